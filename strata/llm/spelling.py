"""Operator 11: spelling variant grouping by bidirectional FM-index search schemes.

Words of the corpus that occur often enough form a vocabulary; each word's
form is the most frequent word one edit away, if that is frequent enough.

An edit lies in a word's first half or in its second, so the other half stands
unchanged at its end of the near word.  The vocabulary is dealt out by halves:
a word is filed under the beginnings and the ends that a near word can take for
its half (two of each, since lengths differ by at most one) and looks itself up
under its own two.  Words filed together make one text, each word between
delimiters, sorted, so that the suffix rank of a delimiter is the number of its
word; a task holds that text's suffix order forwards and backwards as counts
over its two Burrows-Wheeler transforms.  A search is a pair of intervals of
suffix ranks, one in each order, kept in step: the half with its delimiter is
matched outward to one side, then extended character by character across the
other half, where one character may be put in, left out or replaced.  All
searches of a batch take a step at once.  Words found by an unchanged first
half are left out of the search by the second, so no pair is found twice.

Memory: a beginning or end shared by more than ``crowd`` words is cut into
blocks, and every block of its words meets every block of its searches in an
index of its own; other halves are dealt into texts of about ``rows`` rows.
Word counts are summed in the tasks and then by Spark; a form's chain is
followed by doubling jumps in joins over the words that have a form.

Defined results: a null, empty or wordless text has no words; a null doc_id
counts as an empty one in the hash; repeated rows count again; an empty table
gives an empty result; other columns are dropped.  A run that loses its only
code point is empty and, as any result shorter than ``min_length``, no word.
Words may have any length.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.llm.common import Scratch, only

RUN = "[A-Za-zÀ-ÿ]+"
FLUSH = 200_000  # different words that a task counts before it sends them on
STEP = 8192  # searches that take a step at once
SPAN = 32  # characters between two stored counts of the index


def damaged(doc: str, run: str, every: int = 97) -> str:
    """The run, or without one code point where its hash says so."""
    h = zlib.crc32(f"{doc}:{run}".encode())
    if every and h % every == 0:
        i = h % len(run)
        return run[:i] + run[i + 1:]
    return run


def word_counts(docs: DataFrame, min_length: int = 5, every: int = 97) -> DataFrame:
    """word, n over all texts; the tasks send partial counts."""

    def run(batches):
        import pyarrow as pa

        runs, total = re.compile(RUN), Counter()

        def flush():
            out = pa.RecordBatch.from_pydict({"word": list(total), "n": list(total.values())},
                                             schema=pa.schema([("word", pa.string()), ("n", pa.int64())]))
            total.clear()
            return out

        for b in batches:
            for doc, text in zip(b.column("doc").to_pylist(), b.column("text").to_pylist(), strict=True):
                lower = text.encode().lower().decode()  # of bytes, so A-Z alone
                for w, n in Counter(runs.findall(lower)).items():
                    if len(w) >= min_length:
                        w = damaged(doc, w, every)
                        if len(w) >= min_length:
                            total[w] += n
                if len(total) > FLUSH:
                    yield flush()
        yield flush()

    rows = only(docs, "doc_id", "text").select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc"), "text")
    return rows.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


class Vocabulary:
    """Bidirectional FM-index of sorted distinct words between delimiters."""

    def __init__(self, words: list[str]):
        import numpy as np

        self.words = words
        text = np.array([ord(c) for c in "\0" + "\0".join(words)], dtype=np.int32)
        self.alphabet, codes = np.unique(text, return_inverse=True)  # the delimiter is 0
        self.sigma = len(self.alphabet)
        self.code_of = {int(c): i for i, c in enumerate(self.alphabet)}
        codes = codes.astype(np.uint8)  # RUN has 116 characters
        self.n = len(codes)
        self.smaller = np.concatenate(([0], np.cumsum(np.bincount(codes, minlength=self.sigma))))
        # sides: 0 extends to the left (order of the text), 1 to the right (order of the reversed text)
        self.sides = [self._side(codes), self._side(codes[::-1])]

    def _side(self, codes):
        """Blocks of the transform, and how many characters below each code stand before each block."""
        import numpy as np

        bwt = codes[(self._suffixes(codes) - 1) % self.n]
        blocks = -(-self.n // SPAN) + 1
        padded = np.full(blocks * SPAN, 255, dtype=np.uint8)
        padded[:self.n] = bwt
        padded = padded.reshape(blocks, SPAN)
        per = np.zeros((blocks + 1, self.sigma + 1), dtype=np.int32)
        at = np.arange(self.n) // SPAN
        per[1:, 1:] = np.bincount(at * self.sigma + bwt, minlength=blocks * self.sigma).reshape(blocks, self.sigma)
        return padded, np.cumsum(np.cumsum(per, axis=0, dtype=np.int32), axis=1, dtype=np.int32)

    def _suffixes(self, codes):
        """Start of each rotation in order, by doubling; no two are equal as the words differ."""
        import numpy as np

        wide, rank = 8, np.zeros(self.n, dtype=np.int64)  # eight characters below 128 in a long
        for i in range(wide):
            rank = rank << 7 | np.roll(codes, -i)
        while True:
            order = np.argsort(rank, kind="stable")
            new = rank[order]
            first = np.concatenate(([0], np.cumsum(new[1:] != new[:-1])))
            if first[-1] == self.n - 1:
                return order
            rank = np.empty(self.n, dtype=np.int64)
            rank[order] = first
            rank = rank * self.n + np.roll(rank, -(wide % self.n))
            wide *= 2

    def _below(self, side, code, at):
        """Characters below code and up to code among the first ``at`` of the transform."""
        import numpy as np

        blocks, stored = side
        block = at // SPAN
        near, inside = blocks[block], np.arange(SPAN) < (at % SPAN)[:, None]
        less = ((near < code[:, None]) & inside).sum(axis=1)
        same = ((near == code[:, None]) & inside).sum(axis=1)
        return stored[block, code] + less, stored[block, code + 1] + less + same

    def extend(self, way: int, at, code):
        """Intervals (rank in side ``way``, rank in the other, size) after one more character."""
        mine, other, size = at
        low, low_next = self._below(self.sides[way], code, mine)
        high, high_next = self._below(self.sides[way], code, mine + size)
        return self.smaller[code] + low_next - low, other + high - low, (high_next - low_next) - (high - low)

    def children(self, way: int, at):
        """All non-empty one-character extensions: row, code, intervals."""
        import numpy as np

        mine, other, size = at
        ends = []
        blocks, stored = self.sides[way]
        for where in (mine, mine + size):
            block = where // SPAN
            rows, cols = np.nonzero(np.arange(SPAN) < (where % SPAN)[:, None])
            inner = np.bincount(rows * (self.sigma + 1) + blocks[block[rows], cols] + 1,
                                minlength=len(where) * (self.sigma + 1)).reshape(len(where), -1)
            ends.append(stored[block] + np.cumsum(inner, axis=1))
        below = ends[1] - ends[0]
        count = np.diff(below, axis=1)
        row, code = np.nonzero(count)
        start = np.diff(ends[0], axis=1)[row, code]
        return row, code, (self.smaller[code] + start, other[row] + below[row, code], count[row, code])

    def _codes(self, words: list[str]):
        import numpy as np

        length = np.array([len(w) for w in words])
        flat = np.array([self.code_of.get(ord(c), 255) for c in "".join(words)], dtype=np.int64)
        return flat, np.concatenate(([0], np.cumsum(length)))[:-1], length

    def near(self, words: list[str], half_kept: int):
        """(i, j): vocabulary word j is one edit from words[i], whose first (0)
        or second (1) half stands unchanged at that end of it."""
        import numpy as np

        flat, start, length = self._codes(words)
        n, half = len(words), length // 2
        way = 1 if half_kept == 0 else 0  # across the other half
        size = half if half_kept == 0 else length - half
        q = np.arange(n)
        at = (np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64), np.full(n, self.n, dtype=np.int64))
        r = 0
        while len(q):  # the half outward from the middle, then its delimiter
            inside = r < size[q]
            place = start[q] + (half[q] - 1 - r if half_kept == 0 else half[q] + r)
            code = np.where(inside, flat[np.where(inside, place, 0)], 0)
            known = code < self.sigma
            q, inside, code, at = q[known], inside[known], code[known], tuple(x[known] for x in at)
            at = self.extend(1 - way, at, code)
            live = at[2] > 0
            if r == 0:
                done = (q[:0], tuple(x[:0] for x in at))
            over = live & ~inside
            done = (np.concatenate((done[0], q[over])), tuple(np.concatenate((a, b[over])) for a, b in zip(done[1], at, strict=True)))
            go = live & inside
            q, at = q[go], tuple(x[go] for x in at)
            r += 1
        if not n:
            return q, q
        q, at = done
        at = (at[1], at[0], at[2])  # now extended the other way
        left = length - size

        def char(q, r):  # the character at r of the other half, from the middle
            ok = r < left[q]
            place = np.where(ok, start[q] + (half[q] + r if half_kept == 0 else half[q] - 1 - r), 0)
            return np.where(ok, flat[place], -1)

        def join(parts):
            return (np.concatenate([p[0] for p in parts]), tuple(np.concatenate([p[1][i] for p in parts]) for i in range(3)))

        exact, edited, found, r = (q, at), [], [], 0
        while len(exact[0]) or any(len(p[0]) for p in edited):
            now, later, ahead = edited, [], []
            for a in range(0, len(exact[0]), STEP):
                q, at = exact[0][a:a + STEP], tuple(x[a:a + STEP] for x in exact[1])
                want, following = char(q, r), char(q, r + 1)
                row, code, to = self.children(way, at)
                real = code > 0
                row, code, to = row[real], code[real], tuple(x[real] for x in to)
                same, whole = code == want[row], want[row] < 0
                pick = lambda m: (q[row[m]], tuple(x[m] for x in to))
                now.append(pick(~same))  # put in; before an equal character it is the same as after it
                later.append(pick(~same & ~whole))  # replaced
                ahead.append(pick(same))
                out = (want >= 0) & (want != following)  # left out: the last of a run of equal ones
                later.append((q[out], tuple(x[out] for x in at)))
            q, at = join(now) if now else (exact[0][:0], tuple(x[:0] for x in exact[1]))
            for a in range(0, len(q), STEP * 8):
                qs, ats = q[a:a + STEP * 8], tuple(x[a:a + STEP * 8] for x in at)
                code = char(qs, r)
                known = code < self.sigma
                qs, code, ats = qs[known], code[known], tuple(x[known] for x in ats)
                to = self.extend(way, ats, np.maximum(code, 0))  # at the end the delimiter follows
                live = to[2] > 0
                ended = live & (code < 0)
                # a whole word begins with a delimiter, so its rank in the text's order is its number
                found.append((qs[ended], (to[1] if way == 1 else to[0])[ended]))
                live &= code >= 0
                later.append((qs[live], tuple(x[live] for x in to)))
            exact = join(ahead) if ahead else (exact[0][:0], tuple(x[:0] for x in exact[1]))
            edited = later
            r += 1
        if not found:
            return q[:0], q[:0]
        pair = np.unique(np.concatenate([f[0] for f in found]) * len(self.words) + np.concatenate([f[1] for f in found]))
        return pair // len(self.words), pair % len(self.words)


def _filed(words: DataFrame) -> DataFrame:
    """key (of a half), asks, word, n: a word under its own two halves (asks)
    and under those that a near word can have."""
    w, m = F.col("word"), F.length("word")

    def halves(m, asks):
        h = F.floor(m / 2).cast("int")
        return [F.struct(F.xxhash64(F.lit(i), part).alias("key"), F.lit(i).alias("half"), F.lit(asks).alias("asks"))
                for i, part in enumerate((F.substr(w, F.lit(1), h), F.substr(w, F.length(w) - (m - h) + 1, m - h)))]

    under = F.array_distinct(F.array(*[k for d in (-1, 0, 1) for k in halves(m + d, False)]))
    return words.select("word", "n", F.explode(F.concat(F.array(*halves(m, True)), under)).alias("k")).select(
        "k.key", "k.half", "k.asks", "word", "n")


def near_words(words: DataFrame, scratch: Scratch, rows: int = 120_000, crowd: int = 20_000) -> DataFrame:
    """word, n_near and the best near word of each word that has one, one row a half."""
    spark = words.sparkSession
    filed = _filed(words)
    sizes = filed.where("NOT asks").groupBy("key").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > crowd)
    sizes = scratch.keep(sizes)
    total = words.count() * 6
    texts = max(1, -(-total // rows))
    parts = max(texts, int(spark.conf.get("spark.sql.shuffle.partitions")))
    # a crowded half's blocks of words (i) meet its blocks of searches (j)
    blocks = F.ceil(F.col("size") / crowd).cast("int")
    mine = F.pmod(F.xxhash64("word"), blocks).cast("int")
    each = F.sequence(F.lit(0), blocks - 1)
    cells = F.when(F.col("size").isNull(), F.array(F.struct(
        F.pmod("key", F.lit(texts)).alias("text"), F.lit(-1).alias("i"), F.lit(-1).alias("j")))).when(
        F.col("asks"), F.transform(each, lambda i: F.struct(F.col("key").alias("text"), i.alias("i"), mine.alias("j")))).otherwise(
        F.transform(each, lambda j: F.struct(F.col("key").alias("text"), mine.alias("i"), j.alias("j"))))
    dealt = filed.join(sizes, "key", "left").select("half", "asks", "word", "n", F.explode(cells).alias("c")).select(
        "c.text", "c.i", "c.j", "asks", "half", "word", "n")
    dealt = dealt.repartition(parts, "text", "i", "j").sortWithinPartitions("text", "i", "j", "asks", "word")

    def search(batches):
        import pyarrow as pa

        schema = pa.schema([("word", pa.string()), ("n_near", pa.int64()), ("best_n", pa.int64()), ("best", pa.string())])
        cell, index, known = None, None, {}

        def look_up(asking):
            out = {}
            for half in (0, 1):
                words = [w for w, h in asking if h == half]
                for i, j in zip(*[x.tolist() for x in index.near(words, half)], strict=True):
                    w, other = words[i], index.words[j]
                    if half and other.startswith(w[:len(w) // 2]):
                        continue  # the search by the first half has it
                    found, n = out.get((w, half)), known[other]
                    if found is None:
                        out[w, half] = [1, n, other]
                    else:
                        found[0] += 1
                        if n > found[1] or n == found[1] and other < found[2]:
                            found[1:] = n, other
            rows = [(w, *v) for (w, _), v in out.items()]
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(schema)], schema=schema)

        for b in batches:
            asking = []
            for text, i, j, asks, half, word, n in zip(*[c.to_pylist() for c in b.columns], strict=True):
                if (text, i, j) != cell:
                    if asking:
                        yield look_up(asking)
                        asking = []
                    cell, index, known = (text, i, j), None, {}
                if not asks:
                    known[word] = n
                    continue
                if not known:
                    continue  # nothing is filed in this block
                if index is None:
                    index = Vocabulary(sorted(known))
                asking.append((word, half))
            if asking:
                yield look_up(asking)

    return dealt.mapInArrow(search, "word string, n_near long, best_n long, best string")


def _roots(forms: DataFrame, scratch: Scratch) -> DataFrame:
    """word, root of the words with a form, by jumps twice as far each round."""
    jumps = scratch.keep(forms.select("word", F.col("form").alias("root")))
    while True:
        on = jumps.select(F.col("word").alias("root"), F.col("root").alias("next"))
        new = scratch.keep(jumps.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"),
                                                                F.col("next").isNotNull().alias("moved")))
        scratch.drop(jumps)
        jumps = new.select("word", "root")
        if not new.where("moved").limit(1).count():
            return jumps


def spelling_variants(docs: DataFrame, min_length: int = 5, min_count: int = 3, every: int = 97, times: int = 2,
                      rows: int = 120_000, crowd: int = 20_000) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of the vocabulary."""
    scratch = Scratch(docs.sparkSession, "spelling")
    words = scratch.keep(word_counts(docs, min_length, every).where(F.col("n") >= min_count))
    return _variants(words, scratch, times, rows, crowd)


def _variants(words: DataFrame, scratch: Scratch, times: int, rows: int, crowd: int) -> DataFrame:
    best = F.min(F.struct((-F.col("best_n")).alias("less"), "best"))  # most frequent, then least in code point order
    near = near_words(words, scratch, rows, crowd).groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b"))
    form = F.when(-F.col("b.less") >= times * F.col("n"), F.col("b.best"))
    found = scratch.keep(words.join(near, "word", "left").select(
        "word", form.alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(form.isNotNull(), -F.col("b.less")).alias("form_n")))
    roots = _roots(found.where("form IS NOT NULL"), scratch)
    return found.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
