"""Operator 4: removal of repeated byte strings by deep-shallow suffix sorting.

A byte goes if a string of ``length`` bytes that covers it also starts
anywhere else.  Sorting every suffix of a corpus would move each byte
``length`` times over, so suffixes are sorted where it matters:

1. *Anchors.*  In each run of ``length`` bytes the gram of ``GRAM`` bytes with
   the least hash (the rightmost of equals) is its anchor.  Equal runs have
   their anchors at the same place, so a run needs to be compared only with
   runs of the same anchor gram.  Consecutive runs mostly share an anchor; the
   bytes of an anchor's runs are its context.
2. *Contexts* meet by gram hash, in sorted order: those that occur twice as a
   whole are repeated as a whole; a gram with one context only is done.
3. *Suffixes.*  For a gram with several contexts, their bytes are fetched and
   the suffixes from the anchor on, and the reversed ones before it, are sorted:
   multikey quicksort to ``SHALLOW`` bytes, then blind tries for the groups
   whose prefix is longer.  Neighbours' common prefixes give, for each offset,
   the classes of equal left and right parts; a run is repeated where another
   context has both classes.  A gram with more than ``CROWD`` contexts is not
   gathered in a task: its runs are compared by 128-bit hashes in a partial
   aggregate.

Spans then go back to their documents.  Texts are shuffled twice, anchors
once; no step holds more than one gram's contexts, up to CROWD, at a time.

Defined results: a null or empty text has no bytes, texts under ``length``
bytes lose nothing; repeated rows are documents of their own, so their long
strings repeat; rows of one doc_id (null too) with different texts stay apart;
an empty table gives an empty result; other columns are dropped.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.llm.common import Scratch, only

LENGTH = 200
GRAM = 64
SHALLOW = 24
CROWD = 20_000
CHUNK = 1 << 19  # run starts looked at together
ROWS = 20_000  # of an Arrow batch that a step returns


def gram_hashes(data, gram: int):
    """Hash of the gram bytes from each place (a power of two), by doubling."""
    import numpy as np

    h = data.astype(np.uint64) + np.uint64(0x9E37)
    step, factor = 1, 0x9E3779B97F4A7C15
    while step < gram:
        h = h[:-step] * np.uint64(factor) + h[step:]
        factor = factor * factor + 2 & (1 << 64) - 1
        step *= 2
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def least_places(h, width: int):
    """For each window of that many hashes, the place of the least, rightmost."""
    import numpy as np

    value, place = h, np.arange(len(h), dtype=np.int64)
    have, out = 1, None
    span = width
    # windows of powers of two, put together by the binary digits of the width
    while True:
        if span & 1:
            if out is None:
                out, at = (value, place), have
            else:
                v, p = out
                n = len(h) - at - have + 1
                later = value[at:at + n] <= v[:n]
                out, at = (np.where(later, value[at:at + n], v[:n]), np.where(later, place[at:at + n], p[:n])), at + have
        span >>= 1
        if not span:
            return out[1]
        n = len(value) - have
        later = value[have:] <= value[:n]
        value, place = np.where(later, value[have:], value[:n]), np.where(later, place[have:], place[:n])
        have *= 2


def anchors(data: bytes, length: int, gram: int):
    """(anchor, first run start, last run start, gram hash) of all runs."""
    import numpy as np

    whole = np.frombuffer(data, dtype=np.uint8)
    runs = len(data) - length + 1
    for a in range(0, max(runs, 0), CHUNK):
        b = min(a + CHUNK, runs)
        h = gram_hashes(whole[a:b + length - 1], gram)
        place = least_places(h, length - gram + 1)
        cut = np.flatnonzero(np.diff(place)) + 1
        first = np.concatenate([[0], cut])
        last = np.concatenate([cut - 1, [len(place) - 1]])
        yield place[first] + a, first + a, last + a, h[place[first]].view(np.int64)


# -------------------------------------------------------- deep-shallow sort
def common(a: bytes, b: bytes, known: int = 0) -> int:
    """Length of the common prefix, at least known."""
    n = min(len(a), len(b))
    if a[known:n] == b[known:n]:
        return n
    x = int.from_bytes(a[known:n]) ^ int.from_bytes(b[known:n])
    return n - (x.bit_length() + 7) // 8


class BlindTrie:
    """Orders strings with a long common prefix: a node has the depth where
    its strings part and a branch by the byte there (-1: ended).  A string
    goes down by those bytes alone, is compared once with the leaf it comes
    to, and enters where they part."""

    def __init__(self, strings: list[bytes], known: int):
        self.s, self.known, self.root = strings, known, None

    @staticmethod
    def _at(s: bytes, depth: int) -> int:
        return s[depth] if depth < len(s) else -1

    def add(self, i: int) -> None:
        s = self.s[i]
        if self.root is None:
            self.root = [i]
            return
        node = self.root
        while isinstance(node, tuple):
            node = node[1].get(self._at(s, node[0])) or next(iter(node[1].values()))
        other = self.s[node[0]]
        depth = common(s, other, self.known)
        if depth == len(s) == len(other):
            node.append(i)
            return
        up, node = None, self.root
        while isinstance(node, tuple) and node[0] < depth:
            up, node = node, node[1][self._at(s, node[0])]
        if isinstance(node, tuple) and node[0] == depth:
            node[1][self._at(s, depth)] = [i]
            return
        new = (depth, {self._at(other, depth): node, self._at(s, depth): [i]})
        if up is None:
            self.root = new
        else:
            up[1][self._at(s, up[0])] = new

    def ordered(self, first: int):
        """(string, common prefix with the one before); first: that of the first."""
        todo = [(self.root, first)]
        while todo:
            node, lcp = todo.pop()
            if isinstance(node, tuple):
                keys = sorted(node[1], reverse=True)
                todo += [(node[1][k], lcp if k == keys[-1] else node[0]) for k in keys]
            else:
                yield node[0], lcp
                for i in node[1:]:
                    yield i, len(self.s[i])


def deep_shallow_sort(strings: list[bytes], shallow: int = SHALLOW) -> tuple[list[int], list[int]]:
    """Order of the strings and each one's common prefix with the one before."""
    order, lcps = [], []
    todo = [(list(range(len(strings))), 0, 0)]  # strings, depth they agree to, prefix shared with what comes before
    while todo:
        group, depth, lcp = todo.pop()
        if len(group) == 1:
            order.append(group[0])
            lcps.append(lcp)
        elif depth >= shallow:
            trie = BlindTrie(strings, depth)
            for i in group:
                trie.add(i)
            for i, n in trie.ordered(lcp):
                order.append(i)
                lcps.append(n)
        elif group:
            at = [strings[i][depth] if depth < len(strings[i]) else -1 for i in group]
            pivot = sorted((at[0], at[len(at) // 2], at[-1]))[1]
            less = [i for i, c in zip(group, at, strict=True) if c < pivot]
            same = [i for i, c in zip(group, at, strict=True) if c == pivot]
            more = [i for i, c in zip(group, at, strict=True) if c > pivot]
            if more:
                todo.append((more, depth, depth))
            if pivot < 0:  # ended: all equal
                here = lcp if not less else depth
                if less:
                    todo.append((less, depth, lcp))
                for k, i in enumerate(same):
                    order.append(i)
                    lcps.append(here if not k else depth)
            else:
                todo.append((same, depth + 1, depth if less else lcp))
                if less:
                    todo.append((less, depth, lcp))
    return order, lcps


def _classes(strings: list[bytes], length: int):
    """sorted place of each string, and common prefixes in sorted order."""
    import numpy as np

    order, lcps = deep_shallow_sort(strings)
    place = np.empty(len(strings), dtype=np.int64)
    place[np.array(order)] = np.arange(len(strings))
    return place, np.array(lcps)


def repeated_runs(contexts: list[bytes], left: list[int], length: int) -> list[tuple[int, int, int]]:
    """(context, first, last run start in it) of runs that another context has
    with the same anchor; left[i] bytes of a context stand before its anchor.
    Contexts may belong to several grams."""
    import numpy as np

    before = [c[:k][::-1] for c, k in zip(contexts, left, strict=True)]
    after = [c[k:] for c, k in zip(contexts, left, strict=True)]
    l_place, l_lcp = _classes(before, length)
    r_place, r_lcp = _classes(after, length)
    n_left = np.array(left)
    # runs start at offsets 0 .. len(context) - length, that is left - offset before the anchor
    least = n_left - np.array([len(c) - length for c in contexts])
    out = []
    for d in range(int(n_left.max(initial=0)) + 1):
        who = np.flatnonzero((least <= d) & (d <= n_left))
        if len(who) < 2:
            continue
        l_class, r_class = np.cumsum(l_lcp < d), np.cumsum(r_lcp < length - d)
        pair = l_class[l_place[who]] * (len(contexts) + 1) + r_class[r_place[who]]
        _, back, n = np.unique(pair, return_inverse=True, return_counts=True)
        hit = who[n[back] > 1]
        out.append(np.column_stack([hit, n_left[hit] - d]))
    if not out:
        return []
    both = np.concatenate(out)
    both = both[np.lexsort((both[:, 1], both[:, 0]))]
    cut = np.flatnonzero((np.diff(both[:, 0]) != 0) | (np.diff(both[:, 1]) != 1)) + 1
    first, last = np.concatenate([[0], cut]), np.concatenate([cut - 1, [len(both) - 1]])
    return [(int(both[a, 0]), int(both[a, 1]), int(both[b, 1])) for a, b in zip(first, last, strict=True)]


# ------------------------------------------------------------------- Spark
ID = "d long, t long"  # a document: doc_id (null as it is) and a hash of its text
FOUND = f"{ID}, gram long, at long, lo long, hi long, whole boolean"


def _bytes(docs: DataFrame) -> DataFrame:
    return only(docs, "doc_id", "text").select(F.col("doc_id").alias("d"), F.xxhash64("text").alias("t"),
                                               F.col("text").cast("binary").alias("b"))


def _batches(rows, fields: str):
    """Tuples as Arrow batches of a bounded number of rows."""
    from itertools import batched

    import pyarrow as pa

    kinds = {"long": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary(), "string": pa.string()}
    schema = pa.schema([(n, kinds[k]) for n, k in (f.split() for f in fields.split(", "))])
    for part in batched(rows, ROWS):
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*part, strict=True), schema, strict=True)],
                                         schema=schema)


def _rows(batches, *names: str):
    for batch in batches:
        yield from zip(*[batch.column(n).to_pylist() for n in names], strict=True)


ANCHORS = f"{ID}, gram long, ctx long, at long, lo long, hi long, n long"


def _anchor_rows(length: int, gram: int):
    """One row for each context of a document and its count there.  A text
    that goes on repeating itself has few; where its other occurrences stand
    follows as spans (rows without a gram, start and stop in lo and hi)."""
    def rows(batches):
        import xxhash

        for d, t, b in _rows(batches, "d", "t", "b"):
            first, more = {}, []
            for found in anchors(b, length, gram):
                for at, lo, hi, g in zip(*[x.tolist() for x in found], strict=True):
                    key = g, xxhash.xxh64_intdigest(b[lo:hi + length], at - lo)
                    if key in first:
                        first[key][3] += 1
                        more.append((lo, hi + length))
                    else:
                        first[key] = [at, lo, hi, 1]
            for (g, c), (at, lo, hi, n) in first.items():
                yield d, t, g, c - (1 << 64) if c >> 63 else c, at, lo, hi, n
            for start, stop in merge_spans(more):
                yield d, t, None, None, None, start, stop, None

    return lambda batches: _batches(rows(batches), ANCHORS)


def _met(length: int):
    """Rows sorted by gram and context -> contexts that occur twice (whole),
    and one row of each context of a gram that has several: whole is false for
    a single one, null for a witness, which is repeated anyway but may share
    parts with others.  Holds one row."""
    def rows(batches):
        first, last, total, n_ctx = None, None, 0, 0
        for d, t, g, c, at, lo, hi, n in _rows(batches, "d", "t", "gram", "ctx", "at", "lo", "hi", "n"):
            if g is None:
                yield d, t, None, None, lo, hi - length, True
                continue
            row, same_gram = (d, t, g, at, lo, hi), first is not None and g == first[2]
            if same_gram and c == last:
                if total == 1:
                    yield *first, True
                yield *row, True
                total += n
                continue
            if same_gram or n_ctx > 1:
                yield *first, False if total == 1 else None
            n_ctx = n_ctx + 1 if same_gram else 1
            first, last, total = row, c, n
            if n > 1:
                yield *row, True
        if n_ctx > 1:
            yield *first, False if total == 1 else None

    return lambda batches: _batches(rows(batches), FOUND)


CONTEXTS = f"{ID}, gram long, at long, lo long, witness boolean, crowded boolean, c binary"


def _fetched(length: int):
    def rows(batches):
        for d, t, b, wanted in _rows(batches, "d", "t", "b", "w"):
            for w in wanted:
                yield (d, t, w["gram"], w["at"], w["lo"], w["whole"] is None, w["crowded"],
                       b[w["lo"]:w["hi"] + length])

    return lambda batches: _batches(rows(batches), CONTEXTS)


SPANS = f"{ID}, start long, stop long"


def _sorted_runs(length: int):
    """Contexts sorted by gram -> spans; whole grams are sorted together, a bounded number of rows at once."""
    def spans(held):
        for k, a, z in repeated_runs([r[5] for r in held], [r[3] - r[4] for r in held], length):
            d, t, _, _, lo, _, witness = held[k]
            if not witness:
                yield d, t, lo + a, lo + z + length

    def rows(batches):
        held = []
        for r in _rows(batches, "d", "t", "gram", "at", "lo", "c", "witness"):
            if len(held) >= ROWS and r[2] != held[-1][2]:
                yield from spans(held)
                held = []
            held.append(r)
        yield from spans(held)

    return lambda batches: _batches(rows(batches), SPANS)


RUNS = f"{ID}, start long, witness boolean, h binary"


def _single_runs(length: int):
    def rows(batches):
        import xxhash

        for d, t, lo, c, w in _rows(batches, "d", "t", "lo", "c", "witness"):
            for i in range(len(c) - length + 1):
                yield d, t, lo + i, w, xxhash.xxh128_digest(c[i:i + length])

    return lambda batches: _batches(rows(batches), RUNS)


def repeated_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, crowd: int = CROWD) -> DataFrame:
    """d, t, start, stop: byte spans covered by repeated strings; they may overlap."""
    scratch = Scratch(docs.sparkSession, "suffix-dedup")
    data = _bytes(docs)
    rows = data.where(F.length("b") >= length).mapInArrow(_anchor_rows(length, gram), ANCHORS)
    rows = rows.repartition(F.coalesce("gram", F.xxhash64("d", "lo"))).sortWithinPartitions("gram", "ctx")
    found = scratch.keep(rows.mapInArrow(_met(length), FOUND))
    whole = found.where("whole").select("d", "t", F.col("lo").alias("start"), (F.col("hi") + length).alias("stop"))

    parts = found.where("whole IS NULL OR NOT whole")
    sizes = parts.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    parts = parts.join(sizes.where(F.col("n") > crowd).select("gram", F.lit(True).alias("crowded")), "gram", "left")
    wanted = parts.groupBy("d", "t").agg(F.collect_set(F.struct(
        "gram", "at", "lo", "hi", "whole", F.coalesce("crowded", F.lit(False)).alias("crowded"))).alias("w"))
    key = F.coalesce("d", F.lit(0)), F.col("d").isNull(), F.col("t")  # plain keys, so that nulls meet
    wanted = wanted.select(*[c.alias(f"k{i}") for i, c in enumerate(key)], "w")
    texts = data.select("d", "t", "b", *[c.alias(f"k{i}") for i, c in enumerate(key)]).join(wanted, ["k0", "k1", "k2"])
    contexts = texts.select("d", "t", "b", "w").mapInArrow(_fetched(length), CONTEXTS)
    contexts = contexts.repartition(F.when(F.col("crowded"), F.xxhash64("d", "lo")).otherwise(F.col("gram")))
    few = contexts.where("NOT crowded").sortWithinPartitions("gram").mapInArrow(_sorted_runs(length), SPANS)
    spans = whole.unionByName(few)
    if not sizes.where(F.col("n") > crowd).isEmpty():
        runs = scratch.keep(contexts.where("crowded").mapInArrow(_single_runs(length), RUNS))
        often = runs.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h")
        spans = spans.unionByName(runs.where("NOT witness").join(often, "h").select(
            "d", "t", "start", (F.col("start") + length).alias("stop")))
    return scratch.keep(spans)


def merge_spans(spans) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _cut(kept: bool):
    def rows(batches):
        for d, b, spans in _rows(batches, "d", "b", "s"):
            gone, at, parts = merge_spans((x["start"], x["stop"]) for x in spans or ()), 0, []
            for a, z in gone:
                parts.append(b[at:a])
                at = z
            left = b"".join([*parts, b[at:]])
            yield (d, len(b), len(b) - len(left), len(gone), hashlib.sha256(left).hexdigest(), *[left][:kept])

    return lambda batches: _batches(rows(batches), RESULT + ", kept binary" * kept)


def suffix_dedup(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, crowd: int = CROWD, kept: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, and kept (the bytes left) if wanted."""
    spans = repeated_spans(docs, length, gram, crowd).groupBy("d", "t").agg(
        F.collect_set(F.struct("start", "stop")).alias("s"))  # one document's spans
    key = F.coalesce("d", F.lit(0)), F.col("d").isNull(), F.col("t")
    spans = spans.select(*[c.alias(f"k{i}") for i, c in enumerate(key)], "s")
    rows = _bytes(docs).select("d", "b", *[c.alias(f"k{i}") for i, c in enumerate(key)]).join(spans, ["k0", "k1", "k2"], "left")
    return rows.select("d", "b", "s").mapInArrow(_cut(kept), RESULT + ", kept binary" * kept)
