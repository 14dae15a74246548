"""Operator 10: benchmark decontamination by greedy string tiling.

Words (lower case, letters and digits) of a benchmark item and of a document
share *seeds*, runs of ``min_match`` words.  A pair whose shared seeds could
cover ``coverage`` of the item is tiled by running Karp-Rabin: search lengths
fall from long to ``min_match``; at each, rolling hashes of the unmarked runs
find common runs, which are compared, extended and marked, longest first, so
tiles never overlap and their order does not matter.  A document leaks the
item where tiles cover at least that share of the item's words, so passages
that were reordered or interrupted are found as well.

The benchmark is the stated query set and is held against all documents in
blocks: a block's seeds (at most ``block_words``, or one item) are broadcast,
and the documents are read once a block, without a shuffle.

Defined results: a null or empty document leaks nothing; an item with fewer
than ``min_match`` words (a null or empty one too) is contained by a document that has all its words in
a row (no words: by none); repeated items are items; repeated documents give repeated rows; an
empty table on either side gives an empty result; other columns are dropped.
"""

from __future__ import annotations

import re
from collections import defaultdict

from pyspark.sql import DataFrame

from strata.llm.common import map_rows, only, shared

WORD = re.compile(r"[^\W_]+")
BASE, MASK = 0x9E3779B97F4A7C15, (1 << 64) - 1
SCHEMA = "doc_id long, item_id long, coverage double, n_tiles int, longest int"


def words_of(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def _runs(marked: list[bool], length: int):
    """Starts of unmarked runs of that length."""
    free = 0
    for i, m in enumerate(marked):
        free = 0 if m else free + 1
        if free >= length:
            yield i - length + 1


def _hashes(ids: list[int], length: int, starts) -> list[tuple[int, int]]:
    """Karp-Rabin hashes of the runs at ascending starts, rolled where they are adjacent."""
    top, out, last, h = pow(BASE, length - 1, 1 << 64), [], None, 0
    for s in starts:
        if last is not None and s == last + 1:
            h = ((h - ids[last] * top) * BASE + ids[s + length - 1]) & MASK
        else:
            h = 0
            for x in ids[s:s + length]:
                h = (h * BASE + x) & MASK
        out.append((h, s))
        last = s
    return out


def tiles(item: list[int], doc: list[int], min_match: int, longest: int) -> list[tuple[int, int, int]]:
    """Greedy string tiling: (start in item, start in doc, length)."""
    ours, theirs, found, s = [False] * len(item), [False] * len(doc), [], max(longest, min_match)
    while True:
        at = defaultdict(list)
        for h, i in _hashes(item, s, _runs(ours, s)):
            at[h].append(i)
        matches = []
        for h, d in _hashes(doc, s, _runs(theirs, s)) if at else ():
            for i in at.get(h, ()):
                if item[i:i + s] == doc[d:d + s]:
                    k = s
                    while i + k < len(item) and d + k < len(doc) and item[i + k] == doc[d + k] \
                            and not ours[i + k] and not theirs[d + k]:
                        k += 1
                    matches.append((-k, i, d))
        for k, i, d in sorted(matches):
            k = -k
            if not any(ours[i:i + k]) and not any(theirs[d:d + k]):
                ours[i:i + k] = theirs[d:d + k] = [True] * k
                found.append((i, d, k))
        # what a longer match overlapped may still hold shorter ones of this length
        if matches and any(not any(ours[i:i + s]) and not any(theirs[d:d + s]) for _, i, d in matches):
            continue
        if s == min_match:
            return found
        s = max(min_match, s // 2 if s > 2 * min_match else s - 1)


class Block:
    """Some items, their words as numbers and their seeds."""

    def __init__(self, items: list[tuple[int, list[str]]], min_match: int):
        import numpy as np

        self.n = min_match
        self.vocabulary: dict[str, int] = {}
        number = lambda w: self.vocabulary.setdefault(w, len(self.vocabulary) + 1)
        self.items = [(i, [number(w) for w in ws]) for i, ws in items]
        self.seeds = defaultdict(list)
        self.short = defaultdict(list)
        for k, (_, ids) in enumerate(self.items):
            if len(ids) < min_match:
                self.short[len(ids)].append(k)
            for p in range(len(ids) - min_match + 1):
                self.seeds[tuple(ids[p:p + min_match])].append((k, p))
        keys = np.array(list(self.seeds) or [[0] * min_match], dtype=np.uint64)
        self.table = np.zeros(1 << 22, dtype=bool)
        self.table[self._hash(keys.T) >> np.uint64(42)] = True

    @staticmethod
    def _hash(columns):
        import numpy as np

        h = columns[0] * np.uint64(BASE)
        for c in columns[1:]:
            h = (h + c) * np.uint64(BASE)
        return h ^ (h << np.uint64(21))

    def hits(self, ids) -> dict[int, list[tuple[int, int]]]:
        """Place in the documents' words -> (item, place in it) of a shared seed."""
        import numpy as np

        n = len(ids) - self.n + 1
        if n <= 0:
            return {}
        h = self._hash([ids[j:j + n] for j in range(self.n)])
        out = {}
        for p in np.nonzero(self.table[h >> np.uint64(42)])[0].tolist():
            got = self.seeds.get(tuple(ids[p:p + self.n].tolist()))
            if got:
                out[p] = got
        return out

    def leaks(self, ids, hits: dict[int, list[tuple[int, int]]], coverage: float):
        """(item_id, coverage, tiles, longest) of one document."""
        by = defaultdict(list)
        for p in sorted(hits):
            for k, q in hits[p]:
                by[k].append((p, q))
        for k, pairs in sorted(by.items()):
            item_id, item = self.items[k]
            touched = {q + j for q in {q for _, q in pairs} for j in range(self.n)}
            if len(touched) < coverage * len(item):
                continue
            # only words under a seed can be tiled; a gap is a word of no item
            near, last = [], -1
            for p in sorted({p for p, _ in pairs}):
                if p > last + 1:
                    near.append(-1 - len(near))
                near.extend(ids[max(p, last + 1):p + self.n].tolist())
                last = p + self.n - 1
            run, best = {}, 0
            for p, q in pairs:
                run[p - q] = (p, run[p - q][1] + 1) if p - q in run and run[p - q][0] == p - 1 else (p, 1)
                best = max(best, run[p - q][1])
            found = tiles(item, near, self.n, best + self.n - 1)
            covered = sum(t[2] for t in found) / len(item)
            if covered >= coverage:
                yield item_id, covered, len(found), max(t[2] for t in found)

    def short_leaks(self, ids):
        """Items shorter than a seed that stand whole in one document."""
        import numpy as np

        for n, ks in self.short.items():
            for k in ks if 0 < n <= len(ids) else ():
                item_id, item = self.items[k]
                m = len(ids) - n + 1
                if np.logical_and.reduce([ids[j:j + m] == item[j] for j in range(n)]).any():
                    yield item_id, 1.0, 1, n


def _blocks(benchmark: DataFrame, min_match: int, block_words: int):
    items, total = [], 0
    for r in only(benchmark, "item_id", "text").toLocalIterator():
        ws = words_of(r["text"])
        if items and total + len(ws) > block_words:
            yield Block(items, min_match)
            items, total = [], 0
        items.append((r["item_id"], ws))
        total += len(ws)
    yield Block(items, min_match)


def leaks(docs: DataFrame, benchmark: DataFrame, min_match: int = 5, coverage: float = 0.5,
          block_words: int = 1_000_000) -> DataFrame:
    """doc_id, item_id, coverage, n_tiles, longest: one row for each leak."""
    docs, out = only(docs, "doc_id", "text"), None
    for block in _blocks(benchmark, min_match, block_words):
        sent = shared(docs.sparkSession, block)
        part = map_rows(docs, lambda b, sent=sent: _find(b, sent(), coverage), SCHEMA)
        out = part if out is None else out.unionByName(part)
    return out


def clean_documents(docs: DataFrame, benchmark: DataFrame, keep: tuple[str, ...] = ("doc_id", "text"), min_match: int = 5,
                    coverage: float = 0.5, block_words: int = 1_000_000) -> DataFrame:
    """The ``keep`` columns (doc_id and text among them) of documents that leak no item; nothing is shuffled."""
    out = docs.select(*keep)
    for block in _blocks(benchmark, min_match, block_words):
        sent = shared(docs.sparkSession, block)

        def run(batches, sent=sent):
            import pyarrow as pa

            for b in batches:
                n, texts = b.num_rows, b.column("text").to_pylist()
                found = set(_find({"doc_id": range(n), "text": texts}, sent(), coverage)["doc_id"])
                yield b.filter(pa.array([i not in found for i in range(n)], pa.bool_()))

        out = out.mapInArrow(run, out.schema)
    return out


def _find(b: dict, block: Block, coverage: float) -> dict:
    from itertools import repeat

    import numpy as np

    rows = []
    for doc_id, text in zip(b["doc_id"], b["text"], strict=True):
        ws = words_of(text)
        ids = np.fromiter(map(block.vocabulary.get, ws, repeat(0)), dtype=np.uint64, count=len(ws))
        hits = block.hits(ids)
        if hits:
            rows += [(doc_id, *x) for x in block.leaks(ids, hits, coverage)]
        if block.short:
            rows += [(doc_id, *x) for x in block.short_leaks(ids)]
    cols = zip(*rows, strict=True) if rows else [()] * 5
    return dict(zip(("doc_id", "item_id", "coverage", "n_tiles", "longest"), cols, strict=True))
