"""Operator 12: n-gram Jaccard join by grouped prefixes.

A document is the set of its distinct word shingles (64-bit hashes); equal
sets are one set from the start.  Two sets link at a Jaccard similarity of
``percent`` or more.

Order and prefix: in an order of all shingles, two sets that link share one of
the first n - ceil(t n) + 1 of each.  The order takes a fixed quarter of the
hash space first (chosen by the hash alone), the frequent ones among it last,
by the logarithm of how often they occur over all documents; then by hash.
Counts are exact and over all documents; the ``FREQUENT`` most frequent go to
the tasks, which bounds what is sent and changes the order only, never the
result.  Groups: sets of one size and one prefix are one group.  Groups that share a
prefix shingle are paired and filtered by size and by the places of the
shingle; then they are expanded to their sets, whose parity sketches must not
differ in more bits than two linking sets can differ in shingles.  None of
these filters loses a link.  What is left of a task's pairs is sent on as a
spanning forest, never pair by pair.

Verification: a tree of that forest holds every link of its sets.  Its sets are
brought together once each, and compared exactly, the most central first; sets
that are linked already, directly or over others, are not compared again.  The
result is a star for each group of linked sets.

Memory: a shingle shared by more than ``cell`` sets, and a tree of more than
``tokens`` shingles, is cut into blocks, and every block meets every other in a
cell of its own, each with at most two blocks.  A text is never gathered with
its copies: one row stands for a set.

Defined results: a null, empty or wordless text has no shingles, links with
nothing and is its own component; a document of fewer words than a shingle is
one shingle; component_id is the smallest non-null doc_id that links reach
(null if there is none); repeated rows link as copies; an empty table gives an
empty result; other columns are dropped.  Shingles, or sets, of one 64-bit hash
count as equal.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.llm.common import Scratch, only, shared
from strata.llm.components import components

SKETCH = 256  # bits of a parity sketch; doubled until they are half a set's shingles
QUARTER = -(1 << 63) + (1 << 62)  # signed hashes below it are a quarter
FREQUENT = 100_000  # shingles that the order puts last
SLOTS = 1 << 20  # of row keys: bounds the list that is sent to find the rows whose text is needed
CHUNK = 1 << 20  # bytes of text hashed at once
SMALL = 64  # sets of a shingle up to which shingles are treated together


class Shingles:
    """Sorted distinct shingle hashes of texts, many texts at once."""

    def __init__(self, words: int):
        import numpy as np

        self.words = words
        x, table = 0x9E3779B97F4A7C15, []
        for _ in range(256):  # a fixed random value for each byte
            x = (x + 0x9E3779B97F4A7C15) % 2 ** 64
            z = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 % 2 ** 64
            z = (z ^ z >> 27) * 0x94D049BB133111EB % 2 ** 64
            table.append(z ^ z >> 31)
        self.table = np.array(table, dtype=np.uint64)
        self.base, self.back = 0xD6E8FEB86659FD93, pow(0xD6E8FEB86659FD93, -1, 2 ** 64)
        self.space = np.zeros(256, dtype=bool)
        self.space[[9, 10, 11, 12, 13, 32]] = True
        self.up = self.down = np.ones(0, dtype=np.uint64)

    def _powers(self, n):
        import numpy as np

        if len(self.up) < n:
            self.up, self.down = (np.cumprod(np.concatenate(([np.uint64(1)], np.full(n, x, dtype=np.uint64))), dtype=np.uint64)
                                  for x in (self.base, self.back))
        return self.up, self.down

    @staticmethod
    def _mix(x):
        import numpy as np

        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)

    def __call__(self, texts):
        """One sorted array for each text."""
        part, size = [], 0
        for t in texts:
            t = t.encode().lower()  # of bytes, so A-Z alone
            part.append(t)
            size += len(t)
            if size >= CHUNK:
                yield from self._sets(part)
                part, size = [], 0
        yield from self._sets(part)

    def _sets(self, texts):
        import numpy as np

        if not texts:
            return
        blob = np.frombuffer(b" " + b" ".join(texts) + b" ", dtype=np.uint8)
        begins = np.cumsum([1] + [len(t) + 1 for t in texts])
        up, down = self._powers(len(blob))
        edge = np.flatnonzero(np.diff(self.space[blob])) + 1
        first, last = edge[::2], edge[1::2]
        total = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum(self.table[blob] * up[:len(blob)], dtype=np.uint64)))
        word = self._mix((total[last] - total[first]) * down[first] + (last - first).astype(np.uint64))
        starts = np.searchsorted(first, begins)  # number of each text's first word
        count = np.diff(starts)
        n = self.words
        grams = word[:max(len(word) - n + 1, 0)]
        for k in range(1, n):
            grams = self._mix(grams) + word[k:k + len(grams)]
        grams = self._mix(grams + np.uint64(n)).view(np.int64)
        for a, c in zip(starts[:-1].tolist(), count.tolist(), strict=True):
            if c >= n:
                yield np.unique(grams[a:a + c - n + 1])
            elif c:
                x = word[a:a + 1]
                for k in range(1, c):
                    x = self._mix(x) + word[a + k:a + k + 1]
                yield self._mix(x + np.uint64(c)).view(np.int64)
            else:
                yield np.zeros(0, dtype=np.int64)


def sketch(s):
    import numpy as np

    bits = SKETCH << (max(len(s) - 1, 0) // (2 * SKETCH)).bit_length()
    return np.packbits((np.bincount(s & (bits - 1), minlength=bits) & 1).astype(np.uint8))


class Sketches:
    """Parity sketches of several widths; of two, the wider is folded."""

    def __init__(self, sketches: list[bytes]):
        import numpy as np

        self.width = np.array([len(x) for x in sketches])
        self.at, self.rows = {}, {}
        wider = np.zeros(0, dtype=np.int64), None
        for w in sorted(set(self.width.tolist()), reverse=True):
            own = np.flatnonzero(self.width == w)
            bits = np.frombuffer(b"".join(sketches[i] for i in own), dtype=np.uint64).reshape(len(own), -1)
            if len(wider[0]):
                folded = wider[1]
                while folded.shape[1] > bits.shape[1]:
                    half = folded.shape[1] // 2
                    folded = folded[:, :half] ^ folded[:, half:]
                own, bits = np.concatenate((own, wider[0])), np.concatenate((bits, folded))
            self.rows[w] = bits
            self.at[w] = np.zeros(len(sketches), dtype=np.int64)
            self.at[w][own] = np.arange(len(own))
            wider = own, bits

    def differ(self, x, y):
        """Bits in which rows x and y differ."""
        import numpy as np

        x, y = np.broadcast_arrays(x, y)
        width, out = np.minimum(self.width[x], self.width[y]), np.zeros(len(x), dtype=np.int64)
        for w in np.unique(width).tolist():
            m = np.flatnonzero(width == w)
            out[m] = np.bitwise_count(self.rows[w][self.at[w][x[m]]] ^ self.rows[w][self.at[w][y[m]]]).sum(axis=1, dtype=np.int64)
        return out


def prefix_length(n: int, percent: int) -> int:
    return n + 1 + -percent * n // 100


def shingle_rows(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """doc_id, k (of the row), n, sid (of the set), sketch and low: the set's
    shingles in the first quarter of hashes, a prefix's length at least."""

    def run(batches):
        import numpy as np
        import pyarrow as pa
        import xxhash

        make = Shingles(words)
        for b in batches:
            n, sid, bits, low = [], [], [], []
            for s in make(b.column("text").to_pylist()):
                n.append(len(s))
                sid.append(xxhash.xxh64_intdigest(s.tobytes()) - (1 << 63))
                bits.append(sketch(s).tobytes())
                low.append(s[:max(int(np.searchsorted(s, QUARTER)), prefix_length(len(s), percent) if len(s) else 0)])
            ends = np.cumsum([0] + [len(x) for x in low]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("k"), pa.array(n, pa.int64()), pa.array(sid, pa.int64()), pa.array(bits, pa.binary()),
                 pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, dtype=np.int64), *low])))],
                names=["doc_id", "k", "n", "sid", "sketch", "low"])

    return _keyed(docs).mapInArrow(run, "doc_id long, k long, n long, sid long, sketch binary, low array<long>")


def _keyed(docs: DataFrame) -> DataFrame:
    t = only(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return t.select("doc_id", F.xxhash64(F.col("doc_id").isNull(), "doc_id", "text").alias("k"), "text")


def prefixes(rows: DataFrame, frequent: list[tuple[int, int]], percent: int) -> DataFrame:
    """doc_id, k, sid, n, sketch, and prefix and g (its group) instead of low."""
    import numpy as np

    frequent = sorted(frequent)
    known = (np.array([h for h, _ in frequent], dtype=np.int64),
             np.array([c.bit_length() for _, c in frequent], dtype=np.int8))
    get = shared(rows.sparkSession, known)

    def run(batches):
        import pyarrow as pa
        import xxhash

        hashes, classes = get()
        for b in batches:
            n = b.column("n").to_numpy()
            flat = b.column("low").flatten().to_numpy()
            length = np.diff(b.column("low").offsets.to_numpy())
            ends = np.cumsum(length)
            own = np.repeat(np.arange(len(n)), length)
            rank = np.zeros(len(flat), dtype=np.int8)
            if len(hashes):
                at = np.minimum(np.searchsorted(hashes, flat), len(hashes) - 1)
                rank = np.where(hashes[at] == flat, classes[at], rank)
            rank[flat >= QUARTER] = 127
            order = np.lexsort((flat, rank, own))
            flat = flat[order]
            take = np.minimum(n + 1 + -percent * n // 100, length)
            keep = np.arange(len(flat)) < np.repeat(ends - length + take, length)
            flat, ends = flat[keep], np.concatenate(([0], np.cumsum(take))).astype(np.int32)
            g = [xxhash.xxh64_intdigest(flat[x:y].tobytes(), size) - (1 << 63) for x, y, size in zip(ends, ends[1:], n.tolist(), strict=False)]
            yield pa.RecordBatch.from_arrays(
                [b.column(c) for c in ("doc_id", "k", "sid", "n", "sketch")] +
                [pa.array(g, pa.int64()), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))],
                names=["doc_id", "k", "sid", "n", "sketch", "g", "prefix"])

    return rows.select("doc_id", "k", "sid", "n", "sketch", "low").mapInArrow(
        run, "doc_id long, k long, sid long, n long, sketch binary, g long, prefix array<long>")


class Forest:
    """Union-find over whatever is added."""

    def __init__(self):
        self.up = {}

    def find(self, x):
        up = self.up
        top = x
        while up.get(top, top) != top:
            top = up[top]
        while x != top:
            up[x], x = top, up.get(x, x)
        return top

    def join(self, a, b) -> bool:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)
            self.up.setdefault(min(a, b), min(a, b))
        return a != b


def possible(n1, n2, p1, p2, percent):
    """The shingles in which sets of these sizes may differ if they link; less
    than none where the sizes and the places of a shared shingle rule a link out."""
    import numpy as np

    need = -(-percent * (n1 + n2) // (100 + percent))
    most = np.minimum(p1, p2) + np.minimum(n1 - p1, n2 - p2)
    ok = (100 * np.minimum(n1, n2) >= percent * np.maximum(n1, n2)) & (most >= need)
    return np.where(ok, n1 + n2 - 2 * need, -1)


def _grid(df: DataFrame, sizes: DataFrame, key: str, most: int) -> DataFrame:
    """Rows dealt into cells (key, i, j): one, or where the key's size is over
    ``most`` one for each pair of blocks; ``block`` is the row's own."""
    n = F.ceil(F.coalesce("size", F.lit(1)) / most).cast("int")
    mine = F.pmod(F.xxhash64("sid"), n).cast("int")
    return df.join(sizes, key, "left").withColumn("blocks", n).withColumn("block", mine).withColumn("c", F.explode(
        F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda x: F.struct(
            F.least(x, "block").alias("i"), F.greatest(x, F.col("block")).alias("j"))))).select(
        *[c for c in df.columns], "block", "c.i", "c.j")


def _cells(batches, names):
    """Column lists of whole cells: rows with one (key, i, j), whatever batch they came in."""
    held, cell = None, None
    for b in batches:
        cols = [b.column(n).to_pylist() for n in names]
        keys = list(zip(*cols[:3], strict=True))
        a = 0
        for e in range(1, len(keys) + 1):
            if e < len(keys) and keys[e] == keys[a]:
                continue
            part = [c[a:e] for c in cols]
            if keys[a] == cell:
                for x, y in zip(held, part, strict=True):
                    x.extend(y)
            else:
                if held:
                    yield held
                held, cell = part, keys[a]
            a = e
    if held:
        yield held


def candidate_forest(cells: DataFrame, percent: int) -> DataFrame:
    """a, b: a spanning forest of a task's pairs of sets that may link."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        schema, forest, out = pa.schema([("a", pa.int64()), ("b", pa.int64())]), Forest(), []

        def compare(group, block, sid, n, pos, bits, x, y):
            ok = (group[x] == group[y]) & (sid[x] != sid[y])
            x, y = x[ok], y[ok]
            # a grid's cell compares its two blocks with each other, or a block with itself
            ok = (block[0][x] == block[1][x]) | (block[2][x] != block[2][y])
            x, y = x[ok], y[ok]
            may = possible(n[x], n[y], pos[x], pos[y], percent)
            ok = may >= 0
            x, y, may = x[ok], y[ok], may[ok]
            near = bits.differ(x, y) <= may
            for a, b in zip(sid[x[near]].tolist(), sid[y[near]].tolist(), strict=True):
                if forest.join(a, b):
                    out.append((a, b))
            return y[near]

        def flush():
            rows, out[:] = list(out), []
            if len(forest.up) > 500_000:
                forest.up.clear()
            return pa.RecordBatch.from_pydict({"a": [r[0] for r in rows], "b": [r[1] for r in rows]}, schema=schema)

        def columns(parts):
            cols = [np.array([v for p in parts for v in p[k]], dtype=np.int64) for k in range(7)]
            group = np.repeat(np.arange(len(parts)), [len(p[0]) for p in parts])
            return group, (cols[1], cols[2], cols[3]), cols[4], cols[5], cols[6], Sketches([v for p in parts for v in p[7]])

        def together(parts):
            c = columns(parts)
            rows = np.arange(len(c[0]))
            for d in range(1, max(len(p[0]) for p in parts)):
                compare(*c, rows[:-d], rows[d:])

        small, held = [], 0
        for part in _cells(batches, ("h", "i", "j", "block", "sid", "n", "pos", "sketch")):
            if len(part[0]) <= SMALL:
                small.append(part)
                held += len(part[0])
                if held >= 20_000:
                    together(small)
                    small, held = [], 0
                    yield flush()
            else:
                c = columns([part])
                rows, joined = np.arange(len(c[0])), np.arange(len(c[0]))
                for x in rows[:-1]:
                    y = x + 1 + np.flatnonzero(joined[x + 1:] != joined[x])  # those in x's tree need no other edge
                    for z in compare(*c, np.full(len(y), x), y).tolist():
                        if joined[z] != joined[x]:
                            joined[joined == joined[z]] = joined[x]
                yield flush()
        if small:
            together(small)
        yield flush()

    return cells.mapInArrow(run, "a long, b long")


def exact_stars(cells: DataFrame, words: int, percent: int) -> DataFrame:
    """a, b: each set of a cell with the least of those it is linked with."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        make, schema = Shingles(words), pa.schema([("a", pa.int64()), ("b", pa.int64())])
        for part in _cells(batches, ("tree", "i", "j", "block", "sid", "text")):
            inner = part[1][0] == part[2][0]
            block = np.array(part[3])
            sets = list(make(part[5]))
            part[5] = None
            n = np.array([len(s) for s in sets], dtype=np.int64)
            bits = Sketches([sketch(s).tobytes() for s in sets])
            narrow = bits.rows[bits.width.min()].view(np.uint8)[bits.at[bits.width.min()]]
            middle = np.packbits(2 * sum(np.unpackbits(x).astype(np.int32) for x in narrow) > len(sets))
            order = np.argsort(np.bitwise_count(narrow ^ middle).sum(axis=1, dtype=np.int64), kind="stable")
            sid, joined = np.array(part[4], dtype=np.int64), np.arange(len(sets))
            for at in range(1, len(order)):
                x, y = order[at], order[:at]  # the most central first
                if not inner:
                    y = y[block[y] != block[x]]
                need = -(-percent * (n[x] + n[y]) // (100 + percent))
                differ = bits.differ(x, y) if len(y) else need
                ok = (100 * np.minimum(n[x], n[y]) >= percent * np.maximum(n[x], n[y])) & (differ <= n[x] + n[y] - 2 * need)
                y, need = y[ok], need[ok]
                while len(y):
                    if len(np.intersect1d(sets[x], sets[y[0]], assume_unique=True)) >= need[0]:
                        joined[joined == joined[y[0]]] = joined[x]
                    left = joined[y] != joined[x]
                    left[0] = False
                    y, need = y[left], need[left]
            least = np.full(len(sid), np.iinfo(np.int64).max)
            np.minimum.at(least, joined, sid)
            stars = [(a, b) for a, b in zip(sid.tolist(), least[joined].tolist(), strict=True) if a != b]
            yield pa.RecordBatch.from_pydict({"a": [a for a, _ in stars], "b": [b for _, b in stars]}, schema=schema)

    return cells.mapInArrow(run, "a long, b long")


def _with_roots(comp: DataFrame) -> DataFrame:
    return comp.unionByName(comp.select(F.col("root").alias("node"), "root").distinct())


def jaccard_groups(docs: DataFrame, words: int = 3, percent: int = 90, cell: int = 4096, tokens: int = 4_000_000) -> DataFrame:
    """doc_id, n_shingles, component_id."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "jaccard")
    made = scratch.keep(shingle_rows(docs, words, percent))
    rows = scratch.keep(made.select("doc_id", "n", "sid"))
    counts = scratch.keep(made.select(F.explode("low").alias("h")).groupBy("h").agg(F.count(F.lit(1)).alias("c")).where("c > 1"))
    frequent = counts.where("c >= 16").orderBy(F.desc("c"), "h").limit(FREQUENT).collect()  # bounded by the limit
    one = lambda c: F.any_value(c).alias(c)  # noqa: E731 — the same in every row of the set
    sets = scratch.keep(prefixes(made.where("n > 0"), [tuple(r) for r in frequent], percent).groupBy("sid").agg(
        F.min("doc_id").alias("first"), F.min("k").alias("k"), one("n"), one("sketch"), one("g"), one("prefix")))
    scratch.drop(made)

    # groups: one row of prefix shingles each, wherever another group, or another set of it, shares them.
    # Only shingles counted twice or more can be shared; of those beyond the quarter nothing is known.
    many = scratch.keep(sets.groupBy("g").agg(F.min("sid").alias("head"), F.count(F.lit(1)).alias("members")).where("members > 1"))
    heads = sets.select("g", "sid", "prefix").join(many, "g", "left").where("head IS NULL OR head = sid")
    held = heads.select("g", F.posexplode("prefix").alias("pos", "h"))
    again = heads.where("members > 1").select("g", F.lit(0).alias("pos"), F.col("prefix")[0].alias("h"))
    repeated = scratch.keep(held.where(F.col("h") < QUARTER).join(counts.select("h").hint("merge"), "h", "leftsemi").select("g", "pos", "h")
                            .unionByName(held.where(F.col("h") >= QUARTER)).unionByName(again))
    known = repeated.join(many.select("g", "members"), "g", "left").groupBy("h").agg(
        F.count(F.lit(1)).alias("rows"), F.sum(F.coalesce("members", F.lit(1))).alias("size")).where("rows > 1")
    near = scratch.keep(repeated.join(known, "h").select("g", "h", "pos", "size").distinct())
    sizes = scratch.keep(near.where(F.col("size") > cell).select("h", "size").distinct())
    expanded = near.select("g", "h", "pos").join(sets.select("g", "sid", "n", "sketch").hint("merge"), "g").select("h", "sid", "n", "pos", "sketch")
    cells = _grid(expanded, sizes, "h", cell).repartition("h", "i", "j").sortWithinPartitions("h", "i", "j")
    trees = scratch.keep(_with_roots(components(candidate_forest(cells, percent), scratch)))
    scratch.drop(near)

    # every tree's sets once, by the text of one row each
    wanted = scratch.keep(trees.select(F.col("node").alias("sid"), F.col("root").alias("tree")).join(sets.select("sid", "k", "n"), "sid"))
    sizes = scratch.keep(wanted.groupBy("tree").agg(F.sum("n").alias("size")).where(F.col("size") > tokens))
    # a first look by slots of the row's key, at most SLOTS of them, spares most other texts the shuffle
    slots = wanted.select(F.pmod("k", F.lit(SLOTS)).alias("slot")).distinct()
    texts = _keyed(docs).withColumn("slot", F.pmod("k", F.lit(SLOTS))).join(F.broadcast(slots), "slot", "leftsemi")
    texts = texts.join(wanted.hint("merge"), "k").groupBy("tree", "sid").agg(F.any_value("text").alias("text"))
    cells = _grid(texts, sizes, "tree", tokens).repartition("tree", "i", "j").sortWithinPartitions("tree", "i", "j")
    comp = scratch.keep(_with_roots(components(exact_stars(cells, words, percent), scratch)))

    firsts = sets.select("sid", "first")
    least = comp.join(firsts, comp["node"] == firsts["sid"]).groupBy("root").agg(F.min("first").alias("least"))
    named = comp.join(least, "root").select(F.col("node").alias("sid"), "least")
    of = scratch.keep(firsts.join(named, "sid", "left").select("sid", F.coalesce("least", "first").alias("component_id")))
    return rows.where("n > 0").join(of, "sid").select("doc_id", F.col("n").alias("n_shingles"), "component_id").unionByName(
        rows.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))
