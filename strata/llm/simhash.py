"""Operator 2: SimHash near-duplicates by pivot distance tables.

Fingerprints are made per row; equal ones are one from there on (a group of
copies is one row).  A table holds each fingerprint's Hamming distances to
``PIVOTS`` reference fingerprints, taken block by block: the 64 bits are cut
into max_bits + 2 blocks, and the coordinate for a reference is the sum of its
block distances.  Fingerprints that differ in at most max_bits bits have two
blocks at least in which all coordinates agree, so the table's coordinates
over two blocks are a join key.  Within a key, pairs whose coordinates differ
by more than max_bits anywhere are discarded (Hamming distance is a metric, so
no true pair goes) and the survivors are verified exactly.

A key with more than ``BUCKET`` fingerprints (thousands of near copies) is
not paired: two fingerprints within 2 r bits share a fingerprint within r bits
of either, so its members meet, exactly, at those common neighbours; all that
meet at one are linked, and each links to the least, never pair by pair.
Links go through connected components.

Defined results: a null, empty or blank text has fingerprint 0, linked like
any other; repeated rows share a component; component_id is the smallest
non-null doc_id of the component (null if it has none); an empty table gives
an empty result; other columns are dropped.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from strata.llm.common import Scratch, map_rows, only
from strata.llm.components import components

PIVOTS = 24  # reference fingerprints: more than a block has bits, so coordinates tell blocks apart
BUCKET = 64  # fingerprints of a key that are paired


def fingerprint(text: str, words: int = 3, seed: int = 42) -> int:
    """Bit i is set where over half of the shingles' hashes have it; signed."""
    import numpy as np
    import xxhash

    w = text.encode().lower().split()  # bytes: A-Z only, and space and \x09-\x0D only
    if not w:
        return 0
    shingles = map(b" ".join, zip(*[w[i:] for i in range(words)], strict=False)) if len(w) >= words else [b" ".join(w)]
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(s, seed) for s in shingles], dtype=">u8")
    ones = np.zeros(64, dtype=np.int64)
    for i in range(0, len(h), 1 << 16):  # 4 MB of bits at a time
        ones += np.unpackbits(h[i:i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h)).view(">i8")[0])


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    kind = docs.schema["doc_id"].dataType
    kind = "long" if isinstance(kind, IntegralType) else kind.simpleString()
    return map_rows(only(docs, "doc_id", "text"), lambda b: {
        "doc_id": b["doc_id"], "fp": [fingerprint(t, words) for t in b["text"]]}, f"doc_id {kind}, fp long")


def signed(x: int) -> int:
    x &= (1 << 64) - 1
    return x - (1 << 64) if x >> 63 else x


def pivots(n: int = PIVOTS) -> list[int]:
    """Reference fingerprints: a fixed multiplicative sequence's bits."""
    out, x = [], 1
    for _ in range(n):
        x = x * 6364136223846793005 + 1442695040888963407 & (1 << 64) - 1
        out.append((x ^ x >> 29) * 0xBF58476D1CE4E5B9 & (1 << 64) - 1)
    return out


def blocks(n: int) -> list[int]:
    edges = [64 * i // n for i in range(n + 1)]
    return [(1 << b) - (1 << a) for a, b in zip(edges, edges[1:], strict=False)]


def _distance(fp: Column, pivot: int, mask: int) -> Column:
    return F.bit_count(fp.bitwiseXOR(F.lit(signed(pivot))).bitwiseAND(F.lit(signed(mask))))


def pivot_table(fps: DataFrame, max_bits: int) -> DataFrame:
    """fp, coords (distance to each reference), keys (one for each two blocks)."""
    masks = blocks(max_bits + 2)
    parts = [F.array(*[_distance(F.col("fp"), p, m).cast("tinyint") for p in pivots()]) for m in masks]
    t = fps.select("fp", *[p.alias(f"b{i}") for i, p in enumerate(parts)])
    coords = F.array(*[sum((F.col(f"b{i}")[j].cast("int") for i in range(len(masks))), F.lit(0)) for j in range(PIVOTS)])
    keys = F.array(*[F.xxhash64(F.lit(f"{i},{j}"), f"b{i}", f"b{j}") for i, j in combinations(range(len(masks)), 2)])
    return t.select("fp", coords.cast("array<tinyint>").alias("coords"), keys.alias("keys"))


def near_pairs(table: DataFrame, max_bits: int) -> DataFrame:
    """Pairs a > b of one key, by the table and then exactly."""
    a, b = table.alias("a"), table.alias("b")
    far = F.greatest(*[F.abs(F.col("a.coords")[j].cast("int") - F.col("b.coords")[j].cast("int")) for j in range(PIVOTS)])
    return (a.join(b, (F.col("a.key") == F.col("b.key")) & (F.col("a.fp") > F.col("b.fp")))
            .where(far <= max_bits)
            .where(F.bit_count(F.col("a.fp").bitwiseXOR(F.col("b.fp"))) <= max_bits)
            .select(F.col("a.fp").alias("a"), F.col("b.fp").alias("b")))


def crowded_links(fps: DataFrame, max_bits: int) -> DataFrame:
    """Links among fingerprints of crowded keys, by their common neighbours."""
    flips = [signed(sum(1 << i for i in c)) for r in range(max_bits // 2 + 1) for c in combinations(range(64), r)]
    at = fps.select("fp", F.explode(F.array(*[F.lit(x) for x in flips])).alias("flip")).select(
        "fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("via"))
    least = at.groupBy("via").agg(F.min("fp").alias("m"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return at.join(least, "via").where("fp > m").select(F.col("fp").alias("a"), F.col("m").alias("b")).distinct()


def simhash_groups(docs: DataFrame, words: int = 3, max_bits: int = 2) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id."""
    if max_bits % 2:
        raise ValueError("max_bits is even: neighbours meet half way")
    spark = docs.sparkSession
    scratch = Scratch(spark, "simhash")
    rows = scratch.keep(fingerprints(docs, words))
    fps = rows.groupBy("fp").agg(F.min("doc_id").alias("first"))
    keyed = scratch.keep(pivot_table(fps, max_bits).select("fp", "coords", F.explode("keys").alias("key")))
    sizes = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = scratch.keep(keyed.join(sizes, "key"))
    links = near_pairs(shared.where(F.col("n") <= BUCKET), max_bits).unionByName(
        crowded_links(shared.where(F.col("n") > BUCKET).select("fp").distinct(), max_bits))
    comp = components(links, scratch)
    named = fps.join(comp.withColumnRenamed("node", "fp"), "fp").select("fp", "root", "first")
    roots = fps.select(F.col("fp").alias("root"), F.col("first").alias("r_first"))
    ids = named.groupBy("root").agg(F.min("first").alias("least")).join(roots, "root").select(
        "root", F.least("least", "r_first").alias("component_id"))
    linked = scratch.keep(named.select("fp", "root").unionByName(ids.select(F.col("root").alias("fp"), "root"))
                          .join(ids, "root").select("fp", "component_id"))
    single = fps.select("fp", "first")
    comp_of = single.join(linked, "fp", "left").select("fp", F.coalesce("component_id", "first").alias("component_id"))
    comp_of = scratch.keep(comp_of)  # two shuffle reads at the join below, so AQE can split a hot fingerprint
    return rows.join(comp_of, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, keep: tuple[str, ...] = ("doc_id", "text"), words: int = 3, max_bits: int = 2) -> DataFrame:
    """The ``keep`` columns of the least row of each component.

    A row is known by its doc_id (rows without one come last) and its text's
    hash, so texts that share a doc_id or have none are documents of their
    own; rows that repeat both are one, the least by its other columns."""
    row = F.struct(F.col("doc_id").isNull().alias("none"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("id"),
                   F.xxhash64("text").alias("t"), F.xxhash64("text", F.lit(1)).alias("u"))
    rows = docs.select(row.alias("__row"), F.struct(*keep).alias("__kept"))
    least = rows.groupBy("__row").agg(F.min("__kept").alias("__kept"))
    groups = simhash_groups(docs.select(row.alias("doc_id"), "text"), words, max_bits)
    first = groups.where("doc_id = component_id").select(F.col("doc_id").alias("__row")).distinct()
    return least.join(first, "__row", "left_semi").select("__kept.*")
