"""The Jaccard join against all pairs of sets."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from strata.llm import jaccard_join as J
from strata.llm import queries as Q
from tests.conftest import SMOKE

DOCS = "doc_id long, text string"


def shingles(text, words=3):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if len(w) < words:
        return frozenset([" ".join(w)] if w else [])
    return frozenset(" ".join(w[i:i + words]) for i in range(len(w) - words + 1))


def plain(rows, words=3, percent=90):
    sets = [shingles(t, words) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    where = {}
    for i, s in enumerate(sets):
        for j in {j for g in s for j in where.get(g, ())}:
            both = len(s & sets[j])
            if 100 * both >= percent * (len(s) + len(sets[j]) - both):
                parent[find(i)] = find(j)
        for g in s:
            where.setdefault(g, []).append(i)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted(((d, len(s), least.get(find(i))) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True))), key=str)


def got(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_shingles", "component_id").collect()), key=str)


def test_query_equals_all_pairs(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SMOKE}/documents.parquet").select("doc_id", "text").collect()]
    assert got(Q.op12_jaccard_join(spark, SMOKE)) == plain(rows)


def copies(rnd, n, base, changes):
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rnd.randint(0, changes)):
            k = rnd.randrange(len(w))
            kind = rnd.randrange(3)
            if kind == 0:
                w[k] = f"w{rnd.randrange(10 ** 6)}"
            elif kind == 1:
                del w[k]
            else:
                w.insert(k, f"w{rnd.randrange(10 ** 6)}")
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("cell,tokens,frequent", [(4096, 4_000_000, 100_000), (16, 3000, 100_000), (4096, 4_000_000, 0)])
def test_near_copies_at_the_limit(spark, monkeypatch, cell, tokens, frequent):
    """Chains, crowded shingles and large trees, whole and cut into blocks; similarities on both sides of 0.9."""
    monkeypatch.setattr(J, "FREQUENT", frequent)
    rnd = random.Random(7)
    words = [f"v{i}" for i in range(300)]
    rows = []
    for size, n, changes in ((120, 90, 4), (60, 40, 2), (25, 30, 1), (12, 20, 1), (400, 20, 9)):
        rows += copies(rnd, n, [rnd.choice(words) for _ in range(size)], changes)
    common = " ".join(rnd.choice(words) for _ in range(40))
    rows += [common + " " + " ".join(rnd.choice(words) for _ in range(rnd.randint(2, 60))) for _ in range(60)]
    chain = [f"c{i}" for i in range(70)]
    for i in range(25):  # each near the one before, the ends far apart
        rows.append(" ".join(chain[i:i + 45]))
    rnd.shuffle(rows)
    rows = [(i, t) for i, t in enumerate(rows)]
    df = spark.createDataFrame(rows, DOCS).repartition(5)
    assert got(J.jaccard_groups(df, cell=cell, tokens=tokens)) == plain(rows)


def test_odd_rows(spark):
    t = "the cat and the dog sat on the mat with a hat and a rat in a flat " * 3
    rows = [(1, t), (1, t), (1, "quite another text under the same id"), (None, t.upper()), (None, "Only Here\tonce"), (None, None), (2, None), (3, ""),
            (4, " \n\t \r\n"), (5, "one"), (6, "ONE "), (7, "one two"), (8, "ÉTÉ à la plage"), (9, "été à la plage"), (10, "word " * 30000),
            (11, "word word word"), (12, " ".join(f"x{i}" for i in range(30000))), (13, " ".join(f"x{i}" for i in range(1, 30000)))]
    df = spark.createDataFrame(rows, DOCS)
    for c in ("n", "k", "sid", "g", "h", "pos", "sketch", "low", "first", "size", "tree", "block", "i", "j", "c", "node", "root"):
        df = df.withColumn(c, F.lit(1))
    assert got(J.jaccard_groups(df)) == plain(rows)
    assert J.jaccard_groups(df.limit(0)).collect() == []


def test_hashes_stand_for_shingles():
    rnd = random.Random(3)
    texts = [" ".join(rnd.choice(["a", "b", "ab", "ba", "É", "B"]) for _ in range(rnd.randint(0, 40))) + rnd.choice(["", "\n", "  "]) for _ in range(400)]
    sets = list(J.Shingles(3)(texts))
    names, codes = {}, {}
    for t, s in zip(texts, sets, strict=True):
        assert len(s) == len(shingles(t)) and (s[1:] > s[:-1]).all()
        names.setdefault(shingles(t), set()).add(s.tobytes())
        codes.setdefault(s.tobytes(), set()).add(shingles(t))
    assert all(len(v) == 1 for v in names.values()) and all(len(v) == 1 for v in codes.values())


def test_sketches_of_several_widths_never_pass_the_true_difference():
    rnd = np.random.default_rng(4)
    sets = [np.unique(rnd.integers(-2 ** 63, 2 ** 63 - 1, n)) for n in (3, 2000, 2100, 5000, 9000)]
    sets += [np.unique(np.concatenate((s[5:], rnd.integers(-2 ** 63, 2 ** 63 - 1, 7)))) for s in sets]
    bits = J.Sketches([J.sketch(s).tobytes() for s in sets])
    assert sorted(set((bits.width * 8).tolist())) == [256, 1024, 2048, 4096, 8192]
    x, y = (g.ravel() for g in np.meshgrid(np.arange(10), np.arange(10)))
    got = bits.differ(x, y)
    for i, j, d in zip(x, y, got, strict=True):
        true = len(np.setxor1d(sets[i], sets[j]))
        assert d <= true and (d - true) % 2 == 0 and (true > 40 or d >= true - 6)
