"""Spelling variants against all pairs of words."""

import collections
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from strata.llm import queries as Q
from strata.llm import spelling as S
from tests.conftest import SMOKE

DOCS = "doc_id long, text string"


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def plain(rows, every=97, min_count=3):
    n = collections.Counter()
    for doc, text in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = re.sub("[A-Z]", lambda m: m[0].lower(), w)
            h = zlib.crc32(f"{'' if doc is None else doc}:{w}".encode())
            n[w[:h % len(w)] + w[h % len(w) + 1:] if h % every == 0 else w] += 1
    n = {w: c for w, c in n.items() if len(w) >= 5 and c >= min_count}
    by = collections.defaultdict(list)
    for w in n:
        by[len(w)].append(w)
    out, form = {}, {}
    for w in n:
        found = [x for k in (-1, 0, 1) for x in by[len(w) + k] if near(w, x)]
        best = min(found, key=lambda x: (-n[x], x), default=None)
        form[w] = best if best and n[best] >= 2 * n[w] else None
        out[w] = len(found)
    def root(w):
        return root(form[w]) if form[w] else w
    return sorted((w, form[w], root(w), n[w], out[w], n.get(form[w])) for w in n)


def got(df):
    return sorted(tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect())


def test_query_equals_all_pairs(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SMOKE}/documents.parquet").select("doc_id", "text").collect()]
    want = plain(rows)
    assert sum(r[1] is not None for r in want) > 20
    assert got(Q.op11_spelling_variants(spark, SMOKE)) == want


@pytest.mark.parametrize("rows,crowd", [(200, 7), (120_000, 20_000)])
def test_crowded_halves_are_dealt_in_blocks(spark, rows, crowd):
    rnd = random.Random(4)
    words = ["".join(rnd.choice("abÀ") for _ in range(rnd.randint(5, 9))) for _ in range(500)]
    docs = [(i, " ".join([w] * rnd.randint(1, 9))) for i, w in enumerate(words)]
    df = spark.createDataFrame(docs, DOCS)
    assert got(S.spelling_variants(df, rows=rows, crowd=crowd)) == plain(docs)


def test_long_chains_and_odd_rows(spark):
    docs = [(None, "abcdeX " * 3), (1, None), (2, ""), (3, " 12 \t"), (4, "x" * 4000 + " " + ("x" * 3999 + " ") * 3), (4, ("x" * 4000 + " ") * 5)]
    chain = ["aaaaaaaa"]
    for i in range(8):
        chain.append(chain[-1][:i] + "b" + chain[-1][i + 1:])
    docs += [(10 + i, f"{c} " * (3 * 2 ** i)) for i, c in enumerate(chain)]
    docs += [(7, "abcde"), (7, "abcde"), (7, "ABCDE")]
    df = spark.createDataFrame(docs, DOCS)
    for c in ("word", "n", "key", "half", "asks", "form", "root", "c", "i", "j", "doc", "size"):
        df = df.withColumn(c, F.lit(1))
    rows = got(S.spelling_variants(df, every=0))
    assert rows == plain(docs, every=10 ** 12)
    roots = {r[0]: r[2] for r in rows}
    assert roots["aaaaaaaa"] == chain[-1] and roots["x" * 3999] == "x" * 4000
    assert S.spelling_variants(df.limit(0)).collect() == []


def test_index_finds_exactly_the_near_words():
    rnd = random.Random(1)
    words = sorted({"".join(rnd.choice("abc") for _ in range(rnd.randint(2, 7))) for _ in range(300)} | {"e" * 50, "e" * 51})
    v = S.Vocabulary(words)
    found = set()
    for half in (0, 1):
        for i, j in zip(*v.near(words + ["zzzz", "aÿ"], half), strict=True):
            a, b = (words + ["zzzz", "aÿ"])[i], words[j]
            assert b.startswith(a[:len(a) // 2]) if half == 0 else b.endswith(a[len(a) // 2:])
            found.add((a, b))
    assert found == {(a, b) for a in words + ["zzzz", "aÿ"] for b in words if near(a, b)}


def test_sums_do_not_depend_on_parts(spark):
    df = spark.createDataFrame([(i, "alpha beta gamma delta") for i in range(500)], DOCS)
    one = {tuple(r) for r in S.word_counts(df.coalesce(1)).collect()}
    assert one == {tuple(r) for r in S.word_counts(df.repartition(13)).collect()}
