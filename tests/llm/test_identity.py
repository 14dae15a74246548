"""Surrogates where a layout has too few, and rows without an id or with a shared one."""

import re

from strata.llm.pii import pii_surrogates
from strata.llm.simhash import one_of_each


def _texts(spark, made, schema="doc_id long, text string"):
    return [r for r in pii_surrogates(spark.createDataFrame(made, schema), "k").collect()]


def test_rounds_end_where_a_layout_is_full(spark):
    letters = "abcdefghijklmnopqrstuvwxyz"
    mails = [f"{a}@{b}.com" for a in letters for b in letters][:600]
    phones = [f"+1 {i // 100:02d} {i % 100:02d}" for i in range(6000)]
    odd = ["张@公司.cn", "%@-.io", "_@_.io"]
    made = [(i, f"see {x} now") for i, x in enumerate(mails + phones + ["张@公司.cn", "%@-.io"])]
    got = {r["doc_id"]: r["text"][4:-4] for r in _texts(spark, made)}
    reals = set(mails + phones + odd)
    assert len(set(got.values())) == len(made) and not reals & set(got.values())
    assert all(re.fullmatch(r"[a-z]+@[a-z]\.com", got[i]) for i in range(600))
    assert all(re.fullmatch(r"\+1 \d\d \d\d+", got[i]) for i in range(600, 6600))
    assert "张" not in got[6600] and got[6600].endswith(".cn")


def test_rows_without_an_id_keep_their_own_redraws(spark):
    mails = [f"{a}@{b}.com" for a in "abcdefghijklmnopqrst" for b in "abcdefghijklmnopqrst"]
    made = [(None, x) for x in mails] + [(7, x) for x in mails]
    got = sorted(r["text"] for r in _texts(spark, made))
    assert got[::2] == got[1::2] and len(set(got)) == 400 and not set(got) & set(mails)


def test_a_title_without_gender_takes_the_one_shown(spark):
    made = [(1, "Mr John Smith met Dr John Smith"), (2, "Dr John Smith, Mrs John Smith and Mr John Smith"), (3, "Dr Ada Byron")]
    got = {r["doc_id"]: r["text"] for r in _texts(spark, made)}
    mr, dr = got[1].split(" met ")
    assert mr.split(" ")[1:] == dr.split(" ")[1:] and mr.startswith("Mr") and dr.startswith("Dr")
    d, f, m = re.findall(r"(?:Dr|Mrs|Mr) (\w+) \w+", got[2])
    assert len({d, f, m}) == 3  # both genders show: none is taken
    assert "Ada" not in got[3]


def test_near_dedup_knows_rows_by_id_and_text(spark):
    a, b = "the quick brown fox jumps over the lazy dog today", "one entirely different text about sea water and boats"
    made = [(1, a), (1, b), (2, a), (None, a), (None, b + " again and more"), (None, b + " again and more"), (3, None), (4, "")]
    docs = spark.createDataFrame([(i, t, "x") for i, t in made], "doc_id long, text string, source string")
    got = sorted(map(str, one_of_each(docs, ("doc_id", "text", "source")).select("doc_id", "text").collect()))
    kept = {(1, a), (1, b), (None, b + " again and more"), (3, None)}
    assert len(got) in (4, 5) and got == sorted(set(got))
    assert {str(r) for r in docs.select("doc_id", "text").distinct().collect() if (r[0], r[1]) in kept} <= set(got)
    assert not one_of_each(docs.limit(0)).collect()
