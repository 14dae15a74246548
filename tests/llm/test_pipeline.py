"""The pipeline's stages, one by one, against plain versions."""

import re

import corpus_pipeline as P
from strata.llm.decontaminate import words_of
from tests.conftest import SMOKE


def test_stages(spark, tmp_path):
    assert [n for n, _ in P.STAGES] == ["quality rules", "line dedup", "SimHash near-dedup", "benchmark decontamination", "byte-level BPE"]
    docs, at = spark.read.parquet(f"{SMOKE}/documents.parquet"), {}
    at["documents"] = {r["doc_id"]: r for r in docs.collect()}
    for k, (name, stage) in enumerate(P.STAGES):
        df = stage(spark, docs, SMOKE)
        if k < 4:
            assert tuple(df.columns) == P.COLUMNS
        df.write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        at[name] = {r["doc_id"]: r for r in docs.collect()}
    kept = at["quality rules"]
    for d, r in at["documents"].items():
        w = re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "")
        if len(w) < 50:
            assert d not in kept
        if d in kept:
            assert kept[d] == r
    lines = at["line dedup"]
    assert set(lines) == set(kept)
    for d, r in lines.items():  # lines go, none is changed or moved
        rest = iter((kept[d]["text"] or "").split("\n"))
        assert not r["text"] or all(any(x == y for y in rest) for x in r["text"].split("\n"))
        assert r["n_chars"] == len(r["text"])
    long_lines = [x for _, r in sorted(lines.items()) for x in r["text"].split("\n") if len(x) >= 30 and x.strip()]
    assert len(long_lines) == len(set(long_lines))
    from strata.llm.simhash import fingerprint

    groups = {}
    for d, r in lines.items():
        groups.setdefault(fingerprint(r["text"]), []).append(d)
    one = at["SimHash near-dedup"]
    assert set(one) <= {min(g) for g in groups.values()} and all(one[d] == lines[d] for d in one)
    assert {d for d in lines if len(groups[fingerprint(lines[d]["text"])]) == 1} - set(one) <= {
        d for d in lines if any(0 < (fingerprint(lines[d]["text"]) ^ f & (1 << 64) - 1).bit_count() <= 2 for f in groups)}
    items = [words_of(r["text"]) for r in spark.read.parquet(f"{SMOKE}/benchmark.parquet").collect()]
    clean = at["benchmark decontamination"]
    for d, r in one.items():
        text = " " + " ".join(words_of(r["text"])) + " "
        if any(f" {' '.join(i)} " in text for i in items):
            assert d not in clean
    assert all(clean[d] == one[d] for d in clean) and set(at["byte-level BPE"]) == set(clean)


def test_run_equals_the_stages(spark):
    docs = spark.read.parquet(f"{SMOKE}/documents.parquet")
    for _, stage in P.STAGES:
        docs = stage(spark, docs, SMOKE)
    assert sorted(map(tuple, P.run(spark, SMOKE).collect())) == sorted(map(tuple, docs.collect()))
