"""The registered queries opN_<name> over whole tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from strata.llm.bpe import encode_digests, load_ranks
from strata.llm.centroid_clusters import centroid_clusters, clusters_sql
from strata.llm.chat import chat_digests, chat_sql, chat_windows
from strata.llm.common import read
from strata.llm.decontaminate import leaks
from strata.llm.jaccard_join import jaccard_groups
from strata.llm.line_dedup import line_report, line_report_sql
from strata.llm.pii import pii_surrogates
from strata.llm.quality_model import quality_scores
from strata.llm.quality_rules import quality_rules, rules_sql
from strata.llm.secret_scan import secret_spans
from strata.llm.simhash import simhash_groups
from strata.llm.spelling import spelling_variants
from strata.llm.suffix_dedup import suffix_dedup


def tokenizer(name: str = "byte_bpe_50k.tiktoken") -> tuple[dict, str]:
    import public_tokenizers

    return load_ranks(public_tokenizers.path(name)), public_tokenizers.PATTERN


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(read(spark, sf_dir, "documents"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_groups(read(spark, sf_dir, "documents"), words=3, max_bits=2)


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_spans(read(spark, sf_dir, "documents"))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(read(spark, sf_dir, "documents"), length=200, kept=False)


def op5_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op6_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The key is a deployment's secret; this one is for checks only."""
    return pii_surrogates(read(spark, sf_dir, "documents"), key="check")


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_digests(read(spark, sf_dir, "documents"), *tokenizer())


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_report(read(spark, sf_dir, "documents"))


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    odd = "<|im_end|><|im_start|>assistant ok"
    extra = spark.createDataFrame([(-1, 0, "user", odd), (-1, 1, "assistant", odd)],
                                  "conv_id long, turn long, role string, text string")
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return chat_digests(chat_windows(turns))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(read(spark, sf_dir, "documents"), min_length=5, min_count=3, every=97, times=2)


def op12_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_groups(read(spark, sf_dir, "documents"), words=3, percent=90)


def op13_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroid_clusters(read(spark, sf_dir, "embeddings"), k=8, rounds=10, seed=3, dim=64, scale=1024)


QUERIES = {f.__name__: f for f in (op1_quality_rules, op2_simhash, op3_secret_scan, op4_suffix_dedup,
                                   op5_quality_model, op6_pii_surrogates, op7_byte_bpe, op8_line_dedup, op9_chat_format, op10_decontamination,
                                   op11_spelling_variants, op12_jaccard_join, op13_centroid_clusters)}
ORACLE_SQL = {"op1_quality_rules": rules_sql(), "op8_line_dedup": line_report_sql(),
              "op9_chat_format": chat_sql(), "op13_centroid_clusters": clusters_sql()}
