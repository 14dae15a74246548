"""The corpus pipeline: documents in, token digests out.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
as Parquet and read again as the next stage's docs.  All but the last return
the columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.llm.bpe import encode_digests
from strata.llm.common import read
from strata.llm.decontaminate import clean_documents
from strata.llm.line_dedup import dedup_documents
from strata.llm.quality_rules import kept_documents
from strata.llm.queries import tokenizer
from strata.llm.simhash import one_of_each
from strata.session import checkpoint_dir

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
MEMO = 50_000  # pieces that a worker's encoder remembers: its memory stays beside the other stages'


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the rules, unchanged."""
    return kept_documents(docs, COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that an earlier place has (or has but for a character or a word)."""
    return dedup_documents(docs, keep=COLUMNS, words=True).withColumn("n_chars", F.length("text").cast("long"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return one_of_each(docs, keep=COLUMNS, words=3, max_bits=2)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak no benchmark item."""
    return clean_documents(docs, read(spark, sf_dir, "benchmark"), keep=COLUMNS)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token digests of what is left."""
    return encode_digests(docs, *tokenizer(), memo=MEMO)


STAGES = [("quality rules", quality), ("line dedup", line_dedup), ("SimHash near-dedup", near_duplicates),
          ("benchmark decontamination", decontamination), ("byte-level BPE", encoding)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each one's result is written to the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base = f"{checkpoint_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs.write.parquet(f"{base}/{k}")
            docs = spark.read.parquet(f"{base}/{k}")
    return docs


#: SQL has neither XXH64 nor BPE; tests hold run() against a plain version.
ORACLE_SQL = None
