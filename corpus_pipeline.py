"""A corpus pipeline of five of the text operators: rules, near-duplicates, benchmarks, personal data, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tandemetry.llm import decontaminate, near_dedup, packing, pii, quality_rules
from tandemetry.llm.common import materialize, tokenizer_path


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the rules."""
    return quality_rules.keep(docs)


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of texts whose five-word shingles agree to 0.8 or more."""
    return near_dedup.one_of_each(docs, scheme=near_dedup.COPIES)


def benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def privacy(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced; n_chars follows the text."""
    return pii.sanitise(docs, length_col="n_chars")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of at most 4096 tokens."""
    return packing.pack_documents(docs, tokenizer_path("word_bpe_49k.json"))


#: Each function takes (spark, docs, sf_dir); all but the last return the columns of documents.
STAGES = [("quality", quality), ("near_dedup", dedup), ("benchmarks", benchmarks), ("privacy", privacy), ("packing", pack)]

#: SQL has neither XXH64 fingerprints nor the tokenizer; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again as the next one's input."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
