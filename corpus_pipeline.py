"""The corpus pipeline: five stages, each over all that the one before kept.

Quality rules, then one document of each near-duplicate group, then decontamination, then
secrets redacted, and at last the mix of sources. Each stage is (name, function); a function
takes the session, the documents and the folder of the tables, and returns a DataFrame.
All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from wayfind.llm import decontaminate, mixing, quality, secrets, simhash
from wayfind.storage import materialize


def larger_files(out: DataFrame, docs: DataFrame) -> DataFrame:
    """``out`` in half as many partitions as ``docs`` is read in: a stage that drops rows else leaves ever smaller files."""
    n = docs._jdf.rdd().getNumPartitions()
    return out.coalesce(max(docs.sparkSession.sparkContext.defaultParallelism, n // 2))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the counting rules and the divergence from their language keep."""
    return larger_files(quality.keep_good(docs), docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: that with the smallest id."""
    return larger_files(simhash.drop_near_duplicates(docs), docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a verified overlap with the benchmark."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secret_redaction(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with the secrets in their texts replaced."""
    return secrets.redact(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, how often and how many words of each, by source; the budget cuts off all others."""
    return mixing.mix(docs).where("copies > 0").select("doc_id", "source", "size", "source_size", "target", "copies", "taken")


STAGES = [
    ("quality rules", quality_rules),
    ("near-duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secret scans", secret_redaction),
    ("source mix", source_mix),
]

#: SimHash needs XXH64, which DuckDB lacks; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each but the last written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
