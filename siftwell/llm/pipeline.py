"""A corpus pipeline: toxic documents go, one of each near-duplicate class stays, documents with a passage of
the benchmark go, and the rest is packed into sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, near_dups, packing, shared, toxicity
from .queries import table, vocabulary


def toxic_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.clean(spark, docs, table(spark, sf_dir, "labels"))


def duplicates_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dups.clean(spark, docs)


def benchmark_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A document that shares a window of eight words with any item goes; the report's two items are another rule."""
    return decontaminate.clean(spark, docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(spark, docs, vocabulary("byte_bpe_50k.json"), vocabulary("byte_bpe_50k.tiktoken"))


STAGES = [("toxicity", toxic_out), ("near-duplicates", duplicates_out), ("decontamination", benchmark_out), ("packing", pack)]

#: Byte-pair tokens and a trained classifier are beyond SQL; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each one's result is written and read by the next."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = shared.stored(spark, docs, f"stage-{name}")
    return docs
