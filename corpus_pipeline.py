"""The training-data pipeline: from raw documents to packed sequences.

Each stage takes (spark, docs, sf_dir), works on all rows of docs and returns a
DataFrame; run() writes it as Parquet in the shared folder and hands it to the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tierflow.llm import hyperminhash, packing, quality_rules, systematic_mix, weak_label
from tierflow.llm.shared import stored


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the threshold table.

    A null or empty text has no words and goes; repeated rows and ids are judged one by one;
    other columns, whatever their names, pass through; an empty table stays empty.
    """
    return quality_rules.apply_rules(docs)


def classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the scorer, fitted to weak labels of these documents, keeps.

    A null text counts as empty and has the score of the bias alone; repeated texts count
    once in the fit and are judged alike; other columns pass through; an empty table stays
    empty. A score at the threshold is kept.
    """
    return weak_label.kept_only(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one of the smallest id, null ids last.

    Of several rows with that id one stays; texts without words all stay; other columns pass
    through; an empty table stays empty.
    """
    return hyperminhash.deduplicated(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them, up to three times.

    Null sources are one source; repeated rows and ids are documents of their own; a null text
    has no words and adds none; other columns pass through; an empty table stays empty.
    """
    return systematic_mix.mixed(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of a power of two token ids, in buckets of equal length.

    A null text has the end id alone; copies are packed one by one; other columns are left
    out; an empty table gives no sequences.
    """
    return packing.packed(docs)


STAGES = [
    ("quality_rules", rules),
    ("quality_classifier", classifier),
    ("near_dedup", near_dedup),
    ("mixing", mixing),
    ("packing", pack),
]

#: A fitted classifier can't be expressed in SQL; tests compare with a brute-force pipeline.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
