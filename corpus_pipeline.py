"""A corpus from documents: rules, near-duplicates, repeated passages, secrets, packing.

Each stage takes all rows that its predecessor kept and returns the columns of documents, the last one the packed
sequences. Texts that a stage shortens get a new ``n_chars``, where there is such a column.

Defined results: null and empty texts fail the base rule and go at the first stage; a row without an id is judged, cut,
cleaned and packed like any other and has no near-duplicates; repeated rows share an id, so the near-duplicate stage keeps them or drops them
together; of equal documents that with the smallest id stays; texts are read whole at any length; further columns pass through
unchanged whatever their names; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trendloom.llm import minmax, packing, quality_rules, secrets_forest, suffix_dedup
from trendloom.llm.common import materialize, table


def counted(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


def rule_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules and compression bands."""
    return quality_rules.keep(docs)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest id, of each group of near-duplicates."""
    return minmax.keep_first(docs)


def passage_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages that a document with a smaller id has."""
    return counted(suffix_dedup.cut(docs))


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with secrets replaced."""
    return counted(secrets_forest.redact(docs, path_col="source" if "source" in docs.columns else None))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences in token-budget batches of optimal length buckets."""
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", rule_stage),
    ("minmax_near_dedup", near_duplicate_stage),
    ("suffix_dedup", passage_stage),
    ("secret_forest", secret_stage),
    ("length_buckets", packing_stage),
]

#: Compression, the forest and the bucket program can't be said in SQL.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
