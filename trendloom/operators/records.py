"""Post records: identity, cleaning, schema alignment, increments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def first_by(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """One row for each key, the first by a total order. Spark keeps only each task's first row before the shuffle."""
    return df.withColumn("__row", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__row = 1").drop("__row")


def cleaned(posts: DataFrame, key: str, title: str, text: str, *order: Column, least: int = 10, most: int = 400, between: str = ". ") -> DataFrame:
    """First row of each key, with ``ner_input`` of at least ``least`` characters."""
    blank = lambda c: F.coalesce(F.col(c), F.lit(""))
    made = first_by(posts, [key], *order).withColumn("ner_input", F.trim(F.concat(blank(title), F.lit(between), F.substring(blank(text), 1, most))))
    return made.where(F.length("ner_input") >= least)


def normalised(raw: DataFrame, score: str = "score", comments: str = "num_comments", created: str = "created_utc", body: str = "selftext") -> DataFrame:
    """Source records in one form: removed bodies blank, engagement of score and comments, time from epoch seconds."""
    gone = F.col(body).isin("[deleted]", "[removed]")
    return (
        raw.withColumn("text", F.when(F.col(body).isNull() | gone, "").otherwise(F.col(body)))
        .withColumn("engagement_score", (F.coalesce(score, F.lit(0)) + 3 * F.coalesce(comments, F.lit(0))).cast("double"))
        .withColumn("published_at", F.timestamp_seconds(created))
    )


def sentiment_label(compound: Column) -> Column:
    return F.when(compound >= 0.05, "positive").when(compound <= -0.05, "negative").otherwise("neutral")


def category_of(cluster: Column, score: Column, least: float = 0.10, other: str = "Other") -> Column:
    named = cluster.isNotNull() & ~F.lower(F.trim(cluster)).isin("unassigned", "unknown", "")
    return F.when(named & (score >= least), cluster).otherwise(other)


def with_category(posts: DataFrame, cluster: str = "target_cluster", score: str = "target_cluster_score", legacy: str = "category") -> DataFrame:
    """``category`` by cluster, a missing score column counting as 1; without clusters the old label, or ``unknown``."""
    if cluster in posts.columns:
        return posts.withColumn("category", category_of(F.col(cluster), F.col(score) if score in posts.columns else F.lit(1.0)))
    return posts.withColumn("category", F.coalesce(F.col(legacy) if legacy in posts.columns else F.lit(None).cast("string"), F.lit("unknown")))


def aligned(df: DataFrame, schema: StructType, key: str) -> DataFrame:
    """The columns of ``schema`` in its order; missing ones null, others dropped; rows without a key are refused."""
    if key not in df.columns:
        raise ValueError(f"no key column {key}")
    return df.select(*((F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema)).where(F.when(F.col(key).isNull(), F.raise_error(F.lit(f"null {key}")).cast("boolean")).otherwise(F.lit(True)))


def new_rows(raw: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not known yet."""
    return raw.join(known.select(key).distinct(), key, "left_anti")


def appended(old: DataFrame, new: DataFrame) -> DataFrame:
    return old.unionByName(new, allowMissingColumns=True)


def first_communities(pairs: DataFrame) -> DataFrame:
    """``category, sub, priority, pos``: each community in its first category by priority and position."""
    return first_by(pairs, ["sub"], F.col("priority"), F.col("pos"), F.col("category"))


def with_assignments(posts: DataFrame, assigned: DataFrame, key: str, *order: Column) -> DataFrame:
    """Posts with cluster columns: both sides deduplicated, stale columns replaced, defaults for posts without one."""
    columns = [c for c in assigned.columns if c != key]
    own = first_by(posts.drop(*columns), [key], *order)
    once = first_by(assigned, [key], F.col("target_cluster_id"), F.col("target_cluster_score").desc())
    return own.join(once, key, "left").na.fill({"target_cluster_id": "C000", "target_cluster": "unassigned", "target_cluster_score": 0.0})
