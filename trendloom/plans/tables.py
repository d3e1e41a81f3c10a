"""The test tables in the roles of posts, weekly series, brand facts and vectors; the same in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import shared_folder  # noqa: F401


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def mentions(spark: SparkSession, sf_dir: str, category: str = "concat(event_type, '_', cast(user_id % 6 as string))") -> DataFrame:
    e = load(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias("mention_id"), F.expr(category).alias("category"), F.col("user_id").alias("community"), F.col("ts").cast("timestamp_ntz").alias("published_at"), F.col("value").alias("engagement_score"), F.expr("cast((event_id * 37) % 201 - 100 as double) / cast(100 as double)").alias("sentiment_compound"))


MENTIONS = "mentions AS (SELECT event_id AS mention_id, concat(event_type, '_', cast(user_id % 6 AS varchar)) AS category, user_id AS community, ts AS published_at, value AS engagement_score, cast((event_id * 37) % 201 - 100 AS double) / cast(100 AS double) AS sentiment_compound FROM events)"


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = load(spark, sf_dir, "orders")
    return o.select(F.col("o_orderpriority").alias("category"), (F.col("o_custkey") % 50).alias("community"), F.col("o_orderdate").alias("published_at"), F.expr("cast((o_orderkey * 37) % 201 - 100 as double) / cast(100 as double)").alias("sentiment"), F.col("o_totalprice").alias("engagement"))


SERIES = "series AS (SELECT o_orderpriority AS category, o_custkey % 50 AS community, o_orderdate AS published_at, cast((o_orderkey * 37) % 201 - 100 AS double) / cast(100 AS double) AS sentiment, o_totalprice AS engagement FROM orders)"


def brand_facts(spark: SparkSession, sf_dir: str, brand: str = "p_brand") -> DataFrame:
    """Current: shipped from 1998 on."""
    rows = load(spark, sf_dir, "lineitem").join(load(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return rows.select(F.col("p_type").alias("category"), F.expr(brand).alias("brand"), (F.col("l_suppkey") % 20).alias("community"), (F.col("p_size") % 7).alias("cluster"), (F.col("l_shipdate") >= F.lit("1998-01-01").cast("timestamp_ntz")).alias("is_cur"), F.expr("cast((l_orderkey * 37 + l_linenumber) % 201 - 100 as double) / cast(100 as double)").alias("sentiment"))


BRAND_FACTS = "facts AS (SELECT p_type AS category, p_brand AS brand, l_suppkey % 20 AS community, p_size % 7 AS cluster, l_shipdate >= TIMESTAMP '1998-01-01' AS is_cur, cast((l_orderkey * 37 + l_linenumber) % 201 - 100 AS double) / cast(100 AS double) AS sentiment FROM lineitem JOIN part ON l_partkey = p_partkey)"
