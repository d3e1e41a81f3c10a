"""Queries of single text and time functions, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import sources
from ..functions import text as T
from ..operators import extraction, layers, records, weekly
from .layers import PLAIN, REVIEW, REVIEWED, decisions
from .queries import FACTS, query
from .tables import load, series


@query("SELECT doc_id, md5(translate(strip_accents(text), '‘’`–—−', '''''''---')) AS fold_md5 FROM documents")
def fold_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "documents").select("doc_id", F.md5(T.folded(F.col("text"))).alias("fold_md5"))


@query("SELECT doc_id, CASE WHEN i > 0 THEN substr(text, greatest(i - 60, 1), i + 3 + 60 - greatest(i - 60, 1)) END AS around FROM (SELECT doc_id, text, instr(text, 'the') AS i FROM documents)")
def text_around(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "documents").select("doc_id", T.around(F.col("text"), F.lit("the"), 60).alias("around"))


@query(f"SELECT doc_id, CASE WHEN i > 0 THEN array_to_string(list_slice(w, greatest(i - 6, 1), i + 6), ' ') END AS near FROM (SELECT doc_id, w, coalesce(list_position(w, 'und'), 0) AS i FROM (SELECT doc_id, list_filter(string_split({PLAIN.format('text')}, ' '), lambda x: x <> '') AS w FROM documents))")
def words_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = T.near_tokens(T.tokens(T.plain(F.col("text"))), F.lit("und"), 6)
    return load(spark, sf_dir, "documents").select("doc_id", F.array_join(near, " ").alias("near"))


@query("SELECT doc_id, regexp_replace(left(text, 40), '^(?i)(the|a|an)\\s+', '') AS bare FROM documents")
def without_article(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "documents").select("doc_id", T.without_article(F.substring("text", 1, 40)).alias("bare"))


@query("SELECT o_orderkey, cast(epoch(date_trunc('day', o_orderdate)) AS bigint) AS first_second, cast(epoch(date_trunc('day', o_orderdate)) AS bigint) + 86399 AS last_second FROM orders")
def day_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.col("o_orderdate").cast("date")
    return load(spark, sf_dir, "orders").select("o_orderkey", sources.epoch_bounds(day).alias("first_second"), sources.epoch_bounds(day, True).alias("last_second"))


@query(f"{REVIEW}, queue AS (SELECT norm, confidence AS score, raw AS candidate FROM five v WHERE confidence >= 0.45 AND confidence < 0.65 AND NOT EXISTS (SELECT 1 FROM firsts f WHERE f.k = v.k AND f.norm = v.norm AND (f.layer < 5 OR f.pos < v.pos))) SELECT norm AS brand_norm, max(score) AS score, max(struct_pack(s := score, c := candidate)).c AS candidate FROM queue GROUP BY norm")
def brand_review_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extraction.review_queue(layers.review(decisions(spark, sf_dir, REVIEWED)))


@query("SELECT user_id % 50 AS sub, event_type AS category FROM (SELECT *, row_number() OVER (PARTITION BY user_id % 50 ORDER BY length(event_type), event_id, event_type) AS n FROM events) WHERE n = 1")
def first_communities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each community in the first of its categories, shorter names having priority."""
    pairs = load(spark, sf_dir, "events").select(F.col("event_type").alias("category"), (F.col("user_id") % 50).alias("sub"), F.length("event_type").alias("priority"), F.col("event_id").alias("pos"))
    return records.first_communities(pairs).select("sub", "category")


@query(f"{FACTS} SELECT category, week_num, n_weeks, dense_rank() OVER (ORDER BY category) - 1 AS cat_encoded FROM scored WHERE n_weeks >= 10 AND week_num >= 4")
def rise_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = weekly.features(weekly.facts(series(spark, sf_dir)))
    return rows.select("category", F.col("week_num").cast("bigint").alias("week_num"), F.col("n_weeks").cast("bigint").alias("n_weeks"), F.col("cat_encoded").cast("bigint").alias("cat_encoded"))
