"""Queries of the reports and of the dictionary layers of brand extraction, registered beside the others."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import brands, extraction, report, weekly, windows
from .queries import BOARD, BRANDS, FACTS, board, day, query, scored
from .tables import SERIES, brand_facts, load, mentions, series

# Brands of the second week's events, as the tables have no posts with names and weeks.
EVENT_BRANDS = """, eb AS (SELECT category, concat('b', cast(community % 40 AS varchar)) AS brand, count(*) FILTER (is_cur) AS cur_mentions, count(*) FILTER (NOT is_cur) AS prev_mentions, round(avg(CASE WHEN is_cur THEN sentiment_compound END), 3) AS avg_sentiment FROM rows_in WHERE back = 1 GROUP BY 1, 2 HAVING count(*) FILTER (is_cur) >= 3),
ranked AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY cur_mentions DESC, round(cur_mentions / cast(greatest(prev_mentions, 1) AS double), 2) DESC, avg_sentiment DESC NULLS LAST, brand) AS brand_rank FROM eb)
"""


def event_brands(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = mentions(spark, sf_dir)
    rows = windows.in_windows(m, windows.week_windows(m)).where("back = 1")
    return brands.brand_table(rows.select("category", F.expr("concat('b', cast(community % 40 as string))").alias("brand"), "is_cur", F.col("sentiment_compound").alias("sentiment")))


@query(f"WITH {SERIES}, m AS (SELECT max(published_at) AS t FROM series) SELECT category, count(*) FILTER (published_at >= t - INTERVAL 14 DAY) AS cur, count(*) FILTER (published_at < t - INTERVAL 14 DAY) AS prev FROM series, m WHERE published_at >= t - INTERVAL 28 DAY GROUP BY 1")
def trailing_period(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = report.trailing(series(spark, sf_dir))
    return rows.groupBy("category").agg(F.count_if("is_cur").alias("cur"), F.count_if(~F.col("is_cur")).alias("prev"))


@query(f"{BOARD} SELECT back, category, strftime(date_trunc('week', published_at), '%Y-%m-%d') AS week, count(*) AS mentions, round(avg(sentiment_compound), 6) AS mean_sentiment FROM rows_in GROUP BY 1, 2, 3")
def window_weekly(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = mentions(spark, sf_dir)
    rows = report.weekly_spans(windows.in_windows(m, windows.week_windows(m)))
    return rows.select("back", "category", day("week").alias("week"), "mentions", F.round("mean_sentiment", 6).alias("mean_sentiment"))


@query(f"""{BRANDS}, r AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY cur_mentions DESC, brand_spike DESC, avg_sentiment DESC NULLS LAST, brand) AS n FROM brand_table), p AS (SELECT p_type AS category, p_partkey, row_number() OVER (PARTITION BY p_type ORDER BY p_retailprice DESC, p_partkey) AS n FROM part),
c AS (SELECT DISTINCT p_type AS category FROM part UNION ALL SELECT 'unseen')
SELECT category, coalesce((SELECT string_agg(brand, '|' ORDER BY n) FROM r WHERE r.category = c.category AND n <= 20), '') AS top_brands, coalesce((SELECT string_agg(cast(p_partkey AS varchar), '|' ORDER BY n) FROM p WHERE p.category = c.category AND n <= 5), '') AS sample_posts FROM c""")
def category_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    posts = load(spark, sf_dir, "part").select(F.col("p_type").alias("category"), F.col("p_partkey").alias("mention_id"), F.col("p_name").alias("title"), F.col("p_retailprice").alias("engagement_score"))
    categories = posts.select("category").distinct().unionByName(spark.sql("SELECT 'unseen' AS category"))
    rows = report.payload(categories, brands.brand_table(brand_facts(spark, sf_dir)), posts, "mention_id", ["mention_id", "title", "engagement_score"])
    return rows.select("category", F.array_join("top_brands", "|").alias("top_brands"), F.array_join(F.col("sample_posts.mention_id").cast("array<string>"), "|").alias("sample_posts"))


@query("SELECT doc_id, coalesce(name, 'unknown') AS target_cluster FROM documents LEFT JOIN (VALUES ('src0', 'Zero'), ('src1', 'One')) t(id, name) ON id = source")
def cluster_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = spark.sql("SELECT * FROM VALUES ('src0', 'Zero'), ('src1', 'One') AS t(target_cluster_id, target_cluster)")
    return report.named(load(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("target_cluster_id")), names).select("doc_id", "target_cluster")


@query("SELECT concat(event_type, '_', cast(user_id % 6 AS varchar)) AS category, count(*) AS n FROM events GROUP BY 1 ORDER BY n DESC, category LIMIT 10")
def cluster_value_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.value_counts(mentions(spark, sf_dir), "category")


@query("SELECT count(*) AS points, count(DISTINCT CASE WHEN label <> 0 THEN label END) AS clusters, count(*) FILTER (label <> 0) AS valid, count(*) FILTER (label = 0) AS noise, round(cast(100 AS double) * count(*) FILTER (label = 0) / count(*), 1) AS noise_pct FROM embeddings WHERE label IS NOT NULL")
def cluster_cardinality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.cardinality(load(spark, sf_dir, "embeddings"), "label", 0)


@query("SELECT o_orderkey, try_cast(t AS timestamp) IS NULL AS bad, strftime(try_cast(t AS timestamp), '%Y-%m-%d') AS published FROM (SELECT o_orderkey, CASE WHEN o_custkey % 7 = 0 THEN 'soon' WHEN o_custkey % 7 = 1 THEN '' ELSE strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') END AS t FROM orders)")
def parsed_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = F.when(F.col("o_custkey") % 7 == 0, "soon").when(F.col("o_custkey") % 7 == 1, "").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss"))
    rows = load(spark, sf_dir, "orders").select("o_orderkey", report.parsed(told).alias("t"))
    return rows.select("o_orderkey", F.col("t").isNull().alias("bad"), day("t").alias("published"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS d FROM orders WHERE o_custkey % 9 = 0 OR o_orderdate >= TIMESTAMP '1997-01-01'")
def year_cutoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every ninth customer's orders have no time, so these stay."""
    o = load(spark, sf_dir, "orders")
    rows = o.withColumn("created_utc", F.when(F.col("o_custkey") % 9 == 0, 0).otherwise(F.unix_timestamp(F.col("o_orderdate").cast("timestamp"))))
    return report.from_year(rows, 1997).select("o_orderkey", day("o_orderdate").alias("d"))


@query("SELECT o_orderpriority AS category, count(*) AS n FROM orders WHERE o_orderdate >= DATE '1998-06-30' - 60 GROUP BY 1")
def lookback_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = report.since(load(spark, sf_dir, "orders"), 60, F.lit("1998-06-30").cast("date"), "o_orderdate")
    return rows.groupBy(F.col("o_orderpriority").alias("category")).agg(F.count("*").alias("n"))


@query(f"{BRANDS} SELECT category, brand, CASE WHEN cur_mentions > prev_mentions THEN '+' ELSE '' END || format('{{:,}}', cur_mentions - prev_mentions) AS delta, cast(round(cast(brand_spike AS decimal(28, 8)), 1) AS varchar) || 'x' AS spike FROM brand_table")
def formatted_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = brands.brand_table(brand_facts(spark, sf_dir))
    return rows.select("category", "brand", report.signed(F.col("cur_mentions") - F.col("prev_mentions")).alias("delta"), F.concat(report.decimals(F.col("brand_spike"), 1), F.lit("x")).alias("spike"))


@query(f"""{BOARD} SELECT back, count(*) AS categories, cast(sum(mentions_c) AS bigint) AS mentions, {", ".join(f"count(*) FILTER (view_direction = '{d}') AS {d}, round(cast(100 AS double) * count(*) FILTER (view_direction = '{d}') / count(*), 1) AS {d}_pct" for d in ("rising", "stable", "declining"))} FROM final WHERE category <> 'Other' GROUP BY back""")
def kpi_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.kpi(board(spark, sf_dir))


@query(f"{BOARD} SELECT back, category, trend_score, place FROM (SELECT *, row_number() OVER (PARTITION BY back ORDER BY trend_score DESC, category) AS place FROM final WHERE view_direction IN ('rising', 'stable')) WHERE place <= 25")
def board_top_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.top_board(board(spark, sf_dir), ["rising", "stable"]).select("back", "category", "trend_score", F.col("rank").cast("bigint").alias("place"))


@query(f"{BOARD}{EVENT_BRANDS} SELECT category, spike_ratio, place, coalesce((SELECT string_agg(brand, '|' ORDER BY brand_rank) FROM ranked r WHERE r.category = f.category AND brand_rank <= 10), '') AS keywords FROM (SELECT *, row_number() OVER (ORDER BY spike_ratio DESC, category) AS place FROM final WHERE view_direction = 'rising' AND back = 1) f WHERE place <= 8")
def spike_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = report.spike_radar(board(spark, sf_dir).where("back = 1"), event_brands(spark, sf_dir))
    return rows.select("category", "spike_ratio", F.col("rank").cast("bigint").alias("place"), F.array_join("keywords", "|").alias("keywords"))


@query(f"""{BOARD} SELECT back, category, cast(round(cast(trend_score AS decimal(28, 8)), 2) AS varchar) AS score, cast(round(cast(spike_ratio AS decimal(28, 8)), 1) AS varchar) || 'x' AS spike, format('{{:,}}', mentions_c) AS posts, cast(round(cast(eng_momentum AS decimal(28, 8)), 1) AS varchar) || 'x' AS momentum, communities_c AS communities,
CASE WHEN sentiment_c >= 0 THEN '+' ELSE '' END || cast(round(cast(round(sentiment_c, 8) AS decimal(28, 8)), 2) AS varchar) AS sentiment, CASE WHEN sentiment_c >= cast(0.05 AS double) THEN 'positive' WHEN sentiment_c >= cast(-0.05 AS double) THEN 'neutral' ELSE 'negative' END AS mood FROM final""")
def category_card(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.cards(board(spark, sf_dir))


@query(f"""{BOARD}{EVENT_BRANDS}, sr AS (SELECT *, row_number() OVER (ORDER BY trend_score DESC, category) AS by_score, row_number() OVER (ORDER BY normalized_spike DESC, category) AS by_spike FROM final WHERE back = 1),
dl AS (SELECT brand, cur_mentions - prev_mentions AS delta FROM ranked WHERE category = 'click_0' AND brand_rank <= 15)
SELECT 'score' AS section, by_score AS place, category AS name, trend_score AS value, trend_direction AS direction FROM sr WHERE by_score <= 25 UNION ALL SELECT 'spike', by_spike, category, normalized_spike, trend_direction FROM sr WHERE by_spike <= 6 UNION ALL SELECT 'table', by_score, category, cast(mentions_c AS double), trend_direction FROM sr WHERE by_score <= 20
UNION ALL SELECT 'delta', row_number() OVER (ORDER BY delta DESC, brand), brand, cast(delta AS double), CASE WHEN delta > 0 THEN 'rising' ELSE 'declining' END FROM dl""")
def static_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.static_report(board(spark, sf_dir).where("back = 1"), event_brands(spark, sf_dir), "click_0")


HOT = "hot AS (SELECT o_orderpriority AS category, o_orderstatus AS brand, o_orderkey AS mention_id, o_custkey AS url, o_totalprice AS engagement_score FROM orders)"


def _hot(spark: SparkSession, sf_dir: str, keyword: str | None) -> DataFrame:
    index = load(spark, sf_dir, "orders").selectExpr("o_orderpriority AS category", "o_orderstatus AS brand", "o_orderkey AS mention_id", "o_custkey AS url", "o_totalprice AS engagement_score")
    return report.hot_posts(index, 10, keyword).select("category", "mention_id", F.col("rank").cast("bigint").alias("place"))


@query(f"WITH {HOT}, u AS (SELECT *, row_number() OVER (PARTITION BY category, url ORDER BY brand, mention_id) AS n FROM hot) SELECT * FROM (SELECT category, mention_id, row_number() OVER (PARTITION BY category ORDER BY engagement_score DESC, mention_id) AS place FROM u WHERE n = 1) WHERE place <= 10")
def hot_posts_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hot(spark, sf_dir, None)


@query(f"WITH {HOT} SELECT * FROM (SELECT category, mention_id, row_number() OVER (PARTITION BY category ORDER BY engagement_score DESC, mention_id) AS place FROM hot WHERE brand = 'F') WHERE place <= 10")
def hot_posts_keyword(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hot(spark, sf_dir, "F")


EVENTS = [("1998-07-01", "1998-07-31", "July"), ("1998-08-20", "1998-12-31", "Autumn"), ("1996-01-01", "1996-12-31", "Past")]


@query(f"""{FACTS}, held AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY wk DESC) AS back FROM scored WHERE trend_score BETWEEN cast(0.01 AS double) AND 10),
line AS (SELECT category, regr_slope(trend_score, cast(-back AS double)) AS slope, regr_intercept(trend_score, cast(-back AS double)) AS level, max(wk) AS last_week FROM held WHERE back <= 10 AND category > '2' GROUP BY category HAVING count(*) >= 6),
ahead AS (SELECT category, last_week + cast(7 * step AS integer) AS ds, round(greatest(level + slope * (step - 1), 0), 3) AS yhat FROM line, range(1, 5) t(step)),
span AS (SELECT category, min(ds) AS low, max(ds) AS high FROM ahead GROUP BY 1), e(i, a, b, label) AS (VALUES {", ".join(f"({i}, DATE '{a}', DATE '{b}', '{label}')" for i, (a, b, label) in enumerate(EVENTS))})
SELECT category, strftime(ds, '%Y-%m-%d') AS ds, yhat, coalesce((SELECT string_agg(label, '|' ORDER BY i) FROM e WHERE b >= low AND a <= high), '') AS events FROM ahead JOIN span USING (category)""")
def forecast_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = load(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("category")).where("category > '2'")
    rows = report.with_events(weekly.line_forecast(scored(spark, sf_dir)), told, EVENTS)
    return rows.select("category", day("ds").alias("ds"), "yhat", F.array_join("events", "|").alias("events"))


LINES = {"ingen": "Acme", "ionen": "Acme", "license": "Blue"}


@query(f"""WITH a(i, alias, brand) AS (VALUES {", ".join(f"({i}, '{a}', '{b}')" for i, (a, b) in enumerate(LINES.items()))}), f AS (SELECT doc_id, i, alias, brand, lower(text) AS t, instr(lower(text), alias) AS pos FROM documents, a WHERE contains(lower(text), alias))
SELECT doc_id, brand, arg_min(alias, i) AS line, cast(0.95 AS double) AS confidence FROM f WHERE NOT regexp_matches(substr(t, greatest(pos - 60, 1), pos + length(alias) + 60 - greatest(pos - 60, 1)), '{extraction.ANTI_CONTEXT}') GROUP BY 1, 2""")
def product_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extraction.line_hits(load(spark, sf_dir, "documents"), "doc_id", "text", LINES)


KNOWN = {"the": 5e-2, "eau": 1e-6, "license": 1e-4}


@query(f"""WITH a(norm, common) AS (VALUES {", ".join(f"('{n}', {str(f > 5e-5).lower()})" for n, f in KNOWN.items())}), f AS (SELECT doc_id, norm, common, lower(text) AS t, instr(lower(text), norm) AS pos FROM documents, a WHERE contains(lower(text), norm)),
c AS (SELECT *, substr(t, greatest(pos - 60, 1), pos + length(norm) + 60 - greatest(pos - 60, 1)) AS ctx FROM f)
SELECT doc_id, norm, upper(left(norm, 1)) || substr(norm, 2) AS brand, cast(0.85 AS double) AS confidence FROM c WHERE NOT regexp_matches(ctx, '{extraction.ANTI_CONTEXT}') AND (NOT common OR regexp_matches(ctx, '{extraction.BRAND_CONTEXT}'))""")
def known_brands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extraction.known_hits(load(spark, sf_dir, "documents"), "doc_id", "text", KNOWN)


@query(r"""WITH r AS (SELECT p_partkey AS pos, p_name AS display, trim(regexp_replace(regexp_replace(lower(p_name), '[''\-.&,!?/\\()\[\]_*@#%^~`|]', ' ', 'g'), '\s+', ' ', 'g')) AS norm FROM part UNION ALL SELECT -n_nationkey - 1, concat('Nation', cast(n_nationkey AS varchar)), concat('nation', cast(n_nationkey AS varchar)) FROM nation)
SELECT norm, arg_min(display, (pos, display)) AS display FROM r WHERE length(norm) >= 2 AND norm NOT IN ('red widget') AND len(list_filter(string_split(norm, ' '), lambda w: w NOT IN ('small', 'ring'))) > 0 AND NOT (norm IN (SELECT concat('nation', cast(n_nationkey AS varchar)) FROM nation WHERE n_nationkey >= 10)) GROUP BY norm""")
def brand_whitelist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part names and nations as spellings; nations from key 10 on are too common."""
    nations = load(spark, sf_dir, "nation")
    raw = load(spark, sf_dir, "part").selectExpr("p_partkey AS pos", "p_name AS display").unionByName(nations.selectExpr("cast(-n_nationkey - 1 as bigint) AS pos", "concat('Nation', n_nationkey) AS display"))
    common = nations.select(F.concat(F.lit("nation"), F.col("n_nationkey").cast("string")).alias("word"), F.when(F.col("n_nationkey") >= 10, 1e-3).otherwise(1e-6).alias("freq"))
    return extraction.whitelist(raw, ["small", "ring"], [], common, products=["red widget"])


@query("SELECT category, row_number() OVER (ORDER BY lower(shown), category) AS place FROM (SELECT DISTINCT concat(event_type, '_', cast(user_id % 6 AS varchar)) AS category, replace(concat(event_type, '_', cast(user_id % 6 AS varchar)), '_', ' ') AS shown FROM events)")
def label_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Categories are a dimension, so one task orders their labels."""
    from pyspark.sql import Window

    rows = mentions(spark, sf_dir).select("category").distinct()
    return rows.withColumn("place", F.row_number().over(Window.orderBy(F.lower(T.label(F.col("category"))), "category")).cast("bigint"))
