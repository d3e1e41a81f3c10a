"""Queries by name: a Spark plan over the operators and, where SQL can say it, the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.numbers import unit
from ..operators import brands, extraction, models, records, vectors, weekly, windows
from .tables import BRAND_FACTS, MENTIONS, SERIES, brand_facts, load, mentions, series, shared_folder

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return register


def day(column: str):
    return F.date_format(column, "yyyy-MM-dd")


# Records


@query("SELECT doc_id, n, md5(ner) AS ner_md5 FROM (SELECT doc_id, trim(source || '. ' || left(coalesce(text, ''), 400)) AS ner, length(trim(source || '. ' || left(coalesce(text, ''), 400))) AS n FROM documents) WHERE n >= 10")
def clean_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = records.cleaned(load(spark, sf_dir, "documents"), "doc_id", "source", "text", F.col("n_chars"), F.col("text"))
    return rows.select("doc_id", F.length("ner_input").cast("bigint").alias("n"), F.md5("ner_input").alias("ner_md5"))


@query("SELECT event_id, left(sha256(concat_ws('||', event_type, cast(user_id AS varchar), coalesce(props, ''))), 24) AS mention_id FROM events")
def mention_hash_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "events").select("event_id", T.stable_id(F.col("event_type"), F.col("user_id"), F.col("props")).alias("mention_id"))


@query("SELECT lang, source, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY lang, source ORDER BY n_chars DESC, doc_id) AS rn FROM documents) WHERE rn = 1")
def first_by_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.first_by(load(spark, sf_dir, "documents"), ["lang", "source"], F.col("n_chars").desc(), F.col("doc_id")).select("lang", "source", "doc_id")


@query("SELECT d.doc_id, d.lang FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def incremental_new_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.new_rows(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"), "doc_id").select("doc_id", "lang")


@query("SELECT doc_id, lang, source, cast(NULL AS integer) AS quality FROM documents UNION ALL SELECT doc_id, NULL, NULL, quality FROM labels")
def schema_align_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    both = records.appended(docs, load(spark, sf_dir, "labels").select("doc_id", "quality"))
    return records.aligned(both, both.schema, "doc_id").withColumn("quality", F.col("quality").cast("int"))


@query(f"WITH {MENTIONS} SELECT mention_id, CASE WHEN sentiment_compound >= cast(0.05 AS double) THEN 'positive' WHEN sentiment_compound <= cast(-0.05 AS double) THEN 'negative' ELSE 'neutral' END AS sentiment_label FROM mentions")
def sentiment_label_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mentions(spark, sf_dir).select("mention_id", records.sentiment_label(F.col("sentiment_compound")).alias("sentiment_label"))


@query("SELECT doc_id, CASE WHEN source <> 'src3' AND n_chars / cast(10000 AS double) >= cast(0.1 AS double) THEN source ELSE 'Other' END AS category FROM documents")
def category_derivation(spark: SparkSession, sf_dir: str) -> DataFrame:
    cluster = F.when(F.col("source") == "src3", "Unassigned").otherwise(F.col("source"))
    return load(spark, sf_dir, "documents").select("doc_id", records.category_of(cluster, F.col("n_chars") / 10000.0).alias("category"))


@query("SELECT d.doc_id, coalesce('L' || l.quality, 'C000') AS target_cluster_id FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def assignment_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    assigned = load(spark, sf_dir, "labels").select("doc_id", F.concat(F.lit("L"), F.col("quality").cast("string")).alias("target_cluster_id"), F.lit("x").alias("target_cluster"), F.lit(1.0).alias("target_cluster_score"))
    return records.with_assignments(load(spark, sf_dir, "documents"), assigned, "doc_id", F.col("n_chars")).select("doc_id", "target_cluster_id")


@query("SELECT event_id, cast(json_extract_string(props, '$.k') AS bigint) AS k FROM events")
def json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "events").select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))


# Windows


BOARD = f"""WITH {MENTIONS}, latest AS (SELECT cast(max(published_at) - INTERVAL 8 HOUR AS date) AS d FROM mentions),
weeks AS (SELECT cast(b AS integer) AS back, d - cast(dayofweek(d) AS integer) - 7 * cast(b AS integer) AS cur_start FROM latest, range(4) t(b)),
rows_in AS (SELECT w.back, m.*, cast(published_at - INTERVAL 8 HOUR AS date) AS local_day, cast(published_at - INTERVAL 8 HOUR AS date) >= cur_start AS is_cur FROM mentions m JOIN weeks w ON cast(published_at - INTERVAL 8 HOUR AS date) >= cur_start - 7 AND cast(published_at - INTERVAL 8 HOUR AS date) < cur_start + 7),
cover AS (SELECT back, count(*) FILTER (is_cur) AS rows_cur, count(*) FILTER (NOT is_cur) AS rows_prev, count(DISTINCT CASE WHEN is_cur THEN local_day END) AS days_cur FROM rows_in GROUP BY back),
stats AS (SELECT w.back, c.category, count(*) FILTER (is_cur) AS mentions_c, count(*) FILTER (NOT is_cur) AS mentions_p, count(DISTINCT CASE WHEN is_cur THEN community END) AS communities_c,
 coalesce(avg(CASE WHEN is_cur THEN sentiment_compound END), 0) AS sentiment_c, coalesce(avg(CASE WHEN is_cur THEN engagement_score END), 0) AS engagement_c, coalesce(avg(CASE WHEN NOT is_cur THEN engagement_score END), 0) AS engagement_p
 FROM weeks w CROSS JOIN (SELECT DISTINCT category FROM mentions) c LEFT JOIN rows_in r ON r.back = w.back AND r.category = c.category GROUP BY w.back, c.category),
a AS (SELECT *, round(mentions_c / cast(CASE WHEN mentions_p = 0 THEN 1 ELSE mentions_p END AS double), 3) AS spike_ratio, median(engagement_c) OVER (PARTITION BY back) AS med FROM stats),
b AS (SELECT *, quantile_cont(spike_ratio, cast(0.97 AS double)) OVER (PARTITION BY back) AS max_spike, CASE WHEN engagement_p = 0 THEN med ELSE engagement_p END AS base FROM a),
c AS (SELECT *, round(least(spike_ratio, max_spike) / greatest(max_spike, cast(1 AS double)), 4) AS normalized_spike, round(communities_c / cast(greatest(max(communities_c) OVER (PARTITION BY back), 1) AS double), 4) AS cross_community, round((sentiment_c + 1) / 2, 4) AS sentiment_score,
 round(CASE WHEN base = 0 THEN CASE WHEN engagement_c = 0 THEN cast(1 AS double) ELSE cast(4 AS double) END ELSE least(engagement_c / base, cast(4 AS double)) END, 4) AS eng_momentum FROM b),
d AS (SELECT *, round(eng_momentum / greatest(quantile_cont(eng_momentum, cast(0.97 AS double)) OVER (PARTITION BY back), cast(1 AS double)), 4) AS eng_momentum_norm FROM c),
e AS (SELECT *, round(cast(0.25 AS double) * (normalized_spike + cross_community + sentiment_score + eng_momentum_norm), 8) AS trend_score, mentions_c - mentions_p AS mentions_delta, greatest(sum(mentions_p) OVER (PARTITION BY back), 1) AS prev_total,
 round(mentions_c / cast(greatest(sum(mentions_c) OVER (PARTITION BY back), 1) AS double), 6) AS current_share FROM d),
f AS (SELECT *, round(mentions_p / cast(prev_total AS double), 6) AS previous_share FROM e),
g AS (SELECT *, round(current_share / CASE WHEN previous_share = 0 THEN 1 / cast(prev_total AS double) ELSE previous_share END, 3) AS share_spike, round(current_share * prev_total, 1) AS coverage_adjusted_mentions FROM f),
h AS (SELECT *, round(coverage_adjusted_mentions - mentions_p, 1) AS normalized_delta FROM g),
board AS (SELECT h.*, round(rows_cur / cast(greatest(rows_prev, 1) AS double), 4) AS coverage_ratio, days_cur, CASE WHEN rows_cur / cast(greatest(rows_prev, 1) AS double) < cast(0.75 AS double) OR days_cur < 6 THEN 'partial_week' ELSE 'complete_week' END AS data_quality_flag FROM h JOIN cover USING (back)),
final AS (SELECT *, CASE WHEN data_quality_flag = 'partial_week' THEN CASE WHEN mentions_c >= 20 AND normalized_delta >= 50 AND share_spike >= cast(1.25 AS double) AND communities_c >= 3 THEN 'rising' WHEN mentions_p >= 50 AND normalized_delta <= -50 AND share_spike <= cast(0.75 AS double) THEN 'declining' ELSE 'stable' END
 ELSE CASE WHEN mentions_c >= 50 AND mentions_delta >= 50 AND spike_ratio >= cast(1.6 AS double) AND communities_c >= 3 THEN 'rising' WHEN mentions_p >= 50 AND mentions_delta <= -25 AND spike_ratio <= cast(0.8 AS double) THEN 'declining' ELSE 'stable' END END AS trend_direction,
 CASE WHEN mentions_c >= 20 AND mentions_delta >= 8 AND mentions_delta / cast(mentions_p + 5 AS double) >= cast(0.12 AS double) THEN 'rising' WHEN mentions_p >= 20 AND mentions_delta <= -30 AND mentions_delta / cast(mentions_p + 5 AS double) <= cast(-0.25 AS double) THEN 'declining' ELSE 'stable' END AS view_direction FROM board)
"""


def board(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = windows.trend_board(mentions(spark, sf_dir), digits=8)
    return rows.withColumn("view_direction", windows.view_direction(F.col("mentions_c"), F.col("mentions_p")))


@query(f"{BOARD} SELECT back, category, mentions_c, mentions_p, communities_c, spike_ratio, normalized_spike, cross_community, sentiment_score, eng_momentum, eng_momentum_norm, trend_score, mentions_delta, data_quality_flag, trend_direction FROM final")
def trend_board(spark: SparkSession, sf_dir: str) -> DataFrame:
    return board(spark, sf_dir).select("back", "category", "mentions_c", "mentions_p", "communities_c", "spike_ratio", "normalized_spike", "cross_community", "sentiment_score", "eng_momentum", "eng_momentum_norm", "trend_score", "mentions_delta", "data_quality_flag", "trend_direction")


@query(f"{BOARD} SELECT back, category, view_direction FROM final")
def trend_direction_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return board(spark, sf_dir).select("back", "category", "view_direction")


@query(f"{BOARD} SELECT back, category, current_share, previous_share, share_spike, coverage_adjusted_mentions, normalized_delta FROM final")
def share_adjusted_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return board(spark, sf_dir).select("back", "category", "current_share", "previous_share", "share_spike", "coverage_adjusted_mentions", "normalized_delta")


@query(f"{BOARD} SELECT back, rows_cur, rows_prev, days_cur, round(rows_cur / cast(greatest(rows_prev, 1) AS double), 4) AS coverage_ratio, CASE WHEN rows_cur / cast(greatest(rows_prev, 1) AS double) < cast(0.75 AS double) OR days_cur < 6 THEN 'partial_week' ELSE 'complete_week' END AS data_quality_flag FROM cover")
def coverage_quality_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = mentions(spark, sf_dir)
    return windows.coverage(windows.in_windows(m, windows.week_windows(m))).drop("days_prev")


@query(f"{BOARD} SELECT back, count(*) AS categories, count(*) FILTER (view_direction = 'rising') AS rising, count(*) FILTER (view_direction = 'declining') AS declining, count(*) FILTER (view_direction = 'stable') AS stable, cast(sum(mentions_c) AS bigint) AS mentions FROM final WHERE category <> 'Other' GROUP BY back")
def kpi_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    of = lambda d: F.count_if(F.col("view_direction") == d).alias(d)
    return board(spark, sf_dir).where("category <> 'Other'").groupBy("back").agg(F.count("*").alias("categories"), of("rising"), of("declining"), of("stable"), F.sum("mentions_c").alias("mentions"))


@query(f"{BOARD} SELECT back, category, spike_ratio, rank FROM (SELECT *, row_number() OVER (PARTITION BY back ORDER BY spike_ratio DESC, category) AS rank FROM final WHERE view_direction = 'rising') WHERE rank <= 8")
def spike_radar_topn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return brands.ranked(board(spark, sf_dir).where("view_direction = 'rising'"), ["back"], 8, F.col("spike_ratio").desc(), F.col("category")).select("back", "category", "spike_ratio", F.col("rank").cast("bigint").alias("rank"))


@query(f"{BOARD} SELECT category, trend_score, spike_ratio, communities_c, round(greatest(8, least(60, 6 * sqrt(cast(mentions_c AS double)))), 6) AS bubble FROM final WHERE back = 1 ORDER BY trend_score DESC, category LIMIT 12")
def spike_reach_bubble(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best of a window by score: a top-k report."""
    rows = board(spark, sf_dir).where("back = 1").orderBy(F.col("trend_score").desc(), "category").limit(12)
    return rows.select("category", "trend_score", "spike_ratio", "communities_c", F.round(F.greatest(F.lit(8.0), F.least(F.lit(60.0), 6 * F.sqrt("mentions_c"))), 6).alias("bubble"))


@query(f"WITH {MENTIONS} SELECT category, count(*) AS mentions, count(DISTINCT community) AS communities, round(avg(sentiment_compound), 6) AS mean_sentiment, round(avg(engagement_score), 6) AS mean_engagement FROM mentions WHERE published_at >= TIMESTAMP '2024-01-08' AND published_at < TIMESTAMP '2024-01-22' GROUP BY category")
def category_period_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda v: F.lit(v).cast("timestamp_ntz")
    rows = mentions(spark, sf_dir).where((F.col("published_at") >= t("2024-01-08")) & (F.col("published_at") < t("2024-01-22")))
    return rows.groupBy("category").agg(F.count("*").alias("mentions"), F.count_distinct("community").alias("communities"), F.round(F.avg("sentiment_compound"), 6).alias("mean_sentiment"), F.round(F.avg("engagement_score"), 6).alias("mean_engagement"))


@query(f"WITH {MENTIONS} SELECT category, mention_id, engagement_score, rank FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY engagement_score DESC, mention_id) AS rank FROM mentions) WHERE rank <= 5")
def top_posts_per_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    return brands.ranked(mentions(spark, sf_dir), ["category"], 5, F.col("engagement_score").desc(), F.col("mention_id")).select("category", "mention_id", "engagement_score", F.col("rank").cast("bigint").alias("rank"))


@query("SELECT page_id, host FROM (SELECT page_id, regexp_extract(url, '^https?://([^/]+)', 1) AS host, row_number() OVER (PARTITION BY regexp_extract(url, '^https?://([^/]+)', 1) ORDER BY length(html) DESC, page_id) AS rn FROM pages) WHERE rn = 1")
def hot_posts_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", "^https?://([^/]+)", 1).alias("host"), F.length("html").alias("size"))
    return records.first_by(rows, ["host"], F.col("size").desc(), F.col("page_id")).select("page_id", "host")


# Weekly series


FACTS = f"""WITH {SERIES}, facts AS (SELECT category, cast(date_trunc('week', published_at) AS date) AS wk, count(*) AS mentions, count(DISTINCT community) AS communities, avg(sentiment) AS mean_sentiment, avg(engagement) AS mean_engagement FROM series GROUP BY 1, 2),
shares AS (SELECT *, sum(mentions) OVER (PARTITION BY wk) AS total_mentions, sum(communities) OVER (PARTITION BY wk) AS total_communities, mentions / cast(greatest(sum(mentions) OVER (PARTITION BY wk), 1) AS double) AS share, communities / cast(greatest(sum(communities) OVER (PARTITION BY wk), 1) AS double) AS comm_share FROM facts),
lagged AS (SELECT *, share / CASE WHEN lag(share) OVER s IS NOT NULL THEN greatest(lag(share) OVER s, cast(1e-9 AS double)) END AS spike_ww, mean_engagement / CASE WHEN lag(mean_engagement) OVER s IS NOT NULL THEN greatest(lag(mean_engagement) OVER s, cast(1e-9 AS double)) END AS mom FROM shares WINDOW s AS (PARTITION BY category ORDER BY wk)),
parts AS (SELECT *, CASE WHEN spike_ww IS NOT NULL THEN (rank() OVER (PARTITION BY wk ORDER BY spike_ww NULLS LAST) + (count(*) OVER (PARTITION BY wk, spike_ww) - 1) / cast(2 AS double)) / count(spike_ww) OVER (PARTITION BY wk) END AS spike_norm, communities / cast(greatest(max(communities) OVER (PARTITION BY wk), 1) AS double) AS comm_norm, (mean_sentiment + 1) / 2 AS sentiment_score, CASE WHEN mom IS NOT NULL THEN least(mom, cast(4 AS double)) END AS eng_mom FROM lagged),
normed AS (SELECT *, eng_mom / CASE WHEN eng_mom IS NOT NULL THEN greatest(quantile_cont(eng_mom, cast(0.97 AS double)) OVER (PARTITION BY wk), cast(1e-9 AS double)) END AS eng_mom_norm FROM parts),
scored AS (SELECT *, CASE WHEN spike_norm + comm_norm + sentiment_score + eng_mom_norm IS NOT NULL THEN least((spike_norm + comm_norm + sentiment_score + eng_mom_norm) * cast(0.25 AS double), cast(1 AS double)) END AS trend_score, row_number() OVER (PARTITION BY category ORDER BY wk) - 1 AS week_num, count(*) OVER (PARTITION BY category) AS n_weeks FROM normed)
"""


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weekly.trend_score(weekly.shares(weekly.facts(series(spark, sf_dir))))


@query(f"{FACTS} SELECT category, strftime(wk, '%Y-%m-%d') AS week, mentions, communities, round(mean_sentiment, 6) AS mean_sentiment, round(mean_engagement, 6) AS mean_engagement FROM facts")
def weekly_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weekly.facts(series(spark, sf_dir)).select("category", day("week").alias("week"), "mentions", "communities", F.round("mean_sentiment", 6).alias("mean_sentiment"), F.round("mean_engagement", 6).alias("mean_engagement"))


@query(f"WITH {SERIES} SELECT category, strftime(date_trunc('week', published_at), '%Y-%m-%d') AS week, count(*) AS mentions, count(DISTINCT community) AS communities FROM series WHERE published_at < (SELECT max(published_at) - INTERVAL 28 DAY FROM series) GROUP BY 1, 2")
def archive_weekly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weekly.archive(series(spark, sf_dir)).select("category", day("week").alias("week"), "mentions", "communities")


@query(f"{FACTS} SELECT category, strftime(wk, '%Y-%m-%d') AS week, cast(total_mentions AS bigint) AS total_mentions, cast(total_communities AS bigint) AS total_communities, round(share, 8) AS share, round(comm_share, 8) AS comm_share FROM shares")
def weekly_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weekly.shares(weekly.facts(series(spark, sf_dir))).select("category", day("week").alias("week"), "total_mentions", "total_communities", F.round("share", 8).alias("share"), F.round("comm_share", 8).alias("comm_share"))


@query(f"{FACTS} SELECT category, strftime(wk, '%Y-%m-%d') AS week, round(spike_ww, 8) AS spike_ww, round(spike_norm, 8) AS spike_norm FROM parts")
def weekly_spike_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spark, sf_dir).select("category", day("week").alias("week"), F.round("spike_ww", 8).alias("spike_ww"), F.round("spike_norm", 8).alias("spike_norm"))


@query(f"{FACTS} SELECT category, strftime(wk, '%Y-%m-%d') AS week, round(comm_norm, 8) AS comm_norm, round(eng_mom_norm, 8) AS eng_mom_norm, round(trend_score, 8) AS trend_score FROM scored")
def weekly_trend_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spark, sf_dir).select("category", day("week").alias("week"), F.round("comm_norm", 8).alias("comm_norm"), F.round("eng_mom_norm", 8).alias("eng_mom_norm"), F.round("trend_score", 8).alias("trend_score"))


@query(f"""{FACTS} SELECT category, strftime(wk, '%Y-%m-%d') AS week, round(CASE WHEN count(trend_score) OVER w >= 2 THEN avg(trend_score) OVER w END, 7) AS roll_mean, round(CASE WHEN count(trend_score) OVER w >= 2 THEN greatest(stddev_samp(trend_score) OVER w, cast(1e-6 AS double)) END, 7) AS roll_std,
round((trend_score - CASE WHEN count(trend_score) OVER w >= 2 THEN avg(trend_score) OVER w END) / CASE WHEN count(trend_score) OVER w >= 2 THEN greatest(stddev_samp(trend_score) OVER w, cast(1e-6 AS double)) END, 5) AS trend_score_z FROM scored WINDOW w AS (PARTITION BY category ORDER BY wk ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)""")
def rolling_zscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weekly.rolling(scored(spark, sf_dir)).select("category", day("week").alias("week"), F.round("roll_mean", 7).alias("roll_mean"), F.round("roll_std", 7).alias("roll_std"), F.round("trend_score_z", 5).alias("trend_score_z"))


@query(f"""{FACTS} SELECT category, week_num, round(lag(trend_score) OVER s, 8) AS trend_score_lag1, round(CASE WHEN count(trend_score) OVER w = 4 THEN regr_slope(trend_score, cast(week_num AS double)) OVER w END, 7) AS trend_score_mom, round(share - lag(share) OVER s, 8) AS share_chg_1w, round(share - lag(share, 4) OVER s, 8) AS share_chg_4w
FROM scored WINDOW s AS (PARTITION BY category ORDER BY wk), w AS (PARTITION BY category ORDER BY wk ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING)""")
def lag_slope(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = weekly.lags(scored(spark, sf_dir))
    return rows.select("category", F.col("week_num").cast("bigint").alias("week_num"), F.round("trend_score_lag1", 8).alias("trend_score_lag1"), F.round("trend_score_mom", 7).alias("trend_score_mom"), F.round("share_chg_1w", 8).alias("share_chg_1w"), F.round("share_chg_4w", 8).alias("share_chg_4w"))


@query(f"""{FACTS} SELECT category, week_num, CASE WHEN week_num + 2 < n_weeks THEN coalesce(cast(avg(trend_score) OVER a > trend_score AS integer), 0) END AS rise_2w, CASE WHEN week_num + 4 < n_weeks THEN coalesce(cast(avg(trend_score) OVER b > trend_score AS integer), 0) END AS rise_4w
FROM scored WINDOW a AS (PARTITION BY category ORDER BY wk ROWS BETWEEN 1 FOLLOWING AND 2 FOLLOWING), b AS (PARTITION BY category ORDER BY wk ROWS BETWEEN 1 FOLLOWING AND 4 FOLLOWING)""")
def rise_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weekly.rise_targets(weekly.lags(scored(spark, sf_dir))).select("category", F.col("week_num").cast("bigint").alias("week_num"), "rise_2w", "rise_4w")


@query(f"""{FACTS}, held AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY wk DESC) AS back FROM scored WHERE trend_score BETWEEN cast(0.01 AS double) AND 10),
line AS (SELECT category, regr_slope(trend_score, cast(-back AS double)) AS slope, regr_intercept(trend_score, cast(-back AS double)) AS level, max(wk) AS last_week FROM held WHERE back <= 10 GROUP BY category HAVING count(*) >= 6)
SELECT category, strftime(last_week + cast(7 * step AS integer), '%Y-%m-%d') AS ds, round(greatest(level + slope * (step - 1), 0), 3) AS yhat FROM line, range(1, 5) t(step)""")
def series_forecast_linear(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weekly.line_forecast(scored(spark, sf_dir)).select("category", day("ds").alias("ds"), "yhat")


@query()
def rise_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return models.rise_predictions(weekly.facts(series(spark, sf_dir)))


@query("""WITH two AS (SELECT o_orderpriority AS category, round(avg(cast(o_orderstatus = 'F' AS integer)), 6) AS p2 FROM orders WHERE o_orderpriority < '4' GROUP BY 1), four AS (SELECT o_orderpriority AS category, round(avg(cast(o_orderstatus = 'O' AS integer)), 6) AS p4 FROM orders WHERE o_orderpriority > '2' GROUP BY 1)
SELECT category, coalesce(p2, 0.5) AS p2, coalesce(p4, 0.5) AS p4, round(cast(0.55 AS double) * coalesce(p2, 0.5) + cast(0.45 AS double) * coalesce(p4, 0.5), 3) AS rise_score FROM two FULL JOIN four USING (category)""")
def blend_outer(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = load(spark, sf_dir, "orders").withColumnRenamed("o_orderpriority", "category")
    rate = lambda status, name, held: o.where(held).groupBy("category").agg(F.round(F.avg((F.col("o_orderstatus") == status).cast("int")), 6).alias(name))
    return weekly.blended(rate("F", "p2", "category < '4'"), rate("O", "p4", "category > '2'"))


@query("""WITH t AS (SELECT cast(o_custkey % 40 AS varchar) AS category, avg(cast(o_orderstatus = 'F' AS integer)) AS p2, avg(cast(o_orderstatus = 'O' AS integer)) AS p4 FROM orders GROUP BY 1), r AS (SELECT category, '2w' AS horizon, p2 AS p FROM t UNION ALL SELECT category, '4w', p4 FROM t)
SELECT category, horizon, round(p, 6) AS p, CASE WHEN p >= cast(0.35 AS double) THEN 'rising' ELSE 'declining' END AS direction FROM r WHERE p >= cast(0.35 AS double) OR p <= cast(0.31 AS double)""")
def confident_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = load(spark, sf_dir, "orders").withColumn("category", (F.col("o_custkey") % 40).cast("string"))
    rate = lambda v: F.avg((F.col("o_orderstatus") == v).cast("int"))
    return weekly.confident(o.groupBy("category").agg(rate("F").alias("p2"), rate("O").alias("p4")), 0.35, 0.31).withColumn("p", F.round("p", 6))


@query("SELECT DISTINCT o_orderpriority AS category, dense_rank() OVER (ORDER BY o_orderpriority) - 1 AS cat_encoded FROM orders")
def label_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = weekly.encoded(load(spark, sf_dir, "orders").withColumnRenamed("o_orderpriority", "category"))
    return rows.select("category", F.col("cat_encoded").cast("bigint").alias("cat_encoded"))


@query("SELECT o_custkey, strftime(min(o_orderdate), '%Y-%m-%d') AS first_day, strftime(max(o_orderdate), '%Y-%m-%d') AS last_day FROM orders GROUP BY o_custkey HAVING NOT (max(o_orderdate) < TIMESTAMP '1996-01-01' OR min(o_orderdate) > TIMESTAMP '1996-03-31')")
def event_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = load(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.min("o_orderdate").alias("start"), F.max("o_orderdate").alias("end"))
    shown = weekly.overlapping(spans, "start", "end", F.lit("1996-01-01").cast("timestamp_ntz"), F.lit("1996-03-31").cast("timestamp_ntz"))
    return shown.select("o_custkey", day("start").alias("first_day"), day("end").alias("last_day"))


# Brands


BRANDS = f"""WITH {BRAND_FACTS}, brand_rows AS (SELECT category, brand, count(*) FILTER (is_cur) AS cur_mentions, count(*) FILTER (NOT is_cur) AS prev_mentions, round(avg(CASE WHEN is_cur THEN sentiment END), 3) AS avg_sentiment FROM facts GROUP BY 1, 2),
brand_table AS (SELECT *, round(cur_mentions / cast(greatest(prev_mentions, 1) AS double), 2) AS brand_spike FROM brand_rows WHERE cur_mentions >= 3)
"""


@query(f"{BRANDS} SELECT category, brand, cur_mentions, prev_mentions, avg_sentiment, brand_spike FROM brand_table")
def brand_table_cur_prev(spark: SparkSession, sf_dir: str) -> DataFrame:
    return brands.brand_table(brand_facts(spark, sf_dir))


@query(f"""{BRANDS.replace("p_brand AS brand", "concat(p_brand, ' ', p_name) AS brand")}, many AS (SELECT * FROM brand_table) SELECT brand, count(DISTINCT category) AS brand_categories, (SELECT count(DISTINCT category) FROM many) AS n_categories, round(count(DISTINCT category) / cast((SELECT count(DISTINCT category) FROM many) AS double), 6) AS category_share FROM many GROUP BY brand HAVING count(DISTINCT category) / cast((SELECT count(DISTINCT category) FROM many) AS double) <= cast(0.4 AS double)""")
def brand_spread_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A brand's line of products counts as the brand, as all brands are in all categories."""
    facts = brand_facts(spark, sf_dir, "concat(p_brand, ' ', p_name)")
    return brands.spread(brands.brand_table(facts)).withColumn("category_share", F.round("category_share", 6))


@query(f"{BRANDS} SELECT category, brand, cur_mentions, brand_rank FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY cur_mentions DESC, brand_spike DESC, avg_sentiment DESC NULLS LAST, brand) AS brand_rank FROM brand_table) WHERE brand_rank <= 30")
def brand_top30(spark: SparkSession, sf_dir: str) -> DataFrame:
    return brands.top_brands(brands.brand_table(brand_facts(spark, sf_dir))).select("category", "brand", "cur_mentions", F.col("brand_rank").cast("bigint").alias("brand_rank"))


@query(f"{BRANDS} SELECT category, brand, cur_mentions - prev_mentions AS delta, round(cur_mentions / cast(CASE WHEN prev_mentions = 0 THEN 1 ELSE prev_mentions END AS double), 2) AS spike, CASE WHEN avg_sentiment > 0 THEN '+' WHEN avg_sentiment < 0 THEN '-' ELSE '0' END AS mood FROM brand_table")
def keyword_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return brands.keyword_matrix(brands.brand_table(brand_facts(spark, sf_dir))).select("category", "brand", "delta", "spike", "mood")


@query(f"""WITH {BRAND_FACTS}, modes AS (SELECT cluster, arg_min(category, (-n, category)) AS category FROM (SELECT cluster, category, count(*) AS n FROM facts WHERE is_cur GROUP BY 1, 2) GROUP BY cluster),
b AS (SELECT cluster, brand, count(*) FILTER (is_cur) AS c, count(*) FILTER (NOT is_cur) AS p, avg(CASE WHEN is_cur THEN sentiment END) AS s, count(DISTINCT CASE WHEN is_cur THEN community END) AS communities FROM facts GROUP BY 1, 2 HAVING count(*) FILTER (is_cur) >= 2),
k AS (SELECT *, round(c / cast(greatest(p, 1) AS double), 3) AS brand_spike FROM b WHERE cluster IN (SELECT cluster FROM facts WHERE is_cur GROUP BY cluster HAVING count(*) >= 10)),
q AS (SELECT *, quantile_cont(brand_spike, cast(0.97 AS double)) OVER (PARTITION BY cluster) AS top FROM k),
r AS (SELECT *, round(least(brand_spike / greatest(CASE WHEN top = 0 THEN 1 ELSE top END, cast(1 AS double)), cast(1 AS double)), 4) AS norm_spike, round((round(s, 3) + 1) / 2, 4) AS sentiment_score, round(communities / cast(greatest(max(communities) OVER (PARTITION BY cluster), 1) AS double), 4) AS comm_score FROM q)
SELECT cluster, category, brand, c AS cur_mentions, p AS prev_mentions, communities, brand_spike, norm_spike, sentiment_score, comm_score, round(cast(0.40 AS double) * norm_spike + cast(0.35 AS double) * sentiment_score + cast(0.25 AS double) * comm_score, 8) AS brand_trend_score FROM r JOIN modes USING (cluster)""")
def cluster_brand_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return brands.cluster_trend(brand_facts(spark, sf_dir), digits=8)


@query("""WITH posts AS (SELECT doc_id AS mention_id, lang AS category, n_chars AS engagement, text FROM documents), b AS (SELECT DISTINCT lang AS category, unnest(['the', 'ou', 'de la', 'ung']) AS brand FROM documents)
SELECT category, brand, mention_id, rank FROM (SELECT category, brand, mention_id, row_number() OVER (PARTITION BY category, brand ORDER BY engagement DESC, mention_id) AS rank FROM b JOIN posts USING (category) WHERE contains(lower(text), lower(brand))) WHERE rank <= 10""")
def brand_posts_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    posts = load(spark, sf_dir, "documents").select(F.col("doc_id").alias("mention_id"), F.col("lang").alias("category"), F.col("n_chars").alias("engagement"), "text", F.lit(None).cast("string").alias("title"))
    named = posts.select("category").distinct().withColumn("brand", F.explode(F.array(*map(F.lit, ("the", "ou", "de la", "ung")))))
    return brands.brand_posts(named, posts).select("category", "brand", "mention_id", F.col("rank").cast("bigint").alias("rank"))


@query("""WITH posts AS (SELECT source AS cluster, lang AS community, cast(quality AS double) AS score, TIMESTAMP '2024-01-01' + to_days(cast(d.doc_id % 60 AS integer)) AS published_at FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id), tax AS (SELECT DISTINCT source AS cluster FROM documents UNION ALL SELECT 'unseen'),
per AS (SELECT cluster, count(*) AS mentions, count(DISTINCT community) AS communities, round(avg(score), 6) AS avg_score FROM posts GROUP BY 1),
top AS (SELECT cluster, string_agg(community, ', ' ORDER BY n DESC, community) AS top_communities FROM (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY n DESC, community) AS r FROM (SELECT cluster, community, count(*) AS n FROM posts GROUP BY 1, 2)) WHERE r <= 5 GROUP BY 1),
recent AS (SELECT cluster, count(*) AS recent_mentions FROM posts WHERE published_at >= (SELECT max(published_at) - INTERVAL 14 DAY FROM posts) GROUP BY 1)
SELECT cluster, coalesce(mentions, 0) AS mentions, coalesce(communities, 0) AS communities, avg_score, coalesce(top_communities, '') AS top_communities, coalesce(recent_mentions, 0) AS recent_mentions, CASE WHEN mentions >= 100 THEN 'OK' WHEN mentions > 0 THEN 'thin' ELSE 'missing' END AS status FROM tax LEFT JOIN per USING (cluster) LEFT JOIN top USING (cluster) LEFT JOIN recent USING (cluster)""")
def coverage_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels")
    posts = docs.join(labels, "doc_id", "left").select(F.col("source").alias("cluster"), F.col("lang").alias("community"), F.col("quality").cast("double").alias("score"), F.expr("timestamp_ntz'2024-01-01' + make_dt_interval(cast(doc_id % 60 as int))").alias("published_at"))
    taxonomy = posts.select("cluster").distinct().unionByName(spark.sql("SELECT 'unseen' AS cluster"))
    return brands.coverage_report(taxonomy, posts).withColumn("avg_score", F.round("avg_score", 6))


# Vectors


@query("""WITH tax AS (SELECT 'C' || lpad(cast(label + 1 AS varchar), 3, '0') AS id, arg_min(embedding, vec_id) AS t FROM embeddings GROUP BY label), s AS (SELECT vec_id, id, list_dot_product(cast(embedding AS double[]), cast(t AS double[])) / sqrt(list_dot_product(cast(embedding AS double[]), cast(embedding AS double[]))) / sqrt(list_dot_product(cast(t AS double[]), cast(t AS double[]))) AS c FROM embeddings, tax)
SELECT vec_id, CASE WHEN max(c) >= cast(0.2 AS double) THEN arg_max(id, c) ELSE 'C000' END AS target_cluster_id, round(max(c), 4) AS target_cluster_score FROM s GROUP BY vec_id""")
def nearest_taxonomy(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = load(spark, sf_dir, "embeddings")
    tax = e.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("embedding")).select(F.concat(F.lit("C"), F.lpad((F.col("label") + 1).cast("string"), 3, "0")).alias("target_cluster_id"), "embedding")
    return vectors.nearest_taxonomy(e, tax)


@query("""WITH s AS (SELECT n.vec_id, b.vec_id AS other, b.label, list_dot_product(cast(n.embedding AS double[]), cast(b.embedding AS double[])) / sqrt(list_dot_product(cast(n.embedding AS double[]), cast(n.embedding AS double[]))) / sqrt(list_dot_product(cast(b.embedding AS double[]), cast(b.embedding AS double[]))) AS c FROM embeddings n, embeddings b WHERE n.vec_id % 50 = 0 AND b.vec_id <> n.vec_id),
k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY c DESC, other) AS r FROM s) WHERE r <= 5), v AS (SELECT vec_id, label, count(*) AS n FROM k GROUP BY 1, 2)
SELECT vec_id, arg_min(label, (-n, label)) AS label FROM v GROUP BY vec_id""")
def knn_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stated query set of searches, ids divisible by 50, against all rows but the query itself."""
    e = load(spark, sf_dir, "embeddings")
    return vectors.knn_vote(e.where("vec_id % 50 = 0"), e)


@query("""WITH tax AS (SELECT * FROM (VALUES ('src1', ['token', 'license']), ('src2', cast(NULL AS varchar[])), ('src3', ['!!'])) t(id, terms))
SELECT doc_id, CASE WHEN hit THEN 'C000' ELSE source END AS target_cluster_id, hit AS vetoed FROM (SELECT doc_id, source, coalesce(len(list_filter(terms, lambda x: contains(lower(text), x))) > 0, false) AS hit FROM documents LEFT JOIN tax ON id = source)""")
def negative_keyword_veto(spark: SparkSession, sf_dir: str) -> DataFrame:
    tax = spark.sql("SELECT * FROM VALUES ('src1', 'token|License'), ('src2', NULL), ('src3', '!!') AS t(target_cluster_id, negative_keywords)")
    rows = load(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("target_cluster_id"), F.lit(1.0).alias("target_cluster_score"), "text")
    return vectors.vetoed(rows, tax, "doc_id").select("doc_id", "target_cluster_id", "vetoed")


@query()
def pca_kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return models.clusters(load(spark, sf_dir, "embeddings"))


@query()
def hashed_text_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return models.text_vectors(load(spark, sf_dir, "documents"), "doc_id", "text").select("doc_id", F.transform(unit(F.col("embedding")), lambda x: F.round(x, 6)).alias("embedding"))


# Text


@query(r"""SELECT doc_id, md5(trim(regexp_replace(regexp_replace(lower(text), '[''\-.&,!?/\\()\[\]_*@#%^~`|]', ' ', 'g'), '\s+', ' ', 'g'))) AS norm_md5 FROM documents""")
def normalize_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "documents").select("doc_id", F.md5(T.plain(F.col("text"))).alias("norm_md5"))


@query(r"""SELECT doc_id, md5(trim(regexp_replace(regexp_replace(replace(lower(text), '&', 'and'), '[^\p{L}\p{M}\p{Nd}_'']', ' ', 'g'), '\s+', ' ', 'g'))) AS norm_md5 FROM documents""")
def normalize_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "documents").select("doc_id", F.md5(T.contextual(F.col("text"))).alias("norm_md5"))


@query()
def sentence_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "documents").select("doc_id", F.posexplode(T.sentences(F.col("text"))).alias("at", "sentence")).select("doc_id", "at", F.md5("sentence").alias("sentence_md5"))


@query(r"""WITH t AS (SELECT doc_id, list_filter(string_split_regex(trim(regexp_replace(regexp_replace(lower(text), '[''\-.&,!?/\\()\[\]_*@#%^~`|]', ' ', 'g'), '\s+', ' ', 'g')), '\s+'), lambda x: x <> '') AS w FROM documents),
u AS (SELECT doc_id, unnest(w) AS one, generate_subscripts(w, 1) AS i FROM t), g AS (SELECT doc_id, one AS g FROM u UNION ALL SELECT doc_id, one || ' ' || lead(one) OVER (PARTITION BY doc_id ORDER BY i) FROM u)
SELECT doc_id, upper(g) AS brand, count(*) AS hits FROM g WHERE g IN ('the', 'of the', 'de la', 'und') GROUP BY 1, 2""")
def ngram_dictionary_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = spark.sql("SELECT norm, upper(norm) AS display FROM VALUES ('the'), ('of the'), ('de la'), ('und') AS t(norm)")
    return extraction.ngram_hits(load(spark, sf_dir, "documents"), names, "doc_id", "text", 2)


@query(f"""WITH a(alias, brand) AS (VALUES ('thea', 'Thea'), ('ionen', 'Ionen'), ('license', 'Licence'), ('ing', 'Ing')), f AS (SELECT doc_id, alias, brand, lower(text) AS t, instr(lower(text), alias) AS i FROM documents, a WHERE contains(lower(text), alias))
SELECT doc_id, alias, brand FROM f WHERE NOT regexp_matches(substr(t, greatest(i - 60, 1), i + length(alias) + 60 - greatest(i - 60, 1)), '{extraction.ANTI_CONTEXT}')""")
def alias_contains_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extraction.alias_hits(load(spark, sf_dir, "documents"), {"thea": "Thea", "ionen": "Ionen", "license": "Licence", "ing": "Ing"}, "doc_id", "text")


@query(r"""WITH t AS (SELECT doc_id, source, unnest(list_distinct(list_filter(string_split_regex(trim(regexp_replace(regexp_replace(lower(text), '[''\-.&,!?/\\()\[\]_*@#%^~`|]', ' ', 'g'), '\s+', ' ', 'g')), '\s+'), lambda x: x <> ''))) AS token FROM documents)
SELECT token, count(DISTINCT doc_id) AS posts, count(DISTINCT source) AS communities FROM t GROUP BY token""")
def candidate_freq_comm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extraction.candidate_spread(load(spark, sf_dir, "documents"), "doc_id", "text", "source")


@query(f"SELECT conv_id, turn, concat_ws(',', {', '.join(f"CASE WHEN regexp_matches(text, '{pattern}') THEN '{label}' END" for label, pattern in extraction.GATES.items())}) AS labels FROM conversations")
def context_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_join(extraction.gate_labels(F.coalesce("text", F.lit(""))), ",").alias("labels"))


@query()
def brand_context_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    lexicon = extraction.Lexicon({"apache license": "Apache License", "mit license": "MIT License", "gnu": "GNU"}, frozenset({"license", "work"}))
    return extraction.sentence_brands(load(spark, sf_dir, "documents"), "doc_id", "text", lexicon)


LEXICON = "('worthless', cast(-2.0 AS double)), ('pathetic', cast(-2.5 AS double)), ('the', cast(0.1 AS double)), ('und', cast(0.2 AS double)), ('love', cast(3.0 AS double))"


@query(rf"""WITH w AS (SELECT doc_id, unnest(list_filter(string_split_regex(trim(regexp_replace(regexp_replace(lower(left(text, 500)), '[''\-.&,!?/\\()\[\]_*@#%^~`|]', ' ', 'g'), '\s+', ' ', 'g')), '\s+'), lambda x: x <> '')) AS word FROM documents), lex AS (SELECT * FROM (VALUES {LEXICON}) t(word, valence)),
s AS (SELECT d.doc_id, coalesce(sum(valence), 0) AS x, count(w.word) AS n, count(*) FILTER (valence > 0) AS pos, count(*) FILTER (valence < 0) AS neg FROM documents d LEFT JOIN w ON d.doc_id = w.doc_id LEFT JOIN lex ON w.word = lex.word GROUP BY 1)
SELECT doc_id, round(x / sqrt(x * x + 15), 4) AS sentiment_compound, round(coalesce(pos / cast(nullif(n, 0) AS double), 0), 3) AS sentiment_positive, round(coalesce(neg / cast(nullif(n, 0) AS double), 0), 3) AS sentiment_negative, CASE WHEN round(x / sqrt(x * x + 15), 4) >= cast(0.05 AS double) THEN 'positive' WHEN round(x / sqrt(x * x + 15), 4) <= cast(-0.05 AS double) THEN 'negative' ELSE 'neutral' END AS sentiment_label FROM s""")
def lexicon_sentiment(spark: SparkSession, sf_dir: str) -> DataFrame:
    lexicon = spark.sql(f"SELECT * FROM VALUES {LEXICON} AS t(word, valence)")
    return models.lexicon_sentiment(load(spark, sf_dir, "documents"), lexicon, "doc_id", "text")


@query(r"""WITH v AS (SELECT DISTINCT unnest(list_filter([t, CASE WHEN t LIKE '%s' AND length(t) > 4 THEN regexp_replace(t, 's$', '') ELSE t || 's' END], lambda x: length(x) BETWEEN 3 AND 30 AND NOT regexp_full_match(x, '\d+'))) AS term FROM (SELECT trim(regexp_replace(regexp_replace(lower(p_name), '[^a-z0-9_'']', ' ', 'g'), '\s+', ' ', 'g')) AS t FROM part UNION ALL SELECT trim(regexp_replace(regexp_replace(lower(p_type), '[^a-z0-9_'']', ' ', 'g'), '\s+', ' ', 'g')) FROM part)) SELECT term FROM v WHERE term NOT IN ('brass')""")
def category_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extraction.category_terms(load(spark, sf_dir, "part"), ["p_name", "p_type"], ["brass"])


# Streaming


def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a stream; a folder is read, with only their file let through."""
    schema = load(spark, sf_dir, "events").schema
    raw = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/events*")
    return raw.select(F.col("event_id").alias("mention_id"), F.expr("concat(event_type, '_', cast(user_id % 6 as string))").alias("category"), F.col("ts").cast("timestamp").alias("published_at"))


def _places(spark: SparkSession) -> tuple[str, str]:
    import uuid

    base = f"{shared_folder(spark)}/streams/{uuid.uuid4().hex}"
    return f"{base}/state", f"{base}/out"


@query(f"WITH {MENTIONS} SELECT category, strftime(date_trunc('week', published_at + INTERVAL 1 DAY) - INTERVAL 1 DAY, '%Y-%m-%d') AS week_start, count(*) AS mentions FROM mentions GROUP BY 1, 2")
def stream_weekly_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..streaming import collected, weekly_counts

    state, out = _places(spark)
    return collected(weekly_counts(_stream(spark, sf_dir)), state, out, "complete")


@query(f"WITH {MENTIONS} SELECT DISTINCT category FROM mentions")
def stream_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..streaming import collected, first_only

    state, out = _places(spark)
    return collected(first_only(_stream(spark, sf_dir), "category"), state, out).select("category")


@query("SELECT DISTINCT user_id FROM events")
def stream_seen_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users by their first event, whatever the time between; the keys stay for good."""
    from ..streaming import collected, first_ever, keys_on_disk

    schema = load(spark, sf_dir, "events").schema
    raw = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/events*")
    state, out = _places(spark)
    with keys_on_disk(spark):
        return collected(first_ever(raw.select("user_id"), "user_id"), state, out).select("user_id")
