"""Weekly series by category: facts, shares, scores, lags, targets and straight-line forecasts. Lags are by row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions.numbers import at_least, at_most, average_rank



def by_series() -> WindowSpec:
    return Window.partitionBy("category").orderBy("week")


def by_week() -> WindowSpec:
    return Window.partitionBy("week")


def facts(rows: DataFrame, time: str = "published_at") -> DataFrame:
    """``category, week`` (Monday) with mentions, communities, mean sentiment and engagement."""
    return rows.withColumn("week", F.to_date(F.date_trunc("week", F.col(time)))).groupBy("category", "week").agg(F.count("*").alias("mentions"), F.count_distinct("community").alias("communities"), F.avg("sentiment").alias("mean_sentiment"), F.avg("engagement").alias("mean_engagement"))


def archive(rows: DataFrame, days: int = 28, time: str = "published_at") -> DataFrame:
    """Facts of rows older than ``days`` before the latest one."""
    last = rows.agg((F.max(time) - F.expr(f"INTERVAL {days} DAY")).alias("__cut"))
    return facts(rows.join(F.broadcast(last), F.col(time) < F.col("__cut")), time)


def shares(weekly: DataFrame) -> DataFrame:
    """Shares of the week's mentions and of the sum of its categories' communities, by a window, not a join."""
    total = lambda c: F.sum(c).over(by_week())
    return weekly.withColumn("total_mentions", total("mentions")).withColumn("total_communities", total("communities")).withColumn("share", F.col("mentions") / F.greatest("total_mentions", F.lit(1))).withColumn("comm_share", F.col("communities") / F.greatest("total_communities", F.lit(1)))


def spike_rank(weekly: DataFrame) -> DataFrame:
    before = F.lag("share").over(by_series())
    rows = weekly.withColumn("spike_ww", F.col("share") / at_least(before, 1e-9))
    return rows.withColumn("spike_norm", average_rank(F.col("spike_ww"), ["week"], by_week().orderBy(F.col("spike_ww").asc_nulls_last()), by_week(), Window.partitionBy("week", "spike_ww")))


def trend_score(weekly: DataFrame) -> DataFrame:
    """Adds the weekly score: the mean of four parts, at most 1, null if a part is."""
    rows = spike_rank(weekly).withColumn("comm_norm", F.col("communities") / F.greatest(F.max("communities").over(by_week()), F.lit(1))).withColumn("sentiment_score", (F.col("mean_sentiment") + 1) / 2)
    rows = rows.withColumn("eng_mom", at_most(F.col("mean_engagement") / at_least(F.lag("mean_engagement").over(by_series()), 1e-9), 4.0))
    rows = rows.withColumn("eng_mom_norm", F.col("eng_mom") / at_least(F.percentile("eng_mom", F.lit(0.97)).over(by_week()), 1e-9))
    return rows.withColumn("trend_score", at_most((F.col("spike_norm") + F.col("comm_norm") + F.col("sentiment_score") + F.col("eng_mom_norm")) * 0.25, 1.0))


def rolling(rows: DataFrame, value: str = "trend_score", last: int = 4) -> DataFrame:
    """Mean, sample deviation and z of the last rows, the current one too; two values at least."""
    span = by_series().rowsBetween(1 - last, 0)
    enough = F.count(value).over(span) >= 2
    rows = rows.withColumn("roll_mean", F.when(enough, F.avg(value).over(span))).withColumn("roll_std", F.when(enough, F.greatest(F.stddev_samp(value).over(span), F.lit(1e-6))))
    return rows.withColumn("trend_score_z", (F.col(value) - F.col("roll_mean")) / F.col("roll_std"))


def lags(rows: DataFrame, value: str = "trend_score") -> DataFrame:
    """Ordinal, lags and the slope of the four rows before; the slope is null if one of them is."""
    rows = rows.withColumn("week_num", F.row_number().over(by_series()) - 1)
    span = by_series().rowsBetween(-4, -1)
    rows = rows.withColumn("trend_score_lag1", F.lag(value).over(by_series())).withColumn("trend_score_chg", F.col(value) - F.col("trend_score_lag1"))
    rows = rows.withColumn("trend_score_mom", F.when(F.count(value).over(span) == 4, F.regr_slope(F.col(value), F.col("week_num").cast("double")).over(span)))
    change = lambda c, k: F.col(c) - F.lag(c, k).over(by_series())
    return rows.withColumn("spike_norm_lag1", F.lag("spike_norm").over(by_series())).withColumn("sentiment_chg", change("sentiment_score", 1)).withColumn("share_chg_1w", change("share", 1)).withColumn("share_chg_4w", change("share", 4)).withColumn("comm_share_chg", change("comm_share", 1))


def rise_targets(rows: DataFrame, value: str = "trend_score") -> DataFrame:
    """Whether the mean of the next 2 (4) rows is above the current one; null if fewer remain, 0 if it can't be told."""
    size = F.count(F.lit(1)).over(Window.partitionBy("category"))
    for k in (2, 4):
        ahead = F.avg(value).over(by_series().rowsBetween(1, k))
        rows = rows.withColumn(f"rise_{k}w", F.when(F.col("week_num") + k < size, F.coalesce((ahead > F.col(value)).cast("int"), F.lit(0))))
    return rows


def features(rows: DataFrame, least_weeks: int = 10) -> DataFrame:
    """Rows a model takes: categories of enough weeks, from the fifth row on; categories numbered in order."""
    size = F.count(F.lit(1)).over(Window.partitionBy("category"))
    made = rise_targets(lags(rolling(trend_score(shares(rows))))).withColumn("n_weeks", size).where((F.col("n_weeks") >= least_weeks) & (F.col("week_num") >= 4))
    return made.join(F.broadcast(encoded(made)), "category")


def encoded(rows: DataFrame, column: str = "category") -> DataFrame:
    """``column, cat_encoded``: place of each distinct value in order; for dimensions."""
    return rows.select(column).distinct().withColumn("cat_encoded", F.dense_rank().over(Window.orderBy(column)) - 1)


def line_forecast(rows: DataFrame, value: str = "trend_score", last: int = 10, least: int = 6, steps: int = 4) -> DataFrame:
    """Each category's least-squares line through its last points in [0.01, 10], carried on weekly, not below 0."""
    held = rows.where(F.col(value).between(0.01, 10)).withColumn("__back", F.row_number().over(Window.partitionBy("category").orderBy(F.col("week").desc()))).where(F.col("__back") <= last)
    x = (-F.col("__back")).cast("double")
    line = held.groupBy("category").agg(F.regr_slope(F.col(value), x).alias("slope"), F.regr_intercept(F.col(value), x).alias("level"), F.max("week").alias("last_week"), F.count("*").alias("n"), F.sqrt(F.regr_syy(F.col(value), x) * (1 - F.coalesce(F.regr_r2(F.col(value), x), F.lit(1.0))) / F.count("*")).alias("spread")).where(F.col("n") >= least)
    ahead = line.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(steps))))
    clip = lambda c: F.round(F.greatest(c, F.lit(0.0)), 3)
    y = F.col("level") + F.col("slope") * (F.col("step") - 1)
    return ahead.select("category", F.date_add("last_week", F.col("step") * 7).alias("ds"), clip(y).alias("yhat"), clip(y - 1.28 * F.col("spread")).alias("yhat_lower"), clip(y + 1.28 * F.col("spread")).alias("yhat_upper"))


def with_actuals(forecast: DataFrame, rows: DataFrame, value: str = "trend_score") -> DataFrame:
    return forecast.join(rows.select("category", F.col("week").alias("ds"), F.col(value).alias("actual")), ["category", "ds"], "left")


def blended(two: DataFrame, four: DataFrame) -> DataFrame:
    """Both predictions' categories, 0.5 where one is missing, and their blend."""
    return two.join(four, "category", "outer").na.fill(0.5, ["p2", "p4"]).withColumn("rise_score", F.round(0.55 * F.col("p2") + 0.45 * F.col("p4"), 3))


def confident(told: DataFrame, high: float = 0.90, low: float = 0.10) -> DataFrame:
    """``category, horizon, direction, p`` of predictions sure enough to list."""
    rows = told.select("category", F.explode(F.array(*(F.struct(F.lit(h).alias("horizon"), F.col(c).alias("p")) for h, c in (("2w", "p2"), ("4w", "p4"))))).alias("x")).select("category", "x.*")
    return rows.withColumn("direction", F.when(F.col("p") >= high, "rising").when(F.col("p") <= low, "declining")).where("direction is not null")


def overlapping(spans: DataFrame, start: str, end: str, low: Column, high: Column) -> DataFrame:
    """Events that overlap the time shown."""
    return spans.where(~((F.col(end) < low) | (F.col(start) > high)))
