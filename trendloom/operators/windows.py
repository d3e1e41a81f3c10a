"""Trend windows: current against previous weeks, by category."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import ratio


def week_windows(mentions: DataFrame, time: str = "published_at", tz: str = "America/Los_Angeles", weeks: int = 4) -> DataFrame:
    """``back, cur_start, prev_start, cur_end`` in local time: weeks from Sunday, the one of the latest row first.

    Calendar days are counted, so a week over a clock change has seven of them.
    """
    local = F.convert_timezone(F.lit("UTC"), F.lit(tz), F.max(F.col(time).cast("timestamp_ntz")))
    latest = mentions.agg(F.to_date(local)).first()[0]  # one value, so that windows are literals
    last = mentions.sparkSession.range(1).select(F.lit(latest).cast("date").alias("day")).select(F.date_sub("day", F.dayofweek("day") - 1).alias("sunday"))
    rows = last.select("sunday", F.explode(F.sequence(F.lit(0), F.lit(weeks - 1))).alias("back"))
    start = F.date_sub("sunday", F.col("back") * 7)
    return rows.select("back", start.alias("cur_start"), F.date_sub(start, 7).alias("prev_start"), F.date_add(start, 7).alias("cur_end"), F.concat(F.date_format(start, "MM/dd"), F.lit("–"), F.date_format(F.date_add(start, 6), "MM/dd")).alias("window_label"))


def in_windows(mentions: DataFrame, windows: DataFrame, time: str = "published_at", tz: str = "America/Los_Angeles") -> DataFrame:
    """Each row with each window it is in (two at most), ``is_cur`` and its local day. ``windows`` has a row a week.

    Their range with a day on both sides, more than any zone shifts, goes to the scan as literals.
    """
    utc = F.col(time).cast("timestamp_ntz")
    low, high = windows.agg(F.date_sub(F.min("prev_start"), 1), F.date_add(F.max("cur_end"), 1)).first()
    held = mentions.where((utc >= F.lit(low).cast("timestamp_ntz")) & (utc < F.lit(high).cast("timestamp_ntz")))
    rows = held.withColumn("local_day", F.to_date(F.convert_timezone(F.lit("UTC"), F.lit(tz), utc)))
    return rows.join(F.broadcast(windows), (F.col("local_day") >= F.col("prev_start")) & (F.col("local_day") < F.col("cur_end"))).withColumn("is_cur", F.col("local_day") >= F.col("cur_start"))


def period_stats(rows: DataFrame, keys: list[str], community: str = "community", sentiment: str = "sentiment_compound", engagement: str = "engagement_score") -> DataFrame:
    """Mentions, communities, mean sentiment and engagement, current (``_c``) and previous (``_p``), in one pass."""
    cur = F.col("is_cur")
    both = []
    for name, held in (("c", cur), ("p", ~cur)):
        both += [F.count_if(held).alias(f"mentions_{name}"), F.count_distinct(F.when(held, F.col(community))).alias(f"communities_{name}"), F.coalesce(F.avg(F.when(held, F.col(sentiment))), F.lit(0.0)).alias(f"sentiment_{name}"), F.coalesce(F.avg(F.when(held, F.col(engagement))), F.lit(0.0)).alias(f"engagement_{name}")]
    return rows.groupBy(*keys).agg(*both)


def coverage(rows: DataFrame) -> DataFrame:
    """``back, rows_cur, rows_prev, days_cur, days_prev, coverage_ratio, data_quality_flag``."""
    cur = F.col("is_cur")
    day = lambda held: F.count_distinct(F.when(held, F.col("local_day")))
    stats = rows.groupBy("back").agg(F.count_if(cur).alias("rows_cur"), F.count_if(~cur).alias("rows_prev"), day(cur).alias("days_cur"), day(~cur).alias("days_prev"))
    share = F.col("rows_cur") / F.greatest(F.col("rows_prev"), F.lit(1))
    return stats.withColumn("coverage_ratio", F.round(share, 4)).withColumn("data_quality_flag", F.when((share < 0.75) | (F.col("days_cur") < 6), "partial_week").otherwise("complete_week"))


def scored(stats: DataFrame, digits: int = 4) -> DataFrame:
    """Trend board columns of ``period_stats`` with ``back``; normalisers are over each window's categories."""
    whole = Window.partitionBy("back")
    top = lambda c: F.percentile(c, F.lit(0.97)).over(whole)
    one = stats.withColumn("spike_ratio", F.round(ratio(F.col("mentions_c"), F.col("mentions_p")), 3))
    one = one.withColumn("max_spike", top("spike_ratio")).withColumn("median_engagement", F.median("engagement_c").over(whole))
    base = F.when(F.col("engagement_p") == 0, F.col("median_engagement")).otherwise(F.col("engagement_p"))
    momentum = F.when(base == 0, F.when(F.col("engagement_c") == 0, 1.0).otherwise(4.0)).otherwise(F.least(F.try_divide("engagement_c", base), F.lit(4.0)))
    one = (
        one.withColumn("normalized_spike", F.round(F.least("spike_ratio", "max_spike") / F.greatest("max_spike", F.lit(1.0)), 4))
        .withColumn("cross_community", F.round(F.col("communities_c") / F.greatest(F.max("communities_c").over(whole), F.lit(1)), 4))
        .withColumn("sentiment_score", F.round((F.col("sentiment_c") + 1) / 2, 4))
        .withColumn("eng_momentum", F.round(F.coalesce(momentum, F.lit(1.0)), 4))
    )
    one = one.withColumn("eng_momentum_norm", F.round(F.col("eng_momentum") / F.greatest(top("eng_momentum"), F.lit(1.0)), 4))
    return one.withColumn("trend_score", F.round(0.25 * (F.col("normalized_spike") + F.col("cross_community") + F.col("sentiment_score") + F.col("eng_momentum_norm")), digits)).withColumn("mentions_delta", F.col("mentions_c") - F.col("mentions_p"))


def share_adjusted(stats: DataFrame) -> DataFrame:
    """Shares of the window's mentions, and the change that coverage doesn't explain."""
    whole = Window.partitionBy("back")
    total = lambda c: F.greatest(F.sum(c).over(whole), F.lit(1))
    rows = stats.withColumn("prev_total", total("mentions_p")).withColumn("current_share", F.round(F.col("mentions_c") / total("mentions_c"), 6)).withColumn("previous_share", F.round(F.col("mentions_p") / F.col("prev_total"), 6))
    rows = rows.withColumn("share_spike", F.round(F.col("current_share") / F.when(F.col("previous_share") == 0, 1 / F.col("prev_total")).otherwise(F.col("previous_share")), 3))
    rows = rows.withColumn("coverage_adjusted_mentions", F.round(F.col("current_share") * F.col("prev_total"), 1))
    return rows.withColumn("normalized_delta", F.round(F.col("coverage_adjusted_mentions") - F.col("mentions_p"), 1))


def direction(partial: Column) -> Column:
    """Build-time direction, by counts in complete weeks and by shares in partial ones."""
    c, p, d = F.col("mentions_c"), F.col("mentions_p"), F.col("mentions_delta")
    full = F.when((c >= 50) & (d >= 50) & (F.col("spike_ratio") >= 1.6) & (F.col("communities_c") >= 3), "rising").when((p >= 50) & (d <= -25) & (F.col("spike_ratio") <= 0.8), "declining").otherwise("stable")
    low = F.when((c >= 20) & (F.col("normalized_delta") >= 50) & (F.col("share_spike") >= 1.25) & (F.col("communities_c") >= 3), "rising").when((p >= 50) & (F.col("normalized_delta") <= -50) & (F.col("share_spike") <= 0.75), "declining").otherwise("stable")
    return F.when(partial, low).otherwise(full)


def view_direction(current: Column, previous: Column) -> Column:
    """View-time direction with smoothing."""
    delta, rel = current - previous, (current - previous) / (previous + 5)
    return F.when((current >= 20) & (delta >= 8) & (rel >= 0.12), "rising").when((previous >= 20) & (delta <= -30) & (rel <= -0.25), "declining").otherwise("stable")


def trend_board(mentions: DataFrame, tz: str = "America/Los_Angeles", weeks: int = 4, digits: int = 4) -> DataFrame:
    """The board of each window, all categories in it: one scan of mentions and one shuffle by category."""
    windows = week_windows(mentions, tz=tz, weeks=weeks)
    rows = in_windows(mentions, windows, tz=tz)
    stats = period_stats(rows, ["back", "category"])
    every = mentions.select("category").distinct().join(F.broadcast(windows.select("back", "window_label")))
    full = every.join(stats, ["back", "category"], "left").na.fill(0)
    board = share_adjusted(scored(full, digits)).join(F.broadcast(coverage(rows)), "back")
    return board.withColumn("trend_direction", direction(F.col("data_quality_flag") == "partial_week"))
