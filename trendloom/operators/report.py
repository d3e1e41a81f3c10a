"""What reports read: trailing periods, payloads with lists, cards, top lists, lookups and formatted numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .brands import ranked, top_brands
from .records import first_by


def trailing(rows: DataFrame, days: int = 14, time: str = "published_at") -> DataFrame:
    """Rows of the last ``days`` before the latest row (``is_cur``, both ends in) and of as many before these.

    The latest time is fetched first, one value, so that the range reaches the scan as literals. No rows, none.
    """
    last = rows.agg(F.max(time)).first()[0]
    cut, low = (F.lit(last).cast(rows.schema[time].dataType) - F.expr(f"INTERVAL {n * days} DAY") for n in (1, 2))
    return rows.where(F.col(time) >= low).withColumn("is_cur", F.col(time) >= cut)


def weekly_spans(rows: DataFrame, sentiment: str = "sentiment_compound", time: str = "published_at") -> DataFrame:
    """``back, category, week, mentions, mean_sentiment`` over both periods of each window; weeks from Monday, UTC."""
    week = F.to_date(F.date_trunc("week", F.col(time)))
    return rows.groupBy("back", "category", week.alias("week")).agg(F.count("*").alias("mentions"), F.avg(sentiment).alias("mean_sentiment"))


def payload(categories: DataFrame, table: DataFrame, posts: DataFrame, key: str, fields: list[str], engagement: str = "engagement_score", most_brands: int = 20, most_posts: int = 5) -> DataFrame:
    """Categories with ``top_brands``, names by rank, and ``sample_posts``, structs by engagement; empty lists if none."""
    listed = lambda rows, by, what: rows.groupBy("category").agg(F.transform(F.sort_array(F.collect_list(F.struct(F.col(by).alias("by"), what.alias("of")))), lambda x: x["of"]).alias("listed"))
    names = listed(top_brands(table, most_brands), "brand_rank", F.col("brand")).withColumnRenamed("listed", "top_brands")
    best = listed(ranked(posts, ["category"], most_posts, F.col(engagement).desc_nulls_last(), F.col(key)), "rank", F.struct(*fields)).withColumnRenamed("listed", "sample_posts")
    rows = categories.join(names, "category", "left").join(best, "category", "left")
    return rows.withColumn("top_brands", F.coalesce("top_brands", F.array())).withColumn("sample_posts", F.coalesce("sample_posts", F.array()))


def named(assigned: DataFrame, taxonomy: DataFrame, column: str = "target_cluster_id", name: str = "target_cluster", missing: str = "unknown") -> DataFrame:
    """Each cluster id with its name from ``taxonomy`` (an id once), ``missing`` where there is none."""
    return assigned.join(taxonomy.select(column, name), column, "left").withColumn(name, F.coalesce(name, F.lit(missing)))


def value_counts(rows: DataFrame, column: str, k: int = 10) -> DataFrame:
    """The k most frequent values, nulls left out; ties by value. A top-k report."""
    return rows.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), column).limit(k)


def cardinality(rows: DataFrame, label: str = "cluster_id", noise: int = -1) -> DataFrame:
    """One row: ``points, clusters, valid, noise, noise_pct``; nulls are not labels."""
    own = F.col(label)
    told = rows.where(own.isNotNull()).agg(F.count("*").alias("points"), F.count_distinct(F.when(own != noise, own)).alias("clusters"), F.count_if(own != noise).alias("valid"), F.count_if(own == noise).alias("noise"))
    return told.withColumn("noise_pct", F.round(F.try_divide(100.0 * F.col("noise"), F.col("points")), 1))


def from_year(rows: DataFrame, year: int, created: str = "created_utc") -> DataFrame:
    """Rows from the year's first second on (UTC epoch seconds); rows without a time, null or 0, stay."""
    from datetime import UTC, datetime

    cut = int(datetime(year, 1, 1, tzinfo=UTC).timestamp())
    return rows.where(F.col(created).isNull() | (F.col(created) == 0) | (F.col(created) >= cut))


def since(rows: DataFrame, days: int, today: Column | None = None, time: str = "published_at") -> DataFrame:
    """Rows of the last ``days`` UTC dates and today."""
    return rows.where(F.col(time) >= F.date_sub(F.current_date() if today is None else today, days))


def parsed(text: Column) -> Column:
    """Time of a text, null where it is none."""
    return text.try_cast("timestamp_ntz")


def text_column(rows: DataFrame, wanted: str, fallback: str = "full_text") -> Column:
    """``wanted`` if the table has it, else ``fallback``; null as empty."""
    return F.coalesce(F.col(wanted if wanted in rows.columns else fallback).cast("string"), F.lit(""))


def signed(n: Column) -> Column:
    """A whole number with thousands separated and a plus before positive ones."""
    return F.concat(F.when(n > 0, "+").otherwise(""), F.format_number(n, 0))


def decimals(x: Column, digits: int, plus: bool = False) -> Column:
    """A number with fixed digits, half up in decimal; with a plus from 0 on if asked."""
    told = F.round(x.cast("decimal(28,8)"), digits).cast("string")
    return F.concat(F.when(x >= 0, "+").otherwise(""), told) if plus else told


def cards(board: DataFrame, sentiment: str = "sentiment_c") -> DataFrame:
    """The card of each category: score, spike, mood, momentum, communities, as they are shown."""
    s = F.col(sentiment)
    mood = F.when(s >= 0.05, "positive").when(s >= -0.05, "neutral").otherwise("negative")
    return board.select("back", "category", decimals(F.col("trend_score"), 2).alias("score"), F.concat(decimals(F.col("spike_ratio"), 1), F.lit("x")).alias("spike"), F.format_number("mentions_c", 0).alias("posts"), decimals(s, 2, plus=True).alias("sentiment"), mood.alias("mood"), F.concat(decimals(F.col("eng_momentum"), 1), F.lit("x")).alias("momentum"), F.col("communities_c").alias("communities"))


def kpi(board: DataFrame, direction: str = "view_direction", other: str = "Other") -> DataFrame:
    """Categories, mentions, and number and share of each direction, by window."""
    of = lambda d: F.count_if(F.col(direction) == d)
    share = lambda d: F.round(100.0 * of(d) / F.greatest(F.count("*"), F.lit(1)), 1).alias(f"{d}_pct")
    ways = ("rising", "stable", "declining")
    return board.where(F.col("category") != other).groupBy("back").agg(F.count("*").alias("categories"), F.sum("mentions_c").alias("mentions"), *(of(d).alias(d) for d in ways), *(share(d) for d in ways))


def top_board(board: DataFrame, directions: list[str], n: int = 25, direction: str = "view_direction", other: str = "Other") -> DataFrame:
    """The first n categories of the directions in each window, by score."""
    rows = board.where((F.col("category") != other) & F.col(direction).isin(directions))
    return ranked(rows, ["back"], n, F.col("trend_score").desc(), F.col("category"))


def spike_radar(board: DataFrame, table: DataFrame, n: int = 8, keywords: int = 10, direction: str = "view_direction") -> DataFrame:
    """The n rising categories of the largest spike of each window, with the first brands of their table."""
    rising = ranked(board.where(F.col(direction) == "rising"), ["back"], n, F.col("spike_ratio").desc(), F.col("category"))
    names = top_brands(table, keywords).groupBy("category").agg(F.transform(F.sort_array(F.collect_list(F.struct("brand_rank", "brand"))), lambda x: x["brand"]).alias("keywords"))
    return rising.join(names, "category", "left").withColumn("keywords", F.coalesce("keywords", F.array()))


def static_report(board: DataFrame, table: DataFrame, sample: str, direction: str = "trend_direction") -> DataFrame:
    """``section, place, name, value, direction`` of a window's report: four top lists.

    ``score`` has 25 categories by score, ``spike`` six by normalised spike, ``table`` twenty; ``delta`` has the first 15
    brands of the category ``sample``, by change. The direction is the one made with the board.
    """
    part = lambda rows, section, value, way: rows.select(F.lit(section).alias("section"), F.col("rank").cast("bigint").alias("place"), F.col("name"), F.col(value).cast("double").alias("value"), way.alias("direction"))
    rows = board.withColumn("name", F.col("category")).withColumn("one", F.lit(1))
    best = lambda n, by: ranked(rows, ["one"], n, F.col(by).desc(), F.col("category"))
    shown = top_brands(table.where(F.col("category") == sample), 15).withColumn("delta", F.col("cur_mentions") - F.col("prev_mentions")).withColumn("name", F.col("brand"))
    by_delta = ranked(shown, ["category"], 15, F.col("delta").desc(), F.col("brand"))
    sign = F.when(F.col("delta") > 0, "rising").otherwise("declining")
    parts = [part(best(25, "trend_score"), "score", "trend_score", F.col(direction)), part(best(6, "normalized_spike"), "spike", "normalized_spike", F.col(direction)), part(by_delta, "delta", "delta", sign), part(best(20, "trend_score"), "table", "mentions_c", F.col(direction))]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def hot_posts(index: DataFrame, n: int, keyword: str | None = None, key: str = "mention_id", url: str = "url", engagement: str = "engagement_score") -> DataFrame:
    """The n most engaging posts of each category: those of one keyword, or of all keywords with each address once."""
    rows = index.where(F.col("brand") == keyword) if keyword is not None else first_by(index, ["category", url], F.col("brand"), F.col(key))
    return ranked(rows, ["category"], n, F.col(engagement).desc_nulls_last(), F.col(key))


def with_events(forecast: DataFrame, told: DataFrame, events: list[tuple[str, str, str]]) -> DataFrame:
    """Forecasts of categories in ``told``, with the labels of the listed events (first day, last day, label) in their span."""
    from datetime import date

    kept = forecast.join(told.select("category").distinct(), "category", "left_semi")
    span = kept.groupBy("category").agg(F.min("ds").alias("__low"), F.max("ds").alias("__high"))
    every = F.array(*(F.struct(F.lit(date.fromisoformat(a)).alias("a"), F.lit(date.fromisoformat(b)).alias("b"), F.lit(label).alias("label")) for a, b, label in events)) if events else F.array().cast("array<struct<a:date,b:date,label:string>>")
    shown = F.transform(F.filter(every, lambda e: (e["b"] >= F.col("__low")) & (e["a"] <= F.col("__high"))), lambda e: e["label"])
    return kept.join(span.select("category", shown.alias("events")), "category")


def merged_labels(latest: Column, existing: Column, made: Column) -> Column:
    """Window labels without repeats: the latest, those known before, then the rest, as far as they have been made."""
    return F.filter(F.array_distinct(F.concat(F.array(latest), existing, made)), lambda x: F.array_contains(made, x) | F.array_contains(existing, x))
