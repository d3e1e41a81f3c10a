"""Brand statistics: current against previous mentions, spread over categories, rankings, posts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .dictionary import blocks, with_places


def brand_table(facts: DataFrame, least: int = 3) -> DataFrame:
    """``category, brand`` with mentions ``is_cur`` and before, spike and mean sentiment."""
    cur = F.col("is_cur")
    rows = facts.groupBy("category", "brand").agg(F.count_if(cur).alias("cur_mentions"), F.count_if(~cur).alias("prev_mentions"), F.avg(F.when(cur, F.col("sentiment"))).alias("avg_sentiment"))
    return rows.where(F.col("cur_mentions") >= least).withColumn("brand_spike", F.round(F.col("cur_mentions") / F.greatest("prev_mentions", F.lit(1)), 2)).withColumn("avg_sentiment", F.round("avg_sentiment", 3))


def first_seen(facts: DataFrame, *columns: str, order: list[str]) -> DataFrame:
    """What the first row of each category and brand says, by a total order."""
    return facts.groupBy("category", "brand").agg(F.min_by(F.struct(*columns), F.struct(*order)).alias("seen")).select("category", "brand", "seen.*")


def spread(table: DataFrame, most: float = 0.40) -> DataFrame:
    """Brands of the table with their share of the categories that have brands, without those over ``most``."""
    categories = table.agg(F.count_distinct("category").alias("n_categories"))
    per = table.groupBy("brand").agg(F.count_distinct("category").alias("brand_categories"))
    return per.join(F.broadcast(categories)).withColumn("category_share", F.col("brand_categories") / F.greatest("n_categories", F.lit(1))).where(F.col("category_share") <= most)


def top_brands(table: DataFrame, k: int = 30) -> DataFrame:
    order = Window.partitionBy("category").orderBy(F.col("cur_mentions").desc(), F.col("brand_spike").desc(), F.col("avg_sentiment").desc_nulls_last(), "brand")
    return table.withColumn("brand_rank", F.row_number().over(order)).where(F.col("brand_rank") <= k)


def cluster_trend(facts: DataFrame, least_posts: int = 10, least_mentions: int = 2, digits: int = 4) -> DataFrame:
    """Brands of clusters with a score of spike, sentiment and reach; the cluster's category is its most frequent."""
    cur = F.col("is_cur")
    groups = facts.groupBy("cluster").agg(F.count_if(cur).alias("posts"), F.mode(F.when(cur, F.col("category")), True).alias("category")).where(F.col("posts") >= least_posts)
    rows = facts.groupBy("cluster", "brand").agg(F.count_if(cur).alias("c"), F.count_if(~cur).alias("p"), F.avg(F.when(cur, F.col("sentiment"))).alias("s"), F.count_distinct(F.when(cur, F.col("community"))).alias("communities")).where(F.col("c") >= least_mentions).join(groups, "cluster")
    whole = Window.partitionBy("cluster")
    rows = rows.withColumn("brand_spike", F.round(F.col("c") / F.greatest("p", F.lit(1)), 3)).withColumn("__top", F.percentile("brand_spike", F.lit(0.97)).over(whole))
    rows = rows.withColumn("norm_spike", F.round(F.least(F.col("brand_spike") / F.greatest(F.when(F.col("__top") == 0, 1.0).otherwise(F.col("__top")), F.lit(1.0)), F.lit(1.0)), 4))
    rows = rows.withColumn("sentiment_score", F.round((F.round("s", 3) + 1) / 2, 4)).withColumn("comm_score", F.round(F.col("communities") / F.greatest(F.max("communities").over(whole), F.lit(1)), 4))
    return rows.withColumn("brand_trend_score", F.round(0.40 * F.col("norm_spike") + 0.35 * F.col("sentiment_score") + 0.25 * F.col("comm_score"), digits)).select("cluster", "category", "brand", F.col("c").alias("cur_mentions"), F.col("p").alias("prev_mentions"), "communities", "brand_spike", "norm_spike", "sentiment_score", "comm_score", "brand_trend_score")


def brand_posts(brands: DataFrame, posts: DataFrame, k: int = 10) -> DataFrame:
    """Best posts of each category and brand: those of the category whose text or title has the brand in it.

    Names are found in one scan of the posts by an automaton; (category, name) then joins the brands, without texts.
    """
    own = brands.select("category", "brand", F.lower("brand").alias("name")).distinct()
    rows = posts.select("category", "mention_id", "engagement", F.lower(F.concat_ws("\0", "text", "title")).alias("text"))
    found = [with_places(rows, "text", block, fold=False).select("category", "mention_id", "engagement", F.explode("parts.name").alias("name")) for block in blocks(own.limit(0), own)]
    hits = reduce(DataFrame.unionByName, found).join(own, ["category", "name"]).drop("name")
    return ranked(hits, ["category", "brand"], k, F.col("engagement").desc(), F.col("mention_id"))


def ranked(rows: DataFrame, keys: list[str], k: int, *order: Column) -> DataFrame:
    """The first k rows of each key by a total order; each task keeps k before the shuffle."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= k)


def keyword_matrix(table: DataFrame) -> DataFrame:
    return table.withColumn("delta", F.col("cur_mentions") - F.col("prev_mentions")).withColumn("spike", F.round(F.col("cur_mentions") / F.when(F.col("prev_mentions") == 0, 1).otherwise(F.col("prev_mentions")), 2)).withColumn("mood", F.when(F.col("avg_sentiment") > 0, "+").when(F.col("avg_sentiment") < 0, "-").otherwise("0"))


def coverage_report(taxonomy: DataFrame, posts: DataFrame, recent_days: int = 14) -> DataFrame:
    """Every cluster with its posts, communities, score, five largest communities, recent posts and status."""
    cut = posts.agg(F.max("published_at") - F.expr(f"INTERVAL {recent_days} DAY")).first()[0]  # from the files' statistics, or one column
    recent = F.count_if(F.col("published_at") >= F.lit(cut)) if cut is not None else F.lit(0).cast("bigint")
    # One pass: a row for each cluster and community, from which all the rest is summed.
    pairs = posts.groupBy("cluster", "community").agg(F.count("*").alias("n"), recent.alias("recent"), F.sum("score").alias("total"), F.count("score").alias("scored"))
    place = F.row_number().over(Window.partitionBy("cluster").orderBy(F.col("community").isNull(), F.col("n").desc(), "community"))
    top = F.collect_list(F.when((F.col("rank") <= 5) & F.col("community").isNotNull(), F.struct("rank", "community")))
    per = pairs.withColumn("rank", place).groupBy("cluster").agg(F.sum("n").alias("mentions"), F.count("community").alias("communities"), F.try_divide(F.sum("total"), F.sum("scored")).alias("avg_score"), F.array_join(F.transform(F.sort_array(top), lambda x: x["community"]), ", ").alias("top_communities"), F.sum("recent").alias("recent_mentions"))
    rows = taxonomy.select("cluster").join(per, "cluster", "left")
    rows = rows.na.fill({"mentions": 0, "communities": 0, "recent_mentions": 0, "top_communities": ""})
    return rows.withColumn("status", F.when(F.col("mentions") >= 100, "OK").when(F.col("mentions") > 0, "thin").otherwise("missing"))
