from datetime import datetime

import pytest
from pyspark.sql import functions as F

from trendloom import sources
from trendloom.functions import text as T
from trendloom.operators import brands, extraction, records, vectors, weekly, windows

BRANDS = {"acme": "Acme", "blue river": "Blue River", "zorbo": "Zorbo"}


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def test_text_columns(spark):
    assert one(spark, T.plain(F.lit("H&M's  Best-Of! 2x"))) == "h m s best of 2x"
    assert one(spark, T.contextual(F.lit("H&M's Best-Of!"))) == "handm's best of"
    assert one(spark, T.folded(F.lit("Ｃafé’s"))) == "Cafe's"
    assert one(spark, T.ngrams(F.array(*map(F.lit, "abc")), 3)) == ["a", "b", "c", "a b", "b c", "a b c"]
    assert one(spark, T.ngrams(F.array(F.lit("a")), 4)) == ["a"]
    assert one(spark, T.sentences(F.lit("One. Two! three; four"))) == ["One.", "Two!", "three", "four"]
    assert one(spark, T.without_article(F.lit("The Shoe"))) == "Shoe"
    assert one(spark, T.variants(F.lit("shoes"))) == ["shoes", "shoe"]
    assert one(spark, T.first_words(F.lit("a b c d e f g"))) == "a b c d"
    assert one(spark, T.near_tokens(T.tokens(F.lit("a b c d e")), F.lit("c"), 1)) == ["b", "c", "d"]
    assert one(spark, T.cluster_queries(F.lit("n"), F.lit("a|b|c"), F.lit("k|a"))) == ["n", "a", "b", "k"]
    assert one(spark, T.stable_id(F.lit("a"), F.lit(None), digits=8)) == one(spark, F.substring(F.sha2(F.lit("a||"), 256), 1, 8))


def test_clean_and_alignment(spark):
    rows = spark.createDataFrame([("1", "t", "x" * 500, 2), ("1", "old", "y", 1), ("2", None, None, 1), ("3", "", "[deleted]", 1)], "id string, title string, text string, seq int")
    got = {r["id"]: r["ner_input"] for r in records.cleaned(rows, "id", "title", "text", F.col("seq"), least=3).collect()}
    assert got == {"1": "old. y", "3": ". [deleted]"}
    schema = rows.select("id", "seq").withColumn("more", F.lit(1.0)).schema
    assert records.aligned(rows, schema, "id").columns == ["id", "seq", "more"]
    raw = spark.createDataFrame([(1, 5, None, 0, "[removed]")], "id int, score int, num_comments int, created_utc long, selftext string")
    r = records.normalised(raw).first()
    assert (r["text"], r["engagement_score"]) == ("", 5.0)


def test_direction_rules(spark):
    rows = spark.createDataFrame([(100, 50, 50, 2.0, 5, 0.0, 1.0), (20, 60, -40, 0.3, 5, 0.0, 1.0), (60, 55, 5, 1.1, 5, 60.0, 1.3), (60, 55, 5, 1.1, 5, -60.0, 0.5)], "mentions_c long, mentions_p long, mentions_delta long, spike_ratio double, communities_c long, normalized_delta double, share_spike double")
    got = rows.select(windows.direction(F.lit(False)).alias("full"), windows.direction(F.lit(True)).alias("low"), windows.view_direction(F.col("mentions_c"), F.col("mentions_p")).alias("view")).collect()
    assert [r["full"] for r in got] == ["rising", "declining", "stable", "stable"]
    assert [r["low"] for r in got] == ["stable", "stable", "rising", "declining"]
    assert [r["view"] for r in got] == ["rising", "declining", "stable", "stable"]


def test_windows_follow_local_calendar(spark):
    rows = spark.createDataFrame([(datetime(2024, 3, 13, 6),)], "published_at timestamp_ntz")
    got = windows.week_windows(rows, weeks=2).orderBy("back").collect()
    assert [str(r["cur_start"]) for r in got] == ["2024-03-10", "2024-03-03"]  # over a clock change
    assert got[0]["window_label"] == "03/10–03/16"


def test_average_rank_and_nulls(spark):
    rows = spark.createDataFrame([(c, f"2024-01-{d:02d}", m) for c, d, m in [("a", 1, 10), ("a", 8, 20), ("b", 1, 10), ("b", 8, 20), ("c", 8, 5)]], "category string, week string, mentions long").withColumn("communities", F.lit(1))
    got = {(r["category"], r["week"]): r["spike_norm"] for r in weekly.spike_rank(weekly.shares(rows)).collect()}
    assert got[("a", "2024-01-08")] == got[("b", "2024-01-08")] == 0.75
    assert got[("c", "2024-01-08")] is None and got[("a", "2024-01-01")] is None


def test_slope_needs_four_rows(spark):
    rows = spark.createDataFrame([("a", i, None if i == 0 else float(i)) for i in range(7)], "category string, week int, trend_score double")
    for c in ("spike_norm", "sentiment_score", "share", "comm_share"):
        rows = rows.withColumn(c, F.lit(0.0))
    got = [r["trend_score_mom"] for r in weekly.lags(rows).orderBy("week").collect()]
    assert got[:5] == [None] * 5 and got[5] == pytest.approx(1.0)


def test_vectors(spark):
    tax = spark.createDataFrame([("C001", [1.0, 0.0]), ("C002", [0.0, 1.0])], "target_cluster_id string, embedding array<double>")
    vec = spark.createDataFrame([(1, [1.0, 0.1]), (2, [-1.0, -1.0]), (3, None)], "vec_id long, embedding array<double>")
    got = {r["vec_id"]: r["target_cluster_id"] for r in vectors.nearest_taxonomy(vec, tax).collect()}
    assert got == {1: "C001", 2: "C000"}
    bank = spark.createDataFrame([(10, [1.0, 0.0], 7), (11, [0.9, 0.1], -1), (12, [0.0, 1.0], 3), (13, [0.1, 1.0], 3)], "vec_id long, embedding array<double>, label int")
    assert {r["vec_id"]: r["label"] for r in vectors.knn_vote(vec.where("vec_id = 1"), bank, k=2, block=2).collect()} == {1: 7}
    rules = spark.createDataFrame([("C001", None), ("C002", "banana")], "target_cluster_id string, negative_keywords string")
    posts = spark.createDataFrame([(1, "C001", 0.9, "nan banana"), (2, "C002", 0.9, "a BANANA")], "id int, target_cluster_id string, target_cluster_score double, text string")
    assert {r["id"]: r["target_cluster_id"] for r in vectors.vetoed(posts, rules, "id").collect()} == {1: "C001", 2: "C000"}


@pytest.mark.parametrize(
    "sentence, shown",
    [("I bought a Zorbo last week.", {"Zorbo"}), ("We switched from Acme to Blue River because of the price.", {"Acme", "Blue River"}), ("Acme vs Zorbo, which one is better?", {"Acme", "Zorbo"}), ("i bought some shoes yesterday.", set()), ("The weather is nice today.", set())],
)
def test_sentence_brands(spark, sentence, shown):
    lexicon = extraction.Lexicon(BRANDS, frozenset({"shoes", "shoe"}))
    posts = spark.createDataFrame([(1, sentence)], "id long, text string")
    got = extraction.sentence_brands(posts, "id", "text", lexicon).where("decision = 'display_brand'").collect()
    assert {r["brand"] for r in got} == shown


def test_longest(spark):
    assert set(one(spark, extraction.longest(F.array(*map(F.lit, ["on", "onkyo", "blue river", "river", "acme"]))))) == {"onkyo", "blue river", "acme"}


def test_sources(spark, tmp_path):
    rows = spark.createDataFrame([("1", "a \"quoted\"\nline")], "mention_id string, text string")
    full = rows.select(*(F.col(f.split(" ")[0]) if f.split(" ")[0] in rows.columns else F.lit(None).cast(f.split(" ")[1]).alias(f.split(" ")[0]) for f in sources.MENTIONS.split(", ")))
    sources.write_csv(full, f"file://{tmp_path}/m")
    assert sources.read_mentions(spark, f"file://{tmp_path}/m", ["mention_id", "text"]).first()["text"] == 'a "quoted"\nline'
    sources.write_stage(rows, f"file://{tmp_path}/p")
    assert sources.manifest(spark, [f"file://{tmp_path}/p"]).count() >= 1
    with pytest.raises(FileNotFoundError):
        sources.manifest(spark, [f"file://{tmp_path}/p"], required=["gone.parquet"])
    assert sources.flat_cells(spark.createDataFrame([("a", " "), ("nan", "b")], "x string, y string")).count() == 2
    (tmp_path / "f.xml").write_text("<feed><entry><title>t</title></entry></feed>")
    assert sources.read_feed(spark, f"file://{tmp_path}/f.xml", "entry", "title string").first()["title"] == "t"


def test_brand_ranking_has_a_total_order(spark):
    rows = spark.createDataFrame([("c", b, True, 0.5) for b in "bbbaaacc"], "category string, brand string, is_cur boolean, sentiment double")
    got = brands.top_brands(brands.brand_table(rows)).orderBy("brand_rank").collect()
    assert [r["brand"] for r in got] == ["a", "b"]


def test_extraction_rules():
    """Slots, weights and decisions of single sentences, by hand."""
    lexicon = extraction.Lexicon({"acme": "Acme", "blue river": "Blue River", "desk": "Desk"}, frozenset({"desk", "hair dryer"}))
    one = lambda sentence, labels: {r[0]: r[1:] for r in extraction.extract_sentence(sentence, labels, lexicon)}
    assert extraction.slots_of("I switched from Acme to the Blue River because it broke") == {"Acme": "comparison", "Blue River": "comparison"}
    # 0.30 for the purchase, 0.10 for a second place, 0.60 for the name: at most 1.
    assert one("I bought an Acme hair dryer", ["purchase"])["Acme"] == ("display_brand", 1.0, ["exact_whitelist", "multi_context", "purchase"])
    # A category word is a brand only in a relation.
    assert one("My Desk is here", ["ownership"]) == {}
    assert one("I bought a Desk", ["purchase"])["Desk"][0] == "display_brand"
    # An unknown name near a category term: 0.30 and 0.35; without it 0.30 is too little.
    near = one("I bought the Zorbo hair dryer", ["purchase"])["Zorbo"]
    assert near[0] == "display_brand" and "near_cat" in near[2] and near[1] == 0.75
    assert one("I bought the Zorbo", ["purchase"]) == {}
    assert extraction.weighed(["purchase", "purchase", "exact_category"]) == 0.0


def test_streams_survive_a_replay(spark, tmp_path):
    """A batch that runs again replaces what it had written."""
    from trendloom.streaming import collected, first_only

    source, out = tmp_path / "in", f"file://{tmp_path}/out"
    rows = [(str(i % 7), f"2024-01-0{1 + i % 3} 00:00:00") for i in range(30)]
    spark.createDataFrame(rows, "k string, t string").selectExpr("k", "cast(t AS timestamp) AS published_at").write.parquet(f"file://{source}")
    stream = lambda: spark.readStream.schema("k string, published_at timestamp").parquet(f"file://{source}")
    first = collected(first_only(stream(), "k"), f"file://{tmp_path}/state", out)
    assert sorted(r["k"] for r in first.collect()) == [str(i) for i in range(7)]
    again = collected(first_only(stream(), "k"), f"file://{tmp_path}/other_state", out)  # the state is lost, the batch comes again
    assert again.count() == 7


def test_spread_counts_a_post_once(spark):
    posts = spark.createDataFrame([(1, "a b a", "x"), (2, "a", "y"), (3, "a c", "x"), (4, None, "x"), (5, "c", None)], "k long, text string, community string")
    got = {r["token"]: (r["posts"], r["communities"]) for r in extraction.candidate_spread(posts, "k", "text", "community").collect()}
    assert got == {"a": (3, 2), "b": (1, 1), "c": (2, 1)}


def test_unit_is_linear_in_the_width(spark):
    import time

    from trendloom.functions.numbers import unit

    wide = spark.range(100, numPartitions=4).select(F.transform(F.sequence(F.lit(1), F.lit(4000)), lambda x: (x + F.col("id")).cast("double")).alias("v"))
    began = time.perf_counter()
    told = wide.select(unit(F.col("v")).alias("u")).agg(F.max(F.abs(F.aggregate("u", F.lit(0.0), lambda s, x: s + x * x) - 1))).first()[0]
    assert told < 1e-9 and time.perf_counter() - began < 10  # with the norm in the lambda, 16 million products a row


def test_folded_keeps_nulls_and_batches_are_cut(spark):
    import pyarrow as pa

    from trendloom.operators.dictionary import SLICE, sliced

    rows = spark.createDataFrame([(0, "Café"), (1, None), (2, "")], "k long, t string").select("k", T.folded(F.col("t")).alias("f"))
    assert sorted(rows.collect()) == [(0, "Cafe"), (1, None), (2, "")]
    batch = pa.RecordBatch.from_pydict({"k": list(range(2 * SLICE + 1))})
    assert [b.num_rows for b in sliced(iter([batch]))] == [SLICE, SLICE, 1]
