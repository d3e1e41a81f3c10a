"""Report operators, dictionary layers, stages and the command line on small tables."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from trendloom import sources
from trendloom.operators import extraction, records, report, vectors


def values(rows, *names):
    return sorted(tuple(r[n] for n in names) for r in rows.collect())


def test_trailing_period(spark):
    rows = spark.createDataFrame([(d,) for d in ("2024-01-29", "2024-01-15", "2024-01-14", "2024-01-01", "2023-12-31")], "d string").select(F.col("d").cast("timestamp_ntz").alias("published_at"), "d")
    assert values(report.trailing(rows), "d", "is_cur") == [("2024-01-01", False), ("2024-01-14", False), ("2024-01-15", True), ("2024-01-29", True)]
    assert report.trailing(rows.limit(0)).count() == 0


def test_since_and_year(spark):
    rows = spark.createDataFrame([(1, None), (2, 0), (3, 1704067199), (4, 1704067200)], "id int, created_utc long")
    assert values(report.from_year(rows, 2024), "id") == [(1,), (2,), (4,)]
    days = spark.sql("SELECT * FROM VALUES (date'2024-01-01'), (date'2024-01-02') AS t(published_at)")
    assert values(report.since(days, 3, F.lit("2024-01-05").cast("date")), "published_at") == [(dt.date(2024, 1, 2),)]


def test_text_column_and_category(spark):
    rows = spark.createDataFrame([("a", None), (None, "b")], "title string, full_text string")
    assert values(rows.select(report.text_column(rows, "title").alias("v")), "v") == [("",), ("a",)]
    assert values(rows.select(report.text_column(rows, "none").alias("v")), "v") == [("",), ("b",)]
    assert values(records.with_category(rows), "category") == [("unknown",), ("unknown",)]
    named = spark.createDataFrame([("Shoes",), ("Unassigned",), (None,)], "target_cluster string")
    assert values(records.with_category(named), "category") == [("Other",), ("Other",), ("Shoes",)]


def test_formatted(spark):
    row = spark.range(1).select(report.signed(F.lit(1234)).alias("a"), report.signed(F.lit(-1234)).alias("b"), report.signed(F.lit(0)).alias("c"), report.decimals(F.lit(0.25), 1).alias("d"), report.decimals(F.lit(0.0), 2, plus=True).alias("e")).first()
    assert tuple(row) == ("+1,234", "-1,234", "0", "0.3", "+0.00")


def test_payload_and_names(spark):
    cats = spark.createDataFrame([("x",), ("y",)], "category string")
    table = spark.createDataFrame([("x", "b1", 3, 1.0, 0.1), ("x", "b2", 5, 1.0, None)], "category string, brand string, cur_mentions int, brand_spike double, avg_sentiment double")
    posts = spark.createDataFrame([("x", 1, None), ("x", 2, 4.0), ("x", 3, 4.0)], "category string, id int, engagement_score double")
    got = {r["category"]: r for r in report.payload(cats, table, posts, "id", ["id"], most_posts=2).collect()}
    assert got["x"]["top_brands"] == ["b2", "b1"] and [p["id"] for p in got["x"]["sample_posts"]] == [2, 3]
    assert got["y"]["top_brands"] == [] and got["y"]["sample_posts"] == []
    ids = spark.createDataFrame([("C1",), ("C2",), (None,)], "target_cluster_id string")
    names = spark.createDataFrame([("C1", "Shoes")], "target_cluster_id string, target_cluster string")
    assert sorted(r["target_cluster"] for r in report.named(ids, names).collect()) == ["Shoes", "unknown", "unknown"]


def test_cardinality_of_nothing(spark):
    row = report.cardinality(spark.createDataFrame([], "cluster_id int")).first()
    assert (row["points"], row["clusters"], row["noise_pct"]) == (0, 0, None)


def test_overlay(spark):
    rows = spark.sql("SELECT * FROM VALUES ('a', date'2024-01-08'), ('a', date'2024-01-15'), ('b', date'2024-01-08') AS t(category, ds)")
    told = spark.createDataFrame([("a",), ("a",)], "category string")
    got = report.with_events(rows, told, [("2024-01-15", "2024-02-01", "edge"), ("2024-01-01", "2024-01-07", "before")])
    assert values(got.withColumn("e", F.array_join("events", ",")), "category", "e") == [("a", "edge"), ("a", "edge")]


def test_merged_labels(spark):
    made = F.array(*map(F.lit, ("w1", "w2", "w3")))
    row = spark.range(1).select(report.merged_labels(F.lit("w1"), F.array(F.lit("w2"), F.lit("w1"), F.lit("w0")), made).alias("v")).first()
    assert row["v"] == ["w1", "w2", "w0", "w3"]


def test_lines_and_known(spark):
    posts = spark.createDataFrame([(1, "my ps4 and PS5"), (2, "on the ps5 sale"), (3, "the ring is new"), (4, "bought a ring"), (5, None)], "id int, text string")
    assert values(extraction.line_hits(posts, "id", "text"), "id", "brand", "line") == [(1, "Sony", "ps5")]
    assert values(extraction.known_hits(posts, "id", "text", {"ring": 1e-4, "new": 1e-6}), "id", "brand") == [(3, "New"), (4, "Ring")]


def test_whitelist_rules(spark):
    raw = spark.createDataFrame([("The Of", 1), ("Camp", 2), ("Ring", 3), ("Blue River", 4), ("blue-river", 0), ("Oil", 5), ("A", 6)], "display string, pos int")
    freq = spark.createDataFrame([("camp", 1e-3), ("ring", 1e-3), ("blue river", 1.0)], "word string, freq double")
    got = extraction.whitelist(raw, ["the", "of"], ["ring"], freq, products=["oil"])
    assert values(got, "norm", "display") == [("blue river", "blue-river"), ("ring", "Ring")]


def test_votes_leave_the_query_out(spark):
    bank = spark.createDataFrame([(1, [1.0, 0.0], 7), (2, [1.0, 0.0], 3), (3, [0.0, 1.0], 7)], "vec_id long, embedding array<double>, label int")
    assert values(vectors.knn_vote(bank.where("vec_id = 1"), bank, k=1), "vec_id", "label") == [(1, 3)]
    assert vectors.knn_vote(bank.where("vec_id = 1"), bank.where("vec_id = 1")).count() == 0


def test_stage_and_resume(spark, tmp_path):
    calls, rows = [], spark.range(100).withColumnRenamed("id", "key")

    def make(part):
        calls.append(1)
        return part.withColumn("twice", F.col("key") * 2)

    for _ in range(2):
        assert sources.stage(spark, f"file://{tmp_path}/one", lambda: make(rows)).count() == 100
    assert len(calls) == 1
    got = sources.resumed(spark, rows, f"file://{tmp_path}/many", "key", make, steps=3)
    assert sorted(r["twice"] for r in got.collect()) == [2 * i for i in range(100)] and len(calls) == 4
    (tmp_path / "many" / "step=00001" / "_SUCCESS").unlink()
    again = sources.resumed(spark, rows, f"file://{tmp_path}/many", "key", make, steps=3)
    assert again.count() == 100 and len(calls) == 5


def test_append_csv_and_latest_only(spark, tmp_path):
    part = spark.createDataFrame([("w1", 'a "q"')], "window_label string, v string")
    for _ in range(2):
        sources.append_csv(part, f"file://{tmp_path}/csv")
    assert spark.read.option("header", True).option("escape", '"').csv(f"file://{tmp_path}/csv").collect() == part.union(part).collect()
    whole = spark.createDataFrame([("w1", "old"), ("w2", "old")], "window_label string, v string")
    sources.write_stage(whole, f"file://{tmp_path}/t", "window_label")
    sources.write_stage(part, f"file://{tmp_path}/t", "window_label")
    assert values(spark.read.parquet(f"file://{tmp_path}/t"), "window_label", "v") == [("w1", 'a "q"'), ("w2", "old")]


def test_command_line(spark, tmp_path):
    from trendloom.__main__ import main

    main(["cluster_cardinality", "--data", "/root/testdata/sf0.001", "--out", f"file://{tmp_path}/out"])
    assert spark.read.parquet(f"file://{tmp_path}/out").count() == 1
    with pytest.raises(SystemExit):
        main(["no_such_query", "--data", "x"])
