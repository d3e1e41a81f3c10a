"""Benchmark decontamination: windows of benchmark words found in documents.

A window is ten consecutive normalised words of a benchmark item; an item with fewer words, but not none, is one window.
Every window of every document is hashed inside its row, and the hashes meet the benchmark's in a broadcast hash join; a
hit counts only if the words themselves are equal. Only hits, and one row for each document, leave the scan: they shuffle
by document. Everything is a built-in expression; no Python runs beside the data.

Broadcast windows are bounded: beyond ``Contamination.block`` of them, the benchmark's windows are dealt into blocks by hash
and each block takes its own scan of the documents, so a block is of a known size and no window is left out. Items with equal
words share a class, and sets of classes are resolved to item ids once for each different set, not for each document.

Defined results: null and empty texts have no words, are not contaminated and have an empty list of items; a row is returned
for every row of ``docs``, so repeated rows each have theirs; rows with one id and different texts are judged apart; items
with a null id count as items and are not in the list of ids; repeated items count once for each different id; null and
empty items have no windows, and with no windows at all nothing is contaminated; texts are read whole at any length; an
empty table gives an empty one; columns other than ids and texts are not read.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, unclashed

#: ASCII letters, digits and everything beyond ASCII.
ITEM_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The same words before A-Z are lowered, each with the signs before it.
PIECE = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


@dataclass(frozen=True)
class Contamination:
    words: int = 10  #: of a window
    block: int = 1_000_000  #: windows that are broadcast at once, about 150 MB


def lowered(text: Column) -> Column:
    """A-Z in lower case, nothing else changed; the quick way serves texts in ASCII."""
    text = F.coalesce(text, F.lit(""))
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, CAPITALS, CAPITALS.lower()))


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(lowered(text), F.lit(ITEM_WORD), 0)


def hashes(words: Column, length: int) -> Column:
    """Of every window of ``length`` words, in order."""
    last = F.size(words) - length + 1
    return F.when(last >= 1, F.transform(F.sequence(F.lit(1), last), lambda i: F.xxhash64(F.slice(words, i, length)))).otherwise(F.array().cast("array<bigint>"))


def item_windows(benchmark: DataFrame, how: Contamination, item_col: str, text_col: str) -> DataFrame:
    """``item, length, words`` of every window; one row for each item and different window."""
    items = benchmark.select(F.col(f"`{item_col}`").cast("string").alias("item"), words_of(F.col(f"`{text_col}`")).alias("all")).where(F.size("all") > 0)
    length = F.least(F.size("all"), F.lit(how.words))
    placed = items.select("item", "all", length.alias("length"), F.explode(F.sequence(F.lit(1), F.size("all") - length + 1)).alias("at"))
    return placed.select("item", "length", F.slice("all", F.col("at"), F.col("length")).alias("words")).distinct()


def window_table(windows: DataFrame) -> DataFrame:
    """``hash, twin, length, words``: each different window once; ``twin`` tells windows with one hash apart."""
    once = windows.select("length", "words").distinct().withColumn("hash", F.xxhash64("words"))
    return once.withColumn("twin", F.row_number().over(Window.partitionBy("hash").orderBy("length", "words")))


def found(docs: DataFrame, table: DataFrame, lengths: list[int]) -> DataFrame:
    """``id, text_key, n_words, at, length, hash, twin`` of every hit, and a row with ``at`` 0 for every document.

    A document's hashes stand in one array: a mark first, then the windows of each length. The mark meets a row of its
    own in the broadcast table, so documents without hits come out of the same join.
    """
    spark = docs.sparkSession
    mark = spark.range(1).select(F.lit(0).cast("bigint").alias("hash"), F.lit(0).alias("twin"), F.lit(0).alias("length"), F.array().cast("array<string>").alias("words"))
    cut = docs.select("id", F.md5(F.coalesce("text", F.lit(""))).alias("text_key"), words_of(F.col("text")).alias("all"))
    made = cut.select("id", "text_key", "all", F.size("all").alias("n_words"), F.concat(F.array(F.lit(0).cast("bigint")), *(hashes(F.col("all"), n) for n in lengths)).alias("hashes"))
    # The outer form, as the inner one gets a filter that would make the hashes twice; the array is never empty.
    each = made.select("id", "text_key", "all", "n_words", F.posexplode_outer("hashes").alias("slot", "window_hash"))
    at, before = F.col("slot"), F.lit(0)
    for n in lengths[:-1]:
        before = before + F.greatest(F.col("n_words") - n + 1, F.lit(0))
        at = F.when(F.col("slot") > before, F.col("slot") - before).otherwise(at)
    length, before = F.lit(0), F.lit(0)
    for n in lengths:
        length = F.when(F.col("slot") > before, F.lit(n)).otherwise(length)
        before = before + F.greatest(F.col("n_words") - n + 1, F.lit(0))
    same = F.when(F.col("slot") == 0, F.col("length") == 0).otherwise((F.col("length") == length) & (F.slice("all", at, F.greatest(length, F.lit(1))) == F.col("words")))
    joined = each.join(F.broadcast(table.select("hash", "twin", "length", "words").unionByName(mark)), (F.col("window_hash") == F.col("hash")) & same)
    return joined.select("id", "text_key", "n_words", at.alias("at"), "length", "hash", "twin")


def hit_places(spans: Column) -> Column:
    """Ascending places of the words inside any of ``spans``, an array of (at, length)."""
    return F.array_sort(F.array_distinct(F.flatten(F.transform(spans, lambda s: F.sequence(s["at"], s["at"] + s["length"] - 1)))))


def runs_of(places: Column) -> Column:
    """Maximal runs (first, after) of ascending places: a run starts where no place is before, and ends where none follows."""
    after = F.transform(places, lambda p: p + 1)
    return F.arrays_zip(F.array_sort(F.array_except(places, after)).alias("first"), F.array_sort(F.array_except(after, places)).alias("after"))


def scan(docs: DataFrame, benchmark: DataFrame, how: Contamination | None = None, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """A row for each different (id, text): ``id, text_key, copies, n_words, n_hit, runs, n_items, items``.

    ``runs`` are the maximal runs (first, after) of hit words, counted from 1, ``items`` the sorted ids as strings. The actions here run
    over the benchmark: its windows are counted and their at most ``how.words`` lengths listed. One scan of the documents
    for each block of windows is written to the shared folder.
    """
    how = how or Contamination()
    windows = materialize(item_windows(benchmark, how, item_col, item_text_col), "windows")
    table = materialize(window_table(windows), "window_table")
    counts = table.groupBy("length").count().collect()
    blocks = max(1, -(-sum(r["count"] for r in counts) // how.block))
    lengths = sorted(r["length"] for r in counts)
    frame = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    dealt: Iterable[DataFrame] = (table.where(F.pmod("hash", F.lit(blocks)) == b) if blocks > 1 else table for b in range(blocks))
    hits = reduce(DataFrame.unionByName, (found(frame, some, lengths) for some in dealt))
    is_hit = F.col("at") > 0
    by_text = hits.groupBy("id", "text_key").agg(
        F.max("n_words").alias("n_words"),
        (F.count_if(~is_hit) / blocks).cast("bigint").alias("copies"),
        F.collect_set(F.when(is_hit, F.struct("at", "length"))).alias("spans"),
        F.collect_set(F.when(is_hit, F.struct("hash", "twin"))).alias("found"),
    )
    placed = by_text.select("id", "text_key", "n_words", "copies", hit_places(F.col("spans")).alias("places"), F.array_sort("found").alias("found"))
    judged = materialize(
        placed.select("id", "text_key", "copies", F.col("n_words").cast("bigint").alias("n_words"), F.size("places").cast("bigint").alias("n_hit"), runs_of(F.col("places")).alias("runs"), "found").withColumn("set_key", F.when(F.size("found") > 0, F.sha2(F.col("found").cast("string"), 256))),
        "judged",
    )
    is_clean = F.col("set_key").isNull()
    sets = judged.where(~is_clean).groupBy("set_key").agg(F.first("found").alias("found")).select("set_key", F.explode("found").alias("w"))
    member = windows.join(table, ["length", "words"]).select("hash", "twin", "item")
    listed = sets.join(member, (F.col("w.hash") == F.col("hash")) & (F.col("w.twin") == F.col("twin"))).groupBy("set_key").agg(F.collect_set("item").alias("ids"), F.max(F.col("item").isNull().cast("int")).alias("nameless"))
    named = listed.select("set_key", F.array_sort("ids").alias("items"), (F.size("ids") + F.col("nameless")).cast("bigint").alias("n_items"))
    columns = ["id", "text_key", "copies", "n_words", "n_hit", "runs", "n_items", "items"]
    free = judged.where(is_clean).withColumns({"n_items": F.lit(0).cast("bigint"), "items": F.array().cast("array<string>")})
    return judged.where(~is_clean).join(named, "set_key").select(columns).unionByName(free.select(columns))


def contamination(docs: DataFrame, benchmark: DataFrame, how: Contamination | None = None, id_col: str = "doc_id", **cols) -> DataFrame:
    """``id, n_words, n_hit, n_items, items, contaminated`` for every row of ``docs``."""
    rows = scan(docs, benchmark, how, id_col, **cols).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies"))))
    return rows.select(F.col("id").alias(id_col), "n_words", "n_hit", "n_items", "items", (F.col("n_hit") > 0).alias("contaminated"))


def clean(docs: DataFrame, benchmark: DataFrame, how: Contamination | None = None, remove: str = "spans", id_col: str = "doc_id", text_col: str = "text", **cols) -> DataFrame:
    """``docs`` with all its columns, without the documents that have a hit or without the words that are hit.

    ``remove`` is ``documents`` or ``spans``. A removed word goes with the signs between it and the word before.
    """
    if remove not in ("documents", "spans"):
        raise ValueError(f"remove {remove!r}")
    key, own, runs = unclashed(docs, "text_key", "own_id", "hit_runs")
    hit = scan(docs, benchmark, how, id_col, text_col, **cols).where("n_hit > 0").select(F.col("id").alias(own), F.col("text_key").alias(key), F.col("runs").alias(runs))
    text = F.col(f"`{text_col}`")
    same = F.col(f"`{id_col}`").eqNullSafe(F.col(own)) & (F.md5(F.coalesce(text, F.lit(""))) == F.col(key))
    if remove == "documents":
        return docs.join(hit, same, "left_anti")
    pieces = F.regexp_extract_all(text, F.lit(PIECE), 0)
    # What stands between runs stays: from the end of one (or the first word) to the start of the next (or the last word).
    bounds = F.arrays_zip(F.concat(F.array(F.lit(1)), F.col(f"{runs}.after")).alias("first"), F.concat(F.col(f"{runs}.first"), F.array(F.size(pieces) + 1)).alias("after"))
    left = F.flatten(F.transform(bounds, lambda b: F.slice(pieces, b["first"], b["after"] - b["first"])))
    tail = F.substr(text, F.length(F.array_join(pieces, "")) + 1)
    cut = F.when(F.col(runs).isNull(), text).otherwise(F.concat(F.array_join(left, ""), tail))
    return docs.join(hit, same, "left").withColumn(text_col, cut).select(*(f"`{c}`" for c in docs.columns))
