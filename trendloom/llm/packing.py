"""Packing by optimal length buckets.

The histogram of sequence lengths is global and has no more than ``longest`` rows, since longer texts are cut into
sequences of that length first. Dynamic programming over it picks the bucket lengths with the least padding. In each
bucket, sequences form batches of as many as fit the token budget at the bucket's length.

A sequence's place in its bucket is its place in a shard of the bucket plus the sizes of the shards before, so no
bucket is gathered or sorted in one task. Shards hold about the square root of all rows.

Defined results: null and empty texts are one sequence of no tokens; an empty table has no sequences; repeated rows are
sequences of their own; rows that share an id take their places in any order among themselves; a row without an id is packed
like any other; a text longer than ``longest`` is cut into sequences, none of it dropped; only the id and the text are read, so
other columns' names can't clash.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, materialize


@dataclass(frozen=True)
class Packing:
    buckets: int = 16
    longest: int = 4096  #: tokens of a sequence
    budget: int = 16384  #: tokens of a batch, padding included
    shard_rows: int = 2000  #: least rows of a shard, on average


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD))


def best_lengths(counts: dict[int, int], buckets: int) -> list[int]:
    """Ascending bucket lengths, at most ``buckets``, the last the largest length, with the least total padding.

    A sequence goes to the first bucket that holds it. The cost of a bucket satisfies the quadrangle inequality, so the
    best cut moves one way and each row of the program takes O(n log n).
    """
    lengths = np.array(sorted(counts), dtype=np.int64)
    if not len(lengths):
        return []
    number = np.concatenate([[0], np.cumsum([counts[int(v)] for v in lengths])])
    tokens = np.concatenate([[0], np.cumsum([counts[int(v)] * int(v) for v in lengths])])
    n = len(lengths)
    cost = lambda i, j: (number[j] - number[i]) * lengths[j - 1] - (tokens[j] - tokens[i])
    best = np.array([0] + [cost(0, j) for j in range(1, n + 1)], dtype=np.float64)
    cuts = [np.zeros(n + 1, dtype=np.int64)]
    for k in range(2, min(buckets, n) + 1):
        now, cut = np.full(n + 1, np.inf), np.zeros(n + 1, dtype=np.int64)
        todo = [(k, n, k - 1, n - 1)]
        while todo:
            low, high, first, last = todo.pop()
            if low > high:
                continue
            j = (low + high) // 2
            i = np.arange(first, min(last, j - 1) + 1)
            total = best[i] + cost(i, j)
            at = int(total.argmin())
            now[j], cut[j] = total[at], i[at]
            todo += [(low, j - 1, first, int(i[at])), (j + 1, high, int(i[at]), last)]
        best = now
        cuts.append(cut)
    ends, j = [], n
    for cut in reversed(cuts):
        if j:
            ends.append(int(lengths[j - 1]))
        j = int(cut[j])
    return ends[::-1]


def pack(docs: DataFrame, how: Packing | None = None, length: Column | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each sequence.

    ``id, piece, start, n_tokens`` (which tokens of which text), ``bucket, bucket_tokens, batch, place`` (where it
    goes) and ``padding``. Tokens are counted by ``length``, words if that isn't given.
    """
    how = how or Packing()
    length = word_count(F.col(f"`{text_col}`")) if length is None else length
    sized = materialize(docs.select(F.col(f"`{id_col}`").alias("id"), length.cast("bigint").alias("total")), "lengths")
    pieces = sized.select("id", "total", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.col("total") / how.longest).cast("int") - 1))).alias("piece")).select(
        "id", "piece", (F.col("piece").cast("bigint") * how.longest).alias("start"), F.least(F.lit(how.longest), F.col("total") - F.col("piece").cast("bigint") * how.longest).alias("n_tokens")
    )
    counts = {int(r["n_tokens"]): int(r["n"]) for r in pieces.groupBy("n_tokens").agg(F.count("*").alias("n")).collect()}  # at most how.longest + 1 rows
    ends = best_lengths(counts, how.buckets) or [0]
    least = max(how.shard_rows, math.isqrt(sum(counts.values())))
    sizes = [sum(n for v, n in counts.items() if low < v <= high) for low, high in zip([-1, *ends], ends)]
    numbers = lambda values: F.array(*(F.lit(int(v)).cast("bigint") for v in values))
    bucket = F.size(F.filter(numbers(ends), lambda e: e < F.col("n_tokens")))
    placed = pieces.withColumn("bucket", bucket).withColumn("bucket_tokens", F.element_at(numbers(ends), F.col("bucket") + 1))
    placed = placed.withColumn("shard", F.pmod(F.xxhash64("id", "piece"), F.element_at(numbers([math.ceil(n / least) or 1 for n in sizes]), F.col("bucket") + 1)))
    before = placed.groupBy("bucket", "shard").agg(F.count("*").alias("n")).select("bucket", "shard", F.coalesce(F.sum("n").over(Window.partitionBy("bucket").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    ranked = placed.withColumn("rank", F.row_number().over(Window.partitionBy("bucket", "shard").orderBy("id", "piece")) - 1)
    at = F.col("before") + F.col("rank")
    fits = F.greatest(F.lit(1), F.floor(F.lit(how.budget) / F.greatest(F.col("bucket_tokens"), F.lit(1))))
    return ranked.join(before, ["bucket", "shard"]).select(
        F.col("id").alias(id_col), "piece", "start", "n_tokens", "bucket", "bucket_tokens", F.floor(at / fits).cast("bigint").alias("batch"), (at % fits).cast("bigint").alias("place"), (F.col("bucket_tokens") - F.col("n_tokens")).alias("padding")
    )
