"""Vector operators: nearest taxonomy entry, votes of nearest neighbours, vetoes."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: A taxonomy is a dimension; one that grows past this is no dimension, and is refused.
MOST_TAXONOMY = 20_000


def matrix(column: pa.Array) -> np.ndarray:
    """Unit rows of an Arrow column of vectors of one width."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    x = flat.reshape(len(column), -1)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def nearest_taxonomy(vectors: DataFrame, taxonomy: DataFrame, least: float = 0.20, key: str = "vec_id") -> DataFrame:
    """``key, target_cluster_id, target_cluster_score``: the entry of the largest cosine, ``C000`` under ``least``.

    The taxonomy's vectors, at most MOST_TAXONOMY, go to every task; each batch is one matrix product. Ties go to the
    smallest cluster id.
    """
    rows = taxonomy.select("target_cluster_id", F.col("embedding").cast("array<double>").alias("embedding")).where("embedding is not null").orderBy("target_cluster_id").limit(MOST_TAXONOMY + 1).collect()
    if len(rows) > MOST_TAXONOMY:
        raise ValueError(f"over {MOST_TAXONOMY} clusters")
    ids = [r[0] for r in rows]
    bank = matrix(pa.array([r[1] for r in rows], pa.list_(pa.float64()))) if rows else np.empty((0, 0))

    def run(batches):
        for batch in batches:
            if not ids:
                names, scores = ["C000"] * batch.num_rows, np.zeros(batch.num_rows)
            else:
                products = matrix(batch.column(1)) @ bank.T
                best = products.argmax(1)
                scores = np.round(products.max(1), 4)
                names = [ids[b] if s >= least else "C000" for b, s in zip(best.tolist(), products.max(1).tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names), pa.array(scores)], names=[key, "target_cluster_id", "target_cluster_score"])

    kind = vectors.schema[key].dataType.simpleString()
    return vectors.select(key, F.col("embedding").cast("array<double>").alias("embedding")).where("embedding is not null").mapInArrow(run, f"{key} {kind}, target_cluster_id string, target_cluster_score double")


#: Query vectors that go to all tasks at once.
MOST_QUERIES = 16_384


class Nearest:
    """The k best (largest cosine, then smallest id) of each query so far."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int):
        self.ids, self.vectors, self.k = ids, vectors, k
        self.cosine, self.other, self.label = np.full((len(ids), 0), -np.inf), np.empty((len(ids), 0), np.int64), np.empty((len(ids), 0), np.int32)

    def add(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray) -> None:
        products = np.nan_to_num(self.vectors @ vectors.T, nan=-np.inf)
        products[self.ids[:, None] == ids[None]] = -np.inf
        if products.shape[1] > self.k:  # what can't be among the k best of these goes at once
            last = np.partition(products, -self.k, axis=1)[:, [-self.k]]
            used = (products >= last).any(0)
            products, ids, labels = products[:, used], ids[used], labels[used]
        cosine = np.hstack([self.cosine, products])
        other = np.hstack([self.other, np.broadcast_to(ids, products.shape)])
        label = np.hstack([self.label, np.broadcast_to(labels, products.shape)])
        best = np.lexsort((other, -cosine), axis=1)[:, : self.k]
        self.cosine, self.other, self.label = (np.take_along_axis(v, best, 1) for v in (cosine, other, label))

    def table(self) -> pa.RecordBatch:
        known = np.isfinite(self.cosine).ravel()
        columns = [np.repeat(self.ids, self.cosine.shape[1]), self.other.ravel(), self.label.ravel(), self.cosine.ravel()]
        return pa.RecordBatch.from_arrays([pa.array(c[known]) for c in columns], names=["id", "other", "label", "cosine"])


def knn_vote(new: DataFrame, bank: DataFrame, k: int = 5, key: str = "vec_id", label: str = "label", block: int = MOST_QUERIES) -> DataFrame:
    """``key, label``: the most frequent label of the k nearest, noise (-1) left out; ties to the smallest, none is -1.

    New vectors are the queries of an increment: blocks of about ``block`` of them go to all tasks, one after the other, and
    the bank stays where it is. A task keeps each query's k best of the rows that it reads, and only those travel. A bank
    that holds the new vectors too leaves a query its own id's row out; ties of cosine go to the smallest id. One action
    counts the queries, and one for each block collects it.
    """
    asked = new.where("embedding is not null").select(F.col(key).cast("bigint").alias("id"), F.col("embedding").cast("array<double>").alias("embedding")).dropDuplicates(["id"])
    n = max(1, -(-asked.count() // block))
    held = bank.where("embedding is not null").select(F.col(key).cast("bigint").alias("id"), F.col(label).cast("int").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    found = []
    for b in range(n):
        own = asked.where(F.pmod(F.xxhash64("id"), F.lit(n)) == b).toArrow()
        if own.num_rows:
            ids, vectors = own.column("id").to_numpy(), matrix(own.column("embedding").combine_chunks())
            found.append(held.mapInArrow(nearest_of(new.sparkSession.sparkContext.broadcast((ids, vectors)), k), "id bigint, other bigint, label int, cosine double"))
    pairs = reduce(DataFrame.unionByName, found) if found else new.sparkSession.createDataFrame([], "id bigint, other bigint, label int, cosine double")
    top = pairs.withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy(F.col("cosine").desc(), "other"))).where(F.col("rank") <= k)
    votes = top.groupBy("id").agg(F.coalesce(F.mode(F.when(F.col("label") != -1, F.col("label")), True), F.lit(-1)).alias("label"))
    return votes.withColumnRenamed("id", key)


def nearest_of(queries: Broadcast, k: int):
    """For ``mapInArrow`` over (id, label, embedding): the queries' best of a partition."""

    def run(batches):
        best = Nearest(*queries.value, k)
        for batch in batches:
            vectors = matrix(batch.column(2))
            step = max(1, (4 << 20) // max(1, len(best.ids)))  # products of some 32 MB at once
            ids, labels = batch.column(0).to_numpy(), batch.column(1).fill_null(-1).to_numpy()
            for i in range(0, len(ids), step):
                best.add(ids[i : i + step], labels[i : i + step], vectors[i : i + step])
        yield best.table()

    return run


def vetoed(assigned: DataFrame, taxonomy: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Assignments without those whose text has a negative keyword of their cluster in it (score 0, ``C000``).

    A null list means no rule. The keywords of a cluster meet only that cluster's texts, by one equi-join.
    """
    terms = taxonomy.select("target_cluster_id", F.filter(F.transform(F.split("negative_keywords", r"\|"), lambda x: F.lower(F.trim(x))), lambda x: x != "").alias("__terms"))
    rows = assigned.join(terms, "target_cluster_id", "left")
    hit = F.coalesce(F.exists("__terms", lambda t: F.contains(F.lower(F.col(text)), t)), F.lit(False))
    return rows.withColumn("vetoed", hit).withColumn("target_cluster_id", F.when(hit, "C000").otherwise(F.col("target_cluster_id"))).withColumn("target_cluster_score", F.when(hit, 0.0).otherwise(F.col("target_cluster_score"))).drop("__terms")
