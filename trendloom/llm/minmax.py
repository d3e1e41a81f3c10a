"""Near-duplicates of texts by min-max hashing.

Each permutation of a document's shingles gives two signature values, its smallest and its largest, so half as many
permutations are evaluated for signatures of the same length. Bands of values put documents into buckets; a bucket's
members are held against its smallest one, and what is still apart then against all that share a bucket with it; every
link is confirmed on the full shingle sets.

Documents with equal sets are one class and one row from the start; sets are fetched only for documents that share a
bucket. No bucket is gathered in a task: minima come back by a join, and confirmations of a document that many others
are held against are dealt over several tasks.

Missed links: with 32 bands of 4 values a pair at similarity 0.8 shares no bucket with probability
(1 - 0.8^4)^32 < 6e-8, less above it.

Defined results: null and empty texts have an empty set and link with nothing; a row without an id links with
nothing, its component is null and it is kept; repeated rows share the id and so the result; rows of one id with
several texts are one node with all their links; a similarity of exactly the limit links, and of equal documents that with the
smallest id is kept; texts are shingled whole at any length; an empty table gives an empty one; only the id and the text are
read, so other columns' names can't clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_schema, discard, map_batches, materialize
from .graph import components

MASK = (1 << 64) - 1
STEP = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class MinMax:
    shingle: int = 5
    percent: int = 80  #: link at 100 * intersection >= percent * union
    permutations: int = 64
    band: int = 4
    seed: int = 11

    def keys(self) -> tuple[np.ndarray, np.ndarray]:
        draw = np.random.default_rng(self.seed)
        return draw.integers(0, MASK, self.permutations, dtype=np.uint64, endpoint=True), draw.integers(0, MASK, self.permutations, dtype=np.uint64, endpoint=True) | np.uint64(1)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads each bit over all."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class WordHashes(dict):
    """Hash of each word, kept for words met before; bounded."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) > 300_000:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


HASHES = WordHashes()


def shingles(text: str | None, size: int) -> np.ndarray:
    """Sorted distinct hashes of the word windows; of the whole text if it has fewer words."""
    words = (text or "").encode().lower().split()  # on bytes both are ASCII only
    if not words:
        return np.empty(0, dtype=np.uint64)
    codes = np.fromiter(map(HASHES.__getitem__, words), dtype=np.uint64, count=len(words))
    width = min(size, len(words))
    total = np.full(len(words) - width + 1, width, dtype=np.uint64)
    for i in range(width):
        total = mixed(total * STEP + codes[i : len(words) - width + 1 + i])
    return np.unique(total)


def band_keys(values: np.ndarray, how: MinMax, keys: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    low = np.full(how.permutations, MASK, dtype=np.uint64)
    high = np.zeros(how.permutations, dtype=np.uint64)
    for i in range(0, len(values), 4096):
        seen = (values[i : i + 4096, None] ^ keys[0]) * keys[1]
        np.minimum(low, seen.min(axis=0), out=low)
        np.maximum(high, seen.max(axis=0), out=high)
    signature = np.stack([low, high], axis=1).reshape(-1, how.band)
    key = np.arange(len(signature), dtype=np.uint64)
    for column in signature.T:
        key = mixed(key * STEP + column)
    return key


def sketch(docs: DataFrame, how: MinMax, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, n_shingles, set_key`` (128-bit digest of the set) and ``bands`` for every row; no texts go on."""

    def run(rows: dict) -> dict:
        import xxhash

        keys = how.keys()
        out: dict[str, list] = {"id": rows["id"], "n_shingles": [], "set_key": [], "bands": []}
        for text in rows["text"]:
            values = shingles(text, how.shingle)
            out["n_shingles"].append(len(values))
            out["set_key"].append(xxhash.xxh3_128_digest(values.tobytes()) if len(values) else None)
            out["bands"].append(band_keys(values, how, keys).view(np.int64) if len(values) else None)
        return out

    frame = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("id"), F.col(f"`{text_col}`").alias("text"))
    return map_batches(frame, run, "id bigint, n_shingles bigint, set_key binary, bands array<bigint>")


def full_sets(docs: DataFrame, wanted: DataFrame, how: MinMax, id_col: str, text_col: str) -> DataFrame:
    """``node, values`` for the ids and set keys in ``wanted``."""

    def run(rows: dict) -> dict:
        import xxhash

        sets = [shingles(text, how.shingle) for text in rows["text"]]
        return {"id": rows["id"], "set_key": [xxhash.xxh3_128_digest(s.tobytes()) for s in sets], "values": [s.view(np.int64) for s in sets]}

    frame = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("id"), F.col(f"`{text_col}`").alias("text")).join(wanted.select(F.col("node").alias("id")).distinct(), "id", "left_semi")
    made = map_batches(frame, run, "id bigint, set_key binary, values array<bigint>").withColumnRenamed("id", "node")
    return made.join(wanted, ["node", "set_key"]).select("node", "values")


#: Confirmations of one document that go to a task at most, on average.
DEALT = 200


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs ``a, b`` whose full sets are similar enough.

    The set of ``a`` is sent once for each part of its pairs, the set of ``b`` once for each pair.
    """
    parts = pairs.groupBy("a").agg(F.ceil(F.count("*") / DEALT).cast("int").alias("parts"))
    one = pairs.join(parts, "a").select("a", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int").alias("part"), "b")
    members = one.join(sets.withColumnRenamed("node", "b"), "b").select("a", "part", "b", "values")
    heads = parts.select("a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")).join(sets.withColumnRenamed("node", "a"), "a")
    dealt = members.unionByName(heads.select("a", "part", F.lit(None).cast("bigint").alias("b"), "values"))
    schema = "a bigint, b bigint"
    target = arrow_schema(pairs.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, own = None, []
        for batch in batches:
            found: list[tuple[int, int]] = []
            a, part, b, values = (batch.column(i) for i in range(4))
            flat, cuts = values.values.to_numpy(zero_copy_only=False), values.offsets.to_numpy()
            for i, (left, piece, right) in enumerate(zip(a.to_pylist(), part.to_pylist(), b.to_pylist(), strict=True)):
                if (left, piece) != key:
                    key, own = (left, piece), []
                held = flat[cuts[i] : cuts[i + 1]]
                if right is None:
                    own.append(held.copy())
                elif any(similar(x, held, percent) for x in own):
                    found.append((left, right))
            yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in found], type=pa.int64()) for k in (0, 1)], schema=target)

    return dealt.repartition("a", "part").sortWithinPartitions("a", "part", F.col("b").asc_nulls_first()).mapInArrow(run, schema)


def similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
        return False
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= percent * (len(x) + len(y) - both)


def buckets(classes: DataFrame) -> DataFrame:
    """``key, node, hub`` for members of buckets with several: ``hub`` is the smallest, ``size`` their number."""
    rows = classes.select("node", F.explode("bands").alias("key"))
    hubs = rows.groupBy("key").agg(F.min("node").alias("hub"), F.count("*").alias("size")).where("size > 1")
    return rows.join(hubs, "key")


#: Set members of a block of documents, on average.
BLOCK = 1_500_000


def open_links(members: DataFrame, classes: DataFrame, sets: DataFrame, found: DataFrame, percent: int) -> DataFrame:
    """Links ``a, b`` between components that still share a bucket.

    Buckets with one hub are one group. Its documents outside its largest component are held against all of the
    group's, a block of each at a time, by counting common set members; pairs of one component are left out and no
    pair leaves a task but a link. So the rows that are dealt grow with the group, not with its pairs.
    """
    placed = members.where("size > 2").select("hub", "node").distinct().join(found, "node", "left").select("hub", "node", F.coalesce("component", "node").alias("component"))
    placed = placed.join(classes.select("node", F.col("n_shingles").alias("n")).groupBy("node").agg(F.max("n").alias("n")), "node")
    parts = placed.groupBy("hub", "component").agg(F.count("*").alias("own"), F.sum("n").alias("n"))
    groups = parts.groupBy("hub").agg(F.max_by("component", "own").alias("main"), F.max("own").alias("top"), F.sum("own").alias("all"), F.sum("n").alias("n")).where("all > top")
    rows = materialize(placed.join(groups.select("hub", "main", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")), "hub"), "open")
    own, every = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    held = rows.select("hub", "node", "component", own.alias("held"), every.alias("asked"), F.lit(0).alias("role"))
    asked = rows.where("component <> main").select("hub", "node", "component", every.alias("held"), own.alias("asked"), F.lit(1).alias("role"))
    dealt = held.unionByName(asked).join(sets, "node").select("hub", "held", "asked", "role", "node", "component", "values")
    schema = "a bigint, b bigint"
    target = arrow_schema(members.sparkSession, schema)

    def links(known: list[tuple], queries: list[tuple]) -> list[tuple[int, int]]:
        nodes, homes, sizes = (np.array(x) for x in ([k[0] for k in known], [k[1] for k in known], [len(k[2]) for k in known]))
        value, owner = np.concatenate([k[2] for k in known]), np.repeat(np.arange(len(known)), sizes)
        order = np.argsort(value, kind="stable")
        value, owner = value[order], owner[order]
        out = []
        for node, home, own_values in queries:
            low, high = np.searchsorted(value, own_values, "left"), np.searchsorted(value, own_values, "right")
            count = high - low
            place = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(low, count)
            both = np.bincount(owner[place], minlength=len(known))
            linked = np.flatnonzero((100 * both >= percent * (sizes + len(own_values) - both)) & (homes != home))
            # One link to each component is enough.
            out += [(node, int(nodes[i])) for i in linked[np.unique(homes[linked], return_index=True)[1]]]
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, known = None, []
        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in range(6)]
            values = batch.column(6)
            flat, cuts = values.values.to_numpy(zero_copy_only=False), values.offsets.to_numpy()
            out, queries = [], []
            for i, (hub, block, other, role, node, component) in enumerate(zip(*columns, strict=True)):
                if (hub, block, other) != key:
                    out += links(known, queries) if queries else []
                    key, known, queries = (hub, block, other), [], []
                (queries if role else known).append((node, component, flat[cuts[i] : cuts[i + 1]].copy()))
            out += links(known, queries) if queries else []
            yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], pa.int64()) for k in (0, 1)], schema=target)

    return dealt.repartition("hub", "held", "asked").sortWithinPartitions("hub", "held", "asked", "role", "node").mapInArrow(run, schema)


def near_duplicates(docs: DataFrame, how: MinMax | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, n_shingles, component_id, kept`` for every row."""
    how = how or MinMax()
    base = materialize(sketch(docs, how, id_col, text_col), "sketch")
    linked = base.where("id is not null and set_key is not null")
    classes = materialize(linked.groupBy("set_key").agg(F.min("id").alias("node"), F.first("n_shingles").alias("n_shingles"), F.first("bands").alias("bands")), "classes")
    members = materialize(buckets(classes), "buckets")
    star = materialize(members.where("node <> hub").select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct(), "star")
    wanted = classes.join(members.select("node").distinct(), "node", "left_semi").select("node", "set_key")
    sets = materialize(full_sets(docs, wanted, how, id_col, text_col), "sets")
    links = materialize(confirmed(star, sets, how.percent), "links")
    first = components(links)
    more = materialize(open_links(members, classes, sets, first, how.percent), "links")
    found = first if more.isEmpty() else components(links.unionByName(more))
    for done in (members, star, sets, links):
        discard(done)
    placed = classes.join(found, "node", "left").select("set_key", F.coalesce("component", "node").alias("component"))
    return (
        base.select("id", "n_shingles", F.when(F.col("id").isNotNull(), F.col("set_key")).alias("set_key"))
        .join(placed, "set_key", "left")
        .select(F.col("id").alias(id_col), "n_shingles", F.coalesce("component", "id").alias("component_id"))
        .withColumn("kept", F.col(f"`{id_col}`").eqNullSafe(F.col("component_id")))
    )


def keep_first(docs: DataFrame, how: MinMax | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents, all columns, without those that have a near-duplicate with a smaller id in their group."""
    gone = near_duplicates(docs, how, id_col, text_col).where("not kept").select(F.col(f"`{id_col}`").alias("gone_id")).distinct()
    return docs.join(gone, docs[id_col] == gone["gone_id"], "left_anti")
