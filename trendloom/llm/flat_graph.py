"""Near-duplicates of embeddings by a robust-pruned flat graph.

Vectors with one label (and width) are dealt to shards around centroids: each has its home with the nearest one and is a
guest wherever a vector could have its home that it links with, which the planes between the centroids tell. A shard
that is too large is dealt out again. Each shard links its vectors to near ones and prunes robustly; the adjacency lists
of a vector from all its shards are united. Each vector is then searched for in the united graph of its home, greedily
from the shard's medoid, and widens the search over the range in which links can lie. Pairs found are verified in double
precision. Each shard audits recall against brute force on a sample of its queries and searches again, wider, while
the audit misses anything; as the shard has all that its home vectors can link with, that is recall among all of the label.

A large shard that centroids don't separate (one group within the threshold, or noise) is not searched but compared
exactly, by products of blocks, each pair of blocks in a task of its own: that is quadratic in time.

Equal vectors with one label are one class from the start. Each link counts once for each end, in that one's home, and
no pair leaves a task: what goes on is a count for each vector and a spanning tree of each shard's links.

Missed links: those that a search misses and the sampled audit doesn't see; `tests/llm` hold recall against brute force.

Defined results: vectors that are null, empty, zero or hold null or non-finite components, vectors with a null label
and rows without an id link with nothing (n_links 0, component their own id, kept); repeated rows of an id are one
vector; different vectors under one id (or under several labels) are vectors of their own in ``n_links``, each row with its own count, and
one node in components; vectors of different widths don't link; a cosine of exactly the limit links; an empty table gives an
empty one; vectors of any width are whole in one task; only id, label and vector are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_schema, discard, materialize
from .graph import components

SHARD = 3000  #: vectors of a shard above which it is dealt out again
CENTROIDS = 16
SPREAD = 4  #: rows of all shards for each vector, on average, above which centroids don't separate
BLOCK_BYTES = 8 << 20  #: vectors of a block of a shard that isn't separated
LEVELS = 8
DEGREE = 20  #: edges that pruning keeps
NEAR = 64  #: nearest vectors that pruning chooses from
ALPHA = 1.2
BEAM = 24
AUDIT = 64  #: queries of a shard held against brute force


def prepared(vectors: DataFrame, id_col: str, vec_col: str, label_col: str) -> DataFrame:
    """``id, label, width, key, vec``: key is a digest of the vector, null if it links with nothing."""
    schema = "id bigint, label string, width int, key binary, vec array<double>"
    target = arrow_schema(vectors.sparkSession, schema)

    def run(batches):
        import xxhash

        for batch in batches:
            keys, vecs, widths = [], [], []
            for label, vec in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                x = np.array(vec if vec is not None and label is not None and None not in vec else [], dtype=np.float64) + 0.0
                good = len(x) > 0 and np.isfinite(x).all() and x.any()
                x = x / np.abs(x).max() if good else x  # so that no square over- or underflows
                keys.append(xxhash.xxh3_128_digest(x.tobytes()) if good else None)
                vecs.append(x / np.linalg.norm(x) if good else None)
                widths.append(len(x))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(widths, pa.int32()), pa.array(keys, pa.binary()), pa.array(vecs, pa.list_(pa.float64()))], names=target.names)

    frame = vectors.select(F.col(f"`{id_col}`").cast("bigint").alias("id"), F.col(f"`{label_col}`").cast("string").alias("label"), F.col(f"`{vec_col}`").cast("array<double>").alias("vec"))
    return frame.mapInArrow(run, schema)


def reached(x: np.ndarray, c: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroid of each vector, and whether a vector that links with it can be nearest to each centroid.

    All nearest to S lie on its side of the plane between S and any other centroid U. A link is a chord of at most
    ``sqrt(2 - 2 least)``, so what lies farther beyond one of these planes links with none of them.
    """
    dots = x @ c.T
    apart = np.linalg.norm(c[:, None] - c[None], axis=2)
    can = np.ones(dots.shape, dtype=bool)
    for s in range(len(c)):
        others = apart[s] > 1e-4  # planes between almost equal centroids tell nothing
        if others.any():
            can[:, s] = ((dots[:, others] - dots[:, [s]]) / apart[s][others]).max(1) <= np.sqrt(max(0.0, 2 - 2 * least)) + 1e-9
    nearest = dots.argmax(1)
    can[np.arange(len(x)), nearest] = True
    return nearest, can


def centred(samples: DataFrame, least: float) -> DataFrame:
    """``shard, centroids`` (flat) from ``shard, sample array<array<double>>, room``: a few rounds of spherical k-means.

    Null for a shard that they don't separate. Half of the sample is for the rounds; to how many shards a vector goes is
    measured on the other half, and must leave the shard's rows within ``room`` times what they are.
    """
    schema = "shard string, centroids array<double>"

    def run(batches):
        for batch in batches:
            out = []
            for sample, room in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                x, unseen = np.array(sample[::2]), np.array(sample[1::2])
                c = x[:: max(1, len(x) // CENTROIDS)][:CENTROIDS].copy()
                for _ in range(5):
                    near = (x @ c.T).argmax(1)
                    for k in range(len(c)):
                        mean = x[near == k].sum(0) if (near == k).any() else c[k]
                        c[k] = mean / (np.linalg.norm(mean) or 1)
                out.append(c.ravel() if len(c) > SPREAD and len(unseen) and reached(unseen, c, least)[1].sum(1).mean() <= room else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.float64()))], names=["shard", "centroids"])

    return samples.mapInArrow(run, schema)


def dealt_again(rows: DataFrame, least: float) -> DataFrame:
    """``shard`` of each row becomes its home and those where it is a guest; takes ``centroids`` of the shard."""
    schema = "node bigint, copies bigint, vec array<double>, shard string, home boolean"

    def run(batches):
        for batch in batches:
            vec, shard = batch.column(2), np.array(batch.column(3).to_pylist(), dtype=object)
            flat, cuts = vec.values.to_numpy(), vec.offsets.to_numpy()
            home = batch.column(4).to_numpy(zero_copy_only=False)
            index, shards, homes = [], [], []
            for name in dict.fromkeys(shard.tolist()):
                own = np.flatnonzero(shard == name)
                width = int(cuts[own[0] + 1] - cuts[own[0]])  # one width in a shard
                x = flat[cuts[own][:, None] + np.arange(width)]
                nearest, can = reached(x, np.array(batch.column(5)[int(own[0])].as_py()).reshape(-1, width), least)
                at, k = np.nonzero(can)
                index.append(own[at])
                shards += [f"{name}.{i}" for i in k.tolist()]
                homes.append(home[own][at] & (nearest[at] == k))
            if index:
                take = batch.select([0, 1, 2]).take(pa.array(np.concatenate(index)))
                yield pa.RecordBatch.from_arrays([*take.columns, pa.array(shards, pa.string()), pa.array(np.concatenate(homes))], names=["node", "copies", "vec", "shard", "home"])

    return rows.select("node", "copies", "vec", "shard", "home", "centroids").mapInArrow(run, schema)


def dealt(classes: DataFrame, least: float) -> DataFrame:
    """``node, copies, vec, shard, home, size``: a row for each shard of a class.

    ``size`` is that of a shard which is too large and isn't separated, null for the others.
    """
    rows = classes.select("node", "copies", "vec", F.concat_ws("/", F.col("width").cast("string"), "label").alias("shard"), F.lit(True).alias("home"), F.lit(None).cast("bigint").alias("size"))
    rows = materialize(rows, "shards")
    for level in range(LEVELS + 1):
        sizes = rows.where("size IS NULL").groupBy("shard").agg(F.count("*").alias("n"), F.count_if("home").alias("homes"))
        large = materialize(sizes.where(F.col("n") > SHARD), "large")
        if large.isEmpty():
            break
        # About 40 sampled vectors for each centroid, so the sample of a shard is bounded.
        sampled = rows.join(large, "shard").where(F.pmod(F.xxhash64("node", F.lit(level)), F.greatest(F.lit(1), (F.col("n") / (40 * CENTROIDS)).cast("bigint"))) == 0)
        # A shard's rows may grow to SPREAD for each vector at home there; a shard without one has nothing to search for.
        room = F.first(F.col("homes") * F.lit(float(SPREAD)) / F.col("n")).alias("room")
        centroids = centred(sampled.groupBy("shard").agg(F.array_sort(F.collect_list(F.struct("node", "vec"))).alias("own"), room).select("shard", F.transform("own", lambda v: v["vec"]).alias("sample"), "room"), least)
        large_now = large.drop("homes")
        cuts = materialize((large_now.join(centroids, "shard", "left") if level < LEVELS else large_now.withColumn("centroids", F.lit(None).cast("array<double>"))), "centroids")
        found = rows.join(cuts, "shard", "left")
        same = found.where("centroids IS NULL").select("node", "copies", "vec", "shard", "home", F.coalesce("size", "n").alias("size"))
        again = dealt_again(found.where("centroids IS NOT NULL"), least).withColumn("size", F.lit(None).cast("bigint"))
        done = materialize(same.unionByName(again), "shards")
        for old in (large, cuts, rows):
            discard(old)
        rows = done
    return rows


def pruned(x: np.ndarray) -> list[list[int]]:
    """Edges of each vector: robust pruning of its nearest ones, made symmetric."""
    n = len(x)
    edges: list[set[int]] = [set() for _ in range(n)]
    near = min(NEAR, n - 1)
    for i in range(0, n, 512):
        products = x[i : i + 512] @ x.T
        products[np.arange(len(products)), np.arange(i, i + len(products))] = -2
        best = np.argpartition(-products, near - 1, axis=1)[:, :near] if near else np.empty((len(products), 0), dtype=int)
        for k, cand in enumerate(best):
            cand = cand[np.argsort(-products[k, cand], kind="stable")]
            away = np.sqrt(np.maximum(0, 2 - 2 * products[k, cand]))
            between = np.sqrt(np.maximum(0, 2 - 2 * (x[cand] @ x[cand].T)))
            alive = np.ones(len(cand), dtype=bool)
            for j in range(len(cand)):
                if alive[j]:
                    edges[i + k].add(int(cand[j]))
                    if len(edges[i + k]) >= DEGREE:
                        break
                    alive[j + 1 :] &= ALPHA * between[j, j + 1 :] > away[j + 1 :]
    for i in range(n):
        for j in list(edges[i]):
            edges[j].add(i)
    return [sorted(e) for e in edges]


def members(batches) -> tuple[pa.Table, np.ndarray, np.ndarray]:
    part = pa.Table.from_batches(batches)
    order = np.argsort(part.column("node").to_numpy(), kind="stable")
    part = part.take(pa.array(order))
    flat = part.column("vec").combine_chunks()
    flat = (flat.chunk(0) if isinstance(flat, pa.ChunkedArray) else flat).flatten().to_numpy()
    return part, part.column("node").to_numpy(), flat.reshape(part.num_rows, -1)


def build(shards: DataFrame) -> DataFrame:
    """``node, near array<bigint>``: the adjacency list of each vector in each shard."""

    def run(part):
        part, node, x = members(part.to_batches())
        return pa.table({"node": node, "near": pa.array([node[e] for e in pruned(x)], pa.list_(pa.int64()))})

    return shards.select("shard", "node", "vec").groupBy("shard").applyInArrow(run, "node bigint, near array<bigint>")


def searched(x: np.ndarray, query: int, medoid: int, edges: list[list[int]], beam: int, edge: float) -> np.ndarray:
    """Vectors met whose product with the query is at least ``edge``.

    The query is a vector of the graph, so a search that doesn't meet it has stopped short: the beam is widened, and
    at last, if no path leads there, the search starts from the query.
    """
    for wide in (1, 4, 16):
        met, seen = walked(x, query, medoid, edges, beam * wide, edge)
        if query in seen:
            return met
    return walked(x, query, query, edges, beam, edge)[0]


def walked(x: np.ndarray, query: int, start: int, edges: list[list[int]], beam: int, edge: float) -> tuple[np.ndarray, set[int]]:
    """A greedy search with a beam that goes on over all that is in the range: vectors in the range, and all met."""
    import heapq

    q = x[query]
    seen = {start}
    first = float(x[start] @ q)
    todo, best = [(-first, start)], [(first, start)]
    while todo:
        score, i = heapq.heappop(todo)
        # Beyond the beam only what is in the range is expanded, all of it.
        if -score < best[0][0] and len(best) >= beam and -score < edge:
            break
        fresh = [j for j in edges[i] if j not in seen]
        if not fresh:
            continue
        seen.update(fresh)
        for j, s in zip(fresh, (x[fresh] @ q).tolist(), strict=True):
            if len(best) < beam or s > best[0][0] or s >= edge:
                heapq.heappush(todo, (-s, j))
                heapq.heappush(best, (s, j))
                if len(best) > beam and best[0][0] < edge:
                    heapq.heappop(best)
    return np.array([j for s, j in best if s >= edge and j != query], dtype=np.int64), seen


def found_in(x: np.ndarray, edges: list[list[int]], least: float, asked: np.ndarray | None = None) -> tuple[dict[int, np.ndarray], float]:
    """Verified links of the vectors ``asked`` for and the audited recall."""
    asked = np.arange(len(x)) if asked is None else asked
    medoid = int((x @ x.mean(0)).argmax())
    # A monotone path between vectors at distance d stays within 2 d of both ends.
    edge = 1 - 4 * (1 - least)
    sample = asked[np.unique(np.linspace(0, len(asked) - 1, min(len(asked), AUDIT)).astype(int))] if len(asked) else asked
    truth = {int(i): set(np.flatnonzero(x @ x[i] >= least).tolist()) - {int(i)} for i in sample}
    beam = BEAM
    while True:
        links: dict[int, set[int]] = {}
        for i in asked.tolist():
            met = searched(x, i, medoid, edges, beam, edge)
            links[i] = set(met[x[met] @ x[i] >= least].tolist()) if len(met) else set()
        missed = sum(len(t - links[i]) for i, t in truth.items())
        total = sum(map(len, truth.values()))
        if not missed or beam >= len(x):
            break
        beam *= 2
    for i in asked.tolist():  # a link found from one end holds for both
        for j in links[i]:
            if j in links:
                links[j].add(i)
    return {i: np.array(sorted(found), dtype=np.int64) for i, found in links.items()}, 1 - missed / total if total else 1.0


def search(shards: DataFrame, graph: DataFrame, least: float) -> DataFrame:
    """``node, links, root, recall``: each vector is searched for in its home, which has all that it can link with."""
    rows = shards.join(graph, "node").select("shard", "node", "copies", "vec", "home", "near")

    def run(part):
        part, node, x = members(part.to_batches())
        place = {int(v): i for i, v in enumerate(node)}
        edges = [[place[j] for j in near if j in place] for near in part.column("near").to_pylist()]
        links, recall = found_in(x, edges, least, np.flatnonzero(np.array(part.column("home").to_pylist(), dtype=bool)))
        copies = part.column("copies").to_numpy()
        root, counts = list(range(len(node))), np.zeros(len(node), dtype=np.int64)

        def top(i: int) -> int:
            while root[i] != i:
                root[i] = root[root[i]]
                i = root[i]
            return i

        for i, near in links.items():
            for j in near.tolist():
                a, b = sorted((top(i), top(j)))
                root[b] = a
            counts[i] += copies[near].sum()
        return pa.table({"node": node, "links": counts, "root": node[[top(i) for i in range(len(node))]], "recall": np.full(len(node), recall)})

    return rows.groupBy("shard").applyInArrow(run, "node bigint, links bigint, root bigint, recall double")


def compared(x: np.ndarray, y: np.ndarray | None, copies: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Links and root of the vectors ``x`` among each other, or of ``x`` with ``y`` (counted behind them): all products."""
    n, base = len(x), x if y is None else y
    shift = 0 if y is None else n
    root, counts, weights = np.arange(shift + len(base)), np.zeros(shift + len(base)), copies.astype(np.float64)
    step = max(1, (2 << 20) // max(1, len(base)))
    for i in range(0, n, step):
        start = i if y is None else 0
        hit = x[i : i + step] @ base[start:].T >= least
        if y is None:
            hit = np.triu(hit, 1)  # each pair once
        rows, cols = np.arange(i, i + len(hit)), np.arange(shift + start, shift + len(base))
        told = hit.astype(np.float64)
        counts[rows] += told @ weights[cols]
        counts[cols] += weights[rows] @ told
        for r in np.flatnonzero((hit & (root[rows][:, None] != root[cols])).any(1)):
            others = np.unique(np.append(root[cols[hit[r]]], root[rows[r]]))
            for other in others[1:]:
                root[root == other] = others[0]
    return counts.astype(np.int64), root


def compare(dense: DataFrame, least: float) -> DataFrame:
    """``node, links, root, recall`` of shards that aren't separated: exact, a task for each pair of a shard's blocks."""
    blocks = F.ceil(F.col("size") * F.size("vec") * 8 / BLOCK_BYTES).cast("bigint")
    packed_schema = "shard string, block bigint, blocks bigint, node array<bigint>, copies array<bigint>, home array<boolean>, vec array<double>"

    def pack(part):
        part, node, x = members(part.to_batches())
        first = part.slice(0, 1)
        one = lambda values, kind: pa.array([values], pa.list_(kind))
        return pa.table({"shard": first.column("shard"), "block": first.column("block"), "blocks": first.column("blocks"), "node": one(node, pa.int64()), "copies": one(part.column("copies").to_numpy(), pa.int64()), "home": one(part.column("home").to_numpy(), pa.bool_()), "vec": one(x.ravel(), pa.float64())})

    def run(part):
        held = []
        for k in range(part.num_rows):
            node, copies, home, vec = (part.column(c)[k].values.to_numpy(zero_copy_only=False) for c in ("node", "copies", "home", "vec"))
            held.append((node, copies, home.astype(bool), vec.reshape(len(node), -1)))
        node, copies, home = (np.concatenate([h[c] for h in held]) for c in range(3))
        counts, root = compared(held[0][3], held[1][3] if len(held) > 1 else None, copies, least)
        return pa.table({"node": node, "links": np.where(home, counts, 0), "root": node[root], "recall": np.ones(len(node))})

    dealt_out = dense.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")))
    packed = dealt_out.select("shard", "block", "blocks", "node", "copies", "home", "vec").groupBy("shard", "block").applyInArrow(pack, packed_schema)
    sent = packed.withColumn("other", F.explode(F.expr("sequence(0L, blocks - 1)"))).withColumn("low", F.least("block", "other")).withColumn("high", F.greatest("block", "other"))
    pairs = sent.select("shard", "low", "high", "node", "copies", "home", "vec")
    return pairs.groupBy("shard", "low", "high").applyInArrow(run, "node bigint, links bigint, root bigint, recall double")


def near_duplicates(vectors: DataFrame, least: float = 0.98, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """``id, n_links, component_id, kept`` for every row."""
    base = materialize(prepared(vectors, id_col, vec_col, label_col), "vectors")
    usable = base.where("id is not null and key is not null")
    own = usable.groupBy("label", "key", "id").agg(F.first("width").alias("width"), F.first("vec").alias("vec"))
    grouped = own.groupBy("label", "key").agg(F.min("id").alias("least"), F.count("*").alias("copies"), F.first("width").alias("width"), F.first("vec").alias("vec"))
    classes = materialize(grouped.withColumn("node", F.monotonically_increasing_id()), "classes")
    every = dealt(classes, least)
    shards, dense = every.where("size IS NULL"), every.where("size IS NOT NULL")
    graph = materialize(build(shards).groupBy("node").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near")), "graph")
    met = materialize(search(shards, graph, least).unionByName(compare(dense, least)), "links")
    # Vectors under one id are one node of the components.
    several = usable.groupBy("id").agg(F.min("key").alias("low"), F.max("key").alias("high"), F.min("label").alias("one"), F.max("label").alias("other")).where("low <> high OR one <> other").select("id")
    nodes = usable.join(several, "id").select("id", "label", "key").distinct().join(classes.select("label", "key", "node"), ["label", "key"]).select("id", "node")
    same = nodes.join(nodes.groupBy("id").agg(F.min("node").alias("b")), "id").select(F.col("node").alias("a"), "b")
    roots = components(met.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(same))
    placed = classes.select("label", "key", "node", "copies", "least").join(roots, "node", "left").withColumn("root", F.coalesce("component", "node"))
    smallest = placed.groupBy("root").agg(F.min("least").alias("smallest"))
    links = met.groupBy("node").agg(F.sum("links").alias("links"), F.min("recall").alias("audited_recall"))
    by_class = materialize(placed.join(smallest, "root").join(links, "node").select("label", "key", (F.col("copies") - 1 + F.col("links")).alias("n_links"), F.col("smallest").alias("component"), "audited_recall"), "placed")
    discard(every, graph, classes, met)
    return (
        base.select("id", "label", F.when(F.col("id").isNotNull(), F.col("key")).alias("key"))
        .join(by_class, ["label", "key"], "left")
        .select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), F.coalesce("component", "id").alias("component_id"), "audited_recall")
        .withColumn("kept", F.col(f"`{id_col}`").eqNullSafe(F.col("component_id")))
        .select(id_col, "n_links", "component_id", "kept", "audited_recall")
    )
