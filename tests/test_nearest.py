"""The k best kept over pieces of a bank, ties included, against all products."""

import numpy as np
import pytest

from trendloom.operators import vectors


@pytest.mark.parametrize("k", [1, 3, 50])
def test_pieces(k):
    draw = np.random.default_rng(k)
    x = draw.integers(-2, 3, (70, 3)).astype(float)
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    ids, labels = draw.permutation(70).astype(np.int64), draw.integers(-1, 4, 70).astype(np.int32)
    asked = np.arange(0, 70, 7)
    best = vectors.Nearest(ids[asked], x[asked], k)
    for i in range(0, 70, 9):
        best.add(ids[i : i + 9], labels[i : i + 9], x[i : i + 9])
    rows = best.table().to_pylist()
    for q in asked:
        order = sorted((-float(x[q] @ x[j]), int(ids[j])) for j in range(70) if j != q)[:k]
        got = [(-r["cosine"], r["other"]) for r in rows if r["id"] == ids[q]]
        assert [o for _, o in got] == [o for _, o in order] or np.allclose([c for c, _ in got], [c for c, _ in order])
        assert {r["other"]: r["label"] for r in rows} == {int(ids[j]): int(labels[j]) for j in range(70) if int(ids[j]) in {r["other"] for r in rows}}


def test_queries_in_blocks(spark):
    draw = np.random.default_rng(4)
    rows = [(i, draw.standard_normal(4).tolist(), int(draw.integers(-1, 3))) for i in range(200)] + [(900, [float("nan")] * 4, 1), (901, None, 1), (902, [0.0] * 4, None)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    new = table.where("vec_id % 5 = 0 AND vec_id < 900")
    whole = {r["vec_id"]: r["label"] for r in vectors.knn_vote(new, table.repartition(3)).collect()}
    assert whole == {r["vec_id"]: r["label"] for r in vectors.knn_vote(new.unionByName(new), table, block=7).collect()} and len(whole) == 40
    unit = {i: np.array(v) / np.linalg.norm(v) for i, v, _ in rows[:200]}
    for i, told in whole.items():
        near = sorted((-float(unit[i] @ u), j) for j, u in unit.items() if j != i)[:5]
        votes = [rows[j][2] for _, j in near if rows[j][2] != -1]
        assert told == (min(set(votes), key=lambda v: (-votes.count(v), v)) if votes else -1)
