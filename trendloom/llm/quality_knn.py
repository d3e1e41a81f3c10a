"""Quality classifier: votes of the nearest labelled texts in a latent semantic space.

Terms are words and the shapes of words, both hashed; a space of few dimensions comes from a singular value
decomposition of the labelled texts' weighted term counts. The labelled vectors are broadcast: their number is bounded
by ``Voting.examples`` and their width by ``Voting.width``, so their size is too. Every text's cosine with all of them
is computed exactly, a block of texts at a time, and the labels of the nearest vote, weighted by similarity.

The fit runs on the driver over the bounded sample of labelled texts (the smallest by a hash of the id, within each
label). Their terms are counted on the executors, over whole texts, and only the counts come to the driver: at most
``Voting.features`` for each. Only id and text are read; labels only for the sample. A label counts for a text once.

Defined results: null and empty texts have no terms and get the share of good labels among all examples, as does any
text with no known term; of neighbours with equal similarity (to six digits) the examples with smaller ids vote; a
score that ties with the threshold is predicted 1; rows without an id are scored and are never examples; repeated
rows are scored one by one; an example with several texts has the smallest; texts are counted whole at any length; without
any labels every score is 0.5; an empty table gives an empty one; other columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches


@dataclass(frozen=True)
class Voting:
    examples: int = 4000  #: labelled texts at most
    features: int = 1 << 13  #: hashed terms
    width: int = 48  #: latent dimensions
    neighbours: int = 25
    sharpness: float = 8.0  #: a vote's weight is the similarity to this power
    seed: int = 5


SHAPE = re.compile(r"[A-ZÀ-Þ]+|[a-zß-ÿ]+|[0-9]+|\s+|.", re.S)


class Terms(dict):
    """Feature numbers of a word and of its shape, for words met before; bounded."""

    def __init__(self, features: int):
        super().__init__()
        self.features = features

    def __missing__(self, word: str) -> tuple[int, int]:
        import zlib

        if len(self) > 200_000:
            self.clear()
        half = self.features // 2
        # A word's shape: runs of capitals, of small letters and of digits by one sign each, other signs as they are.
        shape = "".join("A" if p[0].isupper() else "a" if p[0].isalpha() else "0" if p[0].isdigit() else p for p in SHAPE.findall(word))
        value = self[word] = (zlib.crc32(word.lower().encode()) % half, half + zlib.crc32(shape.encode()) % half)
        return value


def counted(texts: list[str | None], features: int, known: Terms) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, columns and weights of the term matrix; with the repetition of a text's words as terms too."""
    rows, columns, weights = [], [], []
    for i, text in enumerate(texts):
        words = (text or "").split()
        if not words:
            continue
        counts = Counter(words)
        total: Counter = Counter()
        for word, n in counts.items():
            a, b = known[word]
            total[a] += n
            total[b] += n
        pairs = Counter(zip(words, words[1:])) if len(words) > 1 else Counter()
        again = sum(n for n in pairs.values() if n > 1) / max(1, len(words) - 1)
        size = len(words)
        for column, n in total.items():
            rows.append(i)
            columns.append(column)
            weights.append(np.sqrt(n / size))
        # How much repeats, in steps, is a term like any other.
        rows.append(i)
        columns.append(features + int(min(again, 0.999) * 8))
        weights.append(0.5)
    return np.array(rows, dtype=np.int64), np.array(columns, dtype=np.int64), np.array(weights, dtype=np.float64)


class Space:
    """Term weights and latent axes of the examples, with their vectors and labels."""

    def __init__(self, terms: list[tuple[list[int], list[float]]], labels: list[int], how: Voting):
        """``terms``: columns and weights of each example, in the order of ids."""
        self.how, self.labels = how, np.array(labels, dtype=np.float64)
        self.total = how.features + 8
        rows = np.repeat(np.arange(len(terms)), [len(t[0]) for t in terms])
        columns = np.array([c for t in terms for c in t[0]], dtype=np.int64)
        weights = np.array([w for t in terms for w in t[1]], dtype=np.float64)
        n = max(1, len(terms))
        seen = np.bincount(columns, minlength=self.total) if len(columns) else np.zeros(self.total)
        self.idf = np.where(seen > 0, np.log((1 + n) / (1 + seen)) + 0.2, 0.0)
        matrix = np.zeros((len(terms), self.total), dtype=np.float32)
        matrix[rows, columns] = weights * self.idf[columns]
        self.axes = np.zeros((self.total, 1), dtype=np.float32)
        if len(terms):
            # Randomised decomposition: a few passes over the matrix give its leading right singular vectors.
            draw = np.random.default_rng(how.seed)
            width = min(how.width, *matrix.shape)
            basis = matrix @ draw.standard_normal((self.total, width + 10)).astype(np.float32)
            for _ in range(4):
                basis = matrix @ (matrix.T @ np.linalg.qr(basis)[0])
            basis = np.linalg.qr(basis)[0]
            self.axes = np.linalg.svd(basis.T @ matrix, full_matrices=False)[2][:width].T.astype(np.float32)
        self.vectors = unit(matrix @ self.axes)
        self.prior = float(self.labels.mean()) if len(self.labels) else 0.5

    def latent(self, texts: list[str | None], known: Terms) -> np.ndarray:
        rows, columns, weights = counted(texts, self.how.features, known)
        latent = np.zeros((len(texts), self.axes.shape[1]), dtype=np.float32)
        cuts = np.searchsorted(rows, np.arange(len(texts) + 1))
        for i in range(len(texts)):
            part = slice(cuts[i], cuts[i + 1])
            latent[i] = (weights[part] * self.idf[columns[part]]).astype(np.float32) @ self.axes[columns[part]]
        return latent

    def scores(self, texts: list[str | None], known: Terms) -> list[float]:
        """Weighted shares of good labels among the nearest examples, for one block of texts."""
        latent = self.latent(texts, known)
        found = np.full(len(texts), self.prior)
        some = latent.any(axis=1)
        if not some.any() or not len(self.labels):
            return found.tolist()
        near = np.round(unit(latent[some]) @ self.vectors.T, 6)
        k = min(self.how.neighbours, near.shape[1])
        # All above the k-th similarity, and of those that have it the first.
        last = np.partition(near, -k, axis=1)[:, [-k]]
        ties = near == last
        chosen = near > last
        chosen |= ties & (np.cumsum(ties, axis=1) <= k - chosen.sum(1, keepdims=True))
        best = np.nonzero(chosen)[1].reshape(-1, k)
        votes = np.maximum(np.take_along_axis(near, best, axis=1), 1e-6).astype(np.float64) ** self.how.sharpness
        found[some] = (votes * self.labels[best]).sum(1) / votes.sum(1)
        return np.clip(found, 0, 1).tolist()


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def held_out(id_col: str):
    return F.coalesce(F.crc32(F.col(f"`{id_col}`").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, how: Voting, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Space:
    """The space of the labelled texts outside the held-out part."""
    marked = labels.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").cast("int").alias("label")).where(f"id is not null and label in (0, 1) and crc32(cast(cast(id as string) as binary)) % 5 <> 0").groupBy("id").agg(F.min("label").alias("label"))
    half = how.examples // 2
    # At most half the examples from each label, by a hash of the id: top-k per label, then only these texts are read.
    chosen = [marked.where(F.col("label") == v).orderBy(F.xxhash64("id"), "id").limit(half) for v in (0, 1)]
    picked = chosen[0].unionByName(chosen[1])
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")).join(F.broadcast(picked), "id").groupBy("id").agg(F.min("label").alias("label"), F.min("text").alias("text"))

    def run(batch: dict) -> dict:
        known = Terms(how.features)
        found = [counted([t], how.features, known)[1:] for t in batch["text"]]
        return {"id": batch["id"], "label": batch["label"], "columns": [c for c, _ in found], "weights": [w for _, w in found]}

    kind = rows.schema["id"].dataType.simpleString()
    made = sorted(map_batches(rows.select("id", "label", "text"), run, f"id {kind}, label int, columns array<int>, weights array<double>").collect(), key=lambda r: r["id"])
    return Space([(r["columns"], r["weights"]) for r in made], [r["label"] for r in made], how)


BLOCK = 512  #: texts whose cosines are computed at once


def score(docs: DataFrame, space: Space, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, held_out, score, predicted`` for every text: one scan."""
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(space)
    known: dict[int, Terms] = {}

    def run(rows: dict) -> dict:
        space = sent.value
        terms = known.setdefault(0, Terms(space.how.features))
        scores = [s for i in range(0, len(rows["text"]), BLOCK) for s in space.scores(rows["text"][i : i + BLOCK], terms)]
        return {"id": rows["id"], "held_out": rows["held_out"], "score": scores, "predicted": [int(s >= threshold) for s in scores]}

    kind = docs.schema[id_col].dataType.simpleString()
    frame = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"), held_out(id_col).alias("held_out"))
    return map_batches(frame, run, f"id {kind}, held_out boolean, score double, predicted int").withColumnRenamed("id", id_col)


def classify(docs: DataFrame, labels: DataFrame, how: Voting | None = None, threshold: float = 0.3) -> DataFrame:
    return score(docs, fit(docs, labels, how or Voting()), threshold)
