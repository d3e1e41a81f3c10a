"""Quality rules: word and symbol counts, repetition, and compression bands.

A zstandard ratio (compressed by plain bytes) of the whole document and of each fixed chunk must lie in a band that
depends on length: short texts compress badly, long ones well. Below the band a text repeats itself, above it it
is noise. A document goes if its whole ratio is outside, or if too many of its chunks are.

Wide limits by length are fixed. Within them, the corpus itself sets limits: of all texts whose length is in the same half
octave, the quartiles of the ratio, widened by multiples of their distance. Texts with the same length and ratio count
once, so a group of copies can't move them; a half octave with fewer than ``Bands.enough`` such texts has the fixed
limits alone. The histogram behind it has at most some hundred thousand rows, whatever the corpus, and a limit is a row
for each half octave. Chunks have the limits of texts of their length.

Defined results: null and empty texts have no words, fail the base rule and have null ratios; repeated rows are
judged one by one, so they fare alike; a ratio on a limit is inside; texts are judged whole at any length; rows without
an id are judged like any other; an empty table gives an empty one; columns other than the id and the text are not
read, and ``keep`` returns them whatever their names.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, materialize

SYMBOLS = "#*$%&|<>"
BLANK = re.compile(r"[\x20\x09-\x0D]")


@dataclass(frozen=True)
class Bands:
    """Limits by length. ``bands``: (bytes from, lowest ratio, highest ratio); below the first length none holds."""

    bands: tuple[tuple[int, float, float], ...] = ((128, 0.16, 1.15), (512, 0.20, 0.98), (4096, 0.20, 0.90), (65536, 0.15, 0.85))
    below: float = 2.0  #: quartile distances under the lower quartile
    above: float = 3.0  #: and over the upper one
    least_distance: float = 0.008  #: between quartiles, so that texts much alike make no sharp limit
    enough: int = 100  #: different texts of a half octave
    chunk_bytes: int = 4096
    chunk_share: float = 0.5  #: of chunks outside their band, more than this reject
    level: int = 3
    min_words: int = 50
    max_repeat_percent: int = 50


Limits = dict[int, tuple[float, float]]  #: by half octave


def octave(n_bytes: int) -> int:
    return math.floor(2 * math.log2(n_bytes))


def limits_of(rules: Bands, told: Limits, n_bytes: int) -> tuple[float, float]:
    """Lowest and highest ratio of a text or chunk of this length."""
    low, high = 0.0, math.inf
    for least, lowest, highest in rules.bands:
        if n_bytes >= least:
            low, high = lowest, highest
    if high < math.inf and (own := told.get(octave(n_bytes))):
        low, high = max(low, own[0]), min(high, own[1])
    return low, high


def verdict(rules: Bands, told: Limits, n_bytes: int, ratio: float) -> int:
    """-1 repetitive, 1 incompressible, 0 inside."""
    low, high = limits_of(rules, told, n_bytes)
    return -1 if ratio < low else 1 if ratio > high else 0


def measured(docs: DataFrame, rules: Bands, text_col: str = "text") -> Limits:
    """The corpus' limits by half octave, from the ratios of all texts."""

    def run(rows: dict) -> dict:
        import zstandard

        press = zstandard.ZstdCompressor(level=rules.level)
        some = [t.encode() for t in rows["text"] if t]
        return {"n_bytes": [len(t) for t in some], "ratio": [round(len(press.compress(t)) / len(t), 4) for t in some]}

    ratios = map_batches(docs.select(F.col(f"`{text_col}`").alias("text")), run, "n_bytes bigint, ratio double")
    return quartile_limits(ratios, rules)


def quartile_limits(ratios: DataFrame, rules: Bands) -> Limits:
    """From ``n_bytes, ratio`` of texts."""
    once = ratios.where(F.col("n_bytes") >= rules.bands[0][0]).select("n_bytes", F.round("ratio", 4).alias("ratio")).distinct()
    histogram = once.withColumn("octave", F.floor(2 * F.log2("n_bytes")).cast("int")).groupBy("octave", "ratio").agg(F.count("*").alias("n"))
    rows = histogram.groupBy("octave").agg(F.sum("n").alias("n"), F.expr("percentile(ratio, array(0.25D, 0.75D), n)").alias("q")).where(F.col("n") >= rules.enough).collect()
    far = lambda q: max(q[1] - q[0], rules.least_distance)
    return {r["octave"]: (r["q"][0] - rules.below * far(r["q"]), r["q"][1] + rules.above * far(r["q"])) for r in rows}


def repeated_words(words: list[bytes]) -> int:
    """Words in windows of three that are found twice or more."""
    n = len(words)
    if n < 4:
        return 0
    ids: dict[bytes, int] = {}
    codes = np.fromiter((ids.setdefault(w, len(ids)) for w in words), dtype=np.int64, count=n)
    pairs = codes[:-1] * len(ids) + codes[1:]
    if len(ids) > 2_000_000:  # three codes no longer fit: pairs are numbered anew
        pairs = np.unique(pairs, return_inverse=True)[1]
    windows = pairs[:-1] * len(ids) + codes[2:]
    _, place, count = np.unique(windows, return_inverse=True, return_counts=True)
    twice = count[place] > 1
    inside = np.zeros(n, dtype=bool)
    for i in range(3):
        inside[i : i + n - 2] |= twice
    return int(inside.sum())


def repeated_lines(text: str) -> int:
    seen: set[str] = set()
    n = 0
    for line in text.split("\n"):
        if line and line in seen:
            n += bool(line.encode().split())
        else:
            seen.add(line)
    return n


def figures(rows: dict, rules: Bands) -> dict:
    """Base columns and ratios of a batch of texts."""
    import zstandard

    press = zstandard.ZstdCompressor(level=rules.level)
    ratio = lambda content: len(press.compress(content)) / len(content)
    out: dict[str, list] = {k: [] for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "n_bytes", "zstd_ratio", "chunk_ratios")}
    for text in rows["text"]:
        text = text or ""
        content = text.encode()
        words = content.split()  # bytes split at ASCII white space only
        n_repeat = repeated_words(words)
        failed = len(words) < rules.min_words or 100 * n_repeat > rules.max_repeat_percent * len(words)
        whole = ratio(content) if content else None
        cuts = range(0, len(content), rules.chunk_bytes)
        chunks = [ratio(content[i : i + rules.chunk_bytes]) for i in cuts] if len(cuts) > 1 else [whole] * len(cuts)
        for name, value in zip(out, (len(words), len(text) - len(BLANK.findall(text)), sum(map(text.count, SYMBOLS)), repeated_lines(text), n_repeat, failed, len(content), whole, chunks), strict=True):
            out[name].append(value)
    return out


FIGURES = "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, n_bytes bigint, zstd_ratio double, chunk_ratios array<double>"


def judge(rows: dict, rules: Bands, told: Limits) -> dict:
    """The verdict from figures."""
    out: dict[str, list] = {k: [] for k in ("kept", "n_chunks", "n_chunks_out", "band")}
    for failed, n_bytes, whole, chunks in zip(rows["base_failed"], rows["n_bytes"], rows["zstd_ratio"], rows["chunk_ratios"], strict=True):
        band = verdict(rules, told, n_bytes, whole) if n_bytes else 0
        n_out = sum(verdict(rules, told, min(rules.chunk_bytes, n_bytes - i * rules.chunk_bytes), r) != 0 for i, r in enumerate(chunks))
        for name, value in zip(out, (not failed and not band and n_out <= rules.chunk_share * len(chunks), len(chunks), n_out, band), strict=True):
            out[name].append(value)
    return out


BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]


def score(docs: DataFrame, rules: Bands | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row of figures and the verdict for every document: one scan of the texts, the rest on figures.

    ``id``, the base columns, ``kept, zstd_ratio, n_chunks, n_chunks_out, band`` (-1 repetitive, 1 incompressible).
    """
    rules = rules or Bands()
    kind = docs.schema[id_col].dataType.simpleString()
    frame = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    made = materialize(map_batches(frame, lambda rows: {"id": rows["id"]} | figures(rows, rules), f"id {kind}, {FIGURES}"), "figures")
    told = quartile_limits(made.where("zstd_ratio IS NOT NULL").select("n_bytes", F.col("zstd_ratio").alias("ratio")), rules)
    kept = [c for c in ("id", *BASE, "zstd_ratio")]
    schema = f"id {kind}, {FIGURES.split(', n_bytes')[0]}, zstd_ratio double, kept boolean, n_chunks int, n_chunks_out int, band int"
    judged = map_batches(made, lambda rows: {c: rows[c] for c in kept} | judge(rows, rules, told), schema)
    return judged.select(F.col("id").alias(id_col), *BASE, "kept", "zstd_ratio", "n_chunks", "n_chunks_out", "band")


def keep(docs: DataFrame, rules: Bands | None = None, text_col: str = "text") -> DataFrame:
    """The documents, all columns, that the rules keep: a pass for the corpus' limits and one that filters."""
    rules = rules or Bands()
    told = measured(docs, rules, text_col)

    @F.pandas_udf("boolean")
    def good(texts):
        import pandas as pd

        return pd.Series(judge(figures({"text": list(texts)}, rules), rules, told)["kept"], dtype=bool)

    return docs.filter(good(F.col(f"`{text_col}`")))
