"""Fill-in-the-middle: a text is cut at two token bounds and its pieces change places.

A text becomes an array of code points (UTF-32 read by numpy). A token is a run of ASCII letters or any other single code
point, so a token starts wherever the code point is no letter or its left neighbour is none: ``flatnonzero`` over the two
compared classes gives all starts. Two hashed ranks index that array; the code points between them are sliced and encoded
again. What is drawn depends on the seed and the id alone, so a repeated or lost task draws the same.

Forms: ``plain`` (the text as it is), ``psm`` (prefix, suffix, middle) and ``spm`` (suffix, prefix, middle), each piece after
its mark. A text that has a mark in it stays plain, hence :func:`restored` is exact: no mark can begin inside a piece and
end in a mark, as a mark has its ``<`` and ``>`` at its ends only.

Defined results: null and empty texts are plain, have no tokens and give an empty output; a null id is drawn as the empty
string; repeated rows and rows with one id give the same result each; texts are cut whole at any length; an empty table
gives an empty one; columns other than the id and the text are not read, so their names can't clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BATCH_BYTES, arrow_schema

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"


@dataclass(frozen=True)
class FillMiddle:
    seed: int = 1
    changed_percent: int = 90  #: of texts that aren't left plain
    spm_percent: int = 20  #: of those, suffix first


def token_starts(codes: np.ndarray) -> np.ndarray:
    """Places where a token starts."""
    folded = codes | 0x20
    letter = (folded >= 0x61) & (folded <= 0x7A)
    inside = letter.copy()
    inside[:1] = False
    inside[1:] &= letter[:-1]
    return np.flatnonzero(~inside)


def draws(seed: int, key: object) -> tuple[int, int, int, int]:
    digits = hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()
    return tuple(int(digits[i : i + 8], 16) for i in range(0, 32, 8))


def rearranged(text: str, key: object, how: FillMiddle) -> tuple[int, str, int | None, int | None, str]:
    """Tokens, form, code points of prefix and middle, output."""
    codes = np.frombuffer(text.encode("utf-32-le"), dtype="<u4")
    starts = token_starts(codes)
    n = len(starts)
    h1, h2, h3, h4 = draws(how.seed, key)
    if not text or any(mark in text for mark in (PREFIX, SUFFIX, MIDDLE)) or h3 % 100 >= how.changed_percent:
        return n, "plain", None, None, text
    bounds = np.append(starts, len(codes))
    a, b = (int(bounds[rank]) for rank in sorted((h1 % (n + 1), h2 % (n + 1))))
    prefix, middle, suffix = (codes[i:j].tobytes().decode("utf-32-le") for i, j in ((0, a), (a, b), (b, len(codes))))
    if h4 % 100 < how.spm_percent:
        return n, "spm", a, b - a, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return n, "psm", a, b - a, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


def fill_middle(docs: DataFrame, how: FillMiddle | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, n, form, prefix_chars, middle_chars, output`` for every row of ``docs``; one scan, no shuffle."""
    how = how or FillMiddle()
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, n bigint, form string, prefix_chars bigint, middle_chars bigint, output string"
    target = arrow_schema(docs.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []

        def flushed() -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True))
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(v, type=f.type) for v, f in zip(columns, target, strict=True)], schema=target)

        for batch in batches:
            size = 0
            for key, text in zip(batch["id"], batch["text"], strict=True):  # values one by one: a batch never is in Python as a whole
                key, text = key.as_py(), text.as_py() or ""
                rows.append((key, *rearranged(text, key, how)))
                size += 4 * len(text)
                if size > BATCH_BYTES:
                    yield flushed()
                    size = 0
            if rows:
                yield flushed()

    frame = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    return frame.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def restored(form: Column, output: Column) -> Column:
    """The exact text from an output and its form."""
    width = len(PREFIX)

    def pieces(second: str) -> tuple[Column, Column, Column]:
        body = F.substr(output, F.lit(width + 1))
        first = F.substring_index(body, second, 1)
        rest = F.substr(body, F.length(first) + width + 1)
        other = F.substring_index(rest, MIDDLE, 1)
        return first, other, F.substr(rest, F.length(other) + width + 1)

    prefix, suffix, middle = pieces(SUFFIX)
    late_suffix, late_prefix, late_middle = pieces(PREFIX)
    return F.when(form == "psm", F.concat(prefix, middle, suffix)).when(form == "spm", F.concat(late_prefix, late_middle, late_suffix)).otherwise(output)
