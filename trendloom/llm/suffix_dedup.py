"""Repeated passages by suffix order: bytes in a 50-byte string that a document with a smaller id has too.

Strings that repeat are found by the order of suffixes and their common prefixes, built column-wise over many
strings at once: each round puts one more symbol in front of every string's suffix, keeps the order from the round
before as the tie-break and updates the common prefixes of neighbours from those of the round before.

Whole documents as strings would need a round for each byte of the longest one, over the whole collection. So the
strings are contexts: of each window of ``length`` bytes, the GRAM bytes with the smallest hash anchor it (all of them, if
several are equal); equal windows have the same anchors at the same places. Anchors that only one document has are
dropped; the rest are cut out with what surrounds them in windows, all of one width, and dealt by anchor. Each part is
one sorted collection of at most WIDTH rounds, in which equal windows are met in the same round.

Rows are packed first, as they are read and without a shuffle, into packs of some megabytes, each a row of a table.
All steps work on whole packs, and what travels is a row for each pack and part: a pack's anchors, each once; bits that
tell which of them others have; its contexts, each once and for its smallest id; bits of their repeated windows. What
comes back needs no ids and no places, as a pack makes the same lists again. So a passage that a third of all documents
share sends one context for each pack, however many documents of the pack have it and however often. The rows are as
many as the blocks of a shuffle of packs to parts, and never more than the anchors.

An anchor that very many different contexts share (a short phrase with other words around it each time) would bring them
all to one part. Its windows are dealt one by one instead, each by its own bytes: after folding in the packs, that is a row
for each pack and different window.

The packs' and parts' tables are written to the shared folder between steps: these are the sequential external files.

Defined results: a null text is the empty one (``cut`` leaves it null); texts under ``length`` bytes lose nothing; rows
without an id are compared with nothing and lose nothing; rows of one id, with equal texts or others, don't remove each
other, and each loses what documents with smaller ids have; a very long text is a pack of its own, taken in chunks; an
empty table gives an empty one. Ties can't matter: only whether a smaller id has a string. Extra columns are kept by ``cut`` whatever
their names, and not read by ``removals``.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_schema, discard, materialize, partitions
from .minmax import STEP, mixed

LENGTH = 50
GRAM = 18
WINDOW = LENGTH - GRAM + 1  #: anchors to choose from
EDGE = WINDOW - 1  #: bytes of a context before and behind its anchor
WIDTH = LENGTH + EDGE  #: of a context: all windows that hold the anchor
CHUNK = 1 << 20
PAD = 255  #: no byte of UTF-8
ENTRY = np.dtype([("hash", "<u8"), ("near", "<u2"), ("many", "u1")])
MOST = np.uint64((1 << 64) - 1)


@dataclass(frozen=True)
class Sizes:
    """What bounds memory; no result depends on it."""

    pack_bytes: int = 4 << 20
    anchors_in_part: int = 1_500_000
    bytes_in_part: int = 4 << 20
    hot: int = 1 << 16  #: different contexts of an anchor from which its windows are dealt one by one


def packs(docs: DataFrame, pack_bytes: int) -> DataFrame:
    """``pack, bytes, blob``: rows in the order in which they are read; the first column is the id, the second the text."""
    schema = "bytes bigint, blob binary"

    def run(batches):
        held, size = [], 0

        def packed():
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, held[0].schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                for batch in held:
                    out.write_batch(batch)
            return pa.RecordBatch.from_pydict({"bytes": [size], "blob": [sink.getvalue().to_pybytes()]}, schema=pa.schema([("bytes", pa.int64()), ("blob", pa.binary())]))

        for batch in batches:
            sizes = np.array([len(t) if t else 0 for t in batch.column(1).cast(pa.binary()).to_pylist()], dtype=np.int64)
            at = 0
            while at < batch.num_rows:
                # Up to the row with which the pack is full.
                upto = min(batch.num_rows, at + int(np.searchsorted(np.cumsum(sizes[at:]) + size, pack_bytes)) + 1)
                held.append(batch.slice(at, upto - at))
                size, at = size + int(sizes[at:upto].sum()), upto
                if size >= pack_bytes:
                    yield packed()
                    held, size = [], 0
        if held:
            yield packed()

    return docs.mapInArrow(run, schema).withColumn("pack", F.monotonically_increasing_id()).select("pack", "bytes", "blob")


class Pack:
    """The rows of a pack and their texts in one buffer, apart by PAD."""

    def __init__(self, blob: bytes) -> None:
        self.rows = pa.ipc.open_stream(blob).read_all().combine_chunks()
        ids, texts = self.rows.column(0).to_pylist(), [(t or "").encode() for t in self.rows.column(1).to_pylist()]
        self.texts = texts
        self.used = [i for i, (own, t) in enumerate(zip(ids, texts, strict=True)) if own is not None and len(t) >= LENGTH]
        self.ids = np.array([ids[i] for i in self.used], dtype=np.int64)
        sizes = np.array([len(texts[i]) for i in self.used], dtype=np.int64)
        self.start = LENGTH + np.concatenate([[0], np.cumsum(sizes + 1)[:-1]]) if len(sizes) else np.empty(0, np.int64)
        self.end = self.start + sizes
        pad = bytes([PAD])
        self.data = np.frombuffer(pad * LENGTH + b"".join(texts[i] + pad for i in self.used) + pad * LENGTH, np.uint8)

    def owner(self, place: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.start, place, "right") - 1

    def contexts(self, place: np.ndarray, alone: np.ndarray) -> np.ndarray:
        """What surrounds the anchors, PAD beyond the text; for ``alone`` only the window that starts EDGE bytes before."""
        rows = np.lib.stride_tricks.sliding_window_view(self.data, WIDTH)[place - EDGE]
        cut = np.flatnonzero((rows == PAD).any(1))
        if len(cut):
            out = rows[cut] == PAD
            out[:, :EDGE] = np.logical_or.accumulate(out[:, EDGE - 1 :: -1], axis=1)[:, ::-1]
            out[:, LENGTH:] = np.logical_or.accumulate(out[:, LENGTH:], axis=1)
            rows[cut] = np.where(out, PAD, rows[cut])
        rows[alone, LENGTH:] = PAD
        return rows


def anchors(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places, ascending, and hashes of a buffer's anchors; taken in overlapping chunks."""
    places, hashes = [np.empty(0, np.int64)], [np.empty(0, np.uint64)]
    for at in range(0, max(0, len(data) - LENGTH + 1), CHUNK):
        place, value = anchors_of(data[at : at + CHUNK + LENGTH - 1])
        places.append(place + at)
        hashes.append(value)
    place, first = np.unique(np.concatenate(places), return_index=True)
    return place, np.concatenate(hashes)[first]


def anchors_of(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = len(data) - GRAM + 1
    # Hash of every GRAM bytes: runs of 1, 2, 4, ... bytes are joined from two halves.
    runs, size, gram, at = data.astype(np.uint64) + np.uint64(1), 1, np.zeros(n, np.uint64), 0
    left = GRAM
    while left:
        if left & size:
            gram = gram * STEP + runs[at : at + n]
            at, left = at + size, left - size
        if left:
            runs = mixed(runs[:-size] * STEP + runs[size:])
            size *= 2
    gram = mixed(gram)
    ends = np.concatenate([[0], np.cumsum(data == PAD, dtype=np.int32)])
    outside = ends[GRAM:] > ends[:-GRAM]
    gram[outside] = MOST
    least = slid(np.minimum, gram)
    # A gram is an anchor if it is the least of a window that holds it; the largest of these least ones is then its own.
    # Windows over the end of a text may make it an anchor as well, which only adds a context.
    inner = least.copy()
    inner[least == MOST] = 0
    edge = np.zeros(EDGE, np.uint64)
    place = np.flatnonzero((slid(np.maximum, np.concatenate([edge, inner, edge])) == gram) & ~outside)
    return place, gram[place]


def slid(pick: np.ufunc, values: np.ndarray) -> np.ndarray:
    """``pick`` over each WINDOW values in a row, by doubling."""
    out, size = values, 1
    while size * 2 <= WINDOW:
        out = pick(out[:-size], out[size:])
        size *= 2
    n = len(values) - WINDOW + 1
    return pick(out[:n], out[WINDOW - size : WINDOW - size + n])


class Anchors:
    """A pack's anchors, and the different ones among them in the order of parts and hashes."""

    def __init__(self, pack: Pack, parts: int) -> None:
        self.place, value = anchors(pack.data)
        self.owner = pack.owner(self.place)
        order = np.argsort(value, kind="stable")
        order = order[np.argsort(value[order] % np.uint64(parts), kind="stable")]
        sorted_value = value[order]
        first = heads(sorted_value)
        self.hash = sorted_value[first]
        self.part = (self.hash % np.uint64(parts)).astype(np.int64)
        self.group = np.empty(len(value), np.int64)
        self.group[order] = np.cumsum(first) - 1
        # Whether several documents of the pack have it.
        ids = pack.ids[self.owner]
        low, high = np.full(len(self.hash), np.iinfo(np.int64).max), np.full(len(self.hash), np.iinfo(np.int64).min)
        np.minimum.at(low, self.group, ids)
        np.maximum.at(high, self.group, ids)
        self.several = low != high

    def entries(self, pack: Pack) -> np.ndarray:
        """Hash, a sign of what is near it (the least), and the binary logarithm of how many different there are."""
        view = np.lib.stride_tricks.sliding_window_view(pack.data, 8)
        near = mixed(view[self.place - 8].view("<u8").ravel() * STEP + view[self.place + GRAM].view("<u8").ravel())
        order = np.lexsort((near, self.group))
        group, near = self.group[order], near[order]
        first = heads(group)
        many = np.bincount(group[first | np.append(False, near[1:] != near[:-1])] if len(group) else group, minlength=len(self.hash))
        out = np.empty(len(self.hash), ENTRY)
        out["hash"], out["near"], out["many"] = self.hash, (near[first] >> np.uint64(48)).astype(np.uint16), np.ceil(np.log2(np.maximum(many, 1)))
        return out


def heads(values: np.ndarray) -> np.ndarray:
    return np.append(True, values[1:] != values[:-1]) if len(values) else np.empty(0, bool)


def by_part(part: np.ndarray) -> Iterator[tuple[int, slice]]:
    """Parts, ascending in ``part``, and where they are."""
    cuts = np.append(np.flatnonzero(heads(part)), len(part))
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        yield int(part[a]), slice(a, b)


def written(rows: list[tuple], target: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(target)], schema=target)


def by_groups(batches, decide, target: pa.Schema):
    """``decide`` on the rows of each part; rows come sorted by part, the first column."""
    now, held = None, []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if held and row[0] != now:
                yield written(decide(held), target)
                held = []
            now = row[0]
            held.append(row)
    if held:
        yield written(decide(held), target)


def shared_anchors(packed: DataFrame, parts: int, hot_from: int) -> DataFrame:
    """``pack, part, shared, hot``: bits of a pack's anchors in a part, in their order; shared by other packs, and hot."""
    spark = packed.sparkSession
    schema, out_schema = "part int, pack bigint, entries binary", "pack bigint, part int, shared binary, hot binary"
    target, out_target = arrow_schema(spark, schema), arrow_schema(spark, out_schema)

    def send(batches):
        for batch in batches:
            for own, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                pack = Pack(blob.as_buffer())
                found = Anchors(pack, parts)
                entries = found.entries(pack)
                yield written([(p, own, entries[at].tobytes()) for p, at in by_part(found.part)], target)

    def decide(rows: list[tuple]) -> list[tuple]:
        entries = np.concatenate([np.frombuffer(r[2], ENTRY) for r in rows])
        order = np.argsort(entries["hash"], kind="stable")
        first = heads(entries["hash"][order])
        group = np.cumsum(first) - 1
        shared, hot = np.zeros(len(entries), bool), np.zeros(len(entries), bool)
        shared[order] = np.bincount(group)[group] > 1
        hot[order] = too_many(group, entries[order], hot_from)[group]
        out, at = [], 0
        for _, own, content in rows:
            upto = at + len(content) // ENTRY.itemsize
            if shared[at:upto].any() or hot[at:upto].any():
                out.append((own, rows[0][0], np.packbits(shared[at:upto]).tobytes(), np.packbits(hot[at:upto]).tobytes()))
            at = upto
        return out

    sent = packed.select("pack", "blob").mapInArrow(send, schema)
    return sent.repartition(parts, "part").sortWithinPartitions("part").mapInArrow(lambda batches: by_groups(batches, decide, out_target), out_schema)


def too_many(group: np.ndarray, entries: np.ndarray, hot_from: int) -> np.ndarray:
    """Whether a group has ``hot_from`` contexts or more. Packs with the same sign (as copies have) count once, by the most of them."""
    count = np.exp2(entries["many"].astype(np.float64))
    hot = np.bincount(group, weights=count) >= hot_from
    some = hot[group]
    own, sign, count = group[some], entries["near"][some], count[some]
    order = np.lexsort((-count, sign, own))
    own, sign, count = own[order], sign[order], count[order]
    first = heads(own) | heads(sign)
    hot[hot] = np.bincount(own[first], weights=count[first], minlength=len(hot))[hot] >= hot_from
    return hot


class Contexts:
    """A pack's contexts of shared anchors, and the different ones among them in the order of parts."""

    def __init__(self, pack: Pack, shared_parts: int, parts: int, flags: list) -> None:
        found = Anchors(pack, shared_parts)
        shared, hot = found.several.copy(), np.zeros(len(found.hash), bool)
        told = {f["part"]: f for f in flags or []}
        for part, at in by_part(found.part):
            if part in told:
                n = at.stop - at.start
                shared[at] |= np.unpackbits(np.frombuffer(told[part]["shared"], np.uint8), count=n).astype(bool)
                hot[at] = np.unpackbits(np.frombuffer(told[part]["hot"], np.uint8), count=n)
        shared, hot = shared[found.group], hot[found.group]
        # Each window of a hot anchor stands alone, as a context whose anchor is EDGE bytes behind its start.
        place, owner = found.place[hot], found.owner[hot]
        start = (place[:, None] - np.arange(EDGE, -1, -1))
        start = np.unique(start[(start >= pack.start[owner][:, None]) & (start + LENGTH <= pack.end[owner][:, None])])
        normal = shared & ~hot
        self.place = np.concatenate([found.place[normal], start + EDGE])
        self.alone = np.arange(len(self.place)) >= normal.sum()
        self.pack = pack
        self.ids = pack.ids[pack.owner(self.place - EDGE * self.alone)]
        key = np.empty(len(self.place), np.uint64)
        digest = np.zeros(len(self.place), np.uint64)
        for at in range(0, len(self.place), 1 << 16):
            rows = self.rows(np.arange(at, min(at + (1 << 16), len(self.place))))
            padded = np.zeros((len(rows), -(-WIDTH // 8) * 8), np.uint8)
            padded[:, :WIDTH] = rows
            for word in padded.view(np.uint64).T:
                digest[at : at + len(rows)] = mixed(digest[at : at + len(rows)] * STEP + word)
        key[~self.alone], key[self.alone] = found.hash[found.group[normal]], digest[self.alone]
        part = (key % np.uint64(parts)).astype(np.int64)
        order = np.lexsort((self.ids, digest, part))
        first = heads(digest[order]) | heads(part[order])
        self.group = np.empty(len(order), np.int64)
        self.group[order] = np.cumsum(first) - 1
        self.head = order[first]  # of each group one with the smallest id
        self.part = part[self.head]
        # Rows with another's digest but other bytes are groups of their own.
        for at in range(0, len(order), 1 << 16):
            index = np.arange(at, min(at + (1 << 16), len(order)))
            odd = index[(self.rows(index) != self.rows(self.head[self.group[index]])).any(1)]
            for i in odd.tolist():
                self.group[i] = len(self.head)
                self.head, self.part = np.append(self.head, i), np.append(self.part, part[i])
        moved = np.argsort(self.part, kind="stable")
        back = np.empty(len(moved), np.int64)
        back[moved] = np.arange(len(moved))
        self.group, self.head, self.part = back[self.group], self.head[moved], self.part[moved]

    def rows(self, index: np.ndarray) -> np.ndarray:
        return self.pack.contexts(self.place[index], self.alone[index])


def inside(rows: np.ndarray) -> np.ndarray:
    """The windows, as bits, that lie in the text."""
    bits = np.zeros(len(rows), np.uint64)
    for c in range(WINDOW):
        bits |= ((rows[:, c] != PAD) & (rows[:, c + LENGTH - 1] != PAD)).astype(np.uint64) << np.uint64(c)
    return bits


def repeated(rows: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """Windows, as bits, of each context that a context of a smaller document has at the same place.

    Column-wise: after the round of column c, ``order`` sorts the suffixes from c on and ``common`` holds the
    common prefix of each with the one before. ``symbol`` is the round's part of the collection's transform: what stands
    before the suffixes of the round before, in their order. Parts of earlier rounds are read by none later.
    """
    n = len(rows)
    order, common = np.arange(n), np.zeros(n + 1, np.uint8)
    found = np.zeros(n, np.uint64)
    for c in range(WIDTH - 1, -1, -1):
        symbol = rows[order, c]
        moved = np.argsort(symbol, kind="stable")  # the last-to-first step: equal symbols keep their order
        same = np.flatnonzero(symbol[moved][1:] == symbol[moved][:-1]) + 1
        new = np.zeros(n + 1, np.uint8)
        if len(same):
            # What two neighbours had in common from c + 1 on is the least over all that lay between them.
            spans = np.stack([moved[same - 1] + 1, moved[same] + 1], axis=1).ravel()
            new[same] = 1 + np.minimum.reduceat(common, spans)[::2]
        order, common = order[moved], new
        if c < WINDOW:
            start = np.flatnonzero(common[:n] < LENGTH)
            low = np.minimum.reduceat(docs[order], start)
            later = docs[order] > np.repeat(low, np.diff(np.append(start, n)))
            found[order[later]] |= np.uint64(1 << c)
    return found & inside(rows)


def verdicts(flagged: DataFrame, shared_parts: int, parts: int) -> DataFrame:
    """``pack, part, windows``: the repeated windows of a pack's contexts in a part, in their order."""
    spark = flagged.sparkSession
    schema, out_schema = "part int, pack bigint, docs binary, rows binary", "pack bigint, part int, windows binary"
    target, out_target = arrow_schema(spark, schema), arrow_schema(spark, out_schema)

    def send(batches):
        for batch in batches:
            for own, blob, flags in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                found = Contexts(Pack(blob.as_buffer()), shared_parts, parts, flags)
                for p, at in by_part(found.part):
                    head = found.head[at]
                    yield written([(p, own, found.ids[head].tobytes(), found.rows(head).tobytes())], target)

    def decide(rows: list[tuple]) -> list[tuple]:
        docs, content = np.concatenate([np.frombuffer(r[2], np.int64) for r in rows]), np.concatenate([np.frombuffer(r[3], np.uint8).reshape(-1, WIDTH) for r in rows])
        windows, out, at = repeated(content, docs), [], 0
        for _, own, ids, _ in rows:
            upto = at + len(ids) // 8
            if windows[at:upto].any():
                out.append((own, rows[0][0], windows[at:upto].tobytes()))
            at = upto
        return out

    sent = flagged.select("pack", "blob", "flags").mapInArrow(send, schema)
    return sent.repartition(parts, "part").sortWithinPartitions("part").mapInArrow(lambda batches: by_groups(batches, decide, out_target), out_schema)


def covered(pack: Pack, found: Contexts, told: list) -> np.ndarray:
    """True for each byte of the buffer to be removed."""
    windows = np.zeros(len(found.head), np.uint64)
    by_number = {w["part"]: w["windows"] for w in told or []}
    for part, at in by_part(found.part):
        if part in by_number:
            windows[at] = np.frombuffer(by_number[part], np.uint64)
    starts = np.zeros(len(pack.data), bool)
    low = found.ids[found.head]
    step = np.arange(WINDOW)
    for at in range(0, len(found.place), 1 << 14):
        index = np.arange(at, min(at + (1 << 14), len(found.place)))
        group = found.group[index]
        bits = windows[group]
        later = found.ids[index] > low[group]  # the pack has it in a smaller document
        if later.any():
            bits[later] |= inside(found.rows(index[later]))
        some = bits > 0
        marked = (bits[some][:, None] >> step.astype(np.uint64)) & np.uint64(1) == 1
        starts[(found.place[index[some]][:, None] - EDGE + step)[marked]] = True
    gone = np.zeros(len(pack.data), bool)
    for at in range(0, len(gone), CHUNK):
        begin = max(0, at - LENGTH + 1)  # a window starts in the last LENGTH bytes
        met = np.concatenate([np.zeros(LENGTH, np.int32), np.cumsum(starts[begin : at + CHUNK], dtype=np.int32)])
        gone[at : at + CHUNK] = (met[LENGTH:] > met[:-LENGTH])[at - begin :]
    return gone


def decided(docs: DataFrame, made, schema, sizes: Sizes) -> DataFrame:
    """``made(pack, gone by row)`` of all packs; the first column of ``docs`` is the id, the second the text."""
    spark = docs.sparkSession
    packed = materialize(packs(docs, sizes.pack_bytes), "packs")
    total = packed.agg(F.sum("bytes")).first()[0] or 0
    shared_parts = max(partitions(spark), math.ceil(total * 2 / (WINDOW + 1) / sizes.anchors_in_part))
    parts = max(partitions(spark), math.ceil(total / sizes.bytes_in_part))
    flags = materialize(shared_anchors(packed, shared_parts, sizes.hot), "anchors")
    flags_of = flags.groupBy("pack").agg(F.collect_list(F.struct("part", "shared", "hot")).alias("flags"))
    told = materialize(verdicts(packed.select("pack", "blob").join(flags_of, "pack", "left"), shared_parts, parts), "verdicts")
    told_of = told.groupBy("pack").agg(F.collect_list(F.struct("part", "windows")).alias("told"))

    def run(batches):
        for batch in batches:
            for blob, own_flags, own_told in zip(batch.column(0), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                pack = Pack(blob.as_buffer())
                gone = covered(pack, Contexts(pack, shared_parts, parts, own_flags), own_told)
                by_row = dict.fromkeys(range(pack.rows.num_rows))
                for k, i in enumerate(pack.used):
                    mask = gone[pack.start[k] : pack.end[k]]
                    by_row[i] = mask if mask.any() else None
                yield from made(pack, list(by_row.values()))

    whole = packed.select("pack", "blob").join(flags_of, "pack", "left").join(told_of, "pack", "left")
    done = materialize(whole.select("blob", "flags", "told").mapInArrow(run, schema), "passages")
    discard(packed, flags, told)
    return done


def removals(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sizes: Sizes | None = None) -> DataFrame:
    """``id, n_bytes, n_removed, n_spans, kept_sha256`` for every row."""
    schema = "doc bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string"
    target = arrow_schema(docs.sparkSession, schema)

    def made(pack: Pack, gone: list):
        out = []
        for doc, content, mask in zip(pack.rows.column(0).to_pylist(), pack.texts, gone, strict=True):
            rest, lost, spans = content, 0, 0
            if mask is not None:
                rest = np.frombuffer(content, np.uint8)[~mask].tobytes()
                lost, spans = int(mask.sum()), int(mask[:1].sum() + (mask[1:] & ~mask[:-1]).sum())
            out.append((doc, len(content), lost, spans, hashlib.sha256(rest).hexdigest()))
        yield written(out, target)

    frame = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("doc"), F.col(f"`{text_col}`").cast("string").alias("content"))
    return decided(frame, made, schema, sizes or Sizes()).withColumnRenamed("doc", id_col)


def cut(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sizes: Sizes | None = None) -> DataFrame:
    """The documents, all columns, with repeated passages cut from the text.

    A character stays whole unless all of its bytes go. A text that is nothing but repeats becomes empty.
    """

    def shorter(text: bytes, gone: np.ndarray) -> str:
        content = np.frombuffer(text, np.uint8)
        start = np.flatnonzero((content & 0xC0) != 0x80)
        whole = np.logical_and.reduceat(gone, start)
        return content[~np.repeat(whole, np.diff(np.append(start, len(content))))].tobytes().decode()

    columns = docs.columns
    at = columns.index(text_col)

    def made(pack: Pack, gone: list):
        texts = [old if mask is None else shorter(text, mask) for old, text, mask in zip(pack.rows.column(1).to_pylist(), pack.texts, gone, strict=True)]
        kept = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in pack.rows.columns[2:]]
        kept = [c.chunk(0) if isinstance(c, pa.ChunkedArray) else c for c in kept]
        kept[at] = pa.array(texts, kept[at].type)
        table = pa.Table.from_arrays(kept, names=columns)
        yield from table.to_batches(max_chunksize=4096)

    # The text goes once: the column itself is null in the rest of the row.
    rest = [F.lit(None).cast(docs.schema[c].dataType).alias(f"c{i}") if i == at else docs[f"`{c}`"].alias(f"c{i}") for i, c in enumerate(columns)]
    return decided(docs.select(docs[f"`{id_col}`"].cast("bigint").alias("id"), docs[f"`{text_col}`"].alias("text"), *rest), made, docs.schema, sizes or Sizes())
