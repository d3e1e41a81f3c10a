"""Byte-level BPE encoding and decoding with the ``tokenizers`` library over Arrow batches.

The vocabulary comes as ranks (base64 token, rank). The library's byte-level step cuts a text by the pattern and writes
bytes as printable characters, one for one; its model merges them and its encodings tell the offsets in code points. What
it returned for a part of a text between single spaces is kept, in a bounded memory, and not asked for again. Decoding
reads the tokens' characters back through the byte table and joins bytes, so characters that tokens split come back whole.

Defined results: a null text is the empty text; the empty text has no tokens; of equal ranks there is none, so no ties;
repeated rows and rows without an id are encoded one by one; texts of any length are encoded whole; an empty table gives an
empty one; other columns are not read.
"""

from __future__ import annotations

import array
import base64
import functools
import hashlib
import os
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches


@functools.lru_cache(1)
def byte_characters() -> list[str]:
    """The character of each byte: itself where it is printable Latin-1, else the next one from U+0100 on."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


class ByteBpe:
    """Encoder and decoder of one rank file."""

    def __init__(self, path: str, pattern: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # tasks are the parallelism
        from tokenizers import Regex, Tokenizer, models, pre_tokenizers

        ranks = read_ranks(path)
        chars = byte_characters()
        written = {token: "".join(map(chars.__getitem__, token)) for token in ranks}
        # Any two tokens that make up a third may merge, at the third's rank: so all splits are listed, by rank.
        merges = [
            (written[token[:i]], written[token[i:]])
            for token, _ in sorted(ranks.items(), key=lambda item: item[1])
            for i in range(1, len(token))
            if token[:i] in ranks and token[i:] in ranks
        ]
        self.tokenizer = Tokenizer(models.BPE(vocab={written[t]: r for t, r in ranks.items()}, merges=merges, ignore_merges=True))
        bytewise = pre_tokenizers.ByteLevel(add_prefix_space=False, trim_offsets=False, use_regex=pattern == BUILT_IN)
        self.tokenizer.pre_tokenizer = bytewise if pattern == BUILT_IN else pre_tokenizers.Sequence([pre_tokenizers.Split(Regex(pattern), "isolated"), bytewise])
        self.parted = pattern == BUILT_IN
        table = {char: byte for byte, char in enumerate(chars)}
        self.bytes_of = {i: bytes(map(table.__getitem__, token)) for token, i in self.tokenizer.get_vocab().items()}
        every = range(max(self.bytes_of, default=-1) + 1)
        self.all_bytes = pa.array([self.bytes_of.get(i, b"") for i in every], pa.binary())
        self.all_numbers = pa.array([f"{i},".encode() for i in every], pa.binary())
        self.fresh: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def asked(self, texts: list[str]) -> list[bytes]:
        """Ids of texts from the library, as 32-bit integers one after the other."""
        # One call for all: a call costs more than many parts.
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False) if texts else []
        return [array.array("i", e.ids).tobytes() for e in found]

    def ids_of(self, parts: list[str]) -> list[bytes]:
        """Ids of different parts, remembered ones without the library."""
        known = self.fresh
        rest = []
        for part in parts:
            if part not in known:
                if part in self.older:
                    known[part] = self.older[part]
                else:
                    rest.append(part)
        got = dict(zip(rest, self.asked(rest), strict=True))
        known.update((part, ids) for part, ids in got.items() if len(part) < LONG)
        out = [got[part] if part in got else known[part] for part in parts]
        if len(known) > REMEMBERED:
            self.older, self.fresh = known, {}
        return out

    def encode_flat(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all texts in one array, and where each text's begin and end in it."""
        column = pa.array(texts, pa.string())
        whole = np.ones(len(texts), bool) if not self.parted else pc.match_substring_regex(column, RUNS).to_numpy(zero_copy_only=False).astype(bool)
        # A piece of the built-in pattern begins at each single space between others, so such parts can be encoded apart.
        lists = pc.split_pattern(pc.replace_substring(column.filter(pa.array(~whole)), " ", "\0 "), "\0")
        coded = pc.dictionary_encode(lists.flatten())
        n_parts = np.ones(len(texts), np.int64)
        n_parts[~whole] = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
        of_parts = self.ids_of(coded.dictionary.to_pylist()) + self.asked(column.filter(pa.array(whole)).to_pylist())
        # The parts of all texts in order: those cut apart by their place among the different ones, whole texts after these.
        which = np.empty(int(n_parts.sum()), np.int64)
        alone = np.repeat(whole, n_parts)
        which[~alone] = coded.indices.to_numpy(zero_copy_only=False)
        which[alone] = len(coded.dictionary) + np.arange(int(whole.sum()))
        sizes = np.fromiter(map(len, of_parts), np.int64, len(of_parts)) // 4
        begins = np.cumsum(sizes) - sizes
        taken = sizes[which]
        ends = np.cumsum(taken)
        own = np.frombuffer(b"".join(of_parts), np.int32)
        ids = own[np.repeat(begins[which] - (ends - taken), taken) + np.arange(ends[-1] if len(ends) else 0)]
        stops = np.concatenate([[0], ends])[np.cumsum(n_parts)] if len(texts) else np.empty(0, np.int64)
        return ids, np.concatenate([[0], stops[:-1]]) if len(texts) else stops, stops

    def encode(self, texts: list[str]) -> list[list[int]]:
        ids, starts, stops = self.encode_flat(texts)
        return [ids[a:b].tolist() for a, b in zip(starts.tolist(), stops.tolist(), strict=True)]

    def encode_with_offsets(self, texts: list[str]) -> list[tuple[list[int], list[tuple[int, int]]]]:
        """Ids and, for each, the code points [start, end) that its bytes belong to; split characters overlap."""
        return [(found.ids, found.offsets) for found in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def decode_bytes(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))

    def decode(self, ids: list[int]) -> str:
        """Text of the ids; bytes that are no whole character (a cut sequence) become U+FFFD."""
        return self.decode_bytes(ids).decode("utf-8", errors="replace")

    def decode_stream(self, ids: list[int]) -> list[str]:
        """The text that each id completes: a character split over tokens comes with its last one."""
        import codecs

        reader = codecs.getincrementaldecoder("utf-8")("replace")
        return [reader.decode(self.bytes_of[i]) for i in ids]


#: Parts of texts remembered with their ids, twice: those lately met and those before; longer ones are not.
REMEMBERED = 250_000
LONG = 500
#: Texts with white space before a space, or a space at the end, are not cut: there, pieces depend on what stands on both
#: sides of a space. Nor are those with control characters that only some count as white space.
RUNS = r"[\s\x0b\x85\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}] |[\x00\x1c-\x1f]| \z"
#: Fixed value: the pattern that the library's byte-level step has built in.
BUILT_IN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def spelled(table: pa.Array, ids: np.ndarray) -> Callable[[int, int], memoryview]:
    """What ``table`` has for the ids, joined: bytes of ids from one place to another."""
    taken = table.take(pa.array(ids))
    _, offsets, data = taken.buffers()
    ends = np.frombuffer(offsets, np.int32, len(ids) + 1, 4 * taken.offset)
    held = memoryview(data).cast("B") if data is not None else memoryview(b"")
    return lambda a, b: held[ends[a] : ends[b]]


@functools.lru_cache(4)
def byte_bpe(path: str, pattern: str) -> ByteBpe:
    return ByteBpe(path, pattern)


#: Texts that go to the library at once; the rest of an Arrow batch waits.
AT_ONCE = 1024


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", offsets: bool = False) -> DataFrame:
    """``id, ids array<int>`` and, if asked for, ``starts``/``ends`` in code points, for every row."""

    def run(rows: dict) -> dict:
        coder, texts = byte_bpe(path, pattern), [t or "" for t in rows["text"]]
        if not offsets:
            return {"id": rows["id"], "ids": [ids for i in range(0, len(texts), AT_ONCE) for ids in coder.encode(texts[i : i + AT_ONCE])]}
        both = [x for i in range(0, len(texts), AT_ONCE) for x in coder.encode_with_offsets(texts[i : i + AT_ONCE])]
        return {"id": rows["id"], "ids": [x[0] for x in both], "starts": [[a for a, _ in x[1]] for x in both], "ends": [[b for _, b in x[1]] for x in both]}

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, ids array<int>" + (", starts array<int>, ends array<int>" if offsets else "")
    return map_batches(docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")), run, schema).withColumnRenamed("id", id_col)


def decode(tokens: DataFrame, path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``id, content binary``: the bytes of each row's ids; null ids are no ids."""

    def run(rows: dict) -> dict:
        coder = byte_bpe(path, pattern)
        return {"id": rows["id"], "content": [coder.decode_bytes(ids or []) for ids in rows["ids"]]}

    kind = tokens.schema[id_col].dataType.simpleString()
    frame = tokens.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{ids_col}`").alias("ids"))
    return map_batches(frame, run, f"id {kind}, content binary").withColumnRenamed("id", id_col)


def round_trip(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Digests of encoding every text and of decoding the ids again: id, n_tokens, ids_sha256, decoded_sha256, exact.

    ``exact`` says that the decoded bytes equal the text's. Encoding and decoding run on one batch, so ids never
    leave the task.
    """

    def run(rows: dict) -> dict:
        coder = byte_bpe(path, pattern)
        out: dict[str, list] = {"id": rows["id"], "n_tokens": [], "ids_sha256": [], "decoded_sha256": [], "exact": []}
        texts = [t or "" for t in rows["text"]]
        for i in range(0, len(texts), AT_ONCE):
            some = texts[i : i + AT_ONCE]
            ids, starts, stops = coder.encode_flat(some)
            content, numbers = spelled(coder.all_bytes, ids), spelled(coder.all_numbers, ids)
            for text, a, b in zip(some, starts.tolist(), stops.tolist(), strict=True):
                own = content(a, b)
                out["n_tokens"].append(b - a)
                out["ids_sha256"].append(hashlib.sha256(numbers(a, b)[:-1]).hexdigest())
                out["decoded_sha256"].append(hashlib.sha256(own).hexdigest())
                out["exact"].append(own == text.encode())
        return out

    kind = docs.schema[id_col].dataType.simpleString()
    frame = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    return map_batches(frame, run, f"id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string, exact boolean").withColumnRenamed("id", id_col)
