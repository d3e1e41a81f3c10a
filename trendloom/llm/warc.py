"""WARC archives: write, read back, and merge the captures' index.

Archives are written by Spark's text writer: a WARC record ends with two line ends, which serve as the separator of
rows. So tasks commit files as for any table, in any store. A payload that another record has too is written once; the
others are revisits that refer to it.

Reading parses each archive by the records' lengths. The entries of each part read are sorted locally and cut into
blocks: runs. Ranges of URL key and time are merged from the runs by a loser tree that opens a block only when its
first entry is due, so memory follows the number of runs that overlap, not a range's size.

Defined results: a null payload is the empty one; a null URL has no target and the empty URL key; a row without an id
is a response that nothing refers to; repeated rows are records of their own, where those with the first's id are
responses; captures of one URL and time are ordered by id and then by their record's place; a payload of any length is one record, whole in
a task; only the id, the URL and the payload are read, so other columns' names can't clash; an empty table makes an empty
history.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_schema, materialize, scratch_path

BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
END = "\r\n"
ARCHIVE_BYTES = 16 << 20  #: of an archive, on average
BLOCK = 256  #: entries of a block
RANGE_ENTRIES = 5000  #: of a range, until there are MOST_RANGES
MOST_RANGES = 1024
SAMPLED = 64  #: entries sampled for each range


def base32_sha1(content: Column) -> Column:
    """Bare upper-case base32 SHA-1: each five hexadecimal digits are four characters."""
    digest = F.sha1(content)
    fives = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.conv(F.substring(digest, i * 5 + 1, F.lit(5)), 16, 10).cast("int"))
    char = lambda v, shift: F.substring(F.lit(BASE32), F.shiftright(v, shift).bitwiseAND(31) + 1, F.lit(1))
    return F.array_join(F.transform(fives, lambda v: F.concat(*(char(v, shift) for shift in (15, 10, 5, 0)))), "")


def records(pages: DataFrame, least_bytes: int, id_col: str, url_col: str, payload_col: str, time: Column) -> DataFrame:
    """``value``: a whole WARC record for each row."""
    rows = pages.select(F.col(f"`{id_col}`").cast("bigint").alias("id"), F.regexp_replace(F.col(f"`{url_col}`"), r"[\x00-\x20\x7F]", "%20").alias("url"), F.coalesce(F.col(f"`{payload_col}`"), F.lit("")).alias("payload"), time.alias("time"))
    rows = rows.withColumn("size", F.octet_length("payload")).withColumn("digest", base32_sha1(F.col("payload")))
    first = rows.where(F.col("size") >= least_bytes).groupBy("digest", "size").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    rows = rows.join(first, ["digest", "size"], "left").withColumn("again", F.coalesce(F.col("id") != F.col("first"), F.lit(False)))
    line = lambda name, *value: F.concat(F.lit(f"{name}: "), *value, F.lit(END))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{END}Content-Type: text/html; charset=utf-8{END}"), line("Content-Length", F.col("size").cast("string")), F.lit(END))
    head = F.concat(
        F.lit(f"WARC/1.1{END}"),
        line("WARC-Type", F.when(F.col("again"), "revisit").otherwise("response")),
        line("WARC-Record-ID", F.lit("<urn:capture:"), F.coalesce(F.col("id").cast("string"), F.lit("none")), F.lit(">")),
        line("WARC-Date", F.date_format("time", "yyyy-MM-dd'T'HH:mm:ss'Z'")),
        F.coalesce(line("WARC-Target-URI", F.col("url")), F.lit("")),
        line("WARC-Payload-Digest", F.lit("sha1:"), F.col("digest")),
        F.when(F.col("again"), F.concat(F.lit(f"WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest{END}"), line("WARC-Refers-To", F.lit("<urn:capture:"), F.col("first").cast("string"), F.lit(">")))).otherwise(""),
        F.lit(f"Content-Type: application/http; msgtype=response{END}"),
        line("Content-Length", (F.octet_length("http") + F.when(F.col("again"), 0).otherwise(F.col("size"))).cast("string")),
        F.lit(END),
    )
    return rows.withColumn("http", http).select(F.concat(head, "http", F.when(F.col("again"), "").otherwise(F.col("payload"))).alias("value"))


YEARS_SECONDS = 3650 * 86400


def write(pages: DataFrame, path: str, least_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", time: Column | None = None) -> None:
    """Write an archive folder. ``time`` defaults to a second of ten years that the id tells: the pages have no date.

    Any id gives a date of four digits, so times sort as text.
    """
    if time is None:
        time = F.timestamp_seconds(F.lit(1704067200) + F.pmod(F.coalesce(F.col(f"`{id_col}`").cast("bigint"), F.lit(0)), F.lit(YEARS_SECONDS)))
    mean = pages.agg(F.avg(F.octet_length(F.col(f"`{payload_col}`")))).first()[0] or 0
    records(pages, least_bytes, id_col, url_col, payload_col, time).write.option("lineSep", END + END).option("compression", "gzip").option("maxRecordsPerFile", max(1, int(ARCHIVE_BYTES / (mean + 600)))).text(path)


def url_key(url: str | None) -> str:
    """Sort-friendly form: host labels reversed, then the rest in lower case; no scheme, ``www.`` or fragment."""
    try:
        at = urlsplit(url or "")
        host = (at.hostname or "").removeprefix("www.")
        port = f":{at.port}" if at.port and at.port not in (80, 443) else ""
    except ValueError:
        return (url or "").lower()
    if not host:
        return (url or "").lower()
    return f"{','.join(reversed(host.split('.')))}{port}){at.path or '/'}{'?' + at.query if at.query else ''}".lower()


def parsed(content: bytes) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """``offset, headers, block`` of the records of an unpacked archive."""
    at = 0
    while at < len(content):
        end = content.index(b"\r\n\r\n", at)
        first, *lines = content[at:end].decode().split(END)
        if not first.startswith("WARC/"):
            raise ValueError(f"no record at byte {at}")
        headers = dict(line.split(": ", 1) for line in lines)
        size = int(headers["Content-Length"])
        block = content[end + 4 : end + 4 + size]
        if len(block) != size or content[end + 4 + size : end + 8 + size] != b"\r\n\r\n":
            raise ValueError(f"record at byte {at} is cut short")
        yield at, headers, block
        at = end + 8 + size


def capture_id(urn: str | None) -> int | None:
    value = (urn or "").removeprefix("<urn:capture:").removesuffix(">")
    return int(value) if value.lstrip("-").isdigit() else None


ENTRY = "url_key string, time string, page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, archive string, at bigint"


def read(spark: SparkSession, path: str) -> DataFrame:
    """An index entry for each record; response payloads are held against their digests."""
    target = arrow_schema(spark, ENTRY)

    def run(batches):
        import base64
        import hashlib
        import zlib

        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows = []
                for at, headers, block in parsed(zlib.decompress(content.as_buffer(), 47)):
                    http, _, payload = block.partition(b"\r\n\r\n")
                    size = next(int(h.split(b":")[1]) for h in http.split(b"\r\n") if h.lower().startswith(b"content-length:"))
                    kind, digest = headers["WARC-Type"], headers["WARC-Payload-Digest"].removeprefix("sha1:")
                    if kind == "response" and (len(payload) != size or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
                        raise ValueError(f"{name}, byte {at}: the payload doesn't fit its digest")
                    rows.append((url_key(headers.get("WARC-Target-URI")), headers["WARC-Date"], capture_id(headers["WARC-Record-ID"]), size, digest, kind, capture_id(headers.get("WARC-Refers-To")), name.rsplit("/", 1)[-1], at))
                rows.sort(key=order)
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(target)], schema=target)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")
    return files.mapInArrow(run, ENTRY)


def order(row: tuple) -> tuple:
    return row[0], row[1], -1 if row[2] is None else row[2], row[7], row[8]


class LoserTree:
    """Merges sorted runs. Inner nodes keep the loser of their match, so the next winner costs one way to the root."""

    def __init__(self):
        self.runs: list[list] = []  #: entries
        self.at: list[int] = []
        self.losers: list[int] = []
        self.winner = -1

    def key(self, i: int):
        """Exhausted runs come last."""
        return (1,) if i >= len(self.runs) or self.at[i] >= len(self.runs[i]) else (0, order(self.runs[i][self.at[i]]))

    def open(self, run: list) -> None:
        alive = [i for i in range(len(self.runs)) if self.at[i] < len(self.runs[i])]
        self.runs, self.at = [*(self.runs[i] for i in alive), run], [*(self.at[i] for i in alive), 0]
        width = 1 << (len(self.runs) - 1).bit_length()
        winners = [0] * width + list(range(width))
        self.losers = [0] * width
        for node in range(width - 1, 0, -1):
            a, b = winners[2 * node], winners[2 * node + 1]
            winners[node], self.losers[node] = (a, b) if self.key(a) <= self.key(b) else (b, a)
        self.winner = winners[1]

    def head(self):
        key = self.key(self.winner) if self.runs else (1,)
        return key[1] if len(key) > 1 else None

    def pop(self) -> tuple:
        i = self.winner
        entry = self.runs[i][self.at[i]]
        self.at[i] += 1
        key, node = self.key(i), (i + len(self.losers)) // 2
        while node:
            other = self.losers[node]
            if (rival := self.key(other)) < key:
                self.losers[node], i, key = i, other, rival
            node //= 2
        self.winner = i
        return entry


def merge(entries: DataFrame) -> DataFrame:
    """The entries in global order of ``range, seq``: by URL key, time and id."""
    spark = entries.sparkSession
    total = entries.count()
    ranges = max(1, min(MOST_RANGES, total // RANGE_ENTRIES))
    step = max(1, total // (ranges * SAMPLED))
    sample = sorted((r[0], r[1], -1 if r[2] is None else r[2]) for r in entries.where(F.pmod(F.xxhash64("url_key", "time", "page_id"), F.lit(step)) == 0).select("url_key", "time", "page_id").limit(4 * ranges * SAMPLED).collect()) if ranges > 1 else []
    splits = [sample[i * len(sample) // ranges] for i in range(1, ranges)] if sample else []
    names = [f.split(" ")[0] for f in ENTRY.split(", ")]
    block_schema = f"range int, url_key string, time string, page_id bigint, entries array<struct<{ENTRY.replace(' ', ':').replace(',:', ',')}>>"
    block_target = arrow_schema(spark, block_schema)

    def blocks(batches):
        for batch in batches:
            rows = sorted(zip(*(c.to_pylist() for c in batch.columns), strict=True), key=order)
            keys = [order(r)[:3] for r in rows]
            out, at = [], 0
            for i, end in enumerate([*(bisect.bisect_left(keys, s) for s in splits), len(rows)]):
                out += [(i, rows[a][0], rows[a][1], keys[a][2], [dict(zip(names, r, strict=True)) for r in rows[a : min(a + BLOCK, end)]]) for a in range(at, end, BLOCK)]
                at = max(at, end)
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], f.type) for i, f in enumerate(block_target)], schema=block_target)

    merged_schema = f"range int, seq bigint, {ENTRY}"
    target = arrow_schema(spark, merged_schema)

    def merged(batches):
        def due():
            for batch in batches:
                for i in range(batch.num_rows):
                    own = batch.column(4)[i].as_py()
                    yield batch.column(0)[i].as_py(), [tuple(e[n] for n in names) for e in own]

        tree, now, seq, out = LoserTree(), None, 0, []

        def drained(before):
            nonlocal seq
            while (head := tree.head()) is not None and (before is None or head < before):
                out.append((now, seq, *tree.pop()))
                seq += 1

        def batch_of(rows):
            return pa.RecordBatch.from_arrays([pa.array([o[i] for o in rows], f.type) for i, f in enumerate(target)], schema=target)

        for number, run in due():
            if number != now:
                drained(None)
                now, seq = number, 0
            drained(order(run[0]))
            tree.open(run)
            if len(out) >= 4096:
                yield batch_of(out)
                out.clear()
        drained(None)
        yield batch_of(out)

    return entries.select(*names).mapInArrow(blocks, block_schema).repartition("range").sortWithinPartitions("range", "url_key", "time", "page_id").mapInArrow(merged, merged_schema)


def histories(pages: DataFrame, least_bytes: int = 0, **columns) -> DataFrame:
    """Write the pages as archives in the shared folder, read them back and merge their index."""
    spark = pages.sparkSession
    path = scratch_path(spark, "warc")
    write(pages, path, least_bytes, **columns)
    entries = materialize(read(spark, path), "captures")
    return merge(entries)
