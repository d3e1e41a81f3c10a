"""Paged HTTP listings as a data source: ``spark.read.format("pages")`` and, over time, ``readStream``.

A task reads one key (a community, a query) in one slice of days, page after page. Two kinds of paging:

* ``time``: pages come newest first and go back by the oldest time seen (``before``, ``after`` and ``limit`` are asked for);
  rows at the edge of two pages are told apart by their id, so none is lost or comes twice; a second with a whole page of rows fails. A stream's offset is the day up to
  which all keys were read: it stands in the checkpoint before a batch runs, and a batch that runs again asks the same.
* ``token``: each page names the next one until there is none; for batch reads.

Busy answers (429, 5xx, broken connections) are asked again after a pause that doubles; after ``tries`` the task fails and
Spark runs it anew. Options: ``url``, ``keys`` (by comma), ``key`` (name of its parameter), ``paging``, ``start``, ``end``
(days; ``end`` is not read itself), ``slice_days``, ``limit``, ``pages`` (most pages of a task, 0 for all), ``rows``, ``item``
and ``next`` (paths into an answer), ``id``, ``time``, ``tries``, ``pause`` (seconds), ``delay`` (between pages).
"""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import UTC, date, datetime, timedelta

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType


@dataclass
class Slice(InputPartition):
    key: str
    after: int  #: seconds, the first one read
    before: int  #: the first one not read


def seconds(day: str) -> int:
    return int(datetime.combine(date.fromisoformat(day), datetime.min.time(), UTC).timestamp())


def within(answer: object, path: str) -> object:
    for name in filter(None, path.split(".")):
        answer = answer.get(name) if isinstance(answer, dict) else None
    return answer


class Listing:
    """What both readers share; it travels to the tasks."""

    def __init__(self, schema: StructType, options: dict[str, str]):
        told = {"keys": "", "key": "key", "paging": "time", "start": "1970-01-02", "end": "", "slice_days": "7", "limit": "100", "pages": "0", "rows": "data", "item": "", "next": "after", "id": "id", "time": "created_utc", "tries": "6", "pause": "1", "delay": "0"} | dict(options)
        if "url" not in told or told["paging"] not in ("time", "token"):
            raise ValueError("pages need a url and paging by time or token")
        self.options, self.names = told, [f.name for f in schema.fields]
        self.whole = {f.name for f in schema.fields if f.dataType.typeName() in ("long", "integer", "short", "byte")}
        self.real = {f.name for f in schema.fields if f.dataType.typeName() in ("double", "float")}
        self.texts = {f.name for f in schema.fields if f.dataType.typeName() == "string"}

    def end(self) -> str:
        return self.options["end"] or datetime.now(UTC).date().isoformat()

    def slices(self, start: str, end: str) -> list[Slice]:
        keys = [k.strip() for k in self.options["keys"].split(",") if k.strip()] or [""]
        if self.options["paging"] == "token":
            return [Slice(k, 0, 0) for k in keys]
        step, first, last = timedelta(days=int(self.options["slice_days"])), date.fromisoformat(start), date.fromisoformat(end)
        out = []
        while first < last:
            then = min(first + step, last)
            out += [Slice(k, seconds(first.isoformat()), seconds(then.isoformat())) for k in keys]
            first = then
        return out

    def page(self, **asked: object) -> dict:
        url = f"{self.options['url']}?{urllib.parse.urlencode({k: v for k, v in asked.items() if v not in (None, '')})}"
        pause = float(self.options["pause"])
        for left in range(int(self.options["tries"]) - 1, -1, -1):
            try:
                with urllib.request.urlopen(url, timeout=30) as answer:
                    return json.load(answer)
            except urllib.error.HTTPError as e:
                if e.code != 429 and e.code < 500 or not left:
                    raise
            except (urllib.error.URLError, OSError):
                if not left:
                    raise
            time.sleep(pause)
            pause *= 2
        raise TimeoutError(url)

    def rows_of(self, answer: dict) -> list[dict]:
        found = [within(r, self.options["item"]) for r in within(answer, self.options["rows"]) or []]
        return [r for r in found if isinstance(r, dict)]

    def form(self, row: dict) -> tuple:
        def value(name: str) -> object:
            v = row.get(name)
            if v is None:
                return None
            if name in self.whole:
                return int(v)
            if name in self.real:
                return float(v)
            return v if not (name in self.texts) or isinstance(v, str) else json.dumps(v)

        return tuple(value(n) for n in self.names)

    def read(self, part: Slice) -> Iterator[tuple]:
        walk = self.by_time(part) if self.options["paging"] == "time" else self.by_token(part)
        most = int(self.options["pages"])
        for n, rows in enumerate(walk, 1):
            for row in rows:
                row.setdefault(self.options["key"], part.key)
                yield self.form(row)
            if n == most:
                break
            time.sleep(float(self.options["delay"]))

    def by_time(self, part: Slice) -> Iterator[list[dict]]:
        own, when, limit, before = self.options["id"], self.options["time"], int(self.options["limit"]), part.before
        edge: set = set()  # ids of the oldest second that was read
        while True:
            rows = self.rows_of(self.page(**{self.options["key"]: part.key, "after": part.after, "before": before, "limit": limit, "sort": "desc"}))
            fresh = [r for r in rows if r.get(own) not in edge and part.after <= int(r.get(when) or 0) < part.before]
            yield fresh
            if len(rows) < limit:
                return
            oldest = min(int(r[when]) for r in rows)
            if oldest + 1 == before and not fresh:
                raise ValueError(f"{limit} rows or more in one second of {part.key}: raise the limit")
            edge = {r.get(own) for r in rows if int(r[when]) == oldest} | (edge if oldest + 1 == before else set())
            before = oldest + 1

    def by_token(self, part: Slice) -> Iterator[list[dict]]:
        token = None
        while True:
            answer = self.page(**{self.options["key"]: part.key, "limit": self.options["limit"], "after": token})
            yield self.rows_of(answer)
            token = within(answer, self.options["next"])
            if not token:
                return


class BatchReader(DataSourceReader):
    def __init__(self, listing: Listing):
        self.listing = listing

    def partitions(self) -> list[Slice]:
        return self.listing.slices(self.listing.options["start"], self.listing.end())

    def read(self, partition: Slice) -> Iterator[tuple]:
        return self.listing.read(partition)


class StreamReader(DataSourceStreamReader):
    def __init__(self, listing: Listing):
        if listing.options["paging"] != "time":
            raise ValueError("a stream goes by time")
        self.listing = listing

    def initialOffset(self) -> dict:
        return {"day": self.listing.options["start"]}

    def latestOffset(self) -> dict:
        return {"day": self.listing.end()}

    def partitions(self, start: dict, end: dict) -> list[Slice]:
        return self.listing.slices(start["day"], end["day"])

    def read(self, partition: Slice) -> Iterator[tuple]:
        return self.listing.read(partition)


class Pages(DataSource):
    """Register once: ``spark.dataSource.register(Pages)``."""

    @classmethod
    def name(cls) -> str:
        return "pages"

    def schema(self) -> str:
        raise ValueError("tell the schema of a row")

    def reader(self, schema: StructType) -> BatchReader:
        return BatchReader(Listing(schema, self.options))

    def streamReader(self, schema: StructType) -> StreamReader:
        return StreamReader(Listing(schema, self.options))
