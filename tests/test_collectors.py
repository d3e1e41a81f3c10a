"""Paged sources against a server in this process, workbooks made by hand, keys that are never forgotten."""

import json
import threading
import zipfile
from datetime import UTC, datetime
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlsplit

import pytest

from trendloom import sources, streaming
from trendloom.sources import pages, workbook

DAY = 86_400
START = int(datetime(2026, 1, 1, tzinfo=UTC).timestamp())
ROWS = {c: [{"id": f"{c}{i}", "created_utc": START + (i * 7919 % (6 * DAY // 600)) * 600, "score": i, "title": f"t{i}", "more": {"x": i}} for i in range(450)] for c in ("one", "two")}


class Server(BaseHTTPRequestHandler):
    asked = 0

    def do_GET(self):
        Server.asked += 1
        if Server.asked % 5 == 0:  # every fifth answer is busy
            self.send_response(429 if Server.asked % 2 else 503)
            self.end_headers()
            return
        at = urlsplit(self.path)
        told = {k: v[0] for k, v in parse_qs(at.query).items()}
        if at.path == "/gone":
            self.send_response(404)
            self.end_headers()
            return
        rows, limit = ROWS[told["community"]], int(told["limit"])
        if at.path == "/time":
            found = sorted((r for r in rows if int(told["after"]) <= r["created_utc"] < int(told["before"])), key=lambda r: -r["created_utc"])[:limit]
            answer = {"data": found}
        else:
            first = int(told.get("after", 0))
            answer = {"data": {"children": [{"kind": "t", "data": r} for r in rows[first : first + limit]], "after": first + limit if first + limit < len(rows) else None}}
        self.send_response(200)
        self.end_headers()
        self.wfile.write(json.dumps(answer).encode())

    def log_message(self, *args):
        pass


@pytest.fixture(scope="module")
def url():
    server = ThreadingHTTPServer(("127.0.0.1", 0), Server)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}"
    server.shutdown()


SCHEMA = "id string, community string, created_utc long, score double, title string, more string, absent string"


def options(base, **more):
    return {"url": f"{base}/time", "keys": "one, two", "key": "community", "start": "2026-01-01", "end": "2026-01-07", "slice_days": "2", "limit": "40", "pause": "0.01"} | more


def test_pages_by_time(spark, url):
    spark.dataSource.register(pages.Pages)
    rows = spark.read.format("pages").schema(SCHEMA).options(**options(url)).load().collect()
    assert sorted(r["id"] for r in rows) == sorted(r["id"] for own in ROWS.values() for r in own)
    one = next(r for r in rows if r["id"] == "two7")
    assert (one["community"], one["score"], one["title"], json.loads(one["more"]), one["absent"]) == ("two", 7.0, "t7", {"x": 7}, None)
    # Many rows in each second: pages end amid a second.
    assert len({r["created_utc"] for r in ROWS["one"]}) < 450 or spark.read.format("pages").schema(SCHEMA).options(**options(url, limit="2")).load().count() == 900
    few = spark.read.format("pages").schema(SCHEMA).options(**options(url, pages="1", slice_days="6")).load()
    assert few.count() == 80


def test_seconds_shared_by_pages():
    class Fake(pages.Listing):
        def page(self, **asked):
            return {"data": [r for r in self.rows if asked["after"] <= r["t"] < asked["before"]][: asked["limit"]]}

    from pyspark.sql.types import LongType, StructField, StructType

    told = Fake(StructType([StructField("id", LongType()), StructField("t", LongType())]), {"url": "x", "time": "t", "limit": "4"})
    told.rows = [{"id": i, "t": t} for i, t in enumerate([9, 9, 8, 8, 5, 5, 5, 4, 1])]
    assert [r[0] for r in told.read(pages.Slice("k", 0, 10))] == list(range(9))
    told.rows = [{"id": i, "t": 5} for i in range(4)]
    with pytest.raises(ValueError, match="limit"):
        list(told.read(pages.Slice("k", 0, 10)))


def test_pages_by_token(spark, url):
    spark.dataSource.register(pages.Pages)
    rows = spark.read.format("pages").schema(SCHEMA).options(**options(url, url=f"{url}/token", paging="token", rows="data.children", item="data", next="data.after")).load()
    assert sorted(r["id"] for r in rows.collect()) == sorted(r["id"] for own in ROWS.values() for r in own)
    with pytest.raises(Exception, match="404"):
        spark.read.format("pages").schema(SCHEMA).options(**options(url, url=f"{url}/gone")).load().count()


def test_stream_of_pages_goes_on(spark, url, tmp_path):
    """A second run reads the days after the first one's; no row is lost or comes twice."""
    spark.dataSource.register(pages.Pages)
    state, out = f"file://{tmp_path}/state", f"file://{tmp_path}/out"
    stream = lambda end: spark.readStream.format("pages").schema(SCHEMA).options(**options(url, end=end)).load()
    first = streaming.collected(stream("2026-01-03"), state, out)
    assert first.count() == sum(r["created_utc"] < START + 2 * DAY for own in ROWS.values() for r in own)
    both = streaming.collected(stream("2026-01-07"), state, out)
    assert sorted(r["id"] for r in both.collect()) == sorted(r["id"] for own in ROWS.values() for r in own)
    assert streaming.collected(stream("2026-01-07"), state, out).count() == 900


def test_keys_are_never_forgotten(spark, tmp_path):
    """A key comes again after 61 days, in another run, and is known."""
    source, state, out = tmp_path / "in", f"file://{tmp_path}/state", f"file://{tmp_path}/out"
    put = lambda rows: spark.createDataFrame(rows, "k string, t string").selectExpr("k", "cast(t AS timestamp) AS published_at").write.mode("append").parquet(f"file://{source}")
    stream = lambda: spark.readStream.schema("k string, published_at timestamp").parquet(f"file://{source}")
    with streaming.keys_on_disk(spark):
        put([("a", "2024-01-01 00:00:00"), ("b", "2024-01-02 00:00:00"), ("a", "2024-01-02 00:00:00")])
        assert sorted(r["k"] for r in streaming.collected(streaming.first_ever(stream(), "k"), state, out).collect()) == ["a", "b"]
        put([("c", "2024-06-01 00:00:00")])
        streaming.collected(streaming.first_ever(stream(), "k"), state, out)
        put([("a", "2024-06-02 00:00:00"), ("d", "2024-01-01 00:00:00")])
        assert sorted(r["k"] for r in streaming.collected(streaming.first_ever(stream(), "k"), state, out).collect()) == ["a", "b", "c", "d"]
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass").endswith("HDFSBackedStateStoreProvider")


def book(path, sheets, shared):
    main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {main} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets>{"".join(f"<sheet name={chr(34)}{n}{chr(34)} sheetId={chr(34)}{i}{chr(34)} r:id={chr(34)}r{i}{chr(34)}/>" for i, n in enumerate(sheets))}</sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="x">{"".join(f"<Relationship Id={chr(34)}r{i}{chr(34)} Target={chr(34)}{chr(47) + 'xl/' if i else ''}worksheets/s{i}.xml{chr(34)}/>" for i in range(len(sheets)))}</Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {main}>{''.join(f'<si>{s}</si>' for s in shared)}</sst>")
        for i, rows in enumerate(sheets.values()):
            z.writestr(f"xl/worksheets/s{i}.xml", f"<worksheet {main}><sheetData>{rows}</sheetData></worksheet>")


def test_workbook(spark, tmp_path):
    shared = ["<t>brand_name</t>", "<t xml:space='preserve"  "'> Acme </t>", "<r><t>Blue</t></r><r><t> River</t></r><rPh sb='0' eb='1'><t>note</t></rPh>"]
    first = '<row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1" t="s"><v>1</v></c></row><row r="3"><c r="B3" t="s"><v>2</v></c><c r="AB3"><v>42.0</v></c><c r="AC3"/></row>'
    second = '<row><c t="inlineStr"><is><t>Inline &amp; co</t></is></c><c t="b"><v>1</v></c><c t="str"><f>A1</f><v>made</v></c><c><v>1.5</v></c></row>'
    book(tmp_path / "a.xlsx", {"Sheet one": first, "two": second}, shared)
    (tmp_path / "note.txt").write_text("no workbook")
    rows = workbook.read_workbooks(spark, f"file://{tmp_path}")
    got = {(r["sheet"], r["row"], r["col"]): r["value"] for r in rows.collect()}
    assert got == {("Sheet one", 1, 1): "brand_name", ("Sheet one", 1, 3): " Acme ", ("Sheet one", 3, 2): "Blue River", ("Sheet one", 3, 28): "42", ("two", 1, 1): "Inline & co", ("two", 1, 2): "TRUE", ("two", 1, 3): "made", ("two", 1, 4): "1.5"}
    (tmp_path / "a.csv").write_text("brand_name,, Acme \n,Blue River,42\nInline & co,TRUE,made\n1.5,,\n")
    flat = sources.flat_cells(spark.read.csv(f"file://{tmp_path}/a.csv"))
    assert sorted(r[0] for r in workbook.flat_workbook(rows).collect()) == sorted(r[0] for r in flat.collect())
