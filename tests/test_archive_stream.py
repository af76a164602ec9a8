"""Archives as a streaming source: ends, restarts, both transports."""

import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest

from quillstream.sources import archive_stream
from quillstream.streaming import ingest


def put(root, name, unit, urls):
    (root / name).mkdir(exist_ok=True)
    (root / name / str(unit)).write_text(json.dumps([{"url": u} for u in urls]))


def spec(root, name, kind, chunk=2, **more):
    mark = {"page": "{page}", "offset": "{offset}", "date": "{date}"}[kind]
    return {"name": name, "kind": kind, "url": f"{root}/{name}/{mark}", "chunk": chunk, "first": 1, "pagesize": 5, "date_format": "%Y%m%d", **more}


def got(df):
    return sorted((r.archive, r.unit, r.status) for r in df.collect())


@pytest.fixture
def pages(tmp_path):
    root = tmp_path / "pages"
    root.mkdir()
    for k in range(1, 6):
        put(root, "wraps", k, [f"w{k}", "w"])
        put(root, "clamps", k, [f"c{k}"])
    put(root, "wraps", 6, ["w", "w1"])
    put(root, "clamps", 6, ["c5"])
    for k in (0, 5, 15, 20):
        put(root, "offsets", k, [f"o{k}"] if k < 20 else [])
    for day in ("20240101", "20240102", "20240104"):
        put(root, "days", day, [day] if day != "20240102" else [])
    put(root, "breaks", 1, ["b1"])
    return root


def specs(root):
    return [spec(root, "wraps", "page"), spec(root, "clamps", "page", chunk=3), spec(root, "offsets", "offset"), spec(root, "days", "date", since="2024-01-01"), spec(root, "breaks", "page", chunk=4)]


WANT = sorted(
    [("wraps", k, "page") for k in range(5)] + [("wraps", 5, "wrapped")]
    + [("clamps", k, "page") for k in range(5)] + [("clamps", 5, "repeated")]
    + [("offsets", 0, "page"), ("offsets", 1, "page"), ("offsets", 2, "failed"), ("offsets", 3, "page"), ("offsets", 4, "empty")]
    + [("days", 0, "page"), ("days", 1, "page"), ("days", 2, "failed"), ("days", 3, "page")]
    + [("breaks", 0, "page"), ("breaks", 1, "failed"), ("breaks", 2, "failed"), ("breaks", 3, "error")]
)


def test_every_unit_once_over_restarts(spark, tmp_path, pages):
    options = {"fetcher": "folder", "today": "2024-01-04"}
    out = str(tmp_path / "out")
    first = ingest.walk_archives(spark, out, specs(pages), batches=1, **options)
    assert [r for r in got(first) if r[0] == "wraps"] == [("wraps", 0, "page"), ("wraps", 1, "page")]
    ingest.walk_archives(spark, out, specs(pages), batches=1, **options)
    ingest.walk_archives(spark, out, specs(pages), **options)
    rows = ingest.walk_archives(spark, out, specs(pages), batches=1, **options)
    seen = [r for r in got(rows) if r[0] != "breaks"]
    assert seen == [r for r in WANT if r[0] != "breaks"]
    cursor = json.loads(next(r.cursor for r in rows.collect() if (r.archive, r.unit) == ("days", 3)))
    assert cursor == {"date": "2024-01-04", "page": 1, "offset": 0, "units_done": 3}


def test_a_batch_that_fails_is_read_again_once(spark, tmp_path, pages):
    """The run breaks between the log of a batch and its rows; the next run reads that batch, then goes on."""
    options = {"specs": json.dumps(specs(pages)), "state": str(tmp_path / "out/state"), "fetcher": "folder", "today": "2024-01-04"}
    spark.dataSource.register(archive_stream.ArchiveSource)
    stream = spark.readStream.format("archive").options(**options).load()
    calls = []

    def broken(batch, number):
        calls.append(number)
        if len(calls) == 2:
            raise RuntimeError("lost")
        batch.write.mode("overwrite").parquet(str(tmp_path / f"rows/v={number}"))

    def run():
        q = stream.writeStream.foreachBatch(broken).option("checkpointLocation", str(tmp_path / "check")).start()
        try:
            q.processAllAvailable()
        finally:
            q.stop()

    with pytest.raises(Exception, match="lost"):
        run()
    run()
    rows = spark.read.schema(archive_stream.SCHEMA).parquet(*[str(p) for p in sorted((tmp_path / "rows").iterdir())])
    assert [r for r in got(rows) if r[0] != "breaks"] == [r for r in WANT if r[0] != "breaks"]


def test_errors_go_on_when_started_anew(spark, tmp_path, pages):
    options, out = {"fetcher": "folder", "today": "2024-01-04"}, str(tmp_path / "out")
    mine = [spec(pages, "breaks", "page", chunk=4)]
    assert got(ingest.walk_archives(spark, out, mine, **options)) == [r for r in WANT if r[0] == "breaks"]
    put(pages, "breaks", 4, ["b4"])
    put(pages, "breaks", 5, [])
    rows = got(ingest.walk_archives(spark, out, mine, **options))
    assert rows == [("breaks", 0, "page"), ("breaks", 1, "failed"), ("breaks", 2, "failed"), ("breaks", 3, "error"), ("breaks", 3, "page"), ("breaks", 4, "empty")]


def test_batch_reader(spark, pages):
    spark.dataSource.register(archive_stream.ArchiveSource)
    rows = spark.read.format("archive").options(specs=json.dumps(specs(pages)), fetcher="folder", today="2024-01-04").load()
    assert got(rows) == WANT


def test_days_are_split(spark, tmp_path, pages):
    mine = [spec(pages, "days", "date", chunk=10, since="2024-01-01")]
    rows = ingest.walk_archives(spark, str(tmp_path / "out"), mine, fetcher="folder", today="2024-01-04", days_at_once="1")
    assert rows.rdd.getNumPartitions() >= 1 and got(rows) == [r for r in WANT if r[0] == "days"]


def test_http(spark, tmp_path):
    asked = []

    class Site(BaseHTTPRequestHandler):
        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            asked.append((self.path, body))
            self.send_response(500 if body["page"] == 2 else 200)
            self.end_headers()
            self.wfile.write(json.dumps([{"url": f"u{body['page']}"}] if body["page"] < 4 else []).encode())

        def log_message(self, *a):
            pass

    server = HTTPServer(("127.0.0.1", 0), Site)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        mine = [{"name": "site", "kind": "page", "url": f"http://127.0.0.1:{server.server_port}/list", "method": "POST", "body": '{"page": {page}, "size": {pagesize}}', "pagesize": 9, "chunk": 10}]
        rows = ingest.walk_archives(spark, str(tmp_path / "out"), mine)
        assert got(rows) == [("site", 0, "page"), ("site", 1, "failed"), ("site", 2, "page"), ("site", 3, "empty")]
        assert asked[0] == ("/list", {"page": 1, "size": 9})
    finally:
        server.shutdown()


def test_unknown_fetcher():
    with pytest.raises(ValueError):
        archive_stream.fetcher("carrier pigeon")
    assert archive_stream.fetcher("json:dumps") is json.dumps
