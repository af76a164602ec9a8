"""Streams run to the end over folders of files."""

import datetime as dt
import json


from quillstream.streaming import ingest, versions


def feed(*items):
    return json.dumps({"data": [{"url": u, "title": t, "no": 1} for u, t in items]})


def test_ingest(spark, tmp_path):
    src, table, check = (str(tmp_path / n) for n in ("in", "table", "check"))
    (tmp_path / "in").mkdir()

    def run():
        ingest.ingest(ingest.raw_stream(spark, src), "json_data", table, check).awaitTermination()
        return {r["url"]: (r["title"], r["first_batch"]) for r in versions.current(spark, f"{table}/rows", ingest.DOCUMENTS).collect()}

    (tmp_path / "in/a.json").write_text(feed(("http://x/1", "one"), ("http://x/2", "two")))
    assert run() == {"http://x/1": ("one", 0), "http://x/2": ("two", 0)}
    (tmp_path / "in/b.json").write_text(feed(("http://x/2", "two b"), ("http://x/3", "three")))
    (tmp_path / "in/c.json").write_text("{broken")
    want = {"http://x/1": ("one", 0), "http://x/2": ("two b", 0), "http://x/3": ("three", 1)}
    assert run() == want
    assert run() == want
    assert spark.read.parquet(f"{table}-errors").count() == 1


def test_without_repeats(spark, tmp_path):
    rows = [("a", dt.datetime(2024, 1, 1)), ("a", dt.datetime(2024, 1, 2)), ("b", dt.datetime(2024, 1, 1))]
    spark.createDataFrame(rows, "url string, published_at timestamp").coalesce(1).write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema("url string, published_at timestamp").parquet(str(tmp_path / "in"))
    assert sorted(r["url"] for r in ingest.run_to_table(ingest.without_repeats(s), str(tmp_path / "out")).collect()) == ["a", "b"]


def test_lifecycle(spark, tmp_path):
    day = lambda n: dt.datetime(2024, 1, 1) + dt.timedelta(days=n)
    for name, rows in (("1", [("a", day(5)), ("a", day(0)), ("b", day(0)), ("c", None)]), ("2", [("b", day(60)), ("a", day(61))]), ("3", [("d", day(200))])):
        spark.createDataFrame(rows, "key string, at timestamp").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        s = ingest.lifecycle(spark.readStream.schema("key string, at timestamp").parquet(str(tmp_path / "in")))
        out = ingest.run_to_table(s, str(tmp_path / "out"))
    got = sorted((r["key"], r["at"], r["status"]) for r in out.collect())
    want = [("a", day(0), "active"), ("a", day(35), "dormant"), ("a", day(61), "active"), ("a", day(91), "dormant"), ("b", day(0), "active"), ("b", day(30), "dormant"), ("b", day(60), "active"), ("b", day(90), "dormant"), ("d", day(200), "active")]
    assert got == want


def test_sessions_join_over_a_late_row(spark, tmp_path):
    hour = lambda n: dt.datetime(2024, 1, 1) + dt.timedelta(hours=n)
    for rows in ([("a", hour(0)), ("a", hour(8)), ("b", hour(1))], [("a", hour(4)), ("b", hour(30)), ("c", None)], [("a", hour(60)), ("z", hour(90))]):
        spark.createDataFrame(rows, "key string, at timestamp").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        s = ingest.sessions(spark.readStream.schema("key string, at timestamp").parquet(str(tmp_path / "in")), hours=5, delay="6 hours")
        out = ingest.run_to_table(s, str(tmp_path / "out"))
    assert sorted((r.key, r.first_at, r.last_at, r.n) for r in out.collect()) == [("a", hour(0), hour(8), 3), ("a", hour(60), hour(60), 1), ("b", hour(1), hour(1), 1), ("b", hour(30), hour(30), 1)]
