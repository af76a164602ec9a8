"""Literal payloads for each parser, with the broken ones that must give an error row."""

import datetime as dt
import json

from quillstream.functions import courts, text
from quillstream.functions import dates as D
from quillstream.sources import parsers


def parse(spark, name, *raws, base=""):
    df = spark.createDataFrame([(i, r, base) for i, r in enumerate(raws)], "raw_id long, raw string, base_url string")
    return [r.asDict() for r in parsers.parse(name, df).orderBy("raw_id", "pos").collect()]


def value(spark, f, *args):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([args], ", ".join(f"c{i} string" for i in range(len(args))))
    return df.select(f(*[F.col(f"c{i}") for i in range(len(args))]).alias("v")).head()["v"]


def utc(*a):
    """How collect() shows a UTC instant: in the machine's zone, without a zone."""
    return dt.datetime(*a, tzinfo=dt.timezone.utc).astimezone().replace(tzinfo=None)


RSS = """<?xml version="1.0"?><rss version="2.0"><channel><title>feed</title>
<item><title> One </title><link>/a/1?utm_source=x&amp;id=7#top</link><pubDate>Sat,29 Aug 2026 19:24:00  +0800</pubDate><guid>g1</guid></item>
<item><title></title><link>/a/2</link></item></channel></rss>"""
ATOM = """<feed xmlns="http://www.w3.org/2005/Atom"><entry><title>T</title><link rel="self" href="http://x/self"/><link href="http://x/1"/><updated>2026-08-30T01:02:03Z</updated><author><name>Ann</name></author><id>i1</id></entry></feed>"""


def test_feeds(spark):
    one, two, page, none, null = parse(spark, "rss", RSS, ATOM, "<html><p>down</p></html>", "<rss><channel><item><title/></item></channel></rss>", None, base="http://n.test/list")
    assert (one["url"], one["title"], one["published_at"], one["external_id"], one["body"]) == ("http://n.test/a/1?id=7", "One", utc(2026, 8, 29, 11, 24), "g1", "")
    assert (two["url"], two["author"], two["published_at"]) == ("http://x/1", "Ann", utc(2026, 8, 30, 1, 2, 3))
    assert all(r["error"] and r["url"] is None for r in (page, none, null))
    assert parse(spark, "rss", "<rss><channel></channel></rss>") == []


def test_lists(spark):
    html = '<h3 class="news-title big"><a href="/news/2026-1"><img src=x></a></h3><h3 class="news-title"><a href="/news/2026-1?ref=1">Title  one 09:30</a></h3><p><a href="/news/2026-2">elsewhere</a></p><h3 class="news-title"><a href="/tag/x">tag</a></h3>'
    good, bad = parse(spark, "ctee", html, "<p>closed</p>", base="https://c.test")
    assert (good["url"], good["title"]) == ("https://c.test/news/2026-1", "Title one") and bad["error"]
    assert parse(spark, "pts", '<a href="/article/5">x</a>', base="https://p.test")[0]["url"] == "https://p.test/article/5"


def test_json_lists(spark):
    cna = json.dumps({"ResultData": {"Items": [{"PageUrl": "/n/1", "HeadLine": " h ", "CreateTime": "2026/08/30 22:09", "Id": 5}, {"PageUrl": "", "HeadLine": "x"}]}})
    good, bad = parse(spark, "json_slash", cna, "{oops", base="https://c.test/")
    assert (good["url"], good["title"], good["published_at"], good["external_id"]) == ("https://c.test/n/1", "h", utc(2026, 8, 30, 14, 9), "5") and bad["error"] == "not JSON"
    item = {"url": "https://l.test/1", "title": "t", "time": "09:39", "no": 3}
    for data in ([item], {"a": item}):
        (row,) = parse(spark, "json_data", "﻿" + json.dumps({"data": data}))
        assert (row["url"], row["published_at"], row["external_id"]) == ("https://l.test/1", None, "3")
    (row,) = parse(spark, "json_records", json.dumps({"data": {"records": [{"slug": "s", "title": "t", "published_date": "2026-08-30T00:00:00Z", "id": "1"}, {"slug": "", "title": "t"}]}}))
    assert row["url"].endswith("/a/s") and row["published_at"] == utc(2026, 8, 30)


def test_sitemap(spark):
    a, b = parse(spark, "sitemap", "<urlset><url><loc> https://s.test/1?fbclid=2 </loc><lastmod>2026-01-01T00:00:00Z</lastmod><news:title>N</news:title><news:publication_date>2026-01-02T08:00:00+08:00</news:publication_date></url><url><loc>https://s.test/2</loc></url><url></url></urlset>")
    assert (a["url"], a["title"], a["published_at"]) == ("https://s.test/1", "N", utc(2026, 1, 2)) and (b["title"], b["published_at"]) == ("", None)


def test_judgment(spark):
    html = "<p>臺灣臺北地方法院刑事判決 111年度金訴字第12號</p><p>被　告 王小明 選任</p><p>於中華民國110年1月1日犯案，其後經過相當長之一段期間，始由有關機關查得並移送到案處理之。</p><p>中　華　民　國 112 年 3 月 5 日 刑事第一庭 審判長法官</p>"
    one, = parse(spark, "judicial", html, "<p>no case</p>", base="https://j.test/1")
    assert one["title"] == "臺灣臺北地方法院111年度金訴字第12號判決" and one["published_at"] == utc(2023, 3, 5) and one["external_id"] == "111年度金訴字第12號"


def test_case_json(spark):
    case = {"JID": "a", "JYEAR": "111", "JCASE": "金重訴", "JNO": "007", "JDATE": "20220305", "JTITLE": "貪污", "JFULL": "full", "JPDF": "https://p"}
    one, = parse(spark, "case_json", json.dumps(case), json.dumps(case | {"JTITLE": "聲請保護令"}), json.dumps(case | {"JPDF": ""}), "{")
    assert (one["title"], one["published_at"], one["body"]) == ("貪污（111年度金重訴字第7號）", utc(2022, 3, 5), "full")


def test_oversight(spark):
    html = '<table><tr><th>x</th></tr><tr><td>115/07/28</td><td> 115年院台字第 12 號 </td><td>a  b</td><td><a href="CyBsBoxContent.aspx?n=1&amp;s=2">f</a></td></tr></table>'
    one, bad = parse(spark, "control-yuan", html, "<p/>", base="https://y.test/x/list")
    assert (one["url"], one["title"], one["published_at"]) == ("https://y.test/x/CyBsBoxContent.aspx?n=1&s=2", "115年院台字第12號 a b", utc(2026, 7, 28, 4)) and bad["error"]


def test_tenders(spark):
    record = {"date": 20240925, "brief": {"type": "決標公告", "title": "橋", "companies": {"ids": ["22099131"], "names": ["大成"]}}, "job_number": "J1", "unit_name": "局", "url": "/t/1"}
    one, two = parse(spark, "procurement", json.dumps({"records": [record, record | {"date": 20249999}, {"brief": {}}]}))
    assert (one["title"], one["body"], one["published_at"]) == ("決標公告｜橋（22099131）", "決標公告 ｜ 局 ｜ 橋 ｜ 得標／投標：大成", utc(2024, 9, 25, 4)) and two["published_at"] is None


def test_text_file(spark):
    file = "網址：https://u.test/1?x=2\n標題： 題 \n日期：2020-05-06\n記者：甲\n" + "-" * 40 + "\n內文\n付費訂戶專屬深度報導 more"
    one, = parse(spark, "text_file", file, "no separator", "標題：x\n" + "-" * 40, None)
    assert (one["url"], one["title"], one["author"], one["body"], one["published_at"]) == ("https://u.test/1", "題", "甲", "內文", utc(2020, 5, 6, 12))


def test_unknown_parser(spark):
    import pytest

    with pytest.raises(KeyError):
        parsers.parse("nope", None)


def test_dates(spark):
    assert value(spark, D.parse_datetime, "2026-08-30T01:02:03.5+08:00") == utc(2026, 8, 29, 17, 2, 3, 500000)
    assert value(spark, D.parse_datetime, "2026-08-30 01:02:03") == utc(2026, 8, 30, 1, 2, 3)
    assert value(spark, D.parse_datetime, "2026-08-30") is None and value(spark, D.parse_datetime, "2026-13-30T01:02:03") is None
    assert value(spark, D.parse_rfc822, "Mon, 31 Aug 2026 02:00:00 GMT") == utc(2026, 8, 31, 2)
    assert value(spark, D.parse_short_fraction, "2026-08-30T01:02:03.95+08:00") == utc(2026, 8, 29, 17, 2, 3, 950000)


def test_courts_and_replies(spark):
    for raw, want in (("台北地院", "臺灣臺北地方法院"), ("北檢", "臺灣臺北地方檢察署"), ("台灣高等法院", "臺灣高等法院"), ("地院", "地院"), (None, "")):
        assert value(spark, courts.normalize_court, raw) == want
    assert value(spark, text.model_json, '```json\n{"a": 1}\n```') == '{"a": 1}\n' and value(spark, text.model_json, " {} ") == "{}"
    assert value(spark, text.salvage_reply, '{"reply": "a \\"b\\"\\nc') == 'a "b"\nc' and value(spark, text.salvage_reply, "x") is None
    for url, want in (("../c?d=1", "http://h/c?d=1"), ("/x/./y", "http://h/x/y"), ("//o/z", "http://o/z"), ("http://q/", "http://q/"), ("", ""), ("e", "http://h/a/e")):
        assert value(spark, text.resolve_url, url, "http://h/a/b") == want


def test_articles(spark):
    from quillstream.sources import articles

    long = "句" * 90
    ld = '<script type="application/ld+json">' + json.dumps({"@graph": [{"headline": " A  b ", "author": {"name": "Ann"}, "datePublished": "2026-08-30T08:00:00+08:00", "articleBody": f"▲ caption\n{long}\n\n（圖／x）\nend"}]}) + "</script>"
    block = f'<meta property="article:published_time" content="2026-08-30T00:00:00Z"><title>T</title><article><p>{long}</p><script>no</script></article><p>out</p>'
    df = spark.createDataFrame([(1, ld, None), (2, block, "ctee"), (3, "<p>x</p>", "ctee"), (4, None, None), (5, '<script type="application/ld+json">{</script>', None)], "page_id long, html string, source string")
    a, b, *bad = articles.extract_articles(df).orderBy("page_id").collect()
    assert (a["body"], a["title"], a["author"], a["published_at"], a["strategy"]) == (f"{long}\nend", "A b", "Ann", utc(2026, 8, 30), "json-ld")
    assert (b["body"], b["title"], b["published_at"], b["strategy"]) == (long, "T", utc(2026, 8, 30), "selector")
    assert all(r["error"] and r["body"] is None for r in bad) and len(bad) == 3
    raw = json.dumps({"data": {"title": "T", "published_date": "2026-08-30T00:00:00Z", "content": {"api_data": [{"type": "unstyled", "content": [f"<b>{long}</b><!-- x -->"]}, {"type": "image", "content": ["no"]}, {"type": "infobox", "content": [{"body": "<p>box</p>"}]}]}}})
    c, d = articles.block_articles(spark.createDataFrame([(1, raw, None), (2, "{", None)], df.schema)).orderBy("page_id").collect()
    assert c["body"] == f"{long}\nbox" and d["error"] == "not JSON"
