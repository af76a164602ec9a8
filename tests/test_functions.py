"""Literal cases for the scalar functions."""

import datetime

from pyspark.sql import functions as F

from quillstream.functions import classify, dates, ident, text


def value(spark, column_of, *args):
    df = spark.createDataFrame([args], ", ".join(f"c{i} string" for i in range(len(args))))
    return df.select(column_of(*[F.col(f"c{i}") for i in range(len(args))]).alias("v")).head()["v"]


def test_tokens(spark):
    assert value(spark, text.tokenize, "起訴書") == ["起訴", "訴書"]
    assert value(spark, text.tokenize, "起訴,書 Ａbc１ é2") == ["起訴", "書", "abc1", "2"]
    assert value(spark, text.tokenize, "") == []


def test_case_numbers(spark):
    want = "111年度金重訴字第123號"
    for raw in ("111年度金重訴字第123號", "111 年度 金重訴 字第 123 號", "１１１年度金重訴字第１２３號", "111年金重訴字第123號", "111年度金重訴字123號"):
        assert value(spark, ident.extract_case_numbers, raw) == [want]
    assert value(spark, ident.normalize_case_number, "none") is None
    assert value(spark, ident.extract_case_numbers, "臺北 110年度臺上字第0007號, 110年度台上字第7號") == ["110年度台上字第7號"]


def test_tax_ids(spark):
    for v, ok in (("22099131", True), ("04541302", True), ("12345678", False), ("1234567", False)):
        assert value(spark, ident.is_valid_tax_id, v) is ok
    assert value(spark, ident.extract_tax_ids, "統編22099131、22099131與122099131") == ["22099131"]
    assert value(spark, ident.normalize_tender_id, " ab–１２_3 ") == "AB-12-3"


def test_dates(spark):
    d = datetime.date
    assert value(spark, dates.parse_date, "於2026年3月5日") == d(2026, 3, 5)
    assert value(spark, dates.parse_date, "中華民國111年3月5日") == d(2022, 3, 5)
    assert value(spark, dates.parse_date, "111.03.05") is None
    assert value(spark, lambda c: dates.parse_date(c, True), "111.03.05") == d(2022, 3, 5)
    assert value(spark, dates.parse_date, "2026-13-40") is None
    for t, peak in (("2026-08-31 02:00:00", True), ("2026-08-31 12:00:00", False), ("2026-08-29 02:00:00", False), ("2026-08-31 04:00:00", False)):
        assert value(spark, lambda c: dates.is_peak(c.cast("timestamp")), t) is peak


def test_titles_and_urls(spark):
    assert value(spark, text.title_term, "京華城容積案") == "京華城容積"
    assert value(spark, text.title_term, "南方澳大橋斷橋") == "南方澳大橋斷橋"
    assert value(spark, text.is_generic_term, "李姓男子") is True
    assert value(spark, text.looks_like_company, "大成營造") is True
    assert value(spark, text.normalize_url, "http://a/b?UTM_source=1&x=2&ref=3#top") == "http://a/b?x=2"
    assert value(spark, text.normalize_url, "http://a/b?ref=3") == "http://a/b"


def test_relevance(spark):
    r = value(spark, classify.assess_relevance, "立法院院會", "天氣")
    assert r["relevant"] is False
    r = value(spark, classify.assess_relevance, "台北地方法院", "被告遭起訴")
    assert r["relevant"] and set(r["signals"]) == {"judicial_body", "judicial_process"}


def test_wording(spark):
    gate = lambda final: (lambda c: classify.wording_violations(c, F.lit(final)))
    assert [v["term"] for v in value(spark, gate(False), "他已定讞，定讞")] == ["定讞", "定讞"]
    assert value(spark, gate(True), "他已定讞") == []
    assert value(spark, gate(False), "法院一審判決A有罪，處有期徒刑8年") == []
    assert [(v["term"], v["position"]) for v in value(spark, gate(False), "A有罪")] == [("有罪", 1)]
