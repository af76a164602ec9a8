"""What scalar functions give for single values; the registered queries run them over whole columns."""

import pytest
from pyspark.sql import functions as F

from quillstream.functions import classify, courts, dates, fingerprint, ident
from quillstream.functions import text as tx

CASES = [
    ("H1_half_width", [("ＡＢＣ１２３", "ABC123"), ("（測試）　x", "(測試) x"), ("", ""), ("plain", "plain")], tx.to_halfwidth),
    ("H3_bigrams", [("起訴書", "起訴 訴書"), ("起訴，書", "起訴 書"), ("Ａ1 起", "a1 起"), ("", ""), ("Hello, 世界", "hello 世界")], lambda c: F.array_join(tx.tokenize(c), " ")),
    ("H11_case_number", [("113年度金訴字第51號", "113年度金訴字第51號"), ("113 年度 金訴 字 第 51 號", "113年度金訴字第51號"), ("１１３年度金訴字第５１號", "113年度金訴字第51號"), ("113年金訴字第051號", "113年度金訴字第51號"), ("113年度金訴字51號", "113年度金訴字第51號"), ("no case", None)], ident.normalize_case_number),
    ("H13_tax_id", [("22099131", True), ("04541302", True), ("12345678", False), ("1234567", False), ("2209913a", False)], ident.is_valid_tax_id),
    ("H14_tax_ids", [("統編22099131與12345678", "22099131"), ("04541302 22099131 04541302", "04541302,22099131"), ("122099131", ""), (None, "")], lambda c: F.array_join(ident.extract_tax_ids(c), ",")),
    ("H15_tender_id", [("ab 12–3", "AB12-3"), ("ＡＢ＿１", "AB-1")], ident.normalize_tender_id),
    ("H16_parse_date", [("2024-03-05", "2024-03-05"), ("on 2024/3/5.", "2024-03-05"), ("中華民國113年3月5日", "2024-03-05"), ("113年3月5日", None), ("2024-02-30", None), ("none", None)], lambda c: dates.parse_date(c).cast("string")),
    ("H19_slash_time", [("2024/03/05 09:30", 1709602200), ("2024/03/05 09:30:15", 1709602215), ("09:30", None)], lambda c: F.unix_timestamp(dates.parse_slash_datetime(c))),
    ("H20_feed_time", [("Tue, 05 Mar 2024 09:30:00 +0800", 1709602200), ("Tue,05 Mar 2024 01:30:00 GMT", 1709602200), ("2024-03-05T01:30:00Z", 1709602200), ("x", None)], lambda c: F.unix_timestamp(dates.parse_rfc822(c))),
    ("H26_title_term", [("京華城容積案", "京華城容積"), ("某弊案", "某弊"), ("南方澳大橋斷橋", "南方澳大橋斷橋"), ("一二三四疑雲", "一二三四")], tx.title_term),
    ("H27_generic_term", [("王姓男子", True), ("王姓", True), ("王", True), ("王小明", False), ("沈慶京", False)], tx.is_generic_term),
    ("H28_company", [("大有公司", True), ("某營造", True), ("公司法", False), ("沈慶京", False)], tx.looks_like_company),
    ("H18_date_time", [("2024-03-05T01:30:00+08:00", 1709573400), ("2024-03-05 01:30:00", 1709602200), ("2024-03-05", None)], lambda c: F.unix_timestamp(dates.parse_datetime(c))),
    ("H21_url_rules", [("http://a/b?UTM_source=1&x=2&ref=3#top", "http://a/b?x=2"), ("http://a/b?ref=3", "http://a/b"), ("http://a/b", "http://a/b"), ("http://a/b?x=1&y=2", "http://a/b?x=1&y=2")], tx.normalize_url),
    ("H25_courts", [("北院", "臺灣臺北地方法院"), ("台北地檢署", "臺灣臺北地方檢察署"), ("台灣高等法院", "臺灣高等法院"), ("最高檢", "最高檢察署"), ("橋頭地院", "臺灣橋頭地方法院"), ("地院", "地院"), (None, "")], courts.normalize_court),
    ("H23_schemas", [("judicial_process", "judicial"), ("corruption_charge", "corruption"), ("oversight", "generic"), ("judicial_body,corruption_charge", "judicial"), ("", "generic")], lambda c: classify.choose_schema(F.split(c, ","))),
    ("P16_relevance", [("立法院院會", False), ("台北地方法院開庭", True), ("今天天氣晴", False), ("檢方起訴被告", True), ("113年度金訴字第51號", True), ("", False)], lambda c: classify.assess_relevance(c, F.lit(""))["relevant"]),
    ("H22_wording", [("他已定讞，定讞", "定讞,定讞"), ("法院一審判決A有罪，處有期徒刑8年", ""), ("A有罪", "有罪"), ("", "")], lambda c: F.array_join(F.transform(classify.wording_violations(c, F.lit(False)), lambda v: v["term"]), ",")),
    ("H31_relative_urls", [("../c?d=1", "http://h/c?d=1"), ("/x/./y", "http://h/x/y"), ("//o/z", "http://o/z"), ("http://q/", "http://q/"), ("", ""), ("e", "http://h/a/e")], lambda c: tx.resolve_url(c, F.lit("http://h/a/b"))),
    ("H30_clean_titles", [("  A   b  09:30", "A b"), ("A 9:05", "A"), ("at 09:30 sharp", "at 09:30 sharp")], tx.clean_title),
    ("H36_cut_replies", [('{"reply": "a \\"b\\"', 'a "b"'), ("x", None), ('{"reply": "whole"}', "whole")], tx.salvage_reply),
]


@pytest.mark.parametrize("name,cases,f", CASES, ids=[c[0] for c in CASES])
def test_cases(spark, name, cases, f):
    df = spark.createDataFrame([(i, x) for i, (x, _) in enumerate(cases)], "i int, x string").select("i", f(F.col("x")).alias("got"))
    assert [r.got for r in df.orderBy("i").collect()] == [want for _, want in cases]


def test_weighted_bits(spark):
    rows = list(enumerate(["a", "one two TWO three", "檢察官", "", None]))
    got = {r.i: r.simhash for r in fingerprint.with_simhash(spark.createDataFrame(rows, "i int, text string"), "i", "text").collect()}
    assert got == {0: 4681665781835383343, 1: 3811827784116995843, 2: -7779615825255659392, 3: 0, 4: 0}
