"""Scalar functions over columns made of the given tables; each oracle builds what should come out of the same rows without the function."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstream.functions import classify, courts, dates, ident
from quillstream.functions import text as tx
from quillstream.plans.registry import QUERIES, Query, read


def _scalar(name: str, table: str, key: str, made: str, f: Callable[[Column], Column], got: str) -> None:
    """f over the Spark expression `made` of each row; the oracle's expression `got` says what it gives."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        return read(spark, d, table).select(key, F.expr(made).alias("x")).select(key, f(F.col("x")).alias("got"))

    QUERIES[name] = Query(run, f"select {key}, {got} as got from {table}")


def _pick(k: str, values: list[str], spark: bool = True) -> str:
    """The value at k modulo their number, in both engines."""
    quoted = ", ".join("'" + v.replace("'", "''") + "'" for v in values)
    return f"element_at(array({quoted}), cast({k} % {len(values)} + 1 as int))" if spark else f"[{quoted}][({k} % {len(values)} + 1)::int]"


def _wide(x: str) -> str:
    """Digits and letters in full width."""
    ascii_ = "".join(chr(c) for c in [*range(48, 58), *range(65, 91), *range(97, 123)])
    return f"translate({x}, '{ascii_}', '{''.join(chr(ord(c) + 0xFEE0) for c in ascii_)}')"


_scalar("H1_half_width", "customer", "c_custkey", _wide("c_name") + " || '　（' || c_custkey || '）'", tx.to_halfwidth, "c_name || ' (' || c_custkey || ')'")
_scalar(
    "H3_bigrams", "orders", "o_orderkey", "'起訴' || (case when o_orderkey % 2 = 0 then '，' else '' end) || '書 ' || o_orderstatus || o_orderkey || ' 世'", lambda c: F.array_join(tx.tokenize(c), " "),
    "case when o_orderkey % 2 = 0 then '起訴 書' else '起訴 訴書' end || ' ' || lower(o_orderstatus) || o_orderkey || ' 世'",
)
_YEAR = "(80 + o_custkey % 40)"
_scalar(
    "H11_case_number", "orders", "o_orderkey",
    f"case o_orderkey % 4 when 0 then {_YEAR} || '年度金訴字第' || o_orderkey || '號' when 1 then '見 ' || {_YEAR} || ' 年度 金訴 字 第 0' || o_orderkey || ' 號判決' when 2 then {_wide(_YEAR + ' || ' + repr('年金訴字') + ' || o_orderkey')} || '號' else '第' || o_orderkey || '號' end",
    ident.normalize_case_number, f"case when o_orderkey % 4 < 3 then {_YEAR} || '年度金訴字第' || o_orderkey || '號' end",
)
_TAX = "lpad(cast((o_orderkey * 7919 + {n}) % 100000000 as {t}), 8, '0')"


def _tax_ok(n: int) -> str:
    """Whether the id is valid: sums of the digits of eight products, in DuckDB."""
    x = _TAX.format(n=n, t="varchar")
    total = "list_sum([(p // 10) + p % 10 for p in [substr({x}, i, 1)::int * [1, 2, 1, 2, 1, 2, 4, 1][i] for i in range(1, 9)]])".format(x=x)
    return f"({total} % 5 = 0 or (substr({x}, 7, 1) = '7' and ({total} + 1) % 5 = 0))"


_scalar("H13_tax_id", "orders", "o_orderkey", f"case when o_orderkey % 9 = 0 then 'x' || o_orderkey else {_TAX.format(n=0, t='string')} end", ident.is_valid_tax_id, f"case when o_orderkey % 9 = 0 then false else {_tax_ok(0)} end")
_scalar(
    "H14_tax_ids", "orders", "o_orderkey", f"'統編' || {_TAX.format(n=0, t='string')} || '與' || {_TAX.format(n=5, t='string')} || '、' || {_TAX.format(n=0, t='string')} || '，1' || {_TAX.format(n=5, t='string')}",
    lambda c: F.array_join(ident.extract_tax_ids(c), ","),
    f"concat_ws(',', case when {_tax_ok(0)} then {_TAX.format(n=0, t='varchar')} end, case when {_tax_ok(5)} then {_TAX.format(n=5, t='varchar')} end)",
)
_scalar("H15_tender_id", "part", "p_partkey", f"{_wide(repr('ab'))} || ' c' || {_pick('p_partkey', ['–', '—', '＿', '-'])} || ' ' || p_partkey", ident.normalize_tender_id, "'ABC-' || p_partkey")
_scalar(
    "H16_parse_date", "orders", "o_orderkey",
    "case o_orderkey % 6 when 0 then '於 ' || date_format(o_orderdate, 'yyyy-MM-dd') || ' 判決' when 1 then date_format(o_orderdate, 'yyyy/M/d') when 2 then date_format(o_orderdate, 'yyyy 年 M 月 d 日') when 3 then '中華民國' || (year(o_orderdate) - 1911) || date_format(o_orderdate, '年M月d日') when 4 then (year(o_orderdate) - 1911) || date_format(o_orderdate, '年M月d日') else date_format(o_orderdate, 'yyyy') || '-02-30' end",
    lambda c: dates.parse_date(c).cast("string"), "case when o_orderkey % 6 < 4 then strftime(o_orderdate, '%Y-%m-%d') end",
)
_UTC, _LOCAL = "cast(ts as timestamp_ntz)", "cast(ts as timestamp_ntz) + interval 8 hours"
_scalar(
    "H17_date_time", "events", "event_id", f"case event_id % 4 when 0 then date_format({_UTC}, \"yyyy-MM-dd'T'HH:mm:ss'Z'\") when 1 then date_format({_LOCAL}, \"yyyy-MM-dd'T'HH:mm:ss'+08:00'\") when 2 then date_format({_UTC}, 'yyyy-MM-dd HH:mm:ss') else date_format({_UTC}, 'yyyy-MM-dd') end",
    lambda c: F.unix_timestamp(dates.parse_datetime(c)), "case when event_id % 4 < 3 then epoch_us(ts) // 1000000 end",
)
_scalar(
    "H18_feed_time", "events", "event_id", f"case event_id % 4 when 0 then date_format({_LOCAL}, \"E, dd MMM yyyy HH:mm:ss '+0800'\") when 1 then date_format({_UTC}, \"E,dd MMM yyyy  HH:mm:ss 'GMT'\") when 2 then date_format({_UTC}, \"d MMM yyyy HH:mm:ss\") else 'on ' || event_id end",
    lambda c: F.unix_timestamp(dates.parse_rfc822(c)), "case when event_id % 4 < 3 then epoch_us(ts) // 1000000 end",
)
_scalar(
    "H19_slash_time", "events", "event_id", f"case event_id % 4 when 0 then date_format({_LOCAL}, 'yyyy/MM/dd HH:mm:ss') when 1 then date_format({_LOCAL}, 'yyyy/M/d H:mm') when 2 then date_format({_LOCAL}, 'yyyy-MM-dd HH:mm:ss') else date_format({_LOCAL}, 'HH:mm') end",
    lambda c: F.unix_timestamp(dates.parse_slash_datetime(c)), "case event_id % 4 when 0 then epoch_us(ts) // 1000000 when 1 then epoch_us(ts) // 60000000 * 60 when 2 then epoch_us(ts) // 1000000 end",
)
_scalar(
    "H20_short_fraction", "events", "event_id", f"date_format({_UTC}, \"yyyy-MM-dd'T'HH:mm:ss\") || '.' || (event_id % 9 + 1) || case when event_id % 2 = 0 then 'Z' else '' end",
    lambda c: F.unix_millis(dates.parse_short_fraction(c)), "epoch_us(ts) // 1000000 * 1000 + (event_id % 9 + 1) * 100",
)
_ENDS = ["案", "弊案", "案件", "疑雲", "斷橋"]
_TITLE = "case when o_orderkey % 7 = 0 then '某' else '第' || o_orderkey end"
_scalar(
    "H26_title_term", "orders", "o_orderkey", f"{_TITLE} || {_pick('o_orderkey', _ENDS)}", tx.title_term,
    f"case when o_orderkey % 5 = 4 then {_TITLE} || '斷橋' when o_orderkey % 7 <> 0 then {_TITLE} when o_orderkey % 5 = 1 then '某弊' when o_orderkey % 5 = 2 then '某案件' else '某' || {_pick('o_orderkey', _ENDS, False)} end",
)
_GENERIC = ["", "男", "男子", "嫌", "小明", "董事"]
_scalar("H27_generic_term", "orders", "o_orderkey", f"case when o_orderkey % 11 = 0 then '王' else '王姓' || {_pick('o_orderkey', _GENERIC)} end", tx.is_generic_term, "o_orderkey % 11 = 0 or o_orderkey % 6 < 4")
_scalar("H28_company", "customer", "c_custkey", f"c_mktsegment || {_pick('c_custkey', ['公司', '營造', '公司法', '', '事務所'])}", tx.looks_like_company, "c_custkey % 5 in (0, 1, 4)")
_CITIES, _SHORTS = ["台北", "臺中", "橋頭", "花蓮"], ["院", "地院", "地檢署", "地方檢察署"]
_scalar(
    "H25_courts", "orders", "o_orderkey", f"case o_orderkey % 5 when 0 then '台灣' || {_pick('o_custkey', _CITIES)} || '地方法院' when 1 then ' 高檢 ' when 2 then {_pick('o_custkey', _CITIES)} when 3 then null else {_pick('o_custkey', _CITIES)} || {_pick('o_orderkey div 5', _SHORTS)} end",
    courts.normalize_court,
    f"case o_orderkey % 5 when 0 then replace('台灣' || {_pick('o_custkey', _CITIES, False)} || '地方法院', '台灣', '臺灣') when 1 then '臺灣高等檢察署' when 2 then {_pick('o_custkey', _CITIES, False)} when 3 then '' else '臺灣' || replace({_pick('o_custkey', _CITIES, False)}, '台', '臺') || case when o_orderkey // 5 % 4 < 2 then '地方法院' else '地方檢察署' end end",
)
_KINDS = ["judicial_process", "corruption_charge", "oversight", "judicial_body,corruption_charge", ""]
_scalar("H24_schemas", "events", "event_id", _pick("event_id", _KINDS), lambda c: classify.choose_schema(F.split(c, ",")), _pick("event_id", ["judicial", "corruption", "generic", "judicial", "generic"], False))
_NEWS = ["立法院院會", "台北地方法院開庭", "今天天氣晴", "檢方起訴被告", "113年度金訴字第51號", ""]
_scalar("H23_relevance", "orders", "o_orderkey", f"{_pick('o_orderkey', _NEWS)} || case when o_orderkey % 6 = 2 then cast(o_custkey as string) else '' end", lambda c: classify.assess_relevance(c, F.lit(""))["relevant"], "o_orderkey % 6 in (1, 3, 4)")
_CLAIMS = ["他已定讞，定讞", "法院一審判決A有罪，處有期徒刑8年", "A有罪", ""]
_scalar("H22_wording", "orders", "o_orderkey", f"{_pick('o_orderkey', _CLAIMS)} || o_custkey", lambda c: F.array_join(F.transform(classify.wording_violations(c, F.lit(False)), lambda v: v["term"]), ","), _pick("o_orderkey", ["定讞,定讞", "", "有罪", ""], False))
_QUERY = ["?UTM_source=1&x={k}&ref=3#top", "?ref={k}", "", "?x=1&y={k}#z"]
_KEPT = ["?x={k}", "", "", "?x=1&y={k}"]
_scalar("H21_url_rules", "pages", "page_id", f"substring_index(substring_index(url, '#', 1), '?', 1) || replace({_pick('page_id', _QUERY)}, '{{k}}', cast(page_id as string))", tx.normalize_url, f"split_part(split_part(url, '#', 1), '?', 1) || replace({_pick('page_id', _KEPT, False)}, '{{k}}', page_id::varchar)")
_scalar(
    "H21_relative_urls", "pages", "page_id", _pick("page_id", ["../c?d={k}", "/x/./y{k}", "//o/z{k}", "http://q/{k}", "", "e{k}"]).replace("element_at", "replace(element_at") + ", '{k}', cast(page_id as string))",
    lambda c: tx.resolve_url(c, F.lit("http://h/a/b")), f"replace({_pick('page_id', ['http://h/c?d={k}', 'http://h/x/y{k}', 'http://o/z{k}', 'http://q/{k}', '', 'http://h/a/e{k}'], False)}, '{{k}}', page_id::varchar)",
)
_scalar("H31_clean_titles", "events", "event_id", f"'  ' || event_type || '   ' || event_id || case when event_id % 3 = 0 then ' at 09:30 sharp' else date_format({_UTC}, '  H:mm') end || ' '", tx.clean_title, "event_type || ' ' || event_id || case when event_id % 3 = 0 then ' at 09:30 sharp' else '' end")
_scalar(
    "H36_cut_replies", "customer", "c_custkey", r"""case c_custkey % 4 when 0 then '{"reply": "' || c_name when 1 then '{"x": 1, "reply" : "' || c_name || '\\"q\\"", "y":' when 2 then '{"reply": "' || c_name || '\\nb"}' else c_name end""",
    tx.salvage_reply, """case c_custkey % 4 when 0 then c_name when 1 then c_name || '"q"' when 2 then c_name || chr(10) || 'b' end""",
)
_scalar("H29_embedding_text", "documents", "doc_id", "text", lambda c: tx.embedding_text(F.concat(F.lit("t"), F.col("doc_id").cast("string")), c), r"regexp_replace(left('t' || doc_id || chr(10) || 't' || doc_id || coalesce(chr(10) || text, ''), 2000), '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g')")
