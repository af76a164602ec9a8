"""Rule classifications: relevance signals, corroboration, wording gate, risk tier, schema choice."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillstream.functions import ident

# Relevance terms by category.
TERMS = {
    "judicial_process": "起訴 不起訴 緩起訴 偵結 偵辦 偵查終結 偵查 判決 宣判 定讞 上訴 抗告 更審 再審 羈押 交保 具保 限制出境 限制出海 傳喚 約談 搜索 扣押 查扣 聲請簡易判決 開庭 辯論終結 言詞辯論 起訴書 判決書 判刑 有期徒刑 無期徒刑 緩刑 量刑 科刑 無罪 有罪 免訴 撤銷原判決 被告 犯嫌 涉犯 罪嫌".split(),
    "judicial_body": "地檢署 高檢署 最高檢 檢察署 檢察官 檢察總長 主任檢察官 北檢 新北檢 士檢 橋檢 中檢 南檢 雄檢 檢方 檢調 地方法院 高等法院 最高法院 智慧財產法院 懲戒法院 司法院 法官 調查局 廉政署 政風 刑事局".split(),
    "corruption_charge": "貪污 貪瀆 圖利 背信 瀆職 收賄 行賄 受賄 洗錢 偽造文書 內線交易 掏空 侵占 詐領 違背職務 不違背職務 貪污治罪條例 證券交易法".split(),
    "corruption_context": "弊案 弊端 回扣 綁標 圍標 關說 利益輸送 不法所得 犯罪所得 公款 採購案 標案 工程款".split(),
    "oversight": "彈劾 糾正案 糾舉 監察院 監委 審計部".split(),
}
# Terms that longer words must not trigger.
PATTERNS = {"judicial_body": {"法院": "(?<!立)法院", "高檢": "(?<![提拉升增])高檢"}}
STRONG = ("corruption_charge", "corruption_context", "oversight")
# The wording gate's terms and markers.
NEVER = "定讞 判刑確定 伏法 身陷囹圄 入獄服刑 已入獄 罪證確鑿 詐欺犯 貪污犯 圖利犯 詐騙犯 鋃鐺入獄".split()
CONDITIONAL = "有罪 服刑 定罪".split()
MARKERS = "法院 地院 高院 最高法院 庭 判決 諭知 裁定 宣判 求刑 一審 二審 三審 更審 量刑 判處".split()
NEAR = 15


def signals(text: Column) -> Column:
    """Map from category to its terms found in text, categories without any left out."""
    entries = []
    for category, terms in TERMS.items():
        plain = F.filter(F.array(*[F.lit(t) for t in terms]), lambda t: F.contains(text, t))
        marked = [F.when(text.rlike(p), F.lit(t)) for t, p in PATTERNS.get(category, {}).items()]
        found = F.array_compact(F.concat(plain, F.array(*marked))) if marked else plain
        entries.append(F.struct(F.lit(category).alias("key"), found.alias("value")))
    return F.map_from_entries(F.filter(F.array(*entries), lambda e: F.size(e["value"]) > 0))


def assess_relevance(title: Column, body: Column) -> Column:
    """struct<relevant, signals, has_identifier>; blank is not relevant."""
    text = F.concat_ws("\n", title, body)
    s = signals(text)
    context = F.arrays_overlap(F.map_keys(s), F.array(F.lit("corruption_charge"), F.lit("corruption_context")))
    case = F.size(ident.extract_case_numbers(text)) > 0
    identifier = case | ((F.size(ident.extract_tax_ids(text)) > 0) & context)
    return F.struct(((F.size(F.map_keys(s)) > 0) | case).alias("relevant"), s.alias("signals"), identifier.alias("has_identifier"))


def is_corroborated(categories: Column, has_identifier: Column) -> Column:
    return F.arrays_overlap(categories, F.array(*[F.lit(c) for c in STRONG])) | has_identifier | (F.size(categories) >= 2)


def choose_schema(categories: Column) -> Column:
    has = lambda *c: F.arrays_overlap(categories, F.array(*[F.lit(x) for x in c]))
    return F.when(has("judicial_process", "judicial_body"), "judicial").when(has("corruption_charge", "corruption_context"), "corruption").otherwise("generic")


def wording_violations(text: Column, is_final: Column) -> Column:
    """array<struct<term, position>> of all violations; none where the case is final."""

    def spots(term: str) -> Column:
        n = F.regexp_count(text, F.lit(term))
        gaps = F.split(text, term)
        return F.when(n == 0, F.array().cast("array<int>")).otherwise(F.transform(F.sequence(F.lit(1), n), lambda k: F.aggregate(F.slice(gaps, F.lit(1), k), F.lit(0), lambda a, g: a + F.length(g)) + (k - 1) * len(term)))

    def hits(term: str, conditional: bool) -> Column:
        at = spots(term)
        if conditional:
            around = lambda p: F.concat(F.substring(text, F.greatest(F.lit(0), p - NEAR) + 1, F.least(p, F.lit(NEAR))), F.lit("|"), F.substring(text, p + len(term) + 1, F.lit(NEAR)))
            at = F.filter(at, lambda p: ~around(p).rlike("|".join(MARKERS)))
        return F.transform(at, lambda p: F.struct(F.lit(term).alias("term"), p.alias("position")))

    every = F.concat(*[hits(t, False) for t in NEVER], *[hits(t, True) for t in CONDITIONAL])
    return F.when(is_final | text.isNull(), F.array().cast("array<struct<term:string,position:int>>")).otherwise(every)


def risk_tier(n_persons: Column, n_unresolved: Column) -> Column:
    """No named person: low; any whose case is not final: high; else medium."""
    return F.when(n_persons == 0, "low").when(n_unresolved > 0, "high").otherwise("medium")
