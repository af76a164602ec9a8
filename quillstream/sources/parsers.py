"""Parsers from raw payloads to documents, by name.

Each takes rows (raw_id, raw, base_url) and returns rows (raw_id, pos, url, title, body, published_at, author, external_id, error).
A payload that is not what the parser expects gives one row with an error and no url, so that a source that changed its pages
is told from one without news. JSON, site maps, judgments, tenders and text files are parsed by expressions; feeds and HTML lists
in Arrow batches, one payload at a time.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin, urlsplit, urlunsplit
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstream.functions import dates, ident
from quillstream.functions import text as tx

Parser = Callable[[DataFrame], DataFrame]
PARSERS: dict[str, Parser] = {}
FIELDS = ("url", "title", "body", "published_at", "author", "external_id")
WHITE = r"(?U)^\s+|\s+$"

# Which links of a list page are articles. A chain is the open elements a link must lie in, outermost first.
LISTS = {
    "udn": (r"/news/story/\d+/\d+", [["div.story-list__text"], ["div.context-box__content"]]),
    "chinatimes": (r"/(?:realtimenews|newspapers|opinion)/\d{14}-\d+", [["h3.title"], ["section.article-list", "h3"]]),
    "ctee": (r"/news/\d+-\d+", [["h3.news-title"]]),
    "ettoday": (r"ettoday\.net/news/\d+", [["div.part_list_2", "h3"]]),
    "pts": (r"/article/\d+", [[]]),
}
# Case titles and categories that the law keeps from the public.
CONFIDENTIAL = "少年|少調|少友|保護令|暫時保護令|妨害性自主|性侵害|性騷擾|兒童及少年性剝削|家庭暴力|家暴"
# Court names, decision dates and what must follow them, defendants.
COURT = r"(臺灣|台灣|最高|智慧財產及商業|懲戒)\S{0,10}法院"
DECIDED = r"(?U)中\s*華\s*民\s*國\s*\d{2,3}\s*年\s*\d{1,2}\s*月\s*\d{1,2}\s*日"
FOLLOWS = "(?=.{0,30}?(?:法官|法 官|審判長|庭))"
DEFENDANT = r"(?U)被\s*告\s+([^\s，。；、選任]{2,10})"
# Advertising that ends an article in a text file.
PROMOTIONS = ("你今年最好的選擇", "聯合報每天報版內容", "付費訂戶專屬深度報導", "《紐約時報》數位內容訂戶專屬權益")
TENDER_SITE = "https://pcc.g0v.ronny.tw"


def register(name: str) -> Callable[[Parser], Parser]:
    def wrap(f: Parser) -> Parser:
        PARSERS[name] = f
        return f

    return wrap


def parse(name: str, raws: DataFrame) -> DataFrame:
    """The rows of the parser of that name; an unknown name is an error."""
    if name not in PARSERS:
        raise KeyError(f"no parser {name!r}; there are {sorted(PARSERS)}")
    return PARSERS[name](raws)


def _out(df: DataFrame, **columns: Column) -> DataFrame:
    """The result's columns in order; those not given are null (body and author: empty)."""
    plain = {"body": F.lit(""), "author": F.lit(""), "published_at": F.lit(None).cast("timestamp"), "external_id": F.lit(""), "error": F.lit(None).cast("string")}
    c = plain | columns
    return df.select("raw_id", F.col("pos").cast("int").alias("pos"), c["url"].alias("url"), F.left(c["title"], F.lit(512)).alias("title"), c["body"].alias("body"), c["published_at"].alias("published_at"), F.left(c["author"], F.lit(128)).alias("author"), F.left(c["external_id"], F.lit(128)).alias("external_id"), c["error"].alias("error"))


def _text(c: Column) -> Column:
    return F.regexp_replace(F.coalesce(c, F.lit("")), WHITE, "")


# --- JSON lists
def _json_list(raws: DataFrame, items: Column, item_schema: str, url: Callable[[Column], Column], **fields: Callable[[Column], Column]) -> DataFrame:
    """Items without url or title are left out; a payload that is not JSON gives an error row."""
    ok = F.try_parse_json(F.regexp_replace("raw", "^﻿", "")).isNotNull()
    bad = _out(raws.filter(~F.coalesce(ok, F.lit(False))).withColumn("pos", F.lit(0)), url=F.lit(None).cast("string"), title=F.lit(None).cast("string"), error=F.lit("not JSON"))
    each = raws.filter(ok).select("raw_id", "base_url", F.posexplode(F.from_json(items, f"array<{item_schema}>")).alias("pos", "item"))
    item = F.col("item")
    got = {k: f(item) for k, f in fields.items()}
    good = _out(each.filter((F.coalesce(url(item), F.lit("")) != "") & (_text(got["title"]) != "")), url=tx.normalize_url(tx.resolve_url(url(item), F.coalesce("base_url", F.lit("")))), **(got | {"title": _text(got["title"]), "external_id": F.coalesce(got["external_id"], F.lit(""))}))
    return good.unionByName(bad)


@register("json_slash")
def json_slash(raws: DataFrame) -> DataFrame:
    """ResultData.Items of PageUrl, HeadLine, CreateTime and Id."""
    return _json_list(raws, F.get_json_object("raw", "$.ResultData.Items"), "struct<PageUrl:string,HeadLine:string,CreateTime:string,Id:string>", lambda i: i["PageUrl"], title=lambda i: i["HeadLine"], published_at=lambda i: dates.parse_slash_datetime(i["CreateTime"]), external_id=lambda i: i["Id"])


@register("json_data")
def json_data(raws: DataFrame) -> DataFrame:
    """data as a list, or as an object whose values are the items, of url, title, time and no."""
    raw = F.regexp_replace("raw", "^﻿", "")
    item = "struct<url:string,title:string,time:string,no:string>"
    data = F.get_json_object(raw, "$.data")
    values = F.to_json(F.map_values(F.from_json(data, f"map<string,{item}>")))
    return _json_list(raws, F.when(data.startswith("["), data).otherwise(values), item, lambda i: i["url"], title=lambda i: i["title"], published_at=lambda i: dates.parse_slash_datetime(i["time"]), external_id=lambda i: i["no"])


def _slug_list(items: str, date: str, prefix: str) -> Parser:
    """Items whose address is a prefix and their slug."""

    def run(raws: DataFrame) -> DataFrame:
        return _json_list(raws, F.get_json_object("raw", items), f"struct<slug:string,title:string,{date}:string,id:string>", lambda i: F.when(_text(i["slug"]) != "", F.concat(F.lit(prefix), _text(i["slug"]))), title=lambda i: i["title"], published_at=lambda i: dates.parse_datetime(i[date]), external_id=lambda i: i["id"])

    return run


PARSERS["json_records"] = _slug_list("$.data.records", "published_date", "https://www.twreporter.org/a/")
PARSERS["json_posts"] = _slug_list("$.data.posts", "publishedDate", "https://www.mirrormedia.mg/story/")


# --- site maps
def _tag(block: Column, tag: str) -> Column:
    return F.regexp_extract(block, rf"(?s)<{tag}>\s*(.*?)\s*</{tag}>", 1)


@register("sitemap")
def sitemap(raws: DataFrame) -> DataFrame:
    """Each <url> with a <loc>; a title only where the map gives one; the news date goes before lastmod."""
    each = raws.select("raw_id", "base_url", F.posexplode(F.regexp_extract_all(F.coalesce("raw", F.lit("")), F.lit("(?s)<url>(.*?)</url>"), F.lit(1))).alias("pos", "block")).filter(_tag(F.col("block"), "loc") != "")
    b = F.col("block")
    when = F.when(_tag(b, "news:publication_date") != "", _tag(b, "news:publication_date")).otherwise(_tag(b, "lastmod"))
    return _out(each, url=tx.normalize_url(tx.resolve_url(_tag(b, "loc"), F.coalesce("base_url", F.lit("")))), title=_tag(b, "news:title"), published_at=dates.parse_datetime(when))


# --- court judgments and oversight bodies
def judgment_fields(text: Column) -> dict[str, Column]:
    """Case number, court, defendants and decision date of a judgment's plain text; only a date that a court's marker follows counts."""
    names = F.array_distinct(F.regexp_extract_all(text, F.lit(DEFENDANT), F.lit(1)))
    return {"case_number": ident.normalize_case_number(text), "court": F.regexp_extract(text, COURT, 0), "defendants": names, "decided_on": dates.parse_date(F.regexp_extract(text, DECIDED + FOLLOWS, 0), True)}


@register("judicial")
def judgment(raws: DataFrame) -> DataFrame:
    """One document of a judgment's page; none without a case number."""
    df = raws.withColumn("pos", F.lit(0)).withColumn("plain", tx.strip_markup(F.coalesce("raw", F.lit(""))))
    f = judgment_fields(F.col("plain"))
    df = df.select("raw_id", "base_url", "pos", "plain", *[c.alias(k) for k, c in f.items()]).filter("case_number is not null")
    title = F.when(F.col("court") != "", F.concat("court", "case_number", F.lit("判決"))).otherwise(F.col("case_number"))
    midnight = F.concat(F.col("decided_on").cast("string"), F.lit(" 00:00:00+00:00")).try_cast("timestamp")
    return _out(df, url=F.coalesce("base_url", F.lit("")), title=title, body=F.col("plain"), published_at=midnight, external_id=F.col("case_number"))


@register("case_json")
def case_json(raws: DataFrame) -> DataFrame:
    """Court case records; confidential cases and those without a document's address are left out."""
    c = F.from_json("raw", "struct<JID:string,JYEAR:string,JCASE:string,JNO:string,JDATE:string,JTITLE:string,JFULL:string,JPDF:string>")
    df = raws.withColumn("pos", F.lit(0)).withColumn("c", c).select("raw_id", "pos", "c.*")
    title, kind = F.coalesce("JTITLE", F.lit("")), F.coalesce("JCASE", F.lit(""))
    df = df.filter((F.coalesce("JPDF", F.lit("")) != "") & ~F.concat_ws(" ", title, kind).rlike(CONFIDENTIAL))
    number = F.concat(F.col("JYEAR").try_cast("int").cast("string"), F.lit("年度"), F.translate(kind, "臺", "台"), F.lit("字第"), F.col("JNO").try_cast("int").cast("string"), F.lit("號"))
    day = F.when(F.length("JDATE") == 8, F.concat(F.substring("JDATE", 1, 4), F.lit("-"), F.substring("JDATE", 5, 2), F.lit("-"), F.substring("JDATE", 7, 2), F.lit(" 00:00:00+00:00"))).try_cast("timestamp")
    return _out(df, url=F.col("JPDF"), title=F.when(title != "", F.concat(title, F.lit("（"), number, F.lit("）"))).otherwise(number), body=F.coalesce("JFULL", F.lit("")), published_at=day, external_id=F.coalesce("JID", F.lit("")))


@register("control-yuan")
def oversight_rows(raws: DataFrame) -> DataFrame:
    """Table rows with a document's link: ROC date, case number, summary; no such row is an error."""
    rows = F.regexp_extract_all(F.coalesce("raw", F.lit("")), F.lit(r"(?s)<tr\b[^>]*>(.*?)</tr>"), F.lit(1))
    kept = F.filter(rows, lambda r: r.rlike("CyBsBoxContent"))
    bad = _out(raws.filter(F.size(kept) == 0).withColumn("pos", F.lit(0)), url=F.lit(None).cast("string"), title=F.lit(None).cast("string"), error=F.lit("no document in the list"))
    each = raws.select("raw_id", F.when(F.coalesce("base_url", F.lit("")) != "", F.col("base_url")).otherwise("https://www.cy.gov.tw").alias("base_url"), F.posexplode(kept).alias("pos", "row"))
    cells = F.transform(F.regexp_extract_all("row", F.lit(r"(?s)<td\b[^>]*>(.*?)</td>"), F.lit(1)), tx.strip_markup)
    each = each.withColumn("cells", cells).withColumn("href", F.replace(F.regexp_extract("row", r'<a\b[^>]*href\s*=\s*["\']([^"\']*CyBsBoxContent[^"\']*)', 1), F.lit("&amp;"), F.lit("&")))
    cell = lambda k: F.coalesce(F.get("cells", F.lit(k)), F.lit(""))
    found = F.regexp_extract(cell(1), r"\d{2,3}\s*年[^\s，、]{0,4}字第\s*\d+\s*號", 0)
    number = F.when(found != "", F.replace(found, F.lit(" "), F.lit(""))).otherwise(cell(1))
    link = tx.strip_markup(F.regexp_extract("row", r"(?s)<a\b[^>]*CyBsBoxContent[^>]*>(.*?)</a>", 1))
    title = F.trim(F.concat(number, F.lit(" "), cell(2)))
    good = _out(each, url=tx.normalize_url(tx.resolve_url(F.col("href"), F.col("base_url"))), title=F.when(title != "", title).otherwise(link), published_at=dates.at_noon(dates.parse_date(cell(0), True)), external_id=number)
    return good.unionByName(bad)


# --- procurement
TENDERS = "struct<records:array<struct<date:string,brief:struct<type:string,title:string,companies:struct<ids:array<string>,names:array<string>>>,job_number:string,unit_name:string,url:string>>>"


@register("procurement")
def tenders(raws: DataFrame) -> DataFrame:
    """Tender notices. The title carries the companies' ids, where the identifiers are looked for; the body is the summary line."""
    each = raws.select("raw_id", F.posexplode(F.from_json("raw", TENDERS)["records"]).alias("pos", "r"))
    r = F.col("r")
    kind, name, unit = (_text(c) for c in (r["brief"]["type"], r["brief"]["title"], r["unit_name"]))
    ids, names = (F.coalesce(r["brief"]["companies"][k], F.array().cast("array<string>")) for k in ("ids", "names"))
    title = F.concat(kind, F.lit("｜"), name, F.when(F.size(ids) > 0, F.concat(F.lit("（"), F.array_join(ids, " "), F.lit("）"))).otherwise(""))
    winners = F.when(F.size(names) > 0, F.concat(F.lit("得標／投標："), F.array_join(names, "、"))).otherwise("")
    line = F.array_join(F.filter(F.array(kind, unit, name, winners), lambda p: p != ""), " ｜ ")
    day = F.when(r["date"].rlike("^[0-9]{8}$"), F.try_to_timestamp(r["date"], F.lit("yyyyMMdd")).cast("date"))
    return _out(each.filter(name != ""), url=F.concat(F.lit(TENDER_SITE), F.coalesce(r["url"], F.lit(""))), title=title, body=line, published_at=dates.at_noon(day), external_id=F.coalesce(r["job_number"], F.lit("")))


# --- text files
@register("text_file")
def text_file(raws: DataFrame) -> DataFrame:
    """A header of key：value lines, forty dashes, a body that ends before the first advertising; none without address or title."""
    df = raws.withColumn("pos", F.lit(0)).filter(F.instr("raw", "-" * 40) > 0)
    header = F.substring_index("raw", "-" * 40, 1)
    body = F.substring(F.col("raw"), F.length(header) + 41, F.length("raw"))
    lines = F.filter(F.split(header, r"\r\n|\r|\n"), lambda s: F.contains(s, F.lit("：")))
    entries = F.transform(lines, lambda s: F.struct(F.regexp_replace(F.substring_index(s, "：", 1), WHITE, "").alias("k"), F.regexp_replace(F.substring(s, F.instr(s, F.lit("：")) + 1, F.length(s)), WHITE, "").alias("v")))
    key = lambda k: F.coalesce(F.try_element_at(F.filter(F.col("entries"), lambda e: e["k"] == k), F.lit(-1))["v"], F.lit(""))
    for p in PROMOTIONS:
        at = F.instr(body, F.lit(p))
        body = F.when(at > 1, F.left(body, at - 1)).otherwise(body)
    df = df.withColumn("entries", entries)
    url, title, day = key("網址"), key("標題"), key("日期")
    noon = F.when(day.rlike(r"^\d{4}-\d{2}-\d{2}$"), dates.at_noon(day.try_cast("date"), "+00:00"))
    return _out(df.filter((url != "") & (title != "")), url=F.substring_index(url, "?", 1), title=title, body=F.regexp_replace(body, WHITE, ""), published_at=noon, author=key("記者"))


# --- feeds and HTML lists, in Arrow batches
def plain_url(url: str, base: str) -> str:
    """As text.normalize_url of text.resolve_url."""
    s = urlsplit(urljoin(base, url) if base else url)
    kept = [kv for kv in s.query.split("&") if kv and kv.split("=", 1)[0].lower() not in tx.TRACKING]
    return urlunsplit((s.scheme, s.netloc, s.path, "&".join(kept), ""))


def _local(e: ElementTree.Element) -> str:
    return e.tag.rsplit("}", 1)[-1].lower() if isinstance(e.tag, str) else ""


def read_feed(raw: str | None, base: str | None) -> list[dict]:
    """The entries of an RSS or Atom feed. Not a feed, or entries of which none has address and title: an error."""
    try:
        root = ElementTree.fromstring((raw or "").strip().encode())
    except ElementTree.ParseError as e:
        return [{"error": f"not a feed: {e}"}]
    if _local(root) not in ("rss", "rdf", "feed"):
        return [{"error": f"not a feed: <{_local(root)}>"}]
    entries, out = [e for e in root.iter() if _local(e) in ("item", "entry")], []
    for entry in entries:
        parts: dict[str, str] = {}
        for child in entry:
            name, said = _local(child), "".join(child.itertext()).strip()
            if name == "link" and child.get("href"):
                said = child.get("href") if child.get("rel", "alternate") == "alternate" else ""
            if said:
                parts.setdefault(name, said)
        first = lambda *names: next((parts[n] for n in names if n in parts), "")  # noqa: B023, E731
        if first("link") and first("title"):
            out.append({"url": plain_url(first("link"), base or ""), "title": first("title"), "when": first("pubdate", "published", "date", "updated"), "author": first("author", "creator"), "external_id": first("guid", "id")})
    return out if out or not entries else [{"error": f"{len(entries)} entries, none with address and title"}]


class _Links(HTMLParser):
    """The links of a page with their text and the elements open around them."""

    VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, set[str]]] = []
        self.found: list[tuple[str, str, list]] = []
        self.link: list | None = None

    def handle_starttag(self, tag, attrs):
        a = {k: v or "" for k, v in attrs}
        if tag == "a":
            self.link = [a.get("href", ""), "", list(self.open)]
            self.found.append(self.link)
        if tag not in self.VOID:
            self.open.append((tag, set(a.get("class", "").split())))

    def handle_endtag(self, tag):
        if tag == "a":
            self.link = None
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k][0] == tag:
                del self.open[k:]
                break

    def handle_data(self, data):
        if self.link:
            self.link[1] += data


def _inside(around: list, chain: list[str]) -> bool:
    """Whether the chain's elements are open in this order."""
    rest = iter(around)
    return all(any(tag == step.split(".")[0] and set(step.split(".")[1:]) <= classes for tag, classes in rest) for step in chain)


def read_links(raw: str | None, base: str | None, pattern: str, chains: list[list[str]]) -> list[dict]:
    """Article links, each address once by its first link with a text; none is an error."""
    page, out = _Links(), {}
    page.feed(raw or "")
    page.close()
    for href, said, around in page.found:
        title = re.sub(r"\s*\d{1,2}:\d{2}$", "", re.sub(r"\s+", " ", said).strip()).strip()
        if title and re.search(pattern, href) and any(_inside(around, c) for c in chains):
            out.setdefault(plain_url(href, base or ""), title)
    return [{"url": u, "title": t} for u, t in out.items()] or [{"error": "no article in the list"}]


_BATCH = "pos int, url string, title string, `when` string, author string, external_id string, error string"


def _in_batches(read: Callable[[str | None, str | None], list[dict]]) -> Parser:
    def run(raws: DataFrame) -> DataFrame:
        names = ["raw_id", "pos", "url", "title", "when", "author", "external_id", "error"]

        def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                for k, raw, base in zip(b["raw_id"], b["raw"], b["base_url"], strict=True):
                    found = read(raw, base)
                    yield pd.DataFrame([{"raw_id": k, "pos": i} | f for i, f in enumerate(found)], columns=names).astype(object).where(lambda x: x.notna(), None)

        df = raws.select("raw_id", "raw", "base_url")
        got = df.mapInPandas(each, f"raw_id {df.schema['raw_id'].dataType.simpleString()}, {_BATCH}")
        empty = lambda c: F.when(F.col("error").isNull(), F.coalesce(c, F.lit("")))
        return _out(got, url=F.col("url"), title=F.col("title"), published_at=dates.parse_rfc822(F.col("when")), author=empty("author"), external_id=empty("external_id"), body=F.when(F.col("error").isNull(), ""), error=F.col("error"))

    return run


PARSERS["rss"] = _in_batches(read_feed)
for _name, (_pattern, _chains) in LISTS.items():
    PARSERS[_name] = _in_batches(lambda raw, base, p=_pattern, c=_chains: read_links(raw, base, p, c))
