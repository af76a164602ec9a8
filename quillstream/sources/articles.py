"""Article pages: full text, time, author and title, in Arrow batches one page at a time."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstream.functions import dates

MIN_BODY = 80
# Where a source's text stands, metadata that hold the time, lines that are captions, blocks that hold text.
BODIES = {"udn": "section.article-content__editor", "chinatimes": "div.article-body", "ctee": "article", "ettoday": "div.story", "cna-society": "div.paragraph", "cna-politics": "div.paragraph", "cna-mainland": "div.paragraph", "cna-finance": "div.paragraph", "pts": "article", "ltn": "div.text", "mirrormedia": "main"}
TIMES = ("article:published_time", "pubdate", "datePublished")
NOISE = (r"^[▲▼△▽◤◢]", r"^（圖[／/].*）$", r"^\s*$")
BLOCKS = frozenset("unstyled blockquote quoteby annotation infobox header-one header-two code".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())


_NOISE = [re.compile(p) for p in NOISE]


def clean_body(text: str) -> str:
    """Without caption and blank lines."""
    return "\n".join(line for line in (x.strip() for x in text.splitlines()) if not any(p.match(line) for p in _NOISE))


class _Page(HTMLParser):
    def __init__(self, selector: str | None) -> None:
        super().__init__(convert_charrefs=True)
        self.tag, _, self.cls = (selector or "").partition(".")
        self.open: list[tuple[str, bool]] = []
        self.depth, self.pieces, self.records, self.meta, self.title, self.mode = 0, [], [], {}, "", ""

    def handle_starttag(self, tag, attrs):
        a = {k: v or "" for k, v in attrs}
        if tag == "meta":
            name = a.get("property") or a.get("name") or a.get("itemprop")
            if name and a.get("content", "").strip():
                self.meta.setdefault(name, a["content"].strip())
        elif tag == "script" and a.get("type") == "application/ld+json":
            self.mode = "record"
            self.records.append("")
        elif tag in ("script", "style", "title"):
            self.mode = tag
        if tag not in VOID:
            here = bool(self.tag) and tag == self.tag and (not self.cls or self.cls in a.get("class", "").split())
            self.open.append((tag, here))
            self.depth += here

    def handle_endtag(self, tag):
        if tag in ("script", "style", "title"):
            self.mode = ""
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k][0] == tag:
                self.depth -= sum(here for _, here in self.open[k:])
                del self.open[k:]
                break

    def handle_data(self, data):
        if self.mode == "record":
            self.records[-1] += data
        elif self.mode == "title":
            self.title += data
        elif not self.mode and self.depth:
            self.pieces.append(data)


def _nodes(tree) -> Iterator[dict]:
    """All objects of a JSON tree, outer ones first."""
    todo = [tree]
    while todo:
        v = todo.pop()
        if isinstance(v, dict):
            yield v
            todo.extend(reversed(list(v.values())))
        elif isinstance(v, list):
            todo.extend(reversed(v))


def _facts(records: list[str]) -> dict[str, list[str]]:
    """What all linked-data records of a page say, anywhere in their trees: field to its texts, in page order."""
    told: dict[str, list[str]] = {}
    for record in records:
        try:
            tree = json.loads(record)
        except ValueError:
            continue
        for node in _nodes(tree):
            for field, value in node.items():
                if isinstance(value, dict):
                    value = value.get("name")
                if isinstance(value, str) and value:
                    told.setdefault(field, []).append(value)
    return told


def _read(html: str, source: str | None) -> tuple[_Page, dict[str, list[str]]]:
    page = _Page(BODIES.get(source or ""))
    page.feed(html)
    page.close()
    return page, _facts(page.records)


def _time(page: _Page, told: dict[str, list[str]]) -> str:
    return next(iter([*told.get("datePublished", []), *(page.meta[k] for k in TIMES if k in page.meta)]), "")


def _checked(found: dict, body: str, strategy: str) -> dict:
    body = clean_body(body)
    return found | ({"body": body, "strategy": strategy} if len(body) >= MIN_BODY else {"error": f"only {len(body)} characters of text"})


def read_article(html: str | None, source: str | None = None) -> dict:
    """The longest text that linked data hold, else the source's text block; under 80 characters is an error."""
    if not (html or "").strip():
        return {"error": "empty page"}
    page, told = _read(html, source)
    first = lambda *texts: next((t for t in texts if t), "")
    title = first(*told.get("headline", []), page.meta.get("og:title"), page.title)
    found = {"title": " ".join(title.split())[:512], "author": first(*told.get("author", [])).strip()[:128], "when": _time(page, told)}
    longest = max(told.get("articleBody", []), key=len, default="")
    by_selector = len(longest) < MIN_BODY and bool(page.pieces)
    return _checked(found, "\n".join(page.pieces) if by_selector else longest, "selector" if by_selector else "json-ld")


def read_time(html: str | None) -> str:
    """The time of publication that a page states, whatever the length of its text; empty if none."""
    return _time(*_read(html, None)) if (html or "").strip() else ""


def published_times(pages: DataFrame) -> DataFrame:
    """(page_id, published_at) of rows (page_id, html), for pages whose text came without a time."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"page_id": b["page_id"], "when": [read_time(h) for h in b["html"]]})

    got = pages.select("page_id", "html").mapInPandas(each, f"page_id {pages.schema['page_id'].dataType.simpleString()}, `when` string")
    return got.select("page_id", dates.parse_datetime(F.col("when")).alias("published_at"))


#: An article of typed blocks; a block's content is a text or a list, so it stays JSON at first.
_BLOCK_PAGE = "struct<data: struct<title: string, published_date: string, content: struct<api_data: array<struct<type: string, content: string>>>>>"


def block_articles(pages: DataFrame) -> DataFrame:
    """As extract_articles, of articles of typed JSON blocks, markup taken out; by expressions alone."""
    text = F.coalesce("html", F.lit(""))
    read = pages.select("page_id", text.alias("raw"), F.from_json(text, _BLOCK_PAGE)["data"].alias("d"))
    item = lambda i: F.when(i.startswith("{"), F.coalesce(F.get_json_object(i, "$.body"), F.lit(""))).otherwise(i)
    texts = lambda c: F.when(c.startswith("["), F.transform(F.coalesce(F.from_json(c, "array<string>"), F.array().cast("array<string>")), item)).otherwise(F.array(c))
    blocks = F.filter(F.coalesce("d.content.api_data", F.array().cast("array<struct<type: string, content: string>>")), lambda b: b["type"].isin(*BLOCKS) & b["content"].isNotNull())
    parts = F.flatten(F.transform(blocks, lambda b: texts(b["content"])))
    bare = F.transform(parts, lambda p: F.trim(F.regexp_replace(F.regexp_replace(p, r"(?s)<!--.*?-->", ""), r"<[^>]+>", "")))
    lines = F.filter(F.transform(F.split(F.array_join(bare, "\n"), r"\r?\n|\r"), lambda x: F.trim(x)), lambda x: ~x.rlike("|".join(NOISE)))
    got = read.select("page_id", "raw", "d", F.array_join(lines, "\n").alias("b"))
    fine = F.length("b") >= MIN_BODY
    error = F.when(F.get_json_object("raw", "$").isNull(), "not JSON").when(~fine, F.concat(F.lit("only "), F.length("b"), F.lit(" characters of text")))
    title = F.left(F.trim(F.regexp_replace(F.coalesce("d.title", F.lit("")), r"(?U)\s+", " ")), F.lit(512))
    return got.select("page_id", title.alias("title"), F.when(error.isNull(), F.col("b")).alias("body"), F.lit("").alias("author"), dates.parse_datetime(F.coalesce("d.published_date", F.lit(""))).alias("published_at"), F.when(error.isNull(), "blocks").alias("strategy"), error.alias("error"))


def extract_articles(pages: DataFrame) -> DataFrame:
    """(page_id, title, body, author, published_at, strategy, error) of rows (page_id, html, source); body is null where there is an error."""
    columns = ["page_id", "title", "body", "author", "when", "strategy", "error"]

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [{"page_id": i} | read_article(h, s) for i, h, s in zip(b["page_id"], b["html"], b["source"], strict=True)]
            yield pd.DataFrame(rows, columns=columns).astype(object).where(lambda x: x.notna(), None)

    df = pages.select("page_id", "html", "source")
    got = df.mapInPandas(each, f"page_id {df.schema['page_id'].dataType.simpleString()}, title string, body string, author string, `when` string, strategy string, error string")
    return got.select("page_id", "title", "body", "author", dates.parse_datetime(F.col("when")).alias("published_at"), "strategy", "error")
