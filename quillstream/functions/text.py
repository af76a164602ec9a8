"""Text derivations: half-width folding, bigram tokens, search-text and title terms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Full-width ASCII block and ideographic space, folded by position.
FULL = "".join(chr(c) for c in range(0xFF01, 0xFF5F)) + "　"
HALF = "".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)) + " "
CJK = "㐀-䶿一-鿿豈-﫿"

# Suffixes that a title's term drops, in order; company-name endings; tracking parameters.
TITLE_SUFFIXES = ("弊案", "案件", "事件", "案", "疑雲", "爭議")
COMPANY_SUFFIXES = ("公司", "營造", "建設", "工程", "企業", "事務所", "實業", "科技", "開發", "工業", "商行", "行號")
TRACKING = ("utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "fbclid", "gclid", "from", "ref", "share_source")


def to_halfwidth(c: Column) -> Column:
    return F.translate(c, FULL, HALF)


def is_cjk(c: Column) -> Column:
    return c.rlike(f"^[{CJK}]$")


def tokenize(c: Column) -> Column:
    """Bigrams of CJK runs (a single character stays), lower-cased ASCII words; everything else separates."""
    runs = F.regexp_extract_all(to_halfwidth(c), F.lit(f"[{CJK}]+|[A-Za-z0-9]+"), F.lit(0))
    pairs = lambda r: F.transform(F.sequence(F.lit(1), F.length(r) - 1), lambda i: F.substring(r, i, F.lit(2)))
    return F.flatten(F.transform(runs, lambda r: F.when(r.rlike("^[A-Za-z0-9]"), F.array(F.lower(r))).when(F.length(r) == 1, F.array(r)).otherwise(pairs(r))))


def search_text(c: Column) -> Column:
    return F.array_join(tokenize(c), " ")


def title_term(c: Column) -> Column:
    """The title without its first matching suffix, if more than one character is left."""
    out = None
    for s in TITLE_SUFFIXES:
        hit = c.endswith(s) & (F.length(c) > len(s) + 1)
        cut = F.substring(c, F.lit(1), F.length(c) - len(s))
        out = F.when(hit, cut) if out is None else out.when(hit, cut)
    return out.otherwise(c)


def is_generic_term(c: Column) -> Column:
    """Anonymised persons and terms under two characters."""
    return c.rlike("^.姓(男子|女子|男|女|嫌|婦|翁|童)?$") | (F.length(c) < 2)


def looks_like_company(c: Column) -> Column:
    return c.rlike("(" + "|".join(COMPANY_SUFFIXES) + ")$")


def snippet(c: Column, n: int = 200) -> Column:
    return F.left(F.translate(c, "\n", " "), F.lit(n))


def embedding_text(title: Column, body: Column, max_chars: int = 2000) -> Column:
    """Title twice, then the head of the body."""
    return F.regexp_replace(F.left(F.concat_ws("\n", title, title, body), F.lit(max_chars)), r"(?U)^\s+|\s+$", "")


def normalize_url(c: Column) -> Column:
    """Without fragment and tracking parameters; parameters keep their order; no trailing question mark."""
    bare = F.substring_index(c, "#", 1)
    path, query = F.substring_index(bare, "?", 1), F.when(F.instr(bare, "?") > 0, F.substring(bare, F.instr(bare, F.lit("?")) + 1, F.length(bare))).otherwise("")
    kept = F.array_join(F.filter(F.split(query, "&"), lambda kv: (kv != "") & ~F.lower(F.substring_index(kv, "=", 1)).isin(*TRACKING)), "&")
    return F.when(kept == "", path).otherwise(F.concat(path, F.lit("?"), kept))


def fingerprint_urls(urls: Column) -> Column:
    """sha1 over the sorted URLs."""
    return F.sha1(F.array_join(F.array_sort(urls), "\n"))


def resolve_url(c: Column, base: Column) -> Column:
    """An absolute URL from one that may be relative to base; dot segments are folded away, an empty URL stays empty."""
    origin = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    path = F.regexp_extract(base, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    tail = F.regexp_extract(c, r"([?#].*)$", 1)
    own = F.regexp_extract(c, r"^([^?#]*)", 1)
    joined = F.when(own == "", path).when(own.startswith("/"), own).otherwise(F.concat(F.regexp_extract(path, "^(.*/)", 1), own))
    segments = F.split(F.regexp_replace(joined, "^/", ""), "/")
    last = F.get(F.reverse(segments), F.lit(0))
    step = lambda acc, s: F.when(s == ".", acc).when(s == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(s)))
    folded = F.array_join(F.aggregate(segments, F.array().cast("array<string>"), step), "/")
    slash = F.when(last.isin(".", "..") & (folded != ""), "/").otherwise("")
    relative = F.concat(origin, F.lit("/"), folded, slash, tail)
    return F.when((c == "") | c.rlike("^[A-Za-z][A-Za-z0-9+.-]*:") | (origin == ""), c).when(c.startswith("//"), F.concat(F.regexp_extract(base, "^([^:]+:)", 1), c)).otherwise(relative)


def clean_title(c: Column) -> Column:
    """White space squeezed and a trailing time of day dropped."""
    return F.trim(F.regexp_replace(F.trim(F.regexp_replace(c, r"(?U)\s+", " ")), r"\s*\d{1,2}:\d{2}$", ""))


def strip_markup(c: Column) -> Column:
    """Comments and tags out, the two commonest entities decoded, white space squeezed."""
    bare = F.regexp_replace(F.regexp_replace(c, r"(?s)<!--.*?-->", ""), "<[^>]+>", " ")
    return F.trim(F.regexp_replace(F.replace(F.replace(bare, F.lit("&nbsp;"), F.lit(" ")), F.lit("&amp;"), F.lit("&")), r"(?U)\s+", " "))


def model_json(c: Column) -> Column:
    """A model's reply without the code fence around it."""
    t = F.trim(c)
    inner = F.regexp_replace(F.regexp_replace(t, r"^```[^\n]*\n?", ""), r"(?s)```(?!.*```).*$", "")
    return F.when(t.startswith("```"), inner).otherwise(t)


def salvage_reply(c: Column) -> Column:
    """The "reply" field of a reply whose JSON may be cut off, unescaped as far as it goes; null where there is none."""
    raw = F.regexp_extract(c, r'"reply"\s*:\s*"((?:[^"\\]|\\.)*)', 1)
    return F.when(raw != "", F.replace(F.replace(F.replace(raw, F.lit("\\n"), F.lit("\n")), F.lit('\\"'), F.lit('"')), F.lit("\\\\"), F.lit("\\")))
