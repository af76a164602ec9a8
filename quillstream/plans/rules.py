"""Write rules, nearest neighbours, identifier matches, walks, prices and scalar functions, run by the library's own code on the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillstream.functions import fingerprint, pricing
from quillstream.functions import text as tx
from quillstream.operators import graph, search, tables
from quillstream.plans.events import _DOCS, _EVENTS, _PINS, documents, events
from quillstream.plans.registry import QUERIES, Query, frame, frame_query, read
from quillstream.plans.relational import NEW, OLD


def _by_operator(name: str):
    """Runs a registered query by an operator instead; its oracle stays."""

    def wrap(f):
        QUERIES[name] = Query(f, QUERIES[name].sql)
        return f

    return wrap


def _sides(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    rows = lambda sql: frame(spark, d, f"select cast(o_orderkey as string) as url, o_orderstatus as status, title, o_totalprice as price from {sql} x")
    return rows(OLD), rows(NEW).withColumn("pos", F.lit(1))


@_by_operator("K1_upsert")
def k1(spark: SparkSession, d: str) -> DataFrame:
    got = tables.upsert(*_sides(spark, d))
    return got.select(F.col("url").cast("long").alias("k"), "status", F.coalesce("title", F.lit("")).alias("title"), "price")


@_by_operator("K2_insert_ignore")
def k2(spark: SparkSession, d: str) -> DataFrame:
    return tables.insert_ignore(*_sides(spark, d)).select(F.col("url").cast("long").alias("o_orderkey"))


@_by_operator("K3_changed_only")
def k3(spark: SparkSession, d: str) -> DataFrame:
    old, new = (x.select("url", "title") for x in _sides(spark, d))
    return tables.changed(old, new, "url").join(old.select("url"), "url", "left_semi").select(F.col("url").cast("long").alias("o_orderkey"))


@frame_query("K10_trash", "select o_orderkey as k, case when o_orderkey % 3 = 0 then timestamp '2024-01-01 00:00:00' when o_orderkey % 2 = 0 then timestamp '2024-02-01 00:00:00' end as deleted_at from orders")
def k10(spark: SparkSession, d: str) -> DataFrame:
    """Orders, some of which lie in the trash already, with the even ones put there."""
    old = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    rows = read(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.when(F.col("o_orderkey") % 3 == 0, old).alias("deleted_at"))
    return tables.trash(rows, rows.filter("k % 2 = 0").select("k"), "k", F.lit("2024-02-01 00:00:00").cast("timestamp_ntz"))


@frame_query("J7_identifier_overlap", f"with {_DOCS}, {_EVENTS}, base as (select * from docs), {_PINS} select event_id, doc_id, pos from (select event_id, doc_id, row_number() over (partition by event_id order by published_at desc nulls first, doc_id) as pos from pins) x where pos <= 500")
def j7(spark: SparkSession, d: str) -> DataFrame:
    """Documents that share a case number with an event, newest first, 500 at most as in the channel."""
    asked = events(spark, d).withColumnRenamed("event_id", "query_id")
    return search.identifier_channel(documents(spark, d), asked, 500).withColumnRenamed("query_id", "event_id")


_NEXT = "e as (select conv_id, turn as from_id, turn + 1 as to_id, turn as edge_id from conversations union all select conv_id, max(turn), min(turn), -1 from conversations group by conv_id having max(turn) > min(turn))"


def _walked(seed: str, there: str) -> str:
    return f"with recursive {_NEXT}, w as (select conv_id, edge_id, from_id, to_id, 1 as depth, [{seed}, {there}] as visited from e where {seed} = 1 union all select e.conv_id, e.edge_id, e.from_id, e.to_id, w.depth + 1, list_append(w.visited, e.{there}) from w join e on e.conv_id = w.conv_id and e.{seed} = w.{there} where w.depth < 5 and not list_contains(w.visited, e.{there})) select conv_id, edge_id, from_id, to_id, depth from w"


def _walk(direction: str):
    def run(spark: SparkSession, d: str) -> DataFrame:
        turns = read(spark, d, "conversations").select("conv_id", "turn")
        ends = turns.groupBy("conv_id").agg(F.max("turn").alias("from_id"), F.min("turn").alias("to_id")).filter("from_id > to_id").withColumn("edge_id", F.lit(-1).cast("long"))
        on = turns.select("conv_id", F.col("turn").alias("from_id"), (F.col("turn") + 1).alias("to_id"), F.col("turn").alias("edge_id"))
        starts = turns.select("conv_id", F.lit(1).cast("long").alias("start")).distinct()
        return graph.walk(on.unionByName(ends.select(*on.columns)), starts, direction, within=("conv_id",)).drop("start")

    return run


QUERIES["J12_descendants"] = Query(_walk("descendants"), _walked("from_id", "to_id"))
QUERIES["J12_ancestors"] = Query(_walk("ancestors"), _walked("to_id", "from_id"))


@frame_query("W8_nearest_length", "select doc_id, best from (select a.doc_id, b.doc_id as best, row_number() over (partition by a.doc_id order by abs(a.n_chars - b.n_chars), b.doc_id) as r from documents a join documents b on a.source = b.source and a.lang = b.lang and a.doc_id <> b.doc_id) x where r = 1 and best < doc_id")
def w8(spark: SparkSession, d: str) -> DataFrame:
    """Each document's nearest by length among all of its source and language, the smallest id of several, if that is an earlier one.

    Only distinct lengths stand in a window, with the two smallest ids of each.
    """
    key = ["source", "lang"]
    docs = read(spark, d, "documents").select("doc_id", *key, "n_chars")
    first = docs.groupBy(*key, "n_chars").agg(F.min("doc_id").alias("a"))
    second = docs.join(first, [*key, "n_chars"]).filter(F.col("doc_id") > F.col("a")).groupBy(*key, "n_chars").agg(F.min("doc_id").alias("b"))
    w = Window.partitionBy(*key).orderBy("n_chars")
    side = lambda f: F.struct(F.abs(f("n_chars").over(w) - F.col("n_chars")).alias("far"), f("a").over(w).alias("id"))
    both = first.join(second, [*key, "n_chars"], "left").withColumn("near", F.array_min(F.filter(F.array(side(F.lag), side(F.lead)), lambda x: x["id"].isNotNull())))
    best = F.when(F.col("doc_id") != F.col("a"), F.col("a")).when(F.col("b").isNotNull(), F.col("b")).otherwise(F.col("near.id"))
    return docs.join(both, [*key, "n_chars"]).select("doc_id", best.alias("best")).filter("best < doc_id")


@frame_query("W2_gap_split", "select user_id, event_id, row_number() over (partition by user_id order by ts desc, event_id) <= 20 as shown from events")
def w2(spark: SparkSession, d: str) -> DataFrame:
    """A user's newest 20 rows are shown, the rest folded."""
    w = Window.partitionBy("user_id").orderBy(F.desc("ts"), "event_id")
    return read(spark, d, "events").select("user_id", "event_id", (F.row_number().over(w) <= 20).alias("shown"))


@frame_query("P18_public_fields", "select doc_id, lang, case when source = 'src1' then text end as body from documents")
def p18(spark: SparkSession, d: str) -> DataFrame:
    """Whole bodies of public records; other bodies stay back."""
    return read(spark, d, "documents").select("doc_id", "lang", F.when(F.col("source") == "src1", F.col("text")).alias("body"))


_COST = "select event_id, m, user_id % 1000 as cached, user_id * 7 as uncached, event_id % 5000 as output, isodow(ts) <= 5 and hour(ts) in (1, 2, 3, 6, 7, 8, 9) as peak, case m when 'flash' then [0.014, 0.44, 1.32] else [0.044, 1.32, 3.96] end as p from (select *, case when user_id % 2 = 0 then 'flash' else 'pro' end as m from events) x"


@frame_query("H35_compute_cost", f"select event_id, cast(round((cached * p[1] + uncached * p[2] + output * p[3]) * (case when peak then 1.0 else 0.5 end) / 1000000, 8) as decimal(12,8)) as usd, peak from ({_COST}) c")
def h35(spark: SparkSession, d: str) -> DataFrame:
    """Events as model calls of two tiers, at the price of their moment."""
    model = F.when(F.col("user_id") % 2 == 0, "flash").otherwise("pro")
    cost = pricing.compute_cost(model, F.col("user_id") % 1000, F.col("user_id") * 7, F.col("event_id") % 5000, F.col("ts"))
    return read(spark, d, "events").select("event_id", cost.alias("c")).select("event_id", "c.usd", "c.peak")


#: The fingerprints of the five kinds of events as tokens; the oracle weighs them by itself.
_KINDS = ", ".join(f"('{t}', {fingerprint.feature_hash(t)}::ubigint)" for t in ("click", "error", "purchase", "signup", "view"))


@frame_query("G20_weighted_bits", f"with h(event_type, h) as (values {_KINDS}), n as (select user_id, event_type, count(*) as n from events group by 1, 2), b as (select user_id, b, 2 * sum(case when (h >> b::ubigint) & 1::ubigint = 1 then n else 0 end) > sum(n) as bit from n join h using (event_type), range(0, 64) r(b) group by 1, 2) select user_id, sum(case when not bit then 0 when b = 63 then -9223372036854775808::hugeint else (1::hugeint << b::int) end)::bigint as simhash from b group by 1")
def g20(spark: SparkSession, d: str) -> DataFrame:
    """Fingerprints of users' events as texts; a kind that comes often weighs as often."""
    texts = read(spark, d, "events").groupBy("user_id").agg(F.array_join(F.collect_list("event_type"), " ").alias("text"))
    return fingerprint.with_simhash(texts, "user_id", "text")


@frame_query("H30_snippets", "select doc_id, left(replace(text, chr(10), ' '), 200) as snippet from documents")
def h29(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").select("doc_id", tx.snippet(F.col("text")).alias("snippet"))


@frame_query("H32_url_fingerprints", "select page_id % 50 as source, sha1(array_to_string(list(url order by url), chr(10))) as fp from pages group by 1")
def h32(spark: SparkSession, d: str) -> DataFrame:
    """What a list page's addresses come to, whatever their order."""
    return read(spark, d, "pages").groupBy((F.col("page_id") % 50).alias("source")).agg(tx.fingerprint_urls(F.collect_list("url")).alias("fp"))


@frame_query("Z13_without_markup", r"select page_id, trim(regexp_replace(replace(replace(regexp_replace(regexp_replace(html, '<!--.*?-->', '', 'gs'), '<[^>]+>', ' ', 'g'), '&nbsp;', ' '), '&amp;', '&'), '\s+', ' ', 'g')) as text from pages")
def z13(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "pages").select("page_id", tx.strip_markup(F.col("html")).alias("text"))


