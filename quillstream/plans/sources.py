"""Polls, archives, seeds, schedules and the ledger on rows made of the test tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillstream.operators import sources, tables
from quillstream.plans.registry import frame_query, read
from quillstream.sources import archives
from quillstream.sources.archive_stream import LINKS
from quillstream.streaming import ingest

_WALK = """with li as (select * replace (row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice)::int as l_linenumber) from lineitem), p as (select l_orderkey as source, l_linenumber as page, case when l_quantity > 48 then [] when l_linenumber % 4 = 0 then ['u' || (l_orderkey + l_linenumber - 1)] else ['u' || (l_orderkey + l_linenumber)] end as urls, l_tax = 0.08 as failed from li),
k as (select *, exists (select 1 from part where p_size < 5 and list_contains(urls, 'u' || p_partkey)) as met, lag(urls) over w as before, lag(page) over w as before_page from p window w as (partition by source order by page)),
g as (select *, lag(len(urls) > 0 and not met) over (partition by source order by page) as going from k),
e as (select *, not failed and page <= 5 and (page = 1 or (coalesce(going, false) and before_page = page - 1 and urls <> before)) as enters from g),
r as (select *, bool_and(enters) over (partition by source order by page) as reached from e)
select source, page, unnest(urls) as url from r where reached"""


@frame_query("A12_live_walk", _WALK)
def a12(spark: SparkSession, d: str) -> DataFrame:
    """Orders as sources and their lines as list pages; parts of small size are known."""
    at = F.col("l_orderkey") + F.col("l_linenumber")
    urls = F.when(F.col("l_quantity") > 48, F.array().cast("array<string>")).when(F.col("l_linenumber") % 4 == 0, F.array(F.concat(F.lit("u"), at - 1))).otherwise(F.array(F.concat(F.lit("u"), at)))
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    lines = read(spark, d, "lineitem").withColumn("l_linenumber", F.row_number().over(w))
    pages = lines.select(F.col("l_orderkey").alias("source"), F.col("l_linenumber").alias("page"), urls.alias("urls"), (F.col("l_tax") == 0.08).alias("failed"))
    return sources.live_walk(pages, read(spark, d, "part").filter("p_size < 5").select(F.concat(F.lit("u"), "p_partkey").alias("url")))


@frame_query("A13_monthly_archives", "select o_orderkey as dataset_id, '2024' || lpad((o_orderkey % 12 + 1)::varchar, 2, '0') || '裁判書' as title, o_custkey as fileset_id, o_orderdate as published_at, o_orderstatus = 'P' as gated from orders where o_orderkey % 3 <> 0 and o_orderkey % 5 <> 0 order by o_orderdate desc, o_orderkey limit 24")
def a13(spark: SparkSession, d: str) -> DataFrame:
    """Orders as a catalogue's entries; some have another title, some no files."""
    key = F.col("o_orderkey")
    title = F.when(key % 3 != 0, F.concat(F.lit("2024"), F.lpad((key % 12 + 1).cast("string"), 2, "0"), F.lit("裁判書"))).otherwise("用語辭典")
    files = F.when(key % 5 != 0, F.array(F.struct(F.col("o_custkey").alias("fileSetId"))))
    item = F.struct(key.alias("datasetId"), title.alias("title"), F.when(F.col("o_orderstatus") == "P", "B").otherwise("A").alias("categoryDataset"), F.col("o_orderdate").cast("string").alias("publishedDate"), files.alias("filesetLists"))
    orders = read(spark, d, "orders").groupBy((key % 100).alias("page")).agg(F.collect_list(item).alias("items"))
    return sources.monthly_archives(orders.select(F.to_json(F.struct(F.struct("items").alias("pagedList"))).alias("raw")))


@frame_query("A14_archive_members", "select o_orderkey as case_id, 'a' || (l_linenumber % 3) as archive, min('court/TPD,' || (100 + l_partkey % 20) || ',金,' || l_suppkey || ',20240101,' || l_linenumber || '.json') as name from orders join lineitem on l_partkey % 20 = o_custkey % 20 and l_suppkey = o_orderkey % 100 where o_orderkey < 400 group by 1, 2")
def a14(spark: SparkSession, d: str) -> DataFrame:
    """Orders as cases looked up among the names of lines as archive members."""
    cases = read(spark, d, "orders").filter("o_orderkey < 400").select(F.col("o_orderkey").alias("case_id"), (100 + F.col("o_custkey") % 20).cast("int").alias("year"), F.lit("金").alias("category"), (F.col("o_orderkey") % 100).cast("int").alias("number"))
    name = F.concat(F.lit("court/TPD,"), 100 + F.col("l_partkey") % 20, F.lit(",金,"), "l_suppkey", F.lit(",20240101,"), "l_linenumber", F.lit(".json"))
    members = read(spark, d, "lineitem").select(F.concat(F.lit("a"), F.col("l_linenumber") % 3).alias("archive"), name.alias("name"))
    return sources.find_members(cases, members)


@frame_query("A25_seed_sources", "select 's' || s_suppkey as slug, case when s_suppkey % 3 = 0 then s_name || ' new' else s_name end as name, case when s_suppkey % 2 = 0 then 'no' else 'yes' end as enabled from supplier where s_suppkey % 2 = 0 or s_suppkey % 3 = 0")
def a25(spark: SparkSession, d: str) -> DataFrame:
    """Seeds of suppliers over a table of some: a name follows the seed, being enabled stays as it was set."""
    s = read(spark, d, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("slug"), F.col("s_name").alias("name"), "s_suppkey")
    old = s.filter("s_suppkey % 2 = 0").select("slug", "name", F.lit("no").alias("enabled"))
    seeds = s.filter("s_suppkey % 3 = 0").select("slug", F.concat("name", F.lit(" new")).alias("name"), F.lit("yes").alias("enabled"), F.lit(1).alias("pos"))
    return tables.upsert(old, seeds, key="slug", create_only=("enabled",)).drop("action")


@frame_query("A26_budgeted_calls", "with c as (select event_id as call_id, cast(value as decimal(18,4)) as cost, event_type = 'error' as failed from events), r as (select *, sum(cost) over (order by call_id rows unbounded preceding) - cost as before from c) select call_id, case when before >= 5000 then 'refused' when failed then 'failed' else 'ok' end as status, case when before >= 5000 then 0 else cost end as charged from r")
def a26(spark: SparkSession, d: str) -> DataFrame:
    """Events as calls in the order of their ids, under a budget."""
    calls = read(spark, d, "events").select(F.col("event_id").alias("call_id"), F.col("value").cast("decimal(18,4)").alias("cost"), (F.col("event_type") == "error").alias("failed"))
    return sources.ledger(calls, F.lit(5000))


@frame_query("C9_procurement_plan", "select c_custkey as event_id, c_name as term, 'title' as endpoint from customer where c_acctbal > 0 union all select c_custkey, c_mktsegment || '公司', 'company' from customer where c_acctbal > 0 and c_custkey % 2 = 0")
def c9(spark: SparkSession, d: str) -> DataFrame:
    support = F.array(F.when(F.col("c_custkey") % 2 == 0, F.concat("c_mktsegment", F.lit("公司"))).otherwise("王小明"))
    return sources.procurement_plan(read(spark, d, "customer").select(F.col("c_custkey").alias("event_id"), F.when(F.col("c_acctbal") > 0, F.col("c_name")).alias("identity"), support.alias("support")))


@frame_query("Z1_empty_pages", "select l_orderkey, l_linenumber, case when l_quantity > 5 then 'items' when l_returnflag = 'R' then 'error' else 'end' end as outcome from lineitem")
def z1(spark: SparkSession, d: str) -> DataFrame:
    n = F.when(F.col("l_quantity") > 5, 1).otherwise(0)
    return read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", sources.page_outcome(n, F.col("l_returnflag") == "R").alias("outcome"))


@frame_query("Z27_schedule_faults", "select o_orderkey, case when o_orderkey % 7 = 0 then 'interval' when o_custkey % 30 > 23 then 'hour' end as fault from orders")
def z27(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "orders").select("o_orderkey", sources.schedule_fault(F.col("o_orderkey") % 7, F.when(F.col("o_custkey") % 2 == 0, F.col("o_custkey") % 30).otherwise(F.col("o_custkey") % 30), F.lit(None).cast("int")).alias("fault"))


@frame_query("Z28_proposals", "with s as (select distinct conv_id, case when turn % 2 = 0 then 'title ' || (turn % 4) else left(trim(text), 24) end as title from conversations) select conv_id, title, 3 as n_tags from s where title <> '' and not (title = 'title 0' and conv_id % 3 = 0)")
def z28(spark: SparkSession, d: str) -> DataFrame:
    """Turns as suggestions of events; some conversations have made one already."""
    c = read(spark, d, "conversations")
    title = F.when(F.col("turn") % 2 == 0, F.concat(F.lit(" title "), F.col("turn") % 4)).otherwise(" ")
    made = c.filter("conv_id % 3 = 0").select("conv_id", F.lit("title 0").alias("title")).distinct()
    got = sources.proposals(c.select("conv_id", title.alias("title"), F.col("text").alias("summary"), F.array(*[F.lit(x) for x in "abc"]).alias("tags")), made)
    return got.select("conv_id", "title", F.size("tags").alias("n_tags"))


_BACKFILL = """with o as (select o_custkey % 25 as a, (extract(year from o_orderdate) - 1995) * 12 + extract(month from o_orderdate) - 1 as m, 'u' || o_orderkey as url from orders union all select a, m, 'i' || a || '-' || m from range(0, 25) x(a), range(0, 80) y(m)),
t as (select a, unnest(case when a % 10 = 2 and m = 49 then [49, 50] when a % 10 = 3 and m = 0 then [0, 60] when (a % 10 = 2 and m = 50) or (a % 10 = 3 and m = 60) then [] else [m] end) as u, url from o),
p as (select a, u, count(*) as n, string_agg(url, ' ' order by url) as fp from t group by 1, 2),
k as (select *, ['date', 'page', 'offset'][(a % 3 + 1)::int] as kind from (select distinct a from o) x, range(0, 120) r(u)),
g as (select k.a, k.u, kind, k.u // 9 as c, case when k.a % 10 = 1 and k.u = 40 then 0 else coalesce(n, 0) end as n, case when k.a % 10 = 1 and k.u = 40 then '' else fp end as fp, (fp is null and not (k.a % 10 = 1 and k.u = 40)) or (k.a * 7 + k.u * 3) % 11 = 0 or (k.a % 10 = 9 and k.u between 30 and 32) as failed from k left join p on p.a = k.a and p.u = k.u where kind <> 'date' or k.u < 80),
l as (select *, lag(failed) over w and lag(failed, 2) over w and failed as third, case when not lag(failed) over w then lag(fp) over w end as before, first_value(case when not failed then fp end) over (partition by a order by u) as first_fp from g window w as (partition by a, c order by u)),
s as (select *, case when coalesce(third, false) then 'error' when failed then 'failed' when n = 0 and kind <> 'date' then 'empty' when n > 0 and kind = 'page' and u > 0 and fp = first_fp then 'wrapped' when n > 0 and fp = before then 'repeated' else 'page' end as status from l),
e as (select *, min(case when status not in ('page', 'failed') then u end) over (partition by a) as stop from s)
select a as archive, u as unit, status, case when status = 'page' then n end as n_urls from e where stop is null or u <= stop"""


@frame_query("A11_archive_backfill", _BACKFILL)
def a11(spark: SparkSession, d: str) -> DataFrame:
    """25 archives of three kinds, a page for each month with its orders, with pages that fail, are empty, repeat or wrap; read through the archive source, which is started
    three times."""
    folder = f"{tables.shared_dir(spark)}/archives-{uuid.uuid4().hex}"
    o = read(spark, d, "orders").select((F.col("o_custkey") % 25).cast("int").alias("a"), ((F.year("o_orderdate") - 1995) * 12 + F.month("o_orderdate") - 1).alias("m"), F.concat(F.lit("u"), "o_orderkey").alias("url"))
    every = spark.range(25 * 80).select(F.expr("cast(id div 80 as int)").alias("a"), F.expr("cast(id % 80 as int)").alias("m"))
    o = o.unionByName(every.withColumn("url", F.concat(F.lit("i"), "a", F.lit("-"), "m")))
    a, m, kind = F.col("a"), F.col("m"), F.col("a") % 3
    ints = lambda *x: F.array(*[F.lit(i) for i in x])
    units = F.when((a % 10 == 2) & (m == 49), ints(49, 50)).when((a % 10 == 3) & (m == 0), ints(0, 60)).when(((a % 10 == 2) & (m == 50)) | ((a % 10 == 3) & (m == 60)), F.array().cast("array<int>")).otherwise(F.array(m))
    u = F.col("u")
    pages = o.select("a", F.explode(units).alias("u"), "url").groupBy("a", "u").agg(F.to_json(F.collect_list(F.struct("url"))).alias("raw"))
    pages = pages.filter(((a * 7 + u * 3) % 11 != 0) & ~((a % 10 == 9) & u.between(30, 32))).withColumn("raw", F.when((a % 10 == 1) & (u == 40), "[]").otherwise(F.col("raw")))
    at = F.when(kind == 0, F.date_format(F.date_add(F.lit("1992-01-01").cast("date"), u), "yyyyMMdd")).when(kind == 1, (u + 1).cast("string")).otherwise((u * 50).cast("string"))
    pages.select("raw", "a", at.alias("p")).repartition("a", "p").write.partitionBy("a", "p").text(f"{folder}/pages")
    marks = {"date": "{date}", "page": "{page}", "offset": "{offset}"}
    specs = [{"name": str(n), "kind": k, "url": f"{folder}/pages/a={n}/p={marks[k]}", "date_format": "%Y%m%d", "first": 1, "pagesize": 50, "since": "1992-01-01", "chunk": 9} for n in range(25) for k in [("date", "page", "offset")[n % 3]]]
    for batches in (2, 1, None):
        rows = ingest.walk_archives(spark, folder, specs, batches=batches, fetcher="folder", today="1992-03-20")
    n = F.when(F.col("status") == "page", F.size(F.regexp_extract_all("raw", F.lit(LINKS), F.lit(1))))
    return rows.select(F.col("archive").cast("int").alias("archive"), "unit", "status", n.alias("n_urls"))


_SPEC = "(select o_orderkey as k, ['date', 'page', 'offset'][(o_orderkey % 3 + 1)::int] as kind, 5 + o_orderkey % 7 as pagesize, case when o_orderkey % 2 = 0 then 'POST' else 'GET' end as method, o_orderdate::date as day, o_orderkey % 50 as n from orders) o"


@frame_query("A9_archive_requests", f"select k, method, 'https://t.test/' || case kind when 'date' then strftime(day, '%Y/%m/%d') when 'page' then (n + 1)::varchar else (n * pagesize)::varchar end as url, case when method = 'POST' then '{{\"page\": ' || case kind when 'page' then n + 1 else 1 end || ', \"size\": ' || pagesize || '}}' end as body, kind = 'date' and day > date '1997-01-01' or n >= 40 as ended from {_SPEC}")
def a9(spark: SparkSession, d: str) -> DataFrame:
    """Orders as archives of three kinds, each some units into its walk, with its next request; cursors go through their JSON form."""
    key = F.col("o_orderkey")
    kind = F.element_at(F.array(*[F.lit(x) for x in ("date", "page", "offset")]), (key % 3 + 1).cast("int"))
    mark = F.element_at(F.array(*[F.lit(f"https://t.test/{{{x}}}") for x in ("date", "page", "offset")]), (key % 3 + 1).cast("int"))
    post = key % 2 == 0
    spec = F.struct(kind.alias("kind"), mark.alias("url"), F.lit("yyyy/MM/dd").alias("date_format"), (5 + key % 7).cast("int").alias("pagesize"), F.lit(1).alias("first"), F.when(post, "POST").otherwise("GET").alias("method"), F.when(post, '{"page": {page}, "size": {pagesize}}').alias("body"), F.lit(40).alias("max_units"))
    n = (key % 50).cast("int")
    rows = read(spark, d, "orders").select(key.alias("k"), spec.alias("s"), n.alias("n"), F.col("o_orderdate").cast("date").alias("day"))
    start = rows.withColumn("c", archives.initial_cursor(F.col("s"), F.date_sub("day", "n")))
    # n units on, by the sum of n steps: date, page and offset move alike each time
    moved = F.aggregate(F.sequence(F.lit(0), F.col("n")), F.col("c"), lambda c, i: F.when(i == 0, c).otherwise(archives.advance_cursor(F.col("s"), c)))
    at = start.withColumn("at", archives.read_cursor(archives.cursor_json(moved)))
    request = archives.build_request(F.col("s"), F.col("at"))
    return at.select("k", request.alias("r"), archives.ended(F.col("s"), F.col("at"), F.lit("1997-01-01").cast("date")).alias("ended")).select("k", "r.method", "r.url", "r.body", "ended")
