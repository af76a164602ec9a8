"""What a source's pages, archives, seeds and schedule come to; and model calls under a budget, each with its line in the ledger."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstream.functions import text as tx
from quillstream.operators.ranking import running_total

#: Pages that a live poll looks through at most; how the title of a monthly archive begins; what a proposal may hold.
LIVE_PAGES = 5
MONTHLY = r"^\d{6}裁判書"
MAX_TAGS, TITLE_CHARS = 8, 24


def live_walk(pages: DataFrame, known: DataFrame, max_pages: int = LIVE_PAGES) -> DataFrame:
    """(source, page, url): what a poll from the newest page back collects.

    pages: source, page (from 1), urls (array), failed. The walk ends after a page that holds a known url or none at all,
    before one that failed or repeats the one before, and at max_pages; what it has collected by then stays. A source whose
    first page failed gives nothing.
    """
    seen = pages.select("source", "page", F.explode("urls").alias("url")).join(known.select("url").distinct(), "url", "left_semi").select("source", "page").distinct().withColumn("met", F.lit(True))
    w = Window.partitionBy("source").orderBy("page")
    same = F.array_sort(F.array_distinct("urls")).eqNullSafe(F.lag(F.array_sort(F.array_distinct("urls"))).over(w))
    rows = pages.join(seen, ["source", "page"], "left").withColumn("on", ~F.coalesce("met", F.lit(False)) & (F.size("urls") > 0))
    enters = ~F.col("failed") & ((F.col("page") == 1) | (F.lag("on").over(w) & ~same & (F.lag("page").over(w) == F.col("page") - 1))) & (F.col("page") <= max_pages)
    reached = rows.withColumn("enters", enters).withColumn("all", F.min("enters").over(w)).filter("all")
    return reached.select("source", "page", F.explode("urls").alias("url"))


def page_outcome(n_items: Column, live: Column) -> Column:
    """An empty list page ends a walk through history, and is an error of a live poll."""
    return F.when(n_items > 0, "items").when(live, "error").otherwise("end")


def monthly_archives(listing: DataFrame, limit: int = 24) -> DataFrame:
    """(dataset_id, title, fileset_id, published_at, gated): the newest monthly archives of a listing's JSON text (column raw)."""
    item = "array<struct<datasetId: bigint, title: string, categoryDataset: string, publishedDate: string, filesetLists: array<struct<fileSetId: bigint>>>>"
    items = listing.select(F.explode(F.from_json(F.get_json_object("raw", "$.pagedList.items"), item)).alias("i")).select("i.*")
    fit = items.filter((F.size("filesetLists") > 0) & F.coalesce("title", F.lit("")).rlike(MONTHLY))
    rows = fit.select(F.col("datasetId").alias("dataset_id"), "title", F.col("filesetLists")[0]["fileSetId"].alias("fileset_id"), F.col("publishedDate").try_cast("timestamp_ntz").alias("published_at"), F.coalesce(F.col("categoryDataset") == "B", F.lit(False)).alias("gated"))
    return rows.orderBy(F.desc_nulls_last("published_at"), "dataset_id").limit(limit)


def find_members(cases: DataFrame, members: DataFrame) -> DataFrame:
    """(case_id, archive, name): the first file by name of each case (case_id, year, category, number) among the names of archives' members,
    which hold court, year, category, number, date and version between commas."""
    part = F.split(F.element_at(F.split("name", "/"), -1), ",")
    named = members.select("archive", "name", F.get(part, F.lit(1)).try_cast("int").alias("year"), F.get(part, F.lit(2)).alias("category"), F.get(part, F.lit(3)).try_cast("int").alias("number"))
    return cases.join(named, ["year", "category", "number"]).groupBy("case_id", "archive").agg(F.min("name").alias("name"))


def procurement_plan(events: DataFrame) -> DataFrame:
    """(event_id, term, endpoint): searches of each event with an identity, by title, and by company name for what looks like one."""
    named = events.filter(F.coalesce("identity", F.lit("")) != "")
    companies = named.select("event_id", F.explode("support").alias("term"), F.lit("company").alias("endpoint")).filter(tx.looks_like_company(F.col("term")))
    return named.select("event_id", F.col("identity").alias("term"), F.lit("title").alias("endpoint")).unionByName(companies)


def schedule_fault(interval_minutes: Column, start: Column, end: Column) -> Column:
    """Why a source's schedule is refused, else null."""
    hour = lambda c: c.isNull() | c.between(0, 23)
    return F.when(interval_minutes.isNull() | (interval_minutes < 1), "interval").when(~hour(start) | ~hour(end), "hour")


def ledger(calls: DataFrame, approved: Column) -> DataFrame:
    """calls (call_id, ordered; cost; failed) with status and charged: a call is made as long as what was spent before is under what is approved.

    Failed calls are charged and written too; refused ones cost nothing. Once spent, the budget stops all later calls.
    """
    total = running_total(calls, "call_id", "cost", "total")
    open_ = total["total"] - total["cost"] < approved
    status = F.when(~open_, "refused").when(F.col("failed"), "failed").otherwise("ok")
    return total.select("call_id", status.alias("status"), F.when(open_, F.col("cost")).otherwise(F.lit(0)).alias("charged"))


def proposals(suggested: DataFrame, existing: DataFrame) -> DataFrame:
    """New proposals (conv_id, title, tags): titles that a conversation does not have yet, with the first tags; a blank title is the summary's beginning."""
    title = F.when(F.trim("title") != "", F.trim("title")).otherwise(F.left(F.trim("summary"), F.lit(TITLE_CHARS)))
    named = suggested.select("conv_id", title.alias("title"), F.slice("tags", 1, MAX_TAGS).alias("tags")).filter("title <> ''")
    return named.join(existing.select("conv_id", "title"), ["conv_id", "title"], "left_anti").dropDuplicates(["conv_id", "title"])
