"""Documents go to events: by identifier, by a judge in batches, from judgments and from official checks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstream.functions import classify

from quillstream.operators.search import hybrid_search

CANDIDATES, BATCH = 300, 20
REPLY = "struct<assignments: array<struct<doc_id: bigint, belongs: boolean, reason: string>>>"


def identifier_matches(docs: DataFrame, events: DataFrame) -> DataFrame:
    """(doc_id, event_id): documents whose case numbers meet those of exactly one event."""
    one = docs.select("doc_id", F.explode("case_numbers").alias("case")).distinct()
    other = events.select("event_id", F.explode("case_numbers").alias("case")).distinct()
    found = one.join(other, "case").groupBy("doc_id").agg(F.min("event_id").alias("event_id"), F.max("event_id").alias("last"))
    return found.filter(F.col("event_id") == F.col("last")).select("doc_id", "event_id")


def accepted(replies: DataFrame) -> DataFrame:
    """(event_id, doc_id, reason) that a judge's replies (event_id, batch, finish_reason, content) accept.

    A reply that was cut at its length, or whose content is no valid JSON, counts for nothing: its whole batch is dropped.
    """
    whole = replies.filter(F.col("finish_reason") != "length")
    said = whole.select("event_id", F.from_json("content", REPLY, {"mode": "PERMISSIVE"}).alias("r")).filter(F.col("r").isNotNull())
    each = said.select("event_id", F.explode("r.assignments").alias("a")).filter("a.belongs")
    return each.select("event_id", F.col("a.doc_id").alias("doc_id"), F.coalesce("a.reason", F.lit("")).alias("reason"))


def auto_assign(docs: DataFrame, events: DataFrame, assigned: DataFrame, judge: Callable[[DataFrame], DataFrame], candidates: int = CANDIDATES, batch: int = BATCH) -> DataFrame:
    """(doc_id, event_id, method, reason) of documents that were not assigned before; of several events the first wins.

    events: event_id (their order), identity, support, case_numbers. Candidates come from the keyword channels alone. One that
    shares a case number with the event needs no judge; the others go to it in batches of rows (event_id, batch, doc_ids). A
    document that an earlier event's identifier takes is not judged; all batches are judged at once, so one that an
    earlier event's judge accepts may be judged again, in vain.
    """
    queries = events.select(F.col("event_id").alias("query_id"), "identity", "support", F.array().cast("array<string>").alias("case_numbers"), F.array().cast("array<string>").alias("tax_ids"))
    found = hybrid_search(docs, queries, None, candidates).select(F.col("query_id").alias("event_id"), "doc_id", "pos")
    found = found.join(assigned.select("doc_id").distinct(), "doc_id", "left_anti")
    cases = docs.select("doc_id", "case_numbers")
    met = found.join(cases, "doc_id").join(events.select("event_id", F.col("case_numbers").alias("own")), "event_id")
    same = met.withColumn("shared", F.array_sort(F.array_intersect("case_numbers", "own")))
    first = Window.partitionBy("doc_id").orderBy("event_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    marked = same.withColumn("taken", F.max((F.size("shared") > 0).cast("int")).over(first))
    by_identifier = marked.filter(F.size("shared") > 0).select("doc_id", "event_id", F.lit("identifier").alias("method"), F.concat(F.lit("case number: "), F.array_join("shared", ", ")).alias("reason"))
    place = F.row_number().over(Window.partitionBy("event_id").orderBy("pos")) - 1
    rest = marked.filter("taken = 0").withColumn("batch", F.floor(place / batch).cast("int"))
    asked = rest.groupBy("event_id", "batch").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "doc_id"))), lambda x: x["doc_id"]).alias("doc_ids"))
    judged = accepted(judge(asked)).join(rest.select("event_id", "doc_id"), ["event_id", "doc_id"], "left_semi")
    both = by_identifier.unionByName(judged.select("doc_id", "event_id", F.lit("judge").alias("method"), "reason"))
    return both.groupBy("doc_id").agg(F.min(F.struct("event_id", "method", "reason")).alias("a")).select("doc_id", "a.*")


def ingest_judgments(judgments: DataFrame, events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Links (event_id, doc_id) of judgments to active or dormant events by case number, and what becomes of those events.

    judgments: doc_id, case_numbers, published_at. events: event_id, case_numbers, status, last_progress_at. Of an event
    with a link come (event_id, status, last_progress_at, woke): a dormant one is active again, progress never goes back.
    """
    links = identifier_matches(judgments, events.filter(F.col("status").isin("active", "dormant"))).select("event_id", "doc_id")
    newest = links.join(judgments.select("doc_id", "published_at"), "doc_id").groupBy("event_id").agg(F.max("published_at").alias("newest"))
    woke = F.col("status") == "dormant"
    changed = events.join(newest, "event_id").select("event_id", F.when(woke, "active").otherwise(F.col("status")).alias("status"), F.greatest("last_progress_at", "newest").alias("last_progress_at"), woke.alias("woke"))
    return links, changed


def official_check(events: DataFrame, archives: DataFrame, members: DataFrame, months_back: int = 2) -> tuple[DataFrame, DataFrame]:
    """Cases of due events found in the newest archives, and the events that count as checked.

    events: event_id, case_numbers, due. archives: archive, month, expired (the session that it needs is). members: archive,
    case_number, doc_id. A case belongs to the first event that names it and is taken from the newest archive that has it.
    Archives are opened from the newest while a case is missing; one whose session is expired ends the check, what
    newer ones gave stays, and no event counts as checked.
    """
    pending = events.filter("due").select("event_id", F.explode("case_numbers").alias("case_number")).groupBy("case_number").agg(F.min("event_id").alias("event_id"))
    w = Window.orderBy(F.desc("month"), "archive")  # of the catalogue: one row a month
    opened = archives.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= months_back)
    hits = pending.join(members, "case_number").join(F.broadcast(opened.filter("not expired")), "archive")
    found = hits.groupBy("case_number", "event_id").agg(F.min("place").alias("place"), F.min_by("archive", "place").alias("archive"), F.min_by("doc_id", F.struct("place", "doc_id")).alias("doc_id"))
    barred = opened.filter("expired").agg(F.min("place").alias("barred"))
    reached = found.crossJoin(F.broadcast(barred)).filter(F.col("barred").isNull() | (F.col("place") < F.col("barred")))
    missing = pending.join(reached, "case_number", "left_anti").limit(1).select(F.lit(True).alias("missing"))
    ended = barred.filter("barred is not null").crossJoin(missing)
    checked = events.filter("due and size(case_numbers) > 0").select("event_id").join(F.broadcast(ended), F.lit(True), "left_anti")
    return reached.select("case_number", "event_id", "archive", "doc_id"), checked


def review(events: DataFrame, batch: bool = False) -> DataFrame:
    """(event_id, outcome, status): what approving each event comes to.

    events: event_id, status, risk_tier, missing (number of unconfirmed items of a high risk), publish, violations (number of
    wording faults). In a batch an event of high risk is skipped and none is published.
    """
    pending = F.col("status").isin("candidate", "draft")
    publish = F.lit(False) if batch else F.col("publish")
    high = F.col("risk_tier") == "high"
    outcome = (
        F.when(F.lit(batch) & high, "skipped")
        .when(~pending, "not_pending")
        .when(high & (F.col("missing") > 0), "incomplete")
        .when(publish & (F.col("violations") > 0), "blocked")
        .when(publish, "published")
        .otherwise("approved")
    )
    status = F.when(outcome.isin("approved", "published"), "active").otherwise(F.col("status"))
    return events.select("event_id", outcome.alias("outcome"), status.alias("status"))


def node_fault(citation: Column, violations: Column) -> Column:
    """Why a timeline node is refused, else null."""
    return F.when(citation.isNull(), "no citation").when(violations > 0, "wording")


def edge_fault(from_id: Column, to_id: Column, from_event: Column, to_event: Column, kind: Column, citation: Column, confidence: Column, violations: Column | None = None) -> Column:
    """Why a causal edge is refused, else null. violations: how many faults edge_wording finds, which bar a stated edge."""
    fault = (
        F.when(from_id == to_id, "self loop")
        .when(~from_event.eqNullSafe(to_event), "other event")
        .when((kind == "stated") & citation.isNull(), "no citation")
        .when((kind == "inferred") & confidence.isNull(), "no confidence")
    )
    return fault if violations is None else fault.when((kind == "stated") & (violations > 0), "wording")


def edge_wording(from_summary: Column, to_summary: Column, is_final: Column) -> Column:
    """How many wording faults a stated edge has, read as one claim over both of its nodes."""
    return F.size(classify.wording_violations(F.concat(from_summary, F.lit(" → "), to_summary), is_final))


def edges_made(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """edges (edge_id, event_id, from_id, to_id, kind, citation, confidence, is_final, public) with fault and, where there is none, public: as given, else
    only stated edges are public. nodes: node_id, event_id, summary; an end that is no node belongs to no event."""
    end = lambda side: nodes.select(F.col("node_id").alias(f"{side}_id"), F.col("event_id").alias(f"{side}_event"), F.col("summary").alias(f"{side}_summary"))
    both = edges.join(end("from"), "from_id", "left").join(end("to"), "to_id", "left")
    own = F.when(F.col("from_event").eqNullSafe(F.col("event_id")), F.col("from_event"))
    wording = edge_wording(F.col("from_summary"), F.col("to_summary"), F.coalesce("is_final", F.lit(False)))
    fault = edge_fault(F.col("from_id"), F.col("to_id"), F.coalesce(own, F.lit(-1)), F.col("to_event"), F.col("kind"), F.col("citation"), F.col("confidence"), wording)
    return both.withColumn("fault", fault).select("edge_id", "fault", F.when(F.col("fault").isNull(), F.coalesce("public", F.col("kind") == "stated")).alias("public"))


def nodes_made(nodes: DataFrame) -> DataFrame:
    """(node_id, fault) of timeline nodes (node_id, summary, citation, is_final) to be written."""
    faults = F.size(classify.wording_violations(F.coalesce("summary", F.lit("")), F.coalesce("is_final", F.lit(False))))
    return nodes.select("node_id", node_fault(F.col("citation"), faults).alias("fault"))


def chat_candidates(hits: DataFrame, keyword: DataFrame, docs: DataFrame, limit: int = 12, pool: int = 300, newest: int = 4) -> DataFrame:
    """(query_id, doc_id, pos): the newest few of the best keyword matches, newest first, then the best hits, each document once.

    hits, keyword: query_id, doc_id, pos of the hybrid and the keyword channel; docs: doc_id, published_at. Either may be empty.
    """
    recent = keyword.filter(F.col("pos") <= pool).join(docs.select("doc_id", "published_at").filter("published_at is not null"), "doc_id")
    w = Window.partitionBy("query_id").orderBy(F.desc("published_at"), "pos")
    recent = recent.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= newest).select("query_id", "doc_id", F.lit(0).alias("part"), "r")
    ranked = hits.filter(F.col("pos") <= 4 * limit).select("query_id", "doc_id", F.lit(1).alias("part"), F.col("pos").alias("r"))
    once = recent.unionByName(ranked).groupBy("query_id", "doc_id").agg(F.min(F.struct("part", "r")).alias("o"))
    placed = once.withColumn("pos", F.row_number().over(Window.partitionBy("query_id").orderBy("o")))
    return placed.filter(F.col("pos") <= limit).select("query_id", "doc_id", "pos")
