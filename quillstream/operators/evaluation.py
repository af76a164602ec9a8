"""Measures of retrieval and clustering, core terms of events, label sets, grounding and leaks."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstream.functions import ident
from quillstream.operators.tables import cut

CUTOFFS = (10, 20, 50, 100)
#: How many core terms, of how many counted, in how many documents at least.
CORE_TERMS, CORE_COUNTED, CORE_DOCUMENTS = 12, 24, 2
BODY_CHARS = 200
#: Bytes at a body's head that a payload's are compared with, of a gram that is hashed, and taken at a time; a factor for hashes.
HEAD, GRAM, BLOCK, _ODD = 200, 40, 1 << 20, np.uint64(0x9E3779B97F4A7C15)
#: Rows up to which a side of a join is broadcast.
BROADCAST_ROWS = 200_000


def recall(positives: DataFrame, ranked: DataFrame, cutoffs: tuple[int, ...] = CUTOFFS) -> DataFrame:
    """Per event with positives: n, recall, mrr and, for each cutoff k, p_k and r_k, of rows (event_id, doc_id) and (event_id, doc_id, pos)."""
    both = positives.select("event_id", "doc_id").distinct().join(ranked.select("event_id", "doc_id", "pos"), ["event_id", "doc_id"], "left")
    n, got = F.count(F.lit(1)), F.count("pos")
    at = lambda k: F.count(F.when(F.col("pos") <= k, 1))
    columns = [c for k in cutoffs for c in ((at(k) / k).alias(f"p_{k}"), (at(k) / n).alias(f"r_{k}"))]
    return both.groupBy("event_id").agg(n.alias("n"), (got / n).alias("recall"), F.coalesce(1.0 / F.min("pos"), F.lit(0.0)).alias("mrr"), *columns)


def recall_summary(per_event: DataFrame) -> DataFrame:
    """One row: recall weighted by each event's positives, and the mean over events."""
    return per_event.agg(F.sum("n").alias("n"), (F.sum(F.col("recall") * F.col("n")) / F.sum("n")).alias("weighted"), F.avg("recall").alias("macro"))


def cluster_quality(rows: DataFrame, truth: str = "truth", predicted: str = "predicted", noise: str = "noise") -> DataFrame:
    """One row of figures of a clustering (predicted -1: in none): n_clusters, n_noise, contamination (share of clustered rows
    whose truth is noise), adjusted Rand index, homogeneity and completeness; the last three null if nothing is clustered."""
    cells = rows.groupBy(F.col(truth).alias("t"), F.col(predicted).alias("p")).agg(F.count(F.lit(1)).cast("double").alias("n"))
    pairs = lambda c: c * (c - 1) / 2
    side = lambda k, name: cells.groupBy(k).agg(F.sum("n").alias("n")).agg(F.sum(pairs(F.col("n"))).alias(f"pairs_{name}"), F.sum(-F.col("n") * F.log("n")).alias(f"log_{name}"))
    clustered = F.col("p") != -1
    whole = cells.agg(
        F.sum("n").alias("n"),
        F.sum(pairs(F.col("n"))).alias("pairs"),
        F.sum(-F.col("n") * F.log("n")).alias("log"),
        F.count_distinct(F.when(clustered, F.col("p"))).alias("n_clusters"),
        F.coalesce(F.sum(F.when(~clustered, F.col("n"))), F.lit(0.0)).cast("long").alias("n_noise"),
        F.coalesce(F.sum(F.when(clustered & (F.col("t") == noise), F.col("n"))) / F.sum(F.when(clustered, F.col("n"))), F.lit(0.0)).alias("contamination"),
    )
    x = whole.crossJoin(side("t", "t")).crossJoin(side("p", "p"))  # one row each
    every = F.col("n") * (F.col("n") - 1) / 2
    expected = F.col("pairs_t") * F.col("pairs_p") / F.nullif(every, F.lit(0.0))
    most = (F.col("pairs_t") + F.col("pairs_p")) / 2
    entropy = lambda log: F.log("n") + F.col(log) / F.col("n")
    shared = entropy("log_t") + entropy("log_p") - entropy("log")
    any_ = F.col("n_clusters") > 0
    share = lambda h: F.when(any_, F.when(h <= 1e-12, F.lit(1.0)).otherwise(shared / F.nullif(h, F.lit(0.0))))
    ari = F.when(any_, F.when(most - expected == 0, F.lit(1.0)).otherwise((F.col("pairs") - expected) / F.nullif(most - expected, F.lit(0.0))))
    return x.select("n_clusters", "n_noise", "contamination", ari.alias("ari"), share(entropy("log_t")).alias("homogeneity"), share(entropy("log_p")).alias("completeness"))


def core_terms(names: DataFrame) -> DataFrame:
    """(event_id, terms): of rows (event_id, doc_id, kind, name), the names told most often, in two mentions at least.

    Names of persons and companies have 2 to 12 characters, those of bodies and tenders up to 16; ties go by name.
    """
    limit = F.when(F.col("kind").isin("agencies", "organizations", "tender_names"), 16).otherwise(12)
    fit = names.filter(F.length("name").between(2, limit))
    counted = fit.groupBy("event_id", F.trim("name").alias("name")).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("event_id").orderBy(F.desc("n"), "name")
    top = counted.withColumn("r", F.row_number().over(w)).filter((F.col("r") <= CORE_COUNTED) & (F.col("n") >= CORE_DOCUMENTS) & (F.col("r") <= CORE_TERMS))
    return top.groupBy("event_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("r", "name"))), lambda x: x["name"]).alias("terms"))


def label_confidence(in_title: Column, mentions: Column, corroborated: Column) -> Column:
    return F.when(in_title & (corroborated > 0), "high").when((corroborated >= 2) & (mentions >= 2), "medium").when(in_title | ((mentions >= 3) & (corroborated > 0)), "medium").otherwise("low")


def label_set(docs: DataFrame, events: DataFrame, per_event: int) -> DataFrame:
    """The rows to label of each event: of the newest four times per_event that hold its keyword, those of best confidence, then most mentions.

    docs: doc_id, title, body, published_at (not null). events: event_id, keyword, corroborators (array). Only ids and times are ranked, once for each
    keyword; texts are read again for the few that are left.
    """
    named = docs.withColumn("_text", F.xxhash64("title", "body"))  # tells rows of one id apart
    held = named.join(F.broadcast(events.select("keyword").distinct()), F.contains("body", F.col("keyword"))).select("keyword", "doc_id", "_text", "published_at")
    ranked = held.withColumn("_r", F.row_number().over(Window.partitionBy("keyword").orderBy(F.desc("published_at"), "doc_id")))
    newest = cut(ranked.filter(F.col("_r") <= 4 * per_event))
    few = named.join(F.broadcast(newest.select("doc_id", "_text").distinct()), ["doc_id", "_text"], "left_semi").dropDuplicates(["doc_id", "_text"]).drop("published_at")
    matches = few.join(newest, ["doc_id", "_text"]).join(events, "keyword")
    text = F.concat_ws("\n", "title", "body")
    mentions = F.size(F.split("body", F.concat(F.lit("\\Q"), F.col("keyword"), F.lit("\\E")), -1)) - 1
    seen = F.size(F.filter("corroborators", lambda c: F.contains(text, c)))
    scored = matches.withColumn("mentions", mentions).withColumn("confidence", label_confidence(F.contains("title", F.col("keyword")), F.col("mentions"), seen))
    rank = F.array_position(F.array(F.lit("high"), F.lit("medium"), F.lit("low")), F.col("confidence"))
    w = Window.partitionBy("event_id").orderBy(rank, F.desc("mentions"), "_r")
    flat = lambda c, n: F.left(F.translate(c, "\n\r\t", "   "), F.lit(n))
    kept = scored.withColumn("pos", F.row_number().over(w)).filter(F.col("pos") <= per_event)
    return kept.select("event_id", "confidence", "mentions", F.lit("").alias("label"), F.date_format("published_at", "yyyy-MM-dd").alias("published"), F.translate("title", "\n\r\t", "   ").alias("title"), flat("body", 70).alias("snippet"), "doc_id", "pos")


def grounding(rows: DataFrame) -> DataFrame:
    """rows (id, values, source_text) with checked, grounded, ungrounded (values in order) and rate: a value is grounded if it
    stands in the source, spaces apart, or if both normalise to the same case number."""
    bare = lambda c: F.translate(c, " ", "")
    source = F.translate(F.coalesce("source_text", F.lit("")), " 　", "")
    case = ident.normalize_case_number(F.col("source_text"))
    values = F.filter(F.transform("values", lambda v: F.trim(v)), lambda v: v != "")
    lost = F.filter(values, lambda v: ~F.contains(source, bare(v)) & ~F.coalesce(ident.normalize_case_number(v) == case, F.lit(False)))
    n = F.size(values)
    return rows.select("id", n.alias("checked"), (n - F.size(lost)).alias("grounded"), lost.alias("ungrounded"), F.when(n > 0, (n - F.size(lost)) / n).otherwise(F.lit(1.0)).alias("rate"))


def _least_hashes(texts: pa.Array, first: bool) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash): of every HEAD bytes in a row the least hash of their GRAM-byte grams, told where it changes; with first, of a text's first HEAD bytes."""
    texts = texts.cast(pa.large_string())
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data, ends = np.frombuffer(texts.buffers()[2], np.uint8)[ends[0] : ends[-1]], ends - ends[0]
    power = np.r_[np.uint64(1), np.full(BLOCK + HEAD, _ODD)].cumprod(dtype=np.uint64)
    back = np.r_[np.uint64(1), np.full(BLOCK + HEAD, np.uint64(pow(int(_ODD), -1, 1 << 64)))].cumprod(dtype=np.uint64)
    rows, hashes = [], []
    for at in range(0, len(data) - HEAD + 1, BLOCK):
        part = data[at : at + BLOCK + HEAD - 1].astype(np.uint64) + np.uint64(1)
        sums = np.r_[np.uint64(0), np.cumsum(part * power[: len(part)], dtype=np.uint64)]
        h = (sums[GRAM:] - sums[:-GRAM]) * back[: len(part) - GRAM + 1]
        h = (h ^ (h >> np.uint64(32))) * _ODD
        h ^= h >> np.uint64(29)
        width, n = 1, HEAD - GRAM + 1
        while 2 * width <= n:
            h, width = np.minimum(h[:-width], h[width:]), 2 * width
        h = np.minimum(h[: len(h) - (n - width)], h[n - width :])
        start = at + np.arange(len(h))
        own = np.searchsorted(ends, start, "right") - 1
        whole = start + HEAD <= ends[own + 1]
        told = whole & (start == ends[own]) if first else whole & np.r_[True, ~whole[:-1] | (own[1:] != own[:-1]) | (h[1:] != h[:-1])]
        rows.append(own[told])
        hashes.append(h[told].view(np.int64))
    return (np.concatenate(rows), np.concatenate(hashes)) if rows else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _anchors(texts: DataFrame, first: bool) -> DataFrame:
    """(key, anchor) of rows (key, text)."""

    def run(batches):
        for whole in batches:
            for k in range(0, whole.num_rows, 1000):
                b = whole.slice(k, 1000)
                rows, hashes = _least_hashes(b.column(1), first)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows)), pa.array(hashes)], ["key", "anchor"])

    return texts.mapInArrow(run, "key string, anchor long")


def _sent(rows: DataFrame) -> DataFrame:
    """rows, to be broadcast if they are few."""
    return F.broadcast(rows) if rows.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else rows


def leaks(payloads: DataFrame, corpus: DataFrame) -> DataFrame:
    """(payload_id, doc_id): protected bodies of over BODY_CHARS characters that stand word for word in a payload.

    A payload that holds a body holds its first HEAD bytes and so their gram of least hash, and tells that one too: of every HEAD bytes in a row it
    tells the least, about one for eighty bytes. The same holds for bytes in the middle and at the end, so that bodies of one beginning don't meet all of
    its payloads. Where all three meet, different texts are compared once each, whatever their copies.
    """
    bodies = corpus.filter(F.length("body") > BODY_CHARS).select("doc_id", "body", F.md5("body").alias("body_key"))
    held = payloads.filter(F.length("payload") > BODY_CHARS).select("payload_id", "payload", F.md5("payload").alias("key"))
    middle = F.substring("body", ((F.length("body") - HEAD) / 2).cast("int") + 1, F.lit(HEAD))
    places = F.posexplode(F.array(F.left("body", F.lit(HEAD)), middle, F.right("body", F.lit(HEAD)))).alias("place", "part")
    parts = bodies.select("body_key", places).select(F.concat_ws(":", "place", "body_key").alias("key"), "part")
    asked = _anchors(parts, True).select(F.substring_index("key", ":", 1).cast("int").alias("place"), F.substring_index("key", ":", -1).alias("body_key"), "anchor")
    meets = _anchors(held.select("key", "payload"), False).join(_sent(cut(asked.distinct())), "anchor")
    met = cut(meets.groupBy("key", "body_key").agg(F.count_distinct("place").alias("n")).filter("n = 3").select("key", "body_key"))
    texts = held.join(_sent(met.select("key").distinct()), "key", "left_semi").select("key", "payload").dropDuplicates(["key"])
    both = texts.join(met, "key").join(bodies.select("body_key", "body").dropDuplicates(["body_key"]), "body_key")
    found = cut(both.filter(F.contains("payload", F.col("body"))).select("key", "body_key"))
    return held.select("payload_id", "key").join(_sent(found), "key").join(bodies.select("doc_id", "body_key"), "body_key").select("payload_id", "doc_id")


def unique_slugs(wanted: DataFrame, taken: DataFrame, base: str = "base", order: str = "id") -> DataFrame:
    """wanted with `slug`: the base, or the base with the first free suffix -2, -3 ..., in the given order."""
    w = Window.partitionBy(base)
    rows = wanted.withColumn("_r", F.row_number().over(w.orderBy(order))).withColumn("_n", F.count(F.lit(1)).over(w))
    # so many are asked for and so many suffixes of this base are taken: the free ones are among the first of their sum
    suffix = F.regexp_extract("slug", r"^(.*)-([0-9]+)$", 1)
    held = taken.select(F.explode(F.array_distinct(F.array("slug", F.when(suffix != "", suffix).otherwise(F.col("slug"))))).alias(base)).groupBy(base).agg(F.count(F.lit(1)).alias("_held"))
    asked = rows.groupBy(base).agg(F.first("_n").alias("_n")).join(held, base, "left")
    tries = asked.select(base, F.explode(F.sequence(F.lit(1), F.col("_n") + F.coalesce("_held", F.lit(0)))).alias("_k"))
    named = tries.withColumn("slug", F.when(F.col("_k") == 1, F.col(base)).otherwise(F.concat_ws("-", base, F.col("_k").cast("string"))))
    free = named.join(taken.select("slug"), "slug", "left_anti").withColumn("_r", F.row_number().over(w.orderBy("_k")))
    return rows.join(free.select(base, "_r", "slug"), [base, "_r"]).select(*wanted.columns, "slug")


def union_sorted(*arrays: Column) -> Column:
    """All distinct elements of several arrays, null arrays counting as empty, in order."""
    return F.array_sort(reduce(F.array_union, [F.coalesce(a, F.array().cast("array<string>")) for a in arrays]))
