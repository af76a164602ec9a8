"""Search for many queries at once: keyword, vector and identifier channels, their fusion and pinned hits.

Queries come as rows. As long as they are within a checked size they are sent to every task as arrays, and each task keeps
only its best rows of each query, so that what is shuffled is tasks x queries x k rows however common a term is; beyond it
the search is a join.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstream.functions import text as tx

#: Rows (query terms) and numbers (query vectors' components) up to which queries are sent to the tasks.
MAX_TERMS, MAX_NUMBERS = 1_000_000, 8_000_000
PER_CHANNEL, TOP_K, RRF = 500, 50, 60


def postings(rows: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, token, tf): the inverted index."""
    tokens = F.explode_outer(tx.tokenize(F.col(text))).alias("token")
    return rows.select(id_column, tokens).filter("token is not null").groupBy(id_column, "token").agg(F.count(F.lit(1)).alias("tf"))


class _Best:
    """The best k rows of each query so far; rows are arrays (query, first, second, id), larger first and second and smaller ids being better."""

    def __init__(self, k: int | None):
        self.k = k
        self.held: list[tuple[np.ndarray, ...]] = []
        self.n = 0

    def add(self, *rows: np.ndarray) -> None:
        self.held.append(rows)
        self.n += len(rows[0])
        if self.k and self.n > 200_000:
            self.held = [self.rows()]
            self.n = len(self.held[0][0])

    def rows(self) -> tuple[np.ndarray, ...]:
        cols = tuple(np.concatenate(c) for c in zip(*self.held))
        order = np.lexsort((cols[3], -cols[2], -cols[1], cols[0]))
        cols = tuple(c[order] for c in cols)
        if not self.k or not len(order):
            return cols
        starts = np.flatnonzero(np.r_[True, cols[0][1:] != cols[0][:-1]])
        place = np.arange(len(order)) - np.repeat(starts, np.diff(np.r_[starts, len(order)]))
        return tuple(c[place < self.k] for c in cols)


def keyword_matches(docs: DataFrame, queries: DataFrame, k: int | None = None, all_terms: bool = False, query_id: str = "query_id", text: str = "text") -> DataFrame:
    """(query_id, doc_id, hits, tf, m): documents that hold a query's tokens (all of them, or any), with the distinct tokens found, the
    sum of their frequencies and the number of the query's tokens. With k, at least all those among the query's best k."""
    asked = postings(queries, query_id, text).select(query_id, "token")
    terms = asked.limit(MAX_TERMS + 1).collect()
    kind = docs.schema["doc_id"].dataType.simpleString()
    if len(terms) > MAX_TERMS:
        sizes = asked.groupBy(query_id).agg(F.count(F.lit(1)).alias("m"))
        hit = postings(docs).join(asked, "token").groupBy(query_id, "doc_id").agg(F.count(F.lit(1)).alias("hits"), F.sum("tf").alias("tf")).join(sizes, query_id)
        return hit.filter("hits = m") if all_terms else hit
    ids = sorted({r[0] for r in terms})
    number = {q: i for i, q in enumerate(ids)}
    lists: dict[str, list[int]] = {}
    for r in terms:
        lists.setdefault(r[1], []).append(number[r[0]])
    posted = {t: np.array(x, np.int32) for t, x in lists.items()}
    size = np.bincount([number[r[0]] for r in terms], minlength=len(ids))

    def run(batches):
        best = _Best(k)
        for b in batches:
            for doc, tokens in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                counts: dict[str, int] = {}
                for t in tokens or ():
                    if t in posted:
                        counts[t] = counts.get(t, 0) + 1
                if not counts:
                    continue
                found = [posted[t] for t in counts]
                at = np.concatenate(found)
                hits = np.bincount(at, minlength=len(ids))
                tf = np.bincount(at, np.repeat(np.fromiter(counts.values(), float), [len(x) for x in found]), len(ids)).astype(np.int64)
                q = np.flatnonzero(hits == size if all_terms else hits)
                best.add(q, hits[q], tf[q], np.full(len(q), doc))
        if best.held:
            q, hits, tf, doc = best.rows()
            yield pa.RecordBatch.from_arrays([pa.array(q, pa.int32()), pa.array(doc, pa.int64()), pa.array(hits, pa.int64()), pa.array(tf, pa.int64()), pa.array(size[q], pa.int64())], ["q", "doc_id", "hits", "tf", "m"])

    rows = docs.select(F.col("doc_id").cast("long"), tx.tokenize(F.col(text)).alias("tokens"))
    found = rows.mapInArrow(run, "q int, doc_id long, hits long, tf long, m long")
    names = docs.sparkSession.createDataFrame(list(enumerate(ids)) or [], f"q int, {query_id} {queries.schema[query_id].dataType.simpleString()}")
    return found.join(F.broadcast(names), "q").select(query_id, F.col("doc_id").cast(kind), "hits", "tf", "m")


def keyword_channel(docs: DataFrame, queries: DataFrame, k: int, query_id: str = "query_id") -> DataFrame:
    """The k best any-token matches of each query; score is the share of its distinct tokens found, then the summed frequency, then the id."""
    scored = keyword_matches(docs, queries, k, query_id=query_id).withColumn("score", F.round(F.col("hits").cast("double") / F.col("m"), 6))
    w = Window.partitionBy(query_id).orderBy(F.desc("score"), F.desc("tf"), "doc_id")
    return scored.withColumn("pos", F.row_number().over(w)).filter(F.col("pos") <= k).select(query_id, "doc_id", "hits", "tf", "score", "pos")


def vector_channel(vectors: DataFrame, queries: DataFrame, k: int, id_column: str = "doc_id", query_id: str = "query_id", others_only: bool = False) -> DataFrame:
    """(query_id, doc_id, score, pos): exact k nearest by cosine of each row (query_id, embedding) of queries; null and zero vectors have no place.

    With others_only, a vector whose id is the query's own is left out.
    """
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    real = lambda rows, key: rows.filter("embedding is not null").filter(norm > 0).select(F.col(key).cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("v"))
    asked, base = real(queries, query_id), real(vectors, id_column)
    size = asked.agg(F.coalesce(F.sum(F.size("v")), F.lit(0))).head()[0]
    if size > MAX_NUMBERS:
        dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
        pairs = base.join(asked.select(F.col("id").alias("q"), F.col("v").alias("u")), F.lit(True) if not others_only else F.col("q") != F.col("id"))
        found = pairs.select("q", F.col("id").alias("doc"), (dot(F.col("v"), F.col("u")) / F.sqrt(dot(F.col("v"), F.col("v")) * dot(F.col("u"), F.col("u")))).alias("score"))
    else:
        rows = asked.collect()
        ids = np.array([r["id"] for r in rows], np.int64)
        unit = np.array([r["v"] for r in rows], float).reshape(len(rows), -1)
        unit = unit / np.linalg.norm(unit, axis=1, keepdims=True) if len(rows) else unit

        def run(batches):
            best = _Best(k)
            for b in batches if len(ids) else ():
                for at in range(0, b.num_rows, 2000):
                    part = b.slice(at, 2000)
                    doc = part.column(0).to_numpy()
                    x = np.stack(part.column(1).to_numpy(zero_copy_only=False))
                    s = (x / np.linalg.norm(x, axis=1, keepdims=True)) @ unit.T
                    rounded = np.round(s, 5)
                    if others_only:
                        rounded[doc[:, None] == ids[None, :]] = -np.inf
                    edge = -np.partition(-rounded, k - 1, axis=0)[k - 1] if len(doc) > k else -np.inf
                    d, q = np.nonzero((rounded >= edge) & (rounded > -np.inf))  # with all ties at the edge
                    best.add(q, rounded[d, q], s[d, q], doc[d])
            if best.held:
                q, _, score, doc = best.rows()
                yield pa.RecordBatch.from_arrays([pa.array(ids[q]), pa.array(doc), pa.array(score)], ["q", "doc", "score"])

        found = base.mapInArrow(run, "q long, doc long, score double")
    w = Window.partitionBy("q").orderBy(F.desc("score"), "doc")
    ranked = found.withColumn("score", F.round("score", 5)).withColumn("pos", F.row_number().over(w)).filter(F.col("pos") <= k)
    return ranked.select(F.col("q").alias(query_id), F.col("doc").alias("doc_id"), "score", "pos")


def fuse(channels: DataFrame, query_id: str = "query_id", constant: int = RRF) -> DataFrame:
    """Reciprocal rank fusion of rows (query_id, doc_id, channel, pos): score and the document's place in each channel."""
    return channels.groupBy(query_id, "doc_id").agg(
        F.round(F.sum(1.0 / (constant + F.col("pos"))), 9).alias("score"),
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("channel", "pos")))).alias("channels"),
    )


def identifier_channel(docs: DataFrame, queries: DataFrame, k: int | None = None) -> DataFrame:
    """(query_id, doc_id, pos): documents that share a case number or tax id with the query, newest first, unknown times ahead; all of them without k."""
    def marked(kind: str) -> Column:
        return F.transform(F.filter(F.coalesce(kind, F.array().cast("array<string>")), lambda x: x != ""), lambda x: F.concat(F.lit(f"{kind}:"), x))

    marks = lambda rows, key: rows.select(key, F.explode(F.concat(marked("case_numbers"), marked("tax_ids"))).alias("mark")).distinct()
    hit = marks(docs, "doc_id").join(marks(queries, "query_id"), "mark").select("query_id", "doc_id").distinct().join(docs.select("doc_id", "published_at"), "doc_id")
    w = Window.partitionBy("query_id").orderBy(F.desc_nulls_first("published_at"), "doc_id")
    placed = hit.withColumn("pos", F.row_number().over(w)).select("query_id", "doc_id", "pos")
    return placed if k is None else placed.filter(F.col("pos") <= k)


def hybrid_search(docs: DataFrame, queries: DataFrame, query_vectors: DataFrame | None = None, top_k: int = TOP_K, per_channel: int = PER_CHANNEL) -> DataFrame:
    """(query_id, doc_id, score, channels, pinned, pos): the top_k candidates of each query among first versions.

    docs: doc_id, text, embedding, case_numbers, tax_ids, published_at, canonical_of. queries: query_id, identity, support (array),
    case_numbers, tax_ids; what tells a query's event and what supports it are channels apart, so that many supporting names
    cannot outvote the identity. query_vectors: query_id, channel, embedding. Documents hit by an identifier come first, all of
    them, and have no vote for it.
    """
    base = docs.filter("canonical_of is null")
    words = lambda c: queries.select("query_id", c.alias("text")).filter(F.trim("text") != "")
    support = F.array_join(F.coalesce("support", F.array().cast("array<string>")), " ")
    channels = None
    for name, rows in (("identity", words(F.col("identity"))), ("support", words(support))):
        got = keyword_channel(base, rows, per_channel).select("query_id", "doc_id", F.lit(name).alias("channel"), "pos")
        channels = got if channels is None else channels.unionByName(got)
    if query_vectors is not None:
        for r in query_vectors.select("channel").distinct().collect():  # the names of the channels, two at most
            rows = query_vectors.filter(F.col("channel") == r["channel"])
            got = vector_channel(base, rows, per_channel).select("query_id", "doc_id", F.lit(r["channel"]).alias("channel"), "pos")
            channels = channels.unionByName(got)
    pins = identifier_channel(base, queries).select("query_id", "doc_id", F.col("pos").alias("pin"))
    both = fuse(channels).join(pins, ["query_id", "doc_id"], "full_outer")
    own = F.create_map(F.lit("identifier"), F.col("pin"))
    all_ = F.when(F.col("pin").isNull(), F.col("channels")).when(F.col("channels").isNull(), own).otherwise(F.map_concat("channels", own))
    rows = both.select("query_id", "doc_id", F.coalesce("score", F.lit(0.0)).alias("score"), all_.alias("channels"), F.col("pin").isNotNull().alias("pinned"))
    w = Window.partitionBy("query_id")
    placed = rows.withColumn("pos", F.row_number().over(w.orderBy(F.desc("pinned"), F.desc("score"), "doc_id"))).withColumn("n", F.sum(F.col("pinned").cast("int")).over(w))
    return placed.filter(F.col("pos") <= F.greatest(F.lit(top_k), F.col("n"))).drop("n")


def channel_names(channels: Column) -> Column:
    return F.array_join(F.array_sort(F.map_keys(channels)), "+")


def event_queries(events: DataFrame, docs: DataFrame, max_share: float = 0.015) -> DataFrame:
    """(event_id, identity, support) of rows (event_id, title, core_terms) against first versions (doc_id, text).

    The title without its suffix tells the event, however frequent it is. Of the core terms go those that are anonymised, too
    short, the identity itself, or in more than max_share of the documents, all tokens of a term counting together; the
    others stay in their order, once each.
    """
    named = events.select("event_id", tx.title_term(F.col("title")).alias("identity"), F.posexplode_outer("core_terms").alias("at", "term"))
    fit = F.col("term").isNotNull() & ~tx.is_generic_term(F.col("term")) & (F.col("term") != F.col("identity"))
    n = max(1, docs.count())
    asked = named.filter(fit).select(F.col("term").alias("query_id"), F.col("term").alias("text")).distinct()
    common = keyword_matches(docs, asked, all_terms=True).groupBy("query_id").agg(F.count(F.lit(1)).alias("df")).filter(F.col("df") > max_share * n).select(F.col("query_id").alias("term"), F.lit(True).alias("common"))
    kept = named.join(common, "term", "left").withColumn("kept", fit & F.col("common").isNull())
    once = kept.groupBy("event_id", "identity", F.when(F.col("kept"), F.col("term")).alias("term")).agg(F.min("at").alias("at"))
    support = F.transform(F.filter(F.sort_array(F.collect_list(F.struct("at", "term"))), lambda x: x["term"].isNotNull()), lambda x: x["term"])
    return once.groupBy("event_id", "identity").agg(support.alias("support"))
