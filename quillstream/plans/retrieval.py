"""Keyword, vector and hybrid search, near-duplicate pairs and their measures, over all queries at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillstream.functions import text as tx
from quillstream.operators.near_duplicates import hashed_sets, parted, text_pairs
from quillstream.operators.search import RRF, fuse, keyword_channel, keyword_matches, postings, vector_channel
from quillstream.operators.vector_index import VectorIndex
from quillstream.plans.registry import frame_query, read

K = 20

_TOKENS = "select {id}, unnest([lower(x) for x in regexp_extract_all(text, '[A-Za-z0-9]+')]) as token from {t}"
_POSTINGS = "postings as (select doc_id, token, count(*) as tf from (" + _TOKENS.format(id="doc_id", t="documents") + ") x group by 1, 2)"
_QUERY = "query as (select distinct item_id, token from (" + _TOKENS.format(id="item_id", t="benchmark") + ") x)"
_KEYWORD = f"{_POSTINGS}, {_QUERY}, sizes as (select item_id, count(*) as m from query group by 1), matched as (select q.item_id, p.doc_id, count(*) as hits, sum(p.tf) as tf from query q join postings p using (token) group by 1, 2), scored as (select item_id, doc_id, cast(hits as bigint) as hits, cast(tf as bigint) as tf, round(cast(hits as double) / m, 6) as score from matched join sizes using (item_id)), keyword as (select * from (select *, row_number() over (partition by item_id order by score desc, tf desc, doc_id) as pos from scored) x where pos <= {K})"


@frame_query("J9_inverted_index_any", f"with {_KEYWORD} select item_id, doc_id, hits, tf, score, pos from keyword")
def j9(spark: SparkSession, d: str) -> DataFrame:
    return keyword_channel(read(spark, d, "documents"), read(spark, d, "benchmark"), K, "item_id")


@frame_query("J9_inverted_index_all", f"with {_KEYWORD} select item_id, doc_id, hits from scored join sizes using (item_id) where hits = m")
def j9_all(spark: SparkSession, d: str) -> DataFrame:
    return keyword_matches(read(spark, d, "documents"), read(spark, d, "benchmark"), all_terms=True, query_id="item_id").select("item_id", "doc_id", "hits")


@frame_query("G12_document_frequency", f"with {_POSTINGS} select token, count(*) as df, round(cast(count(*) as double) / greatest((select count(*) from documents), 1), 9) as share from postings group by token")
def g12(spark: SparkSession, d: str) -> DataFrame:
    docs = read(spark, d, "documents")
    n = max(1, docs.count())
    return postings(docs).groupBy("token").agg(F.count(F.lit(1)).alias("df")).withColumn("share", F.round(F.col("df").cast("double") / n, 9))


@frame_query("P24_candidate_terms", f"with {_POSTINGS}, {_QUERY} select item_id, token from query where length(token) >= 2 and token not in (select token from postings group by token having count(*) > 0.015 * (select count(*) from documents))")
def p24(spark: SparkSession, d: str) -> DataFrame:
    """Query terms without those that are too short or too frequent."""
    docs = read(spark, d, "documents")
    common = postings(docs).groupBy("token").agg(F.count(F.lit(1)).alias("df")).filter(F.col("df") > 0.015 * docs.count())
    q = postings(read(spark, d, "benchmark"), "item_id").filter(F.length("token") >= 2)
    return q.join(common, "token", "left_anti").select("item_id", "token")


@frame_query("H3_tokenize", "select doc_id, list_aggregate([lower(x) for x in regexp_extract_all(text, '[A-Za-z0-9]+')], 'string_agg', ' ') as tokens from documents")
def h3(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").select("doc_id", F.when(F.size(tx.tokenize(F.col("text"))) > 0, tx.search_text(F.col("text"))).alias("tokens"))


_VECTOR = f"vector as (select * from (select q.vec_id as item_id, e.vec_id as doc_id, round(list_cosine_similarity(cast(q.embedding as double[]), cast(e.embedding as double[])), 5) as score, row_number() over (partition by q.vec_id order by round(list_cosine_similarity(cast(q.embedding as double[]), cast(e.embedding as double[])), 5) desc, e.vec_id) as pos from embeddings q join embeddings e on q.vec_id % 100 = 0 and e.vec_id <> q.vec_id) x where pos <= {K})"


def own_vectors(spark: SparkSession, d: str) -> DataFrame:
    """The nearest of every vector whose id is divisible by 100, among all others."""
    vectors = read(spark, d, "embeddings")
    queries = vectors.filter(F.col("vec_id") % 100 == 0).select(F.col("vec_id").alias("item_id"), "embedding")
    return vector_channel(vectors, queries, K, "vec_id", "item_id", others_only=True)


@frame_query("J10_vector_knn", f"with {_VECTOR} select item_id, doc_id, score, pos from vector")
def j10(spark: SparkSession, d: str) -> DataFrame:
    return own_vectors(spark, d)


@frame_query("X3_vector_index", f"with {_VECTOR} select item_id, doc_id, score, pos from vector")
def x3(spark: SparkSession, d: str) -> DataFrame:
    """As J10, through the persisted index: its own cell gives each query a bound, which rules out cells."""
    index = VectorIndex.build(read(spark, d, "embeddings"), "vec_id", unit=True)
    v = F.col("embedding").cast("array<double>")
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    asked = read(spark, d, "embeddings").filter(F.col("vec_id") % 100 == 0).select(F.col("vec_id").alias("q"), v.alias("v"))
    asked = asked.withColumn("n", norm).filter("n > 0").select("q", F.transform("v", lambda x: x / F.col("n")).alias("v"))
    near = index.nearest(asked, K, others_only=True, digits=5).withColumn("score", F.round(1 - F.col("d") * F.col("d") / 2, 5))
    w = Window.partitionBy("q").orderBy(F.desc("score"), "id")
    placed = near.withColumn("pos", F.row_number().over(w)).filter(F.col("pos") <= K)
    return placed.select(F.col("q").alias("item_id"), F.col("id").alias("doc_id"), "score", "pos")


@frame_query("C1_hybrid_search", f"with {_KEYWORD}, {_VECTOR}, both_ as (select item_id, doc_id, 'keyword' as channel, pos from keyword union all select item_id, doc_id, 'vector' as channel, pos from vector), fused as (select item_id, doc_id, round(sum(cast(1 as double) / ({RRF} + pos)), 9) as fused, string_agg(channel, ',' order by channel) as channels from both_ group by 1, 2) select item_id, doc_id, fused, channels, pos from (select *, row_number() over (partition by item_id order by fused desc, doc_id) as pos from fused) x where pos <= {K}")
def c1(spark: SparkSession, d: str) -> DataFrame:
    """Keyword and vector channels of all benchmark items, fused; the item's own vector is its query."""
    kw = keyword_channel(read(spark, d, "documents"), read(spark, d, "benchmark"), K, "item_id").select("item_id", "doc_id", F.lit("keyword").alias("channel"), "pos")
    ve = own_vectors(spark, d).select("item_id", "doc_id", F.lit("vector").alias("channel"), "pos")
    w = Window.partitionBy("item_id").orderBy(F.desc("fused"), "doc_id")
    fused = fuse(kw.unionByName(ve), "item_id").select("item_id", "doc_id", F.col("score").alias("fused"), F.array_join(F.array_sort(F.map_keys("channels")), ",").alias("channels"))
    return fused.withColumn("pos", F.row_number().over(w)).filter(F.col("pos") <= K)


@frame_query("G13_recall", f"with {_KEYWORD}, ranked as (select k.item_id, k.pos, coalesce(l.quality, 0) as good from keyword k left join labels l using (doc_id)) select item_id, sum(case when pos <= 10 then good else 0 end)::bigint as hits_10, round(sum(case when pos <= 10 then good else 0 end) / 10.0::double, 6) as precision_10, round(coalesce(max(case when good = 1 then cast(1 as double) / pos end), 0), 6) as mrr from ranked group by item_id")
def g13(spark: SparkSession, d: str) -> DataFrame:
    r = keyword_channel(read(spark, d, "documents"), read(spark, d, "benchmark"), K, "item_id").join(read(spark, d, "labels"), "doc_id", "left").withColumn("good", F.coalesce("quality", F.lit(0)))
    hits = F.sum(F.when(F.col("pos") <= 10, F.col("good")).otherwise(0)).cast("long")
    return r.groupBy("item_id").agg(hits.alias("hits_10"), F.round(hits / F.lit(10.0), 6).alias("precision_10"), F.round(F.coalesce(F.max(F.when(F.col("good") == 1, 1.0 / F.col("pos"))), F.lit(0.0)), 6).alias("mrr"))


@frame_query("G15_contingency", "select label, cast(vec_id % 7 as int) as predicted, count(*) as n from embeddings group by 1, 2")
def g15(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "embeddings").groupBy("label", (F.col("vec_id") % 7).cast("int").alias("predicted")).agg(F.count(F.lit(1)).alias("n"))


_SETS = "sets as (select doc_id, list_distinct([lower(x) for x in regexp_extract_all(text, '[A-Za-z0-9]+')]) as s from documents), rare as (select doc_id, s, len(s) as n from sets where len(s) >= 40)"


@frame_query("J11_near_duplicates", f"with {_SETS} select a.doc_id as left_id, b.doc_id as right_id, round(len(list_intersect(a.s, b.s))::double / (a.n + b.n - len(list_intersect(a.s, b.s))), 6) as jaccard from rare a join rare b on a.doc_id > b.doc_id and (a.doc_id % 720) - (b.doc_id % 720) between -72 and 72 where least(a.n, b.n) >= 0.7 * greatest(a.n, b.n) and len(list_intersect(a.s, b.s))::double / (a.n + b.n - len(list_intersect(a.s, b.s))) >= 0.7")
def j11(spark: SparkSession, d: str) -> DataFrame:
    """Token-set Jaccard of 0.7 and more within 72 hours. Different sets are compared once each; their documents are paired after."""
    docs = hashed_sets(read(spark, d, "documents").select("doc_id", (F.col("doc_id") % 720).alias("at"), "text"))
    sized, sets = parted(docs.filter(F.size("s") >= 40).withColumn("band", F.floor(F.col("at") / 73)))
    scored = text_pairs(sets, sized.select("key", "band").distinct(), 0.7).filter("key < other")
    own = sized.select("key", F.col("key").alias("other"), F.lit(1.0).alias("score")).distinct()
    # bands of neighbours only: a group of copies is cut by time before its documents are paired
    left = sized.select("key", F.col("doc_id").alias("x"), F.col("at").alias("x_at"), F.explode(F.array(F.col("band") - 1, "band", F.col("band") + 1)).alias("band"))
    right = sized.select(F.col("key").alias("other"), F.col("doc_id").alias("y"), F.col("at").alias("y_at"), "band")
    pairs = left.join(scored.unionByName(own), "key").join(right, ["other", "band"]).filter(F.abs(F.col("x_at") - F.col("y_at")) <= 72)
    pairs = pairs.filter((F.col("key") != F.col("other")) | (F.col("x") > F.col("y")))
    return pairs.select(F.greatest("x", "y").alias("left_id"), F.least("x", "y").alias("right_id"), F.round("score", 6).alias("jaccard"))


_TRACKED = ", ".join(f"'{t}'" for t in tx.TRACKING)


@frame_query("H21_normalize_url", f"select page_id, base || case when kept = '' then '' else '?' || kept end as url from (select page_id, split_part(bare, '?', 1) as base, array_to_string(list_filter(string_split(case when contains(bare, '?') then substr(bare, instr(bare, '?') + 1) else '' end, '&'), lambda x: x <> '' and lower(split_part(x, '=', 1)) not in ({_TRACKED})), '&') as kept from (select page_id, split_part(url, '#', 1) as bare from pages) a) b")
def h21(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "pages").select("page_id", tx.normalize_url(F.col("url")).alias("url"))


@frame_query("A7_json_props", "select event_id, cast(json_extract(props, '$.k') as bigint) as k from events")
def a7(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))
