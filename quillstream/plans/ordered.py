"""Queries whose rows carry a place or a running total over the whole table; the oracle's window is one task's work, ours is not."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillstream.operators.ranking import running_total, with_position
from quillstream.plans.registry import QUERIES, Query, frame, oracle, read
from quillstream.plans.relational import DOCS, LEDGER


def _placed(name: str, source: str, columns: str, sql_order: str, order) -> None:
    """Registers columns of source with their place in the order, given for both engines."""

    def run(spark, sf_dir):
        return with_position(frame(spark, sf_dir, f"select {columns} from {source}"), *order())

    QUERIES[name] = Query(run, oracle(f"select {columns}, cast(row_number() over (order by {sql_order}) as int) as pos from {source}"))


_placed("A1_base_scan", DOCS, "doc_id, source, published, fetched", "published desc nulls last, fetched desc, doc_id", lambda: (F.desc_nulls_last("published"), F.desc("fetched"), F.asc("doc_id")))
_placed("T1_desc_nulls_last", DOCS, "doc_id, published", "published desc nulls last, doc_id", lambda: (F.desc_nulls_last("published"), F.asc("doc_id")))
_placed("T2_desc_nulls_first", DOCS, "doc_id, published", "published desc nulls first, doc_id", lambda: (F.desc_nulls_first("published"), F.asc("doc_id")))
_placed("T3_asc_nulls_last", DOCS, "doc_id, published", "published asc nulls last, doc_id", lambda: (F.asc_nulls_last("published"), F.asc("doc_id")))
STATE = "case o_orderstatus when 'P' then 0 when 'O' then 1 else 2 end"
_placed("T8_case_order", "{orders}", f"o_orderkey, {STATE} as state", f"{STATE}, o_orderkey", lambda: (F.asc("state"), F.asc("o_orderkey")))


def j15(spark, sf_dir):
    """Labels of good documents with the document's place by length; labels without a document have none."""
    ranks = with_position(read(spark, sf_dir, "documents").select("doc_id", "n_chars"), F.desc("n_chars"), F.asc("doc_id")).select("doc_id", "pos")
    return read(spark, sf_dir, "labels").filter("quality = 1").select("doc_id").join(ranks, "doc_id", "left")


QUERIES["J15_label_join"] = Query(j15, oracle("select l.doc_id, d.pos from {labels} l left join (select doc_id, row_number() over (order by n_chars desc, doc_id) as pos from {documents}) d on l.doc_id = d.doc_id where l.quality = 1"))


def t5(spark, sf_dir):
    """The first 100 with the pinned ones ahead, and all pinned ones however many."""
    vectors = read(spark, sf_dir, "embeddings").select("vec_id", F.when(F.col("label") == 0, 0).otherwise(1).alias("rest"))
    pinned = vectors.filter("rest = 0").count()
    return with_position(vectors, F.asc("rest"), F.asc("vec_id")).filter(F.col("pos") <= max(100, pinned)).select("vec_id", "pos")


QUERIES["T5_topk_pinned"] = Query(t5, oracle("select vec_id, pos from (select vec_id, row_number() over (order by case when label = 0 then 0 else 1 end, vec_id) as pos, sum(case when label = 0 then 1 else 0 end) over () as pinned from {embeddings}) x where pos <= greatest(100, pinned)"))


def w4(spark, sf_dir):
    """Each grant with the sum of all granted up to its moment."""
    grants = frame(spark, sf_dir, f"select event_id, ts, cost from {LEDGER} where event_type = 'purchase'")
    return running_total(grants, "ts", "cost", "granted").select("event_id", F.col("granted").cast("decimal(20,4)").alias("granted"))


QUERIES["W4_running_grants"] = Query(w4, oracle(f"select event_id, cast(sum(cost) over (order by ts range between unbounded preceding and current row) as decimal(20,4)) as granted from {LEDGER} where event_type = 'purchase'"))
