"""Fingerprints, judges' replies, core terms, grounding, leaks, slugs, checks and prices on literal rows."""

import hashlib

import pytest
from pyspark.sql import functions as F

from quillstream.functions import fingerprint, pricing
from quillstream.operators import assignment, evaluation, search
from quillstream.sources import articles


def test_simhash_by_brute_force(spark):
    texts = ["檢察官起訴書 起訴", "one two two three", "", None, "a", "同一篇報導 同一篇報導 以及 more words"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    tokens = {r.doc_id: r.t for r in df.select("doc_id", F.expr("1").alias("x")).join(df, "doc_id").select("doc_id", fingerprint.tx.tokenize(F.coalesce("text", F.lit(""))).alias("t")).collect()}
    for r in fingerprint.with_simhash(df, "doc_id", "text").collect():
        want = 0
        for bit in range(64):
            total = sum(1 if int.from_bytes(hashlib.blake2b(t.encode(), digest_size=8).digest(), "big") >> bit & 1 else -1 for t in tokens[r.doc_id])
            want |= (total > 0) << bit
        assert r.simhash % (1 << 64) == want


def test_query_expression(spark):
    df = spark.createDataFrame([("檢察官",), ("起訴",), ("",), ("Abc 起訴!",)], "q string")
    assert [r[0] for r in df.select(fingerprint.query_expression(F.col("q"))).collect()] == ["檢察 & 察官", "起訴", "", "abc & 起訴"]


def test_fusion_of_rankings(spark):
    rows = [(1, d, c, p) for c, ids in (("keyword", [10, 20, 30]), ("vector", [20, 40, 50])) for p, d in enumerate(ids, 1)]
    got = search.fuse(spark.createDataFrame(rows, "query_id long, doc_id long, channel string, pos int")).orderBy(F.desc("score"), "doc_id").collect()
    assert got[0].doc_id == 20 and got[0].channels == {"keyword": 2, "vector": 1} and got[0].score == round(1 / 62 + 1 / 61, 9)


def test_pinned_hits_come_first_and_all(spark):
    docs = spark.createDataFrame([(i, "alpha beta" if i < 3 else "other", ["c1"] if i >= 8 else [], [], None, None) for i in range(12)], "doc_id long, text string, case_numbers array<string>, tax_ids array<string>, published_at timestamp, canonical_of long")
    queries = spark.createDataFrame([(1, "alpha", ["beta"], ["c1"], [])], "query_id long, identity string, support array<string>, case_numbers array<string>, tax_ids array<string>")
    got = search.hybrid_search(docs, queries, None, top_k=2).orderBy("pos").collect()
    assert [r.doc_id for r in got] == [8, 9, 10, 11] and all(r.pinned for r in got)
    assert [r.doc_id for r in search.hybrid_search(docs, queries, None, top_k=6).orderBy("pos").collect()] == [8, 9, 10, 11, 0, 1]


def test_replies_that_are_cut_or_no_json_count_for_nothing(spark):
    good = '{"assignments": [{"doc_id": 1, "belongs": true, "reason": "r"}, {"doc_id": 2, "belongs": false}]}'
    rows = [(1, 0, "stop", good), (1, 1, "length", good.replace("1,", "3,")), (1, 2, "stop", "{no"), (2, 0, "stop", "{}")]
    got = assignment.accepted(spark.createDataFrame(rows, "event_id long, batch int, finish_reason string, content string")).collect()
    assert [tuple(r) for r in got] == [(1, 1, "r")]


def test_core_terms(spark):
    rows = [(1, d, "persons", n) for d, n in ((1, "柯文哲"), (2, "柯文哲"), (1, "甲"), (2, "甲"), (1, "single one"), (1, "x" * 13), (2, "x" * 13))]
    rows += [(1, d, "agencies", "y" * 16) for d in (1, 2, 3)]
    got = evaluation.core_terms(spark.createDataFrame(rows, "event_id long, doc_id long, kind string, name string")).head()
    assert got.terms == ["y" * 16, "柯文哲"]


def test_grounding(spark):
    rows = [(1, ["柯 文 哲", "113年度金訴字第51號", "無此人", " "], "被告柯文哲，案號１１３年度 金訴字第 51 號")]
    got = evaluation.grounding(spark.createDataFrame(rows, "id long, values array<string>, source_text string")).head()
    assert (got.checked, got.grounded, got.ungrounded) == (3, 2, ["無此人"])


def test_leaks(spark):
    body = "字" * 150 + "abc" * 40
    payloads = spark.createDataFrame([(1, "x" * 700 + body + "y"), (2, body[:-1]), (3, "short"), (4, None)], "payload_id long, payload string")
    corpus = spark.createDataFrame([(7, body), (8, "y" * 10), (9, None)], "doc_id long, body string")
    assert [tuple(r) for r in evaluation.leaks(payloads, corpus).collect()] == [(1, 7)]


def test_slugs(spark):
    wanted = spark.createDataFrame([(i, "a") for i in range(4)] + [(9, "b")], "id long, base string")
    taken = spark.createDataFrame([("a",), ("a-3",), ("a-x",)], "slug string")
    assert {r.id: r.slug for r in evaluation.unique_slugs(wanted, taken).collect()} == {0: "a-2", 1: "a-4", 2: "a-5", 3: "a-6", 9: "b"}


def test_judgments_wake_dormant_events(spark):
    judgments = spark.createDataFrame([(1, ["c1"], "2024-03-01 00:00:00"), (2, ["c2"], "2024-01-01 00:00:00"), (3, ["c1", "c2"], "2024-02-01 00:00:00")], "doc_id long, case_numbers array<string>, published_at string")
    known = spark.createDataFrame([(1, ["c1"], "dormant", "2024-02-01 00:00:00"), (2, ["c2"], "active", "2024-02-01 00:00:00"), (3, ["c1"], "closed", None)], "event_id long, case_numbers array<string>, status string, last_progress_at string")
    links, changed = assignment.ingest_judgments(judgments, known)
    assert sorted(map(tuple, links.collect())) == [(1, 1), (2, 2)]
    assert sorted(map(tuple, changed.collect())) == [(1, "active", "2024-03-01 00:00:00", True), (2, "active", "2024-02-01 00:00:00", False)]


def test_costs(spark):
    df = spark.createDataFrame([("flash", "2026-08-31 02:00:00"), ("flash", "2026-08-31 12:00:00"), ("flash", "2026-08-29 02:00:00")], "m string, t string")
    cost = pricing.compute_cost(F.col("m"), F.lit(0), F.lit(1_000_000), F.lit(0), F.col("t").cast("timestamp_ntz"))
    assert [(float(r.c.usd), r.c.peak) for r in df.select(cost.alias("c")).collect()] == [(0.44, True), (0.22, False), (0.22, False)]
    with pytest.raises(Exception, match="no price for model"):
        spark.createDataFrame([("other", "2026-08-31 02:00:00")], df.schema).select(cost.alias("c")).collect()


def test_published_time_of_a_short_page(spark):
    pages = [(1, '<meta property="article:published_time" content="2024-03-05T09:30:00+08:00">short'), (2, '<script type="application/ld+json">{"@graph": [{"datePublished": "2024-03-05T01:30:00Z"}]}</script>'), (3, ""), (4, None)]
    got = {r.page_id: r.t for r in articles.published_times(spark.createDataFrame(pages, "page_id long, html string")).select("page_id", F.unix_timestamp("published_at").alias("t")).collect()}
    assert got == {1: 1709602200, 2: 1709602200, 3: None, 4: None}
