"""What only shows on larger tables or rarer values, made small."""

import datetime as dt
import random
import re
from collections import Counter

import duckdb
import pyarrow as pa
from pyspark.sql import functions as F

from quillstream.functions import fingerprint, ident
from quillstream.operators import evaluation, search
from quillstream.operators import near_duplicates as nd
from quillstream.plans.registry import QUERIES


def test_signs_of_keys_beyond_a_long(spark, tmp_path):
    keys = [0, 1, 7_000_000, 7_470_000, 7_500_000, 35_549_999, 2**62]
    spark.createDataFrame([(k,) for k in keys], "o_orderkey long").write.parquet(str(tmp_path / "orders.parquet"))
    got = {r.o_orderkey: (int(r.as_unsigned), r.back) for r in QUERIES["H10_signs"].run(spark, str(tmp_path)).collect()}
    want = {s: s * 1234567890123 % 2**64 for k in keys for s in {k, -k}}
    assert got == {s: (u, u - 2**64 if u >= 2**63 else u) for s, u in want.items()}


def test_all_documents_that_share_an_identifier_are_pinned(spark):
    schema = "doc_id long, text string, embedding array<float>, case_numbers array<string>, tax_ids array<string>, published_at timestamp, canonical_of long"
    docs = spark.createDataFrame([(i, f"word{i} alpha", None, ["c-1"] if i < 5 else [], [], None, None) for i in range(8)], schema)
    asked = spark.createDataFrame([(1, "alpha", [], ["c-1"], [])], "query_id long, identity string, support array<string>, case_numbers array<string>, tax_ids array<string>")
    got = search.hybrid_search(docs, asked, top_k=2, per_channel=2).filter("pinned").collect()
    assert sorted(r.doc_id for r in got) == [0, 1, 2, 3, 4]


def test_case_numbers_of_many_digits(spark):
    cases = [("99年度金訴字第01234567號", "99年度金訴字第1234567號"), ("99年度金訴字第35549999號", "99年度金訴字第35549999號"), ("99年度金訴字第000號", "99年度金訴字第0號")]
    df = spark.createDataFrame([(x,) for x, _ in cases], "x string").select(ident.normalize_case_number(F.col("x")).alias("got"))
    assert [r.got for r in df.collect()] == [want for _, want in cases]


def test_titles_of_one_character(spark, tmp_path):
    spark.createDataFrame([(1, "A edonnt estiin"), (2, "by eran hewhsh"), (3, "Ré eaure de")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([(i, f"w{i} de", "src1") for i in range(9)], "doc_id long, text string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    for t in ("benchmark", "documents"):
        con.sql(f"create view {t} as select * from '{tmp_path}/{t}.parquet/*.parquet'")
    got = QUERIES["P24_event_queries"].run(spark, str(tmp_path)).select("event_id", "identity", "support")
    assert sorted(map(tuple, got.collect())) == sorted(con.sql(QUERIES["P24_event_queries"].sql).select("event_id, identity, support").fetchall())


def test_simhash_of_texts_split_by_bytes(spark):
    """Only texts with CJK or full-width characters have tokens of Spark's; words keep to their texts, also at the edges of lots."""
    odd = [None, "", "end", "start x", "   ", "é-É", "word " * 700, "檢 a b A", "ＡＢ c1", "y x-Z9", "9", "a" * 3000]
    rows = [(i, odd[i % len(odd)] if i % 5 else f"Text {i} of-many {i % 7}") for i in range(2100)]
    df = spark.createDataFrame(rows, "i long, text string").coalesce(1)

    def want(text):
        text = "".join(chr(ord(c) - 0xFEE0) if "\uff01" <= c <= "\uff5e" else c for c in text or "")
        counts = Counter(re.findall("[a-z0-9]+|檢", re.sub("[A-Z]", lambda m: m[0].lower(), text)))
        got = sum((sum(n for w, n in counts.items() if fingerprint.feature_hash(w) >> b & 1) * 2 > sum(counts.values())) << b for b in range(64))
        return got - (1 << 64) if got >> 63 else got

    known = {text: want(text) for _, text in rows}
    simhash = fingerprint.with_simhash(df, "i", "text")
    assert {r.i: r.simhash for r in simhash.collect()} == {i: known[text] for i, text in rows}
    assert [len(w) for w in fingerprint.plain_tokens(pa.array(["x", None, "a b", "ab", "", "c-d-e"]).slice(1))] == [6, 5]


def test_payloads_tell_few_grams_and_find_all_bodies(spark):
    rng = random.Random(5)
    prose = lambda n: "".join(rng.choice("abc dé字") for _ in range(n))
    head = prose(250)
    corpus = [(i, (head if i < 6 else "") + prose(rng.choice([201, 260, 900]))) for i in range(12)] + [(12, head + "q"), (13, "a" * 300)]
    payloads = [(k, prose(rng.randrange(300)) + "".join(corpus[i][1] for i in own) + prose(rng.randrange(90))) for k, own in enumerate([(0,), (1, 7), (), (8, 9, 10, 11), (2,), (13,), (12,)])] * 2
    got = evaluation.leaks(spark.createDataFrame(payloads, "payload_id long, payload string"), spark.createDataFrame(corpus, "doc_id long, body string"))
    assert sorted(map(tuple, got.collect())) == sorted((k, i) for k, p in payloads for i, b in corpus if b in p and len(b) > 200)
    long_ = pa.array([prose(1_500_000), prose(60), prose(40_000)])
    rows, hashes = evaluation._least_hashes(long_, False)
    assert set(rows) == {0, 2} and len(hashes) < sum(len(x.as_py().encode()) for x in long_) / 40


def test_label_set_ranks_ids_alone(spark):
    at = dt.datetime(2024, 1, 1)
    docs = spark.createDataFrame([(i, f"alpha {i}" if i % 3 else "none", f"alpha beta {i} " * (i % 4 + 1), at + dt.timedelta(hours=i % 7)) for i in range(60)] + [(5, "alpha 5", "alpha beta 5 alpha beta 5 ", at)] * 2, "doc_id long, title string, body string, published_at timestamp")
    events = spark.createDataFrame([(1, "alpha", ["beta"]), (2, "alpha", ["zeta"]), (3, "nowhere", [])], "event_id long, keyword string, corroborators array<string>")
    got = evaluation.label_set(docs, events, 2)
    newest = sorted(docs.collect(), key=lambda r: (-r.published_at.timestamp(), r.doc_id))[:8]
    level = lambda r, beta: (0 if "alpha" in r.title and beta else 1 if "alpha" in r.title or (beta and r.body.count("alpha") >= 3) else 2, -r.body.count("alpha"))
    want = {(e, r.doc_id, k + 1) for e, beta in ((1, True), (2, False)) for k, r in enumerate(sorted(newest, key=lambda r: level(r, beta))[:2])}
    assert {(r.event_id, r.doc_id, r.pos) for r in got.collect()} == want


def test_sets_meet_on_several_rare_tokens(spark):
    """All pairs within reach by brute force, and texts that share but one or two rare tokens never meet."""
    rng = random.Random(7)
    base = [[f"w{rng.randrange(4000)}" for _ in range(rng.choice([40, 60, 150]))] for _ in range(12)]
    texts = [[w if rng.random() > rng.choice([0.02, 0.1, 0.16, 0.2]) else f"x{rng.randrange(9000)}" for w in base[i % 12]] for i in range(140)] + [["檢", "rare1"] + [f"y{k}x{j}" for j in range(45)] for k in range(30)]
    rows = [(i, " ".join(t).upper() if i % 2 else "，".join(t), rng.randrange(5)) for i, t in enumerate(texts)]
    sized, sets = nd.parted(nd.hashed_sets(spark.createDataFrame(rows, "i long, text string, band long")))
    key = {r.i: r.key for r in sized.collect()}
    got = {(r.key, r.other): r.score for r in nd.text_pairs(sets, sized.select("key", "band").distinct(), 0.7).collect()}
    words = {i: set(t) for i, t in enumerate(texts)}
    near = lambda i, j: len({*map(str.lower, words[i])} & {*map(str.lower, words[j])}) / len(words[i] | words[j])
    want = {(key[i], key[j]): near(i, j) for i, _, a in rows for j, _, b in rows if key[i] != key[j] and abs(a - b) <= 1 and near(i, j) >= 0.7}
    assert got == want and len(want) > 100
    placed = nd.rare_tokens(sets, nd.frequencies(sets), 0.7, whole=True).join(sized.select("key", "band").distinct(), "key")
    alone = {key[i] for i in range(140, 170)}
    assert not any(r.key in alone for r in nd.meetings(placed, placed, 0.7).collect())
