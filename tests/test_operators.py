"""Composite operators against brute force and literal cases."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillstream.operators import clustering, near_duplicates, ranking, tables


def greedy(docs, threshold=0.7, hours=72):
    """The linking, one document at a time."""
    sets = {i: set(t.split()) for i, t, _ in docs}
    at, linked = {i: a for i, _, a in docs}, {}
    for i in sorted(at, key=lambda k: (at[k], k)):
        if len(sets[i]) < 40:
            continue
        best = None
        for j in sorted(at, key=lambda k: (at[k], k), reverse=True):
            if j != i and j not in linked and len(sets[j]) >= 40 and abs(at[i] - at[j]) <= dt.timedelta(hours=hours):
                s = len(sets[i] & sets[j]) / len(sets[i] | sets[j])
                if s >= threshold and (best is None or s > best[1]):
                    best = (j, s)
        if best and (at[best[0]], best[0]) < (at[i], i):
            linked[i] = best
    return linked


def test_near_duplicate_links(spark):
    rng, docs = random.Random(5), []
    bases = [[f"w{rng.randrange(400)}" for _ in range(70)] for _ in range(4)]
    for i in range(90):
        words = list(rng.choice(bases))
        for _ in range(rng.choice([0, 0, 3, 6, 10])):
            words[rng.randrange(len(words))] = f"x{rng.randrange(30)}"
        docs.append((i, " ".join(words[: rng.choice([70, 70, 70, 30])]), dt.datetime(2024, 1, 1) + dt.timedelta(hours=rng.randrange(400))))
    df = spark.createDataFrame([*docs, (900, None, dt.datetime(2024, 1, 1)), (901, docs[0][1], None)], "doc_id long, text string, at timestamp")
    got = {r["doc_id"]: (r["canonical_of"], round(r["score"] or 0, 9)) for r in near_duplicates.link_near_duplicates(df).collect()}
    want = {k: (v[0], round(v[1], 9)) for k, v in greedy(docs).items()}
    assert len(got) == 92 and len(want) > 10
    assert {k: v for k, v in got.items() if v[0] is not None} == want


def blob(rng, n, centre, spread=0.01):
    x = rng.normal(size=(n, 16)) * spread + centre
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def test_clusters():
    rng = np.random.default_rng(3)
    a, b = np.eye(16)[0], np.eye(16)[1]
    two = clustering.hdbscan(np.vstack([blob(rng, 8, a), blob(rng, 8, b)]))
    assert set(two[:8]) == {0} or set(two[:8]) == {1}
    assert len(set(two)) == 2 and -1 not in two
    alone = clustering.hdbscan(np.vstack([blob(rng, 8, a), blob(rng, 5, np.zeros(16), 1.0)]))
    assert set(alone) == {-1}
    assert set(clustering.hdbscan(blob(rng, 3, a))) == {-1} and len(clustering.hdbscan(np.zeros((0, 4)))) == 0
    same = clustering.hdbscan(np.vstack([np.repeat([a], 6, 0), np.repeat([b], 6, 0)]))
    assert len(set(same)) == 2 and -1 not in same


def test_detect_events(spark):
    rng = np.random.default_rng(4)
    x = np.vstack([blob(rng, 8, np.eye(16)[0]), blob(rng, 8, np.eye(16)[1]), blob(rng, 6, np.eye(16)[2])])
    rows = [(i, f"t{i}", dt.datetime(2024, 1, 20 - i) if i else None, x[i].tolist(), True, i != 21, None) for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, title string, published_at timestamp, embedding array<double>, relevant boolean, corroborated boolean, canonical_of long")
    found = clustering.detect_events(df, spark.createDataFrame([(16,)], "doc_id long")).orderBy("title").collect()
    assert sorted(tuple(r["doc_ids"]) for r in found) == [tuple(range(8)), tuple(range(8, 16))]
    assert {r["title"] for r in found} == {"t7", "t15"}
    with pytest.raises(ValueError):
        clustering.cluster_vectors(df, max_vectors=5)


def test_positions(spark):
    df = spark.range(1000).select(((F.col("id") * 7919) % 1000).alias("k"), (F.col("id") % 5).alias("g"))
    got = ranking.with_position(df, F.asc("k")).orderBy("k").collect()
    assert [r["pos"] for r in got] == list(range(1, 1001))
    assert ranking.with_position(df.filter("k < 0"), F.asc("k")).count() == 0
    run = {r["g"]: r["total"] for r in ranking.running_total(df.withColumn("one", F.lit(1)), "g", "one").collect()}
    assert run == {0: 200, 1: 400, 2: 600, 3: 800, 4: 1000}


def test_write_rules(spark):
    old = spark.createDataFrame([("a", "A", "x", True), ("b", "B", "y", False)], "url string, title string, body string, enabled boolean")
    new = spark.createDataFrame([(0, "a", "A2", "", False), (1, "a", None, "x2", False), (2, "c", "C", None, True), (3, "", "E", "e", True), (4, None, "F", "f", True)], "pos int, url string, title string, body string, enabled boolean")
    got = {r["url"]: tuple(r)[1:] for r in tables.upsert(old, new, create_only=("enabled",)).collect()}
    assert got == {"a": ("A2", "x2", True, "updated"), "b": ("B", "y", False, "kept"), "c": ("C", None, True, "created")}
    assert [r["title"] for r in tables.insert_ignore(old, new).orderBy("title").collect()] == ["C", "E"]
    changed = tables.changed(old, spark.createDataFrame([("a", "A", "x", None), ("b", "B", "y", False), ("d", None, None, None)], old.schema), "url")
    assert {r["url"] for r in changed.collect()} == {"a", "d"}
    rows = spark.createDataFrame([(1, None), (2, "t0")], "id long, deleted_at string")
    ids = spark.createDataFrame([(1,), (2,), (2,)], "id long")
    assert {tuple(r) for r in tables.trash(rows, ids, "id", F.lit("t1")).collect()} == {(1, "t1"), (2, "t0")}
    assert {tuple(r) for r in tables.restore(rows, ids, "id").collect()} == {(1, None), (2, None)}
    assert {tuple(r) for r in tables.delete_forever(rows, ids, "id").collect()} == {(1, None)}
