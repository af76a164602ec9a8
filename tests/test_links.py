"""Streamed links equal the batch's, in any order within the delay, and the state lets go of what is past."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from quillstream.operators.near_duplicates import link_near_duplicates
from quillstream.streaming import links, versions

HOUR = dt.timedelta(hours=1)


def made(seed, n):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    seeds, out = [[word() for _ in range(60)] for _ in range(5)], []
    for i in range(n):
        w = list(rng.choice(seeds))
        for _ in range(rng.choice([0, 0, 2, 5, 8, 14])):
            w[rng.randrange(len(w))] = word()
        out.append((i, " ".join(w if rng.random() < 0.9 else w[:10]), dt.datetime(2024, 1, 1) + rng.randrange(0, 500) * HOUR if i % 17 else None))
    return out


@pytest.mark.parametrize("frequencies", [True, False])
def test_any_order_within_the_delay(spark, tmp_path, frequencies):
    rng = random.Random(3)
    rows = made(1, 90)
    schema = "doc_id long, text string, at timestamp"
    whole = spark.createDataFrame(rows, schema)
    want = {r.doc_id: (r.canonical_of, r.score) for r in link_near_duplicates(whole, hours=24).collect()}
    assert sum(c is not None for c, _ in want.values()) > 10
    late = sorted(rows, key=lambda r: (r[2] or dt.datetime(2024, 1, 3)) + rng.randrange(0, 30) * HOUR)
    known = whole.select(F.explode(F.array_distinct(F.split("text", " "))).alias("token")).groupBy("token").agg(F.count("*").alias("df")) if frequencies else None
    kept = []
    for k in range(4):
        spark.createDataFrame(late[k * 23 : (k + 1) * 23], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        own = links.Links(spark, str(tmp_path / "links"), known, hours=24, delay_hours=30)
        out = own.run(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), finish=k == 3)
        kept.append(versions.current(spark, str(tmp_path / "links/docs"), links.DOCS).count())
    got = {r.doc_id: (r.canonical_of, r.score) for r in out.collect()}
    assert got == want and out.count() == len(rows) and "late" not in {r.state for r in out.collect()}
    assert max(kept) < 60 and kept[-1] == 0


def test_late_rows_are_told_and_a_batch_runs_twice(spark, tmp_path):
    text = " ".join(f"w{i}" for i in range(60))
    rows = lambda *x: spark.createDataFrame([(i, text, dt.datetime(2024, 1, 1) + h * HOUR) for i, h in x], "doc_id long, text string, at timestamp")
    own = links.Links(spark, str(tmp_path), hours=24, delay_hours=10)
    own.take(rows((1, 0), (2, 5)), 0)
    own.take(rows((3, 200), (4, 203)), 1)
    own.take(rows((3, 200), (4, 203)), 1)
    own.take(rows((5, 100)), 2)
    own.take(rows(), 3, last=True)
    got = sorted((r.doc_id, r.canonical_of, r.state) for r in spark.read.schema(links.OUT).parquet(f"{tmp_path}/links").collect())
    # the last copy in reach links to the one before it, as in the batch
    assert got == [(1, None, "settled"), (2, 1, "settled"), (3, None, "settled"), (4, 3, "settled"), (5, None, "late")]
