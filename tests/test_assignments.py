"""G25 counts every key, as Counter.most_common() does without a number."""

from collections import Counter

from quillstream.plans.registry import QUERIES


def test_every_key_is_counted(spark, sf):
    want = Counter(r.o_custkey for r in spark.read.parquet(f"{sf}/orders.parquet").select("o_custkey").collect())
    got = [(r.o_custkey, r.n) for r in QUERIES["G25_assignments"].run(spark, sf).collect()]
    assert len(want) > 50 and got == sorted(want.items(), key=lambda x: (-x[1], x[0]))
