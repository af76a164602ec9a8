"""The cascade's order, its exact fallback, and columns that clash."""

import collections
import random

import pytest
from pyspark.sql import functions as F

from quillstream.llm import quality
from quillstream.llm.common import let


def test_exact_count_of_repeated_words(spark):
    r = random.Random(2)
    texts = [r.choices("abc", k=n) for n in (4, 5, 9, 40, 300)] + [["a"] * 3000]
    df = spark.createDataFrame([(i, w) for i, w in enumerate(texts)], "i long, w array<string>")
    got = {x.i: x.n for x in df.select("i", let(F.col("w"), lambda w: quality._exactly(w, F.size(w))).alias("n")).collect()}
    for i, w in enumerate(texts):
        tri = collections.Counter(zip(w, w[1:], w[2:]))
        assert got[i] == len({k + j for k in range(len(w) - 2) for j in range(3) if tri[tuple(w[k : k + 3])] > 1})


def test_rules_are_ordered_by_rejection_per_cost(spark):
    texts = ["x y z"] * 30 + [" ".join(f"word{i}" for i in range(80))] * 10
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = quality.rule_order(df)
    assert {r.name for r, _, _ in found} == {r.name for r in quality.RULES}
    assert found[0][0].name == "few_words" and found[0][2] == 0.75
    worth = [share / cost for _, cost, share in found]
    assert worth == sorted(worth, reverse=True)


def test_null_ids_and_clashing_columns(spark):
    good = " ".join(f"word{i}" for i in range(80))
    rows = [(None, good, "a", 1), (None, "short", "b", 2), (1, good, "c", 3), (1, None, "d", 4), (2, "word " * 80, "e", 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, rejected_by string, `_M` long")
    assert sorted(quality.filter_quality(df).collect(), key=repr) == sorted([r for r in map(tuple, rows) if r[3] in (1, 3)], key=repr)
    got = quality.measure_quality(df).collect()
    assert len(got) == 5 and sum(r.kept for r in got) == 2
    with pytest.raises(ValueError):
        quality.cascade(df, list(quality.RULES))
