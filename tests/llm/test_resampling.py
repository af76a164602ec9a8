"""Importance resampling against plain Python, and the ring against runs spelt out."""

import hashlib
import math
import random
import re
from collections import Counter
from zlib import crc32

from quillstream.llm import resampling

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def runs(text, n):
    w = words(text)
    return [crc32(" ".join(w[i : i + k]).encode()) for i in range(len(w)) for k in range(1, n + 1) if i + k <= len(w)]


def brute(docs, target, n, m, percent, least):
    doc = [Counter(c % m for c in runs(t, n)) for _, t in docs]
    s, t = sum(doc, Counter()), sum((Counter(c % m for c in runs(x, n)) for x in target), Counter())
    S, T = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (S + m) / ((s[b] + 1) * (T + m))))
    out = []
    for (i, text), c in zip(docs, doc):
        count = sum(c.values())
        weight = sum(gain(b) * k for b, k in c.items()) // count if count else 0
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, count, weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    fit = [k for k, (_, text) in enumerate(docs) if len(words(text)) >= least]
    order = sorted(fit, key=lambda k: (-out[k][3], out[k][0] is None, out[k][0] or 0))
    rank = {k: r + 1 for r, k in enumerate(order[: len(fit) * percent // 100])}
    return [(*row, rank.get(k)) for k, row in enumerate(out)]


def test_ring_gives_all_runs_whatever_the_lots():
    rng = random.Random(1)
    for _ in range(60):
        text = "".join(rng.choice("abXYZ09 .,-éß漢\n") for _ in range(rng.randint(0, 300)))
        for n in (1, 2, 3, 5):
            for lot in (1, 7, 1 << 16):
                count, crc = resampling.features(text, n, lot)
                assert count == len(words(text)) and Counter(crc.tolist()) == Counter(runs(text, n))


def test_against_brute_force(spark):
    rng = random.Random(2)
    vocabulary = [f"w{k}" for k in range(60)] + ["Straße", "漢字", "X1"]
    text = lambda k: " ".join(rng.choice(vocabulary) for _ in range(k))
    docs = [(i, text(rng.randint(0, 60))) for i in range(80)] + [(200, None), (201, ""), (None, text(30)), (202, "one " * 5000)]
    target = [text(40) for _ in range(3)] + [None]
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as weight", "'x' as id")
    items = spark.createDataFrame([(t,) for t in target], "text string")
    for n, m in ((1, 50), (3, 1000)):
        got = resampling.resample(df, items, n=n, buckets=m, percent=25).collect()
        assert sorted(map(tuple, got), key=repr) == sorted(brute(docs, target, n, m, 25, 20), key=repr)


def test_ties_and_empty_tables(spark):
    same = [(7, "a b c d e f g h i j k l m n o p q r s t u")] * 10
    df = spark.createDataFrame(same, "doc_id long, text string")
    none = spark.createDataFrame([], "text string")
    got = resampling.resample(df, none, percent=30).collect()
    assert len({(r.n_features, r.weight, r.score) for r in got}) == 1 and sorted(r["rank"] for r in got if r["rank"]) == [1, 2, 3]
    assert resampling.resample(df.filter("doc_id < 0"), none).count() == 0
