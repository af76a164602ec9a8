"""The whole pipeline against plain Python on a small table."""

import collections
import random
import re

import numpy as np

import corpus_pipeline
from quillstream.llm import pii, quality, simhash
from quillstream.llm.tokens import encoder


def words(text):
    return re.findall(r"[^\x20\x09-\x0d]+", text or "")


def passes(text):
    w = words(text)
    tri = collections.Counter(zip(w, w[1:], w[2:]))
    covered = {i + k for i in range(len(w) - 2) for k in range(3) if tri[tuple(w[i : i + 3])] > 1}
    chars, symbols = sum(map(len, w)), sum(c in quality.SYMBOLS for c in text or "")
    lines = (text or "").split("\n")
    full = [x for x in lines if words(x)]
    repeated, capitals = len(full) - len(set(full)), sum(c in quality.CAPITALS for c in text or "")
    return not (len(w) < 50 or 100 * len(covered) > 50 * len(w) or 10 * symbols > 3 * len(w) or chars < 2 * len(w) or chars > 20 * len(w) or (repeated > 3 and 2 * repeated > len(lines)) or 2 * capitals > chars)


def shingles(text, pattern):
    w = [x for x in re.split(pattern, text.lower()) if x]
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) > 4 else ({tuple(w)} if w else set())


SPACE, NON_ALNUM = r"[\x20\x09-\x0d]+", r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def test_pipeline(spark, tmp_path):
    r = random.Random(5)
    prose = lambda n: " ".join("".join(r.choices(["ra", "ten", "lo", "mi", "ver", "con"], k=r.randint(1, 3))) for _ in range(n))
    base = [prose(r.randint(60, 150)) for _ in range(30)]
    near = [" ".join(w if r.random() > 0.01 else "other" for w in t.split()) for t in base[:12]]
    item = prose(20)
    texts = [*base, *near, base[3], base[3], "short one", None, "", "# " * 60, prose(40) + " " + item + " " + prose(40), "say " * 80, prose(60) + " jo.smith@acme.io " + prose(10), prose(60).upper()]
    ids = [None if i in (5, 44) else 1000 - i for i in range(len(texts))]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in zip(ids, texts)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, item), (1, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    rows = [(i, t) for i, t in zip(ids, texts) if passes(t)]
    sets = [shingles(t, SPACE) for _, t in rows]
    group = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                x, y = group[a], group[b]
                group = [y if g == x else g for g in group]
    stay = {}
    for (i, t), g in zip(rows, group):
        if g not in stay or (i is not None and (stay[g][0] is None or i < stay[g][0])):
            stay[g] = (i, t)
    wanted = shingles(item, NON_ALNUM)
    clean = [(i, t) for i, t in stay.values() if 10 * len(wanted & shingles(t, NON_ALNUM)) < 8 * len(wanted)]
    assert len(rows) > len(stay) > len(clean) > 25

    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality_rules", "simhash_near_dedup", "benchmark_decontamination", "pii_surrogates", "lexical_packing"]
    at = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name in list(stages)[:-1]:
        at = stages[name](spark, at, str(tmp_path))
        assert at.columns == docs.columns
    done = at.collect()
    assert sorted(d.doc_id or 0 for d in done) == sorted(i or 0 for i, _ in clean)
    before = dict((i, t) for i, t in clean)
    for d in done:
        assert d.n_chars == len(d.text)
        if "@" in d.text:
            assert "acme" not in d.text and len(d.text.split()) == len(before[d.doc_id].split())
        else:
            assert d.text == before[d.doc_id]

    got = collections.Counter()
    for p in corpus_pipeline.run(spark, str(tmp_path)).collect():
        got[p.doc_id] += p.length
        assert 0 <= p.offset and p.offset + p.length <= 2048
    assert got == collections.Counter({d.doc_id: len(np.frombuffer(x, "<u2")) + 1 for d, x in zip(done, encoder().encode([d.text for d in done]))})
    assert simhash.STAGE_WORDS == 5 and pii.session_key(spark)
