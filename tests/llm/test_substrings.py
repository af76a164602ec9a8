"""Substring dedup against brute force: hot prefixes, words that fool polynomial hashes, ids that are null or repeat."""

import collections
import hashlib
import random

import pytest

from quillstream.llm import substrings


def brute(rows):
    """Sorted (id, n_words, n_removed, kept words) of rows (id, text)."""
    words = [(t or "").split(" ") if (t or "").strip() else [] for _, t in rows]
    words = [[x for w in ws for x in w.split()] for ws in words]
    key = [substrings.LAST if i is None else i for i, _ in rows]
    first = {}
    for i, w in zip(key, words):
        for k in range(len(w) - 12):
            g = tuple(w[k : k + 13])
            first[g] = min(first.get(g, i), i)
    out = []
    for (d, _), i, w in zip(rows, key, words):
        gone = [False] * len(w)
        for k in range(len(w) - 12):
            if first[tuple(w[k : k + 13])] < i:
                gone[k : k + 13] = [True] * 13
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out.append((d, len(w), sum(gone), kept))
    return collections.Counter(out)


def found(spark, rows, **options):
    df = spark.createDataFrame([(*r, "x", "y", "z") for r in rows], "doc_id long, text string, id string, bucket string, slot string")
    got = substrings.remove_repeats(df, with_text=True, spans=True, **options).collect()
    for r in got:
        assert r.kept_sha256 == hashlib.sha256(r.kept_text.encode()).hexdigest()
        assert sum(s.words for s in r.spans) == r.n_removed
    return collections.Counter((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in got)


def thue_morse(n, a, b):
    return "".join(b if bin(i).count("1") % 2 else a for i in range(n))


def test_words_that_fool_polynomials(spark):
    twelve = " ".join(f"w{i}" for i in range(12))
    rows = [(0, f"{twelve} {thue_morse(1024, 'a', 'b')}"), (1, f"{twelve} {thue_morse(1024, 'b', 'a')}"), (2, f"{twelve} {thue_morse(1024, 'a', 'b')}")]
    got = found(spark, rows)
    assert got == brute(rows) and [n for (d, _, n, _) in got if d == 1] == [0]


def test_chance_agreement_of_hashes(spark, monkeypatch):
    """With hashes of four values only, the words alone tell windows apart."""
    monkeypatch.setattr(substrings, "_mix", lambda x: x & substrings._U(3))
    r = random.Random(3)
    texts = [" ".join(r.choices("ab", k=40)) for _ in range(30)]
    keys = [substrings.LAST] * len(texts)
    import numpy as np

    p = substrings.Suffixes([substrings.normal(t) for t in texts], np.array(keys))
    windows = [tuple(t.split()[k : k + 13]) for t in texts for k in range(28)]
    assert len(set(zip(p.of.tolist(), windows))) == len(set(windows)) == len(p.head)


@pytest.mark.parametrize("options", [{}, {"bucket_bytes": 2_000, "group_suffixes": 20, "slot_windows": 100}, {"bucket_bytes": 500, "group_suffixes": 4}])
def test_hot_prefixes(spark, options):
    r = random.Random(7)
    word = lambda: "".join(r.choices("abcde", k=2))
    head = "this page was made by the same eight words"
    tails = [" ".join(word() for _ in range(20)) for _ in range(12)]
    rows = [(i, f"{' '.join(word() for _ in range(r.randint(0, 30)))} {head} {r.choice(tails)}\t{r.choice(tails)}") for i in range(120)]
    rows += [(500 + i, rows[3][1]) for i in range(40)] + [(600, "é ß " * 30), (601, "é ß " * 20)]
    assert found(spark, rows, **options) == brute(rows)


def test_ids_null_or_repeated(spark):
    text = " ".join(f"w{i}" for i in range(30))
    rows = [(None, text), (None, text), (None, "x " + text), (7, text), (7, text), (9, "y " + text), (9, None), (None, None), (3, ""), (4, " \t\n")]
    assert found(spark, rows) == brute(rows)
    rows = [(None, text), (None, text + " z")]
    assert found(spark, rows) == brute(rows)


def test_empty_table(spark):
    assert not found(spark, [])
