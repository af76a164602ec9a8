"""Byte windows by prefix doubling, against brute force."""

import hashlib
import random

import pytest

from quillstream.llm import suffix_array


def brute(rows, window):
    """rows: (id or None, text) in table order; results in the order of documents."""
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, i))
    seen, out = set(), []
    for i in order:
        raw = (rows[i][1] or "").encode()
        gone = [False] * len(raw)
        for k in range(len(raw) - window + 1):
            if raw[k : k + window] in seen:
                gone[k : k + window] = [True] * window
            seen.add(raw[k : k + window])
        spans = [k for k in range(len(raw)) if gone[k] and (k == 0 or not gone[k - 1])]
        out.append((rows[i][0], len(raw), sum(gone), len(spans), hashlib.sha256(bytes(b for b, g in zip(raw, gone) if not g)).hexdigest()))
    return sorted(out, key=repr)


def made(seed, n, window):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdeé漢") for _ in range(rng.randint(1, 9))) for _ in range(400)]
    text = lambda k: " ".join(rng.choice(vocabulary) for _ in range(k))
    shared, out = [text(40) for _ in range(6)], []
    for i in range(n):
        t = text(rng.randint(0, 120))
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(shared)
            a, b = sorted((rng.randint(0, len(p)), rng.randint(0, len(p))))
            t += rng.choice(["", " ", "x"]) + (p if rng.random() < 0.5 else p[a:b]) + text(rng.randint(0, 10))
        if out and rng.random() < 0.3:  # a near copy
            t = rng.choice(out)[1]
            k = rng.randint(0, len(t))
            t = t[:k] + rng.choice(["", "é", "zz"]) + t[k + rng.randint(0, 2) :]
        out.append((i, t))
    rng.shuffle(out)
    return out


@pytest.mark.parametrize("window,bucket", [(100, 20_000), (100, 3_000), (16, 5_000), (41, 4_000)])
def test_against_brute_force(spark, window, bucket):
    rows = made(window + bucket, 120, window)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3, "doc_id")
    rows = [tuple(r) for r in df.collect()]
    got = suffix_array.remove_repeats(df, window=window, bucket_bytes=bucket, slot_keys=50, part_pairs=2_000).collect()
    assert sorted(map(tuple, got), key=repr) == brute(rows, window)


def test_odd_rows(spark):
    long = "".join(chr(97 + (k * k) % 23) for k in range(400))
    rows = [(None, long), (3, long), (3, long), (1, None), (2, ""), (4, "a" * 100_000), (5, "ab" * 300), (6, "short"), (7, long[:99]), (8, long[:100] + "é" * 200), (None, long[50:300])]
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, bucket int, z string").coalesce(1)
    got = suffix_array.remove_repeats(df, bucket_bytes=30_000, spans=True, with_text=True).collect()
    assert sorted([tuple(r)[:5] for r in got], key=repr) == brute(rows, 100)
    for r in got:
        assert len(r.kept) == r.n_bytes - r.n_removed and sum(s["bytes"] for s in r.spans) == r.n_removed and len(r.spans) == r.n_spans


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert suffix_array.remove_repeats(df).columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    assert suffix_array.remove_repeats(df).count() == 0


def test_rows_without_repeats(spark):
    rows = [(i, hashlib.sha256(str(i).encode()).hexdigest() * 1 + hashlib.md5(str(i).encode()).hexdigest() * 2) for i in range(20)]
    got = suffix_array.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sum(r.n_removed for r in got) == 0


def test_hashes_are_of_their_strings():
    import numpy as np

    buf = np.frombuffer(b"abracadabra" * 20, np.uint8)
    for k in (1, 2, 7, 32, 100):
        h = suffix_array.hashes(buf, k)
        assert len(h) == len(buf) - k + 1 and all(h[i] == h[i + 11] for i in range(len(h) - 11)) and (k < 4 or len(set(h[:11].tolist())) == 11)


def test_classes_survive_a_hash_that_agrees(monkeypatch):
    import numpy as np

    rng = np.random.default_rng(1)
    x, y = rng.integers(0, 9, 500).astype(np.uint64), rng.integers(0, 9, 500).astype(np.uint64)
    for mix in (suffix_array._mix, lambda v: v & np.uint64(1)):
        monkeypatch.setattr(suffix_array, "_mix", mix)
        of, first, lots = suffix_array._classes(x, y, 3)
        assert len(first) == len(set(zip(x.tolist(), y.tolist()))) and (x[first][of] == x).all() and (y[first][of] == y).all()
        assert lots[0][1] == 0 and lots[-1][2] == len(first)
