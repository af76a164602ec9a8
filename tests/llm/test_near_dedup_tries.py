"""The near-duplicate stage goes by fingerprints: its tries against brute force, without Spark."""

import random

import numpy as np
import pyarrow as pa

from quillstream.llm import simhash

COLUMNS = ["key", "at", "node", "n", "fp", "part"]


def differ(a, b):
    return bin((a ^ b) & (1 << 64) - 1).count("1")


def test_tries_give_all_pairs_within_a_wide_budget():
    r = random.Random(3)
    base = [r.getrandbits(64) for _ in range(5)]
    near = [b ^ sum(1 << x for x in r.sample(range(64), k)) for b in base for k in (0, 0, 1, 20, 27, 28, 29, 35)]
    values = np.array([*sorted(near[:20]), *sorted(near[20:])], np.uint64)
    got = [(min(p), max(p)) for x, y in simhash.trie_pairs(values, np.array([0, 20]), np.array([20, 40]), 0, 28, 50) for p in zip(x.tolist(), y.tolist())]
    want = {(i, j) for i in range(40) for j in range(i + 1, 40) if i // 20 == j // 20 and differ(int(values[i]), int(values[j])) <= 28}
    assert len(got) == len(set(got)) and set(got) == want


def test_a_pair_needs_near_fingerprints_different_parts_and_enough_left():
    fp, far = 0x0123456789ABCDEF, 0x0123456789ABCDEF ^ (1 << 40) - 1
    rows = [(1, 0, 10, 100, fp, 10), (1, 3, 11, 100, fp ^ 255, 11), (1, 0, 12, 100, far, 12), (1, 0, 13, 100, fp, 10), (1, 15, 14, 100, fp, 14), (1, 0, 15, 60, fp, 15), (2, 0, 16, 100, fp, 16)]
    batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int64()])], COLUMNS)
    got = sorted((x["a"], x["b"]) for b in simhash._apart(iter([batch])) for x in b.to_pylist())
    assert got == [(10, 11), (11, 13)]


def test_fingerprints_of_texts_at_the_threshold_are_within_the_budget():
    r = np.random.default_rng(4)
    most = 0
    for n in (4, 5, 8, 12, 20, 60, 200):
        for _ in range(300):
            h = r.integers(0, 1 << 64, n + n // 4, dtype=np.uint64)
            a = int(r.integers(0, n // 4 + 1))
            most = max(most, differ(simhash.majority(h[: n + a]), simhash.majority(np.r_[h[:n], h[n + a :]])))
    assert 20 < most <= simhash.STAGE_BUDGET
