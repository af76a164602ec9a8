"""The Merkle manifest against a plain one, for strides and arities, and its proofs."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from quillstream.llm import manifest


def H(text):
    return hashlib.sha256(text.encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def tree(nodes, arity):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([H("".join(levels[-1][i : i + arity])) for i in range(0, len(levels[-1]), arity)])
    return levels


def way(levels, i, arity):
    out = []
    for nodes in levels[:-1]:
        a = i - i % arity
        out.append(("".join(nodes[a:i]), "".join(nodes[i + 1 : a + arity])))
        i //= arity
    return out


def plain(rows, arity):
    leaf = lambda r, more: H("".join(field(v) for v in (r[0], r[3], r[2], None if r[4] is None else r[4] + more, r[1])))
    by = {}
    for r in rows:
        by.setdefault(r[2], []).append((r[0] is not None, r[0] or 0, leaf(r, 0), r))
    langs = sorted(by, key=lambda x: (x is not None, (x or "").encode()))
    trees = {k: tree([x[2] for x in sorted(by[k], key=lambda x: x[:3])], arity) for k in langs}
    top = tree([trees[k][-1][0] for k in langs], arity)
    out = []
    for g, k in enumerate(langs):
        for i, (_, _, own, r) in enumerate(sorted(by[k], key=lambda x: x[:3])):
            proof = way(trees[k], i, arity) + way(top, g, arity)
            at = leaf(r, 1) if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0 else own
            for left, right in proof:
                at = H(left + at + right)
            out.append((r[0], own, trees[k][-1][0], top[-1][0], H("".join(a + b for a, b in proof)), at, at == top[-1][0]))
    return sorted(out, key=repr)


COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, place string, n int"


def rows(n):
    out = [(i * 3 % 1009, f"text é {i}" if i % 5 else None, ["en", "de", None, "zh漢", "b"][min(i % 9, 4)], None if i % 4 == 0 else f"s{i % 3}", None if i % 6 == 0 else i) for i in range(n)]
    return out + [(5, "again", "en", "s", 1), (5, "other", "en", "s", 1), (None, "no id", "en", "s", 2), (None, None, None, None, None), (88, "alone", "zz", "s", 3)]


@pytest.mark.parametrize("arity,stride,n", [(2, 6, 300), (2, 1, 40), (2, 3, 40), (3, 2, 100)])
def test_against_a_plain_tree(spark, arity, stride, n):
    made = rows(n)
    df = spark.createDataFrame([(*r, "x", 1) for r in made], COLUMNS)
    got = manifest.manifest(df, arity=arity, stride=stride).collect()
    assert sorted(map(tuple, got), key=repr) == plain(made, arity)


def test_proofs_fold_to_the_root(spark):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows(30)], COLUMNS)
    got = manifest.manifest(df, with_proof=True).collect()
    for r in got:
        proof = [(s.left, s.right) for s in r.proof]
        assert manifest.fold(r.leaf, proof) == r.root and H("".join(a + b for a, b in proof)) == r.proof_sha256
    assert {r.verified for r in got} == {True, False}


def test_one_row_and_none(spark):
    df = spark.createDataFrame([(1, "a", "en", "s", 1, "x", 1)], COLUMNS)
    (r,) = manifest.manifest(df).collect()
    assert r.leaf == r.subroot == r.root and r.proof_sha256 == H("")
    assert manifest.manifest(df.filter(F.lit(False))).count() == 0
