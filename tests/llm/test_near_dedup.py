"""The pipeline's near-duplicate stage against all pairs in plain Python."""

import random

from quillstream.llm import simhash

R = random.Random(8)
WORDS = [a + b for a in "ba ce di fo gu ha je ki lo mu".split() for b in "n r s t l m nd st".split()]


def near_copy(text, changes):
    w = text.split()
    for k in range(changes):
        w[(2 * k + 1) * len(w) // (2 * changes)] = f"changed{R.random()}"
    return " ".join(w)


def texts():
    out = []
    for _ in range(40):
        base = " ".join(R.choices(WORDS, k=200))
        out += [base] + [near_copy(base, c) for c in (1, 2, 4, 5, 8)]
    hot = " ".join(R.choices(WORDS, k=200))
    chain = [hot]
    for _ in range(6):
        chain.append(near_copy(chain[-1], 3))
    return out + chain + [near_copy(hot, 2) for _ in range(60)] + [out[0], out[0].upper(), "", "a b", "a  b", "one"]


def shingles(t):
    w = (t or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def groups(all_texts):
    s = [shingles(t) for t in all_texts]
    parent = list(range(len(s)))

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(s)):
        for j in range(i):
            if s[i] == s[j] or 100 * len(s[i] & s[j]) >= 80 * len(s[i] | s[j]):
                x, y = sorted((top(i), top(j)))
                parent[y] = x
    return [top(i) for i in range(len(s))]


def test_near_copies_of_jaccard_from_80_percent(spark):
    t = texts()
    df = spark.createDataFrame(list(enumerate(t)), "doc_id long, text string")
    got = {r.doc_id for r in simhash.drop_near_duplicates(df).collect()}
    assert got == set(groups(t))


def test_rows_without_id(spark):
    base = " ".join(R.choices(WORDS, k=200))
    other = " ".join(R.choices(WORDS, k=200))
    rows = [(None, base), (None, base), (None, near_copy(base, 3)), (None, other), (7, near_copy(other, 2)), (None, None), (None, "alone here")]
    got = simhash.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == 4 and sum(r.doc_id == 7 for r in got) == 1
    assert sum((r.text or "") == "" for r in got) == 1 and "alone here" in {r.text for r in got} and other not in {r.text for r in got}


def test_equal_rows_become_one(spark):
    base = " ".join(R.choices(WORDS, k=200))
    rows = [(1, base)] * 3 + [(2, near_copy(base, 1)), (3, "some other words that stand alone here"), (3, "some other words that stand alone here")]
    got = simhash.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(r.doc_id for r in got) == [1, 3]


def test_texts_that_are_alike_but_not_enough_form_no_pairs(spark):
    """300 texts each of which has changed a fifth of one template: all share bands, none links."""
    base = " ".join(R.choices(WORDS, k=200))
    rows = [(i, near_copy(base, 7)) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    formed = []
    real = simhash._verified
    try:
        simhash._verified = lambda pairs, sets: formed.append(pairs.count()) or real(pairs, sets)
        assert simhash.drop_near_duplicates(df).count() == 300
    finally:
        simhash._verified = real
    assert len(formed) == 2 and formed[0] > 100 and formed[1] < 30


def test_a_star_is_contracted(spark):
    edges = spark.range(1, 20_001).selectExpr("0 as a", "id as b")
    got = simhash.components(edges)
    assert got.filter("root = 0").count() == 20_001 == got.count()
