"""Null ids, repeated ids, repeated rows and clashing column names: each row gets what its own text gives."""

import collections

import pytest

from quillstream.llm import decontaminate, html_extract, licenses, packing, secrets, simhash

ITEM = "one two three four five six seven eight nine ten eleven twelve"
TEXTS = ["so " + ITEM + " it ends", "License: cc by nc here", "nothing here at all", None, "", "password = 'abcdefgh12345678' is it", "so " + ITEM + " it ends", "ß é 漢字 \U0001f600 \x00", "w " * 400]
IDS = [None, 1, 1, None, 2, 2, None, 3, 1]
CLASH = "id string, _id string, _row string, doc string, item string, hash string, t string, bucket string, shard string, n string, ids string, n_words string, _words string, gram string, template string, fp string, kept string, _h string"


def table(spark, ids, texts, id_column="doc_id", text="text"):
    names = CLASH.count(",") + 1
    rows = [(i, t, *["x"] * names) for i, t in zip(ids, texts)]
    return spark.createDataFrame(rows, f"{id_column} long, {text} string, {CLASH}")


def search(df):
    items = df.sparkSession.createDataFrame([(None, ITEM, 1), (7, ITEM, 2), (7, None, 3), (8, "cc by nc", 4)], "item_id long, text string, doc long")
    return decontaminate.search(df, items)


@pytest.mark.parametrize("operator", [search, licenses.scan, secrets.scan], ids=["op3", "op6", "op5"])
def test_each_row_by_its_own_text(spark, operator):
    plain = {}
    for r in operator(table(spark, range(len(TEXTS)), TEXTS)).collect():
        plain.setdefault(r.doc_id, []).append(r)
    want = collections.Counter((IDS[i], repr([v for k, v in r.asDict().items() if k != "doc_id"])) for i, rows in plain.items() for r in rows)
    got = collections.Counter((r.doc_id, repr([v for k, v in r.asDict().items() if k != "doc_id"])) for r in operator(table(spark, IDS, TEXTS)).collect())
    assert got == want and want
    assert operator(table(spark, [], [])).count() == 0


def test_near_duplicates_and_pipeline_stages(spark):
    df = table(spark, IDS, TEXTS)
    got = simhash.near_duplicates(df).collect()
    assert len(got) == len(TEXTS)
    groups = collections.defaultdict(set)
    for i, t in zip(IDS, TEXTS):
        groups[simhash.fingerprint(t)].add(i)
    for r in got:
        assert r.doc_id in groups[int(r.fingerprint, 16)]
    kept = simhash.drop_near_duplicates(df)
    assert kept.columns == df.columns
    texts = collections.Counter(t for t in (r.text for r in kept.collect()))
    # one row of the two copies, of null and empty, and of each other text
    assert texts[TEXTS[0]] == 1 and texts[None] + texts[""] == 1 and all(texts[t] == 1 for t in TEXTS[1:3] + TEXTS[5:6] + TEXTS[7:])
    items = spark.createDataFrame([(0, ITEM, "a")], "item_id long, text string, _key string")
    clean = decontaminate.decontaminate(df, items)
    assert clean.columns == df.columns
    assert collections.Counter((r.doc_id, r.text) for r in clean.collect()) == collections.Counter((i, t) for i, t in zip(IDS, TEXTS) if ITEM not in (t or ""))


def test_packing(spark):
    rows = packing.pack(table(spark, IDS, TEXTS), length=64, shard_tokens=300).collect()
    total = collections.Counter()
    for r in rows:
        total[r.doc_id] += r.length
    from quillstream.llm.tokens import encoder

    want = collections.Counter()
    for i, ids in zip(IDS, encoder().encode(TEXTS)):
        want[i] += len(ids) // 2 + 1
    assert total == want
    assert packing.pack(table(spark, [], [])).count() == 0


def test_pages(spark):
    pages = ["<p>a&amp;b</p>", None, "", "<article><p>x  y</p></article><footer>z</footer>"]
    df = spark.createDataFrame([(i, "u", h, "x", "y") for i, h in zip([None, 1, 1, None], pages)], "page_id long, url string, html string, id string, text string")
    got = collections.Counter((r.page_id, r.text, r.n_chars) for r in html_extract.extract(df).collect())
    model = html_extract.trained()
    texts = [html_extract.extract_text(h, model) for h in pages]
    assert got == collections.Counter(zip([None, 1, 1, None], texts, map(len, texts)))
