"""Shards that are resumed, other rows behind them, and rows without id."""

import os

import numpy as np

from quillstream.llm import training_order


def docs(spark, texts):
    return spark.createDataFrame([(None if i % 3 == 0 else i // 2, t, "x", 1) for i, t in enumerate(texts)], "doc_id long, text string, slot string, shard long").coalesce(1)


def test_resume_never_keeps_stale_slots(spark, tmp_path):
    options = {"length": 32, "per_shard": 4}
    texts = [f"some words of text number {i} and a few more of them" for i in range(60)]
    one, two, fresh = (str(tmp_path / x) for x in ("one", "two", "fresh"))
    training_order.write_shards(docs(spark, texts), one, **options).count()
    before = {f: os.stat(f"{one}/{f}").st_mtime_ns for f in os.listdir(one) if f.endswith(".bin")}
    training_order.write_shards(docs(spark, texts), one, resume=True, **options).count()
    assert before == {f: os.stat(f"{one}/{f}").st_mtime_ns for f in os.listdir(one) if f.endswith(".bin")}
    os.remove(f"{one}/shard-00000001.bin")
    open(f"{one}/shard-00000002.bin", "ab").write(b"more")
    open(f"{one}/.x.unfinished", "w").close()
    changed = [*texts[:30], "another text in its place, of other words", *texts[31:]]
    for path, resume in ((one, True), (fresh, False)):
        training_order.write_shards(docs(spark, changed), path, resume=resume, **options).count()
    assert (training_order.read_slots(one, 0, 10**6) == training_order.read_slots(fresh, 0, 10**6)).all()
    assert sorted(os.listdir(one)) == sorted(os.listdir(fresh))
    rows = training_order.write_shards(docs(spark, texts), two, **options).collect()
    assert sorted(r.slot for r in rows) == list(range(len(rows))) and any(None in r.doc_ids for r in rows)
    assert {(r.slot // 4, r.slot % 4) for r in rows} == {(r.shard, r.row) for r in rows}


def test_empty(spark, tmp_path):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert training_order.write_shards(df, str(tmp_path)).count() == 0 and np.size(training_order.read_slots(str(tmp_path), 0, 5)) == 0


def test_ids_are_the_tokenizers(spark, tmp_path):
    """What the shards hold, put back in the stream's order, is the tokenizer's own ids of every document with the closing id."""
    from tokenizers import Tokenizer

    from quillstream.llm.tokens import END_ID, vocabulary_path

    texts = ["The quick brown fox's 12 jumps!", None, "", "Straße éa 漢字 x<|y", "it's 3.14 — “quoted”", *[f"row {i} of wordsandwords, {i * 7919}" for i in range(30)]]
    own = Tokenizer.from_file(vocabulary_path())
    stream = [x for t in texts for x in [*own.encode(t or "", add_special_tokens=False).ids, END_ID]]
    rows = training_order.write_shards(docs(spark, texts), str(tmp_path), length=16, per_shard=4).collect()
    held = training_order.read_slots(str(tmp_path), 0, len(rows))
    got = [int(x) for r in sorted(rows, key=lambda r: r.sequence) for x in held[r.slot]]
    assert got[: len(stream)] == stream and not any(got[len(stream) :]) and len(got) == -(-len(stream) // 16) * 16
