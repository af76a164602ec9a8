"""Documents without id are decontaminated by their own text."""

from quillstream.llm import decontaminate


def test_decontaminate_rows_without_id(spark):
    item = "one two three four five six seven eight nine ten eleven twelve"
    rows = [(None, "so " + item + " it ends"), (None, "so " + item + " it ends"), (None, "nothing of it is here"), (None, None), (1, item), (2, "nothing of it is here")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    items = spark.createDataFrame([(0, item)], "item_id long, text string")
    got = sorted(((r.doc_id, r.text) for r in decontaminate.decontaminate(docs, items).collect()), key=repr)
    assert got == sorted([rows[2], rows[3], rows[5]], key=repr)
