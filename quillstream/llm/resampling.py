"""Importance resampling towards a target distribution of hashed word runs.

One scan of each text keeps a ring: the running zlib CRC states of the last n - 1 starts. A new word extends every state by a space and
the word and opens one of its own, so each run of 1 to n words costs one step on bytes already read; the states' residues
are the buckets. The scan emits, for a document, its buckets with their counts, and that table is kept: corpus counts, gains and weights
all come from it, so no text is read twice. Texts are walked in lots of bytes; the ring lives on from lot to lot, so a long text
takes no more memory than a short one.

A bucket's gain is floor(1000 * ln((t + 1) * (S + m) / ((s + 1) * (T + m)))) for s of the documents' S and t of the target's T features in it, of m
buckets; a document's weight is the floored mean of its features' gains; its score adds a Gumbel draw made of its id. The best share of
the documents with enough words is drawn by rank.

Corpus counts are one row for each bucket and task before they are shuffled; gains are m numbers, a parameter, which is all that the driver
sees. Ranks come from ranges of scores counted by partition.

Defined results: a null or empty text has no feature and weight 0; rows that repeat an id share its draw and are counted and drawn each, in the
order of their texts' hashes; a row without id takes the draw of the empty id and loses ties; without documents nothing is drawn, and an
empty target has T = 0.
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstream.llm.common import cut, lots, text_or_empty
from quillstream.llm.manifest import placed

RUN = 1
BUCKETS = 10_000
SEED = 2024
PERCENT = 10
LEAST_WORDS = 20
#: Bytes of a text that become words at once.
LOT = 1 << 16
#: A-Z in lower case; bytes that are no part of a word become spaces.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 0x80 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def words_of(text: str | None, lot: int = LOT) -> Iterator[list[bytes]]:
    """The words of a text, in lists of whole words."""
    raw = (text or "").encode().translate(_FOLD)
    i = 0
    while i < len(raw):
        j = raw.find(b" ", i + lot)
        j = len(raw) if j < 0 else j
        yield raw[i:j].split()
        i = j


def features(text: str | None, n: int = RUN, lot: int = LOT) -> tuple[int, np.ndarray]:
    """The number of words, and the CRC of each run of 1 to n words, as unsigned numbers."""
    ring: list[int] = []
    found, count = [], 0
    for some in words_of(text, lot):
        count += len(some)
        if n == 1:  # the ring is empty
            states = list(map(crc32, some))
        else:
            states = []
            for w in some:
                tail = b" " + w
                ring = [crc32(tail, state) for state in ring]
                ring.append(crc32(w))
                states += ring
                if len(ring) == n:
                    del ring[0]  # the oldest start has had its n words
        found.append(np.array(states, np.uint32))
    return count, np.concatenate(found) if found else np.empty(0, np.uint32)


def emit(df: DataFrame, text: str = "text", id_column: str = "doc_id", n: int = RUN, buckets: int = BUCKETS) -> DataFrame:
    """id, tie (the text's hash), n_words, n_features, at and times (buckets and their counts, as arrays of 32-bit numbers)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in lots(batches, 500):
            n_words, n_features, at, times = [], [], [], []
            for t in b.column(2).to_pylist():
                count, crc = features(t, n)
                own, c = np.unique(crc % np.uint32(buckets), return_counts=True)
                n_words.append(count)
                n_features.append(len(crc))
                at.append(own.astype("<u4").tobytes())
                times.append(c.astype("<u4").tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n_words, pa.int64()), pa.array(n_features, pa.int64()), pa.array(at, pa.binary()), pa.array(times, pa.binary())], ["id", "tie", "n_words", "n_features", "at", "times"])

    rows = df.select(F.col(id_column).cast("long").alias("id"), F.xxhash64(text_or_empty(text)).alias("tie"), F.col(text).cast("string"))
    return rows.mapInArrow(run, "id long, tie long, n_words long, n_features long, at binary, times binary")


def counts(emitted: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """How often each bucket occurs; every task sends one row for each of its buckets at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for b in batches:
            for at, times in zip(b.column(0), b.column(1)):
                total[np.frombuffer(at.as_buffer(), "<u4")] += np.frombuffer(times.as_buffer(), "<u4")
        own = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(own, pa.int64()), pa.array(total[own])], ["bucket", "c"])

    out = np.zeros(buckets, np.int64)
    for r in emitted.select("at", "times").mapInArrow(run, "bucket long, c long").groupBy("bucket").agg(F.sum("c").alias("c")).collect():  # one row a bucket
        out[r["bucket"]] = r["c"]
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Of each bucket."""
    m = len(corpus)
    ratio = ((target + 1) * float(corpus.sum() + m)) / ((corpus + 1) * float(target.sum() + m))
    return np.floor(1000 * np.log(ratio)).astype(np.int64)


def _weighed(emitted: DataFrame, gain: np.ndarray) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            weight = []
            for n, at, times in zip(b.column("n_features").to_pylist(), b.column("at"), b.column("times")):
                total = int((gain[np.frombuffer(at.as_buffer(), "<u4")] * np.frombuffer(times.as_buffer(), "<u4")).sum())
                weight.append(total // n if n else 0)
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("tie"), b.column("n_words"), b.column("n_features"), pa.array(weight, pa.int64())], ["id", "tie", "n_words", "n_features", "weight"])

    return emitted.mapInArrow(run, "id long, tie long, n_words long, n_features long, weight long")


def gumbel(id_column: Column, seed: int = SEED) -> Column:
    """floor(-1000 * ln(-ln((h + 0.5) / 2^32))) for the first 8 hex digits h of the sha256 of seed:id."""
    hexes = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_column.cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(hexes, 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def resample(docs: DataFrame, target: DataFrame, text: str = "text", id_column: str = "doc_id", n: int = RUN, buckets: int = BUCKETS, seed: int = SEED, percent: int = PERCENT, least_words: int = LEAST_WORDS) -> DataFrame:
    """id, n_features, weight, score, rank (null where not drawn) of every document."""
    emitted = cut(emit(docs, text, id_column, n, buckets))
    wanted = counts(emit(target.withColumn("_target", F.lit(None).cast("long")), text, "_target", n, buckets), buckets)
    weighed = _weighed(emitted, gains(counts(emitted, buckets), wanted)).withColumn("score", F.col("weight") + gumbel(F.col("id"), seed))
    weighed = cut(weighed.withColumn("fit", F.col("n_words") >= least_words))
    drawn = weighed.filter("fit").count() * percent // 100
    ranked = placed(weighed.filter("fit"), [F.col("score").desc(), F.col("id").asc_nulls_last(), F.col("tie")])
    rank = F.when(F.col("place") < drawn, F.col("place") + 1)
    cols = ["id", "n_features", "weight", "score"]
    return ranked.select(*cols, rank.alias("rank")).unionByName(weighed.filter("not fit").select(*cols, F.lit(None).cast("long").alias("rank"))).withColumnRenamed("id", id_column)
