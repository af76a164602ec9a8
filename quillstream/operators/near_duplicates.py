"""Near-duplicate linking: each document points to the best match among first versions, if that match is the earlier one."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillstream.functions import fingerprint
from quillstream.operators.tables import cut, release

THRESHOLD, HOURS, MIN_TOKENS = 0.7, 72, 40
#: Each round settles at least the first document that waits, in practice most of them.
MAX_ROUNDS = 200
#: Rare tokens that two sets must share to be compared; counters of how frequent tokens are; texts taken at a time.
SHARED, COUNTERS, LOT = 3, 1 << 20, 1000
#: Parts of the bands that texts meet at one after another.
TURNS = 4
#: Rows up to which a side of a join is broadcast.
BROADCAST_ROWS = 200_000


def hashed_sets(rows: DataFrame) -> DataFrame:
    """rows with s instead of their text: the 64-bit hashes of its distinct tokens, ascending, and key, a 64-bit digest that names the set."""
    others = [c for c in rows.columns if c != "text"]
    fields = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in others)

    def run(batches):
        for whole in batches:
            for k in range(0, whole.num_rows, LOT):
                b = whole.slice(k, LOT)
                words, counts = fingerprint.plain_tokens(b.column(len(others)))
                listed = b.column(len(others) + 1)
                wide = listed.value_lengths().fill_null(0).to_numpy().astype(np.int64)
                h = np.r_[fingerprint.word_hashes(words), fingerprint.word_hashes(listed.flatten().cast(pa.large_string()))]
                row = np.repeat(np.r_[0 : b.num_rows, 0 : b.num_rows], np.r_[counts, wide])
                order = np.lexsort((h, row))
                h, row = h[order], row[order]
                new = np.r_[True, (h[1:] != h[:-1]) | (row[1:] != row[:-1])][: len(h)]
                h, ends = h[new], np.r_[0, np.cumsum(np.bincount(row[new], minlength=b.num_rows))]
                key = np.array([int.from_bytes(hashlib.blake2b(h[i:j].tobytes(), digest_size=8).digest(), "big", signed=True) for i, j in zip(ends[:-1], ends[1:])], np.int64)
                sets = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(h))
                yield pa.RecordBatch.from_arrays([*b.columns[: len(others)], sets, pa.array(key)], [*others, "s", "key"])

    return rows.select(*others, *fingerprint.split(F.col("text"))).mapInArrow(run, f"{fields}, s array<long>, key long")


def _slots(hashes: np.ndarray) -> np.ndarray:
    return hashes & (COUNTERS - 1)


def frequencies(sets: DataFrame) -> np.ndarray:
    """How often tokens of rows (s) occur, in COUNTERS counters whatever the input; several tokens may share one."""

    def run(batches):
        n = np.zeros(COUNTERS, np.int64)
        for b in batches:
            n += np.bincount(_slots(b.column(0).flatten().to_numpy()), minlength=COUNTERS)
        slot = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(slot.astype(np.int32)), pa.array(n[slot])], ["slot", "n"])

    return _counters(sets.select("s").mapInArrow(run, "slot int, n long"))


def known_frequencies(df: DataFrame) -> np.ndarray:
    """As `frequencies`, of rows (token, df)."""

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(_slots(fingerprint.word_hashes(b.column(0).cast(pa.large_string()))).astype(np.int32)), b.column(1)], ["slot", "n"])

    return _counters(df.filter("token is not null").select("token", F.col("df").cast("long")).mapInArrow(run, "slot int, n long"))


def _counters(rows: DataFrame) -> np.ndarray:
    got = rows.groupBy("slot").agg(F.sum("n").alias("n")).toArrow()  # COUNTERS rows at most
    out = np.zeros(COUNTERS, np.int32)
    out[got["slot"].to_numpy()] = np.minimum(got["n"].to_numpy(), 2**31 - 1)
    return out


def rare_tokens(sets: DataFrame, counters: np.ndarray, threshold: float, whole: bool = False) -> DataFrame:
    """(key, n, at, token): the rarest tokens of rows (key, s), as many as sets that reach the threshold must share SHARED of; at is a token's place
    among a set's own, from the rarest. Any order that is the same for all sets will do: here by the counters, then by hash. A token is told by half of its
    hash; with whole, the counters are those of these sets, and tokens that stand in one set alone are left out."""

    def run(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, LOT):
                b = batch.slice(k, LOT)
                n, h = b.column(1).value_lengths().to_numpy().astype(np.int64), b.column(1).flatten().to_numpy()
                row = np.repeat(np.arange(len(n)), n)
                order = np.lexsort((h, counters[_slots(h)], row))
                at = np.arange(len(h)) - np.repeat(np.cumsum(n) - n, n)
                first = at < np.repeat(np.minimum(n, n - np.ceil(threshold * n - 1e-9).astype(np.int64) + SHARED), n)
                first &= (counters[_slots(h[order])] > 1) | (not whole)
                row, at = row[first], at[first]
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row)), pa.array(n[row].astype(np.int32)), pa.array(at.astype(np.int32)), pa.array(h[order][first].astype(np.int32))], ["key", "n", "at", "token"])

    return sets.select("key", "s").mapInArrow(run, "key long, n int, at int, token int")


def meetings(left: DataFrame, right: DataFrame, threshold: float, turn: int | None = None) -> DataFrame:
    """(key, other) for rows (key, n, at, token, band) of either side that share SHARED tokens in the same or a neighbouring band, as far as they can still
    reach the overlap that the threshold asks for; for one and the same side, each pair once. turn: only at every TURNS-th band from that one on."""
    one = left is right
    # a row waits at its own band and at the next; two that both wait at the next have met before
    bands = F.explode(F.array(F.struct(F.col("band").alias("slot"), F.lit(False).alias("next")), F.struct((F.col("band") + 1).alias("slot"), F.lit(True).alias("next")))).alias("b")
    due = F.lit(True) if turn is None else F.pmod("slot", F.lit(TURNS)) == turn
    placed = lambda rows: rows.select("key", "n", "at", "token", bands).select("token", "b.slot", "key", "n", "at", "b.next").filter(due)
    x, y = placed(left), placed(right).toDF("token", "slot", "other", "m", "at2", "next2")
    least = F.ceil(threshold / (1 + threshold) * (F.col("n") + F.col("m")) - 1e-9)
    apart = F.col("key") < F.col("other") if one else F.col("key") != F.col("other")
    can = apart & ~(F.col("next") & F.col("next2")) & (F.least("n", "m") >= threshold * F.greatest("n", "m") - 1e-9) & (F.least(F.col("n") - F.col("at"), F.col("m") - F.col("at2")) + (SHARED - 1) >= least)
    return x.join(y, ["token", "slot"]).filter(can).groupBy("key", "other").agg(F.count(F.lit(1)).alias("shared")).filter(F.col("shared") >= SHARED).select("key", "other")


def scores(met: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """(key, other, score) of the pairs (key, other) whose sets reach the threshold."""
    keys = met.select("key").union(met.select("other")).distinct()
    few = sets.join(F.broadcast(keys) if keys.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else keys, "key", "left_semi").select("key", "s")
    both = met.join(few, "key").join(few.select(F.col("key").alias("other"), F.col("s").alias("t")), "other")
    common = F.size(F.array_intersect("s", "t"))
    return both.select("key", "other", (common / (F.size("s") + F.size("t") - common)).alias("score")).filter(F.col("score") >= threshold)


def parted(sized: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows (..., key, s) as two tables: the rows without s, and one (key, s) for each key. Copies then keep no sets of their own."""
    held = cut(sized)
    parts = cut(held.drop("s")), cut(held.select("key", "s").dropDuplicates(["key"]))
    del held
    release(sized.sparkSession)
    return parts


def text_pairs(sets: DataFrame, places: DataFrame, threshold: float) -> DataFrame:
    """(key, other, score) both ways for different texts of rows (key, s), at distinct places (key, band), whose token sets reach the threshold.

    Two such sets share SHARED of the rarest tokens of each, so texts meet on those and in the same or a neighbouring band of time;
    where they meet, what is left of both must still be able to reach the overlap that the threshold asks for.
    """
    spark = sets.sparkSession
    release(spark)
    placed = rare_tokens(sets, frequencies(sets), threshold, whole=True).join(places, "key")
    met = None
    for turn in range(TURNS):  # two that meet at a band share all their tokens there, so bands can be taken one after another, which keeps shuffles small
        got = cut(meetings(placed, placed, threshold, turn))
        release(spark)
        met = got if met is None else met.unionByName(got)
    met = cut(met.distinct())
    scored = cut(scores(met, sets, threshold))
    release(spark)
    return both_ways(scored)


def both_ways(pairs: DataFrame) -> DataFrame:
    return pairs.unionByName(pairs.select(F.col("other").alias("key"), F.col("key").alias("other"), "score"))


def with_sets(docs: DataFrame) -> DataFrame:
    """(doc_id, at, s, key) of the rows (doc_id, text, at) that take part: with a time and enough tokens. key names the token set."""
    rows = docs.select("doc_id", F.unix_timestamp(F.col("at").cast("timestamp")).alias("at"), "text").filter("at is not null")
    return hashed_sets(rows).filter(F.size("s") >= MIN_TOKENS)


def by_copies(docs: DataFrame, span: int) -> DataFrame:
    """(doc_id, key, at, state, canonical_of, score) of rows (doc_id, key, at) as far as copies of one text tell it: one with a later copy in reach is
    kept, one without is linked to the copy before it, if in reach; the others are open."""
    w = Window.partitionBy("key").orderBy("at", "doc_id")
    near = docs.select("doc_id", "key", "at", (F.lead("at").over(w) - F.col("at") <= span).alias("later"), F.lag("doc_id").over(w).alias("before"), (F.col("at") - F.lag("at").over(w) <= span).alias("earlier"))
    later, earlier = F.coalesce("later", F.lit(False)), F.coalesce("earlier", F.lit(False))
    state = F.when(later, "kept").when(earlier, "linked").otherwise("open")
    return near.select("doc_id", "key", "at", state.alias("state"), F.when(~later & earlier, F.col("before")).alias("canonical_of"), F.when(~later & earlier, 1.0).alias("score"))


def settle(status: DataFrame, pairs: DataFrame, span: int) -> DataFrame:
    """status without open rows: each is settled as soon as its best match is. pairs: (key, other, score), both ways."""
    other = status.select(F.col("doc_id").alias("c"), F.col("key").alias("other"), F.col("at").alias("c_at"))
    edges = status.filter("state = 'open'").select("doc_id", "key", "at").join(pairs, "key").join(other, "other").filter(F.abs(F.col("at") - F.col("c_at")) <= span)
    is_later = F.struct("c_at", "c") > F.struct("at", "doc_id")
    edges = cut(edges.select("doc_id", "c", "c_at", F.col("score").alias("s"), is_later.alias("is_later")))
    for _ in range(MAX_ROUNDS):  # a later document, whatever becomes of it, is not linked yet when its turn has not come
        live = edges.join(status.select(F.col("doc_id").alias("c"), F.col("state").alias("c_state")), "c").filter("is_later or c_state <> 'linked'")
        best = live.groupBy("doc_id").agg(F.max(F.struct("s", "c_at", "c", "is_later", "c_state")).alias("b"))
        b = F.col("b")
        fate = F.when(b.isNull() | b["is_later"], "kept").when(b["c_state"] == "kept", "linked").otherwise("open")
        was_open = F.col("state") == "open"
        joined = status.join(best, "doc_id", "left").withColumn("fate", F.when(was_open, fate).otherwise(F.col("state")))
        linked = was_open & (F.col("fate") == "linked")
        status = cut(joined.select("doc_id", "key", "at", F.col("fate").alias("state"), F.when(linked, b["c"]).otherwise(F.col("canonical_of")).alias("canonical_of"), F.when(linked, b["s"]).otherwise(F.col("score")).alias("score")))
        if status.filter("state = 'open'").isEmpty():
            return status
    raise RuntimeError(f"documents still wait for one another after {MAX_ROUNDS} rounds")


def link_near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, hours: int = HOURS) -> DataFrame:
    """(doc_id, canonical_of, score) for every row of docs (doc_id, text, at); the last two are null for first versions.

    Documents are taken in the order of time, then id. One looks, within so many hours before and after, for the document not yet
    linked whose token set is most like its own, ties going to the latest; it is linked if that one is earlier, else it stays. Null or
    short texts and rows without a time stay. Copies of one text never meet in pairs: one with a later copy in reach stays,
    and one without links to the copy before it, if in reach. Only documents without a copy in reach look at other texts; they are
    settled in rounds, each document as soon as its best match is. Ids must be distinct.
    """
    span = hours * 3600
    sized, sets = parted(with_sets(docs))
    status = cut(by_copies(sized.select("doc_id", "key", "at"), span))
    pairs = text_pairs(sets, sized.select("key", F.floor(F.col("at") / (span + 1)).alias("band")).distinct(), threshold)
    status = settle(status, pairs, span)
    return docs.select("doc_id").join(status.select("doc_id", "canonical_of", "score"), "doc_id", "left")
