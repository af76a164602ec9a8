"""Exact substring dedup of byte strings by distributed prefix doubling.

A byte goes if a string of `WINDOW` (100) bytes that covers it also starts earlier: in a document with a smaller id, or in the same one
before it. Strings never cross documents and are judged on the input.

What is doubled. Sorting every byte position would cost many times the input, so positions that cannot repeat, or that repeat as
part of a whole passage, leave first; both steps are exact.

1. Rows are dealt into buckets of a bounded size. Every window has an anchor, the place of the smallest hash of its grams (GRAM bytes, the
   leftmost of equal ones). Equal windows have equal grams and their anchors at the same offset. About one position in 32 is an anchor; the
   windows of an anchor are neighbours, and what they cover is its segment.
2. Sieve: buckets send 32 bits of each gram's hash to slots by its other bits; a slot tells each bucket which grams others may have too. A gram
   that stands alone ends here. A chance agreement lets an anchor pass for nothing; it decides nothing.
3. Segments of the grams left are named by 128-bit BLAKE2b digests and grouped by Spark: all occurrences of a segment but the earliest lose
   all its windows. A bucket sends one row for each of its segments, so a passage in any number of documents is one row a bucket. Where a gram's
   segments are all the same, that is the whole answer.
4. Where a gram has several segments (texts that agree in part, the ends of shared passages), the windows of each segment's
   earliest occurrence are sorted out by prefix doubling, after a sieve of their own as in 2.

Prefix doubling. A position starts as the pair of its first two 8-byte numbers. Every round deals the pairs out, sorts them, gives
equal ones one rank and takes out those that occur once; a position's next pair is its own rank and that of the position at the offset
of the length reached (16, 32, 64, then 36 on to reach 100), until it is unique or past the threshold. Ranks come from the bytes by
comparison alone, so two windows have one rank in the end only if their bytes are equal. The last round also carries documents and
tells each window whether an earlier one has its rank. Pairs that repeat within a bucket are sent once.

Defined results: a null or empty text has no bytes; texts under 100 bytes lose nothing, and stand for no other's loss; rows that
repeat an id stand one after another in the order of the table, so a later one loses what it shares with an earlier one; a row
without id comes after all others; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstream.llm.common import Written, cut, cut_by, fresh, give_back, release
from quillstream.llm.substrings import LAST, _expanded, _from_planes, _mix, _parts, _planes, _squeezed

WINDOW = 100
BUCKET_BYTES = 8_000_000
SLOT_KEYS = 1_000_000
PART_PAIRS = 500_000
MAX_PARTITIONS = 20_000
#: Positions hashed at once; what they need stays in a core's cache.
STEP = 1 << 16
_U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_BYTE = np.random.default_rng(11).integers(0, 1 << 64, 256, dtype=np.uint64)
_LOW = _U((1 << 20) - 1)


def gram_of(window: int) -> int:
    return max(8, window * 8 // 25)


def hashes(buf: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of each string of k bytes."""
    part, m = _BYTE[buf], 1  # of strings of m bytes
    whole, done = None, 0
    while True:
        if k & m:
            n = len(buf) - done - m + 1
            whole = part.copy() if whole is None else whole[:n] * _U(pow(_BASE, m, 1 << 64)) + part[done : done + n]
            done += m
        if 2 * m > k:
            return _mix(whole[: len(buf) - k + 1])
        part = part[:-m] * _U(pow(_BASE, m, 1 << 64)) + part[m:]
        m *= 2


def _least(key: np.ndarray, w: int) -> np.ndarray:
    """The minimum of each w neighbours."""
    span = 1
    while 2 * span <= w:
        key = np.minimum(key[:-span], key[span:])
        span *= 2
    return key if span == w else np.minimum(key[: len(key) - (w - span)], key[w - span :])


class Bucket:
    """The texts of a bucket, in the order of their rows, as one buffer."""

    def __init__(self, t: pa.Table):
        import zstandard

        d = zstandard.ZstdDecompressor()
        ids = t.column("id").combine_chunks()
        doc, row = ids.fill_null(LAST).to_numpy(zero_copy_only=False), t.column("row").to_numpy()
        order = np.lexsort((row, doc))
        z = t.column("z").combine_chunks()
        self.ids, self.doc, self.row = ids.take(pa.array(order)), doc[order], row[order]
        texts = [d.decompress(z[i].as_buffer()) for i in order.tolist()]
        self.end = np.cumsum([len(x) for x in texts])
        self.begin = self.end - [len(x) for x in texts]
        self.text = b"".join(texts)
        self.buf = np.frombuffer(self.text, np.uint8)
        self.number = t.column("bucket")[0].as_py()

    def anchors(self, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of each anchor: its first and last window, its place and the hash of its gram."""
        gram = gram_of(window)
        whole = np.ones(len(self.buf), bool)
        for b, e in zip(self.begin.tolist(), self.end.tolist()):
            whole[max(b, e - window + 1) : e] = False
        firsts, places, grams = [], [], []
        for c in range(0, len(self.buf) - window + 1, STEP):
            ok = np.flatnonzero(whole[c : c + STEP])
            if not len(ok):
                continue
            h = hashes(self.buf[c : c + STEP + window - 1], gram)
            at = (_least((h & ~_LOW) | np.arange(len(h), dtype=np.uint64), window - gram + 1)[ok] & _LOW).astype(np.int64)
            new = np.r_[True, at[1:] != at[:-1]]
            firsts.append(ok[new] + c)
            places.append(at[new] + c)
            grams.append(h[at[new]])
        if not firsts:
            none = np.empty(0, np.int64)
            return none, none, none, none.view(np.uint64)
        first, place, g = np.concatenate(firsts), np.concatenate(places), np.concatenate(grams)
        new = np.r_[True, place[1:] != place[:-1]]
        first, place, g = first[new], place[new], g[new]
        last = np.minimum(np.r_[first[1:] - 1, len(self.buf)], self.end[self.rows(first)] - window)
        return first, last, place, g

    def rows(self, positions: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.end, positions, side="right")


def _keys(h: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct (slot, 32 bits) as one number, the place of each hash among them and how many hashes each has."""
    return np.unique(h >> _U(32 - bits), return_inverse=True, return_counts=True)


def _to_slots(bucket: int, keys: np.ndarray) -> pa.Table:
    slot, low = (keys >> _U(32)).astype(np.int64), keys.astype("<u4")
    s, e = _parts(slot)
    return pa.table({"slot": pa.array(slot[s], pa.int32()), "bucket": pa.array([bucket] * len(s), pa.int32()), "keys": pa.array([_squeezed(low[i:j]) for i, j in zip(s, e)], pa.binary())})


def _in_slot(t: pa.Table) -> pa.Table:
    """Tells each bucket which of its keys other buckets have too."""
    lists = [_expanded(x.as_buffer()) for x in t.column("keys")]
    values, counts = np.unique(np.concatenate(lists), return_counts=True)
    shared = values[counts > 1]
    flags = [np.isin(x, shared, assume_unique=True) for x in lists]
    keep = [i for i, f in enumerate(flags) if f.any()]
    rows = pa.array(keep, pa.int32())
    return pa.table({"bucket": t.column("bucket").take(rows), "slot": t.column("slot").take(rows), "flags": pa.array([np.packbits(flags[i]).tobytes() for i in keep], pa.binary())})


SLOTS, FLAGS = "slot int, bucket int, keys binary", "bucket int, slot int, flags binary"


def _passed(h: np.ndarray, answers: pa.Table, bits: int) -> np.ndarray:
    """Which hashes occur more than once, here or in other buckets."""
    keys, place, n = _keys(h, bits)
    s, e = _parts(keys >> _U(32))
    of = dict(zip((keys[s] >> _U(32)).tolist(), zip(s.tolist(), e.tolist())))
    live = n > 1
    for slot, x in zip(answers.column("slot").to_pylist(), answers.column("flags")):
        i, j = of[slot]
        live[i:j] |= np.unpackbits(np.frombuffer(x.as_buffer(), np.uint8), count=j - i).astype(bool)
    return live[place]


def _first_of(*columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Classes of equal rows: the class of each row, and the first row of each class."""
    order = np.lexsort(columns[::-1])  # stable: the first row of a class leads it
    new = np.zeros(len(order), bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[order][1:] != c[order][:-1]
    of = np.empty(len(order), np.int64)
    of[order] = np.cumsum(new) - 1
    return of, order[new]


def lengths_of(window: int) -> list[int]:
    """The lengths that rounds reach: 16, doubled up to the window."""
    out = [16]
    while out[-1] < window:
        out.append(min(2 * out[-1], window))
    return out


def _needed(windows: np.ndarray, lengths: list[int], k: int) -> np.ndarray:
    """The positions whose rank at lengths[k] the windows' ranks are made of."""
    for j in range(len(lengths) - 2, k - 1, -1):
        windows = np.union1d(windows, windows + (lengths[j + 1] - lengths[j]))
    return windows


def _numbers(buf: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The 8 bytes at each position as a number."""
    out = np.zeros(len(at), np.uint64)
    for k in range(8):
        out = (out << _U(8)) | buf[at + k]
    return out


def _u64(raw) -> np.ndarray:
    return _from_planes(raw).view(np.uint64)


STATE = "bucket int, n long, windows binary, at binary, ranks binary"


def _state(bucket: int, n: int, windows: np.ndarray, at: np.ndarray, ranks: bytes) -> pa.Table:
    """A bucket's windows and the ranks of the positions still in play, at the length last reached; before any, its bytes. n: its pairs for the next."""
    cols = {"windows": _squeezed(windows), "at": _squeezed(at), "ranks": _small(ranks)}
    return pa.table({"bucket": pa.array([bucket], pa.int32()), "n": pa.array([n], pa.int64()), **{c: pa.array([v], pa.binary()) for c, v in cols.items()}})


def _small(raw: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(raw)


def _large(value) -> bytes:
    import zstandard

    return zstandard.ZstdDecompressor().decompress(value.as_buffer())


def _pair_up(windows: np.ndarray, at: np.ndarray, ranks: np.ndarray, lengths: list[int], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The positions whose pair stands for lengths[k] bytes, and the two ranks; where one has none, the string occurs once."""
    nxt = _needed(windows, lengths, k)

    def look(positions: np.ndarray) -> np.ndarray:
        i = np.minimum(np.searchsorted(at, positions), len(at) - 1)
        return np.where(at[i] == positions, ranks[i], _U(0))

    if not len(at):
        return at, ranks, ranks
    x, y = look(nxt), look(nxt + (lengths[k] - lengths[k - 1]))
    both = (x > 0) & (y > 0)
    return nxt[both], x[both], y[both]


class _Pairs:
    """A bucket's distinct pairs for lengths[k], dealt to `parts`: class of each position, and the classes of each part in order."""

    def __init__(self, state: pa.Table, parts: int, lengths: list[int], k: int):
        row = {c: state.column(c)[0] for c in ("windows", "at", "ranks")}
        self.windows, at = (_expanded(row[c].as_buffer()).astype(np.int64) for c in ("windows", "at"))
        if k:
            self.at, x, y = _pair_up(self.windows, at, _u64(_large(row["ranks"])), lengths, k)
        else:
            buf = np.frombuffer(_large(row["ranks"]), np.uint8)
            self.at = _needed(self.windows, lengths, 0)
            x, y = _numbers(buf, self.at), _numbers(buf, self.at + 8)
        self.of, self.first, starts = _classes(x, y, parts)
        self.x, self.y = x[self.first], y[self.first]
        self.n = np.bincount(self.of, minlength=len(self.first))
        self.lots = [(part, slice(i, j)) for part, i, j in starts]


def _classes(x: np.ndarray, y: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int, int]]]:
    """The class of each pair, a member of each class, and which classes go to which part; classes are in the order of a hash, and a part is a range of it."""
    h = _mix(x ^ _mix(y))
    order = np.argsort(h)
    for again in (False, True):
        if again:  # different pairs met on one hash
            order = np.lexsort((y, x, h))
        hs, xs, ys = h[order], x[order], y[order]
        new = np.r_[True, (xs[1:] != xs[:-1]) | (ys[1:] != ys[:-1])][: len(order)]
        if not (new[1:] & (hs[1:] == hs[:-1])).any():
            break
    of = np.empty(len(order), np.int64)
    of[order] = np.cumsum(new) - 1
    part = ((hs[new] >> _U(32)) * _U(parts) >> _U(32)).astype(np.int64)
    s, e = _parts(part)
    return of, order[new], list(zip(part[s].tolist(), s.tolist(), e.tolist()))


def remove_repeats(docs: DataFrame, text: str = "text", id_column: str = "doc_id", window: int = WINDOW, with_text: bool = False, spans: bool = False, bucket_bytes: int = BUCKET_BYTES, slot_keys: int = SLOT_KEYS, part_pairs: int = PART_PAIRS) -> DataFrame:
    """Per row: id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256 (of what is left) and, if asked for, kept (the bytes
    left, which may begin or end inside a character) and spans (first byte, bytes)."""
    if not 16 <= window <= STEP:
        raise ValueError(f"window must be from 16 to {STEP} bytes")
    spark, lengths = docs.sparkSession, lengths_of(window)
    total = docs.agg(F.sum(F.octet_length(text))).head()[0] or 0
    buckets = max(1, -(-total // bucket_bytes))
    bits = max(4, int(np.ceil(np.log2(max(1, total / 32 / slot_keys)))))
    packed = _packed(docs, text, id_column, buckets)

    def sieve_out(t: pa.Table) -> pa.Table:
        b = Bucket(t)
        out = _to_slots(b.number, _keys(b.anchors(window)[3], bits)[0])
        del b
        give_back()
        return out

    flags = cut(packed.groupBy("bucket").applyInArrow(sieve_out, SLOTS).groupBy("slot").applyInArrow(_in_slot, FLAGS))
    release(spark)

    def segments(t: pa.Table, answers: pa.Table) -> pa.Table:
        """One row for each segment of the bucket, at its first occurrence, and one with the windows of all others."""
        names = ["g", "d1", "d2", "id", "row", "first", "last"]
        schema = pa.schema([("bucket", pa.int32()), ("runs", pa.binary()), ("g", pa.int32()), *[(c, pa.int64()) for c in names[1:]]])
        if not t.num_rows:
            return schema.empty_table()
        b = Bucket(t)
        first, last, place, g = b.anchors(window)
        live = _passed(g, answers, bits) if len(g) else np.empty(0, bool)
        first, last, place, g = first[live], last[live], place[live], g[live]
        name = b"".join([hashlib.blake2b(b.text[i:j], digest_size=16, salt=int(o).to_bytes(4, "little")).digest() for i, j, o in zip(first.tolist(), (last + window).tolist(), (place - first).tolist())])
        d = np.frombuffer(name, "<i8").reshape(-1, 2)
        _, head = _first_of(d[:, 0], d[:, 1])
        head.sort()
        rest = np.ones(len(first), bool)
        rest[head] = False
        row = b.rows(first[head])
        cols = [(g[head] >> _U(32)).astype(np.uint32).view(np.int32), d[head, 0], d[head, 1], b.doc[row], b.row[row], first[head], last[head]]
        one = pa.table({"bucket": pa.array([b.number], pa.int32()), "runs": pa.array([_runs(first[rest], last[rest])], pa.binary()), "g": pa.nulls(1, pa.int32()), **{c: pa.nulls(1, pa.int64()) for c in names[1:]}}, schema=schema)
        many = pa.table({"bucket": pa.array(np.full(len(head), b.number, np.int32)), "runs": pa.nulls(len(head), pa.binary()), **{c: pa.array(v) for c, v in zip(names, cols)}}, schema=schema)
        del b, name
        give_back()
        return pa.concat_tables([one, many])

    schema = "bucket int, runs binary, g int, d1 long, d2 long, id long, row long, first long, last long"
    kept = Written(packed.groupBy("bucket").cogroup(flags.groupBy("bucket")).applyInArrow(segments, schema))
    release(spark)
    found = kept.table
    rows = found.filter("runs is null").drop("runs")
    earliest = rows.groupBy("d1", "d2").agg(F.min(F.struct("id", "row", "first")).alias("lead"), F.first("g").alias("g"))
    several = earliest.groupBy("g").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("g", F.lit(True).alias("open"))
    named = earliest.join(several, "g", "left").select("d1", "d2", "lead", "open")
    told = rows.join(named, ["d1", "d2"]).withColumn("leads", F.struct("id", "row", "first") == F.col("lead"))
    told = cut(told.filter("not leads or open").select("bucket", "first", "last", "leads"))
    release(spark)

    def gather(t: pa.Table, answers: pa.Table) -> pa.Table:
        """The texts of the windows to be sorted out, as stretches of neighbours."""
        import zstandard

        schema = pa.schema([("bucket", pa.int32()), ("z", pa.binary()), ("n", pa.binary()), ("start", pa.binary()), ("id", pa.binary()), ("row", pa.binary())])
        if not t.num_rows or not answers.num_rows:
            return schema.empty_table()
        b = Bucket(t)
        first, last = (answers.column(c).to_numpy().astype(np.int64) for c in ("first", "last"))
        order = np.argsort(first)
        first, last = first[order], last[order]
        new = np.r_[True, first[1:] != last[:-1] + 1]
        new |= b.rows(first) != np.r_[-1, b.rows(first)[:-1]]
        begin, end = first[new], last[np.r_[np.flatnonzero(new)[1:] - 1, len(first) - 1]] + window
        row = b.rows(begin)
        z = zstandard.ZstdCompressor(level=1).compress(b"".join([b.text[i:j] for i, j in zip(begin.tolist(), end.tolist())]))
        cols = [z, _planes(end - begin), _planes(begin), _planes(b.doc[row]), _planes(b.row[row])]
        out = pa.table([pa.array([b.number], pa.int32()), *[pa.array([c], pa.binary()) for c in cols]], schema=schema)
        del b
        give_back()
        return out

    stretches = cut(packed.groupBy("bucket").cogroup(told.filter("leads").groupBy("bucket")).applyInArrow(gather, "bucket int, z binary, n binary, start binary, id binary, row binary"))
    release(spark)
    gone = cut(found.filter("runs is not null").select("bucket", "runs").unionByName(told.filter("not leads").select("bucket", "first", "last").groupBy("bucket").applyInArrow(_as_runs, RUNS)))
    del found, rows, earliest, several, named, told
    kept.drop()
    release(spark)
    late = _doubled(stretches, window, lengths, bits, part_pairs)
    if late is not None:
        gone = cut(gone.unionByName(late))
    del late, stretches
    release(spark)

    def apply(t: pa.Table, answers: pa.Table) -> pa.Table:
        b = Bucket(t)
        edges = np.zeros(len(b.buf) + 1, np.int32)
        for x in answers.column("runs"):
            first, last = _from_runs(x.as_buffer())
            np.add.at(edges, first, 1)
            np.add.at(edges, last + window, -1)
        covered = np.cumsum(edges[:-1]) > 0
        removed, n_spans, kept, runs = [], [], [], []
        for i, j in zip(b.begin.tolist(), b.end.tolist()):
            mine = covered[i:j]
            n = int(mine.sum())
            edge = np.flatnonzero(np.diff(np.r_[False, mine, False].astype(np.int8))).reshape(-1, 2) if n else np.empty((0, 2), np.int64)
            removed.append(n)
            n_spans.append(len(edge))
            kept.append(b.buf[i:j][~mine].tobytes() if n else b.text[i:j])
            runs.append([{"first": x, "bytes": y - x} for x, y in edge.tolist()] if spans else None)
        cols = {"id": b.ids, "n_bytes": pa.array(b.end - b.begin, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "n_spans": pa.array(n_spans, pa.int64()), "kept_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in kept], pa.string())}
        if with_text:
            cols["kept"] = pa.array(kept, pa.binary())
        if spans:
            cols["spans"] = pa.array(runs, pa.list_(pa.struct([("first", pa.int64()), ("bytes", pa.int64())])))
        del b, kept
        give_back()
        return pa.table(cols)

    schema = "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_text + ", spans array<struct<first: bigint, bytes: bigint>>" * spans
    return packed.groupBy("bucket").cogroup(gone.groupBy("bucket")).applyInArrow(apply, schema).withColumnRenamed("id", id_column)


RUNS = "bucket int, runs binary"


def _runs(first: np.ndarray, last: np.ndarray) -> bytes:
    """Runs of windows, in order."""
    order = np.argsort(first)
    return _squeezed(first[order]) + _squeezed(last[order])


def _from_runs(raw) -> tuple[np.ndarray, np.ndarray]:
    half = len(raw) // 2
    return _expanded(raw[:half]).astype(np.int64), _expanded(raw[half:]).astype(np.int64)


def _as_runs(t: pa.Table) -> pa.Table:
    return pa.table({"bucket": t.column("bucket").slice(0, 1), "runs": pa.array([_runs(*[t.column(c).to_numpy().astype(np.int64) for c in ("first", "last")])], pa.binary())})


def _packed(docs: DataFrame, text: str, id_column: str, buckets: int) -> DataFrame:
    """(bucket, id, row, z): each row's number in the table and its compressed bytes, cut, dealt by bucket."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        c = zstandard.ZstdCompressor(level=1)
        for b in batches:
            for k in range(0, b.num_rows, 1000):
                part = b.slice(k, 1000)
                z = [c.compress((x or "").encode()) for x in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(z, pa.binary())], ["id", "row", "z"])
        give_back()

    number = fresh(docs, "_row")
    rows = docs.withColumn(number, F.monotonically_increasing_id()).select(F.col(id_column).cast("long").alias("id"), F.col(number).alias("row"), F.col(text).cast("string"))
    dealt = rows.mapInArrow(pack, "id long, row long, z binary").withColumn("bucket", F.pmod(F.xxhash64(F.lit(11), "row"), F.lit(buckets)).cast("int"))
    return cut_by(dealt, min(buckets, MAX_PARTITIONS), "bucket")


def _doubled(stretches: DataFrame, window: int, lengths: list[int], bits: int, part_pairs: int) -> DataFrame | None:
    """The runs of windows (bucket, runs) in the stretches that an equal one precedes."""

    def texts(t: pa.Table) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
        """Bucket, bytes, the windows' positions in them and the lengths of the stretches."""
        import zstandard

        buf = np.frombuffer(zstandard.ZstdDecompressor().decompress(t.column("z")[0].as_buffer()), np.uint8)
        n = _from_planes(t.column("n")[0].as_buffer())
        whole = np.ones(len(buf), bool)
        for e in np.cumsum(n).tolist():
            whole[e - window + 1 : e] = False
        return t.column("bucket")[0].as_py(), buf, np.flatnonzero(whole), n

    def hashed(buf: np.ndarray, windows: np.ndarray) -> np.ndarray:
        out, at = [], 0
        for c in range(0, len(buf) - window + 1, STEP):
            to = int(np.searchsorted(windows, c + STEP))
            out.append(hashes(buf[c : c + STEP + window - 1], window)[windows[at:to] - c])
            at = to
        return np.concatenate(out)

    def sieve_out(t: pa.Table) -> pa.Table:
        b, buf, windows, _ = texts(t)
        return _to_slots(b, _keys(hashed(buf, windows), bits)[0])

    def start(t: pa.Table, answers: pa.Table) -> pa.Table:
        if not t.num_rows:
            return _state(0, 0, *[np.empty(0, np.uint64)] * 2, b"").slice(0, 0)
        b, buf, windows, _ = texts(t)
        windows = windows[_passed(hashed(buf, windows), answers, bits)]
        out = _state(b, len(_needed(windows, lengths, 0)), windows, np.empty(0, np.int64), buf.tobytes())
        give_back()
        return out

    flags = stretches.groupBy("bucket").applyInArrow(sieve_out, SLOTS).groupBy("slot").applyInArrow(_in_slot, FLAGS)
    state = cut(stretches.groupBy("bucket").cogroup(flags.groupBy("bucket")).applyInArrow(start, STATE).filter("n > 0"))
    for k in range(len(lengths)):
        n = state.agg(F.sum("n")).head()[0]
        if not n:
            return None
        parts = -(-n // part_pairs)
        if k + 1 == len(lengths):
            return _last(state, stretches, parts, lengths)
        state = cut(_round(state, parts, lengths, k).filter("n > 0"))
        release(stretches.sparkSession)


def _round(state: DataFrame, parts: int, lengths: list[int], k: int) -> DataFrame:
    """Ranks the pairs that stand for lengths[k] bytes."""

    def out(t: pa.Table) -> pa.Table:
        p, b = _Pairs(t, parts, lengths, k), t.column("bucket")[0].as_py()
        rows = [(part, _small(_planes(p.x[c].view(np.int64)) + _planes(p.y[c].view(np.int64))), np.packbits(p.n[c] > 1).tobytes()) for part, c in p.lots]
        cols = list(zip(*rows)) or [()] * 3
        give_back()
        return pa.table({"part": pa.array(cols[0], pa.int32()), "bucket": pa.array([b] * len(rows), pa.int32()), "pairs": pa.array(cols[1], pa.binary()), "twice": pa.array(cols[2], pa.binary())})

    def rank(t: pa.Table) -> pa.Table:
        """Sorted pairs that occur more than once are numbered; the others get zero."""
        pairs = [_u64(_halves) for v in t.column("pairs") for raw in [_large(v)] for _halves in (raw[: len(raw) // 2], raw[len(raw) // 2 :])]
        xs, ys = pairs[::2], pairs[1::2]
        twice = np.concatenate([np.unpackbits(np.frombuffer(v.as_buffer(), np.uint8), count=len(x)) for v, x in zip(t.column("twice"), xs)])
        of, first = _first_of(np.concatenate(xs), np.concatenate(ys))
        n = np.bincount(of, weights=1 + twice, minlength=len(first))
        ranks = np.where(n > 1, (t.column("part")[0].as_py() << 40) + 1 + np.arange(len(first)), 0)[of]
        end = np.cumsum([len(x) for x in xs])
        return pa.table({"bucket": t.column("bucket"), "part": t.column("part"), "ranks": pa.array([_small(_planes(ranks[j - len(x) : j])) for x, j in zip(xs, end.tolist())], pa.binary())})

    def merge(t: pa.Table, answers: pa.Table) -> pa.Table:
        p, told = _Pairs(t, parts, lengths, k), dict(zip(answers.column("part").to_pylist(), answers.column("ranks")))
        rank_of = np.zeros(len(p.first), np.uint64)
        for part, c in p.lots:
            rank_of[c] = _u64(_large(told[part]))
        ranks = rank_of[p.of]
        at, ranks = p.at[ranks > 0], ranks[ranks > 0]
        n = len(_pair_up(p.windows, at, ranks, lengths, k + 1)[0])
        res = _state(t.column("bucket")[0].as_py(), n, p.windows, at, _planes(ranks.view(np.int64)))
        give_back()
        return res

    ranks = state.groupBy("bucket").applyInArrow(out, "part int, bucket int, pairs binary, twice binary").groupBy("part").applyInArrow(rank, "bucket int, part int, ranks binary")
    return state.groupBy("bucket").cogroup(ranks.groupBy("bucket")).applyInArrow(merge, STATE)


def _last(state: DataFrame, stretches: DataFrame, parts: int, lengths: list[int]) -> DataFrame:
    """The windows whose pair, which now stands for all their bytes, an earlier one has."""

    def owners(t: pa.Table, positions: np.ndarray) -> tuple[np.ndarray, ...]:
        """Document, row and place in the bucket of positions in a bucket's stretches."""
        n, start, doc, row = (_from_planes(t.column(c)[0].as_buffer()) for c in ("lengths", "start", "id", "row"))
        end = np.cumsum(n)
        s = np.searchsorted(end, positions, side="right")
        return doc[s], row[s], start[s] + positions - (end - n)[s]

    def earliest(p: _Pairs, t: pa.Table) -> tuple[np.ndarray, ...]:
        """Of each class the first window, in the order of the bucket, which is that of its documents."""
        doc, row, place = owners(t, p.at)
        order = np.argsort(place, kind="stable")[::-1]
        first = np.empty(len(p.first), np.int64)
        first[p.of[order]] = order
        return doc, row, place, first

    def out(t: pa.Table) -> pa.Table:
        schema = pa.schema([("part", pa.int32()), ("bucket", pa.int32()), *[(c, pa.binary()) for c in ("x", "y", "id", "row")]])
        p, b = _Pairs(t, parts, lengths, len(lengths) - 1), t.column("bucket")[0].as_py()
        doc, row, _, first = earliest(p, t)
        rows = [(part, b, *[_planes(v) for v in (p.x[c].view(np.int64), p.y[c].view(np.int64), doc[first[c]], row[first[c]])]) for part, c in p.lots]
        return pa.table([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    def judge(t: pa.Table) -> pa.Table:
        x, y, doc, row = ([_from_planes(v.as_buffer()) for v in t.column(c)] for c in ("x", "y", "id", "row"))
        at, (x, y, doc, row) = np.cumsum([0, *map(len, x)]), map(np.concatenate, (x, y, doc, row))
        order = np.lexsort((row, doc, y, x))
        later = np.zeros(len(order), bool)
        later[order[1:]] = (x[order][1:] == x[order][:-1]) & (y[order][1:] == y[order][:-1])
        return pa.table({"bucket": t.column("bucket"), "part": t.column("part"), "later": pa.array([np.packbits(later[i:j]).tobytes() for i, j in zip(at[:-1], at[1:])], pa.binary())})

    def told(t: pa.Table, answers: pa.Table) -> pa.Table:
        p = _Pairs(t, parts, lengths, len(lengths) - 1)
        flags = dict(zip(answers.column("part").to_pylist(), answers.column("later")))
        _, _, place, first = earliest(p, t)
        later = np.zeros(len(p.first), bool)
        for part, c in p.lots:
            later[c] = np.unpackbits(np.frombuffer(flags[part].as_buffer(), np.uint8), count=c.stop - c.start).astype(bool)
        gone = np.ones(len(p.at), bool)  # within the bucket, all but the first of a class
        gone[first] = later
        w = np.sort(place[gone])
        new = np.flatnonzero(np.r_[True, w[1:] != w[:-1] + 1][: len(w)])
        give_back()
        return pa.table({"bucket": t.column("bucket"), "runs": pa.array([_runs(w[new], w[np.r_[new[1:] - 1, len(w) - 1]] if len(w) else w)], pa.binary())})

    full = cut(state.join(stretches.select("bucket", F.col("n").alias("lengths"), "start", "id", "row"), "bucket"))
    later = full.groupBy("bucket").applyInArrow(out, "part int, bucket int, x binary, y binary, id binary, row binary").groupBy("part").applyInArrow(judge, "bucket int, part int, later binary")
    return full.groupBy("bucket").cogroup(later.groupBy("bucket")).applyInArrow(told, RUNS)
