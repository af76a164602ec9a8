"""Training-order materialisation of token ids as fixed-stride binary shards.

Each input partition is a stream of documents, ids with a closing id, cut into sequences of `length` ids (the last one of a
partition is padded with `pad`). Partition counts (one number each) give every sequence its place in the stream of all, and a
keyed Feistel permutation over the next even power of two, walked along its cycle until it falls inside the count, gives
that place a global slot: a bijection, computed for each sequence on its own, without a sort of random numbers.

Slots are dealt by range: shard s holds slots [s * per_shard, (s + 1) * per_shard) and is one file, slot after slot, each
2 * length bytes, so slot k of a shard starts at byte 2 * length * k and a reader resumes anywhere. A partition is a range of
whole shards whose rows come sorted by slot and are written as they come, so a task holds one batch of them whatever a shard's
size. A file is written under a name of its own attempt and moved into place when whole, so a task that runs twice or is lost
half-way leaves no partial shard; a failed attempt removes its file, and what lost ones left goes when the next run begins. With
`resume`, a shard that is there already is compared with its rows, slot by slot: it stays if all are equal, else it is written
anew from the first that differs. manifest.json holds what a reader needs.

Defined results: a null or empty text is its closing id alone; repeated rows, and rows that repeat an id or have none, are
written each; the stream follows the table's own order; an empty table gives no slot and no shard. Paths may be of any file
system that pyarrow opens by URI; one run at a time writes to a path.
"""

from __future__ import annotations

import hashlib
import json
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyarrow.fs import FileSelector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstream.llm.common import checkpoint_dir, cut, lots
from quillstream.llm.tokens import END_ID, encoder

LENGTH = 2048
PAD = 0
PER_SHARD = 4096
KEY = "training-order"
ROUNDS = 6
#: Partitions of the shuffle by range; beyond so many shards, a partition takes several.
MAX_PARTITIONS = 20_000
UNFINISHED = ".unfinished"


class Feistel:
    """A keyed bijection of 0..n-1."""

    def __init__(self, n: int, key: str = KEY):
        self.n = n
        self.half = max(1, -(-max(1, (n - 1).bit_length()) // 2))
        self.keys = [int.from_bytes(hashlib.blake2b(f"{key}:{r}".encode(), digest_size=8).digest(), "big") | 1 for r in range(ROUNDS)]
        self.mask = np.uint64((1 << self.half) - 1)

    def _round(self, x: np.ndarray, key: int) -> np.ndarray:
        z = (x + np.uint64(key)) * np.uint64(0x9E3779B97F4A7C15)
        z = (z ^ (z >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        return (z ^ (z >> np.uint64(32))) & self.mask

    def _once(self, x: np.ndarray, keys: list[int]) -> np.ndarray:
        half = np.uint64(self.half)
        left, right = x >> half, x & self.mask
        for k in keys:
            left, right = right, left ^ self._round(right, k)
        return (right << half) | left

    def _walk(self, x: np.ndarray, keys: list[int]) -> np.ndarray:
        x = self._once(np.asarray(x, np.uint64), keys)
        while (out := x >= np.uint64(self.n)).any():
            x[out] = self._once(x[out], keys)
        return x.astype(np.int64)

    def slots(self, x: np.ndarray) -> np.ndarray:
        return self._walk(x, self.keys)

    def places(self, slots: np.ndarray) -> np.ndarray:
        """The inverse: which place of the stream a slot holds."""
        return self._walk(slots, self.keys[::-1])


def sequences(docs: DataFrame, text: str = "text", id_column: str = "doc_id", length: int = LENGTH, pad: int = PAD, vocabulary: str | None = None) -> DataFrame:
    """part, k, n (ids before padding), docs (ids of the documents, in order), z (zstd of `length` little-endian uint16 ids)."""

    def run(batches):
        import zstandard
        from pyspark import TaskContext

        part, k = TaskContext.get().partitionId(), 0
        enc, z = encoder(vocabulary), zstandard.ZstdCompressor(level=1)
        end = np.array([END_ID], "<u2").tobytes()
        rest, owners = b"", []
        rows: list[tuple] = []

        def batch():
            cols = list(zip(*rows)) if rows else [[]] * 4
            rb = pa.RecordBatch.from_arrays([pa.array([part] * len(rows), pa.int32()), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.list_(pa.int64())), pa.array(cols[3], pa.binary())], ["part", "k", "n", "docs", "z"])
            rows.clear()
            return rb

        for b in lots(batches):
            ids = b.column(0).to_pylist()
            for doc, raw in zip(ids, enc.encode(b.column(1).to_pylist())):
                rest += raw + end
                owners.append(doc)
                while len(rest) >= 2 * length:
                    rows.append((k, length, owners, z.compress(rest[: 2 * length])))
                    rest, k = rest[2 * length :], k + 1
                    owners = [doc] if rest else []
            yield batch()
        if rest:
            n = len(rest) // 2
            rows.append((k, n, owners, z.compress(rest + np.full(length - n, pad, "<u2").tobytes())))
            yield batch()

    return docs.select(F.col(id_column).cast("long").alias("id"), F.col(text)).mapInArrow(run, "part int, k long, n int, docs array<long>, z binary")


def _files(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def write_shards(docs: DataFrame, path: str, text: str = "text", id_column: str = "doc_id", length: int = LENGTH, pad: int = PAD, per_shard: int = PER_SHARD, key: str = KEY, vocabulary: str | None = None, resume: bool = False) -> DataFrame:
    """Writes the shards under path and returns slot, sequence, shard, row, n_tokens, doc_ids, ids_crc32 for each slot (crc32 of its bytes in the file)."""
    spark = docs.sparkSession
    rows = cut(sequences(docs, text, id_column, length, pad, vocabulary))
    counts = {r["part"]: r["n"] for r in rows.groupBy("part").agg((F.max("k") + 1).alias("n")).collect()}  # one number for each partition
    n = sum(counts.values())
    bases, at = {}, 0
    for p in sorted(counts):
        bases[p], at = at, at + counts[p]
    schema = "slot long, sequence long, shard int, row int, n_tokens long, doc_ids array<long>, ids_crc32 long"
    files, root = _files(path)
    files.create_dir(root, recursive=True)
    for info in files.get_file_info(FileSelector(root)):
        if info.base_name.endswith(UNFINISHED):
            files.delete_file(info.path)
    with files.open_output_stream(f"{root}/manifest.json") as f:
        f.write(json.dumps({"sequences": n, "length": length, "bytes_per_id": 2, "per_shard": per_shard, "shards": -(-n // per_shard), "pad": pad, "key_sha256": hashlib.sha256(key.encode()).hexdigest()}).encode())
    if not n:
        return spark.createDataFrame([], schema)
    order = Feistel(n, key)
    base = np.zeros(max(bases) + 1, np.int64)
    for p, b in bases.items():
        base[p] = b

    def place(batches):
        for b in batches:
            seq = base[b.column(0).to_numpy()] + b.column(1).to_numpy()
            slot = order.slots(seq)
            yield pa.RecordBatch.from_arrays([pa.array(slot // per_shard, pa.int32()), pa.array(slot, pa.int64()), pa.array(seq, pa.int64()), b.column(2), b.column(3), b.column(4)], ["shard", "slot", "sequence", "n", "docs", "z"])

    def write(batches):
        import zstandard

        fs_, top = _files(path)
        d, shard = zstandard.ZstdDecompressor(), None
        for b in lots(batches, 256):
            slots = b.column(1).to_numpy()
            raw = [d.decompress(z.as_buffer()) for z in b.column(5)]
            for slot, x in zip(slots.tolist(), raw):
                if shard is None or slot // per_shard != shard.number:
                    if shard:
                        shard.finish()
                    shard = _Shard(fs_, top, slot // per_shard, resume)
                shard.put(x)
            cols = [b.column(1), b.column(2), b.column(0), pa.array((slots % per_shard).astype(np.int32)), b.column(3).cast(pa.int64()), b.column(4), pa.array([zlib.crc32(x) for x in raw], pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, ["slot", "sequence", "shard", "row", "n_tokens", "doc_ids", "ids_crc32"])
        if shard:
            shard.finish()

    shards = -(-n // per_shard)
    each = -(-shards // MAX_PARTITIONS)  # shards in a partition
    placed = rows.mapInArrow(place, "shard int, slot long, sequence long, n int, docs array<long>, z binary")
    ranged = placed.repartitionById(-(-shards // each), F.floor(F.col("shard") / each).cast("int")).sortWithinPartitions("slot")
    return ranged.mapInArrow(write, schema)


class _Shard:
    """One shard's file while its slots come in order."""

    def __init__(self, fs_, top: str, number: int, resume: bool):
        self.fs, self.number, self.name = fs_, number, f"{top}/shard-{number:08d}.bin"
        self.own = f"{top}/.{number:08d}-{uuid.uuid4().hex}{UNFINISHED}"
        self.old = fs_.open_input_file(self.name) if resume and fs_.get_file_info(self.name).is_file else None
        self.new, self.same = None, 0  # bytes of the old file that are as they should be

    def _write(self, x: bytes) -> None:
        try:
            self.new.write(x)
        except BaseException:
            self.drop()
            raise

    def _anew(self) -> None:
        self.new = self.fs.open_output_stream(self.own)
        if self.old:
            self.old.seek(0)
            for at in range(0, self.same, 1 << 20):
                self._write(self.old.read(min(1 << 20, self.same - at)))

    def put(self, x: bytes) -> None:
        if self.new is None and self.old is not None:
            if self.old.read(len(x)) == x:
                self.same += len(x)
                return
            self._anew()
        elif self.new is None:
            self._anew()
        self._write(x)

    def finish(self) -> None:
        if self.new is None and self.old.size() != self.same:  # longer than it should be
            self._anew()
        if self.new is not None:
            self.new.close()
            self.fs.move(self.own, self.name)

    def drop(self) -> None:
        self.new.close()
        self.fs.delete_file(self.own)


def read_slots(path: str, start: int, count: int) -> np.ndarray:
    """Sequences of consecutive slots, by seeks into the shards."""
    files, root = _files(path)
    with files.open_input_file(f"{root}/manifest.json") as f:
        m = json.loads(f.read())
    out = []
    stride = m["length"] * m["bytes_per_id"]
    for slot in range(start, min(start + count, m["sequences"])):
        with files.open_input_file(f"{root}/shard-{slot // m['per_shard']:08d}.bin") as f:
            f.seek(stride * (slot % m["per_shard"]))
            out.append(np.frombuffer(f.read(stride), "<u2"))
    return np.array(out)


def output_path(spark: SparkSession) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/training-order-{uuid.uuid4().hex}"
