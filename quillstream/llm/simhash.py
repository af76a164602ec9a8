"""SimHash near-duplicates by a self-join of binary tries.

Fingerprints: 64 bits, from the XXH64 of every 3-word shingle. Two texts link at no more than `budget` (3) differing
bits. Equal fingerprints are one row before anything is joined, so a group of copies of any size costs one fingerprint.

The join: a fingerprint's 64 bits are cut into budget + 1 blocks; two that link agree in one block at least. For each
block the fingerprints are rotated so that it leads, and those that share it form one trie over the other bits. The trie is
walked by pairs of nodes from the root: each step goes to the children of both nodes, adds a differing bit where they
take different branches, and drops the pair once the budget is exceeded. Nodes are ranges of a sorted array and all pairs
of a depth advance together. A block value shared by more than `group_rows` fingerprints is cut again by the blocks of
its remaining bits (which again must agree in one), until groups are small or no bits are left to cut, so one hot group
is spread over many tasks without forming its pairs. Each task returns a spanning forest of its links, never all pairs.

Components: hashed forest edges are contracted by alternating large-star and small-star steps with checkpoints.

Defined results: a null text is empty; a text without words has fingerprint zero and links like any other; with fewer
words than a shingle the whole sequence is the shingle; repeated rows share a component; an empty table gives none.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillstream.llm.common import cut, give_back, lots, text_or_empty
from quillstream.llm.decontaminate import checked_broadcast

SEED = 42
WORDS = 3
BUDGET = 3
#: The pipeline stage: shingle length, Jaccard threshold, and the bits that fingerprints of two such texts may differ in. Each bit differs with a
#: probability of at most 3/16 (4 of 5 shingles; about 0.151 for long texts), more than 28 of 64 with 1.1e-6 at most.
STAGE_WORDS, STAGE_PERCENT, STAGE_BUDGET = 5, 80, 28
#: Texts that agree in one of BLOCKS parts of the fingerprint are compared early if they differ in few bits; only an order of work hangs on it.
BLOCKS, EARLY_BUDGET = 4, 12
#: Counters of the sketch that orders shingles by how frequent they are, and the chunks that they are added up in.
COUNTERS, CHUNKS = 1 << 20, 64
_U = np.uint64


def fingerprint(text: str | None, words: int = WORDS, seed: int = SEED) -> int:
    """As an unsigned number."""
    from xxhash import xxh64_intdigest

    w = (text or "").encode().lower().split()  # bytes: lower() and split() know ASCII only
    if not w:
        return 0
    if len(w) < words:
        shingles = [b" ".join(w)]
    else:
        shingles = [b" ".join(x) for x in zip(*[w[i:] for i in range(words)])]
    return majority(np.fromiter((xxh64_intdigest(s, seed) for s in shingles), np.uint64, len(shingles)))


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half the hashes, as an unsigned number."""
    counts = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 65536):
        h = hashes[k : k + 65536].astype(">u8")
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(hashes)).tobytes(), "big")


def fingerprints(df: DataFrame, text: str = "text", id_column: str = "doc_id") -> DataFrame:
    """id, fp (the 64 bits as a signed long)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in lots(batches):
            fps = np.array([fingerprint(t) for t in b.column(1).to_pylist()], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array(fps)], ["id", "fp"])

    return df.select(F.col(id_column).cast("long").alias("id"), F.col(text)).mapInArrow(run, "id long, fp long")


class Forest:
    """Union-find over 0..n-1 that takes edges in bulk and keeps those that joined two trees."""

    def __init__(self, n: int):
        self.parent = np.arange(n, dtype=np.int64)

    def roots(self, x: np.ndarray) -> np.ndarray:
        p = self.parent
        r = p[x]
        while True:
            up = p[r]
            if (up == r).all():
                break
            r = up
        p[x] = r
        return r

    def add(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The links that joined trees, as pairs of roots; with all former ones they span the same components."""
        outs = []
        while len(a):
            a, b = self.roots(a), self.roots(b)
            low, high = np.minimum(a, b), np.maximum(a, b)
            apart = low != high
            low, high = low[apart], high[apart]
            if not len(low):
                break
            high, first = np.unique(high, return_index=True)  # each tree is hung once a round
            hung = low[first]
            self.parent[high] = hung
            outs.append((hung, high))
            a, b = a[apart], b[apart]
        if not outs:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        return np.concatenate([x for x, _ in outs]), np.concatenate([y for _, y in outs])


def _popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)


def trie_pairs(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, depth: int, budget: int = BUDGET, at_once: int = 200_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (indices) of values of a range that differ in at most `budget` bits, in lots.

    values: sorted within each range [starts, ends), whose members agree in their first `depth` bits; equal ones are pairs too. Pairs of nodes are
    walked depth first in lots of at_once, so memory is bounded whatever a range's shape.
    """
    big = ends - starts > 1
    stack = [(depth, starts[big], ends[big], starts[big], ends[big], np.zeros(int(big.sum()), np.int8))]
    while stack:
        d, a0, a1, b0, b1, used = stack.pop()
        if len(a0) > at_once:
            for k in range(0, len(a0), at_once):
                stack.append((d, *(x[k : k + at_once] for x in (a0, a1, b0, b1, used))))
            continue
        # two single leaves are compared at once
        leaf = (a1 - a0 == 1) & (b1 - b0 == 1)
        if leaf.any():
            x, y = a0[leaf], b0[leaf]
            close = (x != y) & (_popcount(values[x] ^ values[y]) <= budget)
            if close.any():
                yield x[close], y[close]
            rest = ~leaf
            a0, a1, b0, b1, used = a0[rest], a1[rest], b0[rest], b1[rest], used[rest]
        if not len(a0):
            continue
        if d >= 64:  # the values of a node are equal: each of one with each of the other
            for i, j, k, m in zip(a0.tolist(), a1.tolist(), b0.tolist(), b1.tolist()):
                other = np.arange(k, m)
                for x in range(i, j):
                    y = other[other > x] if i == k else other
                    if len(y):
                        yield np.full(len(y), x), y
            continue
        am, bm = _middle(values, a0, a1, d), _middle(values, b0, b1, d)
        own = a0 == b0
        parts = (
            (a0, am, b0, bm, used, None),
            (am, a1, bm, b1, used, None),
            (a0, am, bm, b1, used + 1, None),
            (am, a1, b0, bm, used + 1, ~own),
        )
        nxt = []
        for p0, p1, q0, q1, u, where in parts:
            ok = (p1 > p0) & (q1 > q0) & (u <= budget) & ~((p0 == q0) & (p1 - p0 == 1))
            if where is not None:
                ok &= where
            nxt.append(tuple(x[ok] for x in (p0, p1, q0, q1, u)))
        stack.append((d + 1, *(np.concatenate(x) for x in zip(*nxt))))


def trie_links(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, depth: int, budget: int = BUDGET, at_once: int = 200_000) -> tuple[np.ndarray, np.ndarray]:
    """Spanning forest (indices) of the links between values, found by trie_pairs."""
    forest = Forest(len(values))
    found = [forest.add(x, y) for x, y in trie_pairs(values, starts, ends, depth, budget, at_once)]
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate([x for x, _ in found]), np.concatenate([y for _, y in found])


def _middle(values: np.ndarray, lo: np.ndarray, hi: np.ndarray, d: int) -> np.ndarray:
    """For each node (range that agrees above bit d) where its right child begins."""
    bit = _U(1 << (63 - d))
    lo, hi = lo.copy(), hi.copy()
    while True:  # all binary searches advance together
        open_ = lo < hi
        if not open_.any():
            return lo
        mid = (lo + hi) >> 1
        right = np.zeros(len(lo), bool)
        right[open_] = (values[mid[open_]] & bit) == 0
        lo = np.where(open_ & right, mid + 1, lo)
        hi = np.where(open_ & ~right, mid, hi)


def _join_partition(budget: int):
    """Rows (path, part, bits, fp...) of one partition, sorted by path, prefix and bits, to forest edges between fingerprints."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0

        def flush(rows: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            if not rows:
                return
            t = pa.Table.from_batches(rows)
            path, key, bits, fp = (t.column(c).to_numpy() for c in ("path", "key", "bits", "fp"))
            for p in np.unique(path):
                m = path == p
                k, v, f = key[m], bits[m].view(np.uint64), fp[m]
                order = np.lexsort((v, k))
                k, v, f = k[order], v[order], f[order]
                cutp = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
                x, y = trie_links(v, cutp, np.r_[cutp[1:], len(k)], 0, budget)
                if len(x):
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(f[x], f[y])), pa.array(np.maximum(f[x], f[y]))], ["a", "b"])

        last = None
        for b in batches:
            # whole groups only: rows come sorted by (path, key)
            held.append(b)
            size += b.num_rows
            if size >= 200_000:
                t = pa.Table.from_batches(held)
                path, key = t.column("path").to_numpy(), t.column("key").to_numpy()
                same = (path == path[-1]) & (key == key[-1])
                first = int(np.flatnonzero(~same)[-1]) + 1 if (~same).any() else 0
                if first:
                    yield from flush(t.slice(0, first).to_batches())
                    held = t.slice(first).to_batches()
                    size = t.num_rows - first
        yield from flush(held)

    return run


def _rotated(df: DataFrame, bits: int, budget: int) -> DataFrame:
    """From rows (path, key, bits, left, fp) with `bits` free leading bits to one row for each of budget + 1 blocks: the block joins the key, the other bits move up."""
    size = bits // (budget + 1)
    outs = []
    for k in range(budget + 1):
        lo = k * size
        width = size if k < budget else bits - lo
        outs.append(F.struct((F.col("path") * (budget + 1) + F.lit(k + 1)).alias("path"), _block(F.col("bits"), lo, width).alias("block"), _without(F.col("bits"), lo, width).alias("bits")))
    return df.withColumn("_o", F.explode(F.array(*outs))).select(F.col("_o.path").alias("path"), F.xxhash64("key", F.col("_o.path"), F.col("_o.block")).alias("key"), F.col("_o.bits").alias("bits"), "fp")


def _block(x, lo: int, width: int):
    return F.shiftrightunsigned(F.shiftleft(x, lo), 64 - width)


def _without(x, lo: int, width: int):
    """x without `width` bits from lo on; the bits after them move up and zeros come in below."""
    head = F.shiftleft(F.shiftrightunsigned(x, 64 - lo), 64 - lo) if lo else F.lit(0).cast("long")
    tail = F.shiftrightunsigned(F.shiftleft(x, lo + width), lo) if lo + width < 64 else F.lit(0).cast("long")
    return head.bitwiseOR(tail)


def links(fps: DataFrame, budget: int = BUDGET, group_rows: int = 20_000) -> DataFrame:
    """Forest edges (a, b) between the distinct fingerprints in column fp."""
    base = fps.select(F.lit(0).cast("long").alias("path"), F.lit(0).cast("long").alias("key"), F.col("fp").alias("bits"), "fp")
    edges = None
    free = 64
    rows = base
    while True:
        # all blocks but the last have the same width; the last may be wider, so `free` is the most that is left
        parts = cut(_rotated(rows, free, budget))
        free -= free // (budget + 1)
        hot = parts.groupBy("path", "key").count().filter(F.col("count") > group_rows) if free // (budget + 1) > 1 else None
        hot = cut(hot.select("path", "key")) if hot is not None else None
        any_hot = hot is not None and not hot.isEmpty()
        cool = parts.join(hot, ["path", "key"], "left_anti") if any_hot else parts
        found = cool.repartition("path", "key").sortWithinPartitions("path", "key").mapInArrow(_join_partition(budget), "a long, b long")
        edges = found if edges is None else edges.unionByName(found)
        if not any_hot:
            return edges.distinct()
        rows = parts.join(hot, ["path", "key"], "left_semi")


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of an edge: root is the smallest node reachable, in signed order.

    Alternating large-star and small-star steps (Kiveris and others, 2014). Each neighbourhood is reduced to its minimum by an
    aggregate that combines before it shuffles; the minima are a table of their own before they are joined back, so that Spark can split the edges of
    a node that has many.
    """
    e = cut(edges.select("a", "b").filter("a <> b").distinct())
    if e.isEmpty():
        return e.select(F.col("a").alias("node"), F.col("b").alias("root"))
    for _ in range(max_rounds):
        both = e.union(e.select("b", "a")).toDF("u", "v")
        low = cut(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))
        # large star: larger neighbours go to the smallest
        large = cut(both.filter("v > u").join(low, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct())
        # small star: smaller neighbours and the node itself go to the smallest
        low2 = cut(large.groupBy("a").agg(F.min("b").alias("m")))
        small = large.join(low2, "a").select(F.explode(F.array(F.struct(F.col("a").alias("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("x")).select("x.a", "x.b").filter("a <> b").distinct()
        e = cut(small)
        # done when each node but the roots has one edge, to a root; edges go to smaller nodes, so a root is its component's smallest
        ends = e.select(F.col("a").alias("u"), F.lit(1).alias("own")).union(e.select("b", F.lit(0))).groupBy("u").agg(F.sum("own").alias("own"), F.min("own").alias("least"))
        if not ends.filter("own > 1 or own > least").agg(F.count(F.lit(1))).head()[0]:
            break
    else:
        raise RuntimeError("components: not contracted after max_rounds rounds")
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).union(e.select(F.col("b"), F.col("b")).distinct())


def near_duplicates(df: DataFrame, text: str = "text", id_column: str = "doc_id", budget: int = BUDGET) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (the smallest doc_id reachable)."""
    fps = cut(fingerprints(df, text, id_column))
    distinct = fps.groupBy("fp").agg(F.min("id").alias("first"))
    roots = components(links(distinct.select("fp"), budget))
    joined = distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = joined.groupBy("root").agg(F.min("first").alias("component_id"))
    by_fp = joined.join(least, "root").select("fp", "component_id")
    return fps.join(by_fp, "fp").select(F.col("id").alias(id_column), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def shingle_set(text: str | None, words: int = STAGE_WORDS, seed: int = SEED) -> np.ndarray:
    """Sorted distinct hashes of the shingles; words as in fingerprint()."""
    from xxhash import xxh64_intdigest

    w = (text or "").encode().lower().split()
    if not w:
        return np.empty(0, np.uint64)
    shingles = {b" ".join(w)} if len(w) < words else {b" ".join(x) for x in zip(*[w[i:] for i in range(words)])}
    return np.unique(np.fromiter((xxh64_intdigest(s, seed) for s in shingles), np.uint64, len(shingles)))


def _node(shingles: np.ndarray) -> int:
    from xxhash import xxh64_intdigest

    return int(np.uint64(xxh64_intdigest(shingles.tobytes(), SEED)).astype(np.int64))


def _slots(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> _U(40)).astype(np.int64) & (COUNTERS - 1)


def frequencies(docs: DataFrame) -> np.ndarray:
    """For each counter the length in bits of the number of shingles of rows (text) that fall on it; one byte for each comes to the driver, a fixed number."""
    size = COUNTERS // CHUNKS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(COUNTERS, np.uint32)
        for b in lots(batches):
            sets = [shingle_set(t) for t in b.column(0).to_pylist()]
            if sets:
                counts += np.bincount(_slots(np.concatenate(sets)), minlength=COUNTERS).astype(np.uint32)
        packed = [zlib.compress(c.tobytes(), 1) for c in counts.reshape(CHUNKS, size)]
        yield pa.RecordBatch.from_arrays([pa.array(range(CHUNKS), pa.int32()), pa.array(packed, pa.binary())], ["chunk", "counts"])

    def add(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for b in batches:
            for x in b.column("counts"):
                total += np.frombuffer(zlib.decompress(x.as_buffer()), np.uint32)
        bits = np.ceil(np.log2(total + 1)).astype(np.uint8)
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([bits.tobytes()], pa.binary())], ["chunk", "bits"])

    out = np.zeros((CHUNKS, size), np.uint8)
    for r in docs.select("text").mapInArrow(count, "chunk int, counts binary").groupBy("chunk").applyInArrow(add, "chunk int, bits binary").collect():
        out[r["chunk"]] = np.frombuffer(r["bits"], np.uint8)
    return out.reshape(-1)


def _signatures(bits: np.ndarray):
    """Rows (t, text) to t, node, n, fp, the mean of the shingles' bits of frequency, and the shingles from the rarest, as many as another set that reaches the threshold must share one of."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in lots(batches):
            node, n, fp, mean, rare = [], [], [], [], []
            for t in b.column(1).to_pylist():
                s = shingle_set(t)
                often = bits[_slots(s)]
                first = len(s) - (STAGE_PERCENT * len(s) + 99) // 100 + 1
                node.append(_node(s))
                n.append(len(s))
                fp.append(majority(s) if len(s) else 0)
                mean.append(float(often.mean()) if len(s) else 0.0)
                rare.append(s[np.argsort(often, kind="stable")[:first]].tobytes())
            fps = pa.array(np.array(fp, np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(node, pa.int64()), pa.array(n, pa.int32()), fps, pa.array(mean, pa.float32()), pa.array(rare, pa.binary())], ["t", "node", "n", "fp", "mean", "rare"])

    return run


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each of a node's rare shingles, with its place among the node's own, and one for each block of its fingerprint, without a place."""
    width = 64 // BLOCKS
    for b in lots(batches):
        fp = b.column("fp").to_numpy()
        blocks = [(fp.view(np.uint64) >> _U(width * k) & _U((1 << width) - 1) | _U(k << width)) * _U(0x9E3779B97F4A7C15) for k in range(BLOCKS)]
        full = np.flatnonzero(b.column("n").to_numpy() > 0)
        rare = [np.frombuffer(x.as_buffer(), np.int64) for x in b.column("rare")]
        size = np.array([len(x) for x in rare], np.int64)
        row = np.concatenate([np.repeat(np.arange(len(rare)), size), *[full] * BLOCKS])
        key = np.concatenate([*rare, *[x[full].view(np.int64) for x in blocks]])
        at = np.concatenate([np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size), np.full(BLOCKS * len(full), -1)])
        own = b.select(["node", "n", "fp", "mean"]).take(pa.array(row))
        yield pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(at, pa.int32()), *own.columns], ["key", "at", "node", "n", "fp", "mean"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in lots(batches):
        sets = [shingle_set(t) for t in b.column(0).to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array([_node(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], ["node", "shingles"])


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of pairs (a, b, x, y) those whose sets x and y reach the Jaccard threshold."""
    for batch in lots(batches):
        close = []
        for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
            x, y = np.frombuffer(x, _U), np.frombuffer(y, _U)
            both = len(np.intersect1d(x, y, assume_unique=True))
            close.append(100 * both >= STAGE_PERCENT * (len(x) + len(y) - both))
        yield batch.select(["a", "b"]).filter(pa.array(close, pa.bool_()))


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) of nodes whose shingle sets have a Jaccard similarity of the threshold at least.

    Both sides of a join are tables of their own, so Spark splits the pairs of a node that has many.
    """
    one = pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("x")), "a")
    two = one.join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("y")), "b")
    return cut(two.select("a", "b", "x", "y").mapInArrow(_near, "a long, b long"))


def _reaches(x, y):
    """Whether an overlap of x is enough for two sets of y shingles together."""
    return 100 * x >= STAGE_PERCENT * (y - x)


def _whole_groups(batches: Iterator[pa.RecordBatch], rows: int = 200_000) -> Iterator[pa.Table]:
    """The batches, which come sorted by key, in tables of whole groups."""
    held: list[pa.RecordBatch] = []
    size = 0
    for b in batches:
        held.append(b)
        size += b.num_rows
        if size >= rows:
            t = pa.Table.from_batches(held)
            other = np.flatnonzero(t.column("key").to_numpy() != t.column("key")[-1].as_py())
            if len(other):
                yield t.slice(0, int(other[-1]) + 1)
                held = t.slice(int(other[-1]) + 1).to_batches()
                size = sum(x.num_rows for x in held)
    if held:
        yield pa.Table.from_batches(held)


def _apart(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, at, node, n, fp, part), sorted by key, to pairs (a, b) of different parts: a group's fingerprints form a trie, whose
    self-join gives those within the budget; of these stay the pairs whose sizes and places let them reach the threshold."""
    for whole in _whole_groups(batches):
        key, at, node, n, fp, part = (whole.column(c).to_numpy() for c in ("key", "at", "node", "n", "fp", "part"))
        order = np.lexsort((fp.view(np.uint64), key))
        key, at, node, n, v, part = key[order], at[order].astype(np.int64), node[order], n[order].astype(np.int64), fp[order].view(np.uint64), part[order]
        starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        mixed = np.minimum.reduceat(part, starts) != np.maximum.reduceat(part, starts)
        for x, y in trie_pairs(v, starts[mixed], np.r_[starts[1:], len(key)][mixed], 0, STAGE_BUDGET):
            can = (part[x] != part[y]) & (100 * np.minimum(n[x], n[y]) >= STAGE_PERCENT * np.maximum(n[x], n[y])) & _reaches(np.minimum(n[x] - at[x], n[y] - at[y]), n[x] + n[y])
            if can.any():
                u, w = node[x[can]], node[y[can]]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(u, w)), pa.array(np.maximum(u, w))], ["a", "b"])
    give_back()


def jaccard_links(sigs: DataFrame, docs: DataFrame, group_rows: int = 10_000) -> DataFrame:
    """Edges (a, b), found by fingerprints and verified, that span the components of nodes (distinct shingle sets) at the threshold.

    At the threshold two fingerprints may differ in 28 bits, which no block of bits survives, so tries are formed over the nodes that share one of their
    rarest shingles; two sets that reach the threshold share one for certain. Each trie is joined with itself by pairs of nodes within that budget, and
    where the sets meet first, what is left of both must still be able to reach the overlap. Texts that are alike but not alike enough, each by changes
    of its own, form no pairs then.

    Before that a group's members, and those of a block of the fingerprint, are compared with one of them, that whose shingles are most frequent: among near copies
    it is the text with the fewest changes, so most are joined in as many comparisons as there are members, and tries are walked for what is still apart.
    A trie of more than group_rows fingerprints is dealt out by pairs of its parts.
    """
    nodes = sigs.groupBy("node").agg(*[F.first(c).alias(c) for c in ("n", "fp", "mean", "rare")])
    group = Window.partitionBy("key")
    rows = nodes.mapInArrow(_members, "key long, at int, node long, n int, fp long, mean float")
    lead = F.max(F.struct("mean", "node", "n", "fp", "at")).over(group).alias("lead")
    shared = cut(rows.select("key", "at", "node", "n", "fp", F.count(F.lit(1)).over(group).alias("c"), lead).filter("c > 1"))

    like = 100 * F.least("n", "lead.n") >= STAGE_PERCENT * F.greatest("n", "lead.n")
    bits = F.bit_count(F.col("fp").bitwiseXOR(F.col("lead.fp")))
    near = F.when(F.col("at") < 0, bits <= EARLY_BUDGET).otherwise((bits <= STAGE_BUDGET) & _reaches(F.least(F.col("n") - F.col("at"), F.col("lead.n") - F.col("lead.at")), F.col("n") + F.col("lead.n")))
    star = shared.filter((F.col("node") != F.col("lead.node")) & like & near)
    star = cut(star.select(F.least("node", "lead.node").alias("a"), F.greatest("node", "lead.node").alias("b")).distinct())
    roots = cut(components(_verified(star, _sets_of(star, sigs, docs))))

    placed = shared.filter("at >= 0").join(roots, "node", "left").withColumn("part", F.coalesce("root", "node"))
    parts = F.ceil(F.col("c") / group_rows)
    own = F.pmod(F.xxhash64("node"), parts)
    dealt = placed.withColumn("_own", own).withColumn("_with", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)))
    key = F.when(parts == 1, F.col("key")).otherwise(F.xxhash64("key", F.least("_own", "_with"), F.greatest("_own", "_with")))
    tries = dealt.select(key.alias("key"), "at", "node", "n", "fp", "part").repartition("key").sortWithinPartitions("key")
    pairs = cut(tries.mapInArrow(_apart, "a long, b long").distinct().join(star, ["a", "b"], "left_anti"))
    more = _verified(pairs, _sets_of(pairs, sigs, docs))
    return roots.filter("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more)


def _sets_of(pairs: DataFrame, sigs: DataFrame, docs: DataFrame) -> DataFrame:
    """node, shingles of the nodes in pairs (a, b), from one text of each."""
    named = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    wanted = cut(sigs.select("node", "t").join(named, "node", "left_semi").groupBy("node").agg(F.min("t").alias("t")).select("t"))
    read = docs.join(checked_broadcast(wanted), "t", "left_semi").select("text")
    return cut(read.mapInArrow(_sets, "node long, shingles binary").dropDuplicates(["node"]))


def drop_near_duplicates(df: DataFrame, text: str = "text", id_column: str = "doc_id") -> DataFrame:
    """One row of each component of texts at a 5-word-shingle Jaccard similarity of 0.8 and more stays: one that bears the component's smallest id, or
    any one where none has an id. Rows that repeat a text, whatever their ids, are of one component; so are rows without any word.

    Links are exact on shingle hashes. A pair of similarity 0.8 and more may go unseen only where its fingerprints differ in more bits than the budget, with a
    probability of 1.1e-6 at most. Texts with equal shingle sets always share a component. A text is known by the 128 bits of its MD5 sum between the steps.
    """
    name = F.unhex(F.md5(text_or_empty(text)))
    docs = df.select(F.col(id_column).cast("long").alias("id"), name.alias("t"), text_or_empty(text).alias("text"))
    signed = docs.select("t", "text").mapInArrow(_signatures(frequencies(docs)), "t binary, node long, n int, fp long, mean float, rare binary")
    sigs = cut(signed)
    roots = components(jaccard_links(sigs, docs.select("t", "text")))
    by_text = sigs.groupBy("t").agg(F.first("node").alias("node")).join(roots, "node", "left").select("t", F.coalesce("root", "node").alias("root"))
    first = docs.groupBy("t").agg(F.min("id").alias("first"))
    # of a component, the text that holds the smallest id; one text of a component is enough, so texts are compared by name
    best = F.min(F.struct(F.col("first").isNull().alias("none"), "first", "t")).alias("best")
    keep = cut(by_text.join(first, "t").groupBy("root").agg(best).select(F.col("best.t").alias("_t"), F.col("best.first").alias("_first")))
    rows = df.withColumn("_t", name).join(keep, "_t").filter(F.col(id_column).cast("long").eqNullSafe(F.col("_first")))
    return rows.dropDuplicates(["_t"]).select(*df.columns)
