"""Exact substring dedup with prefix-partitioned suffix trees.

A window is `WINDOW` (13) consecutive words of one document. Words covered by a window whose word sequence also
starts in a document with a smaller id are removed.

Every word position starts a suffix; of its path in the suffix tree the first 13 words decide. Two suffixes that agree in 13
words meet in an internal node at least that deep, and following a document's windows that end in such nodes gives its
maximal repeats, which `spans` returns.

1. Documents are dealt into buckets of a bounded size. A bucket finds its equal windows, word for word, and keeps one
   suffix of each, with the least id of its documents, so a passage in any number of documents is one suffix a bucket.
2. Sieve: a bucket's windows go, four hash bytes each, to slots by their leading hash bits, which are uniform; a slot
   tells each bucket which of its windows other buckets may have too. All others are leaves without a deep node above.
   A chance agreement of hashes lets a suffix pass for nothing; it never joins two.
3. Prefix partition: sieved suffixes, as words, go to groups by their first 4 words. Where a group would exceed
   `group_suffixes`, it is split by the first 8 words, or by all 13 where one 8-word prefix alone would exceed it, so
   prefixes have variable length. Which groups those are is estimated from the sieved suffixes of `SAMPLED` buckets (the
   bound of the sample): that decides how groups are cut, never what is found.
   Each group sorts its suffixes; neighbours that agree in all 13 words are the leaves of one deep node.
4. Buckets apply the answers to their own texts.

Defined results: null or empty texts have no words; texts under 13 words lose nothing; rows that repeat an id never remove
each other's words; a row without id comes after all others, and such rows don't remove each other's words; an empty table
gives an empty result.
"""

from __future__ import annotations

import hashlib
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstream.llm.common import cut, give_back, release

WINDOW = 13
PREFIXES = (4, 8)
BUCKET_BYTES = 8_000_000
GROUP_SUFFIXES = 400_000
SLOT_WINDOWS = 1_000_000
SAMPLED = 4
#: The place of rows without id.
LAST = np.iinfo(np.int64).max
_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15)
_INVERSE = _U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
#: What each byte counts in the polynomial.
_BYTE = np.random.default_rng(13).integers(0, 1 << 64, 256, dtype=np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def normal(text: str | None) -> bytes:
    """Words (runs without ASCII white space) joined by single spaces."""
    return b" ".join((text or "").encode().split())


def _word_hashes(buf: np.ndarray, start: np.ndarray, end: np.ndarray, lot: int = 1 << 18) -> np.ndarray:
    """A hash of each word's bytes, from running sums of a polynomial over lots of whole words."""
    out = np.empty(len(start), np.uint64)
    i, size = 0, 0
    while i < len(start):
        j = max(i + 1, int(np.searchsorted(end, start[i] + lot)))
        a, n = start[i], int(end[j - 1] - start[i]) + 1
        if n > size:
            size = max(n, lot)
            up, down = np.full(size, _BASE), np.full(size, _INVERSE)
            up[0] = down[0] = 1
            np.multiply.accumulate(up, out=up)
            np.multiply.accumulate(down, out=down)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTE[buf[a : a + n]] * up[:n], out=sums[1:])
        s, e = start[i:j] - a, end[i:j] - a
        out[i:j] = _mix((sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64) * _U(0xD6E8FEB86659FD93))
        i = j
    return out


class Suffixes:
    """The windows of a bucket's texts in classes of equal word sequences, numbered by their hashes.

    n_words: of each text; at, doc: word and text of each window; of: its class; head: a window of each class; least: the
    smallest of `ids` among its texts; h4, h8, h13: hashes of each class's first words. Hashes only bring windows
    together; the bytes of their words decide whether they are equal.
    """

    def __init__(self, texts: list[bytes], ids: np.ndarray, window: int = WINDOW):
        self.window = window
        self.n_words = np.array([t.count(b" ") + 1 if t else 0 for t in texts], np.int64)
        self.first_word = np.cumsum(self.n_words) - self.n_words
        self.text = b" ".join([t for t in texts if t]) + b" "
        buf = np.frombuffer(self.text, np.uint8)
        self.end = np.flatnonzero(buf == 32) if self.n_words.sum() else np.empty(0, np.int64)
        self.start = np.r_[0, self.end[:-1] + 1] if len(self.end) else self.end
        owner = np.repeat(np.arange(len(texts)), self.n_words)
        if len(owner) >= window:
            self.at = np.flatnonzero(owner[: len(owner) - window + 1] == owner[window - 1 :])
        else:
            self.at = np.empty(0, np.int64)
        self.doc = owner[self.at]
        hashed = _word_hashes(buf, self.start, self.end)
        n = max(0, len(owner) - window + 1)
        h, kept = np.zeros(n, np.uint64), {}
        for k in range(window):
            h *= _BASE
            h += hashed[k : k + n]
            if k + 1 in (*PREFIXES, window):
                kept[k + 1] = _mix(h[self.at])
        order = np.argsort(kept[window], kind="stable")
        same = kept[window][order]
        new = np.r_[True, same[1:] != same[:-1]] if len(order) else np.empty(0, bool)
        self._by_words(order, new)
        self.of = np.empty(len(order), np.int64)
        self.of[order] = np.cumsum(new) - 1
        starts = np.flatnonzero(new)
        self.head = order[starts]
        self.least = np.minimum.reduceat(ids[self.doc[order]], starts) if len(starts) else np.empty(0, np.int64)
        self.h4, self.h8, self.h13 = (kept[k][self.head] for k in (*PREFIXES, window))

    def _words(self, windows: np.ndarray) -> list[bytes]:
        text = self.text
        a, b = self.start[self.at[windows]], self.end[self.at[windows] + self.window - 1]
        return [text[i:j] for i, j in zip(a.tolist(), b.tolist())]

    def _by_words(self, order: np.ndarray, new: np.ndarray) -> None:
        """Compares windows of equal hashes word for word; where they differ, `order` and `new` (where classes begin) are mended."""
        if not len(order):
            return
        rest = np.flatnonzero(~new)
        head = order[np.flatnonzero(new)][np.cumsum(new) - 1][rest]
        differ: list[np.ndarray] = []
        for k in range(0, len(rest), 100_000):
            pairs = zip(self._words(order[rest[k : k + 100_000]]), self._words(head[k : k + 100_000]))
            differ.append(np.fromiter((x != y for x, y in pairs), bool))
        met_by_chance = rest[np.concatenate(differ)] if differ else rest
        starts = np.flatnonzero(new)
        for group in np.unique(np.searchsorted(starts, met_by_chance, side="right") - 1):
            i, j = int(starts[group]), int(starts[group + 1]) if group + 1 < len(starts) else len(order)
            by_words = sorted(zip(self._words(order[i:j]), order[i:j].tolist()))
            order[i:j] = [w for _, w in by_words]
            new[i + 1 : j] = [x[0] != y[0] for x, y in zip(by_words[1:], by_words)]

    def words(self, classes: np.ndarray) -> list[bytes]:
        """The words of some classes, joined by single spaces."""
        return self._words(self.head[classes])


def _sieve_keys(p: Suffixes, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct (slot, 32 hash bits) as one number, and the place of each class among them."""
    return np.unique(p.h13 >> _U(32 - bits), return_inverse=True)


def _unpacked(t: pa.Table) -> tuple[np.ndarray, list[bytes], pa.Array]:
    """Order keys, texts and ids of a bucket, in an order that does not depend on how its rows arrived."""
    import zstandard

    d = zstandard.ZstdDecompressor()
    ids = t.column("id").combine_chunks()
    keys = ids.fill_null(LAST).to_numpy(zero_copy_only=False)
    texts = [d.decompress(z.as_buffer()) for z in t.column("z")]
    order = sorted(range(len(texts)), key=lambda i: (keys[i], texts[i]))
    return keys[order], [texts[i] for i in order], ids.take(pa.array(order, pa.int64()))


def _squeezed(x: np.ndarray) -> bytes:
    """Ascending 32-bit numbers as the byte planes of their differences, whose high planes are mostly zero for the shuffle's compressor."""
    return np.diff(x.astype(np.uint32), prepend=np.uint32(0)).astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def _expanded(raw) -> np.ndarray:
    planes = np.frombuffer(raw, np.uint8).reshape(4, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u4").ravel(), dtype=np.uint32)


def _planes(x: np.ndarray) -> bytes:
    return x.astype("<i8").view(np.uint8).reshape(-1, 8).T.tobytes()


def _from_planes(raw) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(8, -1).T).view("<i8").ravel()


def _parts(sorted_: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts = np.flatnonzero(np.r_[True, sorted_[1:] != sorted_[:-1]]) if len(sorted_) else np.empty(0, np.int64)
    return starts, np.r_[starts[1:], len(sorted_)].astype(np.int64)


def _packed(docs: DataFrame, text: str, id_column: str, buckets: int, first: int | None = None) -> DataFrame:
    """(bucket, id, z): the compressed words of each row, of the `first` buckets only if given."""

    def pack(batches):
        import zstandard

        c = zstandard.ZstdCompressor(level=1)
        for b in batches:
            for k in range(0, b.num_rows, 1000):
                part = b.slice(k, 1000)
                z = [c.compress(normal(x)) for x in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(z, pa.binary())], ["bucket", "id", "z"])
        give_back()

    bucket = F.pmod(F.xxhash64(F.lit(10), F.col(id_column), F.col(text)), F.lit(buckets)).cast("int")
    rows = docs if first is None else docs.filter(bucket < first)
    return rows.select(bucket.alias("bucket"), F.col(id_column).cast("long").alias("id"), F.col(text)).mapInArrow(pack, "bucket int, id long, z binary")


class _Cuts:
    """How sieved suffixes are dealt: 2^bits groups by 4-word prefixes; those in `split` in parts, by 8 or by all words."""

    def __init__(self, bits: int, split: dict[int, tuple[int, bool]]):
        self.bits, self.split = bits, split

    def group(self, h4: np.ndarray) -> np.ndarray:
        return (h4 >> _U(64 - self.bits)).astype(np.int64)

    def __call__(self, p: Suffixes, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        group = self.group(p.h4[classes])
        sub = np.zeros(len(group), np.int64)
        for g, (parts, whole) in self.split.items():
            own = group == g
            sub[own] = ((p.h13 if whole else p.h8)[classes[own]] % _U(parts)).astype(np.int64)
        return group, sub


def _flagged(p: Suffixes, answers: pa.Table, bits: int) -> np.ndarray:
    """Classes that passed the sieve."""
    keys, place = _sieve_keys(p, bits)
    s, e = _parts(keys >> _U(32))
    range_of = dict(zip((keys[s] >> _U(32)).tolist(), zip(s.tolist(), e.tolist())))
    passed = np.zeros(len(keys), bool)
    for slot, x in zip(answers.column("slot").to_pylist(), answers.column("flags")):
        i, j = range_of[slot]
        passed[i:j] = np.unpackbits(np.frombuffer(x.as_buffer(), np.uint8), count=j - i).astype(bool)
    return np.flatnonzero(passed[place]) if len(place) else np.empty(0, np.int64)


def remove_repeats(docs: DataFrame, text: str = "text", id_column: str = "doc_id", window: int = WINDOW, with_text: bool = False, spans: bool = False, bucket_bytes: int = BUCKET_BYTES, group_suffixes: int = GROUP_SUFFIXES, slot_windows: int = SLOT_WINDOWS) -> DataFrame:
    """Per row: id, n_words, n_removed, kept_sha256 (of the kept words joined by one space) and, if asked for, kept_text and
    spans: the document's maximal repeats (first word, words) whose windows start in a document with a smaller id too."""
    if window <= max(PREFIXES):
        raise ValueError(f"window must exceed {max(PREFIXES)} words")
    total = docs.agg(F.sum(F.octet_length(text))).head()[0] or 0
    buckets = max(1, -(-total // bucket_bytes))
    bits = max(4, int(np.ceil(np.log2(max(1, total / 6 / slot_windows)))))
    packed = _packed(docs, text, id_column, buckets)

    def sieve_out(t: pa.Table) -> pa.Table:
        ids, texts, _ = _unpacked(t)
        keys, _ = _sieve_keys(Suffixes(texts, ids, window), bits)
        slot = (keys >> _U(32)).astype(np.int64)
        low = keys.astype("<u4")
        s, e = _parts(slot)
        b = t.column("bucket")[0].as_py()
        give_back()
        return pa.table({"slot": pa.array(slot[s], pa.int32()), "bucket": pa.array([b] * len(s), pa.int32()), "keys": pa.array([_squeezed(low[i:j]) for i, j in zip(s, e)], pa.binary())})

    def sieve_in(t: pa.Table) -> pa.Table:
        blobs = [_expanded(x.as_buffer()) for x in t.column("keys")]
        values, counts = np.unique(np.concatenate(blobs), return_counts=True)
        shared = values[counts > 1]
        flags, n = [], []
        for x in blobs:
            k = np.searchsorted(shared, x)
            f = (k < len(shared)) & (shared[np.minimum(k, max(0, len(shared) - 1))] == x) if len(shared) else np.zeros(len(x), bool)
            n.append(int(f.sum()))
            flags.append(np.packbits(f).tobytes())
        keep = [i for i, c in enumerate(n) if c]
        rows = pa.array(keep, pa.int32())
        return pa.table({"bucket": t.column("bucket").take(rows), "slot": t.column("slot").take(rows), "flags": pa.array([flags[i] for i in keep], pa.binary()), "n": pa.array([n[i] for i in keep], pa.int64())})

    sieved = cut(packed.groupBy("bucket").applyInArrow(sieve_out, "slot int, bucket int, keys binary").groupBy("slot").applyInArrow(sieve_in, "bucket int, slot int, flags binary, n long"))
    release(docs.sparkSession)
    some = min(SAMPLED, buckets)
    cuts = _cuts(_packed(docs, text, id_column, buckets, some), sieved, buckets, some, bits, window, group_suffixes)
    release(docs.sparkSession)

    def tree_out(t: pa.Table, answers: pa.Table) -> pa.Table:
        import zstandard

        schema = pa.schema([("part", pa.int32()), ("sub", pa.int32()), ("bucket", pa.int32()), ("place", pa.binary()), ("doc", pa.binary()), ("words", pa.binary())])
        if not t.num_rows or not answers.num_rows:
            return schema.empty_table()
        ids, texts, _ = _unpacked(t)
        p = Suffixes(texts, ids, window)
        c = _flagged(p, answers, bits)
        group, sub = cuts(p, c)
        order = np.lexsort((c, sub, group))
        c, group, sub = c[order], group[order], sub[order]
        z = zstandard.ZstdCompressor(level=1)
        s, e = _parts(group * (1 << 31) + sub)
        b = t.column("bucket")[0].as_py()
        rows = [(_squeezed(c[i:j]), _planes(p.least[c[i:j]]), z.compress(b"\n".join(p.words(c[i:j])))) for i, j in zip(s, e)]
        out = pa.table({"part": pa.array(group[s], pa.int32()), "sub": pa.array(sub[s], pa.int32()), "bucket": pa.array([b] * len(s), pa.int32()), **{k: pa.array([r[i] for r in rows], pa.binary()) for i, k in enumerate(("place", "doc", "words"))}}, schema=schema)
        del p, texts
        give_back()
        return out

    def tree_in(t: pa.Table) -> pa.Table:
        """The subtrees of one group: suffixes in order, deep nodes with two leaves or more, their least document."""
        import zstandard

        d = zstandard.ZstdDecompressor()
        place = [_expanded(x.as_buffer()) for x in t.column("place")]
        doc = np.concatenate([_from_planes(x.as_buffer()) for x in t.column("doc")])
        words: list[bytes] = []
        for x in t.column("words"):
            words += d.decompress(x.as_buffer()).split(b"\n")
        order = np.array(sorted(range(len(words)), key=words.__getitem__), np.int64)
        in_order = [words[i] for i in order.tolist()]
        new = np.r_[True, np.fromiter((a != b for a, b in zip(in_order[1:], in_order)), bool, len(in_order) - 1)]
        least = np.empty(len(order), np.int64)
        least[order] = np.minimum.reduceat(doc[order], np.flatnonzero(new))[np.cumsum(new) - 1]
        told = least < doc
        end = np.cumsum([len(x) for x in place])
        rows = [(k, x[told[j - len(x) : j]], least[j - len(x) : j][told[j - len(x) : j]]) for k, (x, j) in enumerate(zip(place, end.tolist()))]
        rows = [r for r in rows if len(r[1])]
        return pa.table({"bucket": t.column("bucket").take(pa.array([r[0] for r in rows], pa.int32())), "place": pa.array([_squeezed(r[1]) for r in rows], pa.binary()), "least": pa.array([_planes(r[2]) for r in rows], pa.binary())})

    def apply(t: pa.Table, answers: pa.Table) -> pa.Table:
        keys, texts, ids = _unpacked(t)
        p = Suffixes(texts, keys, window)
        least = p.least
        for x, y in zip(answers.column("place"), answers.column("least")):
            c = _expanded(x.as_buffer())
            least[c] = np.minimum(least[c], _from_planes(y.as_buffer()))
        gone = np.zeros(int(p.n_words.sum()), bool)
        gone[p.at[keys[p.doc] > least[p.of]]] = True
        c = np.cumsum(np.r_[np.zeros(window, np.int64), gone.astype(np.int64)])
        covered = c[window:] - c[:-window] > 0
        first, last = p.first_word.tolist(), (p.first_word + p.n_words).tolist()
        removed, kept, runs = [], [], []
        for raw, i, j in zip(texts, first, last):
            mine = covered[i:j]
            n = int(mine.sum())
            removed.append(n)
            kept.append(raw if not n else b" ".join(compress(raw.split(b" "), (~mine).tolist())))
            if spans:
                edge = np.flatnonzero(np.diff(np.r_[False, mine, False].astype(np.int8))).reshape(-1, 2)
                runs.append([{"first": a, "words": b - a} for a, b in edge.tolist()])
        cols = {"id": ids, "n_words": pa.array(p.n_words, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "kept_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in kept], pa.string())}
        if with_text:
            cols["kept_text"] = pa.array([x.decode() for x in kept], pa.string())
        if spans:
            cols["spans"] = pa.array(runs, pa.list_(pa.struct([("first", pa.int64()), ("words", pa.int64())])))
        del p, texts, kept
        give_back()
        return pa.table(cols)

    sent = packed.groupBy("bucket").cogroup(sieved.select("bucket", "slot", "flags").groupBy("bucket")).applyInArrow(tree_out, "part int, sub int, bucket int, place binary, doc binary, words binary")
    told = sent.groupBy("part", "sub").applyInArrow(tree_in, "bucket int, place binary, least binary")
    schema = "id long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * with_text + ", spans array<struct<first: bigint, words: bigint>>" * spans
    return packed.groupBy("bucket").cogroup(told.groupBy("bucket")).applyInArrow(apply, schema).withColumnRenamed("id", id_column)


def _cuts(packed: DataFrame, sieved: DataFrame, buckets: int, k: int, bits: int, window: int, group_suffixes: int) -> _Cuts:
    """Groups for all sieved suffixes, of about a quarter of group_suffixes each but for hot prefixes, which are looked for in `packed`, the first k buckets."""
    n = sieved.agg(F.sum("n")).head()[0] or 0
    cuts = _Cuts(max(2, int(np.ceil(np.log2(max(1, 4 * n / group_suffixes))))), {})
    if n <= group_suffixes:
        return cuts
    scale = buckets / k

    def count(t: pa.Table, answers: pa.Table) -> pa.Table:
        out: list[tuple[int, int, int]] = []
        if t.num_rows and answers.num_rows:
            ids, texts, _ = _unpacked(t)
            p = Suffixes(texts, ids, window)
            c = _flagged(p, answers, bits)
            group = cuts.group(p.h4[c])
            order = np.lexsort((p.h8[c], group))
            g, h = group[order], p.h8[c][order]
            s, e = _parts(g)
            for i, j in zip(s, e):
                if (j - i) * buckets > group_suffixes // 2:  # by this bucket's measure it may be hot
                    a, b = _parts(h[i:j])
                    out += [(int(g[i]), 0, int(j - i))] + [(int(g[i]), int(h[i + x].astype(np.int64)), int(y - x)) for x, y in zip(a, b) if (y - x) * buckets > group_suffixes // 2]
            give_back()
        cols = list(zip(*out)) or [(), (), ()]
        return pa.table({"part": pa.array(cols[0], pa.int32()), "h8": pa.array(cols[1], pa.int64()), "n": pa.array(cols[2], pa.int64())})

    counted = packed.groupBy("bucket").cogroup(sieved.filter(F.col("bucket") < k).select("bucket", "slot", "flags").groupBy("bucket")).applyInArrow(count, "part int, h8 long, n long")
    found = counted.groupBy("part", "h8").agg(F.sum("n").alias("n")).filter(F.col("n") * scale > group_suffixes).collect()  # hot prefixes only
    whole = {r["part"] for r in found if r["h8"]}
    cuts.split = {r["part"]: (int(-(-2 * r["n"] * scale // group_suffixes)), r["part"] in whole) for r in found if not r["h8"]}
    return cuts
