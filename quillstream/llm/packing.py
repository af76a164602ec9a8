"""Lexical retrieval packing.

Documents become token ids with a closing id. A router sends each to a shard of about `shard_tokens` ids where texts with
like wording meet: a tree of hyperplanes over random projections of the documents' weighted terms, fitted on a bounded
sample of `ROUTER_DOCS` documents, has `2^LEVELS * STEPS` buckets in an order in which neighbours are alike; consecutive buckets
fill a shard up to its size, and a bucket that is too large for one (a group of copies, say) is split by row number over as
many as it needs. Each shard builds a BM25 inverted index of its documents, with the document frequencies and mean length of the
whole corpus. A seed document opens a sequence; the index ranks its unused neighbours by all terms they share with it, which
fill the window greedily; the last one is cut where the window ends and its rest opens the next sequence. Only a shard's
last sequence may be short; it is cut into sequences of power-of-two length, which need no padding.

Defined results: a null or empty text is the closing id alone; repeated rows, and rows that repeat an id or have none, are
packed each; every id lies in exactly one piece; an empty table gives an empty result. Long documents fill whole sequences alone.
"""

from __future__ import annotations

import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstream.llm.common import cut, give_back, lots
from quillstream.llm.tokens import END_ID, encoder

LENGTH = 2048
SHARD_TOKENS = 2_000_000
K1, B = 1.2, 0.75
#: Terms in more than this share of a shard's documents keep a weight for each document instead of postings.
DENSE_SHARE = 1 / 16
#: The router: sampled documents (the bound), levels of its tree, steps along each leaf, projections.
ROUTER_DOCS, LEVELS, STEPS, PROJECTIONS = 4_000, 7, 32, 64
#: Terms in more documents than this share say little about what a document is like, and don't route it.
ROUTE_SHARE = 0.1
TERMS = 1 << 16


def tokenized(docs: DataFrame, text: str = "text", id_column: str = "doc_id", vocabulary: str | None = None, router: "Router | None" = None) -> DataFrame:
    """id, n, ids (little-endian uint16, with the closing id), bucket (the router's; 0 without one)."""

    def run(batches):
        enc = encoder(vocabulary)
        end = np.array([END_ID], "<u2").tobytes()
        for b in lots(batches):
            ids = [x + end for x in enc.encode(b.column(1).to_pylist())]
            bucket = router.buckets([np.frombuffer(x, "<u2") for x in ids]) if router else np.zeros(len(ids), np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(x) // 2 for x in ids], pa.int64()), pa.array(ids, pa.binary()), pa.array(bucket, pa.int32())], ["id", "n", "ids", "bucket"])

    return docs.select(F.col(id_column).cast("long").alias("id"), F.col(text)).mapInArrow(run, "id long, n long, ids binary, bucket int")


def terms_of(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, term, count) of each text's distinct terms, in order."""
    if not texts:
        return (np.empty(0, np.int64),) * 3
    out = []
    for first in range(0, len(texts), 1000):
        lot = texts[first : first + 1000]
        key = np.repeat(np.arange(len(lot), dtype=np.uint32), [len(x) for x in lot]) << np.uint32(16) | np.concatenate(lot)
        key.sort()
        starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        held = key[starts]
        out.append(((held >> np.uint32(16)).astype(np.int64) + first, (held & np.uint32(TERMS - 1)).astype(np.int64), np.diff(np.r_[starts, len(key)])))
    return tuple(np.concatenate(c) for c in zip(*out))


class Corpus:
    """What BM25 needs to know of all documents: their number, mean length and each term's document frequency."""

    def __init__(self, n: int, mean: float, df: np.ndarray):
        self.n, self.mean = n, mean
        self.idf = np.log1p((n - df + 0.5) / (df + 0.5)).astype(np.float32)
        self.idf[END_ID] = 0  # the closing id is no term

    @staticmethod
    def of(rows: DataFrame) -> "Corpus":
        """Of rows (n, ids): one number for each id of the vocabulary comes to the driver, from all documents."""

        def count(batches):
            df = np.zeros(TERMS, np.int64)
            for b in lots(batches):
                df += np.bincount(terms_of([np.frombuffer(x.as_buffer(), "<u2") for x in b.column(0)])[1], minlength=TERMS)
            held = np.flatnonzero(df)
            yield pa.RecordBatch.from_arrays([pa.array(held, pa.int32()), pa.array(df[held])], ["term", "df"])

        total = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).head()
        df = np.zeros(TERMS)
        for r in rows.select("ids").mapInArrow(count, "term int, df long").groupBy("term").agg(F.sum("df").alias("df")).collect():
            df[r["term"]] = r["df"]
        return Corpus(total[0], total[1] / max(1, total[0]), df)


@lru_cache(maxsize=1)
def _signs() -> np.ndarray:
    return np.random.default_rng(1).choice(np.array([-1, 1], np.float32), (TERMS, PROJECTIONS))


def projected(texts: list[np.ndarray], idf: np.ndarray) -> np.ndarray:
    """Unit vectors of random projections of the texts' weighted terms."""
    text, term, tf = terms_of(texts)
    telling = idf[term] > -np.log(ROUTE_SHARE)
    text, term, tf = text[telling], term[telling], tf[telling]
    weight = (np.log1p(tf) * idf[term]).astype(np.float32)
    edge = np.searchsorted(text, np.arange(len(texts) + 1)).tolist()
    signs = _signs()
    v = np.stack([weight[a:z] @ signs[term[a:z]] for a, z in zip(edge, edge[1:])])
    return v / (np.linalg.norm(v, axis=1, keepdims=True) + 1e-9)


class Router:
    """A tree of hyperplanes through the medians of a sample of vectors, each across its widest spread; its leaves are cut in steps along one more."""

    def __init__(self, sample: np.ndarray, idf: np.ndarray):
        self.idf = idf
        nodes = (1 << (LEVELS + 1)) - 1
        self.direction = np.zeros((nodes, PROJECTIONS), np.float32)
        self.middle = np.zeros(nodes, np.float32)
        self.edges: list[np.ndarray] = []
        r = np.random.default_rng(2)
        members = {0: np.arange(len(sample))}
        for node in range(nodes):
            own = members.pop(node)
            x = sample[own] if len(own) else np.zeros((1, PROJECTIONS), np.float32)
            apart = x - x.mean(0)
            v = r.standard_normal(PROJECTIONS).astype(np.float32)
            for _ in range(8):
                w = apart.T @ (apart @ v)
                v = w / np.linalg.norm(w) if np.linalg.norm(w) > 1e-9 else v / np.linalg.norm(v)
            at = x @ v
            self.direction[node], self.middle[node] = v, np.median(at)
            if node < nodes >> 1:
                side = sample[own] @ v > self.middle[node]
                members[2 * node + 1], members[2 * node + 2] = own[~side], own[side]
            else:
                self.edges.append(np.quantile(at, np.arange(1, STEPS) / STEPS).astype(np.float32))

    @staticmethod
    def fitted(docs: DataFrame, text: str, id_column: str, vocabulary: str | None, router_docs: int = ROUTER_DOCS) -> "Router":
        share = min(1.0, router_docs / max(1, docs.count()))
        rows = cut(tokenized(docs.sample(share, seed=1) if share < 1 else docs, text, id_column, vocabulary))
        idf = Corpus.of(rows).idf

        def vectors(batches):
            for b in lots(batches):
                found = projected([np.frombuffer(x.as_buffer(), "<u2") for x in b.column(0)], idf)
                yield pa.RecordBatch.from_arrays([pa.array(found.tolist(), pa.list_(pa.float32()))], ["v"])

        found = rows.select("ids").mapInArrow(vectors, "v array<float>").collect()  # about router_docs vectors
        return Router(np.array([r["v"] for r in found], np.float32).reshape(-1, PROJECTIONS), idf)

    def buckets(self, texts: list[np.ndarray]) -> np.ndarray:
        x = projected(texts, self.idf)
        node = np.zeros(len(x), np.int64)
        for _ in range(LEVELS):
            right = np.einsum("ij,ij->i", x, self.direction[node]) > self.middle[node]
            node = 2 * node + 1 + right
        leaf = node - ((1 << LEVELS) - 1)
        at = np.einsum("ij,ij->i", x, self.direction[node])
        step = np.zeros(len(x), np.int64)
        for k in np.unique(leaf):
            step[leaf == k] = np.searchsorted(self.edges[k], at[leaf == k])
        return leaf * STEPS + step


def shards_of(tokens: np.ndarray, shard_tokens: int) -> tuple[np.ndarray, np.ndarray]:
    """First shard and number of shards of each bucket, of the buckets' ids in order: consecutive buckets share a shard while they fit."""
    first, parts = np.zeros(len(tokens), np.int64), np.ones(len(tokens), np.int64)
    shard, held = 0, 0
    for k, n in enumerate(tokens.tolist()):
        if held and held + n > shard_tokens:
            shard, held = shard + 1, 0
        first[k] = shard
        parts[k] = max(1, -(-n // shard_tokens))
        if parts[k] > 1:
            shard, held = shard + parts[k], 0
        else:
            held += n
    return first, parts


class Bm25:
    """Inverted index of one shard: postings by term, each with its BM25 weight in the corpus (by default, the shard is all of it)."""

    def __init__(self, texts: list[np.ndarray], corpus: Corpus | None = None, k1: float = K1, b: float = B):
        n = len(texts)
        self.n = n
        doc, term, tf = terms_of(texts)
        tf = tf.astype(np.float32)
        size = np.array([len(x) for x in texts], np.float32)
        df = np.bincount(term, minlength=TERMS)
        corpus = corpus or Corpus(n, float(size.mean()), df)
        weight = corpus.idf[term] * tf * (k1 + 1) / (tf + k1 * (1 - b + b * size[doc] / max(1.0, corpus.mean)))
        # terms that another document has too; the closing id is no term
        shared = (df > 1) & (np.arange(TERMS) != END_ID)
        # those in many documents keep a weight for each, as a matrix; the others have postings
        common = np.flatnonzero(shared & (df > max(1, n * DENSE_SHARE)))
        row = np.full(TERMS, -1, np.int32)
        row[common] = np.arange(len(common))
        r = row[term]
        self.dense = np.zeros((len(common), n), np.float32)
        self.dense[r[r >= 0], doc[r >= 0]] = weight[r >= 0]
        rare = shared[term] & (r < 0)
        term, doc, weight = term[rare], doc[rare], weight[rare]
        self.query, self.query_at = term, np.searchsorted(doc, np.arange(n + 1))
        order = np.argsort(term, kind="stable")
        self.doc, self.weight = doc[order], weight[order]
        self.at = np.searchsorted(term[order], np.arange(TERMS + 1))
        text, first = np.divmod(np.flatnonzero(self.dense.T), max(1, len(common)))
        self.common, self.common_at = first, np.searchsorted(text, np.arange(n + 1))

    def neighbours(self, seed: int, unused: np.ndarray, k: int = 32) -> np.ndarray:
        """Unused documents with a common term, best first."""
        score = np.zeros(self.n, np.float32)
        for row in self.common[self.common_at[seed] : self.common_at[seed + 1]].tolist():
            score += self.dense[row]
        terms = self.query[self.query_at[seed] : self.query_at[seed + 1]]
        if len(terms):
            a, size = self.at[terms], self.at[terms + 1] - self.at[terms]
            flat = np.repeat(a - np.cumsum(size) + size, size) + np.arange(size.sum())
            score += np.bincount(self.doc[flat], self.weight[flat], self.n)
        score *= unused
        k = min(k, self.n)
        top = np.argpartition(-score, k - 1)[:k]
        top = top[score[top] > 0]
        return top[np.lexsort((top, -score[top]))]


def pack_shard(texts: list[np.ndarray], length: int = LENGTH, corpus: Corpus | None = None) -> list[tuple[int, int, int, int, int]]:
    """Pieces (document, start, length, sequence, offset); sequences are numbered from 0."""
    n = len(texts)
    size = [len(x) for x in texts]
    index = Bm25(texts, corpus)
    unused = np.ones(n, bool)
    out: list[tuple[int, int, int, int, int]] = []
    seq, nxt, room = 0, 0, length
    rest: tuple[int, int] | None = None

    def put(doc: int, start: int) -> None:
        nonlocal room, seq, rest
        take = min(room, size[doc] - start)
        out.append((doc, start, take, seq, length - room))
        room -= take
        rest = (doc, start + take) if start + take < size[doc] else None
        if room == 0:
            seq, room = seq + 1, length

    while True:
        if rest is not None:
            seed, start = rest
        else:
            while nxt < n and not unused[nxt]:
                nxt += 1
            if nxt == n:
                break
            seed, start = nxt, 0
            unused[seed] = False
        opened = seq
        put(seed, start)
        if seq != opened:
            continue
        while seq == opened:
            found = index.neighbours(seed, unused)
            if not len(found):
                break
            for doc in found.tolist():
                unused[doc] = False
                put(doc, 0)
                if seq != opened:
                    break
        # no neighbour is left: the next unused document goes on in this window
        while seq == opened:
            while nxt < n and not unused[nxt]:
                nxt += 1
            if nxt == n:
                break
            unused[nxt] = False
            put(nxt, 0)
    return _without_padding(out, seq, length - room)


def _without_padding(pieces: list[tuple[int, int, int, int, int]], last: int, filled: int) -> list[tuple[int, int, int, int, int]]:
    """Cuts the last, short sequence into sequences whose lengths are the powers of two that sum to it."""
    if not filled:
        return pieces
    out = [p for p in pieces if p[3] != last]
    sizes = [1 << b for b in range(filled.bit_length() - 1, -1, -1) if filled >> b & 1]
    seq, room, at = last, sizes[0], 0
    k = 0
    for doc, start, n, _, _ in (p for p in pieces if p[3] == last):
        while n:
            take = min(n, room)
            out.append((doc, start, take, seq, at))
            start, n, room, at = start + take, n - take, room - take, at + take
            if not room and k + 1 < len(sizes):
                k += 1
                seq, room, at = seq + 1, sizes[k], 0
    return out


def dealt(rows: DataFrame, shard_tokens: int = SHARD_TOKENS) -> tuple[DataFrame, int]:
    """rows (row, n, bucket, ...) with the shard of each, and the number of shards."""
    tokens = np.zeros((1 << LEVELS) * STEPS, np.int64)
    for r in rows.groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # a number for each of the router's buckets
        tokens[r["bucket"]] = r["n"]
    first, parts = shards_of(tokens, shard_tokens)
    known = rows.sparkSession.createDataFrame([(k, int(a), int(b)) for k, (a, b) in enumerate(zip(first, parts))], "bucket int, first long, parts long")
    placed = rows.join(F.broadcast(known), "bucket").withColumn("shard", F.col("first") + F.pmod(F.xxhash64("row"), F.col("parts")))
    return placed.drop("first", "parts"), int((first + parts).max())


def pack(docs: DataFrame, text: str = "text", id_column: str = "doc_id", length: int = LENGTH, shard_tokens: int = SHARD_TOKENS, vocabulary: str | None = None, with_ids: bool = False) -> DataFrame:
    """Per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset and, if asked for, ids (uint16)."""
    router = Router.fitted(docs, text, id_column, vocabulary)
    # numbered once and written, so that a row keeps its number
    rows = cut(tokenized(docs, text, id_column, vocabulary, router).withColumn("row", F.monotonically_increasing_id()))
    corpus = Corpus.of(rows)
    placed, shards = dealt(rows, shard_tokens)

    def run(whole: pa.Table) -> pa.Table:
        """One shard: bounded by shard_tokens, or one longer document."""
        shard = whole.column("shard")[0].as_py()
        whole = whole.select(["bucket", "row", "id", "ids"]).sort_by([("bucket", "ascending"), ("row", "ascending")])
        ids = whole.column("id").combine_chunks()
        texts = [np.frombuffer(x.as_buffer(), "<u2") for x in whole.column("ids")]
        pieces = np.array(pack_shard(texts, length, corpus), np.int64)
        doc, start, size, seq, offset = pieces.T
        crc = [zlib.crc32(texts[d][a : a + n].astype("<u4").tobytes()) for d, a, n in zip(doc.tolist(), start.tolist(), size.tolist())]
        cols = {
            "id": ids.take(pa.array(doc)),
            "start": pa.array(start),
            "length": pa.array(size),
            "ids_crc32": pa.array(crc, pa.int64()),
            "doc_tokens": pa.array(np.array([len(x) for x in texts], np.int64)[doc]),
            "sequence_id": pa.array((shard << 32) + seq),
            "offset": pa.array(offset),
        }
        if with_ids:
            cols["ids"] = pa.array([texts[d][a : a + n].tobytes() for d, a, n in zip(doc.tolist(), start.tolist(), size.tolist())], pa.binary())
        out = pa.table(cols)
        del whole, texts, pieces, ids
        give_back()
        return out

    schema = "id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids binary" * with_ids
    packed = placed.repartition(max(1, shards // 2), "shard").groupBy("shard").applyInArrow(run, schema)
    return packed.withColumnRenamed("id", id_column)
