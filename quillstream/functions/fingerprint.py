"""The documents' own 64-bit SimHash over weighted tokens, and keyword query expressions."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstream.functions import text as tx

#: Fixed value: bits in which near-duplicates differ at most.
NEAR = 10


def feature_hash(token: str) -> int:
    """The same number for a token on every machine."""
    return int.from_bytes(hashlib.blake2b(token.encode(), digest_size=8).digest(), "big")


#: Texts taken at a time, and hashes kept from one lot to the next.
LOT, KNOWN = 1000, 500_000
#: The lower-case byte of an ASCII letter or digit, 0 for all else.
_BYTE = np.zeros(256, np.uint8)
_BYTE[list(b"0123456789abcdefghijklmnopqrstuvwxyz")] = list(b"0123456789abcdefghijklmnopqrstuvwxyz")
_BYTE[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ")] = list(b"abcdefghijklmnopqrstuvwxyz")


def plain_tokens(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The ASCII words of all texts, one after another, and how many each text has."""
    texts = texts.fill_null("").cast(pa.large_string())
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    held = texts.buffers()[2]
    low = _BYTE[np.frombuffer(held, np.uint8)[ends[0] : ends[-1]]] if held is not None else np.zeros(0, np.uint8)
    inside = low != 0
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    at = ends[:-1] - ends[0]
    at = at[at < len(low)]
    begins[at] = inside[at]  # words never go from one text to the next
    places = np.r_[0, np.cumsum(begins)]
    offsets = np.r_[np.flatnonzero(begins[inside]), np.count_nonzero(inside)].astype(np.int64)
    words = pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets), pa.py_buffer(low[inside]))
    return words, np.diff(places[ends - ends[0]])


def _simhashes(words: pa.Array, counts: np.ndarray, known: dict[str, int]) -> np.ndarray:
    """The SimHash of each of the texts that have so many of the words, which stand one after another."""
    out = np.zeros(len(counts), np.int64)
    full = np.flatnonzero(counts)
    if not len(full):
        return out
    coded = words.dictionary_encode()
    names = coded.dictionary.to_pylist()
    if len(known) > KNOWN:
        known.clear()
    for w in names:
        if w not in known:
            known[w] = feature_hash(w)
    # a byte for each bit of a hash; eight of them are added at a time, over 255 words at most
    bits = np.unpackbits(np.array([known[w] for w in names], ">u8").view(np.uint8).reshape(-1, 8), axis=1).view(np.uint64)
    n = counts[full]
    parts = -(-n // 255)
    first = np.cumsum(parts) - parts
    place = np.repeat(np.cumsum(n) - n, parts) + 255 * (np.arange(parts.sum()) - np.repeat(first, parts))
    sums = np.add.reduceat(bits[coded.indices.to_numpy()], place, axis=0).view(np.uint8)
    sums = np.add.reduceat(sums, first, axis=0, dtype=np.int64)
    out[full] = np.packbits(2 * sums > n[:, None], axis=1).view(">i8")[:, 0]
    return out


#: An odd factor for hashes of bytes.
_ODD = 0x9E3779B97F4A7C15


def word_hashes(words: pa.Array) -> np.ndarray:
    """A 64-bit hash of each word, the same on every machine."""
    coded = words.dictionary_encode()
    names = coded.dictionary.cast(pa.large_string())
    if not len(names):
        return np.zeros(0, np.int64)
    ends = np.frombuffer(names.buffers()[1], np.int64)[names.offset : names.offset + len(names) + 1]
    data = np.frombuffer(names.buffers()[2], np.uint8)[ends[0] : ends[-1]].astype(np.uint64) + np.uint64(1)
    powers = lambda f: np.r_[np.uint64(1), np.full(len(data), np.uint64(f))].cumprod(dtype=np.uint64)
    sums = np.r_[np.uint64(0), np.cumsum(data * powers(_ODD)[:-1], dtype=np.uint64)]
    ends = ends - ends[0]
    h = (sums[ends[1:]] - sums[ends[:-1]]) * powers(pow(_ODD, -1, 1 << 64))[ends[:-1]]
    h = (h ^ (h >> np.uint64(32))) * np.uint64(_ODD)
    h ^= h >> np.uint64(29)
    return h.view(np.int64)[coded.indices.to_numpy()]


def split(text: Column) -> list[Column]:
    """Two columns: the text, where its tokens are its ASCII words, which `plain_tokens` splits; else its tokens."""
    t = F.coalesce(text, F.lit(""))
    wide = t.rlike(f"[{tx.CJK}{tx.FULL[0]}-{tx.FULL[-2]}]")
    return [F.when(~wide, t).alias("_plain"), F.when(wide, tx.tokenize(t)).alias("_tokens")]


def with_simhash(rows: DataFrame, id_column: str, text: str) -> DataFrame:
    """(id, simhash): a bit is set where the tokens that have it outweigh those that have not; 0 without tokens. Signed, as stored.

    Texts with CJK or full-width characters are split by the library's tokens; the tokens of all others are their ASCII words, split by bytes.
    """
    kind = rows.schema[id_column].dataType.simpleString()

    def run(batches):
        known: dict[str, int] = {}
        for whole in batches:
            for k in range(0, whole.num_rows, LOT):
                b = whole.slice(k, LOT)
                listed = b.column(2)
                words = listed.flatten().cast(pa.large_string())
                found = _simhashes(words, listed.value_lengths().fill_null(0).to_numpy().astype(np.int64), known) | _simhashes(*plain_tokens(b.column(1)), known)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.int64())], ["id", "simhash"])

    tokens = rows.select(F.col(id_column).alias("id"), *split(F.col(text)))
    return tokens.mapInArrow(run, f"id {kind}, simhash long").withColumnRenamed("id", id_column)


def hamming_distance(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def is_near_duplicate(a: Column, b: Column, threshold: int = NEAR) -> Column:
    """Never where either is 0, the fingerprint of no text."""
    return (a != 0) & (b != 0) & (hamming_distance(a, b) <= threshold)


def _power(k: int) -> Column:
    return F.lit(str(1 << k)).cast("decimal(20,0)")


def wrapped(c: Column) -> Column:
    """A whole number of any size as the stored fingerprint that its last 64 bits are."""
    return signed(F.pmod(c.cast("decimal(38,0)"), _power(64)))


def unsigned(c: Column) -> Column:
    """A stored fingerprint as the number that its bits are."""
    n = c.cast("decimal(20,0)")
    return F.when(c < 0, (n + _power(64)).cast("decimal(20,0)")).otherwise(n)


def signed(c: Column) -> Column:
    return F.when(c >= _power(63), (c - _power(64)).cast("decimal(20,0)")).otherwise(c).cast("long")


def query_expression(c: Column, operator: str = "&") -> Column:
    """The query's tokens joined by & (all) or | (any); tokens of signs alone are left out; nothing matches an empty one."""
    safe = F.filter(tx.tokenize(F.coalesce(c, F.lit(""))), lambda t: t.rlike("^[A-Za-z0-9]+$") | t.rlike(r"[^\x00-\x7F]"))
    return F.array_join(safe, f" {operator} ")
