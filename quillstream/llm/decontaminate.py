"""Benchmark decontamination: size-partitioned MinHash containment search, verified by exact shingle containment.

Words are runs of letters and digits, lower-cased; shingles are five words (a shorter text is one shingle). The share of
a test item's distinct shingles that a document holds is its containment; 0.8 and more is a hit.

Search: documents are partitioned by size (power of two of their shingle count). A partition with up to 2^k shingles
gets a one-permutation MinHash of 2^k bins: the hash space is cut in 2^k ranges and each keeps its smallest
hash. A short item inside a long document keeps, at that resolution, nearly each of its shingles as a bin's minimum, and
shares at least 63 % of them with the document's sketch whatever the document's size, so one common minimum makes a
candidate: an item of n shingles is missed with probability under 0.37^(0.8 n). Items under `tiny` shingles would be missed
too often, so for them, where there are any, every shingle of the documents is probed.

Verification: candidate documents are read again and their shingles compared with the item's, as strings.

Defined results: null or empty texts and items hold no shingle and match nothing; repeated items and documents are
reported each, also where their ids are null or repeat; an empty table gives an empty result; other columns, whatever their
names, pass `decontaminate` untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstream.llm.common import NON_ALNUM, cut, fresh, let, text_or_empty, words

SHINGLE = 5
THRESHOLD_PERCENT = 80
TINY = 8
#: Rows and bytes up to which a checked side is broadcast; beyond either, the join shuffles.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 64_000_000


def shingle_hashes(w: Column, n: int = SHINGLE) -> Column:
    """Sorted hashes of the n-word shingles, repeats included."""

    def hashes(w: Column) -> Column:
        many = F.transform(F.sequence(F.lit(0), F.size(w) - n), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(n)]))
        one = F.array(F.xxhash64(F.array_join(w, " ")))
        return F.sort_array(F.when(F.size(w) >= n, many).when(F.size(w) > 0, one).otherwise(F.array().cast("array<long>")))

    return let(w, hashes)


def shingle_texts(w: Column, n: int = SHINGLE) -> Column:
    def texts(w: Column) -> Column:
        many = F.transform(F.sequence(F.lit(0), F.size(w) - n), lambda i: F.array_join(F.slice(w, i + 1, n), " "))
        return F.array_distinct(F.when(F.size(w) >= n, many).when(F.size(w) > 0, F.array(F.array_join(w, " "))).otherwise(F.array().cast("array<string>")))

    return let(w, texts)


def bin_minima(h: Column) -> Column:
    """Of sorted hashes: the smallest of each bin. The size partition is the power of two 2^k above the number of hashes; a bin is a hash's k leading bits."""

    def minima(h: Column) -> Column:
        shift = F.lit(64) - F.length(F.bin(F.size(h).cast("long")))
        bin_of = lambda x: F.call_function("shiftright", x, shift)
        return F.filter(h, lambda x, i: (i == 0) | (bin_of(x) != bin_of(F.get(h, i - 1))))

    return let(h, minima)


def _words(text: str) -> Column:
    return words(F.lower(text_or_empty(text)), NON_ALNUM)


def checked_broadcast(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> DataFrame:
    """df with a broadcast hint if it has no more than `rows` rows of no more than `size` bytes in all, as JSON text; the caller's
    joins work either way, and where both sides are shuffled Spark splits a skewed key's rows."""
    n, held = df.limit(rows + 1).agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length(F.to_json(F.struct("*")))), F.lit(0))).head()
    return F.broadcast(df) if n <= rows and held <= size else df


def _key(text: str) -> Column:
    """What stands for a text between the steps: its hash. Verification reads the text itself, so ids may be null or repeat."""
    return F.xxhash64(text_or_empty(text))


def _verified(docs: DataFrame, items: DataFrame, text: str, item_text: str, percent: int, tiny: int, kept: dict[str, Column], named: dict[str, Column]) -> DataFrame:
    """Verified hits of rows of docs and items: their columns `kept` and `named`, n_shared and n_item."""
    w = items.select(_key(item_text).alias("item"), _words(item_text).alias("w")).dropDuplicates(["item"])
    hashes = w.select("item", F.array_distinct(shingle_hashes(F.col("w"))).alias("h"))
    index = cut(hashes.select("item", F.size("h").alias("m"), F.explode_outer("h").alias("hash")).filter("hash is not null"))
    near = _probes(docs, text, bin_minima).join(checked_broadcast(index), "hash").select("doc", "item")
    short = index.filter(F.col("m") < tiny)
    if not short.isEmpty():
        near = near.union(_probes(docs, text, lambda h: h).join(checked_broadcast(short), "hash").select("doc", "item"))
    pairs = cut(near.distinct())
    wanted = pairs.select("doc").distinct()
    read = docs.select(_key(text).alias("doc"), F.struct(*[c.alias(k) for k, c in kept.items()]).alias("kept"), F.col(text).alias("t"))
    read = read.join(checked_broadcast(wanted), "doc", "left_semi").select("doc", "kept", shingle_texts(_words("t")).alias("dt"))
    texts = items.select(_key(item_text).alias("item"), F.struct(*[c.alias(k) for k, c in named.items()]).alias("named"), shingle_texts(_words(item_text)).alias("it")).filter(F.size("it") > 0)
    both = read.join(checked_broadcast(pairs), "doc").join(checked_broadcast(texts), "item")
    both = both.select("kept.*", "named.*", F.size(F.array_intersect("it", "dt")).cast("long").alias("n_shared"), F.size("it").cast("long").alias("n_item"))
    return both.filter(100 * F.col("n_shared") >= percent * F.col("n_item"))


def search(docs: DataFrame, items: DataFrame, text: str = "text", id_column: str = "doc_id", item_text: str = "text", item_id: str = "item_id", percent: int = THRESHOLD_PERCENT, tiny: int = TINY) -> DataFrame:
    """doc_id, item_id, n_shared, n_item, containment of every verified hit: one for each row of docs and of items."""
    hit = _verified(docs, items, text, item_text, percent, tiny, {"_doc_id": F.col(id_column)}, {"_item_id": F.col(item_id)})
    return hit.select(F.col("_doc_id").alias(id_column), F.col("_item_id").alias(item_id), "n_shared", "n_item", (F.col("n_shared") / F.col("n_item")).alias("containment"))


def _probes(docs: DataFrame, text: str, pick) -> DataFrame:
    """doc, hash: one row for each shingle that is picked."""
    # explode_outer: no filter on the array's size is inferred, which would compute the array twice
    return docs.select(_key(text).alias("doc"), F.explode_outer(pick(shingle_hashes(_words(text)))).alias("hash"))


def decontaminate(docs: DataFrame, items: DataFrame, text: str = "text", item_text: str = "text", percent: int = THRESHOLD_PERCENT) -> DataFrame:
    """The rows of docs that hold no test item, each judged by its own text."""
    own = lambda column: (F.xxhash64(text_or_empty(column)), F.xxhash64(F.lit(1), text_or_empty(column)))
    a, b = own(text)
    held = cut(_verified(docs, items, text, item_text, percent, TINY, {"a": a, "b": b}, {}).select("a", "b").distinct())
    key = fresh(docs, "_key")
    hits = held.select(F.struct("a", "b").alias(key + "_hit"))
    rows = docs.withColumn(key, F.struct(a.alias("a"), b.alias("b")))
    return rows.join(checked_broadcast(hits), F.col(key) == F.col(key + "_hit"), "left_anti").select(*[docs[c] for c in docs.columns])
