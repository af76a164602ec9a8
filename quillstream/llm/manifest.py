"""Merkle manifest of a table: built bottom-up from persisted levels, proofs pushed top-down.

Every row is a leaf, the digest of its fields. The leaves of a group (a language), in order of their ids, are hashed in runs of
`ARITY` until one is left, the group's subroot; the subroots, in the order of their groups, are hashed likewise to the root.

Build: leaves get their place in the group without a task that sees the whole group: they are dealt by range and counted by
partition. Nodes are gathered in blocks of ARITY^STRIDE neighbours; a block's tree is folded in one go and its top is a node of the
next persisted level, so a table of n rows has log(n) / log(64) levels, each a 64th of the one below. Proofs: from the root down, a
level joins its blocks with what their parents inherited; each child prepends its own siblings and hands the suffix on. A
block has at most 64 nodes, whatever the size of a group.

Digests are sha256 in lowercase hex, of the hex texts of what they cover. A field is `-` if null, else its bytes' count, `:` and the
value.

Defined results: rows that repeat an id stand in the order of their leaves; a row without id stands first in its group and is never
tampered with; a null group is the first group; an empty table gives no rows and has no root; columns beside the fields don't count.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstream.llm.common import cut, give_back

ARITY = 2
STRIDE = 6
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: The siblings on a way up: for each level, those to the left and to the right of the node, as joined digests.
PROOF = "array<struct<left: string, right: string>>"
Step = tuple[str, str]


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def field(value: Column) -> Column:
    text = value.cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(values: list[Column]) -> Column:
    return F.sha2(F.concat(*[field(v) for v in values]), 256)


def tampered(id_column: str = "doc_id") -> Column:
    """The rows whose n_chars grows by one."""
    return F.coalesce(F.crc32(F.col(id_column).cast("string").cast("binary")) % 7 == 0, F.lit(False))


def fold(start: str, proof: list[Step]) -> str:
    """The root that a leaf and its siblings lead to."""
    for left, right in proof:
        start = digest(left + start + right)
    return start


def levels_of(nodes: list[str], n: int, arity: int, stride: int) -> list[list[str]]:
    """The levels of a block's tree. n: how many nodes the group has on the block's own level, which tells where its tree ends."""
    out, at = [nodes], n
    while at > 1 and len(out) <= stride:
        out.append([digest("".join(out[-1][i : i + arity])) for i in range(0, len(out[-1]), arity)])
        at = -(-at // arity)
    return out


def _steps(levels: list[list[str]], i: int, arity: int) -> list[Step]:
    """The siblings of node i on its way to the top of the block."""
    found = []
    for nodes in levels[:-1]:
        first = i - i % arity
        found.append(("".join(nodes[first:i]), "".join(nodes[i + 1 : first + arity])))
        i //= arity
    return found


def placed(df: DataFrame, order: list[Column], group: str | None = None) -> DataFrame:
    """df, cut, with `place` (from 0, in the order, which starts with the group if there is one) and `n` (rows of the group).

    The rows are dealt by range, so a group of any size is in many tasks; each partition's groups are counted, one small row each.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = df.withColumn("_m", F.monotonically_increasing_id())  # equal rows are dealt out too
    ranged = rows.repartitionByRange(parts, *order, F.col("_m")).sortWithinPartitions(*order, "_m").drop("_m").withColumn("_at", F.monotonically_increasing_id())
    dealt = cut(ranged.select("*", F.shiftright("_at", 33).cast("int").alias("_part"), F.col("_at").bitwiseAND((1 << 33) - 1).alias("_line")).drop("_at"))
    key = F.col(group) if group else F.lit(0)
    counts = dealt.groupBy("_part", key.alias("_g")).agg(F.min("_line").alias("_first"), F.count(F.lit(1)).alias("_c"))
    w = Window.partitionBy("_g")
    before = F.coalesce(F.sum("_c").over(w.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select(F.col("_part").alias("_p"), "_g", (before - F.col("_first")).alias("_shift"), F.sum("_c").over(w).alias("n"))
    joined = dealt.join(starts, (F.col("_part") == F.col("_p")) & key.eqNullSafe(F.col("_g")))
    return joined.select(*df.columns, (F.col("_line") + F.col("_shift")).alias("place"), "n")


def _blocks(nodes: DataFrame, fan: int, more: list[str]) -> DataFrame:
    """From rows (grp, place, n, node, ...) to rows of up to `fan` neighbours: grp, block, n, items (in order). Persisted."""
    item = F.struct(F.col("place"), F.col("node"), *more)
    return cut(nodes.groupBy("grp", F.floor(F.col("place") / fan).alias("block")).agg(F.first("n").alias("n"), F.array_sort(F.collect_list(item)).alias("items")))


def _tops(blocks: DataFrame, arity: int, stride: int) -> DataFrame:
    """The next level's nodes: the top of each block."""
    fan = arity**stride

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, 256):
                part = b.slice(k, 256)
                n = part.column("n").to_pylist()
                tops = [levels_of([i["node"] for i in items], m, arity, stride)[-1][0] for items, m in zip(part.column("items").to_pylist(), n)]
                yield pa.RecordBatch.from_arrays([part.column("grp"), part.column("block"), pa.array([-(-m // fan) for m in n], pa.int64()), pa.array(tops, pa.string())], ["grp", "place", "n", "node"])

    return blocks.select("grp", "block", "n", F.transform("items", lambda i: F.struct(i["node"].alias("node"))).alias("items")).mapInArrow(run, "grp long, place long, n long, node string")


def build(nodes: DataFrame, more: list[str], arity: int = ARITY, stride: int = STRIDE) -> tuple[list[DataFrame], DataFrame]:
    """The persisted levels of all groups' trees, the lowest first, and the tops (grp, node)."""
    levels, done, fan = [_blocks(nodes, arity**stride, more)], [], arity**stride
    while True:
        tops = cut(_tops(levels[-1], arity, stride))
        done.append(tops.filter("n = 1").select("grp", "node"))
        above = tops.filter("n > 1")
        if above.isEmpty():
            break
        levels.append(_blocks(above, fan, []))
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return levels, out


def _pushed(blocks: DataFrame, arity: int, stride: int) -> DataFrame:
    """From blocks with what they inherited to (grp, place, suffix) of their nodes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, 64):
                part = b.slice(k, 64)
                grp, place, suffix = [], [], []
                for g, items, n, rest in zip(*[part.column(c).to_pylist() for c in ("grp", "items", "n", "suffix")]):
                    levels = levels_of([i["node"] for i in items], n, arity, stride)
                    for i, x in enumerate(items):
                        grp.append(g)
                        place.append(x["place"])
                        suffix.append([{"left": left, "right": right} for left, right in _steps(levels, i, arity)] + rest)
                yield pa.RecordBatch.from_arrays([pa.array(grp, pa.int64()), pa.array(place, pa.int64()), pa.array(suffix, part.schema.field("suffix").type)], ["grp", "place", "suffix"])

    return blocks.select("grp", "n", "items", "suffix").mapInArrow(run, f"grp long, place long, suffix {PROOF}")


def _inherit(levels: list[DataFrame], tops: DataFrame, arity: int, stride: int) -> DataFrame:
    """The lowest level's blocks with the proof suffix from their top to the root. tops: grp, suffix."""
    fan, handed = arity**stride, None
    for k, level in reversed(list(enumerate(levels))):
        top = level.filter(F.col("n") <= fan).join(tops, "grp")  # a group's last block
        if handed is not None:
            lower = level.filter(F.col("n") > fan).join(handed.withColumnRenamed("place", "block"), ["grp", "block"])
            top = top.unionByName(lower)
        if k:
            handed = cut(_pushed(top, arity, stride))
    return top


def manifest(df: DataFrame, fields: tuple[str, ...] = FIELDS, group: str = "lang", id_column: str = "doc_id", count: str = "n_chars", arity: int = ARITY, stride: int = STRIDE, with_proof: bool = False) -> DataFrame:
    """id, leaf, subroot, root, proof_sha256 (of the untampered table), folded_root (from the tampered leaf, where there is one, and
    the original siblings), verified and, if asked for, proof (the siblings of each level, left and right of the node)."""
    spark, fan = df.sparkSession, arity**stride
    col = {c: F.col(c) for c in fields}
    changed = leaf([v if c != count else v + 1 for c, v in col.items()])
    is_changed = tampered(id_column) & (F.col(count).isNotNull() if count in fields else F.lit(False))
    leaves = df.select(F.col(group).cast("string").alias("name"), F.col(id_column).cast("long").alias("id"), leaf(list(col.values())).alias("node"), F.when(is_changed, changed).alias("alt"))
    rows = placed(cut(leaves), [F.col("name"), F.col("id"), F.col("node")], "name")  # cut: dealing by range looks at its rows twice
    names = placed(rows.filter("place = 0").select("name", F.col("n").alias("rows")), [F.col("name")])
    groups = cut(names.select("name", F.col("place").alias("grp"), F.col("n").alias("of")))
    nodes = rows.join(groups.select(F.col("name").alias("_name"), "grp"), F.col("name").eqNullSafe(F.col("_name"))).select("grp", "place", "n", "node", "id", "alt")
    levels, subroots = build(nodes, ["id", "alt"], arity, stride)
    subroots = cut(subroots)
    upper = subroots.join(groups, "grp").select(F.lit(0).cast("long").alias("grp"), F.col("grp").alias("place"), F.col("of").alias("n"), "node")
    above, root = build(upper, [], arity, stride)
    head = root.head()
    told = f", proof {PROOF}" * with_proof
    schema = f"id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean{told}"
    if head is None:
        return spark.createDataFrame([], schema).withColumnRenamed("id", id_column)
    root_hex = head["node"]
    none = F.array().cast(PROOF)
    by_group = _pushed(_inherit(above, spark.range(1).select(F.col("id").alias("grp"), none.alias("suffix")), arity, stride), arity, stride).select(F.col("place").alias("grp"), "suffix")
    low = _inherit(levels, cut(by_group), arity, stride).join(subroots.withColumnRenamed("node", "subroot"), "grp")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, 64):
                part = b.slice(k, 64)
                out: list[tuple] = []
                for items, n, rest, sub in zip(*[part.column(c).to_pylist() for c in ("items", "n", "suffix", "subroot")]):
                    tree, rest = levels_of([i["node"] for i in items], n, arity, stride), [(s["left"], s["right"]) for s in rest]
                    for i, x in enumerate(items):
                        proof = _steps(tree, i, arity) + rest
                        folded = fold(x["alt"] or x["node"], proof)
                        row = (x["id"], x["node"], sub, root_hex, digest("".join(a + c for a, c in proof)), folded, folded == root_hex)
                        out.append((*row, [{"left": a, "right": c} for a, c in proof]) if with_proof else row)
                kinds = [pa.int64(), *[pa.string()] * 5, pa.bool_()] + [pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))] * with_proof
                names = ["id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"] + ["proof"] * with_proof
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out), kinds)], names)
        give_back()

    assert fan > 1
    return low.select("items", "n", "suffix", "subroot").mapInArrow(finish, schema).withColumnRenamed("id", id_column)
