"""Bounded walks along causal edges, from many starts at once."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEPTH = 5


def walk(edges: DataFrame, starts: DataFrame, direction: str = "descendants", max_depth: int = DEPTH, within: tuple[str, ...] = ()) -> DataFrame:
    """(start, edge_id, from_id, to_id, depth): each step of every walk from a start that meets no node twice.

    edges: edge_id, from_id, to_id, starts: start; both with the columns `within` (such as the event), which steps keep to.
    Descendants go along the edges, ancestors against them. There are as many joins as max_depth, whatever the graph's size.
    """
    here, there = ("from_id", "to_id") if direction == "descendants" else ("to_id", "from_id")
    steps = edges.select(*within, "edge_id", "from_id", "to_id")
    at = starts.select(*within, "start", F.col("start").alias("node"), F.array("start").alias("visited"))
    found = []
    for depth in range(1, max_depth + 1):
        going = at.join(steps.withColumn("node", F.col(here)), [*within, "node"])
        # the first step is taken even where it leads back to its start
        going = going if depth == 1 else going.filter(~F.array_contains("visited", F.col(there)))
        found.append(going.select(*within, "start", "edge_id", "from_id", "to_id", F.lit(depth).alias("depth")))
        at = going.select(*within, "start", F.col(there).alias("node"), F.array_append("visited", F.col(there)).alias("visited"))
    return reduce(DataFrame.unionByName, found)
