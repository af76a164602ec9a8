"""All named queries with their oracles."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Query:
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None = None


QUERIES: dict[str, Query] = {}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


#: What the two dialects write differently: @hours(x) an interval, @at(x) a timestamp literal, @days(a, b) whole days from a to b.
def _dialect(sql: str, spark: bool) -> str:
    sql = re.sub(r"@hours\(([^()]*)\)", r"make_interval(0, 0, 0, 0, cast(\1 as int))" if spark else r"to_hours(cast(\1 as bigint))", sql)
    sql = re.sub(r"@at\('([^']*)'\)", r"timestamp_ntz'\1'" if spark else r"timestamp '\1'", sql)
    sql = re.sub(r"@days\(([^,()]*),([^()]*)\)", r"timestampdiff(DAY, \1, \2)" if spark else r"date_sub('day', \1, \2)", sql)
    sql = re.sub(r"@each\(([^;]*);\s*(\w+)\s*;\s*(\w+)\)", r"lateral (select explode(\1) as \3) \2" if spark else r"lateral (select unnest(\1) as \3) \2", sql)
    return sql


def frame(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """Spark's rows of a text for both engines; tables stand in braces."""
    tables = sorted(set(re.findall(r"\{(\w+)\}", sql)))
    return spark.sql(_dialect(sql, True), **{t: read(spark, sf_dir, t) for t in tables})


def oracle(sql: str) -> str:
    """DuckDB's form of a text for both engines."""
    return re.sub(r"\{(\w+)\}", r"\1", _dialect(sql, False))


def sql_query(name: str, sql: str) -> None:
    """One text for both engines."""
    QUERIES[name] = Query(lambda spark, sf_dir: frame(spark, sf_dir, sql), oracle(sql))


def frame_query(name: str, sql: str | None = None):
    """Registers a DataFrame function with its own oracle."""

    def wrap(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = Query(f, sql)
        return f

    return wrap


def FLAGSHIP(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["C1_hybrid_search"].run(spark, sf_dir)


from quillstream.plans import composite, events, ordered, relational, retrieval, rules, scalars, sources, streams  # noqa: E402,F401  (they register their queries)
