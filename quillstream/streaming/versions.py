"""Tables kept as numbered versions of Parquet files, so that a batch run twice writes the same version twice."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def _versions(spark: SparkSession, path: str) -> list[int]:
    """The finished versions, by number; read through Spark's own file system, so any store does."""
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(where):
        return []
    names = [f.getPath() for f in fs.listStatus(where)]
    return sorted(int(p.getName()[2:]) for p in names if p.getName().startswith("v=") and fs.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))


def current(spark: SparkSession, path: str, schema: str, before: int | None = None) -> DataFrame:
    """The newest finished version, of those under `before` if given; an empty table if there is none."""
    found = [v for v in _versions(spark, path) if before is None or v < before]
    return spark.read.schema(schema).parquet(f"{path}/v={found[-1]}") if found else spark.createDataFrame([], schema)


def write(df: DataFrame, path: str, version: int) -> None:
    df.write.mode("overwrite").parquet(f"{path}/v={version}")
