"""What the operators share: whole-text word splitting and lineage cuts."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import time
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, as a Java character class.
SPACE = r"[ \t-\r]+"
#: Everything but ASCII letters, digits and non-ASCII characters.
NON_ALNUM = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def text_or_empty(col: str | Column) -> Column:
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def ascii_lower(col: Column) -> Column:
    """Lower-cases A-Z only."""
    return F.translate(col, UPPER, LOWER)


def words(col: Column, separator: str = SPACE) -> Column:
    """The words between runs of separators, in order; an empty text has none."""
    return F.filter(F.split(col, separator), lambda w: w != "")


def let(value: Column, body) -> Column:
    """body(value) with value evaluated once.

    The optimizer may inline a column into each place that names it, also into a lambda that runs for each element, and
    may push a filter on it below its projection; a value bound by a lambda of its own is safe from that.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have yet, whatever the case of its letters."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def checkpoint_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; a temporary folder of our own only where it is unset (tests, local mode)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir is unset: name a folder that all machines share")
    own = getattr(spark, "_quillstream_dir", None)
    if own is None:
        own = "file://" + tempfile.mkdtemp(prefix="quillstream-")
        spark._quillstream_dir = own
    return own


def release(spark: SparkSession) -> None:
    """Lets Spark drop shuffle files of queries that nothing refers to any more.

    The driver's objects go first, which Python tells the JVM from a thread of its own, then what they held.
    """
    for _ in range(2):
        gc.collect()
        time.sleep(0.3)
        spark.sparkContext._jvm.System.gc()


def cut(df: DataFrame) -> DataFrame:
    """Writes df to the reliable checkpoint folder and reads it from there; lost executors don't lose it."""
    spark = df.sparkSession
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(checkpoint_dir(spark))
    return df.checkpoint()


def cut_by(df: DataFrame, partitions: int, key: str) -> DataFrame:
    """df dealt out by key and cut; what groups it by key later reads the folder without another shuffle.

    A checkpoint keeps the partitioning of its plan only if that plan is not adaptive.
    """
    conf = df.sparkSession.conf
    adaptive = conf.get("spark.sql.adaptive.enabled")
    conf.set("spark.sql.adaptive.enabled", "false")
    try:
        return cut(df.repartition(partitions, key))
    finally:
        conf.set("spark.sql.adaptive.enabled", adaptive)


class Written:
    """A table in the shared folder, for as long as it is needed; unlike a checkpoint's, its files are compressed."""

    def __init__(self, df: DataFrame):
        self.spark, self.path = df.sparkSession, f"{checkpoint_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
        df.write.option("compression", "zstd").parquet(self.path)
        self.table = self.spark.read.schema(df.schema).parquet(self.path)

    def drop(self) -> None:
        where = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)


def lots(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """The batches in slices of few rows, so that few texts at a time become Python objects; gives memory back after the last.

    Workers serve one task after another, so what the allocators keep for one would count for all that follow.
    """
    for b in batches:
        for k in range(0, b.num_rows, rows):
            yield b.slice(k, rows)
    give_back()


def give_back() -> None:
    """Returns freed memory of this Python worker to the system, where the allocators can."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # not glibc
        pass
