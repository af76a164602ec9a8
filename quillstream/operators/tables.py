"""Tables cut from their lineage, and the write rules: upsert, insert-ignore, changed rows, trash."""

from __future__ import annotations

import gc
import tempfile
import time

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; a temporary one of our own only where it is unset and Spark runs on one machine, as in tests."""
    if not spark.sparkContext.getCheckpointDir():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir is unset: name a folder that all machines share")
        spark.sparkContext.setCheckpointDir(named or tempfile.mkdtemp(prefix="quillstream-"))
    return spark.sparkContext.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Materialised in the shared folder that spark.checkpoint.dir names; a folder of the machine only where it is unset, as in tests."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def release(spark: SparkSession) -> None:
    """Lets Spark drop shuffle files of queries that nothing refers to any more: the driver's objects go first, which Python tells the JVM from a
    thread of its own, then what they held."""
    for _ in range(2):
        gc.collect()
        time.sleep(0.3)
        spark.sparkContext._jvm.System.gc()


def _filled(new: Column, old: Column) -> Column:
    return F.coalesce(F.when(new.cast("string") != "", new), old)


def upsert(old: DataFrame, batch: DataFrame, key: str = "url", order: str = "pos", create_only: tuple[str, ...] = ()) -> DataFrame:
    """old with the batch merged in, and `action` as kept, created or updated.

    A batch row without key is skipped. The last row by `order` wins, field by field: only a field that is neither null nor empty
    overwrites, and a create_only field never does. A column that the batch lacks keeps its value.
    """
    fields = [c for c in old.columns if c != key]
    given = [c for c in fields if c in batch.columns]
    rows = batch.filter(F.coalesce(F.col(key), F.lit("")) != "")
    last = lambda c: F.max_by(F.col(c), F.when(F.col(c).isNotNull() & (F.col(c).cast("string") != ""), F.col(order)))
    news = rows.groupBy(key).agg(*[last(c).alias(f"new_{c}") for c in given], F.lit(True).alias("came"))
    both = old.withColumn("there", F.lit(True)).join(news, key, "full_outer")
    value = lambda c: F.col(c) if c not in given else F.coalesce(F.col(c), F.col(f"new_{c}")) if c in create_only else _filled(F.col(f"new_{c}"), F.col(c))
    action = F.when(F.col("there").isNull(), "created").when(F.col("came").isNull(), "kept").otherwise("updated")
    return both.select(key, *[value(c).alias(c) for c in fields], action.alias("action"))


def insert_ignore(old: DataFrame, batch: DataFrame, key: str = "url", order: str = "pos") -> DataFrame:
    """The batch's rows to append: the first by `order` of each key that old lacks."""
    w = Window.partitionBy(key).orderBy(order)
    return batch.filter(F.col(key).isNotNull()).withColumn("r", F.row_number().over(w)).filter("r = 1").drop("r").join(old.select(key), key, "left_anti").select(*batch.columns)


def changed(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """new's rows that differ from old's of the same key in any column, nulls being equal, or whose key is new."""
    fields = [c for c in new.columns if c != key]
    before = old.select(key, F.struct(*fields).alias("before"))
    return new.join(before, key, "left").filter(~F.struct(*fields).eqNullSafe(F.col("before"))).select(*new.columns)


def trash(rows: DataFrame, ids: DataFrame, key: str, now: Column) -> DataFrame:
    """Rows of ids get deleted_at, if they have none."""
    return rows.join(ids.select(key).distinct().withColumn("hit", F.lit(True)), key, "left").withColumn("deleted_at", F.when(F.col("hit"), F.coalesce("deleted_at", now)).otherwise(F.col("deleted_at"))).select(*rows.columns)


def restore(rows: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return rows.join(ids.select(key).distinct().withColumn("hit", F.lit(True)), key, "left").withColumn("deleted_at", F.when(F.col("hit").isNull(), F.col("deleted_at"))).select(*rows.columns)


def delete_forever(rows: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Without the rows of ids that lie in the trash; others stay."""
    return rows.join(ids.select(key).distinct().withColumn("hit", F.lit(True)), key, "left").filter(F.col("hit").isNull() | F.col("deleted_at").isNull()).select(*rows.columns)
