"""Streams of raw payloads into a documents table, of documents without repeats, and of events' lifecycles."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quillstream.operators.tables import upsert
from quillstream.sources import parsers
from quillstream.sources.archive_stream import ArchiveSource
from quillstream.streaming import versions

DOCUMENTS = "url string, title string, body string, published_at timestamp, author string, external_id string, first_batch long"
DORMANT_DAYS = 30


def raw_stream(spark: SparkSession, folder: str, base_url: str = "", files_per_batch: int = 1000) -> DataFrame:
    """(raw_id, raw, base_url, path) of each file that arrives in folder, whole."""
    files = spark.readStream.schema("value string").option("wholetext", "true").option("maxFilesPerTrigger", files_per_batch).text(folder)
    return files.select(F.xxhash64("_metadata.file_path").alias("raw_id"), F.col("value").alias("raw"), F.lit(base_url).alias("base_url"), F.col("_metadata.file_path").alias("path"))


def ingest(raws: DataFrame, parser: str, table: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Parses each batch and merges it into the versioned table; the batch's number is its version.

    A batch that is run again after a failure starts from the version before it and replaces its own, so nothing is merged twice.
    Payloads with errors are appended to `table`-errors. The default trigger takes what is there and ends.
    """

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        parsed = parsers.parse(parser, batch.select("raw_id", "raw", "base_url")).persist()
        try:
            good = parsed.filter("error is null").withColumn("first_batch", F.lit(number).cast("long")).withColumn("order", F.struct("raw_id", "pos"))
            old = versions.current(spark, f"{table}/rows", DOCUMENTS, before=number)
            versions.write(upsert(old, good, order="order", create_only=("first_batch",)).drop("action"), f"{table}/rows", number)
            parsed.filter("error is not null").select("raw_id", "error").write.mode("overwrite").parquet(f"{table}-errors/v={number}")
        finally:
            parsed.unpersist()

    return raws.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def without_repeats(docs: DataFrame, key: str = "url", at: str = "published_at", hours: int = 72) -> DataFrame:
    """A stream's rows without those whose key came within so many hours before; rows later than that are dropped by the watermark."""
    return docs.withWatermark(at, f"{hours} hours").dropDuplicatesWithinWatermark([key])


def lifecycle(events: DataFrame, days: int = DORMANT_DAYS) -> DataFrame:
    """(key, status, at) each time a key's status changes, of a stream (key, at).

    The first row makes it active; so many days of event time without a row make it dormant at that very moment; a row after that
    wakes it. Rows of one key within a batch are taken in time order; a row older than the last adds nothing, one without time is dropped.
    """
    span = days * 86_400_000_000

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        out: list[tuple[str, int]] = []
        status, last = state.get if state.exists else (None, None)
        if state.hasTimedOut:
            if status == "active":
                out.append(("dormant", last + span))
                status = "dormant"
        else:
            for at in sorted(int(m) for f in frames for m in f["micros"]):
                if last is not None and at <= last:
                    continue
                if status == "active" and at - last >= span:
                    out.append(("dormant", last + span))
                    status = "dormant"
                if status != "active":
                    out.append(("active", at))
                status, last = "active", at
        state.update((status, last))
        if status == "active":
            state.setTimeoutTimestamp(max(-(-(last + span) // 1000), state.getCurrentWatermarkMs() + 1))
        if out:
            yield pd.DataFrame({"key": [key[0]] * len(out), "status": [s for s, _ in out], "micros": [m for _, m in out]})

    kind = events.schema["key"].dataType.simpleString()
    at = F.col("at").cast("timestamp")
    timed = events.filter("at is not null").select("key", at.alias("at"), F.unix_micros(at).alias("micros")).withWatermark("at", "0 seconds")
    changes = timed.groupBy("key").applyInPandasWithState(step, f"key {kind}, status string, micros long", "status string, last long", "append", GroupStateTimeout.EventTimeTimeout)
    return changes.select("key", "status", F.timestamp_micros("micros").alias("at"))


def sessions(events: DataFrame, hours: int, delay: str = "0 seconds") -> DataFrame:
    """(key, first_at, last_at, n) of a stream (key, at): spells between silences of so many hours. State is what is open; a row within the delay may join two spells."""
    timed = events.filter("at is not null").select("key", F.col("at").cast("timestamp").alias("at")).withWatermark("at", delay)
    spells = timed.groupBy("key", F.session_window("at", f"{hours} hours")).agg(F.min("at").alias("first_at"), F.max("at").alias("last_at"), F.count(F.lit(1)).alias("n"))
    return spells.select("key", "first_at", "last_at", "n")


def run_to_table(stream: DataFrame, folder: str) -> DataFrame:
    """What a stream yields from all that is there now, as a table in folder."""
    spark = stream.sparkSession
    stream.writeStream.format("parquet").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/rows")


def walk_archives(spark: SparkSession, folder: str, specs: list[dict], batches: int | None = None, **options: str) -> DataFrame:
    """Reads archives on from where the stream in folder stands and returns all rows it has read so far.

    batches: how many chunks of each archive to read now; by default until every walk has ended.
    """
    spark.dataSource.register(ArchiveSource)
    stream = spark.readStream.format("archive").options(specs=json.dumps(specs), state=f"{folder}/state", **options).load()
    rows = stream.writeStream.format("parquet").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/checkpoint")
    if batches is None:
        query = rows.start()
        try:
            query.processAllAvailable()
        finally:
            query.stop()
    for _ in range(batches or 0):
        rows.trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/rows")
