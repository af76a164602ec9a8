"""Near-duplicate linking as a stream: the links of operators.near_duplicates, found as documents come, in any order within a delay.

What a document links to depends on the documents within so many hours of it and on what became of the earlier ones among them. So a document is settled
when the watermark (the latest time seen, less the delay) is those hours past it: all that it may meet has come by then, and all before it is settled.

State, as versioned tables in the stream's folder, each batch writing the next version:

- `docs`: documents that wait, and settled ones that those may still meet: none older than twice the hours before the watermark.
- `sets`: the token sets of those documents, one for each text, with their rarest tokens, on which texts meet within neighbouring bands of time.
- `pairs`: the pairs of those texts that reach the threshold.

Everything older is let go, so the state follows the documents of some days, not of all time, and a batch compares what is new with the state
alone. Rows later than the delay are not linked and are told as `late`. A batch that runs again after a failure starts from the version before it.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstream.operators import near_duplicates as nd
from quillstream.operators.tables import cut
from quillstream.streaming import versions

DOCS = "doc_id long, key long, at long, state string, canonical_of long, score double"
SETS = "key long, s array<long>, rare array<int>"
PAIRS = "key long, other long, score double"
OUT = "doc_id long, canonical_of long, score double, state string"
MARK = "watermark long"
END = (1 << 62) - 1


class Links:
    """The linking of one stream, in a folder of its own.

    frequencies: (token, df) of a sample or of history; it orders tokens from rare to common and must stay the same while the stream lives. Without
    it tokens are taken in the order of their hashes, which links the same and compares more.
    """

    def __init__(self, spark: SparkSession, folder: str, frequencies: DataFrame | None = None, threshold: float = nd.THRESHOLD, hours: int = nd.HOURS, delay_hours: int = nd.HOURS):
        self.spark, self.folder, self.threshold, self.span, self.delay = spark, folder, threshold, hours * 3600, delay_hours * 3600
        self.frequencies, self._counters = frequencies, None

    def _old(self, name: str, schema: str, number: int) -> DataFrame:
        return versions.current(self.spark, f"{self.folder}/{name}", schema, before=number)

    def _rare(self, sets: DataFrame) -> DataFrame:
        """sets with the rarest tokens of each."""
        if self._counters is None:
            self._counters = nd.known_frequencies(self.frequencies) if self.frequencies is not None else np.zeros(nd.COUNTERS, np.int32)
        rare = nd.rare_tokens(sets, self._counters, self.threshold)
        listed = rare.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("at", "token"))).alias("r"))
        return sets.join(listed.select("key", F.col("r.token").alias("rare")), "key")

    def take(self, batch: DataFrame, number: int, last: bool = False) -> None:
        """A batch (doc_id, text, at): links what can be settled now. last: nothing more comes, all that waits is settled."""
        docs, sets, pairs = (self._old(n, s, number) for n, s in (("docs", DOCS), ("sets", SETS), ("pairs", PAIRS)))
        before = self._old("mark", MARK, number).agg(F.max("watermark")).head()[0]
        new = cut(nd.with_sets(batch.select(F.col("doc_id").cast("long"), "text", "at")))
        seen = new.agg(F.max("at")).head()[0]
        mark = max(before if before is not None else -END, seen - self.delay if seen is not None else -END)
        versions.write(self.spark.createDataFrame([(mark,)], MARK), f"{self.folder}/mark", number)
        late = F.lit(False) if before is None else F.col("at") < before
        fresh = new.filter(~late)

        # texts: those not in the state get their rarest tokens
        added = cut(self._rare(fresh.select("key", "s").dropDuplicates(["key"]).join(sets.select("key"), "key", "left_anti")))
        sets = sets.unionByName(added.select("key", "s", "rare"))
        waits = fresh.select("doc_id", "key", "at", F.lit("waiting").alias("state"), F.lit(None).cast("long").alias("canonical_of"), F.lit(None).cast("double").alias("score"))
        docs = cut(docs.unionByName(waits))

        # texts of the batch meet the texts around them in time; known pairs are not scored again
        band = F.floor(F.col("at") / (self.span + 1)).alias("band")
        rare = sets.select("key", F.size("s").alias("n"), F.posexplode("rare").alias("at", "token"))
        here = cut(docs.select("key", band).distinct())
        met = nd.meetings(rare.join(fresh.select("key", band).distinct(), "key"), rare.join(here, "key"), self.threshold)
        met = met.select(F.least("key", "other").alias("key"), F.greatest("key", "other").alias("other")).distinct().join(pairs, ["key", "other"], "left_anti")
        pairs = cut(pairs.unionByName(nd.scores(met, sets.select("key", "s"), self.threshold)))

        # whoever is ripe is settled
        until = END if last else mark - self.span - 1  # a row at the watermark itself may still come
        told = nd.by_copies(docs.select("doc_id", "key", "at"), self.span).select("doc_id", *[F.col(c).alias(f"_{c}") for c in ("state", "canonical_of", "score")])
        ripe = (F.col("state") == "waiting") & (F.col("at") <= until)
        asked = docs.join(told, "doc_id").withColumn("ripe", ripe)
        status = cut(asked.select("doc_id", "key", "at", *[F.when(F.col("ripe"), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) for c in ("state", "canonical_of", "score")], "ripe"))
        settled = nd.settle(status.drop("ripe"), nd.both_ways(pairs), self.span)
        out = settled.join(status.filter("ripe").select("doc_id"), "doc_id").select("doc_id", "canonical_of", "score", F.lit("settled").alias("state"))
        short = batch.select(F.col("doc_id").cast("long")).join(new.select("doc_id"), "doc_id", "left_anti").select("doc_id", F.lit("short").alias("state"))
        lates = new.filter(late).select("doc_id", F.lit("late").alias("state"))
        none = short.unionByName(lates).select("doc_id", F.lit(None).cast("long").alias("canonical_of"), F.lit(None).cast("double").alias("score"), "state")
        versions.write(out.unionByName(none), f"{self.folder}/links", number)

        # what nothing can meet any more is let go
        kept = cut(settled.filter(F.col("at") > F.lit(until) - self.span))
        keys = cut(kept.select("key").distinct())
        versions.write(kept, f"{self.folder}/docs", number)
        versions.write(sets.join(keys, "key", "left_semi"), f"{self.folder}/sets", number)
        versions.write(pairs.join(keys, "key", "left_semi").join(keys.withColumnRenamed("key", "other"), "other", "left_semi").select("key", "other", "score"), f"{self.folder}/pairs", number)

    def run(self, docs: DataFrame, finish: bool = False) -> DataFrame:
        """Takes in all that a stream (doc_id, text, at) holds now; finish settles what still waits. Returns OUT rows of all documents settled so far."""
        docs.writeStream.foreachBatch(self.take).option("checkpointLocation", f"{self.folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
        if finish:
            n = versions._versions(self.spark, f"{self.folder}/links")
            self.take(self.spark.createDataFrame([], "doc_id long, text string, at timestamp"), (n[-1] if n else -1) + 1, last=True)
        return self.spark.read.schema(OUT).parquet(f"{self.folder}/links")
