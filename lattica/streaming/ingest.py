"""Structured Streaming: facts that arrive are upserted batch by batch into buckets, checked against what is known, and counted in windows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.plans.rounds import remove
from lattica.sources.triples import normal, upsert

KEY = ("subject", "relation", "object")


class Buckets:
    """A table of facts in buckets by hash of their key: a batch rewrites only the buckets it touches, into its own folder; a manifest per
    batch says which folder holds each bucket. Batches that run again give the same; folders that no manifest of the last two batches
    names are deleted."""

    def __init__(self, spark: SparkSession, path: str, schema, buckets: int = 64):
        self.spark, self.path, self.schema, self.buckets = spark, path, schema, buckets

    def bucket(self):
        return F.pmod(F.xxhash64(*[normal(c) for c in KEY]), F.lit(self.buckets)).cast("int")

    def manifest(self, number: int) -> dict[int, int]:
        """bucket -> batch whose folder holds it, as of batch number (an earlier one where that left none)."""
        for n in range(number, max(-1, number - 3), -1):
            try:
                return {r["bucket"]: r["batch"] for r in self.spark.read.json(f"{self.path}/manifest/{n}").collect()}
            except AnalysisException:
                continue
        return {}

    def read(self, held: dict[int, int], only: list[int] | None = None) -> DataFrame:
        parts = [f"{self.path}/data/{batch}/bucket={b}" for b, batch in held.items() if only is None or b in only]
        return self.spark.read.schema(self.schema).parquet(*parts) if parts else self.spark.createDataFrame([], self.schema)

    def latest(self, number: int) -> DataFrame:
        return self.read(self.manifest(number))

    def merge(self, batch: DataFrame, number: int) -> None:
        held = self.manifest(number - 1) if number else {}
        touched = [r["bucket"] for r in batch.select(self.bucket().alias("bucket")).distinct().collect()]  # at most the number of buckets
        if touched:
            new = upsert(self.read(held, touched), batch).select(*[f.name for f in self.schema])
            new.withColumn("bucket", self.bucket()).write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/data/{number}")
        now = held | {b: number for b in touched}
        rows = self.spark.createDataFrame([(b, n) for b, n in now.items()], "bucket int, batch long")
        rows.coalesce(1).write.mode("overwrite").json(f"{self.path}/manifest/{number}")
        before = set(self.manifest(number - 2).values()) if number > 1 else set()
        for old in before - set(held.values()) - set(now.values()):
            remove(self.spark, f"{self.path}/data/{old}")


def ingest(stream: DataFrame, table: str, checkpoint: str, buckets: int = 64, after: Callable[[DataFrame, int], None] | None = None):
    """Start a query that merges each micro-batch (columns of schema.TRIPLE) into Buckets at table. after(batch, number) runs once the batch is
    in: a guard, a derivation of what the batch adds, a model's update."""
    store = Buckets(stream.sparkSession, table, stream.schema, buckets)

    def merge(batch: DataFrame, number: int) -> None:
        store.merge(batch, number)
        if after:
            after(batch, number)

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def guarded(table: str, types: str) -> Callable[[DataFrame, int], None]:
    """An `after` that writes, per batch, the contradictions between the types of its facts' entities and all types seen so far, to types/warnings/<batch>;
    the types themselves stand in types/seen/<batch>, one folder per batch."""
    from lattica.operators import guard

    def check(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        new = guard.typed(batch)
        old = spark.read.schema("entity string, type string, seq long").parquet(*[f"{types}/seen/{n}" for n in range(number)]) if number else spark.createDataFrame([], "entity string, type string, seq long")
        near = old.join(new.select("entity").distinct(), "entity", "left_semi")
        facts = near.unionByName(new).select(F.col("entity").alias("subject"), F.lit("is_a").alias("relation"), F.col("type").alias("object"), "seq")
        guard.contradictions(facts).write.mode("overwrite").parquet(f"{types}/warnings/{number}")
        new.groupBy("entity", "type").agg(F.min("seq").alias("seq")).write.mode("overwrite").parquet(f"{types}/seen/{number}")

    return check


def rederived(store: Buckets, rules: DataFrame, path: str) -> Callable[[DataFrame, int], None]:
    """An `after` that writes to path/<batch> what the batch's facts add by one application of the rules to all facts: its facts joined on both sides
    with all, nothing else recomputed."""
    from lattica.operators.inference import composed

    def derive(batch: DataFrame, number: int) -> None:
        known = store.latest(number).select(*KEY)
        new = batch.select(*[normal(c).alias(c) for c in KEY])
        live = F.broadcast(rules.filter("target is not null"))
        made = composed(new, known, live).union(composed(known, new, live)).distinct()
        made.join(known, list(KEY), "left_anti").write.mode("overwrite").parquet(f"{path}/{number}")

    return derive


def windowed_counts(events: DataFrame, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """(start, event_type, n, total): counts per window; on a stream, late rows are dropped behind the watermark."""
    w = F.window("ts", width)
    source = events.withWatermark("ts", late) if events.isStreaming else events
    return source.groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")
