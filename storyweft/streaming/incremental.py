"""Incremental stages as available-now streams, and windowed counts with a watermark."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def drain(source: DataFrame, stage: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Run stage on what is new since the checkpoint, then stop. A batch that is replayed must be harmless to stage:
    append only rows whose key is not there."""
    source.writeStream.trigger(availableNow=True).option("checkpointLocation", checkpoint).foreachBatch(stage).start().awaitTermination()


def ledger_stream(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def append_once(path: str, keys: list[str], order: str) -> Callable[[DataFrame, int], None]:
    """A stage that appends each key's first row to the Parquet table at path, once. The table has one writer at a time:
    what is there is read and added to under its lock."""
    from storyweft.operators.mutations import append_new
    from storyweft.sources.sinks import one_writer

    def stage(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        with one_writer(spark, path):
            try:
                have = spark.read.schema(batch.schema).parquet(path)
            except Exception as e:
                if "PATH_NOT_FOUND" not in str(e):
                    raise
                have = batch.limit(0)
            append_new(have, batch, keys, order).write.mode("append").parquet(path)

    return stage


LEDGER_KEYS = ("source", "source_item_id", "payload_hash")


def ledger_appends(source: DataFrame, path: str, checkpoint: str, keys: tuple[str, ...] = LEDGER_KEYS, at: str = "received_at", within: str = "2 days", on_read: Callable[[list[str]], None] | None = None) -> None:
    """Append what is new of a stream to a ledger in folders by day, each key once, then stop.

    Repeats that arrive within the time of each other are dropped by the stream's own state, which the watermark bounds: it
    is on the arrival, so no row is ever too late for it, however old. What is left meets the ledger: a batch that is
    replayed, or that a lost checkpoint brings again, is compared with the days of its own rows and those that `within`
    reaches around them, so what it reads does not grow with the ledger. Keys repeat over no longer time than that.
    on_read is told which days a batch reads."""

    def stage(batch: DataFrame, _: int) -> None:
        spark, near = batch.sparkSession, F.expr(f"INTERVAL {within}")
        batch = batch.withColumn("day", F.date_format(at, "yyyy-MM-dd"))
        batch.persist()
        try:
            days = [r.d for r in batch.select(F.explode(F.sequence(F.to_date(F.col(at) - near), F.to_date(F.col(at) + near))).alias("day")).select(F.date_format("day", "yyyy-MM-dd").alias("d")).distinct().collect()]
            there = _existing(spark, path, days)
            if on_read:
                on_read(there)
            first = batch.groupBy(*keys).agg(F.min_by(F.struct(*batch.columns), at).alias("r")).select("r.*")
            if there:
                have = spark.read.schema(batch.schema).option("basePath", path).parquet(*[f"{path}/day={d}" for d in there])
                first = first.join(have.select(*keys), list(keys), "left_anti")
            first.repartition("day").write.partitionBy("day").mode("append").parquet(path)
        finally:
            batch.unpersist()

    unique = source.withColumn("__now", F.current_timestamp()).withWatermark("__now", within).dropDuplicatesWithinWatermark(list(keys)).drop("__now")
    drain(unique, stage, checkpoint)


def _existing(spark: SparkSession, path: str, days: list[str]) -> list[str]:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted(d for d in days if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/day={d}")))


def process(stages: list[Callable[[], int]], max_cycles: int = 25, until_empty: bool = True) -> list[list[int]]:
    """Rows each stage has handled, cycle by cycle, until a cycle handles none. Raises if work is left after the last."""
    done = []
    for _ in range(max_cycles if until_empty else 1):
        done.append([s() for s in stages])
        if not any(done[-1]):
            return done
    if until_empty:
        raise RuntimeError(f"work is left after {max_cycles} cycles")
    return done


def windowed_counts(events: DataFrame, length: str, slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Counts and sums by time window and event type; a stream drops events later than `late`."""
    e = events.withWatermark("ts", late) if events.isStreaming else events
    g = e.groupBy(F.window("ts", length, slide) if slide else F.window("ts", length), "event_type")
    return g.agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    e = events.withWatermark("ts", late) if events.isStreaming else events
    g = e.groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"))
    return g.select(F.col("session_window.start").alias("start"), "user_id", "n")
