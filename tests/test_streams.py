"""The cascade and the ledger on streams, against their batch forms."""

import random
import time

from pyspark.sql import functions as F

from storyweft.operators import dedup
from storyweft.streaming import incremental
from storyweft.streaming.matching import stream_stories

from .test_operators import _generated


def test_cascade_on_a_stream(spark, tmp_path):
    """Equal to the batch pass over micro-batches whose rows are shuffled; a batch writes what it changed; replays change nothing."""
    rows, df = _generated(spark, 7, 160)
    src, out, written = str(tmp_path / "in"), [], []
    for lo in (0, 60, 120, 40):
        part = df.filter((F.col("article_id") > lo) & (F.col("article_id") <= lo + (60 if lo != 120 else 40)))
        part.orderBy(F.rand(lo)).coalesce(1).write.mode("append").parquet(src)
        stream = stream_stories(incremental.ledger_stream(spark, src, df.schema), candidates=10)
        q = stream.writeStream.trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).foreachBatch(lambda b, _: out.extend(b.collect())).start()
        q.awaitTermination()
        written += [s["numRowsUpdated"] for p in q.recentProgress for s in p["stateOperators"] if p["numInputRows"]]
    want = {r.article_id: (r.story_id, r.exact_signal, r.decision) for r in dedup.greedy_stories(df, candidates=10).collect()}
    assert {r.article_id: (r.story_id, r.exact_signal, r.decision) for r in out} == want and len(out) == 160
    assert max(written) < 2 * written[0] and written[3] < 10  # the fourth batch holds members only


def test_vectors_expire_and_come_back(spark, tmp_path):
    """With next to no time to live the second batch finds no vectors; a story that is seen again brings its own back."""
    schema = "article_id long, collection string, source string, source_item_id string, url string, content_hash string, title string, published_at timestamp, created_at timestamp, vector array<double>"
    row = lambda i, url, v: (i, "c", "s", str(i), url, f"h{i}", f"title {i * 977} of {i * 31}", None, None, v)
    batches = [[row(1, "u1", [1.0, 0.0]), row(2, "u2", [0.0, 1.0])], [row(3, "u1", None), row(4, "", [0.0, 1.0]), row(5, "", [1.0, 0.01])], [row(6, "u1", [0.5, 0.5]), row(7, "", [1.0, 0.0])]]
    src, out = str(tmp_path / "in"), []
    stamp = lambda d: d.withColumn("created_at", F.timestamp_seconds(1_704_067_200 + F.col("article_id")))
    q = None
    try:
        for i, own in enumerate(batches):
            stamp(spark.createDataFrame(own, schema)).coalesce(1).write.mode("append").parquet(src)
            if q is None:
                stream = stream_stories(incremental.ledger_stream(spark, src, schema), keep_days=2 / 86400)
                q = stream.writeStream.trigger(processingTime="1 second").option("checkpointLocation", str(tmp_path / "cp")).foreachBatch(lambda b, _: out.extend(b.collect())).start()
            until = time.time() + 60
            while len(out) < sum(map(len, batches[: i + 1])) and time.time() < until:
                time.sleep(0.2)
            time.sleep(3)
    finally:
        q.stop()
    got = {r.article_id: (r.story_id, r.exact_signal) for r in out}
    assert got == {1: (1, None), 2: (2, None), 3: (1, "exact_url"), 4: (4, None), 5: (1, "semantic"), 6: (1, "exact_url"), 7: (1, "semantic")}


def test_ledger_on_a_stream(spark, tmp_path):
    """Repeated and late items are appended once; a batch reads the days that it can meet, not the ledger."""
    rng = random.Random(3)
    items = [(f"s{i % 3}", str(i // 2), f"h{i // 2}", f"2024-01-{1 + i // 20:02d} 0{i % 10}:00:00") for i in range(120)]
    schema = "source string, source_item_id string, payload_hash string, received_at string"
    src, path = str(tmp_path / "in"), str(tmp_path / "ledger")
    typed = spark.createDataFrame(items, schema).withColumn("received_at", F.col("received_at").cast("timestamp"))
    read = []
    for lo in (0, 40, 20, 80, 0):  # the third and the last are replays
        own = items[lo : lo + 40]
        rng.shuffle(own)
        spark.createDataFrame(own * 2, schema).withColumn("received_at", F.col("received_at").cast("timestamp")).repartition(2).write.mode("append").parquet(src)
        incremental.ledger_appends(incremental.ledger_stream(spark, src, typed.schema), path, str(tmp_path / "cp"), within="2 days", on_read=read.append)
    have = [tuple(r) for r in spark.read.parquet(path).select("source", "source_item_id", "payload_hash").collect()]
    assert len(have) == len(set(have)) and set(have) == {i[:3] for i in items}
    assert read and max(map(len, read)) <= 2 + 2 + 1


def test_counters(spark, tmp_path):
    """In batch and on a stream, against counting what was written."""
    from storyweft.streaming.counters import StageCounters, counted_stream, run_counted

    src, dst = str(tmp_path / "in"), str(tmp_path / "out")
    rows = spark.range(100).select("id", F.when(F.col("id") % 3 > 0, F.col("id") % 3).alias("v"))
    how = {"scanned": None, "ones": F.col("v") == 1, "none": F.col("v").isNull()}
    assert run_counted(rows, lambda r: r.write.parquet(src), **how) == {"scanned": 100, "ones": 33, "none": 34}
    listener = StageCounters()
    spark.streams.addListener(listener)
    try:
        for _ in range(2):
            stream = counted_stream(incremental.ledger_stream(spark, src, rows.schema), "stage", **how)
            stream.writeStream.trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).format("parquet").start(dst).awaitTermination()
            rows.filter("id < 10").write.mode("append").parquet(src)
        until = time.time() + 20
        while listener.totals.get("stage", {}).get("scanned") != 110 and time.time() < until:
            time.sleep(0.2)
    finally:
        spark.streams.removeListener(listener)
    out = spark.read.parquet(dst)
    assert listener.totals["stage"] == {"scanned": out.count(), "ones": out.filter("v = 1").count(), "none": out.filter("v IS NULL").count()}
