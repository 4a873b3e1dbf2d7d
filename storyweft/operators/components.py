"""Connected components by least labels, with joins and sums only."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own: dict[str, str] = {}


def folder(spark: SparkSession, name: str) -> str:
    """A new path in the folder that spark.checkpoint.dir names; a local session without that setting gets its own."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        app = spark.sparkContext.applicationId
        if app not in _own:
            _own[app] = tempfile.mkdtemp(prefix="storyweft-")
        base = _own[app]
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """df as a table in a folder of its own, in folders by a column if one is named."""
    spark = df.sparkSession
    path = folder(spark, name)
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def components(nodes: DataFrame, links: DataFrame, rounds: int = 60) -> DataFrame:
    """id, component (the least id reachable) of nodes (id) by links (a, b). Each round takes the least label around,
    then the label's own label, and is written out; as many rounds as the logarithm of the longest path, about."""
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct()
    both = written(both, "links")
    label = written(nodes.select("id", F.col("id").alias("component")), "labels")
    for _ in range(rounds):
        near = both.join(label, both["b"] == label["id"]).select(both["a"].alias("id"), "component")
        low = near.unionByName(label).groupBy("id").agg(F.min("component").alias("component"))
        low = written(low, "low")
        jump = low.select(F.col("id").alias("component"), F.col("component").alias("next"))
        new = written(low.join(jump, "component", "left").select("id", F.least("component", "next").alias("component")), "labels")
        if new.join(label.withColumnRenamed("component", "old"), "id").filter("component <> old").isEmpty():
            return new
        label = new
    raise RuntimeError("labels still move after all rounds")


def key_components(rows: DataFrame, keys: list[str], links: DataFrame | None = None) -> DataFrame:
    """Components of rows (id) that share a value of any key column (null and '' link nothing), or a row of links (a, b):
    each value's rows are linked to its least id, so a common value makes no pairs."""
    for k in keys:
        own = rows.filter(F.col(k).isNotNull() & (F.col(k) != "")).select("id", F.col(k).alias("k"))
        least = own.groupBy("k").agg(F.min("id").alias("b"))
        part = own.join(least, "k").select(F.col("id").alias("a"), "b")
        links = part if links is None else links.unionByName(part)
    return components(rows.select("id"), links)
