"""Whole runs over item files: ledger, normalise, embed, dedup, and the quality of the stories against known ones."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from storyweft.operators import components, dedup, embed, evaluate, normalize
from storyweft.operators.components import written
from storyweft.sources import items

MODEL, VERSION = "noise", "1"


@dataclass
class Run:
    """Tables of one run, each written down."""

    raw: DataFrame
    articles: DataFrame
    embeddings: DataFrame
    events: DataFrame

    @property
    def counters(self) -> DataFrame:
        return self.events.agg(
            F.count("*").alias("processed"), *[F.count_if(F.col("decision") == d).alias(d) for d in ("new_story", "auto_merge", "gray_zone")], F.count_distinct("story_id").alias("stories"),
            *[F.count_if(F.col("exact_signal") == x).alias(x) for x in dedup.MATCH_TYPES[1:]],
        )


def run_items(spark: SparkSession, path: str, fetched_at: str, make=embed.NoiseBackend, as_of: float | None = None) -> Run:
    """All stages over the item files below path. Arrival ids follow the sorted paths."""
    read = items.read_items(spark, path)
    none = items.ledger_rows(read, fetched_at).limit(0)
    fresh = written(items.ingest(none, read, fetched_at), "arrivals")
    raw = fresh.withColumn("raw_arrival_id", F.row_number().over(Window.orderBy("path")).cast("long"))  # the order of arrival is total by definition
    raw = written(raw, "ledger")
    articles = written(normalize.normalize(raw).withColumn("article_id", F.col("raw_arrival_id")), "articles")
    vectors = written(embed.embed(articles.select("article_id", F.col("normalized_title").alias("title"), F.col("normalized_text").alias("body")), make, MODEL, VERSION), "embeddings")
    own = articles.select("article_id", "collection", "source", "source_item_id", F.col("canonical_url").alias("url"), "content_hash", F.col("normalized_title").alias("title"), "published_at", "created_at")
    ready = own.join(vectors.select("article_id", F.col("embedding").alias("vector")), "article_id")
    return Run(raw, articles, vectors, written(dedup.greedy_stories(ready, as_of), "events"))


def known_stories(run: Run, same: DataFrame | None = None) -> DataFrame:
    """file, truth: items that share a URL, an item uuid or a source's item id, joined with pairs of files known to be the
    same (a, b). Files are told by their path."""
    uuid = F.get_json_object("raw_payload", "$.source_metadata.item_uuid")
    rows = run.raw.join(run.articles.select("raw_arrival_id", "canonical_url"), "raw_arrival_id")
    keys = rows.select(F.col("raw_arrival_id").alias("id"), "path", F.col("canonical_url").alias("k1"), uuid.alias("k2"), F.concat("source", F.lit("\t"), "source_item_id").alias("k3"))
    links = None
    if same is not None:
        left, right = keys.select(F.col("path").alias("x"), F.col("id").alias("a")), keys.select(F.col("path").alias("y"), F.col("id").alias("b"))
        links = same.toDF("x", "y").join(left, "x").join(right, "y").select("a", "b")
    found = components.key_components(keys, ["k1", "k2", "k3"], links)
    return keys.select("id", "path").join(found, "id").select(F.col("path").alias("file"), F.col("component").alias("truth"))


def quality(run: Run, truth: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(counts of the mapping, pairwise precision, recall and F1)."""
    pairs = written(evaluate.mapped(run.raw.select(F.col("raw_arrival_id").alias("id"), F.col("path").alias("file")), truth, run.events.select(F.col("article_id").alias("id"), F.col("story_id").alias("predicted"))), "mapping")
    return evaluate.mapping_counts(pairs), evaluate.pairwise_f1(pairs.dropna(subset=["truth", "predicted"]))
