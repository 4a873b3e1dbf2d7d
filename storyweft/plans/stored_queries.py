"""Stored tables that are updated in place of being rebuilt, and counts kept by changes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storyweft.operators import deltas, mutations
from storyweft.operators.components import folder, written
from storyweft.plans import adapter as m
from storyweft.plans.adapter import EPOCH, table, with_model
from storyweft.plans.registry import query
from storyweft.sources.versions import VersionedTable
from storyweft.streaming.counters import run_counted


@query("versioned_updates", with_model(f"""
SELECT collection, count(*) AS n, count(*) FILTER (deleted_at IS NOT NULL OR (collection = 'en' AND created_at < TIMESTAMP '{EPOCH}' + INTERVAL 1 HOUR)) AS deleted, 1 + (collection = 'en')::BIGINT AS folders_written FROM articles GROUP BY collection
"""))
def versioned_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles as a stored table; those of one collection and its first hour are deleted softly. Rows, deleted ones, and how
    often a collection's folder was written over both versions."""
    t = VersionedTable(spark, folder(spark, "articles-versions"))
    t.append(m.article_rows(spark, sf_dir))
    old = t.manifest(1)["parts"]
    en = t.read().filter("collection = 'en'")
    first_hour = F.col("created_at") < F.lit(EPOCH).cast("timestamp") + F.expr("INTERVAL 1 HOUR")
    t.update(lambda rows: mutations.soft_delete(rows, first_hour, m.AS_OF), where=en)
    new = t.manifest(2)["parts"]
    writes = F.create_map(*[F.lit(x) for p in new for x in (p, 1 + (new[p] != old[p]))])
    rows = t.read().groupBy("collection").agg(F.count("*").alias("n"), F.count("deleted_at").alias("deleted"))
    return rows.select("collection", "n", "deleted", writes[t.partition()].cast("long").alias("folders_written"))


@query("counts_by_delta", """
SELECT lang, source, count(*) AS n, sum(n_chars)::BIGINT AS sum_n_chars, min(doc_id) AS min_doc_id, max(doc_id) AS max_doc_id, max(n_chars) AS max_n_chars
FROM documents WHERE doc_id % 13 <> 0 GROUP BY lang, source
""")
def counts_by_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of seven documents in ten, brought up to date by those that came and went."""
    d = table(spark, sf_dir, "documents").select("lang", "source", "doc_id", "n_chars")
    how = {"keys": ["lang", "source"], "sums": ["n_chars"], "least": ["doc_id"], "greatest": ["doc_id", "n_chars"]}
    view = deltas.view_of(d.filter("doc_id % 10 < 7"), **how)
    went = d.filter("doc_id % 10 < 7 AND doc_id % 13 = 0").withColumn("sign", F.lit(-1))
    came = d.filter("doc_id % 10 >= 7 AND doc_id % 13 <> 0").withColumn("sign", F.lit(1))
    return deltas.folded(view, went.unionByName(came), d.filter("doc_id % 13 <> 0"), **how)


@query("observed_counters", with_model("""
SELECT count(*) AS scanned, count(*) FILTER (deleted_at IS NULL) AS live, count(*) FILTER (normalized_title = '') AS untitled, count(*) FILTER (published_at IS NULL) AS undated FROM articles
"""))
def observed_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a stage that normalises and writes all articles counts on the way."""
    a = m.articles(spark, sf_dir)
    c = run_counted(a, lambda rows: written(rows, "normalized"), scanned=None, live=F.col("deleted_at").isNull(), untitled=F.col("normalized_title") == "", undated=F.col("published_at").isNull())
    return spark.createDataFrame([tuple(c.values())], ", ".join(f"{k} long" for k in c))
