"""The news model over the driver's tables, in Spark and as SQL for the oracle.

Articles are documents: collection is lang, the title is the text's first 80 code points, times follow from the id.
Stories are the classes of equal title and body within a collection; the least article id is the representative.

The model is stored: articles (without bodies), stories, members and events are written once for a session and state of
the documents, in folders by collection. Reading queries take these tables; texts are read and hashed only then.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from storyweft.functions.hashing import content_hash
from storyweft.functions.text import normalize_text
from storyweft.operators.components import written

#: The clock of every query.
AS_OF = "2024-01-08 00:00:00"
EPOCH = "2024-01-01 00:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns that need no text work; the scan reads the text only where a query uses it."""
    d = table(spark, sf_dir, "documents")
    at = F.timestamp_micros(F.unix_micros(F.lit(EPOCH).cast("timestamp")) + F.col("doc_id") * 60_000_000)
    return d.select(
        F.col("doc_id").alias("article_id"), "source", F.col("doc_id").cast("string").alias("source_item_id"), F.col("lang").alias("collection"),
        F.substring("text", 1, 80).alias("title"), F.col("text").alias("body"), at.alias("created_at"), F.concat(F.lit("https://"), "source", F.lit(".example.com/"), "lang", F.lit("/"), F.col("doc_id").cast("string")).alias("canonical_url"),
        F.when(F.col("doc_id") % 10 != 9, at).alias("published_at"), F.when(F.col("doc_id") % 50 == 49, at).alias("deleted_at"),
    )


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = raw_articles(spark, sf_dir)
    a = a.withColumn("normalized_title", normalize_text(F.col("title"))).withColumn("normalized_text", normalize_text(F.col("body")))
    return a.withColumn("content_hash", content_hash(F.col("normalized_title"), F.col("normalized_text")))


def live(df: DataFrame) -> DataFrame:
    return df.filter(F.col("deleted_at").isNull())


def uuid_of(kind: str, id_: Column) -> Column:
    """A stable stand-in for a random UUID."""
    return F.regexp_replace(F.md5(F.concat(F.lit(f"{kind}:"), id_.cast("string"))), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")


def _stories(live_articles: DataFrame) -> DataFrame:
    seen, first = F.coalesce("published_at", "created_at"), lambda c: F.min_by(c, "article_id")
    s = live_articles.groupBy("collection", "content_hash").agg(
        F.min("article_id").alias("story_id"), first("title").alias("canonical_title"), first("canonical_url").alias("canonical_url"), F.min("article_id").alias("representative_article_id"),
        F.min(seen).alias("first_seen_at"), F.max(seen).alias("last_seen_at"), F.min("created_at").alias("created_at"), F.max("created_at").alias("last_event_at"),
        F.count("*").alias("article_count"), F.countDistinct("source").alias("source_count"),
    )
    return s.withColumn("story_uuid", uuid_of("story", F.col("story_id"))).withColumn("status", F.when(F.col("story_id") % 20 == 1, "suppressed").otherwise("active"))


def _members(live_articles: DataFrame, s: DataFrame) -> DataFrame:
    m = live_articles.join(s.select("collection", "content_hash", "story_id"), ["collection", "content_hash"])
    kind = F.when(F.col("article_id") == F.col("story_id"), "seed").otherwise("exact_content_hash")
    return m.select(
        "story_id", "article_id", "article_uuid", "collection", "source", "source_item_id", "title", "canonical_url", "created_at", "published_at", kind.alias("match_type"), F.lit(1.0).alias("match_score"),
        F.to_json(F.struct(kind.alias("signal"))).alias("match_details"), F.col("created_at").alias("matched_at"),
    )


def _events(m: DataFrame) -> DataFrame:
    seed = F.col("match_type") == "seed"
    return m.select(
        "article_id", F.col("story_id").alias("chosen_story_id"), F.when(~seed, F.col("story_id")).alias("best_candidate_story_id"), "collection", F.when(seed, "new_story").otherwise("auto_merge").alias("decision"),
        F.when(~seed, F.col("match_type")).alias("exact_signal"), F.when(~seed, F.col("match_score")).alias("composite_score"), F.col("matched_at").alias("created_at"),
    )


_stores: dict[tuple, dict[str, DataFrame]] = {}


def _state(spark: SparkSession, sf_dir: str) -> tuple:
    """Tells whether the documents are as they were: their size and time of change."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/documents.parquet")
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return spark.sparkContext.applicationId, sf_dir, fs.getContentSummary(path).getLength(), fs.getFileStatus(path).getModificationTime()


def store(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """articles, stories, members and events as stored tables."""
    key = _state(spark, sf_dir)
    if key not in _stores:
        a = articles(spark, sf_dir).drop("body", "normalized_text").withColumn("article_uuid", uuid_of("article", F.col("article_id")))
        a = written(a, "articles", "collection")
        s = written(_stories(live(a)), "stories", "collection")
        m = written(_members(live(a), s), "members", "collection")
        _stores[key] = {"articles": a, "stories": s, "members": m, "events": written(_events(m), "events", "collection")}
    return _stores[key]


def article_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All articles, deleted ones too, without bodies."""
    return store(spark, sf_dir)["articles"]


def stories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store(spark, sf_dir)["stories"]


def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store(spark, sf_dir)["members"]


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store(spark, sf_dir)["events"]


def translations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns as translation results: one target language for each role."""
    c = table(spark, sf_dir, "conversations")
    return c.select(F.col("conv_id").alias("source_id"), F.col("turn").alias("result_id"), F.col("role").alias("target_lang"), F.when(F.col("turn") % 2 == 0, "article_title").otherwise("article_text").alias("source_type"), F.col("text").alias("translated_text"))


NORMAL = r"trim(regexp_replace(regexp_replace(lower({0}), '[\x00-\x08\x0e-\x1f\x7f\x{{80}}-\x{{84}}\x{{86}}-\x{{9f}}]', '', 'g'), '[\t-\r \x{{85}}\p{{Z}}]+', ' ', 'g'))"


def normal_sql(x: str) -> str:
    return NORMAL.format(x)


def uuid_sql(kind: str, x: str) -> str:
    return rf"regexp_replace(md5('{kind}:' || ({x})::VARCHAR), '^(.{{8}})(.{{4}})(.{{4}})(.{{4}})(.{{12}})$', '\1-\2-\3-\4-\5')"


MODEL_SQL = rf"""
raw AS (
  SELECT doc_id AS article_id, source, doc_id::VARCHAR AS source_item_id, lang AS collection, substring(text, 1, 80) AS title, text AS body,
         TIMESTAMP '{EPOCH}' + to_minutes(doc_id) AS created_at, 'https://' || source || '.example.com/' || lang || '/' || doc_id::VARCHAR AS canonical_url,
         CASE WHEN doc_id % 10 <> 9 THEN TIMESTAMP '{EPOCH}' + to_minutes(doc_id) END AS published_at,
         CASE WHEN doc_id % 50 = 49 THEN TIMESTAMP '{EPOCH}' + to_minutes(doc_id) END AS deleted_at
  FROM documents
), articles AS (
  SELECT *, sha256(normalized_title || chr(10) || normalized_text) AS content_hash
  FROM (SELECT *, {normal_sql('title')} AS normalized_title, {normal_sql('body')} AS normalized_text, {uuid_sql('article', 'article_id')} AS article_uuid FROM raw)
), live AS (SELECT * FROM articles WHERE deleted_at IS NULL
), stories AS (
  SELECT collection, content_hash, min(article_id) AS story_id, arg_min(title, article_id) AS canonical_title,
         min(coalesce(published_at, created_at)) AS first_seen_at, max(coalesce(published_at, created_at)) AS last_seen_at,
         arg_min(canonical_url, article_id) AS canonical_url, min(article_id) AS representative_article_id, min(created_at) AS created_at,
         {uuid_sql('story', 'min(article_id)')} AS story_uuid, CASE WHEN min(article_id) % 20 = 1 THEN 'suppressed' ELSE 'active' END AS status
  FROM live GROUP BY collection, content_hash
), members AS (
  SELECT s.story_id, a.article_id, a.article_uuid, a.collection, a.source, a.source_item_id, a.title, a.canonical_url, a.created_at, a.published_at,
         CASE WHEN a.article_id = s.story_id THEN 'seed' ELSE 'exact_content_hash' END AS match_type, 1.0::DOUBLE AS match_score,
         a.created_at AS matched_at
  FROM live a JOIN stories s USING (collection, content_hash)
), ev AS (
  SELECT article_id, story_id AS chosen_story_id, collection, CASE WHEN match_type = 'seed' THEN 'new_story' ELSE 'auto_merge' END AS decision,
         CASE WHEN match_type <> 'seed' THEN match_type END AS exact_signal, CASE WHEN match_type <> 'seed' THEN story_id END AS best_candidate_story_id,
         matched_at AS created_at FROM members
), tr AS (
  SELECT conv_id AS source_id, turn AS result_id, role AS target_lang,
         CASE WHEN turn % 2 = 0 THEN 'article_title' ELSE 'article_text' END AS source_type, text AS translated_text FROM conversations
)
"""


def with_model(sql: str) -> str:
    """A query over raw, articles, live, stories, members, ev and tr."""
    return f"WITH {MODEL_SQL.strip()}{sql if sql.lstrip().startswith(',') else chr(10) + sql}"


def stamp(x) -> Column:
    return F.date_format(x, "yyyy-MM-dd HH:mm:ss")


def stamp_sql(x: str) -> str:
    return f"strftime({x}, '%Y-%m-%d %H:%M:%S')"
