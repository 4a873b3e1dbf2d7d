"""Queries of stages, updates and plug-ins over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storyweft.functions import sql
from storyweft.operators import embed, mutations, normalize, translate
from storyweft.plans import adapter as m
from storyweft.plans import arguments
from storyweft.plans.adapter import AS_OF, live, normal_sql, table, with_model
from storyweft.plans.registry import query
from storyweft.plans.text_queries import TITLE
from storyweft.sources import feeds, items
from storyweft.streaming import incremental


@query("update_story", with_model("""
SELECT story_id, CASE WHEN story_id % 10 = 1 THEN 'renamed' ELSE canonical_title END AS canonical_title, CASE WHEN story_id % 10 = 1 THEN 'suppressed' ELSE status END AS status,
       CASE WHEN story_id % 10 = 1 THEN 'moved' ELSE collection END AS collection, CASE WHEN story_id % 10 = 1 THEN 'https://example.com/x' ELSE canonical_url END AS canonical_url,
       sha256(CASE WHEN story_id % 10 = 1 THEN 'https://example.com/x' ELSE canonical_url END) AS url_hash FROM stories
"""))
def update_story(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = m.stories(spark, sf_dir).select("story_id", "canonical_title", "status", "collection", "canonical_url").withColumn("url_hash", F.sha2("canonical_url", 256))
    change = {"title": F.lit(" renamed "), "status": F.lit("suppressed"), "collection": F.lit(" Moved"), "link": F.lit("https://EXAMPLE.com/x/?utm_source=a")}
    return mutations.update_story(s, F.col("story_id") % 10 == 1, **change)


@query("delete_preview", with_model("""
SELECT 'articles' AS name, count(*) AS rows FROM live WHERE collection = 'de' UNION ALL SELECT 'stories', count(*) FROM stories WHERE collection = 'de'
"""))
def delete_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = m.article_rows(spark, sf_dir).select("article_id", "collection", "deleted_at")
    s = m.stories(spark, sf_dir).select("story_id", "collection").withColumn("deleted_at", F.lit(None).cast("timestamp"))
    out = None
    for name, key, t in (("articles", "article_id", a), ("stories", "story_id", s)):
        n = mutations.affected(t, mutations.soft_delete(t, F.col("collection") == "de", AS_OF), key).select(F.lit(name).alias("name"), "rows")
        out = n if out is None else out.unionByName(n)
    return out


@query("title_changes", with_model("SELECT article_id, 'normalized_title' AS field, normalized_title AS was, 'new' AS now FROM live WHERE article_id % 100 = 3 AND normalized_title <> 'new'"))
def title_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = live(m.article_rows(spark, sf_dir)).select("article_id", "normalized_title")
    after = a.withColumn("normalized_title", F.when(F.col("article_id") % 100 == 3, "new").otherwise(F.col("normalized_title")))
    return mutations.changes(a, after, "article_id")


@query("representatives", with_model("SELECT s.story_id, r.article_id IS NOT NULL AND r.source <> 'src4' AS has_representative, CASE WHEN r.source <> 'src4' THEN r.source || ':' || r.source_item_id ELSE '' END AS label FROM stories s LEFT JOIN live r ON r.article_id = s.story_id"))
def representatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = live(m.article_rows(spark, sf_dir)).select(F.col("article_id").alias("story_id"), F.when(F.col("source") != "src4", F.col("source")).alias("source"), "source_item_id")
    whole = F.col("story_id").isNotNull() & F.col("source").isNotNull() & F.col("source_item_id").isNotNull()
    s = m.stories(spark, sf_dir).select("story_id").join(r, "story_id", "left").withColumn("representative", F.when(whole, F.struct("story_id", "source", "source_item_id")))
    return s.select("story_id", F.col("representative").isNotNull().alias("has_representative"), F.coalesce(F.concat("representative.source", F.lit(":"), "representative.source_item_id"), F.lit("")).alias("label"))


@query("feed_filters", with_model("SELECT story_id, collection FROM stories WHERE collection = 'fr' AND last_seen_at >= TIMESTAMP '2024-01-01' AND last_seen_at < TIMESTAMP '2024-01-03' ORDER BY last_seen_at DESC, story_id DESC LIMIT 200"))
def feed_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = m.stories(spark, sf_dir)
    s = arguments.where(s, arguments.same(F.col("collection"), "fr"), arguments.same(F.col("content_hash"), None), arguments.time_filter(F.col("last_seen_at"), day="2024-01-05", first="2024-01-01", last="2024-01-02"))
    return s.orderBy(F.desc("last_seen_at"), F.desc("story_id")).limit(arguments.bounded("200", arguments.SIZE)).select("story_id", "collection")


@query("languages", "SELECT code, count(doc_id) AS n FROM (SELECT unnest(['ar', 'de', 'en', 'es', 'fr', 'id', 'it', 'ja', 'ko', 'pl', 'pt', 'ru', 'th', 'tr', 'vi', 'zh']) AS code) LEFT JOIN documents ON lang = code GROUP BY 1")
def languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The languages that can be translated into, and how many documents each has."""
    n = table(spark, sf_dir, "documents").groupBy(F.col("lang").alias("code")).agg(F.count("*").alias("n"))
    return translate.supported(spark).select("code").join(n, "code", "left").select("code", F.coalesce("n", F.lit(0)).alias("n"))


@query("normalize_stage", f"""
SELECT doc_id AS raw_arrival_id, 'https://example.com/' || doc_id::VARCHAR || '?a=1' AS canonical_url, 'example.com' AS source_domain, lang AS collection, CASE WHEN doc_id % 2 = 0 THEN 'en' ELSE 'de' END AS normalized_language,
       sha256({normal_sql(TITLE)} || chr(10) || {normal_sql('text')}) AS content_hash FROM documents WHERE {TITLE} <> ''
""")
def normalize_stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    meta = F.struct(F.concat(F.lit(" "), F.upper("lang")).alias("collection"))
    link = F.concat(F.lit("https://Example.com:443/"), i.cast("string"), F.lit("/?utm_source=x&a=1#top"))
    payload = F.to_json(F.struct(F.substring("text", 1, 80).alias("title"), F.col("text").alias("body_text"), F.when(i % 2 == 0, "EN-us").otherwise("de").alias("language"), link.alias("canonical_url"), meta.alias("source_metadata")))
    none = F.lit(None).cast("timestamp")
    raw = table(spark, sf_dir, "documents").filter(F.substring("text", 1, 80) != "").select(i.alias("raw_arrival_id"), "source", i.cast("string").alias("source_item_id"), F.lit(None).cast("string").alias("collection"), F.lit(None).cast("string").alias("url"), none.alias("source_published_at"), none.alias("fetched_at"), payload.alias("raw_payload"))
    return normalize.normalize(raw).select("raw_arrival_id", "canonical_url", "source_domain", "collection", "normalized_language", "content_hash")


@query("payload_hashes", "SELECT event_id, sha256(replace(props, ': ', ':')) AS payload_hash FROM events")
def payload_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest of the canonical form of the events' JSON."""
    return table(spark, sf_dir, "events").select("event_id", items.payload_hash("props").alias("payload_hash"))


@query("hash_embeddings")
def hash_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = live(m.raw_articles(spark, sf_dir)).select("article_id", "title", "body")
    return embed.embed(a, lambda: embed.HashBackend(64), "hash", "1")


@query("embedding_digests", with_model("""
, a AS (SELECT article_id, array_to_string(list_filter([trim(title), trim(body)], lambda x: x <> ''), chr(10) || chr(10)) AS t FROM live),
h AS (SELECT article_id, sha256(t || chr(10) || '0') || sha256(t || chr(10) || '1') || sha256(t || chr(10) || '2') || sha256(t || chr(10) || '3') AS x FROM a WHERE t <> ''),
v AS (SELECT article_id, list_transform(range(64), lambda k: ('0x' || substring(x, 4 * k + 3, 2) || substring(x, 4 * k + 1, 2))::INT / 32767.5 - 1) AS v FROM h)
SELECT article_id, round(v[1] / sqrt(list_inner_product(v, v)), 4) + 0.0::DOUBLE AS first, round(v[64] / sqrt(list_inner_product(v, v)), 4) + 0.0::DOUBLE AS last, round(list_sum(v) / sqrt(list_inner_product(v, v)), 3) + 0.0::DOUBLE AS total FROM v
"""))
def embedding_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First and last component, and the sum of all, of hash_embeddings' vectors."""
    e = hash_embeddings(spark, sf_dir).select("article_id", F.transform("embedding", lambda x: x.cast("double")).alias("e"))
    return e.select("article_id", *[(x + F.lit(0.0)).alias(c) for c, x in (("first", F.round(F.element_at("e", 1), 4)), ("last", F.round(F.element_at("e", -1), 4)), ("total", F.round(F.aggregate("e", F.lit(0.0), lambda s, x: s + x), 3)))])  # no negative zero


@query("translate_run", f"SELECT DISTINCT 'article_title' AS source_type, doc_id AS source_id, 'en' AS target_lang, '[en] ' || {TITLE} AS translated_text FROM documents WHERE lang <> 'en' AND trim({TITLE}) <> ''")
def translate_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = m.article_rows(spark, sf_dir)
    tasks = a.filter(F.trim("title") != "").select(F.lit("article_title").alias("source_type"), F.col("article_id").alias("source_id"), F.col("collection").alias("source_lang"), F.col("title").alias("text"))
    cache = spark.createDataFrame([], "source_type string, source_id long, content_hash string, target_lang string")
    return translate.run(translate.planned(tasks, cache, "en"), "en", translate.Tagged).select("source_type", "source_id", "target_lang", "translated_text")


@query("digest_markdown", f"""
WITH t AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS rank, '- [' || doc_id::VARCHAR || '](' || 'https://example.com/' || doc_id::VARCHAR || ')' || CASE WHEN trim({TITLE}) <> '' THEN ': ' || substring({TITLE}, 1, 200) ELSE '' END AS line FROM documents QUALIFY rank <= 15)
SELECT source, '## ' || source || chr(10) || chr(10) || string_agg(line, chr(10) ORDER BY rank) AS text FROM t GROUP BY source
""")
def digest_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars", F.substring("text", 1, 80).alias("summary"))
    i = F.col("doc_id").cast("string")
    top = feeds.top_per(d.withColumn("title", i).withColumn("link", F.concat(F.lit("https://example.com/"), i)), "source", [F.desc("n_chars"), F.asc("doc_id")], 15)
    return feeds.markdown_digest(top, "source")


@query("session_windows", """
WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events),
s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n FROM s GROUP BY user_id, k
""")
def session_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An engine feature over the event table; the news model itself has no sessions."""
    return incremental.sessions(table(spark, sf_dir, "events")).select("user_id", m.stamp(F.col("start")).alias("start"), "n")


@query("sql_functions", f"SELECT doc_id, sha256({normal_sql(TITLE)}) AS norm_sha, doc_id % 100 / 100.0 >= 0.89 AND doc_id % 100 / 100.0 < 0.935 AS gray FROM documents")
def sql_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    sql.register(spark)
    return table(spark, sf_dir, "documents").selectExpr("doc_id", "sha2(sw_normalize(substring(text, 1, 80)), 256) AS norm_sha", "sw_gray_zone(CAST(doc_id % 100 AS DOUBLE) / 100) AS gray")


