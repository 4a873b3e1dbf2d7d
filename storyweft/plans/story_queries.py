"""Queries over articles, stories, members, events, embeddings and translations."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from storyweft.functions import hashing, scoring, text, timefn
from storyweft.operators import cascade, components, dedup, embed, evaluate, mutations, rules, translate
from storyweft.plans import adapter as m
from storyweft.plans.adapter import AS_OF, live, normal_sql, stamp, stamp_sql, table, with_model
from storyweft.plans.cascade_queries import PLANTED_SQL, planted_vectors
from storyweft.plans.registry import query
from storyweft.plans.text_queries import SIMHASH_SQL, TITLE, TOKENS_SQL
from storyweft.streaming import incremental

# Candidate joins -----------------------------------------------------------------------------------------------------


def _titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("block"), F.substring("text", 1, 80).alias("title"))


@query("simhash_pairs", f"""
WITH {SIMHASH_SQL}, d AS (SELECT min(doc_id) AS doc_id, lang, simhash FROM documents JOIN sim USING (doc_id) GROUP BY lang, simhash)
SELECT p.doc_id AS a, q.doc_id AS b, bit_count(xor(p.simhash, q.simhash))::INT AS distance, 1 - bit_count(xor(p.simhash, q.simhash)) / 64 AS score
FROM d p JOIN d q ON p.lang = q.lang AND p.doc_id < q.doc_id AND bit_count(xor(p.simhash, q.simhash)) <= 3
""")
def simhash_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of class representatives; simhash_classes has the members."""
    return dedup.simhash_pairs(_simhashes(spark, sf_dir)).withColumn("score", hashing.simhash_score(F.col("distance")))


def _simhashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _titles(spark, sf_dir).select("id", "block", hashing.simhash64(text.tokens(F.col("title"))).alias("simhash"))


@query("simhash_classes", f"WITH {SIMHASH_SQL} SELECT doc_id AS id, min(doc_id) OVER (PARTITION BY lang, simhash) AS rep FROM documents JOIN sim USING (doc_id) WHERE simhash IS NOT NULL")
def simhash_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.classes(_simhashes(spark, sf_dir), F.col("simhash"))


@query("token_jaccard_pairs", f"""
WITH t AS (SELECT min(doc_id) AS doc_id, lang, w FROM (SELECT doc_id, lang, list_sort(list_distinct({TOKENS_SQL})) AS w FROM documents) GROUP BY lang, w),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, len(list_intersect(x.w, y.w)) AS i, len(x.w) AS n, len(y.w) AS k FROM t x JOIN t y ON x.lang = y.lang AND x.doc_id < y.doc_id WHERE len(x.w) > 0 AND len(y.w) > 0)
SELECT a, b, round(i / (n + k - i), 6) AS overlap FROM p WHERE i / (n + k - i) >= 0.6
""")
def token_jaccard_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of class representatives; token_classes has the members."""
    return dedup.overlap_pairs(_token_sets(spark, sf_dir), 0.6).select("a", "b", F.round("overlap", 6).alias("overlap"))


def _token_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _titles(spark, sf_dir).select("id", "block", F.array_distinct(text.tokens(F.col("title"))).alias("grams"))


@query("token_classes", f"SELECT doc_id AS id, min(doc_id) OVER (PARTITION BY lang, w) AS rep FROM (SELECT doc_id, lang, list_sort(list_distinct({TOKENS_SQL})) AS w FROM documents) WHERE len(w) > 0")
def token_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _token_sets(spark, sf_dir)
    return dedup.classes(t, dedup.gram_key(F.col("grams")))


@query("trigram_overlap_pairs", f"""
WITH n AS (SELECT doc_id, lang, {normal_sql(TITLE)} AS t FROM documents),
t AS (SELECT doc_id, lang, list_filter(list_distinct(list_transform(range(1, greatest(length(t) - 2, 1) + 1), lambda i: substring(t, i, 3))), lambda x: x <> '') AS w FROM n),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, len(list_intersect(x.w, y.w)) AS i, len(x.w) AS n, len(y.w) AS k FROM t x JOIN t y ON x.lang = y.lang AND x.doc_id < y.doc_id
      WHERE len(x.w) > 0 AND len(y.w) > 0 AND least(len(x.w), len(y.w)) >= 0.85 * greatest(len(x.w), len(y.w))),
d AS (SELECT *, i / (n + k - i) AS o, CASE WHEN (b - a) <= 48 * 60 THEN 1.0 WHEN (b - a) <= 168 * 60 THEN 0.6 ELSE 0.0 END AS c FROM p)
SELECT a, b, round(o, 6) AS overlap, round(0.8 * o + 0.2 * c, 6) AS composite FROM d WHERE o >= 0.88 AND (b - a) <= 14 * 24 * 60
""")
def trigram_overlap_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _titles(spark, sf_dir).select("id", "block", text.trigrams(F.col("title")).alias("grams"))
    p = dedup.overlap_pairs(t, scoring.TRIGRAM_OVERLAP)
    # The date, and so the score, differs within a class: pairs of members are the result here.
    p = dedup.expanded(p, dedup.classes(t, dedup.gram_key(F.col("grams"))), 60 * 24 * scoring.OVERLAP_DAYS).fillna(1.0, ["overlap"])  # ids are minutes
    at = lambda c: F.timestamp_micros(F.col(c) * 60_000_000)
    p = p.filter(timefn.within_days(at("a"), at("b"), scoring.OVERLAP_DAYS))
    c = scoring.overlap_composite(F.col("overlap"), timefn.date_consistency(at("a"), at("b")))
    return p.select("a", "b", F.round("overlap", 6).alias("overlap"), F.round(c, 6).alias("composite"))


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.filter(scoring.valid_vector(F.col("embedding"), 64)).select(F.col("vec_id").alias("id"), F.col("label").alias("block"), F.col("embedding").alias("vector"))


COSINE_SQL = """v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
c AS (SELECT p.vec_id AS id, q.vec_id AS neighbour, list_inner_product(p.e, q.e) / (sqrt(list_inner_product(p.e, p.e)) * sqrt(list_inner_product(q.e, q.e))) AS cosine
      FROM v p JOIN v q ON p.label = q.label AND p.vec_id <> q.vec_id)"""


@query("cosine_topk", f"""
WITH {COSINE_SQL}
SELECT id, neighbour, round(cosine, 6) AS cosine, row_number() OVER (PARTITION BY id ORDER BY round(cosine, 9) DESC, neighbour)::INT AS rank FROM c QUALIFY rank <= 20
""")
def cosine_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.nearest(_vectors(spark, sf_dir)).select("id", "neighbour", F.round("cosine", 6).alias("cosine"), "rank")


PLANTED_COSINE_SQL = f"""{PLANTED_SQL}, c AS (SELECT p.vec_id AS id, q.vec_id AS neighbour, list_inner_product(p.e, q.e) / (sqrt(list_inner_product(p.e, p.e)) * sqrt(list_inner_product(q.e, q.e))) AS cosine
      FROM v p JOIN v q ON p.label = q.label AND p.vec_id <> q.vec_id)"""

SCORED_SQL = f"""{PLANTED_COSINE_SQL}, k AS (SELECT id, neighbour, cosine, row_number() OVER (PARTITION BY id ORDER BY round(cosine, 9) DESC, neighbour) AS rank FROM c QUALIFY rank <= 20),
t AS (SELECT doc_id, list_distinct({TOKENS_SQL}) AS w FROM documents),
p AS (SELECT id, neighbour, rank, cosine, len(list_intersect(x.w, y.w)) AS i, len(x.w) AS n, len(y.w) AS m FROM k JOIN t x ON x.doc_id = id JOIN t y ON y.doc_id = neighbour),
s AS (SELECT id, neighbour, rank, cosine, CASE WHEN n = 0 OR m = 0 THEN 0.0 ELSE i / (n + m - i) END AS title, CASE WHEN abs(neighbour - id) <= 48 * 60 THEN 1.0 WHEN abs(neighbour - id) <= 168 * 60 THEN 0.6 ELSE 0.0 END AS date FROM p),
d AS (SELECT *, greatest(0, least(1, 0.75 * cosine + 0.15 * title + 0.10 * date)) AS composite, cosine >= 0.965 OR (cosine >= 0.935 AND title >= 0.30) AS auto, cosine >= 0.89 AND cosine < 0.935 AS gray FROM s)"""


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest entries of each, with title overlap, date consistency, composite and flags."""
    near = dedup.nearest(planted_vectors(spark, sf_dir)).select(F.col("id").alias("a"), F.col("neighbour").alias("b"), "cosine", "rank")
    w = _titles(spark, sf_dir).select("id", text.tokens(F.col("title")).alias("w"))
    p = near.join(w.toDF("a", "wa"), "a").join(w.toDF("b", "wb"), "b")
    at = lambda c: F.timestamp_micros(F.col(c) * 60_000_000)
    p = p.withColumn("title", text.set_jaccard(F.col("wa"), F.col("wb"))).withColumn("date", timefn.date_consistency(at("a"), at("b")))
    return dedup.decisions(p)


@query("semantic_decisions", f"WITH {SCORED_SQL} SELECT id, neighbour, rank::INT AS rank, round(composite, 6) AS composite, auto, gray FROM d")
def semantic_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir).select(F.col("a").alias("id"), F.col("b").alias("neighbour"), "rank", F.round("composite", 6).alias("composite"), "auto", "gray")


@query("semantic_choice", f"""
WITH {SCORED_SQL}, o AS (SELECT id, min(rank) FILTER (auto) AS first_passing, arg_max(rank, (round(composite, 9), -rank)) AS best FROM d GROUP BY id)
SELECT o.id, coalesce(x.neighbour, y.neighbour) AS chosen, x.neighbour IS NOT NULL AS merged, round(coalesce(x.composite, y.composite), 6) AS composite
FROM o LEFT JOIN d x ON x.id = o.id AND x.rank = first_passing JOIN d y ON y.id = o.id AND y.rank = best
""")
def semantic_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the nearest entries the first that merges, else the one of the best composite, the nearer of equal ones. Vectors
    have planted neighbours, so that all outcomes occur."""
    d = _scored(spark, sf_dir)
    chosen = dedup.choice(d, F.col("auto"))
    return chosen.select(F.col("a").alias("id"), F.col("b").alias("chosen"), "merged", F.round("composite", 6).alias("composite"))


@query("vector_validation", "SELECT label, count(*) FILTER (len(embedding) = 64 AND list_bool_and(list_transform(embedding, lambda x: isfinite(x)))) AS valid, count(*) AS total FROM embeddings GROUP BY label")
def vector_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.groupBy("label").agg(F.count_if(scoring.valid_vector(F.col("embedding"), 64)).alias("valid"), F.count("*").alias("total"))


@query("vector_dimensions", "SELECT vec_id, vec_id % 7 <> 0 AND list_bool_and(list_transform(embedding, lambda x: isfinite(x))) AS valid FROM embeddings")
def vector_dimensions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of the model's 4,096 dimensions, here made of 64 copies; some lack one."""
    long = F.flatten(F.array_repeat("embedding", embed.DIMENSIONS // 64))
    v = F.when(F.col("vec_id") % 7 == 0, F.slice(long, 1, embed.DIMENSIONS - 1)).otherwise(long)
    return table(spark, sf_dir, "embeddings").select("vec_id", scoring.valid_vector(v, embed.DIMENSIONS).alias("valid"))


@query("novelty_gating", """
WITH v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings), n AS (SELECT * FROM v WHERE vec_id % 5 = 0), o AS (SELECT * FROM v WHERE vec_id % 5 <> 0)
SELECT n.vec_id AS id, round(max(list_inner_product(n.e, o.e) / (sqrt(list_inner_product(n.e, n.e)) * sqrt(list_inner_product(o.e, o.e)))), 6) AS recent_max_cosine
FROM n JOIN o ON n.label = o.label GROUP BY 1
""")
def novelty_gating(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A proposal, not a stage yet: the largest cosine against recent entries of the same collection."""
    v = _vectors(spark, sf_dir)
    return dedup.nearest(v.filter("id % 5 = 0"), 1, v.filter("id % 5 <> 0")).select("id", F.round("cosine", 6).alias("recent_max_cosine"))


RULES_SQL = """k AS (
  SELECT item_id AS rule, item_id % 7 AS topic_id, CASE WHEN item_id % 11 = 0 THEN 'exclude' ELSE 'include' END AS rule_type, CASE WHEN item_id % 5 = 0 THEN '(^| )' ELSE '' END || regexp_extract(lower(text), '[a-z]{4,8}') AS pattern,
         item_id % 5 = 0 AS is_regex, item_id % 3 + 1 AS weight FROM benchmark WHERE item_id % 13 <> 0 AND regexp_extract(lower(text), '[a-z]{4,8}') <> ''
), s AS (SELECT DISTINCT s_suppkey % 7 AS topic_id, 'src' || (s_suppkey % 20)::VARCHAR AS source, CASE WHEN s_suppkey % 7 = 3 THEN 'include' ELSE 'exclude' END AS rule_type FROM supplier WHERE s_suppkey % 9 = 0 OR s_suppkey % 7 = 3)"""


@query("topic_rules", f"""
WITH {RULES_SQL}, d AS (SELECT doc_id, source, lower(text) AS t FROM documents),
h AS (SELECT doc_id, source, topic_id, rule_type, weight FROM d JOIN k ON CASE WHEN is_regex THEN regexp_matches(t, pattern) ELSE contains(t, pattern) END),
m AS (SELECT doc_id, source, topic_id, sum(weight) FILTER (rule_type = 'include')::BIGINT AS weight, count(*) FILTER (rule_type = 'include') AS rules, count(*) FILTER (rule_type = 'exclude') AS against FROM h GROUP BY ALL)
SELECT doc_id, topic_id, weight, rules FROM m WHERE rules > 0 AND against = 0 AND NOT EXISTS (SELECT 1 FROM s WHERE s.topic_id = m.topic_id AND s.source = m.source AND rule_type = 'exclude')
  AND (NOT EXISTS (SELECT 1 FROM s WHERE s.topic_id = m.topic_id AND rule_type = 'include') OR EXISTS (SELECT 1 FROM s WHERE s.topic_id = m.topic_id AND s.source = m.source AND rule_type = 'include'))
""")
def topic_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Topics of whole texts by rule tables: keyword rules are words of the benchmark's items, source rules follow from suppliers."""
    b, i = table(spark, sf_dir, "benchmark"), F.col("item_id")
    word = F.regexp_extract(F.lower("text"), "[a-z]{4,8}", 0)
    keywords = b.filter(word != "").select(
        (i % 7).alias("topic_id"), F.when(i % 11 == 0, "exclude").otherwise("include").alias("rule_type"), F.concat(F.when(i % 5 == 0, F.lit("(^| )")).otherwise(""), word).alias("pattern"), (i % 5 == 0).alias("is_regex"), (i % 3 + 1).alias("weight"), (i % 13 != 0).alias("enabled"),
    )
    k = F.col("s_suppkey")
    sources = table(spark, sf_dir, "supplier").filter((k % 9 == 0) | (k % 7 == 3)).select((k % 7).alias("topic_id"), F.concat(F.lit("src"), (k % 20).cast("string")).alias("source"), F.when(k % 7 == 3, "include").otherwise("exclude").alias("rule_type"))
    texts = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "source", "text")
    return rules.topics(texts, keywords, sources).select(F.col("id").alias("doc_id"), "topic_id", "weight", "rules")


@query("greedy_dedup")
def greedy_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = live(m.article_rows(spark, sf_dir))
    p = table(spark, sf_dir, "pages").select(F.col("page_id").alias("article_id"), "url")
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("article_id"), F.col("embedding").alias("vector"))
    return cascade.parallel_stories(a.join(p, "article_id", "left").join(v, "article_id", "left"), sequence=cascade.SEQUENCE)


@query("greedy_lookback")
def greedy_lookback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cascade with a horizon six days before a clock: stories last seen earlier are not compared by title or vector."""
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("article_id"), F.col("embedding").alias("vector"))
    a = live(m.article_rows(spark, sf_dir)).withColumn("url", F.lit(None).cast("string")).join(v, "article_id", "left")
    clock = dt.datetime.fromisoformat("2024-01-07 04:00:00+00:00").timestamp()
    return cascade.parallel_stories(a, as_of=clock, lookback_days=6, sequence=cascade.SEQUENCE)


@query("exact_candidates", """
WITH a AS (SELECT doc_id, lang, source, split_part(url, '?', 1) AS u, sha256(text) AS h, source || ':' || (n_chars)::VARCHAR AS i FROM documents LEFT JOIN pages ON page_id = doc_id)
SELECT doc_id AS id, CASE WHEN u IS NOT NULL THEN min(doc_id) OVER (PARTITION BY lang, u) ELSE -1 END AS by_url, min(doc_id) OVER (PARTITION BY lang, i) AS by_item, min(doc_id) OVER (PARTITION BY lang, h) AS by_content FROM a
""")
def exact_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The exact step over sets: for each article the first of its collection with its URL, its source's item id, its
    content. The greedy pass takes stories instead, in the order of these three keys."""
    p = table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), F.substring_index("url", "?", 1).alias("u"))
    a = table(spark, sf_dir, "documents").join(p, "doc_id", "left").select(F.col("doc_id").alias("id"), F.col("lang").alias("block"), "u", F.concat("source", F.lit(":"), F.col("n_chars").cast("string")).alias("i"), F.sha2("text", 256).alias("h"))
    out = a.select("id")
    for name, key in (("by_url", "u"), ("by_item", "i"), ("by_content", "h")):
        out = out.join(dedup.classes(a, F.col(key)).withColumnRenamed("rep", name), "id", "left")
    return out.fillna(-1)


@query("best_url_story", with_model("""
SELECT split_part(url, '?', 1) AS u, story_id FROM stories JOIN pages ON page_id = story_id WHERE status = 'active'
QUALIFY row_number() OVER (PARTITION BY split_part(url, '?', 1), collection ORDER BY last_seen_at DESC, story_id DESC) = 1
"""))
def best_url_story(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The active story that an article of a URL and collection would join: the one seen last."""
    p = table(spark, sf_dir, "pages").select(F.col("page_id").alias("story_id"), F.substring_index("url", "?", 1).alias("u"))
    s = m.stories(spark, sf_dir).filter("status = 'active'").join(p, "story_id")
    return mutations.latest(s, ["u", "collection"], [F.desc("last_seen_at"), F.desc("story_id")]).select("u", "story_id")


@query("connected_components", """
WITH RECURSIVE k AS (SELECT doc_id, [source || ':' || (doc_id % 97)::VARCHAR, 'c' || (n_chars)::VARCHAR] AS ks FROM documents),
u AS (SELECT doc_id, unnest(ks) AS key FROM k), e AS (SELECT DISTINCT x.doc_id AS a, y.doc_id AS b FROM u x JOIN u y USING (key)),
r(id, c) AS (SELECT doc_id, doc_id FROM k UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.id WHERE r.c < e.b)
SELECT id, min(c) AS component FROM r GROUP BY id
""")
def connected_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    rows = d.select(F.col("doc_id").alias("id"), F.concat("source", F.lit(":"), (F.col("doc_id") % 97).cast("string")).alias("k1"), F.concat(F.lit("c"), F.col("n_chars").cast("string")).alias("k2"))
    return components.key_components(rows, ["k1", "k2"])


F1_SQL = """c AS (SELECT truth, predicted, count(*) AS n FROM l GROUP BY ALL), t AS (SELECT truth, sum(n)::BIGINT AS n FROM c GROUP BY ALL), p AS (SELECT predicted, sum(n)::BIGINT AS n FROM c GROUP BY ALL),
o AS (SELECT (SELECT sum(n) FROM t)::BIGINT AS items, (SELECT sum(n * (n - 1) // 2) FROM c)::BIGINT AS tp, (SELECT sum(n * (n - 1) // 2) FROM t)::BIGINT AS tt, (SELECT sum(n * (n - 1) // 2) FROM p)::BIGINT AS pp)
SELECT items, tp, pp - tp AS fp, tt - tp AS fn, items * (items - 1) // 2 - pp - tt + tp AS tn, round(tp / pp, 6) AS precision, round(tp / tt, 6) AS recall,
       round(2 * (tp / pp) * (tp / tt) / (tp / pp + tp / tt), 6) AS f1, (SELECT count(*) FROM t) AS truth_clusters, (SELECT count(*) FROM p) AS predicted_clusters FROM o"""


@query("pairwise_f1", f"WITH l AS (SELECT lang || source AS truth, lang || source || (n_chars % 2)::VARCHAR AS predicted FROM documents), {F1_SQL}")
def pairwise_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    key = F.concat("lang", "source")
    out = evaluate.pairwise_f1(d.select(key.alias("truth"), F.concat(key, (F.col("n_chars") % 2).cast("string")).alias("predicted")))
    return out.select(*[F.round(c, 6).alias(c) if c in ("precision", "recall", "f1") else c for c in out.columns])


@query("cluster_size_histogram", with_model("SELECT n AS size, count(*) AS clusters FROM (SELECT story_id, count(*) AS n FROM members GROUP BY 1) GROUP BY 1"))
def cluster_size_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.size_histogram(m.members(spark, sf_dir), "story_id")


# Read catalogue -------------------------------------------------------------------------------------------------------


@query("story_feed_page", with_model(f"""
SELECT s.story_id, s.collection, s.canonical_title, {stamp_sql('last_seen_at')} AS last_seen, count(*) AS article_count, count(DISTINCT m.source) AS source_count
FROM stories s JOIN members m USING (story_id) WHERE s.collection = 'en' AND contains(lower(s.canonical_title), 'the')
GROUP BY ALL ORDER BY max(last_seen_at) DESC, s.story_id DESC LIMIT 25 OFFSET 25
"""))
def story_feed_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = m.stories(spark, sf_dir).filter((F.col("collection") == "en") & F.col("canonical_title").ilike("%the%"))
    page = s.orderBy(F.desc("last_seen_at"), F.desc("story_id")).offset(25).limit(25)
    return page.select("story_id", "collection", "canonical_title", stamp(F.col("last_seen_at")).alias("last_seen"), "article_count", "source_count")


@query("story_feed_total", with_model("SELECT count(*) AS total, ceil(count(*) / 25)::BIGINT AS pages FROM stories WHERE collection = 'en'"))
def story_feed_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = m.stories(spark, sf_dir).filter("collection = 'en'").agg(F.count("*").alias("total"))
    return s.select("total", F.ceil(F.col("total") / 25).alias("pages"))


@query("story_search", with_model("""
SELECT s.story_id, s.canonical_title, count(*) AS article_count, count(DISTINCT m.source) AS source_count
FROM stories s JOIN members m USING (story_id) WHERE s.canonical_title ILIKE '%er%th%' GROUP BY ALL ORDER BY source_count DESC, article_count DESC, s.story_id DESC LIMIT 50
"""))
def story_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = m.stories(spark, sf_dir).filter(F.col("canonical_title").ilike("%er%th%")).select("story_id", "canonical_title", "article_count", "source_count")
    return s.orderBy(F.desc("source_count"), F.desc("article_count"), F.desc("story_id")).limit(50)


@query("story_event_window", with_model(f"""
SELECT chosen_story_id AS story_id, count(*) AS events, {stamp_sql('max(created_at)')} AS last_event FROM ev
WHERE created_at >= TIMESTAMP '2024-01-01 02:00:00' AND created_at < TIMESTAMP '2024-01-01 12:00:00' GROUP BY 1
"""))
def story_event_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = m.events(spark, sf_dir).filter(timefn.in_window(F.col("created_at"), "2024-01-01 02:00:00", "2024-01-01 12:00:00"))
    return e.groupBy(F.col("chosen_story_id").alias("story_id")).agg(F.count("*").alias("events"), F.max("created_at").alias("t")).select("story_id", "events", stamp(F.col("t")).alias("last_event"))


@query("digest_new_stories", with_model("SELECT collection, count(DISTINCT chosen_story_id) AS stories FROM ev WHERE decision = 'new_story' AND created_at >= TIMESTAMP '2024-01-01' AND created_at < TIMESTAMP '2024-01-02' GROUP BY 1"))
def digest_new_stories(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = m.events(spark, sf_dir).filter((F.col("decision") == "new_story") & timefn.in_days(F.col("created_at"), "2024-01-01", "2024-01-01"))
    return e.groupBy("collection").agg(F.countDistinct("chosen_story_id").alias("stories"))


@query("collection_stats_full_outer", with_model("""
, a AS (SELECT collection AS k, count(*) AS articles FROM live GROUP BY 1), s AS (SELECT collection AS k, count(*) AS stories FROM stories GROUP BY 1),
e AS (SELECT CASE label % 5 WHEN 0 THEN 'de' WHEN 1 THEN 'en' WHEN 2 THEN 'es' WHEN 3 THEN 'fr' ELSE 'und' END AS k, count(*) AS embeddings FROM embeddings GROUP BY 1)
SELECT coalesce(a.k, s.k, e.k) AS collection, coalesce(articles, 0) AS articles, coalesce(stories, 0) AS stories, coalesce(embeddings, 0) AS embeddings
FROM a FULL JOIN s ON a.k = s.k FULL JOIN e ON coalesce(a.k, s.k) = e.k
"""))
def collection_stats_full_outer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three counts by collection: a union and one sum, one shuffle, where full outer joins would take two more."""
    n = lambda c: [F.lit(int(c == x)).cast("long").alias(x) for x in ("articles", "stories", "embeddings")]
    a = live(m.article_rows(spark, sf_dir)).select("collection", *n("articles"))
    s = m.stories(spark, sf_dir).select("collection", *n("stories"))
    k = F.element_at(F.array(*[F.lit(x) for x in ("de", "en", "es", "fr", "und")]), (F.col("label") % 5 + 1).cast("int"))
    e = table(spark, sf_dir, "embeddings").select(k.alias("collection"), *n("embeddings"))
    return a.unionByName(s).unionByName(e).groupBy("collection").agg(*[F.sum(c).alias(c) for c in ("articles", "stories", "embeddings")])


@query("collection_outer_join", with_model("""
, a AS (SELECT collection AS k, count(*) AS n FROM live WHERE source < 'src2' GROUP BY 1), b AS (SELECT source AS k, count(*) AS n FROM live GROUP BY 1)
SELECT coalesce(a.k, b.k) AS key, coalesce(a.n, 0) AS by_collection, coalesce(b.n, 0) AS by_source FROM a FULL JOIN b ON a.k = b.k
"""))
def collection_outer_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = live(m.article_rows(spark, sf_dir))
    a = r.filter("source < 'src2'").groupBy(F.col("collection").alias("key")).agg(F.count("*").alias("by_collection"))
    b = r.groupBy(F.col("source").alias("key")).agg(F.count("*").alias("by_source"))
    return a.join(b, "key", "full_outer").select("key", F.coalesce("by_collection", F.lit(0)).alias("by_collection"), F.coalesce("by_source", F.lit(0)).alias("by_source"))


@query("pipeline_throughput", with_model("""
SELECT (SELECT count(*) FROM raw) AS raw_total, (SELECT count(*) FROM live) AS live_total,
       (SELECT count(*) FROM live WHERE article_id NOT IN (SELECT vec_id FROM embeddings)) AS pending_embed,
       (SELECT count(*) FROM live WHERE article_id IN (SELECT vec_id FROM embeddings) AND article_id % 3 = 0) AS pending_dedup
"""))
def pipeline_throughput(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = m.article_rows(spark, sf_dir).select("article_id", "deleted_at")
    have = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("article_id")).distinct().withColumn("has", F.lit(True))
    j, is_live = r.join(have, "article_id", "left"), F.col("deleted_at").isNull()
    return j.agg(F.count("*").alias("raw_total"), F.count_if(is_live).alias("live_total"), F.count_if(is_live & F.col("has").isNull()).alias("pending_embed"), F.count_if(is_live & F.col("has").isNotNull() & (F.col("article_id") % 3 == 0)).alias("pending_dedup"))


@query("collection_ranges", with_model(f"SELECT collection, {stamp_sql('min(coalesce(published_at, created_at))')} AS first_at, {stamp_sql('max(coalesce(published_at, created_at))')} AS last_at, count(*) AS n FROM live GROUP BY 1"))
def collection_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.coalesce("published_at", "created_at")
    g = live(m.article_rows(spark, sf_dir)).groupBy("collection").agg(F.min(at).alias("a"), F.max(at).alias("b"), F.count("*").alias("n"))
    return g.select("collection", stamp(F.col("a")).alias("first_at"), stamp(F.col("b")).alias("last_at"), "n")


@query("collections_summary", with_model(f"""
, i AS (SELECT story_id, count(*) AS items FROM members GROUP BY 1)
SELECT collection, count(*) AS stories, sum(items)::BIGINT AS story_items, {stamp_sql('max(last_seen_at)')} AS last_seen FROM stories JOIN i USING (story_id) GROUP BY 1
"""))
def collections_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = m.stories(spark, sf_dir).groupBy("collection").agg(F.count("*").alias("stories"), F.sum("article_count").alias("story_items"), F.max("last_seen_at").alias("t"))
    return g.select("collection", "stories", "story_items", stamp(F.col("t")).alias("last_seen"))


@query("story_days_berlin", with_model("SELECT strftime(timezone('Europe/Berlin', timezone('UTC', last_seen_at)), '%Y-%m-%d') AS day, count(*) AS stories FROM stories GROUP BY 1 ORDER BY day DESC LIMIT 30"))
def story_days_berlin(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = m.stories(spark, sf_dir)
    return s.groupBy(timefn.local_day(F.col("last_seen_at"), "Europe/Berlin").alias("day")).agg(F.count("*").alias("stories")).orderBy(F.desc("day")).limit(30)


@query("system_stats", with_model(f"""
SELECT (SELECT count(*) FROM live) AS articles, (SELECT count(*) FROM stories) AS stories, (SELECT count(*) FROM members) AS story_items, (SELECT count(*) FROM ev) AS events,
       (SELECT {stamp_sql('max(created_at)')} FROM live) AS last_article, (SELECT {stamp_sql('max(last_seen_at)')} FROM stories) AS last_story
"""))
def system_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = live(m.article_rows(spark, sf_dir)).agg(F.count("*").alias("articles"), stamp(F.max("created_at")).alias("last_article"))
    s = m.stories(spark, sf_dir).agg(F.count("*").alias("stories"), stamp(F.max("last_seen_at")).alias("last_story"))
    i = m.members(spark, sf_dir).agg(F.count("*").alias("story_items"))
    e = m.events(spark, sf_dir).agg(F.count("*").alias("events"))
    return a.join(s).join(i).join(e).select("articles", "stories", "story_items", "events", "last_article", "last_story")  # single rows


@query("decision_histogram", with_model("SELECT decision, count(*) AS n FROM ev GROUP BY 1"))
def decision_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m.events(spark, sf_dir).groupBy("decision").agg(F.count("*").alias("n"))


@query("stage_counters", with_model("SELECT collection, count(*) AS processed, count(*) FILTER (decision = 'new_story') AS new_stories, count(*) FILTER (decision = 'auto_merge') AS auto_merges, count(*) FILTER (decision = 'gray_zone') AS gray_zones FROM ev GROUP BY 1"))
def stage_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    is_ = lambda d: F.count_if(F.col("decision") == d)
    return m.events(spark, sf_dir).groupBy("collection").agg(F.count("*").alias("processed"), is_("new_story").alias("new_stories"), is_("auto_merge").alias("auto_merges"), is_("gray_zone").alias("gray_zones"))


@query("story_members", with_model("SELECT story_id, article_id, match_type, match_score, row_number() OVER (PARTITION BY story_id ORDER BY matched_at DESC, article_id DESC)::INT AS place FROM members"))
def story_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("story_id").orderBy(F.desc("matched_at"), F.desc("article_id")))
    return m.members(spark, sf_dir).select("story_id", "article_id", "match_type", "match_score", place.alias("place"))


@query("story_detail", with_model("""
SELECT s.story_id, s.canonical_title, m.article_id, m.source, m.match_type, r.title AS representative_title
FROM stories s JOIN members m USING (story_id) LEFT JOIN live r ON r.article_id = s.story_id AND r.source <> 'src3'
"""))
def story_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = m.stories(spark, sf_dir).select("story_id", "canonical_title")
    r = live(m.article_rows(spark, sf_dir)).filter("source <> 'src3'").select(F.col("article_id").alias("story_id"), F.col("title").alias("representative_title"))
    return s.join(m.members(spark, sf_dir).select("story_id", "article_id", "source", "match_type"), "story_id").join(r, "story_id", "left").select("story_id", "canonical_title", "article_id", "source", "match_type", "representative_title")


@query("article_list", with_model("SELECT article_id, source, title FROM live WHERE collection = 'en' AND created_at >= TIMESTAMP '2024-01-01 01:00:00' ORDER BY created_at DESC, article_id DESC LIMIT 100"))
def article_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = live(m.article_rows(spark, sf_dir)).filter((F.col("collection") == "en") & timefn.in_window(F.col("created_at"), "2024-01-01 01:00:00", None))
    return a.orderBy(F.desc("created_at"), F.desc("article_id")).limit(100).select("article_id", "source", "title")


@query("member_url_groups", r"""
WITH k AS (SELECT page_id, split_part(split_part(url, '?', 1), '#', 1) AS u, regexp_extract(url, '//([^/?#]*)', 1) AS host FROM pages),
g AS (SELECT page_id, host, CASE WHEN trim(u) = '' THEN page_id::VARCHAR ELSE lower(trim(u)) END AS key FROM k)
SELECT key, count(*) AS members, count(DISTINCT host) AS hosts, min(page_id) AS representative FROM g GROUP BY key
""")
def member_url_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.trim(F.substring_index(F.substring_index("url", "?", 1), "#", 1))
    p = table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", "//([^/?#]*)", 1).alias("host"), F.when(u == "", F.col("page_id").cast("string")).otherwise(F.lower(u)).alias("key"))
    return p.groupBy("key").agg(F.count("*").alias("members"), F.countDistinct("host").alias("hosts"), F.min("page_id").alias("representative"))


@query("latest_translation", with_model("SELECT source_id, target_lang, result_id, sha256(translated_text) AS text_sha FROM tr QUALIFY row_number() OVER (PARTITION BY source_id, target_lang ORDER BY result_id DESC) = 1"))
def latest_translation(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = mutations.latest(m.translations(spark, sf_dir), ["source_id", "target_lang"], [F.desc("result_id")])
    return t.select("source_id", "target_lang", "result_id", F.sha2("translated_text", 256).alias("text_sha"))


@query("translated_feed", with_model("""
, t AS (SELECT source_id, translated_text FROM tr WHERE target_lang = 'assistant' QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY result_id DESC) = 1)
SELECT article_id, coalesce(substring(translated_text, 1, 40), substring(title, 1, 40)) AS shown, translated_text IS NOT NULL AS translated FROM live LEFT JOIN t ON source_id = article_id
"""))
def translated_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = mutations.latest(m.translations(spark, sf_dir).filter("target_lang = 'assistant'"), ["source_id"], [F.desc("result_id")])
    a = live(m.article_rows(spark, sf_dir))
    j = a.join(t.select(F.col("source_id").alias("article_id"), "translated_text"), "article_id", "left")
    return j.select("article_id", F.coalesce(F.substring("translated_text", 1, 40), F.substring("title", 1, 40)).alias("shown"), F.col("translated_text").isNotNull().alias("translated"))


@query("translation_listing", with_model("""
SELECT t.source_id, t.result_id, t.source_type, coalesce(CASE WHEN t.source_type = 'article_title' THEN s.story_id ELSE a.article_id END, -1) AS linked_id
FROM tr t LEFT JOIN stories s ON t.source_type = 'article_title' AND s.story_id = t.source_id LEFT JOIN live a ON t.source_type = 'article_text' AND a.article_id = t.source_id
"""))
def translation_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = m.translations(spark, sf_dir)
    s = m.stories(spark, sf_dir).select(F.col("story_id").alias("id"), F.col("story_id").alias("linked_id"), F.lit("article_title").alias("source_type"))
    a = live(m.article_rows(spark, sf_dir)).select(F.col("article_id").alias("id"), F.col("article_id").alias("linked_id"), F.lit("article_text").alias("source_type"))
    return t.join(s.unionByName(a).withColumnRenamed("id", "source_id"), ["source_id", "source_type"], "left").select("source_id", "result_id", "source_type", F.coalesce("linked_id", F.lit(-1)).cast("long").alias("linked_id"))


@query("translation_targets", with_model("SELECT source_id, result_id FROM tr WHERE source_id = 3 OR source_id IN (SELECT article_id FROM members WHERE match_type = 'seed')"))
def translation_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of a story given by its id, and of all articles that opened one."""
    ids = m.members(spark, sf_dir).filter("match_type = 'seed'").select(F.col("article_id").alias("source_id")).unionByName(spark.range(3, 4).select(F.col("id").alias("source_id"))).distinct()
    return m.translations(spark, sf_dir).join(ids, "source_id", "left_semi").select("source_id", "result_id")


@query("translation_stats", """
WITH t AS (SELECT doc_id, lang, substring(text, 1, 80) AS text FROM documents), c AS (SELECT substring(text, 1, 80) AS text FROM documents WHERE doc_id % 4 = 0)
SELECT count(*) AS total, count(*) FILTER (lang <> 'en' AND text NOT IN (SELECT text FROM c)) AS translated, count(*) FILTER (lang <> 'en' AND text IN (SELECT text FROM c)) AS cached, count(*) FILTER (lang = 'en') AS skipped FROM t
""")
def translation_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(F.lit("article_title").alias("source_type"), F.lit(0).cast("long").alias("source_id"), F.col("lang").alias("source_lang"), F.substring("text", 1, 80).alias("text"), "doc_id")
    cache = d.filter("doc_id % 4 = 0").select("source_type", "source_id", F.sha2("text", 256).alias("content_hash"), F.lit("en").alias("target_lang"))
    return translate.stats(translate.planned(d.drop("doc_id"), cache, "en"))


@query("pending_embed", with_model("SELECT article_id FROM live WHERE article_id NOT IN (SELECT vec_id FROM embeddings) ORDER BY article_id LIMIT 64"))
def pending_embed(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("article_id"), F.lit("model").alias("model_name"), F.lit("1").alias("model_version"))
    return embed.pending(live(m.article_rows(spark, sf_dir)).select("article_id"), e, "model", "1").orderBy("article_id").limit(64)


@query("pending_dedup", with_model("SELECT article_id FROM live WHERE article_id IN (SELECT vec_id FROM embeddings) AND article_id NOT IN (SELECT article_id FROM members WHERE article_id % 2 = 0)"))
def pending_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = live(m.article_rows(spark, sf_dir)).select("article_id")
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("article_id"))
    placed = m.members(spark, sf_dir).filter("article_id % 2 = 0").select("article_id")
    return a.join(e, "article_id", "left_semi").join(placed, "article_id", "left_anti")


@query("pending_normalize", "SELECT doc_id AS article_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def pending_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = table(spark, sf_dir, "labels").select("doc_id")
    return table(spark, sf_dir, "documents").select("doc_id").join(done, "doc_id", "left_anti").select(F.col("doc_id").alias("article_id"))


@query("ledger_append", """
SELECT min(doc_id) AS doc_id, source, sha256(text) AS payload_hash FROM documents b WHERE doc_id % 2 = 1
AND NOT EXISTS (SELECT 1 FROM documents l WHERE l.doc_id % 2 = 0 AND l.source = b.source AND l.text = b.text) GROUP BY source, text
""")
def ledger_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "source", F.sha2("text", 256).alias("payload_hash"))
    return mutations.append_new(d.filter("doc_id % 2 = 0"), d.filter("doc_id % 2 = 1"), ["source", "payload_hash"], "doc_id").select("doc_id", "source", "payload_hash")


@query("checkpoint_latest", "SELECT event_type AS source, max(event_id) AS run_id, arg_max(user_id, event_id) AS cursor FROM events GROUP BY 1")
def checkpoint_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.groupBy(F.col("event_type").alias("source")).agg(F.max("event_id").alias("run_id"), F.max_by("user_id", "event_id").alias("cursor"))


@query("soft_delete_before", with_model("SELECT collection, count(*) FILTER (deleted_at IS NOT NULL OR created_at < TIMESTAMP '2024-01-01 05:00:00') AS deleted, count(*) FILTER (deleted_at IS NULL AND created_at < TIMESTAMP '2024-01-01 05:00:00') AS changed FROM raw GROUP BY 1"))
def soft_delete_before(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = m.article_rows(spark, sf_dir).select("collection", "created_at", "deleted_at").withColumn("was", F.col("deleted_at"))
    after = mutations.soft_delete(r, F.col("created_at") < F.lit("2024-01-01 05:00:00").cast("timestamp"), AS_OF)
    return after.groupBy("collection").agg(F.count_if(F.col("deleted_at").isNotNull()).alias("deleted"), F.count_if(F.col("deleted_at").isNotNull() & F.col("was").isNull()).alias("changed"))


@query("restore_articles", with_model("SELECT count(*) FILTER (deleted_at IS NOT NULL) AS before, count(*) FILTER (deleted_at IS NOT NULL AND collection <> 'en') AS after FROM raw"))
def restore_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = m.article_rows(spark, sf_dir).select("collection", "deleted_at").withColumn("was", F.col("deleted_at"))
    after = mutations.restore(r, F.col("collection") == "en")
    return after.agg(F.count("was").alias("before"), F.count("deleted_at").alias("after"))


@query("update_article_recompute", with_model("SELECT article_id, sha256(t) AS title_hash, sha256(t || chr(10) || normalized_text) AS content_hash FROM (SELECT *, CASE WHEN article_id % 10 = 0 THEN 'new title ' || article_id::VARCHAR ELSE normalized_title END AS t FROM live)"))
def update_article_recompute(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = live(m.articles(spark, sf_dir)).select("article_id", "normalized_title", "normalized_text")
    title = F.concat(F.lit("New  Title "), F.col("article_id").cast("string"))
    return mutations.update_article(a, F.col("article_id") % 10 == 0, title=title).select("article_id", "title_hash", "content_hash")


@query("story_spans", with_model(f"SELECT story_id, {stamp_sql('least(min(first_seen_at), min(matched_at))')} AS first_seen, {stamp_sql('greatest(max(last_seen_at), max(matched_at))')} AS last_seen FROM stories JOIN (SELECT story_id, matched_at FROM members) USING (story_id) GROUP BY 1"))
def story_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = m.members(spark, sf_dir).select("story_id", F.col("created_at").alias("seen_at"))
    s = mutations.widened(m.stories(spark, sf_dir).select("story_id", "first_seen_at", "last_seen_at"), seen)
    return s.select("story_id", stamp(F.col("first_seen_at")).alias("first_seen"), stamp(F.col("last_seen_at")).alias("last_seen"))


@query("article_preview", with_model("""
SELECT article_id, CASE WHEN source = 'src1' THEN 'none' WHEN trim(normalized_text) <> '' THEN 'normalized_text' ELSE 'none' END AS origin,
       CASE WHEN source = 'src1' THEN 0 WHEN length(normalized_text) > 100 THEN length(rtrim(substring(normalized_text, 1, 99), ' ')) + 1 ELSE length(normalized_text) END AS char_count FROM live
"""))
def article_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = live(m.articles(spark, sf_dir)).select("article_id", F.when(F.col("source") != "src1", F.col("normalized_text")).alias("t"))
    shown = F.trim("t") != ""
    return a.select("article_id", F.when(shown, "normalized_text").otherwise("none").alias("origin"), F.when(shown, F.char_length(text.truncate_text(F.col("t"), 100))).otherwise(0).cast("long").alias("char_count"))


# Shapes over the star schema and the event table ---------------------------------------------------------------------


@query("correlated_counts", """
SELECT c_custkey, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS n_orders, (SELECT count(DISTINCT o_orderpriority) FROM orders WHERE o_custkey = c_custkey) AS n_priorities FROM customer
""")
def correlated_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n_orders"), F.countDistinct("o_orderpriority").alias("n_priorities"))
    return table(spark, sf_dir, "customer").select("c_custkey").join(o, "c_custkey", "left").select("c_custkey", F.coalesce("n_orders", F.lit(0)).alias("n_orders"), F.coalesce("n_priorities", F.lit(0)).alias("n_priorities"))


@query("star_join", """
SELECT n_name, o_orderpriority, count(*) AS n, sum((l_extendedprice * (1 - l_discount))::DECIMAL(18, 4))::DOUBLE AS revenue
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE l_shipdate >= TIMESTAMP '1996-01-01' GROUP BY 1, 2
""")
def star_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda n: table(spark, sf_dir, n)
    l = t("lineitem").filter(F.col("l_shipdate") >= F.lit("1996-01-01").cast("timestamp")).select("l_orderkey", (F.col("l_extendedprice") * (1 - F.col("l_discount"))).cast("decimal(18,4)").alias("r"))  # noqa: E741
    o = t("orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey", "o_orderpriority")
    c = t("customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey")
    n = F.broadcast(t("nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name"))  # 25 rows at any scale
    return l.join(o, "l_orderkey").join(c, "o_custkey").join(n, "c_nationkey").groupBy("n_name", "o_orderpriority").agg(F.count("*").alias("n"), F.sum("r").cast("double").alias("revenue"))


@query("event_star", with_model(f"""
SELECT s.story_id, s.canonical_title, a.article_id, a.source, coalesce(r.title, s.canonical_title) AS shown, e.decision, {stamp_sql('e.created_at')} AS at
FROM ev e JOIN stories s ON s.story_id = e.chosen_story_id JOIN live a ON a.article_id = e.article_id LEFT JOIN live r ON r.article_id = s.representative_article_id AND r.source <> 'src2'
WHERE s.status = 'active'
"""))
def event_star(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with their story, their article, and the story's representative where there is one."""
    rows = live(m.article_rows(spark, sf_dir))
    e = m.events(spark, sf_dir).select("article_id", F.col("chosen_story_id").alias("story_id"), "decision", F.col("created_at").alias("at"))
    s = m.stories(spark, sf_dir).filter("status = 'active'").select("story_id", "canonical_title", "representative_article_id")
    r = rows.filter("source <> 'src2'").select(F.col("article_id").alias("representative_article_id"), F.col("title").alias("r"))
    j = e.join(s, "story_id").join(rows.select("article_id", "source"), "article_id").join(r, "representative_article_id", "left")
    return j.select("story_id", "canonical_title", "article_id", "source", F.coalesce("r", "canonical_title").alias("shown"), "decision", stamp(F.col("at")).alias("at"))


@query("session_lookup", "SELECT e.event_id, e.user_id, c.c_name FROM events e JOIN customer c ON c.c_custkey = e.user_id WHERE e.event_type = 'click'")
def session_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").filter("event_type = 'click'").select("event_id", "user_id")
    return e.join(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), "c_name"), "user_id").select("event_id", "user_id", "c_name")


@query("event_day_buckets", "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def event_day_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = incremental.windowed_counts(table(spark, sf_dir, "events"), "1 day")
    return w.select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n", F.round("total", 4).alias("total"))


@query("match_details_json", "SELECT event_id, props ->> '$.k' AS detail FROM events WHERE props IS NOT NULL")
def match_details_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").filter("props IS NOT NULL")
    return e.select("event_id", F.variant_get(F.parse_json("props"), "$.k", "string").alias("detail"))


@query("union_counts", "SELECT 'documents' AS name, count(*) AS n FROM documents UNION ALL SELECT 'pages', count(*) FROM pages UNION ALL SELECT 'embeddings', count(*) FROM embeddings")
def union_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = None
    for name in ("documents", "pages", "embeddings"):
        own = table(spark, sf_dir, name).agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
        out = own if out is None else out.unionByName(own)
    return out


@query("integrity_checks", with_model("""
SELECT (SELECT count(*) FROM members WHERE story_id NOT IN (SELECT story_id FROM stories)) AS orphan_members, (SELECT count(*) - count(DISTINCT article_id) FROM members) AS repeated_members,
       (SELECT count(*) FROM stories WHERE last_seen_at < first_seen_at) AS bad_spans, (SELECT count(*) FROM articles WHERE length(content_hash) <> 64) AS bad_hashes
"""))
def integrity_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    mm, s = m.members(spark, sf_dir), m.stories(spark, sf_dir)
    a = mm.join(s.select("story_id"), "story_id", "left_anti").agg(F.count("*").alias("orphan_members"))
    b = mm.agg((F.count("*") - F.countDistinct("article_id")).alias("repeated_members"))
    c = s.agg(F.count_if(F.col("last_seen_at") < F.col("first_seen_at")).alias("bad_spans"))
    d = m.article_rows(spark, sf_dir).agg(F.count_if(F.char_length("content_hash") != 64).alias("bad_hashes"))
    return a.join(b).join(c).join(d)  # single rows
