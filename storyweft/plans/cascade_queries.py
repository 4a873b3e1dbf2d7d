"""The cascade over the tables: as-of candidates, vector pairs and stories, each with SQL that states the rule itself."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storyweft.functions import scoring
from storyweft.operators import asof, cascade, cosine
from storyweft.plans import adapter as m
from storyweft.plans.adapter import live, normal_sql, table, with_model
from storyweft.plans.registry import query
from storyweft.plans.text_queries import SIMHASH_SQL, TITLE, TOKENS_SQL


@query("newest_stories_asof", with_model("""
, e AS (SELECT article_id AS at, story_id, epoch(coalesce(m.published_at, m.created_at)) AS seen FROM members m JOIN stories s USING (story_id) WHERE status = 'active'),
r AS (
  SELECT a.article_id, e.story_id, max(seen) AS last, row_number() OVER (PARTITION BY a.article_id ORDER BY max(seen) DESC, e.story_id DESC) AS rank
  FROM live a JOIN e ON e.at < a.article_id GROUP BY a.article_id, e.story_id QUALIFY rank <= 300
)
SELECT a.article_id, count(story_id) AS n, coalesce(max(story_id) FILTER (rank = 1), -1) AS newest, coalesce(arg_max(story_id, rank), -1) AS oldest, coalesce(sum(story_id * rank), 0)::BIGINT AS digest FROM live a LEFT JOIN r USING (article_id) GROUP BY 1
"""))
def newest_stories_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every article the 300 newest active stories before it, all collections as one: how many, the newest, the oldest, and
    a sum of ids by rank; -1 where there is none."""
    active = m.stories(spark, sf_dir).filter("status = 'active'").select("story_id")
    seen = m.members(spark, sf_dir).join(active, "story_id", "left_semi").select(F.lit("").alias("block"), F.col("article_id").alias("at"), F.col("story_id").alias("story"), (F.unix_micros(F.coalesce("published_at", "created_at")) / 1e6).alias("last"))
    asked = live(m.article_rows(spark, sf_dir)).select(F.lit("").alias("block"), F.col("article_id").alias("at"), F.lit(None).cast("long").alias("story"))
    o = asof.answered(seen, asked, scoring.LEXICAL_CANDIDATES).select("at", "newest")
    digest = F.aggregate(F.transform("newest", lambda s, i: s * (i + 1)), F.lit(0).cast("long"), lambda s, x: s + x)
    return o.select(F.col("at").alias("article_id"), F.size("newest").cast("long").alias("n"), F.coalesce(F.get("newest", F.lit(0)), F.lit(-1)).alias("newest"), F.coalesce(F.get("newest", F.size("newest") - 1), F.lit(-1)).alias("oldest"), digest.alias("digest"))


#: Vectors with near neighbours planted: of three rows the second is the first with a share of its own, the third equals the first.
PLANTED_SQL = """v AS (
  SELECT x.vec_id, CASE x.vec_id % 3 WHEN 0 THEN x.label ELSE coalesce(y.label, x.label) END AS label,
         CASE WHEN y.vec_id IS NULL THEN x.embedding::DOUBLE[] WHEN x.vec_id % 3 = 1 THEN list_transform(list_zip(y.embedding::DOUBLE[], x.embedding::DOUBLE[]), lambda p: p[1] + (x.vec_id % 5 + 1) / 10 * p[2]) ELSE y.embedding::DOUBLE[] END AS e
  FROM embeddings x LEFT JOIN embeddings y ON x.vec_id % 3 > 0 AND y.vec_id = x.vec_id - x.vec_id % 3
)"""


def planted_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, block, vector."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.transform("embedding", lambda x: x.cast("double")).alias("own"))
    first = e.filter("vec_id % 3 = 0").select(F.col("vec_id").alias("at"), F.col("label").alias("l0"), F.col("own").alias("e0"))
    k = F.col("vec_id") % 3
    share = (F.col("vec_id") % 5 + 1) / 10
    mixed = F.when(F.col("e0").isNull(), F.col("own")).when(k == 1, F.zip_with("e0", "own", lambda a, b: a + share * b)).otherwise(F.col("e0"))
    met = e.join(first, (k > 0) & (F.col("at") == F.col("vec_id") - k), "left")
    return met.select(F.col("vec_id").alias("id"), F.coalesce("l0", "label").alias("block"), mixed.alias("vector"))


@query("vector_pairs", f"""
WITH {PLANTED_SQL}, r AS (SELECT min(vec_id) AS vec_id, label, e FROM v GROUP BY label, e),
c AS (SELECT p.vec_id AS a, q.vec_id AS b, list_inner_product(p.e, q.e) / sqrt(list_inner_product(p.e, p.e) * list_inner_product(q.e, q.e)) AS cosine FROM r p JOIN r q ON p.label = q.label AND p.vec_id < q.vec_id)
SELECT a, b, round(cosine, 6) AS cosine FROM c WHERE cosine >= 0.89
""")
def vector_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of a label in or above the gray zone, between representatives of equal vectors (vector_classes has the members)."""
    return cosine.cosine_pairs(planted_vectors(spark, sf_dir), scoring.GRAY_COSINE).select("a", "b", F.round("cosine", 6).alias("cosine"))


@query("vector_classes", f"WITH {PLANTED_SQL} SELECT vec_id AS id, min(vec_id) OVER (PARTITION BY label, e) AS rep FROM v")
def vector_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cosine.vector_classes(planted_vectors(spark, sf_dir))


def cascade_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Live articles; some share a URL, some a source's item id, and vectors have near neighbours."""
    a, i = live(m.article_rows(spark, sf_dir)), F.col("article_id")
    a = a.withColumns({"url": F.when(i % 6 == 0, F.concat(F.lit("https://x.example/"), (i % 90).cast("string"))), "source_item_id": F.when(i % 7 == 0, F.concat(F.lit("i"), (i % 35).cast("string"))).otherwise(i.cast("string"))})
    return a.join(planted_vectors(spark, sf_dir).select(F.col("id").alias("article_id"), "vector"), "article_id", "left")


#: One article of each collection a step; `recurring` holds all that were placed before. Ways are tried in the order of their number.
CASCADE_SQL = f"""
, {SIMHASH_SQL}, {PLANTED_SQL},
art AS MATERIALIZED (
  SELECT article_id, collection, row_number() OVER (PARTITION BY collection ORDER BY article_id) AS n, CASE WHEN article_id % 6 = 0 THEN 'https://x.example/' || (article_id % 90)::VARCHAR END AS url, source,
         CASE WHEN article_id % 7 = 0 THEN 'i' || (article_id % 35)::VARCHAR ELSE article_id::VARCHAR END AS item, content_hash, epoch(published_at) AS published, epoch(coalesce(published_at, created_at)) AS seen
  FROM live
), titles AS MATERIALIZED (
  SELECT doc_id, list_distinct(w) AS w, list_filter(list_distinct(list_transform(range(1, greatest(length(t) - 2, 1) + 1), lambda i: substring(t, i, 3))), lambda x: x <> '') AS g
  FROM (SELECT doc_id, {TOKENS_SQL} AS w, {normal_sql(TITLE)} AS t FROM documents)
), alike AS MATERIALIZED (
  SELECT * FROM (
    SELECT p.article_id AS a, q.article_id AS b, bit_count(xor(x.simhash, y.simhash)) AS d,
           CASE WHEN least(len(u.g), len(k.g)) < 0.85 * greatest(len(u.g), len(k.g)) OR len(u.g) = 0 OR len(k.g) = 0 THEN 0 ELSE len(list_intersect(u.g, k.g)) / (len(u.g) + len(k.g) - len(list_intersect(u.g, k.g))) END AS o
    FROM art p JOIN art q ON p.collection = q.collection AND q.article_id < p.article_id JOIN titles u ON u.doc_id = p.article_id JOIN titles k ON k.doc_id = q.article_id
    LEFT JOIN sim x ON x.doc_id = p.article_id LEFT JOIN sim y ON y.doc_id = q.article_id)
  WHERE d <= 3 OR o >= 0.88
), near AS MATERIALIZED (
  SELECT p.article_id AS a, q.article_id AS b, list_inner_product(x.e, y.e) / sqrt(list_inner_product(x.e, x.e) * list_inner_product(y.e, y.e)) AS cosine,
         CASE WHEN len(u.w) = 0 OR len(k.w) = 0 THEN 0 ELSE len(list_intersect(u.w, k.w)) / (len(u.w) + len(k.w) - len(list_intersect(u.w, k.w))) END AS title
  FROM art p JOIN art q ON p.collection = q.collection AND q.article_id < p.article_id JOIN v x ON x.vec_id = p.article_id JOIN v y ON y.vec_id = q.article_id
  JOIN titles u ON u.doc_id = p.article_id JOIN titles k ON k.doc_id = q.article_id
), steps(article_id, collection, n, story_id, way, score, candidate, gray) USING KEY (article_id) AS (
  SELECT min(-article_id - 1), collection, 0::BIGINT, NULL::BIGINT, NULL::INT, NULL::DOUBLE, NULL::BIGINT, false FROM art GROUP BY collection
  UNION
  SELECT article_id, collection, n, CASE WHEN way < 7 THEN story ELSE article_id END, way, score, story, way = 7 AND cosine >= 0.89 AND cosine < 0.935 FROM (
    SELECT *, row_number() OVER (PARTITION BY article_id ORDER BY way, k1, k2, k3) AS best FROM (
      WITH cur AS (SELECT a.* FROM steps t JOIN art a ON a.collection = t.collection AND a.n = t.n + 1),
      known AS (SELECT r.story_id, x.* FROM recurring.steps r JOIN art x ON x.article_id = r.article_id),
      s AS (SELECT story_id, collection, max(seen) AS last, row_number() OVER (PARTITION BY collection ORDER BY max(seen) DESC, story_id DESC) AS place FROM known GROUP BY story_id, collection),
      lex AS (
        SELECT cur.*, s.story_id AS story, s.last, d, o, CASE WHEN abs(published - last) <= 48 * 3600 THEN 1.0 WHEN abs(published - last) <= 168 * 3600 THEN 0.6 ELSE 0.0 END AS date
        FROM cur JOIN s ON s.collection = cur.collection AND place <= 300 JOIN alike ON alike.a = cur.article_id AND alike.b = s.story_id
      ), sem AS (
        SELECT *, greatest(0, least(1, 0.75 * cosine + 0.15 * title + 0.10 * date)) AS composite FROM (
          SELECT cur.*, s.story_id AS story, cosine, title, CASE WHEN published IS NULL THEN 0.5 WHEN abs(published - last) <= 48 * 3600 THEN 1.0 WHEN abs(published - last) <= 168 * 3600 THEN 0.6 ELSE 0.0 END AS date,
                 row_number() OVER (PARTITION BY cur.article_id ORDER BY round(cosine, 12) DESC, s.story_id) AS r
          FROM cur JOIN s ON s.collection = cur.collection JOIN near ON near.a = cur.article_id AND near.b = s.story_id QUALIFY r <= 20)
      )
      SELECT cur.article_id, cur.collection, cur.n, s.story_id AS story, 1 AS way, -s.last AS k1, -s.story_id AS k2, 0 AS k3, 1.0::DOUBLE AS score, NULL::DOUBLE AS cosine
      FROM cur JOIN s ON s.collection = cur.collection JOIN art seed ON seed.article_id = s.story_id AND seed.url = cur.url
      UNION ALL SELECT cur.article_id, cur.collection, cur.n, known.story_id, 2, -known.article_id, 0, 0, 1.0, NULL FROM cur JOIN known ON known.collection = cur.collection AND known.source = cur.source AND known.item = cur.item
      UNION ALL SELECT cur.article_id, cur.collection, cur.n, known.story_id, 3, -known.article_id, 0, 0, 1.0, NULL FROM cur JOIN known ON known.collection = cur.collection AND known.content_hash = cur.content_hash
      UNION ALL SELECT article_id, collection, n, story, 4, d, -last, -story, 1 - d / 64, NULL FROM lex WHERE d <= 3
      UNION ALL SELECT article_id, collection, n, story, 5, -round(0.8 * o + 0.2 * date, 12), -last, -story, 0.8 * o + 0.2 * date, NULL FROM lex WHERE o >= 0.88 AND abs(published - last) <= 14 * 86400
      UNION ALL SELECT article_id, collection, n, story, 6, r, 0, 0, composite, cosine FROM sem WHERE cosine >= 0.965 OR (cosine >= 0.935 AND title >= 0.30)
      UNION ALL SELECT article_id, collection, n, story, 7, -round(composite, 12), r, 0, composite, cosine FROM sem
      UNION ALL SELECT article_id, collection, n, NULL, 8, 0, 0, 0, NULL, NULL FROM cur
    )) WHERE best = 1
)
SELECT article_id, story_id, CASE WHEN way < 7 THEN 'auto_merge' WHEN gray THEN 'gray_zone' ELSE 'new_story' END AS decision,
       ['exact_url', 'exact_source_id', 'exact_content_hash', 'lexical_simhash', 'lexical_overlap', 'semantic'][way] AS exact_signal, CASE WHEN way < 7 OR gray THEN candidate ELSE -1 END AS best_candidate_story_id, CASE WHEN way < 7 OR gray THEN round(score, 6) END AS composite_score
FROM steps WHERE n > 0
"""


@query("cascade_stories", with_model(CASCADE_SQL).replace("WITH", "WITH RECURSIVE", 1))
def cascade_stories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every step of the cascade over all live articles; no candidate is -1."""
    o = cascade.parallel_stories(cascade_input(spark, sf_dir), sequence=cascade.SEQUENCE)
    return o.select("article_id", "story_id", "decision", "exact_signal", F.coalesce("best_candidate_story_id", F.lit(-1)).alias("best_candidate_story_id"), F.round("composite_score", 6).alias("composite_score"))
