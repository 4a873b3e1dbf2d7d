"""Queries over texts, hashes, URLs, languages and pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storyweft.functions import hashing, lang, profiles, text, timefn, url
from storyweft.operators import validate
from storyweft.plans.adapter import articles, live, normal_sql, table, with_model
from storyweft.plans.registry import query
from storyweft.sources import feeds, pages, reader

TITLE = "substring(text, 1, 80)"


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").withColumn("title", F.substring("text", 1, 80))


@query("content_hash_clusters", with_model("""
SELECT s.collection, s.story_id, count(*) AS article_count, count(DISTINCT m.source) AS source_count
FROM stories s JOIN members m USING (story_id) GROUP BY ALL
"""))
def content_hash_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = live(articles(spark, sf_dir)).select("collection", "content_hash", "article_id", "source")
    return a.groupBy("collection", "content_hash").agg(F.min("article_id").alias("story_id"), F.count("*").alias("article_count"), F.countDistinct("source").alias("source_count")).drop("content_hash")


@query("text_normalize", f"SELECT doc_id, sha256({normal_sql('text')}) AS norm_sha, length({normal_sql('text')}) AS n_chars FROM documents")
def text_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _docs(spark, sf_dir).select("doc_id", text.normalize_text(F.col("text")).alias("n"))
    return d.select("doc_id", F.sha2("n", 256).alias("norm_sha"), F.char_length("n").cast("long").alias("n_chars"))


@query("token_stats", rf"""
SELECT doc_id, len(t)::INT AS n_tokens, len(list_distinct(t))::INT AS n_distinct,
       len(list_filter(regexp_split_to_array({TITLE} || ' ' || text, '[\t-\r \x{{85}}\p{{Z}}]+'), lambda w: w <> ''))::INT AS n_fields
FROM (SELECT *, regexp_extract_all({normal_sql('text')}, '[\p{{L}}\p{{N}}]+') AS t FROM documents)
""")
def token_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _docs(spark, sf_dir).withColumn("t", text.tokens(F.col("text")))
    return d.select("doc_id", F.size("t").alias("n_tokens"), F.size(F.array_distinct("t")).alias("n_distinct"), text.count_tokens(F.col("title"), F.col("text")).alias("n_fields"))


FNV_SQL = """list_reduce(list_concat([14695981039346656037::HUGEINT], list_transform(range(1, 1 + octet_length(encode({0}))),
    lambda i: ('0x' || substring(hex(encode({0})), 2*i-1, 2))::INT::HUGEINT)),
    lambda h, b: (xor(h, b) * 1099511628211::HUGEINT) % 18446744073709551616::HUGEINT)"""
TOKENS_SQL = rf"regexp_extract_all({normal_sql(TITLE)}, '[\p{{L}}\p{{N}}]+')"


@query("fnv1a64_tokens", f"""
SELECT token, n, (CASE WHEN h >= 9223372036854775808::HUGEINT THEN h - 18446744073709551616::HUGEINT ELSE h END)::BIGINT AS fnv
FROM (SELECT token, n, {FNV_SQL.format('token')} AS h FROM (SELECT unnest({TOKENS_SQL}) AS token, count(*) AS n FROM documents GROUP BY 1))
""".replace("SELECT unnest(" + TOKENS_SQL + ") AS token, count(*) AS n FROM documents GROUP BY 1", "SELECT token, count(*) AS n FROM (SELECT unnest(" + TOKENS_SQL + ") AS token FROM documents) GROUP BY 1"))
def fnv1a64_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = _docs(spark, sf_dir).select(F.explode(text.tokens(F.col("title"))).alias("token"))
    return words.groupBy("token").agg(F.count("*").alias("n")).withColumn("fnv", hashing.fnv1a64(F.col("token")))


SIMHASH_SQL = f"""tok AS (
  SELECT doc_id, unnest({TOKENS_SQL}) AS token FROM documents
), word AS (
  SELECT token, {FNV_SQL.format('token')} AS h FROM (SELECT DISTINCT token FROM tok)
), bits AS (
  SELECT doc_id, i, sum(CASE WHEN (h // pow(2, i)::HUGEINT) % 2 = 1 THEN 1 ELSE -1 END) AS w
  FROM tok JOIN word USING (token), range(64) r(i) GROUP BY doc_id, i
), sim AS (
  SELECT doc_id, (CASE WHEN s >= 9223372036854775808::HUGEINT THEN s - 18446744073709551616::HUGEINT ELSE s END)::BIGINT AS simhash
  FROM (SELECT doc_id, sum(CASE WHEN w > 0 THEN pow(2::HUGEINT, i)::HUGEINT ELSE 0::HUGEINT END) AS s FROM bits GROUP BY doc_id)
)"""


@query("title_simhash", f"WITH {SIMHASH_SQL} SELECT doc_id, simhash FROM documents LEFT JOIN sim USING (doc_id)")
def title_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", hashing.simhash64(text.tokens(F.col("title"))).alias("simhash"))


@query("url_canonicalize", r"""
WITH p AS (
  SELECT page_id, url, lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.\-]*)://', 1)) AS scheme,
         lower(regexp_replace(regexp_replace(regexp_extract(url, '^[^:/?#]+://([^/?#]*)', 1), '^.*@', ''), ':\d*$', '')) AS host,
         regexp_extract(url, '^[^:/?#]+://[^/?#]*([^?#]*)', 1) AS path, regexp_extract(url, '\?([^#]*)', 1) AS q
  FROM pages
), k AS (
  SELECT *, list_sort(list_filter(string_split(q, '&'), lambda x: x <> '' AND NOT starts_with(lower(split_part(x, '=', 1)), 'utm_')
           AND lower(split_part(x, '=', 1)) NOT IN ('fbclid', 'gclid', 'mc_cid', 'mc_eid', 'ref', 'ref_src'))) AS ps,
         CASE WHEN path = '/' THEN path ELSE regexp_replace(replace(path, '//', '/'), '/$', '') END AS clean
  FROM p
)
SELECT page_id, host, CASE WHEN host = '' THEN '' ELSE scheme || '://' || host || clean || CASE WHEN len(ps) = 0 THEN '' ELSE '?' || array_to_string(ps, '&') END END AS canonical
FROM k
""")
def url_canonicalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages")
    return p.select("page_id", url.url_host(F.col("url")).alias("host"), url.canonical_url(F.col("url")).alias("canonical"))


@query("source_label", r"""
WITH g AS (
  SELECT lower(regexp_extract(url, '^[^:/?#]+://([^/?#:]*)', 1)) AS host, count(*) AS n, min(url) AS url FROM pages GROUP BY 1
)
SELECT host, regexp_replace(host, '^www\.', '') || CASE WHEN n = 1 THEN '' WHEN n = 2 THEN ' and 1 other' ELSE ' and ' || (n - 1)::VARCHAR || ' others' END AS label FROM g
""")
def source_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages")
    g = p.groupBy(url.url_host(F.col("url")).alias("host")).agg(F.count("*").alias("n"), F.min("url").alias("url"))
    return g.select("host", url.source_label(F.col("url"), F.col("n") - 1).alias("label"))


@query("feed_url_dedup", "SELECT page_id, rtrim(url, '/') AS link FROM pages QUALIFY row_number() OVER (PARTITION BY rtrim(url, '/') ORDER BY page_id) = 1")
def feed_url_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages").select("page_id", F.regexp_replace("url", "/+$", "").alias("link"))
    return p.groupBy("link").agg(F.min("page_id").alias("page_id")).select("page_id", "link")


@query("lang_code_normalize", r"""
WITH v AS (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN ' ' || upper(lang) || '_us ' WHEN 1 THEN lang || '--Hans' WHEN 2 THEN lang || '_123' WHEN 3 THEN 'english' ELSE lang END AS raw FROM documents),
w AS (SELECT *, list_filter(list_transform(string_split(replace(lower(trim(raw)), '_', '-'), '-'), lambda p: trim(p)), lambda p: p <> '') AS parts FROM v),
x AS (SELECT *, CASE WHEN list_bool_and(list_transform(parts, lambda p: regexp_full_match(p, '[a-z]+'))) THEN array_to_string(parts, '-') ELSE '' END AS tag FROM w)
SELECT doc_id, CASE WHEN regexp_full_match(split_part(replace(lower(trim(raw)), '_', '-'), '-', 1), '[a-z]{2}') THEN split_part(replace(lower(trim(raw)), '_', '-'), '-', 1) ELSE '' END AS iso,
       tag, split_part(tag, '-', 1) AS code FROM x
""")
def lang_code_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, x = F.col("doc_id") % 5, F.col("lang")
    raw = F.when(k == 0, F.concat(F.lit(" "), F.upper(x), F.lit("_us "))).when(k == 1, F.concat(x, F.lit("--Hans"))).when(k == 2, F.concat(x, F.lit("_123"))).when(k == 3, F.lit("english")).otherwise(x)
    return table(spark, sf_dir, "documents").select("doc_id", lang.iso_code(raw).alias("iso"), lang.language_tag(raw).alias("tag"), lang.language_code(raw).alias("code"))


@query("language_detect", rf"""
WITH d AS (SELECT doc_id, lang, text, substring(md5(doc_id::VARCHAR), 1, 1) IN ('0', '1', '2') AS held_out FROM documents),
w AS (SELECT doc_id, unnest(string_split(trim(regexp_replace(lower(text), '[^\p{{L}}\p{{M}}]+', ' ', 'g'), ' '), ' ')) AS w FROM d),
p AS (SELECT doc_id, ' ' || w || ' ' AS p, count(*) AS n FROM w WHERE w <> '' GROUP BY ALL),
e AS (SELECT doc_id, n, unnest(list_transform(range(2, length(p)), lambda i: substring(p, i, 1)) || list_transform(range(1, length(p)), lambda i: substring(p, i, 2))
      || list_transform(range(1, length(p) - 1), lambda i: substring(p, i, 3))) AS gram FROM p),
g AS (SELECT doc_id, gram, sum(n) AS n FROM e GROUP BY ALL),
own AS (SELECT doc_id, gram, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, gram) AS place FROM g QUALIFY place <= {profiles.TOP}),
l AS (SELECT lang, gram, sum(n) AS n FROM g JOIN d USING (doc_id) WHERE NOT held_out AND regexp_full_match(lower(lang), '[a-z]{{2}}') GROUP BY ALL),
of AS (SELECT lower(lang) AS name, gram, row_number() OVER (PARTITION BY lang ORDER BY n DESC, gram) AS place FROM l QUALIFY place <= {profiles.TOP}),
names AS (SELECT DISTINCT name FROM of),
s AS (SELECT doc_id, name, sum(coalesce(abs(own.place - of.place), {profiles.TOP}))::BIGINT AS distance FROM own CROSS JOIN names LEFT JOIN of USING (name, gram) GROUP BY ALL),
best AS (SELECT doc_id, min((distance, name)) AS b FROM s GROUP BY ALL)
SELECT doc_id, lang, held_out, CASE WHEN letters >= 6 THEN coalesce(b[2], 'und') ELSE 'und' END AS detected, CASE WHEN letters >= 6 THEN coalesce(b[1], -1) ELSE -1 END AS distance
FROM (SELECT *, coalesce(length(regexp_replace(text, '[^\p{{L}}]', '', 'g')), 0) AS letters FROM d) LEFT JOIN best USING (doc_id)
""")
def language_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trained on the documents that are not held out; distance is -1 where nothing is detected. The texts are of one script, so the SQL has no filter of scripts."""
    d = table(spark, sf_dir, "documents").withColumn("held_out", profiles.held_out(F.col("doc_id")))
    detect = profiles.detector(profiles.fit(d.filter(~F.col("held_out"))))
    return d.withColumn("found", detect(F.col("text"))).select("doc_id", "lang", "held_out", F.col("found.lang").alias("detected"), F.coalesce("found.distance", F.lit(-1)).cast("long").alias("distance"))


ITEM_SQL = """item AS (
  SELECT doc_id, CASE WHEN doc_id % 7 = 1 THEN 'v2' ELSE 'v1' END AS payload_version, CASE WHEN doc_id % 11 = 2 THEN '  ' ELSE source END AS source,
         CASE WHEN doc_id % 13 = 3 THEN NULL ELSE doc_id::VARCHAR END AS source_item_id, CASE WHEN doc_id % 17 = 4 THEN '' ELSE substring(text, 1, 80) END AS title,
         CASE WHEN doc_id % 19 = 5 THEN 'yesterday' ELSE '2024-01-02T03:04:05Z' END AS published_at, CASE WHEN doc_id % 23 = 6 THEN 'no url' ELSE 'https://example.com/' || doc_id::VARCHAR END AS canonical_url
  FROM documents
), checked AS (
  SELECT doc_id, list_filter([
    CASE WHEN payload_version <> 'v1' THEN 'payload_version' END, CASE WHEN source IS NULL OR trim(source) = '' THEN 'source' END,
    CASE WHEN source_item_id IS NULL OR trim(source_item_id) = '' THEN 'source_item_id' END, CASE WHEN title IS NULL OR trim(title) = '' THEN 'title' END,
    CASE WHEN published_at = 'yesterday' THEN 'published_at' END, CASE WHEN canonical_url = 'no url' THEN 'canonical_url' END], lambda e: e IS NOT NULL) AS errors
  FROM item
)"""


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    d = table(spark, sf_dir, "documents")
    return d.select(
        "doc_id", F.when(i % 7 == 1, "v2").otherwise("v1").alias("payload_version"), F.when(i % 11 == 2, "  ").otherwise(F.col("source")).alias("source"),
        F.when(i % 13 != 3, i.cast("string")).alias("source_item_id"), F.when(i % 17 == 4, "").otherwise(F.substring("text", 1, 80)).alias("title"),
        F.when(i % 19 == 5, "yesterday").otherwise("2024-01-02T03:04:05Z").alias("published_at"), F.when(i % 23 == 6, "no url").otherwise(F.concat(F.lit("https://example.com/"), i.cast("string"))).alias("canonical_url"),
    )


@query("validate_items", f"WITH {ITEM_SQL} SELECT doc_id, array_to_string(errors, ',') AS errors, len(errors) = 0 AS valid FROM checked")
def validate_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _items(spark, sf_dir).withColumn("e", validate.item_errors())
    return v.select("doc_id", F.array_join("e", ",").alias("errors"), (F.size("e") == 0).alias("valid"))


@query("validate_report", f"WITH {ITEM_SQL} SELECT count(*) AS scanned, count(*) FILTER (len(errors) = 0) AS valid, count(*) FILTER (len(errors) > 0) AS invalid FROM checked")
def validate_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.report(_items(spark, sf_dir).select((F.size(validate.item_errors()) == 0).alias("valid")))


@query("keyword_filter", f"""
SELECT doc_id FROM documents WHERE source NOT IN ('src1', 'src2') OR contains(lower({TITLE}), 'tion') OR contains(lower({TITLE}), 'schlich') OR contains(lower({TITLE}), 'ment')
""")
def keyword_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _docs(spark, sf_dir)
    return d.filter(~F.col("source").isin("src1", "src2") | feeds.has_keyword(F.col("title"), ["tion", "schlich", "ment"])).select("doc_id")


@query("html_links", r"""
WITH l AS (SELECT page_id, unnest(regexp_extract_all(html, '<a [^>]*href="([^"]*)"[^>]*>([^<]*)', 1)) AS href FROM pages)
SELECT page_id, href, count(*) AS n, substring(md5(href), 1, 16) AS item_id FROM l GROUP BY page_id, href
""")
def html_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = pages.links(table(spark, sf_dir, "pages"))
    return links.groupBy("page_id", "href").agg(F.count("*").alias("n")).withColumn("item_id", hashing.short_id(F.col("href")))


@query("html_strip", "SELECT page_id, length(regexp_replace(html, '<[^>]+>', '', 'g')) AS n_chars, substring(trim(regexp_replace(html, '<[^>]+>', '', 'g')), 1, 300) AS summary FROM pages")
def html_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    bare = text.strip_tags(F.col("html"))
    return table(spark, sf_dir, "pages").select("page_id", F.char_length(bare).cast("long").alias("n_chars"), F.substring(F.trim(bare), 1, 300).alias("summary"))


@query("readable_text", r"""
WITH a AS (SELECT page_id, regexp_extract(html, '<article>(.*)</article>', 1, 's') AS x FROM pages),
b AS (SELECT page_id, regexp_replace(regexp_replace(x, '</?(p|h1|br)>', chr(10), 'g'), '<[^>]*>', '', 'g') AS x FROM a),
c AS (SELECT page_id, regexp_replace(replace(x, '&quot;', '"'), '&amp;?', '&', 'g') AS x FROM b),
d AS (SELECT page_id, trim(regexp_replace(regexp_replace(x, '[ \t]+', ' ', 'g'), ' ?[\r\n][ \r\n]*', chr(10) || chr(10), 'g'), ' ' || chr(10)) AS x FROM c)
SELECT page_id, length(x) AS n_chars, sha256(x) AS body_sha, CASE WHEN length(x) > 1000 THEN trim(substring(x, 1, 999), ' ' || chr(10)) || '…' ELSE x END AS preview FROM d
""")
def readable_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The body that block scoring finds, whatever its element is called; the SQL takes the article element of these pages,
    and of references resolves those that the pages' texts are written with."""
    p = table(spark, sf_dir, "pages").select("page_id", reader.readable_quoted(F.col("html")).alias("body"))
    return p.select("page_id", F.char_length("body").cast("long").alias("n_chars"), F.sha2("body", 256).alias("body_sha"), text.truncate_text(F.col("body"), 1000, " \n").alias("preview"))


@query("clean_truncate_preview", r"""
WITH c AS (
  SELECT doc_id, array_to_string(list_filter(list_transform(string_split(replace(text, chr(13) || chr(10), chr(10)), chr(10)),
         lambda s: trim(regexp_replace(s, '[\t-\r \x{85}\p{Z}]+', ' ', 'g'))), lambda s: s <> ''), chr(10) || chr(10)) AS t FROM documents
)
SELECT doc_id, length(t) AS n_chars, length(t) > 200 AS cut, CASE WHEN length(t) > 200 THEN rtrim(substring(t, 1, 199), ' ') || '…' ELSE t END AS preview FROM c
""")
def clean_truncate_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", text.clean_text(F.col("text")).alias("t"))
    return d.select("doc_id", F.char_length("t").cast("long").alias("n_chars"), text.truncated(F.col("t"), 200).alias("cut"), text.truncate_text(F.col("t"), 200).alias("preview"))


@query("table_cells", f"SELECT doc_id, CASE WHEN length({TITLE}) > 20 THEN substring({TITLE}, 1, 17) || '...' ELSE {TITLE} END AS cell, source || ':' || doc_id::VARCHAR || ' • seed • score 1.000' AS subtitle FROM documents")
def table_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _docs(spark, sf_dir)
    subtitle = F.format_string("%s:%s • %s • score %.3f", "source", F.col("doc_id").cast("string"), F.lit("seed"), F.lit(1.0))
    return d.select("doc_id", text.truncate_cell(F.col("title"), 20).alias("cell"), subtitle.alias("subtitle"))


@query("embedding_inputs", f"SELECT doc_id, sha256(array_to_string(list_filter([trim({TITLE}), trim(text)], lambda x: x <> ''), chr(10) || chr(10))) AS input_sha, octet_length(encode(text)) > octet_length(encode({TITLE})) + 50 AS substantive FROM documents")
def embedding_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _docs(spark, sf_dir)
    return d.select("doc_id", F.sha2(text.embedding_input(F.col("title"), F.col("text")), 256).alias("input_sha"), text.substantive(F.col("text"), F.col("title")).alias("substantive"))


@query("relative_days", """
WITH d AS (SELECT event_id, date_diff('day', ts::DATE, DATE '2024-02-01') AS d FROM events), n AS (SELECT *, abs(d) AS n FROM d),
u AS (SELECT *, CASE WHEN n < 7 THEN n WHEN n < 30 THEN n // 7 WHEN n < 365 THEN n // 30 ELSE n // 365 END AS k,
             CASE WHEN n < 7 THEN 'day' WHEN n < 30 THEN 'week' WHEN n < 365 THEN 'month' ELSE 'year' END AS unit FROM n),
s AS (SELECT *, k::VARCHAR || ' ' || unit || CASE WHEN k = 1 THEN '' ELSE 's' END AS span FROM u)
SELECT CASE WHEN d = 0 THEN 'today' WHEN d = 1 THEN 'yesterday' WHEN d = -1 THEN 'tomorrow' WHEN d > 0 THEN span || ' ago' ELSE 'in ' || span END AS label, count(*) AS n FROM s GROUP BY 1
""")
def relative_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.groupBy(timefn.relative_day(F.to_date("ts"), F.lit("2024-02-01").cast("date")).alias("label")).agg(F.count("*").alias("n"))


@query("date_parse", """
SELECT doc_id, '2024-03-0' || (1 + doc_id % 9)::VARCHAR || ' 04:05:06' AS parsed FROM documents WHERE doc_id % 4 < 3
UNION ALL SELECT doc_id, NULL FROM documents WHERE doc_id % 4 = 3
""")
def date_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    day = F.concat(F.lit("0"), (1 + i % 9).cast("string"))
    raw = F.when(i % 4 == 0, F.concat(F.lit("Fri, "), day, F.lit(" Mar 2024 04:05:06 +0000"))).when(i % 4 == 1, F.concat(F.lit("2024-03-"), day, F.lit("T05:05:06+01:00"))).when(i % 4 == 2, F.concat(F.lit("2024-03-"), day, F.lit(" 04:05:06"))).otherwise("soon")
    return table(spark, sf_dir, "documents").select("doc_id", F.date_format(timefn.parse_any(raw), "yyyy-MM-dd HH:mm:ss").alias("parsed"))


@query("digest_buckets_topk", f"""
WITH b AS (SELECT doc_id, n_chars, {TITLE} AS title, CASE WHEN source IN ('src0', 'src1', 'src2') THEN 'papers' WHEN source IN ('src3', 'src4') THEN 'blogs' ELSE 'press' END AS bucket FROM documents)
SELECT bucket, row_number() OVER (PARTITION BY bucket ORDER BY n_chars DESC, doc_id)::INT AS rank, doc_id, '- ' || substring(title, 1, 40) AS line FROM b QUALIFY rank <= 15
""")
def digest_buckets_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _docs(spark, sf_dir)
    bucket = F.when(F.col("source").isin("src0", "src1", "src2"), "papers").when(F.col("source").isin("src3", "src4"), "blogs").otherwise("press")
    top = feeds.top_per(d.withColumn("bucket", bucket), "bucket", [F.desc("n_chars"), F.asc("doc_id")], 15)
    return top.select("bucket", "rank", "doc_id", F.concat(F.lit("- "), F.substring("title", 1, 40)).alias("line"))


@query("digest_json", f"""
WITH t AS (SELECT doc_id, {TITLE} AS title FROM documents ORDER BY n_chars DESC, doc_id LIMIT 20)
SELECT '2024-01-08' AS generated, 24 AS hours, (SELECT count(*) FROM t) AS total, (SELECT string_agg(doc_id::VARCHAR, ',' ORDER BY doc_id) FROM t) AS ids
""")
def digest_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = _docs(spark, sf_dir).select("doc_id", "title", "n_chars").orderBy(F.desc("n_chars"), "doc_id").limit(20)
    made = feeds.json_digest(top, "2024-01-08", 24)
    back = F.from_json("digest", "generated string, hours int, total long, stories array<struct<doc_id:long,title:string>>")
    d = made.select(back.alias("d"))
    return d.select("d.generated", "d.hours", "d.total", F.array_join(F.transform(F.array_sort("d.stories"), lambda s: s["doc_id"].cast("string")), ",").alias("ids"))


@query("exact_url_clusters", r"""
WITH c AS (SELECT page_id, lower(regexp_replace(regexp_replace(url, '[?#].*$', ''), '/+$', '')) AS link FROM pages)
SELECT page_id, min(page_id) OVER (PARTITION BY link) AS cluster_id, count(*) OVER (PARTITION BY link) AS size FROM c
""")
def exact_url_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages").select("page_id", F.lower(F.regexp_replace(F.regexp_replace("url", r"[?#].*$", ""), "/+$", "")).alias("link"))
    g = p.groupBy("link").agg(F.min("page_id").alias("cluster_id"), F.count("*").alias("size"))
    return p.join(g, "link").select("page_id", "cluster_id", "size")


@query("trigram_stats", f"""
WITH n AS (SELECT doc_id, {normal_sql(TITLE)} AS t FROM documents),
g AS (SELECT doc_id, list_filter(list_distinct(list_transform(range(1, greatest(length(t) - 2, 1) + 1), lambda i: substring(t, i, 3))), lambda x: x <> '') AS g FROM n)
SELECT doc_id, len(g)::INT AS n_trigrams, coalesce(list_min(g), '') AS least FROM g
""")
def trigram_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _docs(spark, sf_dir).select("doc_id", text.trigrams(F.col("title")).alias("g"))
    return d.select("doc_id", F.size("g").alias("n_trigrams"), F.coalesce(F.array_min("g"), F.lit("")).alias("least"))



