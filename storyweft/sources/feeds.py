"""Feed readers and digests: RSS, Atom, listing JSON, keyword filters, per-bucket cuts, JSON and Markdown output."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from storyweft.functions.text import plain_text
from storyweft.functions.timefn import parse_any

RSS = "title string, link string, description string, pubDate string, guid string"
ATOM = "title string, link array<struct<_href:string,_rel:string>>, summary string, content string, updated string, published string, id string, category array<struct<_term:string>>"


def _summary(x: Column, limit: int = 300) -> Column:
    return F.substring(F.trim(plain_text(F.coalesce(x, F.lit("")))), 1, limit)


def _items(rows: DataFrame, cutoff: str | None) -> DataFrame:
    """Entries with title and link; dated ones before the cutoff go, undated ones stay."""
    rows = rows.filter((F.trim("title") != "") & (F.trim("link") != ""))
    return rows if cutoff is None else rows.filter(F.coalesce(F.col("published_at") >= F.lit(cutoff).cast("timestamp"), F.lit(True)))


def read_rss(spark: SparkSession, path: str, cutoff: str | None = None) -> DataFrame:
    x = spark.read.format("xml").option("rowTag", "item").schema(RSS).load(path)
    return _items(x.select(F.trim("title").alias("title"), F.trim("link").alias("link"), _summary(F.col("description")).alias("summary"), parse_any(F.col("pubDate")).alias("published_at")), cutoff)


def read_atom(spark: SparkSession, path: str, cutoff: str | None = None, categories: int = 0, dated: bool = True) -> DataFrame:
    """With categories, that many are put before the summary in brackets. Not dated: times stay null, and so no cutoff
    takes an entry away."""
    x = spark.read.format("xml").option("rowTag", "entry").schema(ATOM).load(path)
    link = F.coalesce(F.filter("link", lambda s: F.coalesce(s["_rel"], F.lit("alternate")) == "alternate")[0]["_href"], F.col("link")[0]["_href"], F.col("id"))
    summary = _summary(F.coalesce("summary", "content"))
    if categories:
        tags = F.concat_ws(", ", F.slice(F.transform("category", lambda c: c["_term"]), 1, categories))
        summary = F.concat(F.when(tags != "", F.concat(F.lit("["), tags, F.lit("] "))).otherwise(F.lit("")), summary)
    return _items(x.select(F.trim("title").alias("title"), link.alias("link"), summary.alias("summary"), (parse_any(F.coalesce("published", "updated")) if dated else F.lit(None).cast("timestamp")).alias("published_at")), cutoff)


def read_papers(spark: SparkSession, path: str) -> DataFrame:
    """Paper feeds: the first three subjects stand before the summary; no cutoff."""
    return read_atom(spark, path, categories=3)


VIDEOS = "title string, `yt:videoId` string, published string, link struct<_href:string>, `media:group` struct<`media:title`:string,`media:description`:string,`media:thumbnail`:struct<_url:string>>"


def read_videos(spark: SparkSession, path: str, cutoff: str | None = None) -> DataFrame:
    """Video feeds: summary and picture come from the media namespace; without a link the video's id gives one."""
    x = spark.read.format("xml").option("rowTag", "entry").schema(VIDEOS).load(path)
    link = F.coalesce(F.col("link._href"), F.concat(F.lit("https://www.youtube.com/watch?v="), F.col("`yt:videoId`")))
    group = F.col("`media:group`")
    rows = x.select(
        F.trim(F.coalesce("title", group["media:title"])).alias("title"), F.trim(link).alias("link"), _summary(group["media:description"]).alias("summary"), parse_any(F.col("published")).alias("published_at"),
        group["media:thumbnail"]["_url"].alias("image_url"), F.col("`yt:videoId`").alias("video_id"),
    )
    return _items(rows, cutoff)


def first_ids(lines: DataFrame, k: int) -> DataFrame:
    """id, place of the first k ids of a JSON list of ids (column value, one list)."""
    ids = lines.select(F.posexplode(F.slice(F.from_json("value", "array<long>"), 1, k)).alias("place", "id"))
    return ids.select("id", (F.col("place") + 1).alias("place"))


LISTING = "data struct<children:array<struct<data:struct<title:string,url:string,permalink:string,selftext:string,created_utc:double,score:long,subreddit:string>>>>"


def read_listing(lines: DataFrame, cutoff_epoch: float, host: str, cap: int = 25) -> DataFrame:
    """Posts of listing JSON (column value, one document a row): external link first, at most `cap` a board, newest first."""
    posts = lines.select(F.explode(F.from_json("value", LISTING)["data"]["children"]).alias("c")).select("c.data.*").filter(F.col("created_utc") >= cutoff_epoch)
    own = F.concat(F.lit(host), F.col("permalink"))
    posts = posts.withColumn("link", F.when(F.coalesce(F.col("url"), F.lit("")).startswith("http"), F.col("url")).otherwise(own))
    return top_per(posts, "subreddit", [F.desc("created_utc"), F.asc("link")], cap)


def read_scored(lines: DataFrame, keywords: list[str], ids: DataFrame | None = None) -> DataFrame:
    """Scored link items (column value, JSON a row): those of the ids wanted, keyword filter, one a URL (best score), by
    score."""
    i = lines.select(F.from_json("value", "id long, title string, url string, score long, time long, descendants long").alias("i")).select("i.*")
    if ids is not None:
        i = i.join(ids.select("id"), "id", "left_semi")
    i = i.filter(has_keyword(F.col("title"), keywords))
    best = Window.partitionBy("url").orderBy(F.desc("score"), "id")
    return i.withColumn("k", F.row_number().over(best)).filter("k = 1").drop("k").orderBy(F.desc("score"), "id")


def has_keyword(x: Column, keywords: list[str]) -> Column:
    """Any keyword within the text, letter case aside."""
    low = F.lower(x)
    out = F.lit(False)
    for k in keywords:
        out = out | F.contains(low, F.lit(k.lower()))
    return out


def combined(parts: list[DataFrame]) -> DataFrame:
    """Rows of several sources under one another, in order of the sources (column part); columns that a source lacks are
    null."""
    out = None
    for i, p in enumerate(parts):
        own = p.withColumn("part", F.lit(i))
        out = own if out is None else out.unionByName(own, allowMissingColumns=True)
    return out


def first_by_url(items: DataFrame, order: str, link: str = "link") -> DataFrame:
    """The first item of each URL, final slashes aside."""
    w = Window.partitionBy(F.regexp_replace(link, "/+$", "")).orderBy(order)
    return items.withColumn("__k", F.row_number().over(w)).filter("__k = 1").drop("__k")


def top_per(rows: DataFrame, key: str, order: list[Column], k: int) -> DataFrame:
    """rank (from 1) and the first k rows of each key; the filter on the rank cuts before the shuffle."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter(F.col("rank") <= k)


def json_digest(top: DataFrame, generated: str, hours: int) -> DataFrame:
    """One row, digest: JSON of a bounded list of rows."""
    own = top.agg(F.count("*").alias("total"), F.collect_list(F.struct("doc_id", "title")).alias("stories"))
    return own.select(F.to_json(F.struct(F.lit(generated).alias("generated"), F.lit(hours).alias("hours"), "total", "stories")).alias("digest"))


def markdown_digest(top: DataFrame, heading: str = "bucket", title: str = "title", link: str = "link", summary: str = "summary") -> DataFrame:
    """bucket, text: a section of rows ranked by top_per (bounded a bucket)."""
    line = F.concat(F.lit("- ["), F.col(title), F.lit("]("), F.col(link), F.lit(")"), F.when(F.trim(summary) != "", F.concat(F.lit(": "), F.substring(summary, 1, 200))).otherwise(""))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))), lambda s: s["line"])
    return top.groupBy(heading).agg(F.concat(F.lit("## "), F.first(heading), F.lit("\n\n"), F.array_join(lines, "\n")).alias("text"))
