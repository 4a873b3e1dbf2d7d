"""Changes as copy-on-write: a function takes a table and returns its next state. Plain Parquet has no MERGE."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from storyweft.functions import hashing, text, url


def append_new(ledger: DataFrame, batch: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Rows of batch to append: the first of each key (by order), unless the ledger has the key. A replay adds none."""
    first = Window.partitionBy(*keys).orderBy(order)
    fresh = batch.withColumn("__k", F.row_number().over(first)).filter("__k = 1").drop("__k")
    return fresh.join(ledger.select(*keys).distinct(), keys, "left_anti")


def latest(log: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Last write of each key of an append-only log."""
    return log.withColumn("__k", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("__k = 1").drop("__k")


def upsert(table: DataFrame, batch: DataFrame, keys: list[str], order: list[Column] | None = None) -> DataFrame:
    """table with batch's rows in place of those of equal keys. A batch may repeat a key if order is given: its first row
    by that order counts."""
    if order is not None:
        batch = latest(batch, keys, order)
    return table.join(batch.select(*keys), keys, "left_anti").unionByName(batch)


def touched(before: DataFrame, after: DataFrame, key: str, now: str) -> DataFrame:
    """after, with updated_at set to now for the rows that differ from before, and kept for others. New rows get now."""
    values = [c for c in after.columns if c not in (key, "updated_at")]
    was = before.select(F.col(key), F.struct(*values).alias("__was"), F.col("updated_at").alias("__at"))
    same = F.col("__was").isNotNull() & F.equal_null(F.struct(*values), F.col("__was"))
    at = F.when(same, F.col("__at")).otherwise(F.lit(now).cast("timestamp"))
    return after.drop("updated_at").join(was, key, "left").withColumn("updated_at", at).drop("__was", "__at")


#: The column that dates a row when rows before a time are deleted.
DATED_BY = {"raw_arrivals": "fetched_at", "articles": "created_at", "stories": "last_seen_at"}


def delete_from(tables: dict[str, DataFrame], now: str, collection: str | None = None, before: str | None = None) -> dict[str, DataFrame]:
    """Stories, articles and ledger after the deletion of a collection, of all before a time, or both at once. Each table
    is dated by a column of its own; only live rows change."""
    if collection is None and before is None:
        raise ValueError("name a collection or a time")
    out = {}
    for name, t in tables.items():
        where = F.lit(True)
        if collection is not None:
            where &= F.col("collection") == collection
        if before is not None:
            where &= F.col(DATED_BY[name]) < F.lit(before).cast("timestamp")
        out[name] = soft_delete(t, where, now)
    return out


STATUSES = ("active", "suppressed", "merged")


def update_story(table: DataFrame, where: Column, title: Column | None = None, status: Column | None = None, collection: Column | None = None, link: Column | None = None) -> DataFrame:
    """Only what is given changes. A title is trimmed, a collection trimmed and in lower case, a link brought to its
    canonical form and hashed (empty if it has none); a status outside STATUSES fails the query."""
    put = lambda c, x: F.when(where, x).otherwise(F.col(c))
    out = table
    if title is not None:
        out = out.withColumn("canonical_title", put("canonical_title", F.trim(title)))
    if status is not None:
        known = F.when(status.isin(*STATUSES), status).otherwise(F.raise_error(F.concat(F.lit("unknown status "), status)))
        out = out.withColumn("status", put("status", known))
    if collection is not None:
        out = out.withColumn("collection", put("collection", F.lower(F.trim(collection))))
    if link is not None:
        new = url.canonical_url(link)
        out = out.withColumns({"canonical_url": put("canonical_url", F.nullif(new, F.lit(""))), "url_hash": put("url_hash", F.when(new != "", F.sha2(new, 256)))})
    return out


def with_merges(stories: DataFrame, merges: DataFrame) -> DataFrame:
    """Stories after more articles joined them. merges: story_id, article_id, title, url, url_hash, seen_at.

    Spans widen both ways, in any order of arrival. Where a story has no representative, the first article to join (the
    least id) becomes it and gives title, URL and its hash; other stories keep theirs."""
    first = F.min_by(F.struct("article_id", "title", "url", "url_hash"), "article_id")
    joined = merges.groupBy("story_id").agg(F.min("seen_at").alias("lo"), F.max("seen_at").alias("hi"), first.alias("a"))
    out = stories.join(joined, "story_id", "left")
    fill = F.col("representative_article_id").isNull() & F.col("a").isNotNull()
    put = lambda c, x: F.when(fill, x).otherwise(F.col(c)).alias(c)
    changed = {
        "first_seen_at": F.least("first_seen_at", "lo").alias("first_seen_at"), "last_seen_at": F.greatest("last_seen_at", "hi").alias("last_seen_at"), "canonical_title": put("canonical_title", F.col("a.title")),
        "canonical_url": put("canonical_url", F.col("a.url")), "canonical_url_hash": put("canonical_url_hash", F.col("a.url_hash")), "representative_article_id": F.coalesce("representative_article_id", "a.article_id").alias("representative_article_id"),
    }
    return out.select(*[changed.get(c, F.col(c)) for c in stories.columns])


def touch_sessions(sessions: DataFrame, used: DataFrame, now: str, ttl: str) -> DataFrame:
    """Sessions that were used (session_id) and have not expired live for ttl from now on."""
    t = F.lit(now).cast("timestamp")
    own = used.select("session_id", F.lit(True).alias("__used")).distinct()
    live = F.col("__used") & (F.col("expires_at") > t)
    return sessions.join(own, "session_id", "left").withColumn("expires_at", F.when(live, t + F.expr(f"INTERVAL {ttl}")).otherwise(F.col("expires_at"))).drop("__used")


def emptied(table: DataFrame) -> DataFrame:
    """No rows, the same columns: what a reset writes over a table."""
    return table.limit(0)


def soft_delete(table: DataFrame, where: Column, now: str) -> DataFrame:
    """Only live rows change."""
    hit = F.col("deleted_at").isNull() & where
    return table.withColumn("deleted_at", F.when(hit, F.lit(now).cast("timestamp")).otherwise(F.col("deleted_at")))


def restore(table: DataFrame, where: Column) -> DataFrame:
    """Only deleted rows change."""
    return table.withColumn("deleted_at", F.when(F.col("deleted_at").isNotNull() & where, F.lit(None).cast("timestamp")).otherwise(F.col("deleted_at")))


def affected(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """Dry-run count: one row, rows whose deletion mark changes."""
    b, a = before.select(key, F.col("deleted_at").alias("was")), after.select(key, F.col("deleted_at").alias("is"))
    return b.join(a, key).agg(F.count_if(~F.equal_null("was", "is")).alias("rows"))


def update_article(table: DataFrame, where: Column, title: Column | None = None, link: Column | None = None) -> DataFrame:
    """A new title recomputes title hash, content hash, title simhash and token count; a new link its hash and domain.
    The text's simhash stays. Columns: normalized_title, normalized_text and the derived ones."""
    out = table
    if title is not None:
        t = F.when(where, text.normalize_text(title)).otherwise(F.col("normalized_title"))
        out = out.withColumn("normalized_title", t)
        out = out.withColumn("title_hash", F.sha2("normalized_title", 256)).withColumn("content_hash", hashing.content_hash(F.col("normalized_title"), F.col("normalized_text")))
        out = out.withColumn("title_simhash", hashing.simhash64(text.tokens(F.col("normalized_title")))).withColumn("token_count", text.count_tokens(F.col("normalized_title"), F.col("normalized_text")))
    if link is not None:
        out = out.withColumn("canonical_url", F.when(where, url.canonical_url(link)).otherwise(F.col("canonical_url")))
        out = out.withColumn("url_hash", F.sha2("canonical_url", 256)).withColumn("source_domain", url.url_host(F.col("canonical_url")))
    return out


def changes(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """key, field, was, now for every changed value."""
    names = [c for c in before.columns if c != key]
    both = before.select(key, *[F.col(c).cast("string").alias(f"b_{c}") for c in names]).join(after.select(key, *[F.col(c).cast("string").alias(f"a_{c}") for c in names]), key)
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(f"b_{c}").alias("was"), F.col(f"a_{c}").alias("now")) for c in names]))
    return both.select(key, each.alias("x")).select(key, "x.*").filter(~F.equal_null("was", "now"))


def widened(stories: DataFrame, seen: DataFrame) -> DataFrame:
    """Story spans after more sightings (story_id, seen_at): least and greatest, in any order of arrival."""
    s = seen.groupBy("story_id").agg(F.min("seen_at").alias("lo"), F.max("seen_at").alias("hi"))
    out = stories.join(s, "story_id", "left")
    return out.withColumn("first_seen_at", F.least("first_seen_at", "lo")).withColumn("last_seen_at", F.greatest("last_seen_at", "hi")).drop("lo", "hi")
