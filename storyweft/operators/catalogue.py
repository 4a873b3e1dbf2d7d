"""Reading forms over the stored model: summaries, searches, lookups and details of stories. Functions of tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storyweft.operators.mutations import latest

SUMMARY = ["story_id", "story_uuid", "canonical_title", "canonical_url", "collection", "first_seen_at", "last_seen_at", "source_count", "article_count", "status", "created_at"]


def by_events(stories: DataFrame, events: DataFrame, start: str, until: str, collection: str | None = None, decision: str | None = None) -> DataFrame:
    """Summaries of the stories that had events in start <= time < until, with the last of these; a collection is that of
    the events' articles. Events are summed by story before they meet the stories."""
    if not start < until:
        raise ValueError("the window is empty")
    e = events.filter((F.col("created_at") >= F.lit(start).cast("timestamp")) & (F.col("created_at") < F.lit(until).cast("timestamp")))
    if collection:
        e = e.filter(F.col("collection") == collection)
    if decision:
        e = e.filter(F.col("decision") == decision)
    last = e.groupBy(F.col("chosen_story_id").alias("story_id")).agg(F.max("created_at").alias("event_created_at"))
    return stories.join(last, "story_id").select(*SUMMARY, "event_created_at")


def most_covered(summaries: DataFrame, limit: int, then: str = "event_created_at") -> DataFrame:
    """The first by sources, articles, then the latest by a column, then the id."""
    return summaries.orderBy(F.desc("source_count"), F.desc("article_count"), F.desc(then), F.desc("story_id")).limit(limit)


def by_title(stories: DataFrame, words: str, collection: str | None = None) -> DataFrame:
    """Summaries of the stories whose title holds the words, letter case aside; % and _ are wildcards."""
    if not words.strip():
        raise ValueError("a search needs words")
    s = stories.filter(F.col("canonical_title").ilike(f"%{words.strip()}%"))
    return (s.filter(F.col("collection") == collection) if collection else s).select(*SUMMARY)


def feed(stories: DataFrame, words: str = "", status: str | None = "active", collection: str | None = None) -> DataFrame:
    """Stories of a status whose title or URL holds the words; a story without URL is searched by its title."""
    s = stories if status is None else stories.filter(F.col("status") == status)
    if collection:
        s = s.filter(F.col("collection") == collection)
    if words:
        s = s.filter(F.col("canonical_title").ilike(f"%{words}%") | F.coalesce("canonical_url", F.lit("")).ilike(f"%{words}%"))
    return s


def by_uuid(table: DataFrame, column: str, value: str) -> DataFrame:
    """At most one row."""
    return table.filter(F.col(column) == F.lit(value.strip().lower())).limit(1)


def provenance(stories: DataFrame, members: DataFrame, articles: DataFrame) -> DataFrame:
    """A row for each member of each story, with where it came from, how it matched, and the story's representative (null
    unless its uuid, source and item id are all there)."""
    r = articles.select(F.col("article_id").alias("representative_article_id"), F.struct("article_uuid", "source", "source_item_id", "published_at").alias("r"))
    whole = F.col("r.article_uuid").isNotNull() & F.col("r.source").isNotNull() & F.col("r.source_item_id").isNotNull()
    s = stories.select("story_id", "story_uuid", "canonical_title", "status", "representative_article_id", "source_count", "article_count").join(r, "representative_article_id", "left")
    s = s.withColumn("representative", F.when(whole, F.col("r"))).drop("r", "representative_article_id")
    own = members.select("story_id", "article_id", "article_uuid", "source", "source_item_id", F.col("title").alias("article_title"), F.col("canonical_url").alias("article_url"), "match_type", "match_score", "match_details", "matched_at")
    return s.join(own, "story_id")


def translated(rows: DataFrame, results: DataFrame, source_type: str, key: str, lang: str, shown: Column, name: str = "shown") -> DataFrame:
    """rows with the latest translation of their source into lang where there is one, else what shown gives."""
    own = results.filter((F.col("source_type") == source_type) & (F.col("target_lang") == lang))
    own = latest(own, ["source_id"], [F.desc("captured_at"), F.desc("result_id")]).select(F.col("source_id").alias(key), F.col("translated_text").alias("__t"))
    return rows.join(own, key, "left").withColumn(name, F.coalesce("__t", shown)).drop("__t")


def preview(articles: DataFrame, read: DataFrame, limit: int) -> DataFrame:
    """article_id, origin (reader, normalized_text or none), text cut to limit, char_count of what is shown, truncated.
    read: article_id, text. The reader's text comes first where it is no blank."""
    from storyweft.functions import text as t

    j = articles.join(read.select("article_id", F.col("text").alias("__r")), "article_id", "left")
    filled = lambda c: F.coalesce(F.trim(c) != "", F.lit(False))
    origin = F.when(filled(F.col("__r")), "reader").when(filled(F.col("normalized_text")), "normalized_text").otherwise("none")
    j = j.withColumn("origin", origin).withColumn("__x", F.when(F.col("origin") == "reader", F.col("__r")).when(F.col("origin") == "normalized_text", F.col("normalized_text")).otherwise(F.lit("")))
    shown = t.truncate_text(F.col("__x"), limit)
    return j.select("article_id", "origin", shown.alias("text"), F.char_length(shown).cast("long").alias("char_count"), t.truncated(F.col("__x"), limit).alias("truncated"))
