"""The normalise stage: one select from ledger rows to articles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storyweft.functions import hashing, lang, text, timefn, url


def collection_label(payload: Column, fallback: Column) -> Column:
    """The payload's collection if it is text, else the row's, else unknown; trimmed, lower case."""
    own = F.lower(F.trim(F.get_json_object(payload, "$.source_metadata.collection")))
    row = F.lower(F.trim(fallback))
    return F.coalesce(F.when(own != "", own), F.when(row != "", row), F.lit("unknown"))


def normalize(raw: DataFrame, detect: bool | Callable[[Column], Column] = True) -> DataFrame:
    """raw: raw_arrival_id, source, source_item_id, collection, url, source_published_at, fetched_at, raw_payload.

    detect: whether to detect languages that payloads do not name, or what gives a text's code, as
    `lambda x: profiles.detector(trained)(x)["lang"]`; True takes stop words, which need no training.

    A payload that is no object falls back to the row: the title is the item id, the body is empty.
    """
    p = F.col("raw_payload")
    text_of = lambda k: F.get_json_object(p, f"$.{k}")
    title = F.coalesce(F.when(F.trim(text_of("title")) != "", text_of("title")), F.col("source_item_id"))
    body = F.coalesce(text_of("body_text"), F.lit(""))
    link = F.coalesce(F.when(F.trim(text_of("canonical_url")) != "", text_of("canonical_url")), F.col("url"))
    code = lang.iso_code(F.coalesce(text_of("language"), F.lit("")))
    language = F.when(code != "", code)
    if detect:
        own = detect if callable(detect) else lang.detect_language
        language = F.coalesce(language, own(F.concat_ws(" ", title, body)))
    host = url.canonical_url_any(link)
    out = raw.select(
        "raw_arrival_id", "source", "source_item_id", collection_label(p, F.col("collection")).alias("collection"), host["canonical"].alias("canonical_url"),
        text.normalize_text(title).alias("normalized_title"), text.normalize_text(body).alias("normalized_text"), F.coalesce(language, F.lit("und")).alias("normalized_language"),
        F.coalesce(timefn.parse_any(text_of("published_at")), F.col("source_published_at")).alias("published_at"), F.coalesce(F.lower(F.trim(text_of("source_domain"))), host["host"]).alias("source_domain"), F.col("fetched_at").alias("created_at"),
    )
    t, b = F.col("normalized_title"), F.col("normalized_text")
    return out.select(
        "*", F.when(F.col("canonical_url") != "", F.sha2("canonical_url", 256)).alias("canonical_url_hash"), F.sha2(t, 256).alias("title_hash"), hashing.content_hash(t, b).alias("content_hash"),
        hashing.simhash64(text.tokens(t)).alias("title_simhash"), hashing.simhash64(text.tokens(b)).alias("text_simhash"), text.count_tokens(t, b).alias("token_count"),
    )


def pending(raw: DataFrame, articles: DataFrame, limit: int | None = None) -> DataFrame:
    """Live ledger rows without an article, in order of arrival."""
    out = raw.filter("deleted_at IS NULL").join(articles.select("raw_arrival_id"), "raw_arrival_id", "left_anti")
    return out if limit is None else out.orderBy("raw_arrival_id").limit(limit)
