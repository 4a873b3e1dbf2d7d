"""Raw web pages: links and lists of entries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storyweft.functions.hashing import short_id

LINK = r'<a [^>]*href="([^"]*)"[^>]*>([^<]*)'


def links(pages: DataFrame) -> DataFrame:
    """page_id, href, label of each anchor."""
    found = F.arrays_zip(F.regexp_extract_all("html", F.lit(LINK), F.lit(1)).alias("href"), F.regexp_extract_all("html", F.lit(LINK), F.lit(2)).alias("label"))
    return pages.select("page_id", F.explode(found).alias("a")).select("page_id", "a.href", "a.label")


def listed(pages: DataFrame, pattern: str) -> DataFrame:
    """id, href, label, page_id of a list page's entries: anchors whose href fits the pattern, whose first group is the
    entry's own id; one row an id, the first in order of pages, then of places. item_id: 16 digits of the id's MD5."""
    found = F.arrays_zip(F.regexp_extract_all("html", F.lit(LINK), F.lit(1)).alias("href"), F.regexp_extract_all("html", F.lit(LINK), F.lit(2)).alias("label"))
    rows = pages.select("page_id", F.posexplode(found).alias("at", "a")).select("page_id", "at", "a.href", F.trim("a.label").alias("label"))
    rows = rows.withColumn("id", F.regexp_extract("href", pattern, 1)).filter((F.col("id") != "") & (F.col("label") != ""))
    first = rows.groupBy("id").agg(F.min(F.struct("page_id", "at", "href", "label")).alias("r"))
    return first.select("id", short_id(F.col("id")).alias("item_id"), "r.href", "r.label", "r.page_id")
