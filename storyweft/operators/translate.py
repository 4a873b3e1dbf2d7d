"""Translation tasks over a cache: a provider registry and a set-based runner."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from storyweft.functions.lang import language_code
from storyweft.functions.text import substantive


class Provider(Protocol):
    name: str

    def translate(self, text: str, source: str, target: str) -> str: ...


class Tagged:
    """For tests: the text after its target language."""

    name = "tagged"

    def translate(self, text: str, source: str, target: str) -> str:
        return f"[{target}] {text}"


class Prompted:
    """A chat service asked to translate; `ask` (system, user) -> text does the transport. An empty answer is an error."""

    name = "local"

    def __init__(self, ask: Callable[[str, str], str]):
        self.ask = ask

    def prompt(self, source: str, target: str) -> str:
        label = lambda c: LANGUAGES.get(c, c)
        return f"Translate from {label(source) if source and source != 'und' else 'the language of the text'} to {label(target)}. Answer with the translation alone."

    def translate(self, text: str, source: str, target: str) -> str:
        answer = (self.ask(self.prompt(source, target), text) or "").strip()
        if not answer:
            raise ValueError("the service gave no translation")
        return answer


#: Languages that can be translated into, with their English names.
LANGUAGES = {
    "ar": "Arabic", "de": "German", "en": "English", "es": "Spanish", "fr": "French", "id": "Indonesian", "it": "Italian", "ja": "Japanese", "ko": "Korean", "pl": "Polish", "pt": "Portuguese", "ru": "Russian",
    "th": "Thai", "tr": "Turkish", "vi": "Vietnamese", "zh": "Chinese",
}


def supported(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(sorted(LANGUAGES.items()), "code string, name string")


class Registry:
    """Providers by name, letter case aside. Without a default given, STORYWEFT_TRANSLATOR names it."""

    def __init__(self, default: str | None = None):
        self.makers: dict[str, Callable[[], Provider]] = {}
        self.default = default or os.environ.get("STORYWEFT_TRANSLATOR")

    def names(self) -> list[str]:
        return sorted(self.makers)

    def add(self, name: str, make: Callable[[], Provider]) -> None:
        key = name.strip().lower()
        if not key or key in self.makers:
            raise ValueError(f"provider name is empty or taken: {name!r}")
        self.makers[key] = make

    def get(self, name: str | None = None) -> Callable[[], Provider]:
        key = (name or self.default or "").strip().lower()
        if key not in self.makers:
            raise KeyError(f"no provider {key!r}; there are {sorted(self.makers)}")
        return self.makers[key]


def expand(stories: DataFrame, articles: DataFrame) -> DataFrame:
    """source_type, source_id, source_lang, text: a story's title, then each member's title and text."""
    s = stories.select(F.lit("story_title").alias("source_type"), F.col("story_id").alias("source_id"), F.col("collection").alias("source_lang"), F.col("canonical_title").alias("text"))
    for kind, column in (("article_title", "title"), ("article_text", "body")):
        s = s.unionByName(articles.select(F.lit(kind).alias("source_type"), F.col("article_id").alias("source_id"), F.col("collection").alias("source_lang"), F.col(column).alias("text")))
    return s.filter(F.trim("text") != "")


def planned(tasks: DataFrame, cache: DataFrame, target: str) -> DataFrame:
    """tasks with content_hash and state: skipped (same language), cached, or open. cache: source_type, source_id,
    content_hash, target_lang."""
    t = tasks.withColumn("content_hash", F.sha2("text", 256))
    have = cache.filter(F.col("target_lang") == target).select("source_type", "source_id", "content_hash", F.lit(True).alias("have")).distinct()
    t = t.join(have, ["source_type", "source_id", "content_hash"], "left")
    same = language_code(F.col("source_lang")) == F.lit(target)
    return t.withColumn("state", F.when(same, "skipped").when(F.col("have"), "cached").otherwise("open")).drop("have")


def run(plan: DataFrame, target: str, make: Callable[[], Provider]) -> DataFrame:
    """Results of the open tasks, to append to the cache."""

    def call(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        provider = make()
        for b in batches:
            done = [provider.translate(t, s, target) for t, s in zip(b["text"], b["source_lang"])]
            yield pd.DataFrame({"source_type": b["source_type"], "source_id": b["source_id"], "content_hash": b["content_hash"], "target_lang": target, "translated_text": done, "provider": provider.name})

    schema = "source_type string, source_id long, content_hash string, target_lang string, translated_text string, provider string"
    return plan.filter("state = 'open'").select("source_type", "source_id", "content_hash", "source_lang", "text").mapInPandas(call, schema)


def stats(plan: DataFrame, dry: bool = False) -> DataFrame:
    """total, translated, cached, skipped; a dry run translates none and counts open tasks as skipped."""
    is_ = lambda s: F.count_if(F.col("state") == s)
    done = F.lit(0).cast("long") if dry else is_("open")
    return plan.agg(F.count("*").alias("total"), done.alias("translated"), is_("cached").alias("cached"), (is_("skipped") + (is_("open") if dry else F.lit(0))).alias("skipped"))


def sources(tasks: DataFrame, captured_at: str) -> DataFrame:
    """Rows of the table of sources: one for each type, id and content."""
    rows = tasks.select("source_type", "source_id", "source_lang", F.col("text").alias("original_text"), F.sha2("text", 256).alias("content_hash"))
    origin = F.when(F.col("source_type") == "article_text", "reader").otherwise("normalized")
    return rows.dropDuplicates(["source_type", "source_id", "content_hash"]).select("*", origin.alias("content_origin"), F.lit(captured_at).cast("timestamp").alias("captured_at"))


def lookup(cache: DataFrame, wanted: DataFrame, target: str) -> DataFrame:
    """wanted (source_type, source_id, content_hash) with the cached translation of that very content, null without."""
    own = cache.filter(F.col("target_lang") == target).select("source_type", "source_id", "content_hash", "translated_text")
    return wanted.join(own.dropDuplicates(["source_type", "source_id", "content_hash"]), ["source_type", "source_id", "content_hash"], "left")


def hydrated(articles: DataFrame, read: DataFrame) -> DataFrame:
    """articles (article_id, title, body) whose body is no substantive text take the reader's (article_id, text), if that
    is; origin tells which: normalized or reader."""
    r = read.select("article_id", F.col("text").alias("__read"))
    j = articles.join(r, "article_id", "left")
    thin = ~F.coalesce(substantive(F.col("body"), F.col("title")), F.lit(False))
    use = thin & F.coalesce(substantive(F.col("__read"), F.col("title")), F.lit(False))
    return j.withColumns({"body": F.when(use, F.col("__read")).otherwise(F.col("body")), "origin": F.when(use, "reader").otherwise("normalized")}).drop("__read")


def listing(results: DataFrame) -> DataFrame:
    """place (from 1) of each result: by target language, type and id, later captures first, then later results."""
    order = Window.partitionBy("target_lang", "source_type", "source_id").orderBy(F.desc("captured_at"), F.desc("created_at"), F.desc("result_id"))
    return results.withColumn("place", F.row_number().over(order))
