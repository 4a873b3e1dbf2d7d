"""Topics by rule tables: keywords, regular expressions, sources; included or excluded, with weights.

Keywords of all topics form one automaton, so a text is read once however many there are. A regular expression waits in it for the
longest literal that it must contain and is searched only where that occurs; without one it is searched always. Texts give the numbers of the rules they match; what
these mean is joined. Rules are taken in blocks of a bounded size, a pass over the texts for each.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storyweft.operators.components import written

#: Most rules, and most bytes of their patterns, of a block, which comes to the driver and is broadcast.
BLOCK_RULES, BLOCK_BYTES = 100_000, 8 << 20
#: Lower-case letters that expressions without case also take for ASCII ones; texts with them are searched for all expressions.
FOLDED = "\u0131\u017f"


def needed(pattern: str) -> str | None:
    """The longest run of at least three ASCII characters, lower case, that every match must contain at the top level."""
    best = run = ""
    for op, arg in re._parser.parse(pattern, re.IGNORECASE):
        run = run + chr(arg) if op is re._constants.LITERAL and arg < 128 else ""
        best = max(best, run, key=len)
    return best.lower() if len(best) > 2 else None


def matcher(rules: list[tuple[int, str, bool]]):
    """A function from a text to the numbers of the rules (number, pattern, is_regex) that occur in its lower-case form."""
    import ahocorasick

    words, alone, own = ahocorasick.Automaton(), [], {}
    for n, pattern, is_regex in rules:
        known = re.compile(pattern, re.IGNORECASE) if is_regex else None
        word = needed(pattern) if is_regex else pattern.lower()
        if word is None:
            alone.append((n, known))
        else:
            own.setdefault(word, ([], []))[is_regex].append((n, known))
    for word, numbers in own.items():
        words.add_word(word, (word, *numbers))
    words.make_automaton()
    all_expressions = alone + [x for _, waiting in own.values() for x in waiting]

    def match(text: str) -> set[int]:
        low, found, seen, waiting = text.lower(), set(), set(), list(alone)
        for _, (word, plain, expressions) in words.iter(low) if own else ():
            if word not in seen:
                seen.add(word)
                found.update(n for n, _ in plain)
                waiting += expressions
        if any(c in low for c in FOLDED):
            waiting = all_expressions
        found.update(n for n, p in waiting if p.search(low))
        return found

    return match


def rule_hits(texts: DataFrame, rules: DataFrame, block_rules: int = BLOCK_RULES, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """id, rule of texts (id, text) and rules (rule, pattern, is_regex): a keyword occurs in the text, a regular expression is found
    in it, in lower case. Null texts, and null or empty patterns, match nothing; a pattern that is no regular expression is an error."""
    spark = texts.sparkSession
    rules = written(rules.filter("pattern <> ''").select(F.col("rule").cast("long").alias("rule"), "pattern", F.coalesce("is_regex", F.lit(False)).alias("is_regex")), "rules")
    n, size = rules.agg(F.count("*"), F.sum(F.octet_length("pattern"))).first()
    blocks = max(1, math.ceil(n / block_rules), math.ceil((size or 0) / block_bytes))
    out = None
    for b in range(blocks):
        own = [(r.rule, r.pattern, r.is_regex) for r in rules.filter(F.pmod(F.xxhash64("rule"), F.lit(blocks)) == b).collect()]
        matcher(own)  # patterns that are none are refused here
        shared = spark.sparkContext.broadcast(own)

        def find(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            match = matcher(shared.value)
            for batch in batches:
                hits = [(i, rule) for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) if t for rule in sorted(match(t))]
                yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in hits], batch.schema.field(0).type), pa.array([r for _, r in hits], pa.int64())], ["id", "rule"])

        found = texts.select("id", "text").mapInArrow(find, f"id {texts.schema['id'].dataType.simpleString()}, rule long")
        out = found if out is None else out.unionByName(found)
    return out


def topics(texts: DataFrame, keywords: DataFrame, sources: DataFrame) -> DataFrame:
    """id, topic_id, weight, rules: topics that texts (id, source, text; ids are unique) belong to.

    keywords: topic_id, rule_type (include or exclude), pattern, is_regex, weight, enabled. sources: topic_id, source, rule_type. A text
    belongs to a topic if one of its enabled include patterns matches and no exclude pattern does, its source is not
    excluded, and is included if the topic includes any. weight: the sum over the include rules that match."""
    numbered = written(keywords.filter("coalesce(enabled, true)").withColumn("rule", F.monotonically_increasing_id()), "topic-rules")
    hits = rule_hits(texts, numbered).join(numbered.select("rule", "topic_id", "rule_type", "weight"), "rule")
    include = F.col("rule_type") == "include"
    met = hits.groupBy("id", "topic_id").agg(F.sum(F.when(include, F.col("weight"))).cast("long").alias("weight"), F.count_if(include).alias("rules"), F.count_if(~include).alias("against")).filter("rules > 0 AND against = 0")
    said = sources.groupBy("topic_id", "source").agg(F.max(F.col("rule_type") == "exclude").alias("out"), F.max(F.col("rule_type") == "include").alias("in"))
    closed = sources.filter("rule_type = 'include'").select("topic_id", F.lit(True).alias("closed")).distinct()
    met = met.join(texts.select("id", "source"), "id").join(said, ["topic_id", "source"], "left").join(closed, "topic_id", "left")
    return met.filter("NOT coalesce(out, false) AND (coalesce(in, false) OR NOT coalesce(closed, false))").select("id", "topic_id", "weight", "rules")
