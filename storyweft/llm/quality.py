"""Quality selection by importance resampling: log ratio of hashed n-gram models of target and raw text, Gumbel top-k.

Raw counts cover every text; target counts cover the labelled good texts (a bounded sample, SAMPLE). A document's log
importance weight is the sum of log p_target - log p_raw over its hashed words and word pairs, taken per n-gram (long
texts must not outweigh short ones) and tempered: its logit is that mean over TEMPERATURE. Its key adds unit Gumbel noise
from a hash of its id, so the k largest keys are a draw of k documents without replacement in proportion to exp(logit).
k, the target size, is the number of documents that labelled texts outside the target sample tell apart as good; it may
be given instead. Documents far from that border are sure to stay or go, those near it are drawn.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from storyweft.llm.common import discard, documents, extended, mix64, saved, slices, words_of

BITS = 18
#: Labelled texts used at most, half of them for the target model and half for the threshold.
SAMPLE = 40_000
#: A share of the good labelled texts lost counts as much as so many times that share of the bad ones kept.
COST = 10.0
#: A document is e times as likely to be drawn next as one whose mean log ratio is less by this.
TEMPERATURE = 0.02
SEED = 7


def gram_buckets(texts: list[bytes | None], bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the texts' words and word pairs, one text after the other, and where each text's end; A-Z count as a-z."""
    h, ends = words_of(texts)
    at = np.concatenate([[0], ends])
    pairs = mix64(h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:])
    both = np.empty(2 * len(h), np.uint64)
    both[::2] = mix64(h)
    both[1 : 2 * len(pairs) : 2] = pairs  # after each word its pair with the next
    keep = np.ones(len(both), bool)
    keep[2 * ends[np.diff(at) > 0] - 1] = False  # a text's last word has no next one
    words = np.diff(at)
    return (both[keep] >> np.uint64(64 - bits)).astype(np.int64), np.cumsum(np.maximum(0, 2 * words - 1))


def bucket_counts(docs: DataFrame, bits: int = BITS) -> DataFrame:
    """kind, bucket, n: sums over the texts of docs (kind, text), combined in the JVM."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch, texts in slices(batches, "text"):
            by: dict[str, list[bytes]] = {}
            for kind, t in zip(batch.column(0).to_pylist(), texts):
                by.setdefault(kind, []).append(t)
            for kind, own in by.items():
                total = sums.setdefault(kind, np.zeros(1 << bits, np.int64))
                total += np.bincount(gram_buckets(own, bits)[0], minlength=1 << bits)
        for kind, total in sums.items():
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array([kind] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(total[at])], ["kind", "bucket", "n"])

    return docs.filter("text IS NOT NULL").select("kind", "text").mapInArrow(count, "kind string, bucket int, n long").groupBy("kind", "bucket").agg(F.sum("n").alias("n"))


def log_ratio(counts: DataFrame, bits: int = BITS) -> np.ndarray:
    """log p_target - log p_raw of each bucket; 2^bits sums of each kind come to the driver.

    The target model is smoothed by the raw one, which gives a bucket that the sample lacks its share of a small mass.
    """
    rows = counts.toArrow()
    kind = np.array(rows["kind"].to_pylist())
    n = {}
    for k in ("raw", "target"):
        n[k] = np.zeros(1 << bits)
        own = kind == k
        n[k][rows["bucket"].to_numpy()[own]] = rows["n"].to_numpy()[own]
    raw = (n["raw"] + 0.5) / (n["raw"] + 0.5).sum()
    mass = 0.05 * max(1.0, n["target"].sum())
    target = (n["target"] + mass * raw) / (n["target"].sum() + mass)
    return np.log(target / raw).astype(np.float32)


def weigh(docs: DataFrame, ratio: np.ndarray, text: str = "text", bits: int = BITS) -> DataFrame:
    """docs plus weight (sum of log ratios) and grams (how many); null texts weigh 0 over 0 n-grams."""
    shared = docs.sparkSession.sparkContext.broadcast(ratio)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches, text):
            codes, ends = gram_buckets(texts, bits)
            n = np.diff(ends, prepend=0)
            full = np.flatnonzero(n)
            w = np.zeros(len(texts))
            if len(full):
                w[full] = np.add.reduceat(shared.value[codes], (ends - n)[full], dtype=np.float64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(w), pa.array(n.astype(np.int64))], [*batch.schema.names, "weight", "grams"])

    return docs.mapInArrow(score, extended(docs, weight="double", grams="long"))


def gumbel(id_: Column, seed: int | Column = SEED) -> Column:
    """Unit Gumbel noise, the same for an id and seed wherever it is computed."""
    u = (F.xxhash64(seed if isinstance(seed, Column) else F.lit(seed), id_).bitwiseAND(F.lit((1 << 53) - 1)) + 0.5) / float(1 << 53)
    return -F.log(-F.log(u))


def mean_ratio() -> Column:
    """A text's mean log ratio an n-gram; 0 without any."""
    return F.when(F.col("grams") > 0, F.col("weight") / F.col("grams")).otherwise(0.0)


def draw_key(score: Column, id_: Column, temperature: float = TEMPERATURE, seed: int | Column = SEED) -> Column:
    return score / F.lit(temperature) + gumbel(id_, seed)


def kth_largest(df: DataFrame, column: str, k: int, bins: int = 4096) -> float:
    """The k-th largest value, by narrowing a histogram: a few passes over one column, `bins` counts to the driver."""
    lo, hi, n = df.agg(F.min(column), F.max(column), F.count(column)).first()
    if not n or k <= 0:
        return float("inf")
    if k >= n:
        return lo
    while True:
        inside = df.filter((F.col(column) >= lo) & (F.col(column) <= hi))
        step = (hi - lo) / bins
        if step == 0 or lo + step == lo:
            return hi
        place = F.least(F.floor((F.col(column) - lo) / step), F.lit(bins - 1))
        found = inside.groupBy(place.alias("b")).agg(F.count("*").alias("n"), F.min(column).alias("lo"), F.max(column).alias("hi")).orderBy(F.desc("b")).collect()
        for r in found:
            if k <= r.n:
                break
            k -= r.n
        if r.lo == r.hi or k == r.n:
            return r.lo
        if k == 1:
            return r.hi
        lo, hi = r.lo, r.hi


@dataclass
class QualityRule:
    """What a fit leaves: the log ratios, the size of the draw and the least key that is in it."""

    ratio: np.ndarray
    size: int
    least: float
    temperature: float
    seed: int
    weighed: DataFrame  # doc_id, weight, grams, score, key of the documents it was fitted on

    def apply(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """docs' kept rows, all columns: weighed again in one pass, which moves no text."""
        own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(text_col).alias("text"))
        key = draw_key(mean_ratio(), F.col(f"row.{id_col}"), self.temperature, self.seed)
        return weigh(own, self.ratio).filter(key >= F.lit(self.least)).select("row.*")


def fit_quality(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE, cost: float = COST, size: int | None = None, temperature: float = TEMPERATURE, seed: int = SEED
) -> QualityRule:
    """A rule from all of docs and from labels: doc_id and quality (1 good, 0 bad; null is ignored). size: how many
    documents to draw; by default as many as reach the bar of threshold().

    Documents without any word, and null texts, have score and weight 0 and are drawn like any other. Without good
    labels, everything is kept. Rows of one id and text stand or fall together, so ties at the border may keep a few
    more than size; rows of a null id share one noise. Other columns of docs are ignored. Very long texts count whole,
    in memory that follows the longest text; an empty table gives a rule that keeps nothing.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    marks = labels.filter("quality IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    marks = marks.withColumn("turn", F.xxhash64(F.lit(seed + 1), "doc_id")).orderBy("turn").limit(sample)
    marks = saved(marks.withColumn("fit", F.pmod("turn", F.lit(2)) == 0).drop("turn"), "quality-labels")  # `sample` rows at most
    labelled = saved(rows.join(F.broadcast(marks), "doc_id"), "quality-sample")
    counts = bucket_counts(rows.select(F.lit("raw").alias("kind"), "text").unionByName(labelled.filter("fit AND quality = 1").select(F.lit("target").alias("kind"), "text")))
    counts = saved(counts, "quality-counts")
    ratio = log_ratio(counts)
    weighed = saved(weigh(rows, ratio).drop("text"), "quality-weights").withColumn("score", mean_ratio())
    if size is None:
        judged = weighed.join(F.broadcast(marks), "doc_id").filter("NOT fit").select("score", "quality").toPandas()
        size = weighed.filter(F.col("score") >= threshold(judged["score"].to_numpy(), judged["quality"].to_numpy(), cost)).count()
    weighed = weighed.withColumn("key", draw_key(F.col("score"), F.col("doc_id"), temperature, seed))
    discard(docs.sparkSession, marks, labelled, counts)
    return QualityRule(ratio, size, kth_largest(weighed, "key", size), temperature, seed, weighed)


def threshold(score: np.ndarray, quality: np.ndarray, cost: float = COST) -> float:
    """The bar with the least cost: the share of good labelled texts below it, times `cost`, plus the share of bad ones at
    or above it; -inf if none are good. Shares mean the same at every number of labels, and one good label of n weighs
    cost / n: it moves the bar past no larger share of the bad ones. Where good and bad lie apart, the middle of the gap.
    """
    good, bad = np.sort(score[quality == 1]), np.sort(score[quality == 0])
    if not len(good):
        return float("-inf")
    if not len(bad):
        return float(good[0]) - 1.0
    lost = np.searchsorted(good, good) / len(good)
    kept = 1 - np.searchsorted(bad, good) / len(bad)
    cut = float(good[np.argmin(cost * lost + kept)])  # of equal costs the lowest bar
    below = bad[bad < cut]
    return (cut + float(below[-1])) / 2 if len(below) else cut


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    rule = fit_quality(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return rule.weighed.select("doc_id", (F.col("key") >= F.lit(rule.least)).alias("kept"), "score", "weight", "grams")
