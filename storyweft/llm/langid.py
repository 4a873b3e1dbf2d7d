"""Language identification: multinomial naive Bayes over hashed character n-grams.

Counts are summed by Spark over all training texts (a row per language, bucket and task, combined in the JVM); the
log-probability matrix, languages x 2^15 float32, is all that is broadcast. Texts are scored in numpy batches.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storyweft.llm.common import documents, extended, held_out, slices

BITS = 15
ORDERS = (1, 2, 3)
UNKNOWN = "und"
#: Letters, and other numerals than decimal digits; has_letter() sets those apart.
LETTER = re.compile(r"[^\W\d_]")
#: Most labels that fit() takes: their sums, labels x 2^15, come to the driver and are broadcast.
MAX_LABELS = 1000
#: ASCII that is no letter counts as a blank.
FOLD = np.array([c if chr(c).isalpha() else 32 for c in range(128)], np.uint32)
MULTIPLIERS = (np.uint32(0x9E3779B1), np.uint32(0x85EBCA77), np.uint32(0xC2B2AE3D))


def has_letter(text: str) -> bool:
    return any(m[0].isalpha() for m in LETTER.finditer(text))


def gram_codes(texts: list[str], orders: tuple[int, ...] = ORDERS, bits: int = BITS) -> tuple[list[np.ndarray], np.ndarray]:
    """Bucket of every n-gram of the texts' code points, an array for each order; where each text starts.

    Each text stands between blanks. n-grams that reach into the next text get the bucket 2^bits.
    """
    points = [np.frombuffer(f" {t.lower()} ".encode("utf-32-le", "replace"), np.uint32) for t in texts]
    starts = np.cumsum([0, *map(len, points)])
    c = np.concatenate(points)
    c = np.where(c < 128, FOLD[np.minimum(c, 127)], c)
    out = []
    for n in orders:
        h = np.full(len(c), np.uint32(n * 0x27D4EB2F & 0xFFFFFFFF))
        for j in range(n):
            h[: len(c) - j] = (h[: len(c) - j] ^ c[j:]) * MULTIPLIERS[j % 3]
            h ^= h >> np.uint32(15)
        code = (h >> np.uint32(32 - bits)).astype(np.int32)
        for j in range(1, n):
            code[starts[1:] - j] = 1 << bits
        out.append(code)
    return out, starts[:-1]


def gram_counts(docs: DataFrame, label: str, text: str, bits: int = BITS) -> DataFrame:
    """label, bucket, n over all texts; bucket -1 counts the texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch, texts in slices(batches, "text"):
            by: dict[str, list[str]] = {}
            for label_, t in zip(batch.column(0).to_pylist(), texts):
                by.setdefault(label_, []).append(t.decode("utf-8", "replace"))
            for label_, own in by.items():
                total = sums.setdefault(label_, np.zeros((1 << bits) + 2, np.int64))
                for code in gram_codes(own, bits=bits)[0]:
                    total[:-1] += np.bincount(code, minlength=(1 << bits) + 1)
                total[-1] += len(own)
        for label_, total in sums.items():
            total[-2] = 0
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array([label_] * len(at), pa.string()), pa.array(np.where(at > 1 << bits, -1, at), pa.int32()), pa.array(total[at])], ["label", "bucket", "n"])

    rows = docs.select(F.col(label).cast("string").alias("label"), F.col(text).alias("text")).dropna()
    return rows.mapInArrow(count, "label string, bucket int, n long").groupBy("label", "bucket").agg(F.sum("n").alias("n"))


class LanguageModel:
    def __init__(self, labels: list[str], weights: np.ndarray, prior: np.ndarray, bits: int = BITS):
        self.labels, self.weights, self.prior, self.bits = labels, weights, prior, bits

    @classmethod
    def fit(cls, docs: DataFrame, label: str = "lang", text: str = "text", alpha: float = 0.5, bits: int = BITS) -> LanguageModel:
        """Counts cover all of docs; languages x 2^bits sums come to the driver, so more than MAX_LABELS languages are
        refused. Rows with a null text or label teach nothing; repeated rows count as often as they come."""
        if docs.filter(F.col(label).isNotNull()).select(label).distinct().limit(MAX_LABELS + 1).count() > MAX_LABELS:
            raise ValueError(f"more than {MAX_LABELS} labels")
        rows = gram_counts(docs, label, text, bits).toArrow()
        labels = sorted(set(rows["label"].to_pylist()))
        counts = np.zeros((len(labels), (1 << bits) + 1))
        place = {x: i for i, x in enumerate(labels)}
        counts[[place[x] for x in rows["label"].to_pylist()], rows["bucket"].to_numpy()] = rows["n"].to_numpy()
        texts = counts[:, -1].copy()
        grams = counts[:, :-1] + alpha
        weights = np.zeros(((1 << bits) + 1, len(labels)), np.float32)
        weights[:-1] = np.log(grams / grams.sum(axis=1, keepdims=True)).T if labels else 0
        return cls(labels, weights, np.log(texts / max(1, texts.sum())) if labels else texts, bits)

    def scores(self, texts: list[str]) -> np.ndarray:
        """Log-probability of each text and language, up to a constant of the text."""
        codes, starts = gram_codes(texts, bits=self.bits)
        total = np.tile(self.prior, (len(texts), 1))
        for code in codes:
            total += np.add.reduceat(self.weights[code], starts, axis=0, dtype=np.float64)
        return total


def identify(docs: DataFrame, model: LanguageModel, text: str = "text") -> DataFrame:
    """docs plus lang_pred and score (the posterior probability, 0 to 1).

    A null text, one without a letter (numerals such as a raised two are none), or a model that saw no language gives
    `und` and 0. Ties go to the label that sorts first. Columns of docs of those names are replaced. Very long texts are
    scored whole, in memory that follows the longest text; repeated rows are scored alike; an empty table gives no rows.
    """
    docs = docs.drop(*[c for c in ("lang_pred", "score") if c in docs.columns])
    shared = docs.sparkSession.sparkContext.broadcast((model.labels, model.weights, model.prior, model.bits))

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = LanguageModel(*shared.value)
        for batch, raw in slices(batches, text, 256 << 10):
            texts = [(t or b"").decode("utf-8", "replace") for t in raw]
            known = [i for i, t in enumerate(texts) if own.labels and has_letter(t)]
            pred, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
            if known:
                s = own.scores([texts[i] for i in known])
                best = s.argmax(axis=1)
                p = 1 / np.exp(s - s.max(axis=1, keepdims=True)).sum(axis=1)
                for i, b, q in zip(known, best.tolist(), p.tolist()):
                    pred[i], score[i] = own.labels[b], q
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(pred, pa.string()), pa.array(score)], [*batch.schema.names, "lang_pred", "score"])

    return docs.mapInArrow(predict, extended(docs, lang_pred="string", score="double"))


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).withColumn("held_out", held_out("doc_id", 4, 2))
    model = LanguageModel.fit(docs.filter("lang is not null and not held_out"))
    return identify(docs.select("doc_id", "held_out", "text"), model).drop("text")
