"""Hard-negative mining: per anchor a full sort of integer scores, binary search of each positive's upper limit.

Anchors are written to the shared folder in blocks, which tasks map where their rows lie; neither side is shuffled to the
other or broadcast. Two passes over the rows, in chunks: the first finds each anchor's positives, its best rows of the same
label; the second sorts an anchor's scores of the rows of other labels by score and id, finds by binary search where each
positive's upper limit begins, and reads on to its lower limit. Chunks give at most what is wanted of each anchor; that is
cut by groups of tasks, then by anchor. The work is anchors times rows, by definition.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from storyweft.llm.common import filesystem, saved, work_dir
from storyweft.llm.eliasfano import map_arrays, put_arrays
from storyweft.llm.topk import fits_doubles, integral, matrix, products

POSITIVES, NEGATIVES = 5, 10
#: Limits of a negative's score, in percent of its positive's.
LOWEST, HIGHEST = 30, 90
#: Anchors of a block, and of one product.
BLOCK, STEP = 1024, 32
CHUNK_BYTES = 48 << 20


def scores(a: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Inner products of all rows of a with all of v as 64-bit integers; those beyond are cut to the nearest."""
    if fits_doubles(a, v):
        return (a @ v.T).astype(np.int64)
    out = np.empty((len(a), len(v)), np.int64)
    for i, row in enumerate(a):
        for at in range(0, len(v), 4096):
            own = v[at : at + 4096]
            out[i, at : at + 4096] = products(np.broadcast_to(row, own.shape), own)
    return out


def limits(positive: np.ndarray, lowest: int = LOWEST, highest: int = HIGHEST) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest whole scores s with lowest * positive <= 100 * s <= highest * positive; by quotient and rest, so that
    nothing overflows."""
    q, r = positive // 100, positive % 100
    return q * lowest - (-r * lowest) // 100, q * highest + r * highest // 100


def first_of(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k greatest scores, the greatest first, ties by id."""
    near = np.arange(len(score))
    if len(score) > k:
        near = np.flatnonzero(score >= np.partition(score, len(score) - k)[len(score) - k])
    return near[np.lexsort((ids[near], -score[near]))][:k]


def _chunks(batches: Iterator[pa.RecordBatch], dim: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Ids, labels and vectors of about CHUNK_BYTES."""
    rows, parts, n = max(1, CHUNK_BYTES // (8 * dim)), [], 0
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            own = batch.slice(at, rows)
            parts.append((own.column(0).to_numpy(), own.column(1).to_numpy(), matrix(own.column(2), dim)))
            n += own.num_rows
            if n >= rows:
                yield tuple(map(np.concatenate, zip(*parts)))
                parts, n = [], 0
    if n:
        yield tuple(map(np.concatenate, zip(*parts)))


def _blocks(anchors: DataFrame, blocks: int, dim: int) -> str:
    """Anchors (vec_id, label, v, and p, a struct array of positives nth, id, score) as files 0 to blocks - 1 of a folder. An
    anchor's block follows from its id, and a block is sorted, so that a repeated task writes the same file."""
    path = work_dir(anchors.sparkSession, "anchors")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, labels, v, counts, nth, pid, ps = [], [], [np.empty((0, dim))], [], [], [], []
        for b in batches:
            ids += b.column(0).to_pylist()
            labels += b.column(1).to_pylist()
            v.append(matrix(b.column(2), dim))
            for own in b.column(3).to_pylist():
                counts.append(len(own))
                nth += [x["nth"] for x in own]
                pid += [x["id"] for x in own]
                ps += [x["score"] for x in own]
        whole = lambda x: np.array(x, np.int64)
        put_arrays(f"{path}/{TaskContext.get().partitionId()}", {"ids": whole(ids), "labels": whole(labels), "v": np.concatenate(v).ravel(), "ends": np.cumsum(whole([0, *counts])), "nth": whole(nth), "pid": whole(pid), "ps": whole(ps)})
        yield pa.RecordBatch.from_arrays([pa.array([len(ids)], pa.int64())], ["n"])

    dealt = anchors.select("vec_id", "label", "v", "p").repartition(blocks, "vec_id").sortWithinPartitions("vec_id")
    dealt.mapInArrow(write, "n long").agg(F.sum("n")).first()
    return path


def _block(path: str, b: int) -> dict[str, np.ndarray] | None:
    """A block's arrays; None where no anchor fell in it, of which no task writes a file."""
    fs, at = filesystem(f"{path}/{b}")
    return map_arrays(f"{path}/{b}") if fs.get_file_info(at).type == pafs.FileType.File else None


def _cut(found: DataFrame, key: list[str], id_col: str, k: int) -> DataFrame:
    """The k first of each key by score and id, by groups of tasks first."""
    rank = lambda *by: F.row_number().over(Window.partitionBy(*key, *by).orderBy(F.desc("score"), id_col))
    groups = math.isqrt(max(found.sparkSession.sparkContext.defaultParallelism, 256)) + 1
    found = found.withColumn("tasks", F.pmod(F.spark_partition_id(), F.lit(groups)))
    found = found.withColumn("rank", rank("tasks")).filter(F.col("rank") <= k)
    return found.withColumn("rank", rank()).filter(F.col("rank") <= k).drop("tasks")


def hard_negatives(rows: DataFrame, anchors: DataFrame, positives: int = POSITIVES, negatives: int = NEGATIVES, lowest: int = LOWEST, highest: int = HIGHEST) -> DataFrame:
    """anchor_id, positive_id, rank (from 1), negative_id, positive_score, negative_score.

    rows and anchors: vec_id, label (whole number), v as from integral(keep=("label",)); other columns aside. Positives: an
    anchor's best rows of its label, negatives: for each positive the best rows of other labels whose score is from lowest to
    highest percent of the positive's; higher scores first, ties by smaller id, all if there are fewer. Rows with the
    anchor's id are neither. Of anchor rows that share an id the one of least label and vector stands; repeated rows are
    rows of their own. Shorter vectors count as padded with zeros. Empty tables, or empty vectors only, give no rows."""
    spark = rows.sparkSession
    dim = rows.agg(F.max(F.size("v"))).first()[0]
    anchors = anchors.groupBy("vec_id").agg(F.min(F.struct(F.col("label").cast("long").alias("label"), "v")).alias("a")).select("vec_id", "a.label", "a.v")
    n = anchors.count() if dim else 0
    if not n:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    rows, blocks = rows.select("vec_id", F.col("label").cast("long").alias("label"), "v"), math.ceil(n / BLOCK)
    path = _blocks(anchors.withColumn("p", F.array().cast("array<struct<nth: long, id: long, score: long>>")), blocks, dim)

    def alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, labels, v in _chunks(batches, dim):
            own = {x: np.flatnonzero(labels == x) for x in np.unique(labels).tolist()}
            for b in range(blocks):
                file = _block(path, b)
                if file is None:
                    continue
                a_ids, a_labels, a_v = file["ids"], file["labels"], file["v"].reshape(-1, dim)
                out = []
                for label in np.unique(a_labels).tolist():
                    near = own.get(label)
                    for part in np.array_split(np.flatnonzero(a_labels == label), max(1, (a_labels == label).sum() // STEP)) if near is not None else ():
                        for i, s in zip(part.tolist(), scores(a_v[part], v[near])):
                            other = near[ids[near] != a_ids[i]]
                            s = s[ids[near] != a_ids[i]]
                            best = first_of(s, ids[other], positives)
                            out += zip([int(a_ids[i])] * len(best), ids[other[best]].tolist(), s[best].tolist())
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], ["anchor_id", "id", "score"])

    found = saved(_cut(rows.mapInArrow(alike, "anchor_id long, id long, score long"), ["anchor_id"], "id", positives), "positives")
    known = found.groupBy("anchor_id").agg(F.array_sort(F.collect_list(F.struct(F.col("rank").cast("long").alias("nth"), "id", "score"))).alias("p"))
    with_positives = _blocks(anchors.join(known, anchors["vec_id"] == known["anchor_id"]), blocks, dim)

    def unlike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, labels, v in _chunks(batches, dim):
            order = np.argsort(ids, kind="stable")
            ids, labels, v = ids[order], labels[order], v[order]
            for b in range(blocks):
                file = _block(with_positives, b)
                if file is None:
                    continue
                a_ids, a_labels, a_v, ends = file["ids"], file["labels"], file["v"].reshape(-1, dim), file["ends"]
                low, high = limits(np.asarray(file["ps"]), lowest, highest)
                out = []
                for at in range(0, len(a_ids), STEP):
                    for i, s in enumerate(scores(a_v[at : at + STEP], v), at):
                        own = slice(ends[i], ends[i + 1])
                        other = np.flatnonzero((labels != a_labels[i]) & (s >= low[own].min()) & (ids != a_ids[i]))  # entries below all lower limits are never read
                        other = other[np.argsort(-s[other], kind="stable")]  # ids ascend, so ties do
                        falling = -s[other]
                        for j in range(own.start, own.stop):
                            begin = np.searchsorted(falling, -high[j], "left")
                            stop = min(begin + negatives, np.searchsorted(falling, -low[j], "right"))
                            if stop > begin:
                                picked = other[begin:stop]
                                out.append((np.full(len(picked), a_ids[i]), np.full(len(picked), file["nth"][j]), np.full(len(picked), file["pid"][j]), np.full(len(picked), file["ps"][j]), ids[picked], s[picked]))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], ["anchor_id", "nth", "positive_id", "positive_score", "negative_id", "score"])

    met = rows.mapInArrow(unlike, "anchor_id long, nth long, positive_id long, positive_score long, negative_id long, score long")
    return _cut(met, ["anchor_id", "nth"], "negative_id", negatives).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", F.col("score").alias("negative_score"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").filter("label IS NOT NULL")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = saved(integral(vectors.withColumn("label", label), scale=256.0, keep=("label",)), "negatives-vectors")
    return hard_negatives(rows, rows.filter("vec_id % 100 = 0"))


OP13_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND list_count(embedding) = len(embedding) AND list_bool_and(list_transform(embedding, lambda x: isfinite(x)))
), s AS (
  SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS alike, list_inner_product(a.v, c.v)::BIGINT AS score
  FROM v a JOIN v c ON c.vec_id <> a.vec_id WHERE a.vec_id % 100 = 0
), p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE alike QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT alike AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score QUALIFY rank <= 10
"""
