"""Exact top-k inner products: vectors by descending length, SVD-rotated partial sums, Cauchy-Schwarz pruning.

Components become integers, and scores are exact: products are taken in doubles where these are exact, in 64-bit
integers where the two lengths show that the score fits, else in integers of any size. A score beyond 64 bits is the
nearest 64-bit number; ties so made go to the smaller id. The vectors of greatest length, SEEDS of them, are scored against every
query first and give each query a threshold. All vectors are then taken by descending length in chunks, in two waves if
there are many: what the longest eighth gives raises the thresholds for the rest. For a block of
queries and a chunk, |query| * longest of the chunk bounds every score; where that reaches the threshold, the sum over
the HEAD leading directions of the rotation plus the product of the residual lengths bounds each pair, and only pairs
whose bound reaches the threshold are scored in full. A pair is dropped only if it cannot be among the k best.

Queries are written to the shared folder in blocks and mapped by the tasks that hold the candidates, so neither side is
shuffled to the other or broadcast; a task holds one chunk and one block at a time, and does not open blocks of which no
query can reach its bar with the chunk's longest vector. A query's answers are cut to k in two steps, by groups of tasks
first, so that a query with many ties loads no task.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from storyweft.llm.common import saved, work_dir
from storyweft.llm.eliasfano import map_arrays, put_arrays

K = 20
SEEDS = 2048
CHUNK = 16_384
QUERIES = 1024
HEAD = 16
WAVE = 8 * CHUNK  # vectors from which there are two waves


def integral(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", scale: float = 64.0, keep: tuple[str, ...] = ()) -> DataFrame:
    """vec_id, v (array of whole doubles), the columns to keep, len2: rows whose id and vector are non-null, with finite
    components only, also after they are scaled. Doubles of 2^53 and more are whole as they are. Other columns go."""
    x = F.col(vec_col)
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double") * F.lit(scale)) < float("inf"))
    whole = lambda y: F.when(F.abs(y) < float(1 << 53), F.floor(y).cast("double")).otherwise(y)
    good = F.col(id_col).isNotNull() & x.isNotNull() & F.forall(x, finite)
    rows = vectors.filter(F.coalesce(good, F.lit(False))).select(F.col(id_col).cast("long").alias("vec_id"), F.transform(x, lambda c: whole(c.cast("double") * F.lit(scale))).alias("v"), *keep)
    return rows.withColumn("len2", F.aggregate("v", F.lit(0.0), lambda s, c: s + c * c))


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Rows padded with zeros to dim."""
    n = len(column)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if len(flat) == n * dim:
        return flat.reshape(n, dim).astype(np.float64)
    out = np.zeros((n, dim))
    sizes = np.diff(column.offsets.to_numpy())
    at = 0
    for i, m in enumerate(sizes.tolist()):
        out[i, :m] = flat[at : at + m]
        at += m
    return out


def rotation(rows: DataFrame, dim: int) -> np.ndarray:
    """Columns: directions by descending share of all vectors' squares (the right singular vectors). dim^2 sums."""

    def gram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dim, dim))
        for batch in batches:
            m = matrix(batch.column(0), dim)
            total += m.T @ m
        yield pa.RecordBatch.from_arrays([pa.array(range(dim * dim), pa.int32()), pa.array(total.ravel())], ["at", "s"])

    sums = rows.select("v").mapInArrow(gram, "at int, s double").groupBy("at").agg(F.sum("s").alias("s")).toArrow()
    g = np.zeros(dim * dim)
    g[sums["at"].to_numpy()] = sums["s"].to_numpy()
    if not np.isfinite(g).all():  # components whose squares are no doubles: any rotation serves
        return np.eye(dim)
    return np.linalg.eigh(g.reshape(dim, dim))[1][:, ::-1]


def fits_doubles(x: np.ndarray, y: np.ndarray) -> bool:
    """Whether all inner products of rows of x and y, and their partial sums, are exact in doubles."""
    return float(np.abs(x).max(initial=0)) * float(np.abs(y).max(initial=0)) * max(1, x.shape[1]) < 2**53


def products(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Inner products of the rows of x and y, pair by pair, as 64-bit integers; those beyond are cut to the nearest."""
    if fits_doubles(x, y):
        return np.einsum("ij,ij->i", x, y).astype(np.int64)
    with np.errstate(over="ignore", invalid="ignore"):
        bound = np.sqrt((x * x).sum(axis=1)) * np.sqrt((y * y).sum(axis=1))
    out = np.zeros(len(x), np.int64)
    fit = bound < 2**62  # whole numbers, so neither has a component beyond 2^62 unless the other vector is 0
    own = np.flatnonzero(fit & (bound > 0))
    out[own] = np.einsum("ij,ij->i", x[own].astype(np.int64), y[own].astype(np.int64))  # may wrap on the way, not at the end
    top = (1 << 63) - 1
    for i in np.flatnonzero(~fit).tolist():
        s = sum(int(a) * int(b) for a, b in zip(x[i].tolist(), y[i].tolist()))
        out[i] = max(-top, min(top, s))
    return out


class Side:
    """Vectors with their rotated heads and residual lengths."""

    def __init__(self, v: np.ndarray, rot: np.ndarray):
        self.v = v
        with np.errstate(over="ignore", invalid="ignore"):
            self.head = v @ rot[:, :HEAD]
            self.length = np.sqrt((v * v).sum(axis=1))
            self.rest = np.sqrt(np.maximum(0, self.length**2 - (self.head * self.head).sum(axis=1)))


def best(q: Side, q_ids: np.ndarray, c: Side, c_ids: np.ndarray, k: int, bar: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, candidate id, score) of each query's k best in c that reach bar; ties to the smaller id; never itself."""
    none = np.empty(0, np.int64)
    if not len(q_ids) or not len(c_ids):
        return none, none, none
    with np.errstate(over="ignore", invalid="ignore"):  # bounds that are no numbers rule nothing out
        slack = 1e-9 * (1 + q.length.max() * c.length.max())
        live = np.flatnonzero(~(q.length * c.length.max() + slack < bar))
        if not len(live):
            return none, none, none
        bound = q.head[live] @ c.head.T + q.rest[live, None] * c.rest[None, :]
        a, b = np.nonzero(~(bound + slack < bar[live, None]))
    if len(a) * 4 < bound.size or not fits_doubles(q.v, c.v):
        s = np.concatenate([none, *(products(q.v[live[a[i : i + 65536]]], c.v[b[i : i + 65536]]) for i in range(0, len(a), 65536))])
    else:
        s = (q.v[live] @ c.v.T)[a, b].astype(np.int64)
    keep = (s >= bar[live[a]]) & (q_ids[live[a]] != c_ids[b])
    a, b, s = live[a[keep]], b[keep], s[keep]
    if len(a) > 4 * k * len(live):  # far more than is wanted: a cut by each query's k-th score first
        order = np.argsort(a, kind="stable")
        parts = np.split(order, np.flatnonzero(np.diff(a[order])) + 1)
        order = np.concatenate([p if len(p) <= k else p[s[p] >= np.partition(s[p], len(p) - k)[len(p) - k]] for p in parts])
        a, b, s = a[order], b[order], s[order]
    order = np.lexsort((c_ids[b], -s, a))
    a, b, s = a[order], b[order], s[order]
    first = np.concatenate([[True], a[1:] != a[:-1]]) if len(a) else np.empty(0, bool)
    place = np.arange(len(a)) - np.maximum.accumulate(np.where(first, np.arange(len(a)), 0)) if len(a) else none
    top = place < k
    return a[top], c_ids[b[top]], s[top]


def top_k(rows: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query's k best rows by inner product, all if fewer.

    rows and queries: vec_id, v, len2 as from integral(), other columns aside. Shorter vectors count as padded with zeros;
    vectors of any length are read whole. A row with the query's id is never its answer. Of query rows that share an id the
    one of the least vector (component by component, a shorter one first) asks, so that the answers do not depend on where
    rows lie; repeated rows are candidates of their own. An empty table, or one of empty vectors, gives no rows.
    """
    spark = rows.sparkSession
    dim, n = rows.agg(F.max(F.size("v")), F.count("*")).first()
    if not n or not dim:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    seeds = rows.orderBy(F.desc("len2"), "vec_id").limit(SEEDS).select("vec_id", "v").toArrow().combine_chunks()  # SEEDS rows
    shared = spark.sparkContext.broadcast((rotation(rows, dim), np.array(seeds["vec_id"].to_pylist(), np.int64), matrix(seeds["v"].combine_chunks() if isinstance(seeds["v"], pa.ChunkedArray) else seeds["v"], dim)))
    wanted = queries.groupBy("vec_id").agg(F.min("v").alias("v"))
    rank = lambda *by: F.row_number().over(Window.partitionBy("query_id", *by).orderBy(F.desc("score"), "vec_id"))

    def cut(found: DataFrame) -> DataFrame:
        """Each query's k best, by groups of tasks first."""
        found = found.withColumn("rank", rank("tasks")).filter(F.col("rank") <= k)
        return found.withColumn("rank", rank()).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

    waves, found = _waves(rows, n), None
    for i, wave in enumerate(waves):
        bars = None if found is None else found.filter(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").cast("double").alias("bar"))
        names, path = _blocks(wanted, bars, shared, dim, k)
        new = _search(wave, names, path, shared, dim, k)
        if found is not None:
            new = new.unionByName(found.select("query_id", "vec_id", "score", F.lit(-1).alias("tasks")))
        found = cut(new) if i == len(waves) - 1 else saved(cut(new), "topk-found")
    return found


def _waves(rows: DataFrame, n: int) -> list[DataFrame]:
    if n < WAVE:
        return [rows]
    edge = rows.approxQuantile("len2", [0.875], 0.01)[0]
    rest = rows.filter(F.col("len2") < edge)
    return [rows] if rest.isEmpty() else [rows.filter(F.col("len2") >= edge), rest]


def _blocks(wanted: DataFrame, bars: DataFrame | None, shared, dim: int, k: int) -> tuple[list[tuple[str, float]], str]:
    """Query blocks as files: each file's name and the length that a vector needs to matter to any of its queries. bars:
    the k-th best score so far of the queries that have k; without them the seeds set the bars."""
    path, first = work_dir(wanted.sparkSession, "topk-queries"), bars is None
    known = wanted.withColumn("bar", F.lit(None).cast("double")) if first else wanted.join(bars, "vec_id", "left").select("vec_id", "v", "bar")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rot, seed_ids, seed_v = shared.value
        seed, part = Side(seed_v, rot), TaskContext.get().partitionId()
        for i, (ids, v, given) in enumerate(_chunks(batches, dim, QUERIES)):
            bar = np.where(np.isnan(given), -np.inf, given)
            if first:
                q, _, s = best(Side(v, rot), ids, seed, seed_ids, k, bar)
                full = np.bincount(q, minlength=len(ids)) == k
                least = np.full(len(ids), np.inf)
                np.minimum.at(least, q, s)
                bar[full] = least[full]
            name = f"{part:06d}-{i:06d}"
            put_arrays(f"{path}/{name}", {"ids": ids, "v": v.ravel(), "bar": bar})
            with np.errstate(over="ignore", divide="ignore", invalid="ignore"):
                reach = np.nan_to_num(bar / np.sqrt((v * v).sum(axis=1)), nan=-np.inf).min()  # length that a candidate needs
            yield pa.RecordBatch.from_pydict({"name": [name], "reach": [float(reach)]})

    made = saved(known.mapInArrow(write, "name string, reach double"), "topk-names")
    return [(r.name, r.reach) for r in made.collect()], path  # a row a block of queries


def _search(rows: DataFrame, names: list[tuple[str, float]], path: str, shared, dim: int, k: int) -> DataFrame:
    """query_id, vec_id, score, tasks (a group of tasks): what the chunks of rows give for the query blocks."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rot = shared.value[0]
        for ids, v, _ in _chunks(batches, dim, CHUNK):
            c = Side(v, rot)
            for name, reach in names:
                if c.length.max() * (1 + 1e-9) + 1e-9 < reach:
                    continue
                file = map_arrays(f"{path}/{name}")
                q_ids, q_v, bar = file["ids"], file["v"].reshape(-1, dim), file["bar"]
                for i in range(0, len(q_ids), 128):
                    own = slice(i, i + 128)
                    q, vec, s = best(Side(q_v[own], rot), q_ids[own], c, ids, k, bar[own])
                    if len(q):
                        yield pa.RecordBatch.from_arrays([pa.array(q_ids[own][q]), pa.array(vec), pa.array(s)], ["query_id", "vec_id", "score"])

    parts = max(rows.sparkSession.sparkContext.defaultParallelism, math.ceil(rows.count() / CHUNK))
    ranged = rows.repartitionByRange(parts, F.desc("len2"), "vec_id").sortWithinPartitions(F.desc("len2"), "vec_id")
    found = ranged.select("vec_id", "v").mapInArrow(search, "query_id long, vec_id long, score long")
    return found.withColumn("tasks", F.pmod(F.spark_partition_id(), F.lit(math.isqrt(parts) + 1)))


def _chunks(batches: Iterator[pa.RecordBatch], dim: int, size: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Ids, vectors and the third column, if there is one, in runs of about size rows."""
    parts, n = [], 0
    for batch in batches:
        for i in range(0, batch.num_rows, size):
            own = batch.slice(i, size)
            third = own.column(2).to_numpy(zero_copy_only=False) if own.num_columns > 2 else np.empty(0)
            parts.append((own.column(0).to_numpy(), matrix(own.column(1), dim), third.astype(np.float64)))
            n += own.num_rows
            if n >= size:
                yield tuple(map(np.concatenate, zip(*parts)))
                parts, n = [], 0
    if n:
        yield tuple(map(np.concatenate, zip(*parts)))


def op6_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = saved(integral(spark.read.parquet(f"{sf_dir}/embeddings.parquet")), "topk-vectors")
    return top_k(rows, rows.filter("vec_id % 20 = 0"))


OP6_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND list_count(embedding) = len(embedding) AND list_bool_and(list_transform(embedding, lambda x: isfinite(x)))
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
  FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 20 = 0
)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score
FROM s QUALIFY rank <= 20
"""
