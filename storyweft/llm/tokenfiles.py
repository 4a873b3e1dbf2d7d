"""Token-ID output: flat unsigned integers plus 64-bit document offsets, read back memory-mapped.

A data set is a folder of segments in ascending id order. Segment k has `k.bin` (token ids, little-endian uint16 where
the vocabulary fits, else uint32), `k.off` (uint64, n + 1 positions in tokens within the segment) and `k.ids` (int64
document ids). A segment's base, the tokens in all segments before it, is a prefix sum over the manifest's counts, so
document i's global position is base + off[i]. The manifest, a row per segment, is a table; its running sums are Spark's.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from storyweft.llm.common import documents, map_file, put_file, saved, slices, work_dir
from storyweft.llm.tokens import default_tokenizer, encoder

#: Text bytes a segment aims at; a longer single document still makes one segment.
SEGMENT_BYTES = 64 << 20
#: Segments that a task reads back.
SEGMENTS = 8
NO_ID = -(1 << 63)


def write_token_files(docs: DataFrame, out: str, tokenizer: str | None = None, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", segment_bytes: int = SEGMENT_BYTES) -> DataFrame:
    """Encode every text, append end_id, write segments below `out`; returns the manifest with bases.

    Nulls count as empty texts (one end id). Rows come in ascending id order, null ids first (kept as the least
    int64); rows of equal id stay together, ordered by text. Other columns are ignored. An empty table has no segment.
    Very long texts are encoded whole, in memory that follows the longest text.
    """
    tokenizer = tokenizer or default_tokenizer()
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(math.ceil(total / segment_bytes), spark.sparkContext.defaultParallelism)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part = encoder(tokenizer), TaskContext.get().partitionId()
        name = f"{part:06d}"
        ids, counts = [], []
        end = np.array([end_id], enc.dtype).tobytes()

        def stream() -> Iterator[bytes]:
            for batch, texts in slices(batches, "text"):
                ids.extend(NO_ID if x is None else x for x in batch.column(0).to_pylist())
                for b in enc.encode(texts):
                    counts.append(len(b) // enc.dtype.itemsize + 1)
                    yield b + end

        put_file(f"{out}/{name}.bin", stream())
        if not ids:
            return
        off = np.zeros(len(ids) + 1, "<u8")
        np.cumsum(counts, out=off[1:])
        put_file(f"{out}/{name}.off", [off.tobytes()])
        put_file(f"{out}/{name}.ids", [np.array(ids, "<i8").tobytes()])
        yield pa.RecordBatch.from_pydict({"segment": [name], "first_id": [ids[0]], "n_docs": [len(ids)], "n_ids": [int(off[-1])], "width": [enc.dtype.itemsize]})

    made = rows.repartitionByRange(n, F.col("id").asc_nulls_first()).sortWithinPartitions(F.col("id").asc_nulls_first(), "text").mapInArrow(write, "segment string, first_id long, n_docs long, n_ids long, width long")
    before = Window.orderBy("first_id", "segment").rowsBetween(Window.unboundedPreceding, -1)  # a row for each SEGMENT_BYTES of text
    return saved(saved(made, "token-segments").withColumn("base", F.coalesce(F.sum("n_ids").over(before), F.lit(0).cast("long"))), "token-manifest")


def read_token_files(manifest: DataFrame, out: str, rows: int = 4096) -> DataFrame:
    """Per document, from the files: id, start (global), ids (binary, uint32 little-endian) and their crc32."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in batch.to_pylist():
                ids = map_file(f"{out}/{s['segment']}.ids", "<i8")
                off = map_file(f"{out}/{s['segment']}.off", "<u8").astype(np.int64)
                flat = map_file(f"{out}/{s['segment']}.bin", f"<u{s['width']}")
                for i in range(0, len(ids), rows):
                    j = min(i + rows, len(ids))
                    sums = [zlib.crc32(flat[off[k] : off[k + 1]].astype("<u4").tobytes()) for k in range(i, j)]
                    own = ids[i:j]
                    yield pa.RecordBatch.from_arrays([pa.array(own, mask=own == NO_ID), pa.array(off[i:j] + s["base"]), pa.array(np.diff(off[i : j + 1])), pa.array(sums, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    tasks = max(manifest.sparkSession.sparkContext.defaultParallelism, math.ceil(manifest.count() / SEGMENTS))
    return manifest.repartition(tasks).mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_ids(manifest: DataFrame, out: str, doc_id: int) -> np.ndarray:
    """One document's ids by its offsets: the segment is found in the manifest, the ids are mapped, not read whole."""
    near = manifest.filter(F.col("first_id") <= doc_id).orderBy(F.desc("first_id")).first()
    if near is None:
        return np.empty(0, "<u4")
    ids = map_file(f"{out}/{near.segment}.ids", "<i8")
    i = int(np.searchsorted(ids, doc_id))
    if i == len(ids) or ids[i] != doc_id:
        return np.empty(0, "<u4")
    off = map_file(f"{out}/{near.segment}.off", "<u8")
    return np.array(map_file(f"{out}/{near.segment}.bin", f"<u{near.width}")[int(off[i]) : int(off[i + 1])])


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = work_dir(spark, "token-files")
    return read_token_files(write_token_files(documents(spark, sf_dir), out), out)
