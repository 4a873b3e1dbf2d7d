"""Best-two-fit packing of documents into sequences of bounded length.

A bin starts with the longest open piece and takes the longest piece that fits until none does; then its smallest
piece is put back if two open pieces fit the wider gap more tightly. Bins are packed in groups of many thousand
pieces, dealt by a hash so that every group has the same mix of lengths; a group costs at most one loose bin.
"""

from __future__ import annotations

import math
import zlib
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storyweft.llm.common import documents, saved, slices
from storyweft.llm.tokens import default_tokenizer, encoder

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, row long"
GROUP = 400_000


def best_two_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """bin and offset of each piece. Lengths are 1 to capacity; pieces of equal length are taken in input order."""
    n = len(lengths)
    bins, offsets = np.zeros(n, np.int64), np.zeros(n, np.int64)
    order = np.argsort(lengths, kind="stable")[::-1]
    left: dict[int, list[int]] = defaultdict(list)
    for i in order.tolist():
        left[int(lengths[i])].append(i)
    sizes = sorted(left)  # lengths that still have open pieces

    def fit(gap: int) -> int:
        k = bisect_right(sizes, gap)
        return sizes[k - 1] if k else 0

    def take(length: int) -> int:
        own = left[length]
        i = own.pop()
        if not own:
            del sizes[bisect_right(sizes, length) - 1]
        return i

    def put(i: int, length: int) -> None:
        own = left[length]
        if not own:
            sizes.insert(bisect_right(sizes, length), length)
        own.append(i)

    def pair(gap: int, least: int) -> tuple[int, int]:
        """Two open lengths whose sum is the largest at most gap and above least."""
        best, found = least, (0, 0)
        i, j = 0, bisect_right(sizes, gap) - 1
        while i <= j:
            total = sizes[i] + sizes[j]
            if total > gap:
                j -= 1
                continue
            if total > best and (i < j or len(left[sizes[i]]) > 1):
                best, found = total, (sizes[i], sizes[j])
                if total == gap:
                    break
            i += 1
        return found

    bin_ = 0
    while sizes:
        length = sizes[-1]
        members, gap = [(length, take(length))], capacity - length
        while gap and (length := fit(gap)):
            members.append((length, take(length)))
            gap -= length
        if gap and sizes and len(members) > 1:
            small, i = members[-1]  # greedy filling takes pieces in descending order
            a, b = pair(gap + small, small)
            if a:
                members[-1:] = [(b, take(b)), (a, take(a))]
                put(i, small)
        at = 0
        for length, i in members:
            bins[i], offsets[i] = bin_, at
            at += length
        bin_ += 1
    return bins, offsets


def token_pieces(docs: DataFrame, capacity: int = 2048, tokenizer: str | None = None, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None) -> DataFrame:
    """Pieces of at most `capacity` tokens of each text's ids with end_id appended; only longer documents are cut.

    row tells pieces of different rows apart: row_col of docs (a unique long, for tables whose ids are null or repeat),
    else the id. Null texts count as empty (one end id). Repeated rows give repeated pieces; other columns are ignored;
    an empty table gives no pieces. Very long texts are encoded whole, in memory that follows the longest text.
    """
    tokenizer = tokenizer or default_tokenizer()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        end = np.array([end_id], enc.dtype).tobytes()
        for batch, texts in slices(batches, "text"):
            rows = []
            for id_, row, b in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), enc.encode(texts)):
                ids = np.frombuffer(b + end, enc.dtype).astype("<u4")
                for piece, start in enumerate(range(0, len(ids), capacity)):
                    part = ids[start : start + capacity]
                    rows.append((id_, piece, start, len(part), zlib.crc32(part.tobytes()), row))
            cols = list(zip(*rows))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), *[pa.int64()] * 4))], ["doc_id", "piece", "start", "length", "ids_crc32", "row"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.col(row_col or id_col).cast("long").alias("row")).mapInArrow(cut, PIECES)


def pack(pieces: DataFrame, capacity: int = 2048, group: int = GROUP) -> DataFrame:
    """Adds sequence_id (group * 2^32 + bin) and offset to rows as from token_pieces(). Every row gets a place of its own,
    repeated ones too."""
    pieces = saved(pieces, "pieces")
    groups = max(1, math.ceil(pieces.count() / group))
    schema = pieces.schema.simpleString()[7:-1].replace(":", " ")

    def fill(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = list(batches)
        if not rows:
            return
        own = pd.concat(rows, ignore_index=True).sort_values(["length", "doc_id", "row", "piece", "ids_crc32"], kind="stable", ignore_index=True)
        bins, offsets = best_two_fit(own["length"].to_numpy(np.int64), capacity)
        yield own.assign(sequence_id=(TaskContext.get().partitionId() << 32) + bins, offset=offsets)

    dealt = pieces.repartition(groups, F.xxhash64("doc_id", "row", "piece", "ids_crc32"))
    return dealt.mapInPandas(fill, f"{schema.replace(',', ', ')}, sequence_id long, offset long".replace("  ", " "))


def sequences(docs: DataFrame, packed: DataFrame, capacity: int = 2048, tokenizer: str | None = None, end_id: int = 0, row_col: str = "doc_id") -> DataFrame:
    """sequence_id and its ids (array<int>, at most capacity), put together from the documents and the packing plan.

    row_col tells docs' rows apart and must be what token_pieces() had; a value that repeats is refused, since its texts
    could not be told apart.
    """
    tokenizer = tokenizer or default_tokenizer()
    n, d = docs.agg(F.count("*"), F.countDistinct(row_col)).first()
    if n != d:
        raise ValueError(f"{row_col} is null or repeats: give pieces and documents a row_col of unique numbers")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        for batch, texts in slices(batches, "text"):
            for row, b in zip(batch.column(0).to_pylist(), enc.encode(texts)):
                ids = [*np.frombuffer(b, enc.dtype).tolist(), end_id]
                parts = [ids[i : i + capacity] for i in range(0, len(ids), capacity)]
                yield pa.RecordBatch.from_arrays([pa.array([row] * len(parts), pa.int64()), pa.array(range(len(parts)), pa.int32()), pa.array(parts, pa.list_(pa.int32()))], ["row", "piece", "ids"])

    own = docs.select(F.col(row_col).cast("long").alias("row"), "text").mapInArrow(encode, "row long, piece int, ids array<int>")
    parts = packed.join(own, ["row", "piece"]).groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
    return parts.select("sequence_id", F.flatten(F.col("parts.ids")).alias("ids"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(token_pieces(documents(spark, sf_dir)))
