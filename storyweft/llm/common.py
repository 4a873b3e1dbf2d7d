"""Shared helpers: text access through Arrow, word hashing, shared-folder tables."""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from storyweft.session import ship

#: Words are runs of anything but space and the controls 9 to 13; bytes.split() cuts there.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]"

_own_dirs: dict[str, str] = {}


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def work_dir(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share (spark.checkpoint.dir).

    Only a local session may go without that setting; it gets a temporary folder.
    """
    ship(spark)
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        app = spark.sparkContext.applicationId
        if app not in _own_dirs:
            _own_dirs[app] = tempfile.mkdtemp(prefix="storyweft-")
        base = _own_dirs[app]
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def saved(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = work_dir(spark, name)
    df.write.option("compression", codec).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.saved_at = path
    return out


def discard(spark: SparkSession, *what: DataFrame | str | None) -> None:
    """Delete paths, or the files of frames that saved() gave, once nothing will read them again."""
    for x in what:
        path = x if x is None or isinstance(x, str) else getattr(x, "saved_at", None)
        if path:
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


#: Rows of a table that may be broadcast whole; larger ones are joined by key.
BROADCAST_ROWS = 200_000


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """A saved table marked for broadcast if it has at most `rows` rows (counted); else as it is, for a join by key."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def row_keyed(docs: DataFrame, id_col: str = "doc_id", name: str = "__row") -> tuple[DataFrame, str]:
    """docs and the column that tells its rows apart: the id, or where ids are null or repeat a row number in the order
    of ids (nulls last), which is written down once so that it cannot change."""
    n, ids = docs.agg(F.count("*"), F.countDistinct(id_col)).first()
    if n == ids:
        return docs, id_col
    while name in docs.columns:
        name += "_"
    ordered = docs.orderBy(F.col(id_col).asc_nulls_last())
    return saved(ordered.withColumn(name, F.monotonically_increasing_id()), "keyed-documents"), name


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else os.path.abspath(uri))


def put_file(uri: str, parts: Iterable[bytes]) -> None:
    """Write a file whole: a retried or speculative task replaces it with the same bytes."""
    fs, path = filesystem(uri)
    fs.create_dir(os.path.dirname(path), recursive=True)
    tmp = f"{path}.{uuid.uuid4().hex[:8]}.tmp"
    with fs.open_output_stream(tmp) as out:
        for part in parts:
            out.write(part)
    fs.move(tmp, path)


def map_file(uri: str, dtype) -> np.ndarray:
    """A file's numbers: memory-mapped where the folder is mounted, else read through its store."""
    fs, path = filesystem(uri)
    if isinstance(fs, pafs.LocalFileSystem):
        if os.path.getsize(path) == 0:
            return np.empty(0, dtype)
        return np.asarray(np.memmap(path, dtype, "r"))
    with fs.open_input_file(path) as f:
        return np.frombuffer(f.read_buffer(), dtype)


def as_bytes(column: pa.Array) -> list[bytes | None]:
    """UTF-8 of each value, None for null."""
    return column.cast(pa.binary()).to_pylist()


def slices(batches: Iterable[pa.RecordBatch], column: str, limit: int = 1 << 20, rows: int = 512) -> Iterator[tuple[pa.RecordBatch, list[bytes | None]]]:
    """Cut batches into runs of about `limit` bytes of text, so that memory follows the longest text only."""
    for batch in batches:
        texts = as_bytes(batch.column(batch.schema.get_field_index(column)))
        start = size = 0
        for i, t in enumerate(texts):
            n = len(t) if t is not None else 0
            if i > start and (size + n > limit or i - start >= rows):
                yield batch.slice(start, i - start), texts[start:i]
                start, size = i, 0
            size += n
        if start < len(texts):
            yield batch.slice(start), texts[start:]
        del texts
        trim()


def trim() -> None:
    """Give freed memory back to the system: workers live long, and an executor's memory is shared."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


# Word hashes ---------------------------------------------------------------------------------------------------------

_rng = np.random.default_rng(20240501)
#: A random number for each byte; A-Z have those of a-z, blanks are no part of words.
BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BYTE[ord("A") : ord("Z") + 1] = BYTE[ord("a") : ord("z") + 1]
BLANK = (32, 9, 10, 11, 12, 13)
INNER = bytes(b not in BLANK for b in range(256))  # 1 for the bytes of words
STEP = int(_rng.integers(1 << 62, 1 << 63)) | 1
BACK = pow(STEP, -1, 1 << 64)
PIECE = 1 << 20  # bytes hashed in one go; a longer word makes a longer piece


def _powers(base: int, n: int) -> np.ndarray:
    known = _tables.get(base)
    if known is None or len(known) < n:
        steps = np.full(max(n, PIECE + 1), base, np.uint64)
        steps[0] = 1
        known = _tables[base] = np.cumprod(steps, dtype=np.uint64)
    return known[:n]


_tables: dict[int, np.ndarray] = {}


def _pieces(buffer: bytes) -> Iterator[tuple[int, int]]:
    """The buffer in runs of about PIECE bytes that end at a blank or with it."""
    start = 0
    while start < len(buffer):
        stop = min(start + PIECE, len(buffer))
        while stop < len(buffer) and buffer[stop] not in BLANK:
            stop += 1
        yield start, stop
        start = stop


def hash_words(buffer: bytes) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hash and start of each word of UTF-8 bytes; A-Z count as a-z.

    A word's hash is the sum of its bytes' numbers times powers of STEP, modulo 2^64, scrambled. Sums come from running
    sums over all bytes, and a power of STEP's inverse moves each word to its own beginning, so no word is handled alone.
    """
    hashes, places = [], []
    for start, stop in _pieces(buffer):
        b = np.frombuffer(buffer, np.uint8, stop - start, start)
        inner = np.empty(len(b) + 2, bool)
        inner[0] = inner[-1] = False
        inner[1:-1] = np.frombuffer(buffer[start:stop].translate(INNER), bool)
        edges = np.flatnonzero(inner[1:] != inner[:-1])
        first, last = edges[::2], edges[1::2]
        sums = np.empty(len(b) + 1, np.uint64)
        sums[0] = 0
        np.cumsum(BYTE[b] * _powers(STEP, len(b)), out=sums[1:])
        hashes.append(mix64((sums[last] - sums[first]) * _powers(BACK, len(b) + 1)[first]))
        places.append(first + start)
    return (np.concatenate(hashes), np.concatenate(places)) if hashes else (np.empty(0, np.uint64), np.empty(0, np.int64))


def words_of(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts, one text after the other, and where each text's words end. Null has none."""
    hashes, places = hash_words(b"\n".join(t or b"" for t in texts))
    ends = np.cumsum([len(t or b"") + 1 for t in texts])
    return hashes, np.searchsorted(places, ends)


_cache: dict[tuple, object] = {}


def cached(key: tuple, make):
    """One object per Python worker, kept between tasks. Making another one drops it, so that the caches of several
    operators never add up in a worker that serves them all."""
    if key not in _cache:
        _cache.clear()
        _cache[key] = make()
    return _cache[key]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit numbers (the splitmix64 finaliser)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def held_out(column, parts: int, remainder: int):
    """crc32 of the id as text, by remainder; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % parts == remainder, F.lit(False))


def extended(df: DataFrame, **kinds: str) -> T.StructType:
    """df's schema and further fields; df.schema itself is shared and must not change."""
    return T.StructType([*df.schema.fields, *(T.StructField(k, T._parse_datatype_string(v)) for k, v in kinds.items())])
