"""Line deduplication that can be undone: sharded cuckoo filters backed by exact reference counts.

Keys are dealt to shards by their hash; the number of shards follows the number of postings, so that a shard stays small.
Three tables hold the state, each cut by shard:
  postings  key, doc_id: a row for each document and distinct line key. Written in ranges of (shard, key, doc_id), so a
            key that every document holds spreads over files and tasks;
  counts    key, holders, first_doc: the exact number of documents that hold the key, and the least of them;
  filters   a cuckoo filter of the keys with two holders or more, two bytes each.
A shard's postings are probed against that shard's filter alone, wherever they lie: no task holds the filters of others.
What a filter lets through meets the exact counts.

Inserting documents adds postings, adds up counts, and puts keys that reach two holders into the filters; deleting them
takes all of it back, keys that fall to one holder leave their filter, and lines dropped on their account come back. Only
shards that the documents' lines fall into are read and written; a manifest says where each shard's parts lie.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storyweft.llm.common import discard, documents, extended, map_file, mix64, put_file, saved, slices, work_dir

MIN_CHARS = 10
BLANK = b" \t\n\x0b\x0c\r"
#: Postings that a shard aims at.
SHARD_POSTINGS = 250_000


def line_key(line: bytes, min_chars: int = MIN_CHARS) -> bytes | None:
    """A line's key, None if it is shorter than min_chars code points."""
    key = line.strip(BLANK)
    if len(key) < min_chars or (len(key) < 4 * min_chars and len(key.decode("utf-8", "replace")) < min_chars):
        return None
    return key.lower()  # of bytes: A-Z only


class CuckooFilter:
    """Four 16-bit fingerprints a bucket, two buckets a key; a key's second bucket follows from the first and the print."""

    SLOTS, KICKS = 4, 400

    def __init__(self, table: np.ndarray):
        self.table = table

    @classmethod
    def sized(cls, keys: int) -> CuckooFilter:
        buckets = 1 << max(1, int(np.ceil(np.log2(max(1, keys) / (cls.SLOTS * 0.85)))))
        return cls(np.zeros((buckets, cls.SLOTS), np.uint16))

    @classmethod
    def of(cls, keys: np.ndarray) -> CuckooFilter:
        """keys: distinct 64-bit numbers. The table is doubled until all fit."""
        f = cls.sized(len(keys))
        while not f.insert(keys):
            f = cls(np.zeros((2 * len(f.table), cls.SLOTS), np.uint16))
        return f

    def places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        h = mix64(keys)
        mask = np.uint64(len(self.table) - 1)
        prints = ((h >> np.uint64(48)) | np.uint64(1)).astype(np.uint16)  # never 0, an empty slot
        first = h & mask
        return prints, first.astype(np.int64), (first ^ (mix64(prints.astype(np.uint64)) & mask)).astype(np.int64)

    def insert(self, keys: np.ndarray) -> bool:
        """False if a key found no place; the table is then to be built anew, larger. Most keys are put into free cells
        of their buckets all at once; the few that find none kick others out."""
        prints, first, second = self.places(keys)
        rest = np.arange(len(keys))
        for bucket in (first, second):
            rest = rest[np.argsort(bucket[rest], kind="stable")]
            own = bucket[rest]
            fresh = np.flatnonzero(np.diff(own, prepend=-1))
            turn = np.arange(len(own)) - np.repeat(fresh, np.diff([*fresh, len(own)]))  # a key's turn within its bucket
            cells = np.argsort(self.table[own] != 0, axis=1, kind="stable")  # free cells first
            fits = turn < (self.table[own] == 0).sum(axis=1)
            self.table[own[fits], cells[fits, turn[fits]]] = prints[rest[fits]]
            rest = rest[~fits]
        mask = len(self.table) - 1
        for p, at in zip(prints[rest].tolist(), second[rest].tolist()):
            for kick in range(self.KICKS):
                slot = (p + kick) & 3
                p, self.table[at, slot] = int(self.table[at, slot]), p
                at ^= int(mix64(np.array([p], np.uint64))[0]) & mask
                free = np.flatnonzero(self.table[at] == 0)
                if len(free):
                    self.table[at, free[0]] = p
                    break
            else:
                return False
        return True

    def delete(self, keys: np.ndarray) -> None:
        """keys must have been inserted."""
        for p, a, b in zip(*(x.tolist() for x in self.places(keys))):
            for at in (a, b):
                hit = np.flatnonzero(self.table[at] == p)
                if len(hit):
                    self.table[at, hit[0]] = 0
                    break

    def contains(self, keys: np.ndarray) -> np.ndarray:
        p, a, b = self.places(keys)
        return ((self.table[a] == p[:, None]) | (self.table[b] == p[:, None])).any(axis=1)


def _numbers(keys: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(keys), "<u8").reshape(-1, 2)[:, 0] if keys else np.empty(0, "<u8")


def postings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """doc_id, key (16-byte digest): a row for each row of docs and distinct line key. Null ids hold no lines."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches, "text"):
            ids, found = [], []
            for id_, t in zip(batch.column(0).to_pylist(), texts):
                own = {k for line in (t or b"").split(b"\n") if (k := line_key(line, min_chars)) is not None}
                ids += [id_] * len(own)
                found += [xxhash.xxh3_128_digest(k) for k in own]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(found, pa.binary())], ["doc_id", "key"])

    docs = docs.filter(F.col(text_col).isNotNull())
    rows = docs.filter(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(keys, "doc_id long, key binary")


def _shard(key, shards: int):
    return F.pmod(F.xxhash64(key), F.lit(shards)).cast("int")


def counted(posted: DataFrame) -> DataFrame:
    """shard, key, holders, first_doc; summed on the map side, so a key in every document is no load. posted has each
    document and key once."""
    return posted.groupBy("shard", "key").agg(F.count("*").alias("holders"), F.min("doc_id").alias("first_doc"))


POSTED, COUNTED = "doc_id long, key binary, shard int", "key binary, holders long, first_doc long, shard int"


@dataclass
class Shard:
    """Where a shard's parts lie. An update makes new ones and leaves the old parts as they are."""

    posted: tuple[str, ...] = ()  # folders of postings, each with a folder shard=K
    counts: str | None = None
    filter: str | None = None


@dataclass
class LineIndex:
    """Postings, counts and filters by shard. The manifest is all that the driver holds: a row a shard."""

    spark: SparkSession
    shards: int
    parts: dict[int, Shard] = field(default_factory=dict)
    columns: dict = field(default_factory=dict)

    @classmethod
    def build(cls, docs: DataFrame, shard_postings: int | None = None, **columns) -> LineIndex:
        """columns: id_col, text_col, min_chars as for postings(). Rows of one id count as one document."""
        posted = saved(postings(docs, **columns).distinct() if _repeats(docs, **columns) else postings(docs, **columns), "line-postings-raw")
        shards = max(1, math.ceil(posted.count() / (shard_postings or SHARD_POSTINGS)))
        index = cls(docs.sparkSession, shards, columns=columns)._added(posted.withColumn("shard", _shard("key", shards)))
        discard(docs.sparkSession, posted)
        return index

    # Reading ----------------------------------------------------------------

    def _table(self, schema: str, folders: Iterable[tuple[str, int]]) -> DataFrame:
        """Rows of shards' folders; each folder of several shards is one scan."""
        by: dict[str, list[int]] = {}
        for folder, shard in folders:
            by.setdefault(folder, []).append(shard)
        out = self.spark.createDataFrame([], schema)
        for i, (folder, own) in enumerate(sorted(by.items())):
            part = self.spark.read.schema(schema).option("basePath", folder).parquet(*[f"{folder}/shard={s}" for s in own])
            out = part if i == 0 else out.unionByName(part)
        return out

    def posted(self, shards: Iterable[int] | None = None) -> DataFrame:
        own = self.parts if shards is None else [s for s in shards if s in self.parts]
        return self._table(POSTED, [(f, s) for s in own for f in self.parts[s].posted])

    def counts(self, shards: Iterable[int] | None = None) -> DataFrame:
        own = self.parts if shards is None else [s for s in shards if s in self.parts]
        return self._table(COUNTED, [(self.parts[s].counts, s) for s in own if self.parts[s].counts])

    def repeats(self) -> DataFrame:
        return self.counts().filter("holders > 1").select("key", "first_doc")

    def files(self) -> set[str]:
        """Every part of every shard, as shard and place."""
        return {f"{s}:{f}" for s, p in self.parts.items() for f in (*p.posted, p.counts, p.filter) if f}

    # Writing ----------------------------------------------------------------

    def _write(self, df: DataFrame, name: str) -> tuple[str, list[int]]:
        """df by shard in a new folder; the shards it has, from the folder's listing. Postings go in ranges that split a
        shard's or a key's many rows; counts have a row a key, so a shard of them is small."""
        path = work_dir(self.spark, name)
        tasks = max(self.spark.sparkContext.defaultParallelism, math.ceil(self.shards / 8))
        if "doc_id" in df.columns:
            df = df.repartitionByRange(max(tasks, self.shards), "shard", "key", "doc_id")
        else:
            df = df.repartition(tasks, "shard")
        df.sortWithinPartitions("shard", "key").write.partitionBy("shard").parquet(path)
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        names = [f.getPath().getName() for f in at.getFileSystem(self.spark._jsc.hadoopConfiguration()).listStatus(at)]
        return path, sorted(int(x.removeprefix("shard=")) for x in names if x.startswith("shard="))

    def _filters(self, changes: DataFrame, old: dict[int, str | None]) -> dict[int, str]:
        """changes: shard, key, delta (1 came, -1 went); new filter files of the shards that have some."""
        path, places = work_dir(self.spark, "line-filters"), {s: f for s, f in old.items() if f}

        def change(own: pd.DataFrame) -> pd.DataFrame:
            shard = int(own["shard"].iloc[0])
            came, went = (_numbers(own.loc[own["delta"] == d, "key"].tolist()) for d in (1, -1))
            if shard in places:
                f = CuckooFilter(map_file(places[shard], np.uint16).reshape(-1, 4).copy())
                f.delete(went)
                full = not f.insert(came)
            else:
                f, full = CuckooFilter.of(came), False
            if not full:
                put_file(f"{path}/{shard:06d}", [f.table.tobytes()])
            return pd.DataFrame({"shard": [shard], "full": [full]})

        done = saved(changes.groupBy("shard").applyInPandas(change, "shard int, full boolean"), "line-filters-made")
        rows = done.collect()  # a row a shard
        discard(self.spark, done)
        made = {r.shard: f"{path}/{r.shard:06d}" for r in rows if not r.full}
        full = {r.shard for r in rows if r.full}
        if full:  # outgrown: built anew, larger, from the exact counts
            again = self.counts(full).filter("holders > 1").select("shard", "key", F.lit(1).alias("delta"))
            made |= self._filters(again, {})
        return made

    def _with_counts(self, parts: dict[int, Shard], fresh: DataFrame, touched: list[int]) -> LineIndex:
        """The index whose touched shards have fresh's counts (shard, key, holders, first_doc)."""
        folder, present = self._write(fresh, "line-counts")
        for s in touched:
            parts[s].counts = folder if s in present else None
        new = LineIndex(self.spark, self.shards, parts, self.columns)
        was = self.counts(touched).filter("holders > 1").select("shard", "key", F.lit(-1).alias("delta"))
        now = new.counts(touched).filter("holders > 1").select("shard", "key", F.lit(1).alias("delta"))
        changes = was.unionByName(now).groupBy("shard", "key").agg(F.sum("delta").cast("int").alias("delta")).filter("delta <> 0")
        made = new._filters(changes, {s: parts[s].filter for s in touched})
        for s, f in made.items():
            parts[s].filter = f
        return new

    def _copy(self) -> dict[int, Shard]:
        return {s: Shard(p.posted, p.counts, p.filter) for s, p in self.parts.items()}

    def _added(self, posted: DataFrame) -> LineIndex:
        folder, touched = self._write(posted, "line-postings")
        parts = self._copy()
        for s in touched:
            own = parts.setdefault(s, Shard())
            own.posted = (*own.posted, folder)
        more = counted(self._table(POSTED, [(folder, s) for s in touched]))
        both = self.counts(touched).unionByName(more).groupBy("shard", "key").agg(F.sum("holders").alias("holders"), F.min("first_doc").alias("first_doc")) if self.parts else more
        return self._with_counts(parts, both, touched)

    def _keys(self, docs: DataFrame) -> tuple[DataFrame, list[int]]:
        own = saved(postings(docs, **self.columns).distinct().withColumn("shard", _shard("key", self.shards)), "line-delta")
        return own, [r.shard for r in own.select("shard").distinct().collect()]

    def insert(self, docs: DataFrame) -> LineIndex:
        """The index after docs came too. Documents whose id the index holds already add the lines that they lacked."""
        own, touched = self._keys(docs)
        return self._added(own.join(self.posted(touched), ["shard", "key", "doc_id"], "left_anti"))

    def delete(self, docs: DataFrame) -> LineIndex:
        """The index after docs (ids and texts, as they were inserted) left."""
        own, touched = self._keys(docs)
        own = own.join(self.posted(touched), ["shard", "key", "doc_id"], "left_semi")
        folder, present = self._write(self.posted(touched).join(own, ["shard", "key", "doc_id"], "left_anti"), "line-postings")
        parts = self._copy()
        for s in touched:
            if s in parts:
                parts[s].posted = (folder,) if s in present else ()
        touched = [s for s in touched if s in parts]
        gone = own.groupBy("shard", "key").agg(F.count("*").alias("went"), F.min("doc_id").alias("least_gone"))
        left = self.counts(touched).join(gone, ["shard", "key"], "left").withColumn("holders", F.col("holders") - F.coalesce("went", F.lit(0))).filter("holders > 0")
        # Where the least holder left, the least of those that stay is looked up in the postings.
        orphans = left.filter("least_gone = first_doc").select("shard", "key")
        heirs = self._table(POSTED, [(folder, s) for s in present]).join(orphans, ["shard", "key"], "left_semi").groupBy("shard", "key").agg(F.min("doc_id").alias("heir"))
        left = left.join(heirs, ["shard", "key"], "left").select("shard", "key", "holders", F.coalesce("heir", "first_doc").alias("first_doc"))
        return self._with_counts(parts, left, touched)

    # Use --------------------------------------------------------------------

    def maybe_repeated(self) -> DataFrame:
        """doc_id, key of the postings that their shard's filter does not clear."""
        places = {s: p.filter for s, p in self.parts.items() if p.filter}

        def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: tuple[int, CuckooFilter | None] = (-1, None)  # postings come in runs of a shard
            for batch in batches:
                shard, keys = batch.column(2).to_numpy(), _numbers(batch.column(1).to_pylist())
                hit = np.zeros(len(keys), bool)
                order = np.argsort(shard, kind="stable")
                for part in np.split(order, np.flatnonzero(np.diff(shard[order])) + 1) if len(order) else []:
                    s = int(shard[part[0]])
                    if held[0] != s:
                        held = s, CuckooFilter(map_file(places[s], np.uint16).reshape(-1, 4)) if s in places else None
                    if held[1] is not None:
                        hit[part] = held[1].contains(keys[part])
                yield batch.select([0, 1]).filter(pa.array(hit))

        return self.posted().select("doc_id", "key", "shard").mapInArrow(pick, "doc_id long, key binary")

    def drops(self) -> DataFrame:
        """doc_id, keys (array of binary) whose lines the document loses."""
        hits = self.maybe_repeated().join(self.repeats(), "key").filter("doc_id <> first_doc")
        return hits.groupBy("doc_id").agg(F.collect_set("key").alias("keys"))


def _repeats(docs: DataFrame, id_col: str = "doc_id", **_) -> bool:
    n, ids = docs.agg(F.count(id_col), F.countDistinct(id_col)).first()
    return n != ids


def drop_repeated_lines(docs: DataFrame, index: LineIndex | None = None, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """docs with repeated lines taken out of the text, plus n_lines and n_dropped.

    A line's key is the line without blanks at its ends, A-Z lower-cased. Keys of min_chars code points or more that
    two documents or more hold lose all their lines but those in the least id that holds them. A null text counts as
    one empty line and stays null; a document that loses every line keeps an empty text. Rows with a null id keep
    all lines and count as nobody's copy; rows of one id count as one document. Columns of docs called n_lines or
    n_dropped are replaced. Very long texts are cut whole, in memory that follows the longest text; an empty table
    gives no rows.
    """
    index = index or LineIndex.build(docs, id_col=id_col, text_col=text_col, min_chars=min_chars)
    docs = docs.drop(*[c for c in ("n_lines", "n_dropped") if c in docs.columns])
    names, drop = docs.columns, "__drop_keys"
    place = names.index(text_col)
    joined = docs.join(index.drops().select(F.col("doc_id").alias("__drop_id"), F.col("keys").alias(drop)), F.col(id_col) == F.col("__drop_id"), "left").drop("__drop_id")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches, text_col):
            kept, n_lines, n_dropped = [], [], []
            for t, gone in zip(texts, batch.column(len(names)).to_pylist()):
                lines = (t or b"").split(b"\n")
                stay = lines
                if gone:
                    gone = set(gone)
                    stay = [x for x in lines if (k := line_key(x, min_chars)) is None or xxhash.xxh3_128_digest(k) not in gone]
                kept.append(None if t is None else b"\n".join(stay))
                n_lines.append(len(lines))
                n_dropped.append(len(lines) - len(stay))
            cols = [batch.column(i) for i in range(len(names))]
            cols[place] = pa.array(kept, pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([*cols, pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())], [*names, "n_lines", "n_dropped"])

    schema = extended(docs, n_lines="long", n_dropped="long")
    return joined.select(*[F.col(f"`{c}`") for c in names], drop).mapInArrow(cut, schema)


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    kept = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return drop_repeated_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2(kept, 256).alias("kept_sha256"))


OP8_SQL = r"""
WITH line AS (
  SELECT doc_id, i, l.line AS line,
         translate(regexp_replace(regexp_replace(l.line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents) d,
       LATERAL (SELECT unnest(d.ls) AS line, generate_subscripts(d.ls, 1) AS i) l
), held AS (
  SELECT key, min(doc_id) AS first_doc FROM line WHERE length(key) >= 10 GROUP BY key HAVING min(doc_id) < max(doc_id)
), marked AS (
  SELECT line.doc_id, i, line, coalesce(line.doc_id <> first_doc, false) AS gone FROM line LEFT JOIN held USING (key)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
