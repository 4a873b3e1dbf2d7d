"""Benchmark decontamination: a broadcast hash set of test windows, verified hits, spans or documents removed.

A window is WINDOW consecutive words of a test item; an item of fewer, but not none, is one window of its own length.
Words are runs of ASCII letters (A-Z count as a-z), digits and anything beyond ASCII. Distinct (window, item) pairs are
made and counted by Spark. Where their bytes stay within BLOCK_BYTES they are one broadcast set; more are cut by hash into
as many blocks as it takes, each broadcast in turn, and what the blocks find in a document is joined by the document's key.

Documents are scanned where they lie: all word hashes of a batch at once, rolled over each window length, looked up in a
bitmap and then among the set's sorted hashes. A hit counts only after the document's own words equal the window's, so
hashes that collide change nothing. Whole texts are scanned, in runs of about a megabyte; a longer text is a run by itself.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from storyweft.llm.common import as_bytes, documents, extended, hash_words, mix64, saved, slices

WINDOW = 10
#: Most bytes of (window, item) pairs in one broadcast set; a pair counts with its window, its item's name and PAIR_BYTES.
BLOCK_BYTES = 32 << 20
PAIR_BYTES = 64
#: Verified slices of texts that a task remembers.
REMEMBERED = 1 << 16
#: Blanks for the bytes that end words; A-Z become a-z.
WORDS = bytes(c if chr(c).isalnum() or c > 127 else 32 for c in bytes(range(256)).lower())
BITS = 20
ROLL = np.uint64(0x9E3779B97F4A7C15)

SPAN = "struct<first: long, words: long, start: long, stop: long>"


def rolled(hashes: np.ndarray, length: int) -> np.ndarray:
    """A hash of every run of `length` word hashes."""
    n = len(hashes) - length + 1
    out = np.zeros(max(0, n), np.uint64)
    for j in range(length):
        out *= ROLL
        out += hashes[j : j + len(out)]
    return mix64(out)


def item_windows(benchmark: DataFrame, length: int = WINDOW, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """window (its words, lower case, one blank apart), words, item (the id as text): distinct. Null texts and those without words
    have none; a null id is kept as null: its windows count, it is no item that can be named."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, text in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1))):
                words = (text or b"").translate(WORDS).split()
                n = min(length, len(words))
                for at in range(0, len(words) - n + 1 if n else 0, 8192):
                    own = [b" ".join(words[i : i + n]) for i in range(at, min(at + 8192, len(words) - n + 1))]
                    yield pa.RecordBatch.from_arrays([pa.array(own, pa.binary()), pa.array([n] * len(own), pa.int32()), pa.array([item] * len(own), pa.string())], ["window", "words", "item"])

    rows = benchmark.select(F.col(id_col).cast("string").alias("item"), F.col(text_col).alias("text"))
    return rows.mapInArrow(cut, "window binary, words int, item string").distinct()


class WindowSet:
    """Windows by length: sorted hashes, a bitmap of their leading bits, the words themselves, and the items of each."""

    def __init__(self, pairs: pa.Table):
        window, items = pairs["window"].to_pylist(), pairs["item"].to_pylist()
        self.names = sorted({i for i in items if i is not None})
        place = {name: i for i, name in enumerate(self.names)}
        own: dict[bytes, set[int]] = {}
        for w, i in zip(window, items):
            own.setdefault(w, set()).update(() if i is None else (place[i],))
        self.windows = sorted(own)
        self.items = np.array([i for w in self.windows for i in own[w]], np.int32)
        self.starts = np.cumsum([0, *(len(own[w]) for w in self.windows)])  # of each window's items
        self.by_length: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        size = np.array([w.count(b" ") + 1 for w in self.windows], np.int64)
        for n in np.unique(size).tolist():
            ids = np.flatnonzero(size == n)
            hashes = rolled(hash_words(b"\n".join(self.windows[i] for i in ids.tolist()))[0], n)[:: n]
            order = np.argsort(hashes, kind="stable")
            bits = np.zeros(1 << BITS, bool)
            bits[hashes >> np.uint64(64 - BITS)] = True
            self.by_length[n] = hashes[order], ids[order], bits

    def named(self, ids: np.ndarray) -> list[str]:
        """Items of windows, in the order of their names as text."""
        places = np.unique(np.concatenate([self.items[self.starts[i] : self.starts[i + 1]] for i in ids.tolist()])) if len(ids) else ids
        return [self.names[i] for i in places.tolist()]


def hits(known: WindowSet, buffer: bytes, hashes: np.ndarray, places: np.ndarray, ends: np.ndarray, seen: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word, length, window) of every verified occurrence. ends: for each word, where its document's words end."""
    first, length, which = [], [], []
    for n, (sorted_hashes, ids, bits) in known.by_length.items():
        h = rolled(hashes, n)
        at = np.flatnonzero(bits[h >> np.uint64(64 - BITS)] & (np.arange(n, n + len(h)) <= ends[: len(h)]))
        low = np.searchsorted(sorted_hashes, h[at])
        same = np.flatnonzero(sorted_hashes[np.minimum(low, len(sorted_hashes) - 1)] == h[at])
        for i, k in zip(at[same].tolist(), low[same].tolist()):
            raw = buffer[places[i] : places[i + n] if i + n < len(places) else len(buffer)]
            w = seen.get((n, raw))
            if w is None:
                words, w = b" ".join(raw.split()), -1
                while k < len(sorted_hashes) and sorted_hashes[k] == h[i]:
                    if known.windows[ids[k]] == words:
                        w = int(ids[k])
                    k += 1
                if len(seen) >= REMEMBERED:
                    seen.clear()
                seen[n, raw] = w
            if w >= 0:
                first.append(i)
                length.append(n)
                which.append(w)
    return np.array(first, np.int64), np.array(length, np.int64), np.array(which, np.int64)


def scan(docs: DataFrame, shared, text_col: str = "text") -> DataFrame:
    """docs (any columns and its text as the last one, which goes) with n_words, spans and items.

    spans: maximal runs of hit words, by number of the first word, count of words, and place of the first byte and the one
    after the last; items: names of the items whose windows occur, in order. A null text has no words."""
    keep = [c for c in docs.columns if c != text_col]

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: WindowSet = shared.value
        seen: dict = {}
        for batch, texts in slices(batches, text_col):
            buffer = b"\n".join(t or b"" for t in texts).translate(WORDS)
            hashes, places = hash_words(buffer)
            begins = np.cumsum([0, *(len(t or b"") + 1 for t in texts)])
            stops = np.searchsorted(places, begins[1:])  # words of each text end here
            n_words = np.diff(stops, prepend=0)
            first, length, which = hits(known, buffer, hashes, places, np.repeat(stops, n_words), seen)
            turn = np.zeros(len(places) + 1, np.int64)
            np.add.at(turn, first, 1)
            np.add.at(turn, first + length, -1)
            hit = np.cumsum(turn[:-1]) > 0
            begun = hit.copy()
            begun[1:] &= ~hit[:-1]
            edge = stops[:-1][stops[:-1] < len(hit)]
            begun[edge] = hit[edge]  # a run stays within its text
            of = np.repeat(np.arange(len(texts)), n_words)
            run_first = np.flatnonzero(begun)
            run_words = np.bincount(np.searchsorted(run_first, np.flatnonzero(hit), "right") - 1, minlength=len(run_first)) if len(run_first) else run_first
            run_of = of[run_first]
            spans = [[] for _ in texts]
            for d, i, n in zip(run_of.tolist(), run_first.tolist(), run_words.tolist()):
                stop = buffer.find(b" ", int(places[i + n - 1]))
                stop, begin = len(buffer) if stop < 0 else stop, int(begins[d])
                spans[d].append({"first": i - int(stops[d] - n_words[d]), "words": n, "start": int(places[i]) - begin, "stop": stop - begin})
            items = [[] for _ in texts]
            order = np.argsort(of[first], kind="stable") if len(first) else first
            for own in np.split(order, np.flatnonzero(np.diff(of[first[order]])) + 1) if len(first) else ():
                items[of[first[own[0]]]] = known.named(np.unique(which[own]))
            found = [pa.array(n_words, pa.int64()), pa.array(spans, pa.list_(pa.struct([(c, pa.int64()) for c in ("first", "words", "start", "stop")]))), pa.array(items, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in keep), *found], [*keep, "n_words", "spans", "items"])

    return docs.mapInArrow(find, extended(docs.select(*[F.col(f"`{c}`") for c in keep]), n_words="long", spans=f"array<{SPAN}>", items="array<string>"))


def _union(found: list[DataFrame]) -> DataFrame:
    """One row a key of several blocks' findings: spans that overlap or touch become one."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for spans in batch.column(2).to_pylist():
                own: list[dict] = []
                for s in sorted((s for part in spans for s in part), key=lambda s: s["first"]):
                    if own and s["first"] <= own[-1]["first"] + own[-1]["words"]:
                        last = own[-1]
                        last["words"] = max(last["words"], s["first"] + s["words"] - last["first"])
                        last["stop"] = max(last["stop"], s["stop"])
                    else:
                        own.append(dict(s))
                out.append(own)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.list_(pa.struct([(c, pa.int64()) for c in ("first", "words", "start", "stop")]))), batch.column(3)], ["key", "n_words", "spans", "items"])

    rows = found[0]
    for more in found[1:]:
        rows = rows.unionByName(more)
    rows = rows.groupBy("key").agg(F.max("n_words").alias("n_words"), F.collect_list("spans").alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    return rows.mapInArrow(merge, f"key long, n_words long, spans array<{SPAN}>, items array<string>")


def contamination(docs: DataFrame, benchmark: DataFrame, length: int = WINDOW, text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc (the row of docs as a struct, without its text), n_words, spans and items (as scan() gives them), n_hit: a row for
    each row of docs.

    Rows of one id, or of none, are documents of their own. Without test windows nothing is hit. benchmark: item_id, text."""
    spark = docs.sparkSession
    pairs = saved(item_windows(benchmark, length), "test-windows")
    size = pairs.agg(F.sum(F.length("window") + F.coalesce(F.length("item"), F.lit(0)) + PAIR_BYTES)).first()[0] or 0
    blocks = max(1, math.ceil(size / block_bytes))
    rest = [F.col(f"`{c}`") for c in docs.columns if c != text_col] or [F.lit(None).cast("long").alias("none")]
    if blocks == 1:
        found = scan(docs.select(F.struct(*rest).alias("doc"), F.col(text_col).alias("text")), spark.sparkContext.broadcast(WindowSet(pairs.toArrow())))
    else:
        keyed = saved(docs.select(F.struct(*rest).alias("doc"), F.col(text_col).alias("text")).withColumn("key", F.monotonically_increasing_id()), "keyed-documents")
        parts = []
        for b in range(blocks):
            own = pairs.filter(F.pmod(F.xxhash64("window", "item"), F.lit(blocks)) == b).toArrow()
            parts.append(saved(scan(keyed.select("key", "text"), spark.sparkContext.broadcast(WindowSet(own))), "window-hits"))
        found = keyed.select("key", "doc").join(_union(parts), "key").drop("key")
    return found.withColumn("n_hit", F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x["words"]))


def without(text: Column, spans: Column) -> Column:
    """Text less the bytes of its spans, separators inside a span included; null stays null."""

    @F.pandas_udf("string")
    def cut(texts: pd.Series, cuts: pd.Series) -> pd.Series:
        out = []
        for t, own in zip(texts, cuts):
            if t is not None and len(own):
                raw, at, parts = t.encode(), 0, []
                for s in own:
                    parts.append(raw[at : s["start"]])
                    at = s["stop"]
                t = b"".join([*parts, raw[at:]]).decode()
            out.append(t)
        return pd.Series(out, dtype=object)

    return F.when(F.size(spans) > 0, cut(text, spans)).otherwise(text)


def decontaminate(docs: DataFrame, benchmark: DataFrame, remove: str = "spans", length: int = WINDOW, share: float = 0.0, text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs in its own columns without what it shares with the benchmark.

    remove="spans": hit words go, with what stands between them; the rest of the text stays as it is, a document may end up
    blank. remove="documents": documents of which more than `share` of the words are hit go. Null texts, and documents that
    share nothing, stay as they are; the order and the number of the others too. Columns of any name may stand beside."""
    if remove not in ("spans", "documents"):
        raise ValueError("remove spans or documents")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{text_col}`").alias("text"))
    found = contamination(rows, benchmark, length, block_bytes=block_bytes)
    if remove == "documents":
        found = found.filter(~(F.col("n_hit") > F.col("n_words") * F.lit(share)))
    text = F.col(f"doc.row.`{text_col}`")
    text = without(text, F.col("spans")) if remove == "spans" else text
    return found.select(*[text.alias(c) if c == text_col else F.col(f"doc.row.`{c}`") for c in docs.columns])


def op11_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: words, hit words, and the test items that occur in it."""
    found = contamination(documents(spark, sf_dir).select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select(
        "doc.doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


OP11_SQL = r"""
WITH dw AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), bw AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), item AS (SELECT item_id, w, least(10, len(w)) AS n FROM bw WHERE len(w) > 0
), known AS (
  SELECT DISTINCT item_id, n, unnest(list_transform(range(1, len(w) - n + 2), lambda i: array_to_string(w[i:i + n - 1], ' '))) AS s FROM item
), size AS (SELECT DISTINCT n FROM known
), own AS (
  SELECT doc_id, n, unnest(range(1, len(w) - n + 2)) AS i, w FROM dw, size WHERE len(w) >= n
), met AS (
  SELECT doc_id, i, own.n, item_id FROM (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS s FROM own) own JOIN known ON known.n = own.n AND known.s = own.s
), word AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS p FROM met) GROUP BY doc_id
), named AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM met WHERE item_id IS NOT NULL) GROUP BY doc_id
)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw d LEFT JOIN word USING (doc_id) LEFT JOIN named USING (doc_id)
"""
