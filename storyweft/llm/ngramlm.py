"""Language-model scoring with a three-level n-gram trie in Elias-Fano form.

Words are numbered by the order of their 64-bit hashes, so a word's number is its rank; 0 is the start of a text, one
more than the vocabulary an unknown word. Level 1 is the vocabulary, cut into files by ranges of the hash. Levels 2 and
3 are cut into shards by ranges of the pair (context word, word): cuts follow the mass of the counts, so that each shard
has about SHARD_TOKENS training tokens and a frequent word's successors lie in many shards.

A shard is one flat file that workers map: for each context word the place where its successors start (a monotone
sequence), the successors themselves, made monotone by adding the context's rank times the universe, and the same once
more from pairs to their third words. Each entry has a quantised discounted probability, each context a quantised
back-off weight. An n-gram is looked up relative to its context: the pointers give the context's range, and a successor
search halves it, reading single values from the packed form.

No task holds the model. Texts are cut into blocks of BLOCK tokens or more; a block deals its distinct pairs and triples
to the shards (sorted, a row a shard), shards send back a byte or three for each, and the block is put together again.
Work and traffic are in proportion to the corpus; counts cover all training texts and nothing is pruned.

Probabilities: P3(c|a,b) = max(n(abc) - D3, 0) / n(ab.) + D3 kinds(ab.) / n(ab.) * P2(c|b), P2 likewise over the add-1/2
unigrams of the vocabulary and one unknown word; a context that training texts lack leaves the shorter one's probability.
D = n1 / (n1 + 2 n2) of each order, from the counts of the whole corpus.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storyweft.llm.common import discard, documents, filesystem, held_out, map_file, put_file, saved, slices, words_of, work_dir
from storyweft.llm.eliasfano import EliasFano, map_arrays, put_arrays

U = np.uint64
#: Distinct words that a file of the vocabulary aims at, and training tokens that a shard of the trie aims at.
SHARD_KEYS = 1_500_000
SHARD_TOKENS = 2_000_000
#: A shard has at least so many times the root of all training tokens, a block so many tokens for each shard: rows from
#: blocks to shards, as many as blocks x shards, then hold some forty n-grams each however large the corpus is. At 2e13
#: tokens (100 TB) a shard has 47 million tokens and a block 12 million.
SHARD_ROOT = 10
ROW_TOKENS = 25
END = U(0x5E2D0F1E1D5EED0F)  # stands for the end of a text
LEVELS = 254  # quantisation steps of a log-probability; code 0 is probability 0
BLOCK = 1 << 19  # tokens of a block, at least
LOOKUPS = 1 << 20  # n-grams looked up in one go


# Compact rows -------------------------------------------------------------------------------------------------------


def planes(a: np.ndarray) -> bytes:
    """The numbers' lowest bytes, then the next ones, and so on (high bytes are mostly 0), compressed; their length first."""
    raw = np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.itemsize).T)
    return len(a).to_bytes(8, "little") + zstandard.compress(raw, 1)


def unplanes(packed: bytes, dtype) -> np.ndarray:
    n, size = int.from_bytes(packed[:8], "little"), np.dtype(dtype).itemsize
    raw = np.frombuffer(zstandard.decompress(memoryview(packed)[8:], max_output_size=n * size), np.uint8)
    return np.ascontiguousarray(raw.reshape(size, n).T).view(dtype).ravel()


def put_packed(uri: str, **arrays: np.ndarray) -> None:
    """Arrays as planes(), in one Arrow file."""
    batch = pa.RecordBatch.from_arrays([pa.array([planes(a)], pa.large_binary()) for a in arrays.values()], [f"{k}:{a.dtype.str}" for k, a in arrays.items()])
    sink = pa.BufferOutputStream()
    with pa.ipc.new_file(sink, batch.schema) as out:
        out.write_batch(batch)
    put_file(uri, [sink.getvalue()])


def get_packed(uri: str) -> dict[str, np.ndarray]:
    fs, path = filesystem(uri)
    with fs.open_input_file(path) as f:
        batch = pa.ipc.open_file(f).get_batch(0)
        names = [n.split(":", 1) for n in batch.schema.names]
        return {k: unplanes(batch.column(i)[0].as_buffer(), dtype) for i, (k, dtype) in enumerate(names)}


# Level 1: the vocabulary ---------------------------------------------------------------------------------------------


def _sum_sorted(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys)
    keys, n = keys[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, int)
    return keys[first], np.add.reduceat(n, first) if len(first) else n


class _Sums:
    """Counts of 64-bit keys in bounded buffers: full buffers are sorted and added up; large sums are handed out."""

    def __init__(self, limit: int = 1_000_000):
        self.limit, self.fresh, self.size, self.keys, self.n = limit, [], 0, np.empty(0, U), np.empty(0, np.int64)

    def add(self, keys: np.ndarray) -> bool:
        self.fresh.append(keys)
        self.size += len(keys)
        if self.size >= self.limit:
            self.fold()
        return len(self.keys) >= 3 * self.limit

    def fold(self) -> None:
        keys, n = np.unique(np.concatenate([np.empty(0, U), *self.fresh]), return_counts=True)
        self.keys, self.n = _sum_sorted(np.concatenate([self.keys, keys]), np.concatenate([self.n, n])) if len(self.keys) else (keys, n)
        self.fresh, self.size = [], 0

    def take(self) -> tuple[np.ndarray, np.ndarray]:
        self.fold()
        out = self.keys, self.n
        self.keys, self.n = np.empty(0, U), np.empty(0, np.int64)
        return out


def tokens_of(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the texts' words, each text followed by END, and where each text ends."""
    h, ends = words_of(texts)
    stops = ends + np.arange(1, len(ends) + 1)
    out = np.full(len(h) + len(ends), END)
    word = np.ones(len(out), bool)
    word[stops - 1] = False
    out[word] = h
    return out, stops


def _range_of(hashes: np.ndarray, files: int) -> np.ndarray:
    return ((hashes >> U(32)) * U(files) >> U(32)).astype(np.int32)


def count_words(docs: DataFrame, files: int) -> DataFrame:
    """file, keys, n: a task's sorted word hashes and counts, a row for each file that it has words of."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = _Sums()

        def flush():
            keys, n = sums.take()
            of = _range_of(keys, files)
            edges = np.flatnonzero(np.diff(of, prepend=-1)) if len(of) else []
            for i, j in zip(edges, [*edges[1:], len(of)]):
                yield pa.RecordBatch.from_arrays([pa.array([int(of[i])], pa.int32()), pa.array([planes(np.diff(keys[i:j], prepend=U(0)))], pa.binary()), pa.array([planes(n[i:j])], pa.binary())], ["file", "keys", "n"])

        for _, texts in slices(batches, "text"):
            if sums.add(tokens_of(texts)[0]):
                yield from flush()
        yield from flush()

    return docs.select("text").mapInArrow(count, "file int, keys binary, n binary")


def _by_key(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Iterator[tuple]]]:
    """(first column, its rows' other columns) of rows sorted by the first column; rows are read as they are used."""
    rows = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns)))
    head = next(rows, None)

    def own(key):
        nonlocal head
        while head is not None and head[0] == key:
            yield head[1:]
            head = next(rows, None)

    while head is not None:
        key = head[0]
        yield key, own(key)


@dataclass
class NgramModel:
    """Where the levels lie, and what all lookups need. Its files stay in the shared folder."""

    path: str
    files: int
    bases: list[int]  # words before each file of the vocabulary
    total: int  # N: training tokens
    words: int  # V: distinct training tokens
    cuts: np.ndarray | None = None  # first pair of each shard but the first
    discounts: tuple[float, float] = (0.75, 0.75)
    cache: dict = field(default_factory=dict, repr=False)

    def __getstate__(self):
        return {**self.__dict__, "cache": {}}

    @property
    def symbols(self) -> int:
        return self.words + 2

    @property
    def shards(self) -> int:
        return len(self.cuts) + 1

    @property
    def block(self) -> int:
        return max(BLOCK, ROW_TOKENS * self.shards)

    def contexts(self, shard: int) -> tuple[int, int]:
        """First and last context word of a shard's range; the unknown word is none."""
        m = self.symbols
        low = int(self.cuts[shard - 1]) // m if shard else 0
        return low, (int(self.cuts[shard]) - 1) // m if shard < len(self.cuts) else self.words

    def file(self, file: int, name: str, dtype) -> np.ndarray:
        if (file, name) not in self.cache:
            self.cache[file, name] = map_file(f"{self.path}/{file:06d}.{name}", dtype)
        return self.cache[file, name]

    def lookup(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbol and count of each word hash (unknown: words + 1, and 0); hashes are sorted."""
        ids, n = np.full(len(hashes), self.words + 1), np.zeros(len(hashes), np.int64)
        of = _range_of(hashes, self.files)
        edges = np.flatnonzero(np.diff(of, prepend=-1)) if len(of) else []
        for i, j in zip(edges, [*edges[1:], len(of)]):
            s, own = int(of[i]), hashes[i:j]
            keys = self.file(s, "words", U)
            if len(keys):
                at = np.minimum(np.searchsorted(keys, own), len(keys) - 1)
                hit = np.flatnonzero(keys[at] == own)
                ids[i + hit] = at[hit] + self.bases[s] + 1
                n[i + hit] = self.file(s, "counts", np.int64)[at[hit]]
        return ids, n

    def unigram(self, n: np.ndarray) -> np.ndarray:
        return (n + 0.5) / (self.total + 0.5 * (self.words + 1))

    # Codes 255 to 1 are log-probabilities from 0 down to less than any that counts give, in steps that grow with their
    # distance from 0, as an error repeated in every likely word would add up; code 0 is probability 0.

    @property
    def low(self) -> float:
        return -math.log10(max(1, self.total)) - 1.5

    def quantise(self, p: np.ndarray) -> np.ndarray:
        return (1 + np.rint((1 - np.sqrt(np.maximum(0, np.log10(p) / self.low))) * LEVELS).clip(0, LEVELS)).astype(np.uint8)

    def values(self) -> np.ndarray:
        return np.concatenate([[0.0], 10 ** ((1 - np.arange(LEVELS + 1) / LEVELS) ** 2 * self.low)])


def _vocabulary(docs: DataFrame) -> NgramModel:
    spark = docs.sparkSession
    path = work_dir(spark, "ngram-trie")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    files = max(spark.sparkContext.defaultParallelism, math.ceil(30 * (size / 6) ** 0.6 / SHARD_KEYS))  # words grow less than texts

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for file, rows in _by_key(batches):
            keys, n = np.empty(0, U), np.empty(0, np.int64)
            some: list[tuple[np.ndarray, np.ndarray]] = []
            for k, c in rows:
                some.append((np.cumsum(unplanes(k, U), dtype=U), unplanes(c, np.int64)))
                if sum(len(x) for x, _ in some) > max(SHARD_KEYS, len(keys)):
                    keys, n = _sum_sorted(np.concatenate([keys, *(x for x, _ in some)]), np.concatenate([n, *(x for _, x in some)]))
                    some = []
            keys, n = _sum_sorted(np.concatenate([keys, *(x for x, _ in some)]), np.concatenate([n, *(x for _, x in some)]))
            put_file(f"{path}/{file:06d}.words", [keys.tobytes()])
            put_file(f"{path}/{file:06d}.counts", [n.tobytes()])
            yield pa.RecordBatch.from_pydict({"file": pa.array([file], pa.int32()), "words": [len(keys)], "total": [int(n.sum())]})

    dealt = count_words(docs, files).repartitionById(files, F.col("file")).sortWithinPartitions("file")
    made = saved(dealt.mapInArrow(write, "file int, words long, total long"), "ngram-words")
    got = {r.file: r for r in made.collect()}  # a row a file
    discard(spark, made)
    bases, total, words = [], 0, 0
    for s in range(files):
        bases.append(words)
        if s in got:
            words, total = words + got[s].words, total + got[s].total
        else:
            put_file(f"{path}/{s:06d}.words", [])
            put_file(f"{path}/{s:06d}.counts", [])
    if words + 2 >= 1 << 32:
        raise ValueError("pairs of so many distinct words don't fit 64 bits")
    model = NgramModel(path, files, bases, total, words)
    model.cuts = _cuts(model, [got[s].total if s in got else 0 for s in range(files)], max(spark.sparkContext.defaultParallelism, math.ceil(total / max(SHARD_TOKENS, SHARD_ROOT * math.sqrt(total)))))
    return model


def _cuts(model: NgramModel, totals: list[int], shards: int) -> np.ndarray:
    """First pair of each shard but the first. Tokens are laid out by their context word, and within a frequent one by
    the share of all tokens that the words have: shards get about equal parts."""
    if not model.words:
        return np.empty(0, U)
    before = np.cumsum([0, *totals])

    def word_at(places: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Symbol of the word that has each place among all tokens, how far into it the place is, and its count."""
        file = np.searchsorted(before, places, side="right") - 1
        word, into, n = (np.zeros(len(places), np.int64) for _ in range(3))
        for s in np.unique(file).tolist():
            own = np.flatnonzero(file == s)
            counts = model.file(s, "counts", np.int64)
            ends = np.cumsum(counts)
            at = np.searchsorted(ends, places[own] - before[s], side="right")
            word[own], n[own] = at + model.bases[s] + 1, counts[at]
            into[own] = places[own] - before[s] - (ends[at] - counts[at])
        return word, into, n

    places = (np.arange(1, shards) * model.total) // shards
    word, into, n = word_at(places)
    second = np.zeros(len(places), np.int64)
    wide = np.flatnonzero(n * shards > model.total // 4)
    if len(wide):
        second[wide] = word_at(((into[wide] / n[wide]) * model.total).astype(np.int64))[0]
    return np.unique(word.astype(U) * U(model.symbols) + second.astype(U))


# Blocks of texts -----------------------------------------------------------------------------------------------------


def _blocks(batches, tokens: int) -> Iterator[tuple[list, np.ndarray, np.ndarray]]:
    """(the block's batches, its word hashes, where each text ends), in blocks of about so many tokens."""
    held, words, ends, size = [], [], [], 0
    for batch, texts in slices(batches, "text"):
        own, stops = tokens_of(texts)
        held.append(batch)
        words.append(own)
        ends.append(stops + size)
        size += len(own)
        if size >= tokens:
            yield held, np.concatenate(words), np.concatenate(ends)
            held, words, ends, size = [], [], [], 0
    if size:
        yield held, np.concatenate(words), np.concatenate(ends)


@dataclass
class Grams:
    """A block's distinct pairs, and its distinct triples as (place of their first two words' pair, third word)."""

    pairs: np.ndarray
    pair_n: np.ndarray
    pair_of: np.ndarray  # place of each token's pair
    later: np.ndarray  # tokens that are not the first of their text
    triples: np.ndarray
    triple_n: np.ndarray
    triple_of: np.ndarray  # place of each later token's triple

    @classmethod
    def of(cls, symbols: np.ndarray, ends: np.ndarray, m: int) -> Grams:
        before = np.concatenate([[0], symbols[:-1]]).astype(U)
        before[ends[:-1]] = 0
        pairs, pair_of, pair_n = np.unique(before * U(m) + symbols.astype(U), return_inverse=True, return_counts=True)
        first = np.zeros(len(symbols), bool)
        first[0] = True
        first[ends[:-1]] = True
        later = np.flatnonzero(~first)
        triples, triple_of, triple_n = np.unique(pair_of[later - 1].astype(U) * U(m) + symbols[later].astype(U), return_inverse=True, return_counts=True)
        return cls(pairs, pair_n, pair_of, later, triples, triple_n, triple_of)

    def rows(self, model: NgramModel, block: int, counts: bool) -> pa.RecordBatch:
        """A row for each shard that the block has pairs of. Pairs after the unknown word, the last ones, need no answer
        and are left out."""
        m = U(model.symbols)
        kinds = np.bincount((self.triples // m).astype(np.int64), minlength=len(self.pairs)).astype(np.uint32)
        third = (self.triples % m).astype(np.uint32)
        edges = np.concatenate([[0], np.searchsorted(self.pairs, model.cuts), [np.searchsorted(self.pairs, U(model.words + 1) * m)]])
        inner = np.concatenate([[0], np.cumsum(kinds, dtype=np.int64)])[edges]
        cols: list[list] = [[] for _ in range(7)]
        for s in np.flatnonzero(np.diff(edges)).tolist():
            (i, j), (k, l) = edges[s : s + 2], inner[s : s + 2]
            n2, n3 = (self.pair_n[i:j].astype(np.uint32), self.triple_n[k:l].astype(np.uint32)) if counts else (np.empty(0, np.uint32),) * 2
            row = (s, block, planes(np.diff(self.pairs[i:j], prepend=U(0))), planes(n2), planes(kinds[i:j]), planes(third[k:l]), planes(n3))
            for c, x in zip(cols, row):
                c.append(x)
        types = [pa.int32(), pa.int64(), *[pa.binary()] * 5]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], ["shard", "block", "pairs", "n2", "kinds", "third", "n3"])


GRAMS = "shard int, block long, pairs binary, n2 binary, kinds binary, third binary, n3 binary"


# Levels 2 and 3 ------------------------------------------------------------------------------------------------------


def fit(docs: DataFrame) -> NgramModel:
    """The model of all texts of docs (text; null counts as empty; repeated rows count as often as they come).

    docs is read three times. An empty table gives a model to which every word is unknown. Other columns are ignored; a
    very long text is counted whole, in memory that follows the longest text.
    """
    spark = docs.sparkSession
    model = _vocabulary(docs)
    if not model.words:
        put_arrays(f"{model.path}/shard-000000", _levels(model, 0, *[np.empty(0, t) for t in (U, np.int64, U, np.int64)], {}))
        return model

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, words, ends in _blocks(batches, model.block):
            some, back = np.unique(words, return_inverse=True)
            yield Grams.of(model.lookup(some)[0][back], ends, model.symbols).rows(model, 0, counts=True)

    dealt = docs.select("text").mapInArrow(count, GRAMS).drop("block").repartitionById(model.shards, F.col("shard")).sortWithinPartitions("shard")
    stats = saved(dealt.mapInArrow(_merger(model), "shard int, ones2 long, twos2 long, ones3 long, twos3 long, edges array<long>"), "ngram-merged")
    merged = stats.collect()  # a row a shard
    model.discounts = tuple(_discount(sum(r[f"ones{k}"] for r in merged), sum(r[f"twos{k}"] for r in merged)) for k in (2, 3))
    whole: dict[int, list[int]] = {}  # kinds and tokens of contexts at the edge of a shard, from all shards that have some
    for r in merged:
        for context, kinds, seen in zip(r.edges[::3], r.edges[1::3], r.edges[2::3]):
            own = whole.setdefault(context, [0, 0])
            own[0] += kinds
            own[1] += seen
    done = {r.shard for r in merged}
    todo = [(s, s in done, [x for c in sorted(set(model.contexts(s))) if c in whole for x in (c, *whole[c])]) for s in range(model.shards)]
    todo = spark.createDataFrame(todo, "shard int, counted boolean, edges array<long>").repartitionById(model.shards, F.col("shard"))
    built = saved(todo.mapInArrow(_builder(model), "shard int, pairs long, triples long"), "ngram-shards")
    discard(spark, stats, built, *[f"{model.path}/{s:06d}.merged" for s in done])
    return model


def _discount(ones: int, twos: int) -> float:
    """The usual estimate n1 / (n1 + 2 n2), of n-grams that all training texts hold once and twice."""
    return min(0.95, max(0.5, ones / (ones + 2 * twos))) if ones else 0.75


def _merger(model: NgramModel):
    """Adds up a shard's rows into a file, and tells how many n-grams occur once and twice and what its edges hold."""
    m = U(model.symbols)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, rows in _by_key(batches):
            pairs, n2, at, third, n3, size = [], [], [], [], [], 0
            for p, c2, kinds, t, c3 in rows:
                pairs.append(np.cumsum(unplanes(p, U), dtype=U))
                n2.append(unplanes(c2, np.uint32))
                at.append(np.repeat(np.arange(len(pairs[-1]), dtype=np.int64) + size, unplanes(kinds, np.uint32)))
                third.append(unplanes(t, np.uint32))
                n3.append(unplanes(c3, np.uint32))
                size += len(pairs[-1])
            pairs, place = np.unique(np.concatenate(pairs), return_inverse=True)
            n2 = np.bincount(place, np.concatenate(n2)).astype(np.int64)
            triples = place[np.concatenate(at)].astype(U) * m + np.concatenate(third).astype(U)
            triples, n3 = _sum_sorted(triples, np.concatenate(n3).astype(np.int64))
            put_packed(f"{model.path}/{shard:06d}.merged", pairs=np.diff(pairs, prepend=U(0)), n2=n2, triples=np.diff(triples, prepend=U(0)), n3=n3)
            context = (pairs // m).astype(np.int64)
            edges = [x for c in sorted(set(model.contexts(shard))) for x in (c, int((context == c).sum()), int(n2[context == c].sum()))]
            row = {"shard": pa.array([shard], pa.int32())} | {f"{k}{o}": [int((n == t).sum())] for o, n in ((2, n2), (3, n3)) for k, t in (("ones", 1), ("twos", 2))}
            yield pa.RecordBatch.from_pydict(row | {"edges": pa.array([edges], pa.list_(pa.int64()))})

    return merge


def _builder(model: NgramModel):
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, counted, edges in zip(*(c.to_pylist() for c in batch.columns)):
                x = get_packed(f"{model.path}/{shard:06d}.merged") if counted else {"pairs": np.empty(0, U), "n2": np.empty(0, np.int64), "triples": np.empty(0, U), "n3": np.empty(0, np.int64)}
                pairs, triples = np.cumsum(x["pairs"], dtype=U), np.cumsum(x["triples"], dtype=U)
                whole = {c: (k, n) for c, k, n in zip(edges[::3], edges[1::3], edges[2::3])}
                put_arrays(f"{model.path}/shard-{shard:06d}", _levels(model, shard, pairs, x["n2"], triples, x["n3"], whole))
                yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "pairs": [len(pairs)], "triples": [len(triples)]})

    return build


def _levels(model: NgramModel, shard: int, pairs: np.ndarray, n2: np.ndarray, triples: np.ndarray, n3: np.ndarray, whole: dict[int, tuple[int, int]]) -> dict[str, np.ndarray]:
    """A shard's arrays. triples: place of the pair * symbols + third word; whole: kinds and tokens of edge contexts."""
    m = U(model.symbols)
    d2, d3 = model.discounts
    first, last = model.contexts(shard)
    own = last - first + 1
    context = (pairs // m).astype(np.int64) - first
    kinds = np.bincount(context, minlength=own)
    pointers = EliasFano.of(np.concatenate([[0], np.cumsum(kinds)]), len(pairs) + 1)
    seen = np.bincount(context, n2, own)
    for c, (k, n) in whole.items():
        kinds[c - first], seen[c - first] = k, n
    place, deep = (triples // m).astype(np.int64), len(pairs)
    kinds3, seen3 = np.bincount(place, minlength=deep), np.bincount(place, n3, deep)
    codes = {
        "backoff2": model.quantise(np.where(seen > 0, d2 * kinds / np.maximum(seen, 1), 1.0)),
        "prob2": model.quantise((n2 - d2) / seen[context]),
        "backoff3": model.quantise(np.where(seen3 > 0, d3 * kinds3 / np.maximum(seen3, 1), 1.0)),
        "prob3": model.quantise((n3 - d3) / seen3[place]),
    }
    level2 = EliasFano.of(pairs - U(first) * m, own * int(m))
    deeper = EliasFano.of(np.concatenate([[0], np.cumsum(kinds3)]), len(triples) + 1)
    level3 = EliasFano.of(triples, max(1, deep) * int(m))
    return codes | pointers.arrays("pointers2") | level2.arrays("level2") | deeper.arrays("pointers3") | level3.arrays("level3")


class Shard:
    """A mapped shard that answers for n-grams."""

    def __init__(self, model: NgramModel, shard: int):
        self.m = U(model.symbols)
        self.first, last = model.contexts(shard)
        self.own = last - self.first + 1
        self.file = map_arrays(f"{model.path}/shard-{shard:06d}")
        self.pointers2, self.level2, self.pointers3, self.level3 = (EliasFano.mapped(self.file, x) for x in ("pointers2", "level2", "pointers3", "level3"))

    def answer(self, pairs: np.ndarray, back: np.ndarray, of: np.ndarray, third: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Codes of the probability of each of pairs[back], of its context's back-off weight and its own one, and of the
        probability of each triple, the place of its pair in `of`. pairs: distinct, sorted, contexts in the shard's range."""
        context = (pairs // self.m).astype(np.int64) - self.first
        fresh = np.flatnonzero(np.diff(context, prepend=-1))
        runs = np.diff([*fresh, len(context)])
        start, stop = (np.repeat(self.pointers2.access(context[fresh] + k).astype(np.int64), runs) for k in (0, 1))
        at = self.level2.find(start, stop, pairs - U(self.first) * self.m)
        hit = np.flatnonzero(at >= 0)
        prob2, backoff3 = np.zeros(len(pairs), np.uint8), np.full(len(pairs), 255, np.uint8)
        prob2[hit], backoff3[hit] = self.file["prob2"][at[hit]], self.file["backoff3"][at[hit]]
        start, stop = np.zeros(len(pairs), np.int64), np.zeros(len(pairs), np.int64)
        start[hit], stop[hit] = self.pointers3.access(at[hit]).astype(np.int64), self.pointers3.access(at[hit] + 1).astype(np.int64)
        deep = self.level3.find(start[of], stop[of], np.maximum(at[of], 0).astype(U) * self.m + third.astype(U))
        prob3 = np.zeros(len(of), np.uint8)
        hit = np.flatnonzero(deep >= 0)
        prob3[hit] = self.file["prob3"][deep[hit]]
        return prob2[back], self.file["backoff2"][context][back], backoff3[back], prob3


# Scoring -------------------------------------------------------------------------------------------------------------


def _answers(model: NgramModel):
    """Rows of GRAMS without counts, sorted by shard: a row of codes for each."""

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s, rows in _by_key(batches):
            shard, held, size = Shard(model, s), [], 0

            def out(held=held, shard=shard, s=s):
                pairs, kinds, third = (np.concatenate([h[i] for h in held]) for i in (1, 2, 3))
                some, back = np.unique(pairs, return_inverse=True)  # blocks share many
                codes = shard.answer(some, back, np.repeat(back, kinds), third)
                at2, at3 = (np.cumsum([0, *(len(h[i]) for h in held)]) for i in (1, 3))
                cut = [[planes(c[i:j]) for i, j in zip(at[:-1], at[1:])] for c, at in zip(codes, (at2, at2, at2, at3))]
                types = [pa.int64(), pa.int32(), *[pa.binary()] * 4]
                return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(([h[0] for h in held], [s] * len(held), *cut), types)], ["block", "shard", "prob2", "backoff2", "backoff3", "prob3"])

            for block, p, kinds, t in rows:
                held.append((block, np.cumsum(unplanes(p, U), dtype=U), unplanes(kinds, np.uint32), unplanes(t, np.uint32)))
                size += len(held[-1][1]) + len(held[-1][3])
                if size >= LOOKUPS:
                    yield out()
                    held.clear()
                    size = 0
            if held:
                yield out()

    return answer


SCORES = "doc_id long, n_tokens long, n_known long, base_score double, score double"


def score(docs: DataFrame, model: NgramModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, n_known, base_score, score (log10) of each row.

    A null text counts as empty: its end alone is scored. A null id stays null; repeated rows are scored alike, each for
    itself; other columns, whatever their names, are ignored; an empty table gives no rows. A very long text is scored
    whole, in memory that follows the longest text. Scores don't depend on how docs is partitioned. docs should be a
    stored table or the like: a task that is run again must find the same rows.
    """
    spark = docs.sparkSession
    path = work_dir(spark, "ngram-blocks")

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        for i, (held, words, ends) in enumerate(_blocks(batches, model.block)):
            some, back = np.unique(words, return_inverse=True)
            ids, n = model.lookup(some)
            block = part << 20 | i
            doc = pa.concat_arrays([b.column(0) for b in held])
            put_packed(
                f"{path}/{block:012d}", doc=doc.fill_null(0).to_numpy(), null=doc.is_null().to_numpy(zero_copy_only=False), ends=ends.astype(np.int64), word=back.astype(np.uint32),
                symbol=ids.astype(np.uint32), n=n,
            )
            yield Grams.of(ids[back], ends, model.symbols).rows(model, block, counts=False)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        value = model.values()
        for block, rows in _by_key(batches):
            codes = [np.concatenate([unplanes(x, np.uint8) for x in c]) for c in list(zip(*rows))[1:]]
            x = get_packed(f"{path}/{block:012d}")
            symbols, base = x["symbol"].astype(np.int64)[x["word"]], model.unigram(x["n"])[x["word"]]
            known, ends = (x["n"] > 0)[x["word"]], x["ends"]
            g = Grams.of(symbols, ends, model.symbols)
            sizes = (len(g.pairs),) * 3 + (len(g.triples),)
            prob2, backoff2, backoff3, prob3 = (np.concatenate([c, np.full(n - len(c), gap, np.uint8)]) for c, n, gap in zip(codes, sizes, (0, 255, 255, 0)))
            p = value[prob2][g.pair_of] + value[backoff2][g.pair_of] * base
            p[g.later] = value[prob3][g.triple_of] + value[backoff3][g.pair_of[g.later - 1]] * p[g.later]
            starts = np.concatenate([[0], ends[:-1]])
            sums = [np.add.reduceat(v, starts) for v in (known.astype(np.int64), np.log10(base), np.log10(p))]
            yield pa.RecordBatch.from_arrays([pa.array(x["doc"], mask=x["null"]), pa.array(np.diff(ends, prepend=0)), *map(pa.array, sums)], ["doc_id", "n_tokens", "n_known", "base_score", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    tasks = max(spark.sparkContext.defaultParallelism, rows.rdd.getNumPartitions())
    dealt = rows.mapInArrow(deal, GRAMS).drop("n2", "n3").repartitionById(model.shards, F.col("shard")).sortWithinPartitions("shard", "block")
    codes = dealt.mapInArrow(_answers(model), "block long, shard int, prob2 binary, backoff2 binary, backoff3 binary, prob3 binary")
    return codes.repartition(tasks, "block").sortWithinPartitions("block", "shard").mapInArrow(gather, SCORES)


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    out = held_out("doc_id", 5, 1)
    model = fit(docs.filter(~out))
    return score(docs, model).select("doc_id", out.alias("held_out"), "n_tokens", "n_known", F.lit(model.total).cast("long").alias("train_tokens"), "base_score", "score")
