"""Near-duplicate groups: a chosen-path similarity join over word shingles, confirmed on whole sets.

1. Sketch. Each text becomes its set of 64-bit shingle hashes, a digest of the set, and COORDS minwise tokens. Texts of
   one digest are one class; from here on only a class's least id stands for it, so copies are never paired.
2. Chosen paths. At every level of a tree a node picks one coordinate, and with probability 1 / threshold - 1 a second
   one; a document moves to the children named by its tokens there. A document thus has 1 / threshold children on
   average, so that a pair just at the threshold shares one child a level, and rows grow by that factor a level only.
   Nodes of at most LEAF documents are compared exhaustively by their sketches, larger ones branch again. Nodes still
   large at depth DEPTH agree in many tokens and are taken as linked whole. Each node yields at most one candidate row a
   document (to the least id of its sketch-linked part), never its pairs. The number of trees follows from the
   threshold and the recall wanted of a pair just at the threshold whose nodes stay large down to the last level;
   pairs that part from the crowd earlier, or are more alike, are met with more certainty.
3. Candidate groups are connected components of those rows: supersets of the true groups.
4. Confirmation on whole sets. Groups of at most CHUNK documents are solved in one task, pair by pair, skipping pairs
   that are connected already. Larger groups are dealt into chunks; every chunk is solved together with PIVOTS documents
   of the group. Whoever is then outside the group's largest class is compared, in blocks, with all of the group.
   No link between documents of a candidate group is lost, and no task holds more than a bounded number of sets.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from storyweft.llm.common import BROADCAST_ROWS, discard, documents, mix64, row_keyed, saved, slices, small, words_of

SHINGLE = 5
COORDS = 128
RECALL = 0.999
DEPTH = 4  # levels that branch again, below the first
LEAF = 150
CHUNK = 120
GROUP_ROWS = 1_000_000  # rows of two or three numbers that are broadcast (24 MB), so that texts and tokens stay; more are joined by key
PIVOTS = 12
TOGETHER = 1 << 21  # hashes of members that are intersected at once (80 MB); longer ones pair by pair
SLACK = 0.15  # sketches within this of the threshold go on to the exact check: over 4 standard deviations
SEED = 11

_rng = np.random.default_rng(SEED)
FACTORS = (_rng.integers(0, 1 << 31, COORDS) * 2 + 1).astype(np.uint32)
PLACES = _rng.integers(1, 1 << 63, SHINGLE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: A permutation of the coordinates for each of the first trees; level d of a tree picks within its own run of it.
ORDER = np.stack([_rng.permutation(COORDS) for _ in range(64)])
RUN = COORDS // (DEPTH + 1)


def _sent(df: DataFrame, rows: int, most: int = BROADCAST_ROWS) -> DataFrame:
    """df marked for broadcast if its rows, known to be `rows` at most, are no more than `most`."""
    return F.broadcast(df) if rows <= most else df


def shingle_sets(texts: list[bytes | None]) -> list[np.ndarray]:
    """Of each text the sorted distinct 64-bit hashes of its shingles; of the whole sequence if it has fewer words."""
    h, ends = words_of(texts)
    n = max(0, len(h) - SHINGLE + 1)
    s = h[:n] * PLACES[0]
    for k in range(1, SHINGLE):
        s += h[k : k + n] * PLACES[k]
    s = mix64(s)  # those that reach into the next text are left out below
    out = []
    for i, j in zip([0, *ends[:-1].tolist()], ends.tolist()):
        if j - i >= SHINGLE:
            out.append(np.unique(s[i : j - SHINGLE + 1]))
        elif j > i:
            out.append(mix64((h[i:j] * PLACES[: j - i]).sum(keepdims=True, dtype=np.uint64) + np.uint64(j - i)))
        else:
            out.append(np.empty(0, np.uint64))
    return out


def sketches(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, n_shingles, digest (null without shingles or id), tokens (COORDS uint32)."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches, "text", 512 << 10):
            ids = batch.column(0).to_pylist()
            sets = shingle_sets(texts)
            full = [i for i, s in enumerate(sets) if len(s) and ids[i] is not None]
            digest: list[bytes | None] = [None] * len(ids)
            tokens: list[bytes | None] = [None] * len(ids)
            if full:
                flat = (np.concatenate([sets[i] for i in full]) >> np.uint64(32)).astype(np.uint32)
                starts = np.cumsum([0, *(len(sets[i]) for i in full[:-1])])
                least = np.empty((len(full), COORDS), np.uint32)
                for j in range(COORDS):
                    least[:, j] = np.minimum.reduceat(flat * FACTORS[j], starts)
                for k, i in enumerate(full):
                    digest[i], tokens[i] = xxhash.xxh3_128_digest(sets[i].tobytes()), least[k].tobytes()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(len, sets), pa.int64()), pa.array(digest, pa.binary()), pa.array(tokens, pa.binary())], ["doc_id", "n_shingles", "digest", "tokens"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(sketch, "doc_id long, n_shingles long, digest binary, tokens binary")


def second_share(percent: int) -> float:
    """How often a node picks a second coordinate."""
    return min(1.0, 100 / percent - 1)


def meeting(percent: float, threshold: int, levels: int = DEPTH + 1) -> float:
    """Chance that two documents of a similarity share a node after so many levels of one tree built for a threshold."""
    s, more, lost = percent / 100, second_share(threshold), 0.0
    for _ in range(levels):
        lost = (1 - s * (1 - lost)) * (1 - more * s * (1 - lost))
    return 1 - lost


def tree_count(percent: int, recall: float = RECALL) -> int:
    """As many trees as the recall needs at the threshold itself, however many: 120 at 30 percent."""
    return math.ceil(math.log(1 - recall) / math.log(1 - meeting(percent, percent)))


@functools.lru_cache(4)
def orders(trees: int) -> np.ndarray:
    """The permutations of so many trees; those beyond ORDER are drawn each by its number."""
    more = [np.random.default_rng((SEED, t)).permutation(COORDS) for t in range(len(ORDER), trees)]
    return np.concatenate([ORDER, more]) if more else ORDER


def _children(tree: np.ndarray, node: np.ndarray, tokens: np.ndarray, level: int, more: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows and names of the children that documents (tree, node, tokens) move to: one each, and a second one in the
    share `more` of nodes."""
    at, names = [], []
    order = orders(1 << int(tree.max(initial=0)).bit_length())
    path = mix64(node ^ np.uint64(level + 1))
    first = (path % np.uint64(RUN)).astype(np.int64)
    for k in (0, 1):
        rows = np.arange(len(node)) if k == 0 else np.flatnonzero((path >> np.uint64(32)) % np.uint64(1 << 20) < more * (1 << 20))
        place = (first[rows] + k * (1 + ((path[rows] >> np.uint64(48)) % np.uint64(RUN - 1)).astype(np.int64))) % RUN
        coord = order[tree[rows], level * RUN + place]
        names.append(mix64(path[rows] ^ (tokens[rows, coord].astype(np.uint64) << np.uint64(8) | coord.astype(np.uint64))))
        at.append(rows)
    return np.concatenate(at), np.concatenate(names)


def _tokens(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(-1, COORDS)


def _roots(reps: DataFrame, trees: int, more: float) -> DataFrame:
    def branch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, tokens = batch.column(0).to_numpy(), _tokens(batch.column(1))
            for t in range(trees):
                tree = np.full(len(ids), t)
                at, node = _children(tree, mix64(np.full(len(ids), t, np.uint64)), tokens, 0, more)
                yield pa.RecordBatch.from_arrays([pa.array(tree[at], pa.int32()), pa.array(node.view(np.int64)), pa.array(ids[at])], ["tree", "node", "rep"])

    return reps.select("rep", "tokens").mapInArrow(branch, "tree int, node long, rep long")


def _branch(rows: DataFrame, level: int, more: float) -> DataFrame:
    """rows: tree, node, rep, tokens of large nodes."""

    def branch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            tree, node, ids = (batch.column(i).to_numpy() for i in range(3))
            at, names = _children(tree, node.view(np.uint64), _tokens(batch.column(3)), level, more)
            yield pa.RecordBatch.from_arrays([pa.array(tree[at], pa.int32()), pa.array(names.view(np.int64)), pa.array(ids[at])], ["tree", "node", "rep"])

    return rows.select("tree", "node", "rep", "tokens").mapInArrow(branch, "tree int, node long, rep long")


def _whole_groups(batches: Iterator[pd.DataFrame], key: list[str]) -> Iterator[pd.DataFrame]:
    """Frames that end where a group ends; batches come sorted by key."""
    rest = None
    for batch in batches:
        own = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
        if not len(own):
            continue
        last = (own[key] == own[key].iloc[-1]).all(axis=1).to_numpy()
        cut = len(own) - int(np.argmin(last[::-1])) if not last.all() else 0
        if cut:
            yield own.iloc[:cut].reset_index(drop=True)
        rest = own.iloc[cut:].reset_index(drop=True)
    if rest is not None and len(rest):
        yield rest


def _least_labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least index reachable from each of n places by links a-b."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        label = label[label]
        if (label == before).all():
            break
    return label


def _compare_leaves(rows: DataFrame, least: float, parts: int) -> DataFrame:
    """rows: node, rep, bits (a byte of each token), nodes of 2 to LEAF rows. Gives a, b: rep and a smaller one linked."""

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for own in _whole_groups(batches, ["node"]):
            node, rep = own["node"].to_numpy(), own["rep"].to_numpy()
            bits = np.frombuffer(b"".join(own["bits"]), np.uint8).reshape(-1, COORDS)
            a, b = [], []
            for k in range(1, LEAF):
                at = np.flatnonzero(node[:-k] == node[k:])
                if not len(at):
                    break
                for i in range(0, len(at), 8192):
                    part = at[i : i + 8192]
                    part = part[(bits[part] == bits[part + k]).sum(axis=1) >= least * COORDS]
                    a.append(part)
                    b.append(part + k)
            if a:
                label = _least_labels(len(rep), np.concatenate(a), np.concatenate(b))
                out = pd.DataFrame({"a": rep, "b": rep[label]})  # rows are sorted by rep within a node
                yield out[out["a"] != out["b"]].drop_duplicates()

    return rows.repartition(parts, "node").sortWithinPartitions("node", "rep").mapInPandas(compare, "a long, b long")


def candidate_links(reps: DataFrame, percent: int, recall: float = RECALL) -> DataFrame:
    """a, b: rows that connect every pair of similar documents, with high probability, among others; rows may repeat."""
    spark = reps.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    low = [F.substring("tokens", 4 * j + 1, 1) for j in range(COORDS)]
    bits = reps.select("rep", F.concat(*low).alias("bits"))
    more, least = second_share(percent), percent / 100 - SLACK
    rows, leaves, in_leaves, whole = saved(_roots(reps, tree_count(percent, recall), more), "branches-0"), [], 0, None
    for level in range(1, DEPTH + 2):
        count = saved(rows.groupBy("node").agg(F.count("*").alias("n"), F.min("rep").alias("least")).filter("n > 1"), f"nodes-{level}")
        is_large = F.col("n") > LEAF
        small_nodes, large_nodes, small_rows, large_rows = (x or 0 for x in count.agg(F.count_if(~is_large), F.count_if(is_large), F.sum(F.when(~is_large, F.col("n"))), F.sum(F.when(is_large, F.col("n")))).first())
        # Large nodes are few, one in LEAF rows at most; marked for broadcast if so few, their rows stay where they are.
        large = _sent(count.filter(is_large).select("node", "least"), large_nodes)
        few = rows if small_nodes <= BROADCAST_ROWS else rows.join(large, "node", "left_anti")
        leaves.append(saved(few.join(_sent(count.filter(~is_large).select("node"), small_nodes), "node").select("node", "rep"), f"leaves-{level}"))
        in_leaves += small_rows
        before = rows, count
        if large_nodes:
            deep = rows.join(large, "node")
            if level > DEPTH:
                whole = saved(deep.filter("rep <> least").select(F.col("rep").alias("a"), F.col("least").alias("b")).distinct(), "links-whole")
            else:  # a node's children have names of their own, so no row comes twice
                rows = saved(_branch(_sent(deep.select("tree", "node", "rep"), large_rows, GROUP_ROWS).join(reps.select("rep", "tokens"), "rep"), level, more), f"branches-{level}")
        discard(spark, *before)
        if not large_nodes:
            break
    # Nodes of all levels have names of their own and are compared together.
    small_sets = functools.reduce(DataFrame.unionByName, leaves)
    links = saved(_compare_leaves(_sent(small_sets, in_leaves, GROUP_ROWS).join(bits, "rep").select("node", "rep", "bits"), least, parts), "links")
    discard(spark, *leaves)
    return links if whole is None else links.unionByName(whole)


def connected_components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """id, least: the least id reachable by links (a, b; saved, rows may repeat), for every id in a link.

    Labels take the minimum over neighbours, then jump to their label's label, until the ends of every link agree. Joins
    and sums by key only: a hub's rows are combined before the shuffle or split by the join; labels so few that they can be
    broadcast go to the links, so that a round shuffles once. Each round is written to the shared folder.
    """
    spark = links.sparkSession
    ends = F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e")
    both = links.filter("a <> b").select(ends).select("e.*")
    once = None
    if links.count() > GROUP_ROWS:
        both = once = saved(both.distinct(), "cc-links")
    step = saved(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("least")).select(F.col("a").alias("id"), "least"), "cc-labels")
    n = step.count()
    for _ in range(rounds):
        jump = step.select(F.col("id").alias("least"), F.col("least").alias("next"))
        labels = saved(step.join(_sent(jump, n), "least").select("id", F.least("least", "next").alias("least")), "cc-labels")
        discard(spark, step)
        near = _sent(labels.select(F.col("id").alias("b"), "least"), n)
        met = both.join(near, "b").select("a", "least")
        if met.join(_sent(labels.select(F.col("id").alias("a"), F.col("least").alias("own")), n), "a").filter("least <> own").isEmpty():
            discard(spark, once)
            return labels
        step = saved(met.withColumnRenamed("a", "id").unionByName(labels).groupBy("id").agg(F.min("least").alias("least")), "cc-step")
        discard(spark, labels)
    raise RuntimeError("labels still move after all rounds")


def similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
        return False
    both = np.concatenate([x, y])
    both.sort()
    inter = int((both[1:] == both[:-1]).sum())
    return 100 * inter >= percent * (len(x) + len(y) - inter)


def _solve(rep: np.ndarray, sets: list[np.ndarray], percent: int, left: np.ndarray | None = None) -> np.ndarray:
    """Label of each member: the least index connected to it. left: pairs are compared only if one of them is in it."""
    n, label, size = len(rep), np.arange(len(rep)), np.array([len(s) for s in sets])
    together = n >= 8 and size.sum() <= TOGETHER  # else one by one, in memory that follows two sets
    if together:
        owner = np.repeat(label, size)
        known, code = np.unique(np.concatenate(sets), return_inverse=True)
        ends = np.cumsum(size)
        mark = np.zeros(len(known), bool)
    for j in range(n):
        other = label != label[j]
        if left is not None:
            other &= left != left[j]
        if together and other.any():
            own = code[ends[j] - size[j] : ends[j]]
            mark[own] = True
            both = np.bincount(owner[mark[code]], minlength=n)
            mark[own] = False
            hit = np.flatnonzero(other & (100 * both >= percent * (size + size[j] - both)))
        else:
            hit = (i for i in np.flatnonzero(other[:j]) if label[i] != label[j] and similar(sets[i], sets[j], percent))
        for i in hit:
            if label[i] != label[j]:
                lo, hi = sorted((label[i], label[j]))
                label[label == hi] = lo
    return label


def _confirm(rows: DataFrame, key: list[str], percent: int, parts: int, sided: bool = False) -> DataFrame:
    """rows: key columns, rep, hashes, and with `sided` side (true or false; only pairs of both sides count). Gives a, b:
    every member and the least one connected to it, itself included."""

    def confirm(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in _whole_groups(batches, key):
            for _, own in frame.groupby(key, sort=False):
                rep = own["rep"].to_numpy()
                sets = [np.frombuffer(x, np.uint64) for x in own["hashes"]]
                label = _solve(rep, sets, percent, own["side"].to_numpy() if sided else None)
                yield pd.DataFrame({"a": rep, "b": rep[label]})

    return rows.repartition(parts, *key).sortWithinPartitions(*key, "rep").mapInPandas(confirm, "a long, b long")


def confirmed(groups: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """id, least: exact components within candidate groups (id, least); docs: doc_id, text."""
    spark = groups.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    total = groups.count()
    n = groups.groupBy("least").agg(F.count("*").alias("n"))
    groups = saved(groups.join(_sent(n, total), "least").select(F.col("id").alias("rep"), F.col("least").alias("grp"), "n"), "groups")

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches, "text"):
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(3)), pa.array([s.tobytes() for s in shingle_sets(texts)], pa.binary())], ["rep", "grp", "n", "hashes"])

    few = _sent(groups, total, GROUP_ROWS)  # three numbers a row: texts stay where they are if these can go to them
    sets = few.join(docs, few["rep"] == docs["doc_id"]).select("rep", "grp", "n", "text").mapInArrow(hashes, "rep long, grp long, n long, hashes binary")
    sets = saved(sets, "shingle-sets")
    done = _confirm(sets.filter(f"n <= {CHUNK}").select("grp", "rep", "hashes"), ["grp"], percent, parts)
    large = sets.filter(f"n > {CHUNK}")
    if groups.filter(f"n > {CHUNK}").isEmpty():
        return done.select(F.col("a").alias("id"), F.col("b").alias("least"))

    # Chunks by a hash; each holds the group's pivots as well, those of its own once.
    chunks = F.ceil(F.col("n") / CHUNK).cast("long")
    turn = F.xxhash64(F.lit(SEED), "rep")
    large = saved(large.withColumn("chunk", F.pmod(turn, chunks)), "large-sets")
    pivot = large.select("grp", turn.alias("turn"), "rep").withColumn("k", F.row_number().over(Window.partitionBy("grp", F.pmod("turn", F.lit(97))).orderBy("turn", "rep"))).filter(f"k <= {PIVOTS}")
    pivot = pivot.groupBy("grp").agg(F.slice(F.sort_array(F.collect_list(F.struct("turn", "rep"))), 1, PIVOTS).alias("p"))  # 97 x PIVOTS at most
    pivot = pivot.select("grp", F.explode("p.rep").alias("rep"))
    pivot = _sent(pivot, total * PIVOTS // CHUNK)
    spread = large.join(pivot, ["grp", "rep"], "left_semi").withColumnRenamed("chunk", "own").withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), chunks - 1))).filter("chunk <> own")
    first = large.select("grp", "chunk", "rep", "hashes").unionByName(spread.select("grp", "chunk", "rep", "hashes"))
    links = saved(_confirm(first, ["grp", "chunk"], percent, parts), "large-links")
    label = connected_components(links)
    state = saved(large.select("grp", "rep").join(_sent(label, total), F.col("rep") == F.col("id"), "left").select("grp", "rep", F.coalesce("least", "rep").alias("least")), "large-labels")
    per = state.groupBy("grp", "least").agg(F.count("*").alias("size"))
    top = per.groupBy("grp").agg(F.max(F.struct("size", F.negate("least").alias("m"))).alias("t")).select("grp", F.negate("t.m").alias("main"))
    outside = saved(state.join(_sent(top, total), "grp").filter("least <> main").select("grp", "rep"), "outside")
    if not outside.isEmpty():
        # Blocks of outsiders against every chunk of the group.
        outside = saved(large.join(_sent(outside, total), ["grp", "rep"]), "outsiders")
        count = outside.groupBy("grp").agg(F.ceil(F.count("*") / CHUNK).cast("long").alias("blocks"))
        block = F.pmod(F.xxhash64(F.lit(SEED + 1), "rep"), F.col("blocks"))
        count = _sent(count, total)
        us = outside.join(count, "grp").withColumn("block", block).withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), chunks - 1)))
        all_ = large.join(count, "grp").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
        pairs = us.select("grp", "block", "chunk", "rep", "hashes", F.lit(True).alias("side")).unionByName(all_.select("grp", "block", "chunk", "rep", "hashes", F.lit(False).alias("side")))
        more = _confirm(pairs, ["grp", "block", "chunk"], percent, parts, sided=True).filter("a <> b")
        # What was found before counts by its labels.
        label = connected_components(saved(label.select(F.col("id").alias("a"), F.col("least").alias("b")).unionByName(more), "large-links"))
    alone = large.select("rep").join(_sent(label, total), F.col("rep") == F.col("id"), "left").select(F.col("rep").alias("id"), F.coalesce("least", "rep").alias("least"))
    return done.select(F.col("a").alias("id"), F.col("b").alias("least")).unionByName(alone)


def _near(docs: DataFrame, percent: int, recall: float) -> DataFrame:
    """doc_id, n_shingles, component_id of docs (doc_id, text), whose ids are unique."""
    spark = docs.sparkSession
    made = saved(sketches(docs, "doc_id", "text"), "sketches")
    reps = made.filter("digest IS NOT NULL").groupBy("digest").agg(F.min(F.struct("doc_id", "tokens")).alias("m"))
    reps = saved(reps.select("digest", F.col("m.doc_id").alias("rep"), F.col("m.tokens").alias("tokens")), "classes")
    groups = connected_components(candidate_links(reps.select("rep", "tokens"), percent, recall))
    exact = saved(confirmed(groups, docs, percent), "components")
    discard(spark, groups)
    named = reps.select("digest", "rep").join(small(exact), F.col("rep") == F.col("id"), "left").select("digest", F.coalesce("least", "rep").alias("component_id"))
    return made.select("doc_id", "n_shingles", "digest").join(named, "digest", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def near_duplicates(docs: DataFrame, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", recall: float = RECALL) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of docs.

    Documents are linked if 100 * |intersection| >= percent * |union| of their shingle sets; component_id is the least
    id reachable. recall: see above; each link among candidates is then confirmed on whole sets.
    Null texts and texts without words have no shingles and link with nothing, as do rows of a null id (component null,
    kept). Where ids repeat, rows are documents of their own, so one id may be in several components; each row has its
    own component's least id. Very long texts count whole, in memory that follows the longest text and set. Other columns
    are ignored; an empty table gives no rows.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    keyed, key = row_keyed(rows)
    if key == "doc_id":
        out = _near(rows, percent, recall)
    else:
        own = keyed.filter("doc_id IS NOT NULL")
        named = own.select(F.col(key).alias("row"), F.col("doc_id").alias("id"))
        found = _near(own.select(F.col(key).alias("doc_id"), "text"), percent, recall).withColumnsRenamed({"doc_id": "row", "component_id": "first"})
        found = found.join(named, "row").join(named.select(F.col("row").alias("first"), F.col("id").alias("component_id")), "first")
        alone = sketches(keyed.filter("doc_id IS NULL"), "doc_id", "text").select("doc_id", "n_shingles", F.lit(None).cast("long").alias("component_id"))
        out = found.select(F.col("id").alias("doc_id"), "n_shingles", "component_id").unionByName(alone)
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir), 85)
