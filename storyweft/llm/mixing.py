"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree. DataFrame and SQL functions only.

Each source's documents are dealt by a hash into a fixed number of blocks. Targets fix how many block draws each source
gives (whole passes over its blocks, then a part of one pass in a permuted order, the last block in part). A binary tree
over the output shards splits the draws of all sources: at each node the left half takes exactly half of the node's
draws, how many of them from each source being a multivariate-hypergeometric draw, taken source by source. A leaf thus
owns a run of every source's permuted draws; runs of different shards are disjoint. Rows are ordered by a hash within
their shard. Reruns agree: every random number is a hash of the seed and the place it is used in.

Sizes: shards follow the number of words mixed (SHARD_WORDS each), blocks the number of shards (BLOCKS_A_SHARD for each,
and BLOCKS at least), so that a shard's and a block's rows stay bounded. The table of blocks has sources x blocks rows, that
of the tree shards x sources. Tables are broadcast only after their rows are counted. Targets and tree are computed over
all sources at once: MAX_SOURCES is the most that mix() takes.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from storyweft.llm.common import SPACE, documents, saved, small

BLOCKS = 1024
BLOCKS_A_SHARD = 16
SHARD_WORDS = 1 << 24  # words that an output shard aims at, about 100 MB
LEVELS = 6  # 2^6 output shards at least
MAX_SOURCES = 100_000
SEED = 20240229


def word_count(text: Column) -> Column:
    """Number of words; 0 for null. Cutting at blanks makes one empty piece at a blank end."""
    blank = F.coalesce(text, F.lit("")) == ""
    pieces = F.size(F.split(text, f"{SPACE}+"))
    ends = F.when(text.rlike(f"^{SPACE}"), 1).otherwise(0) + F.when(text.rlike(f"{SPACE}\\z"), 1).otherwise(0)
    return F.when(blank, F.lit(0)).otherwise(pieces - ends).cast("long")


def source_key(source: Column) -> Column:
    """Sorts by code point, null last, and is never null."""
    return F.coalesce(F.concat(F.lit("s"), source), F.lit("t"))


def sized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", uid_col: str | None = None) -> DataFrame:
    """uid, doc_id, size, src, deal, turn: one row a document, written once. uid_col: a unique long of docs to be uid."""
    uid = F.monotonically_increasing_id() if uid_col is None else F.col(uid_col)
    rows = docs.select(uid.alias("uid"), F.col(id_col).alias("doc_id"), word_count(F.col(text_col)).alias("size"), source_key(F.col(source_col).cast("string")).alias("src"))
    rows = rows.withColumn("deal", F.xxhash64("doc_id", "size", F.lit(SEED))).withColumn("turn", F.xxhash64(F.lit(SEED + 1), "doc_id", "size"))
    return saved(rows, "mix-sized")


def targets(blocks: DataFrame, weights: tuple[float, ...] = (1, 2, 3), share: float = 1.0, cap: float = 3.0) -> DataFrame:
    """src, rank, source_size, target. Level L solves sum(min(cap_i, L * w_i)) = total: sources whose cap is reached
    first come first by cap / weight, and L follows from running sums at the first source that it does not cap."""
    s = blocks.groupBy("src").agg(F.sum("block_size").alias("source_size"))
    s = s.withColumn("rank", F.row_number().over(Window.orderBy("src")))
    every = Window.partitionBy()
    w = F.array(*[F.lit(float(x)) for x in weights])
    s = s.withColumn("w", F.element_at(w, (F.pmod(F.col("rank") - 1, F.lit(len(weights))) + 1).cast("int")))
    s = s.withColumn("top", F.col("source_size") * F.lit(float(cap))).withColumn("at", F.col("top") / F.col("w"))
    before = Window.orderBy("at", "rank").rowsBetween(Window.unboundedPreceding, -1)
    onward = Window.orderBy("at", "rank").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    left = F.sum("source_size").over(every) * F.lit(float(share)) - F.coalesce(F.sum("top").over(before), F.lit(0.0))
    s = s.withColumn("level", left / F.sum("w").over(onward))
    s = s.withColumn("level", F.min(F.when(F.col("level") <= F.col("at"), F.struct("at", "rank", "level"))).over(every)["level"])
    return s.select("src", "rank", "source_size", F.coalesce(F.least("top", F.col("w") * F.col("level")), "top").alias("target"))


def _split(counts: str, level: int) -> Column:
    """Counts of the left child: half of all, source by source from what is left of the node and of the half.

    One hypergeometric draw: k successes among n taken out of `rest` with q successes. Log-probabilities come from the
    ratio of neighbours; the first pass sums them (shifted by their maximum), the second finds the place of a uniform.
    """
    u = f"((xxhash64({SEED + 2}, {level}, node, x.rank) & 9007199254740991) / 9007199254740992D)"
    lo, hi = "greatest(0L, a.n - (a.rest - x.q))", "least(a.n, x.q)"
    step = "ln((x.q - k + 1D) * (a.n - k + 1D) / (k * (a.rest - x.q - a.n + k + 0D)))"
    lw = f"IF(k = {lo}, 0D, p.lw + {step})"
    one = f"aggregate(sequence({lo}, {hi}), struct(0D AS lw, 0D AS m, 0D AS s), (p, k) -> struct({lw} AS lw, greatest(p.m, {lw}) AS m, p.s * exp(p.m - greatest(p.m, {lw})) + exp({lw} - greatest(p.m, {lw})) AS s))"
    two = f"aggregate(sequence({lo}, {hi}), struct(0D AS lw, 0D AS c, CAST(NULL AS BIGINT) AS pick), (p, k) -> struct({lw} AS lw, p.c + exp({lw} - z.m) / z.s AS c, coalesce(p.pick, IF(p.c + exp({lw} - z.m) / z.s >= {u}, k, NULL)) AS pick), p -> coalesce(p.pick, {hi}))"
    draw = f"element_at(transform(array({one}), z -> {two}), 1)"
    total = f"aggregate({counts}, 0L, (t, x) -> t + x.q)"
    return F.expr(
        f"aggregate({counts}, struct({total} AS rest, CAST(floor({total} / 2) AS BIGINT) AS n, CAST(array() AS array<struct<rank:int,q:bigint>>) AS out),"
        f" (a, x) -> element_at(transform(array({draw}), d -> struct(a.rest - x.q AS rest, a.n - d AS n, array_append(a.out, struct(x.rank AS rank, d AS q)) AS out)), 1), a -> a.out)"
    )


def splitting_tree(quotas: DataFrame, levels: int = LEVELS) -> DataFrame:
    """rank, shard, first, until: each shard's run of every source's draws. quotas: rank, q."""
    node = quotas.agg(F.sort_array(F.collect_list(F.struct("rank", F.col("q").cast("long").alias("q")))).alias("counts"))
    node = node.withColumn("node", F.lit(0))
    for level in range(levels):
        if level and level % 6 == 0:
            node = node.repartition(1 << min(level, 12), "node")  # deep trees are split by many tasks
        node = node.withColumn("left", _split("counts", level))
        right = F.expr("zip_with(counts, left, (x, y) -> struct(x.rank AS rank, x.q - y.q AS q))")
        node = node.select(F.col("node"), F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("left").alias("c")), F.struct(F.lit(1).alias("side"), right.alias("c")))).alias("e"))
        node = node.select((F.col("node") * 2 + F.col("e.side")).alias("node"), F.col("e.c").alias("counts"))
    leaves = node.select(F.col("node").alias("shard"), F.explode("counts").alias("c")).select("shard", F.col("c.rank").alias("rank"), F.col("c.q").alias("q"))
    until = F.sum("q").over(Window.partitionBy("rank").orderBy("shard").rowsBetween(Window.unboundedPreceding, 0))
    return leaves.withColumn("until", until).withColumn("first", F.col("until") - F.col("q")).filter("q > 0").drop("q")


def block_draws(blocks: DataFrame, plan: DataFrame, levels: int = LEVELS) -> DataFrame:
    """src, block, epoch, shard, room: a row for each draw of a block; room is the words to take of a block that is
    drawn in part, else null. plan: the table of targets."""
    order = Window.partitionBy("src").orderBy(F.xxhash64(F.lit(SEED + 3), "src", "block"), "block")
    b = blocks.join(small(plan), "src")
    b = b.withColumn("place", F.row_number().over(order) - 1)
    b = b.withColumn("seen", F.sum("block_size").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    b = b.withColumn("n_blocks", F.count("*").over(Window.partitionBy("src")))
    b = b.withColumn("passes", F.when(F.col("source_size") > 0, F.floor(F.round("target") / F.col("source_size"))).otherwise(0))
    b = b.withColumn("extra", F.round("target").cast("long") - F.col("passes") * F.col("source_size"))
    start = F.col("seen") - F.col("block_size")
    room = F.when((start < F.col("extra")) & (F.col("seen") > F.col("extra")), F.col("extra") - start)
    b = b.withColumn("draws", F.col("passes") + F.when((F.col("block_size") > 0) & (start < F.col("extra")), 1).otherwise(0))
    b = b.filter("draws > 0").withColumn("epoch", F.explode(F.expr("sequence(0L, draws - 1)")))
    b = b.withColumn("room", F.when(F.col("epoch") == F.col("passes"), room)).withColumn("turn", F.col("epoch") * F.col("n_blocks") + F.col("place"))
    # Draws are numbered without gaps in the order of their turns.
    b = b.withColumn("draw", F.row_number().over(Window.partitionBy("src").orderBy("turn")) - 1)
    b = saved(b.select("src", "rank", "block", "epoch", "room", "draw"), "mix-draws")
    tree = splitting_tree(b.groupBy("rank").agg(F.count("*").alias("q")), levels)
    tree = saved(tree, "mix-tree")
    # A draw's shard is that of the last run that starts at or before it: runs and draws in one order, the last start carried on.
    both = b.withColumn("shard", F.lit(None).cast("int")).unionByName(tree.select("rank", F.col("first").alias("draw"), F.col("shard").cast("int").alias("shard")), allowMissingColumns=True)
    carried = Window.partitionBy("rank").orderBy("draw", F.col("src").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    both = both.withColumn("shard", F.last("shard", ignorenulls=True).over(carried)).filter("src IS NOT NULL")
    return both.select("src", "block", "epoch", "room", "shard")


def mix(docs: DataFrame, weights: tuple[float, ...] = (1, 2, 3), share: float = 1.0, cap: float = 3.0, levels: int | None = None, **columns) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, plan, mixed): the sized documents, the sources' targets, and a row for each taking of a document with
    uid, shard, position key and take (words; less than the size only where a source's quota ends).

    Null texts and texts of blanks have size 0 and are never taken; a null source is a source of its own, sorted last.
    Repeated rows are documents of their own. An empty table gives empty results. The quota is met exactly, rounded to
    a word. A document is taken once in each whole pass and at most once more. Very long texts are taken whole but for
    the cut at a quota's end; other columns are ignored. levels: 2^levels output shards, by default from the words.
    """
    rows = sized(docs, **columns)
    words, sources = rows.agg(F.sum("size"), F.countDistinct("src")).first()
    if sources > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    if levels is None:
        levels = max(LEVELS, math.ceil(math.log2(max(1, (words or 0) * share / SHARD_WORDS))))
    n_blocks = max(BLOCKS, BLOCKS_A_SHARD << levels)
    rows = rows.withColumn("block", F.pmod("deal", F.lit(n_blocks)).cast("int")).drop("deal")
    blocks = saved(rows.groupBy("src", "block").agg(F.sum("size").alias("block_size")), "mix-blocks")
    plan = saved(targets(blocks, weights, share, cap), "mix-targets")
    draws = saved(block_draws(blocks, plan, levels), "mix-shards")
    mixed = rows.filter("size > 0").select("uid", "doc_id", "size", "src", "block", "turn").join(draws, ["src", "block"])
    whole = mixed.filter("room IS NULL").withColumn("take", F.col("size"))
    inside = Window.partitionBy("src", "block").orderBy("turn", "uid").rowsBetween(Window.unboundedPreceding, 0)
    cut = mixed.filter("room IS NOT NULL").withColumn("end", F.sum("size").over(inside))  # one block of each source, 1 / n_blocks of it
    cut = cut.withColumn("take", F.least("size", F.col("room") - F.col("end") + F.col("size"))).filter("take > 0").drop("end")
    mixed = whole.unionByName(cut).withColumn("position", F.xxhash64(F.lit(SEED + 4), "shard", "uid", "epoch"))
    return rows, plan, mixed.select("uid", "doc_id", "size", "epoch", "shard", "position", "take", F.lit(1 << levels).alias("shards"))


def mixture(docs: DataFrame, mixed: DataFrame, id_col: str = "doc_id", text_col: str = "text", key: str = "doc_id") -> DataFrame:
    """docs' columns and shard: a row for each taking, cut after `take` words, in shuffled order within each shard.

    id_col of docs meets `key` of mixed (doc_id, or uid where mix() had a uid_col); its values must be unique. A column
    of docs called shard is replaced. Write with partitionBy("shard") for a folder each.
    """
    head = mixed.select("shards").first()
    names = [c for c in docs.columns if c != "shard"]
    m = mixed.select(F.struct(F.col(key).alias("id"), "shard", "position", "take", "size").alias("__m"))
    out = docs.select(*[F.col(f"`{c}`") for c in names]).join(m, F.col(id_col) == F.col("__m.id"))
    text = F.when(F.col("__m.take") < F.col("__m.size"), first_words(F.col(text_col), F.col("__m.take"))).otherwise(F.col(text_col))
    out = out.withColumn(text_col, text).repartitionById(head.shards if head else 1, F.col("__m.shard").cast("int")).sortWithinPartitions("__m.shard", "__m.position")
    return out.select(*[F.col(f"`{c}`") for c in names], F.col("__m.shard").alias("shard"))


def first_words(text: Column, n: Column) -> Column:
    """The text up to the end of its n-th word."""
    return F.array_join(F.slice(F.regexp_extract_all(text, F.lit(f"({SPACE}*[^\\x20\\x09-\\x0D]+)"), F.lit(1)), F.lit(1), n.cast("int")), "")


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, plan, mixed = mix(documents(spark, sf_dir))
    none = rows.select("uid", "doc_id", "size", "src", F.lit(0).cast("long").alias("take"))
    keyed = mixed.select("uid", "doc_id", "size", F.lit(None).cast("string").alias("src"), "take")
    taken = none.unionByName(keyed).groupBy("uid").agg(F.max("doc_id").alias("doc_id"), F.max("size").alias("size"), F.max("src").alias("src"), F.sum("take").alias("taken"))
    return taken.join(small(plan), "src").select("doc_id", "size", "source_size", "target", "taken")
