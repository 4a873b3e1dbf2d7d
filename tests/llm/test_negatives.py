"""Hard negatives against full sorts, and top-k answers that do not depend on where rows lie."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from storyweft.llm import negatives, queries, topk

from .. import oracle

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, is_anchor, positives=5, negatives_=10, lowest=30, highest=90):
    """rows: (id, label, whole components as Python ints)."""
    anchors = {}
    for i, label, v in rows:
        if is_anchor(i):
            anchors[i] = min(anchors.get(i, (label, v)), (label, v))
    out = []
    for a, (label, v) in anchors.items():
        s = sorted((-sum(x * y for x, y in zip(v, w)), i, other == label) for i, other, w in rows if i != a)
        for p, pid, _ in [x for x in s if x[2]][:positives]:
            near = [(n, i) for n, i, same in s if not same and lowest * -p <= 100 * -n <= highest * -p][:negatives_]
            out += [(a, pid, rank, i, -p, -n) for rank, (n, i) in enumerate(near, 1)]
    return sorted(out)


def whole(rows, scale=256):
    good = lambda v: v is not None and all(x is not None and math.isfinite(x) for x in v)
    return [(i, label, [math.floor(scale * float(np.float32(x))) for x in v]) for i, v, label in rows if i is not None and label is not None and good(v)]


def mined(df, is_anchor, **how):
    rows = topk.integral(df.filter("label IS NOT NULL"), scale=256.0, keep=("label",))
    return sorted(tuple(r) for r in negatives.hard_negatives(rows, rows.filter(is_anchor), **how).collect())


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    out = [(i, [rng.choice([0.0, 0.25, -0.5, 1.0, rng.uniform(-1, 1)]) for _ in range(6)], rng.randint(0, 3)) for i in range(260)]
    out += [(400 + i, [0.5] * 6, i % 2) for i in range(80)]  # ties
    out += [(20, [1.0] * 6, 1), (20, [0.75] * 6, 0), (21, out[21][1], out[21][2]), (500, [1.0, 2.0], 2), (501, None, 1), (502, [1.0, None, 0.5], 1), (503, [float("nan")] * 6, 1), (504, [1.0] * 6, None), (None, [1.0] * 6, 1), (520, [], 1)]
    return out


@pytest.mark.parametrize("block, chunk", [(1024, 48 << 20), (2, 8 * 6 * 37)])
def test_brute_force(spark, rows, monkeypatch, block, chunk):
    monkeypatch.setattr(negatives, "BLOCK", block)
    monkeypatch.setattr(negatives, "CHUNK_BYTES", chunk)
    df = spark.createDataFrame(rows, SCHEMA)
    for c in ("v", "len2", "anchor_id", "rank", "p"):
        df = df.withColumn(c, F.lit("x"))
    want = brute(whole(rows), lambda i: i % 20 == 0)
    assert mined(df.repartition(5), "vec_id % 20 = 0") == want
    assert mined(df.coalesce(1), "vec_id % 20 = 0", positives=2, negatives=3, lowest=-10, highest=100) == brute(whole(rows), lambda i: i % 20 == 0, 2, 3, -10, 100)


def test_great_scores(spark):
    """Products beyond doubles, and beyond what 100 times a score leaves of 64 bits."""
    rows = [(i, [float(x) for x in v], i % 2) for i, v in enumerate([[2**21, 3, 1], [2**21, 2**20, 1], [2**19 + 1, 5, 7], [2**21, 2, 2**10], [2**20, 2**20, 2**20], [1, 2**21, 3]])]
    assert mined(spark.createDataFrame(rows, SCHEMA), "true") == brute(whole(rows), lambda i: True)
    s = np.array([-3, -1, 0, 1, 7, 99, 100, 101, 2**62 + 12345, -(2**62)])
    low, high = negatives.limits(s)
    assert low.tolist() == [-(-30 * int(x) // 100) for x in s] and high.tolist() == [90 * int(x) // 100 for x in s]


def test_nothing(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    assert mined(df.limit(0), "true") == [] and mined(df, "false") == []
    assert mined(df.filter("vec_id IN (501, 502, 503, 504) OR vec_id IS NULL"), "true") == []
    assert mined(spark.createDataFrame([(0, [1.0], 0), (1, [1.0], 1)], SCHEMA), "true") == []


def test_whole_table(spark, sf_dir):
    oracle.same(queries.QUERIES["op13_hard_negatives"](spark, sf_dir), negatives.OP13_SQL, oracle.connect(sf_dir))


def test_top_k_of_repeated_queries(spark, rows):
    """The same rows in one partition, and in three in reverse order, give the same answers."""
    def top(order, parts):
        df = topk.integral(spark.createDataFrame(order, SCHEMA).repartition(parts) if parts > 1 else spark.createDataFrame(order, SCHEMA).coalesce(1), scale=64.0)
        return sorted(tuple(r) for r in topk.top_k(df, df.filter("vec_id % 20 = 0"), 7).collect())

    one = top(rows, 1)
    assert one == top(rows[::-1], 3)
    own = [(i, [math.floor(64 * float(np.float32(x))) for x in v]) for i, v, _ in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    query = min(v for i, v in own if i == 20)
    want = sorted((-sum(x * y for x, y in zip(query, v)), i) for i, v in own if i != 20)[:7]
    assert [r[1:] for r in one if r[0] == 20] == [(rank, i, -s) for rank, (s, i) in enumerate(want, 1)]
