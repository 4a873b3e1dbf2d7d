"""Decontamination against plain loops over words."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from storyweft.llm import common, decontam, queries

from .. import oracle

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def brute(docs, items, length=10):
    """(n_words, hit places, items as text) of each text."""
    known = []
    for item, text in items:
        w = words(text)
        n = min(length, len(w))
        known += [(tuple(w[i : i + n]), item) for i in range(len(w) - n + 1 if n else 0)]
    out = []
    for t in docs:
        w, hit, named = words(t), set(), set()
        for window, item in known:
            for i in range(len(w) - len(window) + 1):
                if tuple(w[i : i + len(window)]) == window:
                    hit |= set(range(i, i + len(window)))
                    named |= set() if item is None else {str(item)}
        out.append((len(w), hit, sorted(named)))
    return out


ITEM = "Alpha beta, gamma delta epsilon zeta eta theta iota kappa lambda mu."
ITEMS = [(1, ITEM), (2, "short Item-here"), (3, None), (4, ""), (10, ITEM.upper()), (None, "nameless item of benchmark"), (5, "été à 12 février"), (1, "another text of item one which has more than ten words in it")]
TEXTS = [
    None, "", " \n", "nothing here", f"Before.\n{ITEM}  After it short\titem HERE!", "alpha beta gamma delta epsilon zeta eta theta iota", "ALPHA-beta gamma delta epsilon zeta eta theta iota kappa",
    "short item", "here short item", "the nameless item of benchmark, été à 12 février", "beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu " * 3, "short item here short item here", "alpha " * 70_000 + ITEM,
]


@pytest.fixture(scope="module")
def odd(spark):
    df = spark.createDataFrame([(i if i != 3 else None, t, "x") for i, t in enumerate(TEXTS)] + [(5, TEXTS[4], "y")], "doc_id long, text string, source string")
    for c in ("n_words", "spans", "items", "row", "doc", "key", "n_hit", "window"):
        df = df.withColumn(c, F.lit("x"))
    return df


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame(ITEMS, "item_id long, text string")


def test_whole_table(spark, sf_dir):
    oracle.same(queries.QUERIES["op11_decontamination"](spark, sf_dir), decontam.OP11_SQL, oracle.connect(sf_dir))


@pytest.mark.parametrize("block_bytes", [decontam.BLOCK_BYTES, 300])
def test_blocks_and_brute_force(odd, items, block_bytes):
    got = decontam.contamination(odd.select("doc_id", "text"), items, block_bytes=block_bytes).collect()
    texts = [*TEXTS, TEXTS[4]]
    want = sorted((n, sorted(hit), named) for n, hit, named in brute(texts, ITEMS))
    assert sorted((r.n_words, [p for s in r.spans for p in range(s["first"], s["first"] + s["words"])], r["items"]) for r in got) == want
    assert all(r.n_hit == sum(s["words"] for s in r.spans) for r in got)


@pytest.mark.parametrize("block_bytes", [decontam.BLOCK_BYTES, 300])
def test_removal(odd, items, block_bytes):
    kept = decontam.decontaminate(odd, items, "documents", block_bytes=block_bytes)
    assert kept.columns == odd.columns
    clean = [t for t, (_, hit, _) in zip(TEXTS, brute(TEXTS, ITEMS)) if not hit]
    assert sorted(str(r.text) for r in kept.collect()) == sorted(map(str, clean))
    cut = decontam.decontaminate(odd, items, block_bytes=block_bytes)
    assert cut.columns == odd.columns and cut.count() == len(TEXTS) + 1
    left = {r.text for r in cut.collect()}
    assert {None, "", " \n", "nothing here", "Before.\n.  After it !", "the ", "short item", "here short item", "alpha " * 70_000 + ".", "alpha beta gamma delta epsilon zeta eta theta iota"} <= left
    assert not any(t and "iota kappa" in t for t in left)
    mostly = decontam.decontaminate(odd, items, "documents", share=0.9, block_bytes=block_bytes)
    assert {len(words(r.text)) for r in mostly.collect()} == {n for n, hit, _ in brute(TEXTS, ITEMS) if len(hit) <= 0.9 * n}
    with pytest.raises(ValueError):
        decontam.decontaminate(odd, items, "words")


def test_empty(odd, items):
    assert decontam.decontaminate(odd.limit(0), items).count() == 0
    assert decontam.decontaminate(odd, items.limit(0)).count() == odd.count()
    assert decontam.decontaminate(odd.select("text"), items, "documents").columns == ["text"]


def test_equal_hashes_are_verified(spark, monkeypatch):
    """All hashes alike: only equal words count."""
    monkeypatch.setattr(decontam, "rolled", lambda h, n: h[: max(0, len(h) - n + 1)] * 0)
    import numpy as np
    import pyarrow as pa

    known = decontam.WindowSet(pa.table({"window": [b"a b", b"c d", b"e f"], "item": ["1", "2", "3"]}))
    buffer = b"a b c d f e"
    hashes, places = common.hash_words(buffer)
    first, length, which = decontam.hits(known, buffer, hashes, places, np.full(6, 6), {})
    assert first.tolist() == [0, 2] and length.tolist() == [2, 2] and [known.windows[i] for i in which] == [b"a b", b"c d"]
