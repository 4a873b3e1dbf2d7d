"""Corpus operators against brute force, exact round trips and held-out labels."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from storyweft.llm import common, eliasfano, langid, lines, media, mixing, neardup, ngramlm, packing, quality, queries, tokenfiles, tokens, topk

from .. import oracle

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def low(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return common.documents(spark, sf_dir).toPandas()


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, blanks, long and repeated texts, and columns whose names the operators use inside."""
    long = "word " * 60_000
    rows = [
        (1, None, None, None), (2, "", "en", "a"), (3, " \t\n ", "en", "a"), (4, long, "de", "b"), (5, long, "de", "b"), (6, "One two three four five six. \nA repeated line here\nÉ", "en", None),
        (7, "one two three four five six. \n a repeated line here \n", None, "b"), (8, "12 34 --", "en", "a"), (8, "12 34 --", "en", "a"), (None, "no id but words enough for a shingle", "en", "a"),
    ]
    df = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    for c in ("size", "key", "n_lines", "score", "tokens", "shard", "label", "take", "uid", "weight", "held_out", "id", "row"):
        df = df.withColumn(c, F.lit("x"))
    return df


@pytest.fixture(scope="module")
def empty(odd):
    return odd.limit(0)


def test_oracles(spark, sf_dir):
    con = oracle.connect(sf_dir)
    for name, sql in queries.ORACLE.items():
        oracle.same(queries.QUERIES[name](spark, sf_dir), sql, con)


# 1 -------------------------------------------------------------------------------------------------------------------


def test_language_id(spark, sf_dir, docs):
    got = queries.QUERIES["op1_language_id"](spark, sf_dir).toPandas().set_index("doc_id")
    assert len(got) == len(docs)
    out = got[got.held_out]
    assert set(out.index) == {i for i in docs.doc_id if zlib.crc32(str(i).encode()) % 4 == 2}
    truth = docs.set_index("doc_id").lang
    assert (out.lang_pred == truth[out.index]).mean() > 0.97
    assert got.score.between(0, 1).all()


def test_language_id_by_hand(spark):
    """Naive Bayes by counting n-grams as text; 2^22 buckets leave next to no collisions."""
    texts = [("en", "the cat and the dog"), ("en", "a dog sat on the mat"), ("de", "der hund und die katze"), ("de", "ein hund lag auf der matte"), ("fr", "le chat et le chien")]
    df = spark.createDataFrame(texts, "lang string, text string")
    model = langid.LanguageModel.fit(df, bits=22)
    grams = lambda t: [f" {t} "[i : i + n] for n in langid.ORDERS for i in range(len(t) + 3 - n)]
    counts = {x: Counter(g for lang, t in texts if lang == x for g in grams(t)) for x in ("de", "en", "fr")}
    for t in ("the dog", "der hund", "chat", "katze on mat"):
        want = [math.log(sum(x == lang for x, _ in texts) / 5) + sum(math.log((c[g] + 0.5) / (sum(c.values()) + 0.5 * 2**22)) for g in grams(t)) for lang, c in counts.items()]
        assert model.labels == ["de", "en", "fr"] and np.allclose(model.scores([t])[0], want, atol=1e-3)


def test_gram_counts_by_hand():
    codes, starts = langid.gram_codes(["ab", "b"], orders=(1, 2), bits=10)
    one, two = codes
    assert starts.tolist() == [0, 4] and len(one) == 7
    assert one[2] == one[5] and two[3] == two[6] == 1 << 10 and two[2] == two[5]  # "b " in both texts; none across


def test_language_id_odd(odd, empty):
    model = langid.LanguageModel.fit(odd.filter("lang is not null"))
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.identify(odd, model).collect()}
    assert got[1] == got[2] == got[3] == got[8] == ("und", 0.0)
    assert got[4][0] == "de"
    signs = odd.sparkSession.createDataFrame([(1, "²³"), (2, "½ 12"), (3, "①"), (4, "Ⅷ ʰ")], "doc_id long, text string")
    assert {r.doc_id: r.lang_pred == "und" for r in langid.identify(signs, model).collect()} == {1: True, 2: True, 3: True, 4: False}
    none = langid.LanguageModel.fit(empty)
    assert none.labels == [] and langid.identify(empty, none).count() == 0
    assert {r.lang_pred for r in langid.identify(odd, none).collect()} == {"und"}


# 2 -------------------------------------------------------------------------------------------------------------------


def fill(sizes, weights):
    """Targets by repeated resharing."""
    total, target, free = float(sum(sizes)), [0.0] * len(sizes), set(range(len(sizes)))
    rest = total
    while free:
        w = sum(weights[i] for i in free)
        over = {i for i in free if rest * weights[i] / w > 3 * sizes[i] + 1e-9}
        if not over:
            for i in free:
                target[i] = rest * weights[i] / w
            break
        for i in over:
            target[i] = 3.0 * sizes[i]
        rest -= sum(target[i] for i in over)
        free -= over
    return target


def test_mixing(spark, sf_dir, docs):
    got = queries.QUERIES["op2_mixing"](spark, sf_dir).toPandas().set_index("doc_id")
    again = queries.QUERIES["op2_mixing"](spark, sf_dir).toPandas().set_index("doc_id")
    assert (got.taken.sort_index() == again.taken.sort_index()).all()
    size = {d: len(WORD.findall(t or "")) for d, t in zip(docs.doc_id, docs.text)}
    assert got["size"].to_dict() == size
    names = sorted(docs.source.unique())
    by = docs.assign(size=docs.doc_id.map(size), taken=docs.doc_id.map(got.taken)).groupby("source")[["size", "taken"]].sum()
    want = fill([by["size"][s] for s in names], [1 + i % 3 for i in range(len(names))])
    for s, t in zip(names, want):
        assert by.taken[s] == pytest.approx(t, abs=1)
        assert got.target[docs.doc_id[docs.source == s]].iloc[0] == pytest.approx(t, rel=1e-9)
    assert (got.taken <= 3 * got["size"]).all()


def test_mixing_odd(odd, empty):
    rows, plan, mixed = mixing.mix(odd)
    assert rows.count() == 10 and {r.src: r.rank for r in plan.collect()} == {"sa": 1, "sb": 2, "t": 3}
    sizes = {r.src: (r.source_size, r.target) for r in plan.collect()}
    want = fill([sizes[k][0] for k in ("sa", "sb", "t")], [1, 2, 3])
    assert [sizes[k][1] for k in ("sa", "sb", "t")] == pytest.approx(want)
    assert mixed.agg(F.sum("take")).first()[0] == pytest.approx(sum(want), abs=3)
    assert mixing.mix(empty)[2].count() == 0


def test_splitting_tree(spark):
    q = [5000, 1, 0, 700, 3072]
    leaves = mixing.splitting_tree(spark.createDataFrame(list(enumerate(q)), "rank int, q long"), 4).toPandas()
    n = leaves.until - leaves["first"]
    assert n.groupby(leaves["rank"]).sum().to_dict() == {i: x for i, x in enumerate(q) if x}
    per = n.groupby(leaves.shard).sum()
    assert per.max() - per.min() <= 1
    big = n[leaves["rank"] == 0]
    mean = q[0] / 16
    assert abs(big - mean).max() < 6 * math.sqrt(mean * (1 - q[0] / sum(q)))  # spread of a hypergeometric draw
    for _, own in leaves.sort_values("shard").groupby("rank"):
        assert (own["first"].to_numpy()[1:] == own.until.to_numpy()[:-1]).all()


def test_mixture_rows(spark, docs):
    d = spark.createDataFrame(docs[["doc_id", "text", "source"]])
    rows, plan, mixed = mixing.mix(d)
    out = mixing.mixture(d, mixed).toPandas()
    words = out.text.map(lambda t: len(WORD.findall(t)))
    assert words.sum() == mixed.agg(F.sum("take")).first()[0]
    texts = docs.set_index("doc_id").text
    assert all(texts[i].startswith(t) for i, t in zip(out.doc_id, out.text))


def test_mixture_shards_follow_the_words(spark, docs, monkeypatch):
    monkeypatch.setattr(mixing, "SHARD_WORDS", 400)
    d = spark.createDataFrame(docs[["doc_id", "text", "source"]])
    rows, plan, mixed = mixing.mix(d)
    n = mixed.agg(F.sum("take")).first()[0]
    shards = mixed.select("shards").first()[0]
    assert shards == 1 << math.ceil(math.log2(n / 400)) > 64
    got = mixed.groupBy("shard").agg(F.count("*").alias("n")).toPandas()
    assert got.shard.between(0, shards - 1).all()
    want = plan.agg(F.sum(F.round("target"))).first()[0]
    assert n == want
    out = mixing.mixture(d, mixed)
    assert out.select("shard").distinct().count() == len(got) and out.count() == mixed.count()
    with monkeypatch.context() as few:
        few.setattr(mixing, "MAX_SOURCES", 1)
        with pytest.raises(ValueError):
            mixing.mix(d)


# 3, 9 ----------------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def ids(docs):
    t = Tokenizer.from_file(tokens.default_tokenizer())
    return {d: x.ids for d, x in zip(docs.doc_id, t.encode_batch([x or "" for x in docs.text], add_special_tokens=False))}


def crc(x):
    return zlib.crc32(np.array(x, "<u4").tobytes())


def test_token_files(spark, sf_dir, ids):
    got = queries.QUERIES["op3_token_files"](spark, sf_dir).toPandas().sort_values("doc_id")
    start = 0
    for r in got.itertuples():
        own = [*ids[r.doc_id], 2]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(own), crc(own))
        start += len(own)


def test_token_files_odd(spark, odd, empty):
    out = common.work_dir(spark, "t")
    m = tokenfiles.write_token_files(odd, out, segment_bytes=1000)
    got = tokenfiles.read_token_files(m, out).toPandas()
    assert len(got) == 10 and got.start.min() == 0 and got.n_tokens.sum() == got.start.max() + got.n_tokens[got.start.idxmax()]
    assert tokenfiles.token_ids(m, out, 1).tolist() == [2] and tokenfiles.token_ids(m, out, 999).tolist() == []
    assert tokenfiles.token_ids(m, out, 6).tolist() == tokens.WordEncoder(tokens.default_tokenizer()).tokenizer.encode("One two three four five six. \nA repeated line here\nÉ", add_special_tokens=False).ids + [2]
    out = common.work_dir(spark, "t")
    assert tokenfiles.read_token_files(tokenfiles.write_token_files(empty, out), out).count() == 0


def test_encoder_equals_the_library():
    import random

    rng = random.Random(4)
    e = tokens.WordEncoder(tokens.default_tokenizer(), limit=50)
    alphabet = "aBc 's't'll d\n\t ́éİΣσœ\x1c\x85​中Ⅰǅ!$9_-Ω̈<|endoftext|>\U0001f600"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40))) for _ in range(2000)] + ["a<|endoftext|>b", "It's DON'T"]
    want = e.tokenizer.encode_batch(texts, add_special_tokens=False)
    for i in range(0, len(texts), 50):
        for x, b in zip(want[i : i + 50], e.encode([t.encode() for t in texts[i : i + 50]])):
            assert np.frombuffer(b, e.dtype).tolist() == x.ids


def test_packing(spark, sf_dir, ids):
    got = queries.QUERIES["op9_packing"](spark, sf_dir).toPandas()
    for d, own in got.sort_values("piece").groupby("doc_id"):
        full = [*ids[d], 0]
        assert own.piece.tolist() == list(range(len(own))) and own.length.sum() == len(full)
        assert (own.length.iloc[:-1] == 2048).all()
        for r in own.itertuples():
            assert r.start == 2048 * r.piece and r.ids_crc32 == crc(full[r.start : r.start + r.length])
    own = got.sort_values(["sequence_id", "offset"])
    g = own.groupby("sequence_id").length
    assert (g.cumsum() - own.length == own.offset).all() and g.sum().max() <= 2048
    assert got.sequence_id.nunique() <= math.ceil(got.length.sum() / 2048) + 2


def test_best_two_fit():
    rng = np.random.default_rng(0)
    for high in (30, 60, 100):
        n = rng.integers(1, high + 1, 400)
        bins, offsets = packing.best_two_fit(n, 100)
        used = np.bincount(bins, n)
        assert used.max() <= 100 and sorted(set(bins)) == list(range(bins.max() + 1))
        order = np.sort(n)[::-1].tolist()
        plain: list[int] = []  # first fit by descending length
        for x in order:
            k = next((i for i, u in enumerate(plain) if u + x <= 100), None)
            plain.append(x) if k is None else plain.__setitem__(k, plain[k] + x)
        assert len(used) <= len(plain) + 1
    assert len(packing.best_two_fit(np.empty(0, np.int64), 100)[0]) == 0


def plain_best_two_fit(lengths, capacity):
    """The rule by scanning lists: fill with the longest that fits; then two open pieces may replace the smallest."""
    left, bins = sorted(lengths), []
    while left:
        own = [left.pop()]
        while (fits := [x for x in left if x <= capacity - sum(own)]):
            own.append(max(fits))
            left.remove(own[-1])
        gap = capacity - sum(own)
        if gap and left and len(own) > 1:
            pairs = [(x + y, x, y) for i, x in enumerate(left) for y in left[i + 1 :] if own[-1] < x + y <= gap + own[-1]]
            if pairs:
                total = max(p[0] for p in pairs)
                _, x, y = min((p for p in pairs if p[0] == total), key=lambda p: p[1])
                small = own.pop()
                own += [y, x]
                left.remove(x)
                left.remove(y)
                left = sorted([*left, small])
        bins.append(own)
    return bins


def test_best_two_fit_by_hand():
    rng = np.random.default_rng(1)
    for _ in range(40):
        n = rng.integers(1, 61, 60)
        bins, _ = packing.best_two_fit(n, 100)
        assert sorted(sorted(n[bins == b].tolist()) for b in set(bins)) == sorted(map(sorted, plain_best_two_fit(n.tolist(), 100)))


def test_packing_odd(spark, odd, empty):
    packed = packing.pack(packing.token_pieces(odd))
    assert packed.count() >= 10 and packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).agg(F.max("n")).first()[0] <= 2048
    assert packing.pack(packing.token_pieces(empty)).count() == 0
    some = odd.filter("doc_id in (1, 4, 6)")
    packed = packing.pack(packing.token_pieces(some))
    seq = {r.sequence_id: r.ids for r in packing.sequences(some, packed).collect()}
    for r in packed.collect():
        assert crc(seq[r.sequence_id][r.offset : r.offset + r.length]) == r.ids_crc32
    with pytest.raises(ValueError):
        packing.sequences(odd, packed)
    keyed = common.saved(odd.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text"), "keyed")
    packed = common.saved(packing.pack(packing.token_pieces(keyed, row_col="row")), "packed")
    seq = {r.sequence_id: r.ids for r in packing.sequences(keyed, packed, row_col="row").collect()}
    for r in packed.collect():
        assert crc(seq[r.sequence_id][r.offset : r.offset + r.length]) == r.ids_crc32


# 4 -------------------------------------------------------------------------------------------------------------------


def brute_groups(texts, percent):
    sets = {}
    for d, t in texts.items():
        w = WORD.findall(low(t))
        sets[d] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    label = {d: d for d in texts}

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    order = sorted(texts)
    for i, a in enumerate(order):
        for b in order[i + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and 100 * min(len(x), len(y)) >= percent * max(len(x), len(y)):
                n = len(x & y)
                if 100 * n >= percent * (len(x) + len(y) - n):
                    p, q = sorted((root(a), root(b)))
                    label[q] = p
    return {d: len(s) for d, s in sets.items()}, {d: root(d) for d in texts}


def test_near_duplicates(spark, sf_dir, docs):
    size, group = brute_groups(dict(zip(docs.doc_id, docs.text)), 85)
    got = queries.QUERIES["op4_near_duplicates"](spark, sf_dir).toPandas().set_index("doc_id")
    assert got.n_shingles.to_dict() == size and got.component_id.to_dict() == group
    assert (got.kept == (got.component_id == got.index)).all()


def family(n, edits, seed, words=60, tag="w"):
    rng = np.random.default_rng(seed)
    base = [f"{tag}{x}" for x in rng.integers(0, 10**6, words)]
    out = []
    for _ in range(n):
        own = list(base)
        for k in rng.integers(0, words, edits):
            own[k] = f"e{rng.integers(0, 10**6)}"
        out.append(" ".join(own))
    return out


def test_large_groups(spark, monkeypatch):
    """Chunks, pivots and outsiders: two large families that share many shingles, and chains."""
    monkeypatch.setattr(neardup, "CHUNK", 10)
    monkeypatch.setattr(neardup, "LEAF", 12)
    texts = family(60, 1, 1, tag="a") + family(40, 2, 2, tag="b")
    a = texts[0].split()
    texts += [" ".join(a[: 60 - k] + [f"z{j}" for j in range(k)]) for k in range(0, 30, 1)]  # a chain away from the first
    texts += [texts[0]] * 20
    d = {i: t for i, t in enumerate(texts)}
    _, group = brute_groups(d, 80)
    got = neardup.near_duplicates(spark.createDataFrame(list(d.items()), "doc_id long, text string"), 80)
    assert {r.doc_id: r.component_id for r in got.collect()} == group


def test_near_duplicates_shuffle_little(spark, monkeypatch):
    """Small tables of many partitions: labels, nodes and groups go to the rows that need them, and a round of labels shuffles once."""
    held = {"spark.sql.shuffle.partitions": "31", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in held}
    monkeypatch.setattr(neardup, "LEAF", 12)
    texts = family(60, 1, 1, tag="a") + family(40, 2, 2, tag="b")
    d = dict(enumerate(texts))
    _, group = brute_groups(d, 80)
    docs = common.saved(spark.createDataFrame(list(d.items()), "doc_id long, text string").coalesce(1), "family")
    sc = spark.sparkContext
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        sc.setJobGroup("near-duplicates", "tasks are counted")
        rows = neardup.near_duplicates(docs, 80).collect()
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
        for k, v in before.items():
            spark.conf.set(k, v)
    assert {r.doc_id: r.component_id for r in rows} == group
    stages = {k for j in sc.statusTracker().getJobIdsForGroup("near-duplicates") for k in sc.statusTracker().getJobInfo(j).stageIds}
    wide = sum(1 for k in stages if (i := sc.statusTracker().getStageInfo(k)) and i.numCompletedTasks == 31)
    assert wide <= 20  # 48 before, when tables were joined by key and the last round was found by joins


def test_solve_as_pair_by_pair(monkeypatch):
    """All members at once give the labels of pairs, with sides and without."""
    rng = np.random.default_rng(3)
    for n, words in ((30, 12), (60, 9), (8, 40)):
        sets = [np.unique(rng.integers(0, words * 2, words).astype(np.uint64)) for _ in range(n)]
        sides = rng.random(n) < 0.4
        for left in (None, sides):
            monkeypatch.setattr(neardup, "TOGETHER", 1 << 21)
            got = neardup._solve(np.arange(n), sets, 40, left)
            monkeypatch.setattr(neardup, "TOGETHER", 0)
            assert got.tolist() == neardup._solve(np.arange(n), sets, 40, left).tolist()


def test_near_duplicates_of_repeated_ids(spark):
    """Rows of one id are documents of their own, in any order of the table."""
    t = ["a b c d e f g h", "a b c d e f g h", "other words that are not like it at all", "q r s t u v w x"]
    rows = [(7, t[0]), (5, t[1]), (7, t[2]), (9, t[3]), (None, t[0])]
    for order in (rows, rows[::-1]):
        got = neardup.near_duplicates(spark.createDataFrame(order, "doc_id long, text string"), 80).collect()
        assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id), r.kept) for r in got) == [("5", 4, "5", True), ("7", 4, "5", False), ("7", 5, "7", True), ("9", 4, "9", True), ("None", 4, "None", True)]


def test_chosen_paths_meet(monkeypatch):
    """Pairs of sketches that agree in a share of their coordinates share a node as often as meeting() says, and rows
    grow by 1 / threshold a level."""
    rng = np.random.default_rng(9)
    n, percent, more = 4000, 80, neardup.second_share(80)
    x = rng.integers(0, 1 << 32, (n, neardup.COORDS)).astype(np.uint32)
    y = np.where(rng.random(x.shape) < 0.8, x, rng.integers(0, 1 << 32, x.shape).astype(np.uint32))
    both = np.concatenate([x, y])
    doc, node = np.arange(2 * n), neardup.mix64(np.arange(2 * n, dtype=np.uint64) % np.uint64(n))  # a root for each pair
    tree = np.zeros(2 * n, np.int64)
    for level in range(neardup.DEPTH + 1):
        at, node = neardup._children(tree[: len(doc)], node, both[doc], level, more)
        doc = doc[at]
        tree = np.zeros(len(doc), np.int64)
        assert len(doc) == pytest.approx(2 * n * 1.25 ** (level + 1), rel=0.06)
        left, right = ({(d % n, k) for d, k in zip(doc.tolist(), node.tolist()) if (d < n) == side} for side in (True, False))
        met = len({d for d, _ in left & right})
        assert met / n == pytest.approx(neardup.meeting(80, percent, level + 1), abs=0.03)
    for p in (20, 30, 50, 80, 85):
        assert 1 - (1 - neardup.meeting(p, p)) ** neardup.tree_count(p) >= neardup.RECALL


def test_trees_beyond_the_first(spark):
    """A low threshold takes as many trees as its recall needs, each with an order of its own."""
    many = neardup.orders(128)
    assert neardup.tree_count(30) == 120 and len({tuple(o) for o in many.tolist()}) == 128
    assert np.array_equal(np.sort(many, axis=1), np.tile(np.arange(neardup.COORDS), (128, 1))) and np.array_equal(many[:64], neardup.orders(8))
    rng = random.Random(4)
    base = [[f"w{rng.randrange(10**6)}" for _ in range(60)] for _ in range(40)]
    texts = [" ".join(b) for b in base] + [" ".join(b[:38] + [f"x{rng.randrange(10**6)}" for _ in range(22)]) for b in base]  # 34 of 78 shingles shared
    got = neardup.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), 30).toPandas().set_index("doc_id")
    assert [int(got.component_id[i]) for i in range(80)] == [i % 40 for i in range(80)]


def test_near_duplicates_odd(odd, empty):
    got = [(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in neardup.near_duplicates(odd, 85).collect()]
    assert sorted((x for x in got if x[0] is not None)) == [(1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True), (4, 1, 4, True), (5, 1, 4, False), (6, 7, 6, True), (7, 6, 6, False), (8, 1, 8, True), (8, 1, 8, True)]
    assert [x[2:] for x in got if x[0] is None] == [(None, True)]
    assert neardup.near_duplicates(empty, 85).count() == 0


# 5 -------------------------------------------------------------------------------------------------------------------


def test_media(spark, sf_dir, docs):
    got = queries.QUERIES["op5_media"](spark, sf_dir).toPandas().set_index("doc_id")
    for d, t in zip(docs.doc_id, docs.text):
        b = (t or "").encode()
        p = b + b" " * (max(192, -(-len(b) // 192) * 192) - len(b))
        r = got.loc[d]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:]))
        m = media.to_wav(p)
        assert media.from_wav(m) == p and (r.media_bytes, r.media_sha256) == (len(m), hashlib.sha256(m).hexdigest())
    same = docs.assign(f=docs.doc_id.map(got.feature)).groupby("text").f.nunique()
    assert (same == 1).all()


def test_fingerprints_find_tones():
    t = np.arange(192 * 40)
    wave = (128 + 60 * np.sin(2 * np.pi * t * 24 / 192) * (1 + 0.5 * np.sin(t / 300))).astype(np.uint8).tobytes()
    at, bins = media.peaks(wave)
    assert len(at) and set(bins) == {24}
    times, codes = media.fingerprint(wave)
    assert set(codes >> 16) == {24} and (np.diff(times) >= 0).all()
    assert [len(x) for x in media.fingerprint(b" " * 192)] == [0, 0]


def test_fingerprints_by_hand():
    """Spectra by the definition of the transform, peaks and pairs by plain loops."""
    rng = np.random.default_rng(6)
    raw = bytes(rng.integers(97, 123, 192 * 7).astype(np.uint8)) + b" " * 192
    n = media.BLOCK
    turn = np.exp(-2j * np.pi * np.outer(np.arange(n // 2 + 1), np.arange(n)) / n)
    frames = [np.abs(turn @ ((np.frombuffer(raw[i : i + n], np.uint8).astype(float) - 128) * np.hanning(n))) ** 2 for i in range(0, len(raw) - n + 1, media.HOP)]
    best = [(2 + int(f[2:].argmax()), f[2:].max()) for f in frames]
    power = [-1, *(p for _, p in best), -1]
    at = [i for i in range(len(best)) if power[i + 1] >= power[i] and power[i + 1] > power[i + 2]]
    pairs = [(t, (best[t][0] << 16) | (best[u][0] << 8) | (u - t)) for i, t in enumerate(at) for u in at[i + 1 : i + 1 + media.FAN] if u - t <= media.REACH]
    times, codes = media.fingerprint(raw)
    assert pairs and list(zip(times.tolist(), codes.tolist())) == pairs


def test_media_odd(odd, empty):
    got = media.describe_media(common.saved(media.encode_media(odd), "m")).collect()
    assert len(got) == 10 and {r.payload_bytes for r in got if r.n_bytes == 0} == {192}
    assert media.describe_media(media.encode_media(empty)).count() == 0


# 6 -------------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("spread, wave", [(0.0, 1000), (2.0, 1000), (2.0, 100), (0.0, 100)])
def test_top_k(spark, spread, wave, monkeypatch):
    monkeypatch.setattr(topk, "WAVE", wave)
    monkeypatch.setattr(topk, "CHUNK", 50)
    monkeypatch.setattr(topk, "SEEDS", 30)
    rng = np.random.default_rng(7)
    v = rng.normal(size=(400, 24)) * np.exp(spread * rng.normal(size=(400, 1))) * np.linspace(1, 0.05, 24)
    v[100:130] = v[100]
    rows = [(i, [float(x) for x in v[i]]) for i in range(400)] + [(900, None), (901, [float("nan")] * 24), (902, [None] * 24), (903, [float("inf")] * 24)]
    r = topk.integral(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    got = defaultdict(list)
    for x in topk.top_k(r, r.filter("vec_id % 20 = 0")).orderBy("query_id", "rank").collect():
        got[x.query_id].append((x.vec_id, x.score))
    w = np.floor(64 * v).astype(np.int64)
    for q in range(0, 400, 20):
        s = w @ w[q]
        want = sorted(((-s[i], i) for i in range(400) if i != q))[:20]
        assert got[q] == [(i, -x) for x, i in want]
    assert len(got) == 20


def test_top_k_of_large_numbers(spark):
    """Exact where doubles are not; beyond 64 bits the nearest 64-bit number."""
    rng = np.random.default_rng(8)
    v = np.floor(rng.normal(size=(60, 8)) * 2.0 ** rng.integers(10, 30, (60, 1)))
    v[0, :], v[1, :], v[2, :] = 8e6, 1e30, 1e306
    rows = [(i, [float(x) for x in v[i]]) for i in range(60)] + [(70, [float("1e308")] * 8)]  # the last is not finite once scaled
    r = topk.integral(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), scale=64.0)
    assert r.count() == 60
    w = [[int(64 * x) for x in row] for row in v.tolist()]
    top = 2**63 - 1
    got = defaultdict(list)
    for x in topk.top_k(r, r.filter("vec_id < 10"), 7).orderBy("query_id", "rank").collect():
        got[x.query_id].append((x.vec_id, x.score))
    for q in range(10):
        s = [max(-top, min(top, sum(a * b for a, b in zip(w[q], row)))) for row in w]
        assert got[q] == [(i, -x) for x, i in sorted((-s[i], i) for i in range(60) if i != q)[:7]]


def test_top_k_few(spark):
    r = topk.integral(spark.createDataFrame([(0, [1.0]), (1, [2.0, 1.0])], "vec_id long, embedding array<double>"))
    assert [(x.query_id, x.vec_id, x.score) for x in topk.top_k(r, r.filter("vec_id = 0")).collect()] == [(0, 1, 64 * 128)]
    assert topk.top_k(r.limit(0), r.limit(0)).count() == 0


# 7 -------------------------------------------------------------------------------------------------------------------


def test_quality(spark, docs, sf_dir):
    base = sf_dir.replace("sf0.001", "sf0.01")
    labels = spark.read.parquet(f"{base}/labels.parquet")
    rule = quality.fit_quality(common.documents(spark, base), labels)
    got = rule.weighed.select("doc_id", (F.col("key") >= rule.least).alias("kept")).toPandas().set_index("doc_id").kept
    truth = labels.toPandas().set_index("doc_id").quality
    kept = got[truth.index]
    assert kept[truth == 1].mean() > 0.98
    assert kept[truth == 0].mean() < 0.35
    applied = rule.apply(common.documents(spark, base))
    assert applied.count() == got.sum() and applied.columns == common.documents(spark, base).columns


def test_gumbel_top_k_draws_in_proportion(spark):
    """Over many seeds, each set of k documents comes as often as drawing one by one by exp(logit) would give it."""
    score, t, k, n = [0.30, 0.28, 0.25, 0.21, 0.10], 0.05, 2, 4000
    rows = spark.createDataFrame(list(enumerate(score)), "id long, score double").crossJoin(spark.range(n).withColumnRenamed("id", "seed"))
    drawn = rows.withColumn("key", quality.draw_key(F.col("score"), F.col("id"), t, F.col("seed"))).toPandas()
    got = Counter(frozenset(own.nlargest(k, "key").id) for _, own in drawn.groupby("seed"))
    p = np.exp(np.array(score) / t)
    want = Counter()
    for i in range(len(p)):
        for j in range(len(p)):
            if i != j:
                want[frozenset((i, j))] += p[i] / p.sum() * p[j] / (p.sum() - p[i])
    for s, q in want.items():
        assert abs(got[s] - n * q) < 4.5 * math.sqrt(n * q) + 1


def test_quality_draw_by_hand(spark, sf_dir):
    """The kept documents are the `size` largest of score / TEMPERATURE + noise, all of it computed apart; another seed
    draws others near the border, and only there."""
    base = sf_dir.replace("sf0.001", "sf0.01")
    d, labels = common.documents(spark, base), spark.read.parquet(f"{base}/labels.parquet")
    kept = []
    for seed in (7, 8):
        rule = quality.fit_quality(d, labels, size=700, seed=seed)
        x = rule.weighed.select("doc_id", "weight", "grams", "key", F.xxhash64(F.lit(seed), "doc_id").alias("h")).toPandas()
        u = ((x.h.to_numpy() & ((1 << 53) - 1)) + 0.5) / 2**53
        own = x.weight / x.grams / quality.TEMPERATURE - np.log(-np.log(u))
        assert np.allclose(own, x.key)
        kept.append(set(x.doc_id[own.argsort()[::-1][:700]]))
        assert kept[-1] == {r.doc_id for r in rule.apply(d).select("doc_id").collect()}
    assert 0 < len(kept[0] - kept[1]) < 200


def test_word_hashes(monkeypatch):
    """Equal words have equal hashes wherever they stand, others have not; words and texts are cut as the rule says."""
    import random

    rng = random.Random(2)
    alphabet = ["a", "A", "b", "é", "É", "ß", "中", "\u00a0", "\u2003", "0", "-", " ", "\t", "\n", "\x0b", "\x0c", "\r", "\x1c", "\x85", "\0"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(60))) for _ in range(400)] + ["", None, "x" * 500 + " y", " "]
    seen, back = {}, {}
    for piece in (1 << 20, 7):
        monkeypatch.setattr(common, "PIECE", piece)
        h, ends = common.words_of([None if t is None else t.encode() for t in texts])
        words = [w for t in texts for w in WORD.findall(low(t))]
        assert len(h) == len(words) and ends.tolist() == np.cumsum([len(WORD.findall(t or "")) for t in texts]).tolist()
        for w, x in zip(words, h.tolist()):
            assert seen.setdefault(w, x) == x and back.setdefault(x, w) == w
    h, ends = common.words_of([])
    assert len(h) == len(ends) == 0
    many = [f"{a}{b}{c}".encode() for a in "abcdefghij" for b in range(100) for c in "pqrst"]
    assert len(np.unique(common.hash_words(b" ".join(many))[0])) == len(many)


def test_weights_by_hand(spark):
    """Log ratios against a count of every n-gram's bucket."""
    texts = {1: "good words here", 2: "bad bad bad", 3: "good good words", 4: "other words"}
    d = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    rows = d.select(F.lit("raw").alias("kind"), "text").unionByName(d.filter("doc_id = 3").select(F.lit("target").alias("kind"), "text"))
    ratio = quality.log_ratio(quality.bucket_counts(rows, bits=12), bits=12)
    raw, target = (Counter(int(b) for i in ids for b in quality.gram_buckets([texts[i].encode()], 12)[0]) for ids in (texts, (3,)))
    n, m = sum(raw.values()), sum(target.values())
    p = {b: (raw[b] + 0.5) / (n + 0.5 * 4096) for b in range(4096)}
    want = [math.log((target[b] + 0.05 * m * p[b]) / (1.05 * m) / p[b]) for b in range(4096)]
    assert np.allclose(ratio, want, atol=1e-5)
    got = {r.doc_id: r for r in quality.weigh(d, ratio, bits=12).collect()}
    for i, t in texts.items():
        grams = quality.gram_buckets([t.encode()], 12)[0]
        assert len(grams) == 2 * len(t.split()) - 1
        assert (got[i].weight, got[i].grams) == (pytest.approx(sum(want[b] for b in grams), abs=1e-4), len(grams))


def test_one_good_label_does_not_set_the_bar():
    rng = np.random.default_rng(3)
    good, bad = rng.normal(0.5, 0.2, 1000), rng.normal(-1, 0.3, 300)
    bar = lambda g, b: quality.threshold(np.concatenate([g, b]), np.repeat([1, 0], [len(g), len(b)]))
    plain = bar(good, bad)
    assert abs(bar(np.append(good, -1.5), bad) - plain) < 0.05  # a good text among the worst
    assert bar(np.tile(good, 20), np.tile(bad, 20)) == plain  # the same shares, more labels
    assert (good < plain).mean() < 0.01 and (bad >= plain).mean() < 0.02


def test_kth_largest(spark):
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(size=500), [3.0] * 40, [1e9, -1e9]])
    df = spark.createDataFrame([(float(a),) for a in x], "x double")
    for k in (1, 2, 17, 300, len(x), len(x) + 5):
        assert quality.kth_largest(df, "x", k, bins=16) == np.sort(x)[::-1][min(k, len(x)) - 1]
    assert quality.kth_largest(df, "x", 0) == float("inf")


def test_quality_odd(spark, odd, empty):
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert quality.fit_quality(odd, none).apply(odd).count() == 10
    assert quality.fit_quality(empty, none).apply(empty).count() == 0
    some = spark.createDataFrame([(6, 1), (4, 0), (7, 1), (None, 1), (2, None)], "doc_id long, quality int")
    assert quality.fit_quality(odd, some).apply(odd).columns == odd.columns


# 8 -------------------------------------------------------------------------------------------------------------------


def test_cuckoo_filter():
    rng = np.random.default_rng(2)
    keys = rng.integers(0, 1 << 63, 5000, dtype=np.uint64)
    f = lines.CuckooFilter.of(keys)
    assert f.contains(keys).all()
    assert f.contains(rng.integers(0, 1 << 63, 20_000, dtype=np.uint64)).mean() < 0.002
    f.delete(keys[:2500])
    assert f.contains(keys[2500:]).all() and f.contains(keys[:2500]).mean() < 0.01
    assert not lines.CuckooFilter.sized(4).insert(keys[:100])


def brute_lines(texts):
    """Each document's text without repeated lines, by the rule."""
    held = defaultdict(set)
    key = lambda x: low(x.strip(" \t\n\x0b\x0c\r"))
    for d, t in texts.items():
        for x in (t or "").split("\n"):
            if len(key(x)) >= 10:
                held[key(x)].add(d)
    gone = lambda d, x: len(held.get(key(x), ())) > 1 and min(held[key(x)]) != d
    return {d: "\n".join(x for x in (t or "").split("\n") if not gone(d, x)) for d, t in texts.items()}


def test_index_is_reversible(spark, docs):
    d = spark.createDataFrame(docs[["doc_id", "text"]])
    first, more = d.filter("doc_id % 3 > 0"), d.filter("doc_id % 3 = 0")
    index = lines.LineIndex.build(first, shard_postings=150)
    assert index.shards > 5
    both = index.insert(more)
    whole = lines.LineIndex.build(d)
    drops = lambda i: {r.doc_id: sorted(map(bytes, r["keys"])) for r in i.drops().collect()}
    state = lambda i: sorted((bytes(r.key), r.holders, r.first_doc) for r in i.counts().collect())
    assert drops(both) == drops(whole) and drops(whole) and state(both) == state(whole)
    back = both.delete(more)
    assert drops(back) == drops(index) and state(back) == state(index)
    assert drops(both.insert(more)) == drops(whole)  # the same documents again change nothing
    rest = both.delete(first)
    assert state(rest) == state(lines.LineIndex.build(more))
    texts = dict(zip(docs.doc_id, docs.text))
    got = {r.doc_id: r.text or "" for r in lines.drop_repeated_lines(d, both).collect()}
    assert got == brute_lines(texts)
    assert whole.maybe_repeated().count() < whole.posted().count()


def test_updates_touch_their_shards_only(spark, docs):
    d = spark.createDataFrame(docs[["doc_id", "text"]])
    index = lines.LineIndex.build(d, shard_postings=60)
    one = spark.createDataFrame([(10**6, "a line that nobody else has ever written")], "doc_id long, text string")
    after = index.insert(one)
    old, new = index.files(), after.files()
    assert index.shards > 15 and len(old - new) <= 1 and len({x.split(":")[0] for x in old ^ new}) == 1
    other = spark.createDataFrame([(10**6 + 1, "a line that nobody else has ever written")], "doc_id long, text string")
    twice = after.insert(other)
    assert twice.repeats().count() == index.repeats().count() + 1
    again = twice.delete(one)  # the heir becomes the first holder
    assert again.counts().filter(f"first_doc = {10**6 + 1} and holders = 1").count() == 1
    assert again.repeats().count() == index.repeats().count()


def test_lines_odd(odd, empty):
    got = {r.doc_id: (r.text, r.n_lines, r.n_dropped) for r in lines.drop_repeated_lines(odd).collect()}
    assert got[1] == (None, 1, 0) and got[2] == ("", 1, 0)
    assert got[6][2] == 0 and got[7] == ("", 3, 2) and got[5] == ("", 1, 1) and got[8] == ("12 34 --", 1, 0)
    assert lines.drop_repeated_lines(empty).count() == 0
    assert lines.drop_repeated_lines(odd).columns == [c for c in odd.columns if c != "n_lines"] + ["n_lines", "n_dropped"]


# 10 ------------------------------------------------------------------------------------------------------------------


def test_elias_fano():
    rng = np.random.default_rng(3)
    for n, u in ((0, 1), (1, 1), (500, 700), (500, 1 << 40), (3000, 1 << 20), (5000, 1 << 62)):
        v = np.unique(rng.integers(0, u, n, dtype=np.uint64)) if n else np.empty(0, np.uint64)
        if n == 5000:
            v = np.unique(np.concatenate([v, np.arange(1000, dtype=np.uint64), np.uint64(u - 1000) + np.arange(999, dtype=np.uint64)]))
        e = eliasfano.EliasFano.of(v, u)
        order = rng.permutation(len(v))
        assert e.access(order).tolist() == v[order].tolist()
        probe = np.concatenate([v, rng.integers(0, u, 200, dtype=np.uint64)])
        start, stop = np.zeros(len(probe), np.int64), np.full(len(probe), len(v))
        place = {x: k for k, x in enumerate(v.tolist())}
        assert e.find(start, stop, probe).tolist() == [place.get(x, -1) for x in probe.tolist()]
        assert (e.find(start, np.minimum(stop, 3), probe) < 3).all()
    wide = eliasfano.EliasFano.of(np.array([0, 0, 5, 5, 5, 9]), 10)  # equal values, as pointers have
    assert wide.access(np.arange(6)).tolist() == [0, 0, 5, 5, 5, 9]


class Trigrams:
    """The model by counting, with its own discounts."""

    def __init__(self, texts):
        self.c, self.two, self.three = Counter(), Counter(), Counter()
        for w in texts:
            s = ["<s>", *w]
            self.c.update(w)
            self.two.update(zip(s, w))
            self.three.update(zip(s, s[1:], s[2:]))
        self.n, self.v = sum(self.c.values()), len(self.c)
        self.d = []
        for grams in (self.two, self.three):
            n1, n2 = (sum(x == k for x in grams.values()) for k in (1, 2))
            self.d.append(min(0.95, max(0.5, n1 / (n1 + 2 * n2))))
        self.seen, self.kinds = Counter(), Counter()
        for grams in (self.two, self.three):
            for g, n in grams.items():
                self.seen[g[:-1]] += n
                self.kinds[g[:-1]] += 1

    def p1(self, w):
        return (self.c[w] + 0.5) / (self.n + 0.5 * (self.v + 1))

    def step(self, grams, d, context, w, shorter):
        if not self.seen[context]:
            return shorter
        return max(0, grams[*context, w] - d) / self.seen[context] + d * self.kinds[context] / self.seen[context] * shorter

    def p2(self, a, w):
        return self.step(self.two, self.d[0], (a,), w, self.p1(w))

    def p3(self, a, b, w):
        return self.step(self.three, self.d[1], (a, b), w, self.p2(b, w))

    def logs(self, w):
        s = ["<s>", *w]
        return [math.log10(self.p2(s[0], w[0]))] + [math.log10(self.p3(a, b, x)) for a, b, x in zip(s, s[1:], s[2:])]


def test_lm_scoring(spark, sf_dir, docs):
    got = queries.QUERIES["op10_lm_scoring"](spark, sf_dir).toPandas().set_index("doc_id")
    out = {d: zlib.crc32(str(d).encode()) % 5 == 1 for d in docs.doc_id}
    toks = {d: [*WORD.findall(low(t)), "</s>"] for d, t in zip(docs.doc_id, docs.text)}
    plain = Trigrams([w for d, w in toks.items() if not out[d]])
    assert len(got) == len(docs)
    for d, w in toks.items():
        r = got.loc[d]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (out[d], len(w), sum(x in plain.c for x in w), plain.n)
        assert r.base_score == pytest.approx(sum(math.log10(plain.p1(x)) for x in w), rel=1e-9)
        exact = sum(plain.logs(w))
        assert r.score == pytest.approx(exact, abs=0.03 * len(w) ** 0.5 + 0.005 * len(w))  # quantised
    # One context's probabilities sum to one: all known words and the unknown one.
    a, b = max((g[:2] for g in plain.three), key=lambda g: plain.seen[g])
    assert sum(plain.p3(a, b, w) for w in plain.c) + plain.p3(a, b, "\0") == pytest.approx(1, abs=1e-6)


def test_lm_shards_and_partitions(spark, monkeypatch):
    """Discounts are of the corpus; scores are the same for any partitions, blocks and shards, frequent words cut too."""
    rng = np.random.default_rng(5)
    texts = [" ".join(rng.choice(["a", "b", "c", *(f"w{i}" for i in range(40))], rng.integers(1, 30), p=[0.3, 0.2, 0.1, *[0.01] * 40])) for _ in range(120)]
    plain = Trigrams([[*t.split(), "</s>"] for t in texts])
    d = spark.createDataFrame(list(enumerate(texts)) + [(500, "a nowhere b a c"), (501, "nowhere a")], "doc_id long, text string")
    got = []
    for parts, tokens_, block in ((1, 2_000_000, 1 << 19), (16, 30, 50)):
        monkeypatch.setattr(ngramlm, "SHARD_TOKENS", tokens_)
        monkeypatch.setattr(ngramlm, "BLOCK", block)
        monkeypatch.setattr(ngramlm, "LOOKUPS", block)
        monkeypatch.setattr(ngramlm, "SHARD_ROOT", 0)
        monkeypatch.setattr(ngramlm, "ROW_TOKENS", 0)
        model = ngramlm.fit(d.filter("doc_id < 500").repartition(parts))
        assert model.discounts == pytest.approx(plain.d)
        stored = common.saved(d.repartition(parts), "lm")
        got.append({r.doc_id: r.score for r in ngramlm.score(stored, model).collect()})
    assert model.shards > 40 and got[0].keys() == got[1].keys()
    for i, t in [*enumerate(texts), (500, "a nowhere b a c"), (501, "nowhere a")]:
        assert got[0][i] == pytest.approx(got[1][i], abs=1e-9)
        exact = sum(plain.logs([*t.split(), "</s>"]))
        assert got[0][i] == pytest.approx(exact, abs=0.03 * len(t.split()) ** 0.5 + 0.03)


def test_lm_odd(odd, empty):
    model = ngramlm.fit(odd.select("text"))
    got = {r.doc_id: r for r in ngramlm.score(odd, model).collect()}
    assert got[1].n_tokens == got[2].n_tokens == got[3].n_tokens == 1 and got[4].n_tokens == 60_001
    none = ngramlm.fit(empty.select("text"))
    assert (none.total, none.words) == (0, 0)
    assert {r.n_known for r in ngramlm.score(odd, none).collect()} == {0} and ngramlm.score(empty, none).count() == 0


# Pipeline ------------------------------------------------------------------------------------------------------------


def test_pipeline(spark, sf_dir, docs):
    d = common.documents(spark, sf_dir)
    kept = [d]
    for name, stage in corpus_pipeline.STAGES:
        kept.append(common.saved(stage(spark, kept[-1], sf_dir), name))
        if name != "packing":
            assert kept[-1].columns == d.columns
    assert kept[1].count() <= d.count() and kept[2].count() == kept[1].count()
    before = kept[2].toPandas()
    _, group = brute_groups(dict(zip(before.doc_id, before.text)), 80)
    assert sorted(r.doc_id for r in kept[3].select("doc_id").collect()) == sorted(x for x in group if group[x] == x)
    # Mixing: each source's words reach its target, and a document's takings are whole but for one of each source.
    unique, mixed = kept[3].toPandas(), kept[4].toPandas()
    size = lambda t: len(WORD.findall(t or ""))
    names = sorted(unique.source.unique())
    words = {s: [size(t) for t in unique.text[unique.source == s]] for s in names}
    want = fill([sum(words[s]) for s in names], [1 + i % 3 for i in range(len(names))])
    texts = unique.set_index("doc_id").text
    for s, t in zip(names, want):
        own = mixed[mixed.source == s]
        assert sum(map(size, own.text)) == pytest.approx(t, abs=1)
        assert sum(x != texts[d] for d, x in zip(own.doc_id, own.text)) <= 1 and all(texts[d].startswith(x) for d, x in zip(own.doc_id, own.text))
        assert (own.groupby("doc_id").size() <= 3).all()
    # Packing: every taking's ids are there once, without gaps, in as few sequences as they need.
    pieces = kept[5].toPandas()
    plain = Tokenizer.from_file(tokens.default_tokenizer())
    ids = Counter((d, crc([*plain.encode(t or "", add_special_tokens=False).ids, 0][i : i + 2048])) for d, t in zip(mixed.doc_id, mixed.text) for i in range(0, len(plain.encode(t or "", add_special_tokens=False).ids) + 1, 2048))
    assert Counter(zip(pieces.doc_id, pieces.ids_crc32)) == ids
    own = pieces.sort_values(["sequence_id", "offset"])
    g = own.groupby("sequence_id").length
    assert (g.cumsum() - own.length == own.offset).all() and g.sum().max() <= 2048 and pieces.sequence_id.nunique() <= math.ceil(pieces.length.sum() / 2048) + 2


def test_pipeline_odd(spark, odd, empty, tmp_path):
    """Every row is counted through the stages: nulls, blanks, repeated ids, clashing names."""
    spark.createDataFrame([(6, 1, 0), (4, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    stage = dict(corpus_pipeline.STAGES)
    texts = lambda d: Counter((r.doc_id, r.text) for r in d.collect())
    d = odd
    for name in ("line_dedup", "near_duplicates"):
        before, d = texts(d), common.saved(stage[name](spark, d, str(tmp_path)), "odd")
        assert d.columns == odd.columns
        if name == "line_dedup":
            assert sum(texts(d).values()) == 10 and texts(d)[5, ""] == 1 and texts(d)[7, ""] == 1
        else:  # one of the two equal rows of id 8 goes
            assert texts(d) == before - Counter({(8, "12 34 --"): 1})
    mixed = common.saved(stage["mixing"](spark, d, str(tmp_path)), "odd")
    assert {r.doc_id for r in mixed.collect()} == {4, 6, 8, None} and mixed.columns == odd.columns
    assert all(t and t.strip() for _, t in texts(mixed))
    pieces = common.saved(stage["packing"](spark, mixed, str(tmp_path)), "odd")
    plain = Tokenizer.from_file(tokens.default_tokenizer())
    n = sum(len(plain.encode(r.text, add_special_tokens=False).ids) + 1 for r in mixed.collect())
    assert pieces.agg(F.sum("length")).first()[0] == n and pieces.select("row").distinct().count() == mixed.count()
    kept = common.saved(stage["quality"](spark, odd, str(tmp_path)), "odd")
    assert not texts(kept) - texts(odd) and kept.columns == odd.columns
    for f in stage.values():
        empty = common.saved(f(spark, empty, str(tmp_path)), "odd")
        assert empty.count() == 0


def test_pipeline_keeps_rows_of_null_and_repeated_ids(spark, tmp_path):
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    rows = [(1, "a b c d e f one"), (1, "g h i j k l two"), (None, "m n o p q r three"), (None, "s t u v w x four"), (2, "y z a c e g five")]
    d = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    want = Counter((str(i), t) for i, t in rows)
    for name, stage in corpus_pipeline.STAGES[1:4]:  # nothing is a duplicate and one source is taken once: all stay
        d = common.saved(stage(spark, d, str(tmp_path)), "rows")
        assert Counter((str(r.doc_id), r.text) for r in d.collect()) == want, name
    pieces = common.saved(corpus_pipeline.packing(spark, d, str(tmp_path)), "rows")
    assert pieces.count() == 5 and pieces.select("row").distinct().count() == 5
    keyed = corpus_pipeline.STAGES[0][1](spark, d, str(tmp_path))
    assert {(str(r.doc_id), r.text) for r in keyed.collect()} <= set(want)


def test_pipeline_mixes_rows_without_a_unique_id(spark, tmp_path):
    rows = [(1, "a b c"), (1, "d e"), (1, "d e"), (None, "f g h i"), (None, "j"), (2, "k")]
    d = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    out = common.saved(corpus_pipeline.mixing(spark, d, str(tmp_path)), "mixed")  # one source: each document is taken once
    assert sorted((str(r.doc_id), r.text) for r in out.collect()) == sorted((str(i), t) for i, t in rows)
    assert out.columns == d.columns
    pieces = corpus_pipeline.packing(spark, out, str(tmp_path))
    assert pieces.filter("doc_id IS NULL").count() >= 2
