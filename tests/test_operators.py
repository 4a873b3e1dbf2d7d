"""Operators against brute force and small fixtures."""

import json
import os
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from storyweft.operators import components, dedup, embed, evaluate, mutations, translate, validate
from storyweft.sources import feeds, items
from storyweft.streaming import incremental


def test_simhash_bands_lose_nothing(spark):
    rng = random.Random(3)
    base = [rng.getrandbits(64) for _ in range(12)]
    values = [b ^ sum(1 << rng.randrange(64) for _ in range(rng.randrange(5))) & (1 << 64) - 1 for b in base for _ in range(8)] + base[:3]
    rows = [(i, "x" if i % 5 else "y", v - (1 << 64) if v >> 63 else v) for i, v in enumerate(values)] + [(999, "x", None)]
    df = spark.createDataFrame(rows, "id long, block string, simhash long")
    members = dedup.classes(df, F.col("simhash"))
    assert all(rows[r.rep][1:] == rows[r.id][1:] and r.rep <= r.id for r in members.collect()) and members.count() == len(rows) - 1
    pairs = dedup.simhash_pairs(df)
    assert pairs.filter("distance = 0").count() == 0 and pairs.count() == pairs.select("a", "b").distinct().count()
    got = {(r.a, r.b, r.distance or 0) for r in dedup.expanded(pairs, members).collect()}
    mask = (1 << 64) - 1
    want = {(p[0], q[0], d) for p in rows[:-1] for q in rows[:-1] if p[0] < q[0] and p[1] == q[1] and (d := ((p[2] ^ q[2]) & mask).bit_count()) <= 3}
    assert got == want


def test_prefix_filter_loses_nothing(spark):
    rng = random.Random(5)
    sets = []
    for i in range(60):
        own = set(rng.sample("abcdefghijklmnop", rng.randrange(0, 9))) if i % 3 else set(sets[-1][2]) ^ {rng.choice("abcdefgh")} if sets else {"a"}
        sets.append((i, "x", sorted(own)))
    df = spark.createDataFrame(sets, "id long, block string, grams array<string>")
    got = {(r.a, r.b) for r in dedup.expanded(dedup.overlap_pairs(df, 0.6), dedup.classes(df, dedup.gram_key(F.col("grams")))).collect()}
    want = {(p[0], q[0]) for p in sets for q in sets if p[0] < q[0] and p[2] and q[2] and len(set(p[2]) & set(q[2])) / len(set(p[2]) | set(q[2])) >= 0.6}
    assert got == want


def test_parts_of_sets_lose_nothing(spark):
    rng = random.Random(6)
    letters = [a + b for a in "abcdefghijklm" for b in "nopqrstu"]
    sets = []
    for i in range(150):
        size = rng.choice([1, 2, 5, 8, 9, 16, 17, 40, 75])
        own = set(rng.sample(letters, size)) if i % 3 == 0 else set(sets[-1][2]) ^ set(rng.sample(letters, rng.randrange(0, 5)))
        sets.append((i, "x" if i % 7 else "y", sorted(own)))
    df = spark.createDataFrame(sets, "id long, block string, grams array<string>")
    pairs, members = dedup.overlap_pairs(df, 0.88), dedup.classes(df, dedup.gram_key(F.col("grams")))
    want = {(p[0], q[0]) for p in sets for q in sets if p[0] < q[0] and p[1] == q[1] and p[2] and q[2] and len(set(p[2]) & set(q[2])) / len(set(p[2]) | set(q[2])) >= 0.88}
    assert {(r.a, r.b) for r in dedup.expanded(pairs, members).collect()} == want and len(want) > 20
    for days in (0, 1, 4):
        near = [(r.a, r.b) for r in dedup.expanded(pairs, members, days).collect()]
        assert sorted(near) == sorted((a, b) for a, b in want if b - a <= days)


def test_sets_that_only_share_a_phrase_are_not_moved(spark):
    """Texts with a common beginning meet on its grams; none of those pairs may leave the join of the keys."""
    rng = random.Random(7)
    rows = [(i, "x", sorted({f"common{k}" for k in range(20)} | {f"own{rng.randrange(400)}" for _ in range(30)})) for i in range(300)]
    keyed = dedup._signed(spark.createDataFrame(rows, "id long, block string, grams array<string>"))
    assert dedup._met_on_parts(keyed, 0.88).count() < 30


def test_nearest(spark):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(90, 8))
    rows = [(i, i % 2, v[i].tolist()) for i in range(90)]
    got = {(r.id, r["rank"]): r.neighbour for r in dedup.nearest(spark.createDataFrame(rows, "id long, block int, vector array<double>"), 5).collect()}
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    for i in range(90):
        near = sorted((-(u[i] @ u[j]), j) for j in range(90) if j != i and i % 2 == j % 2)[:5]
        assert [got[i, k + 1] for k in range(5)] == [j for _, j in near]


def test_nearest_of_many_equal_vectors(spark):
    rng = np.random.default_rng(2)
    rows = [(i, 0, [1.0 + i % 3, 0.0, 0.0]) for i in rng.permutation(400).tolist()] + [(1000 + i, 0, [0.0, 1.0, float(i)]) for i in range(5)]  # 400 are parallel
    got = {(r.id, r["rank"]): r.neighbour for r in dedup.nearest(spark.createDataFrame(rows, "id long, block int, vector array<double>").coalesce(1), 5).collect()}
    for i in range(400):
        assert [got[i, k + 1] for k in range(5)] == [j for j in range(6) if j != i][:5]


def test_nearest_holds_little(monkeypatch):
    """Of many blocks short runs leave before the input ends, each vector once; scores taken in slices are those of all at once."""
    monkeypatch.setattr(dedup, "WAITING_BYTES", 20_000)
    rng, drawn = np.random.default_rng(5), []
    v = rng.normal(size=(2000, 8))
    blocks = [None if i % 300 == 7 else str(i % 300) for i in range(2000)]

    def batches():
        for i in range(0, 2000, 100):
            drawn.append(i)
            yield pa.RecordBatch.from_arrays([pa.array(range(i, i + 100), pa.int64()), pa.array(blocks[i : i + 100], pa.string()), pa.array(v[i : i + 100].tolist(), pa.list_(pa.float64()))], ["id", "block", "vector"])

    seen = set()
    for run in dedup.packed(batches()):
        assert seen or len(drawn) <= 4
        (r,) = run.to_pylist()
        m = np.frombuffer(r["vs"], np.float64).reshape(-1, r["dim"])
        for i, x in zip(np.frombuffer(r["ids"], np.int64).tolist(), m):
            assert i not in seen and r["block"] == blocks[i] and np.allclose(x, v[i] / np.linalg.norm(v[i]))
            seen.add(i)
    assert len(seen) == 2000
    u, ids = v / np.linalg.norm(v, axis=1, keepdims=True), np.arange(2000)
    whole = dedup._best(u[:90], u, ids[:90], ids, 5)
    parts = [np.concatenate(x) for x in zip(*(dedup._best(u[i : i + 9], u, ids[i : i + 9], ids, 5) for i in range(0, 90, 9)))]
    assert [x.tolist() for x in whole[:2]] == [x.tolist() for x in parts[:2]] and np.allclose(whole[2], parts[2])


def _article(i, **x):
    return {"article_id": i, "collection": "c", "source": f"s{i}", "source_item_id": str(i), "url": None, "content_hash": f"h{i}", "title": f"entirely different words number {i * 7919}", "published_at": "2024-01-01 00:00:00", "created_at": "2024-01-01 00:00:00", "vector": None} | x


def test_greedy_signals(spark):
    rows = [
        _article(1, url="http://a/1", title="Acme launches orbital drone today"), _article(2, url="http://a/1"), _article(3, source="s1", source_item_id="1"), _article(4, content_hash="h1"),
        _article(5, title="acme launches orbital drone today!"), _article(6, collection="other", url="http://a/1"), _article(7, vector=[1.0, 0.0], title="alpha beta gamma delta"),
        _article(8, vector=[1.0, 0.01], title="omega psi chi phi"), _article(9, vector=[0.91, 0.415], title="kappa iota theta eta"),
    ]
    schema = "article_id long, collection string, source string, source_item_id string, url string, content_hash string, title string, published_at string, created_at string, vector array<double>"
    df = spark.createDataFrame([tuple(r.values()) for r in rows], schema)
    for c in ("published_at", "created_at"):
        df = df.withColumn(c, F.col(c).cast("timestamp"))
    got = {r.article_id: (r.story_id, r.exact_signal, r.decision) for r in dedup.greedy_stories(df).collect()}
    assert got[1] == (1, None, "new_story")
    assert got[2][:2] == (1, "exact_url") and got[3][:2] == (1, "exact_source_id") and got[4][:2] == (1, "exact_content_hash")
    assert got[5][:2] == (1, "lexical_simhash")
    assert got[6] == (6, None, "new_story")
    assert got[8][:2] == (7, "semantic")
    assert got[9] == (9, None, "gray_zone")


class PlainCascade:
    """The matching rules by plain loops over all stories, members and vectors."""

    def __init__(self, horizon=None):
        self.horizon, self.stories, self.members = horizon, [], []

    @staticmethod
    def words(t):
        import re

        return re.findall(r"[^\W_]+", " ".join(t.lower().split()))

    @classmethod
    def simhash(cls, t):
        def fnv(w):
            h = 14695981039346656037
            for b in w.encode():
                h = ((h ^ b) * 1099511628211) % 2**64
            return h

        hs = [fnv(w) for w in cls.words(t)]
        return sum(1 << i for i in range(64) if sum(1 if h >> i & 1 else -1 for h in hs) > 0) if hs else None

    @staticmethod
    def share(a, b):
        return len(set(a) & set(b)) / len(set(a) | set(b)) if a and b else 0.0

    @staticmethod
    def grams(t):
        t = " ".join(t.lower().split())
        return [t[i : i + 3] for i in range(len(t) - 2)] or [t] if t else []

    @staticmethod
    def date(a, last):
        return 0.5 if a is None else 1.0 if abs(a - last) <= 48 * 3600 else 0.6 if abs(a - last) <= 168 * 3600 else 0.0

    def place(self, a):
        seen = a["published"] if a["published"] is not None else a["created"]
        fresh = [s for s in self.stories if self.horizon is None or s["last"] >= self.horizon]
        rule = lambda story, signal, score, cos=None: self.merge(a, seen, story, signal, score, cos)
        same = [s for s in self.stories if a["url"] and s["seed"]["url"] == a["url"]]
        if same:
            return rule(max(same, key=lambda s: (s["last"], s["id"])), "exact_url", 1.0)
        for signal, keys in (("exact_source_id", ("source", "item")), ("exact_content_hash", ("hash",))):
            own = [m for m in self.members if all(m[0][k] == a[k] for k in keys)]
            if own:
                return rule(own[-1][1], signal, 1.0)
        near = sorted(fresh, key=lambda s: (s["last"], s["id"]), reverse=True)[:300]
        h = self.simhash(a["title"])
        bits = [((h ^ g).bit_count(), -s["last"], -s["id"], s) for s in near if h is not None and (g := self.simhash(s["seed"]["title"])) is not None]
        bits = [b for b in bits if b[0] <= 3]
        if bits:
            d, _, _, s = min(bits, key=lambda b: b[:3])
            return rule(s, "lexical_simhash", 1 - d / 64)
        best = None
        for s in near:
            o = self.share(self.grams(a["title"]), self.grams(s["seed"]["title"]))
            if o >= 0.88 and a["published"] is not None and abs(a["published"] - s["last"]) <= 14 * 86400:
                score = 0.8 * o + 0.2 * self.date(a["published"], s["last"])
                if best is None or score > best[0]:
                    best = (score, s)
        if best:
            return rule(best[1], "lexical_overlap", best[0])
        found = []
        if a["vector"] is not None:
            with_v = [(float(np.dot(a["vector"], s["seed"]["vector"])), s) for s in fresh if s["seed"]["vector"] is not None]
            for cos, s in sorted(with_v, key=lambda c: (-c[0], c[1]["id"]))[:20]:
                title, date = self.share(self.words(a["title"]), self.words(s["seed"]["title"])), self.date(a["published"], s["last"])
                score = max(0.0, min(1.0, 0.75 * cos + 0.15 * title + 0.1 * date))
                if cos >= 0.965 or (cos >= 0.935 and title >= 0.3):
                    return rule(s, "semantic", score, cos)
                found.append((score, cos, s))
        story = {"id": a["id"], "seed": a, "last": seen}
        self.stories.append(story)
        self.members.append((a, story))
        top = max(found, key=lambda f: f[0]) if found else None
        gray = top is not None and 0.89 <= top[1] < 0.935
        return a["id"], "gray_zone" if gray else "new_story", None, top[0] if gray else None, top[1] if gray else None, top[2]["id"] if gray else None

    def merge(self, a, seen, story, signal, score, cos):
        story["last"] = max(story["last"], seen)
        self.members.append((a, story))
        return story["id"], "auto_merge", signal, score, cos, story["id"]


def _generated(spark, seed, n):
    """Articles that meet at every step of the cascade: as plain rows and as a table."""
    rng = random.Random(seed)
    pool = [" ".join(rng.choice(["rate", "bank", "storm", "vote", "court", "goal", "chip", "probe", "Über", "train"]) + str(rng.randrange(60)) for _ in range(9)) for _ in range(40)]
    base = [np.array([rng.gauss(0, 1) for _ in range(12)]) for _ in range(25)]
    rows = []
    for i in range(1, n + 1):
        t = rng.choice(pool)
        change = rng.random()
        title = t if change < 0.15 else t + "!" if change < 0.3 else t[:-1] + "x" if change < 0.45 else " ".join([*t.split()[:-1], f"new{i}"]) if change < 0.6 else f"{t.split()[0]} {i} " + " ".join(f"u{rng.randrange(999)}" for _ in range(7))
        v = rng.choice(base) + rng.choice([0.0, 0.15, 0.28, 0.36, 0.5]) * np.array([rng.gauss(0, 1) for _ in range(12)])
        at = 1_704_067_200 + rng.randrange(40 * 24) * 3600
        rows.append({
            "id": i, "collection": rng.choice("ab"), "source": f"s{rng.randrange(6)}", "item": str(rng.randrange(140)), "url": f"http://a/{rng.randrange(150)}" if rng.random() < 0.3 else None,
            "hash": f"h{rng.randrange(2000)}", "title": title, "published": at if rng.random() < 0.85 else None, "created": 1_704_067_200 + i * 60, "vector": v if rng.random() < 0.8 else None,
        })
    schema = "article_id long, collection string, source string, source_item_id string, url string, content_hash string, title string, published_at long, created_at long, vector array<double>"
    df = spark.createDataFrame([(r["id"], r["collection"], r["source"], r["item"], r["url"], r["hash"], r["title"], r["published"], r["created"], None if r["vector"] is None else r["vector"].tolist()) for r in rows], schema)
    for c in ("published_at", "created_at"):
        df = df.withColumn(c, F.timestamp_seconds(c))
    return rows, df


def test_greedy_against_plain_loops(spark):
    """Every step of the cascade, its order and its ties, over generated articles; with and without a horizon."""
    rows, df = _generated(spark, 11, 320)
    signals = set()
    for as_of, days in ((None, 365), (1_704_067_200 + 40 * 86400, 20)):
        got = {r.article_id: r for r in dedup.greedy_stories(df, as_of, days).collect()}
        assert len(got) == len(rows)
        for c in "ab":
            plain = PlainCascade(None if as_of is None else as_of - days * 86400)
            for r in (r for r in rows if r["collection"] == c):
                own = r | {"vector": None if r["vector"] is None else r["vector"] / np.linalg.norm(r["vector"])}
                story, decision, signal, score, cos, candidate = plain.place(own)
                x = got[r["id"]]
                assert (x.story_id, x.decision, x.exact_signal, x.best_candidate_story_id) == (story, decision, signal, candidate), r
                assert x.composite_score == (None if score is None else pytest.approx(score, abs=1e-9)) and x.best_cosine == (None if cos is None else pytest.approx(cos, abs=1e-9))
                assert json.loads(x.match_details)["signal"] == (signal or "seed") and x.match_type == (signal or "seed")
                signals.add(signal or decision)
    assert signals == {"exact_url", "exact_source_id", "exact_content_hash", "lexical_simhash", "lexical_overlap", "semantic", "new_story", "gray_zone"}


def _tables(spark, articles, stories, members):
    schema = "article_id long, collection string, source string, source_item_id string, url string, content_hash string, title string, published_at string, created_at string, vector array<double>"
    times = lambda d, *c: d.withColumns({x: F.col(x).cast("timestamp") for x in c})
    s = spark.createDataFrame(stories, "story_id long, collection string, status string, representative_article_id long, canonical_title string, canonical_url string, first_seen_at string, last_seen_at string")
    m = spark.createDataFrame([(*a.values(), story, gone) for a, story, gone in members], schema + ", story_id long, deleted boolean")
    a = spark.createDataFrame([tuple(x.values()) for x in articles], schema)
    return times(a, "published_at", "created_at"), times(s, "first_seen_at", "last_seen_at"), times(m, "published_at", "created_at")


def test_greedy_over_stories_that_are_there(spark):
    """Suppressed stories and deleted members take no article; a story without a representative is matched by its title
    only; an article that is a member already is passed over."""
    day = "2024-01-02 00:00:00"
    old = [_article(i, title=f"quite another heading {i * 31}") for i in range(1, 6)]
    old[0] |= {"url": "http://a/1"}
    old[2] |= {"title": "the river rose again overnight in the north", "vector": [1.0, 0.0]}
    stories = [(1, "c", "suppressed", 1, old[0]["title"], "http://a/1", day, day), (2, "c", "active", 2, old[1]["title"], "", day, day), (3, "c", "active", 3, old[2]["title"], "", day, day), (4, "c", "active", 4, old[3]["title"], "http://a/4", day, day)]
    members = [(old[0], 1, False), (old[1], 2, False), (old[2], 3, True), (old[3], 4, False)]
    new = [
        _article(10, url="http://a/1"), _article(11, source="s2", source_item_id="2"), _article(12, content_hash="h3"), _article(13, title=old[2]["title"], vector=[1.0, 0.0], published_at=day),
        _article(14, url="http://a/4"), old[1], _article(15, title="the river rose again overnight in the north", published_at=None),
    ]
    a, s, m = _tables(spark, new, stories, members)
    got = {r.article_id: (r.story_id, r.exact_signal) for r in dedup.greedy_stories(a, stories=s, members=m).collect()}
    assert got == {10: (10, None), 11: (2, "exact_source_id"), 12: (12, None), 13: (3, "lexical_overlap"), 14: (4, "exact_url"), 15: (15, None)}
    events = dedup.greedy_stories(a, stories=s, members=m)
    assert dedup.memberships(events, day).filter("match_type = 'seed'").count() == 3 and dedup.audit(events, day).filter("exact_signal IS NOT NULL AND composite_score IS NULL").count() == 0
    assert dedup.match_type("exact_url") == "exact_url" and dedup.match_type("by hand") == "manual"


def test_components(spark):
    rng = random.Random(2)
    links = [(rng.randrange(80), rng.randrange(80)) for _ in range(50)] + [(i, i + 1) for i in range(100, 140)]
    nodes = sorted({x for e in links for x in e} | {500})
    label = {n: n for n in nodes}
    for _ in nodes:
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    got = components.components(spark.createDataFrame([(n,) for n in nodes], "id long"), spark.createDataFrame(links, "a long, b long"))
    assert {r.id: r.component for r in got.collect()} == label


def test_pairwise_f1(spark):
    r = evaluate.pairwise_f1(spark.createDataFrame([("a", 1), ("a", 1), ("a", 2), ("b", 2)], "truth string, predicted int")).first()
    assert (r.tp, r.fp, r.fn, r.tn, r.items) == (1, 1, 2, 2, 4)


ITEM = {"payload_version": "v1", "source": "s", "source_item_id": "i", "title": "t", "published_at": "2024-01-02T03:04:05Z", "source_metadata": {"collection": "c", "job_name": "j", "job_run_id": "r", "scraped_at": "2024-01-02T03:04:05Z"}}


META = ITEM["source_metadata"]
LONG = "http://a/" + "x" * 4090
PAYLOADS = [
    ({}, []), ({"title": " "}, ["title"]), ({"title": "\u2003\u0085"}, ["title"]), ({"title": None}, ["title"]), ({"title": 5}, ["title"]), ({"title": "x" * 2048}, []), ({"title": "x" * 2049}, ["title"]),
    ({"source": ""}, ["source"]), ({"source": "x" * 129}, ["source"]), ({"source_item_id": None}, ["source_item_id"]), ({"source_item_id": "x" * 513}, ["source_item_id"]),
    ({"payload_version": "v2"}, ["payload_version"]), ({"payload_version": 1}, ["payload_version"]), ({"extra": 1}, ["unknown key"]),
    ({"published_at": "yesterday"}, ["published_at"]), ({"published_at": "2024-02-30T00:00:00Z"}, ["published_at"]), ({"published_at": "2024-02-28T00:00:00.5+01:00"}, []), ({"published_at": 3}, ["published_at"]),
    ({"canonical_url": "no link"}, ["canonical_url"]), ({"canonical_url": LONG}, ["canonical_url"]), ({"image_url": ""}, ["image_url"]), ({"image_url": LONG}, ["image_url"]), ({"image_url": "https://a/b.png"}, []),
    ({"body_text": "x" * 500_001}, ["body_text"]), ({"body_text": ""}, []), ({"language": "e"}, ["language"]), ({"language": "x" * 36}, ["language"]), ({"source_domain": ""}, ["source_domain"]), ({"source_domain": ["a"]}, ["source_domain"]),
    ({"authors": "x"}, ["authors"]), ({"authors": ["a", " "]}, ["authors"]), ({"authors": ["a"] * 65}, ["authors"]), ({"authors": ["x" * 257]}, ["authors"]), ({"authors": []}, []), ({"tags": [None]}, ["tags"]), ({"tags": ["a", 1]}, ["tags"]),
    ({"tags": ["a"] * 129}, ["tags"]), ({"tags": ["x" * 129]}, ["tags"]), ({"tags": ["a"] * 128}, []), ({"source_metadata": []}, ["source_metadata"]), ({"source_metadata": META | {"more": {"x": [1]}}}, []),
    ({"source_metadata": META | {"scraped_at": "bad"}}, ["metadata scraped_at"]), ({"source_metadata": META | {"job_name": ""}}, ["metadata job_name"]), ({"source_metadata": META | {"collection": 7}}, ["metadata collection"]),
    ({"source_metadata": {k: v for k, v in META.items() if k != "job_run_id"}}, ["metadata job_run_id"]), ({"source_metadata": META | {"collection": "x" * 129}}, ["metadata collection"]),
    ({"title": "", "tags": 1, "extra": None}, ["unknown key", "title", "tags"]),
]


def test_payloads(spark):
    texts = [json.dumps(ITEM | change) for change, _ in PAYLOADS]
    missing = {k: v for k, v in ITEM.items() if k not in ("title", "source_metadata")}
    whole = json.dumps(ITEM)
    odd = [json.dumps(missing), None, "", " ", "[1]", "3", "null", '{"a": NaN}', whole + " x", whole + ", {}", whole + "], [{}", whole + "}, {", '{"a": 1, "a": 2}', f" {whole}\n"]
    want = [e for _, e in PAYLOADS] + [["missing title", "missing source_metadata"]] + [["not an object"]] * 12 + [[]]
    rows = spark.createDataFrame(list(enumerate(texts + odd)), "i int, p string")
    got = {r.i: r.e for r in rows.select("i", validate.payload_errors(F.col("p")).alias("e")).collect()}
    for i, e in enumerate(want):
        assert got[i] == e, (texts + odd)[i][:200]


def test_strict_json():
    for bad in ('{"a": NaN}', "Infinity", '{"a": 1} 2', "", "[" * 100_000):
        assert items.canonical_json(bad) is None
    assert items.canonical_json('{"b": 1.10, "a": [1e3, null, true, "<&>"]}') == '{"a":[1e3,null,true,"\\u003c\\u0026\\u003e"],"b":1.10}'


def test_ingest_is_idempotent(spark, tmp_path):
    for i, x in enumerate([ITEM, ITEM, ITEM | {"title": "u"}, {"no": "item"}]):
        (tmp_path / f"{i}.json").write_text(json.dumps(x))
    (tmp_path / ".hidden.json").write_text("{}")
    read = items.read_items(spark, str(tmp_path))
    assert read.count() == 4
    none = items.ledger_rows(read, "2024-01-03 00:00:00").limit(0)
    fresh = items.ingest(none, read, "2024-01-03 00:00:00")
    assert fresh.count() == 2
    assert items.ingest(fresh, read, "2024-01-03 00:00:00").count() == 0


def test_soft_delete_and_restore(spark):
    t = spark.createDataFrame([(1, None), (2, "2024-01-01 00:00:00")], "id long, deleted_at string").withColumn("deleted_at", F.col("deleted_at").cast("timestamp"))
    gone = mutations.soft_delete(t, F.lit(True), "2024-02-02 00:00:00")
    assert mutations.affected(t, gone, "id").first().rows == 1
    assert mutations.affected(gone, mutations.soft_delete(gone, F.lit(True), "2024-03-03 00:00:00"), "id").first().rows == 0
    assert mutations.restore(gone, F.col("id") == 2).filter("deleted_at IS NULL").count() == 1


def test_embed_stage(spark):
    a = spark.createDataFrame([(1, "t", "b"), (2, " ", " "), (3, "t", "b")], "article_id long, title string, body string")
    made = embed.embed(a, lambda: embed.HashBackend(64), "m", "1").collect()
    assert {r.article_id for r in made} == {1, 3} and made[0].embedding == made[1].embedding
    assert np.linalg.norm(made[0].embedding) == pytest.approx(1, abs=1e-5)
    assert embed.pending(a, spark.createDataFrame(made), "m", "1").count() == 1
    assert embed.request(["a", " "], 1) == (["a"], 8)


def test_hash_embeddings_take_the_body(spark, tmp_path):
    from storyweft.plans.catalogue import QUERIES

    rows = [(1, "x" * 80 + " one"), (2, "x" * 80 + " two"), (3, " " * 80 + "late words"), (4, " ")]
    spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.article_id: r.embedding for r in QUERIES["hash_embeddings"](spark, str(tmp_path)).collect()}
    assert set(got) == {1, 2, 3} and got[1] != got[2]
    own = embed.HashBackend(64).embed([f"{'x' * 80}\n\n{rows[0][1]}"])[0]
    assert got[1] == pytest.approx(own, abs=1e-6)


def test_noise_backend():
    """Against the generator by whole numbers."""
    import hashlib

    texts = ["a", "b", "a"]
    got = embed.NoiseBackend(16).embed(texts)
    assert got[0] == got[2] != got[1]
    x = int.from_bytes(hashlib.sha256(b"b").digest()[:8], "little")
    v = []
    for _ in range(16):
        x ^= x << 13 & 2**64 - 1
        x ^= x >> 7
        x ^= x << 17 & 2**64 - 1
        v.append((x % 2_000_001 - 1_000_000) / 1e6)
    assert got[1] == pytest.approx((np.array(v) / np.linalg.norm(v)).tolist(), abs=1e-6)
    assert abs(np.dot(*embed.NoiseBackend().embed(["one", "two"]))) < 0.1


def test_hash_backend_by_hand():
    import hashlib

    raw = hashlib.sha256(b"x\n0").digest() + hashlib.sha256(b"x\n1").digest()
    v = np.array([int.from_bytes(raw[i : i + 2], "little") / 32767.5 - 1 for i in range(0, 40, 2)])
    assert embed.HashBackend(20).embed(["x"])[0] == pytest.approx((v / np.linalg.norm(v)).tolist(), abs=1e-6)
    whole = embed.HashBackend().embed(["x"])[0]
    assert len(whole) == 4096 and np.linalg.norm(whole) == pytest.approx(1, abs=1e-5)


def test_remote_backend_and_health():
    asked = []

    def post(url, body):
        asked.append((url, body))
        if "input" in body:
            return {"data": [{"index": i, "embedding": [float(i), 1.0]} for i in reversed(range(len(body["input"])))]}
        return {"embeddings": [[1.0, 0.0]] * len(body["texts"])}

    assert embed.RemoteBackend("http://h/embed", post, 2).embed(["a", "b"], 9) == [[1.0, 0.0]] * 2 and asked[0] == ("http://h/embed", {"texts": ["a", "b"], "max_length": 9})
    assert embed.RemoteBackend("http://h/v1/embeddings/", post, 2).embed(["a", "b"]) == [[0.0, 1.0], [1.0, 1.0]]
    for bad in ({"embeddings": [[1.0]]}, {"data": [{"index": 0, "embedding": [1.0]}, {"index": 0, "embedding": [1.0]}]}, {"data": [{"index": 1, "embedding": [1.0]}, {"index": 2, "embedding": [1.0]}]}):
        with pytest.raises(ValueError):
            embed.RemoteBackend("http://h", lambda u, b, bad=bad: bad, 1).embed(["a", "b"])
    assert embed.health(embed.HashBackend(8)) == {"ok": True, "dimensions": 8, "error": None}
    assert embed.health(embed.RemoteBackend("http://h", post, 5))["ok"] is False
    assert "no service" in embed.health(embed.RemoteBackend("http://h", lambda u, b: (_ for _ in ()).throw(OSError("no service")), 5))["error"]


def test_translation(spark):
    t = spark.createDataFrame([("article_title", 1, "en", "hello"), ("article_title", 2, "zh", "ni hao")], "source_type string, source_id long, source_lang string, text string")
    cache = spark.createDataFrame([], "source_type string, source_id long, content_hash string, target_lang string")
    plan = translate.planned(t, cache, "zh")
    assert translate.stats(plan).first().asDict() == {"total": 2, "translated": 1, "cached": 0, "skipped": 1}
    done = translate.run(plan, "zh", translate.Tagged)
    assert done.first().translated_text == "[zh] hello"
    assert translate.stats(translate.planned(t, done, "zh")).first().cached == 1
    registry = translate.Registry("Tagged")
    registry.add("tagged", translate.Tagged)
    assert registry.get() is translate.Tagged


def test_feeds(spark, tmp_path):
    (tmp_path / "r.xml").write_text("<rss><channel><item><title>A</title><link>http://a/</link><description>&lt;b&gt;x&lt;/b&gt; y</description><pubDate>Tue, 05 Mar 2024 10:00:00 +0000</pubDate></item><item><title>B</title><link>http://b</link><pubDate>soon</pubDate></item><item><title>C</title><link>http://c</link><pubDate>Tue, 05 Mar 2019 10:00:00 +0000</pubDate></item></channel></rss>")
    got = feeds.read_rss(spark, str(tmp_path / "r.xml"), "2024-01-01 00:00:00").collect()
    assert {r.title: r.summary for r in got} == {"A": "x y", "B": ""}
    (tmp_path / "a.xml").write_text('<feed><entry><title>P</title><id>http://p</id><summary>s</summary><updated>2024-03-05T10:00:00Z</updated><category term="x"/><category term="y"/></entry></feed>')
    r = feeds.read_atom(spark, str(tmp_path / "a.xml"), categories=1).first()
    assert (r.link, r.summary) == ("http://p", "[x] s")
    post = {"data": {"children": [{"data": {"title": "t", "url": "/r/x", "permalink": "/r/x", "created_utc": 5.0, "score": 1, "subreddit": "x"}}]}}
    assert feeds.read_listing(spark.createDataFrame([(json.dumps(post),)], "value string"), 1.0, "http://h").first().link == "http://h/r/x"
    top = feeds.top_per(spark.createDataFrame([("b", "t", "l", "", 1)], "bucket string, title string, link string, summary string, n int"), "bucket", [F.desc("n")], 15)
    assert feeds.markdown_digest(top).first().text == "## b\n\n- [t](l)"
    scored = spark.createDataFrame([(json.dumps({"id": 1, "title": "AI x", "url": "u", "score": s}),) for s in (3, 9)], "value string")
    assert [r.score for r in feeds.read_scored(scored, ["ai"]).collect()] == [9]
    assert feeds.first_by_url(spark.createDataFrame([("http://a/", 2), ("http://a", 1)], "link string, n int"), "n").first().n == 1


def test_streams(spark, tmp_path):
    src, out, cp = (str(tmp_path / x) for x in ("src", "out", "cp"))
    spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "k string, n long").coalesce(1).write.parquet(src)
    for extra in (None, [("b", 4), ("c", 5)]):
        if extra:
            spark.createDataFrame(extra, "k string, n long").write.mode("append").parquet(src)
        incremental.drain(incremental.ledger_stream(spark, src, "k string, n long"), incremental.append_once(out, ["k"], "n"), cp)
    assert {r.k: r.n for r in spark.read.parquet(out).collect()} == {"a": 1, "b": 3, "c": 5}
    work = [3, 2, 0]
    assert incremental.process([lambda: work.pop(0)]) == [[3], [2], [0]]
    with pytest.raises(RuntimeError):
        incremental.process([lambda: 1], max_cycles=2)


def _planted(folder):
    """Items of a week: copies by URL, by source id, by content, near-copies of headings, others alone; their stories."""
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghiklmnoprstuw") for _ in range(rng.randrange(4, 9)))
    truth, n = {}, 0

    def put(story, **change):
        nonlocal n
        n += 1
        item = ITEM | {"source": f"src{n % 5}", "source_item_id": f"item-{n}", "published_at": f"2024-01-0{1 + n % 6}T10:00:00Z", "source_metadata": META | {"item_uuid": f"u{n}"}} | change
        (folder / f"{n:03d}.json").write_text(json.dumps(item, indent=2))  # many lines
        truth[f"{n:03d}.json"] = story

    for story in range(40):
        title, body = " ".join(word() for _ in range(9)), " ".join(word() for _ in range(30))
        link = f"https://News{story}.example.com/a/{story}"
        put(story, title=title, body_text=body, canonical_url=link, source="first", source_item_id=f"s{story}")
        kind = story % 8
        if kind == 0:
            put(story, title=word() + " " + title, canonical_url=f"{link}/?utm_source=x#top")
        elif kind == 1:
            put(story, title=" ".join(word() for _ in range(9)), source="first", source_item_id=f"s{story}", canonical_url=f"{link}/moved")
        elif kind == 2:
            put(story, title=title.upper(), body_text=body, canonical_url=f"{link}/copy")
        elif kind == 3:
            put(story, title=title + " !", body_text=word(), canonical_url=f"{link}/near")
        elif kind == 4:  # the same link in another collection is another story
            put(1000 + story, title=title, body_text=body, canonical_url=link, source_metadata=META | {"collection": "elsewhere"})
    (folder / "bad.json").write_text(json.dumps(ITEM | {"title": " "}))
    return truth


def test_whole_run_over_planted_items(spark, tmp_path):
    from storyweft.plans import runs

    truth = _planted(tmp_path)
    run = runs.run_items(spark, str(tmp_path), "2024-01-08 00:00:00")
    c = run.counters.first()
    assert (c.processed, c.exact_url, c.exact_source_id, c.exact_content_hash, c.lexical_simhash + c.lexical_overlap, c.stories) == (65, 5, 5, 5, 5, 45)
    known = spark.createDataFrame(list(truth.items()), "name string, truth long")
    files = run.raw.select(F.col("path").alias("file"), F.element_at(F.split("path", "/"), -1).alias("name"))
    counts, scores = runs.quality(run, files.join(known, "name").select("file", "truth"))
    assert counts.first().asDict() == {"items": 65, "records": 65, "missing_truth": 0, "missing_prediction": 0}
    f = scores.first()
    assert (f.tp, f.fp, f.fn, f.f1) == (20, 0, 0, 1.0)
    # Keys alone, without what was matched by content or heading, and with one pair of files given.
    paths = {r.name: r.file for r in files.collect()}
    names = sorted(truth)
    pair = next((a, b) for a, b in zip(names, names[1:]) if truth[a] == truth[b] and truth[a] % 8 == 3)
    same = spark.createDataFrame([tuple(paths[x] for x in pair)], "a string, b string")
    sizes = evaluate.size_histogram(runs.known_stories(run, same), "truth")
    assert {r["size"]: r.clusters for r in sizes.collect()} == {1: 65 - 2 * 16, 2: 16}


@pytest.mark.skipif("STORYWEFT_ITEMS" not in os.environ, reason="needs a folder of item files and what is known of them")
def test_whole_run_over_given_items(spark):
    """STORYWEFT_ITEMS: a folder; STORYWEFT_EXPECTED: JSON of counters, scores, and groups of files that are the same."""
    from storyweft.plans import runs

    want = json.loads(os.environ["STORYWEFT_EXPECTED"])
    run = runs.run_items(spark, os.environ["STORYWEFT_ITEMS"], "2026-02-14 12:00:00")
    paths = [r.path for r in run.raw.select("path").collect()]
    find = lambda x: next(p for p in paths if p.endswith(x))
    same = [(find(g[0]), find(x)) for g in want["same"] for x in g[1:]]
    truth = runs.known_stories(run, spark.createDataFrame(same, "a string, b string"))
    got = run.counters.first().asDict() | runs.quality(run, truth)[1].first().asDict()
    assert {k: round(v, 6) if isinstance(v, float) else v for k, v in got.items() if k in want["values"]} == want["values"]


def test_mapping_counts_what_is_missing(spark):
    items_ = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (4, "d")], "id long, file string")
    truth = spark.createDataFrame([("a", 1), ("b", 1), ("c", 2)], "file string, truth long")
    found = spark.createDataFrame([(1, 7), (2, 7), (4, 9)], "id long, predicted long")
    assert evaluate.mapping_counts(evaluate.mapped(items_, truth, found)).first().asDict() == {"items": 4, "records": 2, "missing_truth": 1, "missing_prediction": 1}


def test_process_over_item_fixture(spark):
    from storyweft.operators.normalize import normalize, pending

    raw = spark.createDataFrame([(1, "s", "i1", "World_News", None, json.dumps(ITEM | {"title": "Hello  World", "canonical_url": "https://E.com/x/?utm_a=1", "language": "EN-us"})), (2, "s", "i2", "World_News", "https://e.com/y", "broken")], "raw_arrival_id long, source string, source_item_id string, collection string, url string, raw_payload string")
    raw = raw.withColumn("source_published_at", F.lit(None).cast("timestamp")).withColumn("fetched_at", F.lit("2024-01-05").cast("timestamp")).withColumn("deleted_at", F.lit(None).cast("timestamp"))
    got = {r.raw_arrival_id: r for r in normalize(raw).collect()}
    assert (got[1].normalized_title, got[1].canonical_url, got[1].normalized_language, got[1].collection) == ("hello world", "https://e.com/x", "en", "c")
    assert (got[2].normalized_title, got[2].canonical_url, got[2].collection, got[2].normalized_language) == ("i2", "https://e.com/y", "world_news", "und")
    assert pending(raw, normalize(raw).filter("raw_arrival_id = 1")).count() == 1


def test_video_and_paper_feeds(spark, tmp_path):
    (tmp_path / "v.xml").write_text(
        '<feed xmlns:yt="y" xmlns:media="m"><entry><title> Clip &amp; more </title><yt:videoId>abc</yt:videoId><published>2024-03-05T10:00:00+00:00</published>'
        '<media:group><media:title>x</media:title><media:description>All &lt;b&gt;about&lt;/b&gt; it</media:description><media:thumbnail url="http://p/1.jpg"/></media:group></entry>'
        "<entry><title>old</title><yt:videoId>d</yt:videoId><published>2023-03-05T10:00:00+00:00</published></entry></feed>"
    )
    r = feeds.read_videos(spark, str(tmp_path / "v.xml"), "2024-01-01 00:00:00").collect()
    assert [(x.title, x.link, x.summary, x.image_url, x.video_id) for x in r] == [("Clip & more", "https://www.youtube.com/watch?v=abc", "All about it", "http://p/1.jpg", "abc")]
    (tmp_path / "a.xml").write_text('<feed><entry><title>P</title><id>http://p</id><summary>s</summary><published>2020-01-01T00:00:00Z</published>' + "".join(f'<category term="c{i}"/>' for i in range(5)) + "</entry></feed>")
    assert feeds.read_atom(spark, str(tmp_path / "a.xml"), "2024-01-01", dated=False).first().published_at is None and feeds.read_atom(spark, str(tmp_path / "a.xml"), "2024-01-01").count() == 0
    assert feeds.read_papers(spark, str(tmp_path / "a.xml")).first().summary == "[c0, c1, c2] s"
    ids = feeds.first_ids(spark.createDataFrame([("[5, 3, 9, 4]",)], "value string"), 3)
    assert {(x.id, x.place) for x in ids.collect()} == {(5, 1), (3, 2), (9, 3)}
    scored = spark.createDataFrame([(json.dumps({"id": i, "title": "AI", "url": f"u{i}", "score": i}),) for i in (3, 4, 9)], "value string")
    assert [x.id for x in feeds.read_scored(scored, ["ai"], ids).collect()] == [9, 3]


def test_page_previews():
    from storyweft.sources.reader import MAX_BYTES, preview_of

    assert preview_of("one\r\n two\n\n three", "Text/Plain; charset=utf-8") == "one\n\ntwo\n\nthree"
    page = '<html><head><title>Head line</title><meta name="description" content=" In short. "></head><body>{}</body></html>'
    assert preview_of(page.format("<nav>menu</nav><div>ad</div><article><p>The long story</p><p>and its end</p></article><footer>f</footer>")) == "The long story\n\nand its end"
    assert preview_of(page.format("<article>a</article><p>nearly all the text is out here</p>")) == "a\n\nnearly all the text is out here"
    assert preview_of(page.format("<script>x</script>")) == "In short." and preview_of("<title> Only  this </title>") == "Only this"
    assert preview_of(None) is None and preview_of("") == ""
    assert len(preview_of("x" * (MAX_BYTES + 5), "text/plain")) == MAX_BYTES


def test_sinks(spark, tmp_path):
    from storyweft.sources import sinks

    df = spark.createDataFrame([(1, "a", None, "long " * 30), (2, "é\tb", 1.5, "")], "place long, name string, n double, words string")
    assert json.loads(sinks.shown(df, "json")) == [{"place": 1, "name": "a", "n": None, "words": "long " * 30}, {"place": 2, "name": "é\tb", "n": 1.5, "words": ""}]
    lines = sinks.shown(df.drop("words")).split("\n")
    assert lines == ["PLACE  NAME  N", "1      a     -", "2      é b   1.5"]
    assert [r.line for r in sinks.table_lines(df, 8).orderBy("place").collect()] == ["NAME\tN\tWORDS", "a\t-\tlong ...", "é b\t1.5\t"]
    with pytest.raises(ValueError):
        sinks.shown(df, "xml")
    sinks.save(df, str(tmp_path / "t"), "json")
    assert spark.read.json(str(tmp_path / "t")).count() == 2


def test_one_writer(spark, tmp_path):
    from storyweft.sources.sinks import one_writer

    path = str(tmp_path / "table")
    with one_writer(spark, path):
        with pytest.raises(RuntimeError, match="being written"), one_writer(spark, path):
            pass
        batch = spark.createDataFrame([("a", 1)], "k string, n long")
        with pytest.raises(RuntimeError):
            incremental.append_once(path, ["k"], "n")(batch, 0)
    incremental.append_once(path, ["k"], "n")(batch, 0)
    incremental.append_once(path, ["k"], "n")(batch, 0)
    assert spark.read.parquet(path).count() == 1


def test_inline_items(spark):
    assert items.inline_item(spark, f" {json.dumps(ITEM)}\n").select(validate.payload_errors(F.col("payload")).alias("e")).first().e == []
    with pytest.raises(ValueError):
        items.inline_item(spark, " \n")


def test_run_log(spark):
    read = spark.createDataFrame([(1,), (2,)], "x int")
    one, two, three = (items.started(spark, i, f"s{i}", "2024-01-01 00:00:00") for i in (1, 2, 3))
    log = one.unionByName(two).unionByName(three).unionByName(items.finished(one, read, read.limit(1), "2024-01-02 00:00:00")).unionByName(items.finished(two, read, read, "2024-01-02 00:00:00", "é" * 3000))
    got = {r.run_id: (r.status, r.items_fetched, r.items_inserted, len((r.error_message or "").encode())) for r in items.run_states(log).collect()}
    assert got == {1: ("completed", 2, 1, 0), 2: ("failed", 2, 0, 4000), 3: ("running", 0, 0, 0)}


def test_providers(monkeypatch):
    asked = []
    p = translate.Prompted(lambda system, user: asked.append((system, user)) or " hallo ")
    assert p.translate("hello", "en", "de") == "hallo" and "English to German" in asked[0][0] and asked[0][1] == "hello"
    assert "language of the text to xx" in p.prompt("und", "xx")
    with pytest.raises(ValueError):
        translate.Prompted(lambda s, u: " ").translate("a", "en", "de")
    monkeypatch.setenv("STORYWEFT_TRANSLATOR", "Tagged")
    r = translate.Registry()
    r.add("tagged", translate.Tagged)
    assert r.get() is translate.Tagged and r.names() == ["tagged"]
    for bad in (" ", "TAGGED"):
        with pytest.raises(ValueError):
            r.add(bad, translate.Tagged)
    with pytest.raises(KeyError):
        r.get("none")


def test_tasks_of_a_story(spark):
    s = spark.createDataFrame([(1, "en", "T")], "story_id long, collection string, canonical_title string")
    a = spark.createDataFrame([(5, "en", "x", " "), (6, "de", "y", "body")], "article_id long, collection string, title string, body string")
    got = {(r.source_type, r.source_id, r.text) for r in translate.expand(s, a).collect()}
    assert got == {("story_title", 1, "T"), ("article_title", 5, "x"), ("article_title", 6, "y"), ("article_text", 6, "body")}


def test_story_updates(spark):
    s = spark.createDataFrame([(1, "a", "active", "c", "http://a/", "h")], "story_id long, canonical_title string, status string, collection string, canonical_url string, url_hash string")
    same = mutations.update_story(s, F.lit(True))
    assert same.collect() == s.collect()
    none = mutations.update_story(s, F.lit(True), link=F.lit("no link")).first()
    assert (none.canonical_url, none.url_hash) == (None, None)
    with pytest.raises(Exception, match="unknown status"):
        mutations.update_story(s, F.lit(True), status=F.lit("lost")).collect()
    with pytest.raises(ValueError):
        mutations.delete_from({}, "2024-01-01")
    t = spark.createDataFrame([(1, "x", "https://e.com/a", "2")], "article_id long, normalized_title string, canonical_url string, url_hash string")
    r = mutations.update_article(t, F.col("article_id") == 1, link=F.lit("https://WWW.e.com:443/b/?utm_x=1")).first()
    assert (r.canonical_url, r.source_domain) == ("https://www.e.com/b", "www.e.com") and len(r.url_hash) == 64


def test_sessions_are_touched(spark):
    s = spark.createDataFrame([(1, "2024-01-01 10:00:00"), (2, "2024-01-01 08:00:00"), (3, "2024-01-01 10:00:00")], "session_id long, e string").select("session_id", F.col("e").cast("timestamp").alias("expires_at"))
    used = spark.createDataFrame([(1,), (2,), (1,)], "session_id long")
    got = {r.session_id: str(r.expires_at) for r in mutations.touch_sessions(s, used, "2024-01-01 09:00:00", "2 HOURS").collect()}
    assert got == {1: "2024-01-01 11:00:00", 2: "2024-01-01 08:00:00", 3: "2024-01-01 10:00:00"}
    assert mutations.emptied(s).count() == 0 and mutations.emptied(s).columns == s.columns


def test_store_follows_the_documents(spark, tmp_path):
    from storyweft.plans import adapter

    def put(n):
        rows = [(i, f"text {i}", "en", "s", 6) for i in range(n)]
        spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
        return adapter.stories(spark, str(tmp_path))

    first = put(3)
    assert first.count() == 3 and adapter.stories(spark, str(tmp_path)) is first
    assert put(5).count() == 5
