"""Versioned tables, counts by changes, and claims."""

import os
import random

import pytest
from pyspark.sql import functions as F

from storyweft.operators import deltas
from storyweft.sources import versions
from storyweft.sources.versions import Conflict, VersionedTable


def rows(spark, data):
    return spark.createDataFrame(data, "id long, collection string, title string")


def content(df):
    return sorted((r.id, r.collection, r.title) for r in df.collect())


@pytest.fixture
def stored(spark, tmp_path):
    t = VersionedTable(spark, str(tmp_path / "articles"))
    t.append(rows(spark, [(i, c, f"t{i}") for i, c in enumerate(["a", "b", None, "a/=% ", ""] * 4)]))
    return t


def files(t):
    return {os.path.join(d, n): os.stat(os.path.join(d, n)).st_mtime_ns for d, _, names in os.walk(f"{t.path}/data") for n in names if n.endswith(".parquet") and not n.startswith(".")}


def test_update_rewrites_what_it_touches(spark, stored):
    before, pinned = files(stored), stored.read()
    old = stored.manifest(1)["parts"]
    assert stored.update(lambda d: d.withColumn("title", F.concat("title", F.lit("!"))), where=stored.read().filter("id IN (0, 2)")) == 2
    new = stored.manifest(2)["parts"]
    assert sum(new[p] != old[p] for p in new) == 2 and set(new) == set(old)
    after = files(stored)
    assert all(after[f] == at for f, at in before.items())  # nothing is changed in place
    assert {f"t{i}!" for i in range(20) if i % 5 in (0, 2)} == {x for *_, x in content(stored.read()) if x.endswith("!")}
    assert not any(x.endswith("!") for *_, x in content(pinned)) and content(pinned) == content(stored.read(1))
    assert stored.vacuum() == 0 and stored.versions() == [2]  # the first folder still holds the other partitions
    assert len(content(stored.read())) == 20


def test_deletes_empty_a_partition(spark, stored):
    stored.update(lambda d: d.filter("false"), where=stored.read().filter("collection = 'a'"))
    assert len(content(stored.read())) == 16 and len(stored.manifest(2)["parts"]) == 4
    stored.append(rows(spark, [(99, "a", "back")]))
    assert content(stored.read().filter("collection = 'a'")) == [(99, "a", "back")]
    with pytest.raises(ValueError):
        stored.update(lambda d: d.withColumn("collection", F.lit("b")), where=stored.read().filter("collection = 'a'"))
    stored.update(lambda d: d.withColumn("collection", F.lit("b")))
    assert {c for _, c, _ in content(stored.read())} == {"b"}


def test_lost_writers_leave_nothing(spark, stored, monkeypatch):
    """A writer that is lost with its data written, or with a version taken, leaves the old version; the next one goes on."""
    want = content(stored.read())
    monkeypatch.setattr(VersionedTable, "_put", lambda *a: (_ for _ in ()).throw(KeyboardInterrupt()))
    with pytest.raises(KeyboardInterrupt):
        stored.update(lambda d: d.filter("false"))
    monkeypatch.undo()
    assert content(stored.read()) == want
    open(f"{stored.path}/versions/{2:012d}.taken", "w").close()
    monkeypatch.setattr(versions, "LOST", 0)
    assert stored.append(rows(spark, [(50, "z", "new")])) == 2 and len(content(stored.read())) == 21


def test_writers_that_meet(spark, stored):
    """Changes of other partitions join; changes of what was read are refused; appends always join."""
    other = VersionedTable(spark, stored.path)

    def meanwhile(collection):
        def change(d):
            other.update(lambda x: x.withColumn("title", F.lit("theirs")), where=other.read().filter(F.col("collection") == collection))
            return d.withColumn("title", F.lit("ours"))

        return change

    stored.update(meanwhile("b"), where=stored.read().filter("collection = 'a'"))
    titles = {c: t for _, c, t in content(stored.read().filter("collection IN ('a', 'b')"))}
    assert titles == {"a": "ours", "b": "theirs"}
    with pytest.raises(Conflict):
        stored.update(meanwhile("a"), where=stored.read().filter("collection = 'a'"))
    assert {t for _, _, t in content(stored.read().filter("collection = 'a'"))} == {"theirs"}


def test_counts_by_changes(spark):
    """Random inserts, deletes and updates, folded one after the other, against counting anew."""
    rng, schema = random.Random(4), "k string, j int, x long, y double"
    how = {"keys": ["k", "j"], "sums": ["x"], "least": ["x", "y"], "greatest": ["y"]}
    row = lambda: (rng.choice(["a", "b", None]), rng.choice([1, 2, None]), rng.choice([None, rng.randrange(30)]), rng.choice([None, float(rng.randrange(9))]))
    table = [row() for _ in range(60)]
    view = deltas.view_of(spark.createDataFrame(table, schema), **how)
    plain = lambda df: sorted(map(str, (tuple(r) for r in df.collect())))
    for step in range(4):
        gone = rng.sample(range(len(table)), 25 if step < 3 else len(table))
        new = [row() for _ in range(10 if step < 3 else 0)]
        changes = [(*table[i], -1) for i in gone] + [(*r, 1) for r in new]
        table = [r for i, r in enumerate(table) if i not in set(gone)] + new
        after = spark.createDataFrame(table, schema)
        view = deltas.folded(view, spark.createDataFrame(changes, schema + ", sign int"), after, **how)
        assert plain(view) == plain(deltas.view_of(after, **how))
        view = spark.createDataFrame(view.collect(), view.schema)
    assert deltas.folded(deltas.view_of(after, ["k"]), spark.createDataFrame([("q", 1, 2, 3.0, 1)], schema + ", sign int"), after, ["k"]).collect() == [("q", 1)]


def test_claims(spark, tmp_path):
    """Two workers never hold a range; an expired lease is taken again, and the worker that lost it cannot end the range."""
    from concurrent.futures import ThreadPoolExecutor

    from storyweft.sources.claims import Claims

    pending = spark.range(100).select("id")
    one, two = (Claims(spark, str(tmp_path / "claims"), owner, 600, 10) for owner in ("one", "two"))
    with ThreadPoolExecutor(8) as pool:
        taken = [c for cs in pool.map(lambda w: w.take(pending, most=6), [one, two, one, two]) for c in cs]
    assert sorted(c.range for c in taken) == list(range(10)) and {c.lease for c in taken} == {1}
    assert one.take(pending) == [] and one.take_range(3) is None
    late = Claims(spark, one.path, "late", -1, 10)  # to it every lease has expired
    again = late.take_range(3)
    first = next(c for c in taken if c.range == 3)
    assert again.lease == 2 and not one.done(first) and not one.renew(first) and late.renew(again) and late.done(again) and not late.done(again)
    assert late.take_range(3) is None
    seen = []
    assert sorted(late.work(pending, lambda rows: seen.extend(r.id for r in rows.collect()))) == [n for n in range(10) if n != 3]
    assert sorted(seen) == [i for i in range(100) if not 30 <= i < 40]


def test_rules(spark):
    from storyweft.operators import rules

    texts = spark.createDataFrame([(1, "s", "The Red Fox and the redder fox"), (2, "t", "nothing"), (3, "s", None), (4, "u", "ÉTÉ a1a1"), (5, None, "red")], "id long, source string, text string")
    table = [(1, "red", False), (2, "redder", False), (3, r"\bfox$", True), (4, "été", False), (5, r"(a1)\1", True), (6, "", False), (7, "RED", False), (8, "(?i:NOTH)", True), (9, None, False)]
    made = spark.createDataFrame(table, "rule long, pattern string, is_regex boolean")
    want = [(1, 1), (1, 2), (1, 3), (1, 7), (2, 8), (4, 4), (4, 5), (5, 1), (5, 7)]
    for how in ({}, {"block_rules": 2}, {"block_bytes": 4}):
        assert sorted(tuple(r) for r in rules.rule_hits(texts, made, **how).collect()) == want
    assert [rules.needed(p) for p in ("(^| )Wort", "a.cde+", "(abc)?", "abc|abd", "été123")] == ["wort", None, None, None, "123"]
    folded = rules.matcher([(1, "k(i)ste", True), (2, "miß", True), (3, "x?kiste", True)])
    assert folded("kıſte") == {1, 3} and folded("KISTE") == {1, 3} and folded("Miß") == {2}
    with pytest.raises(Exception, match="unterminated|missing"):
        rules.rule_hits(texts, spark.createDataFrame([(1, "(", True)], "rule long, pattern string, is_regex boolean"))
    keywords = spark.createDataFrame([(1, "include", "red", False, 2, True), (1, "include", "fox", False, 1, None), (2, "include", "red", False, 1, True), (2, "exclude", "fox", False, 1, True), (3, "include", "n", False, 5, False)], "topic_id int, rule_type string, pattern string, is_regex boolean, weight int, enabled boolean")
    sources = spark.createDataFrame([(2, "u", "include"), (1, "t", "exclude")], "topic_id int, source string, rule_type string")
    assert sorted(tuple(r) for r in rules.topics(texts, keywords, sources).collect()) == [(1, 1, 3, 2), (5, 1, 2, 1)]
    assert rules.topics(texts, keywords.limit(0), sources).count() == 0


def test_deep_json(spark):
    from storyweft.sources import items

    deep = "[" * 1500 + "]" * 1500
    assert items.canonical_json(deep) == deep and items.canonical_json('{"b":[1.50,{}],"a":{"y":[],"x":"<"}}') == '{"a":{"x":"\\u003c","y":[]},"b":[1.50,{}]}'
    too_deep = "[" * 300_000 + "]" * 300_000
    df = spark.createDataFrame([(deep,), (too_deep,), (None,)], "p string")
    assert df.select(items.payload_hash("p").alias("h")).filter("h IS NULL").count() == 1
