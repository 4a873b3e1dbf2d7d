"""Conversation repair against plain recursion over the turns."""

import hashlib
import random
import re
import zlib
from functools import lru_cache

import pytest
from pyspark.sql import functions as F

from storyweft.llm import queries, turns

from .. import oracle

BLANK = " \t\n\v\f\r"
PATTERN = re.compile("(s?(ua)+)?")


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        show = lambda x: " " if x is None else str(x)
        kind, role, text = zlib.crc32(f"{show(conv)}:{show(turn)}".encode()) % 20, show(role), show(text)
        if kind:
            row = (turn, "user" if kind == 4 else role, "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text)
            out += [(conv, *row)] * (2 if kind == 3 else 1)
    return out


def brute(own):
    """RESULT of one conversation's rows (turn, role, text), from the end by states."""
    own = sorted(own, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    seen, faults = set(), []
    for _, role, text in own:
        body = text.rstrip(BLANK)
        faults.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "")
        seen.add((role, text))

    @lru_cache(None)
    def best(i, done, spare=3):
        """Least (cost, audit, roles) from turn i on, after the roles done (only the last counts, and whether there are any)."""
        ways = []
        if i == len(own):
            if done in ("", "a"):
                ways.append((0, "", ()))
        else:
            role, extra = own[i][1], 3 if faults[i] == "truncated" else 0
            ways.append(add(4, "D", None, best(i + 1, done)))
            if faults[i] not in ("blank", "duplicate"):
                for new, cost, letter in ((role, extra, "K"), ("user", 3 + extra, "R"), ("assistant", 3 + extra, "R")):
                    if fits(done, new[:1]):
                        ways.append(add(cost, letter, (new, own[i][2]), best(i + 1, new[:1])))
        for new in ("user", "assistant"):
            if spare and fits(done, new[0]):
                ways.append(add(3, "I", (new, ""), best(i, new[0], spare - 1)))
        return min((w for w in ways if w is not None), default=None)

    def fits(done, new):
        return new == "s" and done == "" or new == "u" and done in ("", "s", "a") or new == "a" and done == "u"

    def add(cost, letter, turn, rest):
        return rest and (cost + rest[0], letter + rest[1], (() if turn is None else (turn,)) + rest[2])

    cost, audit, mended = best(0, "")
    assert PATTERN.fullmatch("".join(r[0] for r, _ in mended))
    numbers = {t for t, _, _ in own if t is not None}
    gaps = max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:]))
    digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in mended).encode()).hexdigest()
    return (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, digest), mended


def rows_at_random(seed, n=60, most=9):
    rng = random.Random(seed)
    rows = []
    for conv in range(n):
        for turn in range(rng.randint(1, most)):
            text = rng.choice(["One.", "Two?", "three", "", " \n", "Vier!", "été", None, "x. "])
            rows.append((conv if conv else None, rng.choice([turn, turn, turn, None, 2 * turn, 0]), rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "s"]), text))
    return rows


SCHEMA = "conv_id long, turn long, role string, text string"


def check(spark, rows, **how):
    got = {r.conv_id: tuple(r[c] for c in turns.RESULT) for r in turns.repair(turns.ordered_turns(turns.damaged(spark.createDataFrame(rows, SCHEMA)), gone="gone"), **how).collect()}
    own = {conv: [] for conv, *_ in rows}
    for conv, *rest in damage(rows):
        own[conv].append(tuple(rest))
    assert got == {conv: brute(r)[0] for conv, r in own.items()}


def test_whole_table(spark, sf_dir):
    oracle.same(queries.QUERIES["op12_conversation_repair"](spark, sf_dir), turns.OP12_SQL, oracle.connect(sf_dir))


def test_brute_force(spark):
    check(spark, rows_at_random(1) + [(900, t, "user" if t % 2 else "assistant", "Again." if t % 3 else "Cut") for t in range(300)])


def test_cut_conversations(spark, monkeypatch):
    """Small partitions: conversations lie in many, and most end in the second pass."""
    monkeypatch.setattr(turns, "FAN", 2)
    check(spark, rows_at_random(2, 12) + [(7, t, random.Random(t).choice(["user", "assistant", "system"]), random.Random(-t).choice(["Same.", f"No {t}.", "open"])) for t in range(9, 260)], part_bytes=800)


def test_long_texts(spark):
    check(spark, [(1, 1, "user", "word " * 900_000 + "end."), (1, 2, "assistant", "Yes."), (2, 0, "user", None), (3, None, None, None)])


def test_product_is_associative():
    rng = random.Random(3)
    code = lambda n: "".join(rng.choices("sSuUaAxXd", k=n))
    for _ in range(60):
        a, b, c = (turns.reduced(code(rng.randint(0, 20))) for _ in range(3))
        assert turns.product(turns.product(a, b), c) == turns.product(a, turns.product(b, c))
    for n in (1, 5, 40):
        codes = code(n)
        one_by_one = turns.IDENTITY
        for x in codes:
            one_by_one = turns.product(one_by_one, turns.product(turns.CLOSURE, turns.edits(x)))
        assert one_by_one == turns.reduced(codes)


def test_repaired_turns(spark):
    rows = rows_at_random(4, 25)
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("x") for c in ("row", "head", "again", "audit", "digest", "lead")})
    ordered = turns.ordered_turns(turns.damaged(df), gone="gone")
    got = turns.repaired_turns(ordered, turns.repair(ordered)).orderBy("conv_id", "place").collect()
    mended = {conv: [] for conv, *_ in rows}
    for r in got:
        assert len(mended[r.conv_id]) == r.place and (r.turn is None or r.edit != "I")
        mended[r.conv_id].append((r.role, r.text))
    own = {conv: [] for conv, *_ in rows}
    for conv, *rest in damage(rows):
        own[conv].append(tuple(rest))
    assert mended == {conv: list(brute(r)[1]) for conv, r in own.items()}


def test_empty(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert turns.repair(turns.ordered_turns(none)).collect() == []
    alone = turns.repair(turns.ordered_turns(spark.createDataFrame([(5, 1, "user", "gone")], SCHEMA).withColumn("gone", F.lit(True)), gone="gone")).first()
    assert tuple(alone) == (5, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    with pytest.raises(Exception):
        turns.ordered_turns(none.drop("role"))
