"""Conversation structure repair by a min-plus scan of 4x4 matrices over (cost, audit).

A conversation is repaired by the cheapest edits of its turns that leave the roles (system)? (user assistant)+, or nothing.
States: 0 nothing yet, 1 after the system turn, 2 after a user turn, 3 after an assistant turn. A turn is a matrix of its
edits from state to state, with the closure of insertions before it; a conversation is the product of its turns'
matrices and a last closure. Elements are pairs of a cost and the edits' initials, the least cost first, then the least
initials in ASCII. The product is associative: of two elements that compete, neither's initials are a prefix of the
other's, as they hold the same turns, and one insertion more would cost more.

Turns are ordered by conversation and turn over range partitions, so that a conversation may lie in many. A task reduces
what it holds of each conversation as a tree, and finishes those that lie in it whole. Partial products of the others
meet by eighths of the partitions, level by level. The digest of a repaired conversation is sequential by definition: the
turns of a conversation that is cut, or longer than KEPT_BYTES, pass once more through one task, streaming, behind its audit.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storyweft.llm.common import extended, saved, small

BLANKS = " \t\n\v\f\r"
DELETE, REROLE, INSERT, TRUNCATED = 4, 3, 3, 3
#: Bytes of turns that a range partition aims at.
PART_BYTES = 32 << 20
#: Bytes of a conversation's turns that a task keeps for its digest; a longer one streams through a second pass.
KEPT_BYTES = 4 << 20
#: Partial products that meet in one step.
FAN = 8

#: Where a user and an assistant turn lead from each state; None: not allowed.
USER, ASSISTANT = (2, 2, None, 2), (None, None, 3, None)
SYSTEM = (1, None, None, None)
NEXT = {"s": SYSTEM, "u": USER, "a": ASSISTANT}

Matrix = tuple  # 16 elements (cost, audit) or None, by rows


def _better(x, y):
    return y if x is None or (y is not None and y < x) else x


def product(a: Matrix, b: Matrix) -> Matrix:
    out = [None] * 16
    for i in range(4):
        for k in range(4):
            x = a[4 * i + k]
            if x is None:
                continue
            for j in range(4):
                y = b[4 * k + j]
                if y is None:
                    continue
                best, cost = out[4 * i + j], x[0] + y[0]
                if best is None or cost < best[0] or (cost == best[0] and x[1] + y[1] < best[1]):
                    out[4 * i + j] = (cost, x[1] + y[1])
    return tuple(out)


def _single() -> Matrix:
    m = [None] * 16
    for step in (USER, ASSISTANT):
        for i, j in enumerate(step):
            if j is not None:
                m[4 * i + j] = (INSERT, "I")
    return tuple(m)


IDENTITY: Matrix = tuple((0, "") if i % 5 == 0 else None for i in range(16))


def _closure() -> Matrix:
    """Any number of insertions: powers until nothing gets better."""
    one = tuple(_better(x, y) for x, y in zip(IDENTITY, _single()))
    whole = one
    while (more := product(whole, one)) != whole:
        whole = more
    return whole


CLOSURE = _closure()


def edits(code: str) -> Matrix:
    """A turn's matrix without insertions. code: role's initial (x if it is none of s, u, a), upper case if the text is
    truncated, d if the turn has to go."""
    m: list = [(DELETE, "D") if i % 5 == 0 else None for i in range(16)]
    if code != "d":
        extra = TRUNCATED if code.isupper() else 0
        moves = [(NEXT.get(code.lower(), ()), extra, "K"), (USER, REROLE + extra, "R"), (ASSISTANT, REROLE + extra, "R")]
        for step, cost, letter in moves:
            for i, j in enumerate(step):
                if j is not None:
                    m[4 * i + j] = _better(m[4 * i + j], (cost, letter))
    return tuple(m)


@lru_cache(maxsize=1 << 14)
def _few(codes: str) -> Matrix:
    if len(codes) == 1:
        return product(CLOSURE, edits(codes))
    half = len(codes) // 2
    return product(_few(codes[:half]), _few(codes[half:]))


def reduced(codes: str) -> Matrix:
    """The product of turns, as a balanced tree; runs of up to eight turns are remembered."""
    if not codes:
        return IDENTITY
    level = [_few(codes[i : i + 8]) for i in range(0, len(codes), 8)]
    while len(level) > 1:
        level = [product(*level[i : i + 2]) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0]


def finished(m: Matrix) -> tuple[int, str]:
    """The cheapest way from nothing to nothing, or to an assistant turn."""
    done = product(m, CLOSURE)
    return min(x for x in (done[0], done[3]) if x is not None)


class Repairer:
    """Takes a conversation's turns in order and gives the repaired (edit, role, text) as its audit says."""

    def __init__(self, audit: str):
        self.audit, self.at, self.last = audit, 0, ""

    def _due(self) -> str:
        return "assistant" if self.last == "u" else "user"

    def _inserted(self) -> Iterator[tuple[str, str, str]]:
        while self.audit[self.at : self.at + 1] == "I":
            self.at += 1
            role = self._due()
            self.last = role[0]
            yield "I", role, ""

    def turn(self, role: str, text: str) -> Iterator[tuple[str, str, str]]:
        yield from self._inserted()
        edit = self.audit[self.at]
        self.at += 1
        if edit != "D":
            role = self._due() if edit == "R" else role
            self.last = role[:1]
            yield edit, role, text

    def end(self) -> Iterator[tuple[str, str, str]]:
        yield from self._inserted()


class Digest:
    def __init__(self):
        self.sum, self.lines = hashlib.sha256(), 0

    def add(self, turns) -> None:
        for _, role, text in turns:
            self.sum.update((("\n" if self.lines else "") + f"{role}:{text}").encode("utf-8", "surrogatepass"))
            self.lines += 1


def ordered_turns(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", gone: str | None = None) -> DataFrame:
    """conv_id, turn, role, text, gone, row and the keys that order turns: conversation, turn (null first), role, then the text's first 64
    characters and its digest; equal turns by the place where they lie. Null roles and texts are one space. gone: a
    boolean column; such rows only keep their conversation in the result. Written to the shared folder."""
    role, text = F.coalesce(F.col(role_col).cast("string"), F.lit(" ")), F.coalesce(F.col(text_col).cast("string"), F.lit(" "))
    out = rows.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), role.alias("role"), text.alias("text"), (F.col(gone) if gone else F.lit(False)).alias("gone"))
    digest = F.unhex(F.sha2(F.concat(F.char_length("role").cast("string"), F.lit(":"), "role", "text").cast("binary"), 256))
    return saved(out.withColumns({"head": F.substring("text", 1, 64), "digest": digest, "row": F.monotonically_increasing_id()}), "turns")


ORDER = ["conv_id", "turn", "role", "head", "digest", "row"]

PARTIAL = {
    "part": "int", "done": "boolean", "rows": "long", "blank": "long", "duplicate": "long", "truncated": "long", "illegal": "long", "first_initial": "string", "last_initial": "string",
    "first_turn": "long", "last_turn": "long", "n_turns": "long", "costs": "array<long>", "audits": "array<string>", "cost": "long", "audit": "string", "repaired_sha256": "string",
}
LEGAL = {"su", "ua", "au"}


class Segment:
    """What a task knows of one conversation."""

    def __init__(self, conv):
        self.conv, self.codes, self.turns, self.size = conv, [], [], 0
        self.rows = self.blank = self.duplicate = self.truncated = self.illegal = self.n_turns = 0
        self.first = self.last = self.first_turn = self.last_turn = None

    def add(self, turn, role: str, text: str, again: bool) -> None:
        initial, body = role[:1], text.rstrip(BLANKS)
        cut = False
        if not body:
            self.blank += 1
        elif again:
            self.duplicate += 1
        elif body[-1] not in ".!?":
            self.truncated += 1
            cut = True
        code = "d" if not body or again else initial if initial in ("s", "u", "a") else "x"
        self.codes.append(code.upper() if cut else code)
        if self.rows:
            self.illegal += self.last + initial not in LEGAL
        else:
            self.first = initial
        self.last = initial
        self.rows += 1
        if turn is not None and turn != self.last_turn:
            self.n_turns += 1
            self.first_turn = turn if self.first_turn is None else self.first_turn
            self.last_turn = turn
        self.size += len(role) + len(text)
        if self.turns is not None:
            self.turns.append((role, text))
            if self.size > KEPT_BYTES:
                self.turns = None

    def row(self, part: int, whole: bool) -> dict:
        m = reduced("".join(self.codes))
        out = {
            "conv_id": self.conv, "part": part, "done": whole and self.turns is not None, "rows": self.rows, "blank": self.blank, "duplicate": self.duplicate, "truncated": self.truncated, "illegal": self.illegal,
            "first_initial": self.first, "last_initial": self.last, "first_turn": self.first_turn, "last_turn": self.last_turn, "n_turns": self.n_turns,
        }
        if not out["done"]:
            return out | {"costs": [x and x[0] for x in m], "audits": [x and x[1] for x in m]}
        cost, audit = finished(m)
        digest, repairer = Digest(), Repairer(audit)
        for role, text in self.turns:
            digest.add(repairer.turn(role, text))
        digest.add(repairer.end())
        return out | {"cost": cost, "audit": audit, "repaired_sha256": digest.sum.hexdigest()}


def _segments(turns: DataFrame) -> DataFrame:
    """PARTIAL rows of sorted range partitions: done, where a conversation lies whole inside one."""
    schema = extended(turns.select("conv_id"), **PARTIAL)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        kind, part, own, n, out = to_arrow_schema(schema), TaskContext.get().partitionId(), None, 0, []
        for batch in batches:
            for lo in range(0, batch.num_rows, 2048):
                piece = batch.slice(lo, 2048)
                for conv, turn, role, text, gone, again in zip(*(c.to_pylist() for c in piece.columns)):
                    if own is None or conv != own.conv:
                        if own is not None:
                            out.append(own.row(part, n > 1))
                        own, n = Segment(conv), n + 1
                    if not gone:
                        own.add(turn, role, text, again)
                if len(out) >= 512:
                    yield pa.RecordBatch.from_pylist(out, schema=kind)
                    out = []
        if own is not None:
            out.append(own.row(part, False))  # the first and the last may go on in the next partition
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=kind)

    return turns.select("conv_id", "turn", "role", "text", "gone", "again").mapInArrow(fold, schema)


def joined(a: dict, b: dict) -> dict:
    """Two neighbouring partial rows as one; an associative operation with rows of no turns as its neutral elements."""
    if not b["rows"] or not a["rows"]:
        return a if a["rows"] else b
    m = product(*(tuple(None if c is None or c != c else (int(c), s) for c, s in zip(x["costs"], x["audits"])) for x in (a, b)))
    out = {k: a[k] + b[k] for k in ("rows", "blank", "duplicate", "truncated", "n_turns")}
    out["illegal"] = a["illegal"] + b["illegal"] + (a["last_initial"] + b["first_initial"] not in LEGAL)
    out["n_turns"] -= a["last_turn"] is not None and a["last_turn"] == b["first_turn"]
    first = b["first_turn"] if a["first_turn"] is None else a["first_turn"]
    last = a["last_turn"] if b["last_turn"] is None else b["last_turn"]
    return a | out | {"first_initial": a["first_initial"], "last_initial": b["last_initial"], "first_turn": first, "last_turn": last, "costs": [x and x[0] for x in m], "audits": [x and x[1] for x in m]}


def _met(open_rows: DataFrame) -> DataFrame:
    """One row a conversation of its partial rows: FAN neighbouring partitions at a time, level by level, until the last
    partition that gave one and the first are neighbours."""
    schema, parts = open_rows.schema, (open_rows.agg(F.max("part")).first()[0] or 0) + 1

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = None
        for batch in batches:
            for r in batch.to_pylist():
                same = own is not None and r["conv_id"] == own["conv_id"] and r["part"] // FAN == own["part"] // FAN
                if own is not None and not same:
                    yield pa.RecordBatch.from_pylist([own | {"part": own["part"] // FAN}], schema=batch.schema)
                own = joined(own, r) | {"conv_id": r["conv_id"], "part": r["part"]} if same else r
        if own is not None:
            yield pa.RecordBatch.from_pylist([own | {"part": own["part"] // FAN}], schema=batch.schema)

    while parts > 1:
        node = F.floor(F.col("part") / FAN)
        open_rows = open_rows.repartition(F.col("conv_id"), node).sortWithinPartitions("conv_id", "part").mapInArrow(meet, schema)
        parts = math.ceil(parts / FAN)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                r["cost"], r["audit"] = finished(tuple(None if c is None else (c, s) for c, s in zip(r["costs"], r["audits"])))
                out.append(r | {"costs": None, "audits": None})
            yield pa.RecordBatch.from_pylist(out, schema=batch.schema)

    return open_rows.mapInArrow(finish, schema)


def _walked(turns: DataFrame, audits: DataFrame, schema, start, row, end) -> DataFrame:
    """Streams the turns of the conversations of audits (conv_id, audit) in order, each behind its audit, one task a conversation."""
    head = audits.select("conv_id", F.lit(0).alias("lead"), F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"), F.col("audit").alias("text"), F.lit("").alias("head"), F.lit(None).cast("binary").alias("digest"), F.lit(0).cast("long").alias("row"))
    ids = small(saved(audits.select(F.col("conv_id").alias("__c")), "conversations"))
    body = turns.filter("NOT gone").join(ids, F.col("conv_id").eqNullSafe(F.col("__c")), "left_semi").select("conv_id", F.lit(1).alias("lead"), *ORDER[1:4], "digest", "row", "text")

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        kind, state, out = to_arrow_schema(schema), None, []
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                for conv, lead, turn, role, text in zip(*(c.to_pylist() for c in batch.slice(lo, 1024).columns)):
                    if lead == 0:
                        if state is not None:
                            out += end(state)
                        state = start(conv, text)
                    else:
                        out += row(state, turn, role, text)
                if len(out) >= 1024:
                    yield pa.RecordBatch.from_pylist(out, schema=kind)
                    out = []
        if state is not None:
            out += end(state)
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=kind)

    return head.unionByName(body).repartition("conv_id").sortWithinPartitions("conv_id", "lead", *ORDER[1:]).select("conv_id", "lead", "turn", "role", "text").mapInArrow(walk, schema)


def marked(turns: DataFrame) -> DataFrame:
    """turns with again: whether role and text were seen earlier in the conversation. First places are summed by key,
    which combines before it moves; only texts that repeat are joined back."""
    first = turns.filter("NOT gone").groupBy("conv_id", "digest").agg(F.min(F.struct("turn", "row")).alias("first"), F.count("*").alias("n")).filter("n > 1")
    first = small(saved(first.select(F.col("conv_id").alias("__c"), F.col("digest").alias("__d"), F.col("first.row").alias("__first")), "repeated-turns"))
    met = turns.join(first, F.col("conv_id").eqNullSafe(F.col("__c")) & (F.col("digest") == F.col("__d")), "left")
    return met.withColumn("again", F.coalesce(F.col("__first") != F.col("row"), F.lit(False))).drop("__c", "__d", "__first")


RESULT = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def repair(turns: DataFrame, part_bytes: int = PART_BYTES) -> DataFrame:
    """conv_id and RESULT, a row for each conversation of turns as ordered_turns() gives them (a null id is a conversation).

    A turn's first fault counts: blank, duplicate (role and text seen earlier), truncated (the last character that is no
    blank is not one of .!?). gaps: turn numbers missing between the least and the greatest. illegal: neighbours whose
    roles' initials are not su, ua, au. cost, audit: the cheapest edits' initials in order, the least in ASCII among equal costs: K keep, R give it
    the role that is due, D delete, I insert an empty turn. A conversation whose turns are all gone has zeros, an empty
    audit and the digest of nothing."""
    rows, size = turns.agg(F.count("*"), F.sum(F.length("text") + 64)).first()
    parts = max(turns.sparkSession.sparkContext.defaultParallelism, math.ceil((size or 0) / part_bytes)) if rows else 1
    ranged = marked(turns).repartitionByRange(parts, *ORDER).sortWithinPartitions(*ORDER)
    found = saved(_segments(ranged), "conversation-parts")
    cut = saved(_met(found.filter("NOT done")), "conversation-audits")
    schema = extended(cut.select("conv_id"), repaired_sha256="string")

    def row(state, _turn, role, text):
        state[2].add(state[1].turn(role, text))
        return ()

    def end(state):
        state[2].add(state[1].end())
        return [{"conv_id": state[0], "repaired_sha256": state[2].sum.hexdigest()}]

    digests = _walked(turns, cut, schema, lambda conv, audit: (conv, Repairer(audit), Digest()), row, end)
    digests = digests.select(F.col("conv_id").alias("__c"), F.col("repaired_sha256").alias("__sha"))
    late = cut.join(digests, F.col("conv_id").eqNullSafe(F.col("__c"))).withColumn("repaired_sha256", F.col("__sha")).drop("__c", "__sha")
    gaps = F.coalesce(F.col("last_turn") - F.col("first_turn") + 1 - F.col("n_turns"), F.lit(0)).alias("gaps")
    return found.filter("done").unionByName(late).select("conv_id", gaps, *RESULT[1:])


def repaired_turns(turns: DataFrame, repairs: DataFrame) -> DataFrame:
    """conv_id, place (from 0), turn (null if inserted), role, text, edit: conversations as repair() mends them, in its order.
    A conversation streams through one task."""
    schema = extended(turns.select("conv_id"), place="long", turn="long", role="string", text="string", edit="string")

    def emit(state, turn, mended):
        for edit, role, text in mended:
            yield {"conv_id": state[0], "place": state[2], "turn": None if edit == "I" else turn, "role": role, "text": text, "edit": edit}
            state[2] += 1

    return _walked(turns, repairs.select("conv_id", "audit"), schema, lambda conv, audit: [conv, Repairer(audit), 0], lambda s, turn, role, text: emit(s, turn, s[1].turn(role, text)), lambda s: emit(s, None, s[1].end()))


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, gone: each row by crc32(conv_id:turn) % 20 (nulls are one space): 0 is gone, 1 has an empty text,
    2 has lost its .!?, 3 comes twice, 4 says that it is the user's."""
    space = F.lit(" ")
    text, role = F.coalesce(F.col("text").cast("string"), space), F.coalesce(F.col("role").cast("string"), space)
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    kind = F.crc32(key.cast("binary")) % 20
    rows = conversations.select("conv_id", "turn", role.alias("role"), text.alias("text"), kind.alias("kind"))
    text = F.when(F.col("kind") == 1, F.lit("")).when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, F.lit("user")).otherwise(F.col("role"))
    copies = F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("kind") == 0).alias("gone"), copies.alias("copy")).drop("copy")


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = damaged(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    return repair(ordered_turns(rows, gone="gone"))


#: One step a turn: the four states' (cost, audit, repaired text), insertions first, then the turn's edits. crc32 is worked out bit by bit.
OP12_SQL = r"""
WITH RECURSIVE given AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, encode(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')) AS k FROM conversations
), kinds AS (
  SELECT conv_id, turn, role, text, xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(range(1, octet_length(k) + 1), lambda i:
    list_prepend(ascii(decode(k[i:i]))::BIGINT, [-1, -1, -1, -1, -1, -1, -1, -1]::BIGINT[])))), lambda s, x:
      CASE WHEN x >= 0 THEN xor(s, x) ELSE xor(s >> 1, 3988292384 * (s & 1)) END), 4294967295::BIGINT) % 20 AS kind FROM given
), turns AS (
  SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(CASE kind WHEN 0 THEN [] WHEN 3 THEN [1, 2] ELSE [1] END) AS copy FROM kinds
), placed AS (
  SELECT *, row_number() OVER w AS n, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS again, left(role, 1) AS i, lag(left(role, 1)) OVER w AS before,
    rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS body
  FROM turns WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy)
), judged AS (
  SELECT *, CASE WHEN body = '' THEN 'blank' WHEN again > 1 THEN 'duplicate' WHEN right(body, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault FROM placed
), step AS (
  SELECT *, fault IN ('blank', 'duplicate') AS goes, CASE fault WHEN 'truncated' THEN 3 ELSE 0 END AS more FROM judged
), walk(conv_id, n, s0, s1, s2, s3) AS (
  SELECT DISTINCT conv_id, 0::BIGINT, {'c': 0::BIGINT, 'a': '', 'r': ''}, NULL::STRUCT(c BIGINT, a VARCHAR, r VARCHAR), NULL::STRUCT(c BIGINT, a VARCHAR, r VARCHAR), NULL::STRUCT(c BIGINT, a VARCHAR, r VARCHAR) FROM given
  UNION ALL
  SELECT conv_id, n,
    list_min([CASE WHEN s0 IS NOT NULL THEN {'c': s0.c + 4, 'a': s0.a || 'D', 'r': s0.r} END]),
    list_min([CASE WHEN s1 IS NOT NULL THEN {'c': s1.c + 4, 'a': s1.a || 'D', 'r': s1.r} END, CASE WHEN s0 IS NOT NULL AND i = 's' AND NOT goes THEN {'c': s0.c + more, 'a': s0.a || 'K', 'r': s0.r || chr(10) || line} END]),
    list_min([CASE WHEN c2 IS NOT NULL THEN {'c': c2.c + 4, 'a': c2.a || 'D', 'r': c2.r} END] || flatten(list_transform([s0, s1, c3], lambda s: CASE WHEN s IS NULL OR goes THEN [] ELSE
      [CASE WHEN i = 'u' THEN {'c': s.c + more, 'a': s.a || 'K', 'r': s.r || chr(10) || line} END, {'c': s.c + 3 + more, 'a': s.a || 'R', 'r': s.r || chr(10) || 'user:' || text}] END))),
    list_min([CASE WHEN c3 IS NOT NULL THEN {'c': c3.c + 4, 'a': c3.a || 'D', 'r': c3.r} END] || flatten(list_transform([c2], lambda s: CASE WHEN s IS NULL OR goes THEN [] ELSE
      [CASE WHEN i = 'a' THEN {'c': s.c + more, 'a': s.a || 'K', 'r': s.r || chr(10) || line} END, {'c': s.c + 3 + more, 'a': s.a || 'R', 'r': s.r || chr(10) || 'assistant:' || text}] END)))
  FROM (
    SELECT *, list_min([s3, CASE WHEN c2 IS NOT NULL THEN {'c': c2.c + 3, 'a': c2.a || 'I', 'r': c2.r || chr(10) || 'assistant:'} END]) AS c3 FROM (
      SELECT walk.conv_id, step.n, s0, s1, s3, role || ':' || text AS line, text, i, goes, more,
        list_min([s2] || list_transform([s0, s1, s3], lambda s: CASE WHEN s IS NOT NULL THEN {'c': s.c + 3, 'a': s.a || 'I', 'r': s.r || chr(10) || 'user:'} END)) AS c2
      FROM walk JOIN step ON step.conv_id IS NOT DISTINCT FROM walk.conv_id AND step.n = walk.n + 1))
), ended AS (
  SELECT conv_id, list_min([s0, s3] || list_transform(list_filter([s2] || list_transform([s0, s1, s3], lambda s: CASE WHEN s IS NOT NULL THEN {'c': s.c + 3, 'a': s.a || 'I', 'r': s.r || chr(10) || 'user:'} END), lambda s: s IS NOT NULL),
    lambda s: {'c': s.c + 3, 'a': s.a || 'I', 'r': s.r || chr(10) || 'assistant:'})) AS best
  FROM walk QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY n DESC) = 1
), counted AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
    count(*) FILTER (before IS NOT NULL AND before || i NOT IN ('su', 'ua', 'au')) AS illegal FROM judged GROUP BY conv_id
)
SELECT e.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal,
  best.c AS cost, best.a AS audit, sha256(best.r[2:]) AS repaired_sha256
FROM ended e LEFT JOIN counted c ON c.conv_id IS NOT DISTINCT FROM e.conv_id
"""
