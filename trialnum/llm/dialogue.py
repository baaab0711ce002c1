"""Repair of conversations: the cheapest edits that give a legal order of roles.

A legal conversation has role initials ``(s?(ua)+)?``. Every row is kept, reroled or deleted, and empty
user or assistant turns may be inserted. The audit of a conversation is the initials of its edits in
order; of the cheapest audits the least one in ASCII order counts.

The dynamic programme goes over a conversation's rows with four states of the order of roles. Audits that
begin alike share their beginning: an audit is a node of a tree with its parent, its ancestors 1, 2, 4, ...
steps back and a rolling hash; two audits of equal cost are compared at the end of their longest common
prefix, which the ancestors' hashes find and the nodes themselves confirm.

Rows are sorted over all conversations and cut into blocks of a fixed number of rows. A block's part of a
conversation is a table from entry state to exit state, and such tables are joined in a fixed number of rounds,
so that a conversation of any length is spread over tasks. Within a part audits end with the edit of a row,
so of two different ones none begins the other, and the least whole audit is made of the least parts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trialnum.llm.shared import arrow_schema, materialize

BLOCK_BITS, WIDE_BITS = 10, 6  # rows of a block, blocks joined first; both as powers of two
PLACE_BITS = 33  # bits of a row's place within its partition
COSTS = {"K": 0, "R": 2, "D": 3, "I": 2, "truncated": 1}
HASH_BASE, HASH_MODULUS = 1_000_003, (1 << 61) - 1
# states: nothing kept yet, after the system turn, after a user turn, after an assistant turn
KEEPS = {"s": ((0, 1),), "u": ((0, 2), (1, 2), (3, 2)), "a": ((2, 3),)}
NEXT_TURN = {0: ("user", 2), 1: ("user", 2), 2: ("assistant", 3), 3: ("user", 2)}
NOT_SPACE = "[^\\x20\\x09-\\x0D]"
PATHS = "array<struct<entry: int, exit: int, cost: long, audit: string>>"


class Audits:
    """Strings that share their beginnings, as nodes: each adds one letter to its parent."""

    def __init__(self) -> None:
        self.letter, self.depth, self.hash = [""], [0], [0]
        self.ancestors: list[list[int]] = [[]]  # 1, 2, 4, ... letters back

    def add(self, node: int, letters: str) -> int:
        for letter in letters:
            up, k = [node], 0
            while k < len(self.ancestors[up[k]]):
                up.append(self.ancestors[up[k]][k])
                k += 1
            self.letter.append(letter)
            self.depth.append(self.depth[node] + 1)
            self.hash.append((self.hash[node] * HASH_BASE + ord(letter)) % HASH_MODULUS)
            self.ancestors.append(up)
            node = len(self.letter) - 1
        return node

    def back(self, node: int, depth: int) -> int:
        """The ancestor of ``node`` that has ``depth`` letters."""
        steps = self.depth[node] - depth
        while steps:
            k = steps.bit_length() - 1
            node, steps = self.ancestors[node][k], steps - (1 << k)
        return node

    def spelled(self, node: int) -> str:
        letters = []
        while node:
            letters.append(self.letter[node])
            node = self.ancestors[node][0]
        return "".join(reversed(letters))

    def same(self, a: int, b: int) -> bool:
        """Whether two nodes of equal depth and hash spell the same, down to the node they share."""
        while a != b:
            if self.letter[a] != self.letter[b]:
                return False
            a, b = self.ancestors[a][0], self.ancestors[b][0]
        return True

    def less(self, a: int, b: int) -> bool:
        depth = min(self.depth[a], self.depth[b])
        x, y = self.back(a, depth), self.back(b, depth)
        if self.hash[x] == self.hash[y]:
            return self.depth[a] < self.depth[b] if self.same(x, y) else self.spelled(a) < self.spelled(b)
        for k in range(len(self.ancestors[x]) - 1, -1, -1):
            if k < len(self.ancestors[x]):
                up, vp = self.ancestors[x][k], self.ancestors[y][k]
                if self.hash[up] != self.hash[vp]:
                    x, y = up, vp
        # one letter back they have the same hash: the end of the common prefix
        if self.same(self.ancestors[x][0], self.ancestors[y][0]):
            return self.letter[x] < self.letter[y]
        return self.spelled(a) < self.spelled(b)


def _least(audits: Audits, options: list[tuple[int, int, str]]) -> tuple[int, int] | None:
    """(cost, node) of the cheapest of (cost, node, letters to add), of equal ones the least audit."""
    if not options:
        return None
    cost = min(o[0] for o in options)
    nodes = [audits.add(node, letters) for c, node, letters in options if c == cost]
    best = nodes[0]
    for node in nodes[1:]:
        if audits.less(node, best):
            best = node
    return cost, best


def best_paths(rows: list[tuple[str, bool, bool]], entry: int) -> list[tuple[int, int, str]]:
    """(exit state, cost, audit) from one entry state over rows of (role initial, must be deleted, truncated)."""
    audits = Audits()
    states: list[tuple[int, int] | None] = [None] * 4
    states[entry] = (0, 0)
    for initial, must_go, truncated in rows:
        # what is inserted before the row: one turn, or two where nothing or only a system turn is there
        before: list[list[tuple[int, int, str]]] = [[], [], [], []]
        for state, reached in enumerate(states):
            if reached is not None:
                cost, node = reached
                before[state].append((cost, node, ""))
                one = NEXT_TURN[state][1]
                before[one].append((cost + COSTS["I"], node, "I"))
                if state < 2:
                    before[NEXT_TURN[one][1]].append((cost + 2 * COSTS["I"], node, "II"))
        after: list[list[tuple[int, int, str]]] = [[], [], [], []]
        for state, options in enumerate(before):
            for cost, node, letters in options:
                after[state].append((cost + COSTS["D"], node, letters + "D"))
                if not must_go:
                    stays = cost + (COSTS["truncated"] if truncated else 0)
                    after[NEXT_TURN[state][1]].append((stays + COSTS["R"], node, letters + "R"))
                    for start, end in KEEPS.get(initial, ()):
                        if start == state:
                            after[end].append((stays, node, letters + "K"))
        states = [_least(audits, options) for options in after]
    return [(state, reached[0], audits.spelled(reached[1])) for state, reached in enumerate(states) if reached is not None]


def _part(conv, block: int, rows: list[dict], firsts: set[int], edge: bool, starts_block: bool) -> dict:
    repeated = [r["place"] not in firsts and not r["blank"] for r in rows]
    plain = [(r["initial"], r["blank"] or again, r["truncated"] and not again) for r, again in zip(rows, repeated)]
    initials = [r["initial"] for r in rows]
    # a part that does not start its block starts its conversation
    entries = range(4) if starts_block else (0,)
    return {
        "conv_id": conv, "block": block, "edge": edge, "first": initials[0], "last": initials[-1],
        "blank": sum(r["blank"] for r in rows), "duplicate": sum(repeated), "truncated": sum(t for _, _, t in plain),
        "illegal": sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])),
        "paths": [
            {"entry": e, "exit": x, "cost": cost, "audit": audit} for e in entries for x, cost, audit in best_paths(plain, e)
        ],
    }


def _join_parts(parts: list[dict]) -> dict:
    """One part of consecutive parts of a conversation."""
    whole = dict(parts[0])
    for part in parts[1:]:
        for name in ("blank", "duplicate", "truncated", "illegal"):
            whole[name] += part[name]
        whole["illegal"] += whole["last"] + part["first"] not in ("su", "ua", "au")
        whole["last"] = part["last"]
        best: dict[tuple[int, int], tuple[int, str]] = {}
        for a in whole["paths"]:
            for b in part["paths"]:
                if a["exit"] == b["entry"]:
                    key, option = (a["entry"], b["exit"]), (a["cost"] + b["cost"], a["audit"] + b["audit"])
                    best[key] = min(best.get(key, option), option)
        whole["paths"] = [{"entry": e, "exit": x, "cost": c, "audit": s} for (e, x), (c, s) in best.items()]
    return whole


def _parts_schema(conv: T.DataType) -> str:
    counts = ", ".join(f"{c} long" for c in ("blank", "duplicate", "truncated", "illegal"))
    return f"conv_id {conv.simpleString()}, block long, edge boolean, first string, last string, {counts}, paths {PATHS}"


def _ordered(turns: DataFrame) -> DataFrame:
    """Rows in a form that gives their order: turn (null first), role, SHA-256 of the text; rows equal in all are equal."""
    return turns.select(
        "conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"),
    ).withColumn("digest", F.unhex(F.sha2("text", 256)))


ORDER = ["conv_id", "turn", "role", "digest"]


def _parts(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Parts of conversations, one for each conversation and block; the sorted rows they are made of, without texts."""
    conv = turns.schema["conv_id"].dataType
    schema = _parts_schema(conv)
    arrow = arrow_schema(schema)
    blank = ~F.col("text").rlike(NOT_SPACE)
    ended = F.col("text").rlike("[.!?][\\x20\\x09-\\x0D]*+\\z")
    light = _ordered(turns).select(
        *ORDER, F.substring("role", 1, 1).alias("initial"), blank.alias("blank"), (~blank & ~ended).alias("truncated")
    )
    light = light.repartitionByRange(*ORDER).sortWithinPartitions(*ORDER)
    light = materialize(light.withColumn("place", F.monotonically_increasing_id()))
    block = F.shiftright("place", BLOCK_BITS).alias("block")
    firsts = light.groupBy("conv_id", "role", "digest").agg(F.min("place").alias("place")).select("place", block)
    rows = light.select("conv_id", "place", "initial", "blank", "truncated", block)

    def cut(left: pa.Table, right: pa.Table) -> pa.Table:
        found, firsts, parts = left.sort_by("place").to_pylist(), set(right["place"].to_pylist()), []
        at = 0
        while at < len(found):
            to, conv_id = at, found[at]["conv_id"]
            while to < len(found) and found[to]["conv_id"] == conv_id:
                to += 1
            edge = at == 0 or to == len(found)
            parts.append(_part(conv_id, found[at]["block"], found[at:to], firsts, edge, at == 0))
            at = to
        return pa.Table.from_pylist(parts, arrow)

    parts = rows.groupBy("block").cogroup(firsts.groupBy("block")).applyInArrow(cut, schema)
    return materialize(parts), light


def _joined_parts(parts: DataFrame, group: Column) -> DataFrame:
    """Parts of one conversation and group, in order of their blocks, made one."""
    schema = _parts_schema(parts.schema["conv_id"].dataType)
    arrow = arrow_schema(schema)

    def join(table: pa.Table) -> pa.Table:
        found = table.drop_columns(["_group"]).sort_by("block").to_pylist()
        return pa.Table.from_pylist([_join_parts(found)], arrow)

    return parts.withColumn("_group", group).groupBy("conv_id", "_group").applyInArrow(join, schema)


def audit_conversations(turns: DataFrame) -> DataFrame:
    """``(conv_id, turn, role, text)`` -> one row per conversation that has rows:

    ``gaps`` (missing turn numbers between the least and the largest), rows whose first fault is ``blank`` (no character
    but the six ASCII spaces), ``duplicate`` (role and text seen earlier) or ``truncated`` (the last other character is
    not one of ``.!?``), ``illegal`` neighbours, and the ``cost`` and ``audit`` of the cheapest edits.

    Costs: keep 0, rerole to user or assistant 2, delete 3 (required for blank and duplicate rows), insert an
    empty user or assistant turn 2; every truncated row that stays adds 1. Rows are taken by turn, null first; equal turns by
    role and SHA-256 of the text. Null role and text count as one space, so as an unknown role and a blank text; a
    role that begins with another letter, or is empty, cannot be kept. Null ids are one conversation. Turns so far
    apart that their number exceeds BIGINT have null gaps. An empty table gives no rows; other columns are ignored.
    """
    parts, light = _parts(turns)
    # only the first and the last part of a block can go on elsewhere; those are few
    edges = parts.where("edge")
    for bits in (WIDE_BITS, PLACE_BITS - BLOCK_BITS):
        edges = _joined_parts(edges, F.shiftright("block", bits))
    edges = _joined_parts(edges, F.lit(0))
    found = parts.where("not edge").unionByName(edges)
    # the end: after a user turn an assistant turn is missing, after the system turn both
    missing = lambda p: F.element_at(F.array(*map(F.lit, (0, 2, 1, 0))), p["exit"] + 1)
    ends = F.transform(
        F.filter("paths", lambda p: p["entry"] == 0),
        lambda p: F.struct(
            (p["cost"] + COSTS["I"] * missing(p)).alias("cost"), F.concat(p["audit"], F.repeat(F.lit("I"), missing(p))).alias("audit")
        ),
    )
    best = found.withColumn("_best", F.array_min(ends)).select(
        "conv_id", "blank", "duplicate", "truncated", "illegal", F.col("_best.cost").alias("cost"), F.col("_best.audit").alias("audit")
    )
    whole = lambda c: F.col(c).cast("decimal(38,0)")
    turn_sets = light.groupBy("conv_id", "turn").agg(F.count(F.lit(1)).alias("n")).groupBy("conv_id")
    spans = turn_sets.agg(F.min("turn").alias("low"), F.max("turn").alias("high"), F.count("turn").alias("turns"))
    gaps = F.coalesce(whole("high") - whole("low") + 1 - F.col("turns"), F.lit(0)).try_cast("long")
    spans = spans.select("conv_id", gaps.alias("gaps"))
    joined = best.unionByName(spans, allowMissingColumns=True)
    columns = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"]
    return joined.groupBy("conv_id").agg(*[F.first(c, ignorenulls=True).alias(c) for c in columns])


class _Editor:
    """Carries out one audit, row by row."""

    def __init__(self, audit: str) -> None:
        self.audit, self.at, self.state = audit, 0, 0

    def inserted(self) -> Iterator[tuple[str, str, str]]:
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            role, self.state = NEXT_TURN[self.state]
            self.at += 1
            yield "I", role, ""

    def row(self, role: str, text: str) -> Iterator[tuple[str, str, str]]:
        """(edit, role, text) of the turns up to and with this row; of a deleted row none."""
        yield from self.inserted()
        edit, self.at = self.audit[self.at], self.at + 1
        if edit == "D":
            return
        if edit == "R":
            role, self.state = NEXT_TURN[self.state]
        else:
            self.state = dict(KEEPS[role[0]])[self.state]
        yield edit, role, text


def _streamed(turns: DataFrame, audits: DataFrame, carry: list[str]) -> DataFrame:
    """Audits and rows of each conversation together, the audit first, the rows in their order."""
    rows = _ordered(turns).withColumn("_rank", F.lit(1))
    heads = audits.select("conv_id", "audit", *carry, F.lit(0).alias("_rank"))
    both = rows.unionByName(heads, allowMissingColumns=True).repartition("conv_id")
    return both.sortWithinPartitions("conv_id", "_rank", "turn", "role", "digest").drop("digest", "turn")


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict | None, Iterator[tuple[str, str, str]]]]:
    """(head, turns) steps: a head when a conversation begins, then the turns of each of its rows, and those after the last."""
    editor = head = None
    for batch in batches:
        for row in batch.to_pylist():
            if row["_rank"] == 0:
                if editor is not None:
                    yield head, editor.inserted()
                head, editor = row, _Editor(row["audit"] or "")
                yield head, iter(())
            else:
                yield head, editor.row(row["role"], row["text"])
    if editor is not None:
        yield head, editor.inserted()


def repaired_turns(turns: DataFrame, audits: DataFrame) -> DataFrame:
    """``(conv_id, position, edit, role, text)``: the turns that the audits make of ``turns``, positions from 0."""
    schema = f"conv_id {turns.schema['conv_id'].dataType.simpleString()}, position long, edit string, role string, text string"
    arrow = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, of, position = [], None, 0
        for head, found in _conversations(batches):
            if head is not of:
                of, position = head, 0
            for edit, role, text in found:
                rows.append({"conv_id": head["conv_id"], "position": position, "edit": edit, "role": role, "text": text})
                position += 1
            if len(rows) >= 1000:
                yield pa.RecordBatch.from_pylist(rows, arrow)
                rows = []
        yield pa.RecordBatch.from_pylist(rows, arrow)

    return _streamed(turns, audits, []).mapInArrow(run, schema)


def repaired_digests(turns: DataFrame, audits: DataFrame) -> DataFrame:
    """The columns of ``audits`` and ``repaired_sha256``: of the repaired ``role:text`` joined by newlines.

    A conversation's texts are hashed as they stream by in order, so memory does not grow with it. The hash of one
    string is one chain by definition, so this last step is one task for each conversation.
    """
    carry = [c for c in audits.columns if c not in ("conv_id", "audit")]
    fields = [*[audits.schema[c] for c in ("conv_id", *carry, "audit")], T.StructField("repaired_sha256", T.StringType())]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in fields)
    arrow = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, of, digest, count = [], None, hashlib.sha256(), 0
        for head, found in _conversations(batches):
            if head is not of:
                if of is not None:
                    rows.append({**of, "repaired_sha256": digest.hexdigest()})
                of, digest, count = head, hashlib.sha256(), 0
            for _, role, text in found:
                digest.update(f"{chr(10) if count else ''}{role}:{text}".encode())
                count += 1
            if len(rows) >= 1000:
                yield pa.RecordBatch.from_pylist([{n: r[n] for n in arrow.names} for r in rows], arrow)
                rows = []
        if of is not None:
            rows.append({**of, "repaired_sha256": digest.hexdigest()})
        yield pa.RecordBatch.from_pylist([{n: r[n] for n in arrow.names} for r in rows], arrow)

    return _streamed(turns, audits, carry).mapInArrow(run, schema)
