import hashlib
import itertools
import random
import re
import sys
import zlib
from functools import lru_cache

import duckdb
import pytest
from pyspark.sql import functions as F

from check import rows as plain_rows
from trialnum.llm import dialogue
from trialnum.llm.damage import damaged_turns
from trialnum.llm.dialogue import Audits, audit_conversations, best_paths, repaired_digests, repaired_turns
from trialnum.llm.queries import ORACLES, QUERIES

sys.setrecursionlimit(20_000)  # the plain search recurses once per edit
SCHEMA = "conv_id long, turn long, role string, text string"
BLANK = re.compile("[^\\x20\\x09-\\x0D]")


def order(rows):
    rows = [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows]
    return sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), hashlib.sha256(r[3].encode()).digest()))


def cheapest(plain):
    """Least (cost, audit) by trying all edits from the front, with what follows remembered."""

    @lru_cache(None)
    def rest(i, state, run):
        options = [(0, "")] if i == len(plain) and state in (0, 3) else []
        nxt = 3 if state == 2 else 2
        if run < 3:
            cost, audit = rest(i, nxt, run + 1)
            options.append((cost + 2, "I" + audit))
        if i < len(plain):
            initial, gone, cut = plain[i]
            cost, audit = rest(i + 1, state, 0)
            options.append((cost + 3, "D" + audit))
            if not gone:
                cost, audit = rest(i + 1, nxt, 0)
                options.append((cost + 2 + cut, "R" + audit))
                kept = {"s": 1 if state == 0 else None, "u": 2 if state != 2 else None, "a": 3 if state == 2 else None}.get(initial)
                if kept:
                    cost, audit = rest(i + 1, kept, 0)
                    options.append((cost + cut, "K" + audit))
        return min(options, default=(10**9, ""))

    return rest(0, 0, 0)


def brute_force(rows):
    out = {}
    for conv in {r[0] for r in rows}:
        found, seen, plain = order([r for r in rows if r[0] == conv]), set(), []
        n = [0, 0, 0]
        for _, _, role, text in found:
            visible = [c for c in text if BLANK.match(c)]
            blank, again = not visible, (role, text) in seen
            cut = bool(visible) and visible[-1] not in ".!?"
            seen.add((role, text))
            n[0 if blank else 1 if again else 2] += blank or again or cut
            plain.append((role[:1], blank or again, cut and not again))
        turns = [t for _, t, _, _ in found if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in itertools.pairwise(plain))
        cost, audit = cheapest(tuple(plain))
        texts, state, at = [], 0, 0
        for edit in audit:
            need = ("assistant", 3) if state == 2 else ("user", 2)
            if edit == "I":
                texts.append(need[0] + ":")
                state = need[1]
                continue
            role, text = found[at][2:]
            at += 1
            if edit == "R":
                texts.append(need[0] + ":" + text)
                state = need[1]
            if edit == "K":
                texts.append(role + ":" + text)
                state = "sua".index(role[0]) + 1
        out[conv] = (gaps, *n, illegal, cost, audit, hashlib.sha256("\n".join(texts).encode()).hexdigest())
    return out


def found(df):
    names = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    return {r["conv_id"]: tuple(r[n] for n in names) for r in df.collect()}


def repaired(spark, rows):
    turns = spark.createDataFrame(rows, SCHEMA)
    return found(repaired_digests(turns, audit_conversations(turns)))


def some_rows(seed, conversations, most, roles=("user", "assistant", "system", "user", "assistant", "tool", "", None)):
    rng, rows = random.Random(seed), []
    for conv in range(conversations):
        for turn in range(rng.randint(1, most)):
            number = rng.choice([turn, turn, turn, turn + 5, None, 3])
            text = rng.choice(["yes.", "no", "", " \t", "what?", "é…", "Sure!  ", "x.\n", None, "1", "2", "3", "4.", "5.", "6."])
            rows.append((conv if conv else None, number, rng.choice(roles), text))
    return rows


def test_audits_equal_a_plain_search(spark):
    rows = some_rows(1, 60, 9)
    assert repaired(spark, rows) == brute_force(rows)


def test_conversations_over_many_blocks_and_partitions(spark, monkeypatch):
    monkeypatch.setattr(dialogue, "BLOCK_BITS", 2)
    monkeypatch.setattr(dialogue, "WIDE_BITS", 2)
    rows = some_rows(2, 2, 150) + some_rows(3, 12, 5) + [(77, t, "user" if t % 3 else "assistant", f"{t}") for t in range(400)]
    assert repaired(spark, rows) == brute_force(rows)


@pytest.mark.parametrize("modulus", [3, (1 << 61) - 1])
def test_common_prefixes_with_and_without_collisions(monkeypatch, modulus):
    monkeypatch.setattr(dialogue, "HASH_MODULUS", modulus)
    rng, audits, nodes = random.Random(4), Audits(), [0]
    for _ in range(300):
        nodes.append(audits.add(rng.choice(nodes[-9:] + [0]), rng.choice("DIKR")))
    for a, b in itertools.product(rng.sample(nodes, 40), repeat=2):
        assert audits.less(a, b) == (audits.spelled(a) < audits.spelled(b))
    for seed in range(30):
        rng = random.Random(seed)
        rows = [(rng.choice("suax"), rng.random() < 0.2, rng.random() < 0.3) for _ in range(12)]
        ends = {0: "", 1: "II", 2: "I", 3: ""}
        best = min((cost + 2 * len(ends[x]), audit + ends[x]) for x, cost, audit in best_paths(rows, 0))
        assert best == cheapest(tuple(rows))


def test_turns_that_are_repaired(spark):
    rows = [(1, 0, "assistant", "Hello."), (1, 1, "user", "Hi."), (1, 2, "user", "Hi."), (1, 3, "user", "  "), (2, 5, "system", "Be kind."), (2, 6, "user", "Go.")]
    turns = spark.createDataFrame(rows, SCHEMA)
    audits = audit_conversations(turns)
    got = [tuple(r) for r in repaired_turns(turns, audits).orderBy("conv_id", "position").collect()]
    assert got == [
        (1, 0, "I", "user", ""), (1, 1, "K", "assistant", "Hello."), (1, 2, "K", "user", "Hi."), (1, 3, "I", "assistant", ""),
        (2, 0, "K", "system", "Be kind."), (2, 1, "K", "user", "Go."), (2, 2, "I", "assistant", ""),
    ]
    assert found(audits.withColumn("repaired_sha256", F.lit("")))[1][5:7] == (10, "IKKDDI")
    assert found(repaired_digests(turns, audits)) == brute_force(rows)


def test_empty_tables_nulls_long_texts_and_extra_columns(spark):
    assert repaired(spark, []) == {}
    long = "a b. " * 200_000
    rows = [(None, None, None, None), (None, None, "user", long), (3, -(2**62), "user", "a."), (3, 2**62, "assistant", long + "x")] + [(9, 1, "user", "same.")] * 40
    assert repaired(spark, rows) == brute_force(rows)
    turns = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], SCHEMA + ", place long, digest long, _rank long")
    assert found(repaired_digests(turns, audit_conversations(turns))) == brute_force(rows)
    far = spark.createDataFrame([(1, -(2**63), "user", "a."), (1, 2**63 - 1, "assistant", "b.")], SCHEMA)
    assert audit_conversations(far).first()["gaps"] is None


def test_damage_and_query_on_rows_of_every_kind(spark, tmp_path):
    rows = [r if r[1] != 3 else (*r[:2], "user", "fixed") for r in some_rows(5, 300, 7)]
    path = str(tmp_path / "conversations.parquet")
    spark.createDataFrame(rows, SCHEMA).write.parquet(path)
    damaged = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        key = ":".join(" " if k is None else str(k) for k in (conv, turn))
        fault = zlib.crc32(key.encode()) % 20
        if fault:
            text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
            damaged += [(conv, turn, "user" if fault == 4 else role, text)] * (2 if fault == 3 else 1)
    df = spark.read.parquet(path)
    assert sorted(map(str, damaged)) == sorted(str(tuple(r)) for r in damaged_turns(df).collect())
    want = brute_force(damaged)
    empty = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    want |= {c: empty for c, *_ in rows if c not in want}
    got = QUERIES["op12_conversations"](spark, str(tmp_path))
    assert found(got) == want
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS FROM '{path}/*.parquet'")
    sql = con.sql(ORACLES["op12_conversations"])
    assert plain_rows(sql.columns, sql.fetchall()) == plain_rows(got.columns, got.collect())
