"""Conversation repair against plain Python: all edit sequences of short conversations, a search over states for others."""

from __future__ import annotations

import collections
import hashlib
import itertools
import os
import random
import re
import zlib

import pyarrow.parquet as pq
import pytest

ROOT = "/root/testdata"
SCHEMA = "conv_id long, turn long, role string, text string, audit string, mid int, copy string"
FORM = re.compile(r"(s?(ua)+)?")


def after_damage(rows) -> dict:
    """conv_id -> (turn, role, text) in order, after the planted damage."""
    out = {conv: [] for conv, *_ in rows if conv is not None}
    for conv, turn, role, text in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[1] is not None, r[1] or 0, " " if r[2] is None else r[2], " " if r[3] is None else r[3])):
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out[conv] += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


def faults(turns) -> list[str]:
    seen, out = set(), []
    for _, role, text in turns:
        solid = re.findall(r"[^\x20\x09-\x0D]", text)
        out.append("blank" if not solid else "duplicate" if (role, text) in seen else "" if solid[-1] in ".!?" else "truncated")
        seen.add((role, text))
    return out


def price(letters, turns, marks):
    """Cost of edits, and the repaired turns, or None if the edits are not allowed; roles follow from the number of turns left."""
    length, at, place, cost, out = sum(x != "D" for x in letters), 0, 0, 0, []
    for x in letters:
        want = "s" if place < length % 2 else "ua"[(place - length % 2) % 2]
        if x == "I":
            if want == "s":
                return None
            cost, place = cost + 5, place + 1
            out.append(("user" if want == "u" else "assistant", ""))
            continue
        (_, role, text), mark = turns[at], marks[at]
        at += 1
        if x == "D":
            cost += 2
            continue
        if mark in ("blank", "duplicate") or (x == "K" and role[:1] != want) or (x == "R" and want == "s"):
            return None
        cost, place = cost + (x == "R") + 5 * (mark == "truncated"), place + 1
        out.append((role if x == "K" else "user" if want == "u" else "assistant", text))
    return (cost, out) if FORM.fullmatch("".join(r[:1] for r, _ in out)) else None


def by_enumeration(turns, marks):
    gaps = [("", "I", "II")] * (len(turns) + 1)
    best = None
    for letters in itertools.product("DKR", repeat=len(turns)):
        for inserts in itertools.product(*gaps):
            audit = "".join(i + x for i, x in itertools.zip_longest(inserts, letters, fillvalue=""))
            priced = price(audit, turns, marks)
            if priced and (best is None or (priced[0], audit) < best):
                best = (priced[0], audit)
    return best


def by_search(turns, marks):
    """Cheapest edits from every (turn, last role) backwards, so audits are compared from their first letter on."""
    n, follow = len(turns), {"": "su", "s": "u", "u": "a", "a": "u"}
    best = {}
    for i in range(n, -1, -1):
        here = {}
        for state in follow:
            options = [(0, "")] if i == n and state in ("", "a") else []
            if i < n:
                _, role, _ = turns[i]
                options.append((2 + best[i + 1, state][0], "D" + best[i + 1, state][1]))
                if marks[i] not in ("blank", "duplicate"):
                    for to in follow[state]:
                        c, audit = best[i + 1, to]
                        c += 5 * (marks[i] == "truncated")
                        options += [(c, "K" + audit)] * (role[:1] == to) + [(c + 1, "R" + audit)] * (to != "s")
            here[state] = min(options, default=(10**9, "Z"))
        for _ in range(3):
            for state, after in follow.items():
                here[state] = min([here[state], *((5 + here[to][0], "I" + here[to][1]) for to in after if to != "s")])
        best |= {(i, s): v for s, v in here.items()}
    return best[0, ""]


def brute(rows) -> dict:
    out = {}
    for conv, turns in after_damage(rows).items():
        marks = faults(turns)
        cost, audit = by_search(turns, marks)
        if len(turns) <= 3:
            assert (cost, audit) == by_enumeration(turns, marks)
        price_, repaired = price(audit, turns, marks)
        assert price_ == cost
        known = {t for t, *_ in turns if t is not None}
        count = collections.Counter(marks)
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:]))
        sha = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in repaired).encode()).hexdigest()
        out[conv] = (max(known) - min(known) + 1 - len(known) if known else 0, count["blank"], count["duplicate"], count["truncated"], illegal, cost, audit, sha)
    return out


def found(df) -> dict:
    rows = df.collect()
    out = {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in rows}
    assert len(out) == len(rows)
    return out


def odd_rows():
    rng = random.Random(8)
    text = lambda: rng.choice(("Yes.", "No!", "what?", "cut off", "", None, " \t", "end. \n", "é.", "…", "a.b"))
    rows = [(c, t * rng.choice((1, 1, 2)), rng.choice(("system", "user", "user", "assistant", "assistant", "tool", None, "")), f"{text() or ''}" if rng.random() < 0.9 else None) for c in range(300) for t in range(rng.randint(1, 6))]
    rows += [(1000 + c, t if t % 7 else None, ("user", "assistant")[t % 2], f"{t // 3} said." if t % 5 else text()) for c in range(4) for t in range(60 + 500 * (c == 3))]
    rows += [(2000, 1, "user", "Same.")] * 1500 + [(None, 0, "user", "x"), (-7, -3, "user", "Hi."), (-7, 9, "assistant", "Yo.")]
    return rows + [(3000 + c, 0, "user", "One.") for c in range(60)]  # some lose their only turn


@pytest.mark.parametrize("long_rows", [0, 20, 256])
def test_repair_equals_brute_force(spark, long_rows):
    from gridloom.llm.turn_repair import repair_conversations

    rows = odd_rows()
    df = spark.createDataFrame([(*r, "x", 1, "y") for r in rows], SCHEMA).repartition(6)
    want = brute(rows)
    assert any(not v[6] for v in want.values())
    assert found(repair_conversations(df, long_rows)) == want


def test_products_do_not_depend_on_grouping():
    from gridloom.llm.turn_repair import CLOSURE, multiply, product, turn_matrix

    rng = random.Random(5)
    assert multiply(CLOSURE, CLOSURE) == CLOSURE
    for _ in range(30):
        ms = [turn_matrix(rng.choice(["s", "u", "a", ""]), rng.choice(["", "blank", "duplicate", "truncated"])) for _ in range(rng.randint(1, 12))]
        left = ms[0]
        for m in ms[1:]:
            left = multiply(left, m)
        right = ms[-1]
        for m in reversed(ms[:-1]):
            right = multiply(m, right)
        assert left == right == product(ms)


def test_repair_of_nothing(spark):
    from gridloom.llm.turn_repair import repair_conversations

    assert repair_conversations(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.skipif(not os.path.isdir(ROOT), reason="needs the supplied tables")
@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_repair_query(spark, sf):
    from gridloom.llm.queries import queries

    rows = [tuple(r.values()) for r in pq.read_table(f"{ROOT}/{sf}/conversations.parquet").select(["conv_id", "turn", "role", "text"]).to_pylist()]
    assert found(queries()["op13_conversation_repair"](spark, f"{ROOT}/{sf}")) == brute(rows)
