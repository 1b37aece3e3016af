"""Conversation repair against a plain search with whole strings, in one piece and in blocks."""

import hashlib
import itertools
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from tabforge.llm import op12_repair as R
from tabforge.llm.common import documents

SCHEMA = "conv_id long, turn long, role string, text string"
BLANK = re.compile(r"[^\x20\x09-\x0D]")


def plain(rows):
    """rows: (turn, role, text), damaged, ordered. The contract word by word, strings copied freely."""
    seen, kinds, n = set(), [], {"blank": 0, "duplicate": 0, "truncated": 0}
    for _, role, text in rows:
        marks = BLANK.findall(text)
        kind = "blank" if not marks else "duplicate" if (role, text) in seen else "truncated" if marks[-1] not in ".!?" else ""
        seen.add((role, text))
        if kind:
            n[kind] += 1
        kinds.append(kind)
    # (cost, audit, roles) by initials so far, reduced to the last initial
    best = {"": (0, "", ())}

    def keep(into, state, x):
        if state not in into or x[:2] < into[state][:2]:
            into[state] = x

    def after(state, initial):
        return initial in {"": "su", "s": "u", "u": "a", "a": "u"}[state]

    def closed(now):
        for _ in range(3):
            new = dict(now)
            for s, (c, a, out) in now.items():
                for role in ("user", "assistant"):
                    if after(s, role[0]):
                        keep(new, role[0], (c + 5, a + "I", (*out, (role, ""))))
            now = new
        return now

    best = closed(best)
    for (_, role, text), kind in zip(rows, kinds):
        new = {}
        for s, (c, a, out) in best.items():
            keep(new, s, (c + 2, a + "D", out))
            if kind in ("blank", "duplicate"):
                continue
            extra = 5 if kind == "truncated" else 0
            if role[:1] and after(s, role[0]):
                keep(new, role[0], (c + extra, a + "K", (*out, (role, text))))
            for to in ("user", "assistant"):
                if after(s, to[0]):
                    keep(new, to[0], (c + extra + 1, a + "R", (*out, (to, text))))
        best = closed(new)
    cost, audit, out = min((best[s] for s in ("", "a") if s in best), key=lambda x: x[:2])
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum((x[1][:1] + y[1][:1]) not in ("su", "ua", "au") for x, y in zip(rows, rows[1:]))
    return (gaps, n["blank"], n["duplicate"], n["truncated"], illegal, cost, audit,
            hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest())


def damaged(table):
    out = {}
    for c, t, role, text in table:
        role, text = role if role is not None else " ", text if text is not None else " "
        d = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        rows = out.setdefault(c, [])
        text = "" if d == 1 else re.sub("[.!?]", "", text) if d == 2 else text
        rows += [] if d == 0 else [(t, "user" if d == 4 else role, text)] * (2 if d == 3 else 1)
    return {c: sorted(r, key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2])) for c, r in out.items()}


def of(df):
    lines = F.transform("repaired", lambda x: F.concat(x["role"], F.lit(":"), x["text"]))
    rows = df.select("conv_id", *R.RESULT.replace(" long", "").split(", ")[:6], "audit", F.sha2(F.array_join(lines, "\n"), 256)).collect()
    found = {r[0]: tuple(r[1:]) for r in rows}
    assert len(found) == len(rows)
    return found


HARD = [(1, 0, "user", "Hi."), (1, 1, "user", "Hi."), (1, 3, "assistant", "cut off"), (2, None, "system", "Be kind."), (2, None, "tool", "x."),
        (2, 5, "assistant", None), (3, 0, None, "a."), (3, 0, "", "b!"), (3, 7, "User", "c?"), (None, 1, "user", "no id."), (None, 2, "assistant", "yes."),
        (4, 0, "system", "only"), (5, 2, "assistant", "A."), (5, 1, "user", "Q? \n"), (5, 1, "user", "Q? \n"), (6, None, None, None), (7, 0, "user", " \t\n")]


@pytest.mark.parametrize("long, block", [(10_000, 4096), (0, 2), (2, 1)])
def test_hard_rows(spark, long, block):
    table = HARD + [(50 + i % 7, i // 7, random.Random(i).choice(["user", "assistant", "system", "tool"]),
                     random.Random(i * 7).choice(["One.", "two", "three!", "", f"n{i}."])) for i in range(200)]
    df = spark.createDataFrame(table, SCHEMA).withColumns({c: F.lit(1) for c in ("g", "r", "kind", "x")}).repartition(3)
    assert of(R.repair(R.damage(df), long, block)) == {c: plain(r) for c, r in damaged(table).items()}


@pytest.mark.parametrize("long", [10_000, 0])
def test_whole_table(spark, long):
    table = documents(spark, "/root/testdata/sf0.01", "conversations")
    rows = [tuple(r) for r in table.select("conv_id", "turn", "role", "text").collect()]
    assert of(R.repair(R.damage(table), long, 3)) == {c: plain(r) for c, r in damaged(rows).items()}


def test_one_conversation_holds_a_third(spark):
    table = [(0, i // 3, ("user", "assistant", "tool")[i % 3], f"text {i % 500}{'.' * (i % 2)}") for i in range(3000)]
    df = spark.createDataFrame(table + [(c, t, "user", "a.") for c in range(1, 2000) for t in range(3)], SCHEMA)
    got = of(R.repair(df, 1000, 128))
    want = plain([(t, r, x) for _, t, r, x in sorted(table, key=lambda x: x[1:])])
    assert got[0] == want and len(got) == 2000


def test_empty_table(spark):
    assert of(R.repair(spark.createDataFrame([], SCHEMA))) == {}


def test_prefixes_order_strings():
    tree, nodes = R.Prefixes(), {}
    for s in ("".join(x) for n in range(6) for x in itertools.product("DIK", repeat=n)):
        node = 0
        for ch in s:  # nothing shared: the hashes and the letters have to tell
            node = tree.push(node, ch)
        nodes[s] = node
    some = random.Random(1).sample(sorted(nodes), 120)
    for a, b in itertools.product(some, some):
        assert tree.less(nodes[a], nodes[b]) == (a < b)


def test_prefixes_survive_colliding_hashes(monkeypatch):
    monkeypatch.setattr(R, "_MOD", 3)
    test_prefixes_order_strings()
