"""Repaired conversations against all edit sequences, blocks against whole parses, odd rows, and one conversation over many tasks."""

from __future__ import annotations

import hashlib
import itertools
import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from chalkline.llm import conversations as C

KINDS = "DsuaoSUAO"


def every_parse(kinds):
    """The least (cost, audit) of all sequences of edits with up to two insertions at a place."""
    best = None
    for edits in itertools.product("KRD", repeat=len(kinds)):
        if any(k == "D" and e != "D" for k, e in zip(kinds, edits, strict=True)):
            continue
        roles = [[k.lower()] if e == "K" else ["u", "a"] if e == "R" else [] for k, e in zip(kinds, edits, strict=True)]
        for gaps in itertools.product(range(3), repeat=len(kinds) + 1):
            cost = sum({"K": 0, "R": 1, "D": 2}[e] + (5 if k.isupper() and e != "D" else 0) for k, e in zip(kinds, edits, strict=True)) + 5 * sum(gaps)
            audit = "I" * gaps[0] + "".join(e + "I" * g for e, g in zip(edits, gaps[1:], strict=True))
            if best is not None and (cost, audit) >= best:
                continue
            slots = [["u", "a"]] * gaps[0]
            for r, g in zip(roles, gaps[1:], strict=True):
                slots = slots + ([r] if r else []) + [["u", "a"]] * g
            n = len(slots)
            want = ["s"] * (n % 2) + ["u", "a"] * (n // 2)
            if n != 1 and all(w in s for w, s in zip(want, slots, strict=True)):
                best = (cost, audit)
    return best


@pytest.mark.parametrize("n", range(4))
def test_parse_against_every_sequence(n):
    for kinds in map("".join, itertools.product(KINDS, repeat=n)):
        assert C.parse(kinds) == every_parse(kinds), kinds


def plain_parse(kinds):
    """A table by place and role sequence so far, for longer rows."""
    table = {"0": (0, "")}

    def insert(t):
        for _ in range(4):
            for s, (c, a) in list(t.items()):
                for to in {"0": "u", "s": "u", "u": "a", "a": "u"}[s]:
                    t[to] = min(t.get(to, (10**9, "")), (c + 5, a + "I"))
        return t

    table = insert(table)
    for k in kinds:
        new = {}
        for s, (c, a) in table.items():
            new[s] = min(new.get(s, (10**9, "")), (c + 2, a + "D"))
            if k == "D":
                continue
            for to in {"0": "su", "s": "u", "u": "a", "a": "u"}[s]:
                more = 5 if k.isupper() else 0
                if k.lower() == to:
                    new[to] = min(new.get(to, (10**9, "")), (c + more, a + "K"))
                elif to != "s":
                    new[to] = min(new.get(to, (10**9, "")), (c + more + 1, a + "R"))
        table = insert(new)
    return min(v for s, v in table.items() if s in "0a")


@given(st.text(KINDS, max_size=60), st.lists(st.integers(0, 60), max_size=5))
@settings(max_examples=300, deadline=None)
def test_blocks_of_any_conversation(kinds, cuts):
    assert C.parse(kinds) == plain_parse(kinds)
    borders = [0, *sorted(min(c, len(kinds)) for c in cuts), len(kinds)]
    blocks = []
    for number, (low, high) in enumerate(itertools.pairwise(borders)):
        block = C._Block("c")
        block.rows = [("", "", k) for k in kinds[low:high]]
        moves = [dict(zip(("before", "after", "cost", "audit"), m, strict=True)) for m in C.parse_block(block.kinds)]
        blocks.append({"part": 0, "block": number, "moves": moves, "turns": 0, "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0, "first": "", "last": "", "first_turn": None})
    whole, *steps = C._path("c", iter(blocks))
    assert whole[-2:] == C.parse(kinds)
    audits = {s[2]: next(m["audit"] for m in blocks[s[2]]["moves"] if (m["before"], m["after"]) == s[3:5]) for s in steps}
    assert "".join(audits[i] for i in range(len(blocks))) == whole[-1]


def plain(rows):
    """What repair_conversations says, one conversation after another."""
    by, out = {}, {}
    for conv, turn, role, text in rows:
        by.setdefault(conv, []).append((turn is not None, turn or 0, " " if role is None else role, " " if text is None else text))
    for conv, own in by.items():
        own.sort(key=lambda r: (r[0], r[1], r[2].encode(), r[3].encode()))
        seen, held, faults = set(), [], [0, 0, 0]
        for _, _, role, text in own:
            bare = re.sub(r"[\x20\x09-\x0d]+$", "", text)
            fault = 0 if not re.search(r"[^\x20\x09-\x0d]", text) else 1 if (role, text) in seen else 2 if bare[-1] not in ".!?" else 3
            seen.add((role, text))
            if fault < 3:
                faults[fault] += 1
            kind = role[:1] if role[:1] and role[:1] in "sua" else "o"
            held.append((role, text, "D" if fault < 2 else kind.upper() if fault == 2 else kind))
        turns = [t for known, t, *_ in own if known]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(own))
        cost, audit = plain_parse("".join(k for *_, k in held))
        lines, left, want = [], iter(held), len(audit.replace("D", "")) % 2
        for edit in audit:
            role, text, _ = ("", "", "") if edit == "I" else next(left)
            if edit != "D":
                lines.append(f"{role if edit == 'K' else ('user', 'assistant')[(len(lines) - want) % 2]}:{text}")
        out[conv] = (gaps, *faults, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest(), lines)
    return out


def odd_rows():
    draw = random.Random(3)
    roles = ["system", "user", "assistant", "user", "assistant", "tool", "", None, "usher", "Assistant"]
    texts = ["Hi.", "hi", "Well?", "", " \t", None, "ok!\n", "a:b\nc.", "ß…", "long " * 300 + "."]
    rows = [(draw.choice([1, 2, 3, 4, None, 60]), draw.choice([None, *range(12)]), draw.choice(roles), draw.choice(texts)) for _ in range(400)]
    rows += [(5, 0, "system", "S."), (5, 1, "user", "U."), (5, 2, "assistant", "A."), (6, None, None, None), (7, 9, "user", "only."), *[(8, 3, "user", "same.")] * 70]
    return rows + [(9, t, ("user", "assistant")[t % 2], f"message {t}." if t % 7 else "cut") for t in range(3000)]


def told(found):
    return {r["conv_id"]: tuple(r)[1:] for r in found.conversations.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256").collect()}


@pytest.mark.parametrize(("most", "tasks"), [(C.BLOCK, 4), (3, 4), (50, 37)])
def test_against_plain(spark, most, tasks):
    rows = odd_rows()
    df = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, Audit string")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", tasks)
    try:
        found = C.repair_conversations(df, "conv_id", "turn", "role", "text", most)
        want = plain(rows)
        assert told(found) == {c: v[:-1] for c, v in want.items()}
        held = {}
        for r in sorted(found.rows.collect(), key=lambda r: (r["part"], r["block"])):
            held.setdefault(r["conv_id"], []).extend(f"{x['role']}:{x['text']}" for x in r["lines"])
        assert held == {c: v[-1] for c, v in want.items()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_empty_table(spark):
    df = spark.createDataFrame([], "conv_id string, turn long, role string, text string")
    found = C.repair_conversations(df, "conv_id", "turn", "role", "text")
    assert found.conversations.collect() == [] and found.rows.collect() == []


def test_damage(spark):
    import zlib

    rows = [(c, t, "assistant", "One. Two!") for c in (1, 2, None) for t in (None, *range(60))]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    want = []
    for conv, turn, role, text in rows:
        fault = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        row = (conv, turn, "user" if fault == 4 else role, "" if fault == 1 else "One Two" if fault == 2 else text)
        want += [row] * (0 if fault == 0 else 2 if fault == 3 else 1)
    assert sorted(map(str, map(tuple, C.damaged(df, "conv_id", "turn", "role", "text").collect()))) == sorted(map(str, want))
