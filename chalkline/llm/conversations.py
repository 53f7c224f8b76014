"""Repair of a conversation's structure by an error-correcting Earley parse.

The grammar of roles, weighted by what its error productions cost:

    Whole -> nothing | Pairs        Pairs -> Open assistant
    Open  -> Head user | Pairs user Head  -> nothing | system

A terminal matches a row of its role (Keep), any row that gets its role (Rerole)
or no row (Insert); at any place a row may be left out (Delete). Rules refer to
others only at their beginning, so every item of the chart begins where the
conversation does, and a chart column is the least (cost, audit) of each item.
Audits of equal cost at one item and place are never one the beginning of the
other, so the least stays the least whatever follows.

Rows are sorted over all tasks by conversation and turn, whatever the size of a
conversation, and tasks parse what is theirs. A conversation that lies within
one task is done there. What is longer, or cut by the border of a task, is
parsed in blocks, from every item that may stand at a block's beginning to every
item at its end; then the blocks' results, a few short strings for up to BLOCK
rows, are put together in order, and each block's rows are repaired by it.
"""

from __future__ import annotations

import hashlib
import os.path
from collections.abc import Iterator
from functools import lru_cache
from itertools import groupby
from typing import Any, NamedTuple

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from chalkline.llm.scratch import Scratch, bounded_batches

SYSTEM, USER, ASSISTANT = "system", "user", "assistant"
RULES = [("Whole", ()), ("Whole", ("Pairs",)), ("Head", ()), ("Head", (SYSTEM,)), ("Open", ("Head", USER)), ("Open", ("Pairs", USER)), ("Pairs", ("Open", ASSISTANT))]
#: Terminals that a row can be given, and that can stand without one.
GIVEN = (USER, ASSISTANT)
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: Rows and symbols of a block.
BLOCK, BLOCK_SYMBOLS = 1024, 1 << 20
BLANK, ENDS, LEGAL = " \t\n\x0b\x0c\r", ".!?", ("su", "ua", "au")

Item = tuple[str, tuple[str, ...], int]
Chart = dict[Item, tuple[int, str]]


def _predicted() -> set[Item]:
    """Items at a conversation's beginning: all rules, and what follows from those without symbols."""
    return _completed([(left, right, 0) for left, right in RULES])


def _completed(items: list[Item]) -> set[Item]:
    """The items with those that wait for what is complete among them."""
    found, todo = set(items), list(items)
    while todo:
        left, right, dot = todo.pop()
        if dot == len(right):
            for other, symbols in RULES:
                if symbols[:1] == (left,) and (new := (other, symbols, 1)) not in found:
                    found.add(new)
                    todo.append(new)
    return found


def _moves(items: set[Item]) -> dict[str, Item]:
    """The item that each terminal leads to."""
    return {right[dot]: (left, right, dot + 1) for left, right, dot in items if dot < len(right) and right[dot].islower()}


#: Kernels: what a conversation begins with, and the items just after a terminal. An item whose like follows alike is one with it.
START: Item = ("Whole", (), 0)
SCANNED = [(left, right, len(right)) for left, right in RULES if right and right[-1].islower()]
KERNEL = {START: _predicted()} | {item: _completed([item]) for item in SCANNED}
ONE: dict[Item, Item] = {}
for _item, _items in KERNEL.items():
    ONE[_item] = next((k for k in ONE.values() if _item != START != k and k[0] == _item[0]), _item)
ITEMS = list(dict.fromkeys(ONE.values()))
STEPS = {item: {t: ONE[to] for t, to in _moves(KERNEL[item]).items()} for item in ITEMS}
ENDING = [item for item in ITEMS if any(left == "Whole" and dot == len(right) for left, right, dot in KERNEL[item])]


def _better(chart: Chart, item: Item, value: tuple[int, str]) -> bool:
    if item in chart and chart[item] <= value:
        return False
    chart[item] = value
    return True


def _inserted(chart: Chart) -> Chart:
    """The chart column with what insertions lead to."""
    todo = list(chart)
    while todo:
        cost, audit = chart[item := todo.pop()]
        for terminal, to in STEPS[item].items():
            if terminal in GIVEN and _better(chart, to, (cost + INSERT, audit + "I")):
                todo.append(to)
    return chart


def _scanned(chart: Chart, kind: str) -> Chart:
    """The next column, after a row of this kind: ``D`` must go, else the role's initial (``o``: another), upper-case if it is truncated."""
    after: Chart = {}
    more, role = TRUNCATED if kind.isupper() else 0, kind.lower()
    for item, (cost, audit) in chart.items():
        _better(after, item, (cost + DELETE, audit + "D"))
        if kind != "D":
            for terminal, to in STEPS[item].items():
                if terminal[0] == role:
                    _better(after, to, (cost + more, audit + "K"))
                elif terminal in GIVEN:
                    _better(after, to, (cost + REROLE + more, audit + "R"))
    return _inserted(after)


@lru_cache(10_000)
def parse(kinds: str) -> tuple[int, str]:
    """Least cost and audit for a whole conversation's kinds of rows."""
    chart = _inserted({START: (0, "")})
    for kind in kinds:
        chart = _scanned(chart, kind)
    return min(chart[item] for item in ENDING if item in chart)


@lru_cache(1000)
def parse_block(kinds: str) -> list[tuple[int, int, int, str]]:
    """(item before, item after, cost, audit) for all pairs of items that a block can lie between."""
    out = []
    for i, item in enumerate(ITEMS):
        chart = _inserted({item: (0, "")}) if item == START else {item: (0, "")}  # what is inserted before all rows
        for kind in kinds:
            chart = _scanned(chart, kind)
        out += [(i, ITEMS.index(to), cost, audit) for to, (cost, audit) in chart.items()]
    return out


def repaired(rows: list[tuple[str, str, str]], audit: str, item: Item = START) -> list[tuple[str, str]]:
    """(role, text) after the edits of ``audit`` to rows of (role, text, kind), the first of which follows ``item``."""
    out, left = [], iter(rows)
    for edit in audit:
        role, text, kind = ("", "", "o") if edit == "I" else next(left)
        if edit == "D":
            continue
        steps = STEPS[item]
        terminal = next((t for t in steps if edit == "K" and t[0] == kind.lower()), None) or next(t for t in steps if t in GIVEN)
        out.append((role if edit == "K" else terminal, text))
        item = steps[terminal]
    return out


class Repaired(NamedTuple):
    """``conversations``: a row for each; ``rows``: what each holds now, as arrays of (role, text) in the order of part and block."""

    conversations: DataFrame
    rows: DataFrame


COUNTS = "turns long, min_turn long, max_turn long, first_turn long, last_turn long, blank long, duplicate long, truncated long, illegal long, first string, last string"
LINES = "array<struct<role: string, text: string>>"
PARSED = f"part int, block long, whole boolean, {COUNTS}, cost long, audit string, sha string, moves array<struct<before: int, after: int, cost: long, audit: string>>, held array<struct<role: string, text: string, kind: string>>, lines {LINES}"


class _Block:
    """Consecutive rows of one conversation."""

    def __init__(self, conv: Any):
        self.conv, self.size = conv, 0
        self.rows: list[tuple[str, str, str]] = []
        self.turns = self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.min_turn = self.max_turn = self.first_turn = self.last_turn = self.first = self.last = None

    def add(self, turn: int | None, role: str, text: str, again: bool) -> None:
        seen = text.strip(BLANK)
        blank, short = not seen, bool(seen) and seen[-1] not in ENDS
        initial, gone = role[:1], blank or again
        kind = initial if initial and initial in "sua" else "o"
        self.blank += blank
        self.duplicate += again and not blank
        self.truncated += short and not gone
        self.illegal += self.last is not None and self.last + initial not in LEGAL
        self.rows.append((role, text, "D" if gone else kind.upper() if short else kind))
        self.size += len(text)
        self.first = initial if self.first is None else self.first
        self.last = initial
        if turn is not None:
            self.turns += turn != self.last_turn
            if self.first_turn is None:
                self.first_turn = self.min_turn = turn
            self.max_turn = self.last_turn = turn

    @property
    def kinds(self) -> str:
        return "".join(kind for *_, kind in self.rows)

    def told(self, part: int, number: int, whole: bool) -> tuple:
        counts = (self.turns, self.min_turn, self.max_turn, self.first_turn, self.last_turn, self.blank, self.duplicate, self.truncated, self.illegal, self.first, self.last)
        if not whole:
            moves = [dict(zip(("before", "after", "cost", "audit"), m, strict=True)) for m in parse_block(self.kinds)]
            held = [dict(zip(("role", "text", "kind"), r, strict=True)) for r in self.rows]
            return (self.conv, part, number, False, *counts, None, None, None, moves, held, None)
        cost, audit = parse(self.kinds)
        lines = repaired(self.rows, audit)
        return (self.conv, part, number, True, *counts, cost, audit, _Digest().of(lines), None, None, _structs(lines))


class _Digest:
    """SHA-256 of ``role:text`` lines, joined by newlines."""

    def __init__(self) -> None:
        self.hash, self.begun = hashlib.sha256(), False

    def of(self, lines: list[tuple[str, str]]) -> str:
        for role, text in lines:
            self.hash.update((f"\n{role}:{text}" if self.begun else f"{role}:{text}").encode())
            self.begun = True
        return self.hash.hexdigest()


def _structs(lines: list[tuple[str, str]]) -> list[dict]:
    return [{"role": role, "text": text} for role, text in lines]


def _sent(rows: Iterator[tuple], schema: pa.Schema, most: int = 512) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) == most:
            yield _batch(held, schema)
            held = []
    if held:
        yield _batch(held, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


def _blocks(rows: Iterator[tuple], most: int) -> Iterator[tuple[_Block, bool]]:
    """Blocks of the sorted rows (conv, turn, role, text, m, first) of a task, each with whether it is the conversation's only one."""
    block, alone = None, True
    for conv, turn, role, text, m, first in rows:
        for copy in range(m):
            if block is not None and (block.conv != conv or len(block.rows) >= most or block.size >= BLOCK_SYMBOLS):
                same = block.conv == conv
                yield block, alone and not same
                alone, block = not same, None
            if block is None:
                block = _Block(conv)
            block.add(turn, role, text, not first or copy > 0)
    if block is not None:
        yield block, alone


def _marked(df: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """(conv, turn, role, text, m, first): equal rows are one with m copies; first, if no earlier turn says the same."""
    blank = lambda c: F.coalesce(F.col(c), F.lit(" "))
    said = df.select(F.col(conv).alias("conv"), F.col(turn).cast("long").alias("turn"), blank(role).alias("role"), blank(text).alias("text"))
    said = said.groupBy("conv", "turn", "role", "text").agg(F.count("*").alias("m")).withColumn("_h", F.sha2(F.col("text").cast("binary"), 256))
    when = F.struct(F.col("turn").isNotNull().alias("has"), F.col("turn").alias("at"))  # nulls first
    begun = said.groupBy(F.col("conv").alias("c"), F.col("role").alias("r"), F.col("_h").alias("h")).agg(F.min(when).alias("_t"))
    begun = begun.select("c", "r", "h", F.col("_t.at").alias("t"), F.lit(True).alias("first"))
    same = F.col("conv").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("_h") == F.col("h")) & F.col("turn").eqNullSafe(F.col("t"))
    return said.join(begun, same, "left").select("conv", "turn", "role", "text", "m", F.coalesce("first", F.lit(False)).alias("first"))


def repair_conversations(df: DataFrame, conv: str, turn: str, role: str, text: str, most: int = BLOCK) -> Repaired:
    """Conversations with their faults, the cheapest edits that make roles go ``(s?(ua)+)?``, and what they hold then.

    A conversation's rows go by turn (null first), role and text. A row counts for
    its first fault: blank, duplicate (its role and text were seen), truncated
    (it ends in none of ENDS). Blank and duplicate rows must be deleted; a
    truncated one that stays costs 5 more. ``audit`` has the initials of the
    edits, of equally cheap ones the ASCII-least; ``gaps`` the turns that lack
    between the first and the last, ``illegal`` the neighbours whose roles'
    initials don't follow each other. Null roles and texts are one space, rows of
    a null conversation are one conversation, equal rows repeat each other; an
    empty table gives none, and other columns are not read.

    A conversation may be as long as it likes: it is sorted, marked and parsed by
    many tasks, in blocks of at most ``most`` rows. Its blocks' results, and for the hash of its text the repaired
    blocks, go through one task in order, without being held together; what is
    held there is the audit.
    """
    spark = df.sparkSession
    bounded_batches(spark)
    scratch = Scratch(spark, "talk")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    schema = f"conv {df.schema[conv].dataType.simpleString()}, {PARSED}"
    arrow = _arrow(schema)

    def parse_sorted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()

        def told() -> Iterator[tuple]:
            last = None  # the last conversation of a task may go on in the next, the first one have begun in the one before
            first = True
            for number, (block, alone) in enumerate(_blocks(_rows(batches), most)):
                if last is not None:
                    yield last[0].told(part, number - 1, last[1])
                    first = first and last[0].conv == block.conv
                last = (block, alone and not first)
            if last is not None:
                yield last[0].told(part, number, False)

        yield from _sent(told(), arrow)

    order = ["conv", "turn", "role", "text"]
    marked = _marked(df, conv, turn, role, text)
    sorted_ = marked.repartitionByRange(n, "conv", "turn", "role", F.substring("text", 1, 256)).sortWithinPartitions(*order)
    parsed = scratch.keep(sorted_.select(*order, "m", "first").mapInArrow(parse_sorted, schema), "parsed")

    gaps = F.coalesce(F.col("max_turn") - F.col("min_turn") + 1 - F.col("turns"), F.lit(0)).alias("gaps")
    told = ["blank", "duplicate", "truncated", "illegal", "cost", "audit"]
    alone = parsed.where("whole")
    open_ = parsed.where("NOT whole")
    paths = scratch.keep(_paths(open_, n), "paths")
    chosen = paths.where("block IS NOT NULL").select("part", "block", "before", "after")
    lines = scratch.keep(_lines(open_.select("conv", "part", "block", "moves", "held").join(chosen, ["part", "block"])), "lines")
    digests = _digests(lines, n).withColumnRenamed("conv", "c")
    joined = paths.where("block IS NULL").join(digests, F.col("conv").eqNullSafe(F.col("c")))
    done = alone.select("conv", gaps, *told, "sha").unionByName(joined.select("conv", gaps, *told, "sha"))
    rows = alone.select("conv", "part", "block", "lines").unionByName(lines)
    return Repaired(done.select(F.col("conv").alias(conv), "gaps", *told, F.col("sha").alias("repaired_sha256")), rows.withColumnRenamed("conv", conv))


def _arrow(schema: str) -> pa.Schema:
    return to_arrow_schema(T.StructType.fromDDL(schema))


def _in_order(df: DataFrame, n: int) -> DataFrame:
    return df.repartition(n, "conv").sortWithinPartitions("conv", "part", "block")


def _paths(open_: DataFrame, n: int) -> DataFrame:
    """The cheapest way through the blocks of each conversation: a row for each block with its items, and one for the whole, without a block."""
    slim = open_.drop("whole", "cost", "audit", "sha", "held", "lines")
    kind = slim.schema["conv"].dataType.simpleString()
    schema = f"conv {kind}, part int, block long, before int, after int, {COUNTS}, cost long, audit string"
    arrow, names = _arrow(schema), slim.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = (dict(zip(names, row, strict=True)) for row in _rows(batches))
        yield from _sent((row for conv, own in groupby(blocks, key=lambda b: b["conv"]) for row in _path(conv, own)), arrow)

    return _in_order(slim, n).mapInArrow(run, schema)


def _path(conv: Any, blocks: Iterator[dict]) -> Iterator[tuple]:
    """Rows of _paths for one conversation; audits are kept from where the items' differ."""
    best = {ITEMS.index(START): (0, "")}
    settled: list[str] = []
    back: list[tuple[int, int, dict[int, int]]] = []
    sums = dict.fromkeys(["turns", "blank", "duplicate", "truncated", "illegal"], 0)
    low = high = last_turn = last = first = first_turn = None
    for block in blocks:
        after: dict[int, tuple[int, str]] = {}
        came: dict[int, int] = {}
        for move in block["moves"]:
            if (held := best.get(move["before"])) is not None:
                value = (held[0] + move["cost"], held[1] + move["audit"])
                if move["after"] not in after or value < after[move["after"]]:
                    after[move["after"]], came[move["after"]] = value, move["before"]
        common = os.path.commonprefix([audit for _, audit in after.values()])
        settled.append(common)
        best = {to: (cost, audit[len(common) :]) for to, (cost, audit) in after.items()}
        back.append((block["part"], block["block"], came))
        for k in sums:
            sums[k] += block[k]
        sums["illegal"] += last is not None and last + block["first"] not in LEGAL
        first, last = block["first"] if first is None else first, block["last"]
        if block["first_turn"] is not None:
            sums["turns"] -= last_turn == block["first_turn"]
            low = first_turn = block["min_turn"] if low is None else low
            high = last_turn = block["max_turn"]
    value, end = min((best[i], i) for i in map(ITEMS.index, ENDING) if i in best)
    counts = (sums["turns"], low, high, first_turn, last_turn, sums["blank"], sums["duplicate"], sums["truncated"], sums["illegal"], first, last)
    yield (conv, None, None, None, None, *counts, value[0], "".join(settled) + value[1])
    none = (None,) * (len(counts) + 2)
    for part, number, came in reversed(back):
        yield (conv, part, number, came[end], end, *none)
        end = came[end]


def _lines(blocks: DataFrame) -> DataFrame:
    """(conv, part, block, lines): the repaired rows of blocks whose items are known."""
    kind = blocks.schema["conv"].dataType.simpleString()
    schema = f"conv {kind}, part int, block long, lines {LINES}"
    arrow = _arrow(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def told() -> Iterator[tuple]:
            for conv, part, number, moves, held, before, after in _rows(batches):
                audit = next(m["audit"] for m in moves if (m["before"], m["after"]) == (before, after))
                rows = [(r["role"], r["text"], r["kind"]) for r in held]
                yield conv, part, number, _structs(repaired(rows, audit, ITEMS[before]))

        yield from _sent(told(), arrow, 16)

    return blocks.select("conv", "part", "block", "moves", "held", "before", "after").mapInArrow(run, schema)


def _digests(lines: DataFrame, n: int) -> DataFrame:
    """(conv, sha) of conversations from their repaired blocks in order."""
    schema = f"conv {lines.schema['conv'].dataType.simpleString()}, sha string"
    arrow = _arrow(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def told() -> Iterator[tuple]:
            for conv, own in groupby(_rows(batches), key=lambda x: x[0]):
                digest = _Digest()
                for *_, block in own:
                    digest.of([(x["role"], x["text"]) for x in block])
                yield conv, digest.hash.hexdigest()

        yield from _sent(told(), arrow)

    return _in_order(lines, n).mapInArrow(run, schema)


def damaged(df: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """The rows with faults that are decided by the crc32 of conversation and turn; a null is one space."""
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat(said(conv), F.lit(":"), said(turn))) % 20
    rows = df.withColumns({"_fault": fault, role: said(role), text: said(text)}).where("_fault <> 0")
    rows = rows.withColumns(
        {
            text: F.when(F.col("_fault") == 1, "").when(F.col("_fault") == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(F.col(text)),
            role: F.when(F.col("_fault") == 4, USER).otherwise(F.col(role)),
            "_copy": F.explode(F.when(F.col("_fault") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))),
        }
    )
    return rows.drop("_fault", "_copy")
