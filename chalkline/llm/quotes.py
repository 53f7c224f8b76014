"""Conversations in reply order, without quotations.

Lines that open with ``>`` are quotations; the number of marks is their level.
Consecutive lines of one level form a passage. Passages, their paragraphs and
their lines are normalised and hashed, and meet the same units of what earlier
messages said themselves. A message replies to the one that its nearest
quotation comes from, else to the turn before.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import blake2b
from itertools import groupby

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chalkline.llm.scratch import Scratch, bounded_batches

#: Turns that are searched together for an original.
BLOCK = 1024
MARKS = re.compile(r"^[ \t]*((?:>[ \t]*)+)")
BLANK = re.compile(r"\n[ \t]*\n")


def parse(text: str) -> tuple[str, list[tuple[int, str]]]:
    """(what the message says itself, [(level, passage)] of what it quotes)."""
    lines = []
    for line in text.split("\n"):
        m = MARKS.match(line)
        lines.append((m[1].count(">"), line[m.end() :]) if m else (0, line))
    runs = [(level, "\n".join(x for _, x in own)) for level, own in groupby(lines, key=lambda x: x[0])]
    return "\n".join(x for level, x in runs if not level).strip("\n"), [(level, x) for level, x in runs if level]


def units(passage: str) -> dict[str, int]:
    """Words by hash of the whole passage, its paragraphs and its lines, each with case and spacing levelled."""
    found = {}
    for x in (passage, *BLANK.split(passage), *passage.split("\n")):
        words = x.lower().split()
        if words:
            found[blake2b(" ".join(words).encode(), digest_size=16).hexdigest()] = len(words)
    return found


PARSED = (
    "conv_id {0}, turn {1}, role {2}, text string, n_quotes int, own array<string>, quoted array<struct<level:int,words:int,hash:string>>"
)


def _parsed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        out: dict[str, list] = {"text": [], "n_quotes": [], "own": [], "quoted": []}
        for text in batch["text"]:
            said, quotes = parse(text or "")
            out["text"].append(said if text is not None else None)
            out["n_quotes"].append(len(quotes))
            out["own"].append(list(units(said)))
            out["quoted"].append([{"level": level, "words": n, "hash": h} for level, x in quotes for h, n in units(x).items()])
        yield batch.assign(**out)[["conv_id", "turn", "role", "text", "n_quotes", "own", "quoted"]]


def _jumped(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(conv, at, top): where the chain of ``to`` from each node ends, by pointer jumping; a node without ``to`` is its own end.

    A round joins only the nodes that haven't met an end yet.
    """
    state = scratch.keep(links.select("conv", "at", F.coalesce("to", "at").alias("top"), F.col("to").isNull().alias("ended")), "chain")
    while not (open_ := state.where("NOT ended")).isEmpty():
        far = state.select("conv", F.col("at").alias("top"), F.col("top").alias("far"), F.col("ended").alias("met"))
        moved = open_.select("conv", "at", "top").join(far, ["conv", "top"]).select("conv", "at", F.col("far").alias("top"), F.col("met").alias("ended"))
        before, state = state, scratch.keep(state.where("ended").unionByName(moved), "chain")
        scratch.drop(before)
    return state.drop("ended")


def _said_before(originals: DataFrame, asked: DataFrame) -> DataFrame:
    """(conv_id, hash, turn, said): the last turn before each asked one that says a unit itself, where there is one.

    Turns are cut into blocks, so that a unit that a conversation says all the
    time is no single partition: inside a block the rows are searched in order,
    before it only the last turn of each earlier block.
    """
    keys = ["conv_id", "hash"]
    block = F.floor(F.col("turn") / BLOCK).alias("block")
    said = originals.join(asked.select(*keys).distinct(), keys, "left_semi").select(*keys, "turn", block, F.lit(True).alias("own"))
    rows = said.unionByName(asked.select(*keys, "turn", block, F.lit(False).alias("own")))
    before = W.partitionBy(*keys, "block").orderBy("turn").rangeBetween(W.unboundedPreceding, -1)
    near = rows.withColumn("near", F.max(F.when(F.col("own"), F.col("turn"))).over(before)).where("NOT own")
    lasts = rows.groupBy(*keys, "block").agg(F.max(F.when(F.col("own"), F.col("turn"))).alias("last"))
    earlier = F.max("last").over(W.partitionBy(*keys).orderBy("block").rowsBetween(W.unboundedPreceding, -1))
    found = near.join(lasts.select(*keys, "block", earlier.alias("far")), [*keys, "block"])
    return found.select(*keys, "turn", F.coalesce("near", "far").alias("said")).where("said IS NOT NULL")


def reply_ordered(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Messages without their quotations, with what orders a conversation by its replies.

    Returns conv_id, turn, role, text, n_quotes, ``quoted_turn`` (the message
    linked through a quotation), ``parent_turn`` (that, else the turn before if
    it exists), ``branch_turn`` (where the run of messages that answer the turn
    before them begins) and ``root_turn``. By (root_turn, branch_turn, turn) a
    message stands after the one it replies to. Links count from a message's
    lowest level, there from its longest unit, there from the latest original,
    that is the last message before it that says the unit itself.

    Null texts stay null and link to nothing; rows with a null conversation or
    turn have no links; rows that repeat a turn are one message for links and
    come out each. Only the four columns named are read, whatever else there is;
    an empty table gives no rows. Turns are whole numbers. No step gathers a conversation in one place.
    """
    bounded_batches(df.sparkSession)
    scratch = Scratch(df.sparkSession, "quotes")
    rows = df.select(F.col(conv).alias("conv_id"), F.col(turn).alias("turn"), F.col(role).alias("role"), F.col(text).alias("text"))
    kinds = [f.dataType.simpleString() for f in rows.schema.fields[:3]]
    parsed = scratch.keep(rows.mapInPandas(_parsed, PARSED.format(*kinds)), "parsed")
    known = parsed.where("conv_id IS NOT NULL AND turn IS NOT NULL")
    originals = known.select("conv_id", "turn", F.explode("own").alias("hash")).distinct()
    quotes = scratch.keep(known.select("conv_id", "turn", F.explode("quoted").alias("q")).select("conv_id", "turn", "q.*"), "quoted")
    # The nearest quotation: greatest by (-level, words, turn) among those that meet an earlier original.
    linked = (
        quotes.join(_said_before(originals, quotes.select("conv_id", "hash", "turn").distinct()), ["conv_id", "hash", "turn"])
        .groupBy("conv_id", "turn")
        .agg(F.max(F.struct(-F.col("level"), F.col("words"), F.col("said"))).getField("said").alias("quoted_turn"))
    )
    nodes = known.select("conv_id", "turn").distinct()
    earlier = nodes.select("conv_id", (F.col("turn") + 1).alias("turn"), F.lit(True).alias("_follows"))
    replies = scratch.keep(
        nodes.join(linked, ["conv_id", "turn"], "left")
        .join(earlier, ["conv_id", "turn"], "left")
        .withColumn("parent_turn", F.coalesce("quoted_turn", F.when(F.col("_follows"), F.col("turn") - 1)))
        .withColumn("_chained", F.col("_follows").isNotNull() & (F.col("parent_turn") == F.col("turn") - 1)),
        "replies",
    )
    link = lambda to: replies.select(F.col("conv_id").alias("conv"), F.col("turn").alias("at"), to.alias("to"))
    ends = lambda found, name: found.select(F.col("conv").alias("conv_id"), F.col("at").alias("turn"), F.col("top").alias(name))
    branches = ends(_jumped(link(F.when(F.col("_chained"), F.col("parent_turn"))), scratch), "branch_turn")
    roots = ends(_jumped(link(F.col("parent_turn")), scratch), "root_turn")
    told = replies.drop("_follows", "_chained").join(branches, ["conv_id", "turn"]).join(roots, ["conv_id", "turn"])
    return parsed.select("conv_id", "turn", "role", "text", "n_quotes").join(told, ["conv_id", "turn"], "left")
