"""Mixing sources to target weights by entropy balancing, with DataFrame operations only.

Document rates r minimise the relative entropy to 1 under one token constraint
for each source and 0 <= r <= MOST. The solution is an exponential tilt,
r = min(MOST, exp(lambda * n / mean n)), and the dual is convex with one lambda
for each source. Newton's steps, kept inside a bracket, run over the histogram
of (source, size): one distributed aggregation a step, all sources at once.
Rates are then rounded into copies by systematic rounding along the sizes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chalkline.llm.scratch import Scratch, set_apart

#: A document is taken so many times at most, and a target is at most so many times its source's size.
MOST = 3
#: Weights of the sources by code point, repeated.
WEIGHTS = (1, 2, 3)
#: Newton's steps stop at this relative gap; to need so many is an error.
GAP, STEPS = 1e-7, 80
#: Starts of the systematic rounding that are tried for each source.
STARTS = 64
#: Parts that the copies of one size are ranked in.
SALTS = 1024
#: Rates are held in units of 2^-RATE_BITS, so that sums don't depend on their order.
RATE_BITS = 20

WORDS = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long")


def _source_key(source: Column) -> Column:
    """The source with null as a value of its own; it sorts last."""
    return F.coalesce(F.concat(F.lit("s"), source.cast("string")), F.lit("~null"))


def _running(df: DataFrame, order: list[str], sums: dict[str, Column], scratch: Scratch) -> DataFrame:
    """Adds, for each of ``sums``, the sum over all rows up to this one in the order.

    Rows are dealt by ranges of the order and summed inside a range; what the
    ranges before hold is a sum over as many rows as there are ranges.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = scratch.keep(df.repartitionByRange(n, *order).withColumn("_part", F.spark_partition_id()), "ordered")
    inside = W.partitionBy("_part").orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    earlier = W.partitionBy().orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    totals = placed.groupBy("_part").agg(*[F.sum(x).alias(k) for k, x in sums.items()])
    before = totals.select("_part", *[F.coalesce(F.sum(k).over(earlier), F.lit(0)).alias(f"_before_{k}") for k in sums])
    found = placed.withColumns({k: F.sum(x).over(inside) for k, x in sums.items()}).join(before, "_part")
    return found.withColumns({k: F.col(k) + F.col(f"_before_{k}") for k in sums}).drop("_part", *[f"_before_{k}" for k in sums])


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, scratch: Scratch | None = None) -> DataFrame:
    """Targets in tokens of (_source, source_size): the whole shared by weight, none above MOST times its source.

    A source is capped if its cap for a unit of weight is under the level that
    the others would reach; caps in rising order show where that stops. Sources
    may be as many as hosts: no step has all of them in one task.
    """
    scratch = scratch or Scratch(sizes.sparkSession, "targets")
    numbered = _running(sizes, ["_source"], {"_rank": F.lit(1).cast("long")}, scratch)
    weighed = numbered.withColumn("_weight", F.get(F.lit(list(weights)), F.pmod(F.col("_rank") - 1, F.lit(len(weights))).cast("int")))
    weighed = weighed.withColumn("_by_weight", MOST * F.col("source_size") / F.col("_weight"))
    rising = _running(weighed, ["_by_weight", "_source"], {"_caps": MOST * F.col("source_size"), "_upto": F.col("_weight").cast("long")}, scratch)
    rising = scratch.keep(rising, "rising")
    everything = rising.agg(F.sum("source_size").alias("_all"), F.sum("_weight").alias("_every"))
    ranked = (
        rising.crossJoin(F.broadcast(everything))  # one row
        .withColumn("_left", F.col("_all") - F.col("_caps") + MOST * F.col("source_size"))
        .withColumn("_weights", F.col("_every") - F.col("_upto") + F.col("_weight"))
        .withColumn("_level", F.col("_left") / F.col("_weights"))
    )
    # The first source that stays under its cap sets the level of all after it.
    free = ranked.where(F.col("_by_weight") > F.col("_level")).agg(F.min(F.struct("_by_weight", "_source", "_level")).alias("_free"))
    told = ranked.crossJoin(F.broadcast(free))  # one row
    capped = F.col("_free").isNull() | (F.struct("_by_weight", "_source") < F.struct("_free._by_weight", "_free._source"))
    target = F.when(capped, MOST * F.col("source_size")).otherwise(F.col("_free._level") * F.col("_weight"))
    return told.withColumn("target", target.cast("double")).select("_source", "source_size", "target", "_mean", "_least")


def _tilted(lam: Column, x: Column) -> Column:
    return F.exp(F.least(F.lit(1.0986122886681098), F.greatest(F.lit(-700.0), lam * x)))  # ln 3


def _balanced(cells: DataFrame, targets: DataFrame, scratch: Scratch) -> DataFrame:
    """Lambda of each source by safeguarded Newton steps over the histogram."""
    reach = 1.1 * 1.0986122886681098 * F.col("_mean") / F.col("_least")
    state = targets.select(
        "_source", "target", "_mean", F.lit(0.0).alias("_lam"), (-60 * reach).alias("_low"), reach.alias("_high"), F.lit(False).alias("_done")
    )
    state = scratch.keep(state, "state")
    exact = lambda x: F.sum(x.cast("decimal(34,9)")).cast("double")  # noqa: E731  a sum that no order changes
    for _ in range(STEPS):
        x = F.col("_size") / F.col("_mean")
        rate = _tilted(F.col("_lam"), x)
        tokens = rate * F.col("_size") * F.col("_n")
        sums = (
            cells.join(state.where("NOT _done"), "_source")
            .groupBy("_source")
            .agg(exact(tokens).alias("_got"), exact(F.when(rate < MOST, tokens * x).otherwise(0.0)).alias("_slope"))
        )
        gap = F.col("_got") - F.col("target")
        low = F.when(gap < 0, F.col("_lam")).otherwise(F.col("_low"))
        high = F.when(gap > 0, F.col("_lam")).otherwise(F.col("_high"))
        newton = F.col("_lam") - gap / F.nullif(F.col("_slope"), F.lit(0.0))
        inside = (newton > F.col("_low2")) & (newton < F.col("_high2"))
        moved = (
            state.join(sums, "_source", "left")
            .withColumn("_low2", low)
            .withColumn("_high2", high)
            .withColumn("_end", F.col("_done") | (F.abs(gap) <= GAP * F.col("target") + 1e-3) | (F.col("_high2") - F.col("_low2") < 1e-12))
            .withColumn("_next", F.when(inside, newton).otherwise((F.col("_low2") + F.col("_high2")) / 2))
            .select(
                "_source",
                "target",
                "_mean",
                F.when(F.col("_end"), F.col("_lam")).otherwise(F.col("_next")).alias("_lam"),
                F.coalesce("_low2", "_low").alias("_low"),
                F.coalesce("_high2", "_high").alias("_high"),
                F.coalesce("_end", F.lit(True)).alias("_done"),
            )
        )
        before, state = state, scratch.keep(moved, "state")
        scratch.drop(before)
        if state.where("NOT _done").isEmpty():
            return state
    raise ArithmeticError(f"rates miss their targets by more than {GAP} after {STEPS} steps")


def mix_sources(df: DataFrame, size: Column, source: str, id_col: str, weights: tuple[int, ...] = WEIGHTS, by: str | None = None) -> DataFrame:
    """Copies of each row of ``df`` in the mix.

    Returns id_col, source, ``size``, ``source_size``, ``target`` (its source's,
    in tokens) and ``copies`` (0 to MOST), and no other column of df; an id or
    source of an added name comes out with ``_in`` at its end. A source's copies come to its target
    within a fraction of its largest document, and at the cap exactly. Null
    sources form one source, the last; rows of size 0 take no part in the sums
    and are copied once; rows that repeat are rated one by one; an empty table
    gives no rows. Reruns agree: sums are exact, and ranks go by a hash of the
    column ``by`` (the id where it isn't given) and then the id.
    """
    scratch = Scratch(df.sparkSession, "mixing")
    apart = set_apart([id_col, source], ["size", "source_size", "target", "copies"])
    draw = F.xxhash64(F.col(by or id_col), F.lit(11))
    rows = scratch.keep(
        df.select(
            F.col(id_col).alias("_id"), F.col(source).alias("_given"), _source_key(F.col(source)).alias("_source"), size.alias("_size"), draw.alias("_draw")
        ),
        "sizes",
    )
    rows = rows.withColumn("_salt", F.pmod("_draw", F.lit(SALTS)).cast("int"))
    salted = scratch.keep(rows.groupBy("_source", "_size", "_salt").agg(F.count(F.lit(1)).alias("_m")), "salted")
    cells = scratch.keep(salted.groupBy("_source", "_size").agg(F.sum("_m").alias("_n")), "cells")
    weighed = cells.groupBy("_source").agg(
        F.sum(F.col("_size") * F.col("_n")).alias("source_size"),
        F.coalesce(F.sum(F.col("_size") * F.col("_n")) / F.sum(F.when(F.col("_size") > 0, F.col("_n"))), F.lit(1.0)).alias("_mean"),
        F.coalesce(F.min(F.when(F.col("_size") > 0, F.col("_size"))), F.lit(1)).cast("double").alias("_least"),
    )
    targets = scratch.keep(source_targets(weighed, weights, scratch), "targets")
    state = _balanced(cells.where("_size > 0"), targets, scratch)

    # Rates as integers; along the sizes of a source their running sum says how many copies were due before a cell.
    unit = 1 << RATE_BITS
    at_cap = F.col("target") >= MOST * F.col("source_size")
    rate = F.when(at_cap | (F.col("_size") == 0), F.when(F.col("_size") == 0, 1.0).otherwise(float(MOST))).otherwise(
        _tilted(F.col("_lam"), F.col("_size") / F.col("_mean"))
    )
    along = W.partitionBy("_source").orderBy("_size").rowsBetween(W.unboundedPreceding, W.currentRow)
    rated = (
        cells.join(targets.drop("_mean", "_least").join(state.select("_source", "_lam", "_mean"), "_source"), "_source")
        .withColumn("_rate", F.round(rate * unit).cast("long"))
        .withColumn("_due", F.sum(F.col("_rate") * F.col("_n")).over(along) - F.col("_rate") * F.col("_n"))
    )
    rated = scratch.keep(rated.select("_source", "_size", "_n", "_rate", "_due", "source_size", "target"), "rated")
    upto = lambda x, start: F.shiftright(x + start, RATE_BITS)
    start = F.col("_start") * (unit // STARTS)
    tried = (
        rated.where("_size > 0")
        .withColumn("_start", F.explode(F.sequence(F.lit(0), F.lit(STARTS - 1))))
        .groupBy("_source", "_start")
        .agg(
            F.sum(F.col("_size") * (upto(F.col("_due") + F.col("_rate") * F.col("_n"), start) - upto(F.col("_due"), start))).alias("_got"),
            F.first("target").alias("_goal"),
        )
        .groupBy("_source")
        .agg(F.min_by("_start", F.struct(F.abs(F.col("_got") - F.col("_goal")), "_start")).alias("_start"))
    )

    within = W.partitionBy("_source", "_size").orderBy("_salt").rowsBetween(W.unboundedPreceding, W.currentRow)
    parts = (
        salted.withColumn("_skip", F.sum("_m").over(within) - F.col("_m"))
        .join(rated, ["_source", "_size"])
        .join(tried, "_source", "left")
        .select("_source", "_size", "_salt", "_skip", "_rate", "_due", "source_size", "target", F.coalesce(start, F.lit(0)).alias("_start"))
    )
    ranked = rows.withColumn(
        "_rank", F.row_number().over(W.partitionBy("_source", "_size", "_salt").orderBy("_draw", "_id"))
    )
    place = F.col("_due") + (F.col("_skip") + F.col("_rank")) * F.col("_rate")
    copies = upto(place, F.col("_start")) - upto(place - F.col("_rate"), F.col("_start"))
    return ranked.join(parts, ["_source", "_size", "_salt"]).select(
        F.col("_id").alias(apart[0]),
        F.col("_given").alias(apart[1]),
        F.col("_size").alias("size"),
        "source_size",
        "target",
        copies.cast("int").alias("copies"),
    )
