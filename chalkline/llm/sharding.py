"""Sharding by sampled splitters, with DataFrame operations only.

Records are put in the order of a key (36 bits of the text's digest, then 24 of
the id's), so that equal texts stand together and a hot text still has millions
of places to be cut at. A size-weighted sample of the keys gives quantile
boundaries of many fine ranges; ranges that are overfull once all records are
counted are subdivided, and again while any is. Ranges are the unit of work: no window is wider than one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chalkline.llm.scratch import Scratch, set_apart

#: Bits of the key that come from the id; the rest comes from the text.
ID_BITS = 24
#: A group of equal texts up to this share of a mean shard is never cut.
WHOLE_SHARE = 0.02
#: Fine ranges at least and at most; between them one for each RANGE_BYTES. They bound every table that is broadcast.
RANGES, MOST_RANGES, RANGE_BYTES = 1024, 32_768, 256 << 20
#: Sampled keys expected in a range.
SAMPLE_PER_RANGE = 64


def order_key(text: Column, id_: Column) -> Column:
    """60 bits: 36 of the text's MD5, 24 of the id's."""
    head = F.conv(F.substring(F.md5(F.coalesce(text, F.lit(""))), 1, 9), 16, 10).cast("long")
    tail = F.conv(F.substring(F.md5(F.coalesce(id_.cast("string"), F.lit(""))), 1, 6), 16, 10).cast("long")
    return head * (1 << ID_BITS) + tail


def _with_range(df: DataFrame, bounds: list[int]) -> DataFrame:
    """Adds ``_range``: how many of the sorted bounds are at or below ``_key``.

    The bounds are met by an equi-join on the key's top 12 bits, so that a
    record is compared with those of its own slice only.
    """
    edges = [0, *bounds, 1 << 60]
    lows = df.sparkSession.range(1).select(F.posexplode(F.lit(edges)).alias("_range", "_low"))
    lookup = (
        lows.withColumn("_high", F.get(F.lit(edges), F.col("_range") + 1))
        .where("_high > _low")
        .withColumn("_slice", F.explode(F.sequence(F.shiftright("_low", 48), F.shiftright(F.col("_high") - 1, 48))))
    )
    return (
        df.withColumn("_slice", F.shiftright("_key", 48))
        .join(F.broadcast(lookup), "_slice")  # MOST_RANGES + 4096 rows at most
        .where("_key >= _low AND _key < _high")
        .drop("_slice", "_low", "_high")
    )


def _ranged(slim: DataFrame, total: int, shards: int) -> tuple[DataFrame, list[int], list[int]]:
    """``slim`` with its ranges; the texts whose groups may be cut; keys of so many rows that a range of them alone is overfull."""
    spark = slim.sparkSession
    ranges = max(RANGES, min(MOST_RANGES, total // RANGE_BYTES))
    mean = max(1, total // ranges)

    # Size-weighted sample, then its quantiles.
    draw = F.pmod(F.xxhash64("_key", "_row"), F.lit(1 << 40)) / F.lit(float(1 << 40))
    sample = slim.where(draw < F.col("_size") * (ranges * SAMPLE_PER_RANGE / max(1, total)))
    steps = [i / ranges for i in range(1, ranges)]
    found = sample.agg(F.percentile_approx("_key", F.lit(steps), 16 * ranges)).first()[0] or []

    # Groups that hold two boundaries may be hot; their exact sizes decide. Other boundaries move to the start of their group.
    heads = sorted(b >> ID_BITS for b in found)
    doubtful = sorted({a for a, b in zip(heads, heads[1:]) if a == b})
    hot: list[int] = []
    if doubtful:
        suspects = spark.range(1).select(F.explode(F.lit(doubtful)).alias("_head"))
        sums = (
            slim.withColumn("_head", F.shiftright("_key", ID_BITS))
            .join(F.broadcast(suspects), "_head")  # at most one for every two boundaries
            .groupBy("_head")
            .agg(F.sum("_size").alias("_bytes"))
        )
        hot = [r[0] for r in sums.where(F.col("_bytes") * shards > WHOLE_SHARE * total).select("_head").collect()]
    hot_set = set(hot)
    start = lambda b: b if b >> ID_BITS in hot_set else b >> ID_BITS << ID_BITS
    bounds = sorted({start(b) for b in found})

    # Exact counts; overfull ranges are subdivided by quantiles of their own until none is left that can be.
    while True:
        ranged = _with_range(slim, bounds)
        filled = ranged.groupBy("_range").agg(F.sum("_size").alias("_b"), F.min("_key").alias("_low"), F.max("_key").alias("_high"), F.count(F.lit(1)).alias("_n"))
        full = filled.where(f"_b > {2 * mean}").drop("_b").collect()  # fewer than half of all ranges
        stuck = [r["_low"] for r in full if r["_low"] == r["_high"] and r["_n"] > 1 and r["_low"] >> ID_BITS in hot_set]
        over = [r["_range"] for r in full if r["_low"] < r["_high"]]
        if stuck or not over:
            return ranged, hot, stuck
        wide = spark.range(1).select(F.explode(F.lit(over)).alias("_range"))
        cuts = ranged.join(F.broadcast(wide), "_range").groupBy("_range").agg(F.percentile_approx("_key", F.lit([i / 8 for i in range(1, 8)]), 1000).alias("_cuts"))
        cuts = [b for r in cuts.collect() for b in r["_cuts"]]
        # A key that fills two eighths of its range gets borders of its own, so that what it leaves can be told.
        alone = {x for a, b in zip(cuts, cuts[1:]) if a == b for x in (a, a + 1) if a >> ID_BITS in hot_set}
        finer = sorted({*bounds, *map(start, cuts), *alone})
        if finer == bounds:  # groups that stay whole
            return ranged, hot, []
        bounds = finer


def _scattered(slim: DataFrame, keys: list[int]) -> DataFrame:
    """Rows of these keys get new ones all over the places of their text, by a number that no two of them share.

    They are equal, so which of them has which number says nothing. Numbers come
    from counts by place in the table, not from a window over a key.
    """
    wanted = F.broadcast(slim.sparkSession.range(1).select(F.explode(F.lit(keys)).alias("_key"), F.lit(True).alias("_hot")))  # one for every two ranges at most
    marked = slim.join(wanted, "_key", "left").withColumn("_part", F.shiftright("_row", 20))
    hot = marked.where("_hot")
    counts = hot.groupBy("_key", "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = counts.select("_key", "_part", (F.sum("_n").over(W.partitionBy("_key").orderBy("_part")) - F.col("_n")).alias("_before"))
    number = F.col("_before") + F.row_number().over(W.partitionBy("_key", "_part").orderBy("_row"))
    tail = F.pmod(F.xxhash64("_key", number), F.lit(1 << ID_BITS))
    moved = hot.join(before, ["_key", "_part"]).withColumn("_tail", tail).withColumn("_key", F.shiftleft(F.shiftright("_key", ID_BITS), ID_BITS) + F.col("_tail"))
    return marked.where("_hot IS NULL").select(slim.columns).unionByName(moved.select(slim.columns))


def shard_by_splitters(df: DataFrame, text: str, id_col: str, shards: int = 8) -> DataFrame:
    """Deals the records of ``df`` into shards whose bytes are near equal.

    A record's size is the UTF-8 bytes of its text (null: none) plus 1. Returns
    the id, ``size``, ``text_crc32`` (null for a null text), ``shard`` and
    ``slot`` (gapless from 0 in each shard). Other columns are not carried; an id
    column of an added name comes out with ``_in`` at its end.

    Groups of equal texts stay whole up to WHOLE_SHARE of a mean shard; larger
    ones are cut wherever the sizes ask for it. Null and empty texts form one
    group, null ids come first among equals, rows that repeat are dealt one by
    one, and an empty table gives no rows. Rows equal in id and text have one
    key; where they are too many for a range each gets a key of its own. Reruns
    deal alike: the sample is drawn by hash and changes only how the work is cut up.
    """
    scratch = Scratch(df.sparkSession, "sharding")
    slim = scratch.keep(
        df.select(
            F.col(id_col).alias("_id"),
            (F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1).alias("_size"),
            F.crc32(F.col(text).cast("binary")).alias("_crc"),
            order_key(F.col(text), F.col(id_col)).alias("_key"),
            F.monotonically_increasing_id().alias("_row"),
        ),
        "keys",
    )
    total = slim.agg(F.sum("_size")).first()[0] or 0
    while True:
        ranged, hot, stuck = _ranged(slim, total, shards)
        if not stuck:
            break
        slim = scratch.keep(_scattered(slim, stuck), "scattered")

    heads_hot = F.shiftright("_key", ID_BITS).isin(hot) if hot else F.lit(False)
    sums = ranged.groupBy("_range").agg(F.sum("_size").alias("_b"))
    offsets = sums.select("_range", (F.sum("_b").over(W.orderBy("_range")) - F.col("_b")).alias("_before"))
    order = ["_key", "_id", "_size", "_crc"]
    inside = W.partitionBy("_range").orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    group = W.partitionBy("_range", "_head")
    # Middle of the record, or of the whole group where it is not cut, in half bytes of the total order.
    own = 2 * (F.col("_before") + F.col("_upto")) - F.col("_size")
    whole = 2 * (F.col("_before") + F.min(F.col("_upto") - F.col("_size")).over(group)) + F.sum("_size").over(group)
    placed = scratch.keep(
        ranged.withColumn("_head", F.shiftright("_key", ID_BITS))
        .withColumn("_upto", F.sum("_size").over(inside))
        .withColumn("_rank", F.row_number().over(inside))
        .join(F.broadcast(offsets), "_range")  # a row for each range
        .withColumn("_middle", F.when(heads_hot, own).otherwise(whole))
        .withColumn("shard", F.least(F.lit(shards - 1), F.expr(f"_middle * {shards} div {2 * max(1, total)}")).cast("int"))
        .select("_id", "_size", "_crc", "_range", "_rank", "shard"),
        "placed",
    )
    parts = placed.groupBy("_range", "shard").agg(F.min("_rank").alias("_first"), F.count(F.lit(1)).alias("_n"))
    firsts = parts.select(
        "_range", "shard", "_first", (F.sum("_n").over(W.partitionBy("shard").orderBy("_range")) - F.col("_n")).alias("_base")
    )
    return placed.join(F.broadcast(firsts), ["_range", "shard"]).select(  # ranges + shards rows at most
        F.col("_id").alias(set_apart([id_col], ["size", "text_crc32", "shard", "slot"])[0]),
        F.col("_size").alias("size"),
        F.col("_crc").alias("text_crc32"),
        "shard",
        (F.col("_base") + F.col("_rank") - F.col("_first")).cast("long").alias("slot"),
    )
