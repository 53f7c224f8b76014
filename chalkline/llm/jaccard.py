"""Near-duplicate join on word shingles: MinHash bands, then full sets.

Equal texts (by their words) are one representative from the start. Band hashes
of the representatives are shuffled; a bucket's members are compared with its
leader, on full sets, which settles ordinary buckets and ties large groups
together in one pass. Only buckets that still hold more than one component are
looked into again: first against further members of the leader's component,
then by blocks, where a task holds the sets of two blocks, compares what is
still apart and returns a spanning forest of the links that it finds. So no
candidate pair between components is left open, and no pair is emitted: rows
grow with the members of open buckets. Links are counted inside components by
blocks in the same way. Texts whose numbers of shingles rule the threshold out
are never fetched.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chalkline.llm.components import components
from chalkline.llm.scratch import Scratch, bounded_batches, memory_returned, set_apart
from chalkline.llm.shingles import Words, arrow_bytes, mixed, shingle_set

THRESHOLD = 0.8
#: A pair at the threshold misses all bands with this probability at most.
MISS = 1e-6
#: Hashes that a signature may have.
MOST_HASHES = 300
#: Texts of one component, or of one open bucket, that meet in a task, twice over; and shingles in a block.
BLOCK, OPEN_BLOCK, ROOM = 256, 512, 1 << 20
#: Times that members apart from their leader meet another member of its component before blocks are formed.
PIVOT_ROUNDS = 3
#: Bytes of text, and shingles, that are hashed at once.
CHUNK, STRIPE = 1 << 20, 1 << 16


def bands_and_rows(threshold: float = THRESHOLD, miss: float = MISS, most: int = MOST_HASHES) -> tuple[int, int]:
    """(bands, rows): as many rows in a band as the target recall leaves within ``most`` hashes, since rows keep unlike texts apart."""
    best = (math.ceil(math.log(miss) / math.log(1 - threshold)), 1)
    for rows in range(1, 33):
        bands = math.ceil(math.log(miss) / math.log1p(-(threshold**rows)))
        if bands * rows <= most:
            best = (bands, rows)
    return best


def band_hashes(hashes: np.ndarray, firsts: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """(texts, bands) of 64-bit band hashes; texts without shingles have rows that mean nothing."""
    texts = len(firsts) - 1
    signs = np.random.default_rng(20240607).integers(0, 1 << 32, (bands * rows, 2), np.uint64).astype(np.uint32)
    short = (hashes >> np.uint64(32)).astype(np.uint32)
    full = np.flatnonzero(np.diff(firsts))
    out = np.zeros((texts, bands), np.uint64)
    if not len(full):
        return out
    lows = np.full((bands * rows, len(full)), np.uint32(0xFFFFFFFF))
    begins = firsts[:-1][full]
    # Stripes of shingles stay in the processor's cache while all hashes pass over them.
    for low in range(0, len(short), STRIPE):
        part = short[low : low + STRIPE]
        own = np.arange(np.searchsorted(begins, low, "right") - 1, np.searchsorted(begins, low + len(part), "left"))
        cuts = np.maximum(begins[own] - low, 0)
        buffer = np.empty_like(part)
        for i, (flip, times) in enumerate(signs):
            np.bitwise_xor(part, flip, out=buffer)
            np.multiply(buffer, times | np.uint32(1), out=buffer)
            seen = np.minimum.reduceat(buffer, cuts)
            lows[i, own] = np.minimum(lows[i, own], seen)
    with np.errstate(over="ignore"):
        for b in range(bands):
            h = np.full(len(full), np.uint64(b + 1))
            for r in range(rows):
                h = mixed(h * np.uint64(0x9E3779B97F4A7C15) + lows[b * rows + r].astype(np.uint64))
            out[full, b] = h
    return out


def distinct_counts(hashes: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """Different hashes of each text."""
    who = np.repeat(np.arange(len(firsts) - 1), np.diff(firsts))
    order = np.lexsort((hashes, who))
    own, h = who[order], hashes[order]
    fresh = np.ones(len(own), bool)
    fresh[1:] = (own[1:] != own[:-1]) | (h[1:] != h[:-1])
    return np.bincount(own[fresh], minlength=len(firsts) - 1).astype(np.int64)


def _signed(rows_: DataFrame, bands: int, rows: int) -> DataFrame:
    """(_row, _id) of rows_ (_row, _id, _text) with the keys of the words ``_hi``, ``_lo``, the number of different shingles and the band hashes."""
    bounded_batches(rows_.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = arrow_bytes(batch.column(2))
            at = 0
            while at < len(batch):
                end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + CHUNK, "right")) - 1)
                words = Words(data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at])
                hashes, firsts = words.shingles()
                hi, lo = words.sequence_keys()
                signs = band_hashes(hashes, firsts, bands, rows).view(np.int64)
                signs = pa.ListArray.from_arrays(pa.array(np.arange(end - at + 1, dtype=np.int32) * bands), pa.array(signs.ravel()))
                counts = pa.array(distinct_counts(hashes, firsts))
                own = [batch.column(i).slice(at, end - at) for i in range(2)]
                yield pa.RecordBatch.from_arrays([*own, pa.array(hi.view(np.int64)), pa.array(lo.view(np.int64)), counts, signs], names=["_row", "_id", "_hi", "_lo", "_n", "_bands"])
                at = end
            memory_returned()

    kind = rows_.schema["_id"].dataType.simpleString()
    return rows_.select("_row", "_id", "_text").mapInArrow(run, f"_row long, _id {kind}, _hi long, _lo long, _n long, _bands array<long>")


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """(x, y, like): the Jaccard similarity of the full shingle sets of each pair."""
    side = lambda k: texts.select(F.col("_rep").alias(k), F.col("_text").alias(f"_{k}"))
    both = pairs.join(side("x"), "x").join(side("y"), "y").select("x", "y", "_x", "_y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept: dict[int, np.ndarray] = {}
            like = np.empty(len(batch))
            for i, (x, y, tx, ty) in enumerate(zip(*(batch.column(c).to_pylist() for c in range(4)), strict=True)):
                if len(kept) > 64:
                    kept.clear()
                a = kept[x] if x in kept else kept.setdefault(x, shingle_set(tx))
                b = kept[y] if y in kept else kept.setdefault(y, shingle_set(ty))
                common = len(np.intersect1d(a, b, assume_unique=True))
                like[i] = common / max(1, len(a) + len(b) - common)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(like)], names=["x", "y", "like"])
        memory_returned()

    return both.mapInArrow(run, "x long, y long, like double")


def _blocks(count: Column, shingles: Column, most: int) -> Column:
    """Blocks of at most ``most`` texts, and about ROOM shingles, on average."""
    return F.ceil(F.greatest(count / most, shingles / ROOM)).cast("int")


def _dealt(members: DataFrame, by: str, most: int) -> DataFrame:
    """members (with ``by``, _rep, _n) dealt into blocks: a row for each pair of blocks (_i, _j) that its own one (_block) is in."""
    sizes = members.groupBy(by).agg(F.count(F.lit(1)).alias("_m"), F.sum("_n").alias("_room"))
    sized = members.join(sizes.withColumn("_of", _blocks(F.col("_m"), F.col("_room"), most)).select(by, "_of"), by)
    return (
        sized.withColumn("_block", F.pmod(F.xxhash64("_rep"), "_of").cast("int"))
        .withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_of") - 1)))
        .withColumn("_i", F.least("_block", "_other"))
        .withColumn("_j", F.greatest("_block", "_other"))
        .drop("_of", "_other")
    )


def _links(members: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """(_rep, links) over (_rep, comp, copies, _n): for each text the rows whose texts are linked with it, its own copies apart.

    A component of m texts is dealt into blocks; each two blocks meet in a task
    that returns counts, so rows grow as m^2 / BLOCK and no pair is emitted.
    """
    dealt = _dealt(members, "comp", BLOCK).join(texts.select("_rep", "_text"), "_rep")

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        sets = [shingle_set(t) for t in rows["_text"]]
        lengths = np.array([len(s) for s in sets])
        flat, who = np.concatenate(sets), np.repeat(np.arange(len(sets)), lengths)
        values, place, times = np.unique(flat, return_inverse=True, return_counts=True)
        shared = times[place] > 1
        columns = np.cumsum(times > 1) - 1
        who, place = who[shared], columns[place[shared]]
        common = np.zeros((len(sets), len(sets)), np.float32)
        for low in range(0, int((times > 1).sum()), 4096):  # exact: counts stay under 2^24
            part = (place >= low) & (place < low + 4096)
            table = np.zeros((len(sets), 4096), np.float32)
            table[who[part], place[part] - low] = 1
            common += table @ table.T
        common = common.astype(np.float64)
        union = lengths[:, None] + lengths[None, :] - common
        linked = common >= threshold * union
        block, i, j = rows["_block"].to_numpy(), rows["_i"].iloc[0], rows["_j"].iloc[0]
        linked &= (block[:, None] != block[None, :]) if i != j else ~np.eye(len(sets), dtype=bool)
        return pd.DataFrame({"_rep": rows["_rep"], "links": (linked @ rows["copies"].to_numpy().astype(np.float64)).astype(np.int64)})

    return dealt.groupBy("comp", "_i", "_j").applyInPandas(run, "_rep long, links long").groupBy("_rep").agg(F.sum("links").alias("links"))


def _open(large: DataFrame, comp: DataFrame, scratch: Scratch) -> DataFrame:
    """Rows of the buckets that hold more than one component, with their own (comp) and their leader's (_lead).

    What is told of a bucket is a table of its own, so that joining it to the
    members of a large bucket can be split.
    """
    placed = large.join(comp.withColumnRenamed("node", "_rep"), "_rep", "left").withColumn("comp", F.coalesce("comp", "_rep"))
    kinds = placed.groupBy("_band").agg(
        F.min("comp").alias("_c"), F.max("comp").alias("_d"), F.max(F.when(F.col("_rep") == F.col("_leader"), F.col("comp"))).alias("_lead")
    )
    return placed.join(scratch.keep(kinds.where("_c <> _d").select("_band", "_lead"), "kinds"), "_band")


def _forest(open_: DataFrame, signs: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """(a, b): links that tie together what is linked inside the open buckets (_band, _rep, comp, _n), all pairs looked at.

    Of buckets with the same members the one with the least hash stands for
    all. A pair belongs to the least hash that its texts share, so that it is
    looked at once, whatever the number of buckets in which it meets.
    """
    marks = open_.groupBy("_band").agg(F.count(F.lit(1)).alias("_m"), F.sum(F.xxhash64("_rep").cast("decimal(38,0)")).alias("_sum"))
    first = marks.groupBy("_m", "_sum").agg(F.min("_band").alias("_band")).select("_band")
    members = open_.join(first, "_band").select("_band", "_rep", "comp", "_n")
    dealt = _dealt(members, "_band", OPEN_BLOCK).join(signs, "_rep").join(texts, "_rep")

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rep, comp, n = (rows[c].to_numpy() for c in ("_rep", "comp", "_n"))
        block, here, alone = rows["_block"].to_numpy(), rows["_band"].iloc[0], rows["_i"].iloc[0] == rows["_j"].iloc[0]
        apart = comp[:, None] != comp[None, :]
        apart &= np.triu(np.ones_like(apart), 1) if alone else (block[:, None] < block[None, :])
        apart &= np.minimum(n[:, None], n[None, :]) >= threshold * np.maximum(n[:, None], n[None, :])
        least, shared = np.full(apart.shape, np.iinfo(np.int64).max), np.zeros(apart.shape, np.int16)
        for own in np.stack(rows["_bands"].to_list()).T:
            same = own[:, None] == own[None, :]
            shared += same
            np.minimum(least, np.where(same, own[:, None], np.iinfo(np.int64).max), out=least)
        x, y = np.nonzero(apart & (least == here))
        order = np.argsort(-shared[x, y], kind="stable")  # the most alike first: what they tie together needs no further look
        root: dict[int, int] = {}

        def top(c: int) -> int:
            while c in root:
                c = root[c]
            return c

        sets: dict[int, np.ndarray] = {}
        found = []
        of = lambda i: sets[i] if i in sets else sets.setdefault(i, shingle_set(rows["_text"].iloc[i]))
        for i, j in zip(x[order].tolist(), y[order].tolist(), strict=True):
            a, b = top(int(comp[i])), top(int(comp[j]))
            if a != b:
                s, t = of(i), of(j)
                common = len(np.intersect1d(s, t, assume_unique=True))
                if common >= threshold * (len(s) + len(t) - common):
                    root[max(a, b)] = min(a, b)
                    found.append((rep[i], rep[j]))
        memory_returned()
        return pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    return dealt.groupBy("_band", "_i", "_j").applyInPandas(run, "a long, b long")


def _grown(comp: DataFrame, more: DataFrame, scratch: Scratch) -> DataFrame:
    """Components (node, comp) with the links ``more`` (a, b): only what the links tie together is labelled anew, a component being one node."""
    if more.isEmpty():
        return comp
    told = lambda df, end: df.join(comp.withColumnRenamed("node", end), end, "left").withColumn(end, F.coalesce("comp", end)).drop("comp")
    tied = scratch.keep(told(told(more, "a"), "b").where("a <> b").distinct(), "tied")
    fresh = more.select(F.col("a").alias("node")).unionByName(more.select(F.col("b").alias("node"))).distinct().join(comp, "node", "left_anti")
    every = comp.select("node", "comp").unionByName(fresh.withColumn("comp", F.col("node")))
    moved = components(tied, scratch)
    grown = every.join(moved.select(F.col("node").alias("comp"), F.col("comp").alias("_to")), "comp", "left").select("node", F.coalesce("_to", "comp").alias("comp"))
    grown = scratch.keep(grown, "components")
    scratch.drop(comp, moved, tied)
    return grown


def near_classes(
    df: DataFrame, text: str, id_col: str, keep: list[str] | None = None, threshold: float = THRESHOLD, count_links: bool = True
) -> DataFrame:
    """One row for each row of df: ``keep``, ``class_id``, ``is_first`` and, if asked for, ``n_links``.

    Rows are linked if the sets of five-word shingles have a Jaccard similarity
    of ``threshold`` or more; a shorter text is one shingle of all its words,
    and texts without a word (null, empty) are equal to each other. Classes are
    the connected components of links; class_id is the smallest id in it (null
    if it has only null ids), is_first holds for one row of that id, and
    n_links counts the other rows that a row is linked with. A column of
    ``keep`` with an added name comes out with ``_in`` at its end. An empty
    table gives no rows.
    """
    keep = [id_col] if keep is None else keep
    scratch = Scratch(df.sparkSession, "jaccard")
    bands, rows = bands_and_rows(threshold)
    inner = df.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)], F.col(id_col).alias("_id"), F.col(text).alias("_text"))
    names = [f"k{i}" for i in range(len(keep))]
    given = scratch.keep(inner.withColumn("_row", F.monotonically_increasing_id()), "given")
    signed = scratch.keep(_signed(given, bands, rows), "signed")

    distinct = signed.groupBy("_hi", "_lo").agg(F.min("_row").alias("_rep"), F.count(F.lit(1)).alias("copies"))
    member = scratch.keep(signed.select("_row", "_id", "_hi", "_lo").join(distinct, ["_hi", "_lo"]).select("_row", "_id", "_rep", "copies"), "members")
    reps = member.where("_row = _rep").select("_rep", "copies")
    signs, texts = signed.select(F.col("_row").alias("_rep"), "_n", "_bands"), given.select(F.col("_row").alias("_rep"), "_text")

    banded = (
        signs.join(reps.select("_rep"), "_rep").where("_n > 0")
        .select("_rep", "_n", F.explode("_bands").alias("_band"))
    )
    buckets = banded.groupBy("_band").agg(F.min(F.struct("_rep", "_n")).alias("_first"), F.count(F.lit(1)).alias("_size")).where("_size > 1")
    buckets = scratch.keep(buckets.select("_band", "_size", F.col("_first._rep").alias("_leader"), F.col("_first._n").alias("_most")), "leaders")
    bucketed = scratch.keep(banded.join(buckets, "_band"), "buckets")
    # Sets of unlike sizes can't be linked.
    alike = lambda a, b: F.least(a, b) >= threshold * F.greatest(a, b)
    to_leader = bucketed.where("_rep <> _leader").where(alike(F.col("_n"), F.col("_most"))).select(F.col("_rep").alias("x"), F.col("_leader").alias("y"))
    edges = lambda seen: seen.where(F.col("like") >= threshold).select(F.col("x").alias("a"), F.col("y").alias("b"))
    linked = scratch.keep(edges(_verified(to_leader.distinct(), texts)), "stars")
    comp = components(linked, scratch)

    # Buckets of three and more whose members are still in different components.
    large = scratch.keep(_open(bucketed.where("_size > 2").select("_band", "_rep", "_n", "_leader"), comp, scratch).drop("comp", "_lead"), "large")
    scratch.drop(bucketed, buckets)
    # Who isn't with the leader meets another member of the leader's component, a different one in each bucket.
    for turn in range(PIVOT_ROUNDS):
        open_ = scratch.keep(_open(large, comp, scratch), "open")
        pivots = open_.where("comp = _lead AND _rep <> _leader").groupBy("_band")
        pivots = pivots.agg(F.min_by(F.struct("_rep", "_n"), F.xxhash64("_rep", "_band", F.lit(turn))).alias("y"))
        met = open_.where("comp <> _lead").select("_band", F.col("_rep").alias("x"), "_n").join(pivots, "_band")
        met = met.where(alike(F.col("_n"), F.col("y._n"))).select("x", F.col("y._rep").alias("y")).distinct()
        comp = _grown(comp, scratch.keep(edges(_verified(met, texts)), "pivots"), scratch)
        scratch.drop(open_)
    open_ = scratch.keep(_open(large, comp, scratch).select("_band", "_rep", "_n", "comp"), "open")
    comp = _grown(comp, scratch.keep(_forest(open_, signs.select("_rep", "_bands"), texts, threshold), "forest"), scratch)
    scratch.free(given, signed, member, comp)

    classed = reps.join(comp.withColumnRenamed("node", "_rep"), "_rep", "left").withColumn("comp", F.coalesce("comp", "_rep"))
    if count_links:
        grouped = classed.join(comp.select(F.col("node").alias("_rep")), "_rep", "left_semi").join(signs.select("_rep", "_n"), "_rep")
        classed = classed.join(_links(scratch.keep(grouped, "grouped"), texts, threshold), "_rep", "left")
        classed = classed.withColumn("n_links", F.coalesce("links", F.lit(0)) + F.col("copies") - 1)
    classed = scratch.keep(classed.drop("copies", "links"), "classed")
    placed = scratch.keep(member.drop("copies").join(classed, "_rep"), "placed")
    scratch.free(given, placed)
    firsts = placed.groupBy("comp").agg(F.min("_id").alias("class_id"))
    named = placed.join(firsts, "comp")
    same = F.col("_id").eqNullSafe(F.col("class_id"))
    first_row = named.where(same).groupBy("comp").agg(F.min("_row").alias("_first"))
    out = (
        named.join(first_row, "comp")
        .select("_row", "class_id", (F.col("_row") == F.col("_first")).alias("is_first"), *(["n_links"] if count_links else []))
    )
    out = scratch.keep(out, "classes")
    scratch.free(given, out)
    apart = set_apart(keep, ["class_id", "is_first", "n_links"])
    return given.select("_row", *[F.col(n).alias(c) for n, c in zip(names, apart, strict=True)]).join(out.hint("merge"), "_row").drop("_row")
