"""Removal of byte strings that repeat anywhere in a corpus, by suffix sorting of shards.

Two equal strings of LENGTH bytes have the same smallest K-gram at the same
place, their anchor. A text is cut into segments, each the window starts that
share an anchor, and equal windows can only be in segments with equal anchors.
So anchors that are single in the corpus need no more work, equal segments are
one with a count, and shards of segments with equal anchors are independent:
each is suffix-sorted by external induction (:mod:`suffixsort`), where windows
that repeat are neighbours with a common prefix of LENGTH, as the prefixes tell
that the sort carries along.

Many segments share little besides their anchor. Before a shard is sorted,
windows go of which a stretch of bytes that neighbours have in common stands
once in a chunk of whole keys; what is left is sorted, and the sort decides.

An anchor under which too many different segments meet is split by content:
windows in half of the offsets share more bytes than the anchor, and those
bytes make the new key. It ends, at the latest, with windows of one offset,
whose key is all of their bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chalkline.llm.scratch import Scratch, bounded_batches, memory_returned, set_apart
from chalkline.llm.shingles import arrow_bytes, content_hashes, prefix_sums, stretch_hashes, window_hashes
from chalkline.llm.suffixsort import repeated_starts

#: A string that repeats has so many bytes.
LENGTH = 200
#: Bytes of an anchor.
GRAM = 40
#: Different segments under one key; with more the key is split.
MOST_SEGMENTS = 256
#: Bytes of text that are cut at once.
CHUNK = 1 << 18
#: Bytes of segments that are given out at once.
OUT = 4 << 20
#: Bytes of segments in a shard of the suffix sorter, whose tuples go to disk beyond the sorter's budget (they take 18 times as much).
SHARD = 2 << 20
#: Strips that ``length`` neighbouring windows are dealt into before they are sorted.
STRIPS = 10


def sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """Least of each ``width`` neighbours: running minima inside blocks from both ends."""
    n = len(x) - width + 1
    padded = np.full(-(-len(x) // width) * width, np.iinfo(x.dtype).max, x.dtype)
    padded[: len(x)] = x
    rows = padded.reshape(-1, width)
    left = np.minimum.accumulate(rows, axis=1).ravel()
    right = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[:n], left[width - 1 : width - 1 + n])


def segments(data: np.ndarray, offsets: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """Segments of texts that stand one after another: (text, first, last, anchor, key, content).

    ``first`` and ``last`` are window starts in the text, ``anchor`` the place
    of its K-gram, ``key`` that K-gram's hash and ``content`` the hash of all
    bytes of the segment's windows.
    """
    sums = prefix_sums(data)
    grams = window_hashes(sums, gram)
    width = length - gram + 1
    none = tuple(np.empty(0, np.int64) for _ in range(6))
    if len(grams) < width:
        return none
    # 40 bits of the hash, then the place: the least has the leftmost place among equal ones.
    packed = (grams >> np.uint64(24) << np.uint64(24)) | np.arange(len(grams), dtype=np.uint64)
    at = (sliding_least(packed, width) & np.uint64((1 << 24) - 1)).astype(np.int64)
    starts = np.arange(len(at))
    sizes = np.diff(offsets)
    full = np.flatnonzero(sizes >= length)
    inside = np.zeros(len(at) + 1, np.int64)
    np.add.at(inside, offsets[:-1][full], 1)
    np.add.at(inside, offsets[1:][full] - length + 1, -1)
    inside = np.cumsum(inside)[:-1] > 0
    fresh = np.ones(len(at), bool)
    fresh[1:] = (at[1:] != at[:-1]) | ~inside[:-1]
    fresh[offsets[:-1][full]] = True
    fresh &= inside
    first = starts[fresh]
    ends = np.ones(len(at), bool)
    ends[:-1] = fresh[1:] | ~inside[1:]
    last = starts[ends & inside]
    anchor = at[first]
    text = np.searchsorted(offsets, first, "right") - 1
    base = offsets[text]
    content = content_hashes(data, sums, first, last + length)
    return text, first - base, last - base, anchor - base, grams[anchor].view(np.int64), content.view(np.int64)


def _cut(df: DataFrame, length: int, gram: int) -> DataFrame:
    """Segments of (_row, _text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column(0).to_numpy()
            data, offsets = arrow_bytes(batch.column(1))
            at = 0
            while at < len(rows):
                end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + CHUNK, "right")) - 1)
                own = offsets[at : end + 1] - offsets[at]
                # Places have 24 bits; a longer text goes in parts that share no window.
                for low in range(0, max(1, int(own[-1])), (1 << 24) - length):
                    high = min(int(own[-1]), low + (1 << 24) - 1)
                    part = own if end - at > 1 else np.array([0, high - low])
                    text, first, last, anchor, key, content = segments(data[offsets[at] + low : offsets[at] + high], part, length, gram)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(x) for x in (rows[at + text], first + low, (last - first).astype(np.int32), anchor + low, key, content)],
                        names=["_row", "first", "more", "anchor", "key", "content"],
                    )
                    if high == int(own[-1]):
                        break
                at = end
        memory_returned()

    return df.select("_row", "_text").mapInArrow(run, "_row long, first long, more int, anchor long, key long, content long")


def _pieces(wanted: DataFrame, texts: DataFrame, length: int, gram: int) -> DataFrame:
    """Segments with their bytes; ``offset`` is the first window's distance from the anchor, low and high the offsets that the key stands for."""
    lists = wanted.groupBy("_row").agg(F.collect_list(F.struct("first", "more", "anchor", "key")).alias("own"))
    schema = pa.schema([("_row", pa.int64()), ("first", pa.int64()), ("key", pa.int64()), ("offset", pa.int64()), ("span", pa.int64()), ("bytes", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, starts = arrow_bytes(batch["_text"])
            whole, counts = data.tobytes(), pc.list_value_length(batch["own"]).to_numpy()
            first, more, anchor, key = (x.to_numpy() for x in batch["own"].flatten().flatten())
            rows, low, sizes = np.repeat(batch["_row"].to_numpy(), counts), np.repeat(starts[:-1], counts) + first, more.astype(np.int64) + length
            high = low + sizes
            found = [rows, first, key, first - anchor, more.astype(np.int64) + 1]
            # Segments overlap, so that a batch of texts is several of them.
            edges = np.flatnonzero(np.diff(np.cumsum(sizes) // OUT)) + 1
            for a, b in zip([0, *edges.tolist()], [*edges.tolist(), len(rows)], strict=True):
                raw = [whole[i:j] for i, j in zip(low[a:b].tolist(), high[a:b].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([*(pa.array(x[a:b]) for x in found), pa.array(raw, pa.binary())], schema=schema)

    joined = lists.join(texts.select("_row", "_text"), "_row").select("_row", "own", "_text")
    found = joined.mapInArrow(run, "_row long, first long, key long, offset long, span long, bytes binary")
    return found.withColumn("low", F.lit(gram - length).cast("long")).withColumn("high", F.lit(0).cast("long"))


PIECE = ["_row", "first", "key", "offset", "span", "bytes", "low", "high"]


def _halved(pieces: DataFrame, length: int) -> DataFrame:
    """Each piece's windows at offsets low..high in two halves, keyed by the bytes that all windows of the half share."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for row, first, key, offset, span, raw, low, high in batch.itertuples(index=False, name=None):
                middle = (low + high) // 2
                for a, b in ((low, middle), (middle + 1, high)):
                    begin, end = max(a, offset), min(b, offset + span - 1)
                    if begin <= end:
                        digest = sha256(b"%d %d %d " % (key, a, b) + raw[b - offset : a - offset + length]).digest()
                        own = raw[begin - offset : end - offset + length]
                        out.append((row, first + begin - offset, int.from_bytes(digest[:8], "little", signed=True), begin, end - begin + 1, own, a, b))
            yield pd.DataFrame(out, columns=PIECE)
        memory_returned()

    return pieces.select(*PIECE).mapInPandas(run, "_row long, first long, key long, offset long, span long, bytes binary, low long, high long")


def may_repeat(offsets: np.ndarray, spans: np.ndarray, raw: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(piece, first, span): runs of the pieces' windows, from the piece's start, without those that surely stand once.

    Windows are dealt by their offset into strips of neighbours. All windows of
    a strip share ``length`` less a strip's width, plus one, of bytes at one
    distance from the anchor, so what repeats repeats those bytes too: where
    their hash is single among the pieces, the strip has nothing to sort.
    """
    width = max(1, length // STRIPS)
    own, last = offsets // width, (offsets + spans - 1) // width
    counts = last - own + 1
    piece = np.repeat(np.arange(len(raw)), counts)
    strip = np.arange(len(piece)) - np.repeat(np.cumsum(counts) - counts, counts) + own[piece]
    sizes = np.fromiter(map(len, raw), np.int64, len(raw))
    base = (np.cumsum(sizes) - sizes - offsets)[piece]  # the anchors' places
    shared = stretch_hashes(prefix_sums(np.frombuffer(b"".join(raw), np.uint8)), base + (strip + 1) * width - 1, base + strip * width + length)
    _, kind, often = np.unique(shared, return_inverse=True, return_counts=True)
    met = often[kind] > 1
    low = np.maximum(strip * width - offsets[piece], 0)[met]
    high = np.minimum((strip + 1) * width - offsets[piece], spans[piece])[met]
    piece = piece[met]
    fresh = np.ones(len(piece), bool)
    fresh[1:] = (piece[1:] != piece[:-1]) | (low[1:] != high[:-1])
    ends = np.ones(len(piece), bool)
    ends[:-1] = fresh[1:]
    return piece[fresh], low[fresh], high[ends] - low[fresh]


def _sorted_repeats(pieces: DataFrame, length: int) -> DataFrame:
    """(_row, low, high): runs of window starts of each piece that repeat in another place of its shard."""

    def shard(held: list[tuple]) -> pa.RecordBatch:
        found = repeated_starts([x[3] for x in held], length)
        rows, lows, highs, at = [], [], [], 0
        for row, first, span, raw in held:
            own = np.concatenate([[False], found[at : at + span], [False]])
            edges = np.flatnonzero(own[1:] != own[:-1])
            rows += [row] * (len(edges) // 2)
            lows += (first + edges[::2]).tolist()
            highs += (first + edges[1::2] - 1).tolist()
            at += len(raw)
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (rows, lows, highs)], names=["_row", "low", "high"])

    def sieved(taken: list[tuple]) -> list[tuple]:
        rows, firsts, offsets, spans, raw = zip(*taken, strict=True)
        found = may_repeat(np.array(offsets), np.array(spans), list(raw), length)
        return [(rows[i], firsts[i] + low, span, raw[i][low : low + span - 1 + length]) for i, low, span in zip(*(x.tolist() for x in found), strict=True)]

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
        """Pieces of whole keys."""
        taken, room, before = [], 0, None
        for batch in batches:
            for key, *x in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
                if room >= SHARD and key != before:
                    yield taken
                    taken, room = [], 0
                taken.append(tuple(x))
                room += len(x[4])
                before = key
        if taken:
            yield taken

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, room = [], 0
        for taken in chunks(batches):
            own = sieved(taken)
            more = sum(len(x[3]) for x in own)
            if held and room + more > SHARD:
                yield shard(held)
                held, room = [], 0
            held += own
            room += more
        if held:
            yield shard(held)
        held.clear()
        memory_returned()

    n = int(pieces.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = pieces.select("key", "_row", "first", "offset", "span", "bytes").repartition(n, "key").sortWithinPartitions("key")
    return dealt.mapInArrow(run, "_row long, low long, high long")


def repeated_windows(texts: DataFrame, scratch: Scratch, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(_row, low, high): runs of window starts in (_row, _text) whose ``length`` bytes also start elsewhere."""
    cut = scratch.keep(_cut(texts, length, gram), "segments")
    # Keys are a table of their own: a join right above an aggregation can't be split where a key is hot.
    often = scratch.keep(cut.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key"), "often")
    # Members and their contents of keys that occur twice; the hot side of the join can be split.
    level = scratch.keep(cut.join(often, "key").select("_row", "first", "more", "anchor", "key", "content"), "candidates")
    scratch.drop(cut, often)
    found, pools, bare = [], [], True
    while True:
        counted = scratch.keep(
            level.groupBy("key", "content").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("_row", "first")).alias("one")), "counted"
        )
        more = F.col("more") if bare else F.col("span") - 1
        twice = counted.where("n > 1").select("key", "content")
        found.append(level.join(twice, ["key", "content"]).select("_row", F.col("first").alias("low"), (F.col("first") + more).alias("high")))
        groups = counted.groupBy("key").agg(F.count(F.lit(1)).alias("d"), F.min("n").alias("least")).where("d > 1 AND least = 1").select("key", "d")
        groups = scratch.keep(groups, "groups")
        ones = counted.select("key", "content", F.col("one._row").alias("_row"), F.col("one.first").alias("first")).join(groups, "key")
        met = level.join(ones.drop("content"), ["key", "_row", "first"])
        if bare:
            sizes = scratch.keep(met.select("key", "_row", "first", "d"), "sizes")
            pieces = _pieces(met, texts, length, gram).join(sizes, ["key", "_row", "first"]).select(*PIECE, "d")
        else:
            pieces = met.select(*PIECE, "d")
        pieces = scratch.keep(pieces, "pieces")
        pools.append(pieces.where(F.col("d") <= MOST_SEGMENTS).select(*PIECE))
        hot = pieces.where((F.col("d") > MOST_SEGMENTS) & (F.col("low") < F.col("high")))
        if hot.isEmpty():
            break
        level = scratch.keep(_halved(hot, length).withColumn("content", F.xxhash64("bytes")), "halves")
        bare = False
    pool = pools[0]
    for other in pools[1:]:
        pool = pool.unionByName(other)
    runs = scratch.keep(_sorted_repeats(pool, length), "sorted")
    for other in found:
        runs = runs.unionByName(other)
    return runs


def _spans(lows: np.ndarray, highs: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of bytes under the windows that start at low..high: starts and ends."""
    order = np.argsort(lows, kind="stable")
    lows, ends = lows[order], np.maximum.accumulate(highs[order] + length)
    fresh = np.ones(len(lows), bool)
    fresh[1:] = lows[1:] > ends[:-1]
    return lows[fresh], np.append(ends[:-1][fresh[1:]], ends[-1:])


def remove_repeats(df: DataFrame, text: str, keep: list[str], length: int = LENGTH) -> DataFrame:
    """Columns ``keep`` with ``n_bytes``, ``spans`` (starts and ends of what is removed) and ``kept`` (the bytes left).

    Each byte goes that is under a string of ``length`` bytes which also starts
    at another place of the corpus, the same text included; strings are judged
    on the input. Null texts are empty. Rows that repeat are texts of their
    own, so copies of ``length`` bytes or more go altogether. Strings never
    cross texts. An empty table gives no rows. A column of ``keep`` with an added
    name comes out with ``_in`` at its end.
    """
    spark = df.sparkSession
    bounded_batches(spark)
    scratch = Scratch(spark, "repeats")
    names = [f"k{i}" for i in range(len(keep))]
    source = df.select(*[F.col(c).alias(n) for c, n in zip(keep, names, strict=True)], F.coalesce(F.col(text), F.lit("")).alias("_text"))
    texts = scratch.keep(source.withColumn("_row", F.monotonically_increasing_id()), "texts")
    runs = repeated_windows(texts, scratch, length)
    lists = scratch.keep(runs.groupBy("_row").agg(F.collect_list("low").alias("_low"), F.collect_list("high").alias("_high")), "runs")
    scratch.free(texts, lists)
    joined = texts.join(lists.hint("merge"), "_row", "left").select(*names, "_text", "_low", "_high")
    schema = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in joined.schema.fields[: len(names)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(i) for i in range(len(names) + 3)]
            sizes, spans, kept = [], [], []
            for value, low, high in zip(*columns[len(names) :], strict=True):
                raw = value.as_py().encode()
                own: list[dict[str, int]] = []
                sizes.append(len(raw))
                if low.is_valid:
                    starts, ends = _spans(low.values.to_numpy(), high.values.to_numpy(), length)
                    own = [{"start": int(a), "end": int(b)} for a, b in zip(starts, ends, strict=True)]
                    edges = [0, *(x for s in own for x in (s["start"], s["end"])), len(raw)]
                    raw = b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
                spans.append(own)
                kept.append(raw)
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays(
                [*columns[: len(names)], pa.array(sizes, pa.int64()), pa.array(spans, kind), pa.array(kept, pa.binary())],
                names=[*names, "n_bytes", "spans", "kept"],
            )
        memory_returned()

    out = joined.mapInArrow(run, f"{schema}n_bytes long, spans array<struct<start:bigint,end:bigint>>, kept binary")
    apart = set_apart(keep, ["n_bytes", "spans", "kept"])
    return out.select(*[F.col(n).alias(c) for n, c in zip(names, apart, strict=True)], "n_bytes", "spans", "kept")
