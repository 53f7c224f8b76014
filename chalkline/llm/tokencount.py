"""Token counts of whole texts, huge ones from overlapping chunks that are spliced where their encodings agree.

A text of at most ``chunk`` symbols is encoded as it is. A longer one is cut into
chunks that reach ``overlap`` symbols into the next, which tasks encode apart.
Two neighbours are spliced at a token that both have at the same place.

Why that is exact: a BPE encoding is right if and only if every two neighbouring
tokens are the encoding of their own text, as no merge depends on what lies
beyond a place that no merge crosses. Left of the common token all neighbours
come from the left chunk's encoding, right of it from the right one's, and the
token itself stands in both. What a chunk's cut end does to the tokens near it
therefore doesn't matter.

Where an overlap holds no common token it is widened: the chunks on either side
become one unit, which a task encodes again from left to right, a chunk at a
time, each window beginning at a token of the one before, and further back
as long as both have no token in common. Units double until all seams hold.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chalkline.llm.scratch import Scratch, bounded_batches, memory_returned, set_apart

#: Symbols of a text that one call encodes, and symbols that a chunk reaches into the next.
CHUNK, OVERLAP = 1 << 15, 256

CUTS = "row long, part int, text string"
UNITS = "row long, first int, last int, n long, head array<long>, head_at array<int>, tail array<long>, tail_at array<int>"


class Pieces:
    """A sentencepiece BPE model that can encode from the middle of a text."""

    @staticmethod
    @cache
    def of(path: str) -> Pieces:
        """One for all calls in a worker."""
        return Pieces(path)

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.model = model = SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        plain = [not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i)) for i in range(size)]
        names = [model.id_to_piece(i) for i in range(size)]
        used = set(chain.from_iterable(name for name, own in zip(names, plain, strict=True) if own))
        # A symbol that no piece has takes part in no merge, and keeps the mark that the model puts before a text away from it.
        self.stop = next(c for c in map(chr, (10, *range(1, 32), 0xFFFE)) if c not in used)
        self.stop_ids = len(model.encode(self.stop))
        # Symbols that a token stands for; of the bytes of one symbol only the first counts.
        self.width = np.array([len(name) if own else self._byte(name) if model.is_byte(i) else 1 for i, (name, own) in enumerate(zip(names, plain, strict=True))], np.int64)
        self.plain = np.array(plain)
        probe = " \ufb01  \u212b "  # a ligature and a sign that compatibility forms replace, and blanks
        if model.normalize(probe).replace("▁", " ") != " " + probe or not any(map(model.is_byte, range(size))):
            raise ValueError("only a model that leaves texts as they are, and has bytes for unknown symbols, can be cut by symbols")

    @staticmethod
    def _byte(name: str) -> int:
        return 0 if 0x80 <= int(name[1:-1], 16) < 0xC0 else 1

    def encode(self, text: str, at_start: bool) -> np.ndarray:
        """Ids of a text, or of one that stands within another, whose first symbol then has no mark before it."""
        if at_start:
            return np.array(self.model.encode(text), np.int64)
        return np.array(self.model.encode(self.stop + text), np.int64)[self.stop_ids :]

    def tokens(self, text: str, at: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the text that begins at symbol ``at`` of its document, and where each token begins."""
        ids = self.encode(text, at == 0)
        width = self.width[ids]
        ends = at + np.cumsum(width)
        if len(ids) and ends[-1] != at + len(text) + (at == 0):
            raise ValueError("tokens don't cover the text")
        starts = ends - width
        if at == 0 and len(ids):  # the mark before the text stands for no symbol of it
            starts = np.maximum(starts - 1, 0)
        return ids, starts

    def keys(self, ids: np.ndarray, starts: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
        """Tokens that begin in [low, high) as one number each, and their places; bytes are no witnesses."""
        places = np.flatnonzero(self.plain[ids] & (starts >= max(low, 1)) & (starts < high))
        return starts[places] * len(self.width) + ids[places], places

    def common(self, left: tuple[np.ndarray, np.ndarray], right: tuple[np.ndarray, np.ndarray], low: int, high: int) -> tuple[int, int] | None:
        """Places in both encodings of the first token in [low, high) that they share."""
        (a, a_at), (b, b_at) = self.keys(*left, low, high), self.keys(*right, low, high)
        _, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
        return (int(a_at[i[0]]), int(b_at[j[0]])) if len(i) else None


class _Unit:
    """Chunks ``first`` and on of one text, encoded from left to right; holds the last window's tokens and the text."""

    def __init__(self, codec: Pieces, row: int, first: int, text: str, chunk: int, overlap: int):
        self.codec, self.row, self.first, self.last, self.chunk, self.overlap = codec, row, first, first, chunk, overlap
        self.begin = first * chunk
        self.texts = [text]
        self._from_begin()

    def _from_begin(self) -> None:
        self.text, self.start = "".join(self.texts), self.begin
        self.ids, self.starts = self.codec.tokens(self.text, self.begin)
        self.n = 0  # tokens before those held
        self.head: list[np.ndarray] = []
        self.head_at: list[np.ndarray] = []

    def _told(self, upto: int) -> None:
        """Notes the head's part in the first ``upto`` tokens held."""
        keys, places = self.codec.keys(self.ids[:upto], self.starts[:upto], self.begin, self.begin + self.overlap)
        self.head.append(keys)
        self.head_at.append(places + self.n)

    def add(self, text: str) -> None:
        """The next chunk, which begins ``overlap`` symbols before the end of what is held, or less at the end of a text."""
        self.last += 1
        end, reach = self.start + len(self.text), self.overlap
        more = text[end - self.last * self.chunk :]
        self.texts.append(more)
        while True:
            at = int(np.searchsorted(self.starts, end - reach, "right")) - 1
            if at <= 0:  # the held tokens share none with any window: all of the unit is encoded again
                return self._from_begin()
            low = int(self.starts[at])
            window = self.text[low - self.start :] + more
            new = self.codec.tokens(window, low)
            if found := self.codec.common((self.ids, self.starts), new, low, end):
                left, right = found
                self._told(left)
                self.n += left
                self.ids, self.starts = new[0][right:], new[1][right:]
                self.start = int(self.starts[0])
                self.text = window[self.start - low :]
                return None
            reach *= 2

    def row_of(self) -> tuple:
        self._told(len(self.ids))
        end = (self.last + 1) * self.chunk
        tail, places = self.codec.keys(self.ids, self.starts, end, end + self.overlap)
        return (self.row, self.first, self.last, self.n + len(self.ids), np.concatenate(self.head), np.concatenate(self.head_at), tail, places + self.n)


def _batch(units: list[tuple]) -> pa.RecordBatch:
    longs, ints = pa.list_(pa.int64()), pa.list_(pa.int32())
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), longs, ints, longs, ints]
    names = ["row", "first", "last", "n", "head", "head_at", "tail", "tail_at"]
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*units, strict=True), kinds, strict=True)], names=names)


def count_tokens(df: DataFrame, text: str, model: str, keep: list[str], chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """Columns ``keep`` of df with ``n_tokens``, the tokens of the whole text without any that are added.

    ``model`` is the file of a sentencepiece BPE model whose normaliser leaves
    texts as they are. A null text counts as an empty one, which has no tokens;
    strings of special tokens in a text are ordinary text. Rows that repeat are
    counted each; an empty table gives none. A kept column named ``n_tokens``
    comes out as ``n_tokens_in``. Texts over ``chunk`` symbols go through several
    tasks; only where overlaps have no token in common does one task read a
    stretch of chunks, in order.
    """
    if not 0 < overlap <= chunk:
        raise ValueError("an overlap is shorter than a chunk")
    spark = df.sparkSession
    bounded_batches(spark)
    apart = set_apart(keep, ["n_tokens"])
    kept = [F.col(c).alias(n) for c, n in zip(keep, apart, strict=True)]
    sent = df.select(*kept, F.coalesce(F.col(text), F.lit("")).alias("_sent"))
    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in sent.schema.fields[:-1]) + "n_tokens long"

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Pieces.of(model)
        for batch in batches:
            ids = codec.model.encode(batch.column(len(apart)).to_pylist(), num_threads=1)
            counts = pa.array([len(x) for x in ids], pa.int64())
            del ids
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(apart)], counts], names=[*apart, "n_tokens"])
        memory_returned()

    long = F.char_length("_sent") > chunk
    if sent.where(long).isEmpty():
        return sent.mapInArrow(whole, schema)
    scratch = Scratch(spark, "counts")
    rows = scratch.keep(sent.where(long).withColumn("_row", F.monotonically_increasing_id()), "rows")
    counts = _counts_of_long(rows.select(F.col("_row").alias("row"), F.col("_sent").alias("text")), scratch, model, chunk, overlap)
    huge = rows.join(counts, rows["_row"] == counts["row"]).select(*apart, "n_tokens")
    return sent.where(~long).mapInArrow(whole, schema).unionByName(huge)


def _counts_of_long(texts: DataFrame, scratch: Scratch, model: str, chunk: int, overlap: int) -> DataFrame:
    """(row, n_tokens) of long texts, by chunks."""
    spark = texts.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, text in zip(batch.column(0), batch.column(1), strict=True):
                whole = text.as_py()
                parts = [whole[at : at + chunk + overlap] for at in range(0, len(whole), chunk)]
                numbers = pa.array(range(len(parts)), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array([row.as_py()] * len(parts), pa.int64()), numbers, pa.array(parts, pa.string())], names=["row", "part", "text"])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Pieces.of(model)
        for batch in batches:
            parts = zip(*(c.to_pylist() for c in batch.columns), strict=True)
            if units := [_Unit(codec, row, part, text, chunk, overlap).row_of() for row, part, text in parts]:
                yield _batch(units)
        memory_returned()

    def encode_on(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Chunks (row, first, part, text) in order: those of one (row, first) are a unit."""
        codec, unit = Pieces.of(model), None
        for row, first, part, text in (x for batch in batches for x in zip(*(c.to_pylist() for c in batch.columns), strict=True)):
            if unit is not None and (unit.row, unit.first) != (row, first):
                yield _batch([unit.row_of()])
                unit = None
            if unit is None:
                unit = _Unit(codec, row, part, text, chunk, overlap)
            else:
                unit.add(text)
        if unit is not None:
            yield _batch([unit.row_of()])
        memory_returned()

    cuts = scratch.keep(texts.mapInArrow(cut, CUTS).repartition(n, "row", "part"), "cuts")
    units = scratch.keep(cuts.mapInArrow(encode, UNITS), "units")
    while True:
        right = units.select("row", (F.col("first") - 1).alias("last"), F.col("last").alias("end"), "head", "head_at")
        meet = F.array_intersect("tail", "head")
        seams = units.drop("head", "head_at").join(right, ["row", "last"]).withColumn("key", F.get(meet, F.lit(0)))
        place = lambda keys, at: F.element_at(at, F.array_position(keys, F.col("key")).cast("int"))
        # Left of the seam the tokens after the common one are not counted, right of it those through it.
        over = (F.col("n") - 1 - place("tail", "tail_at")) + 1 + place("head", "head_at")
        seams = scratch.keep(seams.select("row", "first", "last", "end", over.cast("long").alias("over")), "seams")
        open_ = seams.where("over IS NULL")
        if open_.isEmpty():
            break
        units = _widened(units, cuts, open_, scratch, encode_on, n)
    total = units.select("row", "n").unionByName(seams.select("row", (-F.col("over")).alias("n")))
    return total.groupBy("row").agg(F.sum("n").alias("n_tokens"))


def _widened(units: DataFrame, cuts: DataFrame, open_: DataFrame, scratch: Scratch, encode_on, n: int) -> DataFrame:
    """Units with those beside an open seam made one, which reaches as far again as it is long to the right."""
    marked = units.select("row", "first", "last").join(open_.select("row", "first", (2 * F.col("end") - F.col("first")).alias("upto")), ["row", "first"], "left")
    by = W.partitionBy("row").orderBy("first")
    reach = F.max("upto").over(by.rowsBetween(W.unboundedPreceding, 0))
    before = F.max("upto").over(by.rowsBetween(W.unboundedPreceding, -1))
    marked = marked.withColumns({"_reach": reach, "_before": before}).where("_reach >= first")
    opens = F.when(F.col("_before") >= F.col("first"), 0).otherwise(1)
    touched = scratch.keep(marked.withColumn("_run", F.sum(opens).over(by.rowsBetween(W.unboundedPreceding, 0))), "touched")
    runs = touched.groupBy("row", "_run").agg(F.min("first").alias("first"), F.max("last").alias("upto"))
    parts = runs.select("row", "first", F.explode(F.sequence("first", "upto")).alias("part"))
    ordered = cuts.join(parts, ["row", "part"]).select("row", "first", "part", "text").repartition(n, "row", "first").sortWithinPartitions("row", "first", "part")
    again = ordered.mapInArrow(encode_on, UNITS)
    return scratch.keep(units.join(touched.select("row", "first"), ["row", "first"], "left_anti").unionByName(again), "units")
