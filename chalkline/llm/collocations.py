"""Phrases whose words stand together more often than chance has it.

Texts are cut into pieces, and equal pieces become one with a multiplicity, so a
passage that many documents share is read once. Tasks count the n-grams of their
pieces on arrays of word numbers; what they counted goes by a hash of the
n-gram to buckets, where DuckDB adds it up out-of-core. Only pairs that reach
the least count can be part of a longer phrase that does, so n-grams of three
words and more are counted only where a filter of those pairs lets them through.

A phrase needs the counts of its parts, which lie in other buckets: it sends a
lookup request for each part, requests and counts are shuffled to each other,
and the answers go back to the phrase.
"""

from __future__ import annotations

import shutil
import tempfile
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chalkline.llm.scratch import Scratch, bounded_batches, memory_returned

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What ends a piece.
ENDS = r"[.,;:!?\x0A-\x0D]"
#: Bytes of pieces that a task counts at once, and what DuckDB may hold in a task before it goes on on disk.
GATHERED, HELD = 16 << 20, "192MB"
#: The filter of frequent pairs has this many bits for each, and so many at most (32 MB), however many pairs there are.
BITS_EACH, MOST_BITS = 16, 1 << 28
#: Parts that the ranking of one language is cut into.
RANKED_APART = 64

#: 1000 * f * n / (l * r), floored, in 37 digits.
SCORE = "(cast(1000 * f AS decimal(18,0)) * cast(n AS decimal(18,0))) div (cast(l AS decimal(18,0)) * cast(r AS decimal(18,0)))"

GRAMS = "lang string, gram string, words int, f long"


def pieces_of(df: DataFrame, text: str, lang: str) -> DataFrame:
    """(lang, piece, m): the pieces of all texts with how often each stands, their words set apart by one space."""
    plain = F.translate(F.col(text), UPPER + "\t", LOWER + " ")
    cut = df.select(F.coalesce(F.col(lang), F.lit("und")).alias("lang"), F.explode(F.split(plain, ENDS)).alias("piece"))
    joined = F.when(F.col("piece").contains("  "), F.regexp_replace("piece", "  +", " ")).otherwise(F.col("piece"))
    return cut.select("lang", F.trim(joined).alias("piece")).where("piece <> ''").groupBy("lang", "piece").agg(F.count("*").alias("m"))


def _spread(values: np.ndarray) -> np.ndarray:
    """Mixes the bits of unsigned 64-bit numbers."""
    values = (values ^ (values >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return values ^ (values >> np.uint64(29))


def _hashes(words: pa.Array) -> np.ndarray:
    raw = [w.encode() for w in words.to_pylist()]
    return _spread(np.array([zlib.crc32(w) << 32 | zlib.adler32(w) for w in raw], np.uint64))


def _pair_hashes(lang: np.ndarray, first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return _spread(_spread(_spread(lang) + first) + second)


class _Words:
    """The words of a batch of pieces as numbers; a number stands for a word of one language."""

    def __init__(self, langs: pa.Array, pieces: pa.Array, m: np.ndarray):
        lists = pc.split_pattern(pieces, " ")
        sizes = np.diff(lists.offsets.to_numpy())
        words, lang = lists.flatten().dictionary_encode(), langs.dictionary_encode()
        lang_of = np.repeat(lang.indices.to_numpy().astype(np.int64), sizes)
        own, self.first, self.id = np.unique(lang_of * len(words.dictionary) + words.indices.to_numpy(), return_index=True, return_inverse=True)
        self.m = np.repeat(m, sizes)
        self.left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(self.id))  # words from here to the piece's end
        self.word, self.lang = words.dictionary.take(pa.array(own % len(words.dictionary))), lang.dictionary.take(pa.array(own // len(words.dictionary)))

    def counted(self, at: np.ndarray, key: np.ndarray, n: int) -> tuple[np.ndarray, pa.RecordBatch | None]:
        """Numbers for the n-grams that begin at the places ``at``, which are equal where ``key`` is, and their counts."""
        own, place, number = np.unique(key, return_index=True, return_inverse=True)
        if not len(own):
            return number, None
        f = np.zeros(len(own), np.int64)
        np.add.at(f, number, self.m[at])
        begin = at[place]
        parts = [self.word.take(pa.array(self.id[begin + k])) for k in range(n)]
        gram = parts[0] if n == 1 else pc.binary_join_element_wise(*parts, " ")
        lang = self.lang.take(pa.array(self.id[begin]))
        return number, pa.RecordBatch.from_arrays([lang, gram, pa.array(np.full(len(own), n, np.int32)), pa.array(f)], names=["lang", "gram", "words", "f"])

    def short(self) -> Iterator[pa.RecordBatch | None]:
        """Words and pairs."""
        places = np.arange(len(self.id))
        yield self.counted(places, self.id, 1)[1]
        at = places[self.left >= 2]
        yield self.counted(at, self.id[at] * len(self.word) + self.id[at + 1], 2)[1]

    def long(self, frequent: np.ndarray, longest: int) -> Iterator[pa.RecordBatch | None]:
        """Phrases of three words and more all of whose pairs the filter lets through."""
        at = np.flatnonzero(self.left >= 2)
        word, lang = _hashes(self.word), _hashes(self.lang)
        bits = _pair_hashes(lang[self.id[at]], word[self.id[at]], word[self.id[at + 1]]) & np.uint64(8 * len(frequent) - 1)
        passes = np.zeros(len(self.id), bool)
        passes[at] = (frequent[bits >> np.uint64(3)] >> (bits & np.uint64(7)).astype(np.uint8)) & 1
        at = np.flatnonzero(passes)
        _, number = np.unique(self.id[at] * len(self.word) + self.id[at + 1], return_inverse=True)
        for n in range(3, longest + 1):
            on = (self.left[at] >= n) & passes[np.minimum(at + n - 2, len(passes) - 1)]
            at, number = at[on], number[on]
            number, batch = self.counted(at, number * len(self.word) + self.id[at + n - 1], n)
            yield batch


def _gathered(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.Table]:
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size > most:
            yield pa.Table.from_batches(held)
            held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


def _counts(pieces: DataFrame, what, gathered: int) -> DataFrame:
    """GRAMS as tasks counted them, by ``what`` of _Words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _gathered(batches, gathered):
            langs, texts, m = (table.column(c).combine_chunks() for c in range(3))
            words = _Words(langs, texts, m.to_numpy())
            for batch in what(words):
                if batch is not None:
                    yield from (batch.slice(at, 1 << 16) for at in range(0, len(batch), 1 << 16))
            del words
        memory_returned()

    return pieces.select("lang", "piece", "m").mapInArrow(run, GRAMS)


def _added_up(counted: DataFrame, least: int) -> DataFrame:
    """The n-grams that stand at least so often, added up by DuckDB in buckets by hash."""
    n = int(counted.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb

        if (first := next(batches, None)) is None:
            return

        def all_() -> Iterator[pa.RecordBatch]:
            yield first
            yield from batches

        folder = tempfile.mkdtemp(prefix="bucket-")  # of this task alone, and gone with it
        try:
            with duckdb.connect(config={"threads": 1, "memory_limit": HELD, "temp_directory": folder, "preserve_insertion_order": False}) as con:
                con.register("counted", pa.RecordBatchReader.from_batches(first.schema, all_()))
                sums = f"SELECT lang, gram, words, CAST(sum(f) AS BIGINT) AS f FROM counted GROUP BY lang, gram, words HAVING sum(f) >= {least}"
                yield from con.sql(sums).to_arrow_reader(1 << 14)
        finally:
            shutil.rmtree(folder, ignore_errors=True)
        memory_returned()

    return counted.repartition(n, "lang", "gram").mapInArrow(run, GRAMS)


def _filter_of(pairs: DataFrame, n_pairs: int) -> bytes:
    """A bit for the hash of each pair; the rest of what it lets through only costs work."""
    bits = min(max(1 << 16, 1 << (BITS_EACH * n_pairs - 1).bit_length()), MOST_BITS)
    block = 1 << 16

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = pc.split_pattern(batch.column(1), " ").flatten()
            at = np.arange(len(batch)) * 2
            first, second = (_hashes(parts.take(pa.array(at + k))) for k in (0, 1))
            bit = (_pair_hashes(_hashes(batch.column(0)), first, second) & np.uint64(bits - 1)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(bit // block), pa.array(bit % block)], names=["block", "bit"])

    def made(table: pa.Table) -> pa.Table:
        held = np.zeros(block, np.uint8)
        held[table.column("bit").to_numpy()] = 1
        one = pa.array([np.packbits(held, bitorder="little").tobytes()], pa.binary())
        return pa.table([table.column("block").slice(0, 1).combine_chunks(), one], names=["block", "held"])

    set_ = pairs.select("lang", "gram").mapInArrow(hashed, "block long, bit long").distinct()
    out = bytearray(bits // 8)
    for row in set_.groupBy("block").applyInArrow(made, "block long, held binary").toLocalIterator():  # bits / 8 bytes in all
        out[row["block"] * block // 8 : (row["block"] + 1) * block // 8] = row["held"]
    return bytes(out)


def _words(at: int | Column, n: int | Column) -> Column:
    """``n`` words of the column gram from word ``at`` on."""
    return F.array_join(F.slice("_w", at, n), " ")


def collocations(df: DataFrame, text: str, lang: str, least: int = 100, longest: int = 5, top: int = 2000, covered: int = 100, gathered: int = GATHERED) -> DataFrame:
    """The ``top`` phrases of two to ``longest`` words of each language: (lang, rank, phrase, a, l, r, n, score).

    Texts, lower-cased from A to Z, are cut by ENDS into pieces and those by
    spaces and tabs into words; a null text has none, a null language is ``und``.
    ``a`` says how often the phrase stands within pieces, places that overlap and
    rows that repeat counting each; n is the words of the language. A phrase is
    cut after its first k words, l and r being the counts of both parts, where
    the score floor(1000 * a * n / (l * r)) is lowest, of equal ones at the
    smallest k. Phrases with a under ``least`` are none, and one goes if a longer
    one that has its words side by side stands ``covered`` percent as often or
    more. Ranks go by score and a, both falling, and the phrase's bytes. An empty
    table gives no phrase; other columns of df are not read. Tasks count
    ``gathered`` bytes of pieces at once. Sums are 64-bit,
    products 37 digits.
    """
    if not 0 < covered <= 100 or least < 1 or longest < 2:
        raise ValueError("covered is a percentage, least a count, longest two words or more")
    spark = df.sparkSession
    bounded_batches(spark)
    scratch = Scratch(spark, "phrases")
    pieces = scratch.keep(pieces_of(df, text, lang), "pieces")
    spaces = F.char_length("piece") - F.char_length(F.replace("piece", F.lit(" "), F.lit("")))
    n = scratch.keep(pieces.groupBy("lang").agg(F.sum(F.col("m") * (spaces + 1)).cast("long").alias("n")), "n")

    short = scratch.keep(_added_up(_counts(pieces, _Words.short, gathered), least), "short")
    found = short
    if longest > 2:
        pairs = short.where("words = 2")
        sent = spark.sparkContext.broadcast(_filter_of(pairs, max(pairs.count(), 1)))
        long = lambda words: words.long(np.frombuffer(sent.value, np.uint8), longest)
        found = short.unionByName(scratch.keep(_added_up(_counts(pieces, long, gathered), least), "long"))
    phrases = found.where("words > 1").withColumn("_w", F.split("gram", " "))

    # One word less on either side: if any longer phrase covers this one, one that is a word longer does.
    ends = F.array(_words(1, F.col("words") - 1), _words(2, F.col("words") - 1))
    longer = phrases.where("words > 2").select("lang", F.explode(ends).alias("gram"), "f").groupBy("lang", "gram").agg(F.max("f").alias("over"))
    kept = phrases.drop("_w").join(longer, ["lang", "gram"], "left").where(f"over IS NULL OR 100 * over < {covered} * f").drop("over")
    kept = scratch.keep(kept, "kept")

    cut = kept.withColumn("_w", F.split("gram", " ")).withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1)))
    sides = F.array(F.struct(F.lit("l").alias("side"), _words(1, F.col("k")).alias("part")), F.struct(F.lit("r").alias("side"), _words(F.col("k") + 1, F.col("words") - F.col("k")).alias("part")))
    requests = cut.select("lang", "gram", "f", "k", F.explode(sides).alias("_s")).select("lang", "gram", "f", "k", "_s.*")
    answers = requests.join(found.select("lang", F.col("gram").alias("part"), F.col("f").alias("has")).hint("shuffle_merge"), ["lang", "part"])
    cuts = answers.groupBy("lang", "gram", "f", "k").agg(*[F.max(F.when(F.col("side") == s, F.col("has"))).alias(s) for s in "lr"])
    scored = cuts.join(n, "lang").withColumn("score", F.expr(SCORE))
    best = scored.groupBy("lang", "gram", F.col("f").alias("a"), "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("_b"))
    best = best.select("lang", F.col("gram").alias("phrase"), "a", "_b.l", "_b.r", "n", "_b.score")
    return _ranked(best, top)


def _ranked(best: DataFrame, top: int) -> DataFrame:
    """The first ``top`` of each language; a language is ranked in parts first, as it may hold all phrases."""
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    apart = best.withColumn("_part", F.pmod(F.xxhash64("phrase"), F.lit(RANKED_APART)))
    apart = apart.withColumn("rank", F.row_number().over(W.partitionBy("lang", "_part").orderBy(*order))).where(F.col("rank") <= top)
    ranked = apart.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
