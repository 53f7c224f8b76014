"""Language identification by unigram pieces, with all segmentations summed.

The pieces of a fixed public vocabulary get a probability in each language. A
word's likelihood is the sum over every way to cut it into pieces, found by the
forward algorithm; a text's is the product over its words.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chalkline.llm.scratch import Scratch, bounded_batches, memory_returned, set_apart

#: Labelled documents that the fit expects to read for each language.
SAMPLE = 1500
#: Languages that a worker scores at once; of more, each block goes over the texts by itself.
LANGUAGES = 256
#: Count added to every piece, and likelihood of a character that no piece has.
SMOOTH, UNKNOWN = 0.1, 1e-10
#: Words kept with their scores in a worker, and bytes of scores that it holds at once.
CACHE, HELD = 200_000, 64 << 20
#: Longer words take the forward algorithm in logarithms.
SHORT = 24
LETTERS = regex.compile(r"\p{L}+")
MARK = "▁"  # how the vocabulary writes the start of a word
BASE = np.uint64(0x9E3779B97F4A7C15)


def load_pieces(path: str) -> list[str]:
    """The ordinary pieces of a sentencepiece vocabulary, by rank."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = range(model.get_piece_size())
    return [model.id_to_piece(i) for i in ids if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]


def _hashes(codes: np.ndarray) -> np.ndarray:
    """Polynomial hashes of rows of code points; a row's length is part of its value, as codes are above 0."""
    h = np.zeros(len(codes), np.uint64)
    with np.errstate(over="ignore"):
        for i in range(codes.shape[1]):
            h = h * BASE + codes[:, i]
    return h


def _codes(words: list[str], length: int) -> np.ndarray:
    return np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(len(words), length).astype(np.uint64) + np.uint64(1)


class Forward:
    """Sums over segmentations under piece probabilities of shape (pieces, languages)."""

    def __init__(self, pieces: list[str], probs: np.ndarray):
        by_length: dict[int, list[int]] = {}
        for i, p in enumerate(pieces):
            by_length.setdefault(len(p), []).append(i)
        self.tables = {}
        for length, own in by_length.items():
            h = _hashes(_codes([pieces[i] for i in own], length))
            order = np.argsort(h)
            self.tables[length] = (h[order], probs[np.array(own)[order]])
        self.longest = max(by_length)
        self.langs = probs.shape[1]

    def _pieces(self, codes: np.ndarray, start: int, length: int) -> tuple[np.ndarray, np.ndarray] | None:
        """(rows, probabilities) of the words that have a piece at ``start`` of ``length``."""
        if length not in self.tables:
            return None
        keys, probs = self.tables[length]
        h = _hashes(codes[:, start : start + length])
        at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
        rows = np.flatnonzero(keys[at] == h)
        return rows, probs[at[rows]]

    def words(self, words: list[str]) -> np.ndarray:
        """Log likelihoods of shape (words, languages); words carry their mark already."""
        out = np.empty((len(words), self.langs))
        groups: dict[int, list[int]] = {}
        for i, w in enumerate(words):
            groups.setdefault(len(w), []).append(i)
        for length, whole in groups.items():
            most = max(1, HELD // (8 * self.langs * (length + 1)))
            for own in (whole[at : at + most] for at in range(0, len(whole), most)):
                out[own] = self._short(_codes([words[i] for i in own], length)) if length <= SHORT else np.stack([self._long(words[i]) for i in own])
        return out

    def _short(self, codes: np.ndarray) -> np.ndarray:
        n, length = codes.shape
        alpha = np.zeros((length + 1, n, self.langs))
        alpha[0] = 1.0
        for i in range(length):
            for step in range(1, min(self.longest, length - i) + 1):
                if (hit := self._pieces(codes, i, step)) is None:
                    continue
                rows, probs = hit
                alpha[i + step][rows] += alpha[i][rows] * probs
            alpha[i + 1] += alpha[i] * UNKNOWN  # a character outside the vocabulary
        return np.log(alpha[length])

    def _long(self, word: str) -> np.ndarray:
        """One long word: all starts are looked up at once for each length, then one pass keeps scaled sums."""
        codes = _codes([word], len(word))[0]
        n = len(codes)
        found: dict[int, list[tuple[int, np.ndarray]]] = {}
        for step in range(1, self.longest + 1):
            if n < step or (hit := self._pieces(np.lib.stride_tricks.sliding_window_view(codes, step), 0, step)) is None:
                continue
            for row, probs in zip(*hit, strict=True):
                found.setdefault(int(row) + step, []).append((int(row), probs))
        alpha, scale = {0: np.ones(self.langs)}, np.zeros(self.langs)
        for j in range(1, n + 1):
            total = alpha[j - 1] * UNKNOWN
            for start, probs in found.get(j, ()):
                total = total + alpha[start] * probs
            alpha[j] = total
            alpha.pop(j - self.longest - 1, None)
            if total.min() < 1e-100:  # each language by its own, so that none is lost
                alpha = {k: v / total for k, v in alpha.items()}
                scale += np.log(total)
        return np.log(alpha[n]) + scale


def _marked(word: str) -> list[str]:
    return [MARK + x for x in LETTERS.findall(word.lower())]


class Scorer:
    """Language and score of texts; words that were met before are looked up."""

    def __init__(self, forward: Forward, langs: list[str]):
        self.forward, self.langs = forward, langs
        self.most = max(1024, min(CACHE, HELD // (8 * len(langs))))
        self._clear()

    def _clear(self) -> None:
        self.rows: dict[str, int] = {}
        self.table = np.zeros((1024, len(self.langs)))
        self.lettered = np.zeros(1024, bool)

    def _known(self, words: list[str]) -> np.ndarray:
        """Rows of the table for distinct words, scored now where they are new."""
        if len(self.rows) > self.most:
            self._clear()
        new = [w for w in words if w not in self.rows]
        if new:
            parts = [_marked(w) for w in new]
            flat = list(dict.fromkeys(x for p in parts for x in p))
            place = {x: i for i, x in enumerate(flat)}
            scores = self.forward.words(flat) if flat else np.empty((0, len(self.langs)))
            need = len(self.rows) + len(new)
            while need > len(self.table):
                self.table, self.lettered = np.concatenate([self.table, np.zeros_like(self.table)]), np.concatenate([self.lettered, np.zeros_like(self.lettered)])
            for w, p in zip(new, parts, strict=True):
                i = self.rows[w] = len(self.rows)
                self.lettered[i] = bool(p)
                self.table[i] = scores[[place[x] for x in p]].sum(axis=0) if p else 0.0
        return np.fromiter((self.rows[w] for w in words), np.int64, len(words))

    def sums(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Log likelihoods of texts by language, and whether they have a letter."""
        lists = pc.utf8_split_whitespace(pc.fill_null(column.cast(pa.large_string()), ""))
        words = pc.dictionary_encode(lists.flatten())
        rows = self._known(words.dictionary.to_pylist())[words.indices.to_numpy()] if len(words) else np.empty(0, np.int64)
        ends = lists.offsets.to_numpy()
        ends = ends - ends[0]
        sums = np.zeros((len(column), len(self.langs)))
        lettered = np.zeros(len(column), bool)
        full = np.flatnonzero(ends[1:] > ends[:-1])
        if len(full):
            sums[full] = np.add.reduceat(self.table[rows], ends[:-1][full], axis=0)
            lettered[full] = np.logical_or.reduceat(self.lettered[rows], ends[:-1][full])
        return sums, lettered

    def block(self, column: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
        """(best language, its log likelihood, logarithm of the sum over all languages) of texts; texts without a letter are ``und``."""
        sums, lettered = self.sums(column)
        top = sums.max(axis=1)
        names = np.where(lettered, np.array(self.langs, object)[sums.argmax(axis=1)], "und")
        return names.tolist(), top, top + np.log(np.exp(sums - top[:, None]).sum(axis=1))

    def texts(self, column: pa.Array) -> tuple[list[str], np.ndarray]:
        names, top, total = self.block(column)
        return names, np.where(np.array(names, object) == "und", 0.0, np.exp(top - total))


def held_out(id_: Column) -> Column:
    return F.coalesce(F.crc32(id_.cast("string").cast("binary")) % 4 == 2, F.lit(False))


class Model(NamedTuple):
    """``langs`` in order; ``counts`` has (lang, piece, n) of the sampled documents."""

    langs: list[str]
    counts: DataFrame | None


def fit(labelled: DataFrame, text: str, lang: str, id_col: str, vocabulary: str, sample: int = SAMPLE) -> Model:
    """Piece counts of every label, from about ``sample`` whole documents of each, chosen by a hash of the id.

    All labels are learned. The counts are a table with a vocabulary's rows for
    each label at most; the driver holds the labels' names. Rows without a text
    or a label are left out; an empty table gives no language.
    """
    import sentencepiece

    bounded_batches(labelled.sparkSession)
    scratch = Scratch(labelled.sparkSession, "languages")
    known = labelled.where(F.col(text).isNotNull() & F.col(lang).isNotNull()).select(F.col(id_col).alias("id"), F.col(lang).alias("lang"), F.col(text).alias("text"))
    sizes = scratch.keep(known.groupBy("lang").agg(F.count(F.lit(1)).alias("size")), "sizes")
    langs = sorted(r[0] for r in sizes.select("lang").collect())
    if not langs:
        return Model([], None)
    draw = F.pmod(F.xxhash64("id", F.lit(5)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    chosen = known.join(sizes, "lang").where(draw < F.lit(float(sample)) / F.col("size")).select("lang", "text")

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sentencepiece.SentencePieceProcessor(model_file=vocabulary)
        totals: dict[str, Counter] = {}
        for batch in batches:
            for name, value in zip(batch["lang"].to_pylist(), batch["text"].to_pylist(), strict=True):
                totals.setdefault(name, Counter()).update(x for w in value.split() for x in _marked(w))
        for name, words in totals.items():
            found: Counter = Counter()
            for word, n in words.items():
                for piece in model.encode(word.replace(MARK, " "), out_type=str):
                    found[piece] += n
            if found:  # a document without a letter says nothing of its label
                yield pa.RecordBatch.from_pydict({"lang": [name] * len(found), "piece": list(found), "n": list(found.values())})

    sums = chosen.mapInArrow(pieces, "lang string, piece string, n long").groupBy("lang", "piece").agg(F.sum("n").alias("n"))
    return Model(langs, scratch.keep(sums, "counts"))


def probabilities(model: Model, langs: list[str], names: list[str]) -> np.ndarray:
    """Of the pieces ``names`` in the languages ``langs``, which are few."""
    place, column = {p: i for i, p in enumerate(names)}, {x: i for i, x in enumerate(langs)}
    table = np.full((len(names), len(langs)), SMOOTH)
    own = model.counts if len(langs) == len(model.langs) else model.counts.where(F.col("lang").between(langs[0], langs[-1]))
    for r in own.toLocalIterator():  # a vocabulary's rows for each of these languages at most
        if r["piece"] in place:
            table[place[r["piece"]], column[r["lang"]]] += r["n"]
    return table / table.sum(axis=0)


def identify(df: DataFrame, text: str, model: Model, vocabulary: str, keep: list[str], at_once: int = LANGUAGES) -> DataFrame:
    """Columns ``keep`` of df with ``lang_pred`` and ``score``, the posterior under equal priors.

    Every whole text is scored. Null texts and texts without a letter are
    ``und`` with score 0, and so is everything where no language was learned;
    equal likelihoods go to the first language by code point. A column of
    ``keep`` with an added name comes out with ``_in`` at its end.

    A worker holds the probabilities of ``at_once`` languages. Of more, each
    block of so many scores all texts for itself, and the blocks' results are put
    together by row.
    """
    spark = df.sparkSession
    bounded_batches(spark)
    langs = model[0]
    apart = set_apart(keep, ["lang_pred", "score"])
    source = df.select(*[F.col(c).alias(a) for c, a in zip(keep, apart, strict=True)], *([] if text in keep else [F.col(text).alias("_text")]))
    at = keep.index(text) if text in keep else len(keep)  # a kept text isn't sent twice
    names = load_pieces(vocabulary)
    if len(langs) > at_once:
        return _by_blocks(source, source.columns[at], apart, model, vocabulary, names, at_once)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[: len(keep)])
    shared = spark.sparkContext.broadcast(probabilities(model, langs, names) if langs else None)  # pieces x languages

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(Forward(load_pieces(vocabulary), shared.value), langs) if langs else None
        for batch in batches:
            found, scores = scorer.texts(batch.column(at)) if scorer else (["und"] * len(batch), np.zeros(len(batch)))
            columns = [batch.column(i) for i in range(len(keep))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(found, pa.string()), pa.array(scores, pa.float64())], names=[*apart, "lang_pred", "score"])
        del scorer
        memory_returned()

    return source.mapInArrow(scored, f"{schema}, lang_pred string, score double")


def _by_blocks(source: DataFrame, text: str, keep: list[str], model: Model, vocabulary: str, names: list[str], at_once: int) -> DataFrame:
    """identify() for more languages than a worker scores at once."""
    spark = source.sparkSession
    scratch = Scratch(spark, "blocks")
    rows = scratch.keep(source.withColumn("_row", F.monotonically_increasing_id()), "rows")
    union = None
    for low in range(0, len(model.langs), at_once):
        langs = model.langs[low : low + at_once]
        shared = spark.sparkContext.broadcast(probabilities(model, langs, names))

        def scored(batches: Iterator[pa.RecordBatch], langs: list[str] = langs, shared=shared) -> Iterator[pa.RecordBatch]:
            scorer = Scorer(Forward(load_pieces(vocabulary), shared.value), langs)
            for batch in batches:
                best, top, total = scorer.block(batch.column(1))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(best, pa.string()), pa.array(top), pa.array(total)], names=["_row", "best", "top", "total"])
            del scorer
            memory_returned()

        part = scratch.keep(rows.select("_row", text).mapInArrow(scored, "_row long, best string, top double, total double"), "block")
        shared.unpersist()
        union = part if union is None else union.unionByName(part)
    first = F.min(F.struct((-F.col("top")).alias("below"), "best")).alias("first")
    told = union.groupBy("_row").agg(first, F.collect_list("total").alias("totals"))  # a total for each block
    share = 1 / F.aggregate("totals", F.lit(0.0), lambda sum_, x: sum_ + F.exp(x + F.col("first.below")))
    told = told.select(F.col("_row").alias("_r"), F.col("first.best").alias("lang_pred"), F.when(F.col("first.best") == "und", 0.0).otherwise(share).alias("score"))
    return rows.join(told, rows["_row"] == told["_r"]).select(*keep, "lang_pred", "score")
