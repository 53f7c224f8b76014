"""BPE encoding and decoding of whole texts, with tree concatenation for long unsplit stretches.

A text is normalised and cut into stretches that merges can't cross. A short
stretch is encoded once and then looked up. A long one is a tree: its halves are
encoded apart, and around each join a growing window is encoded again until a
token on either side of the join is the same, with the same place, in the
window and in the half. Between equal tokens the window's encoding stands: BPE
encodings are fixed by which neighbours may stand together, and every pair of
neighbours then comes from a correct encoding of its own.

A stretch over PIECE symbols is dealt out: its pieces are rows, which tasks
encode in parallel, and neighbours are joined in pairs, round after round.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from collections.abc import Iterator
from functools import cache
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chalkline.llm.scratch import Scratch, bounded_batches, memory_returned, set_apart

#: Symbols of a stretch that are encoded at once; longer ones are halved.
LEAF = 4096
#: Symbols on either side of a join that are encoded again at first.
WINDOW = 32
#: Symbols of a stretch that one task encodes; longer ones are dealt out.
PIECE = 1 << 16
#: Stretches kept in a worker, and symbols of the longest that is kept.
CACHE, SHORT = 100_000, 64
#: Bytes of ids and decoded text in an output batch.
BATCH = 16 << 20


@cache
def _plain_classes() -> tuple[str, str, str]:
    """Letters, numbers and other visible symbols below U+0300 whose lower case stays there, as character classes; NFC leaves them as they are."""
    kinds: dict[str, list[str]] = {"L": [], "N": [], "rest": []}
    for i in range(0x300):
        kind = unicodedata.category(c := chr(i))[0]
        if kind not in "CZ" and all(ord(x) < 0x300 for x in c.lower()):
            kinds[kind if kind in "LN" else "rest"].append(c)
    return tuple("".join(map(re.escape, x)) for x in kinds.values())


class Codec:
    """A tokenizer of the tokenizers library, whose merges stay inside stretches that its pre-tokenizer cuts."""

    @staticmethod
    @cache
    def of(path: str, leaf: int, window: int) -> Codec:
        """One for all calls in a worker."""
        return Codec(path, leaf, window)

    def __init__(self, path: str, leaf: int = LEAF, window: int = WINDOW):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.leaf, self.window = leaf, window
        self.model = self.tokenizer.model
        self.special = {t.content: i for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        self.cuts = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.names: pa.Array | None = None
        self.known: dict[str, list[int]] = {}
        self.by_word: dict[str, list[int]] = {}
        letters, numbers, rest = _plain_classes()
        pattern = rf"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{numbers}]|[{rest}]+"
        self.plain = re.compile(pattern)
        self.is_plain = re.compile(rf"[ \t\n\r{letters}{numbers}{rest}]*")
        self.words = self._splits_like(pattern)

    def _splits_like(self, pattern: str) -> bool:
        """Whether the tokenizer cuts a probe as the plain pattern does; if not, only the library cuts."""
        probe = "Is it's we'll 12 x² ¼ no-one's déjà «a» ª º µ Ǆ ı !? 'd a'sb !'s " + "".join(c for c in map(chr, range(0x300)) if self.is_plain.fullmatch(c))
        own = [p for w in self.plain.findall(probe.lower()) for p in self._cut(w)]
        return own == self._library(probe)

    def _cut(self, normal: str) -> list[str]:
        return [p for p, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(normal)] if self.tokenizer.pre_tokenizer else [normal]

    def _library(self, part: str) -> list[str]:
        return self._cut(self.tokenizer.normalizer.normalize_str(part) if self.tokenizer.normalizer else part)

    def stretch(self, text: str) -> list[int]:
        """Ids of one stretch, by halves where it is long."""
        return [i for i, _, _ in self._tree(text, 0, len(text))] if len(text) > self.leaf else [t.id for t in self.model.tokenize(text)]

    def _part(self, text: str, low: int, high: int) -> list[tuple[int, int, int]]:
        found, at = [], low
        for t in self.model.tokenize(text[low:high]):
            end = min(high, at + len(t.value))  # the last token's name may end in a mark for the end of the word
            found.append((t.id, at, end))
            at = end
        return found

    def _tree(self, text: str, low: int, high: int) -> list[tuple[int, int, int]]:
        if high - low <= self.leaf:
            return self._part(text, low, high)
        middle = (low + high) // 2
        return self._joined(text, low, high, self._tree(text, low, middle), self._tree(text, middle, high))

    def _joined(self, text: str, low: int, high: int, left: list, right: list) -> list[tuple[int, int, int]]:
        """Encoding of text[low:high] from those of its halves."""
        middle, reach = right[0][1], self.window
        in_left, in_right = {t: i for i, t in enumerate(left)}, {t: i for i, t in enumerate(right)}
        while True:
            a, b = max(low, middle - reach), min(high, middle + reach)
            a = next((t[1] for t in reversed(left) if t[1] <= a), low)
            b = next((t[2] for t in right if t[2] >= b), high)
            window = self._part(text, a, b)
            # A token that touches a cut end of the window, or of a half, is no witness, nor is the half's own end of word.
            before = low if a == low else next((t for t in window if t[1] > a and t[2] < middle and t in in_left), None)
            after = high if b == high else next((t for t in reversed(window) if t[2] < b and t[1] > middle and t in in_right), None)
            if before is not None and after is not None:
                head = [] if before == low and a == low else left[: in_left[before]]
                start = low if a == low else before[1]
                tail = [] if b == high else right[in_right[after] + 1 :]
                end = high if b == high else after[2]
                return [*head, *(t for t in window if t[1] >= start and t[2] <= end), *tail]
            if a == low and b == high:
                return window
            reach *= 2

    def _ids(self, stretch: str) -> list[int]:
        if len(stretch) > SHORT:
            return self.stretch(stretch)
        found = self.known.get(stretch)
        if found is None:
            if len(self.known) > CACHE:
                self.known.clear()
            found = self.known[stretch] = self.stretch(stretch)
        return found

    def parts(self, text: str, most: int | None = None) -> Iterator[list[int] | str]:
        """Ids of what comes next in the text or, where a stretch is over ``most``, the stretch itself."""
        known, long = self.by_word, most or sys.maxsize
        for part in self.cuts.split(text) if self.cuts else [text]:
            if part in self.special:
                yield [self.special[part]]
            elif self.words and self.is_plain.fullmatch(part):
                for word in self.plain.findall(part.lower()):
                    found = known.get(word)
                    if found is None:
                        stretches = self._cut(word)
                        if len(word) > SHORT:
                            yield from (p if len(p) > long else self.stretch(p) for p in stretches)
                            continue
                        if len(known) > CACHE:
                            known.clear()
                        found = known[word] = [i for p in stretches for i in self.stretch(p)]
                    yield found
            elif part:
                for stretch in self._library(part):
                    yield stretch if len(stretch) > long else self._ids(stretch)

    def encode(self, text: str) -> list[int]:
        return list(chain.from_iterable(self.parts(text)))

    def piece(self, text: str) -> tuple[list[int], list[int]]:
        """Ids of a piece of a stretch, and where each token ends."""
        found = self._tree(text, 0, len(text))
        return [i for i, _, _ in found], [end for _, _, end in found]

    def joined(self, left: tuple[str, list[int], list[int]], right: tuple[str, list[int], list[int]]) -> tuple[str, list[int], list[int]]:
        """Two neighbouring pieces (text, ids, ends) as one."""
        text, middle = left[0] + right[0], len(left[0])

        def tokens(ids: list[int], ends: list[int], at: int) -> list[tuple[int, int, int]]:
            ends = [e + at for e in ends]
            return list(zip(ids, [at, *ends[:-1]], ends, strict=True))

        found = self._joined(text, 0, len(text), tokens(left[1], left[2], 0), tokens(right[1], right[2], middle))
        return text, [i for i, _, _ in found], [end for _, _, end in found]

    def decoded(self, ids: pa.ListArray) -> pa.Array:
        """Texts of lists of ids as the library's decode has them; special tokens are kept."""
        if self.tokenizer.decoder is None:
            if self.names is None:
                vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
                names = [""] * (max(vocabulary.values()) + 1)
                for token, i in vocabulary.items():
                    names[i] = token
                self.names = pa.array(names, pa.string())
            return pc.binary_join(pa.ListArray.from_arrays(ids.offsets, self.names.take(ids.values)), " ")
        return pa.array([self.tokenizer.decode(x, skip_special_tokens=False) for x in ids.to_pylist()], pa.string())


def _schema(df: DataFrame, columns: list[str], names: list[str]) -> str:
    return "".join(f"`{n}` {f.dataType.simpleString()}, " for n, f in zip(names, df.select(*columns).schema.fields, strict=True))


def _sent(df: DataFrame, keep: list[str], names: list[str], column: str) -> DataFrame:
    """What goes to Python: the kept columns under their names, and ``column`` if it isn't among them."""
    return df.select(*[F.col(c).alias(n) for c, n in zip(keep, names, strict=True)], *([] if column in keep else [F.col(column).alias("_sent")]))


def encode_texts(df: DataFrame, text: str, tokenizer: str, keep: list[str], leaf: int = LEAF, window: int = WINDOW, piece: int = PIECE, decode: bool = False) -> DataFrame:
    """Columns ``keep`` of df with ``ids``, the token ids of the whole text (null: of an empty one).

    With ``decode`` also ``decoded``, the text of those ids as decode_ids has
    it, made by the worker that has the tokenizer already. A kept column of an
    added name comes out with ``_in`` at its end. Special tokens in a
    text become their ids; none are added. Rows that repeat are encoded each; an
    empty table gives none. Texts over ``piece`` symbols are asked for long
    stretches, which are dealt out; if there are none, nothing is.
    """
    spark = df.sparkSession
    bounded_batches(spark)
    added = ["ids", "decoded"] if decode else ["ids"]
    apart, place = set_apart(keep, added), keep.index(text) if text in keep else len(keep)
    sent, schema = _sent(df, keep, apart, text), _schema(df, keep, apart) + ("ids array<int>, decoded string" if decode else "ids array<int>")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(tokenizer, leaf, window)
        for batch in batches:
            held, start, room = [], 0, 0
            texts = batch.column(place)
            for at in range(len(batch)):
                ids = codec.encode(texts[at].as_py() or "")
                held.append(np.array(ids, np.int32))
                room += 4 * len(ids)
                if room > BATCH or at + 1 == len(batch):
                    offsets = np.concatenate([[0], np.cumsum([len(x) for x in held])]).astype(np.int32)
                    lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(held)))
                    own = [batch.column(i).slice(start, len(held)) for i in range(len(keep))]
                    told = [codec.decoded(lists)] if decode else []
                    yield pa.RecordBatch.from_arrays([*own, lists, *told], names=[*apart, *added])
                    held, start, room = [], at + 1, 0
        del codec
        memory_returned()

    name = sent.columns[place]
    # A stretch is no longer than its text, but for what lower case and compatibility forms add.
    long = F.coalesce(F.char_length(name) > piece // 4, F.lit(False)) & F.col(name).rlike(rf"\S{{{min(1000, max(1, piece // 4))}}}")
    if sent.where(long).isEmpty():
        return sent.mapInArrow(run, schema)
    dealt = _dealt(sent.where(long), name, apart, tokenizer, leaf, window, piece)
    if decode:
        dealt = decode_ids(dealt, "ids", tokenizer, [*apart, "ids"])
    return sent.where(~long).mapInArrow(run, schema).unionByName(dealt)


def _dealt(sent: DataFrame, text: str, names: list[str], tokenizer: str, leaf: int, window: int, piece: int) -> DataFrame:
    """Columns ``names`` with ``ids`` of texts whose stretches over ``piece`` symbols go through several tasks."""
    scratch = Scratch(sent.sparkSession, "stretches")
    rows = scratch.keep(sent.withColumn("_row", F.monotonically_increasing_id()), "rows")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(tokenizer, leaf, window)
        for batch in batches:
            for row, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids: list[int] = []
                item = 0
                for part in chain(codec.parts(value or "", piece), [None]):
                    if isinstance(part, list):
                        ids += part
                        continue
                    if ids:  # what stands between long stretches
                        yield _pieces([(row, item, 0, None, ids, [])])
                        ids, item = [], item + 1
                    if part is not None:
                        for k, at in enumerate(range(0, len(part), piece)):
                            yield _pieces([(row, item, k, part[at : at + piece], [], [])])
                        item += 1

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(tokenizer, leaf, window)
        for batch in batches:
            for x in batch.to_pylist():
                ids, ends = codec.piece(x["text"])
                yield _pieces([(x["row"], x["item"], x["part"], x["text"], ids, ends)])

    def join(pair: pd.DataFrame) -> pd.DataFrame:
        pair = pair.sort_values("part")
        if len(pair) == 1:
            return pair.assign(part=pair["part"] // 2)
        left, right = ((x["text"], list(x["ids"]), list(x["ends"])) for _, x in pair.iterrows())
        whole, ids, ends = Codec.of(tokenizer, leaf, window).joined(left, right)
        one = pair.iloc[0]
        return pd.DataFrame([(one["row"], one["item"], one["part"] // 2, whole, ids, ends)], columns=pair.columns)

    cuts = scratch.keep(rows.select("_row", text).mapInArrow(cut, PIECES), "cuts")
    n = int(sent.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    state = scratch.keep(cuts.where("text IS NOT NULL").repartition(n, "row", "item", "part").mapInArrow(encode, PIECES), "encoded")
    while not state.where("part > 0").isEmpty():
        joined = scratch.keep(state.groupBy("row", "item", F.floor(F.col("part") / 2).alias("pair")).applyInPandas(join, PIECES), "joined")
        scratch.drop(state)
        state = joined
    whole = cuts.where("text IS NULL").select("row", "item", "ids").unionByName(state.select("row", "item", "ids"))
    lists = whole.groupBy(F.col("row").alias("_row")).agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("item", "ids"))), lambda x: x["ids"])).alias("ids"))
    out = rows.join(lists, "_row", "left").withColumn("ids", F.coalesce("ids", F.array().cast("array<int>")))
    return out.select(*names, "ids")


PIECES = "row long, item int, part int, text string, ids array<int>, ends array<int>"


def _pieces(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.int32())]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["row", "item", "part", "text", "ids", "ends"])


def decode_ids(df: DataFrame, ids: str, tokenizer: str, keep: list[str]) -> DataFrame:
    """Columns ``keep`` of df with ``decoded``, the text of each list of ids (null: empty); a kept column of that name comes out as ``decoded_in``."""
    bounded_batches(df.sparkSession)
    apart, place = set_apart(keep, ["decoded"]), keep.index(ids) if ids in keep else len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(tokenizer)
        for batch in batches:
            lists = batch.column(place)
            lists = pa.ListArray.from_arrays(lists.offsets, lists.values.cast(pa.int32())) if not lists.null_count else pa.array([x or [] for x in lists.to_pylist()], pa.list_(pa.int32()))
            own = [batch.column(i) for i in range(len(keep))]
            yield pa.RecordBatch.from_arrays([*own, codec.decoded(lists)], names=[*apart, "decoded"])
        del codec
        memory_returned()

    return _sent(df, keep, apart, ids).mapInArrow(run, _schema(df, keep, apart) + "decoded string")
