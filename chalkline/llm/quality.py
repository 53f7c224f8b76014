"""Quality rules as a short-circuit cascade, with DataFrame operations only.

Signals are computed inside each row, whatever its length: no word is
exploded. The rules form a conjunction, so their order changes the work and
never the verdict. A sample prices each rule (its own seconds a document, beside
the signals that are computed anyway) and measures how often it rejects; rules
then run by rejections per second, and CASE stops at the first that fails.
"""

from __future__ import annotations

import math
import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chalkline.llm.scratch import set_apart

WORD = r"[^\x20\x09-\x0D]"
SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
#: Documents in the sample that prices the rules, and times that each of them is judged.
SAMPLE, TIMES = 2000, 8


@dataclass(frozen=True)
class Rule:
    """A rule passes where ``passes`` is true; ``passes`` reads the text and the signals given to it."""

    name: str
    passes: Column


def word_list(text: Column) -> Column:
    return F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")


def _once(x: Column, f) -> Column:
    """f(x) with x computed once in a row, even where the optimizer puts this expression into a filter."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def repeated_words(words: Column) -> Column:
    """Positions that lie in a 3-word window found twice or more, the first one included.

    Words are hashed once, windows from those hashes. Only where hashes repeat
    are windows sorted with their places; a window repeats if a neighbour is
    equal. Its places, in order, cover at most 3 words each.
    """

    def windows(h: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(h) - 3), lambda i: F.xxhash64(F.get(h, i), F.get(h, i + 1), F.get(h, i + 2)))

    def places(s: Column) -> Column:
        same = lambda a, b: F.coalesce(F.get(s, a)["h"] == F.get(s, b)["h"], F.lit(False))
        twice = F.filter(s, lambda x, j: same(j, j - 1) | same(j, j + 1))
        return F.array_sort(F.transform(twice, lambda x: x["i"]))

    def covered(p: Column) -> Column:
        return F.aggregate(
            p, F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last")), lambda a, i: F.struct((a["n"] + F.least(F.lit(3), i - a["last"])).alias("n"), i.alias("last"))
        )["n"]

    def found(w: Column) -> Column:
        ordered = F.sort_array(F.transform(w, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(w)) == F.size(w), 0).otherwise(_once(ordered, lambda s: _once(places(s), covered)))

    hashed = F.transform(words, lambda w: F.xxhash64(w))
    return _once(hashed, lambda h: F.when(F.size(h) >= 3, _once(windows(h), found)).otherwise(0)).cast("long")


SIGNALS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def with_signals(df: DataFrame, text: str) -> DataFrame:
    """Adds ``n_words``, ``word_chars``, ``n_symbols``, ``n_dup_lines`` and ``n_repeat_words``; a null text has none of any."""
    t = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: F.trim(x, F.lit(SPACES)) != "")
    of_words = lambda w: F.struct(F.size(w).cast("long").alias("n"), repeated_words(w).alias("r"))
    return (
        df.withColumn("_of_words", _once(word_list(t), of_words))
        .withColumn("n_words", F.col("_of_words.n"))
        .withColumn("word_chars", F.char_length(F.translate(t, SPACES, "")).cast("long"))
        .withColumn("n_symbols", (F.char_length(t) - F.char_length(F.translate(t, SYMBOLS, ""))).cast("long"))
        .withColumn("n_dup_lines", _once(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"))
        .withColumn("n_repeat_words", F.col("_of_words.r"))
        .drop("_of_words")
    )


def base_failed() -> Column:
    """Under 50 words, or over half of them in repeated windows."""
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def web_rules(text: str) -> list[Rule]:
    """Rules for prose; each leaves wide room around ordinary text in any language."""
    n, chars = F.col("n_words"), F.col("word_chars")
    letters = F.char_length(F.regexp_replace(F.col(text), r"[^\p{L}]+", ""))
    return [
        Rule("word length", (chars >= 2 * n) & (chars <= 20 * n)),
        Rule("symbols", 10 * F.col("n_symbols") <= n),
        Rule("repeated lines", (F.col("n_dup_lines") < 3) | (F.col("n_dup_lines") * 10 <= 3 * F.size(F.split(F.col(text), "\n")))),
        Rule("letters", letters * 10 >= 6 * chars),
    ]


def _seconds(df: DataFrame, value: Column) -> float:
    """Least of three runs of one job that evaluates ``value`` in every row."""
    took = []
    for _ in range(3):
        began = time.perf_counter()
        df.agg(F.count_if(value)).first()
        took.append(time.perf_counter() - began)
    return min(took)


def priced(sample: DataFrame, rules: list[Rule], times: int = TIMES) -> list[tuple[float, float]]:
    """(seconds a document, share rejected) of each rule over the sample, whose signals are there already.

    Each row stands ``times`` times, and the job without a rule is taken off, so
    that what is left is the rule's own work and not a job's. Costs are told in
    powers of two of the least one that can be told, or noise would order rules.
    """
    total = max(1, sample.count())
    fails = [~F.coalesce(rule.passes, F.lit(False)) for rule in rules]
    rejected = sample.agg(*[F.count_if(f).alias(f"_{i}") for i, f in enumerate(fails)]).first() if rules else ()
    repeated = sample.withColumn("_time", F.explode(F.sequence(F.lit(1), F.lit(times))))
    idle = _seconds(repeated, F.col("_time") < 0)
    least = max(idle, 1e-3) / 4
    found = []
    for fail, n in zip(fails, rejected, strict=True):
        own = max(_seconds(repeated, fail & (F.col("_time") > 0)) - idle, least)
        found.append((least * 2.0 ** round(math.log2(own / least)) / times / total, n / total))
    return found


def ordered(rules: list[Rule], prices: list[tuple[float, float]]) -> list[Rule]:
    """Most rejections per cost first; equal ones keep their order."""
    worth = [share / max(cost, 1e-12) for cost, share in prices]
    return [rules[i] for i in sorted(range(len(rules)), key=lambda i: -worth[i])]


def cascade(rules: list[Rule]) -> Column:
    """Name of the first rule that rejects, null if none does; later rules aren't evaluated."""
    verdict = None
    for rule in rules:
        fails = ~F.coalesce(rule.passes, F.lit(False))
        verdict = F.when(fails, rule.name) if verdict is None else verdict.when(fails, rule.name)
    return verdict if verdict is not None else F.lit(None).cast("string")


def rule_order(df: DataFrame, text: str, rules: list[Rule], sample: int = SAMPLE) -> list[str]:
    """Names of the rules by rejections per cost on about ``sample`` rows of df, drawn where they are read."""
    share = sample / max(1, df.count())
    probe = with_signals(df.select(text).where(F.rand(17) < share), text).where(~base_failed()).cache()
    found = ordered(rules, priced(probe, rules))
    probe.unpersist()
    return [r.name for r in found]


def apply_quality(df: DataFrame, text: str, rules: list[Rule] | None = None, sample: int = SAMPLE, order: list[str] | None = None) -> DataFrame:
    """Adds the signals, ``base_failed``, ``rejected_by`` (the rule that ended the cascade) and ``kept`` to ``df``.

    The sample orders rules and decides nothing else: ``kept`` is the same in
    any order, ``rejected_by`` is the first rule of that order which rejects.
    ``order`` (names, as rule_order gives them) pins it for runs that must tell
    the same. Null and empty texts have no words and fail the base; repeated
    rows are judged one by one; an empty table gives no rows. A column of df
    with an added name comes out with ``_in`` at its end; rules find the text
    under the name that it comes out with.
    """
    apart = set_apart(df.columns, [*SIGNALS, "base_failed", "rejected_by", "kept"])
    text = apart[df.columns.index(text)]
    df = df.toDF(*apart)
    rules = web_rules(text) if rules is None else rules
    if order is None:
        order = rule_order(df, text, rules, sample) if len(rules) > 1 else [r.name for r in rules]
    rules = sorted(rules, key=lambda r: order.index(r.name))
    judged = with_signals(df, text).withColumn("base_failed", base_failed())
    return judged.withColumn("rejected_by", F.when(F.col("base_failed"), "base").otherwise(cascade(rules))).withColumn("kept", F.col("rejected_by").isNull())
