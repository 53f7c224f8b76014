"""Sharding, mixing and quality rules against plain versions."""

from __future__ import annotations

import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from chalkline.llm.mixing import MOST, mix_sources, source_targets, word_count
from chalkline.llm.quality import Rule, apply_quality, ordered, priced, with_signals
from chalkline.llm.sharding import shard_by_splitters

SCHEMA = "doc_id long, text string, source string"
ODD = [(1, None, "a"), (2, "", None), (3, "  \n", "a"), (None, "x y", "b"), (5, "é ü", "b"), (5, "é ü", "b"), (7, "w " * 5000, "a")]


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def shards(spark, rows):
    found = shard_by_splitters(frame(spark, rows), "text", "doc_id", 8).collect()
    assert len(found) == len(rows)
    by = {}
    for r in found:
        by.setdefault(r["shard"], []).append(r)
    for own in by.values():
        assert sorted(r["slot"] for r in own) == list(range(len(own)))
    return by


def test_shards_are_even_and_keep_small_groups(spark):
    rows = [(i, f"text {i} " * (1 + i % 40), "s") for i in range(6000)] + [(10_000 + i, f"copy {i // 3}", "s") for i in range(900)]
    by = shards(spark, rows)
    sizes = [sum(r["size"] for r in own) for own in by.values()]
    assert len(sizes) == 8 and max(sizes) < 1.02 * min(sizes)
    homes = {}
    for s, own in by.items():
        for r in own:
            homes.setdefault(r["text_crc32"], set()).add(s)
    assert all(len(x) == 1 for x in homes.values())
    crc = {i: zlib.crc32(t.encode()) for i, t, _ in rows}
    assert all(r["text_crc32"] == crc[r["doc_id"]] and 0 <= r["shard"] < 8 for own in by.values() for r in own)


def test_hot_group_is_cut(spark):
    rows = [(i, "the same text", "s") for i in range(3000)] + [(5000 + i, f"other {i}", "s") for i in range(3000)]
    sizes = [sum(r["size"] for r in own) for own in shards(spark, rows).values()]
    assert len(sizes) == 8 and max(sizes) < 1.03 * min(sizes)


@pytest.mark.parametrize("ids", ["none", "equal", "some"])
def test_rows_equal_in_id_and_text(spark, ids):
    """One key holds many rows: all of the table, or half of it beside ordinary rows; reruns over another layout deal alike."""
    number = {"none": lambda i: None, "equal": lambda i: 7, "some": lambda i: i if i % 3 == 0 else None}[ids]
    rows = [(number(i), "the very same text", "s") for i in range(4000)]
    if ids != "equal":
        rows += [(5000 + i, f"other {i} " * (1 + i % 9), "s") for i in range(3000)]
    by = shards(spark, rows)
    sizes = [sum(r["size"] for r in own) for own in by.values()]
    assert len(sizes) == 8 and max(sizes) < 1.05 * min(sizes)
    again = shard_by_splitters(frame(spark, rows).repartition(3), "text", "doc_id", 8).collect()
    assert sorted(map(str, again)) == sorted(str(r) for own in by.values() for r in own)


def test_shard_edges(spark):
    found = [r for own in shards(spark, ODD).values() for r in own]
    assert {(r["doc_id"], r["size"]) for r in found} == {(i, len((t or "").encode()) + 1) for i, t, _ in ODD}
    assert [r["text_crc32"] for r in found if r["doc_id"] == 1] == [None]
    assert shards(spark, []) == {}


def plain_targets(sizes, weights=(1, 2, 3)):
    names = sorted(sizes)
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    left, free, target = sum(sizes.values()), set(names), {}
    while free:
        level = left / sum(w[s] for s in free)
        over = {s for s in free if w[s] * level >= MOST * sizes[s]}
        if not over:
            return target | {s: w[s] * level for s in free}
        for s in over:
            target[s] = MOST * sizes[s]
            left -= target[s]
        free -= over
    return target


@pytest.mark.parametrize("sizes", [{"a": 100, "b": 100, "c": 100}, {"a": 1000, "b": 10, "c": 1, "d": 500}, {"a": 0, "b": 7}, {"a": 5}])
def test_targets(spark, sizes):
    rows = [(s, n, 1.0, 1.0) for s, n in sizes.items()]
    got = source_targets(spark.createDataFrame(rows, "_source string, source_size long, _mean double, _least double")).collect()
    assert {r["_source"]: pytest.approx(r["target"]) for r in got} == plain_targets(sizes)


def test_mix_meets_targets_and_reruns_agree(spark):
    rows = [(i, "w " * (1 + i * 7919 % 300), "abcde"[min(4, i % 9)] if i % 50 else None) for i in range(3000)]
    df = frame(spark, rows)
    mix = lambda d: sorted(map(tuple, mix_sources(d, word_count(F.col("text")), "source", "doc_id").collect()), key=str)
    found = mix(df)
    assert found == mix(df.repartition(7))
    taken, target = Counter(), {}
    for _, source, size, _, goal, copies in found:
        assert 0 <= copies <= MOST
        taken[source] += size * copies
        target[source] = goal
    assert all(abs(taken[s] - target[s]) <= 0.01 * target[s] + 5 for s in target)
    assert sum(target.values()) == pytest.approx(sum(r[2] for r in found))


def test_mix_edges(spark):
    found = mix_sources(frame(spark, ODD), word_count(F.col("text")), "source", "doc_id").collect()
    assert len(found) == len(ODD)
    assert {r["source"] for r in found} == {"a", "b", None}
    assert mix_sources(frame(spark, []), word_count(F.col("text")), "source", "doc_id").collect() == []


def plain_signals(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    counts, covered = Counter(windows), set()
    for i, w in enumerate(windows):
        if counts[w] > 1:
            covered |= {i, i + 1, i + 2}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered))


TEXTS = [None, "", " ", "a", "a b c", "a b c a b c", "a a a a", "a a a a a b", "x y z q x y z", "l1\nl1\n l1\n\nl2", "😀 é\n😀 é", "#$ a*b <c>|", "a\x0bb\x85c d", "x y " * 40 + "end"]


def test_signals(spark):
    rows = list(enumerate(TEXTS))
    df = with_signals(spark.createDataFrame(rows, "doc_id long, text string"), "text")
    got = {r["doc_id"]: (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in df.collect()}
    assert got == {i: plain_signals(t) for i, t in rows}


def test_quality_verdicts(spark):
    prose = " ".join(f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(80))
    rows = [(1, prose), (2, prose.replace(" ", " $$ ")), (3, "short"), (4, "same old words " * 40), (5, None), (6, prose)]
    found = apply_quality(spark.createDataFrame(rows, "doc_id long, text string"), "text").collect()
    assert {r["doc_id"]: r["kept"] for r in found} == {1: True, 2: False, 3: False, 4: False, 5: False, 6: True}
    assert [r["rejected_by"] for r in found if r["doc_id"] == 2] == ["symbols"]
    assert apply_quality(spark.createDataFrame([], "doc_id long, text string"), "text").collect() == []


def test_prices_are_of_the_rules_themselves(spark):
    """A rule that works hard on every text costs several times one that reads a signal, and comes after it if both reject alike."""
    rows = [(i, f"some {i} words " * 60) for i in range(400)]
    df = with_signals(spark.createDataFrame(rows, "doc_id long, text string"), "text").cache()
    hard = F.regexp_count(F.regexp_replace("text", r"(\\w)(\\w)", "$2$1"), F.lit(r"[aeiou]\\w*s")) < 0
    rules = [Rule("hard", hard), Rule("easy", F.col("n_words") < 0)]
    (dear, share), (cheap, same) = priced(df, rules, times=40)
    assert share == same == 1.0 and dear >= 2 * cheap
    assert [r.name for r in ordered(rules, [(dear, share), (cheap, same)])] == ["easy", "hard"]


def test_quality_columns_with_added_names(spark):
    df = spark.createDataFrame([(1, "a b", 5, "x", "y")], "doc_id long, kept string, N_words int, _words string, _lines string")
    found = apply_quality(df, "kept", order=["word length", "symbols", "repeated lines", "letters"])
    row = found.first()
    assert (row["kept_in"], row["N_words_in"], row["_words"], row["_lines"], row["n_words"], row["kept"]) == ("a b", 5, "x", "y", 2, False)


def test_rules_run_by_rejections_per_cost():
    rules = [Rule(n, None) for n in "abc"]
    assert [r.name for r in ordered(rules, [(1.0, 0.1), (0.5, 0.4), (0.1, 0.01)])] == ["b", "a", "c"]
