"""Phrases against a plain count of every n-gram: odd rows, overlaps, repeats, ties, buckets that go to disk."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from chalkline.llm import collocations as C

COLUMNS = "lang", "rank", "phrase", "a", "l", "r", "n", "score"


def plain(rows, least, longest, top, covered=100):
    f, n = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        lowered = (text or "").translate({c: c + 32 for c in range(65, 91)})
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", lowered):
            w = re.findall(r"[^ \t]+", piece)
            n[lang] += len(w)
            for k in range(1, longest + 1):
                f[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, count in f.items():
        phrases = {g: a for g, a in count.items() if len(g) > 1 and a >= least}
        inside = Counter()
        for g, a in phrases.items():
            for i in range(len(g)):
                for j in range(i + 2, len(g) + 1):
                    if j - i < len(g):
                        inside[g[i:j]] = max(inside[g[i:j]], a)
        found = []
        for g, a in phrases.items():
            if 100 * inside[g] >= covered * a:
                continue
            score, k = min((1000 * a * n[lang] // (count[g[:k]] * count[g[k:]]), k) for k in range(1, len(g)))
            found.append((-score, -a, " ".join(g).encode(), count[g[:k]], count[g[k:]]))
        for rank, (score, a, g, left, right) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, g.decode(), -a, left, right, n[lang], -score))
    return sorted(out)


def told(df, **how):
    return sorted(tuple(r[c] for c in COLUMNS) for r in C.collocations(df, "text", "lang", **how).collect())


@pytest.fixture(scope="module")
def rows():
    draw = random.Random(5)
    words = ["the", "The", "of", "a", "Éa", "é", "new", "york", "x", "ß", "日本", "a" * 300]

    def text():
        parts = []
        for _ in range(draw.randint(0, 40)):
            parts.append(draw.choice(["new york city hall", "a a a a a", "of the", *words, *words]))
            parts.append(draw.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\x0b", " ", ""]))
        return "".join(parts)

    rows = [(text(), draw.choice(["en", "en", "fr", None, "und", ""])) for _ in range(250)]
    return [*rows, *rows[:30], (None, "en"), ("", None), (" \t.. ", "fr"), ("new york " * 900, "en"), *[("Same passage, of the city hall", "en")] * 40]


@pytest.mark.parametrize(("least", "longest", "top", "covered"), [(3, 5, 2000, 100), (1, 3, 50, 100), (5, 2, 7, 100), (2, 6, 30, 60)])
def test_against_plain(spark, rows, least, longest, top, covered):
    df = spark.createDataFrame([(t, lang, 1, "z") for t, lang in rows], "text string, lang string, rank int, Phrase string")
    assert told(df, least=least, longest=longest, top=top, covered=covered) == plain(rows, least, longest, top, covered)


def test_small_batches_and_a_full_filter(spark, rows, monkeypatch):
    """Many batches a task, and a filter of so few bits that it lets nearly all through."""
    monkeypatch.setattr(C, "MOST_BITS", 1 << 16)
    monkeypatch.setattr(C, "RANKED_APART", 3)
    df = spark.createDataFrame(rows, "text string, lang string").repartition(7)
    assert told(df, least=2, gathered=200) == plain(rows, 2, 5, 2000)


def test_empty_table_and_no_phrase(spark):
    df = spark.createDataFrame([("one two", "en"), (None, None)], "text string, lang string")
    assert told(df.limit(0)) == [] and told(df) == []


def test_buckets_beyond_memory(spark):
    """Sums of more n-grams than DuckDB may hold."""
    many = spark.range(600_000).select(F.lit("en").alias("lang"), F.concat(F.lit("w" * 400), F.col("id") % 300_000).alias("gram"), F.lit(2).alias("words"), F.lit(5).cast("long").alias("f"))
    found = C._added_up(many, 10).agg(F.count("*"), F.sum("f")).first()
    assert tuple(found) == (300_000, 3_000_000)


def test_products_beyond_64_bits(spark):
    big = spark.createDataFrame([(2_000_000_000_003, 9_000_000_000_000_001, 2_000_000_000_009, 3_000_000_000_011)], "f long, n long, l long, r long")
    assert big.select(F.expr(C.SCORE)).first()[0] == 1000 * 2_000_000_000_003 * 9_000_000_000_000_001 // (2_000_000_000_009 * 3_000_000_000_011)
