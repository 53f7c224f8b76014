"""Hand-made inputs with known results, and order-dependent operators against plain versions."""

from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F

from chalkline.functions.numeric import mastery_score
from chalkline.functions.payload import questions_type, quiz_defaults
from chalkline.functions.text import may_reach, robust_json, repair_xml, semantic_name, seq_ratio
from chalkline.operators import folds
from chalkline.operators.graph import acyclic, break_cycles, layers, sequence_week, week_order
from chalkline.operators.keyed import cascade_delete, keyed_union, patched, set_null, upsert
from chalkline.operators.lineage import Scratch
from chalkline.operators.structure import fold_dedup, pages_of
from chalkline.plans.language import without_meta
from chalkline.plans.people import personality, top_two


@pytest.mark.parametrize("score,attempts,spent,expected,mastery", [(0.8, 1, 300, 300, 0.88), (0.5, 3, 600, 300, 0.47), (0.0, 0, 0, 300, 0.4)])
def test_mastery(spark, score, attempts, spent, expected, mastery):
    df = spark.createDataFrame([(score, attempts, spent, expected)], "s double, a int, t int, e int")
    assert df.select(mastery_score(*map(F.col, "sate"))).first()[0] == mastery


def test_fold_dedup_keeps_what_two_passes_would_lose(spark):
    """Row 2 goes by its meaning, so row 3 with row 2's name on another page stays."""
    rows = [("b", 1, "a", "p1|x"), ("b", 2, "c", "p1|x"), ("b", 3, "c", "p2|y"), ("b", 4, "c", "p3|z")]
    df = spark.createDataFrame(rows, "book string, pos long, exact string, meaning string")
    kept = fold_dedup(df, ["book"], ["pos"], "exact", "meaning", "pos")
    assert sorted(r[0] for r in kept.collect()) == [1, 3]


def plain_dedup(rows):
    seen, means, kept = set(), set(), []
    for pos, a, b in rows:
        if a in seen or b in means:
            continue
        seen.add(a), means.add(b), kept.append(pos)
    return kept


def test_fold_dedup_against_plain(spark):
    r = random.Random(4)
    rows = [(g, i, r.choice("abcde"), r.choice("vwxyz")) for g in range(10) for i in range(20)]
    df = spark.createDataFrame(rows, "g int, pos long, k string, m string")
    got = {}
    for row in fold_dedup(df.withColumn("id", F.col("g") * 100 + F.col("pos")), ["g"], ["pos"], "k", "m", "id").collect():
        got.setdefault(row[0] // 100, []).append(row[0] % 100)
    assert got == {g: plain_dedup([(i, k, m) for h, i, k, m in rows if h == g]) for g in range(10)}


def test_folds_of_long_keys_go_on_in_rounds(spark, monkeypatch):
    """Keys of one event to far more than an array holds end where a single array ends."""
    r = random.Random(9)
    rows = [(g, i, r.random()) for g in range(6) for i in r.sample(range(1000), [1, 3, 4, 7, 20, 50][g])]
    df = spark.createDataFrame(rows, "g int, at int, x double")
    fold = lambda: sorted(map(tuple, folds.ordered_fold(df, ["g"], ["at"], ["x"], F.lit(0.0), lambda acc, e: F.round(acc * 0.3 + e["x"] * 0.7, 2), "y").collect()))
    whole = fold()
    monkeypatch.setattr(folds, "EVENTS", 4)
    assert fold() == whole and [n for _, n, _ in whole] == [1, 3, 4, 7, 20, 50]


def test_deep_layers(spark):
    """A chain of 110 nodes, one without edges and a cycle, which gets none."""
    nodes = [(0, i) for i in range(110)] + [(0, 500), (0, 600), (0, 601)]
    edges = [(0, i + 1, i) for i in range(109)] + [(0, 600, 601), (0, 601, 600)]
    found = layers(spark.createDataFrame(nodes, "group int, node int"), spark.createDataFrame(edges, "group int, child int, parent int"))
    assert sorted((r["node"], r["layer"]) for r in found.collect()) == [(i, i) for i in range(110)] + [(500, 0)]


def test_edit_distance_rules_out_no_alike_pair(spark):
    """No pair that reaches the ratio goes, letters beyond 16 bits included; of unlike ones few stay."""
    r = random.Random(11)
    texts = ["".join(r.choices("aab😀cde గ", k=r.randrange(0, 14))) for _ in range(60)]
    pairs = [(a, b) for a in texts for b in texts]
    rows = spark.createDataFrame(pairs, "a string, b string").select("a", "b", may_reach(F.col("a"), F.col("b"), 0.7).alias("may"), F.lit(0.7) <= seq_ratio("a", "b")).collect()
    assert not [x for x in rows if x[3] and not x["may"]]
    assert sum(x["may"] for x in rows) < 0.2 * len(rows) and any(x[3] for x in rows)


def plain_layers(nodes, edges):
    needs = {n: {p for g, c, p in edges if (g, c) == n and (g, p) in nodes} for n in nodes}
    found, layer = {}, 0
    while ready := [n for n in nodes if n not in found and all((n[0], p) in found for p in needs[n])]:
        found.update(dict.fromkeys(ready, layer))
        layer += 1
    return found


def test_layers_against_peeling(spark):
    """Groups with edges given twice, self loops, cycles, unknown ends, a ladder, and nodes of many prerequisites."""
    r = random.Random(7)
    nodes = {(0, i) for i in range(40)} | {(1, i) for i in range(40)} | {(2, i) for i in range(30)} | {(3, i) for i in range(25)}
    edges = [(0, c, p) for c in range(40) for p in r.sample(range(c), min(c, r.choice((0, 1, 1, 2, 7))))] * 2 + [(0, 3, 999), (0, 999, 3)]
    edges += [(1, r.randrange(40), r.randrange(40)) for _ in range(38)] + [(1, 5, 5)]
    edges += [(2, i, p) for i in range(2, 30) for p in (i - i % 2 - 1, i - i % 2 - 2)]
    edges += [(3, c, p) for c in range(25) for p in range(c)]
    found = layers(spark.createDataFrame(sorted(nodes), "group int, node int"), spark.createDataFrame(edges, "group int, child int, parent int"))
    assert {(x["group"], x["node"]): x["layer"] for x in found.collect()} == plain_layers(nodes, edges)


def test_rounds_of_layers_follow_the_logarithm(spark, monkeypatch):
    made = []
    keep = Scratch.keep
    monkeypatch.setattr(Scratch, "keep", lambda self, df, name: made.append(name) or keep(self, df, name))
    # A ladder: each node of a layer needs both of the layer before.
    nodes = spark.range(1000).select(F.lit(0).alias("group"), F.col("id").alias("node"))
    below = F.expr("node - node % 2 - 2")
    edges = nodes.select("group", F.col("node").alias("child"), F.explode(F.array(below, below + 1)).alias("parent")).where("parent >= 0")
    assert layers(nodes, edges).where("layer <> floor(node / 2)").isEmpty()
    assert made.count("ways") <= 12
    none = nodes.where("node < 0")
    assert layers(none, edges).isEmpty() and layers(nodes, edges.where("child < 0")).where("layer = 0").count() == 1000


def test_answer_key_of_questions_with_one_number(spark):
    """A question without a number has its place; of one number the last answer counts, in order of the last ones."""
    q = lambda n, a: (n, None, None, "q", a)
    rows = [(1, [q(2, "a"), q(None, "b"), q(2, "c"), q(10, "d"), q(1, None), q(4, "z")]), (2, []), (3, None), (4, [q(1, "x"), q(1, "y")])]
    _, answers, points = quiz_defaults(F.col("questions"))
    found = spark.createDataFrame(rows, f"id int, questions {questions_type()}").select("id", F.to_json(answers).alias("a"), points.alias("n")).collect()
    assert {x["id"]: (x["a"], x["n"]) for x in found} == {1: ('{"2":"c","10":"d","1":"","4":"z"}', 6), 2: ("{}", 0), 3: ("{}", 0), 4: ('{"1":"y"}', 2)}


def test_week_of_topics_without_edges(spark):
    plans = spark.createDataFrame([(1, 0, "unknown"), (1, 1, "b"), (1, 2, "alone"), (1, 3, "a")], "plan long, pos int, concept string")
    edges = spark.createDataFrame([(0, "b", "a")], "pos int, child string, parent string")
    topics = spark.createDataFrame([("a",), ("b",), ("alone",)], "concept string")
    found = sequence_week(plans, edges, topics).collect()
    assert [c for _, c in sorted((r["day"], r["concept"]) for r in found)] == ["a", "alone", "b", "unknown"]


def test_cycles_are_sought_in_list_order(spark):
    """From "10", first in the list, the edge of "2" closes the cycle; in order of names it would be the other one."""
    edges = spark.createDataFrame([("g", 1, "10", "2"), ("g", 2, "2", "10")], "group string, pos int, child string, parent string")
    assert [(r["child"], r["parent"]) for r in break_cycles(edges).collect()] == [("10", "2")]


def test_week_order():
    edges = [("b", "a"), ("c", "a"), ("d", "b"), ("x", "c"), ("y", "c"), ("p", "q"), ("q", "p")]
    known = {n for e in edges for n in e}
    assert week_order(["d", "c", "b", "a", "new"], edges, known, 5) == ["a", "c", "b", "d", "new"]
    assert week_order(["p", "q", "a"], edges, known, 5) == ["a", "p", "q"]
    assert week_order(["a", "b", "c", "d", "x", "y"], edges, known, 3) == ["a", "c", "b"]


def test_acyclic():
    r = random.Random(1)
    for _ in range(50):
        edges = {(str(r.randrange(8)), str(r.randrange(8))) for _ in range(14)}
        kept = acyclic(sorted(edges), [str(i) for i in range(8)])
        assert set(kept) <= edges
        left, changed = {n for e in kept for n in e}, True
        while changed:
            free = {n for n in left if not any(c == n and p in left for c, p in kept)}
            left, changed = left - free, bool(free)
        assert not left
    assert acyclic([("b", "a"), ("a", "b")], ["a", "b"]) == [("a", "b")]


def test_keyed_writes(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string")
    assert sorted(map(tuple, upsert(old, new, ["k"]).collect())) == [(1, "a"), (2, "c"), (3, "d")]
    batch = spark.createDataFrame([(2, "c", 1), (2, "e", 3), (2, "d", 2)], "k int, v string, at int")
    assert sorted(map(tuple, upsert(old, batch, ["k"], [F.col("at")]).collect())) == [(1, "a"), (2, "e")]
    gone = spark.createDataFrame([(2,)], "k int")
    children = spark.createDataFrame([(10, 1), (11, 2), (12, None)], "id int, parent int")
    assert sorted(map(tuple, set_null(gone, "k", children, "parent").collect()), key=str) == [(10, 1), (11, None), (12, None)]
    patch = spark.createDataFrame([(1, None, "x"), (2, "z", "y"), (9, "q", "q")], "k int, v string, secret string")
    assert sorted(map(tuple, patched(old, patch, "k", ["v"]).collect())) == [(1, "a"), (2, "z")]
    merged = keyed_union([old, new], F.col("k").cast("string"), F.col("v"))
    assert sorted(map(tuple, merged.collect())) == [(1, "a"), (2, "b"), (3, "d")]
    child = spark.createDataFrame([(1, 10), (2, 20)], "p int, c int")
    grand = spark.createDataFrame([(10, 1), (20, 2)], "c int, g int")
    levels = cascade_delete(old.where("k = 1"), "k", [(child, "p", "c"), (grand, "c", "g")])
    assert [sorted(map(tuple, x.collect())) for x in levels] == [[(2, 20)], [(20, 2)]]


def test_inverted_range_has_no_pages(spark):
    df = spark.createDataFrame([(3, 5), (5, 3)], "lo int, hi int")
    assert sorted(r["page"] for r in pages_of(df, "lo", "hi").collect()) == [3, 4, 5]


def test_text(spark):
    df = spark.createDataFrame([("14. Title (x)", "tide", "diet")], "a string, b string, c string")
    row = df.select(semantic_name(F.col("a")), seq_ratio("b", "c"), seq_ratio("c", "b")).first()
    assert row[0] == "title" and (row[1], row[2]) == (0.25, 0.5)
    s = "Birds fly high. This page belongs to another chapter. They sing."
    notes = spark.createDataFrame([(s,), ("One. NOTE: x",), ("as per the prompt",)], "s string")
    assert [r[0] for r in notes.select(without_meta(F.col("s"))).collect()] == ["Birds fly high. They sing.", "One.", "as per the prompt"]


@pytest.mark.parametrize("raw", ['{"a": [1, 2', 'x ```json\n{"a": [1, 2]}\n``` y', '{"a": [1, 2], "b": "cut', '{"a": [1, 2],}', '{"a": [1, 2]} tail'])
def test_json_repair(spark, raw):
    fixed = spark.createDataFrame([(raw,)], "s string").select(robust_json(F.col("s"))).first()[0]
    assert json.loads(fixed)["a"] == [1, 2]


def test_json_beyond_repair(spark):
    df = spark.createDataFrame([("no json",), (None,), ("",)], "s string")
    assert [r[0] for r in df.select(robust_json(F.col("s"))).collect()] == [None, None, None]


def test_xml_repair(spark):
    df = spark.createDataFrame([("noise <a><b>x & y</b><c>z",), ("none",)], "s string")
    assert [r[0] for r in df.select(repair_xml("s")).collect()] == ["<a><b>x &amp; y</b><c>z</c></a>", None]


def test_personality_ties_and_floor(spark):
    columns = "interests array<string>, style string, level string, n long, mean double, spread double, frustration double, attempts10 double, quizzes long, retry double"
    df = spark.createDataFrame([(None, None, None, 0, None, 0.0, 0.9, None, 0, 0.0)], columns)
    row = top_two(personality(df)).first()
    assert (row["explorer"], row["resilient"], row["dominant"], row["secondary"], row["label"]) == (50.0, 40.0, "Explorer", "Achiever", "Driven Explorer")
