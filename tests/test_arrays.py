"""Arrays of ids against a plain lookup."""

from __future__ import annotations

import random

from chalkline.operators.arrays import resolve_arrays


def test_order_repeats_and_dangling_ids(spark):
    r = random.Random(8)
    things = [("b" if i % 3 else "c", f"e{i % 30}", i, f"text {i}", i % 5) for i in range(80)]
    boxes = [("b", f"s{i}", i, f"box {i}", None) for i in range(5)]
    ids = lambda p, n: None if r.random() < 0.1 else [r.choice([f"{p}{r.randrange(n)}", "gone", None]) for _ in range(r.randrange(7))]
    parents = [(r.choice("bc"), i, ids("e", 40), ids("s", 8), "x") for i in range(60)]
    thing = "book string, id string, doc_pos int, text string, page int"
    df = spark.createDataFrame(parents, "book string, topic int, es array<string>, ss array<string>, other string")
    children = {"es": spark.createDataFrame(things, thing), "ss": spark.createDataFrame(boxes, thing)}
    found = resolve_arrays(df, ["book", "topic"], children, ["text", "page"], ["book"])
    assert found.columns == df.columns
    known = {"es": {(b, i): (t, p) for b, i, _, t, p in things}, "ss": {(b, i): (t, p) for b, i, _, t, p in boxes}}
    look = lambda kind, b, own: [known[kind][b, i] for i in own or [] if (b, i) in known[kind]]
    want = {(b, t): (look("es", b, e), look("ss", b, s)) for b, t, e, s, _ in parents}
    assert {(x["book"], x["topic"]): ([tuple(y) for y in x["es"]], [tuple(y) for y in x["ss"]]) for x in found.collect()} == want
