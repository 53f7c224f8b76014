"""Queries that once left rows out, on small tables where each cut shows."""

from __future__ import annotations

import datetime as dt
import json

from pyspark.sql import functions as F

from chalkline.functions.text import robust_json
from chalkline.plans import people, registry

DAY = dt.datetime(2024, 1, 1)


def kept(spark, folder, **tables):
    """Writes each table, (rows, schema), where the queries read theirs."""
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def run(spark, name, folder):
    return [tuple(r) for r in registry.queries()[name](spark, folder).collect()]


def test_assigned_worksheets_of_every_student(spark, tmp_path):
    """Students apart from 0, 50, ... and classes of over 20 assignments."""
    customer = [(k, k % 3) for k in range(60)]
    orders = [(k, k % 3, DAY + dt.timedelta(days=k * 7 % 40)) for k in range(90)]
    sf = kept(
        spark,
        tmp_path,
        customer=(customer, "c_custkey long, c_nationkey int"),
        nation=([(0, "a"), (1, "b"), (2, "c")], "n_nationkey int, n_name string"),
        orders=(orders, "o_orderkey long, o_custkey long, o_orderdate timestamp"),
    )
    pairs = [(c, o, day, "abc"[n]) for c, n in customer for o, k, day in orders if k % 25 == n]
    assert run(spark, "assigned_worksheets", sf) == sorted(pairs, key=lambda r: (r[0], -(r[2] - DAY).days, r[1]))


def test_assigned_worksheets_are_sorted_in_pieces(spark, tmp_path, monkeypatch):
    """Classes of many pieces, times that several worksheets share, a class without a name; pairs are laid out behind the last shuffle."""
    monkeypatch.setattr(people, "PIECE", 4)
    monkeypatch.setattr(people, "DEALS", 3)
    customer = [(k, k % 4) for k in range(30)]
    orders = [(k, k % 3, DAY + dt.timedelta(days=k % 5)) for k in range(80)] + [(100, 3, DAY), (101, None, DAY), (102, 3, None)]
    sf = kept(
        spark,
        tmp_path,
        customer=([*customer, (30, None), (31, 9)], "c_custkey long, c_nationkey int"),
        nation=([(0, "a"), (1, "b"), (2, "c")], "n_nationkey int, n_name string"),
        orders=(orders, "o_orderkey long, o_custkey long, o_orderdate timestamp"),
    )
    pairs = [(c, o, day, ["a", "b", "c", None][n]) for c, n in customer for o, k, day in orders if k is not None and k % 25 == n]
    found = registry.queries()["assigned_worksheets"](spark, sf)
    assert [tuple(r) for r in found.collect()] == sorted(pairs, key=lambda r: (r[0], r[2] is None, -((r[2] or DAY) - DAY).days, r[1]))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate inline") < plan.index("Sort [c_custkey")


def test_assigned_worksheets_shuffle_no_pairs(spark, tmp_path, monkeypatch):
    """What is shuffled are worksheets, pieces and students, in no part their pairs; more pieces than a join holds as plain rows."""
    monkeypatch.setattr(people, "PIECE", 1)
    customer = [(k, k % 3) for k in range(12)]
    orders = [(k, k % 3, DAY + dt.timedelta(days=k * 7 % 40)) for k in range(4500)]
    sf = kept(
        spark,
        tmp_path,
        customer=(customer, "c_custkey long, c_nationkey int"),
        nation=([(0, "a"), (1, "b"), (2, "c")], "n_nationkey int, n_name string"),
        orders=(orders, "o_orderkey long, o_custkey long, o_orderdate timestamp"),
    )
    spark.sparkContext.setJobGroup(str(tmp_path), "counted")
    try:
        found = run(spark, "assigned_worksheets", sf)
    finally:
        for name in ("spark.jobGroup.id", "spark.job.description"):
            spark.sparkContext.setLocalProperty(name, None)
    assert found == sorted(((c, o, day, "abc"[n]) for c, n in customer for o, k, day in orders if k == n), key=lambda r: (r[0], -(r[2] - DAY).days, r[1]))
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    tracker, store = spark.sparkContext.statusTracker(), spark.sparkContext._jsc.sc().statusStore()
    stages = {k for job in tracker.getJobIdsForGroup(str(tmp_path)) for k in tracker.getJobInfo(job).stageIds}
    assert 0 < sum(store.lastStageAttempt(k).shuffleWriteRecords() for k in stages) <= 2 * len(orders) + len(customer)


def test_unread_notifications_of_a_hot_student(spark, tmp_path):
    """Over 50 unread ones, some of the same time."""
    orders = [(k, k % 10 // 9, "OF"[k % 5 == 0], DAY + dt.timedelta(days=k * 7 % 40)) for k in range(120)]
    sf = kept(
        spark,
        tmp_path,
        customer=([(0,), (1,)], "c_custkey long"),
        orders=(orders, "o_orderkey long, o_custkey long, o_orderstatus string, o_orderdate timestamp"),
    )
    unread = sorted(((c, k, day) for k, c, status, day in orders if status == "O"), key=lambda r: (r[0], -(r[2] - DAY).days, -r[1]))
    assert sum(c == 0 for c, _, _ in unread) > 50
    assert run(spark, "unread_notifications", sf) == unread


def graph(spark, folder):
    """Students and parts of any key, in two books; students have worked on some of the parts, some of them twice."""
    students, parts = list(range(0, 110, 7)), {p: "ab"[p % 9 == 4] for p in range(260) if p not in (5, 60)}
    orders = [(o, students[o % len(students)]) for o in range(200)]
    lines = [(o, (o * 31 + i * i * 17) % 260, float(1 + (o * 7 + i * 13) % 50)) for o, _ in orders for i in range(8)]
    sf = kept(
        spark,
        folder,
        customer=([(k,) for k in students], "c_custkey long"),
        part=(list(parts.items()), "p_partkey long, p_type string"),
        orders=(orders, "o_orderkey long, o_custkey long"),
        lineitem=(lines, "l_orderkey long, l_partkey long, l_quantity double"),
    )
    owner, known = dict(orders), {}
    for o, p, q in lines:
        known[owner[o], p] = max(q / 50, known.get((owner[o], p), 0.0))
    return students, parts, known, sf


def test_learning_gaps_over_all_students_and_parts(spark, tmp_path):
    students, parts, known, sf = graph(spark, tmp_path)
    gaps = [(s, p, p // 2) for s, p in known if p >= 1 and p in parts and p // 2 in parts and known.get((s, p // 2), 0) < 0.7]
    assert sorted(run(spark, "learning_gaps", sf)) == sorted(gaps)


def test_recommend_next_over_all_students_and_parts(spark, tmp_path):
    """No pair of student and topic is made by the query; here all are."""
    students, parts, known, sf = graph(spark, tmp_path)
    needs = lambda p: [p // 2] if p >= 1 and p // 2 in parts and parts[p // 2] == parts[p] else []
    ready = lambda s, p: known.get((s, p), 0) < 0.8 and all(known.get((s, n), 0) >= 0.7 for n in needs(p))
    following = [(s, b, min(p for p in parts if parts[p] == b and ready(s, p))) for s in students for b in "ab"]
    assert sorted(run(spark, "recommend_next", sf)) == following


def test_page_to_topic_of_all_topics_and_pages(spark, tmp_path):
    """Topics of any id, gaps between their ranges with ties, and a book of over 64 pages."""
    starts = {"a": [3, 3, 20, 31, 90, 140], "b": [10, 18], "c": [64]}
    part = [(2 * i + 40 * (b == "b"), b, "x", "n", s) for b, own in starts.items() for i, s in enumerate(own)]
    part = [(k + 100 * (b == "c"), b, c, n, s) for k, b, c, n, s in part]
    sf = kept(spark, tmp_path, part=(part, "p_partkey long, p_type string, p_brand string, p_name string, p_size int"))
    expected = []
    for book in starts:
        own = [(k, s, s + k % 8) for k, b, _, _, s in part if b == book]
        for page in range(max([64, *(end for _, _, end in own)]) + 1):
            held = [k for k, s, e in own if s <= page <= e]
            near = min(own, key=lambda t: (abs(t[1] - page), t[0]))[0]
            expected.append((book, page, held[-1] if held else near, bool(held)))
    assert sorted(run(spark, "page_to_topic_range_join", sf)) == expected


def test_substitute_exercises_in_every_order(spark, tmp_path):
    orders, part = [(k, k % 4) for k in range(25)], [(p, f"part {p}") for p in range(4)]
    sf = kept(spark, tmp_path, orders=(orders, "o_orderkey long, o_custkey long"), part=(part, "p_partkey long, p_name string"))
    own = lambda k: f"part {k}" if k < 4 else f"E_1_2_{k}"
    assert sorted(run(spark, "substitute_exercises", sf)) == [(k, f"Do part {c} then {own(k)} and part {c}.", 2, 1 + (k < 4)) for k, c in orders]


def test_text_cards_of_any_text(spark, tmp_path):
    """Texts with tabs, no text at all, and spaces of several kinds at the cut."""
    head, rest = "x" * 277, "y" * 30
    texts = ["a\tb", None, "", "\t" * 300, head + "\u00a0 " + rest, head + "z\t" + rest, head + "z\n" + rest]
    cards = ["a\tb", "", "", "…", head + "…", head + "z…", head + "z…"]
    sf = kept(spark, tmp_path, documents=([(i, t, "de") for i, t in enumerate(texts)], "doc_id long, text string, lang string"))
    plain = [i != 4 for i in range(len(texts))]
    assert sorted(run(spark, "text_cards", sf)) == list(zip(range(len(texts)), cards, plain, strict=True))


def test_json_repair_keeps_what_stands_around_an_early_fault(spark):
    """Far over 200 commas, brackets and strings after the fault; and cuts inside strings, words and numbers."""
    late = ", ".join(f'{{"k": {i}, "t": "x, y"}}' for i in range(500))
    after = [{"k": i, "t": "x, y"} for i in range(500)]
    known = [
        ('{"a": [{"k": 1}, {"k": 2 "t": 3}, ' + late + "]}", {"a": [{"k": 1}, {"k": 2, "t": 3}, *after]}),
        ("[" + late + " oops", [{"k": i, "t": "x, y"} for i in range(500)]),
        ('{"a": "b\\u12', {"a": "b"}),
        ('{"a": [tru', {"a": []}),
        ('{"a": [1, 2.', {"a": [1]}),
        ('{"a": 1, "b', {"a": 1}),
        ("[[1, 2}, 3]", [[1, 2], 3]),
    ]
    df = spark.createDataFrame([(raw,) for raw, _ in known], "s string")
    assert [json.loads(r[0]) for r in df.select(robust_json(F.col("s"))).collect()] == [value for _, value in known]
