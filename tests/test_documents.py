"""Curriculum documents with known results."""

from __future__ import annotations

import json

from chalkline.operators.curriculum import clamped, fix, merge_chunks, nested
from chalkline.sources.documents import parse_legacy, parse_strict, read_raw


def strict(topics, exercises=(), deps=(), chapters=({"id": "C_1", "number": 1, "title": "One", "page_start": 1, "page_end": 9},)):
    graphs = {"concept_dependencies": [{"from": a, "to": b, "type": "prerequisite"} for a, b in deps]}
    return json.dumps({"entities": {"chapters": list(chapters), "topics": topics, "exercises": list(exercises), "sidebars": []}, "graphs": graphs})


def topic(id_, name, chapter="C_1", start=1, end=2):
    return {"id": id_, "name": name, "summary": "s", "chapter_id": chapter, "page_start": start, "page_end": end}


def frame(spark, *documents):
    return [parse_strict(spark.createDataFrame([("b", d)], "book string, document string")) for d in documents]


def test_merge_of_two_chunks(spark):
    one = strict([topic("T_1_1", "A")], [{"id": "E_1_1_1", "text": "x", "topic_id": "T_1_1"}])
    two = strict([topic("T_1_2", "B"), topic("T_1_3", " a ")], [{"id": "E_1_2_1", "text": "y", "topic_id": "T_1_2"}], [("T_1_2", "T_1_1")])
    merged = merge_chunks(frame(spark, one, two))
    assert sorted(r["id"] for r in merged.topics.collect()) == ["T_1_1", "T_1_2"]
    assert (merged.exercises.count(), merged.edges.count(), merged.chapters.count()) == (2, 1, 1)
    book = nested(merged).first()
    assert len(book["chapters"]) == 1 and [t["topic_name"] for t in book["chapters"][0]["topics"]] == ["A", "B"]


def test_fix(spark):
    """The late chapter is inverted, so it holds no page when the orphan looks for one."""
    chapters = [{"id": "X", "number": 1, "title": "Late", "page_start": 20, "page_end": 12}, {"id": "C_1", "number": 2, "title": "Early", "page_start": 1, "page_end": 9}]
    topics = [topic("T_a", "Birds", "C_1", 3, 4), topic("T_b", "birds", "C_1", 5, 6), topic("T_c", "Trees", "gone", 14, 15), topic("T_d", "no content found", "C_1"), topic("T_e", "2. Birds (x)", "C_1", 3, 4)]
    exercises = [{"id": "E1", "text": "x", "topic_id": "T_a"}, {"id": "E2", "text": "y", "topic_id": "T_d"}, {"id": "E3", "text": "z", "topic_id": "T_b"}]
    (c,) = frame(spark, strict(topics, exercises, [("T_c", "T_a"), ("T_a", "T_a"), ("T_a", "T_d"), ("T_b", "T_a")], chapters))
    fixed, report = fix(c)
    assert sorted((r["id"], r["chapter_id"], r["name"]) for r in fixed.topics.collect()) == [("T_1_1", "C_1", "Birds"), ("T_1_4", "C_1", "Trees")]
    assert [(r["id"], r["topic_id"]) for r in fixed.exercises.collect()] == [("E_1_1_1", "T_1_1")]
    assert sorted((r["child"], r["parent"]) for r in fixed.edges.collect()) == [("T_1_1", "T_d"), ("T_1_3", "T_1_1"), ("T_1_4", "T_1_1")]
    assert sorted((r["id"], r["title"], r["page_start"]) for r in fixed.chapters.collect()) == [("C_1", "Early", 1), ("C_2", "Late", 12)]
    want = {"garbage_removed": 1, "orphans_reassigned": 1, "inverted_fixed": 1, "chapters_renumbered": 1, "topics_renumbered": 4, "duplicates_removed": 1, "semantic_dupes_removed": 1, "dangling_dropped": 1}
    assert {r["change"]: r["n"] for r in report.collect()} == want
    # The orphan's page lies behind the chapter that was nearest to it.
    assert [(r["id"], r["page_start"], r["page_end"]) for r in clamped(fixed).topics.where("violated").collect()] == [("T_1_4", 1, 9)]


def test_legacy_files(spark, tmp_path):
    (tmp_path / "grade1").mkdir()
    text = json.dumps({"chapters": [{"chapter_name": "C", "topics": [{"topic_name": "Basics", "prerequisites": []}, {"topic_name": "Advanced", "prerequisites": ["Basics"], "exercises": ["q"]}]}]})
    (tmp_path / "grade1" / "book.json").write_text(text)
    c = parse_legacy(read_raw(spark, str(tmp_path)))
    assert sorted((r["book"], r["id"]) for r in c.topics.collect()) == [("grade1", "T_1_1"), ("grade1", "T_1_2")]
    assert [(r["child"], r["parent"]) for r in c.edges.collect()] == [("Advanced", "Basics")]
    assert [(r["id"], r["text"]) for r in c.exercises.collect()] == [("E_1_2_1", "q")]
