"""Books in several documents: no row holds a whole one, and what is read is what one document would give."""

from __future__ import annotations

import json

import duckdb
import pytest
from pyspark.sql import functions as F

from chalkline.operators import curriculum
from chalkline.operators.curriculum import enrich, fix, nested, nested_whole, validate
from chalkline.operators.lineage import Scratch, settings
from chalkline.operators.writes import write_documents
from chalkline.plans import books, registry
from chalkline.sources.documents import discover, parse_legacy, parse_nested, parse_strict

SF = "/root/testdata/sf0.001"
QUERIES = "array_references import_children import_prerequisites import_strict merge_chunks nest_and_reimport nested_whole_form concat_chunks documents_discovered cross_dependency_union".split()
QUERIES += [f"fix_{x}" for x in "exercises prerequisites report subtopics chapters curriculum edges".split()]
QUERIES += [f"validate_{x}" for x in "chapters quarantine topics".split()] + [f"enrich_{x}" for x in "edges report topics".split()]


@pytest.fixture
def small(monkeypatch):
    """Documents of very few entities."""
    monkeypatch.setattr(books, "TOPICS", 16)
    monkeypatch.setattr(books, "EXERCISES", 512)
    monkeypatch.setattr(books, "CHAPTERS", 4)
    monkeypatch.setattr(books, "STRETCH", 3)


def test_documents_are_bounded(spark, small):
    """A document has no more topics and exercises than its keys; a book was one row before."""
    read = books.raw_books(spark, SF).select("book", "part", F.from_json("document", "entities struct<topics:array<struct<id:string>>,exercises:array<struct<id:string>>>").alias("d"))
    sizes = [(r["book"], r["part"], r["t"] or 0, r["e"] or 0) for r in read.select("book", "part", F.size("d.entities.topics").alias("t"), F.size("d.entities.exercises").alias("e")).collect()]
    assert len({x[:2] for x in sizes}) == len(sizes) > 6 * 13
    assert max(t for _, _, t, _ in sizes) <= 16 and max(e for *_, e in sizes) <= 512


@pytest.mark.parametrize("name", QUERIES)
def test_matches_sql_in_small_documents(spark, small, name):
    con = duckdb.connect()
    for t in ("part", "lineitem"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    found = registry.queries()[name](spark, SF)
    columns = sorted(found.columns)
    want = con.execute(f"select {', '.join(columns)} from ({registry.oracle_sql()[name]})").fetchall()
    assert sorted(map(repr, (tuple(r[c] for c in columns) for r in found.collect()))) == sorted(map(repr, want))


def test_stretches_give_the_same_book(spark):
    topics = [{"id": f"T_{i}", "name": f"t{i}", "chapter_id": f"C_{i % 2}", "exercise_ids": [f"E_{i}"]} for i in range(11)]
    entities = {"chapters": [{"id": f"C_{k}", "number": 3 - k, "title": f"c{k}"} for k in range(3)], "topics": topics, "exercises": [{"id": f"E_{i}", "text": f"x{i}", "topic_id": f"T_{i}"} for i in range(11)]}
    c = parse_strict(spark.createDataFrame([("b", json.dumps({"entities": entities}))], "book string, document string"))
    for write, parse in ((nested, parse_legacy), (nested_whole, parse_nested)):
        text = F.to_json(F.struct("chapters")).alias("document")
        whole, cut = parse(write(c).select("book", text)), parse(write(c, 2).select("book", "first_chapter", "first_topic", text))
        for part in ("chapters", "topics", "exercises"):
            seen = [sorted(map(repr, (tuple(r) for r in getattr(x, part).collect()))) for x in (whole, cut)]
            assert seen[0] == seen[1] and seen[0]


def test_few_partitions_hold_bounded_lists(spark, monkeypatch):
    """Lists are made in tasks of SHARE exercises, however few partitions shuffles have; each of these held a part of all before, and failed at 1 GB."""
    topics = [{"id": f"T_{i}", "name": f"t{i}", "chapter_id": f"C_{i % 2}"} for i in range(12)]
    exercises = [{"id": f"E_{i}", "text": f"x{i}", "topic_id": f"T_{i % 12}"} for i in range(60)]
    entities = {"chapters": [{"id": f"C_{k}", "number": k, "title": f"c{k}"} for k in range(2)], "topics": topics, "exercises": exercises}
    c = parse_strict(spark.createDataFrame([("b", json.dumps({"entities": entities}))], "book string, document string"))
    seen = lambda df: sorted(map(repr, (tuple(r) for r in df.collect())))
    monkeypatch.setattr(curriculum, "SHARE", 1 << 17)
    with settings(spark, {"spark.sql.shuffle.partitions": "2"}):
        want = seen(nested(c, 3))
        plans, repartition = [], type(c.topics).repartition
        monkeypatch.setattr(type(c.topics), "repartition", lambda self, n, *keys: (plans.append((n, keys)), repartition(self, n, *keys))[1])
        monkeypatch.setattr(curriculum, "SHARE", 7)
        assert seen(nested(c, 3)) == want and len(want) == 4
    assert plans == [(9, ("book", "topic_id")), (9, ("book", "chapter_id", "_piece"))]


@pytest.mark.parametrize("step", [fix, enrich, validate])
def test_exercises_are_written_by_no_step(spark, step, monkeypatch):
    """The largest list is read where a result asks for it; each step wrote it once more before."""
    names, keep = [], Scratch.keep
    monkeypatch.setattr(Scratch, "keep", lambda self, df, name: (names.append(name), keep(self, df, name))[1])
    entities = {
        "chapters": [{"id": "C_1", "title": "c", "page_start": 1, "page_end": 9}],
        "topics": [{"id": "T_1", "name": "water", "chapter_id": "C_1", "page_start": 2, "page_end": 3}],
        "exercises": [{"id": "E_9", "text": "x", "topic_id": "T_1"}],
    }
    c = parse_strict(spark.createDataFrame([("b", json.dumps({"entities": entities}))], "book string, document string"), Scratch(spark, "books"))
    done = step(c)
    done = done.curriculum if step is validate else done[0]
    assert "topics" in names and "documents" in names and "exercises" not in names
    assert [r["text"] for r in done.exercises.collect()] == ["x"]


def test_files_of_parts(spark, tmp_path):
    """A later write with fewer parts leaves none of the earlier ones."""
    rows = spark.createDataFrame([("a", 0, "0"), ("a", 2, "2"), ("a", 11, "11"), ("b", 4, "4")], "book string, part long, document string")
    read = lambda: sorted((r["book"], r["part"], r["document"].strip()) for r in discover(spark, str(tmp_path)).collect())
    write_documents(rows, str(tmp_path), "book")
    assert read() == [("a", 0, "0"), ("a", 2, "2"), ("a", 11, "11"), ("b", 4, "4")]
    write_documents(rows.where("part = 2"), str(tmp_path), "book")
    assert read() == [("a", 2, "2"), ("b", 4, "4")]
    write_documents(rows.where("part = 11").drop("part"), str(tmp_path), "book")
    assert read() == [("a", 0, "11"), ("b", 4, "4")]
