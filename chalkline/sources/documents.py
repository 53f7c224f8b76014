"""Curriculum documents, in the form with separate entities and in the nested one.

``raw`` frames have a book and its document as JSON text. Readers flatten a
document into entity frames that carry the book and ``doc_pos``, the place of
the entity in its list, given once here by posexplode.

A book may come in many documents. Those of the separate form have a number,
``part``: a list goes on in the next part. Those of the nested form tell where
they begin: ``first_chapter`` is the place of their first chapter, and
``first_topic`` that of its first topic, both from 0. So no book has to fit
into a row.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chalkline.operators.lineage import Scratch

STRICT = """struct<
entities:struct<
  chapters:array<struct<id:string,number:int,title:string,page_start:int,page_end:int>>,
  topics:array<struct<id:string,name:string,summary:string,chapter_id:string,page_start:int,page_end:int,prerequisites:array<string>,exercise_ids:array<string>,sidebar_ids:array<string>>>,
  subtopics:array<struct<id:string,name:string,summary:string,topic_id:string,page_start:int,page_end:int>>,
  exercises:array<struct<id:string,text:string,summary:string,topic_id:string,page:int>>,
  sidebars:array<struct<id:string,text:string,topic_id:string,chapter_id:string,page:int>>>,
graphs:struct<
  chapter_structure:array<struct<from:string,to:string,type:string>>,
  exercise_mapping:array<struct<from:string,to:string,type:string>>,
  concept_dependencies:array<struct<from:string,to:string,type:string>>>>"""
LEGACY = "struct<chapters:array<struct<chapter_name:string,topics:array<struct<topic_name:string,summary:string,prerequisites:array<string>,exercises:array<string>>>>>>"
_BOX = "array<struct<text:string,page:int>>"
NESTED = f"""struct<chapters:array<struct<chapter_number:int,chapter_title:string,page_start:int,page_end:int,
topics:array<struct<topic_name:string,concept_summary:string,page_start:int,page_end:int,
subtopics:array<struct<subtopic_name:string,summary:string,page_start:int,page_end:int>>,
prerequisites:array<string>,original_exercises:{_BOX},details_and_sidebars:{_BOX}>>>>>"""
#: Places that a part of a book has; a list of more doesn't fit into a row.
PLACES = 1 << 28
GRAPHS = ("chapter_structure", "exercise_mapping", "concept_dependencies")


@dataclass(frozen=True)
class Curriculum:
    """Entity frames of any number of books; ``edges`` holds all three graphs, named by its column ``graph``."""

    chapters: DataFrame
    topics: DataFrame
    subtopics: DataFrame
    exercises: DataFrame
    sidebars: DataFrame
    edges: DataFrame

    def but(self, **frames: DataFrame) -> Curriculum:
        return replace(self, **frames)


def read_raw(spark: SparkSession, path: str) -> DataFrame:
    """(book, document) of JSON files; a book is named by its folder."""
    files = spark.read.text(path, wholetext=True, recursiveFileLookup=True)
    return files.select(F.element_at(F.split("_metadata.file_path", "/"), -2).alias("book"), F.col("value").alias("document"))


def read_stems(spark: SparkSession, path: str) -> DataFrame:
    """(book, document) of the JSON files in a folder; a book is named by its file, without the ending."""
    files = spark.read.option("pathGlobFilter", "*.json").text(path, wholetext=True)
    return files.select(F.regexp_replace("_metadata.file_name", r"\.json$", "").alias("book"), F.col("value").alias("document"))


def discover(spark: SparkSession, path: str, name: str = "ontology.json") -> DataFrame:
    """(book, part, document) of ``*/name``, and of ``*/*/name`` in folders that have none of their own; a book is named by its folder.

    Further parts of a book lie beside its first, with the part's number before the file's ending.
    """
    stem, dot, ending = name.rpartition(".")
    files = f"{{{name},{stem}.*{dot}{ending}}}"
    folder = lambda depth: f"{path}/{'/'.join(['*'] * depth)}/{files}"
    read = lambda depth: spark.read.option("pathGlobFilter", files).text(folder(depth), wholetext=True)
    step = lambda i: F.element_at(F.split("_metadata.file_path", "/"), i)
    number = F.regexp_extract("_metadata.file_name", rf"\.(-?\d+)\.{re.escape(ending)}$", 1)
    own = (F.col("_metadata.file_name") == name) | (number != "")
    part = F.when(F.col("_metadata.file_name") == name, 0).otherwise(number.try_cast("long"))
    levels = [(1, -2), (2, -3)]
    found = [read(depth).where(own).select(step(top).alias("top"), step(-2).alias("book"), part.alias("part"), F.col("value").alias("document")) for depth, top in levels if _any(spark, folder(depth))]
    if not found:
        return spark.createDataFrame([], "book string, part long, document string")
    if len(found) == 1:
        return found[0].drop("top")
    one, two = found
    return one.unionByName(two.join(one.select("top").distinct(), "top", "left_anti")).drop("top")


def _any(spark: SparkSession, glob: str) -> bool:
    """Whether files match; asked of the file system that the path names."""
    where = spark._jvm.org.apache.hadoop.fs.Path(glob)
    return bool(where.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(where))


def first_source(sources: list[DataFrame], key: str) -> DataFrame:
    """Rows by ``key`` from the first of the sources that has it, with ``priority`` (0 for the first)."""
    whole = None
    for i, one in enumerate(sources):
        one = one.withColumn("priority", F.lit(i))
        whole = one if whole is None else whole.unionByName(one, allowMissingColumns=True)
    best = whole.groupBy(key).agg(F.min("priority").alias("priority"))
    return whole.join(best, [key, "priority"])


def parse_strict(raw: DataFrame, scratch: Scratch | None = None) -> Curriculum:
    """Entities and the edges of the three graphs; missing lists are empty.

    Each frame parses the documents for itself, which suits readers of one or
    two. With ``scratch`` they are parsed once, into a working table with the
    lists nested, of which a frame reads the columns of its own list.
    """
    part = ["part"] if "part" in raw.columns else []
    read = raw.select("book", *part, F.from_json("document", STRICT.replace("\n", "")).alias("d"))
    if scratch is not None:
        read = scratch.keep(read, "documents")
    place = F.coalesce(F.col("part").cast("long"), F.lit(0)) * PLACES + F.col("_pos") if part else F.col("_pos")
    rows = lambda path: read.select("book", *part, F.posexplode(F.col(path)).alias("_pos", "e")).select("book", place.alias("doc_pos"), "e.*")
    edges = None
    for graph in GRAPHS:
        own = rows(f"d.graphs.{graph}").select("book", "doc_pos", F.lit(graph).alias("graph"), F.col("from").alias("child"), F.col("to").alias("parent"), F.col("type").alias("kind"))
        edges = own if edges is None else edges.unionByName(own)
    return Curriculum(*[rows(f"d.entities.{e}") for e in ("chapters", "topics", "subtopics", "exercises", "sidebars")], edges)


def _chapters(raw: DataFrame, form: str) -> DataFrame:
    """(book, doc_pos, n, c, _from) of nested documents: a chapter's place, from 1 in ``n``, and the place of its first topic here."""
    told = "first_chapter" in raw.columns
    at = lambda name: F.coalesce(F.col(name).cast("int"), F.lit(0)) if told else F.lit(0)
    read = raw.select("book", at("first_chapter").alias("_chapter"), at("first_topic").alias("_topic"), F.from_json("document", form.replace("\n", "")).alias("d"))
    flat = read.select("book", "_chapter", "_topic", F.posexplode("d.chapters").alias("_pos", "c"))
    n = F.col("_chapter") + F.col("_pos")
    return flat.select("book", n.alias("doc_pos"), (n + 1).alias("n"), "c", F.when(F.col("_pos") == 0, F.col("_topic")).otherwise(0).alias("_from"))


def parse_legacy(raw: DataFrame) -> Curriculum:
    """The nested form; ids are made of places: C_n, T_n_p, E_n_p_q."""
    chapters = _chapters(raw, LEGACY)
    flat = chapters.select("book", "n", "_from", F.posexplode("c.topics").alias("_pos", "t")).withColumn("doc_pos", F.col("_from") + F.col("_pos"))
    topic_id = F.concat_ws("_", F.lit("T"), F.col("n").cast("string"), (F.col("doc_pos") + 1).cast("string"))
    chapter_id = lambda n: F.concat(F.lit("C_"), n.cast("string"))
    topics = flat.select(
        "book", "doc_pos", topic_id.alias("id"), F.col("t.topic_name").alias("name"), "t.summary", chapter_id(F.col("n")).alias("chapter_id"),
        F.lit(None).cast("int").alias("page_start"), F.lit(None).cast("int").alias("page_end"), "t.prerequisites", F.col("t.exercises").alias("texts"),
    )
    exercises = topics.select("book", F.col("id").alias("topic_id"), F.posexplode("texts").alias("doc_pos", "text")).select(
        "book", "doc_pos", F.concat_ws("_", F.regexp_replace("topic_id", "^T", "E"), (F.col("doc_pos") + 1).cast("string")).alias("id"), "text", "topic_id"
    )
    edges = topics.select("book", F.col("name").alias("child"), F.posexplode("prerequisites").alias("doc_pos", "parent")).withColumns(
        {"kind": F.lit("prerequisite"), "graph": F.lit("concept_dependencies")}
    )
    named = chapters.where("_from = 0").select("book", "doc_pos", chapter_id(F.col("n")).alias("id"), F.col("n").alias("number"), F.col("c.chapter_name").alias("title"))
    none = exercises.limit(0).select("book", "doc_pos", "id", "text", "topic_id")
    return Curriculum(named, topics.drop("texts"), none.withColumnRenamed("text", "name"), exercises, none, edges)


def parse_nested(raw: DataFrame) -> Curriculum:
    """The nested form with all that topics hold; ids are made of places: C_n, T_n_p, ST_, E_ and S_n_p_q, and arrays name them."""
    chapters = _chapters(raw, NESTED)
    id_ = lambda prefix, *places: F.concat_ws("_", F.lit(prefix), *[F.col(p).cast("string") for p in places])
    flat = chapters.select("book", "n", "_from", F.posexplode("c.topics").alias("_p", "t")).withColumn("p", F.col("_from") + F.col("_p") + 1)
    ids = lambda prefix, column: F.transform(column, lambda x, i: F.concat_ws("_", F.lit(prefix), F.col("n").cast("string"), F.col("p").cast("string"), (i + 1).cast("string")))
    topics = flat.select(
        "book", (F.col("n") * (1 << 32) + F.col("p")).alias("doc_pos"), id_("T", "n", "p").alias("id"), F.col("t.topic_name").alias("name"), F.col("t.concept_summary").alias("summary"),
        id_("C", "n").alias("chapter_id"), "t.page_start", "t.page_end", "t.prerequisites", ids("E", "t.original_exercises").alias("exercise_ids"), ids("S", "t.details_and_sidebars").alias("sidebar_ids"),
    )
    below = lambda column: flat.select("book", "n", "p", id_("T", "n", "p").alias("topic_id"), F.posexplode(column).alias("doc_pos", "x")).withColumn("q", F.col("doc_pos") + 1)
    texts = lambda prefix, column: below(column).select("book", "doc_pos", id_(prefix, "n", "p", "q").alias("id"), "x.text", "topic_id", "x.page")
    subtopics = below("t.subtopics").select("book", "doc_pos", id_("ST", "n", "p", "q").alias("id"), F.col("x.subtopic_name").alias("name"), "x.summary", "topic_id", "x.page_start", "x.page_end")
    edges = topics.select("book", F.col("id").alias("child"), F.posexplode("prerequisites").alias("doc_pos", "parent")).withColumns({"kind": F.lit("prerequisite"), "graph": F.lit("concept_dependencies")})
    named = chapters.where("_from = 0").select("book", "doc_pos", id_("C", "n").alias("id"), F.col("c.chapter_number").alias("number"), F.col("c.chapter_title").alias("title"), "c.page_start", "c.page_end")
    sidebars = texts("S", "t.details_and_sidebars").withColumn("chapter_id", F.lit(None).cast("string"))
    return Curriculum(named, topics, subtopics, texts("E", "t.original_exercises"), sidebars, edges)


def imported(c: Curriculum) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(topics, children, prerequisites) as an import takes them.

    Topics of unknown chapters are skipped, blank texts of exercises and side
    boxes too; prerequisites are resolved by id, else by the last topic of that
    name, and go where neither is known. Topics get their place in the chapter.
    """
    live = c.chapters.select("book", F.col("id").alias("chapter_id")).distinct()
    place = F.row_number().over(W.partitionBy("book", "chapter_id").orderBy("doc_pos")) - 1
    topics = c.topics.withColumn("position", place).join(live, ["book", "chapter_id"], "left_semi")
    ids = topics.select("book", "id").distinct()
    texts = c.exercises.select("book", "topic_id", "doc_pos", "text", F.lit("exercise").alias("kind")).unionByName(
        c.sidebars.select("book", "topic_id", "doc_pos", "text", F.lit("sidebar").alias("kind"))
    )
    children = texts.where(F.regexp_replace(F.coalesce("text", F.lit("")), r"(?U)\s", "") != "").join(ids.withColumnRenamed("id", "topic_id"), ["book", "topic_id"], "left_semi")
    refs = topics.select("book", F.col("id").alias("topic_id"), F.posexplode("prerequisites").alias("pos", "ref"))
    by_id = ids.select("book", F.col("id").alias("ref"), F.col("id").alias("_i"))
    by_name = topics.groupBy("book", F.col("name").alias("ref")).agg(F.max_by("id", "doc_pos").alias("_n"))
    found = refs.join(by_id, ["book", "ref"], "left").join(by_name, ["book", "ref"], "left").withColumn("prerequisite_id", F.coalesce("_i", "_n"))
    return topics, children, found.where("prerequisite_id IS NOT NULL").select("book", "topic_id", "pos", "prerequisite_id")
