"""Payloads of lesson plans, worksheets and notifications: projections, repairs, recursion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chalkline.functions.payload import (
    collect_keys,
    questions_type,
    quiz_defaults,
    recovery_questions,
    replace_ids,
    spread,
    strip_keys,
    valid_questions,
    with_lesson_info,
    without_images,
)
from chalkline.functions.text import xml_elements
from chalkline.plans.registry import register
from chalkline.sources.tables import table


def _text(*parts: str | Column) -> Column:
    """Texts and columns one after another."""
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


K = F.col


@register(
    "spread_payload",
    """SELECT event_id AS id, CASE WHEN event_id % 3 = 0 THEN 'override' ELSE event_type END AS type, CASE WHEN event_id % 3 = 1 THEN NULL ELSE 'event ' || user_id END AS message,
       CAST(json_extract(props, '$.k') AS VARCHAR) AS k FROM events""",
)
def spread_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notifications with the keys of their payload beside their own; the payload overrides, by null as well."""
    rows = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k")
    more = F.when(K("event_id") % 3 == 0, ', "type": "override"').when(K("event_id") % 3 == 1, ', "message": null').otherwise("")
    rows = rows.withColumn("payload", _text('{"k": ', k, more, "}"))
    own = {"type": K("event_type"), "message": _text("event ", K("user_id")), "k": F.lit(None).cast("string")}
    return rows.select(K("event_id").alias("id"), *[v.alias(c) for c, v in spread(K("payload"), own).items()])


@register(
    "drop_fixed_path",
    """SELECT l_orderkey AS worksheet, '[' || string_agg('{"title":"Section ' || l_linenumber || '","questions":[{"number":' || l_linenumber || '}]}', ',' ORDER BY l_linenumber, l_partkey, l_suppkey) || ']' AS sections
       FROM lineitem GROUP BY l_orderkey""",
)
def drop_fixed_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Worksheets without the images at sections[].questions[].image_data."""
    question = F.struct(K("l_linenumber").alias("number"), F.lit("iVBORw0KGgo").alias("image_data"))
    section = F.struct("l_linenumber", "l_partkey", "l_suppkey", F.struct(_text("Section ", K("l_linenumber")).alias("title"), F.array(question).alias("questions")).alias("s"))
    sheets = table(spark, sf_dir, "lineitem").groupBy(K("l_orderkey").alias("worksheet")).agg(F.transform(F.array_sort(F.collect_list(section)), lambda x: x["s"]).alias("sections"))
    return sheets.select("worksheet", F.to_json(without_images(K("sections"))).alias("sections"))


@register(
    "strip_image_data",
    """SELECT p_partkey AS id, CASE WHEN p_partkey % 2 = 0 THEN '{"title":"' || p_name || '","pages":[{"n":1,"deep":[[{"keep":2.5}]]},"x"]}' ELSE '{"title": "' || p_name || '"}' END AS document FROM part""",
)
def strip_image_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Open JSON without any key that ends in image_data, however deep; what holds none stays as it is."""
    name = K("p_name")
    deep = _text('{"title": "', name, '", "image_data": "x", "pages": [{"n": 1, "cover_image_data": {"a": 1}, "deep": [[{"keep": 2.5, "image_data": null}]]}, "x"]}')
    raw = F.when(K("p_partkey") % 2 == 0, deep).otherwise(_text('{"title": "', name, '"}'))
    return table(spark, sf_dir, "part").select(K("p_partkey").alias("id"), strip_keys(raw).alias("document"))


@register(
    "collect_image_prompts",
    """SELECT p_partkey AS id, unnest(['image_prompt', 'pages[0].cover_image_prompt', 'pages[1].parts[0].image_prompt']) AS path, unnest(['a ' || p_name, 'cover ' || p_size, 'deep']) AS value FROM part WHERE p_partkey % 2 = 0""",
)
def collect_image_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompts under keys that end in image_prompt, with their paths; blank and other values don't count."""
    deep = _text(
        '{"image_prompt": "a ', K("p_name"), '", "pages": [{"cover_image_prompt": "cover ', K("p_size"), '", "image_prompt": "  "}, {"parts": [{"image_prompt": "deep"}], "image_prompt": ["no"]}], "n": 1}'
    )
    raw = F.when(K("p_partkey") % 2 == 0, deep).otherwise(F.lit('{"n": 1}'))
    found = table(spark, sf_dir, "part").select(K("p_partkey").alias("id"), F.explode(collect_keys(raw)).alias("x"))
    return found.select("id", "x.path", "x.value")


@register(
    "substitute_in_json",
    """SELECT o_orderkey AS plan, '{"steps":["Do ' || coalesce(p_name, 'E_1_1_' || o_custkey) || '",{"E_1_1_1":"E_1_2"}],"n":1}' AS document FROM orders LEFT JOIN part ON p_partkey = o_custkey""",
)
def substitute_in_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exercise ids in the strings of nested plans replaced by their texts; keys, and what is no id, stay."""
    ident = _text("E_1_1_", K("o_custkey"))
    plans = table(spark, sf_dir, "orders").select(K("o_orderkey").alias("plan"), K("o_custkey").alias("p_partkey"), _text('{"steps": ["Do ', ident, '", {"E_1_1_1": "E_1_2"}], "n": 1}').alias("document"))
    known = table(spark, sf_dir, "part").select("p_partkey", F.to_json(F.create_map(_text("E_1_1_", K("p_partkey")), K("p_name"))).alias("lookup"))
    return plans.join(known, "p_partkey", "left").select("plan", replace_ids("document", F.coalesce("lookup", F.lit("{}"))).alias("document"))


@register(
    "normalised_lesson_plans",
    """SELECT p_partkey AS id, CASE p_partkey % 3 WHEN 0 THEN 'lecture' ELSE 'activity' END AS lesson_type, CASE WHEN p_partkey % 2 = 0 THEN 'Top' ELSE 'Inner' END AS subject,
       CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE '3' END AS grade, p_name AS topic, CAST(p_size AS VARCHAR) AS duration_minutes FROM part""",
)
def normalised_lesson_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lesson plans with a type, and lesson_info's fields at the top where it lacks them; a null at the top stays."""
    kind = F.when(K("p_partkey") % 3 == 0, '"lesson_type": "lecture", ').when(K("p_partkey") % 3 == 1, '"lesson_type": "", ').otherwise("")
    top = F.when(K("p_partkey") % 2 == 0, '"subject": "Top", ').otherwise("")
    grade = F.when(K("p_partkey") % 5 == 0, '"grade": null, ').otherwise("")
    raw = _text("{", kind, top, grade, '"lesson_info": {"subject": "Inner", "grade": "3", "topic": "', K("p_name"), '", "duration_minutes": ', K("p_size"), "}}")
    rows = table(spark, sf_dir, "part").select(K("p_partkey").alias("id"), raw.alias("plan"))
    return rows.select("id", *[v.alias(c) for c, v in with_lesson_info(K("plan")).items()])


def worksheet_context(plan: Column) -> Column:
    """What a worksheet's prompt takes of a plan (struct): 400 characters of the concept, 3 examples, 200 of each task, 5 questions."""
    text = lambda x, n: F.substring(F.coalesce(x, F.lit("")), 1, n)
    listed = lambda x, n: F.slice(F.coalesce(x, F.array().cast("array<string>")), 1, n)
    return F.struct(
        F.coalesce(plan["lesson_title"], F.lit("Topic")).alias("title"),
        text(plan["explain"]["concept_explanation"], 400).alias("concept"),
        listed(plan["explain"]["examples"], 3).alias("key_examples"),
        text(plan["elaborate"]["task_1"], 200).alias("guided_task"),
        listed(F.transform(plan["evaluate"]["questions"], lambda q: F.coalesce(q, F.lit(""))), 5).alias("sample_questions"),
    )


@register(
    "worksheet_contexts",
    """SELECT doc_id, coalesce(lang, 'Topic') AS title, left(coalesce(text, ''), 400) AS concept, len(string_split(coalesce(text, ''), ' ')[1:3]) AS examples, left(coalesce(source, ''), 200) AS guided,
       array_to_string(string_split(coalesce(text, ''), ' ')[1:5], '|') AS questions FROM documents""",
)
def worksheet_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.split(F.coalesce("text", F.lit("")), " ")
    plan = F.struct(
        K("lang").alias("lesson_title"),
        F.struct(K("text").alias("concept_explanation"), words.alias("examples")).alias("explain"),
        F.struct(K("source").alias("task_1")).alias("elaborate"),
        F.struct(words.alias("questions")).alias("evaluate"),
    )
    found = table(spark, sf_dir, "documents").select("doc_id", plan.alias("plan")).select("doc_id", worksheet_context(K("plan")).alias("c"))
    return found.select(
        "doc_id", K("c.title").alias("title"), K("c.concept").alias("concept"), F.size("c.key_examples").cast("long").alias("examples"), K("c.guided_task").alias("guided"), F.array_join("c.sample_questions", "|").alias("questions")
    )


@register(
    "topic_contexts",
    """WITH e AS (SELECT l_partkey AS topic_id, list('E_' || (l_orderkey * 8 + l_linenumber) ORDER BY l_orderkey * 8 + l_linenumber)[1:10] AS ids FROM lineitem GROUP BY l_partkey),
       s AS (SELECT ps AS topic_id, list(doc_id ORDER BY doc_id)[1:5] AS boxes FROM (SELECT doc_id, doc_id % 40 AS ps FROM documents) GROUP BY ps)
       SELECT p_partkey AS topic_id, array_to_string(ids, ',') AS exercises, array_to_string(boxes, ',') AS sidebars FROM part LEFT JOIN e ON e.topic_id = p_partkey LEFT JOIN s ON s.topic_id = p_partkey""",
)
def topic_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Topics with their first ten exercises and first five side boxes, in document order."""
    key = K("l_orderkey") * 8 + K("l_linenumber")
    first = lambda df, by, order, n: first_listed(df, [by], order, n)
    exercises = first(table(spark, sf_dir, "lineitem").select(K("l_partkey").alias("topic_id"), key.alias("k")), "topic_id", "k", 10)
    boxes = first(table(spark, sf_dir, "documents").select((K("doc_id") % 40).alias("topic_id"), K("doc_id").alias("k")), "topic_id", "k", 5)
    topics = table(spark, sf_dir, "part").select(K("p_partkey").alias("topic_id")).join(exercises.withColumnRenamed("listed", "e"), "topic_id", "left").join(boxes.withColumnRenamed("listed", "s"), "topic_id", "left")
    return topics.select("topic_id", F.array_join(F.transform("e", lambda x: _text("E_", x)), ",").alias("exercises"), F.array_join(K("s").cast("array<string>"), ",").alias("sidebars"))


def first_listed(df: DataFrame, keys: list[str], order: str, n: int) -> DataFrame:
    """(keys, listed): the first n values of each key; only those are gathered."""
    ranked = df.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy(order))).where(K("_n") <= n)
    return ranked.groupBy(*keys).agg(F.array_sort(F.collect_list(order)).alias("listed"))


@register(
    "positional_lookup",
    """WITH t AS (SELECT p_type AS book, dense_rank() OVER (PARTITION BY p_type ORDER BY p_brand) - 1 AS i, row_number() OVER (PARTITION BY p_type, p_brand ORDER BY p_partkey) - 1 AS j, p_partkey AS topic FROM part),
       a AS (SELECT o_orderkey AS ask, (SELECT min(p_type) FROM part) AS book, o_orderkey % 30 AS i, o_custkey % 20 AS j FROM orders)
       SELECT ask, topic FROM a LEFT JOIN t USING (book, i, j)""",
)
def positional_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Topic j of chapter i of a book, by places from 0; none where a place is out of range."""
    parts = table(spark, sf_dir, "part")
    place = F.dense_rank().over(W.partitionBy("p_type").orderBy("p_brand")) - 1
    inner = F.row_number().over(W.partitionBy("p_type", "p_brand").orderBy("p_partkey")) - 1
    topics = parts.select(K("p_type").alias("book"), place.cast("long").alias("i"), inner.cast("long").alias("j"), K("p_partkey").alias("topic"))
    book = parts.agg(F.min("p_type").alias("book"))
    asks = table(spark, sf_dir, "orders").select(K("o_orderkey").alias("ask"), (K("o_orderkey") % 30).alias("i"), (K("o_custkey") % 20).alias("j")).crossJoin(F.broadcast(book))  # one row
    return asks.join(topics, ["book", "i", "j"], "left").select("ask", "topic")


# --- worksheets and quizzes -----------------------------------------------------------------------------------------

_QUESTION = "struct<number:int,type:string,question:string,options:array<string>,answer:string,correct_answer:string,bloom_level:string,difficulty_tag:string>"


@register(
    "worksheet_repair",
    """WITH q AS (SELECT l_orderkey AS worksheet, l_linenumber AS number, CASE l_linenumber % 4 WHEN 0 THEN ' . ' WHEN 1 THEN 'a' ELSE 'What is ' || l_partkey || '?' END AS question,
         CASE WHEN l_suppkey % 5 = 0 THEN '' WHEN l_suppkey % 7 = 0 THEN NULL ELSE 'x' END AS answer, CASE WHEN l_partkey % 2 = 0 THEN 'apply' END AS bloom FROM lineitem)
       SELECT worksheet, count(*) AS n, CAST(count(*) * (worksheet % 3 + 1) AS BIGINT) AS total_marks, count(*) FILTER (coalesce(bloom, 'remember') = 'remember') AS remembered
       FROM q WHERE length(regexp_replace(question, '[^a-zA-Z0-9]', '', 'g')) >= 2 AND answer <> '' GROUP BY worksheet""",
)
def worksheet_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Worksheets with sound questions only and their marks counted anew; one without any is an error and goes."""
    n = K("l_linenumber") % 4
    question = F.when(n == 0, " . ").when(n == 1, "a").otherwise(_text("What is ", K("l_partkey"), "?"))
    answer = F.when(K("l_suppkey") % 5 == 0, "").when(K("l_suppkey") % 7 != 0, "x")
    q = F.struct(K("l_linenumber").alias("number"), question.alias("question"), answer.alias("answer"), F.when(K("l_partkey") % 2 == 0, "apply").alias("bloom_level"), F.lit("").alias("difficulty_tag"))
    sheets = table(spark, sf_dir, "lineitem").groupBy(K("l_orderkey").alias("worksheet")).agg(F.collect_list(q).alias("questions"))
    sound = sheets.withColumn("q", valid_questions(K("questions"))).where(F.size("q") > 0)
    marks = F.size("q") * (K("worksheet") % 3 + 1)
    remembered = F.size(F.filter("q", lambda x: (x["bloom_level"] == "remember") & (x["difficulty_tag"] == "medium")))
    return sound.select("worksheet", F.size("q").cast("long").alias("n"), marks.cast("long").alias("total_marks"), remembered.cast("long").alias("remembered"))


@register(
    "recovery_repair",
    """WITH q AS (SELECT l_orderkey AS worksheet, l_linenumber AS place, l_partkey AS p, l_suppkey AS s, CASE WHEN l_linenumber % 5 = 0 THEN ' ' ELSE 'q' END AS question, CASE WHEN l_suppkey % 3 = 0 THEN 'short' WHEN l_suppkey % 3 = 1 THEN 'mcq' END AS kind,
         l_partkey % 4 AS options, CASE l_partkey % 5 WHEN 0 THEN 'b) tree' WHEN 1 THEN 'E x' WHEN 2 THEN '' WHEN 3 THEN NULL ELSE 'C' END AS given FROM lineitem),
       t AS (SELECT *, CASE WHEN kind = 'short' THEN given WHEN length(coalesce(given, '')) > 1 AND upper(left(given, 1)) IN ('A', 'B', 'C', 'D') THEN upper(left(given, 1)) WHEN coalesce(given, '') = '' THEN 'A' ELSE given END AS answer FROM q
         WHERE trim(question) <> '' AND (kind = 'short' OR options >= 2)),
       n AS (SELECT worksheet, answer, row_number() OVER (PARTITION BY worksheet ORDER BY place, p, s) AS number FROM t WHERE coalesce(answer, '') <> '')
       SELECT o_orderkey AS worksheet, coalesce(string_agg(number || answer, ',' ORDER BY number), '1A') AS answers FROM orders LEFT JOIN n ON worksheet = o_orderkey GROUP BY o_orderkey""",
)
def recovery_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recovery worksheets with sound questions, numbered anew, answers as letters; one without any gets a fallback question."""
    kind = F.when(K("l_suppkey") % 3 == 0, "short").when(K("l_suppkey") % 3 == 1, "mcq")
    given = F.get(F.array(F.lit("b) tree"), F.lit("E x"), F.lit(""), F.lit(None), F.lit("C")), (K("l_partkey") % 5).cast("int"))
    options = F.slice(F.array(*map(F.lit, "xyz")), F.lit(1), (K("l_partkey") % 4).cast("int"))
    q = F.struct(
        K("l_linenumber").alias("place"), K("l_partkey").alias("p"), K("l_suppkey").alias("s"), F.when(K("l_linenumber") % 5 == 0, " ").otherwise("q").alias("question"),
        kind.alias("type"), options.alias("options"), given.alias("answer"), F.lit(None).cast("string").alias("correct_answer"),
    )
    sheets = table(spark, sf_dir, "lineitem").groupBy(K("l_orderkey").alias("worksheet")).agg(F.array_sort(F.collect_list(q)).alias("questions"))
    sound = sheets.select("worksheet", recovery_questions(K("questions")).alias("q"))
    every = table(spark, sf_dir, "orders").select(K("o_orderkey").alias("worksheet")).join(sound, "worksheet", "left")
    answers = F.array_join(F.transform("q", lambda x: _text(x["number"], x["answer"])), ",")
    return every.select("worksheet", F.when(F.coalesce(F.size("q"), F.lit(0)) > 0, answers).otherwise("1A").alias("answers"))


@register(
    "quiz_defaults",
    """WITH q AS (SELECT l_orderkey AS quiz, row_number() OVER w AS place, count(*) OVER (PARTITION BY l_orderkey) AS n, CASE WHEN l_suppkey % 3 = 0 THEN 2 ELSE row_number() OVER w END AS number, CASE WHEN l_partkey % 2 = 0 THEN 'a' || l_partkey ELSE '' END AS answer
         FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey))
       SELECT quiz, CAST(number AS VARCHAR) AS number, answer, n AS total_points FROM q QUALIFY row_number() OVER (PARTITION BY quiz, number ORDER BY place DESC) = 1""",
)
def quiz_defaults_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answer keys of quizzes whose questions lack numbers, points and types; of one number the last question counts."""
    q = F.struct(
        "l_linenumber", "l_partkey", "l_suppkey",
        F.struct(
            F.when(K("l_suppkey") % 3 == 0, 2).cast("int").alias("number"), F.lit(None).cast("int").alias("points"), F.lit(None).cast("string").alias("type"), F.lit("q").alias("question"),
            F.when(K("l_partkey") % 2 == 0, _text("a", K("l_partkey"))).alias("correct_answer"),
        ).alias("q"),
    )
    quizzes = table(spark, sf_dir, "lineitem").groupBy(K("l_orderkey").alias("quiz")).agg(F.transform(F.array_sort(F.collect_list(q)), lambda x: x["q"]).cast(questions_type()).alias("questions"))
    _, answers, points = quiz_defaults(K("questions"))
    return quizzes.select("quiz", F.explode(answers).alias("number", "answer"), points.cast("long").alias("total_points"))


# --- documents in XML -------------------------------------------------------------------------------------------------

_TEXTS = "struct<_id:string,text:string,_page:string>"
XML = f"""_id string,_number string,title string,topics struct<topic:array<struct<_id:string,name:string,page_start:string,
prerequisites:struct<ref:array<string>>,subtopics:struct<subtopic:array<struct<_id:string,name:string>>>,exercises:struct<exercise:array<{_TEXTS}>>,sidebars:struct<sidebar:array<{_TEXTS}>>>>>""".replace("\n", "")


def xml_entities(raw: DataFrame) -> dict[str, DataFrame]:
    """Entities and edges of all chapters in XML (key, xml), however damaged: what stands around them goes, bare ampersands and open tags are mended.

    chapters, topics, subtopics, exercises, sidebars and the edge sets
    structure, mapping and dependencies. Numbers that aren't any are 0;
    prerequisites count only as T_n_m; a text that has no element gives nothing.
    Valid XML is read as it is; only the rest goes through the repair.
    """
    whole = K("xml").rlike(r"(?s)^\s*<chapter\b.*</chapter>\s*$") & ~K("xml").rlike(r"&(?!#?\w+;)") & ~K("xml").rlike(r"(?s)<chapter\b.*<chapter\b")
    asis = F.array(F.struct(K("xml").alias("xml"), F.lit(True).alias("whole")))
    blocks = raw.select("key", F.explode(F.when(whole, asis).otherwise(xml_elements(F.when(~whole, K("xml")), "chapter"))).alias("_block"))
    parsed = blocks.select("key", F.from_xml("_block.xml", XML).alias("c"), "_block.whole").where("c._id IS NOT NULL")
    number = lambda x: F.coalesce(F.trim(x).try_cast("int"), F.lit(0))
    chapters = parsed.select("key", K("c._id").alias("id"), number(K("c._number")).alias("number"), F.coalesce("c.title", F.lit("")).alias("title"), "whole")
    topics = parsed.select("key", K("c._id").alias("chapter_id"), F.explode("c.topics.topic").alias("t"))
    refs = F.coalesce(F.filter(K("t.prerequisites.ref"), lambda r: r.rlike(r"^T_\d+_\d+$")), F.array().cast("array<string>"))
    flat = topics.select("key", "chapter_id", K("t._id").alias("id"), K("t.name").alias("name"), number(K("t.page_start")).alias("page_start"), refs.alias("prerequisites"), "t")
    below = lambda path: flat.select("key", K("id").alias("topic_id"), F.explode(path).alias("x"))
    texts = lambda path: below(path).select("key", "topic_id", K("x._id").alias("id"), F.coalesce("x.text", F.lit("")).alias("text"), number(K("x._page")).alias("page"))
    exercises = texts("t.exercises.exercise")
    edge = lambda df, child, parent, kind: df.select("key", K(child).alias("child"), K(parent).alias("parent"), F.lit(kind).alias("kind"))
    needs = flat.select("key", "id", F.explode("prerequisites").alias("ref"))
    return {
        "chapters": chapters,
        "topics": flat.drop("t"),
        "subtopics": below("t.subtopics.subtopic").select("key", "topic_id", K("x._id").alias("id"), K("x.name").alias("name")),
        "exercises": exercises,
        "sidebars": texts("t.sidebars.sidebar"),
        "structure": edge(flat, "chapter_id", "id", "contains"),
        "mapping": edge(exercises, "id", "topic_id", "tests"),
        "dependencies": edge(needs, "id", "ref", "prerequisite"),
    }


def _xml_chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A chapter for each part: whole, cut short, with words around it, with a bare ampersand, and no XML at all."""
    n = K("p_partkey")
    whole = _text(
        '<chapter id="C_', n, '" number="', n, '"><title>', K("p_name"), '</title><topics><topic id="T_', n, '_1"><name>', K("p_type"), "</name><page_start>", K("p_size"), "</page_start>",
        "<prerequisites><ref>T_1_2</ref><ref>later</ref><ref>T_3_4</ref></prerequisites><subtopics><subtopic id=\"ST_", n, '_1_1"><name>sub</name></subtopic></subtopics>',
        '<exercises><exercise id="E_', n, '_1_1" page="', K("p_size"), '"><text>do</text></exercise><exercise id="E_', n, '_1_2" page="x"><text>more</text></exercise></exercises>',
    )
    end = '<sidebars><sidebar id="S_1" page="4"><text>box</text></sidebar></sidebars></topic></topics></chapter>'
    k = n % 5
    xml = F.when(k == 0, _text(whole, end)).when(k == 1, whole).when(k == 2, _text("Here it is:\n```xml\n", whole, end, "\n```")).when(k == 3, _text(F.replace(whole, F.lit("<text>do<"), F.lit("<text>do & dare<")), end)).otherwise("no chapter here")
    return table(spark, sf_dir, "part").select(n.alias("key"), xml.alias("xml"))


_XML_ROWS = "SELECT p_partkey AS key, p_partkey % 5 AS k, * FROM part WHERE p_partkey % 5 <> 4"


@register("xml_topics", f"SELECT key, 'C_' || key AS chapter_id, 'T_' || key || '_1' AS id, p_type AS name, p_size AS page_start, 'T_1_2,T_3_4' AS prerequisites FROM ({_XML_ROWS})")
def xml_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = xml_entities(_xml_chapters(spark, sf_dir))["topics"]
    return found.withColumn("prerequisites", F.array_join("prerequisites", ","))


@register(
    "xml_texts",
    f"""WITH r AS ({_XML_ROWS}) SELECT key, 'exercise' AS kind, 'E_' || key || '_1_1' AS id, CASE k WHEN 3 THEN 'do & dare' ELSE 'do' END AS text, p_size AS page FROM r
        UNION ALL SELECT key, 'exercise', 'E_' || key || '_1_2', 'more', 0 FROM r UNION ALL SELECT key, 'sidebar', 'S_1', 'box', 4 FROM r WHERE k <> 1 UNION ALL SELECT key, 'subtopic', 'ST_' || key || '_1_1', 'sub', 0 FROM r
        UNION ALL SELECT key, 'chapter', 'C_' || key, p_name, key FROM r""",
)
def xml_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chapters, subtopics, exercises and side boxes of chapters in XML."""
    e = xml_entities(_xml_chapters(spark, sf_dir))
    told = lambda df, kind, text, page: df.select("key", F.lit(kind).alias("kind"), "id", K(text).alias("text"), page.cast("long").alias("page"))
    whole = told(e["exercises"], "exercise", "text", K("page")).unionByName(told(e["sidebars"], "sidebar", "text", K("page")))
    return whole.unionByName(told(e["subtopics"], "subtopic", "name", F.lit(0))).unionByName(told(e["chapters"], "chapter", "title", K("number")))


@register(
    "xml_edges",
    f"""WITH r AS ({_XML_ROWS}) SELECT key, 'C_' || key AS child, 'T_' || key || '_1' AS parent, 'contains' AS kind FROM r UNION ALL SELECT key, 'E_' || key || '_1_' || unnest([1, 2]), 'T_' || key || '_1', 'tests' FROM r
        UNION ALL SELECT key, 'T_' || key || '_1', unnest(['T_1_2', 'T_3_4']), 'prerequisite' FROM r""",
)
def xml_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = xml_entities(_xml_chapters(spark, sf_dir))
    return e["structure"].unionByName(e["mapping"]).unionByName(e["dependencies"])


#: Two chapters in XML with a fault that only one way of reading gets over; {n} and {m} stand for a part's key and the next number.
_FIRST, _SECOND = (f'<chapter id="C_{{{x}}}" number="{i}"><title>{t}</title><topics><topic id="T_{{{x}}}_1"><name>one</name></topic><topic id="T_{{{x}}}_2"><name>two</name></topic></topics></chapter>' for i, (x, t) in enumerate([("n", "First"), ("m", "Second")], 1))
_SALVAGE = [
    f"<ontology>{_FIRST}{_SECOND}<dependencies/></ontology>",
    f"Thinking <b>aloud</b>.\n```xml\n<ontology lang=te>{_FIRST}{_SECOND}</ontology>\n``` Done & dusted.",
    f"<ontology>{_FIRST}{_SECOND[: _SECOND.index('two')]}",
    f"<ontology>{_FIRST}{_SECOND.replace('</topics>', '').replace('</chapter>', '')}</chapter></ontology> and so on <etc",
    f"</dependencies>{_FIRST.replace('</chapter>', '')}{_SECOND.replace('<name>one</name>', '<name>one</nam></name>')}",
    f"<ontology>{_FIRST.replace('First', 'a &lt; b &nbsp;&amp; c < d')}{_SECOND.replace('number=', 'note=' + chr(34) + '1 < 2' + chr(34) + ' number=')}",
]


def salvage_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    filled = F.lit(None).cast("string")
    n = K("p_partkey")
    for i, pattern in enumerate(_SALVAGE):
        said = F.replace(F.replace(F.lit(pattern), F.lit("{n}"), n.cast("string")), F.lit("{m}"), _text(n, "00"))
        filled = F.when(n % len(_SALVAGE) == i, said).otherwise(filled)
    return table(spark, sf_dir, "part").select(n.alias("key"), filled.alias("xml"))


@register(
    "xml_salvage",
    f"""WITH c AS (SELECT p_partkey AS key, p_partkey % {len(_SALVAGE)} AS k, unnest([1, 2]) AS number FROM part)
        SELECT key, 'C_' || key || CASE number WHEN 2 THEN '00' ELSE '' END AS id, number, CASE WHEN number = 2 THEN 'Second' WHEN k = 5 THEN 'a < b ' || chr(160) || '& c < d' ELSE 'First' END AS title,
               NOT (k IN (2, 3, 4) AND number = 2 OR k IN (4, 5) AND number = 1) AS whole, CAST(CASE WHEN k = 2 AND number = 2 THEN 1 ELSE 2 END AS BIGINT) AS named
        FROM c""",
)
def xml_salvage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both chapters of every text, whatever is broken in or around them, and how many of their topics have a name."""
    e = xml_entities(salvage_texts(spark, sf_dir))
    named = e["topics"].where("name <> ''").groupBy("key", K("chapter_id").alias("id")).agg(F.count("*").alias("named"))
    return e["chapters"].join(named, ["key", "id"], "left").select("key", "id", "number", "title", "whole", F.coalesce("named", F.lit(0)).cast("long").alias("named"))
