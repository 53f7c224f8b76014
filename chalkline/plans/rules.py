"""Filters, labels and small rules over parts, orders and documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chalkline.functions.labels import (
    BANDS,
    BLOOM,
    BOOK_SUBJECTS,
    GRADES,
    PLAN_SUBJECTS,
    SCRIPTS,
    STORY_VALUES,
    SUBJECT_LABELS,
    UUID,
    book_name,
    by_grade,
    by_words,
    escaped,
    falsy_default,
    grade_of,
    highlighted,
    in_script,
    inferred_book,
    rotated,
    transliterated,
)
from chalkline.functions.text import normalised
from chalkline.operators.folds import newest
from chalkline.operators.structure import numbered
from chalkline.plans.registry import register
from chalkline.sources.tables import table


def _pick(key: str, values: list[str | None], step: int = 1) -> Column:
    return F.get(F.array(*map(F.lit, values)), (F.floor(F.col(key) / step) % len(values)).cast("int"))


def _pick_sql(key: str, values: list[str | None], step: int = 1) -> str:
    listed = ", ".join("NULL" if v is None else "'" + v.replace("'", "''") + "'" for v in values)
    return f"[{listed}][CAST({key} // {step} % {len(values)} + 1 AS INT)]"


# --- lookups -------------------------------------------------------------------------------------------------------


def single(df: DataFrame, condition: Column) -> DataFrame:
    """The row that meets the condition, or none; two of them are an error, found without reading on after the second."""
    found = df.where(condition).limit(2)
    counted = found.withColumn("_n", F.count(F.lit(1)).over(W.partitionBy(F.lit(1))))  # two rows at most
    return counted.where(F.when(F.col("_n") > 1, F.raise_error(F.lit("more than one row"))).otherwise(F.lit("")).isNotNull()).drop("_n")


@register("single_row_lookup", "SELECT s_suppkey AS id, s_name AS name FROM supplier WHERE s_suppkey = 7 UNION ALL SELECT s_suppkey, s_name FROM supplier WHERE s_suppkey = -1")
def single_row_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A teacher by id, and none for an id that nobody has."""
    teachers = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    return single(teachers, F.col("id") == 7).unionByName(single(teachers, F.col("id") == -1))


@register("default_first_row", "SELECT s_suppkey AS id, s_name AS name FROM supplier ORDER BY s_suppkey LIMIT 1")
def default_first_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The teacher that stands in where none is named: the first by id."""
    return table(spark, sf_dir, "supplier").orderBy("s_suppkey").limit(1).select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))


@register("in_list_filter", "SELECT o_orderkey AS id, o_orderpriority AS priority FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 45)")
def in_list_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A short list as a filter that reaches the scan, a long one as a semi join."""
    large = table(spark, sf_dir, "lineitem").where("l_quantity > 45").select(F.col("l_orderkey").alias("o_orderkey"))
    urgent = table(spark, sf_dir, "orders").where(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"))
    return urgent.join(large, "o_orderkey", "left_semi").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("priority"))


def submissions_of(df: DataFrame, unreviewed_only: bool = False, limit: int | None = None) -> DataFrame:
    """Submissions, newest first; only those not reviewed yet if asked for, and only so many if asked for."""
    df = df.where("NOT reviewed") if unreviewed_only else df
    df = df.orderBy(F.desc("submitted_at"), F.desc("id"))
    return df if limit is None else df.limit(limit)


@register(
    "flagged_filter",
    """WITH s AS (SELECT o_orderkey AS id, o_orderdate AS submitted_at, o_orderstatus = 'F' AS reviewed FROM orders)
       SELECT 'all' AS asked, id FROM s UNION ALL SELECT 'open', id FROM s WHERE NOT reviewed UNION ALL SELECT 'newest', id FROM (SELECT id FROM s WHERE NOT reviewed ORDER BY submitted_at DESC, id DESC LIMIT 50)""",
)
def flagged_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("submitted_at"), (F.col("o_orderstatus") == "F").alias("reviewed"))
    asked = [("all", submissions_of(rows)), ("open", submissions_of(rows, True)), ("newest", submissions_of(rows, True, 50))]
    found = [df.select(F.lit(name).alias("asked"), "id") for name, df in asked]
    return found[0].unionByName(found[1]).unionByName(found[2])


_HEX = "lower(md5(CAST(c_custkey AS VARCHAR)))"
_DASHED = f"substr({_HEX}, 1, 8) || '-' || substr({_HEX}, 9, 4) || '-' || substr({_HEX}, 13, 4) || '-' || substr({_HEX}, 17, 4) || '-' || substr({_HEX}, 21, 12)"


@register(
    "uuid_guard",
    f"""WITH i AS (SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN {_DASHED} WHEN 1 THEN upper({_DASHED}) WHEN 2 THEN 'S' || c_custkey ELSE {_DASHED} || 'a' END AS id FROM customer)
        SELECT c_custkey AS student, id FROM i WHERE regexp_matches(id, '(?i)^[0-9a-f]{{8}}-[0-9a-f]{{4}}-[0-9a-f]{{4}}-[0-9a-f]{{4}}-[0-9a-f]{{12}}$')""",
)
def uuid_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids that are UUIDs, in either case."""
    h = F.md5(F.col("c_custkey").cast("string"))
    dashed = F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])
    k = F.col("c_custkey") % 4
    ids = F.when(k == 0, dashed).when(k == 1, F.upper(dashed)).when(k == 2, F.concat(F.lit("S"), F.col("c_custkey").cast("string"))).otherwise(F.concat(dashed, F.lit("a")))
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("student"), ids.alias("id")).where(F.col("id").rlike(UUID))


def topic_search(df: DataFrame, needle: str) -> DataFrame:
    """Topics whose name or summary holds the needle in any case; an empty one finds all, and no sign in it is special."""
    low = F.lit(needle.strip().lower())
    return df.where(F.lower("name").contains(low) | F.lower(F.coalesce("summary", F.lit(""))).contains(low)) if needle.strip() else df


_SEARCHED = "t AS (SELECT p_partkey AS topic_id, p_name AS name, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE p_type || ' 100%_' || p_size END AS summary FROM part)"


@register(
    "search_name_or_summary",
    f"""WITH {_SEARCHED} SELECT 'SMALL' AS needle, topic_id FROM t WHERE contains(lower(name), 'small') OR contains(lower(summary), 'small')
        UNION ALL SELECT '%_7', topic_id FROM t WHERE contains(lower(name), '%_7') OR contains(lower(summary), '%_7') UNION ALL SELECT '', topic_id FROM t""",
)
def search_name_or_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    summary = F.when(F.col("p_partkey") % 3 != 0, F.concat("p_type", F.lit(" 100%_"), F.col("p_size").cast("string")))
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("topic_id"), F.col("p_name").alias("name"), summary.alias("summary"))
    found = [topic_search(rows, x).select(F.lit(x).alias("needle"), "topic_id") for x in ("SMALL", "%_7", "")]
    return found[0].unionByName(found[1]).unionByName(found[2])


@register(
    "ghost_split",
    "SELECT p_partkey AS topic_id, CASE p_partkey % 6 WHEN 0 THEN 'ghost' WHEN 1 THEN 'ghost' ELSE 'kept' END AS part FROM part",
)
def ghost_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Topics with a first page, and those without (null or 0)."""
    start = F.when(F.col("p_partkey") % 6 == 0, 0).when(F.col("p_partkey") % 6 > 1, F.col("p_size"))
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("topic_id"), start.alias("page_start"))
    real = F.coalesce("page_start", F.lit(0)) > 0
    kept, ghosts = rows.where(real), rows.where(~real)
    return kept.select("topic_id", F.lit("kept").alias("part")).unionByName(ghosts.select("topic_id", F.lit("ghost").alias("part")))


@register(
    "mastery_bands",
    "SELECT l_orderkey AS student, l_linenumber AS n, l_quantity / 50 AS mastery, CASE WHEN l_quantity / 50 < 0.6 THEN 'weak' WHEN l_quantity / 50 >= 0.8 THEN 'strong' END AS band FROM lineitem WHERE l_quantity / 50 < 0.6 OR l_quantity / 50 >= 0.8",
)
def mastery_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weak under 0.6, strong from 0.8; what lies between is neither."""
    m = F.col("l_quantity") / 50
    band = F.when(m < 0.6, "weak").when(m >= 0.8, "strong")
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("student"), F.col("l_linenumber").alias("n"), m.alias("mastery"), band.alias("band")).where("band IS NOT NULL")


@register(
    "front_matter_ranges",
    """WITH c AS (SELECT p_type AS book, p_brand AS title, min(p_size) + 7 * (min(p_partkey) % 5) AS book_page FROM part GROUP BY p_type, p_brand),
       f AS (SELECT book, title, book_page + 3 - 1 AS start_page FROM c WHERE book_page + 3 - 1 >= 8 AND book_page + 3 - 1 BETWEEN 0 AND 29)
       SELECT book, title, CAST(start_page AS BIGINT) AS start_page, CAST(coalesce(lead(start_page) OVER (PARTITION BY book ORDER BY start_page, title) - 1, 29) AS BIGINT) AS end_page FROM f""",
)
def front_matter_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chapters of a table of contents as page ranges of a file of 30 pages, whose offset is 3 and whose first lesson is on page 8."""
    smallest = table(spark, sf_dir, "part").groupBy(F.col("p_type").alias("book"), F.col("p_brand").alias("title")).agg((F.min("p_size") + 7 * (F.min("p_partkey") % 5)).alias("book_page"))
    return chapter_ranges(smallest, ["book"], offset=3, first_lesson=8, pages=30)


def chapter_ranges(contents: DataFrame, group: list[str], offset: int, first_lesson: int, pages: int) -> DataFrame:
    """Contents (title, book_page) as (start_page, end_page): printed pages become places in the file, what comes before the first lesson goes."""
    start = F.col("book_page") + (offset - 1)
    inside = contents.withColumn("start_page", start.cast("long")).where((F.col("start_page") >= first_lesson) & F.col("start_page").between(0, pages - 1))
    following = F.lead("start_page").over(W.partitionBy(*group).orderBy("start_page", "title")) - 1
    return inside.select(*group, "title", "start_page", F.coalesce(following, F.lit(pages - 1)).cast("long").alias("end_page"))


def page_offset(first_index: Column, printed: Column) -> Column:
    """What a printed page number is off its place in the file, from one page of which both are known."""
    return first_index - printed + 1


# --- defaults and labels ---------------------------------------------------------------------------------------------

_STYLES = ['{"style": "visual"}', '{"style": null}', "{}", '{"style": ""}']


@register(
    "missing_and_falsy",
    f"""WITH j AS (SELECT c_custkey AS id, {_pick_sql('c_custkey', _STYLES)} AS doc, c_custkey % 3 AS level FROM customer)
        SELECT id, CASE WHEN list_contains(json_keys(doc), 'style') THEN doc->>'style' ELSE 'story' END AS if_missing, coalesce(nullif(doc->>'style', ''), 'story') AS if_falsy, CASE WHEN level = 0 THEN 9 ELSE level END AS level FROM j""",
)
def missing_and_falsy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A default for a key that isn't there keeps an explicit null; one for falsy values replaces null, empty and zero."""
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), _pick("c_custkey", _STYLES).alias("doc"), (F.col("c_custkey") % 3).alias("level"))
    value = F.get_json_object("doc", "$.style")
    there = F.array_contains(F.json_object_keys("doc"), "style")
    return rows.select("id", F.when(there, value).otherwise("story").alias("if_missing"), falsy_default(value, F.lit("story")).alias("if_falsy"), falsy_default(F.col("level"), F.lit(9).cast("long")).alias("level"))


_PROFILE = {"teaching_style": "activity", "lesson_duration": "45 minutes", "language": "English", "activity_preference": "worksheets", "assessment_style": "quizzes", "difficulty_preference": "medium"}


@register(
    "teacher_profiles",
    f"""SELECT s_suppkey AS teacher_id, s_name AS name, {', '.join(f"CASE WHEN s_suppkey % {i + 2} = 0 THEN 'own ' || s_nationkey ELSE '{v}' END AS {k}" for i, (k, v) in enumerate(_PROFILE.items()))} FROM supplier""",
)
def teacher_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profiles with the defaults of what a teacher hasn't set."""
    own = F.concat(F.lit("own "), F.col("s_nationkey").cast("string"))
    rows = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("teacher_id"), F.col("s_name").alias("name"), *[F.when(F.col("s_suppkey") % (i + 2) == 0, own).alias(k) for i, k in enumerate(_PROFILE)])
    return rows.select("teacher_id", "name", *[F.coalesce(k, F.lit(v)).alias(k) for k, v in _PROFILE.items()])


@register("grade_coercion", "SELECT p_partkey AS id, CASE WHEN p_partkey % 2 = 0 THEN CAST(p_size AS VARCHAR) ELSE 'Grade ' || p_size END AS grade FROM part")
def grade_coercion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests whose grade is a number or a text come in as text."""
    number = F.concat(F.lit('{"grade": '), F.col("p_size").cast("string"), F.lit("}"))
    text = F.concat(F.lit('{"grade": "Grade '), F.col("p_size").cast("string"), F.lit('"}'))
    body = F.when(F.col("p_partkey") % 2 == 0, number).otherwise(text)
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.from_json(body, "grade string")["grade"].alias("grade"))


_BOOKS = ["Grade 1 Maths", "grade10 science", "English Literacy kg", "Social World Grade 5", "gradekg evs", "History grade 3", "Language Grade2", "Art"]


def _words_sql(low: str, rules_: list[tuple[list[str], str]], default: str) -> str:
    return "CASE " + " ".join(f"WHEN {' OR '.join(f'contains({low}, {w!r})' for w in words)} THEN '{label}'" for words, label in rules_) + f" ELSE {default} END"


@register(
    "subjects_and_grades",
    f"""WITH b AS (SELECT p_partkey AS id, {_pick_sql('p_partkey', _BOOKS)} AS book FROM part), l AS (SELECT *, lower(book) AS low, replace(lower(book), ' ', '') AS tight FROM b)
        SELECT id, {_words_sql('low', BOOK_SUBJECTS, "'General'")} AS subject, {_words_sql('low', SUBJECT_LABELS, 'book')} AS label,
        CASE {' '.join(f"WHEN contains(tight, 'grade{g}') THEN '{g}'" for g in GRADES)} ELSE '' END AS grade FROM l""",
)
def subjects_and_grades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subject, import label and grade that a book's name stands for; the first grade that the text holds counts."""
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), _pick("p_partkey", _BOOKS).alias("book"))
    low = F.lower("book")
    return rows.select("id", by_words(low, BOOK_SUBJECTS, F.lit("General")).alias("subject"), by_words(low, SUBJECT_LABELS, F.col("book")).alias("label"), grade_of(F.col("book")).alias("grade"))


_SUBJECTS = ["Mathematics", "Social Science", "English", "EVS", "Telugu"]


@register(
    "book_names",
    f"""WITH r AS (SELECT p_partkey AS id, CASE p_partkey % 3 WHEN 0 THEN 'Grade ' WHEN 1 THEN 'grade' ELSE '' END || p_size AS grade, {_pick_sql('p_partkey', _SUBJECTS)} AS subject FROM part),
        g AS (SELECT *, trim(replace(replace(grade, 'Grade ', ''), 'grade', '')) AS n, lower(subject) AS low FROM r)
        SELECT id, 'grade' || n || '_' || replace(replace(low, ' ', '_'), 'mathematics', 'maths') AS book, 'grade' || n || '_' || {_words_sql('low', PLAN_SUBJECTS, 'low')} AS inferred FROM g""",
)
def book_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The book that a grade and a subject are filed under, and the one that a plan infers."""
    prefix = F.when(F.col("p_partkey") % 3 == 0, "Grade ").when(F.col("p_partkey") % 3 == 1, "grade").otherwise("")
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.concat(prefix, F.col("p_size").cast("string")).alias("grade"), _pick("p_partkey", _SUBJECTS).alias("subject"))
    return rows.select("id", book_name(F.col("grade"), F.col("subject")).alias("book"), inferred_book(F.col("grade"), F.col("subject")).alias("inferred"))


def _grade_sql(bands: list[tuple[int | None, str]]) -> str:
    return "CASE " + " ".join(f"WHEN g <= {last} THEN '{text}'" for last, text in bands[:-1]) + f" ELSE '{bands[-1][1]}' END"


@register(
    "grade_rules",
    f"""WITH r AS (SELECT p_partkey AS id, p_size, CASE WHEN p_partkey % 5 = 0 THEN 5 ELSE p_size % 13 END AS g FROM part)
        SELECT id, {_grade_sql(BANDS)} AS band, 'Bloom''s distribution across all ' || p_size || ' questions: ' || {_grade_sql(BLOOM)} AS bloom FROM r""",
)
def grade_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language band and Bloom distribution of a grade; one without digits counts as 5."""
    grade = F.when(F.col("p_partkey") % 5 == 0, "Nursery").otherwise(F.concat(F.lit("Grade "), (F.col("p_size") % 13).cast("string")))
    text = F.concat(F.lit("Bloom's distribution across all "), F.col("p_size").cast("string"), F.lit(" questions: "), by_grade(grade, BLOOM))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), by_grade(grade, BANDS).alias("band"), text.alias("bloom"))


_NAMES = ["కథ", "Katha", "hindi कहानी", "", "தமிழ்", "ಕನ್ನಡ x", "café"]
_LANGS = [*SCRIPTS, "English"]
_IN_SCRIPT = " ".join(f"WHEN '{name}' THEN regexp_matches(name, '[\\x{{{low:04X}}}-\\x{{{high:04X}}}]')" for name, (low, high) in SCRIPTS.items())


@register(
    "script_detection",
    f"""WITH r AS (SELECT p_partkey AS id, {_pick_sql('p_partkey', _NAMES)} AS name, {_pick_sql('p_partkey', _LANGS, 7)} AS lang FROM part)
        SELECT id, CASE lang {_IN_SCRIPT} ELSE true END AS in_script,
          lang <> 'English' AND NOT regexp_matches(name, '[^\\x00-\\x7F]') AS transliterated FROM r""",
)
def script_detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a name is in its language's script, or looks transliterated (an empty one does)."""
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), _pick("p_partkey", _NAMES).alias("name"), _pick("p_partkey", _LANGS, 7).alias("lang"))
    return rows.select("id", in_script(F.col("name"), F.col("lang")).alias("in_script"), transliterated(F.col("name"), F.col("lang")).alias("transliterated"))


@register(
    "normalised_text",
    r"""SELECT doc_id, trim(regexp_replace(regexp_replace(nfc_normalize('  ' || chr(65279) || coalesce(text, '') || chr(8203) || chr(9) || chr(160) || 'é' || chr(10)), '[\x{200B}-\x{200D}\x{FEFF}]', '', 'g'), '[\x{09}-\x{0D}\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+', ' ', 'g')) AS text FROM documents""",
)
def normalised_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts with marks, odd spaces and a decomposed letter around, in normal form; a null text is an empty one."""
    odd = F.concat(F.lit("  ﻿"), F.coalesce("text", F.lit("")), F.lit("​\t é\n"))
    return table(spark, sf_dir, "documents").select("doc_id", normalised(odd).alias("text"))


@register(
    "highlighted_hits",
    r"""WITH t AS (SELECT p_partkey AS id, p_name || ' <b> & "c++" C++' AS name FROM part), e AS (SELECT id, replace(replace(replace(replace(name, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;') AS x FROM t)
        SELECT id, regexp_replace(x, '(?i)(c\+\+)', '<mark>\1</mark>', 'g') AS html, x AS plain FROM e""",
)
def highlighted_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search hits as HTML: escaped, with what the needle finds marked."""
    name = F.concat("p_name", F.lit(' <b> & "c++" C++'))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), highlighted(name, "c++").alias("html"), escaped(name).alias("plain"))


@register(
    "rotated_values",
    f"SELECT o_orderkey AS day, {_pick_sql('o_orderkey', STORY_VALUES)} AS value, strftime(o_orderdate, '%Y%m%d_%H%M%S') AS file_stamp, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') || '+00:00' AS iso FROM orders",
)
def rotated_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One of ten values by a day's number, and the day as a stamp for file names and as UTC text."""
    day = F.col("o_orderdate")
    iso = F.concat(F.date_format(day, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+00:00"))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("day"), rotated(F.col("o_orderkey"), STORY_VALUES).alias("value"), F.date_format(day, "yyyyMMdd_HHmmss").alias("file_stamp"), iso.alias("iso"))


# --- constraints and picks ---------------------------------------------------------------------------------------------

#: Constraints of the tables as (name, whether a row violates it); nulls violate nothing but NOT NULL.
CONSTRAINTS = {
    "teaching_style": ("s_style", "s_style NOT IN ('lecture', 'activity', 'storytelling')"),
    "style_missing": ("s_style", "s_style IS NULL"),
    "frustration": ("level", "level NOT BETWEEN 0.0 AND 1.0"),
    "status": ("status", "status NOT IN ('untaught', 'partial', 'taught')"),
}
_CHECKED_SQL = """checked AS (SELECT o_orderkey AS id, ['lecture', 'activity', 'storytelling', 'other', NULL][CAST(o_orderkey % 5 + 1 AS INT)] AS s_style, (o_orderkey % 13) / 10.0 AS level,
['untaught', 'partial', 'taught', 'skipped'][CAST(o_orderkey % 4 + 1 AS INT)] AS status FROM orders)"""


@register(
    "constraint_report",
    f"""WITH {_CHECKED_SQL} {' UNION ALL '.join(f"SELECT '{name}' AS broken, count(*) AS n, min(id) AS first_id FROM checked WHERE {bad} HAVING count(*) > 0" for name, (_, bad) in CONSTRAINTS.items())}""",
)
def constraint_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that break a constraint, counted for each in one pass, with the first of them."""
    rows = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"),
        _pick("o_orderkey", ["lecture", "activity", "storytelling", "other", None]).alias("s_style"),
        ((F.col("o_orderkey") % 13) / 10.0).alias("level"),
        _pick("o_orderkey", ["untaught", "partial", "taught", "skipped"]).alias("status"),
    )
    return violations(rows, {name: bad for name, (_, bad) in CONSTRAINTS.items()}, "id")


def violations(rows: DataFrame, rules_: dict[str, str], key: str) -> DataFrame:
    """(broken, n, first_id) of the named conditions that rows meet and shouldn't."""
    broken = F.filter(F.array(*[F.when(F.expr(bad), name) for name, bad in rules_.items()]), lambda x: x.isNotNull())
    found = rows.select(key, F.explode(broken).alias("broken"))
    return found.groupBy("broken").agg(F.count(F.lit(1)).alias("n"), F.min(key).alias("first_id"))


@register(
    "week_days",
    """SELECT o_custkey AS plan, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS INT) AS day_of_week, o_orderkey AS concept FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) <= 5""",
)
def week_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first five concepts of a plan on Monday to Friday."""
    concepts = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("plan")).agg(F.array_sort(F.collect_list("o_orderkey")).alias("concepts"))
    return concepts.select("plan", F.posexplode(F.slice("concepts", 1, 5)).alias("day_of_week", "concept"))


@register(
    "numeric_suffix_order",
    """WITH t AS (SELECT p_type AS book, p_partkey, 'T_' || p_partkey % 4 || '_' || CASE WHEN p_partkey % 9 = 0 THEN 'x' ELSE CAST(p_partkey AS VARCHAR) END AS id FROM part)
       SELECT book, id, row_number() OVER (PARTITION BY book ORDER BY coalesce(try_cast(regexp_extract(id, '([^_]*)$', 1) AS INT), 999), p_partkey) AS place FROM t""",
)
def numeric_suffix_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Topics by the number that their id ends in; one that ends in none counts as 999."""
    tail = F.when(F.col("p_partkey") % 9 == 0, "x").otherwise(F.col("p_partkey").cast("string"))
    rows = table(spark, sf_dir, "part").select(F.col("p_type").alias("book"), "p_partkey", F.concat_ws("_", F.lit("T"), (F.col("p_partkey") % 4).cast("string"), tail).alias("id"))
    suffix = F.coalesce(F.element_at(F.split("id", "_"), -1).try_cast("int"), F.lit(999))
    return numbered(rows, ["book"], [suffix, F.col("p_partkey")], "place").select("book", "id", "place")


_TAUGHT_SQL = """t AS (SELECT p_type AS book, p_brand AS chapter, dense_rank() OVER (PARTITION BY p_type ORDER BY p_brand) AS n, p_partkey AS topic, ['taught', 'partial', 'taught', 'taught', 'untaught', 'taught', 'taught'][CAST(p_partkey % 7 + 1 AS INT)] AS status FROM part)"""


@register(
    "next_day_picks",
    f"""WITH {_TAUGHT_SQL}, c AS (SELECT DISTINCT book, n FROM t),
        open AS (SELECT book, n, topic, row_number() OVER (PARTITION BY book, n ORDER BY topic) AS k FROM t WHERE status IN ('untaught', 'partial')),
        every AS (SELECT book, n, topic, row_number() OVER (PARTITION BY book, n ORDER BY topic) AS k FROM t),
        base AS (SELECT c.book, c.n, CASE WHEN EXISTS (SELECT 1 FROM open o WHERE o.book = c.book AND o.n = c.n) THEN c.n ELSE c.n + 1 END AS m, EXISTS (SELECT 1 FROM open o WHERE o.book = c.book AND o.n = c.n) AS same FROM c),
        pool AS (SELECT a.book, a.n, a.m, o.topic, o.k FROM base a JOIN open o ON a.same AND o.book = a.book AND o.n = a.m UNION ALL SELECT a.book, a.n, a.m, e.topic, e.k FROM base a JOIN every e ON NOT a.same AND e.book = a.book AND e.n = a.m)
        SELECT a.book, a.n AS chapter, f.topic AS first, coalesce(s.topic, x.topic) AS following FROM base a LEFT JOIN pool f ON f.book = a.book AND f.n = a.n AND f.k = 1
        LEFT JOIN pool s ON s.book = a.book AND s.n = a.n AND s.k = 2 LEFT JOIN every x ON f.topic IS NOT NULL AND x.book = a.book AND x.n = a.m + 1 AND x.k = 1""",
)
def next_day_picks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What to teach next from each chapter: its first two open topics; if all are taught those of the next chapter; and the first one of the chapter after where a second is missing."""
    status = _pick("p_partkey", ["taught", "partial", "taught", "taught", "untaught", "taught", "taught"])
    rank = F.dense_rank().over(W.partitionBy("book").orderBy("p_brand"))
    topics = table(spark, sf_dir, "part").select(F.col("p_type").alias("book"), "p_brand", F.col("p_partkey").alias("topic"), status.alias("status")).withColumn("n", rank)
    open_ = F.col("status").isin("untaught", "partial")
    listed = lambda when: F.slice(F.array_sort(F.collect_list(F.when(when, F.col("topic")))), 1, 2)
    chapters = topics.groupBy("book", "n").agg(listed(open_).alias("open"), listed(F.lit(True)).alias("every"))
    later = lambda k: chapters.select("book", (F.col("n") - k).alias("n"), F.col("every").alias(f"after{k}"))
    both = chapters.join(later(1), ["book", "n"], "left").join(later(2), ["book", "n"], "left")
    pool = F.when(F.size("open") > 0, F.col("open")).otherwise(F.col("after1"))
    onward = F.when(F.size("open") > 0, F.col("after1")).otherwise(F.col("after2"))
    first = F.get(pool, F.lit(0))
    return both.select("book", F.col("n").cast("long").alias("chapter"), first.alias("first"), F.coalesce(F.get(pool, F.lit(1)), F.when(first.isNotNull(), F.get(onward, F.lit(0)))).alias("following"))


@register(
    "reteach_first_five",
    """WITH w AS (SELECT l_orderkey AS worksheet, l_linenumber AS number, CAST(l_quantity AS INT) AS wrong, CAST(l_partkey % 60 AS INT) AS total FROM lineitem),
       f AS (SELECT *, row_number() OVER (PARTITION BY worksheet ORDER BY number) AS k FROM w WHERE wrong / greatest(total, 1) > 0.3),
       q AS (SELECT l_orderkey AS worksheet, CAST(l_linenumber AS VARCHAR) AS number, 'Question ' || l_suppkey AS text, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey) AS k FROM lineitem WHERE l_linenumber % 2 = 1)
       SELECT f.worksheet, f.number, coalesce(q.text, '') AS question FROM f LEFT JOIN q ON q.worksheet = f.worksheet AND q.number = CAST(f.number AS VARCHAR) AND q.k = 1 WHERE f.k <= 5""",
)
def reteach_first_five(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first five questions that over 30 % got wrong, with the question's text found by its number as text."""
    lines = table(spark, sf_dir, "lineitem")
    wrong = lines.select(F.col("l_orderkey").alias("worksheet"), F.col("l_linenumber").alias("number"), F.col("l_quantity").cast("int").alias("wrong"), (F.col("l_partkey") % 60).cast("int").alias("total"))
    flagged = newest(wrong.where(F.col("wrong") / F.greatest("total", F.lit(1)) > 0.3), ["worksheet"], [F.col("number")], 5).select("worksheet", "number", F.col("number").cast("string").alias("key"))
    texts = lines.where("l_linenumber % 2 = 1").select(F.col("l_orderkey").alias("worksheet"), F.col("l_linenumber").cast("string").alias("key"), F.concat(F.lit("Question "), F.col("l_suppkey").cast("string")).alias("text"), "l_partkey", "l_suppkey")
    first = newest(texts, ["worksheet", "key"], [F.col("l_partkey"), F.col("l_suppkey")], 1).select("worksheet", "key", "text")
    return flagged.join(first, ["worksheet", "key"], "left").select("worksheet", "number", F.coalesce("text", F.lit("")).alias("question"))


@register(
    "at_risk_from_maps",
    """WITH m AS (SELECT o_custkey AS student, l_partkey % 5 AS topic, max(l_quantity) / 50 AS mastery FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL),
       a AS (SELECT c_custkey AS student, coalesce(CAST(sum(CAST(mastery AS DECIMAL(10, 2))) AS DOUBLE) / count(mastery), 0.0) AS mean, (c_custkey % 10) / 10.0 AS frustration FROM customer LEFT JOIN m ON student = c_custkey GROUP BY c_custkey)
       SELECT student, mean, CAST(frustration AS DOUBLE) AS frustration FROM a WHERE mean < 0.6 OR frustration > 0.6""",
)
def at_risk_from_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Students at risk by the mastery map of their profile, without their names."""
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("student")), "l_orderkey")
    known = lines.groupBy("student", (F.col("l_partkey") % 5).alias("topic")).agg((F.max("l_quantity") / 50).cast("decimal(10,2)").alias("mastery"))
    maps = known.groupBy("student").agg(F.map_from_entries(F.collect_list(F.struct("topic", "mastery"))).alias("map"))
    profiles = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("student"), ((F.col("c_custkey") % 10) / 10.0).alias("frustration")).join(maps, "student", "left")
    values = F.map_values("map")
    total = F.aggregate(values, F.lit(0).cast("decimal(20,2)"), lambda a, x: (a + x).cast("decimal(20,2)")).cast("double")
    mean = F.coalesce(F.try_divide(total, F.size(values)), F.lit(0.0))
    return profiles.select("student", mean.alias("mean"), F.col("frustration").cast("double").alias("frustration")).where("mean < 0.6 OR frustration > 0.6")
