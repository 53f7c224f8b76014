"""Text classification, repair and name resolution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chalkline.functions.classify import (
    ACTIVITIES,
    ACTIVITY_ORDER,
    CONCEPTS,
    EXERCISES,
    GARBAGE_NAMES,
    GARBAGE_SUMMARIES,
    SKILLS,
    STANDARD,
    is_garbage,
    rules,
    with_activity,
    with_concepts,
    without_meta,
)
from chalkline.functions.text import (
    SPACES,
    canonical_ids,
    digits_only,
    first_keyword,
    may_reach,
    norm_name,
    repair_xml,
    robust_json,
    safe_dirname,
    seq_ratio,
    strip_fences,
    truncated,
)
from chalkline.operators.folds import first_by
from chalkline.plans.registry import register
from chalkline.sources.tables import table

def _sql_first(x: str, rules: list[tuple[str, list[str]]], default: str) -> str:
    return "CASE " + " ".join(f"WHEN {' OR '.join(f'contains({x}, {w!r})' for w in words)} THEN '{label}'" for label, words in rules) + f" ELSE {default} END"


#: Descriptions that the rules have something to say about, dealt by key.
DESCRIBED = (
    "Trace the letters and write the words",
    "Draw a circle and colour it",
    "Match the picture with its word",
    "Listen to the poem and sing",
    "How many birds do you count",
    "Read the story aloud",
    "గేయం",
    "Observe the illustration and discuss the answer",
)
_PICK = "[" + ", ".join(f"'{x}'" for x in DESCRIBED) + "][p_partkey % 8 + 1]"
DESCRIBED_SQL = f"described AS (SELECT p_partkey AS topic_id, p_type AS book, p_brand AS chapter, p_size AS page_start, p_name AS name, {_PICK} AS summary, lower({_PICK}) AS t FROM part)"


def described(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("topic_id"),
        F.col("p_type").alias("book"),
        F.col("p_brand").alias("chapter"),
        F.col("p_size").alias("page_start"),
        F.col("p_name").alias("name"),
        F.get(F.array(*map(F.lit, DESCRIBED)), (F.col("p_partkey") % 8).cast("int")).alias("summary"),
    )


def typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Topics with their activity type."""
    return with_activity(described(spark, sf_dir))


ACTIVITY_SQL = f"{DESCRIBED_SQL}, typed AS (SELECT *, {_sql_first('t', ACTIVITIES, repr('OTHER'))} AS activity FROM described)"


def activity_sql(rows: str) -> str:
    """``typed``: the rows (name, summary) with their activity, for text in ASCII."""
    short, full = "lower(trim(name))", "lower(trim(name)) || ' ' || lower(trim(left(summary, 200)))"
    return f"typed AS (SELECT *, coalesce({_sql_first(short, ACTIVITIES, 'NULL')}, {_sql_first(full, ACTIVITIES, repr('OTHER'))}) AS activity FROM {rows})"


@register(
    "keyword_class",
    f"WITH {DESCRIBED_SQL} SELECT topic_id, {_sql_first('t', EXERCISES, repr('general_activity'))} AS exercise, {_sql_first('t', SKILLS, repr('general_skill'))} AS skill FROM described",
)
def keyword_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.lower("summary")
    return described(spark, sf_dir).select(
        "topic_id", first_keyword(text, rules(EXERCISES), "general_activity").alias("exercise"), first_keyword(text, rules(SKILLS), "general_skill").alias("skill")
    )


@register("canonical_type", f"WITH {ACTIVITY_SQL} SELECT topic_id, activity FROM typed")
def canonical_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return typed(spark, sf_dir).select("topic_id", "activity")


_TAGS_SQL = ", ".join(f"CASE WHEN {' OR '.join(f'contains(t, {w!r})' for w in words)} THEN '{label}' END" for label, words in CONCEPTS)


@register(
    "concept_tags",
    f"WITH {DESCRIBED_SQL}, whole AS (SELECT topic_id, lower(name || ' ' || summary) AS t FROM described), g AS (SELECT topic_id, list_filter([{_TAGS_SQL}], lambda x: x IS NOT NULL) AS tags FROM whole) SELECT topic_id, CASE WHEN len(tags) = 0 THEN 'GENERAL' ELSE array_to_string(tags, ',') END AS tags FROM g",
)
def concept_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_concepts(described(spark, sf_dir)).select("topic_id", F.array_join("concepts", ",").alias("tags"))


@register("activity_distribution", f"WITH {ACTIVITY_SQL} SELECT activity, count(*) AS n FROM typed GROUP BY activity")
def activity_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return typed(spark, sf_dir).groupBy("activity").agg(F.count(F.lit(1)).alias("n"))


@register(
    "activity_summary_missing",
    f"""WITH {ACTIVITY_SQL}, s AS (SELECT book, chapter, list(DISTINCT activity) AS a FROM typed GROUP BY ALL)
        SELECT book, chapter, array_to_string(list_sort(a), ',') AS activities, array_to_string(list_filter({list(STANDARD)!r}, lambda x: NOT list_contains(a, x)), ',') AS missing FROM s""",
)
def activity_summary_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Activity types of each chapter, and the standard ones it lacks."""
    sets = typed(spark, sf_dir).groupBy("book", "chapter").agg(F.array_sort(F.collect_set("activity")).alias("a"))
    missing = F.array_except(F.array(*map(F.lit, STANDARD)), F.col("a"))
    return sets.select("book", "chapter", F.array_join("a", ",").alias("activities"), F.array_join(missing, ",").alias("missing"))


ACTIVITY_RANK_SQL = "CASE activity " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in ACTIVITY_ORDER.items()) + " END"


@register(
    "adjacent_type_edges",
    f"""WITH {ACTIVITY_SQL}, l AS (SELECT topic_id AS child, activity, lag(topic_id) OVER w AS parent, lag(activity) OVER w AS before FROM typed
        WINDOW w AS (PARTITION BY book, chapter ORDER BY {ACTIVITY_RANK_SQL}, coalesce(page_start, 0), topic_id)) SELECT child, parent FROM l WHERE before <> activity""",
)
def adjacent_type_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In teaching order a topic needs the one before it, if their types differ."""
    rank = F.create_map(*[F.lit(x) for kv in ACTIVITY_ORDER.items() for x in kv])[F.col("activity")]
    ranked = typed(spark, sf_dir).withColumn("rank", rank)
    w = W.partitionBy("book", "chapter").orderBy("rank", F.coalesce("page_start", F.lit(0)), "topic_id")
    linked = ranked.select(F.col("topic_id").alias("child"), F.lag("topic_id").over(w).alias("parent"), "activity", F.lag("activity").over(w).alias("before"))
    return linked.where("before <> activity").select("child", "parent")


#: Similarity from which two names of a chapter and type are suspected to be one topic.
SIMILAR = 0.7


def alike_pairs(rows: DataFrame, group: list[str], order: str, name: str, least: float) -> DataFrame:
    """(topic_id, other_id, ratio) of rows of a group whose names are alike by ``least`` or more, the earlier first.

    Equal names are one name with a list of ids. Two names reach the ratio only
    if the shorter one has enough letters, so names meet by length: a name
    looks up the lengths that its own allows. Pairs whose edit distance or
    common letters rule the ratio out go in the JVM, and the rest to Python.
    """
    names = rows.groupBy(*group, name).agg(F.array_sort(F.collect_list(order)).alias("ids")).withColumn("n", F.char_length(name))
    lengths = F.sequence(F.greatest(F.lit(0), F.floor(F.col("n") * (least / (2 - least))).cast("int")), F.col("n"))
    left = names.select(*group, F.col(name).alias("a"), F.col("ids").alias("ids_a"), F.explode(lengths).alias("m"))
    right = names.select(*group, F.col(name).alias("b"), F.col("ids").alias("ids_b"), F.col("n").alias("m"))
    met = left.join(right, [*group, "m"]).where((F.char_length("b") < F.char_length("a")) | (F.col("a") <= F.col("b")))
    met = met.where(2 * F.char_length("b") >= least * (F.char_length("a") + F.char_length("b"))).where(may_reach(F.col("a"), F.col("b"), least))
    # The ratio isn't symmetric: each order of two names that occurs is measured.
    both = met.withColumn("there", seq_ratio("a", "b")).withColumn("back", seq_ratio("b", "a")).where((F.col("there") >= least) | (F.col("back") >= least))
    pairs = both.select("a", "b", "there", "back", F.explode("ids_a").alias("x"), "ids_b").select("a", "b", "there", "back", "x", F.explode("ids_b").alias("y"))
    pairs = pairs.where("x <> y AND (a <> b OR x < y)")
    found = pairs.select(F.least("x", "y").alias("topic_id"), F.greatest("x", "y").alias("other_id"), F.when(F.col("x") < F.col("y"), F.col("there")).otherwise(F.col("back")).alias("ratio"))
    return found.where(F.col("ratio") >= least)


@register("similar_pairs")
def similar_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Topics of one chapter and type whose names are alike by 0.7 or more, the earlier one first."""
    rows = typed(spark, sf_dir).withColumn("name", norm_name(F.col("name"))).select("book", "chapter", "activity", "topic_id", "name")
    return alike_pairs(rows, ["book", "chapter", "activity"], "topic_id", "name", SIMILAR)


#: Names and summaries as extraction returns them, dealt by key; some are garbage in one way or another.
RAW_NAME = "CASE WHEN p_partkey % 11 = 3 THEN [' No Content Found ', 'Content NOT found here', 'CONTENT DISCREPANCY', 'I cannot extract this', 'Not applicable', 'N/A', '  '][CAST(p_partkey // 11 % 7 + 1 AS INT)] ELSE p_name END"
RAW_SUMMARY = "CASE WHEN p_partkey % 13 = 5 THEN [' This page belongs to another chapter.', 'The content on these pages belongs elsewhere', 'There is a clear discrepancy', 'The provided image is empty', 'No content'][CAST(p_partkey // 13 % 5 + 1 AS INT)] WHEN p_partkey % 13 = 6 THEN 'Here: no content' ELSE p_type END"
GARBAGE_SQL = f"""WITH raw AS (SELECT p_partkey AS topic_id, {RAW_NAME} AS name, {RAW_SUMMARY} AS summary FROM part), low AS (SELECT *, lower(trim(name)) AS n, lower(trim(summary)) AS s FROM raw)
SELECT topic_id, name FROM low WHERE n <> '' AND NOT ({" OR ".join(f"contains(n, '{x}')" for x in GARBAGE_NAMES)} OR {" OR ".join(f"starts_with(s, '{x}')" for x in GARBAGE_SUMMARIES)})"""


def _chosen(key: Column, step: int, values: list[str]) -> Column:
    return F.get(F.array(*map(F.lit, values)), (F.floor(key / step) % len(values)).cast("int"))


def raw_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(topic_id, name, summary) as extraction returns them."""
    key = F.col("p_partkey")
    names = [" No Content Found ", "Content NOT found here", "CONTENT DISCREPANCY", "I cannot extract this", "Not applicable", "N/A", "  "]
    openings = [" This page belongs to another chapter.", "The content on these pages belongs elsewhere", "There is a clear discrepancy", "The provided image is empty", "No content"]
    summary = F.when(key % 13 == 5, _chosen(key, 13, openings)).when(key % 13 == 6, "Here: no content").otherwise(F.col("p_type"))
    return table(spark, sf_dir, "part").select(
        key.alias("topic_id"), F.when(key % 11 == 3, _chosen(key, 11, names)).otherwise(F.col("p_name")).alias("name"), summary.alias("summary")
    )


@register("garbage_filter", GARBAGE_SQL)
def garbage_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Topics but those that say that they are none."""
    return raw_topics(spark, sf_dir).where(~is_garbage(F.col("name"), F.col("summary"))).select("topic_id", "name")


@register("debug_sentence_strip", f"WITH {DESCRIBED_SQL} SELECT topic_id, summary || CASE WHEN topic_id % 3 = 0 THEN '. Then more.' ELSE '.' END AS summary FROM described")
def debug_sentence_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Descriptions between sentences about the extraction, without those."""
    meta = F.when(F.col("topic_id") % 3 == 0, ". This page belongs to another chapter. Then more.").when(F.col("topic_id") % 3 == 1, ". NOTE: taken from page 3")
    # Sentences that begin with a late letter of the script, or with one of its digits.
    meta = meta.when(F.col("topic_id") % 6 == 2, ". ౘ NOTE: extracted").when(F.col("topic_id") % 12 == 5, ". ౧౨ as per the prompt").otherwise(".")
    return described(spark, sf_dir).select("topic_id", without_meta(F.concat("summary", meta)).alias("summary"))


@register(
    "json_repair",
    """SELECT event_id, CASE event_id % 4 WHEN 2 THEN '{"a": [1, 2]}' WHEN 3 THEN '{"k": ' || CAST(json_extract(props, '$.k') AS VARCHAR) || ', "t": "open"}' ELSE props END AS json FROM events""",
)
def json_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event properties as models return them: fenced, cut short or with text around; what they hold afterwards."""
    k = F.col("event_id") % 4
    raw = (
        F.when(k == 0, F.col("props"))
        .when(k == 1, F.concat(F.lit("```json\n"), "props", F.lit("\n```")))
        .when(k == 2, F.concat(F.lit('Sure: {"a": [1, 2'), F.lit("")))
        .otherwise(F.concat(F.lit('{"k": '), F.get_json_object("props", "$.k"), F.lit(', "t": "open')))
    )
    return table(spark, sf_dir, "events").select("event_id", robust_json(raw).alias("json"))


#: Faults that models make in JSON, by number; {k} and {t} stand for an event's values.
DAMAGED_JSON = [
    "{'k': {k}, 't': '{t}', 'l': [1, {k}]}",
    '{k: {k}, t: {t}, l: [1, {k}]}',
    '{"k": {k} "t": "{t}" "l": [1 {k}]}',
    '{"k": {k},, "t": "{t}", "l": [1, {k},],}',
    '{“k”: {k}, “t”: “{t}”, "l": [1, {k}]}',
    '{"k" {k}, "t": "{t}", "l": [1, {k}] // as asked\n}',
    '{"k": {k}, "t": "{t}\n "l": [1, {k}]}',
    'Here: {"k": {k}, "t": "{t}", "l": [1, {k}]}, as asked.',
    '{"k": {k}, "t": "{t}", "l": [1, {k}}',
    '{"k": {k}, "t: "{t}", "l": [1, {k}]',
]
#: The same whose text holds quotes of its own.
QUOTED_JSON = '{"k": {k}, "t": "so "{t}", he said", "l": [1, {k}]}'


def _filled(pattern: str) -> Column:
    return F.replace(F.replace(F.lit(pattern), F.lit("{k}"), F.get_json_object("props", "$.k")), F.lit("{t}"), F.col("event_type"))


@register(
    "json_repair_in_place",
    f"""SELECT event_id, '{{"k": ' || (props->>'$.k') || ', "t": "' || CASE WHEN event_id % {len(DAMAGED_JSON) + 1} = {len(DAMAGED_JSON)} THEN 'so \\"' || event_type || '\\", he said' ELSE event_type END
        || '", "l": [1, ' || (props->>'$.k') || ']}}' AS json FROM events""",
)
def json_repair_in_place(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event's values in JSON with one of eleven faults, after which all of them are there."""
    kinds = [*DAMAGED_JSON, QUOTED_JSON]
    raw = F.lit(None).cast("string")
    for i, pattern in enumerate(kinds):
        raw = F.when(F.col("event_id") % len(kinds) == i, _filled(pattern)).otherwise(raw)
    return table(spark, sf_dir, "events").select("event_id", robust_json(raw).alias("json"))


XML = "topic struct<_id:string,name:string,page_start:int,prerequisites:struct<ref:array<string>>>"


@register("xml_flatten", "SELECT p_partkey AS topic_id, 'T_1_' || p_partkey AS id, p_name || ' & co' AS name, p_size AS page_start, 'T_1_2' AS prerequisites FROM part")
def xml_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Topics from XML of which a third lacks its end; prerequisites count only as T_n_m."""
    whole = F.concat(
        F.lit('<chapter><topic id="T_1_'), F.col("topic_id").cast("string"), F.lit('"><name>'), "name", F.lit(" & co</name><page_start>"), F.col("page_start").cast("string"),
        F.lit("</page_start><prerequisites><ref>T_1_2</ref><ref>later</ref></prerequisites>"),
    )
    raw = F.when(F.col("topic_id") % 3 == 0, whole).otherwise(F.concat(whole, F.lit("</topic></chapter>")))
    read = F.from_xml(repair_xml(raw), XML)["topic"]
    found = described(spark, sf_dir).select("topic_id", read.alias("x"))
    refs = F.filter(F.col("x.prerequisites.ref"), lambda r: r.rlike(r"^T_\d+_\d+$"))
    return found.select("topic_id", F.col("x._id").alias("id"), F.col("x.name").alias("name"), F.coalesce("x.page_start", F.lit(0)).alias("page_start"), F.array_join(refs, ",").alias("prerequisites"))


# Subjects and languages by the word in a file's name.
SUBJECTS = {
    "maths": "Mathematics",
    "math": "Mathematics",
    "english": "English",
    "hindi": "Hindi",
    "telugu": "Telugu",
    "tamil": "Tamil",
    "kannada": "Kannada",
    "science": "Science",
    "evs": "Environmental Science",
    "social": "Social Studies",
}
LANGUAGES = {"english": "English", "hindi": "Hindi", "telugu": "Telugu", "tamil": "Tamil", "kannada": "Kannada", "maths": "English", "math": "English"}

_STEM = "'grade' || (p_partkey % 10 + 1) || '_' || ['english','maths','evs','history'][p_partkey % 4 + 1] || CASE WHEN p_partkey % 3 = 0 THEN '_fl' ELSE '' END"


def _stem(key: Column) -> Column:
    subject = F.get(F.array(*map(F.lit, ["english", "maths", "evs", "history"])), (key % 4).cast("int"))
    return F.concat(F.lit("grade"), (key % 10 + 1).cast("string"), F.lit("_"), subject, F.when(key % 3 == 0, "_fl").otherwise(""))


@register(
    "metadata_from_stem",
    f"""WITH s AS (SELECT p_partkey, {_STEM} AS stem, p_partkey % 10 + 1 AS g, p_partkey % 4 AS w FROM part)
        SELECT stem, CAST(g AS VARCHAR) AS grade, ['English','Mathematics','Environmental Science','General'][w + 1] AS subject, 'English' AS language,
        'Grade ' || g || ' ' || ['English','Mathematics','Environmental Science','History'][w + 1] AS title FROM s GROUP BY ALL""",
)
def metadata_from_stem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grade, subject, language and title from the words of a file's name."""
    stems = table(spark, sf_dir, "part").select(_stem(F.col("p_partkey")).alias("stem")).distinct()
    parts = F.split(F.lower("stem"), "_")
    named = lambda d: F.create_map(*[F.lit(x) for kv in d.items() for x in kv])
    word = F.get(F.filter(parts, lambda p: named(SUBJECTS)[p].isNotNull()), F.lit(0))
    grade = F.coalesce(F.nullif(F.regexp_extract(F.get(F.filter(parts, lambda p: p.rlike(r"^grade\d+")), F.lit(0)), r"^grade(\d+)", 1), F.lit("")), F.lit("1"))
    label = lambda p: F.when(p.rlike(r"^grade\d+"), F.concat(F.lit("Grade "), grade)).otherwise(F.coalesce(named(SUBJECTS)[p], F.initcap(p)))
    title = F.array_join(F.transform(F.filter(parts, lambda p: ~p.isin("fl", "sl")), label), " ")
    return stems.select(
        "stem",
        grade.alias("grade"),
        F.coalesce(named(SUBJECTS)[word], F.lit("General")).alias("subject"),
        F.coalesce(named(LANGUAGES)[word], F.lit("English")).alias("language"),
        title.alias("title"),
    )


SUFFIXES = ("_fl", "fl", "_sl", "sl", "_first_language", "_second_language")
_BASE = "regexp_replace(replace(lower(trim(asked)), ' ', '_'), '_+', '_', 'g')"
RESOLVE_SQL = f"""WITH books AS (SELECT DISTINCT {_STEM} AS book FROM part), asks AS (SELECT DISTINCT 'Grade' || (p_partkey % 12 + 1) || ' ' || ['English','Maths','evs_f','Hist'][p_partkey % 4 + 1] AS asked FROM part),
n AS (SELECT asked, {_BASE} AS base FROM asks),
c AS (SELECT asked, book, 0 AS rank FROM asks JOIN books ON book = asked UNION ALL SELECT asked, book, 1 FROM asks JOIN books ON lower(book) = lower(asked)
  UNION ALL SELECT asked, book, 2 FROM n JOIN books ON lower(book) = base
  {''.join(f" UNION ALL SELECT asked, book, {3 + i} FROM n JOIN books ON lower(book) = base || '{s}'" for i, s in enumerate(SUFFIXES))}
  UNION ALL SELECT asked, book, CASE WHEN lower(book) LIKE '%\\_fl' ESCAPE '\\' THEN 20 WHEN lower(book) LIKE '%fl' THEN 21 ELSE 22 END FROM n JOIN books ON starts_with(lower(book), base))
SELECT asked, book FROM c QUALIFY row_number() OVER (PARTITION BY asked ORDER BY rank, book) = 1"""


@register("book_resolution", RESOLVE_SQL)
def book_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Books that requests mean: exact, any case, tidied, with a suffix, else by prefix, first-language editions first.

    All but the prefix are equalities on a key; a prefix is one too, as each
    book is listed under all of its prefixes.
    """
    parts = table(spark, sf_dir, "part")
    books = parts.select(_stem(F.col("p_partkey")).alias("book")).distinct()
    subject = F.get(F.array(*map(F.lit, ["English", "Maths", "evs_f", "Hist"])), (F.col("p_partkey") % 4).cast("int"))
    asks = parts.select(F.concat(F.lit("Grade"), (F.col("p_partkey") % 12 + 1).cast("string"), F.lit(" "), subject).alias("asked")).distinct()
    base = F.regexp_replace(F.replace(F.replace(F.lower(F.trim("asked")), F.lit("%20"), F.lit(" ")), F.lit(" "), F.lit("_")), "_+", "_")
    keys = [(F.concat(F.lit("="), "asked"), 0), (F.lower("asked"), 1), (base, 2), *((F.concat(base, F.lit(s)), 3 + i) for i, s in enumerate(SUFFIXES)), (F.concat(F.lit("^"), base), 20)]
    wanted = asks.select("asked", F.explode(F.array(*[F.struct(k.alias("key"), F.lit(r).alias("rank")) for k, r in keys])).alias("w")).select("asked", "w.*")
    low = F.lower("book")
    prefixes = F.transform(F.sequence(F.lit(1), F.char_length(low)), lambda n: F.concat(F.lit("^"), F.substring(low, F.lit(1), n)))
    listed = books.select("book", F.explode(F.concat(F.array(F.concat(F.lit("="), "book"), low), prefixes)).alias("key"))
    late = F.when(F.col("book").endswith("_fl"), 0).when(F.col("book").endswith("fl"), 1).otherwise(2)
    found = wanted.join(listed, "key").withColumn("rank", F.when(F.col("rank") == 20, F.col("rank") + late).otherwise(F.col("rank")))
    return first_by(found, ["asked"], [F.col("rank"), F.col("book")]).select("asked", "book")


@register(
    "id_functions",
    r"""WITH t AS (SELECT *, 'T_' || p_partkey % 5 || '_' || p_partkey AS id, p_name || '? A' AS label, p_size || '0 minutes' AS time, '```json' || chr(10) || p_name || chr(10) || '```' AS fenced FROM part)
       SELECT p_partkey AS topic_id, regexp_replace(id, '^T_3_', 'T_9_') AS moved, coalesce(try_cast(regexp_extract(id, '([^_]*)$', 1) AS INT), 999) AS suffix,
       lower(replace(regexp_replace(label, '[<>:"/\\|?*]', '', 'g'), ' ', '_')) AS dir, CAST(regexp_replace(time, '\D', '', 'g') AS INT) AS minutes,
       regexp_replace(regexp_replace(fenced, '^```[a-zA-Z]*\s*', ''), '\s*```$', '') AS bare FROM t""",
)
def id_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids moved to another chapter, numeric suffixes, directory names, digits and fences."""
    ident = F.concat_ws("_", F.lit("T"), (F.col("p_partkey") % 5).cast("string"), F.col("p_partkey").cast("string"))
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("topic_id"),
        canonical_ids(ident, F.lit(3), F.lit(9)).alias("moved"),
        F.coalesce(F.element_at(F.split(ident, "_"), -1).try_cast("int"), F.lit(999)).alias("suffix"),
        safe_dirname(F.concat("p_name", F.lit("? A"))).alias("dir"),
        digits_only(F.concat(F.col("p_size").cast("string"), F.lit("0 minutes"))).alias("minutes"),
        strip_fences(F.concat(F.lit("```json\n"), "p_name", F.lit("\n```"))).alias("bare"),
    )


@register(
    "substitute_exercises",
    r"""WITH plans AS (SELECT o_orderkey AS plan, 'Do E_1_1_' || o_custkey || ' then E_1_2_' || o_orderkey || ' and E_1_1_' || o_custkey || '.' AS text FROM orders),
        found AS (SELECT plan, text, regexp_extract_all(text, 'E_\d+_\d+_\d+') AS ids FROM plans),
        a AS (SELECT plan, replace(text, ids[1], coalesce(p.p_name, ids[1])) AS text, ids, p.p_partkey IS NOT NULL AS one FROM found LEFT JOIN part p ON 'E_1_1_' || p.p_partkey = ids[1])
        SELECT plan, replace(text, ids[2], coalesce(p.p_name, ids[2])) AS text, CAST(len(list_distinct(ids)) AS INT) AS n_ids, CAST(one AS INT) + CAST(p.p_partkey IS NOT NULL AS INT) AS n_known
        FROM a LEFT JOIN part p ON 'E_1_2_' || p.p_partkey = ids[2]""",
)
def substitute_exercises(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exercise ids in every plan's text, found once each and replaced in the order found; unknown ones stay."""
    mine, other = F.concat(F.lit("E_1_1_"), F.col("o_custkey").cast("string")), F.concat(F.lit("E_1_2_"), F.col("o_orderkey").cast("string"))
    text = F.concat(F.lit("Do "), mine, F.lit(" then "), other, F.lit(" and "), mine, F.lit("."))
    plans = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("plan"), text.alias("text"))
    key = F.col("p_partkey").cast("string")
    parts = table(spark, sf_dir, "part").select("p_name", F.explode(F.array(F.concat(F.lit("E_1_1_"), key), F.concat(F.lit("E_1_2_"), key))).alias("id"))
    return substituted(plans, "plan", "text", parts.select("id", F.col("p_name").alias("exercise"))).select("plan", "text", "n_ids", "n_known")


def substituted(plans: DataFrame, key: str, text: str, lookup: DataFrame) -> DataFrame:
    """Rows of (key, text) with ids E_a_b_c replaced by their exercise of (id, exercise), one id after the other as they are met."""
    found = plans.withColumn("ids", F.array_distinct(F.regexp_extract_all(text, F.lit(r"E_\d+_\d+_\d+"), 0)))
    hits = found.select(key, F.posexplode("ids").alias("i", "id")).join(lookup, "id")
    maps = hits.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("i", "id", "exercise"))).alias("subs"))
    done = F.aggregate("subs", F.col(text), lambda acc, s: F.replace(acc, s["id"], s["exercise"]))
    joined = found.join(maps, key, "left")
    counts = {"n_ids": F.size("ids"), "n_known": F.coalesce(F.size("subs"), F.lit(0))}
    return joined.withColumns({text: F.coalesce(done, F.col(text)), **counts}).drop("ids", "subs")


@register(
    "text_cards",
    rf"""WITH t AS (SELECT doc_id, coalesce(text, '') AS text, lang FROM documents)
         SELECT doc_id, CASE WHEN length(text) > 280 THEN regexp_replace(left(text, 279), '[{SPACES}]+$', '') || '…' ELSE text END AS card,
         NOT regexp_matches(text, '[^\x00-\x7F]') AND lang <> 'en' AS transliterated FROM t""",
)
def text_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts cut at 280 with an ellipsis, and whether a foreign one is written in ASCII alone; a missing text counts as empty."""
    rows = table(spark, sf_dir, "documents").withColumn("text", F.coalesce("text", F.lit("")))
    plain = ~F.col("text").rlike(r"[^\x00-\x7F]") & (F.col("lang") != "en")
    return rows.select("doc_id", truncated(F.col("text")).alias("card"), plain.alias("transliterated"))
