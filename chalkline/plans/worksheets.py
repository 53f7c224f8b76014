"""Worksheets: validation, grading, answer keys.

A worksheet is an order; its questions are the order's lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chalkline.functions.numeric import round_half_up
from chalkline.plans.registry import register
from chalkline.sources.tables import table

OBJECTIVE = ("mcq", "multiple_choice", "true_false")


def normal_answer(x: Column) -> Column:
    return F.lower(F.trim(x))


def marks(kind: Column, expected: Column, given: Column, each: Column, partial: Column) -> Column:
    """Marks of an answer: none if blank, all or none on objective types, else the share that an outside grader gave, to a tenth."""
    blank = F.trim(F.coalesce(given, F.lit(""))) == ""
    exact = F.when(normal_answer(given) == normal_answer(expected), each.cast("double")).otherwise(0.0)
    return F.when(blank, 0.0).when(kind.isin(*OBJECTIVE), exact).otherwise(round_half_up(each * partial, 1))


QUESTIONS_SQL = """q AS (SELECT l_orderkey AS worksheet, l_linenumber AS number, ['mcq','true_false','short_answer'][l_linenumber % 3 + 1] AS kind, l_returnflag AS expected,
  CASE WHEN l_partkey % 5 = 0 THEN ' ' WHEN l_partkey % 2 = 0 THEN ' ' || lower(l_returnflag) ELSE 'Z' END AS given, 1 + l_suppkey % 3 AS each, (l_partkey % 11) / 10.0::DOUBLE AS partial FROM lineitem)"""


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.get(F.array(F.lit("mcq"), F.lit("true_false"), F.lit("short_answer")), F.col("l_linenumber") % 3)
    given = F.when(F.col("l_partkey") % 5 == 0, " ").when(F.col("l_partkey") % 2 == 0, F.concat(F.lit(" "), F.lower("l_returnflag"))).otherwise("Z")
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("worksheet"),
        F.col("l_linenumber").alias("number"),
        kind.alias("kind"),
        F.col("l_returnflag").alias("expected"),
        given.alias("given"),
        (1 + F.col("l_suppkey") % 3).alias("each"),
        ((F.col("l_partkey") % 11) / 10.0).alias("partial"),
    )


@register(
    "grade_worksheet",
    f"""WITH {QUESTIONS_SQL}, m AS (SELECT worksheet, each, CASE WHEN trim(given) = '' THEN 0.0::DOUBLE WHEN kind <> 'short_answer' THEN CASE WHEN lower(trim(given)) = lower(trim(expected)) THEN each::DOUBLE ELSE 0.0::DOUBLE END
        ELSE floor(each * partial * 10 + 0.5) / 10.0::DOUBLE END AS got FROM q), t AS (SELECT worksheet, CAST(sum(each) AS BIGINT) AS total, sum(CAST(got AS DECIMAL(18,1)))::DOUBLE AS earned FROM m GROUP BY worksheet)
        SELECT worksheet, total, earned, CASE WHEN total = 0 THEN 0.0::DOUBLE ELSE floor(earned / total * 100 * 10 + 0.5) / 10.0::DOUBLE END AS percentage FROM t""",
)
def grade_worksheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = marks(F.col("kind"), F.col("expected"), F.col("given"), F.col("each"), F.col("partial"))
    sums = questions(spark, sf_dir).groupBy("worksheet").agg(
        F.sum("each").alias("total"), F.sum(got.cast("decimal(18,1)")).cast("double").alias("earned")
    )
    percentage = F.when(F.col("total") == 0, 0.0).otherwise(round_half_up(F.col("earned") / F.col("total") * 100, 1))
    return sums.withColumn("percentage", percentage)


@register(
    "validate_questions",
    """WITH q AS (SELECT l_orderkey AS worksheet, l_returnflag AS section, CASE WHEN l_partkey % 6 = 0 THEN '' ELSE l_linestatus END AS question, coalesce(nullif(CAST(l_suppkey % 4 AS INT), 0), 1) AS each,
       CASE WHEN l_partkey % 4 = 0 THEN 'remember' ELSE 'apply' END AS bloom FROM lineitem)
       SELECT worksheet, section, count(*) AS questions, CAST(sum(each) AS BIGINT) AS marks, count(*) FILTER (bloom = 'remember') AS defaulted FROM q WHERE question <> '' GROUP BY ALL""",
)
def validate_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections as nested arrays: questions without a text go, missing fields get defaults, marks are added up, empty sections go."""
    question = F.struct(
        F.when(F.col("l_partkey") % 6 == 0, "").otherwise(F.col("l_linestatus")).alias("question"),
        F.nullif((F.col("l_suppkey") % 4).cast("int"), F.lit(0)).alias("each"),
        F.when(F.col("l_partkey") % 4 != 0, "apply").alias("bloom"),
    )
    sections = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("worksheet"), F.col("l_returnflag").alias("section")).agg(F.collect_list(question).alias("raw"))
    kept = F.filter("raw", lambda q: q["question"] != "")
    fixed = F.transform(kept, lambda q: F.struct(F.coalesce(q["each"], F.lit(1)).alias("each"), F.coalesce(q["bloom"], F.lit("remember")).alias("bloom")))
    return (
        sections.withColumn("qs", fixed)
        .where(F.size("qs") > 0)
        .select(
            "worksheet",
            "section",
            F.size("qs").cast("long").alias("questions"),
            F.aggregate("qs", F.lit(0).cast("long"), lambda a, q: a + q["each"]).alias("marks"),
            F.size(F.filter("qs", lambda q: q["bloom"] == "remember")).cast("long").alias("defaulted"),
        )
    )


@register(
    "recovery_letters",
    """SELECT l_orderkey AS worksheet, l_linenumber, l_extendedprice, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_extendedprice) AS INT) AS number,
       CASE WHEN l_partkey % 3 = 0 THEN 'B' WHEN l_partkey % 3 = 1 THEN 'C' ELSE 'none' END AS answer FROM lineitem""",
)
def recovery_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions numbered anew; an answer that opens with A to D is that letter."""
    raw = F.when(F.col("l_partkey") % 3 == 0, "B) half").when(F.col("l_partkey") % 3 == 1, "C").otherwise("none")
    letter = F.when((F.char_length(raw) > 1) & raw.rlike("^[A-D]"), F.substring(raw, 1, 1)).otherwise(raw)
    row = F.struct("l_linenumber", "l_partkey", "l_extendedprice", letter.alias("answer"))
    sheets = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("worksheet")).agg(F.array_sort(F.collect_list(row)).alias("qs"))
    return sheets.select("worksheet", F.posexplode("qs").alias("i", "q")).select(
        "worksheet", "q.l_linenumber", "q.l_extendedprice", (F.col("i") + 1).alias("number"), "q.answer"
    )


@register(
    "answer_key_lines",
    """SELECT l_orderkey AS worksheet, l_partkey, l_extendedprice, l_linenumber || '. ' || l_returnflag || CASE WHEN l_partkey % 2 = 0 THEN ' [apply | easy]' ELSE '' END AS line FROM lineitem""",
)
def answer_key_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    badge = F.when(F.col("l_partkey") % 2 == 0, " [apply | easy]").otherwise("")
    line = F.concat(F.col("l_linenumber").cast("string"), F.lit(". "), "l_returnflag", badge)
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("worksheet"), "l_partkey", "l_extendedprice", line.alias("line"))


@register(
    "quiz_shape",
    """WITH n AS (SELECT l_orderkey AS quiz, count(*) AS n FROM lineitem GROUP BY l_orderkey) SELECT quiz, n, greatest(3, CAST(round_even(0.4::DOUBLE * n, 0) AS INT)) AS mcq,
       CAST(n - greatest(3, CAST(round_even(0.4::DOUBLE * n, 0) AS INT)) AS BIGINT) AS subjective, CAST(greatest(10, least(40, n)) AS BIGINT) AS minutes FROM n""",
)
def quiz_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two fifths of the questions are multiple choice, three at least; a minute each, between 10 and 40."""
    sizes = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("quiz")).agg(F.count(F.lit(1)).alias("n"))
    mcq = F.greatest(F.lit(3), F.bround(0.4 * F.col("n"), 0).cast("int"))
    return sizes.select("quiz", "n", mcq.alias("mcq"), (F.col("n") - mcq).alias("subjective"), F.greatest(F.lit(10), F.least(F.lit(40), F.col("n"))).cast("long").alias("minutes"))


@register(
    "week_start_dates",
    """SELECT o_orderkey AS plan, CAST(o_orderdate AS DATE) AS start, strftime(o_orderdate, '%Y-%m-%d') AS label, dayofweek(o_orderdate) = 1 AS valid,
       ['Monday','Tuesday','Wednesday','Thursday','Friday'][o_orderkey % 5 + 1] AS day FROM orders""",
)
def week_start_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Week starts must be Mondays; days are named by number."""
    label = F.substring(F.col("o_orderdate").cast("string"), 1, 10)
    start = F.try_to_date(label, "yyyy-MM-dd")
    names = F.array(*map(F.lit, ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday"]))
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("plan"), start.alias("start"), label.alias("label"), (F.weekday(start) == 0).alias("valid"), F.element_at(names, (F.col("o_orderkey") % 5 + 1).cast("int")).alias("day")
    )
