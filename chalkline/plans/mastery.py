"""Mastery, frustration and growth of students over their quiz submissions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chalkline.functions.numeric import clamp, mastery_score, round_half_up
from chalkline.operators.folds import newest, ordered_fold
from chalkline.plans.registry import register
from chalkline.sources.tables import submissions, table

#: The submissions view and its mastery column, as SQL.
SUBMISSIONS_SQL = """
submissions AS (
  SELECT event_id, user_id AS student_id, event_type AS topic, ts AS submitted_at,
         least(1.0::DOUBLE, value / 200) AS score, 1 + k % 4 AS attempts, k % 6 AS hints, 60 + 9 * k AS time_spent
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events)),
scored AS (
  SELECT *, floor((0.6::DOUBLE * score + 0.2::DOUBLE / greatest(attempts, 1)
         + 0.2::DOUBLE * least(1.0::DOUBLE, 300 / greatest(time_spent, 1)::DOUBLE)) * 100 + 0.5) / 100.0::DOUBLE AS mastery
  FROM submissions)
"""

#: Latest blended mastery of each student and topic, as SQL.
BLENDED_SQL = f"""{SUBMISSIONS_SQL},
numbered AS (SELECT *, row_number() OVER (PARTITION BY student_id, topic ORDER BY submitted_at, event_id) AS rn FROM scored),
fold AS (
  SELECT student_id, topic, rn, mastery AS m FROM numbered WHERE rn = 1
  UNION ALL
  SELECT n.student_id, n.topic, n.rn, floor((0.7::DOUBLE * n.mastery + 0.3::DOUBLE * f.m) * 100 + 0.5) / 100.0::DOUBLE
  FROM fold f JOIN numbered n ON n.student_id = f.student_id AND n.topic = f.topic AND n.rn = f.rn + 1),
blended AS (
  SELECT f.student_id, f.topic, f.m AS mastery, f.rn AS n_events FROM fold f
  JOIN (SELECT student_id, topic, max(rn) AS rn FROM numbered GROUP BY ALL) l USING (student_id, topic, rn))
"""

#: Latest frustration of each student, as SQL.
FRUSTRATION_SQL = """
by_student AS (
  SELECT student_id, row_number() OVER (PARTITION BY student_id ORDER BY submitted_at, event_id) AS rn,
         0.4::DOUBLE * greatest(0.0::DOUBLE, 1 - score) + 0.3::DOUBLE * least(1.0::DOUBLE, (attempts - 1) / 2.0::DOUBLE)
         + 0.3::DOUBLE * least(1.0::DOUBLE, hints / 5.0::DOUBLE) AS rule FROM scored),
mood AS (
  SELECT student_id, 0 AS rn, 0.0::DOUBLE AS f FROM (SELECT DISTINCT student_id FROM scored)
  UNION ALL
  SELECT b.student_id, CAST(b.rn AS INT), least(1.0::DOUBLE, greatest(0.0::DOUBLE,
         floor((0.5::DOUBLE * m.f + 0.5::DOUBLE * b.rule) * 100 + 0.5) / 100.0::DOUBLE))
  FROM mood m JOIN by_student b ON b.student_id = m.student_id AND b.rn = m.rn + 1),
frustrated AS (
  SELECT m.student_id, m.f AS frustration FROM mood m
  JOIN (SELECT student_id, max(rn) AS rn FROM by_student GROUP BY ALL) l ON l.student_id = m.student_id AND l.rn = m.rn)
"""


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return submissions(spark, sf_dir).withColumn(
        "mastery", mastery_score(F.col("score"), F.col("attempts"), F.col("time_spent"), F.col("expected_time"))
    )


def blended(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mastery of each student and topic: 0.7 new + 0.3 previous, rounded at each submission."""
    return ordered_fold(
        scored(spark, sf_dir),
        ["student_id", "topic"],
        ["submitted_at", "event_id"],
        ["mastery"],
        F.lit(None).cast("double"),
        lambda m, e: F.coalesce(round_half_up(0.7 * e["mastery"] + 0.3 * m), e["mastery"]),
        "mastery",
    )


def quiz_rule(score: Column, attempts: Column, hints: Column) -> Column:
    """0.4 of what the score misses + 0.3 attempts + 0.3 hints, without the lower clamp of attempts."""
    return 0.4 * F.greatest(F.lit(0.0), 1 - score) + 0.3 * F.least(F.lit(1.0), (attempts - 1) / 2.0) + 0.3 * F.least(F.lit(1.0), hints / 5.0)


def frustration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frustration of each student over all topics, from 0, halved towards each submission's rule."""
    return ordered_fold(
        submissions(spark, sf_dir),
        ["student_id"],
        ["submitted_at", "event_id"],
        ["score", "attempts", "hints"],
        F.lit(0.0),
        lambda f, e: clamp(round_half_up(0.5 * f + 0.5 * quiz_rule(e["score"], e["attempts"], e["hints"])), 0.0, 1.0),
        "frustration",
    )


def exact_mean(x: str, digits: int = 2) -> Column:
    """Mean of rounded values through an exact sum, so that no order of addition shows."""
    return F.sum(F.col(x).cast(f"decimal(18,{digits})")).cast("double") / F.count(x)


def mean_sql(x: str, digits: int = 2) -> str:
    return f"(sum(CAST({x} AS DECIMAL(18,{digits})))::DOUBLE / count({x}))"


@register("mastery_score", f"WITH {SUBMISSIONS_SQL} SELECT event_id, student_id, topic, mastery FROM scored")
def mastery_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spark, sf_dir).select("event_id", "student_id", "topic", "mastery")


@register(
    "class_mastery_stats",
    f"""WITH {SUBMISSIONS_SQL} SELECT topic, floor({mean_sql('mastery')} * 100 + 0.5) / 100.0::DOUBLE AS avg_mastery,
        count(*) FILTER (mastery < 0.6) AS struggling FROM scored GROUP BY topic""",
)
def class_mastery_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    struggling = F.count_if(F.col("mastery") < 0.6).alias("struggling")
    return scored(spark, sf_dir).groupBy("topic").agg(round_half_up(exact_mean("mastery")).alias("avg_mastery"), struggling)


@register(
    "mastery_blend_fold",
    f"""WITH RECURSIVE {BLENDED_SQL} SELECT b.student_id, b.topic, b.mastery, CAST(b.n_events AS INT) AS n_events,
        t.attempts, t.time_spent, t.hints
        FROM blended b JOIN (SELECT student_id, topic, CAST(sum(attempts) AS BIGINT) AS attempts, CAST(sum(time_spent) AS BIGINT) AS time_spent,
                             CAST(sum(hints) AS BIGINT) AS hints FROM scored GROUP BY ALL) t USING (student_id, topic)""",
)
def mastery_blend_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blended mastery with the running sums of attempts, time and hints."""
    sums = submissions(spark, sf_dir).groupBy("student_id", "topic").agg(*[F.sum(c).alias(c) for c in ("attempts", "time_spent", "hints")])
    return blended(spark, sf_dir).join(sums, ["student_id", "topic"])


@register("frustration_fold", f"WITH RECURSIVE {SUBMISSIONS_SQL}, {FRUSTRATION_SQL} SELECT student_id, frustration FROM frustrated")
def frustration_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frustration(spark, sf_dir).select("student_id", "frustration")


LAST3_SQL = f"""{SUBMISSIONS_SQL},
last3 AS (
  SELECT student_id, submitted_at, event_id,
         sum(CAST(round(score * 1000000) AS BIGINT)) OVER w / 1000000.0::DOUBLE / count(*) OVER w AS s,
         sum(attempts) OVER w / (count(*) OVER w)::DOUBLE AS a, sum(hints) OVER w / (count(*) OVER w)::DOUBLE AS h
  FROM submissions WINDOW w AS (PARTITION BY student_id, topic ORDER BY submitted_at, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW))
"""


@register(
    "frustration_last3",
    f"""WITH {LAST3_SQL} SELECT event_id, student_id, floor((0.4::DOUBLE * greatest(0.0::DOUBLE, 1 - s)
        + 0.3::DOUBLE * least(1.0::DOUBLE, (a - 1) / 2.0::DOUBLE) + 0.3::DOUBLE * least(1.0::DOUBLE, h / 5.0::DOUBLE)) * 10000 + 0.5)
        / 10000.0::DOUBLE AS rule FROM last3""",
)
def frustration_last3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each submission's rule over the means of the student's last three on the topic."""
    frame = W.partitionBy("student_id", "topic").orderBy("submitted_at", "event_id").rowsBetween(-2, 0)
    n = F.count(F.lit(1)).over(frame)
    mean = lambda c: F.sum(c).over(frame) / n.cast("double")
    score = F.sum(F.round(F.col("score") * 1_000_000).cast("long")).over(frame) / 1_000_000.0 / n
    rule = quiz_rule(score, mean("attempts"), mean("hints"))
    return submissions(spark, sf_dir).select("event_id", "student_id", round_half_up(rule, 4).alias("rule"))


@register(
    "frustration_last3_fold",
    f"""WITH RECURSIVE {LAST3_SQL},
    ruled AS (SELECT student_id, row_number() OVER (PARTITION BY student_id ORDER BY submitted_at, event_id) AS rn,
              0.4::DOUBLE * greatest(0.0::DOUBLE, 1 - s) + 0.3::DOUBLE * least(1.0::DOUBLE, (a - 1) / 2.0::DOUBLE)
              + 0.3::DOUBLE * least(1.0::DOUBLE, h / 5.0::DOUBLE) AS rule FROM last3),
    mood AS (SELECT student_id, 0 AS rn, 0.0::DOUBLE AS f FROM (SELECT DISTINCT student_id FROM ruled)
             UNION ALL SELECT r.student_id, CAST(r.rn AS INT), floor((0.5::DOUBLE * m.f + 0.5::DOUBLE * r.rule) * 100 + 0.5) / 100.0::DOUBLE
             FROM mood m JOIN ruled r ON r.student_id = m.student_id AND r.rn = m.rn + 1)
    SELECT m.student_id, m.f AS frustration FROM mood m
    JOIN (SELECT student_id, max(rn) AS rn FROM ruled GROUP BY ALL) l ON l.student_id = m.student_id AND l.rn = m.rn""",
)
def frustration_last3_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The engine's frustration: the same fold over the rule of the last three."""
    frame = W.partitionBy("student_id", "topic").orderBy("submitted_at", "event_id").rowsBetween(-2, 0)
    n = F.count(F.lit(1)).over(frame)
    mean = lambda c: F.sum(c).over(frame) / n.cast("double")
    score = F.sum(F.round(F.col("score") * 1_000_000).cast("long")).over(frame) / 1_000_000.0 / n
    ruled = submissions(spark, sf_dir).withColumn("rule", quiz_rule(score, mean("attempts"), mean("hints")))
    fold = ordered_fold(
        ruled, ["student_id"], ["submitted_at", "event_id"], ["rule"], F.lit(0.0), lambda f, e: round_half_up(0.5 * f + 0.5 * e["rule"]), "frustration"
    )
    return fold.select("student_id", "frustration")


MATRIX_SQL = f"""{BLENDED_SQL},
matrix AS (SELECT s.student_id, t.topic, coalesce(b.mastery, 0.0::DOUBLE) AS mastery
  FROM (SELECT DISTINCT user_id AS student_id FROM events UNION SELECT c_custkey FROM customer) s CROSS JOIN (SELECT DISTINCT topic FROM scored) t
  LEFT JOIN blended b ON b.student_id = s.student_id AND b.topic = t.topic)
"""


def zero_filled(known: DataFrame, groups: DataFrame, by: list[str]) -> DataFrame:
    """(by, topic, avg_mastery, struggling) where every student counts for every topic, with 0 where nothing is known.

    ``known`` has (by, topic, mastery), ``groups`` (by, students). No pair of
    student and topic is made: unknown ones add nothing to a sum, and are
    struggling like all who haven't reached 0.7.
    """
    sums = known.groupBy(*by, "topic").agg(F.sum(F.col("mastery").cast("decimal(20,6)")).alias("_sum"), F.count_if(F.col("mastery") >= 0.7).alias("_fine"))
    every = groups.crossJoin(known.select("topic").distinct()) if by else known.select("topic").distinct().crossJoin(F.broadcast(groups))  # groups x topics; one group is one row
    found = every.join(sums, [*by, "topic"], "left")
    mean = F.coalesce(F.col("_sum"), F.lit(0)).cast("double") / F.col("students")
    return found.select(*by, "topic", round_half_up(mean).alias("avg_mastery"), (F.col("students") - F.coalesce("_fine", F.lit(0))).alias("struggling"))


@register(
    "class_matrix_zero_filled",
    f"""WITH RECURSIVE {MATRIX_SQL} SELECT topic, floor({mean_sql('mastery')} * 100 + 0.5) / 100.0::DOUBLE AS avg_mastery,
        count(*) FILTER (mastery < 0.7) AS struggling FROM matrix GROUP BY topic""",
)
def class_matrix_zero_filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean mastery and struggling students of each topic over all students, known or not."""
    users = submissions(spark, sf_dir).select("student_id").union(table(spark, sf_dir, "customer").select("c_custkey")).distinct()
    return zero_filled(blended(spark, sf_dir), users.agg(F.count(F.lit(1)).alias("students")), [])


AT_RISK_SQL = f"""{BLENDED_SQL}, {FRUSTRATION_SQL},
averages AS (SELECT student_id, {mean_sql('mastery')} AS avg_mastery FROM blended GROUP BY student_id),
risk AS (
  SELECT c.c_custkey AS student_id, c.c_name AS name, coalesce(a.avg_mastery, 0.0::DOUBLE) AS raw, coalesce(f.frustration, 0.0::DOUBLE) AS frustration
  FROM customer c LEFT JOIN averages a ON a.student_id = c.c_custkey LEFT JOIN frustrated f ON f.student_id = c.c_custkey)
"""


def risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each student's unrounded mean mastery (0 if none) and frustration."""
    means = blended(spark, sf_dir).groupBy("student_id").agg(exact_mean("mastery").alias("raw"))
    students = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("student_id"), F.col("c_name").alias("name"))
    moods = frustration(spark, sf_dir).select("student_id", "frustration")
    return students.join(means, "student_id", "left").join(moods, "student_id", "left").fillna(0.0, ["raw", "frustration"])


@register(
    "at_risk_students",
    f"""WITH RECURSIVE {AT_RISK_SQL} SELECT student_id, name, floor(raw * 100 + 0.5) / 100.0::DOUBLE AS avg_mastery, frustration
        FROM risk WHERE raw < 0.6 OR frustration > 0.6""",
)
def at_risk_students(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = risk(spark, sf_dir).where("raw < 0.6D OR frustration > 0.6D")
    return found.select("student_id", "name", round_half_up(F.col("raw")).alias("avg_mastery"), "frustration")


@register(
    "dashboard_summary",
    f"""WITH RECURSIVE {AT_RISK_SQL} SELECT n_name AS class_name, count(*) AS students, count(*) FILTER (raw < 0.6 OR frustration > 0.6) AS at_risk
        FROM risk JOIN customer ON c_custkey = student_id JOIN nation ON n_nationkey = c_nationkey GROUP BY n_name""",
)
def dashboard_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Students and students at risk of each class, in one join instead of a query for each student."""
    classes = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("student_id"), F.col("c_nationkey").alias("n_nationkey"))
    names = table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_name").alias("class_name"))
    joined = risk(spark, sf_dir).join(classes, "student_id").join(names, "n_nationkey")
    return joined.groupBy("class_name").agg(
        F.count(F.lit(1)).alias("students"), F.count_if((F.col("raw") < 0.6) | (F.col("frustration") > 0.6)).alias("at_risk")
    )


@register(
    "quiz_history_topn",
    f"""WITH {SUBMISSIONS_SQL}, ranked AS (SELECT *, row_number() OVER (PARTITION BY student_id ORDER BY submitted_at DESC, event_id DESC) AS rank FROM scored)
        SELECT student_id, CAST(rank AS INT) AS rank, event_id, topic, score, attempts FROM ranked WHERE rank <= 50""",
)
def quiz_history_topn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 newest submissions of each student."""
    found = newest(submissions(spark, sf_dir), ["student_id"], [F.desc("submitted_at"), F.desc("event_id")], 50)
    return found.select("student_id", "rank", "event_id", "topic", "score", "attempts")


GROWTH_SQL = f"""{SUBMISSIONS_SQL},
recent AS (
  SELECT student_id, topic AS value, event_id, CAST(floor(score * 5) AS INT) AS score,
         row_number() OVER (PARTITION BY student_id ORDER BY submitted_at DESC, event_id DESC) AS pos
  FROM submissions QUALIFY pos <= 50),
counted AS (
  SELECT *, row_number() OVER (PARTITION BY student_id ORDER BY pos) AS nth, count(*) OVER (PARTITION BY student_id) AS n
  FROM recent WHERE score <> 0),
halves AS (
  SELECT student_id, any_value(n) AS n, sum(score) AS total,
         sum(score) FILTER (nth <= n // 2) / nullif(count(*) FILTER (nth <= n // 2), 0)::DOUBLE AS late,
         sum(score) FILTER (nth > n // 2) / (count(*) FILTER (nth > n // 2))::DOUBLE AS early
  FROM counted GROUP BY student_id),
best AS (SELECT student_id, event_id FROM recent QUALIFY row_number() OVER (PARTITION BY student_id ORDER BY score DESC, pos) = 1),
totals AS (SELECT student_id, count(*) AS total FROM recent GROUP BY student_id)
"""


@register(
    "growth_trend",
    f"""WITH {GROWTH_SQL} SELECT t.student_id, t.total AS reflections,
        coalesce(floor(h.total / h.n::DOUBLE * 10 + 0.5) / 10.0::DOUBLE, 0.0::DOUBLE) AS avg_score,
        CASE WHEN h.n >= 4 AND late - early >= 0.5 THEN 'growing' WHEN h.n >= 4 AND early - late >= 0.5 THEN 'needs support' ELSE 'steady' END AS trend,
        b.event_id AS best_event
        FROM totals t LEFT JOIN halves h USING (student_id) JOIN best b USING (student_id)""",
)
def growth_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Newest 50 reflections of each student: mean of the scores that aren't 0, trend of their halves, best one (newest on ties)."""
    rated = submissions(spark, sf_dir).withColumn("stars", F.floor(F.col("score") * 5).cast("int"))
    recent = newest(rated, ["student_id"], [F.desc("submitted_at"), F.desc("event_id")], 50)
    counted = F.col("stars") != 0
    own = W.partitionBy("student_id")
    nth = F.count_if(counted).over(own.orderBy("rank").rowsBetween(W.unboundedPreceding, W.currentRow))
    placed = recent.withColumn("nth", nth).withColumn("n", F.count_if(counted).over(own))
    half = F.expr("n div 2")
    mean = lambda when: F.sum(F.when(when & counted, F.col("stars"))) / F.nullif(F.count_if(when & counted), F.lit(0)).cast("double")
    late, early = F.col("late"), F.col("early")
    return (
        placed.groupBy("student_id")
        .agg(
            F.count(F.lit(1)).alias("reflections"),
            F.coalesce(round_half_up(mean(F.lit(True)), 1), F.lit(0.0)).alias("avg_score"),
            F.max("n").alias("n"),
            mean(F.col("nth") <= half).alias("late"),
            mean(F.col("nth") > half).alias("early"),
            F.max_by("event_id", F.struct("stars", -F.col("rank"))).alias("best_event"),
        )
        .select(
            "student_id",
            "reflections",
            "avg_score",
            F.when((F.col("n") >= 4) & (late - early >= 0.5), "growing")
            .when((F.col("n") >= 4) & (early - late >= 0.5), "needs support")
            .otherwise("steady")
            .alias("trend"),
            "best_event",
        )
    )


@register(
    "growth_top_values",
    f"""WITH {GROWTH_SQL}, ranked AS (SELECT student_id, value, count(*) AS n,
        row_number() OVER (PARTITION BY student_id ORDER BY count(*) DESC, min(pos)) AS rank FROM recent GROUP BY student_id, value)
        SELECT student_id, CAST(rank AS INT) AS rank, value, n FROM ranked WHERE rank <= 3""",
)
def growth_top_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three most frequent values among a student's newest 50, the one seen first on ties."""
    recent = newest(submissions(spark, sf_dir), ["student_id"], [F.desc("submitted_at"), F.desc("event_id")], 50)
    counts = recent.groupBy("student_id", F.col("topic").alias("value")).agg(F.count(F.lit(1)).alias("n"), F.min("rank").alias("first"))
    return newest(counts, ["student_id"], [F.desc("n"), F.col("first")], 3).select("student_id", "rank", "value", "n")


@register(
    "student_profile_maps",
    f"""WITH RECURSIVE {BLENDED_SQL} SELECT student_id, topic, mastery, CAST(sum(s.attempts) AS BIGINT) AS attempts, CAST(sum(s.hints) AS BIGINT) AS hints
        FROM blended JOIN submissions s USING (student_id, topic) GROUP BY student_id, topic, mastery""",
)
def student_profile_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A profile holds maps by topic; here each map's entries as rows again."""
    entry = lambda c: F.map_from_entries(F.array_sort(F.collect_list(F.struct("topic", c))))
    maps = mastery_blend_fold(spark, sf_dir).groupBy("student_id").agg(*[entry(c).alias(c) for c in ("mastery", "attempts", "hints")])
    return maps.select("student_id", F.explode("mastery").alias("topic", "m"), "attempts", "hints").select(
        "student_id", "topic", F.col("m").alias("mastery"), F.col("attempts")[F.col("topic")].alias("attempts"), F.col("hints")[F.col("topic")].alias("hints")
    )


LEVELS = ("beginner", "intermediate", "advanced")


@register(
    "level_calibration",
    f"""WITH {SUBMISSIONS_SQL} SELECT event_id, [{', '.join(repr(x) for x in LEVELS)}][greatest(1, least(3, event_id % 3 + 1
        + CASE WHEN score < 0.3 THEN -1 WHEN score > 0.8 THEN 1 ELSE 0 END))] AS level FROM scored""",
)
def level_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One level down or up, never beyond the ends; the verdict is an input (here: from the score)."""
    verdict = F.when(F.col("score") < 0.3, -1).when(F.col("score") > 0.8, 1).otherwise(0)
    at = F.greatest(F.lit(0), F.least(F.lit(2), F.col("event_id") % 3 + verdict)).cast("int")
    return submissions(spark, sf_dir).select("event_id", F.get(F.array(*map(F.lit, LEVELS)), at).alias("level"))


@register(
    "roadmap_bands",
    f"""WITH RECURSIVE {BLENDED_SQL} SELECT student_id, topic, CAST(trunc(mastery * 100) AS INT) AS percent,
        CASE WHEN mastery >= 0.8 THEN 'green' WHEN mastery >= 0.6 THEN 'yellow' ELSE 'red' END AS band FROM blended""",
)
def roadmap_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = F.col("mastery")
    band = F.when(m >= 0.8, "green").when(m >= 0.6, "yellow").otherwise("red")
    return blended(spark, sf_dir).select("student_id", "topic", (m * 100).cast("int").alias("percent"), band.alias("band"))


@register(
    "teaching_notes_bands",
    f"""WITH RECURSIVE {BLENDED_SQL}, topics AS (SELECT topic, floor({mean_sql('mastery')} * 100 + 0.5) / 100.0::DOUBLE AS avg_mastery FROM blended GROUP BY topic),
        overall AS (SELECT {mean_sql('avg_mastery')} AS m FROM topics)
        SELECT topic, avg_mastery, avg_mastery < 0.6 AS reinforce,
        CASE WHEN m IS NULL THEN 'Unknown' WHEN m >= 0.75 THEN 'Low' WHEN m >= 0.55 THEN 'Medium' ELSE 'High' END AS expected_difficulty FROM topics, overall""",
)
def teaching_notes_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Topic means, and the class's difficulty from the mean of the means."""
    topics = blended(spark, sf_dir).groupBy("topic").agg(round_half_up(exact_mean("mastery")).alias("avg_mastery"))
    m = F.col("m")
    band = F.when(m.isNull(), "Unknown").when(m >= 0.75, "Low").when(m >= 0.55, "Medium").otherwise("High")
    overall = topics.agg(exact_mean("avg_mastery").alias("m"))
    return topics.crossJoin(F.broadcast(overall)).select(  # one row
        "topic", "avg_mastery", (F.col("avg_mastery") < 0.6).alias("reinforce"), band.alias("expected_difficulty")
    )


@register(
    "low_topics_first_three",
    f"""WITH RECURSIVE {BLENDED_SQL}, stats AS (SELECT c_nationkey AS class_id, topic, floor({mean_sql('mastery')} * 100 + 0.5) / 100.0::DOUBLE AS avg_mastery FROM blended JOIN customer ON c_custkey = student_id GROUP BY ALL)
        SELECT class_id, array_to_string(list(topic ORDER BY topic)[1:3], ',') AS low_topics FROM stats WHERE avg_mastery < 0.6 GROUP BY class_id""",
)
def low_topics_first_three(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first three topics of each class under 0.6, in the order in which topics are listed."""
    classes = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("student_id"), F.col("c_nationkey").alias("class_id"))
    stats = blended(spark, sf_dir).join(classes, "student_id").groupBy("class_id", "topic").agg(round_half_up(exact_mean("mastery")).alias("avg_mastery"))
    low = newest(stats.where("avg_mastery < 0.6D"), ["class_id"], [F.col("topic")], 3)
    return low.groupBy("class_id").agg(F.array_join(F.array_sort(F.collect_list("topic")), ",").alias("low_topics"))


@register(
    "at_risk_labels",
    f"""WITH RECURSIVE {AT_RISK_SQL} SELECT student_id, name || ' (mastery: ' || CAST(CAST(floor(raw * 100 + 0.5) AS INT) AS VARCHAR) || '%)'
        || CASE WHEN frustration > 0.6 THEN ' — high frustration' ELSE '' END AS label FROM risk WHERE raw < 0.6 OR frustration > 0.6
        ORDER BY student_id LIMIT 5""",
)
def at_risk_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of the first five students at risk."""
    percent = F.floor(F.col("raw") * 100 + 0.5).cast("int").cast("string")
    tail = F.when(F.col("frustration") > 0.6, " — high frustration").otherwise("")
    first = risk(spark, sf_dir).where("raw < 0.6D OR frustration > 0.6D").orderBy("student_id").limit(5)
    return first.select("student_id", F.concat("name", F.lit(" (mastery: "), percent, F.lit("%)"), tail).alias("label"))


@register(
    "difficulty_split_thirds",
    """WITH placed AS (SELECT l_partkey AS topic_id, l_orderkey, l_linenumber,
        row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber, l_suppkey, l_quantity, l_extendedprice) - 1 AS i, count(*) OVER (PARTITION BY l_partkey) AS n FROM lineitem)
        SELECT topic_id, CASE WHEN i < n // 3 THEN 'easy' WHEN i < 2 * (n // 3) THEN 'medium' ELSE 'challenge' END AS difficulty, count(*) AS exercises
        FROM placed GROUP BY ALL""",
)
def difficulty_split_thirds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A topic's exercises at n div 3 and 2 (n div 3): the remainder is challenge, unlike ntile."""
    order = W.partitionBy("l_partkey").orderBy("l_orderkey", "l_linenumber", "l_suppkey", "l_quantity", "l_extendedprice")
    placed = table(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").alias("topic_id"),
        (F.row_number().over(order) - 1).alias("i"),
        F.expr("count(1) OVER (PARTITION BY l_partkey) div 3").alias("third"),
    )
    band = F.when(F.col("i") < F.col("third"), "easy").when(F.col("i") < 2 * F.col("third"), "medium").otherwise("challenge")
    return placed.groupBy("topic_id", band.alias("difficulty")).agg(F.count(F.lit(1)).alias("exercises"))


@register(
    "reteach_flags",
    """WITH counts AS (SELECT l_partkey AS question, count(*) FILTER (l_returnflag = 'R') AS wrong, count(*) AS total FROM lineitem GROUP BY l_partkey)
        SELECT question, wrong, total, CAST(round_even(wrong / total::DOUBLE * 100, 0) AS INT) AS percent FROM counts
        WHERE wrong / greatest(total, 1)::DOUBLE > 0.3""",
)
def reteach_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions that over 30% got wrong, with the percentage to the nearest, halves to even."""
    counts = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("question")).agg(
        F.count_if(F.col("l_returnflag") == "R").alias("wrong"), F.count(F.lit(1)).alias("total")
    )
    flagged = counts.where(F.try_divide(F.col("wrong").cast("double"), F.greatest("total", F.lit(1))) > 0.3)
    return flagged.withColumn("percent", F.bround(F.col("wrong") / F.col("total").cast("double") * 100, 0).cast("int"))


@register(
    "class_pulse",
    f"""WITH RECURSIVE {MATRIX_SQL}, weak AS (SELECT c_nationkey AS class_id, topic, floor({mean_sql('mastery')} * 100 + 0.5) / 100.0::DOUBLE AS avg_mastery
        FROM matrix JOIN customer ON c_custkey = student_id GROUP BY ALL),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY class_id ORDER BY avg_mastery, topic) AS rank FROM weak WHERE avg_mastery < 0.7)
        SELECT class_id, CAST(rank AS INT) AS rank, topic, avg_mastery FROM ranked WHERE rank <= 4""",
)
def class_pulse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First four weak topics of each class."""
    classes = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("student_id"), F.col("c_nationkey").alias("class_id"))
    groups = classes.groupBy("class_id").agg(F.count(F.lit(1)).alias("students"))
    means = zero_filled(blended(spark, sf_dir).join(classes, "student_id"), groups, ["class_id"])
    weak = newest(means.where("avg_mastery < 0.7D"), ["class_id"], [F.col("avg_mastery"), F.col("topic")], 4)
    return weak.select("class_id", "rank", "topic", "avg_mastery")
