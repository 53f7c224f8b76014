"""Queries over the prerequisite graph: part n needs part n div 2."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chalkline.operators.folds import first_by
from chalkline.operators.graph import break_cycles, layers, sequence_week
from chalkline.plans.registry import register
from chalkline.sources.documents import parse_legacy
from chalkline.sources.tables import table

EDGES_SQL = "edges AS (SELECT p_partkey AS child, p_partkey // 2 AS parent FROM part WHERE p_partkey >= 1 AND p_partkey // 2 <> p_partkey)"
#: Mastery of a student on a part: the largest quantity of it that they ordered, of 50.
KNOWN_SQL = "known AS (SELECT o_custkey AS student, l_partkey AS topic, max(l_quantity) / 50 AS mastery FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL)"
#: Edges whose ends are in one book.
BOOK_EDGES_SQL = f"{EDGES_SQL}, inside AS (SELECT c.p_type AS book, child, parent FROM edges JOIN part c ON c.p_partkey = child JOIN part p ON p.p_partkey = parent AND p.p_type = c.p_type)"


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part").where("p_partkey >= 1")
    return parts.select(F.col("p_partkey").alias("child"), F.expr("p_partkey div 2").alias("parent")).where("child <> parent")


def known(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(student, topic, mastery) of what students have worked on; nothing else is known of them."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_partkey").alias("topic"), "l_quantity")
    mine = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("student"))
    return lines.join(mine, "l_orderkey").groupBy("student", "topic").agg((F.max("l_quantity") / 50).alias("mastery"))


def book_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(book, child, parent) of edges whose ends are in one book."""
    books = table(spark, sf_dir, "part").select(F.col("p_type").alias("book"), "p_partkey")
    side = lambda c: books.withColumnRenamed("p_partkey", c)
    return edges(spark, sf_dir).join(side("child"), "child").join(side("parent"), ["book", "parent"]).select("book", "child", "parent")


@register(
    "graph_edges_by_name",
    f"WITH {EDGES_SQL} SELECT DISTINCT c.p_name AS child, p.p_name AS parent FROM edges JOIN part c ON c.p_partkey = child JOIN part p ON p.p_partkey = parent",
)
def graph_edges_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges whose ends both exist, by name."""
    names = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    side = lambda c: names.select(F.col("p_partkey").alias(c), F.col("p_name").alias(f"{c}_name"))
    both = edges(spark, sf_dir).join(side("child"), "child").join(side("parent"), "parent")
    return both.select(F.col("child_name").alias("child"), F.col("parent_name").alias("parent")).distinct()


@register(
    "graph_by_names",
    """SELECT DISTINCT p_name AS child, CASE WHEN p_partkey % 5 = 0 THEN 'Unknown ' || p_partkey % 3 ELSE p_type END AS parent FROM part WHERE p_partkey % 2 = 0""",
)
def graph_by_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of the nested form: prerequisites are names, and may name what no topic is called."""
    parent = F.when(F.col("p_partkey") % 5 == 0, F.concat(F.lit("Unknown "), (F.col("p_partkey") % 3).cast("string"))).otherwise(F.col("p_type"))
    needs = F.when(F.col("p_partkey") % 2 == 0, F.array(parent)).otherwise(F.array().cast("array<string>"))
    topic = F.struct(F.col("p_name").alias("topic_name"), needs.alias("prerequisites"))
    books = table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("book")).agg(F.collect_list(topic).alias("topics"))
    chapter = F.array(F.struct(F.lit("One").alias("chapter_name"), "topics"))
    raw = books.select("book", F.to_json(F.struct(chapter.alias("chapters"))).alias("document"))
    return parse_legacy(raw).edges.select("child", "parent").distinct()


@register(
    "resolve_prerequisites",
    """WITH refs AS (SELECT p_partkey AS topic, CASE WHEN p_partkey % 3 = 0 THEN CAST(p_partkey // 2 AS VARCHAR) WHEN p_partkey % 3 = 1 THEN p_name ELSE 'nothing' END AS ref FROM part),
       byname AS (SELECT p_name, max(p_partkey) AS id FROM part GROUP BY p_name)
       SELECT topic, coalesce(i.p_partkey, n.id) AS parent FROM refs LEFT JOIN part i ON CAST(i.p_partkey AS VARCHAR) = ref LEFT JOIN byname n ON n.p_name = ref
       WHERE coalesce(i.p_partkey, n.id) IS NOT NULL""",
)
def resolve_prerequisites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References resolved by id, else by name (the last topic of that name); others go."""
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    key = F.col("p_partkey")
    ref = F.when(key % 3 == 0, F.expr("p_partkey div 2").cast("string")).when(key % 3 == 1, F.col("p_name")).otherwise("nothing")
    by_id = parts.select(key.cast("string").alias("ref"), key.alias("i"))
    by_name = parts.groupBy(F.col("p_name").alias("ref")).agg(F.max("p_partkey").alias("n"))
    found = parts.select(key.alias("topic"), ref.alias("ref")).join(by_id, "ref", "left").join(by_name, "ref", "left")
    return found.select("topic", F.coalesce("i", "n").alias("parent")).where("parent IS NOT NULL")


@register(
    "learning_gaps",
    f"""WITH {EDGES_SQL}, {KNOWN_SQL} SELECT k.student, k.topic, e.parent AS gap FROM known k JOIN edges e ON e.child = k.topic JOIN part ON p_partkey = e.parent
        LEFT JOIN known g ON g.student = k.student AND g.topic = e.parent WHERE coalesce(g.mastery, 0) < 0.7""",
)
def learning_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Direct prerequisites that a student hasn't reached 0.7 on, for each topic that they work on."""
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("parent"))
    needs = edges(spark, sf_dir).join(parts, "parent").select(F.col("child").alias("topic"), F.col("parent").alias("gap"))
    mastery = known(spark, sf_dir)
    asked = mastery.select("student", "topic").join(needs, "topic")
    reached = mastery.where("mastery >= 0.7").select("student", F.col("topic").alias("gap"))
    return asked.join(reached, ["student", "gap"], "left_anti").select("student", "topic", "gap")


@register(
    "recommend_next",
    f"""WITH {BOOK_EDGES_SQL}, {KNOWN_SQL}, asked AS (SELECT c_custkey AS student, p_type AS book, p_partkey AS topic FROM customer, part),
        met AS (SELECT student, topic FROM known WHERE mastery >= 0.7), done AS (SELECT student, topic FROM known WHERE mastery >= 0.8),
        lacking AS (SELECT DISTINCT a.student, a.topic FROM asked a JOIN inside e ON e.child = a.topic LEFT JOIN met m ON m.student = a.student AND m.topic = e.parent WHERE m.topic IS NULL)
        SELECT student, book, min(topic) AS next_topic FROM asked a ANTI JOIN lacking USING (student, topic) ANTI JOIN done USING (student, topic) GROUP BY student, book""",
)
def recommend_next(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A student's first topic of each book under 0.8 whose prerequisites in the book are all at 0.7 or more.

    No pairs of students and topics are made: a topic is ready for someone if
    it needs nothing, or if all that it needs is among what they have reached.
    Of the topics that need nothing the first open one is the book's first, or
    the one after a topic that they have mastered.
    """
    inside = book_edges(spark, sf_dir)
    topics = table(spark, sf_dir, "part").select(F.col("p_type").alias("book"), F.col("p_partkey").alias("topic"))
    mastery = known(spark, sf_dir)
    met = mastery.where("mastery >= 0.7").select("student", F.col("topic").alias("parent"))
    done = mastery.where("mastery >= 0.8").select("student", "topic")
    needed = inside.groupBy(F.col("child").alias("topic")).agg(F.count(F.lit(1)).alias("n"))
    ready = (
        met.join(inside, "parent").groupBy("student", "book", F.col("child").alias("topic")).agg(F.count(F.lit(1)).alias("n"))
        .join(needed, ["topic", "n"]).select("student", "book", "topic")
    )
    free = topics.join(needed.select("topic"), "topic", "left_anti")
    following = free.select("book", "topic", F.lead("topic").over(W.partitionBy("book").orderBy("topic")).alias("next")).where("next IS NOT NULL")
    onward = done.join(following, "topic").select("student", "book", F.col("next").alias("topic"))
    opening = free.groupBy("book").agg(F.min("topic").alias("topic"))
    first = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("student")).crossJoin(opening)
    open_ = first.unionByName(onward).unionByName(ready).join(done, ["student", "topic"], "left_anti")
    return open_.groupBy("student", "book").agg(F.min("topic").alias("next_topic"))


@register(
    "mastery_with_names",
    f"""WITH {KNOWN_SQL} SELECT student, p_name AS topic, max(mastery) AS mastery FROM known JOIN part ON p_partkey = topic AND topic % 9 <> 0 GROUP BY student, p_name""",
)
def mastery_with_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mastery by the name of the topic; rows whose topic has none go, and of topics of one name the best counts."""
    names = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("topic"), F.when(F.col("p_partkey") % 9 != 0, F.col("p_name")).alias("name"))
    named = known(spark, sf_dir).join(names, "topic", "left").where("name IS NOT NULL")
    return named.groupBy("student", F.col("name").alias("topic")).agg(F.max("mastery").alias("mastery"))


def recommended(strict: DataFrame, legacy: DataFrame, students: DataFrame) -> DataFrame:
    """(student, next_topic, form): the strict form's topic, else that of the nested list, else none."""
    both = students.join(strict.select("student", F.col("next_topic").alias("s")), "student", "left").join(legacy.select("student", F.col("next_topic").alias("l")), "student", "left")
    form = F.when(F.col("s").isNotNull(), "strict").when(F.col("l").isNotNull(), "legacy")
    return both.select("student", F.coalesce("s", "l").alias("next_topic"), form.alias("form"))


@register(
    "recommend_either_form",
    f"""WITH {KNOWN_SQL}, done AS (SELECT student, topic FROM known WHERE mastery >= 0.8),
        first AS (SELECT form, student, min(p_partkey) AS t FROM (SELECT 'strict' AS form, c_custkey AS student, c_custkey % 50 + 1 AS book FROM customer WHERE c_custkey % 3 = 0
            UNION ALL SELECT 'legacy', c_custkey, c_custkey // 50 % 50 + 1 FROM customer WHERE c_custkey % 2 = 0) f JOIN part ON p_size = book ANTI JOIN done ON done.student = f.student AND done.topic = p_partkey GROUP BY ALL),
        strict AS (SELECT * FROM first WHERE form = 'strict'), nested AS (SELECT * FROM first WHERE form = 'legacy')
        SELECT c_custkey AS student, coalesce(s.t, n.t) AS next_topic, CASE WHEN s.t IS NOT NULL THEN 'strict' WHEN n.t IS NOT NULL THEN 'legacy' END AS form FROM customer LEFT JOIN strict s ON s.student = c_custkey LEFT JOIN nested n ON n.student = c_custkey""",
)
def recommend_either_form(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recommendations where a third of the students follows a book in the strict form, and half of them one in the nested form.

    The first topic of a book that a student hasn't mastered is the book's first one or follows one that they have.
    """
    student = F.col("c_custkey")
    students = table(spark, sf_dir, "customer").select(student.alias("student"), (student % 50 + 1).alias("strict"), (F.floor(student / 50) % 50 + 1).alias("nested"))
    done = known(spark, sf_dir).where("mastery >= 0.8").select("student", "topic")
    topics = table(spark, sf_dir, "part").select(F.col("p_size").alias("book"), F.col("p_partkey").alias("topic"))
    opening = topics.groupBy("book").agg(F.min("topic").alias("topic"))
    following = topics.select("book", "topic", F.lead("topic").over(W.partitionBy("book").orderBy("topic")).alias("next")).where("next IS NOT NULL")
    onward = done.join(following, "topic").select("student", "book", F.col("next").alias("topic"))

    def first(who: DataFrame) -> DataFrame:
        asked = who.join(opening, "book").unionByName(who.join(onward, ["student", "book"]))
        return asked.join(done, ["student", "topic"], "left_anti").groupBy("student").agg(F.min("topic").alias("next_topic"))

    strict, nested = (students.where(f"student % {n} = 0").select("student", F.col(form).alias("book")) for form, n in (("strict", 3), ("nested", 2)))
    return recommended(first(strict), first(nested), students.select("student"))


@register(
    "topo_layers",
    f"""WITH RECURSIVE {EDGES_SQL}, way AS (SELECT p_partkey AS node, 0 AS depth FROM part WHERE p_partkey NOT IN (SELECT child FROM edges)
        UNION ALL SELECT child, depth + 1 FROM way JOIN edges ON parent = node) SELECT node, max(depth) AS layer FROM way GROUP BY node""",
)
def topo_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = table(spark, sf_dir, "part").select(F.lit(0).alias("group"), F.col("p_partkey").alias("node"))
    return layers(nodes, edges(spark, sf_dir).withColumn("group", F.lit(0))).select("node", "layer")


def _plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A plan for each class: eight parts in an order dealt by keys."""
    classes = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("plan"))
    slots = classes.withColumn("pos", F.explode(F.sequence(F.lit(0), F.lit(7))))
    return slots.withColumn("concept", F.expr("cast((plan + pos * 5) % 12 + 1 + plan AS string)"))


PLANS_SQL = "plans AS (SELECT CAST(n_nationkey AS BIGINT) AS plan, pos, (n_nationkey + pos * 5) % 12 + 1 + n_nationkey AS concept FROM nation, (SELECT unnest(range(0, 8)) AS pos))"
#: In this graph a concept has one prerequisite, so a layer's order follows from that of the layer before.
WEEK_SQL = f"""{EDGES_SQL}, {PLANS_SQL}, deps AS (SELECT parent, count(*) AS n FROM edges GROUP BY parent),
laid AS (
  SELECT p.plan, p.concept, 0 AS layer, row_number() OVER (PARTITION BY p.plan ORDER BY coalesce(n, 0) DESC, pos) AS r FROM plans p LEFT JOIN deps ON parent = p.concept
  WHERE NOT EXISTS (SELECT 1 FROM edges e JOIN plans q ON q.concept = e.parent WHERE e.child = p.concept AND q.plan = p.plan)
  UNION ALL
  SELECT l.plan, c.concept, l.layer + 1, row_number() OVER (PARTITION BY l.plan ORDER BY coalesce(n, 0) DESC, l.r, c.concept)
  FROM laid l JOIN edges e ON e.parent = l.concept JOIN plans c ON c.plan = l.plan AND c.concept = e.child LEFT JOIN deps d ON d.parent = c.concept),
week AS (SELECT plan, CAST(row_number() OVER (PARTITION BY plan ORDER BY layer, r) - 1 AS INT) AS day, CAST(concept AS VARCHAR) AS concept FROM laid)"""


@register("week_sequence", f"WITH RECURSIVE {WEEK_SQL} SELECT plan, day, concept FROM week WHERE day < 5")
def week_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each class's plan put in teaching order and cut to five days."""
    graph = edges(spark, sf_dir).select(F.col("child").alias("pos"), F.col("child").cast("string").alias("child"), F.col("parent").cast("string").alias("parent"))
    topics = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("concept"))
    return sequence_week(_plans(spark, sf_dir), graph, topics)


@register(
    "fix_plan_order",
    f"""WITH RECURSIVE {WEEK_SQL} SELECT w.plan, day, w.concept, max(pos) AS day_row FROM week w LEFT JOIN plans p ON p.plan = w.plan AND CAST(p.concept AS VARCHAR) = w.concept
        WHERE day < 5 GROUP BY ALL""",
)
def fix_plan_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A plan's days in sequenced order, each with the day row that held its concept last."""
    plans = _plans(spark, sf_dir)
    last = plans.groupBy("plan", "concept").agg(F.max("pos").alias("day_row"))
    return week_sequence(spark, sf_dir).join(last, ["plan", "concept"], "left").select("plan", "day", "concept", "day_row")


def _placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of which both ends are in a plan, with their places."""
    plans = _plans(spark, sf_dir).withColumn("concept", F.col("concept").cast("long"))
    side = lambda c: plans.select("plan", F.col("concept").alias(c), F.col("pos").alias(f"{c}_pos"))
    return edges(spark, sf_dir).join(side("child"), "child").join(side("parent"), ["plan", "parent"])


@register(
    "order_violations",
    f"""WITH {EDGES_SQL}, {PLANS_SQL} SELECT c.plan, e.child, e.parent FROM edges e JOIN plans c ON c.concept = e.child JOIN plans p ON p.plan = c.plan AND p.concept = e.parent WHERE p.pos > c.pos""",
)
def order_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Concepts that are planned before a prerequisite."""
    return _placed(spark, sf_dir).where("parent_pos > child_pos").select("plan", "child", "parent")


@register(
    "order_respected",
    f"""WITH {EDGES_SQL}, {PLANS_SQL} SELECT c.plan, e.child, e.parent FROM edges e JOIN plans c ON c.concept = e.child JOIN plans p ON p.plan = c.plan AND p.concept = e.parent WHERE p.pos < c.pos""",
)
def order_respected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _placed(spark, sf_dir).where("parent_pos < child_pos").select("plan", "child", "parent")


@register(
    "break_cycles",
    f"""WITH {EDGES_SQL}, d AS (SELECT p_type AS grp, child, parent FROM edges JOIN part ON p_partkey = child)
        SELECT grp AS "group", CAST(child AS VARCHAR) AS child, CAST(parent AS VARCHAR) AS parent FROM d WHERE child % 7 <> 0 UNION ALL SELECT grp, CAST(parent AS VARCHAR), CAST(child AS VARCHAR) FROM d WHERE child % 7 = 0""",
)
def break_cycles_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The graph of each book with edges back from every seventh parent, made acyclic."""
    books = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("child"), F.col("p_type").alias("group"))
    down = edges(spark, sf_dir).join(books, "child")
    back = down.where("child % 7 = 0").select("group", F.col("parent").alias("child"), F.col("child").alias("parent"))
    both = down.select("group", "child", "parent").unionByName(back)
    return break_cycles(both.select("group", F.col("child").alias("pos"), F.col("child").cast("string").alias("child"), F.col("parent").cast("string").alias("parent")))


_DAYS_SQL = """days AS (SELECT o_custkey AS plan, CAST(o_orderkey % 5 AS INT) AS dow, min(o_orderkey) AS day_id FROM orders GROUP BY ALL),
d AS (SELECT *, CASE WHEN day_id % 4 = 0 THEN 'taught' ELSE 'pending' END AS status FROM days)"""


def week_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("plan"), (F.col("o_orderkey") % 5).cast("int").alias("dow")).agg(F.min("o_orderkey").alias("day_id"))
    return days.withColumn("status", F.when(F.col("day_id") % 4 == 0, "taught").otherwise("pending"))


def carried_forward(days: DataFrame, carried: DataFrame) -> DataFrame:
    """Days (plan, dow, day_id, status) with a concept of each plan of ``carried`` (plan, from_day) put on the day after from_day.

    Pending days from there on move by one, off the week's end; others stay,
    and ``conflict`` marks days that two rows of a plan then share. Nothing
    comes after day 4, so a plan carried from there stays as it is.
    """
    moves = carried.where("from_day < 4").select("plan", (F.col("from_day") + 1).alias("slot"))
    known = days.join(moves, "plan", "left")
    shifted = F.coalesce((F.col("status") == "pending") & (F.col("dow") >= F.col("slot")), F.lit(False))
    stayed = known.withColumn("dow", F.when(shifted, F.col("dow") + 1).otherwise(F.col("dow"))).where("dow <= 4").drop("slot")
    new = days.select("plan").distinct().join(moves, "plan").select("plan", F.col("slot").cast("int").alias("dow"), F.lit(None).cast("long").alias("day_id"), F.lit("carried_forward").alias("status"))
    return stayed.select(*new.columns).unionByName(new).withColumn("conflict", F.count(F.lit(1)).over(W.partitionBy("plan", "dow")) > 1)


@register(
    "carry_forward_shift",
    f"""WITH {_DAYS_SQL}, m AS (SELECT plan, dow, day_id, status, CAST(plan % 5 + 1 AS INT) AS slot, plan % 5 < 4 AS moves FROM d),
       s AS (SELECT plan, CASE WHEN moves AND status = 'pending' AND dow >= slot THEN dow + 1 ELSE dow END AS dow, day_id, status FROM m),
       u AS (SELECT plan, dow, day_id, status FROM s WHERE dow <= 4 UNION ALL SELECT DISTINCT plan, slot, NULL, 'carried_forward' FROM m WHERE moves)
       SELECT *, count(*) OVER (PARTITION BY plan, dow) > 1 AS conflict FROM u""",
)
def carry_forward_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weeks with a concept carried over from a day that differs by plan."""
    days = week_rows(spark, sf_dir)
    return carried_forward(days, days.select("plan").distinct().withColumn("from_day", F.col("plan") % 5))


# Fixed value: how a day's notes open that begins with a recap.
RECAP = "[RECAP] Start with a 5-minute recap of '{}' before today's concept."


@register(
    "recap_note",
    """WITH days AS (SELECT o_custkey AS plan, CAST(o_orderkey % 5 AS INT) AS dow, min(o_orderkey) AS day_id FROM orders GROUP BY ALL)
       SELECT plan, dow, '[RECAP] Start with a 5-minute recap of ''fractions'' before today''s concept.' || CASE WHEN day_id % 3 = 0 THEN '' ELSE chr(10) || 'day ' || day_id END AS notes
       FROM days WHERE dow > 1 AND day_id % 4 <> 0 QUALIFY row_number() OVER (PARTITION BY plan ORDER BY dow) = 1""",
)
def recap_note(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first pending day after day 1 opens with a recap; notes that it had follow on a line of their own."""
    first = first_by(week_rows(spark, sf_dir).where("dow > 1 AND status = 'pending'"), ["plan"], [F.col("dow")])
    own = F.when(F.col("day_id") % 3 != 0, F.concat(F.lit("day "), F.col("day_id").cast("string")))
    return first.select("plan", "dow", F.concat_ws("\n", F.lit(RECAP.format("fractions")), own).alias("notes"))


@register(
    "week_serialised",
    """WITH days AS (SELECT o_custkey AS plan, CAST(o_orderkey % 5 AS INT) AS dow, min(o_orderkey) AS day_id FROM orders GROUP BY ALL),
       f AS (SELECT l_orderkey AS day_id, arg_min(l_comment, (l_linenumber, l_comment)) AS response FROM (SELECT l_orderkey, l_linenumber, l_returnflag || l_partkey AS l_comment FROM lineitem) GROUP BY l_orderkey)
       SELECT plan, string_agg(['Monday', 'Tuesday', 'Wednesday', 'Thursday', 'Friday'][dow + 1] || ':' || d.day_id || ':' || coalesce(response, 'none'), ' ' ORDER BY dow) AS days FROM days d LEFT JOIN f ON f.day_id = d.day_id GROUP BY plan""",
)
def week_serialised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plans with their days as structs: the weekday's name, and the first feedback or none."""
    told = F.struct("l_linenumber", F.concat("l_returnflag", F.col("l_partkey").cast("string")).alias("response"))
    feedback = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("day_id")).agg(F.array_sort(F.collect_list(told)).alias("feedback"))
    names = F.array(*map(F.lit, ("Monday", "Tuesday", "Wednesday", "Thursday", "Friday")))
    day = F.struct("dow", F.element_at(names, F.col("dow") + 1).alias("day"), "day_id", F.try_element_at("feedback", F.lit(1)).alias("feedback"))
    plans = week_rows(spark, sf_dir).join(feedback, "day_id", "left").groupBy("plan").agg(F.array_sort(F.collect_list(day)).alias("days"))
    text = F.transform("days", lambda d: F.concat_ws(":", d["day"], d["day_id"].cast("string"), F.coalesce(d["feedback"]["response"], F.lit("none"))))
    return plans.select("plan", F.array_join(text, " ").alias("days"))


@register(
    "week_summary_rules",
    """WITH d AS (SELECT o_custkey AS plan, o_orderkey AS concept, ['taught','partial','skipped','carried_forward','pending'][o_orderkey % 5 + 1] AS status, o_orderkey % 3 = 0 AS struggled FROM orders)
       SELECT plan, array_to_string(list(concept ORDER BY concept) FILTER (status = 'taught'), ',') AS covered,
       array_to_string(list(concept ORDER BY concept) FILTER (status IN ('partial','skipped','carried_forward')), ',') AS missed,
       array_to_string(list(concept ORDER BY concept) FILTER (struggled), ',') AS struggles,
       concat_ws(',', array_to_string(list(concept ORDER BY concept) FILTER (status IN ('partial','skipped','carried_forward')), ','), array_to_string(list(concept ORDER BY concept) FILTER (struggled), ',')) AS next_week FROM d GROUP BY plan""",
)
def week_summary_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a week covered, missed and struggled with; next week takes up missed and struggles."""
    status = F.get(F.array(*map(F.lit, ["taught", "partial", "skipped", "carried_forward", "pending"])), (F.col("o_orderkey") % 5).cast("int"))
    days = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("plan"), F.col("o_orderkey").alias("concept"), status.alias("status"))
    listed = lambda when: F.when(F.count_if(when) > 0, F.array_join(F.array_sort(F.collect_list(F.when(when, F.col("concept")))).cast("array<string>"), ","))
    return days.groupBy("plan").agg(
        listed(F.col("status") == "taught").alias("covered"),
        listed(F.col("status").isin("partial", "skipped", "carried_forward")).alias("missed"),
        listed(F.col("concept") % 3 == 0).alias("struggles"),
    ).withColumn("next_week", F.concat_ws(",", "missed", "struggles"))
