"""Books, chapters and topics: numbering, ranges, cleaning, merging and search.

Book, chapter and topic are part type, (type, brand) and part key; a topic's
first page is its size, its last one up to seven pages later.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chalkline.functions.numeric import round_half_up
from chalkline.functions.text import canonical_ids, semantic_name
from chalkline.operators.curriculum import status_of
from chalkline.operators.folds import first_by
from chalkline.operators.keyed import keyed_union
from chalkline.operators.structure import clamp_range, fold_dedup, islands, numbered, pages_of
from chalkline.plans.registry import register
from chalkline.sources.tables import table

TOPICS_SQL = """
topics AS (SELECT p_partkey AS topic_id, p_type AS book, p_brand AS chapter, p_name AS name, p_size AS page_start, p_size + p_partkey % 8 AS page_end FROM part),
chapters AS (SELECT book, chapter, min(page_start) AS page_start, count(*) AS n_topics, CAST(min(topic_id) AS BIGINT) AS doc_pos FROM topics GROUP BY ALL)
"""


def topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("topic_id"),
        F.col("p_type").alias("book"),
        F.col("p_brand").alias("chapter"),
        F.col("p_name").alias("name"),
        F.col("p_size").alias("page_start"),
        (F.col("p_size") + F.col("p_partkey") % 8).alias("page_end"),
    )


def chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topics(spark, sf_dir).groupBy("book", "chapter").agg(
        F.min("page_start").alias("page_start"), F.count(F.lit(1)).alias("n_topics"), F.min("topic_id").alias("doc_pos")
    )


@register(
    "topic_positions",
    f"WITH {TOPICS_SQL} SELECT topic_id, row_number() OVER (PARTITION BY book, chapter ORDER BY topic_id) - 1 AS position FROM topics",
)
def topic_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return numbered(topics(spark, sf_dir), ["book", "chapter"], [F.col("topic_id")], "position", 0).select("topic_id", "position")


@register(
    "chapter_renumber",
    f"WITH {TOPICS_SQL} SELECT book, chapter, 'C_' || row_number() OVER (PARTITION BY book ORDER BY coalesce(page_start, 0), chapter) AS chapter_id FROM chapters",
)
def chapter_renumber(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C_1, C_2, ... by (first page, name as a string)."""
    found = numbered(chapters(spark, sf_dir), ["book"], [F.coalesce("page_start", F.lit(0)), F.col("chapter")], "n")
    return found.select("book", "chapter", F.concat(F.lit("C_"), F.col("n").cast("string")).alias("chapter_id"))


@register(
    "topic_renumber",
    f"""WITH {TOPICS_SQL}, c AS (SELECT book, chapter, row_number() OVER (PARTITION BY book ORDER BY page_start, chapter) AS n FROM chapters WHERE chapter <> 'Brand#13')
        SELECT topic_id, 'T_' || n || '_' || row_number() OVER (PARTITION BY t.book, chapter ORDER BY coalesce(t.page_start, 0), topic_id) AS new_id
        FROM topics t JOIN c USING (book, chapter)""",
)
def topic_renumber(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T_chapter_topic; topics of a chapter that is gone are dropped."""
    known = numbered(chapters(spark, sf_dir).where("chapter <> 'Brand#13'"), ["book"], [F.col("page_start"), F.col("chapter")], "n").select("book", "chapter", "n")
    found = numbered(topics(spark, sf_dir).join(known, ["book", "chapter"]), ["book", "chapter"], [F.coalesce("page_start", F.lit(0)), F.col("topic_id")], "t")
    return found.select("topic_id", F.concat_ws("_", F.lit("T"), F.col("n").cast("string"), F.col("t").cast("string")).alias("new_id"))


@register(
    "exercise_renumber",
    """SELECT l_partkey AS topic_id, l_orderkey, l_linenumber, 'E_' || l_partkey || '_' || row_number() OVER (PARTITION BY l_partkey
       ORDER BY l_shipdate, l_orderkey, l_linenumber, l_suppkey, l_extendedprice) AS exercise_id, l_extendedprice FROM lineitem""",
)
def exercise_renumber(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = [F.col(c) for c in ("l_shipdate", "l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice")]
    found = numbered(table(spark, sf_dir, "lineitem"), ["l_partkey"], order, "n")
    ident = F.concat_ws("_", F.lit("E"), F.col("l_partkey").cast("string"), F.col("n").cast("string"))
    return found.select(F.col("l_partkey").alias("topic_id"), "l_orderkey", "l_linenumber", ident.alias("exercise_id"), "l_extendedprice")


@register(
    "chapter_page_ranges",
    f"""WITH {TOPICS_SQL}, n AS (SELECT *, lead(page_start) OVER (PARTITION BY book ORDER BY page_start, chapter) AS nxt FROM chapters)
        SELECT book, chapter, page_start, coalesce(nxt - 1, 120) AS toc_end, greatest(page_start, coalesce(nxt - 1, 120)) AS page_end,
        CASE WHEN nxt - 1 < page_start THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END AS confidence FROM n""",
)
def chapter_page_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A chapter ends before the next one starts, the last one with the book; never before its own start, which halves confidence."""
    following = F.lead("page_start").over(W.partitionBy("book").orderBy("page_start", "chapter"))
    found = chapters(spark, sf_dir).withColumn("toc_end", F.coalesce(following - 1, F.lit(120)))
    collapsed = F.col("toc_end") < F.col("page_start")
    return found.select(
        "book", "chapter", "page_start", "toc_end", F.greatest("page_start", "toc_end").alias("page_end"), F.when(collapsed, 0.5).otherwise(1.0).alias("confidence")
    )


@register(
    "same_start_richest",
    f"""WITH {TOPICS_SQL} SELECT book, page_start, chapter, n_topics FROM chapters
        QUALIFY row_number() OVER (PARTITION BY book, page_start ORDER BY n_topics DESC, doc_pos) = 1""",
)
def same_start_richest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of chapters that start on one page the one with most topics stays, the first on ties."""
    found = first_by(chapters(spark, sf_dir), ["book", "page_start"], [F.desc("n_topics"), F.col("doc_pos")])
    return found.select("book", "page_start", "chapter", "n_topics")


@register(
    "consecutive_title_islands",
    f"""WITH {TOPICS_SQL}, f AS (SELECT *, left(name, 3) AS title, CASE WHEN left(name, 3) IS DISTINCT FROM lag(left(name, 3)) OVER w OR row_number() OVER w = 1 THEN 1 ELSE 0 END AS fresh
        FROM topics WINDOW w AS (PARTITION BY book ORDER BY page_start, topic_id)),
        i AS (SELECT *, sum(fresh) OVER (PARTITION BY book ORDER BY page_start, topic_id) AS island FROM f)
        SELECT book, CAST(island AS BIGINT) AS island, any_value(title) AS title, count(*) AS merged, min(page_start) AS page_start,
        CAST(max(coalesce(page_end, page_start)) AS BIGINT) AS page_end FROM i GROUP BY book, island""",
)
def consecutive_title_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbours of one title become one, spanning to the farthest end."""
    titled = topics(spark, sf_dir).withColumn("title", F.substring("name", 1, 3))
    found = islands(titled, ["book"], [F.col("page_start"), F.col("topic_id")], "title", "island")
    return found.groupBy("book", "island").agg(
        F.first("title").alias("title"),
        F.count(F.lit(1)).alias("merged"),
        F.min("page_start").alias("page_start"),
        F.max(F.coalesce("page_end", "page_start")).cast("long").alias("page_end"),
    )


@register(
    "recurring_titles",
    f"""WITH {TOPICS_SQL} SELECT book, name AS title, count(*) AS n, string_agg(CAST(topic_id AS VARCHAR), ',' ORDER BY topic_id) AS sections
        FROM topics GROUP BY book, name HAVING count(*) > 1""",
)
def recurring_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = topics(spark, sf_dir).groupBy("book", F.col("name").alias("title"))
    sections = F.array_join(F.transform(F.array_sort(F.collect_list("topic_id")), lambda x: x.cast("string")), ",")
    return groups.agg(F.count(F.lit(1)).alias("n"), sections.alias("sections")).where("n > 1")


@register(
    "orphan_nearest_chapter",
    f"""WITH {TOPICS_SQL}, live AS (SELECT * FROM chapters WHERE length(chapter) = 8),
        pages AS (SELECT book, unnest(range(page_start, page_start + 3)) AS page, chapter, page_start FROM live),
        map AS (SELECT book, page, chapter FROM pages QUALIFY row_number() OVER (PARTITION BY book, page ORDER BY page_start DESC, chapter DESC) = 1),
        orphans AS (SELECT * FROM topics t WHERE NOT EXISTS (SELECT 1 FROM live l WHERE l.book = t.book AND l.chapter = t.chapter))
        SELECT topic_id, m.chapter AS nearest, abs(m.page - o.page_start) AS distance FROM orphans o JOIN map m ON m.book = o.book AND abs(m.page - o.page_start) <= 19
        QUALIFY row_number() OVER (PARTITION BY topic_id ORDER BY abs(m.page - o.page_start), m.page > o.page_start) = 1""",
)
def orphan_nearest_chapter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Topics whose chapter is unknown go to the chapter of the nearest page within 19, the lower page first.

    The page map has one chapter a page (the last to start), and each orphan
    looks pages up by equality, not by a range.
    """
    live = chapters(spark, sf_dir).where("length(chapter) = 8")
    pages = pages_of(live.withColumn("last", F.col("page_start") + 2), "page_start", "last")
    page_map = first_by(pages, ["book", "page"], [F.desc("page_start"), F.desc("chapter")]).select("book", "page", F.col("chapter").alias("nearest"))
    orphans = topics(spark, sf_dir).join(live.select("book", "chapter"), ["book", "chapter"], "left_anti")
    around = orphans.withColumn("delta", F.explode(F.sequence(F.lit(-19), F.lit(19)))).withColumn("page", F.col("page_start") + F.col("delta"))
    found = around.join(page_map, ["book", "page"])
    return first_by(found, ["topic_id"], [F.abs("delta"), F.col("delta") > 0]).select("topic_id", "nearest", F.abs("delta").alias("distance"))


@register(
    "page_to_topic_first",
    f"""WITH {TOPICS_SQL} SELECT b.book, p.page, t.topic_id FROM (SELECT DISTINCT book FROM topics) b, (SELECT unnest(range(0, 65)) AS page) p
        JOIN topics t ON t.book = b.book AND p.page BETWEEN t.page_start AND t.page_end
        QUALIFY row_number() OVER (PARTITION BY b.book, p.page ORDER BY t.topic_id) = 1""",
)
def page_to_topic_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page's first topic in document order whose range holds it."""
    found = pages_of(topics(spark, sf_dir), "page_start", "page_end").where("page BETWEEN 0 AND 64")
    return found.groupBy("book", "page").agg(F.min("topic_id").alias("topic_id"))


@register(
    "page_to_topic_range_join",
    f"""WITH {TOPICS_SQL}, b AS (SELECT book, CAST(least(0, min(page_start)) AS INT) AS first, CAST(greatest(64, max(page_start), max(page_end)) AS INT) AS last FROM topics GROUP BY book),
        p AS (SELECT book, CAST(unnest(range(first, last + 1)) AS INT) AS page FROM b),
        exact AS (SELECT p.book, page, max(topic_id) AS topic_id FROM p JOIN topics t ON t.book = p.book AND page BETWEEN page_start AND page_end GROUP BY ALL),
        near AS (SELECT p.book, page, topic_id FROM p JOIN topics t ON t.book = p.book QUALIFY row_number() OVER (PARTITION BY p.book, page ORDER BY abs(page_start - page), topic_id) = 1)
        SELECT book, page, coalesce(e.topic_id, n.topic_id) AS topic_id, e.topic_id IS NOT NULL AS inside FROM near n LEFT JOIN exact e USING (book, page)""",
)
def page_to_topic_range_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last topic that holds a page, else the one with the nearest start, the first on ties.

    The fallback needs no pairs of pages and topics: the nearest start is the
    last one at or before the page or the first one after it. A book's pages go
    to its topics' last one, at least to 64.
    """
    every = topics(spark, sf_dir)
    first, last = F.least(F.lit(0), F.min("page_start")), F.greatest(F.lit(64), F.max("page_start"), F.max("page_end"))
    extent = every.groupBy("book").agg(first.cast("int").alias("first"), last.cast("int").alias("last"))
    pages = extent.select("book", F.explode(F.sequence("first", "last")).alias("page"))
    exact = pages_of(every, "page_start", "page_end").groupBy("book", F.col("page").cast("int").alias("page")).agg(F.max("topic_id").alias("held"))
    starts = every.groupBy("book", F.col("page_start").alias("page")).agg(F.min("topic_id").alias("topic_id"))
    at = starts.withColumn("start", F.struct(F.col("page").alias("p"), "topic_id"))
    line = pages.join(at.select("book", "page", "start"), ["book", "page"], "left")
    w = W.partitionBy("book").orderBy("page")
    before = F.last("start", True).over(w.rowsBetween(W.unboundedPreceding, 0))
    after = F.first("start", True).over(w.rowsBetween(1, W.unboundedFollowing))
    keyed = lambda s: F.when(s.isNotNull(), F.struct(F.abs(s["p"] - F.col("page")).alias("d"), s["topic_id"].alias("t")))
    nearest = line.withColumn("b", before).withColumn("a", after).withColumn("near", F.least(keyed(F.col("b")), keyed(F.col("a"))))
    found = nearest.join(exact, ["book", "page"], "left")
    return found.select("book", "page", F.coalesce("held", F.col("near")["t"]).alias("topic_id"), F.col("held").isNotNull().alias("inside"))


@register(
    "clamp_ranges",
    f"""WITH {TOPICS_SQL}, r AS (SELECT topic_id, page_start - topic_id % 5 AS lo, page_end + topic_id % 7 - 3 AS hi, 10 AS plo, CASE WHEN topic_id % 3 = 0 THEN 9999 ELSE 40 END AS phi FROM topics),
        s AS (SELECT *, phi < 9999 AND lo > phi AS violated, CASE WHEN (phi < 9999 AND lo > phi) OR lo < plo THEN plo ELSE lo END AS st FROM r)
        SELECT topic_id, CAST(st AS BIGINT) AS page_start, CAST(greatest(st, CASE WHEN phi < 9999 AND hi > phi THEN phi ELSE hi END) AS BIGINT) AS page_end, violated FROM s""",
)
def clamp_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = topics(spark, sf_dir).select(
        "topic_id",
        (F.col("page_start") - F.col("topic_id") % 5).alias("lo"),
        (F.col("page_end") + F.col("topic_id") % 7 - 3).alias("hi"),
        F.when(F.col("topic_id") % 3 == 0, 9999).otherwise(40).alias("phi"),
    )
    start, end, violated = clamp_range(F.col("lo"), F.col("hi"), F.lit(10), F.col("phi"))
    return rows.select("topic_id", start.cast("long").alias("page_start"), end.cast("long").alias("page_end"), violated.alias("violated"))


@register(
    "confidence_status",
    f"""WITH {TOPICS_SQL}, r AS (SELECT book, chapter, page_start, n_topics % 5 AS n, lead(page_start) OVER (PARTITION BY book ORDER BY page_start, chapter) - 1 AS nxt FROM chapters),
        c AS (SELECT book, chapter, floor(0.9::DOUBLE * CASE WHEN n = 0 THEN 0.3::DOUBLE WHEN n = 1 AND coalesce(nxt, 120) - page_start > 8 THEN 0.7::DOUBLE ELSE 1.0::DOUBLE END * 100 + 0.5) / 100.0::DOUBLE AS c1,
              coalesce(nxt < page_start, false) AS collapsed FROM r),
        d AS (SELECT book, chapter, floor(c1 * CASE WHEN collapsed THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END * 100 + 0.5) / 100.0::DOUBLE AS confidence FROM c)
        SELECT book, chapter, confidence, CASE WHEN confidence >= 0.8 THEN 'verified' WHEN confidence >= 0.4 THEN 'partial' ELSE 'unverified' END AS status, confidence < 0.6 AS quarantined FROM d""",
)
def confidence_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Empty chapters, single topics over many pages and collapsed bounds lower confidence; each product is rounded."""
    n = F.col("n_topics") % 5
    following = F.lead("page_start").over(W.partitionBy("book").orderBy("page_start", "chapter")) - 1
    rows = chapters(spark, sf_dir).withColumn("next", following)
    sparse = (n == 1) & (F.coalesce("next", F.lit(120)) - F.col("page_start") > 8)
    one = round_half_up(0.9 * F.when(n == 0, 0.3).when(sparse, 0.7).otherwise(1.0))
    both = round_half_up(one * F.when(F.coalesce(F.col("next") < F.col("page_start"), F.lit(False)), 0.5).otherwise(1.0))
    found = rows.select("book", "chapter", both.alias("confidence"))
    return found.withColumn("status", status_of(F.col("confidence"))).withColumn("quarantined", F.col("confidence") < 0.6)


@register(
    "page_gaps_placeholders",
    f"""WITH {TOPICS_SQL}, covered AS (SELECT DISTINCT book, chapter, unnest(range(page_start, page_end + 1)) AS page FROM topics),
        expected AS (SELECT book, chapter, unnest(range(page_start, page_start + 30)) AS page FROM chapters)
        SELECT book, chapter, CAST(page AS BIGINT) AS page, 'T_' || chapter || '_placeholder_' || page AS topic_id FROM expected ANTI JOIN covered USING (book, chapter, page)""",
)
def page_gaps_placeholders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A placeholder topic for each page of a chapter that no topic covers."""
    covered = pages_of(topics(spark, sf_dir), "page_start", "page_end").select("book", "chapter", F.col("page").cast("long").alias("page")).distinct()
    expected = pages_of(chapters(spark, sf_dir).withColumn("last", F.col("page_start") + 29), "page_start", "last")
    gaps = expected.select("book", "chapter", F.col("page").cast("long").alias("page")).join(covered, ["book", "chapter", "page"], "left_anti")
    return gaps.withColumn("topic_id", F.concat(F.lit("T_"), "chapter", F.lit("_placeholder_"), F.col("page").cast("string")))


@register(
    "page_placeholders_whole",
    f"""WITH {TOPICS_SQL}, covered AS (SELECT DISTINCT book, chapter, unnest(range(page_start, page_end + 1)) AS page FROM topics),
        expected AS (SELECT book, chapter, unnest(range(page_start, page_start + 30)) AS page FROM chapters), gaps AS (SELECT book, chapter, CAST(page AS BIGINT) AS page FROM expected ANTI JOIN covered USING (book, chapter, page))
        SELECT book, 'exercise' AS kind, 'E_' || chapter || '_placeholder_' || page || '_1' AS id, 'T_' || chapter || '_placeholder_' || page AS other FROM gaps
        UNION ALL SELECT book, 'contains', chapter, 'T_' || chapter || '_placeholder_' || page FROM gaps UNION ALL SELECT book, 'tests', 'E_' || chapter || '_placeholder_' || page || '_1', 'T_' || chapter || '_placeholder_' || page FROM gaps""",
)
def page_placeholders_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What comes with each placeholder topic: an exercise, the edge from its chapter and the edge from the exercise."""
    gaps = page_gaps_placeholders(spark, sf_dir)
    exercise = F.concat(F.regexp_replace("topic_id", "^T", "E"), F.lit("_1"))
    rows = F.array(*[F.struct(F.lit(kind).alias("kind"), one.alias("id"), F.col("topic_id").alias("other")) for kind, one in (("exercise", exercise), ("contains", F.col("chapter")), ("tests", exercise))])
    return gaps.select("book", F.explode(rows).alias("x")).select("book", "x.*")


@register(
    "image_page_topics",
    f"""WITH {TOPICS_SQL}, t AS (SELECT book, topic_id, CASE WHEN topic_id % 7 = 0 THEN 0 ELSE page_start END AS a, CASE WHEN topic_id % 5 = 0 THEN 999 ELSE page_end END AS b FROM topics)
        SELECT book, page, min(topic_id) AS topic_id FROM t JOIN (SELECT unnest(range(0, 80)) AS page) p ON page BETWEEN a AND b GROUP BY book, page""",
)
def image_page_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first topic that holds an image's page; a missing first page is 0, a missing last one 999.

    Ranges meet only the pages that have images: bounds are cut to those first.
    """
    rows = topics(spark, sf_dir).select("book", "topic_id", F.when(F.col("topic_id") % 7 != 0, F.col("page_start")).alias("a"), F.when(F.col("topic_id") % 5 != 0, F.col("page_end")).alias("b"))
    bounded = rows.select("book", "topic_id", F.greatest(F.coalesce("a", F.lit(0)), F.lit(0)).alias("a"), F.least(F.coalesce("b", F.lit(999)), F.lit(79)).alias("b"))
    return pages_of(bounded, "a", "b").groupBy("book", F.col("page").cast("long").alias("page")).agg(F.min("topic_id").alias("topic_id"))


@register(
    "ids_of_another_chapter",
    r"""WITH i AS (SELECT p_partkey AS topic, p_partkey % 4 AS old, p_partkey % 9 AS new, unnest(['C_' || p_partkey % 4, 'T_' || p_partkey % 4 || '_' || p_partkey, 'ST_' || p_partkey % 4 || '_1_2', 'E_7_' || p_partkey % 4, 'S_' || p_partkey % 4 || '_9', 'note']) AS id FROM part)
        SELECT topic, id, regexp_replace(id, '^([A-Z]+_)' || old || '(_|$)', '\1' || new || '\2') AS moved FROM i""",
)
def ids_of_another_chapter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of a chunk whose chapter has another number than it should: the first number of all kinds of ids moves."""
    old, new, key = ((F.col("p_partkey") % 4), (F.col("p_partkey") % 9), F.col("p_partkey").cast("string"))
    o = old.cast("string")
    ids = F.array(F.concat_ws("_", F.lit("C"), o), F.concat_ws("_", F.lit("T"), o, key), F.concat_ws("_", F.lit("ST"), o, F.lit("1_2")), F.concat_ws("_", F.lit("E_7"), o), F.concat_ws("_", F.lit("S"), o, F.lit("9")), F.lit("note"))
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("topic"), old.alias("old"), new.alias("new"), F.explode(ids).alias("id"))
    return rows.select("topic", "id", canonical_ids(F.col("id"), F.col("old"), F.col("new")).alias("moved"))


@register(
    "page_coverage",
    f"""WITH {TOPICS_SQL} SELECT book, chapter, count(DISTINCT page) AS pages FROM (SELECT book, chapter, unnest(range(page_start, page_end + 1)) AS page FROM topics
        UNION ALL SELECT book, chapter, page_start + 60 FROM chapters) GROUP BY ALL""",
)
def page_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages that a chapter's topics or side boxes are on."""
    ranged = pages_of(topics(spark, sf_dir), "page_start", "page_end").select("book", "chapter", F.col("page").cast("long").alias("page"))
    boxes = chapters(spark, sf_dir).select("book", "chapter", (F.col("page_start") + 60).cast("long").alias("page"))
    return ranged.unionByName(boxes).groupBy("book", "chapter").agg(F.countDistinct("page").alias("pages"))


@register(
    "topic_dedup_exact",
    f"WITH {TOPICS_SQL} SELECT topic_id FROM topics QUALIFY row_number() OVER (PARTITION BY book, chapter, lower(trim(name)) ORDER BY topic_id) = 1",
)
def topic_dedup_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return first_by(topics(spark, sf_dir).withColumn("key", F.lower(F.trim("name"))), ["book", "chapter", "key"], [F.col("topic_id")]).select("topic_id")


@register(
    "exercise_dedup_prefix80",
    "SELECT doc_id FROM documents QUALIFY row_number() OVER (PARTITION BY source, lower(left(text, 80)) ORDER BY doc_id) = 1",
)
def exercise_dedup_prefix80(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exercises of a topic with the same first 80 characters, whatever their case, are one."""
    keyed = table(spark, sf_dir, "documents").select("doc_id", "source", F.lower(F.substring("text", 1, 80)).alias("key"))
    return first_by(keyed, ["source", "key"], [F.col("doc_id")]).select("doc_id")


@register(
    "topic_dedup_semantic",
    f"""WITH RECURSIVE {TOPICS_SQL}, r AS (SELECT book, chapter, topic_id, lower(topic_id % 4 || '. ' || name || ' (' || left(book, 1) || ')') AS exact, page_start || '|' || lower(name) AS meaning,
          row_number() OVER (PARTITION BY book, chapter ORDER BY topic_id) AS n FROM topics),
        f AS (SELECT book, chapter, n, [exact] AS a, [meaning] AS b, [topic_id] AS ids FROM r WHERE n = 1 UNION ALL
          SELECT f.book, f.chapter, r.n, CASE WHEN list_contains(a, exact) OR list_contains(b, meaning) THEN a ELSE list_append(a, exact) END, CASE WHEN list_contains(a, exact) OR list_contains(b, meaning) THEN b ELSE list_append(b, meaning) END,
          CASE WHEN list_contains(a, exact) OR list_contains(b, meaning) THEN ids ELSE list_append(ids, topic_id) END FROM f JOIN r ON r.book = f.book AND r.chapter = f.chapter AND r.n = f.n + 1)
        SELECT unnest(arg_max(ids, n)) AS topic_id FROM f GROUP BY book, chapter""",
)
def topic_dedup_semantic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact and semantic duplicates of a chapter in one pass; a row that goes registers neither key."""
    rows = topics(spark, sf_dir).withColumn("title", F.concat((F.col("topic_id") % 4).cast("string"), F.lit(". "), "name", F.lit(" ("), F.substring("book", 1, 1), F.lit(")")))
    keyed = rows.withColumn("exact", F.lower(F.trim("title"))).withColumn("meaning", F.concat_ws("|", F.col("page_start").cast("string"), semantic_name(F.col("title"))))
    return fold_dedup(keyed, ["book", "chapter"], ["topic_id"], "exact", "meaning", "topic_id")


@register(
    "keyed_union_merge",
    f"""WITH {TOPICS_SQL}, parts AS (SELECT 0 AS part, topic_id, name FROM topics WHERE topic_id % 3 <> 0 UNION ALL SELECT 1, topic_id, name || '!' FROM topics WHERE topic_id % 2 = 0)
        SELECT topic_id, name FROM parts QUALIFY row_number() OVER (PARTITION BY topic_id ORDER BY part) = 1""",
)
def keyed_union_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks merged in order: the first row of an id stays."""
    rows = topics(spark, sf_dir).select("topic_id", "name")
    second = rows.where("topic_id % 2 = 0").withColumn("name", F.concat("name", F.lit("!")))
    return keyed_union([rows.where("topic_id % 3 <> 0"), second], F.col("topic_id").cast("string"), F.col("topic_id"))


@register(
    "edge_dedup_remap",
    """WITH edges AS (SELECT l_partkey AS child, l_suppkey AS parent, l_returnflag AS kind FROM lineitem), remap AS (SELECT p_partkey AS old, p_partkey // 10 AS new FROM part WHERE p_partkey % 10 < 5)
       SELECT DISTINCT coalesce(a.new, child) AS child, coalesce(b.new, parent) AS parent, kind FROM edges LEFT JOIN remap a ON a.old = child LEFT JOIN remap b ON b.old = parent
       WHERE coalesce(a.new, child) <> coalesce(b.new, parent)""",
)
def edge_dedup_remap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges under new ids (unmapped ones stay), without repeats and self loops."""
    edges = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("child"), F.col("l_suppkey").alias("parent"), F.col("l_returnflag").alias("kind")).distinct()
    remap = table(spark, sf_dir, "part").where("p_partkey % 10 < 5").select(F.col("p_partkey").alias("old"), F.expr("p_partkey div 10").alias("new"))
    one = edges.join(remap.select(F.col("old").alias("child"), F.col("new").alias("c")), "child", "left").join(
        remap.select(F.col("old").alias("parent"), F.col("new").alias("p")), "parent", "left"
    )
    return one.select(F.coalesce("c", "child").alias("child"), F.coalesce("p", "parent").alias("parent"), "kind").where("child <> parent").distinct()


@register(
    "search_topics",
    f"""WITH {TOPICS_SQL}, ids AS (SELECT topic_id, book, name, 'T_' || (topic_id % 30) || '_' || topic_id AS tid, CASE WHEN topic_id % 4 = 0 THEN NULL ELSE chapter END AS chapter FROM topics),
        c AS (SELECT book, chapter, row_number() OVER (PARTITION BY book ORDER BY page_start, chapter) AS num FROM chapters)
        SELECT tid, i.book, name, CAST(coalesce(c.num, try_cast(split_part(tid, '_', 2) AS INT), 0) AS BIGINT) AS chapter_num,
        coalesce(i.chapter, 'Chapter ' || split_part(tid, '_', 2)) AS title FROM ids i LEFT JOIN c ON c.book = i.book AND c.chapter = i.chapter
        WHERE lower(name) LIKE '%bolt%' ORDER BY chapter_num, tid""",
)
def search_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Topics that hold a term; a chapter that isn't found is named by the number in the topic's id. Ids sort as strings."""
    tid = F.concat_ws("_", F.lit("T"), (F.col("topic_id") % 30).cast("string"), F.col("topic_id").cast("string"))
    hits = topics(spark, sf_dir).where(F.lower("name").contains("bolt")).select(
        tid.alias("tid"), "book", "name", F.when(F.col("topic_id") % 4 != 0, F.col("chapter")).alias("chapter")
    )
    nums = numbered(chapters(spark, sf_dir), ["book"], [F.col("page_start"), F.col("chapter")], "num").select("book", "chapter", "num")
    part = F.split("tid", "_")[1]
    return (
        hits.join(nums, ["book", "chapter"], "left")
        .select(
            "tid",
            "book",
            "name",
            F.coalesce("num", part.try_cast("int"), F.lit(0)).cast("long").alias("chapter_num"),
            F.coalesce("chapter", F.concat(F.lit("Chapter "), part)).alias("title"),
        )
        .orderBy("chapter_num", "tid")
    )


@register(
    "pages_from_exercise_ids",
    """WITH p AS (SELECT l_partkey AS topic, try_cast(split_part('E_' || l_partkey || '_' || (l_linenumber % 3 + 1) || '_1', '_', 3) AS INT) AS page FROM lineitem),
       s AS (SELECT topic, list(DISTINCT page ORDER BY page) AS pages FROM p GROUP BY topic) SELECT topic, array_to_string(CASE WHEN pages = [1] THEN [] ELSE pages END, ',') AS pages FROM s""",
)
def pages_from_exercise_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages decoded from exercise ids; the lone page 1 means unknown."""
    ident = F.concat_ws("_", F.lit("E"), F.col("l_partkey").cast("string"), (F.col("l_linenumber") % 3 + 1).cast("string"), F.lit("1"))
    page = F.split(ident, "_")[2].try_cast("int")
    sets = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("topic")).agg(F.array_sort(F.collect_set(page)).alias("pages"))
    blank = F.when(F.col("pages") == F.array(F.lit(1)), F.lit("")).otherwise(F.array_join(F.col("pages").cast("array<string>"), ","))
    return sets.select("topic", blank.alias("pages"))


@register(
    "inferred_prerequisites",
    f"""WITH {TOPICS_SQL}, c AS (SELECT book, chapter, row_number() OVER (PARTITION BY book ORDER BY page_start, chapter) AS n FROM chapters),
        t AS (SELECT topic_id, book, n, topic_id % 3 = 0 AS bare FROM topics JOIN c USING (book, chapter)),
        l AS (SELECT book, n, max(topic_id) AS last_id FROM t GROUP BY ALL)
        SELECT topic_id, last_id AS parent FROM t JOIN l ON l.book = t.book AND l.n = t.n - 1 WHERE bare""",
)
def inferred_prerequisites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A topic without prerequisites needs the last topic of the nearest earlier chapter that has any."""
    nums = numbered(chapters(spark, sf_dir), ["book"], [F.col("page_start"), F.col("chapter")], "n").select("book", "chapter", "n")
    placed = topics(spark, sf_dir).join(nums, ["book", "chapter"]).select("topic_id", "book", "n")
    ends = placed.groupBy("book", "n").agg(F.max("topic_id").alias("last_id"))
    earlier = ends.withColumn("parent", F.last("last_id", True).over(W.partitionBy("book").orderBy("n").rowsBetween(W.unboundedPreceding, -1)))
    return placed.where("topic_id % 3 = 0").join(earlier.select("book", "n", "parent"), ["book", "n"]).where("parent IS NOT NULL").select("topic_id", "parent")


@register("page_batches", "SELECT p_type AS book, CAST((row_number() OVER (PARTITION BY p_type ORDER BY p_partkey) - 1) // 7 AS BIGINT) AS batch, p_partkey AS page FROM part")
def page_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages in chunks of seven."""
    found = numbered(table(spark, sf_dir, "part"), ["p_type"], [F.col("p_partkey")], "n", 0)
    return found.select(F.col("p_type").alias("book"), F.expr("n div 7").cast("long").alias("batch"), F.col("p_partkey").alias("page"))


@register(
    "running_id_offsets",
    """WITH b AS (SELECT p_type AS book, p_size AS batch, count(*) AS n FROM part GROUP BY ALL)
       SELECT book, batch, CAST(coalesce(sum(n) OVER (PARTITION BY book ORDER BY batch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + 1 AS BIGINT) AS first_id FROM b""",
)
def running_id_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids go on counting from one batch to the next."""
    counts = table(spark, sf_dir, "part").groupBy(F.col("p_type").alias("book"), F.col("p_size").alias("batch")).agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(W.partitionBy("book").orderBy("batch").rowsBetween(W.unboundedPreceding, -1))
    return counts.select("book", "batch", (F.coalesce(before, F.lit(0)) + 1).alias("first_id"))


@register(
    "entity_counts",
    """SELECT p_type AS book, 'topics' AS entity, count(*) AS n FROM part GROUP BY p_type UNION ALL SELECT p_type, 'chapters', count(DISTINCT p_brand) FROM part GROUP BY p_type
       UNION ALL SELECT p_type, 'exercises', count(*) FROM part JOIN lineitem ON l_partkey = p_partkey GROUP BY p_type""",
)
def entity_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = topics(spark, sf_dir)
    exercises = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("topic_id")).agg(F.count(F.lit(1)).alias("e"))
    wide = parts.join(exercises, "topic_id", "left").groupBy("book").agg(
        F.count(F.lit(1)).alias("topics"), F.countDistinct("chapter").alias("chapters"), F.coalesce(F.sum("e"), F.lit(0)).alias("exercises")
    )
    return wide.unpivot("book", ["topics", "chapters", "exercises"], "entity", "n").where("n > 0")


@register(
    "change_report_counts",
    """SELECT p_type AS book, 'garbage' AS change, count(*) AS n FROM part WHERE p_name LIKE 's%' GROUP BY p_type UNION ALL SELECT p_type, 'inverted', count(*) FROM part WHERE p_size > 40 GROUP BY p_type
       UNION ALL SELECT p_type, 'duplicates', count(*) FROM (SELECT p_type FROM part QUALIFY row_number() OVER (PARTITION BY p_type, p_brand, p_name ORDER BY p_partkey) > 1) GROUP BY p_type""",
)
def change_report_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audit rows of each kind of change, counted for each book."""
    rows = numbered(topics(spark, sf_dir), ["book", "chapter", "name"], [F.col("topic_id")], "rank")
    found = [F.when(F.col("name").startswith("s"), "garbage"), F.when(F.col("page_start") > 40, "inverted"), F.when(F.col("rank") > 1, "duplicates")]
    kinds = rows.select("book", F.explode(F.array(*found)).alias("change")).where("change IS NOT NULL")
    return kinds.groupBy("book", "change").agg(F.count(F.lit(1)).alias("n"))
