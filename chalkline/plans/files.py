"""Written and read again: tables, documents, plans, raw responses and checkpoints, in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chalkline.functions.text import normalised
from chalkline.operators.folds import first_by
from chalkline.operators.keyed import patched, set_null
from chalkline.operators.lineage import Scratch
from chalkline.operators.writes import Checkpoint, insert, replace_partitions, write_documents, write_plans, write_raw
from chalkline.plans.books import BOOKS_SQL, raw_books
from chalkline.plans.registry import register
from chalkline.sources.documents import discover, first_source, parse_strict, read_stems
from chalkline.sources.tables import table

K = F.col


def _folder(spark: SparkSession, name: str) -> str:
    return Scratch(spark, name).where(name)


@register("insert_rows", "SELECT o_orderstatus AS status, count(*) AS n, count(*) AS n_ids, count(*) AS stamped FROM orders GROUP BY o_orderstatus")
def insert_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two batches inserted into a table; every row has an id of its own and a stamp."""
    path = _folder(spark, "plans")
    rows = table(spark, sf_dir, "orders").select(K("o_orderkey").alias("plan"), K("o_orderstatus").alias("status"))
    insert(rows.where("plan % 2 = 0"), path)
    insert(rows.where("plan % 2 = 1"), path)
    found = spark.read.parquet(path)
    return found.groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("id").alias("n_ids"), F.count("created_at").alias("stamped"))


@register(
    "partial_update",
    """SELECT s_suppkey AS id, CASE WHEN s_suppkey % 2 = 0 AND s_suppkey % 4 = 0 THEN 'new ' || s_suppkey ELSE s_name END AS name, s_nationkey AS nation,
       CASE WHEN s_suppkey % 4 = 0 THEN TIMESTAMP '2024-05-06 07:08:09' ELSE TIMESTAMP '2024-01-01 00:00:00' END AS updated_at FROM supplier""",
)
def partial_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Teachers with the allowed fields of a patch; nulls change nothing, and neither do fields that aren't allowed. What changes gets a new stamp."""
    base = table(spark, sf_dir, "supplier").select(K("s_suppkey").alias("id"), K("s_name").alias("name"), K("s_nationkey").alias("nation"), F.lit("2024-01-01").cast("timestamp_ntz").alias("updated_at"))
    name = F.when(K("id") % 4 == 0, F.concat(F.lit("new "), K("id").cast("string")))
    patch = base.where("id % 2 = 0").select("id", name.alias("name"), F.lit(-1).alias("nation"))
    return patched(base, patch, "id", ["name", "email"], F.lit("2024-05-06 07:08:09").cast("timestamp_ntz"))


@register("set_null_on_delete", "SELECT l_orderkey AS id, l_linenumber AS n, CASE WHEN l_suppkey % 3 <> 0 THEN l_suppkey END AS teacher FROM lineitem")
def set_null_on_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows stay when the teacher that they name is deleted, without the name."""
    gone = table(spark, sf_dir, "supplier").where("s_suppkey % 3 = 0")
    rows = table(spark, sf_dir, "lineitem").select(K("l_orderkey").alias("id"), K("l_linenumber").alias("n"), K("l_suppkey").alias("teacher"))
    return set_null(gone, "s_suppkey", rows, "teacher")


@register(
    "replace_book",
    """WITH b AS (SELECT p_type AS book, dense_rank() OVER (ORDER BY p_type) AS k, p_partkey AS topic, p_name AS name FROM part)
       SELECT book, topic, name FROM b WHERE k % 2 = 0 UNION ALL SELECT book, topic, name || ' 2' FROM b WHERE k % 2 = 1 AND topic % 3 = 0""",
)
def replace_book(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Books replaced as a whole by a later import, twice over; the others stay as they were."""
    path = _folder(spark, "topics")
    rows = table(spark, sf_dir, "part").select(K("p_type").alias("book"), K("p_partkey").alias("topic"), K("p_name").alias("name"))
    replace_partitions(rows, path, "book")
    again = rows.select("book").distinct().withColumn("k", F.dense_rank().over(W.orderBy("book"))).where("k % 2 = 1")  # books are few
    later = rows.join(again.select("book"), "book", "left_semi").where("topic % 3 = 0").withColumn("name", F.concat("name", F.lit(" 2")))
    for _ in range(2):
        replace_partitions(later, path, "book")
    return spark.read.schema(rows.schema).parquet(path).select("book", "topic", "name")


@register(
    "documents_discovered",
    f"WITH {BOOKS_SQL} SELECT book, count(*) AS topics, count(*) FILTER (name LIKE '%గేయం%') AS marked FROM (SELECT book, name || ' గేయం' AS name FROM topics) GROUP BY book",
)
def documents_discovered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Books written as JSON files, half of them a level deeper, found and read again; a deeper file beside one of its own folder doesn't count."""
    path = _folder(spark, "output")
    raw = raw_books(spark, sf_dir)
    raw = Scratch(spark, "books").keep(raw.select("book", "part", F.regexp_replace("document", '("name":"[^"]*)', "$1 గేయం").alias("document")), "raw")
    deep = F.length("book") % 2 == 0
    write_documents(raw.where(~deep), path, "book")
    write_documents(raw.where(deep), f"{path}/strict", "book")
    write_documents(raw.where(~deep).select(F.concat("book", F.lit("/old")).alias("book"), F.lit("{}").alias("document")).distinct(), path, "book")
    c = parse_strict(discover(spark, path))
    return c.topics.groupBy("book").agg(F.count(F.lit(1)).alias("topics"), F.count_if(K("name").contains("గేయం")).alias("marked"))


@register(
    "prioritised_books",
    """WITH b AS (SELECT DISTINCT p_type AS book, dense_rank() OVER (ORDER BY p_type) AS k FROM part) SELECT book, CASE WHEN k % 3 = 0 THEN 1 ELSE 0 END AS priority, CASE WHEN k % 3 = 0 THEN 'file' ELSE 'database' END AS source FROM b WHERE k % 3 <> 2 OR k % 2 = 0""",
)
def prioritised_books(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Books from the database, else from their file."""
    books = table(spark, sf_dir, "part").select(K("p_type").alias("book")).distinct().withColumn("k", F.dense_rank().over(W.orderBy("book")))  # books are few
    books = books.where("k % 3 <> 2 OR k % 2 = 0")
    path = _folder(spark, "data")
    write_documents(books.where("k % 2 = 0 OR k % 3 = 0").select("book", F.lit('{"source": "file"}').alias("document")), path, "book")
    database = books.where("k % 3 <> 0").select("book", F.lit('{"source": "database"}').alias("document"))
    found = first_source([database, discover(spark, path)], "book")
    return found.select("book", "priority", F.get_json_object("document", "$.source").alias("source"))


@register(
    "book_names_union",
    """WITH b AS (SELECT DISTINCT p_type AS book, dense_rank() OVER (ORDER BY p_type) AS k FROM part)
       SELECT 'union' AS listing, row_number() OVER (ORDER BY book) AS place, book FROM b UNION ALL SELECT 'fallback', row_number() OVER (ORDER BY book), book FROM b WHERE k % 2 = 1""",
)
def book_names_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of books in the database and in files together; and of those in files where the database has none."""
    books = table(spark, sf_dir, "part").select(K("p_type").alias("book")).distinct().withColumn("k", F.dense_rank().over(W.orderBy("book")))  # books are few
    path = _folder(spark, "data")
    write_documents(books.where("k % 2 = 1").select("book", F.lit("{}").alias("document")), path, "book", None)
    filed = read_stems(spark, path).select("book")
    database = books.where("k % 2 = 0 OR k = 1").select("book")
    placed = lambda df, name: df.select(F.lit(name).alias("listing"), F.row_number().over(W.orderBy("book")).alias("place"), "book")
    return placed(database.unionByName(filed).distinct(), "union").unionByName(placed(books_or_files(database.limit(0), filed), "fallback"))


def books_or_files(database: DataFrame, filed: DataFrame) -> DataFrame:
    """Books of the database, or those of files if it has none."""
    return filed if database.isEmpty() else database


@register(
    "plan_files",
    """SELECT lower(replace(p_type, ' ', '_')) AS book, lower(replace(p_name, ' ', '_')) || '_a' AS topic, count(*) AS n, sum(p_partkey) AS keys FROM part GROUP BY ALL""",
)
def plan_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lesson plans in folders of their book and topic, written twice and read again."""
    path = _folder(spark, "plans")
    document = F.to_json(F.struct(K("p_partkey").alias("id")))
    plans = table(spark, sf_dir, "part").select(F.concat("p_type", F.lit("?")).alias("book"), F.concat("p_name", F.lit(": A")).alias("topic"), document.alias("value"))
    for _ in range(2):  # the second time changes nothing
        write_plans(plans, path)
    found = spark.read.schema("value string, book string, topic string").text(path)
    return found.groupBy("book", "topic").agg(F.count(F.lit(1)).alias("n"), F.sum(F.get_json_object("value", "$.id").cast("long")).alias("keys"))


@register("raw_responses", "SELECT coalesce(lang, 'none') AS label, count(*) AS n, sum(length(coalesce(text, ''))) AS chars FROM documents GROUP BY ALL")
def raw_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw texts by label, with their line breaks; a label that is written again is replaced, a text that is null comes back empty."""
    path = _folder(spark, "raw")
    rows = table(spark, sf_dir, "documents").select(K("lang").alias("label"), K("text").alias("raw"))
    write_raw(rows.where("label = 'en'").limit(3), path)
    write_raw(rows, path)
    found = spark.read.option("lineSep", "\x1e").schema("value string, label string").text(path)
    return found.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.sum(F.char_length("value")).alias("chars"))


@register(
    "checkpointed_chapters",
    """WITH c AS (SELECT DISTINCT p_type || '/' || p_brand AS chapter, CAST(regexp_extract(p_brand, '(\\d+)', 1) AS INT) AS k FROM part) SELECT 1 AS run, chapter FROM c WHERE k % 3 = 0 UNION ALL SELECT 2, chapter FROM c WHERE k % 3 <> 0""",
)
def checkpointed_chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each of three runs works on: a third is done before the first run breaks off, the second does the rest, nothing is left for the third."""
    work = table(spark, sf_dir, "part").select(F.concat_ws("/", "p_type", "p_brand").alias("chapter"), F.regexp_extract("p_brand", r"(\d+)", 1).cast("int").alias("k")).distinct()
    done, scratch = Checkpoint(spark, _folder(spark, "done"), "chapter"), Scratch(spark, "runs")
    runs = []
    for run, until in ((1, "k % 3 = 0"), (2, "true"), (3, "true")):
        own = scratch.keep(done.left(work).where(until).select(F.lit(run).alias("run"), "chapter"), "run")
        for _ in range(2):  # noted twice, as after a crash between the two
            done.note(own)
        runs.append(own)
    return runs[0].unionByName(runs[1]).unionByName(runs[2])


# --- pages --------------------------------------------------------------------------------------------------------------


@register(
    "reading_order_text",
    r"""WITH b AS (SELECT l_orderkey AS page, l_quantity AS y, l_partkey % 100 AS x, l_linenumber AS n, CASE WHEN l_linenumber % 5 = 0 THEN 1 ELSE 0 END AS kind, CASE WHEN l_linenumber % 4 = 0 THEN ' ' ELSE ' block ' || l_partkey || chr(10) END AS text FROM lineitem)
        SELECT page, chr(10) || '--- Page ' || (page + 1) || ' ---' || chr(10) || coalesce(string_agg(regexp_replace(text, '^\s+|\s+$', '', 'g') || chr(10) || chr(10), '' ORDER BY y, x, n, regexp_replace(text, '^\s+|\s+$', '', 'g')) FILTER (kind = 0 AND trim(text) <> ''), '') AS text FROM b GROUP BY page""",
)
def reading_order_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text blocks of pages from top to bottom, then left to right, under a mark of the page; images and blank blocks go."""
    text = F.when(K("l_linenumber") % 4 == 0, " ").otherwise(F.concat(F.lit(" block "), K("l_partkey").cast("string"), F.lit("\n")))
    blocks = table(spark, sf_dir, "lineitem").select(
        K("l_orderkey").alias("page"), K("l_quantity").alias("y"), (K("l_partkey") % 100).alias("x"), K("l_linenumber").alias("n"), F.when(K("l_linenumber") % 5 == 0, 1).otherwise(0).alias("kind"), text.alias("text")
    )
    return page_texts(blocks)


def page_texts(blocks: DataFrame) -> DataFrame:
    """(page, text) of blocks (page, y, x, n, kind, text) in reading order; kind 0 is text."""
    stripped = F.regexp_replace("text", r"(?U)^\s+|\s+$", "")
    own = F.when((K("kind") == 0) & (stripped != ""), F.struct("y", "x", "n", stripped.alias("t")))
    pages = blocks.groupBy("page").agg(F.array_sort(F.collect_list(own)).alias("b"))
    body = F.array_join(F.transform("b", lambda x: F.concat(x["t"], F.lit("\n\n"))), "")
    return pages.select("page", F.concat(F.lit("\n--- Page "), (K("page") + 1).cast("string"), F.lit(" ---\n"), body).alias("text"))


@register("significant_images", "SELECT l_orderkey AS page, bool_or(l_partkey % 300 > 100 AND l_suppkey * 20 > 100) AS significant FROM lineitem GROUP BY l_orderkey")
def significant_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a page holds an image of which both sides are over 100 pixels."""
    pages = table(spark, sf_dir, "lineitem").groupBy(K("l_orderkey").alias("page")).agg(F.collect_list(F.struct((K("l_partkey") % 300).alias("w"), (K("l_suppkey") * 20).alias("h"))).alias("images"))
    return pages.select("page", F.exists("images", lambda i: (i["w"] > 100) & (i["h"] > 100)).alias("significant"))


@register(
    "ocr_text",
    "SELECT o_custkey AS job, coalesce(string_agg(CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE 'text ' || o_orderkey END, '' ORDER BY 'out/' || o_orderkey || '.json') FILTER (o_orderkey % 5 <> 0), '') AS text FROM orders GROUP BY o_custkey",
)
def ocr_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of a job's result files, one after another in the order of their names; other files, and results without a text, add nothing."""
    name = F.concat(F.lit("out/"), K("o_orderkey").cast("string"), F.when(K("o_orderkey") % 5 == 0, ".pdf").otherwise(".json"))
    content = F.when(K("o_orderkey") % 3 == 0, "{}").otherwise(F.concat(F.lit('{"text": "text '), K("o_orderkey").cast("string"), F.lit('"}')))
    blobs = table(spark, sf_dir, "orders").select(K("o_custkey").alias("job"), name.alias("name"), content.alias("content"))
    told = F.when(K("name").endswith(".json"), F.struct("name", F.coalesce(F.get_json_object("content", "$.text"), F.lit("")).alias("t")))
    return blobs.groupBy("job").agg(F.array_join(F.transform(F.array_sort(F.collect_list(told)), lambda x: x["t"]), "").alias("text"))


# --- curricula made of pages ------------------------------------------------------------------------------------------

_PAGES = """pages AS (SELECT p_type AS chapter, p_partkey AS page, CASE WHEN p_partkey % 4 = 1 THEN '' ELSE 'text of ' || p_name END AS text, CASE WHEN p_partkey % 3 = 0 THEN 'do ' || p_partkey END AS exercises, p_partkey % 11 = 7 AS failed FROM part)"""


@register(
    "curriculum_from_pages",
    f"""WITH {_PAGES}, r AS (SELECT *, sum(CASE WHEN text <> '' THEN 1 ELSE 0 END) OVER w AS t, sum(CASE WHEN exercises IS NOT NULL THEN 1 ELSE 0 END) OVER w AS e FROM pages WHERE NOT failed WINDOW w AS (PARTITION BY chapter ORDER BY page))
        SELECT chapter, 'T_' || t AS id, left(text, 200) AS text, page FROM r WHERE text <> '' UNION ALL SELECT chapter, 'E_' || t || '_' || e, exercises, page FROM r WHERE exercises IS NOT NULL""",
)
def curriculum_from_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A topic for each page with text; exercises belong to the last topic before them. Pages that failed count for nothing."""
    n = K("p_partkey")
    pages = table(spark, sf_dir, "part").select(
        K("p_type").alias("chapter"), n.alias("page"), F.when(n % 4 == 1, "").otherwise(F.concat(F.lit("text of "), "p_name")).alias("text"),
        F.when(n % 3 == 0, F.concat(F.lit("do "), n.cast("string"))).alias("exercises"), (n % 11 == 7).alias("failed"),
    )
    upto = W.partitionBy("chapter").orderBy("page")
    has = lambda c: (F.coalesce(c, F.lit("")) != "").cast("int")
    rows = pages.where("NOT failed").withColumns({"t": F.sum(has("text")).over(upto), "e": F.sum(has("exercises")).over(upto)})
    topics = rows.where(has("text") == 1).select("chapter", F.concat(F.lit("T_"), K("t").cast("string")).alias("id"), F.substring("text", 1, 200).alias("text"), "page")
    exercises = rows.where(has("exercises") == 1).select("chapter", F.concat_ws("_", F.lit("E"), K("t").cast("string"), K("e").cast("string")).alias("id"), K("exercises").alias("text"), "page")
    return topics.unionByName(exercises)


@register(
    "image_enrichment",
    """WITH t AS (SELECT p_type AS book, p_partkey AS topic, p_size AS ps, p_size + p_partkey % 3 AS pe FROM part),
       i AS (SELECT DISTINCT b.book, l_orderkey % 60 AS pdf FROM lineitem, (SELECT DISTINCT book FROM t) b),
       p AS (SELECT *, greatest(pdf - 3 + 1, 1) AS page, CASE WHEN pdf % 4 = 0 THEN '' ELSE 'picture ' || pdf END AS description, CASE WHEN pdf % 3 = 0 THEN 'draw ' || pdf ELSE '' END AS exercise FROM i),
       m AS (SELECT p.*, coalesce((SELECT max(topic) FROM t WHERE t.book = p.book AND p.page BETWEEN ps AND pe AND p.page > 0), (SELECT arg_min(topic, (abs(ps - p.page), topic)) FROM t WHERE t.book = p.book)) AS topic FROM p)
       SELECT book, 'S_' || topic || '_' || (row_number() OVER (PARTITION BY book ORDER BY pdf) + 2) AS id, '[IMAGE] ' || description AS text, page, topic FROM m WHERE description <> ''
       UNION ALL SELECT book, 'E_' || topic || '_' || (row_number() OVER (PARTITION BY book ORDER BY pdf) + 5), '[VISUAL ACTIVITY] ' || exercise, page, topic FROM m WHERE exercise <> ''""",
)
def image_enrichment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Descriptions and exercises that pictures gave, filed under the topic of their printed page with ids that go on from those that are there."""
    parts = table(spark, sf_dir, "part")
    topics = parts.select(K("p_type").alias("book"), K("p_partkey").alias("topic"), K("p_size").alias("ps"), (K("p_size") + K("p_partkey") % 3).alias("pe"))
    pdf = table(spark, sf_dir, "lineitem").select((K("l_orderkey") % 60).alias("pdf")).distinct()
    pages = topics.select("book").distinct().crossJoin(pdf)  # every book has a picture on each of these pages
    pages = pages.withColumn("page", F.greatest(K("pdf") - 3 + 1, F.lit(1)))
    pages = pages.withColumns({"description": F.when(K("pdf") % 4 == 0, "").otherwise(F.concat(F.lit("picture "), K("pdf").cast("string"))), "exercise": F.when(K("pdf") % 3 == 0, F.concat(F.lit("draw "), K("pdf").cast("string"))).otherwise("")})
    held = topics.where("ps <= pe").withColumn("page", F.explode(F.sequence("ps", "pe"))).where("page > 0").groupBy("book", "page").agg(F.max("topic").alias("held"))
    starts = topics.groupBy("book", K("ps").alias("page")).agg(F.min("topic").alias("at"))
    line = pages.select("book", "page").unionByName(starts.select("book", "page")).distinct().join(starts, ["book", "page"], "left").withColumn("start", F.when(K("at").isNotNull(), F.struct("page", "at")))
    w = W.partitionBy("book").orderBy("page")
    before, after = F.last("start", True).over(w.rowsBetween(W.unboundedPreceding, 0)), F.first("start", True).over(w.rowsBetween(1, W.unboundedFollowing))
    away = lambda s: F.when(s.isNotNull(), F.struct(F.abs(s["page"] - K("page")).alias("d"), s["at"].alias("t")))
    near = line.select("book", "page", F.least(away(before), away(after))["t"].alias("near"))
    placed = pages.join(held, ["book", "page"], "left").join(near, ["book", "page"]).withColumn("topic", F.coalesce("held", "near"))

    def added(column: str, prefix: str, mark: str, there: int) -> DataFrame:
        own = placed.where(K(column) != "").withColumn("n", F.row_number().over(W.partitionBy("book").orderBy("pdf")) + there)
        return own.select("book", F.concat_ws("_", F.lit(prefix), K("topic").cast("string"), K("n").cast("string")).alias("id"), F.concat(F.lit(mark), K(column)).alias("text"), "page", "topic")

    return added("description", "S", "[IMAGE] ", 2).unionByName(added("exercise", "E", "[VISUAL ACTIVITY] ", 5))


@register(
    "sidebar_dedup",
    "SELECT doc_id FROM documents QUALIFY row_number() OVER (PARTITION BY source, lower(left(trim(regexp_replace(coalesce(text, ''), '[\\s\\x{A0}]+', ' ', 'g')), 80)) ORDER BY doc_id) = 1",
)
def sidebar_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Side boxes of a topic whose first 80 characters are the same, whatever their case and spacing, are one."""
    keyed = table(spark, sf_dir, "documents").select("doc_id", "source", F.lower(F.substring(normalised(F.coalesce("text", F.lit(""))), 1, 80)).alias("key"))
    return first_by(keyed, ["source", "key"], [K("doc_id")]).select("doc_id")
