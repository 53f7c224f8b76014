"""Queries over tables that take changes: merges by key, deletes along references, batches that count once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chalkline.operators.keyed_table import KeyedTable
from chalkline.operators.lineage import Scratch
from chalkline.operators.references import CASCADE, SET_NULL, Reference, delete_with_references
from chalkline.operators.writes import write_documents
from chalkline.plans.mastery import BLENDED_SQL, scored
from chalkline.plans.registry import register
from chalkline.sources.cached import CachedBooks
from chalkline.sources.tables import table
from chalkline.streaming.mastery_store import MasteryStore

K = F.col
STAMP = "2024-05-06 07:08:09"


@register(
    "merge_sink",
    f"""WITH base AS (SELECT c_custkey AS id, c_name AS name, c_acctbal AS balance FROM customer),
        upserted AS (SELECT id, CASE WHEN id % 5 = 0 THEN 'second ' || id ELSE name END AS name, CASE WHEN id % 5 = 0 THEN balance + 2 ELSE balance END AS balance FROM base
                     UNION ALL SELECT -id - 1, 'new ' || id, balance FROM base WHERE id % 50 = 0)
        SELECT id, CASE WHEN id % 7 = 0 THEN 'patched' ELSE name END AS name, balance, CASE WHEN id % 7 = 0 THEN TIMESTAMP '{STAMP}' END AS updated_at
        FROM upserted WHERE id % 11 <> 0""",
)
def merge_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table after an upsert with two rows a key, a patch whose first run was lost before it was published, the same patch once more, and a delete."""
    store = KeyedTable(spark, Scratch(spark, "merged").where("customers"), ["id"], buckets=16)
    base = table(spark, sf_dir, "customer").select(K("c_custkey").alias("id"), K("c_name").alias("name"), K("c_acctbal").alias("balance"), F.lit(None).cast("timestamp_ntz").alias("updated_at"))
    store.upsert(base)
    twice = base.where("id % 5 = 0").withColumn("seq", F.explode(F.array(F.lit(1), F.lit(2))))
    twice = twice.withColumns({"balance": K("balance") + K("seq"), "name": F.concat(F.when(K("seq") == 1, "first ").otherwise("second "), K("id").cast("string"))})
    new = base.where("id % 50 = 0").select((-K("id") - 1).alias("id"), F.concat(F.lit("new "), K("id").cast("string")).alias("name"), "balance", "updated_at", F.lit(1).alias("seq"))
    store.upsert(twice.unionByName(new), order=[K("seq")])
    patch = store.read().where("id % 7 = 0").select("id", F.lit("patched").alias("name"), F.lit(None).cast("double").alias("balance"))
    allowed, stamp = ["name", "balance"], F.lit(STAMP).cast("timestamp_ntz")
    store.stage(patch, lambda old, rows: old.where("false"), "patches", 0)  # a driver that is lost here has changed nothing
    for _ in range(2):
        store.patch(patch, allowed, stamp, writer="patches", batch=0)
    store.delete(store.read().where("id % 11 = 0").select("id"))
    return store.read()


REFERENCES = [
    Reference("customers", "nation", "nations", CASCADE),
    Reference("suppliers", "nation", "nations", CASCADE),
    Reference("parts", "maker", "suppliers", CASCADE),
    Reference("parts", "parent", "parts", CASCADE),
    Reference("orders", "customer", "customers", CASCADE),
    Reference("items", "order_id", "orders", CASCADE),
    Reference("items", "part", "parts", CASCADE),
    Reference("items", "supplier", "suppliers", SET_NULL),
    Reference("events", "student", "customers", SET_NULL),
]


@register(
    "reference_closure",
    """WITH RECURSIVE n AS (SELECT n_nationkey AS k FROM nation WHERE n_nationkey % 5 = 1),
       c AS (SELECT c_custkey AS k FROM customer WHERE c_nationkey IN (SELECT k FROM n)), s AS (SELECT s_suppkey AS k FROM supplier WHERE s_nationkey IN (SELECT k FROM n)),
       p AS (SELECT p_partkey AS k FROM part WHERE p_partkey % 97 IN (SELECT k FROM s)
             UNION SELECT x.p_partkey FROM part x JOIN p ON x.p_partkey // 3 = p.k WHERE x.p_partkey % 4 = 0),
       o AS (SELECT o_orderkey AS k FROM orders WHERE o_custkey IN (SELECT k FROM c))
       SELECT 'nations' AS name, CAST(n_nationkey AS VARCHAR) AS id, NULL AS ref FROM nation WHERE n_nationkey NOT IN (SELECT k FROM n)
       UNION ALL SELECT 'customers', CAST(c_custkey AS VARCHAR), NULL FROM customer WHERE c_custkey NOT IN (SELECT k FROM c)
       UNION ALL SELECT 'suppliers', CAST(s_suppkey AS VARCHAR), NULL FROM supplier WHERE s_suppkey NOT IN (SELECT k FROM s)
       UNION ALL SELECT 'parts', CAST(p_partkey AS VARCHAR), NULL FROM part WHERE p_partkey NOT IN (SELECT k FROM p)
       UNION ALL SELECT 'orders', CAST(o_orderkey AS VARCHAR), NULL FROM orders WHERE o_orderkey NOT IN (SELECT k FROM o)
       UNION ALL SELECT 'items', l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey, CASE WHEN l_suppkey NOT IN (SELECT k FROM s) THEN CAST(l_suppkey AS VARCHAR) END
         FROM lineitem WHERE l_orderkey NOT IN (SELECT k FROM o) AND l_partkey NOT IN (SELECT k FROM p)
       UNION ALL SELECT 'events', CAST(event_id AS VARCHAR), CASE WHEN user_id NOT IN (SELECT k FROM c) THEN CAST(user_id AS VARCHAR) END FROM events""",
)
def reference_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of seven tables once a fifth of the nations goes: items are reached by their order and by their part, parts also by other parts."""
    part, item = table(spark, sf_dir, "part"), table(spark, sf_dir, "lineitem")
    tables = {
        "nations": table(spark, sf_dir, "nation").select(K("n_nationkey").alias("id")),
        "customers": table(spark, sf_dir, "customer").select(K("c_custkey").alias("id"), K("c_nationkey").alias("nation")),
        "suppliers": table(spark, sf_dir, "supplier").select(K("s_suppkey").alias("id"), K("s_nationkey").alias("nation")),
        "parts": part.select(K("p_partkey").alias("id"), (K("p_partkey") % 97).alias("maker"), F.when(K("p_partkey") % 4 == 0, F.expr("p_partkey div 3")).alias("parent")),
        "orders": table(spark, sf_dir, "orders").select(K("o_orderkey").alias("id"), K("o_custkey").alias("customer")),
        "items": item.select(F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("id"), K("l_orderkey").alias("order_id"), K("l_partkey").alias("part"), K("l_suppkey").alias("supplier")),
        "events": table(spark, sf_dir, "events").select(K("event_id").alias("id"), K("user_id").alias("student")),
    }
    left = delete_with_references(tables, dict.fromkeys(tables, "id"), REFERENCES, "nations", tables["nations"].where("id % 5 = 1"))
    kept = {"items": K("supplier"), "events": K("student")}
    told = [left[name].select(F.lit(name).alias("name"), K("id").cast("string").alias("id"), kept.get(name, F.lit(None)).cast("string").alias("ref")) for name in tables]
    whole = told[0]
    for one in told[1:]:
        whole = whole.unionByName(one)
    return whole


@register(
    "mastery_exactly_once",
    f"""WITH RECURSIVE {BLENDED_SQL} SELECT b.student_id, b.topic, b.mastery, CAST(b.n_events AS INT) AS n_events,
        t.attempts, t.time_spent, t.hints
        FROM blended b JOIN (SELECT student_id, topic, CAST(sum(attempts) AS BIGINT) AS attempts, CAST(sum(time_spent) AS BIGINT) AS time_spent,
                             CAST(sum(hints) AS BIGINT) AS hints FROM scored GROUP BY ALL) t USING (student_id, topic)""",
)
def mastery_exactly_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All submissions in three batches, of which a seventh comes late, one is lost between log and state, and two come twice."""
    store = MasteryStore(spark, Scratch(spark, "mastery").where("store"), buckets=16)
    events = scored(spark, sf_dir)
    number = F.when(K("event_id") % 7 == 0, 2).when(K("submitted_at") < F.lit("2024-01-01").cast("timestamp"), 0).otherwise(K("event_id") % 2)
    batches = [events.where(number == b) for b in range(3)]
    store.absorb(batches[0], 0)
    store.record(batches[1], 1)  # a driver that is lost here has the submissions in the log only
    for batch, rows in ((1, batches[1]), (1, batches[1]), (2, batches[2].unionByName(batches[0].where("event_id % 5 = 0"))), (2, batches[2])):
        store.absorb(rows, batch)
    return store.state.read().drop("last_at", "last_event")


@register(
    "cached_books",
    """WITH b AS (SELECT p_type AS book, dense_rank() OVER (ORDER BY p_type) AS k, count(*) AS n FROM part GROUP BY p_type)
       SELECT book, CASE WHEN k % 7 = 3 THEN '{"from": "store"}' WHEN k % 5 = 1 THEN '{"topics": ' || n || ', "edition": 2}' ELSE '{"topics": ' || n || '}' END AS document,
              CASE WHEN k % 7 = 3 THEN 0 ELSE 1 END AS priority, CASE WHEN k % 5 = 1 AND k % 11 <> 2 THEN 2 ELSE 1 END AS times_read
       FROM b WHERE k % 11 <> 2 OR k % 7 = 3""",
)
def cached_books(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Books by a cache of files, read, then changed and read again: what the store has comes from there, and each file was read as often as it was new."""
    scratch = Scratch(spark, "cached")
    folder = scratch.where("files")
    rank = F.dense_rank().over(W.orderBy("book"))  # books are few
    parts = table(spark, sf_dir, "part").groupBy(K("p_type").alias("book")).agg(F.count("*").alias("n")).withColumn("k", rank)
    parts = scratch.keep(parts, "books")
    topics = F.concat(F.lit('{"topics": '), K("n").cast("string"))
    cache = CachedBooks(spark, folder, scratch.where("cache"))
    write_documents(parts.select("book", F.concat(topics, F.lit("}")).alias("document")), folder, "book")
    cache.refresh()
    before = scratch.keep(cache.table.read().select("book", K("modified").alias("_old")), "before")
    for gone in parts.where("k % 11 = 2").select("book").collect():  # files that another program removes
        where = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{gone['book']}")
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    write_documents(parts.where("k % 5 = 1 AND k % 11 <> 2").select("book", F.concat(topics, F.lit(', "edition": 2}')).alias("document")), folder, "book")
    found = cache.lookup(parts.where("k % 7 = 3").select("book", F.lit('{"from": "store"}').alias("document")))
    after = cache.table.read().select("book", K("modified").alias("_new"))
    again = F.when(K("_old") < K("_new"), 2).otherwise(1).alias("times_read")
    return found.join(before, "book").join(after, "book", "left").select("book", F.regexp_replace("document", "\n$", "").alias("document"), "priority", again)
