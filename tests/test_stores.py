"""Tables that take changes: what is rewritten, lost drivers, conflicts, references in circles, late submissions in a stream."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from chalkline.operators.keyed_table import Conflict, KeyedTable
from chalkline.operators.references import CASCADE, SET_NULL, Reference, delete_with_references
from chalkline.plans.mastery import mastery_blend_fold, scored
from chalkline.streaming.mastery_store import MasteryStore

SF = "/root/testdata/sf0.001"


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_only_touched_buckets_are_rewritten(spark, tmp_path):
    store = KeyedTable(spark, f"file://{tmp_path}/t", ["id"], buckets=32)
    whole = store.upsert(spark.range(20_000).select("id", F.sha2(F.col("id").cast("string"), 256).alias("v")))
    before = store.latest().folders
    one = store.upsert(spark.createDataFrame([(7, "x")], "id long, v string"))
    after = store.latest().folders
    assert (whole.rewritten, one.rewritten) == (32, 1) and one.bytes < whole.bytes / 16
    assert sum(before[b] != after[b] for b in before) == 1
    assert store.read().where("id = 7").collect()[0]["v"] == "x" and store.read().count() == 20_000
    assert rows(store.read(spark.createDataFrame([(7,), (8,), (-1,)], "id long")).select("id")) == [(7,), (8,)]


def test_lost_driver_and_conflict(spark, tmp_path):
    store = KeyedTable(spark, f"file://{tmp_path}/t", ["id"], buckets=4)
    store.upsert(spark.createDataFrame([(1, "a"), (2, "b"), (None, "n")], "id long, v string"))
    change = spark.createDataFrame([(2, "c"), (3, "d")], "id long, v string")
    lost = store.stage(change, lambda old, new: new, "w", 5)
    assert rows(store.read()) == [(1, "a"), (2, "b"), (None, "n")]
    store.upsert(change, writer="w", batch=5)
    assert store.upsert(change.withColumn("v", F.lit("again")), writer="w", batch=5) is None
    with pytest.raises(Conflict):
        store.publish(lost)
    assert rows(store.read()) == [(1, "a"), (2, "c"), (3, "d"), (None, "n")]
    assert len(store.vacuum()) > 0 and rows(store.read()) == [(1, "a"), (2, "c"), (3, "d"), (None, "n")]
    store.delete(spark.createDataFrame([(1,), (9,)], "id long"))
    store.patch(spark.createDataFrame([(2, None, 1), (3, "p", 1), (8, "q", 1)], "id long, v string, w int"), ["v", "w"])
    assert rows(store.read()) == [(2, "c"), (3, "p"), (None, "n")]
    store.delete(store.read().where("id IS NOT NULL").select("id"))
    assert rows(store.read()) == [(None, "n")]
    with pytest.raises(ValueError, match="other keys"):
        KeyedTable(spark, f"file://{tmp_path}/t", ["v"], buckets=4).upsert(change)


def plain_delete(tables, references, root, gone):
    dead = {name: set() for name in tables}
    dead[root] = {r["id"] for r in tables[root]} & gone
    while True:
        more = [(ref.table, r["id"]) for ref in references if ref.rule == CASCADE for r in tables[ref.table] if r[ref.column] in dead[ref.parent] and r["id"] not in dead[ref.table]]
        if not more:
            break
        for name, k in more:
            dead[name].add(k)
    out = {}
    for name, own in tables.items():
        null = {ref.column: dead[ref.parent] for ref in references if ref.table == name and ref.rule == SET_NULL}
        out[name] = sorted((tuple(None if c in null and v in null[c] else v for c, v in r.items()) for r in own if r["id"] not in dead[name]), key=str)
    return out


def test_references_in_circles(spark):
    tables = {
        "a": [{"id": i, "up": i - 1 if i % 4 else None, "b": i * 3 % 11} for i in range(40)],
        "b": [{"id": i, "a": (i * 7 + 3) % 50, "a2": i % 13} for i in range(20)],
        "c": [{"id": i, "a": i % 40, "b": i % 20} for i in range(60)],
    }
    references = [Reference("a", "up", "a", CASCADE), Reference("b", "a", "a", CASCADE), Reference("a", "b", "b", CASCADE), Reference("b", "a2", "a", SET_NULL), Reference("c", "a", "a", SET_NULL), Reference("c", "b", "b", CASCADE)]
    frames = {n: spark.createDataFrame([tuple(r.values()) for r in own], ", ".join(f"{c} long" for c in own[0])) for n, own in tables.items()}
    for gone in ({1}, {5, 6, 99}, set(), {39}):
        keys = spark.createDataFrame([(k,) for k in gone] + [(None,)], "k long")
        left = delete_with_references(frames, dict.fromkeys(tables, "id"), references, "a", keys)
        assert {n: rows(x) for n, x in left.items()} == plain_delete(tables, references, "a", gone)
    with pytest.raises(ValueError, match="without a table"):
        delete_with_references(frames, dict.fromkeys(tables, "id"), [Reference("a", "up", "z", CASCADE)], "a", keys)


def test_stream_that_is_stopped_and_late(spark, tmp_path):
    """A stream into the store, started again over the same checkpoint, whose second file is earlier than its first."""
    events = scored(spark, SF).where("student_id < 6")
    middle = events.selectExpr("percentile_approx(event_id, 0.5)").first()[0]
    events.where(f"event_id > {middle}").coalesce(1).write.parquet(f"{tmp_path}/in")
    store = MasteryStore(spark, f"file://{tmp_path}/store", buckets=4)
    for _ in range(2):
        stream = spark.readStream.schema(events.schema).parquet(f"{tmp_path}/in")
        query = store.writer(stream).option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
        query.awaitTermination()
        events.where(f"event_id <= {middle}").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    assert store.state.done("mastery") == 1
    columns = ["student_id", "topic", "mastery", "n_events", "attempts", "time_spent", "hints"]
    assert rows(store.state.read().select(columns)) == rows(mastery_blend_fold(spark, SF).where("student_id < 6").select(columns))


def test_cache_opens_changed_files_only(spark, tmp_path):
    """A file whose time and size are as they were isn't opened, even if it says something else."""
    import os

    from chalkline.sources.cached import CachedBooks

    def put(book, text, when=None):
        path = tmp_path / "in" / book / "ontology.json"
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)
        os.utime(path, when and (when, when))

    cache = CachedBooks(spark, f"file://{tmp_path}/in", f"file://{tmp_path}/cache", buckets=4)
    assert cache.read().collect() == []
    for i, book in enumerate(["one", "two", "drei é", "four"]):
        put(book, f"first {i}", 1_700_000_000)
    assert cache.refresh() == (4, 0, 0) and cache.refresh() == (0, 4, 0)
    put("one", "FIRST 0", 1_700_000_000)  # behind the cache's back
    put("two", "later", 1_700_000_001)
    (tmp_path / "in" / "four" / "ontology.json").unlink()
    put("five", "new")
    before = cache.table.latest().version
    assert cache.refresh() == (2, 2, 1) and cache.table.latest().version == before + 1
    assert rows(cache.read()) == [("drei é", "first 2"), ("five", "new"), ("one", "first 0"), ("two", "later")]
    stored = spark.createDataFrame([("two", "stored"), ("six", "stored")], "book string, document string")
    assert rows(cache.lookup(stored).select("book", "document")) == [("drei é", "first 2"), ("five", "new"), ("one", "first 0"), ("six", "stored"), ("two", "stored")]
