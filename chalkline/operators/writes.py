"""Sinks: tables that grow, are patched or replaced by the book, and files for people and other programs."""

from __future__ import annotations

import re
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chalkline.functions.text import safe_dirname
from chalkline.operators.lineage import settings

#: Files that get their names at one time.
RENAMES = 16


def insert(rows: DataFrame, path: str, stamp: Column | None = None) -> None:
    """Appends rows with an ``id`` and ``created_at`` of their own."""
    rows.withColumns({"id": F.uuid(), "created_at": F.current_timestamp() if stamp is None else stamp}).write.mode("append").parquet(path)


def replace_partitions(rows: DataFrame, path: str, key: str) -> None:
    """Writes rows so that each key they have is replaced as a whole and every other one stays; the same rows again change nothing."""
    with settings(rows.sparkSession, {"spark.sql.sources.partitionOverwriteMode": "dynamic"}):
        rows.repartition(key).write.mode("overwrite").partitionBy(key).parquet(path)


def _files(spark: SparkSession, path: str) -> tuple:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def write_documents(rows: DataFrame, path: str, key: str, name: str | None = "ontology.json") -> None:
    """Writes (key, document) as ``path/{key}/{name}``, without a name as ``path/{key}.json``; UTF-8 as it is, one file for each key.

    With a column ``part`` and a name a key has a file for each of its parts, of which all but 0 have their number before
    the ending; parts of an earlier write that this one doesn't have go.

    Tasks write the files; what is left to the driver is giving each its name, RENAMES at a time. The old file goes only
    when the new one is whole, and a repeated call ends alike.
    """
    spark = rows.sparkSession
    fs, root = _files(spark, path)
    partial = f"{path}/_written"
    part = F.coalesce(F.col("part").cast("long"), F.lit(0)) if name and "part" in rows.columns else F.lit(0).cast("long")
    told = rows.select(key, part.alias("_part"), "document")
    told.repartition(key, "_part").write.mode("overwrite").partitionBy(key, "_part").option("lineSep", "\n").text(partial)
    of = lambda *x: spark._jvm.org.apache.hadoop.fs.Path(*x)
    value = lambda title: spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.unescapePathName(title.split("=", 1)[1])
    stem, _, ending = (name or "").rpartition(".")

    def named(job: tuple) -> None:
        source, target = job
        fs.mkdirs(target.getParent())
        for one in fs.listStatus(source):
            if one.getPath().getName().startswith("part-"):
                fs.delete(target, False)
                if not fs.rename(one.getPath(), target):
                    raise OSError(f"{one.getPath()} could not be renamed to {target}")

    jobs, homes = [], []
    for folder in fs.listStatus(of(partial)):
        title = folder.getPath().getName()
        if "=" not in title:
            continue
        own = {value(x.getPath().getName()): x.getPath() for x in fs.listStatus(folder.getPath())}
        if name:
            home, files = of(root, value(title)), {k: name if k == "0" else f"{stem}.{k}.{ending}" for k in own}
            homes.append((home, set(files.values())))
            jobs += [(own[k], of(home, files[k])) for k in own]
        else:
            jobs += [(x, of(root, f"{value(title)}.json")) for x in own.values()]
    with ThreadPoolExecutor(RENAMES) as pool:
        list(pool.map(named, jobs))
    former = re.compile(rf"{re.escape(stem)}(\.-?\d+)?\.{re.escape(ending)}")
    for home, files in homes:
        for old in fs.listStatus(home):
            if former.fullmatch(old.getPath().getName()) and old.getPath().getName() not in files:
                fs.delete(old.getPath(), False)
    fs.delete(of(partial), True)


def write_plans(plans: DataFrame, path: str) -> None:
    """Plans (book, topic, document) under folders of the book and the topic, whose names are made safe; a topic that is written again is replaced."""
    named = plans.withColumns({"book": safe_dirname(F.col("book")), "topic": safe_dirname(F.col("topic"))})
    with settings(plans.sparkSession, {"spark.sql.sources.partitionOverwriteMode": "dynamic"}):
        named.repartition("book", "topic").write.mode("overwrite").partitionBy("book", "topic").text(path)


def write_raw(responses: DataFrame, path: str) -> None:
    """Raw responses (label, raw) as they came, a folder for each label; a label written again is replaced. No label is "none", no response an empty one."""
    told = responses.select(F.coalesce("label", F.lit("none")).alias("label"), F.coalesce("raw", F.lit("")).alias("raw"))
    with settings(responses.sparkSession, {"spark.sql.sources.partitionOverwriteMode": "dynamic"}):
        told.repartition("label").write.mode("overwrite").partitionBy("label").option("lineSep", "\x1e").text(path)


class Checkpoint:
    """Keys that are done, kept as a table; a run asks for what is left and notes what it finished."""

    def __init__(self, spark: SparkSession, path: str, key: str):
        self.spark, self.path, self.key = spark, path, key

    def done(self) -> DataFrame | None:
        fs, where = _files(self.spark, self.path)
        return self.spark.read.parquet(self.path).select(self.key).distinct() if fs.exists(where) else None

    def left(self, work: DataFrame) -> DataFrame:
        done = self.done()
        return work if done is None else work.join(done, self.key, "left_anti")

    def note(self, finished: DataFrame) -> None:
        """Keys that are noted twice count once."""
        finished.select(self.key).distinct().write.mode("append").parquet(self.path)
