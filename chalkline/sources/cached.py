"""Book documents from a folder, kept in a table that is refreshed for the files that changed."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chalkline.operators.keyed_table import KeyedTable
from chalkline.operators.lineage import Scratch
from chalkline.sources.documents import first_source

#: What says that a file is the one that was read.
STAMP = ["modified", "length"]


class Refreshed(NamedTuple):
    read: int
    kept: int
    removed: int


class CachedBooks:
    """(book, document, modified, length) of the files ``*/name`` under ``folder``; a book is named by its folder.

    refresh() lists the files, which reads none, and compares their times and
    sizes with those of the table: it reads what is new or changed and removes
    what is gone, in one merge of the buckets that this touches.
    """

    def __init__(self, spark: SparkSession, folder: str, cache: str, name: str = "ontology.json", buckets: int = 16):
        self.spark, self.pattern = spark, f"{folder.rstrip('/')}/*/{name}"
        self.table = KeyedTable(spark, cache, ["book"], buckets=buckets)

    def _listed(self) -> DataFrame:
        where = self.spark._jvm.org.apache.hadoop.fs.Path(self.pattern)
        if not where.getFileSystem(self.spark._jsc.hadoopConfiguration()).globStatus(where):
            return self.spark.createDataFrame([], "path string, book string, modified timestamp, length long")
        files = self.spark.read.format("binaryFile").load(self.pattern)  # without its content a file isn't opened
        return files.select("path", F.element_at(F.split("path", "/"), -2).alias("book"), F.col("modificationTime").alias("modified"), "length")

    def refresh(self) -> Refreshed:
        scratch = Scratch(self.spark, "listed")
        files = scratch.keep(self._listed(), "files")
        empty = self.spark.createDataFrame([], "book string, document string, modified timestamp, length long")
        known = empty if self.table.latest() is None else self.table.read()
        fresh = files.join(known.select("book", *STAMP), ["book", *STAMP], "left_anti")
        paths = [r[0] for r in fresh.select("path").collect()]  # as Spark's readers list files: on the driver
        gone = scratch.keep(known.select("book").join(files, "book", "left_anti"), "gone")
        removed = gone.count()
        if paths or removed or self.table.latest() is None:
            read = self.spark.read.format("binaryFile").load(paths) if paths else None
            told = empty if read is None else read.select(
                F.element_at(F.split("path", "/"), -2).alias("book"), F.decode("content", "UTF-8").alias("document"), F.col("modificationTime").alias("modified"), "length"
            )
            changes = told.unionByName(gone.select("book", *[F.lit(None).cast(t).alias(c) for c, t in (("document", "string"), ("modified", "timestamp"), ("length", "long"))]))
            self.table.merge(changes, lambda old, new: old.join(new.select("book"), "book", "left_anti").unionByName(new.where("modified IS NOT NULL")))
        kept = files.count() - len(paths)
        scratch.close()
        return Refreshed(len(paths), kept, removed)

    def read(self) -> DataFrame:
        """(book, document) as of now."""
        self.refresh()
        return self.table.read().select("book", "document")

    def lookup(self, stored: DataFrame) -> DataFrame:
        """(book, document, priority): books of ``stored`` as they are there, the others from the files."""
        return first_source([stored.select("book", "document"), self.read()], "book")
