"""Working tables in the folder that the cluster shares.

Spark's ``spark.checkpoint.dir`` names it; only where that is unset, on one
machine, a folder of our own is made. A table written here cuts lineage like a
checkpoint: a lost executor re-reads files instead of recomputing.
"""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Iterator
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

#: Settings while a working table is written. Tables cut lineage, so a query's shuffle files are of no use once it has ended;
#: ids and offsets in files are a fraction of their size in memory, and the size check before a broadcast must see the latter.
WRITING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.sources.fileCompressionFactor": "10"}

#: Bytes that a task gathers before it writes a row group.
ROW_GROUP = str(16 << 20)

_own: dict[str, str] = {}
#: Where scratches are noted that are made in this context, if anywhere.
noted: ContextVar[list[Scratch] | None] = ContextVar("noted", default=None)


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, or one of our own where it is unset and the driver's machine is the only one."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if spark.sparkContext.master.split("[")[0] != "local":
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = "file://" + tempfile.mkdtemp(prefix="chalkline-")
        atexit.register(_remove, spark, _own[app])
    return _own[app]


def _remove(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):  # the JVM may be gone at exit
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


@contextlib.contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Session settings that hold inside the block only."""
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


class Scratch:
    """A folder of tables under the shared one.

    Single tables go with drop() and free(), the folder with close() or at the
    end of the session.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self._made = 0
        self._kept: list[tuple[DataFrame, str]] = []
        atexit.register(_remove, spark, self.path)
        if (notes := noted.get()) is not None:
            notes.append(self)

    def where(self, name: str) -> str:
        self._made += 1
        return f"{self.path}/{self._made:03d}-{name}"

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """Writes df as Parquet and reads it again; the result carries no lineage."""
        path = self.where(name)
        with settings(self.spark, WRITING):
            df.write.option("compression", "zstd").option("parquet.block.size", ROW_GROUP).parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self._kept.append((out, path))
        return out

    def stand_in(self, table: DataFrame, view: DataFrame) -> DataFrame:
        """``view``, which reads ``table`` and goes by the same rules from now on."""
        self._kept += [(view, path) for x, path in self._kept if x is table]
        return view

    def drop(self, *tables: DataFrame) -> None:
        """Removes the tables behind frames that keep() returned."""
        gone = {path for x, path in self._kept if any(x is t for t in tables)}
        for path in gone:
            _remove(self.spark, path)
        self._kept = [x for x in self._kept if x[1] not in gone]

    def free(self, *still: DataFrame) -> None:
        """Removes all tables but those that are still read."""
        used = {path for x, path in self._kept if any(x is s for s in still)}
        self.drop(*[x for x, path in self._kept if path not in used])

    def close(self) -> None:
        _remove(self.spark, self.path)
        self._kept = []
