"""A table on files that takes updates, upserts and deletes by key, as a whole or not at all.

Rows lie in buckets of their key, a folder for each bucket and version. A merge
reads and rewrites only the buckets that its changes touch, into folders of its
own, and then publishes a manifest, which names the folder of every bucket. The
manifest is put in place by one rename that fails if its version is there: until
then readers see the table as it was, afterwards as it is. A driver that is lost
in between leaves folders that nobody names; the merge is run again. A merge that
carries a batch number is done once, however often it is run.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chalkline.operators.keyed import patched, upsert
from chalkline.operators.lineage import Scratch

BUCKET = "_bucket"
Action = Callable[[DataFrame, DataFrame], DataFrame]


class Conflict(RuntimeError):
    """Another writer published the version that this one was about to."""


@dataclass
class Manifest:
    version: int
    schema: str
    keys: list[str]
    bucket_by: list[str]
    buckets: int
    #: Bucket to folder, under the table's own.
    folders: dict[str, str] = field(default_factory=dict)
    #: Writer to the number of its last batch.
    batches: dict[str, int] = field(default_factory=dict)


@dataclass
class Staged:
    """What a merge has written and not yet published."""

    manifest: Manifest
    rewritten: int
    bytes: int


class KeyedTable:
    """``keys`` tell rows apart; ``bucket_by``, some of them, say where a row lies."""

    def __init__(self, spark: SparkSession, path: str, keys: list[str], bucket_by: list[str] | None = None, buckets: int = 64):
        self.spark, self.path, self.keys, self.bucket_by, self.buckets = spark, path.rstrip("/"), keys, bucket_by or keys, buckets
        if not set(self.bucket_by) <= set(keys):
            raise ValueError("a bucket goes by columns of the key")

    # --- manifests

    def _at(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.path, *parts]))

    def _files(self):
        return self._at().getFileSystem(self.spark._jsc.hadoopConfiguration())

    def latest(self) -> Manifest | None:
        """The manifest in force, if the table has one."""
        folder, fs = self._at("manifests"), self._files()
        if not fs.exists(folder):
            return None
        versions = [f.getPath().getName() for f in fs.listStatus(folder)]
        versions = sorted(v for v in versions if v.endswith(".json"))
        if not versions:
            return None
        stream = fs.open(self._at("manifests", versions[-1]))
        try:
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return Manifest(**json.loads(text))

    def publish(self, staged: Staged) -> None:
        """Makes what is staged the table; raises Conflict if its version exists."""
        jvm, new = self.spark._jvm, staged.manifest
        draft, final = self._at("manifests", f".draft-{uuid.uuid4().hex}"), self._at("manifests", f"{new.version:09d}.json")
        out = self._files().create(draft, False)
        try:
            out.write(bytearray(json.dumps(new.__dict__).encode()))
        finally:
            out.close()
        place = jvm.org.apache.hadoop.fs.FileContext.getFileContext(final.toUri(), self.spark._jsc.hadoopConfiguration())
        none = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            place.rename(draft, final, none)
        except Exception as e:
            self._files().delete(draft, False)
            if self._files().exists(final):
                raise Conflict(f"version {new.version} of {self.path} is there already") from e
            raise

    # --- reading

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.bucket_by), F.lit(self.buckets)).cast("int")

    def _frame(self, manifest: Manifest, folders: list[str]) -> DataFrame:
        schema = T.StructType.fromJson(json.loads(manifest.schema))
        if not folders:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/{f}" for f in folders])

    def read(self, only: DataFrame | None = None) -> DataFrame:
        """The table; with ``only`` its rows whose ``bucket_by`` values stand there, read from their buckets."""
        now = self.latest()
        if now is None:
            raise FileNotFoundError(self.path)
        if only is None:
            return self._frame(now, list(now.folders.values()))
        named = only.select(*self.bucket_by).distinct()
        touched = {str(r[0]) for r in named.select(self.bucket()).distinct().collect()}  # buckets at most
        rows = self._frame(now, [f for b, f in now.folders.items() if b in touched])
        return rows.join(named, self.bucket_by, "left_semi")

    def done(self, writer: str) -> int:
        """Number of the writer's last batch, -1 before the first."""
        now = self.latest()
        return -1 if now is None else now.batches.get(writer, -1)

    # --- writing

    def stage(self, changes: DataFrame, action: Action, writer: str | None = None, batch: int | None = None) -> Staged | None:
        """Writes the buckets that ``changes`` touch, as ``action(old, changes)`` has them; None if the batch is done.

        The first stage of a table takes the columns of ``changes``.
        """
        now = self.latest() or Manifest(-1, json.dumps(changes.schema.jsonValue()), self.keys, self.bucket_by, self.buckets)
        if (now.keys, now.bucket_by, now.buckets) != (self.keys, self.bucket_by, self.buckets):
            raise ValueError(f"{self.path} has other keys or buckets")
        if writer is not None and batch is not None and now.batches.get(writer, -1) >= batch:
            return None
        scratch = Scratch(self.spark, "changes")
        changes = scratch.keep(changes, "changes")  # read twice, and the same both times
        touched = [str(r[0]) for r in changes.select(self.bucket()).distinct().collect()]
        schema = T.StructType.fromJson(json.loads(now.schema))
        old = self._frame(now, [now.folders[b] for b in touched if b in now.folders])
        rows = action(old, changes).select(*[F.col(f.name).cast(f.dataType) for f in schema]).withColumn(BUCKET, self.bucket())
        new = f"data/{now.version + 1:09d}-{uuid.uuid4().hex}"
        n = max(1, min(len(touched), int(self.spark.conf.get("spark.sql.shuffle.partitions"))))
        rows.repartition(n, BUCKET).write.partitionBy(BUCKET).parquet(f"{self.path}/{new}")
        fs, size = self._files(), 0
        folders = {b: f for b, f in now.folders.items() if b not in touched}
        for status in fs.listStatus(self._at(new)):
            name = status.getPath().getName()
            if name.startswith(f"{BUCKET}="):
                folders[name.split("=", 1)[1]] = f"{new}/{name}"
                size += fs.getContentSummary(status.getPath()).getLength()
        scratch.close()
        batches = dict(now.batches)
        if writer is not None and batch is not None:
            batches[writer] = batch
        return Staged(Manifest(now.version + 1, now.schema, self.keys, self.bucket_by, self.buckets, folders, batches), len(touched), size)

    def merge(self, changes: DataFrame, action: Action, writer: str | None = None, batch: int | None = None) -> Staged | None:
        """stage() and publish()."""
        if (staged := self.stage(changes, action, writer, batch)) is not None:
            self.publish(staged)
        return staged

    def upsert(self, rows: DataFrame, order: list[Column] | None = None, **how) -> Staged | None:
        """Rows replace those of their key; of several of one key the last in the given order counts."""
        return self.merge(rows, lambda old, new: upsert(old, new, self.keys, order), **how)

    def patch(self, rows: DataFrame, allowed: list[str], stamp: Column | None = None, **how) -> Staged | None:
        """Values that aren't null go to the allowed columns of rows that are there; one row for each of a table with one key column."""
        (key,) = self.keys
        return self.merge(rows, lambda old, new: patched(old, new, key, allowed, stamp), **how)

    def delete(self, gone: DataFrame, **how) -> Staged | None:
        """Rows of these keys go."""
        return self.merge(gone.select(*self.keys), lambda old, new: old.join(new.distinct(), self.keys, "left_anti"), **how)

    def vacuum(self, keep: int = 1) -> list[str]:
        """Removes data that none of the last ``keep`` manifests names, and the manifests before them; returns the folders."""
        fs = self._files()
        if self.latest() is None:
            return []
        names = sorted(f.getPath().getName() for f in fs.listStatus(self._at("manifests")) if f.getPath().getName().endswith(".json"))
        named: set[str] = set()
        for name in names[-keep:]:
            stream = fs.open(self._at("manifests", name))
            named |= set(json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))["folders"].values())
            stream.close()
        for name in names[:-keep]:
            fs.delete(self._at("manifests", name), False)
        gone = []
        for version in fs.listStatus(self._at("data")):
            for part in fs.listStatus(version.getPath()):
                folder = f"data/{version.getPath().getName()}/{part.getPath().getName()}"
                if part.isDirectory() and folder not in named:
                    fs.delete(part.getPath(), True)
                    gone.append(folder)
        return gone
