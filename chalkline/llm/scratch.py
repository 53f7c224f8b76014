"""What the training-data operators share: working tables, the end of a pipeline's stage, bounded batches, clashing names."""

from __future__ import annotations

import contextlib
import ctypes
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from chalkline.operators import lineage
from chalkline.operators.lineage import Scratch, settings, shared_dir

__all__ = ["Scratch", "bounded_batches", "memory_returned", "pipeline_stage", "set_apart", "settings", "shared_dir"]

#: Column metadata by which a stage's result, written and read again, tells whose tables it came from.
STAGE = "chalkline.stage"
_of_stages: dict[str, list[Scratch]] = {}


def pipeline_stage(docs: DataFrame, column: str, body: Callable[[], DataFrame]) -> DataFrame:
    """A stage of a pipeline, ``body``, whose input is ``docs``; its result is marked on ``column``.

    The working tables of the stage that docs came from go, once docs is read
    from elsewhere: it has been written then. Other runs' tables stay, and so do
    those of a last stage, which its result reads, until the session ends.
    """
    before = docs.schema[column].metadata.get(STAGE)
    tables = _of_stages.get(before, [])
    read = docs.inputFiles() if tables else []
    if tables and not any(f"/{t.path.rsplit('/', 1)[-1]}/" in f for t in tables for f in read):
        for t in _of_stages.pop(before):
            t.close()
    own, mark = [], uuid.uuid4().hex
    held = lineage.noted.set(own)
    try:
        out = body()
    finally:
        lineage.noted.reset(held)
    _of_stages[mark] = own
    return out.withMetadata(column, {**out.schema[column].metadata, STAGE: mark})


def bounded_batches(spark: SparkSession) -> None:
    """Bounds what one Arrow batch holds, so that very long texts can't fill a worker's memory.

    The bound stays set, since operators return frames whose Python step runs when they are read.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))


def memory_returned() -> None:
    """Gives memory that numpy and Arrow have freed back to the system, so that idle workers don't hold it."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def set_apart(keep: list[str], added: list[str]) -> list[str]:
    """Names under which the columns ``keep`` come out beside ``added``: a clashing one gets ``_in`` at its end, as often as it takes."""
    taken, out = {a.lower() for a in added}, []
    free = {k.lower() for k in keep}
    for k in keep:
        name = k
        while name.lower() in taken or (name != k and name.lower() in free):
            name += "_in"
        taken.add(name.lower())
        out.append(name)
    return out
