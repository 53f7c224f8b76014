"""Mastery kept up to date by batches of submissions, each of which counts once.

Two keyed tables: the log of submissions and the state of every (student,
topic). A batch goes to the log first, then the keys that it touches are brought
up to date and their states are published with the batch's number. Whatever is
lost in between, the same batch again ends at the same tables: what is published
is skipped, what isn't is made anew. A submission that comes late is folded in
its place: its key, and no other, is folded again from the log.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from chalkline.functions.numeric import round_half_up
from chalkline.operators.folds import ordered_fold
from chalkline.operators.keyed_table import KeyedTable
from chalkline.operators.lineage import Scratch

KEY = ["student_id", "topic"]
SUMS = ["attempts", "time_spent", "hints"]
EVENT = [*KEY, "event_id", "submitted_at", "mastery", *SUMS]
WRITER = "mastery"


def _blend(previous, event):
    return F.coalesce(round_half_up(0.7 * event["mastery"] + 0.3 * previous), event["mastery"])


def _folded(events: DataFrame, old: DataFrame | None) -> DataFrame:
    """States after ``events`` in their order, from the states ``old`` or from nothing."""
    moment = F.struct("submitted_at", "event_id")
    told = events.groupBy(*KEY).agg(*[F.sum(c).alias(c) for c in SUMS], F.max(moment).alias("last"))
    if old is None:
        fold = ordered_fold(events, KEY, ["submitted_at", "event_id"], ["mastery"], F.lit(None).cast("double"), _blend, "mastery")
        return told.join(fold, KEY)
    began = old.select(*KEY, F.col("mastery").alias("_from"), *[F.col(c).alias(f"_{c}") for c in (*SUMS, "n_events")], F.lit(True).alias("_has"))
    known = events.join(began.select(*KEY, "_from", "_has"), KEY, "left")
    known = known.withColumns({"_has": F.coalesce("_has", F.lit(False)), "_from": F.coalesce("_from", F.lit(0.0))})
    fold = ordered_fold(known, [*KEY, "_from", "_has"], ["submitted_at", "event_id"], ["mastery"], F.when(F.col("_has"), F.col("_from")), _blend, "mastery")
    grown = told.join(fold.drop("_from", "_has"), KEY).join(began.drop("_from", "_has"), KEY, "left")
    return grown.withColumns({c: F.col(c) + F.coalesce(f"_{c}", F.lit(0)) for c in (*SUMS, "n_events")})


class MasteryStore:
    """``log`` and ``state`` under one folder, both in ``buckets`` by student and topic."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        self.spark = spark
        self.log = KeyedTable(spark, f"{path}/log", [*KEY, "event_id"], KEY, buckets)
        self.state = KeyedTable(spark, f"{path}/state", KEY, None, buckets)

    def record(self, events: DataFrame, batch: int) -> None:
        """The batch's submissions in the log; one that the log has already is the same submission."""
        self.log.upsert(events.select(*EVENT).dropDuplicates([*KEY, "event_id"]), writer=WRITER, batch=batch)

    def absorb(self, events: DataFrame, batch: int) -> None:
        """One batch, numbered without gaps by its stream. Null students, topics and ids are not submissions."""
        if self.state.done(WRITER) >= batch:
            return
        scratch = Scratch(self.spark, "batch")
        events = scratch.keep(events.select(*EVENT).where("student_id IS NOT NULL AND topic IS NOT NULL AND event_id IS NOT NULL").dropDuplicates([*KEY, "event_id"]), "events")
        self.record(events, batch)
        if self.state.latest() is None:
            self.state.merge(self._rows(_folded(events, None)), lambda old, new: new, WRITER, batch)
        else:
            old = scratch.keep(self.state.read(events), "old")
            first = events.groupBy(*KEY).agg(F.min(F.struct("submitted_at", "event_id")).alias("first"))
            reached = old.select(*KEY, F.struct("last_at", "last_event").alias("reached"))
            marked = first.join(reached, KEY, "left").select(*KEY, F.coalesce(F.col("first") <= F.col("reached"), F.lit(False)).alias("late"))
            marked = scratch.keep(marked, "marked")
            late = marked.where("late").select(*KEY)
            onward = self._rows(_folded(events.join(marked.where("NOT late").select(*KEY), KEY, "left_semi"), old))
            again = self._rows(_folded(self.log.read(late), None))
            self.state.upsert(onward.unionByName(again), writer=WRITER, batch=batch)
        scratch.close()

    @staticmethod
    def _rows(folded: DataFrame) -> DataFrame:
        return folded.select(*KEY, "mastery", F.col("n_events").cast("int").alias("n_events"), *[F.col(c).cast("long").alias(c) for c in SUMS], F.col("last.submitted_at").alias("last_at"), F.col("last.event_id").alias("last_event"))

    def writer(self, scored: DataFrame) -> DataStreamWriter:
        """A stream of scored submissions into the store; batches carry the stream's own numbers."""
        return scored.writeStream.foreachBatch(lambda df, batch: self.absorb(df, batch))
