"""The mastery fold over a stream of quiz submissions.

A submission changes one (student, topic): the blended mastery and the running
sums. Submissions count in the order of their times within a micro-batch and
of batches otherwise; recomputing from the log gives the batch query's order.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState

OUTPUT = "student_id long, topic string, mastery double, attempts long, time_spent long, hints long"
STATE = "mastery double, attempts long, time_spent long, hints long"


def blend(previous: float | None, new: float) -> float:
    """0.7 new + 0.3 previous to two digits; the first score as it is."""
    return new if previous is None else math.floor((0.7 * new + 0.3 * previous) * 100 + 0.5) / 100


def _fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    mastery, attempts, spent, hints = state.get if state.exists else (None, 0, 0, 0)
    rows = pd.concat(list(batches)).sort_values(["submitted_at", "event_id"])
    for r in rows.itertuples(index=False):
        mastery = blend(mastery, r.mastery)
        attempts, spent, hints = attempts + r.attempts, spent + r.time_spent, hints + r.hints
    state.update((float(mastery), int(attempts), int(spent), int(hints)))
    yield pd.DataFrame({"student_id": [key[0]], "topic": [key[1]], "mastery": [mastery], "attempts": [attempts], "time_spent": [spent], "hints": [hints]})


def running_mastery(scored: DataFrame) -> DataFrame:
    """A row for each (student, topic) that a micro-batch changed, with its values after it."""
    columns = ["student_id", "topic", "submitted_at", "event_id", "mastery", "attempts", "time_spent", "hints"]
    return scored.select(*columns).groupBy("student_id", "topic").applyInPandasWithState(_fold, OUTPUT, STATE, "update", "NoTimeout")
