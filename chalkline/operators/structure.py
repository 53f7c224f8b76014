"""Order, numbering, ranges and islands over curriculum entities.

``doc_pos`` is the place of an entity in its document and the last tie-break of
every window here.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def numbered(df: DataFrame, group: list[str], order: list[Column], name: str, start: int = 1) -> DataFrame:
    """Adds the place in the group, counted from ``start``."""
    return df.withColumn(name, F.row_number().over(W.partitionBy(*group).orderBy(*order)) + (start - 1))


def islands(df: DataFrame, group: list[str], order: list[Column], same: str, name: str) -> DataFrame:
    """Adds the number of the run of equal ``same`` values that a row is in."""
    w = W.partitionBy(*group).orderBy(*order)
    fresh = (~F.col(same).eqNullSafe(F.lag(same).over(w)) | (F.row_number().over(w) == 1)).cast("int")
    return df.withColumn("_fresh", fresh).withColumn(name, F.sum("_fresh").over(w.rowsBetween(W.unboundedPreceding, 0))).drop("_fresh")


def clamp_range(low: Column, high: Column, parent_low: Column, parent_high: Column) -> tuple[Column, Column, Column]:
    """(start, end, violated) of a range put inside its parent's; a parent end of 9999 is open."""
    shut = parent_high < 9999
    violated = shut & (low > parent_high)
    start = F.when(violated | (low < parent_low), parent_low).otherwise(low)
    end = F.when(shut & (high > parent_high), parent_high).otherwise(high)
    return start, F.greatest(start, end), violated


def pages_of(df: DataFrame, low: str, high: str, page: str = "page") -> DataFrame:
    """A row for each page of a range; inverted ranges have none. Turns a range join into an equi-join."""
    return df.where(F.col(low) <= F.col(high)).withColumn(page, F.explode(F.sequence(F.col(low), F.col(high))))


def fold_dedup(df: DataFrame, group: list[str], order: list[str], first_key: str, second_key: str, id_col: str, carry: list[str] | None = None, why: bool = False) -> DataFrame:
    """Ids that stay, with the group columns ``carry``, when rows come in order and one goes if a key of it belongs to a row that stayed.

    A row that goes doesn't register its other key, so two passes of distinct
    would lose rows; it is one pass over a group's rows with two sets. With
    ``why`` all rows come out, with ``gone_by`` (first, second or null).
    """
    rows = df.select(*group, *[F.col(o).alias(f"_o{i}") for i, o in enumerate(order)], F.col(first_key).alias("_k1"), F.col(second_key).alias("_k2"), F.col(id_col).alias("_id"))

    def run(own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values([f"_o{i}" for i in range(len(order))], kind="stable")
        first: set = set()
        second: set = set()
        gone = []
        for a, b in zip(own["_k1"], own["_k2"], strict=True):
            by = "first" if a in first else "second" if b in second else None
            if by is None:
                first.add(a)
                second.add(b)
            gone.append(by)
        return own[[*group, "_id"]].assign(gone_by=pd.Series(gone, index=own.index, dtype=object))

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*group, "_id").schema.fields)
    found = rows.groupBy(*group).applyInPandas(run, f"{kinds}, gone_by string")
    found = found if why else found.where("gone_by IS NULL")
    return found.select(*(carry or []), F.col("_id").alias(id_col), *(["gone_by"] if why else []))
