"""Keyed writes over immutable tables: upsert, cascade, merge."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def upsert(old: DataFrame, new: DataFrame, keys: list[str], order: list[Column] | None = None) -> DataFrame:
    """The last row of each key of ``new`` in the given order (without one its keys are single), and the rows of ``old`` whose keys it doesn't have."""
    if order is None:
        return new.select(*old.columns).unionByName(old.join(new.select(*keys), keys, "left_anti"))
    last = F.row_number().over(W.partitionBy(*keys).orderBy(*[o.desc() for o in order]))
    written = new.withColumn("_n", last).where("_n = 1").select(*old.columns)
    return written.unionByName(old.join(new.select(*keys), keys, "left_anti"))


def set_null(gone: DataFrame, key: str, table: DataFrame, parent: str) -> DataFrame:
    """``table`` with its reference ``parent`` emptied where that row of ``gone[key]`` is deleted; the row itself stays."""
    dead = gone.select(F.col(key).alias(parent), F.lit(True).alias("_dead")).distinct()
    emptied = table.join(dead, parent, "left").withColumn(parent, F.when(F.col("_dead").isNull(), F.col(parent)))
    return emptied.select(*table.columns)


def patched(base: DataFrame, patch: DataFrame, key: str, allowed: list[str], stamp: Column | None = None) -> DataFrame:
    """``base`` with the allowed columns of ``patch`` that aren't null; other columns of the patch are ignored.

    ``stamp`` goes to ``updated_at`` of rows that the patch changes. One patch
    row a key; keys that base doesn't have add nothing.
    """
    taken = [c for c in allowed if c in patch.columns and c in base.columns]
    given = patch.select(key, *[F.col(c).alias(f"_new_{c}") for c in taken])
    changes = F.lit(False)
    for c in taken:
        changes = changes | F.col(f"_new_{c}").isNotNull()
    both = base.join(given, key, "left").withColumn("_changed", F.coalesce(changes, F.lit(False)))
    out = both.withColumns({c: F.coalesce(f"_new_{c}", c) for c in taken})
    if stamp is not None:
        out = out.withColumn("updated_at", F.when(F.col("_changed"), stamp).otherwise(F.col("updated_at")))
    return out.select(*base.columns)


def cascade_delete(gone: DataFrame, key: str, levels: list[tuple[DataFrame, str, str]]) -> list[DataFrame]:
    """What is left of each level (table, parent column, own column) once the parents ``gone[key]`` are deleted."""
    left = []
    for table, parent, own in levels:
        dead = gone.select(F.col(key).alias(parent))
        left.append(table.join(dead, parent, "left_anti"))
        gone, key = table.join(dead, parent, "left_semi").select(own).distinct(), own
    return left


def keyed_union(parts: list[DataFrame], key: Column, order: Column) -> DataFrame:
    """Union of the parts in their order; of rows with one key the first stays, rows with an empty key go."""
    whole = None
    for i, part in enumerate(parts):
        one = part.withColumn("_part", F.lit(i))
        whole = one if whole is None else whole.unionByName(one)
    first = F.row_number().over(W.partitionBy(key).orderBy("_part", order))
    return whole.where(key.isNotNull() & (key != "")).withColumn("_n", first).where("_n = 1").drop("_n", "_part")
