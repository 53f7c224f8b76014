"""References between tables, and what a delete does along them."""

from __future__ import annotations

from collections import defaultdict
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chalkline.operators.lineage import Scratch

CASCADE, SET_NULL = "CASCADE", "SET NULL"


class Reference(NamedTuple):
    """``column`` of ``table`` names rows of ``parent`` by its key; ``rule`` says what becomes of it when they are deleted."""

    table: str
    column: str
    parent: str
    rule: str


def delete_with_references(tables: dict[str, DataFrame], keys: dict[str, str], references: list[Reference], root: str, gone: DataFrame) -> dict[str, DataFrame]:
    """All tables after the rows of ``root`` whose key stands in ``gone`` are deleted.

    Rows that refer to a deleted one by CASCADE are deleted, along all paths and
    through references of a table to itself; those that refer by SET NULL lose
    the reference, unless they are deleted along another path. ``keys`` has the
    key column of each table. Keys in ``gone`` that no row has, and null ones,
    delete nothing; null references refer to nothing.

    Deleted keys are found in rounds, each over the keys that the one before
    found: as many as the longest chain of references that matters.
    """
    unknown = [r for r in references if r.table not in tables or r.parent not in tables or r.rule not in (CASCADE, SET_NULL)]
    if unknown or root not in tables:
        raise ValueError(f"references without a table or a rule: {unknown or root}")
    scratch = Scratch(gone.sparkSession, "deleted")
    children = defaultdict(list)
    for r in references:
        if r.rule == CASCADE:
            children[r.parent].append(r)
    first = tables[root].select(F.col(keys[root]).alias("key")).join(gone.select(F.col(gone.columns[0]).alias("key")), "key", "left_semi").distinct()
    dead = {root: scratch.keep(first, root)}
    fresh = dict(dead)
    while fresh:
        found: dict[str, list[DataFrame]] = defaultdict(list)
        for parent, new in fresh.items():
            for r in children[parent]:
                rows = tables[r.table].select(F.col(keys[r.table]).alias("key"), F.col(r.column).alias("_ref"))
                found[r.table].append(rows.join(new.select(F.col("key").alias("_ref")), "_ref", "left_semi").select("key"))
        fresh = {}
        for table, parts in found.items():
            whole = parts[0]
            for part in parts[1:]:
                whole = whole.unionByName(part)
            whole = whole.where("key IS NOT NULL").distinct()
            if table in dead:
                whole = whole.join(dead[table], "key", "left_anti")
            new = scratch.keep(whole, table)
            if not new.isEmpty():
                fresh[table] = new
                dead[table] = dead[table].unionByName(new) if table in dead else new
    out = {}
    for name, rows in tables.items():
        left = rows
        if name in dead:
            left = left.join(dead[name].select(F.col("key").alias(keys[name])), keys[name], "left_anti")
        for r in references:
            if r.table == name and r.rule == SET_NULL and r.parent in dead:
                lost = dead[r.parent].select(F.col("key").alias("_lost"), F.lit(True).alias("_is_lost"))
                left = left.join(lost, F.col(r.column) == F.col("_lost"), "left").withColumn(r.column, F.when(F.col("_is_lost").isNull(), F.col(r.column))).drop("_lost", "_is_lost")
        out[name] = left.select(*rows.columns)
    return out
