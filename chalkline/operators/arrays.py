"""Arrays of ids as references: each becomes the array of what it names, in its order."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def resolve_arrays(parents: DataFrame, keys: list[str], arrays: dict[str, DataFrame], fields: list[str], within: list[str] | None = None) -> DataFrame:
    """``parents`` whose arrays of ids hold structs of ``fields`` instead, in the order of the ids.

    ``arrays`` has for each array column the frame of what its ids name, with
    ``within`` (columns of both sides in which ids are alone), ``id``,
    ``doc_pos`` and the fields. An id that names nothing is left out, one that
    stands twice is there twice; of rows of one id the last by doc_pos counts. A
    null array is empty, parents are told apart by ``keys``.

    All arrays go together: references are shuffled once by what they name, with
    the kind of array as part of it, and what they found once to its parent. A
    thing that very many name is a skewed join that Spark splits.
    """
    within = within or []
    refs, named = [], []
    for kind, children in arrays.items():
        place = F.posexplode(F.col(kind)).alias("_pos", "_id")
        refs.append(parents.select(*keys, *[c for c in within if c not in keys], F.lit(kind).alias("_kind"), place))
        named.append(children.select(*within, F.lit(kind).alias("_kind"), F.col("id").alias("_id"), "doc_pos", F.struct(*fields).alias("_what")))
    union = lambda frames: reduce(DataFrame.unionByName, frames)
    last = union(named).groupBy(*within, "_kind", "_id").agg(F.max_by("_what", "doc_pos").alias("_what"))
    found = union(refs).join(last, [*within, "_kind", "_id"])
    item = F.struct("_pos", "_what")
    lists = found.groupBy(*keys).agg(*[F.sort_array(F.collect_list(F.when(F.col("_kind") == kind, item))).alias(f"_{kind}") for kind in arrays])
    nothing = F.array().cast(last.select(F.array("_what")).schema[0].dataType)
    out = parents.join(lists, keys, "left")
    out = out.withColumns({kind: F.coalesce(F.transform(f"_{kind}", lambda x: x["_what"]), nothing) for kind in arrays})
    return out.select(*parents.columns)
