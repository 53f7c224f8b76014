"""Prerequisite graphs: layers, weekly sequences, cycles."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chalkline.operators.lineage import Scratch


#: Prerequisites up to which a node is looked through.
FAN = 4
#: No path is as long; keeps the weights on cycles, which double each round, inside of a long.
FAR = 1 << 40


def layers(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(group, node, layer): longest way down from a node without prerequisites, inside each group.

    ``nodes`` is (group, node), ``edges`` (group, child, parent); edges that
    are given twice, or name no node, count as one and as none. Nodes on or
    behind a cycle never get a layer.

    An open node's layer is the largest of max(base, layer of a parent + w)
    over its edges. A round puts the layers found in the last one in place,
    then replaces each parent that has up to FAN prerequisites by those: ways
    double in length, and parallel ones become one by their maxima. So chains,
    trees and what joins again take rounds by the logarithm of their depth;
    where more prerequisites than FAN stay apart a round finds one layer at
    least. A round without a new layer leaves cycles and what is behind them.
    """
    scratch = Scratch(nodes.sparkSession, "layers")
    key = ["group", "node"]
    own = lambda c: nodes.select("group", F.col("node").alias(c))
    inside = edges.select("group", "child", "parent").join(own("child"), ["group", "child"], "left_semi").join(own("parent"), ["group", "parent"], "left_semi")
    first = inside.select("group", F.col("child").alias("node"), "parent", F.lit(0).cast("long").alias("base"), F.lit(1).cast("long").alias("w"))

    def merged(ways: DataFrame) -> DataFrame:
        """One row a node and parent, ``n`` parents of the node; ways without a parent are ended."""
        one = ways.groupBy(*key, "parent").agg(F.max("base").alias("base"), F.max("w").alias("w"))
        return one.withColumn("n", F.count("parent").over(W.partitionBy(*key)))

    ways = scratch.keep(merged(first), "ways")
    found = scratch.keep(nodes.select(*key).distinct().join(ways.select(*key), key, "left_anti").withColumn("layer", F.lit(0).cast("long")), "found")
    done = found
    while True:
        ended = F.col("layer").isNotNull()
        placed = ways.where("n > 0").join(found.withColumnRenamed("node", "parent"), ["group", "parent"], "left").select(
            *key, F.when(~ended, F.col("parent")).alias("parent"), F.when(ended, F.greatest("base", F.col("layer") + F.col("w"))).otherwise(F.col("base")).alias("base"), "w", "n"
        )
        through = placed.where(F.col("n") <= FAN).select("group", F.col("node").alias("parent"), F.col("parent").alias("_parent"), F.col("base").alias("_base"), F.col("w").alias("_w"))
        met = F.col("_base").isNotNull()
        further = placed.join(through, ["group", "parent"], "left").select(
            *key,
            F.when(met, F.col("_parent")).otherwise(F.col("parent")).alias("parent"),
            F.when(met, F.least(F.lit(FAR), F.greatest("base", F.col("_base") + F.col("w")))).otherwise(F.col("base")).alias("base"),
            F.when(met, F.least(F.lit(FAR), F.col("w") + F.col("_w"))).otherwise(F.col("w")).alias("w"),
        )
        before, ways = ways, scratch.keep(merged(further), "ways")
        scratch.drop(before)
        found = ways.where("n = 0").select(*key, F.col("base").alias("layer"))
        if found.isEmpty():
            scratch.drop(ways)
            return done.withColumn("layer", F.col("layer").cast("int"))
        found = scratch.keep(found, "found")
        done = done.unionByName(found)


def week_order(requested: list[str], edges: list[tuple[str, str]], known: set[str], days: int) -> list[str]:
    """A plan's concepts, prerequisites first.

    ``edges`` are (child, parent) in document order. Among concepts that are
    ready together those with more dependents come first, dependents outside
    the plan included; equal ones keep the order in which they became ready.
    Concepts on a cycle follow in the order asked for, unknown ones come last.
    """
    dependents: dict[str, list[str]] = {}
    needs: dict[str, list[str]] = {}
    for child, parent in edges:
        dependents.setdefault(parent, []).append(child)
        needs.setdefault(child, []).append(parent)
    own = [c for c in requested if c in known]
    waiting = dict.fromkeys(own, 0)
    for c in own:  # a concept asked for twice waits twice
        waiting[c] += sum(p in waiting for p in needs.get(c, ()))
    out: list[str] = []
    ready = [c for c in own if not waiting[c]]
    while ready:
        ready.sort(key=lambda c: -len(dependents.get(c, ())))
        following: list[str] = []
        for c in ready:
            out.append(c)
            for d in dependents.get(c, ()):
                if d in waiting:
                    waiting[d] -= 1
                    if not waiting[d]:
                        following.append(d)
        ready = following
    placed = set(out)
    out += [c for c in own if c not in placed]
    return (out + [c for c in requested if c not in known])[:days]


def sequence_week(plans: DataFrame, edges: DataFrame, topics: DataFrame, days: int = 5) -> DataFrame:
    """(plan, day, concept) for plans (plan, pos, concept), edges (pos, child, parent) and the names of all topics (concept).

    A topic without edges is known like any other. Each plan meets only the edges that touch its concepts; a plan has some
    tens of concepts, so it is one group.
    """
    touching = (
        plans.select("plan", "concept").distinct().join(
            edges.select(F.col("child").alias("concept"), "child", "parent", "pos").unionByName(edges.select(F.col("parent").alias("concept"), "child", "parent", "pos")), "concept"
        )
        .select("plan", "pos", "child", "parent").distinct()
    )
    known = topics.select("concept").distinct().withColumn("known", F.lit(True))
    asked = plans.join(known, "concept", "left").select(
        "plan", "pos", F.col("concept").alias("child"), F.lit(None).cast("string").alias("parent"), F.lit(True).alias("asked"), F.coalesce("known", F.lit(False)).alias("known")
    )
    rows = asked.unionByName(touching.withColumns({"asked": F.lit(False), "known": F.lit(False)}))

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["pos", "child", "parent"], kind="stable")
        own = group[~group["asked"]]
        pairs = list(zip(own["child"], own["parent"], strict=True))
        order = week_order(list(group[group["asked"]]["child"]), pairs, set(group[group["known"]]["child"]), days)
        return pd.DataFrame({"plan": group["plan"].iloc[0], "day": range(len(order)), "concept": order})

    return rows.groupBy("plan").applyInPandas(run, "plan long, day int, concept string")


def acyclic(edges: list[tuple[str, str]], order: list[str]) -> list[tuple[str, str]]:
    """Edges (child, parent) without those that close a cycle, looking from nodes in order and at parents in sorted order."""
    needs: dict[str, set[str]] = {}
    for child, parent in edges:
        needs.setdefault(child, set()).add(parent)
    state: dict[str, int] = {}
    kept: list[tuple[str, str]] = []
    for root in order:
        if state.get(root):
            continue
        state[root] = 1
        stack: list[tuple[str, Iterator[str]]] = [(root, iter(sorted(needs.get(root, ()))))]
        while stack:
            node, parents = stack[-1]
            parent = next(parents, None)
            if parent is None:
                state[node] = 2
                stack.pop()
            elif state.get(parent) == 1:
                continue  # on the way down: this edge closes a cycle
            else:
                kept.append((node, parent))
                if not state.get(parent):
                    state[parent] = 1
                    stack.append((parent, iter(sorted(needs.get(parent, ())))))
    return kept


def break_cycles(edges: DataFrame) -> DataFrame:
    """(group, child, parent) of (group, pos, child, parent) without cycles; pos is the child's place in the list of topics, a group one book's graph."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("pos", kind="stable")
        pairs = list(zip(group["child"], group["parent"], strict=True))
        kept = acyclic(pairs, list(dict.fromkeys(group["child"])))
        return pd.DataFrame({"group": group["group"].iloc[0], "child": [c for c, _ in kept], "parent": [p for _, p in kept]})

    return edges.groupBy("group").applyInPandas(run, "group string, child string, parent string")
