"""Exact top-k inner products by Fagin's threshold algorithm.

Candidates are dealt into cells of bounded size. A cell turns its vectors into
an orthogonal basis, ordered by variance, and sorts them once along each
dimension that holds much of it; what the other dimensions hold of a vector
counts by its length, in a list of its own. A query descends all lists
together, from the end that its component favours. What it meets is scored in
full, on the given integers, and it stops when the product of the query with
the values at the current depth (for the rest: of the lengths), a bound on all
vectors not met, is under the kth score. A query comes to its second cell with
the kth score of the first. The cells' lists meet in one ranking.

Where variance is the same in all directions no bound stops early, whatever the
basis: the lists' ends say little about a product then, and a query meets all.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chalkline.llm.scratch import Scratch

#: Vectors and queries that meet in one cell.
CELL, QUERY_BLOCK = 8192, 2048
#: Depth of the first descent, and how many times as deep a further one goes at most.
FIRST_DEPTH, DEEPER = 32, 8
#: Vectors whose variance gives the basis, which changes the work and never the result; dimensions for which one is sought.
BASIS_SAMPLE, BASIS_DIMS = 4096, 2048
#: Share of the variance that the sorted dimensions hold.
HEAD = 0.999


def basis_of(vectors: np.ndarray) -> np.ndarray:
    """An orthogonal basis (columns) of the vectors' space, the directions of most variance first."""
    values, directions = np.linalg.eigh(vectors.T @ vectors)
    return directions[:, np.argsort(-values, kind="stable")]


class SortedLists:
    """Vectors of one cell with an ascending order along each dimension of a basis."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, basis: np.ndarray | None = None):
        order = np.argsort(ids, kind="stable")
        self.ids, whole = ids[order], vectors[order]
        self.limit = int(np.abs(whole).max(initial=0))
        self.whole = whole
        self.vectors = whole.astype(np.float64)  # exact below 2^53; larger products take Python's integers
        self.basis = np.eye(whole.shape[1]) if basis is None else basis
        turned = self.vectors @ self.basis
        energy = np.cumsum((turned**2).sum(axis=0))
        self.head = whole.shape[1] if not len(energy) or energy[-1] == 0 else int(np.searchsorted(energy, HEAD * energy[-1])) + 1
        rest = np.sqrt((turned[:, self.head :] ** 2).sum(axis=1))
        self.values = np.column_stack([turned[:, : self.head], rest])
        self.order = np.argsort(self.values, axis=0, kind="stable")
        self.sorted = np.take_along_axis(self.values, self.order, axis=0)
        self.longest = float(np.sqrt((turned**2).sum(axis=1)).max(initial=0))
        self.met = 0  # rows met by all queries so far

    def top(self, own: int, query: np.ndarray, k: int, floor: float = -np.inf) -> tuple[np.ndarray, np.ndarray]:
        """(ids, scores) of the k best for a query, ties to the smaller id; ``own`` takes no part, nor need what is under ``floor``."""
        n, dims = self.whole.shape
        exact = self.limit * int(np.abs(query).max(initial=0)) * max(1, dims) < 1 << 53
        vectors = self.vectors if exact else self.whole.astype(object)
        turned = query.astype(np.float64) @ self.basis
        weights = np.append(turned[: self.head], np.sqrt((turned[self.head :] ** 2).sum()))
        up, down = np.flatnonzero(weights > 0), np.flatnonzero(weights < 0)
        slack = 1e-9 * (1 + self.longest * float(np.sqrt((turned**2).sum())))  # of the turned values' rounding
        query = query.astype(np.float64) if exact else query.astype(object)
        bound = lambda depth: float((weights[up] * self.sorted[n - depth, up]).sum() + (weights[down] * self.sorted[depth - 1, down]).sum()) + slack
        skipped = self.ids == own
        met = skipped.copy()
        rows, scores, depth = np.empty(0, np.int64), np.empty(0, vectors.dtype), 0
        while depth < n:
            kth = max(floor, float(scores.min()) if len(rows) >= k else -np.inf)
            if depth and bound(depth) < kth:  # at equality an unmet vector may have a smaller id
                break
            far = min(n, max(FIRST_DEPTH, DEEPER * depth))
            if depth and bound(far) < kth:  # the least depth that stops
                low, high = depth, far
                while low < high:
                    middle = (low + high) // 2
                    low, high = (low, middle) if bound(middle) < kth else (middle + 1, high)
                far = low
            fresh = np.zeros(n, bool)
            if far == n:
                fresh[:] = True
            else:
                fresh[self.order[n - far : n - depth, up]] = True
                fresh[self.order[depth:far, down]] = True
            fresh &= ~met
            met |= fresh
            new = np.flatnonzero(fresh)
            rows, scores = np.concatenate([rows, new]), np.concatenate([scores, vectors[new] @ query])
            if len(rows) > k:
                least = np.sort(scores)[-k]
                best = scores >= least
                rows, scores = rows[best], scores[best]
                best = np.lexsort((rows, -scores))[:k]  # rows ascend with ids
                rows, scores = rows[best], scores[best]
            depth = far
        self.met += int((met & ~skipped).sum())
        return self.ids[rows], scores


def quantised(vector: Column) -> Column:
    """floor(1024 x) of each component, null for vectors that are null or hold a null or non-finite component."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when(vector.isNotNull() & finite, F.transform(vector, lambda x: F.floor(x.cast("double") * 1024).cast("long")))


def exact_top_k(df: DataFrame, id_col: str, vector: Column, is_query: Column, k: int = 10) -> DataFrame:
    """For each query row the k candidates of highest inner product: query_id, rank, vec_id, score.

    ``vector`` is an array of integers. Candidates are all rows but those with
    the query's id; ties go to the smaller id; fewer than k are returned where
    fewer exist. Rows without an id or a vector take no part, and vectors of
    another length are no candidates. A query row that repeats is asked once; a
    candidate row that repeats is ranked as often. An empty table gives none.
    Only the id, the vector and what tells queries are read, whatever else there is.
    """
    rows = df.select(F.col(id_col).cast("long").alias("id"), vector.alias("v"), is_query.alias("q")).where("id IS NOT NULL AND v IS NOT NULL")
    scratch = Scratch(df.sparkSession, "topk")
    sizes = rows.agg(F.count(F.lit(1)), F.count_if("q")).first()
    parts, blocks = max(1, -(-sizes[0] // CELL)), max(1, -(-sizes[1] // QUERY_BLOCK))
    bases = _bases(rows)
    dim = F.size("v").alias("dim")
    each = lambda low, high: F.explode(F.sequence(F.lit(low), F.lit(high - 1)))
    spread = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    candidates = rows.select("id", "v", dim, spread(parts).alias("part"), each(0, blocks).alias("block"))
    asked = rows.where("q").dropDuplicates(["id", "v"]).select("id", "v", dim, spread(blocks).alias("block"))

    def cell(own: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        found: list[pd.DataFrame] = []
        if len(own) and len(queries):
            vectors = np.stack(own["v"].to_list()).astype(np.int64).reshape(len(own), -1)
            lists = SortedLists(own["id"].to_numpy(), vectors, bases.get(vectors.shape[1]))
            for who, q, floor in zip(queries["id"], queries["v"], queries["floor"], strict=True):
                ids, scores = lists.top(who, np.asarray(q, np.int64), k, -np.inf if pd.isna(floor) else floor)
                found.append(pd.DataFrame({"query_id": who, "vec_id": ids, "score": scores.astype(np.int64)}))
        return pd.concat(found) if found else pd.DataFrame({"query_id": [], "vec_id": [], "score": []}, dtype="int64")

    keys = ["dim", "part", "block"]

    def meet(own: DataFrame, queries: DataFrame) -> DataFrame:
        return own.groupBy(*keys).cogroup(queries.groupBy(*keys)).applyInPandas(cell, "query_id long, vec_id long, score long")

    best = meet(candidates.where("part = 0"), asked.withColumns({"part": F.lit(0), "floor": F.lit(None).cast("double")}))
    if parts > 1:
        best, asked = scratch.keep(best, "first"), scratch.keep(asked, "asked")
        order = W.partitionBy("query_id").orderBy(F.desc("score"))  # k rows
        kth = best.withColumn("_n", F.row_number().over(order)).where(F.col("_n") == k).select(F.col("query_id").alias("id"), F.col("score").cast("double").alias("floor"))
        rest = asked.join(kth, "id", "left").withColumn("part", each(1, parts))
        best = best.unionByName(meet(candidates.where("part > 0"), rest))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))  # k rows from each part
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _bases(rows: DataFrame) -> dict[int, np.ndarray]:
    """A basis for each number of dimensions that a sample of bounded size has."""
    few = rows.where(F.size("v").between(1, BASIS_DIMS)).orderBy(F.xxhash64("id", F.lit(3))).limit(BASIS_SAMPLE).select("v").collect()
    by: dict[int, list] = {}
    for (v,) in few:
        by.setdefault(len(v), []).append(v)
    return {dim: basis_of(np.array(own, np.float64)) for dim, own in by.items()}
