"""Connected components by contraction, as joins and grouped minima."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import attach, discard, few, written


def _shuffled(code: Column) -> Column:
    """A bijection of 64-bit numbers (xorshift), so that each round orders the nodes anew."""
    code = code.bitwiseXOR(F.shiftleft(code, 13))
    code = code.bitwiseXOR(F.shiftrightunsigned(code, 7))
    return code.bitwiseXOR(F.shiftleft(code, 17))


#: Edges that are one task's work: two numbers each.
FEW = 100_000


def _together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """node, root of at most FEW edges; root is the smallest node of its component."""
    parent: dict[int, int] = {}

    def top(v: int) -> int:
        while (up := parent.setdefault(v, v)) != v:
            parent[v] = v = parent[up]
        return v

    for batch in batches:
        for a, b in zip(batch["a"].to_pylist(), batch["b"].to_pylist()):
            a, b = top(a), top(b)
            parent[max(a, b)] = min(a, b)
    nodes = list(parent)
    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([top(v) for v in nodes], pa.int64())], ["node", "root"])


def _codes(edges: DataFrame, level: int, used: list[DataFrame]) -> DataFrame:
    """node, level, code: nodes have the same level and code if edges (a < b, written) connect them."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = written(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("v"), F.least("a", "m").alias("m")), "least")
    left = edges.join(least.hint("merge"), F.col("a") == F.col("v")).select(F.col("m").alias("a"), "b")
    moved = left.join(least.hint("merge"), F.col("b") == F.col("v")).select(_shuffled(F.col("a")).alias("a"), _shuffled(F.col("m")).alias("b"))
    moved = written(moved.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    used += [least, moved]
    own, n = least.select(F.col("v").alias("node"), F.lit(level).alias("level"), _shuffled(F.col("m")).alias("code")), moved.count()
    if not n:
        return own
    if n <= FEW:
        further = moved.coalesce(1).mapInArrow(_together, "node long, root long").select("node", F.lit(level + 1).alias("level"), F.col("root").alias("code"))
    else:
        further = _codes(moved, level + 1, used)
    further = further.select(F.col("node").alias("_node"), F.col("level").alias("_level"), F.col("code").alias("_code"))
    joined = own.join(further.hint("merge"), F.col("code") == F.col("_node"), "left")
    table = written(joined.select("node", F.coalesce("_level", "level").alias("level"), F.coalesce("_code", "code").alias("code")), "codes")
    used.append(table)
    return table


def components(edges: DataFrame, rows: int | None = None) -> DataFrame:
    """node, root of every node that has an edge (a long, b long); root is the smallest node of its component.

    Each round gives every node the smallest of itself and its neighbours and replaces the edges' ends by these,
    until no edge is left; on the way back nodes take the codes of what they were replaced by. At first the codes
    are the ids, so that stars around the smallest are one round; then they are shuffled before each round: were
    they in the order of the ids, a path whose ids ascend would lose one node a round; in random order any path
    about halves. Minima are combined before the exchange, so a node with many neighbours costs a task no more
    than its own rows. Once at most FEW edges are left, one task joins their ends.
    rows: how many edges there are at most, if that is known.
    """
    first = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct()
    first = written(first if rows is None else few(first, rows), "edges")
    if first.count() <= FEW:
        found = written(first.coalesce(1).mapInArrow(_together, "node long, root long"), "components")
        discard(first)
        return found
    used = [first]
    labels = written(_codes(first, 0, used), "labels")
    roots = written(labels.groupBy("level", "code").agg(F.min("node").alias("root"), F.count(F.lit(1)).alias("n")), "roots")
    found = written(attach(labels, roots, ["level", "code"]).select("node", "root"), "components")
    discard(*used, labels, roots)
    return found
