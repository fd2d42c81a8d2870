"""Connected components of a large graph by contraction, all in DataFrames."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: Edges (16 bytes each) that one task takes: what contraction has left is finished there.
IN_ONE_TASK = 1 << 20


def smallest_reachable(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of n places the smallest place that links lead to."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        while not np.array_equal(hop := new[new], new):
            new = hop
        if np.array_equal(new, label):
            break
        label = new
        open_links = label[a] != label[b]
        a, b = a[open_links], b[open_links]
    return label


def components(edges: DataFrame, tag: str = "components") -> DataFrame:
    """``edges`` has columns ``a`` and ``b``, longs. Returns ``node`` and ``root``, a row for each node that an edge touches;
    nodes have the same root exactly if a path joins them.

    Each round draws a fresh random order of the nodes, lets every node point at the first among itself and its
    neighbours, and contracts. A constant part of the nodes goes in each round, whatever the graph's shape, so the
    rounds are about logarithmic in the nodes. Minima are taken before rows are shuffled, so a node with very many edges
    is no hot key; what is carried over is written, not recomputed. Once at most IN_ONE_TASK edges are left, a single task
    goes through them. Only counts come to the driver.
    """
    rest = materialize(edges.where("a <> b").select("a", "b").distinct(), tag)
    roots = None
    turn = 0
    while rest.count() > IN_ONE_TASK:
        both = rest.select("a", "b").union(rest.select(F.col("b").alias("a"), F.col("a").alias("b")))
        order = lambda c: F.struct(F.xxhash64(F.lit(turn), F.col(c)).alias("draw"), F.col(c).alias("node"))  # noqa: B023, E731
        first = both.groupBy("a").agg(F.min(order("b")).alias("near"))
        first = materialize(first.select(F.col("a").alias("node"), F.least("near", order("a"))["node"].alias("to")), tag)
        if roots is None:
            roots = first.select("node", F.col("to").alias("root"))
        else:
            step = first.select(F.col("node").alias("root"), "to")
            roots = materialize(roots.join(step, "root", "left").select("node", F.coalesce("to", "root").alias("root")), tag)
        a = first.select(F.col("node").alias("a"), F.col("to").alias("to_a"))
        b = first.select(F.col("node").alias("b"), F.col("to").alias("to_b"))
        rest = rest.join(a, "a").join(b, "b").where("to_a <> to_b")
        rest = materialize(rest.select(F.least("to_a", "to_b").alias("a"), F.greatest("to_a", "to_b").alias("b")).distinct(), tag)
        turn += 1

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if held:
            a, b = (np.concatenate([h.column(i).to_numpy() for h in held]) for i in (0, 1))
            nodes, places = np.unique(np.concatenate([a, b]), return_inverse=True)
            root = smallest_reachable(len(nodes), places[: len(a)], places[len(a) :])
            yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[root])], ["node", "root"])

    last = rest.select(F.col("a").cast("bigint"), F.col("b").cast("bigint")).repartition(1).mapInArrow(finish, "node bigint, root bigint")
    if roots is None:
        return last
    last = last.select(F.col("node").alias("root"), F.col("root").alias("to"))
    return roots.join(last, "root", "left").select("node", F.coalesce("to", "root").alias("root"))
