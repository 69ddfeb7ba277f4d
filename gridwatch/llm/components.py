"""Connected components of a link table, as rounds of edge contraction."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridwatch.llm.common import cut


def components(edges: DataFrame) -> DataFrame:
    """``(node, component)`` for every node of ``edges(u, v)``: component is
    the smallest node reachable.

    Each round points every node at the least of itself and its neighbours
    (an aggregate with map-side combine, so a hub costs one row per task),
    follows the pointers to their ends by doubling, renames both ends of every
    edge to these and drops loops and repeats.  What is left of a component is
    its local minima, at most half of its nodes; a star whose centre is its
    least node is done in one round, a chain of n nodes takes log2(n)
    doublings.  The maps of all rounds are composed at the end.  Nothing but
    emptiness reaches the driver.  Null ends and loops are ignored; an empty
    table gives no rows.
    """
    e = cut(edges.select("u", "v").where("u <> v")
            .select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct())
    maps: list[DataFrame] = []
    while not e.isEmpty():
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        step = cut(both.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("near"))
                   .select("node", F.least("node", "near").alias("to")))
        while True:
            ahead = step.select(F.col("node").alias("to"), F.col("to").alias("next"))
            doubled = cut(step.join(ahead, "to").select("node", "next", (F.col("next") != F.col("to")).alias("moved")))
            step = doubled.select("node", F.col("next").alias("to"))
            if doubled.where("moved").isEmpty():
                break
        maps.append(step)
        left = step.select(F.col("node").alias("u"), F.col("to").alias("tu"))
        right = step.select(F.col("node").alias("v"), F.col("to").alias("tv"))
        e = cut(e.join(left, "u").join(right, "v")
                .select(F.least("tu", "tv").alias("u"), F.greatest("tu", "tv").alias("v"))
                .where("u <> v").distinct())
    if not maps:
        return edges.select(F.col("u").alias("node"), F.col("u").alias("component")).where("false")
    out = maps[0].select("node", F.col("to").alias("component"))
    for step in maps[1:]:
        nxt = step.select(F.col("node").alias("component"), "to")
        out = out.join(nxt, "component", "left").select(
            "node", F.coalesce("to", "component").alias("component"))
    return out


def spanning(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges of a star forest with the components of the edges ``(u, v)``:
    every node but the least of its component, and that least node."""
    if not len(u):
        return u, v
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[:len(u)], at[len(u):]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        while True:                                   # pointer jumping
            jump = new[new]
            if np.array_equal(jump, new):
                break
            new = jump
        new = new[label]
        if np.array_equal(new, label):
            break
        label = new
        keep = label[a] != label[b]
        a, b = a[keep], b[keep]
        if not len(a):
            break
    far = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[far], nodes[label[far]]
