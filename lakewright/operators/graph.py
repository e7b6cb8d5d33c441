"""Graphs: connected components of link tables, and correlation graphs with their degrees and distances."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakewright.session import cut, join_counted, release


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """One star step over (u, v). Large: u's larger neighbours go to the least of u and its neighbours;
    small: u and its smaller neighbours go to the least of them. The least is found by aggregation and
    brought back by a join that spreads nodes of very many neighbours."""
    if large:
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = cut(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count_if(F.col("v") > F.col("u")).alias("held")))
        out = join_counted(both.filter("v > u"), least, "u", "held", "v", "m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = cut(down.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("held")))
        out = join_counted(down, least, "u", "held", "v", "m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return cut(out.filter("u <> v").distinct())


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b): component is the least node that links reach.

    Nodes may be of any type with an order, structs too. Loops, repeated and two-way links are fine; null
    ends link nothing; without links there are no rows. Rounds go on until all links are stars around
    their least node. Each step is checkpointed; only a few numbers of it come to the driver.
    """
    now = cut(edges.filter("a is not null and b is not null").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct())
    rounds = 0
    while True:
        # a node hangs on one other at most, and nothing hangs on what hangs itself
        ends = now.select(F.col("u").alias("x"), F.lit(1).alias("hangs"), F.lit(0).alias("holds")).unionByName(now.select(F.col("v").alias("x"), F.lit(0).alias("hangs"), F.lit(1).alias("holds")))
        per = ends.groupBy("x").agg(F.sum("hangs").alias("hangs"), F.max("holds").alias("holds"))
        if per.filter("hangs > 1 or (hangs = 1 and holds = 1)").isEmpty():
            break
        now = _stars(_stars(now, True), False)
        rounds += 1
        if rounds % 4 == 0:
            release(edges.sparkSession)
    leaves = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return leaves.unionByName(roots)


def local_roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Least member of each node's component, for nodes 0 to n - 1 and links (i, j)."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[i], root[j])
        after = root.copy()
        np.minimum.at(after, i, low)
        np.minimum.at(after, j, low)
        np.minimum.at(after, root[i], low)
        np.minimum.at(after, root[j], low)
        after = after[after]
        if (after == root).all():
            return root
        root = after


def edges(corr: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Both directions of pairs with |correlation| >= threshold."""
    return corr.filter((F.col("i") != F.col("j")) & (F.abs("value") >= threshold)).select("i", "j")


def degrees(nodes: DataFrame, e: DataFrame) -> DataFrame:
    return nodes.join(e.groupBy("i").agg(F.count("*").alias("degree")), "i", "left").withColumn("degree", F.coalesce("degree", F.lit(0)).cast("long"))


def components(nodes: DataFrame, e: DataFrame) -> DataFrame:
    """(i, component): the least node that edges reach; a node without edges is its own."""
    found = connected_components(e.select(F.col("i").alias("a"), F.col("j").alias("b")))
    return nodes.join(found.withColumnRenamed("node", "i"), "i", "left").select("i", F.coalesce("component", "i").alias("component"))


#: The most nodes whose distances are searched.
DIAMETER_NODES = 4096


def diameter(nodes: DataFrame, e: DataFrame) -> int:
    """The longest shortest path between connected nodes; frontier by frontier, for graphs of variables, not
    rows: connected pairs are held, so more than ``DIAMETER_NODES`` nodes are an error."""
    if nodes.limit(DIAMETER_NODES + 1).count() > DIAMETER_NODES:
        raise ValueError(f"more than {DIAMETER_NODES} nodes")
    seen = cut(e.select(F.col("i").alias("a"), F.col("j").alias("b")).distinct())
    steps, frontier = 0, seen
    while not frontier.isEmpty():
        steps += 1
        nxt = cut(frontier.join(e.select(F.col("i").alias("b"), F.col("j").alias("c")), "b").select("a", F.col("c").alias("b")).filter("a <> b").distinct().join(seen, ["a", "b"], "left_anti"))
        seen, frontier = cut(seen.unionByName(nxt)), nxt
    return steps


def graph_summary(nodes: DataFrame, e: DataFrame) -> DataFrame:
    """Nodes, edges, mean and largest degree, components, isolated nodes."""
    comp = components(nodes, e)
    d = degrees(nodes, e).agg(F.count("*").alias("nodes"), (F.sum("degree") / 2).cast("long").alias("edges"), F.avg("degree").alias("average_degree"), F.max("degree").alias("max_degree"), F.count_if(F.col("degree") == 0).alias("isolated"))
    return d.crossJoin(comp.agg(F.countDistinct("component").alias("components")))  # one row each
