"""Circles in graphs of (site, src, dst, seq) edges: strongly connected components, and the edges at which a depth-first walk meets them.

Components are found by rounds of joins over all sites at once.  A walk enters a component once and goes through all of it before it leaves it for good,
so the order within a component depends only on where it is entered; which of the components' entrances comes first follows from the least path
of steps that leads there.  Only the inside of one component is walked in one task.
"""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .graph import MOST_ROUNDS, by_shuffle, counted, heights, saved


def least_sources(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(site, node, label): the least node from which each of ``nodes(site, node)`` can be reached over ``edges(site, src, dst)``, itself included.

    A round takes the least label of a node's sources, and then that label's own label, as what reaches the label reaches the node.
    """
    labels = saved(nodes.select("site", "node", F.col("node").alias("label")))
    for _ in range(MOST_ROUNDS):
        near = edges.join(by_shuffle(labels.select("site", F.col("node").alias("src"), "label")), ["site", "src"]).groupBy("site", F.col("dst").alias("node")).agg(F.min("label").alias("near"))
        step = labels.join(by_shuffle(near), ["site", "node"], "left").select("site", "node", "label", F.least("label", F.coalesce("near", "label")).alias("new"))
        hop = labels.select("site", F.col("node").alias("new"), F.col("label").alias("far"))
        step = saved(step.join(by_shuffle(hop), ["site", "new"]).select("site", "node", F.col("label").alias("old"), F.least("new", "far").alias("label")))
        labels = step.select("site", "node", "label")
        if step.filter("old != label").isEmpty():
            return labels
    raise RuntimeError("labels did not settle")


def strong_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(site, node, component) of ``nodes(site, node)`` over ``edges(site, src, dst)`` between them; a component is named by its least node.

    Nodes with the same least source form classes that no component crosses; of each class, what can reach the source within it is its component.
    """
    left, among, done = saved(nodes.select("site", "node").distinct()), saved(edges.select("site", "src", "dst").distinct()), []
    while True:
        ahead = least_sources(left, among)
        ends = (ahead.select("site", F.col("node").alias(end), F.col("label").alias(f"of_{end}")) for end in ("src", "dst"))
        inside = saved(reduce(lambda rows, end: rows.join(by_shuffle(end), ["site", end.columns[1]]), ends, among).filter("of_src = of_dst").select("site", "src", "dst"))
        back = least_sources(left, inside.select("site", F.col("dst").alias("src"), F.col("src").alias("dst")))
        both = saved(ahead.join(by_shuffle(back.withColumnRenamed("label", "back")), ["site", "node"]))
        done.append(both.filter("label = back").select("site", "node", F.col("label").alias("component")))
        left = saved(both.filter("label != back").select("site", "node"))
        if left.isEmpty():
            return reduce(DataFrame.unionByName, done)
        among = saved(among_nodes(inside, left))


def among_nodes(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends in ``nodes(site, node)``."""
    for end in ("src", "dst"):
        edges = edges.join(by_shuffle(nodes.select("site", F.col("node").alias(end))), ["site", end], "left_semi")
    return edges


def reachable(starts: DataFrame, edges: DataFrame) -> DataFrame:
    """(site, node) that can be reached from ``starts(site, node)``, these included."""
    seen = front = saved(starts.select("site", "node").distinct())
    while True:
        step = edges.join(counted(front.select("site", F.col("node").alias("src"))), ["site", "src"], "left_semi").select("site", F.col("dst").alias("node")).distinct()
        front = saved(step.join(by_shuffle(seen), ["site", "node"], "left_anti"))
        if front.isEmpty():
            return seen
        seen = saved(seen.unionByName(front))


def _walk(rows: pd.DataFrame) -> pd.DataFrame:
    """Depth-first through one component from its entrance: every edge out of its nodes with its place in the walk, and whether it closes a circle."""
    nexts, start, inside = {}, None, set(rows["src"].dropna())
    for src, dst in rows.sort_values(["seq", "dst"])[["src", "dst"]].itertuples(index=False):
        if src is None or src != src:
            start = dst
        else:
            nexts.setdefault(src, []).append(dst)
    state, found, stack = {start: "open"}, [], [(start, iter(nexts.get(start, ())))]
    while stack:
        node, left = stack[-1]
        for dst in left:
            found.append((node, dst, len(found), state.get(dst) == "open"))
            if dst in inside and dst not in state:
                # Nodes of other components are not entered: whatever lies there leads nowhere back.
                state[dst] = "open"
                stack.append((dst, iter(nexts.get(dst, ()))))
                break
        else:
            state[node] = "done"
            stack.pop()
    out = pd.DataFrame(found, columns=["src", "dst", "place", "closing"])
    out.insert(0, "component", rows["component"].iloc[0])
    out.insert(0, "site", rows["site"].iloc[0])
    return out


def closing_edges(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """(site, src, dst) of the edges that a depth-first walk meets while their target is still open.

    The walk starts at ``roots(site, page)`` in the order of their ``ord`` where they have one, else by name, follows the edges of a node by seq, and
    enters each node once.  Only nodes that can reach a circle take part; of edges given twice the first seq counts.
    """
    edges = saved(edges.groupBy("site", "src", "dst").agg(F.min(F.col("seq").cast("long")).alias("seq")))
    nodes = edges.select("site", F.col("src").alias("node")).union(edges.select("site", F.col("dst").alias("node"))).distinct()
    odd = saved(nodes.join(by_shuffle(heights(nodes, edges).select("site", "node")), ["site", "node"], "left_anti"))
    kind = dict(edges.dtypes)["dst"]
    nothing = edges.select("site", "src", "dst").limit(0)
    if odd.isEmpty():
        return nothing
    order = F.col("ord").cast("long") if "ord" in roots.columns else F.lit(0).cast("long")
    starts = roots.groupBy("site", F.col("page").alias("node")).agg(F.min(order).alias("ord")).join(by_shuffle(odd), ["site", "node"], "left_semi")
    starts = saved(starts.withColumn("rank", F.row_number().over(Window.partitionBy("site").orderBy("ord", "node")).cast("long")).select("site", "node", "rank"))
    inner = saved(among_nodes(edges, odd))
    live = saved(reachable(starts, inner))
    if live.isEmpty():
        return nothing
    inner = saved(among_nodes(inner, live))
    parts = saved(strong_components(live, inner))
    of = lambda end: parts.select("site", F.col("node").alias(end), F.col("component").alias(f"{end}_part"))
    inner = saved(inner.join(by_shuffle(of("src")), ["site", "src"]).join(by_shuffle(of("dst")), ["site", "dst"]))
    waits = saved(inner.filter("src_part != dst_part").select("site", F.col("src_part").alias("before"), F.col("dst_part").alias("component")).distinct())
    ways = [saved(starts.join(by_shuffle(parts), ["site", "node"]).select("site", "component", F.array("rank").alias("way"), "node"))]
    left, closing = saved(parts.select("site", "component").distinct()), []
    while True:
        held = waits.join(by_shuffle(left.select("site", F.col("component").alias("before"))), ["site", "before"], "left_semi").select("site", "component").distinct()
        ready = saved(left.join(by_shuffle(held), ["site", "component"], "left_anti"))
        if ready.isEmpty():
            return saved(reduce(DataFrame.unionByName, closing).distinct())
        first = reduce(DataFrame.unionByName, ways).join(by_shuffle(ready), ["site", "component"], "left_semi").groupBy("site", "component").agg(F.min(F.struct("way", "node")).alias("by"))
        first = saved(first.select("site", "component", "by.way", "by.node"))
        inside = inner.withColumnRenamed("src_part", "component").join(by_shuffle(ready), ["site", "component"], "left_semi").select("site", "component", "src", "dst", "seq")
        begin = first.select("site", "component", F.lit(None).cast(kind).alias("src"), F.col("node").alias("dst"), F.lit(-1).cast("long").alias("seq"))
        steps = saved(inside.unionByName(begin).groupBy("site", "component").applyInPandas(_walk, f"site string, component {kind}, src {kind}, dst {kind}, place long, closing boolean"))
        closing.append(steps.filter("closing").select("site", "src", "dst"))
        out = steps.join(by_shuffle(of("dst")), ["site", "dst"]).filter("component != dst_part").join(by_shuffle(first.select("site", "component", "way")), ["site", "component"])
        ways.append(saved(out.select("site", F.col("dst_part").alias("component"), F.concat("way", F.array("place")).alias("way"), F.col("dst").alias("node"))))
        left = saved(left.join(by_shuffle(ready), ["site", "component"], "left_anti"))
