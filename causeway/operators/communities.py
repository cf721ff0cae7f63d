"""Communities of a weighted graph by greedy modularity, level by level.

A level moves nodes between communities while that raises the modularity. In a sweep one hash half of the nodes moves, and
the halves are drawn anew every other sweep: a node chooses among communities as the other half leaves them, so two
neighbours rarely swap forever. Communities then become the nodes of the next, smaller graph, whose edges are the summed
weights, those within a community as a loop. A level that doesn't raise the modularity of the whole graph ends the search.

Every step is joins and sums over edge and node tables; no task sees a community's or a hub's neighbours at once, and
weights are whole numbers, so sums, moves and reruns agree exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import persist_shared

#: Weights are counted in these parts.
UNITS = 1_000_000
MOST_LEVELS, MOST_SWEEPS = 12, 24
#: A level's sweeps end when a turn of both halves moves no more than this share of its nodes.
SETTLED = 0.01


def _directed(edges: DataFrame, a: str, b: str, weight: str | None) -> DataFrame:
    """a, b, w in both directions; a loop once, counted twice, as it has both its ends at one node."""
    w = F.lit(UNITS) if weight is None else F.round(F.col(weight) * UNITS)
    rows = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.col(a).alias("a"), F.col(b).alias("b"), w.cast("long").alias("w")).where("w > 0")
    both = F.explode(F.when(F.col("a") == F.col("b"), F.array(F.struct("a", "b", (F.col("w") * 2).alias("w")))).otherwise(F.array(F.struct("a", "b", "w"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"), "w"))))
    return rows.select(both.alias("x")).select("x.*").groupBy("a", "b").agg(F.sum("w").alias("w"))


def _quality(links: DataFrame, nodes: DataFrame, total: int) -> float:
    """Modularity of the labelling c of the nodes."""
    ends = links.join(nodes.select(F.col("node").alias("a"), F.col("c").alias("ca")), "a").join(nodes.select(F.col("node").alias("b"), F.col("c").alias("cb")), "b")
    inside = ends.where("ca = cb").agg(F.sum("w")).first()[0] or 0
    squares = nodes.groupBy("c").agg(F.sum("k").alias("t")).agg(F.sum((F.col("t") / F.lit(float(total))) ** 2)).first()[0] or 0.0
    return inside / total - squares


def _sweep(links: DataFrame, nodes: DataFrame, total: int, sweep: int) -> DataFrame:
    """node, k, c, moved: each node of the sweep's half in the community that gains most, the smallest of equal ones."""

    def turn(node: str) -> Column:
        return F.pmod(F.xxhash64(F.lit(sweep // 2), node), F.lit(2)) == sweep % 2

    near = links.where(turn("a") & (F.col("a") != F.col("b"))).join(nodes.select(F.col("node").alias("b"), "c"), "b").select("a", "c", "w")
    stays = nodes.where(turn("node")).select(F.col("node").alias("a"), "c", F.lit(0).cast("long").alias("w"))
    options = near.union(stays).groupBy("a", "c").agg(F.sum("w").alias("w"))
    sizes = nodes.groupBy("c").agg(F.sum("k").alias("t"))
    mine = nodes.select(F.col("node").alias("a"), "k", F.col("c").alias("own"))
    told = options.join(sizes, "c").join(mine, "a")
    rest = F.col("t") - F.when(F.col("c") == F.col("own"), F.col("k")).otherwise(0)
    # Gain of joining c over being alone, times the total weight: whole numbers beyond 64 bits, so as decimals.
    d = lambda x: x.cast("decimal(19,0)")
    gain = d(F.col("w")) * d(F.lit(total)) - d(F.col("k")) * d(rest)
    best = told.groupBy("a").agg(F.min(F.struct((-gain).alias("g"), (F.col("c") != F.col("own")).alias("moved"), "c")).alias("best"))
    moved = nodes.join(best.select(F.col("a").alias("node"), F.col("best.c").alias("to")), "node", "left")
    to = F.coalesce("to", "c")
    return moved.select("node", "k", to.alias("c"), (to != F.col("c")).alias("moved"))


def _level(links: DataFrame, total: int) -> tuple[DataFrame, int]:
    """node, k, c of one level, and the number of its nodes."""
    nodes = persist_shared(links.groupBy(F.col("a").alias("node")).agg(F.sum("w").alias("k")).withColumn("c", F.col("node")), "community-nodes")
    n, turned = nodes.count(), 0
    for sweep in range(MOST_SWEEPS):
        nodes = persist_shared(_sweep(links, nodes, total, sweep), "community-sweep")
        turned = nodes.where("moved").count() + (turned if sweep % 2 else 0)
        nodes = nodes.drop("moved")
        if sweep % 2 and turned <= SETTLED * n:
            break
    return nodes, n


def communities(edges: DataFrame, a: str, b: str, weight: str | None = None) -> tuple[DataFrame, float]:
    """(node, community) of every node with an edge, and the modularity; a community is named by its smallest node.

    Edges are undirected; parallel ones add up, loops count, rows with a null end or a weight of 0 or less are left out.
    Weights are rounded to millionths. Without edges there are no rows and the modularity is 0.
    """
    links = persist_shared(_directed(edges, a, b, weight), "community-links")
    total = links.agg(F.sum("w")).first()[0]
    found = links.select(F.col("a").alias("node")).distinct().withColumn("community", F.col("node"))
    if not total:
        return found, 0.0
    best = None
    for _ in range(MOST_LEVELS):
        nodes, n = _level(links, total)
        now = _quality(links, nodes, total)
        if best is not None and now <= best + 1e-9:
            break
        best = now
        label = nodes.select(F.col("node").alias("community"), "c")
        found = persist_shared(found.join(label, "community").select("node", F.col("c").alias("community")), "communities")
        ends = links.join(nodes.select(F.col("node").alias("a"), F.col("c").alias("ca")), "a").join(nodes.select(F.col("node").alias("b"), F.col("c").alias("cb")), "b")
        links = persist_shared(ends.groupBy(F.col("ca").alias("a"), F.col("cb").alias("b")).agg(F.sum("w").alias("w")), "community-links")
        if nodes.select("c").distinct().count() == n:
            break
    names = found.groupBy("community").agg(F.min("node").alias("first"))
    return found.join(names, "community").select("node", F.col("first").alias("community")), best


def community_report(edges: DataFrame, a: str, b: str, weight: str | None = None) -> DataFrame:
    """One row: n_nodes, n_communities, share of the largest, modularity."""
    found, quality = communities(edges, a, b, weight)
    sizes = found.groupBy("community").agg(F.count(F.lit(1)).alias("n"))
    return sizes.agg(F.sum("n").alias("n_nodes"), F.count(F.lit(1)).alias("n_communities"), (F.max("n") / F.sum("n")).alias("share")).withColumn("modularity", F.lit(quality))
