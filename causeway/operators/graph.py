"""Graphs as edge tables: components, modularity, bipartite attribute edges."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import persist_shared


def connected_components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """node, component (its least node): each round takes the least label nearby, then that label's label."""
    edges = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a is not null and b is not null")
    both = persist_shared(edges.union(edges.select("b", "a")).distinct(), "graph-edges")
    labels = persist_shared(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("a")).alias("component")), "graph-labels")
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        least = persist_shared(labels.join(near, "node").select("node", "component", F.least("component", "near").alias("least")), "graph-least")
        jump = least.select(F.col("node").alias("least"), F.col("least").alias("next"))
        moved = persist_shared(least.join(jump, "least", "left").select("node", "component", F.coalesce("next", "least").alias("now")), "graph-moved")
        labels = moved.select("node", F.col("now").alias("component"))
        if moved.where("now <> component").isEmpty():
            return labels


def largest_component_share(edges: DataFrame, a: str, b: str) -> DataFrame:
    """One row: n_nodes, n_components, share of the largest."""
    sizes = connected_components(edges, a, b).groupBy("component").agg(F.count(F.lit(1)).alias("n"))
    return sizes.agg(F.sum("n").alias("n_nodes"), F.count(F.lit(1)).alias("n_components"), (F.max("n") / F.sum("n")).alias("share"))


def modularity(edges: DataFrame, a: str, b: str, labels: DataFrame, node: str, label: str) -> DataFrame:
    """One row: modularity of a labelling of an undirected edge list: sum over labels of inside/m - (degree/2m)^2."""
    e = edges.select(F.col(a).alias("a"), F.col(b).alias("b"))
    l = labels.select(F.col(node).alias("n"), F.col(label).alias("l"))
    ends = e.join(l.withColumnsRenamed({"n": "a", "l": "la"}), "a").join(l.withColumnsRenamed({"n": "b", "l": "lb"}), "b")
    by = ends.select(F.explode(F.array(F.struct(F.col("la").alias("l"), F.col("lb").alias("o")), F.struct(F.col("lb").alias("l"), F.col("la").alias("o")))).alias("x")).select("x.*")
    per = by.groupBy("l").agg(F.count(F.lit(1)).alias("d"), (F.count_if(F.col("l") == F.col("o")) / 2).alias("inside"))
    m2 = F.lit(2.0) * F.col("m")
    return per.agg(F.sum("d").alias("two_m"), F.sum("inside").alias("inside"), F.sum(F.col("d").cast("double") * F.col("d")).alias("sq")).withColumn("m", F.col("two_m") / 2).select(
        (F.col("inside") / F.col("m") - F.col("sq") / (m2 * m2)).alias("modularity"))


def attribute_edges(df: DataFrame, key: str, lists: Sequence[str], least: int = 2, most: int | None = 5000) -> DataFrame:
    """key, attribute_type, value for each list column's values that between least and most (None: any number of) keys have."""
    parts = [df.select(key, F.lit(c).alias("attribute_type"), F.explode(c).alias("value")) for c in lists]
    edges = parts[0]
    for p in parts[1:]:
        edges = edges.unionByName(p)
    edges = edges.where(F.trim("value") != "").distinct()
    if least <= 1 and most is None:
        return edges
    n = F.col("n")
    often = edges.groupBy("attribute_type", "value").agg(F.count(F.lit(1)).alias("n")).where(n >= least if most is None else n.between(least, most))
    return edges.join(often, ["attribute_type", "value"], "left_semi")
