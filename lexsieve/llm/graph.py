"""Connected components of an edge table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexsieve.plans.scale import written


def _nearest(directed: DataFrame) -> DataFrame:
    """For each node the smallest of itself and its neighbours; partial minima come before the shuffle."""
    return directed.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))


def _settled(edges: DataFrame) -> bool:
    """Whether every edge leads from a node with no other edge to a root: one exchange, counted before it."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("as_u"), F.lit(0).alias("as_v")).union(
        edges.select("v", F.lit(0), F.lit(1)))
    return ends.groupBy("node").agg(F.sum("as_u").alias("leaving"), F.max("as_v").alias("entered")).where(
        "leaving + entered > 1 and leaving > 0").isEmpty()


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root): the smallest node of the component of every node that has an edge.

    Every round replaces edges and never adds any, so the table stays as large as the input; a hub's edges
    lie in a plain join, whose skewed partitions adaptive execution splits. Self loops, repeated edges and
    null ends are allowed: a null end is dropped, a node with only a self loop is its own root. The rounds end when
    every node but the roots has one edge, to its root.
    """
    clean = edges.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")).where("u is not null and v is not null")
    loops = clean.where("u = v").select(F.col("u").alias("node"), F.col("u").alias("root"))
    # tables, not checkpoints: a round's few edges are read in as many tasks as their size asks for, not in one for each shuffle partition
    now = written(clean.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    while not _settled(now):
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.join(_nearest(both), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        near = _nearest(large)
        hooked = large.join(near, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = written(hooked.union(near.select("u", F.col("m").alias("v"))).where("u <> v").distinct(), "edges")
    found = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    roots = found.select(F.col("root").alias("node"), "root").union(loops).distinct()
    return found.union(roots.join(found.select("node"), "node", "left_anti"))
