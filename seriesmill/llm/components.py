"""Connected components over an edge table, in rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stored


def _to_the_top(parent: DataFrame, most: int) -> DataFrame:
    """Replace every parent by its parent until all parents are tops (paths halve per step)."""
    parent = stored(parent)
    for _ in range(most):
        above = parent.select(F.col("node").alias("up"), F.col("up").alias("top"))
        moved = stored(parent.join(above, "up", "left").select(
            "node", F.coalesce("top", "up").alias("up"), F.col("top").isNotNull().alias("moved")))
        parent = moved.select("node", "up")
        if moved.where("moved").isEmpty():
            return parent
    raise RuntimeError(f"paths did not settle in {most} steps")


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", most: int = 64) -> DataFrame:
    """Columns ``node, root``: every node of an edge with the smallest node it reaches.

    Each round hooks every node with a smaller neighbour to the smallest one,
    follows those hooks to their tops, and replaces each edge by one between
    tops.  Nodes that were hooked never come back, so at least half of the
    nodes of a component leave each round.  An edge table with a third of its
    edges at one node is no burden: a minimum per node is combined before the
    exchange.  Every round is written to the shared folder; only emptiness
    tests reach the driver.

    Edges with a NULL end or equal ends name no link; a node with nothing but
    such edges is not in the result.  Repeated edges count once.
    """
    def ordered(x: str, y: str, df: DataFrame) -> DataFrame:
        return df.where(F.col(x) != F.col(y)).select(
            F.least(x, y).alias("lo"), F.greatest(x, y).alias("hi")).distinct()

    links = stored(ordered(a, b, edges.select(a, b)))
    tree: DataFrame | None = None
    for _ in range(most):
        if links.isEmpty():
            break
        parent = _to_the_top(links.groupBy(F.col("hi").alias("node")).agg(F.min("lo").alias("up")), most)
        hi = parent.select(F.col("node").alias("hi"), F.col("up").alias("y"))
        lo = parent.select(F.col("node").alias("lo"), F.col("up").alias("lo_up"))
        links = stored(ordered("x", "y", links.join(hi, "hi").join(lo, "lo", "left").select(
            F.coalesce("lo_up", "lo").alias("x"), "y")))
        if tree is not None:
            above = parent.select(F.col("node").alias("root"), F.col("up").alias("top"))
            tree = tree.join(above, "root", "left").select("node", F.coalesce("top", "root").alias("root"))
            parent = tree.unionByName(parent.select("node", F.col("up").alias("root")))
            tree = stored(parent)
        else:
            tree = parent.select("node", F.col("up").alias("root"))
    else:
        raise RuntimeError(f"components did not settle in {most} rounds")
    if tree is None:
        return links.select(F.col("lo").alias("node"), F.col("hi").alias("root"))
    return tree.unionByName(tree.select(F.col("root").alias("node"), "root").distinct())
