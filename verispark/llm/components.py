"""Connected components by contraction, without bringing links to the driver.

In each round every vertex points to its smallest neighbour, pointers are
shortened twice, and links move to the vertices pointed to; links inside a vertex
go.  Pointers never lead to larger ids, so the last vertex of a component is its
smallest.  Tables of a round are written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import written


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node in ``links`` (columns a, b: long); component is the smallest node.

    Links may repeat, point either way, or join a node to itself; nulls are left out.
    """
    links = written(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a is not null and b is not null").distinct())
    labels = links.select(F.col("a").alias("node")).union(links.select("b")).distinct().withColumn("component", F.col("node"))
    links = links.filter("a <> b")
    while not links.isEmpty():
        both = links.union(links.select("b", "a"))
        up = both.groupBy(F.col("a").alias("v")).agg(F.least(F.min("b"), F.col("v")).alias("to"))
        up = written(up)
        up = written(_follow(up))
        labels = written(
            labels.join(up, labels.component == up.v, "left").select("node", F.coalesce("to", "component").alias("component"))
        )
        a, b = up.select(F.col("v").alias("a"), F.col("to").alias("to_a")), up.select(F.col("v").alias("b"), F.col("to").alias("to_b"))
        moved = links.join(a, "a").join(b, "b").filter("to_a <> to_b")
        links = written(moved.select(F.greatest("to_a", "to_b").alias("a"), F.least("to_a", "to_b").alias("b")).distinct())
    return labels


def _follow(up: DataFrame) -> DataFrame:
    """Every pointer moved on to where its target points, twice."""
    for _ in range(2):
        on = up.select(F.col("v").alias("to"), F.col("to").alias("further"))
        up = up.join(on, "to").select("v", F.col("further").alias("to"))
    return up
