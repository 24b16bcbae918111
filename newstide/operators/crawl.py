"""What a graph reaches from its seeds, level by level, whatever cycles it has."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.readers import scratch
from .components import written
from .selection import _union


def crawl(edges: DataFrame, seeds: DataFrame, depth: int | None = None) -> DataFrame:
    """(node, depth): every node that edges (parent, child) lead to from ``seeds`` (node), seeds included, with its least number of steps.

    A level is what the edges of the one before lead to and no level has yet; it
    is written, and joins with the next need only it. It ends at ``depth``, or
    where a level is empty: no node is visited twice, so cycles end too. Nodes
    and ends of edges that are null are left out.
    """
    scratch(seeds.sparkSession, "")
    level = written(seeds.where("node is not null").select("node", F.lit(0).alias("depth")).distinct())
    found = [level]
    while len(found) - 1 != depth and not level.isEmpty():
        reached = edges.join(level.select(F.col("node").alias("parent")), "parent", "left_semi").where("child is not null").select(F.col("child").alias("node")).distinct()
        level = written(reached.join(_union(found).select("node"), "node", "left_anti").select("node", F.lit(len(found)).alias("depth")))
        found.append(level)
    return _union(found)
