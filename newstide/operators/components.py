"""Connected components by alternating large-star and small-star rounds (Kiveris et al., 2014)."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def release(spark: SparkSession) -> None:
    """Have the driver notice which shuffles nothing refers to any more, so that executors delete their files."""
    spark._jvm.System.gc()


def written(df: DataFrame) -> DataFrame:
    """``df`` as a table in the session's checkpoint folder: evaluated once, its lineage cut, later reads take only the columns they need."""
    spark = df.sparkSession
    path = f"{spark.sparkContext.getCheckpointDir()}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    release(spark)
    return spark.read.schema(df.schema).parquet(path)


def _dropped(df: DataFrame) -> None:
    """Delete the table that ``written`` gave; nothing may read it any more."""
    spark = df.sparkSession
    files = df.inputFiles()
    if not files:
        return
    path = spark._jvm.org.apache.hadoop.fs.Path(os.path.dirname(files[0]))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def _small_star(e: DataFrame) -> DataFrame:
    """Each node's smaller neighbours, and the node itself, move to the smallest of them."""
    e = e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    least = e.groupBy("a").agg(F.min("b").alias("m"))
    return e.join(least, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))


def _large_star(e: DataFrame) -> DataFrame:
    """Each node's larger neighbours move to the smallest node of its neighbourhood."""
    both = e.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("edge")).select("edge.a", "edge.b")
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    return both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node that each node of ``edges`` (a, b) reaches.

    Nodes without an edge to another node are absent. The session's checkpoint
    folder must be set; every round is written there, and rounds grow with the
    logarithm of the longest path. No edge list reaches the driver: rounds end
    when a hash sum of the edges stays the same.
    """
    now = written(_small_star(edges))
    seen = None
    while True:
        mark = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if mark == seen or not mark[0]:
            break
        seen = mark
        before, now = now, written(_small_star(_large_star(now)))
        _dropped(before)
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
