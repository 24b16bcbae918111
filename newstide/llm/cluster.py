"""What the corpus operators share about the cluster they run on."""

from __future__ import annotations

import math
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.components import written

#: Text bytes that one grouped Python call should hold.
GROUP_BYTES = 8 << 20


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that the session names. A folder of this machine is chosen only for a local master that names none."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="newstide-checkpoint-"))
    return sc.getCheckpointDir()


def materialise(df: DataFrame) -> DataFrame:
    """Evaluate once into a table in the shared folder and cut the lineage there; files of shuffles that nothing needs any more go."""
    checkpoint_dir(df.sparkSession)
    return written(df)


def groups_for(df: DataFrame, column: str = "text", target: int = GROUP_BYTES) -> int:
    """How many groups keep each one's text near ``target`` bytes; never below the session's own shuffle width."""
    total = df.select(F.sum(F.octet_length(column))).first()[0] or 0
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(total / target), 1)


def parquet(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def fresh(df: DataFrame, name: str) -> str:
    """``name``, or it with underscores before it until ``df`` has no such column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name
