"""Arrays that partitions compute and whose sum is wanted."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import tidied


def sum_over(df: DataFrame, columns: list[str], count: Callable[[pa.RecordBatch], np.ndarray]) -> np.ndarray | None:
    """``count(batch)``, a float64 array of fixed size, summed over all batches; None without rows.

    Each partition sends one array. About a square root of their number are
    added up first, so neither a task nor the driver holds one per partition.
    """

    def run(batches):
        part, total = None, None
        for batch in batches:
            if batch.num_rows:
                part = batch.column("part")[0].as_py()
                here = count(batch)
                total = here if total is None else total + here
        if total is not None:
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "counts": pa.array([total.tobytes()], pa.binary())})

    def add(table: pa.Table) -> pa.Table:
        return pa.table({"counts": pa.array([sum(np.frombuffer(x, "<f8") for x in table.column("counts").to_pylist()).tobytes()], pa.binary())})

    rows = df.select(*columns, F.spark_partition_id().alias("part")).mapInArrow(tidied(run), "part int, counts binary")
    fan = max(1, math.isqrt(rows.rdd.getNumPartitions()))
    some = rows.groupBy(F.pmod("part", F.lit(fan))).applyInArrow(add, "counts binary").collect()
    return sum(np.frombuffer(r.counts, "<f8") for r in some) if some else None
