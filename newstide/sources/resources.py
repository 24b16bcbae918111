"""Resources and what they depend on: layers in which they can be built, and what is still missing."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.components import written
from .readers import scratch


def layers(needs: dict[str | int, Iterable]) -> list[list]:
    """Names by layer, each after all it needs; raises ValueError on a cycle."""
    left = {k: set(v) - {k} for k, v in needs.items()}
    for x in set().union(*left.values(), set()) - set(left):
        left[x] = set()
    out = []
    while left:
        ready = sorted(k for k, v in left.items() if not v)
        if not ready:
            raise ValueError(f"cycle among {sorted(map(str, left))}")
        out.append(ready)
        left = {k: v - set(ready) for k, v in left.items() if k not in ready}
    return out


@dataclass
class Registry:
    """Named, lazily built DataFrames; each is built once from those it needs."""

    builders: dict[str, tuple[Callable[..., DataFrame], tuple[str, ...]]] = field(default_factory=dict)
    built: dict[str, DataFrame] = field(default_factory=dict)

    def resource(self, *needs: str):
        def add(f: Callable[..., DataFrame]):
            self.builders[f.__name__] = (f, needs)
            return f

        return add

    def get(self, name: str) -> DataFrame:
        layers({k: v for k, (_, v) in self.builders.items()})
        if name not in self.built:
            f, needs = self.builders[name]
            self.built[name] = f(*map(self.get, needs))
        return self.built[name]


def coverage(wanted: DataFrame, present: DataFrame, keys: list[str]) -> DataFrame:
    """Share of the wanted units, by the first key, that are present."""
    have = present.select(*keys).distinct().withColumn("_there", F.lit(1))
    return wanted.join(have, keys, "left").groupBy(keys[0]).agg((F.count("_there") / F.count("*")).alias("coverage"))


def missing_units(wanted: DataFrame, present: DataFrame, keys: list[str]) -> DataFrame:
    """Units that still have to be made."""
    return wanted.join(present.select(*keys).distinct(), keys, "left_anti")


def units_there(spark: SparkSession, path: str, keys: dict[str, str]) -> DataFrame:
    """The values of ``keys`` (name to type) that a table written by them has partitions of, told by its folders; none where there is no table yet."""
    from pyspark.errors import AnalysisException

    schema = ", ".join(f"{k} {t}" for k, t in keys.items())
    try:
        return spark.read.schema(schema).parquet(path).distinct()
    except AnalysisException:
        return spark.createDataFrame([], schema)


def build_missing(wanted: DataFrame, path: str, build: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The units (rows of ``wanted``) that were missing from the table at ``path``, which has them now.

    ``build`` makes the rows of some units; only what is missing is made, and
    only its partitions are written, so a run that was broken off is made good
    by the next, and where nothing is missing nothing is written. A unit that
    has no rows is never there; units with null in a key are left out.
    """
    scratch(wanted.sparkSession, "")
    wanted, keys = wanted.na.drop(), dict(wanted.dtypes)
    missing = written(wanted.distinct().join(units_there(wanted.sparkSession, path, keys), list(keys), "left_anti"))
    if not missing.isEmpty():
        build(missing).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)
    return missing
