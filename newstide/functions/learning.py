"""Learned components on pyspark.ml and on sums that SQL can take."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ordered import hash_first


def assembled(df: DataFrame, features: list[str]) -> DataFrame:
    return VectorAssembler(inputCols=features, outputCol="features", handleInvalid="keep").transform(df)


def logistic_policy(train: DataFrame, rows: DataFrame, features: list[str], label: str) -> DataFrame:
    model = LogisticRegression(labelCol=label, maxIter=30, regParam=0.01).fit(assembled(train, features))
    return model.transform(assembled(rows, features)).withColumn("p", vector_to_array("probability")[1]).drop("features", "rawPrediction", "probability", "prediction")


#: Rows whose kernels are taken at once.
STRIP = 512


def gp_fit(x: np.ndarray, y: np.ndarray, noise: float = 0.1) -> tuple[np.ndarray, ...]:
    """A Gaussian process with a squared-exponential kernel that has a length scale, its deviation, for each feature, and white noise."""
    scale = np.where(x.std(0) > 0, x.std(0), 1.0) * np.sqrt(x.shape[1])
    return x, scale, np.linalg.solve(_kernel(x, x, scale) + noise * np.eye(len(x)), y - y.mean()), y.mean()


def _kernel(a: np.ndarray, b: np.ndarray, scale: np.ndarray) -> np.ndarray:
    far = np.zeros((len(a), len(b)))
    for f in range(a.shape[1]):
        d = a[:, f, None] - b[None, :, f]
        d /= scale[f]
        d *= d
        far += d
    np.negative(far, out=far)
    far /= 2
    return np.exp(far, out=far)


def gp_mean(z: np.ndarray, x: np.ndarray, scale: np.ndarray, weights: np.ndarray, mean: float) -> np.ndarray:
    """Means of a fitted process, a bounded number of rows at a time."""
    out = np.empty(len(z))
    for i in range(0, len(z), STRIP):
        out[i : i + STRIP] = _kernel(z[i : i + STRIP], x, scale) @ weights + mean
    return out


def gp_predict(x: np.ndarray, y: np.ndarray, z: np.ndarray, noise: float = 0.1) -> np.ndarray:
    """Mean at ``z`` of the process that is fitted to ``x`` and ``y``."""
    return gp_mean(z, *gp_fit(x, y, noise))


def gp_ensemble(rows: DataFrame, features: list[str], label: str, models: int = 10, sample: int = 100) -> DataFrame:
    """Each row's mean prediction over ``models`` processes, each on a reservoir of ``sample`` rows (hash order).

    The reservoirs are bounded, so they travel with the task; of the rows, which are read three times, only theirs are shuffled.
    """
    numbered = rows.withColumn("model", F.explode(F.sequence(F.lit(0), F.lit(models - 1))))
    numbered = numbered.withColumn("h", F.md5(F.concat(F.col("model").cast("string"), F.lit("-"), F.col("id").cast("string"))))
    part = hash_first(numbered.select("model", "h", *features, label), ["model"], F.col("h"), sample).orderBy("model", "h").collect()
    kept = []
    for m in sorted({r.model for r in part}):
        own = [r for r in part if r.model == m]
        kept.append(gp_fit(np.array([[r[f] for f in features] for r in own], float), np.array([r[label] for r in own], float)))

    def run(batches):
        for batch in batches:
            z = np.stack([batch.column(f).to_numpy(zero_copy_only=False) for f in features], 1).astype(float)
            mean = np.mean([gp_mean(z, *model) for model in kept], 0) if len(z) else np.empty(0)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(mean)], names=["id", "salience"])

    return rows.select(F.col("id").cast("long").alias("id"), *features).mapInArrow(run, "id long, salience double")


#: Cells of a relation that one block of its factors' solution holds.
CELLS = 10_000_000


def weighted_factors(counts: DataFrame, rank: int = 8, missing: float = 0.01, ridge: float = 20.0, blocks: int = 10) -> tuple[DataFrame, DataFrame]:
    """Document and word factors of a (doc, word, n) relation; observed cells weigh far more than missing ones.

    Each side is dealt to ``blocks``, of which a task holds one; first values are drawn by block.
    """
    from pyspark.ml.recommendation import ALS

    als = ALS(rank=rank, implicitPrefs=True, alpha=1 / missing, regParam=ridge / 1000, maxIter=4, userCol="doc", itemCol="word", ratingCol="n", seed=3, numUserBlocks=blocks, numItemBlocks=blocks)
    model = als.fit(counts)
    return model.userFactors, model.itemFactors


def least_squares(df: DataFrame, x: list[str], y: str, weight: str) -> DataFrame:
    """Weighted normal equations as one row of sums: xx (upper triangle by row) and xy."""
    w = F.col(weight)
    sums = [F.sum(w * F.col(a) * F.col(b)).alias(f"s_{a}_{b}") for i, a in enumerate(x) for b in x[i:]]
    return df.agg(*sums, *[F.sum(w * F.col(a) * F.col(y)).alias(f"t_{a}") for a in x])
