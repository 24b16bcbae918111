"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints that differ in at most ``2 * r`` bits have a value within ``r``
bits of both. So every distinct fingerprint emits all values within ``r`` bits
of it, one shuffle brings equal values together, and what meets there is
verified. Equal fingerprints are one node, however many documents have them,
and at most ``sum(C(64, i), i <= r)`` nodes can meet at a value.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .cluster import materialise, parquet
from .components import components
from .text import tidied

SEED = 42


def majority(h: np.ndarray) -> int:
    """The bits that over half of the 64-bit hashes have set."""
    ones = np.zeros(64, np.int64)
    for i in range(0, len(h), 1 << 14):
        ones += np.unpackbits(h[i : i + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view(np.uint64)[0])


def fingerprint_of(text: str | None, shingle: int) -> int:
    """Majority bits of the shingles' XXH64, as an unsigned integer; no words: zero."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = [0, *(ends[:-1] + 1).tolist()]
    ends = ends.tolist()
    k = min(shingle, len(words))
    digest = xxhash.xxh64_intdigest
    return majority(np.fromiter([digest(joined[a:b], SEED) for a, b in zip(starts, ends[k - 1 :], strict=False)], np.uint64, len(words) - k + 1))


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """(doc_id, fp): fp as a signed 64-bit integer."""

    def run(batches):
        for batch in batches:
            fp = np.array([fingerprint_of(x, shingle) for x in batch.column("text").to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(fp.view(np.int64))], names=["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(tidied(run), "doc_id long, fp long")


def linked(nodes: DataFrame, radius: int = 1) -> DataFrame:
    """(a, b), a < b: verified links between distinct fingerprints (column fp), enough of them to join whatever is within ``2 * radius`` bits.

    At a shared value the fingerprints are chained in order instead of paired;
    all that meet there are within ``2 * radius`` bits of each other, so a chain
    joins the same nodes.
    """
    masks = [sum(1 << b for b in bits) for r in range(radius + 1) for bits in combinations(range(64), r)]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    ball = nodes.select("fp", F.explode(F.array(*[F.lit(m).cast("long") for m in signed])).alias("mask")).select("fp", F.col("fp").bitwiseXOR(F.col("mask")).alias("value"))
    before = F.lag("fp").over(Window.partitionBy("value").orderBy("fp"))
    met = ball.select("fp", before.alias("other")).where("other is not null")
    pairs = met.select(F.col("other").alias("a"), F.col("fp").alias("b")).distinct()
    return pairs.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= 2 * radius)


def near_duplicates(docs: DataFrame, shingle: int = 3, radius: int = 1) -> DataFrame:
    """Per row of ``docs``: doc_id, fingerprint (16 hex digits), component_id and n_same (rows with that fingerprint).

    Only doc_id and text are read, whatever else ``docs`` holds. Texts without
    words have fingerprint zero and link like any other. Rows that repeat a
    doc_id each get a row. Rows without doc_id get one too; a component is named
    by its smallest doc_id that isn't null (null if there is none). An empty
    table gives no rows.
    """
    marked = materialise(fingerprints(docs, shingle))
    nodes = materialise(marked.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n_same")))
    joined = components(linked(nodes, radius))
    named = nodes.join(joined, nodes.fp == joined.node, "left").select("fp", "least", "n_same", F.coalesce("component", "fp").alias("root"))
    smallest = named.groupBy("root").agg(F.min("least").alias("component_id"))
    labels = named.join(smallest, "root").select("fp", "component_id", "n_same")
    return marked.join(labels, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "n_same")


def op7_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(parquet(spark, sf_dir, "documents"))
