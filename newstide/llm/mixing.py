"""Mixing sources to target weights by temperature.

Weights are token shares raised to an exponent between 0 (uniform) and 1 (as
they are) and normalised; the exponent is bisected to meet a target entropy or a
limit on repetition. Weights become a token budget for each source, and the
budget whole passes over the source and a part of one: blocks of documents in
the order of a seeded permutation, the last block cut within.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .cluster import materialise, parquet

WORDS = r"[^\x20\x09-\x0D]+"


@dataclass(frozen=True)
class Settings:
    #: No source is seen more often than this.
    max_repeats: float = 2.0
    #: Entropy of the weights to reach, as a share of the uniform weights' entropy; the repetition limit goes first.
    entropy_share: float = 0.98
    #: Each source's permutation has 2 ** bits blocks.
    bits: int = 12
    seed: int = 42
    #: Exponents tried at once, and how often the interval is narrowed.
    sections: int = 32
    rounds: int = 5
    #: Up to so many sources the plan, a row each, is broadcast; beyond it is joined by shuffle.
    broadcast_sources: int = 10_000


def exponent(totals: DataFrame, s: Settings) -> float:
    """The largest exponent whose weights reach the target entropy, but none that repeats a source more than allowed.

    ``totals`` has a row (tokens) for each source; only sums over it come to the driver.
    """
    whole, low, high, n = totals.where("tokens > 0").agg(F.sum("tokens"), F.min("tokens"), F.max("tokens"), F.count("*")).first()
    if not n or low == high:
        return 1.0
    share = totals.where("tokens > 0").select((F.col("tokens") / F.lit(float(whole))).alias("p"))
    # repeats of the rarest source relative to one pass over the most common: (high / low) ** (1 - a)
    a, b = 0.0, 1.0
    for _ in range(60):
        mid = (a + b) / 2
        a, b = (a, mid) if (1 - mid) * math.log(high / low) <= math.log(s.max_repeats) else (mid, b)
    limit = b
    goal, a, b = s.entropy_share * math.log(n), 0.0, 1.0
    for _ in range(s.rounds):
        tried = [a + (b - a) * k / s.sections for k in range(s.sections + 1)]
        sums = share.agg(*[f for k, x in enumerate(tried) for f in (F.sum(F.pow("p", F.lit(x))).alias(f"z{k}"), F.sum(F.pow("p", F.lit(x)) * F.log("p")).alias(f"l{k}"))]).first()
        entropy = [math.log(sums[f"z{k}"]) - x * sums[f"l{k}"] / sums[f"z{k}"] for k, x in enumerate(tried)]
        reached = [k for k, h in enumerate(entropy) if h >= goal]
        if not reached:
            a = b = 0.0
            break
        k = max(reached)
        a, b = tried[k], tried[min(k + 1, s.sections)]
    return max(limit, a)


def plan(marked: DataFrame, s: Settings) -> DataFrame:
    """Per source: weight, repeats, whole passes, and where the part of a pass ends (block, and last place within it).

    The budget is the smallest for which no source gets less than one pass, so
    that no document is lost.
    """
    blocks = materialise(marked.groupBy("source", "block").agg(F.sum("n_tokens").alias("tokens")))
    totals = materialise(blocks.groupBy("source").agg(F.sum("tokens").alias("tokens")))
    a = exponent(totals, s)
    z, top, whole = totals.where("tokens > 0").agg(F.sum(F.pow(F.col("tokens").cast("double"), F.lit(a))), F.max("tokens"), F.sum("tokens")).first()
    top = float(top or 1)
    per = totals.select(
        "source",
        F.col("tokens").alias("source_tokens"),
        F.when(F.col("tokens") > 0, F.pow(F.col("tokens").cast("double"), F.lit(a)) / F.lit(float(z or 1))).otherwise(0.0).alias("weight"),
        F.when(F.col("tokens") > 0, F.pow(F.lit(top) / F.col("tokens"), F.lit(1 - a))).otherwise(1.0).alias("repeats"),
    )
    per = per.withColumn("passes", F.floor(F.col("repeats") + 1e-9).cast("int")).withColumn("rest", F.greatest(F.col("source_tokens") * (F.col("repeats") - F.col("passes")), F.lit(0.0)))
    run = blocks.withColumn("before", F.sum("tokens").over(Window.partitionBy("source").orderBy("block")) - F.col("tokens")).withColumnRenamed("source", "of")
    # the block in which the rest ends
    cut = per.join(run, F.col("source").eqNullSafe(F.col("of"))).where("before < rest and rest <= before + tokens").select("source", F.col("block").alias("cut"), (F.col("rest") - F.col("before")).alias("room"))
    inside = marked.join(cut.select(F.col("source").alias("of"), "cut", "room"), F.col("source").eqNullSafe(F.col("of")) & (F.col("block") == F.col("cut")))
    before = F.sum("n_tokens").over(Window.partitionBy("source", "block").orderBy("place").rangeBetween(Window.unboundedPreceding, 0))
    last = inside.withColumn("upto", before).where(F.col("upto") - F.col("n_tokens") / 2 <= F.col("room")).groupBy("source").agg(F.max("place").alias("last"))
    ends = cut.alias("c").join(last.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of")), "left").select(F.col("source").alias("of"), "cut", "last")
    return per.join(ends, F.col("source").eqNullSafe(F.col("of")), "left").drop("of")


def _placed(docs: DataFrame, s: Settings) -> DataFrame:
    place = F.xxhash64("doc_id", F.lit(s.seed))
    return docs.withColumns({"place": place, "block": F.shiftrightunsigned(place, 64 - s.bits).cast("int")})


def _copies() -> F.Column:
    part = (F.col("block") < F.col("cut")) | ((F.col("block") == F.col("cut")) & (F.col("place") <= F.col("last")))
    return (F.col("passes") + F.when(F.coalesce(part, F.lit(False)), 1).otherwise(0)).cast("int")


def _with_plan(placed: DataFrame, by_source: DataFrame, s: Settings) -> DataFrame:
    named = by_source.withColumnRenamed("source", "plan_source")
    small = by_source.count() <= s.broadcast_sources
    return placed.join(F.broadcast(named) if small else named, placed.source.eqNullSafe(named.plan_source))


def mix(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """Per row of ``docs``: doc_id, source, n_tokens, its source's weight and repeats, block, copies, and an order key for each copy.

    Only doc_id, text and source are read. Sorting all copies by order key
    gives the mixed stream: pass after pass, blocks in a new permutation each
    pass. Null and empty texts have no tokens; a source without tokens is passed
    once with weight 0. A null source is a source. Repeated rows, and rows
    without doc_id, share a place and are cut together. An empty table gives no
    rows.
    """
    marked = materialise(_placed(docs.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORDS)), F.lit(0)).cast("long").alias("n_tokens")), s))
    found = _with_plan(marked, materialise(plan(marked, s)), s).withColumn("copies", _copies())
    wide = float(1 << 32)
    key = lambda e: e + (F.pmod(F.xxhash64("source", "block", e), F.lit(1 << 32)) + F.pmod(F.xxhash64("place", e), F.lit(1 << 20)) / float(1 << 20)) / wide
    return found.select("doc_id", "source", "n_tokens", "weight", "repeats", "block", "copies", F.transform(F.sequence(F.lit(0), F.col("copies") - 1), key).alias("order_keys"))


def mixed(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """The rows of ``docs``, with all their columns, each as often as the mixture has it (once or more).

    A table of rows has no order; ``mix`` gives the order keys of the stream.
    Null and empty texts count no tokens and stay; a null source is a source;
    rows that repeat a doc_id, and rows without one, each stay. No name in
    ``docs`` clashes, since rows travel whole. An empty table stays empty.
    """
    marked = materialise(_placed(docs.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORDS)), F.lit(0)).cast("long").alias("n_tokens")), s))
    by_source = materialise(plan(marked, s))
    keep = F.struct(*[docs[c] for c in docs.columns])
    rows = _placed(docs.select(keep.alias("row"), "doc_id", "source"), s)
    found = _with_plan(rows, by_source, s)
    return found.select("row", F.explode(F.sequence(F.lit(1), _copies()))).select("row.*")


def op9_temperature_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(parquet(spark, sf_dir, "documents"))
