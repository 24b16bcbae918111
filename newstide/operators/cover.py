"""Covers of facts by sentences, for all topics at once: picks and rounds are joins, no topic is one task.

Rows are (topic, epoch, doc_id, sent_id, update_id, nugget), a row for each fact
that a sentence carries; the first five columns name a sentence and order it.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.readers import scratch
from .clustering import by_group, greedy_cover
from .components import _dropped, written
from .ordered import cumulative
from .selection import _union

SENTENCE = ["topic", "epoch", "doc_id", "sent_id", "update_id"]


def _distinct(rows: DataFrame) -> DataFrame:
    """Each fact of a sentence once, written; topics go as structs, so that joins keep one without a name."""
    scratch(rows.sparkSession, "")
    return written(rows.select(F.struct("topic").alias("topic"), *SENTENCE[1:], "nugget").distinct())


def _named(rows: DataFrame) -> DataFrame:
    return rows.withColumn("topic", F.col("topic.topic"))


def best_sentences(rows: DataFrame, by: list[str]) -> DataFrame:
    """(by, gain, update_id): the sentence with the most facts among those with the same ``by``; the first of equals."""
    gains = rows.groupBy(*SENTENCE).agg(F.count("*").alias("gain"))
    rest = [c for c in SENTENCE if c not in by]
    best = gains.groupBy(*by).agg(F.min(F.struct((-F.col("gain")).alias("less"), *rest)).alias("x"))
    return best.select(*by, (-F.col("x.less")).alias("gain"), "x.update_id")


def cover(rows: DataFrame, budget: int) -> DataFrame:
    """(topic, step, update_id, gain): the greedy cover of each topic's facts, at most ``budget`` sentences of it.

    A step takes in every topic the sentence with the most facts that are left,
    and takes them away from all others; it ends when no topic has any left.
    """
    left, picks = _distinct(rows), []
    for step in range(1, budget + 1):
        if left.isEmpty():
            break
        pick = written(best_sentences(left, ["topic"]).withColumn("step", F.lit(step).cast("long")))
        known = left.join(pick.select("update_id"), "update_id", "left_semi").select("topic", "nugget").distinct()
        before, left = left, written(left.join(known, ["topic", "nugget"], "left_anti"))
        _dropped(before)
        picks.append(pick.select("topic", "step", "update_id", "gain"))
    return _named(_union(picks) if picks else left.select("topic", F.lit(0).cast("long").alias("step"), "update_id", F.lit(0).cast("long").alias("gain")))


def streamed_cover(rows: DataFrame, budget: int) -> DataFrame:
    """(topic, doc_id, picked, covered, bound): documents in time, each picking greedily what is new until the topic's budget is spent.

    A document that may pick all it wants covers all that it has, so what is new
    in it are the facts that no earlier document has: documents are covered each
    for itself, and the budget is a running sum over them. ``covered`` counts the
    topic's facts known after the document, ``bound`` all that there are.
    """
    rows = _distinct(rows)
    first = rows.groupBy("topic", "nugget").agg(F.min(F.struct("epoch", "doc_id")).alias("first"))
    new = rows.join(first, ["topic", "nugget"]).where((F.col("first.epoch") == F.col("epoch")) & (F.col("first.doc_id") == F.col("doc_id")))
    sets = new.groupBy(*SENTENCE).agg(F.array_sort(F.collect_set("nugget")).alias("nuggets"))

    def gains(table: pa.Table) -> dict:
        return {"gains": [[g for _, g in greedy_cover([set(x) for x in table.column("nuggets").to_pylist()], budget)]]}

    kind = dict(rows.dtypes)
    found = by_group(sets, ["topic", "epoch", "doc_id"], ["sent_id"], gains, f"topic {kind['topic']}, epoch {kind['epoch']}, doc_id {kind['doc_id']}, gains array<long>")
    docs = rows.select("topic", "epoch", "doc_id").distinct().join(found, ["topic", "epoch", "doc_id"], "left").withColumn("gains", F.coalesce("gains", F.array().cast("array<long>")))
    spent = cumulative(docs.withColumn("hour", F.floor(F.col("epoch") / 3600)), ["topic"], "hour", ["epoch", "doc_id"], {"spent": F.size("gains")})
    room = F.greatest(F.lit(0), F.lit(budget) - F.col("spent") + F.size("gains"))
    spent = spent.withColumn("picked", F.least(F.size("gains"), room).cast("long"))
    spent = spent.withColumn("gain", F.aggregate(F.slice("gains", F.lit(1), F.col("picked").cast("int")), F.lit(0).cast("long"), lambda s, g: s + g))
    covered = cumulative(spent, ["topic"], "hour", ["epoch", "doc_id"], {"covered": "gain"})
    bound = first.groupBy("topic").agg(F.count("*").alias("bound"))
    return _named(covered.join(bound, "topic").select("topic", "doc_id", "picked", "covered", "bound"))


def step_choices(rows: DataFrame) -> tuple[DataFrame, int]:
    """(topic, doc_id, action, gain, loss), and the number of rounds: documents in time, each choosing the sentence with the most that is new, or NEXT where nothing is.

    What a document doesn't choose stays new for later ones; ``loss`` is what
    else was new in it. A round decides all documents that for none of their
    facts that are still new wait for an earlier one; what they choose is taken
    away from the others.
    """
    every = _distinct(rows)
    left, decided, rounds = every, [], 0
    while not left.isEmpty():
        ahead = left.groupBy("topic", "nugget").agg(F.min(F.struct("epoch", "doc_id")).alias("first"))
        waits = left.join(ahead, ["topic", "nugget"]).where(F.struct("epoch", "doc_id") != F.col("first")).select("topic", "doc_id").distinct()
        ready = left.join(waits, ["topic", "doc_id"], "left_anti")
        best = best_sentences(ready, ["topic", "doc_id"]).join(ready.groupBy("topic", "doc_id").agg(F.countDistinct("nugget").alias("new")), ["topic", "doc_id"])
        chosen = written(best.select("topic", "doc_id", F.col("update_id").alias("action"), "gain", (F.col("new") - F.col("gain")).alias("loss")))
        known = left.join(chosen.select(F.col("action").alias("update_id")), "update_id", "left_semi").select("topic", "nugget").distinct()
        before, left = left, written(left.join(chosen, ["topic", "doc_id"], "left_anti").join(known, ["topic", "nugget"], "left_anti"))
        if before is not every:
            _dropped(before)
        decided.append(chosen)
        rounds += 1
        if len(decided) == 16:  # a plan of bounded size
            decided = [written(_union(decided))]
    zero = F.lit(0).cast("long")
    docs = every.select("topic", "doc_id").distinct()
    some = _union(decided) if decided else docs.select("topic", "doc_id", F.lit("NEXT").alias("action"), zero.alias("gain"), zero.alias("loss"))
    rest = docs.join(some, ["topic", "doc_id"], "left_anti").select("topic", "doc_id", F.lit("NEXT").alias("action"), zero.alias("gain"), zero.alias("loss"))
    return _named(some.unionByName(rest)), rounds
