"""Packing documents into fixed-length token sequences by minimum bin slack.

Only how many pieces have each length matters for the plan, and there are at
most ``capacity`` lengths. The plan therefore works on counts on the driver: a
bin starts with the longest length left, subset-sum dynamic programming over
the lengths left (one bit per sum) finds the fullest combination with it, and
that combination is removed as often as the counts allow. Pieces then find
their place from their rank among the pieces of their length.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .cluster import materialise, parquet
from .text import tidied
from .tokens import encoder

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
RESULT = PIECES + ", sequence_id long, offset long"
END_ID = 0
#: The vocabulary's added token, which its tokenizer never spells out.
ADDED = (b"<|endoftext|>", 50256)


def pieces_of(docs: DataFrame, ranks: str, capacity: int) -> DataFrame:
    """Per piece of a document: its place in the document's ids and their checksum. The first piece takes the remainder."""

    def run(batches):
        enc = encoder(ranks, ADDED)
        for batch in batches:
            docs_out, nth, start, length, crc = [], [], [], [], []
            ids_in = batch.column("doc_id").to_pylist()
            for i, j, ids, rows in enc.column(batch.column("text")):
                for d in range(i, j):
                    own = np.append(ids[rows[d - i] : rows[d - i + 1]], np.uint32(END_ID)).astype("<u4")
                    n = -(-len(own) // capacity)
                    cut = [0, *range(len(own) - capacity * (n - 1), len(own) + 1, capacity)]
                    for k, (a, b) in enumerate(zip(cut, cut[1:], strict=False)):
                        docs_out.append(ids_in[d])
                        nth.append(k)
                        start.append(a)
                        length.append(b - a)
                        crc.append(zlib.crc32(own[a:b].tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(docs_out, pa.int64()), pa.array(nth, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(tidied(run), PIECES)


def fullest(counts: dict[int, int], room: int) -> dict[int, int]:
    """The combination of available lengths (length: how many) with the largest sum of at most ``room``."""
    mask, reach, seen = (1 << (room + 1)) - 1, 1, []
    for size in sorted((s for s in counts if s <= room and counts[s] > 0), reverse=True):
        left, step = min(counts[size], room // size), 1
        before = reach
        while left:  # binary splitting of the multiplicity
            take = min(step, left)
            reach |= (reach << (take * size)) & mask
            left, step = left - take, step * 2
        seen.append((size, before))
        if reach >> room & 1:
            break
    goal, out = reach.bit_length() - 1, {}
    for size, before in reversed(seen):
        n = 0
        while not before >> goal & 1:
            goal, n = goal - size, n + 1
        if n:
            out[size] = n
    return out


def plan(counts: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """Bins as (combination, how many bins of it), until nothing is left."""
    left, out = {s: n for s, n in counts.items() if n > 0}, []
    while left:
        longest = max(left)
        left[longest] -= 1
        combo = fullest(left, capacity - longest)
        left[longest] += 1
        combo[longest] = combo.get(longest, 0) + 1
        times = min(left[s] // n for s, n in combo.items())
        for s, n in combo.items():
            left[s] -= times * n
            if not left[s]:
                del left[s]
        out.append((combo, times))
    return out


def _slots(bins: list[tuple[dict[int, int], int]]) -> dict[int, tuple[np.ndarray, ...]]:
    """By length: first rank, first sequence, pieces a sequence and first offset of each use of that length, by rising rank."""
    rows: dict[int, list] = {}
    used: dict[int, int] = {}
    sequence = 0
    for combo, times in bins:
        offset = 0
        for size, n in sorted(combo.items(), reverse=True):
            rows.setdefault(size, []).append((used.get(size, 0), sequence, n, offset))
            used[size] = used.get(size, 0) + times * n
            offset += size * n
        sequence += times
    return {s: tuple(np.array(c, np.int64) for c in zip(*x, strict=True)) for s, x in rows.items()}


def pack(docs: DataFrame, ranks: str, capacity: int = 2048) -> DataFrame:
    """Per piece of every document its sequence and the place there.

    ``docs`` needs doc_id and text; other columns are ignored. A document is its
    ids and one end id, so null and empty texts are one token; only documents
    longer than ``capacity`` are cut. Repeated rows are packed as often as they
    occur. Rows without doc_id are packed too. A literal ``<|endoftext|>`` in a
    text is the vocabulary's one id for it. Very long texts are many pieces.
    An empty table gives no rows.
    """
    spark = docs.sparkSession
    pieces = materialise(pieces_of(docs, ranks, capacity))
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    spread = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)).cast("int"))
    held = spread.groupBy("length", "bucket").count()
    slots = _slots(plan({r.length: r.n for r in held.groupBy("length").agg(F.sum("count").alias("n")).collect()}, capacity))
    before = held.select("length", "bucket", (F.sum("count").over(Window.partitionBy("length").orderBy("bucket")) - F.col("count")).alias("base"))
    ranked = spread.withColumn("nth", F.row_number().over(Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "start", "ids_crc32")))
    placed = ranked.join(before, ["length", "bucket"]).select(*pieces.columns, (F.col("base") + F.col("nth") - 1).alias("rank"))

    def place(batches):
        for batch in batches:
            size, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            sequence, offset = np.zeros(len(size), np.int64), np.zeros(len(size), np.int64)
            order = np.argsort(size, kind="stable")
            cut = np.flatnonzero(np.diff(size[order])) + 1
            for rows in np.split(order, cut) if len(order) else ():
                first, seq, n, off = slots[int(size[rows[0]])]
                use = np.searchsorted(first, rank[rows], "right") - 1
                within = rank[rows] - first[use]
                sequence[rows] = seq[use] + within // n[use]
                offset[rows] = off[use] + within % n[use] * size[rows]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(sequence), pa.array(offset)], names=[*batch.schema.names[:-1], "sequence_id", "offset"])

    return placed.mapInArrow(tidied(place), RESULT)


def ranks_path() -> str:
    """The ranks of the vocabulary in ``byte_bpe_50k.json``."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def op4_minimum_bin_slack_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(parquet(spark, sf_dir, "documents"), ranks_path())
