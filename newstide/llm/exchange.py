"""Keyed lookups between groups of documents in two shuffles.

Documents sit in groups ``g``. A group sends each of its *distinct* 64-bit keys
once, packed in arrays, to the owner ``p`` of the key's range; the owner sees
what all groups hold of a key and replies to each group with one value per key,
in the order in which the keys were sent, so that keys never travel back. A key
that a third of all documents hold still costs one entry per group, and no
task collects the documents that share it.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cluster import groups_for

U64 = np.uint64
SENT = "p int, g int, keys binary, extra binary"
REPLY = "g int, p int, reply binary, stats array<long>"


def grouped(docs: DataFrame, groups: int, carry: dict[str, str] | None = None) -> DataFrame:
    """(g, doc_id, text) dealt to ``groups`` groups of rising doc_id: a smaller group has only smaller ids.

    Bounds are quantiles of doc_id. Rows without doc_id come after all others,
    in groups of their own by a hash of their texts.
    ``carry`` names further columns of ``docs`` to take along, and what to call them.
    """
    from pyspark.ml.feature import Bucketizer

    more = [docs[a].alias(b) for a, b in (carry or {}).items()]
    ids = docs.select(docs["doc_id"], docs["text"], *more).withColumn("at", F.coalesce(F.col("doc_id").cast("double"), F.lit(float("inf"))))
    cuts = ids.where("doc_id is not null").approxQuantile("at", [i / groups for i in range(1, groups)], 1 / (4 * groups)) if groups > 1 else []
    splits = [-float("inf"), *sorted(set(cuts)), float("inf")]
    if len(splits) > 2:
        ids = Bucketizer(splits=splits, inputCol="at", outputCol="bucket").transform(ids)
    else:
        ids = ids.withColumn("bucket", F.lit(0.0))
    nameless = groups + F.pmod(F.xxhash64("text"), F.lit(groups))
    g = F.when(F.col("doc_id").isNull(), nameless).otherwise(F.col("bucket")).cast("int")
    return ids.select(g.alias("g"), "doc_id", "text", *(carry or {}).values()).repartition(groups, "g")


def by_range(keys: np.ndarray, owners: int) -> np.ndarray:
    """The owner of each key: equal ranges of its upper half."""
    return ((keys >> U64(32)) * U64(owners) >> U64(32)).astype(np.int64)


def packed(g: int, owner: np.ndarray, owners: int, keys: np.ndarray, extra: np.ndarray | None) -> pa.RecordBatch:
    """One row per owner of a group's keys; ``owner`` must rise along them. ``extra`` goes along as it is (booleans as bits)."""
    bounds = np.searchsorted(owner, np.arange(owners + 1))
    used = np.flatnonzero(np.diff(bounds))
    cut = [slice(bounds[p], bounds[p + 1]) for p in used]
    pack = lambda x: (np.packbits(x) if x.dtype == bool else x).tobytes()
    return pa.RecordBatch.from_arrays(
        [pa.array(used, pa.int32()), pa.array([g] * len(used), pa.int32()), pa.array([keys[c].tobytes() for c in cut], pa.binary()), pa.array([b"" if extra is None else pack(extra[c]) for c in cut], pa.binary())],
        names=["p", "g", "keys", "extra"],
    )


def received(table: pa.Table, dtype: str) -> tuple[list[int], np.ndarray, np.ndarray]:
    """The groups that wrote to an owner, all their keys, and the bounds of each group's."""
    groups = table.column("g").to_pylist()
    parts = [np.frombuffer(x, dtype) for x in table.column("keys").to_pylist()]
    return groups, np.concatenate([np.empty(0, dtype), *parts]), np.cumsum([0, *map(len, parts)])


def replies(table: pa.Table) -> list[bytes]:
    """A group's replies in the order of their owners, which is the order of its keys."""
    p, blobs = table.column("p").to_numpy(), table.column("reply").to_pylist()
    return [blobs[i] for i in np.argsort(p, kind="stable")]


def bit_replies(table: pa.Table, owner: np.ndarray) -> np.ndarray:
    """Booleans for all of a group's keys."""
    p, blobs = table.column("p").to_numpy(), table.column("reply").to_pylist()
    sizes = np.bincount(owner, minlength=int(p.max()) + 1 if len(p) else 1)
    parts = [np.unpackbits(np.frombuffer(blobs[i], np.uint8), count=int(sizes[p[i]])) for i in np.argsort(p, kind="stable")]
    return np.concatenate([np.empty(0, np.uint8), *parts]).astype(bool)


def ask(sent: DataFrame, owners: int, answer: Callable[[pa.Table], pa.Table]) -> DataFrame:
    """Replies of the owners to what the groups sent."""
    return sent.repartition(owners, "p").groupBy("p").applyInArrow(answer, REPLY)


def reply_table(groups: list[int], p: int, blobs: list[bytes], stats: list[list[int]] | None = None) -> pa.Table:
    n = len(groups)
    return pa.table({"g": pa.array(groups, pa.int32()), "p": pa.array([p] * n, pa.int32()), "reply": pa.array(blobs, pa.binary()), "stats": pa.array(stats or [[]] * n, pa.list_(pa.int64()))})


def width(docs: DataFrame) -> int:
    return groups_for(docs)
