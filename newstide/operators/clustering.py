"""Clustering and order-dependent selection, by group.

These depend on the order of a topic's rows, so each group is one Arrow call;
groups are topics or (topic, interval) buckets, whose size the caller bounds by
its choice of interval.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def unit_rows(x: np.ndarray) -> np.ndarray:
    n = np.sqrt((x * x).sum(1, keepdims=True))
    return x / np.where(n > 0, n, 1)


#: Cells of a matrix that are passed messages at once: a strip of rows that stays in a processor's cache.
STRIP_CELLS = 1 << 17


def affinity_propagation(s: np.ndarray, preference: np.ndarray | float, damping: float = 0.7, most: int = 100, patience: int = 15) -> np.ndarray:
    """Exemplar of each point (Frey and Dueck, 2007); ties are broken by a seeded perturbation, and an
    unconverged run falls back to the point with the largest preference.

    Messages are passed a strip of rows at a time, an availability when its strip is next at hand."""
    n = len(s)
    if n < 2:
        return np.arange(n)
    s = s.astype(float).copy()
    np.fill_diagonal(s, preference)
    s += np.random.default_rng(0).normal(size=s.shape) * (np.finfo(float).eps * np.abs(s) + 1e-12)
    r, a, adiag = np.zeros((n, n)), np.zeros((n, n)), np.zeros(n)
    step = max(1, STRIP_CELLS // n)
    buffer, total, last, same = np.empty((step + 1, n)), None, None, 0
    for _ in range(most):
        sums = None
        for i in range(0, n, step):
            mine, avail, resp = s[i : i + step], a[i : i + step], r[i : i + step]
            rows = np.arange(len(mine))
            own, x = (rows, rows + i), buffer[1 : len(mine) + 1]
            if total is not None:  # the last round's availabilities, while the strip is at hand
                np.maximum(resp, 0, out=x)
                x[own] = resp[own]
                np.subtract(total, x, out=x)
                diagonal = x[own]
                np.minimum(x, 0, out=x)
                x[own] = diagonal
                avail *= damping
                x *= 1 - damping
                avail += x
            np.add(avail, mine, out=x)
            best = x.argmax(1)
            first = x[rows, best]
            x[rows, best] = -np.inf
            second = x.max(1)
            np.subtract(mine, first[:, None], out=x)
            x[rows, best] = mine[rows, best] - second
            resp *= damping
            x *= 1 - damping
            resp += x
            np.maximum(resp, 0, out=x)
            x[own] = resp[own]
            if sums is None:
                sums = x.sum(0)
            else:  # one row after the other, as a sum over all of them
                buffer[0] = sums
                sums = buffer[: len(mine) + 1].sum(0)
        total, rdiag = sums, r.diagonal()
        adiag = damping * adiag + (1 - damping) * (total - rdiag)
        chosen = (adiag + rdiag) > 0
        same = same + 1 if last is not None and (chosen == last).all() else 0
        last = chosen
        if same >= patience and chosen.any():
            break
    exemplars = np.flatnonzero(last)
    if not len(exemplars):
        return np.full(n, int(np.argmax(np.broadcast_to(preference, n))))
    owner = exemplars[s[:, exemplars].argmax(1)]
    owner[exemplars] = exemplars
    return owner


def by_group(df: DataFrame, keys: list[str], order: list[str], f: Callable[[pa.Table], dict[str, np.ndarray | list]], schema: str) -> DataFrame:
    """``f`` over each group's rows in order; it returns columns, and the keys are put before them."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([(c, "ascending") for c in order])
        out = f(table)
        n = len(next(iter(out.values())))
        lead = {k: pa.array([table.column(k)[0].as_py()] * n, table.schema.field(k).type) for k in keys}
        return pa.table(lead | {k: v if isinstance(v, pa.ChunkedArray) else pa.array(list(v)) if len(v) else pa.array([], pa.null()) for k, v in out.items()}).cast(arrow)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    arrow = to_arrow_schema(_parse_datatype_string(schema))
    return df.groupBy(*keys).applyInArrow(run, schema)


#: Dimensions of the vectors made of ``bins``.
WIDTH = 64


def vectors(table: pa.Table, column: str = "vector") -> np.ndarray:
    """A row a vector; tables with ``bins`` (a list of dimensions for each row) are counted into vectors."""
    if "bins" in table.column_names:
        lists = table.column("bins").combine_chunks()
        row = np.repeat(np.arange(len(lists)), lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
        at = row * WIDTH + lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        return np.bincount(at, minlength=len(lists) * WIDTH).astype(float).reshape(len(lists), WIDTH)
    rows = table.column(column).to_pylist()
    return np.array(rows, float).reshape(len(rows), -1)


def linkage_clusters(df: DataFrame, keys: list[str], similarity: float, carry: list[str] = []) -> DataFrame:
    """Single-linkage clusters of each group cut at a cosine: keys, the id nearest its cluster's centroid, cluster size, and what columns of that row to ``carry`` along."""
    kinds = dict(df.dtypes)

    def f(table: pa.Table):
        x, ids = unit_rows(vectors(table)), table.column("id").to_pylist()
        name = np.arange(len(x))
        near = x @ x.T >= similarity
        while True:
            then = np.where(near, name[None, :], len(x)).min(1)
            then = np.minimum(then, name)
            if (then == name).all():
                break
            name = then
        lead, size = [], []
        for c in np.unique(name):
            rows = np.flatnonzero(name == c)
            far = ((x[rows] - x[rows].mean(0)) ** 2).sum(1)
            lead.append(rows[int(np.argmin(far.round(9)))])
            size.append(len(rows))
        return {"id": [ids[k] for k in lead], "cluster_size": size} | {c: table.column(c).take(pa.array(lead, pa.int64())) for c in carry}

    column = "bins" if "bins" in df.columns else "vector"
    schema = ", ".join(f"{k} {kinds[k]}" for k in keys) + f", id {kinds['id']}, cluster_size long" + "".join(f", {c} {kinds[c]}" for c in carry)
    return by_group(df.select(*dict.fromkeys([*keys, "id", column, *carry])), keys, ["id"], f, schema)


def carried_buckets(counts: list[int]) -> list[int]:
    """The bucket of each interval where one with at most a row waits for the next; -1 for rows never reached."""
    out, held, bucket = [], [], 0
    rows = 0
    for n in counts:
        held.append(len(out))
        out.append(-1)
        rows += n
        if rows > 1:
            for k in held:
                out[k] = bucket
            held, rows, bucket = [], 0, bucket + 1
    return out


def carry_over(df: DataFrame, keys: list[str], interval: str) -> DataFrame:
    """(keys, interval, bucket): intervals of at most one row join the next one."""
    kinds = dict(df.dtypes)
    counts = df.groupBy(*keys, interval).agg(F.count("*").alias("n"))

    def f(table: pa.Table):
        at = table.column(interval).to_pylist()
        return {interval: at, "bucket": carried_buckets(table.column("n").to_pylist())}

    return by_group(counts, keys, [interval], f, ", ".join(f"{k} {kinds[k]}" for k in [*keys, interval]) + ", bucket long")


def single_linkage(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, cluster): the smallest id each node reaches over edges (a, b); labels move by star rounds."""
    from .components import components

    found = components(edges.select("a", "b"))
    return nodes.select("id").join(found, F.col("id") == F.col("node"), "left").select("id", F.coalesce("component", "id").alias("cluster"))


def greedy_cover(sets: list[set], budget: int) -> list[tuple[int, int]]:
    """(position, gain) of up to ``budget`` sets, each with the most that is new; the first of equals."""
    seen: set = set()
    out = []
    for _ in range(budget):
        gains = [len(s - seen) for s in sets]
        k = int(np.argmax(gains)) if gains else 0
        if not gains or not gains[k]:
            break
        out.append((k, gains[k]))
        seen |= sets[k]
    return out
