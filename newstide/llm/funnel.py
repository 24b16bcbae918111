"""Ordered funnels: how far each client's attempts get, and how long each step takes.

A client's time is cut into cells. Grouped Arrow-backed pandas calls hold the
per-kind sorted times of many cells at once, as one ``int64`` array a kind in
which cells are far apart, and chain all attempts of all cells step by step with
``searchsorted``. A step that leaves its cell can only reach the first row of its
kind in a later one, so a cell needs no more of the later cells than those rows,
and every attempt that leaves goes on from there as any other does: the walk
from such a row is done once, in its own cell, and joined to the number of
attempts that arrive. So a group is bounded by what one client does within a
cell, whatever else it holds, and neither a client nor a span of time is ever
one task. Percentiles are selected among the distinct times of one bucket.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .cluster import materialise, parquet

SECOND = 1_000_000
#: Rows that a grouped call holds on average.
GROUP_ROWS = 100_000


@dataclass(frozen=True)
class Funnel:
    name: str
    steps: tuple[str, ...]
    excluded: tuple[str, ...] = ()


FUNNELS = (
    Funnel("A", ("view", "click", "view", "purchase"), ("error",)),
    Funnel("B", ("signup", "view", "click", "purchase"), ("error",)),
    Funnel("C", ("click", "click", "purchase", "view"), ("signup",)),
)


def microseconds(ts) -> F.Column:
    """Microseconds since 1970 of a timestamp's own date and time of day, whatever the session's zone."""
    t = F.col(ts)
    return (F.unix_date(t.cast("date")).cast("long") * 86_400 + F.hour(t) * 3600 + F.minute(t) * 60) * SECOND + (F.expr(f"extract(SECOND FROM `{ts}`)") * SECOND).cast("long")


def walk(at: np.ndarray, first: int, funnel: Funnel, times: dict[str, np.ndarray], limit: int, span: int, cell: int):
    """Rows at ``at``, which stand at step ``first``, moved on: yields (step, which of them reach it, time taken, where).

    ``times`` are the sorted places of each kind, ``span`` apart from cell to
    cell. A row whose step lies beyond its cell isn't moved further.
    """
    bar = np.sort(np.concatenate([times[k] for k in funnel.excluded])) if funnel.excluded else np.empty(0, np.int64)
    never = np.iinfo(np.int64).max
    which = np.arange(len(at))
    for step in range(first + 1, len(funnel.steps)):
        after = np.append(times[funnel.steps[step]], never)
        then = after[np.searchsorted(after, at, "right").clip(max=len(after) - 1)]
        stop = np.append(bar, never)[np.searchsorted(bar, at, "right")]
        reached = (then - at <= limit) & (then < stop)
        which, taken, at = which[reached], (then - at)[reached], then[reached]
        if not len(which):
            return
        yield step, which, taken, at
        inside = at % span < cell
        which, at = which[inside], at[inside]


def _group(rows: pd.DataFrame, kinds: list[str], funnels: tuple[Funnel, ...], limit: int, cell: int) -> pd.DataFrame:
    """All cells of one group: attempts (start 0), and the walks from each cell's first rows at later steps (start > 0)."""
    client, place, kind, at = (rows[c].to_numpy() for c in ("client", "cell", "kind", "at"))
    order = np.lexsort((at, place, client))
    client, place, kind, at = client[order], place[order], kind[order], at[order]
    new = np.append(True, (client[1:] != client[:-1]) | (place[1:] != place[:-1]))
    span = cell + limit + 1
    key = (np.cumsum(new) - 1) * span + at
    client, place = client[new], place[new]
    times = {name: key[kind == k] for k, name in enumerate(kinds)}
    own = {name: x[x % span < cell] for name, x in times.items()}
    out = []

    def add(start, step, of, n, taken=-1, to=None):
        out.append(pd.DataFrame({"client": client[of], "cell": place[of], "funnel": f, "start": start, "step": step, "taken": taken, "crossed": False if to is None else to != place[of], "to": 0 if to is None else to, "n": n}))

    for f, funnel in enumerate(funnels):
        for start in range(len(funnel.steps) - 1):
            begin = own[funnel.steps[start]]
            if start:
                _, head = np.unique(begin // span, return_index=True)
                begin = begin[head]
                begin = begin[begin % span < limit]  # nothing from an earlier cell reaches the others
            else:
                of, n = np.unique(begin // span, return_counts=True)
                add(0, 0, of, n)
            for step, which, taken, then in walk(begin, start, funnel, times, limit, span, cell):
                of = begin[which] // span
                add(start, step, of, 1, taken, place[of] + then % span // cell)
    return pd.concat(out, ignore_index=True)


def nth_smallest(values: np.ndarray, counts: np.ndarray, n: int) -> int:
    """The n-th smallest (from 1) of distinct values that occur ``counts`` times, by halving partitions."""
    while len(values) > 1:
        middle = (len(values) - 1) // 2
        low = values <= np.partition(values, middle)[middle]
        below = int(counts[low].sum())
        if n > below:
            n, low = n - below, ~low
        values, counts = values[low], counts[low]
    return int(values[0])


def _select(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values(["client", "funnel", "step"], kind="stable")
    keys = rows[["client", "funnel", "step"]].to_numpy()
    begin = np.flatnonzero(np.append(True, (keys[1:] != keys[:-1]).any(1)))
    values, counts, rank = rows["taken"].to_numpy(), rows["n"].to_numpy(), rows["rank"].to_numpy()
    out = rows.iloc[begin][["client", "funnel", "step"]].copy()
    out["taken"] = [nth_smallest(values[a:b], counts[a:b], int(rank[a])) for a, b in zip(begin, [*begin[1:], len(rows)], strict=True)]
    return out


def funnels(clicks: DataFrame, wanted: tuple[Funnel, ...] = FUNNELS, limit: int = 900 * SECOND, percent: int = 50, cell: int = 900 * SECOND) -> DataFrame:
    """Per funnel and client with an attempt: funnel, client_id, n (attempts that reach each step), deepest (the last
    step that any reaches, from 1), taken (for each step after the first the ``percent``-th percentile of the
    microseconds since the step before, nearest rank; null if no attempt reaches it), same_depth (clients of that funnel and depth).

    ``clicks`` has client_id, kind and ts; other columns are not read. Rows that
    hold null in any of the three, and rows that repeat all three, don't count.
    Every row of a funnel's first kind starts an attempt. The next step is the
    client's earliest row of its kind that is later; the attempt ends if that is
    more than ``limit`` after, or if an excluded row is after the step and not
    after the next. Rows of two kinds at the same time are not after each other.
    An empty table gives no rows. ``cell`` bounds what a group must hold of one
    client: its distinct rows within that time. It may be any length, shorter
    for clients with millions of rows a minute; results don't depend on it.
    """
    spark = clicks.sparkSession
    kinds = sorted({k for f in wanted for k in (*f.steps, *f.excluded)})
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    groups = max(4 * width, math.ceil(clicks.count() / GROUP_ROWS))
    code = F.array_position(F.array(*[F.lit(k) for k in kinds]), F.col("kind")).cast("int") - 1
    some = clicks.where(F.col("kind").isin(kinds) & F.col("client_id").isNotNull() & F.col("ts").isNotNull())
    rows = some.select(F.col("client_id").cast("long").alias("client"), code.alias("kind"), microseconds("ts").alias("us")).distinct()
    rows = rows.withColumn("at", F.pmod("us", F.lit(cell))).withColumn("cell", ((F.col("us") - F.col("at")) / cell).cast("long"))
    ahead = rows.groupBy("client", "cell", "kind").agg(F.min("at").alias("at"))
    ahead = ahead.withColumn("back", F.explode(F.sequence(F.lit(1), F.lit(math.ceil(limit / cell)))))
    ahead = ahead.select("client", "kind", (F.col("cell") - F.col("back")).alias("cell"), (F.col("at") + F.col("back") * cell).alias("at")).where(F.col("at") < cell + limit)
    both = rows.select("client", "kind", "cell", "at").unionByName(ahead).withColumn("group", F.pmod(F.xxhash64("client", "cell"), F.lit(groups)))
    walked = both.groupBy("group").applyInPandas(lambda part: _group(part, kinds, wanted, limit, cell), "client long, cell long, funnel int, start int, step int, taken long, crossed boolean, to long, n long")
    walked = materialise(walked)

    attempts = walked.where("start = 0")
    onward = walked.where("start > 0").drop("n")
    steps = [attempts.where("step > 0")]
    for _ in range(max(len(f.steps) for f in wanted) - 2):  # an arrival leaves its cell again at a later step
        arrivals = steps[-1].where("crossed").groupBy("client", F.col("to").alias("cell"), "funnel", F.col("step").alias("start")).agg(F.sum("n").alias("n"))
        steps.append(onward.join(arrivals, ["client", "cell", "funnel", "start"]))
    key = ["client", "funnel", "step"]
    taken = steps[0].select(*key, "taken", "n")
    for more in steps[1:]:
        taken = taken.unionByName(more.select(*key, "taken", "n"))
    taken = materialise(taken.groupBy(*key, "taken").agg(F.sum("n").alias("n")))

    bucket = F.floor(F.col("taken") / max(1, limit // 900))
    counts = taken.groupBy(*key, bucket.alias("bucket")).agg(F.sum("n").alias("here"))  # about 900 a step of a client at most
    every = Window.partitionBy(*key)
    upto = F.sum("here").over(every.orderBy("bucket"))
    rank = F.ceil(F.sum("here").over(every) * percent / 100)
    ranked = counts.select(*key, "bucket", (upto - F.col("here")).alias("before"), upto.alias("upto"), rank.alias("rank"), F.sum("here").over(every).alias("reached"))
    place = ranked.where("before < rank and rank <= upto").select(*key, "bucket", (F.col("rank") - F.col("before")).alias("rank"), "reached")
    near = taken.withColumn("bucket", bucket).join(place, [*key, "bucket"]).withColumn("group", F.pmod(F.xxhash64(*key), F.lit(groups)))
    chosen = near.groupBy("group").applyInPandas(_select, "client long, funnel int, step int, taken long")
    facts = attempts.where("step = 0").select(*key, "n", F.lit(None).cast("long").alias("taken"))
    facts = facts.unionByName(place.select(*key, F.col("reached").alias("n"), F.lit(None).cast("long").alias("taken")))
    facts = facts.unionByName(chosen.select(*key, F.lit(None).cast("long").alias("n"), "taken"))
    most = max(len(f.steps) for f in wanted)
    at = lambda step, c: F.when(F.col("step") == step, F.col(c))
    result = facts.groupBy("client", "funnel").agg(
        F.array(*[F.coalesce(F.sum(at(k, "n")), F.lit(0)) for k in range(most)]).alias("n"), F.array(*[F.max(at(k, "taken")) for k in range(1, most)]).alias("taken"), (F.max("step") + 1).alias("deepest")
    )
    result = materialise(result)
    depth = F.broadcast(result.groupBy("funnel", "deepest").agg(F.count("*").alias("same_depth")))  # funnels times steps
    name = F.element_at(F.array(*[F.lit(f.name) for f in wanted]), F.col("funnel") + 1)
    return result.join(depth, ["funnel", "deepest"]).select(name.alias("funnel"), F.col("client").alias("client_id"), "n", "deepest", "taken", "same_depth")


def op11_funnels(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = funnels(parquet(spark, sf_dir, "clicks"))
    n = [F.col("n")[k].alias(f"n{k + 1}") for k in range(4)]
    t = [F.col("taken")[k].alias(f"t{k + 2}") for k in range(3)]
    return found.select("funnel", "client_id", *n, "deepest", *t, "same_depth")


def _attempts_sql(f: Funnel) -> str:
    """DuckDB: a row an attempt, with the time of each step that it reaches."""
    kind = lambda names: f"(SELECT client_id, ts FROM r WHERE kind IN ({', '.join(repr(k) for k in names)}))"
    now = f"SELECT client_id, ts AS t1 FROM r WHERE kind = '{f.steps[0]}'"
    for k, step in enumerate(f.steps[1:], 2):
        then = f"SELECT a.*, b.ts AS then_ts FROM ({now}) a ASOF LEFT JOIN {kind([step])} b ON a.client_id = b.client_id AND a.t{k - 1} < b.ts"
        stop = f"SELECT a.*, b.ts AS stop_ts FROM ({then}) a ASOF LEFT JOIN {kind(f.excluded)} b ON a.client_id = b.client_id AND a.t{k - 1} < b.ts"
        now = f"SELECT * EXCLUDE (then_ts, stop_ts), CASE WHEN then_ts - t{k - 1} <= INTERVAL 15 MINUTE AND coalesce(then_ts < stop_ts, true) THEN then_ts END AS t{k} FROM ({stop})"
    return f"SELECT '{f.name}' AS funnel, * FROM ({now})"


_MIDDLE = "list_sort(list(epoch_us(t{b}) - epoch_us(t{a})) FILTER (WHERE t{b} IS NOT NULL))[(count(t{b}) + 1) // 2] AS t{b}"
ORACLE = f"""WITH r AS (SELECT DISTINCT client_id, kind, ts FROM clicks WHERE client_id IS NOT NULL AND kind IS NOT NULL AND ts IS NOT NULL), a AS ({" UNION ALL ".join(_attempts_sql(f) for f in FUNNELS)}),
    c AS (SELECT funnel, client_id, count(*) AS n1, count(t2) AS n2, count(t3) AS n3, count(t4) AS n4, CAST(1 + max(CASE WHEN t4 IS NOT NULL THEN 3 WHEN t3 IS NOT NULL THEN 2 WHEN t2 IS NOT NULL THEN 1 ELSE 0 END) AS INT) AS deepest,
    {", ".join(_MIDDLE.format(a=k, b=k + 1) for k in (1, 2, 3))} FROM a GROUP BY ALL) SELECT *, count(*) OVER (PARTITION BY funnel, deepest) AS same_depth FROM c"""
