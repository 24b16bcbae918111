"""Running numbers and sums over groups of any size: within buckets first, then over the buckets' totals.

A bucket is a column that never falls along the order (an hour, a hash's first
digits, a string's first letters). Windows over rows are by group and bucket;
only the buckets' sums are ordered as a whole, so a group that holds most rows
is spread over its buckets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def cumulative(df: DataFrame, keys: list[str], bucket: str, order: list, sums: dict[str, Column | str]) -> DataFrame:
    """``df`` with running sums, each row's own included: ``sums`` maps new columns to what they add up."""
    rows = df.withColumns({f"_v_{n}": F.expr(c) if isinstance(c, str) else c for n, c in sums.items()})
    inside = Window.partitionBy(*keys, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1) if keys else Window.orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy(*keys, bucket).agg(*[F.sum(f"_v_{n}").alias(f"_t_{n}") for n in sums])
    base = totals.select(*[F.col(k).alias(f"_k_{k}") for k in (*keys, bucket)], *[F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_b_{n}") for n in sums])
    on = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in (*keys, bucket)]
    done = rows.withColumns({f"_w_{n}": F.sum(f"_v_{n}").over(inside) for n in sums}).join(base, on)
    return done.select(*df.columns, *[(F.col(f"_w_{n}") + F.col(f"_b_{n}")).alias(n) for n in sums])


def numbered(df: DataFrame, keys: list[str], bucket: Column, order: list, name: str = "nth") -> DataFrame:
    """``df`` with each row's number in its group, from 1; ties must be broken by ``order``."""
    return cumulative(df.withColumn("_bucket", bucket), keys, "_bucket", order, {name: F.lit(1).cast("long")}).drop("_bucket")


def hash_numbered(df: DataFrame, keys: list[str], digest: Column, name: str = "nth") -> DataFrame:
    """``df`` numbered in the order of a hexadecimal digest, over 4,096 buckets a group."""
    return numbered(df.withColumn("_digest", digest), keys, F.substring(digest, 1, 3), ["_digest"], name).drop("_digest")


def hash_first(df: DataFrame, keys: list[str], digest: Column, most: int) -> DataFrame:
    """The first ``most`` rows of each group in the order of a hexadecimal digest, the groups being few.

    Counts by the digest's first three digits say which rows are in; only those
    of the digits where ``most`` is passed are ordered, so no other is shuffled.
    ``df`` is read twice.
    """
    rows = df.withColumn("_digest", digest).withColumn("_cell", F.substring("_digest", 1, 3))
    cells = rows.groupBy(*keys, "_cell").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(*keys).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    some = cells.withColumn("_room", F.lit(most) - before).where("_room > 0")
    met = rows.join(F.broadcast(some), [*keys, "_cell"])  # at most 4,096 rows a group
    cut = met.where("_n > _room").withColumn("_nth", F.row_number().over(Window.partitionBy(*keys).orderBy("_digest"))).where("_nth <= _room")
    return met.where("_n <= _room").select(*df.columns).unionByName(cut.select(*df.columns))


def lagged(df: DataFrame, keys: list[str], bucket: str, order: list, value: str, names: list[str]) -> DataFrame:
    """``df`` with the values 1, 2, ... rows before, null where there is none; rows are numbered, then dealt to overlapping runs."""
    run = 1024
    n = numbered(df, keys, F.col(bucket), order, "_nth")
    at = F.floor((F.col("_nth") - 1) / run)
    more = F.when((F.col("_nth") - 1) % run >= run - len(names), F.array(at, at + 1)).otherwise(F.array(at))
    rows = n.withColumn("_run", F.explode(more)).withColumn("_own", F.col("_run") == at)
    w = Window.partitionBy(*keys, "_run").orderBy("_nth")
    return rows.withColumns({c: F.lag(value, k).over(w) for k, c in enumerate(names, 1)}).where("_own").drop("_nth", "_run", "_own")


def top_per_group(df: DataFrame, keys: list[str], order: list, k: int, salts: int = 32) -> DataFrame:
    """The first ``k`` rows of each group: of each salt first, then of what they leave."""
    salt = F.pmod(F.xxhash64(*[F.col(c) for c in df.columns if c not in keys]), F.lit(salts))
    some = df.withColumn("_salt", salt).withColumn("_rank", F.row_number().over(Window.partitionBy(*keys, "_salt").orderBy(*order))).where(F.col("_rank") <= k)
    return some.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_rank") <= k).drop("_salt", "_rank")


def exact_median(df: DataFrame, column: str, cell: float = 1e-4) -> DataFrame:
    """One row, the median of ``column``: counts by cell find where it lies, and only that cell's rows are ordered."""
    cells = df.select(F.col(column).alias("x"), F.floor(F.col(column) / cell).alias("cell")).where("x is not null")
    counts = cells.groupBy("cell").agg(F.count("*").alias("n"))
    upto = F.sum("n").over(Window.orderBy("cell").rowsBetween(Window.unboundedPreceding, 0))
    places = counts.withColumn("upto", upto).crossJoin(counts.agg(F.sum("n").alias("all")))  # one row
    low, high = F.floor((F.col("all") - 1) / 2) + 1, F.floor(F.col("all") / 2) + 1
    wanted = places.where((F.col("upto") >= low) & (F.col("upto") - F.col("n") < high)).select("cell", (F.col("upto") - F.col("n")).alias("before"), low.alias("low"), high.alias("high"))
    rank = F.col("before") + F.row_number().over(Window.partitionBy("cell").orderBy("x"))
    return cells.join(F.broadcast(wanted), "cell").withColumn("rank", rank).where("rank between low and high").agg(F.avg("x").alias(column))


def salted_join(rows: DataFrame, table: DataFrame, key: str, spread: str, how: str = "inner", salts: int = 16) -> DataFrame:
    """``rows`` with the columns of ``table`` (one row a key): keys that very many rows hold are dealt by ``spread`` to copies of the table.

    Both sides are shuffled: Spark takes the copies for as large as the table's files, and would broadcast what the driver can't hold.
    """
    if salts == 1:
        return rows.join(table.hint("merge"), key, how)
    left = rows.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int"))
    right = table.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right.hint("merge"), [key, "_salt"], how).drop("_salt")


#: Rows of a table that are broadcast at most (one whose key has more than 64 bytes counts for several), and rows of a key that one task should hold.
BROADCAST, SHARE = 200_000, 100_000


def lookup(rows: DataFrame, table: DataFrame, key: str, frequent: str, spread: str, how: str = "inner", most: int = BROADCAST) -> DataFrame:
    """``rows`` with the columns of ``table`` (one row a key, none of them null), without a shuffle of the rows whose keys are frequent.

    ``frequent`` is how many rows hold the key. The ``most`` rows of the table
    with the largest are broadcast (of equal ones none, if not all have room),
    so what is left to be dealt by key is rows of rare keys, which need copies
    of the table only where one may have very many rows. The table is read
    several times, so it should be ``written``.
    """
    size = F.floor(F.octet_length(key) / 64) + 1
    if (table.agg(F.sum(size)).first()[0] or 0) <= most:
        return rows.join(F.broadcast(table), key, how)
    n = table.groupBy(frequent).agg(F.sum(size).alias("_n"))
    upto = F.sum("_n").over(Window.orderBy(F.desc(frequent)).rowsBetween(Window.unboundedPreceding, 0))
    least, top = n.withColumn("_upto", upto).agg(F.min(F.when(F.col("_upto") <= most, F.col(frequent))), F.max(frequent)).first()
    hot = F.lit(False) if least is None else F.col(frequent) >= least
    met = rows.join(F.broadcast(table.where(hot)), key, "left")
    salts = min(16, -(-(top if least is None else least) // SHARE)) or 1
    rare = salted_join(met.where(F.col(frequent).isNull()).select(*rows.columns), table.where(~hot), key, spread, how, salts)
    return met.where(F.col(frequent).isNotNull()).unionByName(rare.select(*met.columns))
