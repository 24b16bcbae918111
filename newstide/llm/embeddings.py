"""Embedding near-duplicates by randomised-rotation binary codes.

A unit vector is rotated at random and kept as the signs of its coordinates,
with the correction factor (its inner product with its own code) stored beside
them. Dividing a code's inner product with another rotated vector by that factor
estimates the two vectors' inner product without bias (Gao and Long, 2024). Two
codes of different rotations have independent errors, so their product, divided
by both factors, is unbiased too: codes alone, with their factors and the bound
on the error, say which pairs may reach the threshold. Only those pairs' vectors
are fetched, and computed exactly. Candidates share a band of code bits, where
bands are so many that a pair at the threshold shares one with the given
probability. Equal vectors are one node.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .cluster import materialise, parquet
from .components import components

RESULT_COLUMNS = ("vec_id", "n_links", "component_id", "kept")


@dataclass(frozen=True)
class Settings:
    threshold: float = 0.9
    #: Probability that a pair at the threshold shares a band.
    recall: float = 0.98
    #: Distinct vectors that a band's bucket holds on average, as a power of two.
    load: int = 4
    #: Standard errors of the estimate within which a pair is computed exactly.
    sure: float = 4.0
    #: Rotations whose signs and factors travel with a vector's bands; two at least.
    carried: int = 4
    #: Vectors of one tile of a bucket; larger buckets become pairs of tiles.
    tile: int = 512


@lru_cache(8)
def rotations(dim: int, count: int) -> np.ndarray:
    """``count`` random orthogonal matrices, side by side (dim x count * dim)."""
    rng = np.random.default_rng(dim)
    return np.concatenate([np.linalg.qr(rng.normal(size=(dim, dim)))[0] for _ in range(count)], 1)


def banding(n: int, s: Settings) -> tuple[int, int]:
    """(bits, bands) for ``n`` vectors."""
    bits = min(30, max(6, math.ceil(math.log2(max(n, 2))) - s.load))
    alike = (1 - math.acos(s.threshold) / math.pi) ** bits
    return bits, math.ceil(math.log(1 - s.recall) / math.log(1 - alike))


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def codes_of(units: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """Sign bits under ``count`` rotations (rows x count * dim), and each rotation's correction factor."""
    n, dim = units.shape
    turned = units @ rotations(dim, count)
    return turned > 0, np.abs(turned).reshape(n, count, dim).sum(2) / math.sqrt(dim)


def estimate(bits: np.ndarray, factors: np.ndarray, units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unbiased inner products of coded vectors (rows) with ``units`` (columns), and each row's standard error."""
    n, count = factors.shape
    dim = units.shape[1]
    signs = (bits * 2.0 - 1.0).reshape(n, count, dim) / (math.sqrt(dim) * factors * count)[:, :, None]
    error = np.sqrt((np.maximum(1 - factors**2, 0) / factors**2).mean(1) / max(dim - 1, 1) / count)
    return signs.reshape(n, -1) @ (units @ rotations(dim, count)).T, error


def distinct_vectors(vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(vec_id, node) of every row, node null where a vector links with nothing; (node, least, copies, raw) of the distinct vectors.

    Vectors are equal if two hashes of 64 bits each are; raw holds their
    components as they came, in single or double precision.
    """
    kind = np.dtype("<f4" if vectors.schema["embedding"].dataType.elementType.typeName() == "float" else "<f8")

    def run(batches):
        for batch in batches:
            raw = []
            for x in batch.column("embedding").to_pylist():
                good = x and None not in x
                v = np.array(x, kind) if good else np.zeros(1)
                # negative zero equals zero
                raw.append(kind.char.encode() + (v + kind.type(0)).tobytes() if good and np.isfinite(v).all() and v.any() else None)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(raw, pa.binary())], names=["vec_id", "raw"])

    shape = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(f"array<{'float' if kind.itemsize == 4 else 'double'}>").alias("embedding"))
    rows = shape.mapInArrow(run, "vec_id long, raw binary").withColumns({"one": F.when(F.col("raw").isNotNull(), F.xxhash64("raw")), "two": F.xxhash64(F.lit(1), "raw")})
    nodes = rows.where("one is not null").groupBy("one", "two").agg(F.min("vec_id").alias("least"), F.count("*").alias("copies"), F.min("raw").alias("raw"))
    nodes = materialise(nodes.withColumn("node", F.monotonically_increasing_id()))
    named = rows.select("vec_id", "one", "two").join(nodes.select("one", "two", "node"), ["one", "two"], "left").select("vec_id", "node")
    return materialise(named), nodes.drop("one", "two")


def _units(raws: list[bytes]) -> np.ndarray:
    """Unit rows, in double precision, of raw vectors of one length."""
    return _unit(np.stack([np.frombuffer(x, f"<{x[:1].decode()}", offset=1) for x in raws]).astype(float))


def _size(raw: bytes) -> int:
    return (len(raw) - 1) // (4 if raw[:1] == b"f" else 8)


def _codes(nodes: DataFrame, bits: int, bands: int, carried: int) -> DataFrame:
    """(node, dim, code, factors) of each vector: its packed signs under all rotations of the bands, and the carried rotations' factors as floats."""

    def run(batches):
        for batch in batches:
            raws = batch.column("raw").to_pylist()
            by: dict[int, list[int]] = {}
            for k, x in enumerate(raws):
                by.setdefault(_size(x), []).append(k)
            for dim, members in by.items():
                code, factors = codes_of(_units([raws[k] for k in members]), _rotations(dim, bits, bands, carried))
                own = factors[:, :carried].astype("<f4")
                packed = [pa.array([x.tobytes() for x in v], pa.binary()) for v in (np.packbits(code, axis=1), own)]
                yield pa.RecordBatch.from_arrays([batch.column("node").take(pa.array(members)), pa.array([dim] * len(members), pa.int32()), *packed], names=["node", "dim", "code", "factors"])

    return nodes.select("node", "raw").mapInArrow(run, "node long, dim int, code binary, factors binary")


def _rotations(dim: int, bits: int, bands: int, carried: int) -> int:
    return max(-(-bits * bands // dim), carried)


def _unpacked(codes: list[bytes], count: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(b"".join(codes), np.uint8).reshape(len(codes), -1), axis=1, count=count)


def _bucketed(codes: DataFrame, bits: int, bands: int, carried: int, keys_only: bool) -> DataFrame:
    """A row for each band of each code: the band with its bits, and the carried rotations' signs and factors."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims).tolist():
                own = batch.take(pa.array(np.flatnonzero(dims == dim)))
                code = _unpacked(own.column("code").to_pylist(), dim * _rotations(dim, bits, bands, carried))
                key = pa.array(_keys(code, dim, bits, bands).ravel())
                if keys_only:
                    yield pa.RecordBatch.from_pydict({"key": key})
                    continue
                each = pa.array(np.repeat(np.arange(own.num_rows), bands))
                signs = pa.array([x.tobytes() for x in np.packbits(code[:, : dim * carried], axis=1)], pa.binary())
                yield pa.RecordBatch.from_arrays([key, own.column("node").take(each), signs.take(each), own.column("factors").take(each)], names=["key", "node", "signs", "factors"])

    names = ("dim", "code") if keys_only else ("node", "dim", "code", "factors")
    return codes.select(*names).mapInArrow(run, "key long" if keys_only else "key long, node long, signs binary, factors binary")


def _keys(code: np.ndarray, dim: int, bits: int, bands: int) -> np.ndarray:
    """Rows x bands: length of the vectors, band and the band's bits in one number."""
    band = code[:, : bits * bands].astype(np.int64).reshape(-1, bands, bits) @ (1 << np.arange(bits, dtype=np.int64))
    return ((np.int64(dim) << 44) | (np.arange(bands, dtype=np.int64) << 30))[None, :] | band


def _sides(rows: dict[str, list]) -> tuple[np.ndarray, np.ndarray]:
    i, j, salt = rows["i"][0], rows["j"][0], np.array(rows["salt"])
    return (np.flatnonzero(salt == i), np.flatnonzero(salt == j)) if i != j else (np.arange(len(salt)),) * 2


def code_products(bits: np.ndarray, factors: np.ndarray, dim: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What a tile's estimates take: each code divided by its factors (rows x count * dim), those turned back and summed (rows x dim), and each row's squared standard error.

    A code turned back and divided by its factor is the vector plus an error at
    right angles to it, of squared length (1 - f^2) / f^2.
    """
    n, count = factors.shape
    scale = (1 / (math.sqrt(dim) * factors)).astype(np.float32)
    code = (np.where(bits, np.float32(1), np.float32(-1)).reshape(n, count, dim) * scale[:, :, None]).reshape(n, -1)
    square = (1 / factors**2 - 1).clip(0).mean(1) / max(dim - 1, 1) / count
    return code, code @ _turned_back(dim, count), square.astype(np.float32)


@lru_cache(8)
def _turned_back(dim: int, count: int) -> np.ndarray:
    return np.ascontiguousarray(rotations(dim, count).T, dtype=np.float32)


def code_estimate(left: tuple, right: tuple, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Unbiased inner products of codes (rows) with codes (columns), and their standard error for pairs at ``threshold`` or above.

    Only products of different rotations are summed: under one rotation the
    errors of like vectors are alike. An error lies at right angles to its own
    vector, so against another at ``threshold`` only the sine's share of it counts.
    """
    (a, whole_a, va), (b, whole_b, vb) = left, right
    dim = whole_a.shape[1]
    count = a.shape[1] // dim
    # codes under one rotation have the same product turned back or not
    guess = (whole_a @ whole_b.T - a @ b.T) / np.float32(count * (count - 1))
    both = np.float32(max(dim - 1, 1) * count / (count - 1)) * va[:, None] * vb
    return guess, np.sqrt((va[:, None] + vb) * np.float32(1 - threshold**2) + both)


def _undecided(rows: dict[str, list], s: Settings) -> np.ndarray:
    """Places in a tile of vectors that may have a link there: some estimate is within ``sure`` errors of the threshold, or above."""
    dim = rows["key"][0] >> 44
    factors = np.frombuffer(b"".join(rows["factors"]), "<f4").reshape(len(rows["key"]), -1).astype(float)
    codes = code_products(_unpacked(rows["signs"], dim * factors.shape[1]), factors, dim)
    left, right = _sides(rows)
    guess, error = code_estimate(*[tuple(x[side] for x in codes) for side in (left, right)], s.threshold)
    # the rest is room for single precision
    near = guess + s.sure * error + 1e-5 >= s.threshold
    if rows["i"][0] == rows["j"][0]:
        np.fill_diagonal(near, False)
    return np.union1d(left[near.any(1)], right[near.any(0)])


def _links(rows: dict[str, list], bits: int, bands: int, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Linked pairs of a tile's fetched vectors that share no earlier band; positions of both."""
    units = _units(rows["raw"])
    dim = units.shape[1]
    left, right = _sides(rows)
    a, b = np.nonzero(units[left] @ units[right].T >= s.threshold - 1e-9)
    a, b = left[a], right[b]
    if rows["i"][0] == rows["j"][0]:
        a, b = a[a < b], b[a < b]
    good = (units[a] * units[b]).sum(1) >= s.threshold
    a, b = a[good], b[good]
    some, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    code, _ = codes_of(units[some], _rotations(dim, bits, bands, s.carried))
    x, y = place[: len(a)], place[len(a) :]
    band = (rows["key"][0] >> 30) & 0x3FFF
    for at in range(0, band):
        if not len(a):
            break
        new = (code[x, at * bits : (at + 1) * bits] != code[y, at * bits : (at + 1) * bits]).any(1)
        a, b, x, y = a[new], b[new], x[new], y[new]
    return a, b


def _by_tile(rows: DataFrame, use, schema: str) -> DataFrame:
    """``use`` over the rows of each tile (key, i, j), which come one tile after another; it returns tuples."""
    names = rows.columns
    width = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    fields = schema.replace(" long", "").split(", ")

    def run(batches):
        held: dict[str, list] = {n: [] for n in names}
        out: list[tuple] = []

        def close():
            if len(held["key"]) > 1:
                out.extend(use(held))
            for n in names:
                held[n] = []

        def batch_of():
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in range(len(fields))], names=fields)

        for batch in batches:
            key = np.stack([batch.column(n).to_numpy() for n in ("key", "i", "j")])
            cuts = [0, *(np.flatnonzero((np.diff(key, axis=1) != 0).any(0)) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a == b:
                    continue
                part = batch.slice(a, b - a).to_pydict()
                if held["key"] and (held["key"][0], held["i"][0], held["j"][0]) != tuple(key[:, a].tolist()):
                    close()
                for n in names:
                    held[n] += part[n]
            if len(out) > 10_000:
                yield batch_of()
                out.clear()
        close()
        yield batch_of()

    return rows.repartition(width, "key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(run, schema)


def undecided(nodes: DataFrame, bits: int, bands: int, s: Settings = Settings()) -> DataFrame:
    """(key, i, j, salt, node): the vectors of each tile whose codes leave open, or say, that they have a link there."""
    codes = materialise(_codes(nodes, bits, bands, s.carried))
    large = _bucketed(codes, bits, bands, s.carried, True).groupBy("key").count().where(F.col("count") > s.tile).select("key", F.ceil(F.col("count") / s.tile).cast("int").alias("parts"))
    rows = _bucketed(codes, bits, bands, s.carried, False).join(large, "key", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("node", "key"), F.col("parts")).cast("int"))
    rows = rows.withColumn("t", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).withColumns({"i": F.least("salt", "t"), "j": F.greatest("salt", "t")})

    def chosen(held):
        return [(held["key"][k], held["i"][k], held["j"][k], held["salt"][k], held["node"][k]) for k in _undecided(held, s).tolist()]

    return _by_tile(rows.select("key", "i", "j", "salt", "node", "signs", "factors"), chosen, "key long, i long, j long, salt long, node long")


def links(nodes: DataFrame, s: Settings = Settings()) -> DataFrame:
    """(node, other, n): with ``other`` null, n vectors linked with the node in some tile; else an edge of a tile's spanning forest.

    Codes and their factors choose which vectors of a tile may have a link there;
    only those are fetched with their components, and computed exactly. Every
    linked pair is counted in the first band that it shares, and nowhere else.
    """
    bits, bands = banding(nodes.count(), s)
    rows = undecided(nodes, bits, bands, s)
    with_raw = rows.join(nodes.select("node", "copies", "raw"), "node").select("key", "i", "j", "salt", "node", "copies", "raw")

    def linked(held):
        a, b = _links(held, bits, bands, s)
        if not len(a):
            return []
        n, copies, node = len(held["key"]), np.array(held["copies"]), np.array(held["node"])
        count = np.bincount(a, copies[b], n) + np.bincount(b, copies[a], n)
        name = np.arange(n)
        while True:
            low = np.minimum(name[a], name[b])
            then = name.copy()
            np.minimum.at(then, a, low)
            np.minimum.at(then, b, low)
            if (then == name).all():
                break
            name = then
        return [(int(node[k]), None, int(count[k])) for k in np.flatnonzero(count)] + [(int(node[k]), int(node[name[k]]), 0) for k in np.flatnonzero(name != np.arange(n))]

    return _by_tile(with_raw, linked, "node long, other long, n long")


def near_duplicates(vectors: DataFrame, s: Settings = Settings()) -> DataFrame:
    """Per row of ``vectors``: vec_id, n_links, component_id, kept.

    Candidates share a band with the probability ``recall`` at the threshold;
    bits and bands grow with the number of vectors so that this share, and the
    load of a bucket, stay. Only vec_id and embedding are read. Null, empty and zero vectors, and those
    with null or non-finite components, link with nothing; vectors of different
    lengths don't link either. Repeated rows are copies: each counts as a vector
    of its own. Rows without vec_id get a row; a component is named by its
    smallest vec_id that isn't null. An empty table gives no rows.
    """
    rows, nodes = distinct_vectors(vectors)
    found = materialise(links(nodes, s))
    joined = components(found.where("other is not null").select(F.col("node").alias("a"), F.col("other").alias("b")))
    counted = found.where("other is null").groupBy("node").agg(F.sum("n").alias("n"))
    named = nodes.join(joined.withColumnRenamed("node", "member"), nodes.node == F.col("member"), "left").select("node", "least", "copies", F.coalesce("component", "node").alias("root"))
    named = named.join(named.groupBy("root").agg(F.min("least").alias("component_id")), "root").join(counted, "node", "left")
    facts = named.select("node", "component_id", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    linked = rows.where("node is not null").join(facts, "node").select("vec_id", "n_links", "component_id")
    alone = rows.where("node is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def op8_rotated_code_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(parquet(spark, sf_dir, "embeddings"))
