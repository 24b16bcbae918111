"""Similar pairs, and selection in order, both exact: no all-pairs rows, no pass over a group in one task.

Dense vectors of a group meet in tiles: blocks of bounded size, a tile for each
pair of blocks, of which only what is similar leaves. Sparse ones too, by larger
tiles: rows' lengths in a bounded number of dimensions, to which words are dealt,
bound their cosines, and exact ones are taken where the bound is large enough. Selection in order ("keep a row unless it is like one kept before")
makes no pairs: rows meet what was kept before them, in one call where a group is small, by rounds over its first
rows where it is large. Where rows have a representative, rounds go over similar pairs: whatever no undecided row
comes before stays, what is like it goes, until no pair is left. The answer is that of the sequential pass.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.readers import scratch
from .clustering import unit_rows, vectors
from .components import _dropped, written
from .ordered import top_per_group

#: Rows on each side of a tile of dense vectors, and of one of word counts.
TILE, POSTINGS = 1024, 16384
#: Rows on each side of a tile of dense vectors that gives out rows, not pairs, and how many of them meet the others at once.
WIDE, ROWS = 8192, 256
#: Dimensions of bounds of word counts, and rows of a side that are made dense at once.
BOUNDS, STRIP = 2048, 2048


def tiled(rows: DataFrame, keys: list[str], order: list[str], f: Callable[[pa.Table, np.ndarray | None], dict[str, np.ndarray | list]], schema: str, tile: int = TILE) -> DataFrame:
    """``f`` over tiles of each group of ``rows`` (with a column id), so that any two rows of a group meet in exactly one.

    It gets a tile's rows in ``order`` and a mask of its first block, whose rows
    meet those of the second; in a tile of one block the mask is None and all
    rows meet. Groups of more than ``tile`` rows are dealt to as many blocks as
    keep each near that, and a row has a copy for each block of its group.
    Those groups, at most one for ``tile`` rows, are broadcast.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    arrow = to_arrow_schema(_parse_datatype_string(schema))
    named = rows.withColumn("_g", F.xxhash64(*keys))
    large = named.groupBy("_g").agg(F.ceil(F.count("*") / tile).cast("int").alias("_parts")).where("_parts > 1")
    dealt = named.join(F.broadcast(large), "_g", "left").withColumn("_parts", F.coalesce("_parts", F.lit(1)))
    dealt = dealt.withColumn("_own", F.pmod(F.xxhash64("id"), F.col("_parts")).cast("int")).withColumn("_t", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)))
    dealt = dealt.withColumns({"_i": F.least("_own", "_t"), "_j": F.greatest("_own", "_t")}).drop("_g", "_parts", "_t")

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([(c, "ascending") for c in order])
        i, j = table.column("_i")[0].as_py(), table.column("_j")[0].as_py()
        out = f(table, None if i == j else table.column("_own").to_numpy() == i)
        return pa.table([pa.array(out[n], arrow.field(n).type) for n in arrow.names], schema=arrow)

    return dealt.groupBy(*keys, "_i", "_j").applyInArrow(run, schema)


def cosines(table: pa.Table, first: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, columns and cosines of a tile: those of its first block by those of its second, or all by all."""
    x = unit_rows(vectors(table))
    left, right = (np.arange(len(x)),) * 2 if first is None else (np.flatnonzero(first), np.flatnonzero(~first))
    return left, right, x[left] @ x[right].T


def strips(table: pa.Table, first: np.ndarray | None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """``cosines`` for a bounded number of rows after the other, and where the column's row comes after the row's."""
    x = unit_rows(vectors(table))
    left, right = (np.arange(len(x)),) * 2 if first is None else (np.flatnonzero(first), np.flatnonzero(~first))
    for i in range(0, len(left), ROWS):
        some = left[i : i + ROWS]
        yield some, right, x[some] @ x[right].T, right > some[:, None]


def repeats(rows: DataFrame, keys: list[str], order: list[str], least: float, tile: int = WIDE) -> DataFrame:
    """(id) of the rows whose cosine to any row before them in their group is ``least`` or more; as ``dense_pairs``, of which only the later ids are of use."""
    kind = dict(rows.dtypes)["id"]

    def later(table: pa.Table, first: np.ndarray | None) -> dict:
        found = np.zeros(table.num_rows, bool)
        for left, right, s, after in strips(table, first):
            near = s >= least
            found[right] |= (near & after).any(0)
            if first is not None:
                found[left] |= (near & ~after).any(1)
        return {"id": table.column("id").take(pa.array(np.flatnonzero(found))).combine_chunks()}

    return tiled(rows.select(*dict.fromkeys([*keys, *order, "id", "vector"])), keys, [*order, "id"], later, f"id {kind}", tile).distinct()


def dense_pairs(rows: DataFrame, keys: list[str], order: list[str], least: float, tile: int = TILE) -> DataFrame:
    """(a, b, cosine) of the rows of a group whose cosine is ``least`` or more, a before b in ``order``.

    ``rows`` has keys, id, order and vector or bins; zero vectors are like none. Ties in ``order`` go by id.
    """
    kind = dict(rows.dtypes)["id"]

    def near(table: pa.Table, first: np.ndarray | None) -> dict:
        left, right, s = cosines(table, first)
        p, q = np.nonzero(s >= least)
        p, q, c = left[p], right[q], s[p, q]
        once = p < q if first is None else np.ones(len(p), bool)
        p, q, c = p[once], q[once], c[once]
        ids = table.column("id")
        return {"a": ids.take(pa.array(np.minimum(p, q))).combine_chunks(), "b": ids.take(pa.array(np.maximum(p, q))).combine_chunks(), "cosine": c}

    column = "bins" if "bins" in rows.columns else "vector"
    return tiled(rows.select(*dict.fromkeys([*keys, *order, "id", column])), keys, [*order, "id"], near, f"a {kind}, b {kind}, cosine double", tile)


def entries(start: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of rows whose entries begin at ``start``: which of ``rows`` each of their entries is of, and where it stands."""
    size = start[rows + 1] - start[rows]
    which = np.repeat(np.arange(len(rows)), size)
    return which, np.arange(len(which)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(start[rows], size)


class Counts:
    """Rows of a tile as their words' codes and numbers, one row after the other."""

    def __init__(self, table: pa.Table, least: float):
        lists, self.least = table.column("words").combine_chunks(), least
        self.n = table.column("n").combine_chunks().flatten().to_numpy(zero_copy_only=False)
        self.start = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))]).astype(np.int64)
        coded = lists.flatten().dictionary_encode()
        self.word = coded.indices.to_numpy(zero_copy_only=False)
        self.norm = np.sqrt(table.column("squared").to_numpy())
        # words with the largest numbers have a dimension of their own, the others share what is left
        mass, own = np.bincount(self.word, self.n * self.n, len(coded.dictionary)), BOUNDS * 3 // 4
        self.dimension, at = np.empty(len(mass), np.int64), np.arange(len(mass))
        self.dimension[np.argsort(-mass, kind="stable")] = np.where(at < own, at, own + at % (BOUNDS - own))

    def lengths(self, rows: np.ndarray) -> np.ndarray:
        """The length of each row in each dimension: by Cauchy and Schwarz their products are cosines at least."""
        which, place = entries(self.start, rows)
        squares = np.bincount(which * BOUNDS + self.dimension[self.word[place]], self.n[place] ** 2, len(rows) * BOUNDS)
        return (np.sqrt(squares).reshape(len(rows), BOUNDS) / self.norm[rows, None]).astype(np.float32)

    def met(self, left: np.ndarray, right: np.ndarray, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Rows of both sides whose bound is ``least`` or more, by strips of the left one and in its order; of one side each two rows once."""
        for i in range(0, len(left), STRIP):
            x, found = self.lengths(left[i : i + STRIP]), []
            for j in range(i if same else 0, len(right), STRIP):
                p, q = np.nonzero(x @ self.lengths(right[j : j + STRIP]).T >= self.least - 1e-4)  # single precision
                p, q = left[i + p], right[j + q]
                found.append((p[p < q], q[p < q]) if same else (p, q))
            p, q = (np.concatenate(c) for c in zip(*found, strict=True))
            by = np.argsort(p, kind="stable")
            yield p[by], q[by]

    def cosines(self, p: np.ndarray, q: np.ndarray) -> np.ndarray:
        """Exact ones of the rows ``p``, which are in order, and ``q``."""
        out, own = np.zeros(len(p)), np.zeros(len(self.dimension))
        ends = np.concatenate([np.flatnonzero(np.diff(p, prepend=-1)), [len(p)]])
        for a, b in zip(ends[:-1], ends[1:], strict=True):
            mine = slice(self.start[p[a]], self.start[p[a] + 1])
            own[self.word[mine]] = self.n[mine]
            for c in range(a, b, STRIP):
                which, place = entries(self.start, q[c : min(b, c + STRIP)])
                out[c : min(b, c + STRIP)] = np.bincount(which, own[self.word[place]] * self.n[place], min(b, c + STRIP) - c)
            own[self.word[mine]] = 0
        return out / (self.norm[p] * self.norm[q])


def _sparse(rows: DataFrame, least: float, exact: bool) -> DataFrame:
    kind = dict(rows.dtypes)["id"]

    def near(table: pa.Table, first: np.ndarray | None) -> dict:
        counts, every = Counts(table, least), np.arange(table.num_rows)
        left, right = (every, every) if first is None else (every[first], every[~first])
        pairs, cosine = [(every[:0], every[:0])], [np.zeros(0)]
        for p, q in counts.met(left, right, first is None):
            c = counts.cosines(p, q) if exact else np.ones(len(p))
            good = c >= least if exact else c > 0
            pairs.append((p[good], q[good]))
            cosine.append(c[good])
        p, q = (np.concatenate(x) for x in zip(*pairs, strict=True))
        ids = table.column("id")
        return {"a": ids.take(pa.array(np.minimum(p, q))).combine_chunks(), "b": ids.take(pa.array(np.maximum(p, q))).combine_chunks(), "cosine": np.concatenate(cosine)}

    words = rows.select("group", "id", "squared", F.map_keys("counts").alias("words"), F.map_values("counts").alias("n"))
    return tiled(words, ["group"], ["id"], near, f"a {kind}, b {kind}, cosine double", POSTINGS)


def sparse_candidates(rows: DataFrame, least: float) -> DataFrame:
    """(a, b), a < b: ids of every two rows of a group whose cosine may be ``least`` or more. ``rows`` has group, id, squared and counts (word to number).

    A tile's words are dealt to ``BOUNDS`` dimensions, the heaviest ones each to
    its own; products of what rows have in each bound their cosines.
    """
    return _sparse(rows, least, False).select("a", "b")


def with_squares(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(group, id, counts, squared) of rows with counts; those without a number are left out."""
    squared = F.aggregate(F.map_values("counts"), F.lit(0.0), lambda s, n: s + n * n)
    return rows.select(F.struct(*keys).alias("group"), "id", "counts", squared.alias("squared")).where("squared > 0")


def sparse_pairs(rows: DataFrame, keys: list[str], least: float) -> DataFrame:
    """(a, b, cosine), a < b, of the rows of a group whose cosine is ``least`` or more. ``rows`` has keys, id (which names a row) and counts (map of words to doubles); it is read twice, so it should be a table.

    Exact cosines are taken in the tile, of its candidates only: what leaves it is pairs.
    """
    return _sparse(with_squares(rows, keys), least, True)


def settled(edges: DataFrame) -> tuple[DataFrame, int]:
    """The nodes that go, (node), where of each edge (a, b) the later node b goes if a stays, and the number of rounds.

    A round keeps every node that no edge leads to and takes what its edges lead
    to out. It ends, as edges lead from earlier to later rows only.
    """
    scratch(edges.sparkSession, "")
    now, gone, rounds = written(edges.select("a", "b")), [], 0
    while not now.isEmpty():
        waiting = now.select(F.col("b").alias("a")).distinct()
        out = written(now.join(waiting, "a", "left_anti").select(F.col("b").alias("node")).distinct())
        before, now = now, written(now.join(out, now.a == out.node, "left_anti").join(out, F.col("b") == out.node, "left_anti"))
        _dropped(before)
        gone.append(out)
        rounds += 1
        if len(gone) == 16:  # a plan of bounded size
            gone = [written(_union(gone))]
    return (_union(gone) if gone else now.select(F.col("b").alias("node"))), rounds


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def chosen(x: np.ndarray, most: float) -> np.ndarray:
    """Which of the unit vectors, in order, have a cosine below ``most`` to all those chosen before."""
    out = np.zeros(len(x), bool)
    for i in range(0, len(x), ROWS):
        at = i + np.flatnonzero(~near(x[i : i + ROWS], x[:i][out[:i]], most))
        like, stays = x[at] @ x[at].T >= most, np.ones(len(at), bool)
        for k in range(len(at)):
            if stays[k]:
                stays[k + 1 :] &= ~like[k, k + 1 :]
        out[at[stays]] = True
    return out


def near(x: np.ndarray, kept: np.ndarray, most: float) -> np.ndarray:
    """Which of the unit vectors have a cosine of ``most`` or more to any of ``kept``."""
    out = np.zeros(len(x), bool)
    for i in range(0, len(x) if len(kept) else 0, ROWS):
        out[i : i + ROWS] = (x[i : i + ROWS] @ kept.T >= most).any(1)
    return out


def _rounds(rows: DataFrame, most: float, content: str, block: int) -> list[DataFrame]:
    """Tables of the rows (_g, id, place, content and others) that stay, of groups ``_g`` of any size.

    A round settles the first ``block`` rows of each group where they are together, and takes out the others that are like what stays of them.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = rows.schema
    arrow, names = to_arrow_schema(schema), rows.columns

    def first_stay(table: pa.Table) -> pa.Table:
        table = table.take(pa.array(np.argsort(table.column("_n").to_numpy(), kind="stable")))
        return table.select(names).filter(pa.array(chosen(unit_rows(vectors(table, content)), most))).cast(arrow)

    def others(table: pa.Table) -> pa.Table:
        kept = table.column("_kept").to_numpy(zero_copy_only=False)
        mine, theirs = table.filter(pa.array(~kept)), table.filter(pa.array(kept))
        if mine.num_rows and theirs.num_rows:
            mine = mine.filter(pa.array(~near(unit_rows(vectors(mine, content)), unit_rows(vectors(theirs, content)), most)))
        return mine.select(names).cast(arrow)

    now, stay = rows, []
    while True:
        first = top_per_group(now, ["_g"], ["place"], block)
        first = first.withColumn("_n", F.row_number().over(Window.partitionBy("_g").orderBy("place")))
        first = written(first)
        stay.append(written(first.groupBy("_g").applyInArrow(first_stay, schema)))
        upto = first.groupBy("_g").agg(F.max("place").alias("_upto"))
        rest = now.join(F.broadcast(upto), "_g").where("place > _upto").drop("_upto")  # a group for ``block`` rows at most
        parts = rest.groupBy("_g").agg(F.ceil(F.count("*") / (4 * block)).cast("int").alias("_parts"))
        mine = rest.join(F.broadcast(parts), "_g").withColumn("_part", F.pmod(F.xxhash64("id"), F.col("_parts")).cast("int")).withColumn("_kept", F.lit(False))
        theirs = stay[-1].join(F.broadcast(parts), "_g").withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))).withColumn("_kept", F.lit(True))
        both = mine.select(*names, "_part", "_kept").unionByName(theirs.select(*names, "_part", "_kept"))
        before, now = now, written(both.groupBy("_g", "_part").applyInArrow(others, schema))
        _dropped(first)
        if before is not rows:
            _dropped(before)
        if len(stay) == 16:  # a plan of bounded size
            stay = [written(_union(stay))]
        if now.isEmpty():
            return stay


def greedy_novel(df: DataFrame, keys: list[str], order: list[str], most: float, columns: list[str] = ["id"], tile: int = WIDE) -> DataFrame:
    """Rows of each group kept because their cosine to every row kept before, in ``order``, is below ``most`` (above 0); the first stays.

    ``df`` has keys, order, id (which names a row) and vector or bins. Of equal
    vectors all but the first go at once; zero vectors are like none and stay.
    Rows meet what was kept before them, no pairs are made: groups of up to
    ``tile`` rows in one call, larger ones by rounds of as many rows, which are
    at most the group's rows over ``tile`` and few where little is kept.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    scratch(df.sparkSession, "")
    bins = "bins" in df.columns
    content, value = ("bins", F.sort_array("bins")) if bins else ("vector", F.col("vector"))
    rest = [c for c in dict.fromkeys([*order, "id", *columns]) if c not in keys]
    rows = written(df.select(*keys, *rest, value.alias(content)))
    some = F.coalesce(F.size(content) > 0 if bins else F.exists(content, lambda x: x != 0), F.lit(False))
    first = rows.where(some).groupBy(*keys, content).agg(F.min(F.struct(*rest)).alias("row")).select(*keys, content, "row.*")
    first = written(first.withColumn("_g", F.xxhash64(*keys)))
    large = first.groupBy("_g").agg(F.count("*").alias("_rows")).where(F.col("_rows") > tile).select("_g")
    out = list(dict.fromkeys([*keys, *columns]))
    schema = first.select(*out).schema
    arrow, by = to_arrow_schema(schema), [(c, "ascending") for c in dict.fromkeys([*order, "id"])]

    def group(table: pa.Table) -> pa.Table:
        table = table.sort_by(by)
        return table.select(out).filter(pa.array(chosen(unit_rows(vectors(table, content)), most))).cast(arrow)

    some_large = not large.isEmpty()
    small = first.join(F.broadcast(large), "_g", "left_anti") if some_large else first  # a row for every ``tile`` and more
    kept = small.groupBy("_g").applyInArrow(group, schema)
    if some_large:
        ordered = [x for c in dict.fromkeys([*order, "id"]) for x in (F.isnull(c), F.col(c))]  # nulls last, as in a call
        place = F.struct(*[x.alias(f"_{k}") for k, x in enumerate(ordered)])
        wide = first.join(F.broadcast(large), "_g", "left_semi").withColumn("place", place)
        kept = kept.unionByName(_union(_rounds(written(wide), most, content, tile)).select(*out))
    return kept.unionByName(rows.where(~some).select(*out))


def streaming_dedup(df: DataFrame, keys: list[str], order: list[str], least: float = 0.8) -> DataFrame:
    """(keys, id, representative): each row, in ``order``, joins the most similar earlier representative of its group with
    cosine ``least`` or more (the first of equals), else it represents itself.

    ``df`` has keys, id (which names a row), order and counts (map of words to
    doubles). Rows of equal counts are one node until each looks for the
    representative that is nearest among those before it. Rows without counts
    represent themselves.
    """
    scratch(df.sparkSession, "")
    place = F.struct(*[c for c in order if c != "id"], "id")
    entries = F.array_sort(F.map_entries("counts"))
    content = F.when(F.size("counts") > 0, F.sha2(F.to_json(F.struct(*keys, entries.alias("entries"))), 256))
    own = F.aggregate(F.map_values("counts"), F.lit(0.0), lambda s, n: s + n * n)
    rows = written(df.select(*keys, "id", place.alias("place"), "counts", content.alias("content")))
    first = rows.where("content is not null").groupBy("content").agg(F.min_by(F.struct(*keys, "id", "place", "counts"), "place").alias("row"))
    first = written(first.select("content", "row.*").withColumn("own", own))
    pairs = written(sparse_pairs(first, keys, least - 1e-12))
    at = lambda x: first.select(F.col("id").alias(x), F.col("place").alias(f"place_{x}"))
    placed = pairs.join(at("a"), "a").join(at("b"), "b")
    ahead = F.col("place_a") < F.col("place_b")
    out, _ = settled(placed.select(F.when(ahead, F.col("a")).otherwise(F.col("b")).alias("a"), F.when(ahead, F.col("b")).otherwise(F.col("a")).alias("b")))
    kept = first.join(out, first.id == out.node, "left_anti")
    near = placed.select(F.col("a").alias("of"), F.col("b").alias("to"), "cosine", F.col("place_b").alias("since")).unionByName(placed.select(F.col("b").alias("of"), F.col("a").alias("to"), "cosine", F.col("place_a").alias("since")))
    near = near.join(kept.select(F.col("id").alias("to")), "to")
    near = near.unionByName(kept.select(F.col("id").alias("of"), F.col("id").alias("to"), (F.col("own") / (F.sqrt("own") * F.sqrt("own"))).alias("cosine"), F.col("place").alias("since")))
    known = near.join(first.select(F.col("id").alias("of"), "content"), "of")
    met = rows.select("content", "id", "place").join(known, "content").where("since <= place")
    best = met.groupBy("id").agg(F.min_by("to", F.struct(-F.col("cosine"), "since")).alias("representative"))
    return rows.select(*keys, "id").join(best, "id", "left").select(*keys, "id", F.coalesce("representative", "id").alias("representative"))
