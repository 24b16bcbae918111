"""Near copies: SimHash balls first, banded minima for what balls of two bits can't reach, every candidate checked on whole sets of word shingles.

Texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more
are near copies, and what they join is a group. Fingerprints of such texts
differ in about ten of 64 bits at the threshold, and a ball of half that radius
has millions of values; so ball hashing (``simhash.linked``) joins only the
closest copies. For the rest, 24 bands of 6 minima bring 99.9 % of all pairs at
the threshold together. Of the texts in a band each is compared with the
smallest first, then those of different groups with each other, tile by tile,
so that only verified links become rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .cluster import fresh, materialise
from .components import components
from .simhash import linked, majority
from .text import tidied

SHINGLE, SIMILARITY = 5, 0.8
BANDS, ROWS = 24, 6
#: Candidates with fewer equal minima aren't checked: 5 standard errors below SIMILARITY.
LEAST_EQUAL = int(BANDS * ROWS * (SIMILARITY - 5 * (SIMILARITY * (1 - SIMILARITY) / (BANDS * ROWS)) ** 0.5))
#: Shingles of a text whose minima are taken at once.
CHUNK = 2048
#: Texts on each side of a tile.
TILE = 1024

_RND = np.random.default_rng(42)
_FACTOR, _ADD = (_RND.integers(0, 1 << 63, (BANDS * ROWS, 1), np.uint64) * np.uint64(2) + np.uint64(1) for _ in range(2))
_PLACE = _RND.integers(0, 1 << 63, SHINGLE, np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_set(words: list[bytes]) -> np.ndarray:
    """Distinct hashes of a text's shingles, rising; a shorter text is one shingle, no words none."""
    if not words:
        return np.empty(0, np.uint64)
    if len(words) < SHINGLE:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words))], np.uint64)
    known = {w: xxhash.xxh64_intdigest(w) for w in set(words)}
    h = np.fromiter((known[w] for w in words), np.uint64, len(words))
    n = len(h) - SHINGLE + 1
    mixed = sum(h[k : k + n] * _PLACE[k] for k in range(SHINGLE))
    return np.unique((mixed ^ mixed >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9))


def minima(shingles: np.ndarray) -> np.ndarray:
    """The text's signature, one minimum for each of the hash functions."""
    out = np.full(BANDS * ROWS, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(shingles), CHUNK):
        np.minimum(out, ((shingles[None, i : i + CHUNK] * _FACTOR + _ADD) >> np.uint64(32)).min(axis=1).astype(np.uint32), out)
    return out


def _words(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()


def text_key(text: str = "text") -> Column:
    """128 bits that name a text: rows of equal texts are one node. Null counts as empty."""
    return F.unhex(F.md5(F.coalesce(F.col(text), F.lit(""))))


def marks(docs: DataFrame) -> DataFrame:
    """(doc_id, key, fp, minima, bands) of every row."""

    def run(batches):
        for batch in batches:
            prints, sign, bands = [], [], []
            for text in batch.column("text").to_pylist():
                found = shingle_set(_words(text))
                m = minima(found).tobytes()
                step = 4 * ROWS
                prints.append(majority(found))
                sign.append(m)
                bands.append(np.array([xxhash.xxh64_intdigest(m[k * step : (k + 1) * step], k) for k in range(BANDS)], np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("key"), pa.array(np.array(prints, np.uint64).view(np.int64)), pa.array(sign, pa.binary()), pa.array(bands, pa.list_(pa.int64()))],
                names=["doc_id", "key", "fp", "minima", "bands"],
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key().alias("key"), "text")
    return rows.mapInArrow(tidied(run), "doc_id long, key binary, fp long, minima binary, bands array<long>")


def _sets(texts: DataFrame) -> DataFrame:
    """(node, shingles) of (node, text): 32 bits of each shingle."""

    def run(batches):
        for batch in batches:
            sets = [np.unique((shingle_set(_words(x)) >> np.uint64(32)).astype(np.uint32)).tobytes() for x in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(sets, pa.binary())], names=["node", "shingles"])

    return texts.select("node", "text").mapInArrow(tidied(run), "node long, shingles binary")


def _kept(pairs: DataFrame, values: DataFrame, column: str, keep) -> DataFrame:
    """The pairs (a, b) whose two values in ``column`` pass ``keep``."""
    one, two = (values.select(F.col("node").alias(x), F.col(column).alias(f"of_{x}")) for x in "ab")

    def run(batches):
        for batch in batches:
            good = [keep(x, y) for x, y in zip(batch.column("of_a").to_pylist(), batch.column("of_b").to_pylist(), strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    return pairs.join(one, "a").join(two, "b").select("a", "b", "of_a", "of_b").mapInArrow(tidied(run), "a long, b long")


def _alike(x: bytes, y: bytes) -> bool:
    return int((np.frombuffer(x, np.uint32) == np.frombuffer(y, np.uint32)).sum()) >= LEAST_EQUAL


def _near(x: bytes, y: bytes) -> bool:
    a, b = np.frombuffer(x, np.uint32), np.frombuffer(y, np.uint32)
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both >= SIMILARITY * (len(a) + len(b) - both)


def _sets_of(wanted: DataFrame, nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """Shingle sets of the ``wanted`` nodes; their texts are found by their smallest doc_id (those without one are few)."""
    named = wanted.join(nodes, "node").select("node", "key", "least")
    ids = named.where("least is not null").select(F.col("least").alias("wanted_id")).distinct()
    texts = docs.select("doc_id", "text")
    texts = texts.join(ids, texts.doc_id == F.col("wanted_id"), "left_semi").unionByName(texts.where("doc_id is null"))
    found = texts.select("text", text_key().alias("key")).join(named.select("node", "key"), "key").dropDuplicates(["node"])
    return materialise(_sets(found))


def _checked(pairs: DataFrame, nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs that are near copies."""
    likely = materialise(_kept(pairs, nodes, "minima", _alike))
    wanted = likely.select(F.col("a").alias("node")).union(likely.select("b")).distinct()
    return materialise(_kept(likely, _sets_of(wanted, nodes, docs), "shingles", _near))


def _tile_links(table: pa.Table) -> pa.Table:
    """A spanning forest of the near copies between a tile's two sides whose labels differ."""
    node, label = (table.column(c).to_numpy() for c in ("node", "label"))
    first = table.column("probing").to_numpy(zero_copy_only=False)
    sets = [np.frombuffer(x, np.uint32) for x in table.column("shingles").to_pylist()]
    size = np.array([len(x) for x in sets])
    words, of = np.unique(np.concatenate([np.empty(0, np.uint32), *sets]), return_inverse=True)
    at = np.concatenate([[0], np.cumsum(size)])
    other = np.flatnonzero(~first)
    flat = np.concatenate([np.empty(0, np.int64), *(of[at[k] : at[k + 1]] for k in other)]).astype(np.int64)
    owner = np.repeat(np.arange(len(other)), size[other])
    root = list(range(len(node)))

    def find(k):
        while root[k] != k:
            root[k] = root[root[k]]
            k = root[k]
        return k

    a, b, mark = [], [], np.zeros(len(words), bool)
    for k in np.flatnonzero(first):
        mark[of[at[k] : at[k + 1]]] = True
        both = np.bincount(owner[mark[flat]], minlength=len(other))
        mark[of[at[k] : at[k + 1]]] = False
        near = (both >= SIMILARITY * (size[k] + size[other] - both)) & (label[other] != label[k])
        for m in other[near].tolist():
            x, y = find(k), find(m)
            if x != y:
                root[x] = y
                a.append(node[k])
                b.append(node[m])
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def _tiled(probing: DataFrame, probed: DataFrame, nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """Near copies between two sides, each (group, node, label), within each group and across labels.

    Both sides are dealt to blocks of about ``TILE`` texts, and a tile is a
    block of each; a row for each tile and text, never for each pair.
    """
    count = lambda side, name: side.groupBy("group").agg(F.ceil(F.count("*") / TILE).cast("int").alias(name))
    salt = lambda n: F.pmod(F.xxhash64("node", "group"), F.col(n)).cast("int")
    sizes = count(probing, "across").join(count(probed, "down"), "group")
    left, right = probing.join(sizes, "group"), probed.join(sizes, "group")
    left = left.select("group", salt("across").alias("i"), F.explode(F.sequence(F.lit(0), F.col("down") - 1)).alias("j"), "node", "label", F.lit(True).alias("probing"))
    right = right.select("group", F.explode(F.sequence(F.lit(0), F.col("across") - 1)).alias("i"), salt("down").alias("j"), "node", "label", F.lit(False).alias("probing"))
    sets = _sets_of(probing.select("node").union(probed.select("node")).distinct(), nodes, docs)
    rows = left.unionByName(right).join(sets, "node")
    return materialise(rows.groupBy("group", "i", "j").applyInArrow(_tile_links, "a long, b long"))


def near_links(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(a, b): near copies among the nodes, enough of them to join whatever balls and bands bring together."""
    prints = nodes.groupBy("fp").agg(F.min("node").alias("lead"))
    of = lambda x: prints.select(F.col("fp").alias(x), F.col("lead").alias(f"of_{x}"))
    close = linked(prints.select("fp")).join(of("a"), "a").join(of("b"), "b").select(F.col("of_a").alias("x"), F.col("of_b").alias("y"))
    same = nodes.join(prints, "fp").where("node <> lead").select(F.col("lead").alias("x"), F.col("node").alias("y"))
    keys = nodes.select("node", F.explode("bands").alias("key"))
    leads = keys.groupBy("key").agg(F.min("node").alias("lead"), F.count("*").alias("n")).where("n > 1").select("key", "lead")
    shared = materialise(keys.join(leads, "key"))
    banded = shared.where("node <> lead").select(F.col("lead").alias("x"), F.col("node").alias("y"))
    pairs = close.unionByName(same).unionByName(banded).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    first = _checked(pairs, nodes, docs)
    # bands whose texts are still of several groups: what isn't of a band's main group is held against that group, ...
    placed = shared.join(components(first), "node", "left").select("key", "node", F.coalesce("component", "node").alias("label"))
    most = placed.groupBy("key", "label").count().groupBy("key").agg(F.max_by("label", F.struct("count", "label")).alias("main"), F.count("*").alias("labels")).where("labels > 1")
    mixed = materialise(placed.join(most, "key").select("key", "node", "label", "main"))
    outer = mixed.where("label <> main")
    members = mixed.where("label = main").select(F.col("main").alias("group"), "node", "label").distinct()
    links = first.unionByName(_tiled(outer.select(F.col("main").alias("group"), "node", "label").distinct(), members, nodes, docs))
    # ... and against what else of the band isn't
    left = outer.select(F.col("key").alias("group"), "node", "label")
    several = left.groupBy("group").agg(F.min("label").alias("a"), F.max("label").alias("b")).where("a <> b").select("group")
    left = materialise(left.join(several, "group"))
    return links.unionByName(_tiled(left, left, nodes, docs))


def _named(docs: DataFrame) -> DataFrame:
    """The distinct texts: node, key, least (smallest doc_id or null), root (the group's smallest node)."""
    marked = marks(docs)
    nodes = marked.groupBy("key").agg(F.min("doc_id").alias("least"), F.first("fp").alias("fp"), F.first("minima").alias("minima"), F.first("bands").alias("bands"))
    nodes = materialise(nodes.withColumn("node", F.monotonically_increasing_id()))
    joined = components(near_links(docs, nodes)).withColumnRenamed("component", "root")
    return nodes.join(joined, "node", "left").select("node", "key", "least", F.coalesce("root", "node").alias("root"))


def near_copies(docs: DataFrame) -> DataFrame:
    """Per row of ``docs``: doc_id and component_id, the smallest doc_id of its group (null if no row of the group has one).

    Only doc_id and text are read, whatever else ``docs`` holds. Words are what
    white space divides; A-Z count as a-z. Null and empty texts, and those
    without words, are near each other and no other. Texts of fewer than five
    words are one shingle; very long ones take memory for their shingles only. Rows that repeat a doc_id each get a
    row. An empty table gives no rows.
    """
    named = _named(docs)
    smallest = named.groupBy("root").agg(F.min("least").alias("component_id"))
    labels = named.join(smallest, "root").select("key", "component_id")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key().alias("key")).join(labels, "key").select("doc_id", "component_id")


def one_per_group(docs: DataFrame) -> DataFrame:
    """One row, with all its columns, of each group of near copies: that of the smallest doc_id.

    A row is known by its doc_id and its text: where rows repeat a doc_id with
    different texts, each text's group keeps its own, so no group goes without.
    Of a group's texts under the smallest doc_id the first by its key stays, of
    rows alike in both the first in the order of text and of all columns' hash.
    Rows without doc_id all stay, and no row goes because of them. An empty
    table stays empty; no name in ``docs`` clashes.
    """
    best = _named(docs).where("least is not null").groupBy("root").agg(F.min(F.struct("least", "key")).alias("best"))
    key, kept_id, kept_key, row = (fresh(docs, c) for c in ("key", "kept_id", "kept_key", "row"))
    kept = best.select(F.col("best.least").alias(kept_id), F.col("best.key").alias(kept_key))
    named = docs.where(F.col("doc_id").isNotNull()).withColumn(key, text_key())
    named = named.join(kept, (F.col("doc_id") == F.col(kept_id)) & (F.col(key) == F.col(kept_key)), "left_semi")
    order = F.struct(F.col("text"), F.xxhash64(*[F.to_json(F.struct(F.col(f"`{c}`"))) for c in docs.columns]))
    rows = named.groupBy("doc_id", key).agg(F.min_by(F.struct(*[F.col(f"`{c}`") for c in docs.columns]), order).alias(row))
    return rows.select(f"{row}.*").unionByName(docs.where(F.col("doc_id").isNull()))
