"""Exact substring dedup by fixed-block anchors.

Of every document only the non-overlapping blocks of ``block`` words are
indexed; every rolling window of ``block`` words of every document probes that
index. A repeat of ``2 * block - 1`` words or more always holds a whole aligned
block, so no repeat of that length is missed. Hits are extended word by word on
both sides: the ``2 * block - 1``-word windows that hold a hit anchor are
compared by a 64-bit hash within the owner's range of a second, independent one
(two different windows of n pass for equal with a probability of about n^2 /
2^65 over the number of owners: below 10^-3 for the 10^10 words of 60 GB), and
runs of equal windows join to maximal exact repeats.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import exchange as X
from .cluster import parquet
from .text import U64, column_bytes, hashed_words, mix, rolling, split_rows, tidy

RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string, spans array<struct<start:long,end:long>>"


def _valid(rows: np.ndarray, n: int, k: int) -> np.ndarray:
    """Which of the ``n - k + 1`` runs of ``k`` words lie in one row."""
    ok = np.zeros(max(0, n - k + 1), bool)
    if len(ok):
        ok[:] = rows[k - 1 :] == rows[: n - k + 1]
    return ok


def _ranked(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and each key's place among them."""
    order = np.argsort(keys).astype(np.int32)
    ranked = keys[order]
    new = np.ones(len(ranked), bool)
    new[1:] = ranked[1:] != ranked[:-1]
    place = np.empty(len(keys), np.int32)
    place[order] = np.cumsum(new, dtype=np.int32) - 1
    return ranked[new], place


class _Group:
    """What a group knows of its own words; made again in each phase rather than shipped."""

    def __init__(self, table: pa.Table, block: int, owners: int):
        self.block, self.window, self.owners = block, 2 * block - 1, owners
        ids = table.column("doc_id").to_pylist()
        texts = table.column("text").to_pylist() if None in ids else None
        order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0, (texts[i] or "") if ids[i] is None else ""))
        self.table = table.take(pa.array(order, pa.int64())) if len(ids) else table
        self.ids = [ids[i] for i in order]
        self.rank = np.cumsum([0] + [a != b or a is None for a, b in zip(self.ids[1:], self.ids, strict=False)], dtype=np.int32)[: len(ids)]
        self.words, self.bounds = hashed_words(*column_bytes(self.table.column("text")))
        self.rows = split_rows(self.bounds, len(self.words)).astype(np.int32)
        # anchors: key = owner, then 32 bits within its range
        self.at = np.flatnonzero(_valid(self.rows, len(self.words), block)).astype(np.int32)
        comp = rolling(self.words, block, 7)[self.at]
        comp = (X.by_range(comp, owners).astype(U64) << U64(32)) | (comp & U64(0xFFFFFFFF))
        self.anchors, self.anchor_of = _ranked(comp)
        del comp
        aligned = (self.at - self.bounds[self.rows[self.at]]) % block == 0 if len(self.at) else np.empty(0, bool)
        self.indexed = np.zeros(len(self.anchors), bool)
        self.indexed[self.anchor_of[aligned]] = True
        # an anchor that two documents of this group hold, one of them as a block
        low = np.full(len(self.anchors), np.iinfo(np.int32).max, np.int32)
        high = np.full(len(self.anchors), -1, np.int32)
        held = self.rank[self.rows[self.at]] if len(self.at) else self.at
        # words run in the order of documents: the first and last writers are the extremes
        low[self.anchor_of[::-1]] = held[::-1]
        high[self.anchor_of] = held
        self.shared = self.indexed & (low < high)

    @property
    def anchor_owner(self) -> np.ndarray:
        return (self.anchors >> U64(32)).astype(np.int32)

    def sent(self, g: int) -> pa.Table:
        return pa.Table.from_batches([X.packed(g, self.anchor_owner, self.owners, self.anchors.astype("<u4"), self.indexed)])

    def candidates(self, hit: np.ndarray) -> None:
        """Windows that hold a hit anchor, as distinct keys (owner from the second hash) in the order they are sent; frees the anchors."""
        n, starts = len(self.words), np.zeros(len(self.words) + 1, np.int32)
        for_window = self.at[(hit | self.shared)[self.anchor_of]]
        del self.at, self.anchors, self.anchor_of, self.indexed, self.shared
        np.add.at(starts, np.maximum(for_window - self.block + 1, 0), 1)
        np.add.at(starts, for_window + 1, -1)
        covered = np.cumsum(starts)[:n] > 0
        ok = _valid(self.rows, n, self.window)
        self.start = np.flatnonzero(ok & covered[: len(ok)]).astype(np.int32)
        del starts, for_window, covered, ok
        first = rolling(self.words, self.window, 13)[self.start]
        second = rolling(mix(self.words ^ U64(0x5851F42D4C957F2D)), self.window, 31)[self.start]
        owner = X.by_range(second, self.owners)
        order = np.lexsort((self.start, first, owner))
        new = np.ones(len(order), bool)
        if len(order) > 1:
            new[1:] = (first[order][1:] != first[order][:-1]) | (owner[order][1:] != owner[order][:-1])
        self.key_of = np.empty(len(order), np.int32)
        self.key_of[order] = np.cumsum(new) - 1
        lead = order[new]
        self.keys, self.key_owner = first[lead], owner[lead]
        doc = self.rank[self.rows[self.start]] if len(self.start) else self.start
        self.first_doc, self.doc = doc[lead], doc

    def covered(self, earlier: np.ndarray) -> np.ndarray:
        """Words of windows that start in a document with a smaller id, in an earlier group or in this one."""
        found = self.start[earlier[self.key_of] | (self.first_doc[self.key_of] < self.doc)]
        edge = np.zeros(len(self.words) + 1, np.int32)
        np.add.at(edge, found, 1)
        np.add.at(edge, found + self.window, -1)
        return np.cumsum(edge)[: len(self.words)] > 0


def _answer_anchor(table: pa.Table) -> pa.Table:
    """For each group and anchor: another group indexes it, or this one does and another probes it."""
    groups, keys, bounds = X.received(table, "<u4")
    index = np.concatenate([np.empty(0, np.uint8)] + [np.unpackbits(np.frombuffer(x, np.uint8), count=int(n)) for x, n in zip(table.column("extra").to_pylist(), np.diff(bounds), strict=True)]).astype(bool)
    order = np.argsort(keys, kind="stable")
    ranked = keys[order]
    head = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]])) if len(ranked) else np.empty(0, np.int64)
    run = np.diff(np.append(head, len(ranked)))
    indexed = np.repeat(np.add.reduceat(index[order].astype(np.int32), head) if len(head) else head, run)
    probed = np.repeat(run, run)
    bit = np.empty(len(keys), bool)
    bit[order] = (indexed - index[order] >= 1) | (index[order] & (probed >= 2))
    return X.reply_table(groups, table.column("p")[0].as_py(), [np.packbits(bit[a:b]).tobytes() for a, b in zip(bounds, bounds[1:], strict=False)])


def _answer_window(table: pa.Table) -> pa.Table:
    """For each group and window: a smaller group holds it."""
    groups, keys, bounds = X.received(table, "<u8")
    g = np.repeat(np.array(groups, np.int64), np.diff(bounds))
    order = np.lexsort((g, keys))
    ranked = keys[order]
    head = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]])) if len(ranked) else np.empty(0, np.int64)
    least = np.repeat(g[order][head], np.diff(np.append(head, len(ranked))))
    bit = np.empty(len(keys), bool)
    bit[order] = least < g[order]
    return X.reply_table(groups, table.column("p")[0].as_py(), [np.packbits(bit[a:b]).tobytes() for a, b in zip(bounds, bounds[1:], strict=False)])


def _parts(docs: DataFrame, block: int, schema: str, finished, carry: dict[str, str] | None = None) -> DataFrame:
    n = X.width(docs)
    deal = X.grouped(docs, n, carry)

    def probe(table):
        own = _Group(table, block, n)
        sent = own.sent(table.column("g")[0].as_py())
        del own
        tidy()
        return sent

    def verify(table, answers):
        if not table.num_rows:
            return pa.schema([("p", pa.int32()), ("g", pa.int32()), ("keys", pa.binary()), ("extra", pa.binary())]).empty_table()
        own = _Group(table, block, n)
        own.candidates(X.bit_replies(answers, own.anchor_owner))
        sent = pa.Table.from_batches([X.packed(table.column("g")[0].as_py(), own.key_owner, n, own.keys.astype("<u8"), None)])
        del own
        tidy()
        return sent

    def finish(table, answers):
        kind = answers.column("kind").to_numpy()
        own = _Group(table, block, n)
        own.candidates(X.bit_replies(answers.filter(pa.array(kind == 0)), own.anchor_owner))
        gone = own.covered(X.bit_replies(answers.filter(pa.array(kind == 1)), own.key_owner))
        out = finished(own, gone)
        del own, gone
        tidy()
        return out

    anchors = X.ask(deal.groupBy("g").applyInArrow(probe, X.SENT), n, _answer_anchor)
    windows = X.ask(deal.groupBy("g").cogroup(anchors.groupBy("g")).applyInArrow(verify, X.SENT), n, _answer_window)
    both = anchors.withColumn("kind", F.lit(0)).unionByName(windows.withColumn("kind", F.lit(1)))
    return deal.groupBy("g").cogroup(both.groupBy("g")).applyInArrow(finish, schema)


def _repeats(own: _Group, gone: np.ndarray) -> list[list[tuple[int, int]]]:
    """Per row the maximal repeats as word spans."""
    edges = np.diff(np.concatenate([[0], gone.astype(np.int8), [0]]))
    starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    # a repeat ends with its document
    cut = np.unique(own.bounds[1:-1])
    cut = cut[(cut > 0) & (cut < len(gone))]
    cut = cut[gone[cut] & gone[cut - 1]] if len(cut) else cut
    starts, ends = np.sort(np.concatenate([starts, cut])), np.sort(np.concatenate([ends, cut]))
    first = np.searchsorted(own.rows[starts] if len(starts) else starts, np.arange(len(own.ids) + 1))
    return [[(int(starts[k] - lo), int(ends[k] - lo)) for k in range(a, b)] for lo, a, b in zip(own.bounds, first, first[1:], strict=False)]


def _kept(text: str | None, repeats: list[tuple[int, int]]) -> bytes:
    words = (text or "").encode().split()
    for a, b in reversed(repeats):
        del words[a:b]
    return b" ".join(words)


def _report(own: _Group, gone: np.ndarray) -> pa.Table:
    repeats = _repeats(own, gone)
    digests = [hashlib.sha256(_kept(t, r)).hexdigest() for t, r in zip(own.table.column("text").to_pylist(), repeats, strict=True)]
    return pa.table({
        "doc_id": pa.array(own.ids, pa.int64()),
        "n_words": pa.array(np.diff(own.bounds), pa.int64()),
        "n_removed": pa.array([sum(b - a for a, b in r) for r in repeats], pa.int64()),
        "kept_sha256": pa.array(digests, pa.string()),
        "spans": pa.array([[{"start": a, "end": b} for a, b in r] for r in repeats], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
    })


def remove_repeats(docs: DataFrame, block: int = 7) -> DataFrame:
    """Per document: words, words removed, the digest of the kept words, and the removed maximal repeats as word spans.

    ``docs`` needs doc_id and text; other columns are ignored, whatever their
    names. A word goes if a window of ``2 * block - 1`` words that covers it also
    starts in a document with a smaller doc_id, judged on the input. Null and
    empty texts have no words. Rows that repeat a doc_id count as one document
    for that comparison and each gets its row; rows without doc_id come after
    all others, each on its own, in an order of their texts' hashes. A very long
    text is held whole by one task. An empty table gives no rows.
    """
    return _parts(docs, block, RESULT, _report)


def without_repeats(docs: DataFrame, block: int = 7) -> DataFrame:
    """The rows of ``docs``, with all their columns, without the words that ``remove_repeats`` removes.

    Texts that lose words are their kept words joined by one space, and n_chars,
    where there is such a column, counts what is left; other texts stay as they
    are. No row goes, not even one that loses all its words. Nulls, repeated
    ids, ties and empty tables are taken as ``remove_repeats`` takes them.
    """
    names = [c for c in docs.columns if c not in ("doc_id", "text")]
    carry, order = {c: f"c{k}" for k, c in enumerate(names)}, docs.columns

    def rewritten(own: _Group, gone: np.ndarray) -> pa.Table:
        old = own.table.column("text").to_pylist()
        new = [_kept(t, r).decode() if r else t for t, r in zip(old, _repeats(own, gone), strict=True)]
        out = {}
        for c in order:
            column = own.table.column(carry.get(c, c))
            if c == "text":
                column = pa.array(new, pa.string())
            elif c == "n_chars":
                column = pa.array([n if a == b else len(b) for n, a, b in zip(column.to_pylist(), old, new, strict=True)], column.type)
            out[c] = column
        return pa.table(out)

    return _parts(docs, block, docs.schema, rewritten, carry)


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(parquet(spark, sf_dir, "documents")).drop("spans")
