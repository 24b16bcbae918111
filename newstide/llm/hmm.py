"""A hidden Markov language model over whole corpora.

States emit word classes (a hash of a word's last three bytes; short words are
classes of their own) and each class emits its words by their counts in the
whole training corpus. The words of a class that training has not seen are one
type, to which the Good-Turing share of once-seen tokens goes. The state tables
have a fixed size and are trained by Baum-Welch, whose expected counts are
summed across partitions; word counts grow with the corpus and stay distributed
(see ``exchange``).
Texts are scored by the scaled forward recursion over all of their tokens.
"""

from __future__ import annotations

import math
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import exchange as X
from .cluster import parquet
from .partials import sum_over
from .text import LOWER, U64, column_bytes, mix, slices, spans, word_hashes

RESULT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
END_KEY = U64(0xF3E1D5C7B9AB9D8F)


@dataclass(frozen=True)
class Settings:
    states: int = 8
    classes: int = 2048
    #: Tokens over which the first class distributions are told apart, before any training.
    segment: int = 32
    #: Full Baum-Welch passes over all training documents.
    passes: int = 2
    #: About how many documents, and characters of each, choose where training starts; all of them train.
    seed_docs: int = 1200
    seed_chars: int = 2000
    #: Longer texts are taken in chunks, joined exactly by the chunks' transfer matrices; results don't depend on it.
    chunk: int = 2048


def word_classes(buf: np.ndarray, start: np.ndarray, end: np.ndarray, classes: int) -> np.ndarray:
    """Class of each word from its last three bytes."""
    if not len(start):
        return np.empty(0, np.int32)
    last = np.zeros(len(start), U64)
    for back in (1, 2, 3):
        at = end - back
        last = last * U64(257) + np.where(at >= start, buf[np.maximum(at, 0)].astype(U64) + U64(1), U64(0))
    return (mix(last) % U64(classes)).astype(np.int32)


def _sequences(table: pa.Table | pa.RecordBatch, classes: int):
    """Per slice of rows: lower-cased bytes, word bounds, classes with an end after each row's words, row bounds of those."""
    buf, bounds = column_bytes(table.column("text"))
    for i, j in slices(bounds, 4 << 20):
        part, own = LOWER[buf[bounds[i] : bounds[j]]], bounds[i : j + 1] - bounds[i]
        s, e, rows = spans(part, own)
        tokens = np.full(len(s) + j - i, classes, np.int32)
        place = np.arange(len(s)) + np.repeat(np.arange(j - i), np.diff(rows))
        tokens[place] = word_classes(part, s, e, classes)
        yield i, j, part, s, e, rows, tokens, rows + np.arange(j - i + 1), place


@dataclass
class Model:
    start: np.ndarray
    trans: np.ndarray
    emit: np.ndarray  # symbols x states

    @staticmethod
    def from_counts(x: np.ndarray, k: int, m: int) -> Model:
        start, trans, emit = np.split(x[: k + k * k + (m + 1) * k], [k, k + k * k])
        one = lambda v, axis=None: v / v.sum(axis=axis, keepdims=axis is not None)
        share = one(emit.reshape(m + 1, k).sum(1) + 1e-3)[:, None]
        return Model(one(start + 0.1), one(trans.reshape(k, k) + 0.1, 1), one(emit.reshape(m + 1, k) + share * 2.0, 0))


def _chunks(bounds: np.ndarray, chunk: int) -> tuple[np.ndarray, ...]:
    """The row, number within the row, first symbol and size of every chunk."""
    per = -(-np.diff(bounds) // chunk)
    row = np.repeat(np.arange(len(per)), per)
    nth = np.arange(len(row)) - np.repeat(np.cumsum(per) - per, per)
    begin = bounds[row] + nth * chunk
    return row, nth, begin, np.minimum(bounds[row + 1] - begin, chunk)


def _living(size: np.ndarray) -> np.ndarray:
    """How many of the falling sizes reach each step."""
    return np.searchsorted(-size, -np.arange(1, int(size[0]) + 1), "right")


def _moves(model: Model, tokens: np.ndarray, begin: np.ndarray, size: np.ndarray, head: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each chunk's matrix from the states before it to those at its end, scaled, and the log of the scale."""
    k = model.trans.shape[0]
    order = np.argsort(-size, kind="stable")
    b, first = begin[order], head[order]
    move, total = np.broadcast_to(np.eye(k), (len(b), k, k)).copy(), np.zeros(len(b))
    for t, a in enumerate(_living(size[order])):
        # a text's first symbol needs no transition before it
        step = move[:a] @ (model.trans if t else np.where(first[:a, None, None], np.eye(k), model.trans))
        step *= model.emit[tokens[b[:a] + t]][:, None, :]
        s = step.sum((1, 2))
        move[:a] = step / s[:, None, None]
        total[:a] += np.log(s)
    back = np.argsort(order)
    return move[back], total[back]


def expected_counts(model: Model, tokens: np.ndarray, bounds: np.ndarray, chunk: int, lanes: int = 4096) -> np.ndarray:
    """Expected start, transition and emission counts and the log-likelihood of whole rows of symbols.

    Chunks are lanes that run side by side; what arrives at a chunk from those
    before it, and what those after it send back, comes from transfer matrices,
    so every transition of a text is counted.
    """
    k, m = model.trans.shape[0], len(model.emit)
    out_start, out_trans, out_emit, likelihood = np.zeros(k), np.zeros((k, k)), np.zeros((m, k)), 0.0
    row, nth, begin, size = _chunks(bounds, chunk)
    arrive, leave = np.zeros((len(row), k)), np.ones((len(row), k))
    several = np.flatnonzero(np.bincount(row, minlength=len(bounds) - 1)[row] > 1)
    if len(several):
        move, _ = _moves(model, tokens, begin[several], size[several], nth[several] == 0)
        alpha = model.start
        for p, c in enumerate(several):
            if nth[c]:
                arrive[c] = alpha
            else:
                alpha = model.start
            alpha = alpha @ move[p]
            alpha = alpha / alpha.sum()
        for p in range(len(several) - 1, 0, -1):
            c = several[p]
            if nth[c]:
                back = move[p] @ leave[c]
                leave[several[p - 1]] = back / back.max()
    order = np.argsort(-size, kind="stable")
    for lane in (order[i : i + lanes] for i in range(0, len(order), lanes)):
        b, first, after = begin[lane], nth[lane] == 0, leave[lane]
        live = _living(size[lane])
        steps = len(live)
        alpha, scale, emitted, seen = [], [], [], []
        for t in range(steps):
            a = live[t]
            seen.append(tokens[b[:a] + t])
            emitted.append(model.emit[seen[t]])
            x = (alpha[-1][:a] @ model.trans if t else np.where(first[:, None], model.start, arrive[lane] @ model.trans)) * emitted[t]
            scale.append(x.sum(1))
            alpha.append(x / scale[t][:, None])
            likelihood += np.log(scale[t]).sum()
        beta, gammas = np.empty((0, k)), [None] * steps
        for t in range(steps - 1, -1, -1):
            ending = slice(live[t + 1] if t + 1 < steps else 0, live[t])
            last = after[ending]
            beta = np.concatenate([beta, last / (alpha[t][ending] * last).sum(1, keepdims=True)])
            gammas[t] = alpha[t] * beta
            tail = emitted[t] * beta / scale[t][:, None]
            if t:
                out_trans += alpha[t - 1][: live[t]].T @ tail
                beta = tail @ model.trans.T
            else:
                out_trans += arrive[lane][~first].T @ tail[~first]
        out_start += gammas[0][first].sum(0)
        symbols, weights = np.concatenate(seen), np.concatenate(gammas)
        for s in range(k):
            out_emit[:, s] += np.bincount(symbols, weights[:, s], m)
    return np.concatenate([out_start, (out_trans * model.trans).ravel(), out_emit.ravel(), [likelihood]])


def forward(model: Model, tokens: np.ndarray, bounds: np.ndarray, chunk: int) -> np.ndarray:
    """Exact natural-log likelihood of each row's symbols (every row has at least one)."""
    size = np.diff(bounds)
    out = np.zeros(len(size))
    short = np.flatnonzero(size <= chunk)
    short = short[np.argsort(-size[short], kind="stable")]
    if len(short):
        b = bounds[short]
        alpha, total = None, np.zeros(len(short))
        for t, a in enumerate(_living(size[short])):
            alpha = (model.start if alpha is None else alpha[:a] @ model.trans) * model.emit[tokens[b[:a] + t]]
            s = alpha.sum(1)
            alpha /= s[:, None]
            total[:a] += np.log(s)
        out[short] = total
    row, nth, begin, length = _chunks(bounds, chunk)
    long = np.flatnonzero(size[row] > chunk)
    if len(long):
        # all chunks of all long texts at once, then each text's product of them
        move, total = _moves(model, tokens, begin[long], length[long], nth[long] == 0)
        for p, c in enumerate(long):
            alpha = (alpha if nth[c] else model.start) @ move[p]
            s = alpha.sum()
            alpha, out[row[c]] = alpha / s, out[row[c]] + total[p] + math.log(s)
    return out


def _seeded(texts: list[str], s: Settings) -> Model:
    """Where training starts: a mixture of class distributions over segments of a bounded sample, then Baum-Welch there."""
    k, m, rng = s.states, s.classes, np.random.default_rng(5)
    parts = [(t, b) for *_, t, b, _ in _sequences(pa.table({"text": pa.array(texts, pa.string())}), m)]
    shift = np.cumsum([0, *(len(t) for t, _ in parts)])
    tokens = np.concatenate([np.empty(0, np.int32), *(t for t, _ in parts)])
    bounds = np.concatenate([np.zeros(1, np.int64), *(b[1:] + z for (_, b), z in zip(parts, shift, strict=False))])
    size = 1 + k + k * k + (m + 1) * k
    if not len(tokens):
        return Model.from_counts(np.zeros(size), k, m)
    seg = np.arange(len(tokens)) // s.segment
    weight = rng.dirichlet(np.full(k, 0.3), seg[-1] + 1)
    for _ in range(25):
        emit = np.stack([np.bincount(tokens, weight[seg, j], m + 1) for j in range(k)], 1)
        emit = (emit + 0.05) / (emit + 0.05).sum(0)
        log = np.log(emit)[tokens]
        score = np.stack([np.bincount(seg, log[:, j]) for j in range(k)], 1) + np.log(weight.mean(0) + 1e-9)
        weight = np.exp(score - score.max(1, keepdims=True))
        weight /= weight.sum(1, keepdims=True)
    model = Model(np.full(k, 1 / k), np.full((k, k), 0.05 / k) + np.eye(k) * 0.95, emit)
    for _ in range(4):
        model = Model.from_counts(expected_counts(model, tokens, bounds, s.chunk), k, m)
    return model


def train(docs: DataFrame, s: Settings = Settings()) -> tuple[Model, np.ndarray]:
    """The model and the tokens of each class, from all ``docs``.

    Only where training starts comes from a sample; class counts and every
    Baum-Welch pass take all whole texts.
    """

    def tally(batch):
        return sum((np.bincount(tokens, minlength=s.classes + 1) for *_, tokens, _, _ in _sequences(batch, s.classes)), np.zeros(s.classes + 1))

    total = sum_over(docs, ["text"], tally)
    total = np.zeros(s.classes + 1) if total is None else total
    place = f"substring(text, 1 + cast(pmod(xxhash64(doc_id, 1), greatest(length(text) - {s.seed_chars}, 1)) as int), {s.seed_chars})"
    # a share by hash rather than a sort's first rows, which every partition would send in full
    share = min(1.0, s.seed_docs / max(docs.count(), 1))
    chosen = docs.where(F.pmod(F.xxhash64("doc_id", F.lit(2)), F.lit(1 << 30)) < int(share * (1 << 30)) + 1)
    sample = chosen.where("text is not null").select(F.xxhash64("doc_id", F.lit(2)).alias("o"), F.expr(place).alias("text"))
    sample = sample.orderBy("o", "text").limit(2 * s.seed_docs)
    model = _seeded([r.text for r in sample.collect()], s)
    for _ in range(s.passes):
        now = model

        def estep(batch, now=now):
            return sum((expected_counts(now, tokens, rows, s.chunk) for *_, tokens, rows, _ in _sequences(batch, s.classes)), np.zeros(s.states + s.states**2 + (s.classes + 1) * s.states + 1))

        counts = sum_over(docs, ["text"], estep)
        if counts is not None:
            model = Model.from_counts(counts, s.states, s.classes)
    return model, total


class _Group:
    def __init__(self, table: pa.Table, s: Settings):
        self.ids = table.column("doc_id").to_pylist()
        self.held = np.array([zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2 for i in self.ids], bool)
        hashes, self.sizes = [np.empty(0, U64)], [np.empty(0, np.int64)]
        self.table, self.s = table, s
        for _, _, part, st, en, rows, *_ in _sequences(table, s.classes):
            hashes.append(word_hashes(part, st, en))
            self.sizes.append(np.diff(rows))
        self.sizes = np.concatenate(self.sizes)
        words = np.concatenate(hashes)
        self.keys, self.of = np.unique(np.append(words, END_KEY), return_inverse=True)
        self.of, self.end = self.of[:-1], self.of[-1]

    def sent(self, g: int, owners: int) -> pa.Table:
        learned = np.repeat(~self.held, self.sizes)
        counts = np.bincount(self.of[learned], minlength=len(self.keys))
        counts[self.end] += (~self.held).sum()
        return pa.Table.from_batches([X.packed(g, X.by_range(self.keys, owners), owners, self.keys.astype("<u8"), counts.astype("<u4"))])

    def scored(self, answers: pa.Table, model: Model, totals: np.ndarray) -> pa.Table:
        s = self.s
        count = np.concatenate([np.empty(0, np.int64)] + [np.frombuffer(x[1:], "<u4" if x[:1] == b"4" else "<u8").astype(np.int64) for x in X.replies(answers) if x])
        stats = np.array(answers.column("stats").to_pylist(), np.int64).sum(0)
        n_train, vocabulary, once = map(int, stats)
        unseen = min(0.5, max(1e-9, once / max(n_train, 1)))
        c = count[self.of]
        floor = math.log10(n_train + vocabulary + 1)
        docs = len(self.ids)
        row = np.repeat(np.arange(docs), self.sizes)
        end = int(count[self.end])
        base = np.bincount(row, np.log10(c + 1.0) - floor, docs) + math.log10(end + 1) - floor
        known = np.bincount(row, c > 0, docs).astype(np.int64) + (end > 0)
        score, at = np.empty(docs), 0
        for i, j, part, st, en, rows, tokens, bounds, place in _sequences(self.table, s.classes):
            here = forward(model, tokens, bounds, s.chunk)
            total, own = totals[tokens[place]], c[at : at + len(st)]
            word = np.where(own > 0, (1 - unseen) * own / np.maximum(total, 1), np.where(total > 0, unseen, 1.0))
            score[i:j] = (here + np.bincount(np.repeat(np.arange(j - i), np.diff(rows)), np.log(word), j - i)) / math.log(10)
            at += len(st)
        return pa.table({"doc_id": pa.array(self.ids, pa.int64()), "held_out": pa.array(self.held), "n_tokens": pa.array(self.sizes + 1, pa.int64()), "n_known": pa.array(known, pa.int64()), "train_tokens": pa.array([n_train] * docs, pa.int64()), "base_score": pa.array(base), "score": pa.array(score)})


def score(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """Per document its log10 probability under the hidden Markov model and under add-one unigrams.

    ``docs`` needs doc_id and text; other columns are ignored. Documents whose
    crc32(doc_id as text; null: empty) mod 7 is 2 are held out of all training.
    Null and empty texts are one end token. Repeated rows are scored, and
    learned from, one by one; rows without doc_id are held out or not by the
    empty id. Very long texts are scored whole, in chunks joined exactly. An
    empty table gives no rows. Unseen words are one type for each word class,
    against the base's one type, so the two scores' perplexities aren't alike.
    """
    learned = docs.where(F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(7)) != 2)
    model, totals = train(learned, s)
    n = X.width(docs)
    # any groups will do, so a hash deals them: even in rows whatever the ids, those without one included
    deal = docs.select(F.pmod(F.xxhash64("doc_id", "text"), F.lit(n)).cast("int").alias("g"), F.col("doc_id").cast("long").alias("doc_id"), "text").repartition(n, "g")

    def send(table):
        return _Group(table, s).sent(table.column("g")[0].as_py(), n)

    def answer(table):
        groups, keys, bounds = X.received(table, "<u8")
        counts = np.concatenate([np.empty(0, np.int64)] + [np.frombuffer(x, "<u4").astype(np.int64) for x in table.column("extra").to_pylist()])
        distinct, of = np.unique(keys, return_inverse=True)
        total = np.bincount(of, counts, len(distinct)).astype(np.int64)
        stats = [int(total.sum()), int((total > 0).sum()), int((total == 1).sum())]
        kind, mark = ("<u4", b"4") if total.max(initial=0) < 1 << 32 else ("<u8", b"8")
        blobs = {g: mark + total[of[a:b]].astype(kind).tobytes() for g, a, b in zip(groups, bounds, bounds[1:], strict=False)}
        # every group learns the totals, also of owners that it asked nothing
        return X.reply_table(list(range(n)), table.column("p")[0].as_py(), [blobs.get(g, b"") for g in range(n)], [stats] * n)

    def finish(table, answers):
        return _Group(table, s).scored(answers, model, totals) if table.num_rows else _EMPTY

    replies = X.ask(deal.groupBy("g").applyInArrow(send, X.SENT), n, answer)
    return deal.groupBy("g").cogroup(replies.groupBy("g")).applyInArrow(finish, RESULT)


_EMPTY = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())]).empty_table()


def op5_hmm_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(parquet(spark, sf_dir, "documents"))
