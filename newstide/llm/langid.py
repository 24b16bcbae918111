"""Language identification by a bidirectional gated recurrent network over bytes.

The network labels every byte of a text; a document's probabilities are the
means over its bytes. It is trained in numpy by backpropagation through time on
windows of the whole texts of a bounded, documented number of training
documents. A text is read whole in both directions: its chunks run side by side,
each from the state that its neighbour ends with, and run again until no
neighbour's state changes.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .cluster import parquet
from .text import column_bytes, slices

RESULT = "doc_id long, held_out boolean, lang_pred string, score double"
UNKNOWN = "und"
#: Steps whose probabilities are computed at once.
TOGETHER = 16


@dataclass(frozen=True)
class Settings:
    hidden: int = 8
    #: Bytes of a training window.
    segment: int = 96
    #: Training documents a language: one from each of so many hash cells.
    cells: int = 400
    steps: int = 250
    batch: int = 256
    rate: float = 0.01
    #: Bytes of a chunk in prediction, and of the warm-up that first guesses the state its neighbour ends with.
    chunk: int = 1024
    warm: int = 384
    #: Largest difference of a state below which it counts as settled.
    settled: float = 1e-4
    #: Chunks predicted at once.
    lanes: int = 1024


def _sigmoid(x):
    return 0.5 + 0.5 * np.tanh(0.5 * x)


class Cell:
    """One direction's gated recurrent unit; arrays are features x lanes. Gates: update, reset, candidate."""

    def __init__(self, rng: np.random.Generator, h: int):
        self.h = h
        self.table = (rng.normal(size=(3 * h, 256)) * 0.5).astype(np.float32)  # each byte's input to the gates, bias included
        self.rec = (rng.normal(size=(3 * h, h)) / np.sqrt(h)).astype(np.float32)

    def params(self) -> list[np.ndarray]:
        return [self.table, self.rec]

    def run(self, codes: np.ndarray):
        """States after each step for codes (steps x lanes), from zero, and what backpropagation needs."""
        h, lanes = self.h, codes.shape[1]
        state, states, kept = np.zeros((h, lanes), np.float32), [], []
        for row in codes:
            x = self.table[:, row]
            gates = _sigmoid(x[: 2 * h] + self.rec[: 2 * h] @ state)
            z, r = gates[:h], gates[h:]
            gated = r * state
            n = np.tanh(x[2 * h :] + self.rec[2 * h :] @ gated)
            kept.append((state, x, z, r, gated, n))
            state = n + z * (state - n)
            states.append(state)
        return states, kept

    def states(self, codes: np.ndarray, state: np.ndarray | None = None, live: np.ndarray | None = None, every: bool = True) -> np.ndarray:
        """As ``run``, from ``state`` (else zero) and in place: steps x features x lanes, or the last state only.

        Where ``live`` (steps x lanes) is false a lane's state stays.
        """
        h, (steps, lanes) = self.h, codes.shape
        half = np.where(np.arange(3 * h) < 2 * h, np.float32(0.5), np.float32(1))[:, None]  # of the sigmoids' tanh
        table, rec = half * self.table, half * self.rec
        state = np.zeros((h, lanes), np.float32) if state is None else state
        out = np.empty((steps if every else 2, h, lanes), np.float32)
        x, gates, n = (np.empty((k * h, lanes), np.float32) for k in (3, 2, 1))
        for t in range(steps):
            np.take(table, codes[t], 1, x, "clip")
            np.matmul(rec[: 2 * h], state, gates)
            gates += x[: 2 * h]
            np.tanh(gates, gates)
            gates *= 0.5
            gates += 0.5
            z, gated = gates[:h], gates[h:]
            gated *= state
            np.matmul(rec[2 * h :], gated, n)
            n += x[2 * h :]
            np.tanh(n, n)
            then = out[t if every else t % 2]
            np.subtract(state, n, then)
            then *= z
            then += n
            if live is not None:
                np.copyto(then, state, where=~live[t])
            state = then
        return out if every else state

    def back(self, codes: np.ndarray, kept, grads: np.ndarray) -> list[np.ndarray]:
        """Gradients of the table and the recurrence from those of the states (steps x features x lanes)."""
        h = self.h
        d_rec, carry, pres = np.zeros_like(self.rec), 0.0, []
        for t in range(len(kept) - 1, -1, -1):
            state, x, z, r, gated, n = kept[t]
            d = grads[t] + carry
            d_n = d * (1 - z) * (1 - n * n)
            d_gated = self.rec[2 * h :].T @ d_n
            d_z = d * (state - n) * z * (1 - z)
            d_r = d_gated * state * r * (1 - r)
            pre = np.concatenate([d_z, d_r, d_n])
            d_rec[: 2 * h] += pre[: 2 * h] @ state.T
            d_rec[2 * h :] += d_n @ gated.T
            pres.append(pre)
            carry = d * z + d_gated * r + self.rec[: 2 * h].T @ pre[: 2 * h]
        every, flat = np.concatenate(pres[::-1], 1), codes.ravel()
        return [np.stack([np.bincount(flat, row, 256) for row in every]).astype(self.table.dtype), d_rec]


class Network:
    def __init__(self, languages: list[str], s: Settings, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.languages, self.s = languages, s
        self.ahead, self.behind = Cell(rng, s.hidden), Cell(rng, s.hidden)
        self.out = (rng.normal(size=(len(languages), 2 * s.hidden)) * 0.1).astype(np.float32)
        self.bias = np.zeros((len(languages), 1), np.float32)

    def params(self) -> list[np.ndarray]:
        return [*self.ahead.params(), *self.behind.params(), self.out, self.bias]

    @staticmethod
    def _soften(logits: np.ndarray) -> np.ndarray:
        e = np.exp(logits - logits.max(0))
        return e / e.sum(0)

    def gradients(self, codes: np.ndarray, label: np.ndarray, live: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """Mean cross-entropy over all live positions (steps x lanes) and its gradients."""
        f, kept_f = self.ahead.run(codes)
        b, kept_b = self.behind.run(codes[::-1])
        h, total, loss = self.s.hidden, max(1, int(live.sum())), 0.0
        d_f, d_b = [None] * len(codes), [None] * len(codes)
        d_out, d_bias = np.zeros_like(self.out), np.zeros_like(self.bias)
        for t in range(len(codes)):
            both = np.concatenate([f[t], b[len(codes) - 1 - t]])
            p = self._soften(self.out @ both + self.bias)
            loss -= float((np.log(p[label, np.arange(len(label))] + 1e-9) * live[t]).sum())
            p[label, np.arange(len(label))] -= 1
            p *= live[t] / total
            d_out += p @ both.T
            d_bias += p.sum(1, keepdims=True)
            d = self.out.T @ p
            d_f[t], d_b[len(codes) - 1 - t] = d[:h], d[h:]
        return loss / total, [*self.ahead.back(codes, kept_f, d_f), *self.behind.back(codes[::-1], kept_b, d_b), d_out, d_bias]

    def train(self, codes: np.ndarray, label: np.ndarray, size: np.ndarray, seed: int = 3) -> None:
        """Adam over random batches of segments (lanes x steps)."""
        s, rng = self.s, np.random.default_rng(seed)
        first = [np.zeros_like(p) for p in self.params()]
        second = [np.zeros_like(p) for p in self.params()]
        by = [np.flatnonzero(label == k) for k in range(len(self.languages))]
        for step in range(1, s.steps + 1):
            pick = np.concatenate([rng.choice(rows, max(1, s.batch // len(by))) for rows in by])
            live = (np.arange(s.segment)[:, None] < size[pick]).astype(np.float32)
            _, grads = self.gradients(codes[pick].T, label[pick], live)
            rate = s.rate * (1 - step / (s.steps + 1)) + 1e-4
            for p, g, m, v in zip(self.params(), grads, first, second, strict=True):
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                p -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)).astype(np.float32)

    def _chunk_sums(self, codes: np.ndarray, live: np.ndarray, ahead: np.ndarray, behind: np.ndarray) -> tuple[np.ndarray, ...]:
        """Sum over each lane's live positions of their probabilities (languages x lanes), and the states that both directions end with."""
        full = bool(live.all())  # as most chunks are: nothing to mask
        f = self.ahead.states(codes, ahead, None if full else live)
        b = self.behind.states(codes[::-1], behind, None if full else live[::-1])
        h, out, back = self.s.hidden, np.zeros((len(self.languages), codes.shape[1]), np.float32), b[::-1]
        for i in range(0, len(codes), TOGETHER):
            p = np.matmul(self.out[:, :h], f[i : i + TOGETHER])
            p += np.matmul(self.out[:, h:], back[i : i + TOGETHER])
            p += self.bias
            p -= p.max(1, keepdims=True)
            np.exp(p, p)
            p /= p.sum(1, keepdims=True)
            if not full:
                p *= live[i : i + TOGETHER, None]
            out += p.sum(0)
        return out, f[-1].copy(), b[-1].copy()

    def pooled(self, buf: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Mean probabilities (rows x languages) over all bytes of each row, both directions carried through the whole row."""
        s, size = self.s, np.diff(bounds)
        warm = min(s.warm, s.chunk)
        per = -(-size // s.chunk)
        row = np.repeat(np.arange(len(size)), per)
        nth = np.arange(len(row)) - np.repeat(np.cumsum(per) - per, per)
        begin = bounds[row] + nth * s.chunk
        length = np.minimum(bounds[row + 1] - begin, s.chunk)
        padded = np.concatenate([buf, np.zeros(s.chunk, np.uint8)])
        total = np.zeros((len(self.languages), len(row)))
        into = [np.zeros((s.hidden, len(row)), np.float32) for _ in range(2)]
        later = np.flatnonzero(nth > 0)  # chunks with one before them in their row
        # first guesses: what a few bytes before a chunk, or after it, lead to
        for i in range(0, len(later), s.lanes):
            lane = later[i : i + s.lanes]
            into[0][:, lane] = self.ahead.states(padded[begin[lane] - warm + np.arange(warm)[:, None]], every=False)
            steps = np.arange(warm)[:, None]
            live = steps < length[lane]
            into[1][:, lane - 1] = self.behind.states(padded[begin[lane] + steps][::-1], live=live[::-1], every=False)
        todo, ends = np.arange(len(row)), [np.zeros((s.hidden, len(row)), np.float32) for _ in range(2)]
        while len(todo):
            by_size = todo[np.argsort(-length[todo], kind="stable")]
            for i in range(0, len(by_size), s.lanes):
                lane = by_size[i : i + s.lanes]
                steps = np.arange(int(length[lane[0]]))[:, None]
                live = steps < length[lane]
                codes = np.where(live, padded[begin[lane] + steps], 0)
                total[:, lane], ends[0][:, lane], ends[1][:, lane] = self._chunk_sums(codes, live, into[0][:, lane], into[1][:, lane])
            moved = np.zeros(len(row), bool)
            for side, here, there in ((0, later, later - 1), (1, later - 1, later)):
                new = ends[side][:, there]
                off = np.abs(new - into[side][:, here]).max(0, initial=0) > s.settled
                into[side][:, here[off]] = new[:, off]
                moved[here[off]] = True
            todo = np.flatnonzero(moved)
        out = np.stack([np.bincount(row, t, len(size)) for t in total], 1)
        return out / np.maximum(size, 1)[:, None]


def fit(docs: DataFrame, s: Settings = Settings()) -> Network | None:
    """Train on the whole texts of one hash-chosen document of every cell of every language; None if no document has a language.

    ``cells`` documents a language are the bound of the sample; rows without doc_id aren't in it.
    """
    known = docs.where("doc_id is not null and lang is not null and text is not null and text <> ''").where(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) != 2)
    known = known.select("lang", "doc_id", "text", F.xxhash64("doc_id", F.lit(5)).alias("h")).withColumn("cell", F.pmod("h", F.lit(s.cells)))
    chosen = known.groupBy("lang", "cell").agg(F.min_by("doc_id", F.struct("h", "doc_id")).alias("doc_id"))
    rows = known.join(F.broadcast(chosen), ["lang", "cell", "doc_id"]).groupBy("lang", "cell").agg(F.min("text").alias("text")).orderBy("lang", "cell").collect()
    languages = sorted({r.lang for r in rows})
    if not languages:
        return None
    codes, label, size = [], [], []
    for r in rows:
        raw = np.frombuffer(r.text.encode(), np.uint8)
        n = -(-len(raw) // s.segment)
        codes.append(np.pad(raw, (0, n * s.segment - len(raw))).reshape(n, s.segment))
        label.append(np.full(n, languages.index(r.lang)))
        size.append(np.minimum(len(raw) - np.arange(n) * s.segment, s.segment))
    net = Network(languages, s)
    net.train(np.concatenate(codes), np.concatenate(label), np.concatenate(size))
    return net


def identify(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """Per row of ``docs``: doc_id, held_out, lang_pred and the pooled probability of that language.

    Only doc_id, text and, for training, lang are read. Documents whose
    crc32(doc_id as text; null: empty) mod 4 is 2 are held out of training; null
    languages teach nothing. Null texts and texts without a letter are ``und``
    with score 0; so is everything if no language can be learned. Equal means go
    to the first language in order. Repeated rows are predicted one by one.
    Very long texts are read whole, in chunks that settle on each other's states
    to within ``settled``. An empty table gives no rows.
    """
    net = fit(docs, s)

    def run(batches):
        import regex

        letter = regex.compile(r"\p{L}")
        for batch in batches:
            column = batch.column("text")
            buf, bounds = column_bytes(column)
            names, scores = [], []
            for i, j in slices(bounds):
                p = net.pooled(buf[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i]) if net else np.zeros((j - i, 1))
                best = p.argmax(1)
                for text, k, x in zip(column[i:j].to_pylist(), best.tolist(), p[np.arange(j - i), best].tolist(), strict=True):
                    known = net is not None and text is not None and letter.search(text) is not None
                    names.append(net.languages[k] if known else UNKNOWN)
                    scores.append(min(1.0, x) if known else 0.0)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    held = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(4)) == 2
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), held.alias("held_out"), "text").mapInArrow(run, RESULT)


def op6_byte_gru_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(parquet(spark, sf_dir, "documents"))
