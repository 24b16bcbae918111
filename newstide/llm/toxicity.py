"""Toxicity by noisy-channel deobfuscation.

A token that isn't plain letters is read as a noisy copy of a word: its
characters span a lattice (a sign may stand for a letter, separate letters or
be noise; a repeated letter may be one), and Viterbi decoding under a character
trigram model finds the likeliest letters. Words, restored or plain, are then
weighed by how surely they mark toxic documents, and what they say together is
calibrated on the same labels.
"""

from __future__ import annotations

import math
import unicodedata
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .cluster import parquet
from .partials import sum_over
from .text import LOWER, column_bytes, slices, spans, tidied

RESULT = "doc_id long, held_out boolean, score double, predicted int, words array<string>"

#: Readings that a task keeps.
KEPT = 60_000

#: Letters that a sign may stand for.
STANDS_FOR = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "<": "c", "€": "e", "£": "l", "¡": "i", "§": "s"}
#: Signs around a word that aren't part of it.
AROUND = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~«»“”’…"
#: Letters up to which a squeezed key stands for no word: too many words share it.
SHORT = 3
#: Lower edges of bands of evidence (-log of the share of clean documents that words leave), and documents of each that are assumed.
BANDS, PRIOR = np.array([0.0, 1.0, 1.4, 1.8, 2.2, 2.6, 3.0, 3.5]), 2.0
#: Costs, in nats, of reading a sign as a letter, of a repeated letter, and of a sign or a digit that means nothing.
AS_LETTER, AGAIN, NOISE, DIGIT = 0.5, 0.5, 1.0, 12.0


@dataclass(frozen=True)
class Settings:
    #: Labelled documents, by hash order, that the word weights are fitted on.
    labelled: int = 20_000
    #: Standard errors below the observed share at which a word's share counts.
    sure: float = 2.0


def _folded(word: str) -> str:
    """Without accents."""
    return word if word.isascii() else "".join(c for c in unicodedata.normalize("NFKD", word) if not unicodedata.combining(c))


def _squeezed(word: str) -> str:
    """A key that accents and repeated letters don't change, told from plain words by its first sign."""
    word = _folded(word)
    return "~" + "".join(a for a, b in zip(word, " " + word, strict=False) if a != b)


class Channel:
    """Restores words under a character trigram model: log probabilities by the two letters before (0 is a word's edge)."""

    def __init__(self, trigrams: np.ndarray):
        counts = trigrams.reshape(27, 27, 27) + 0.05
        self.log = np.log(counts / counts.sum(2, keepdims=True)).tolist()

    def restore(self, token: str) -> str:
        beam: dict[tuple[int, int], tuple[float, tuple]] = {(0, 0): (0.0, ())}
        for c in token:
            letter = c if "a" <= c <= "z" else ""
            choices = [(letter, 0.0)] if letter else [(x, AS_LETTER) for x in STANDS_FOR.get(c, "")]
            drop = None if letter else DIGIT if c.isalnum() else NOISE
            then: dict[tuple[int, int], tuple[float, tuple]] = {}

            def offer(state, score, path, then=then):
                if state not in then or then[state][0] < score:
                    then[state] = (score, path)

            for (a, b), (score, path) in beam.items():
                for x, cost in choices:
                    k = ord(x) - 96
                    offer((b, k), score - cost + self.log[a][b][k], (path, x))
                    if k == b:
                        offer((a, b), score - cost - AGAIN, path)
                if drop is not None:
                    offer((a, b), score - drop, path)
            beam = then
        score, path = max((s + self.log[a][b][0], p) for (a, b), (s, p) in beam.items())
        out = []
        while path:
            path, x = path
            out.append(x)
        return "".join(reversed(out))

    def readings(self, token: bytes) -> tuple[str, ...]:
        """Words that a lower-cased token may be: without the signs around it and, unless it is plain letters, restored.

        Plain letters keep their accents, which tell words apart; what is restored has none, and meets accented words by its squeezed key.
        """
        exact = token.decode(errors="replace")
        if not exact.isascii():
            exact = unicodedata.normalize("NFC", exact.lower())
        text = _folded(exact)
        plain, core = exact.strip(AROUND), text.strip(AROUND)
        if plain.isalpha() and not any(a == b == c for a, b, c in zip(plain, plain[1:], plain[2:], strict=False)):
            if len(core) == len(text) or not any(c in "$@!|+(<" for c in text):
                return (plain,)
            whole = self.restore(text)
            return tuple(dict.fromkeys((plain, whole, _squeezed(whole))))
        if sum(c.isalpha() or c in STANDS_FOR for c in text) < 2 or text.isdigit():
            return ()
        found = {self.restore(text), "".join(filter(str.isalpha, text))} | ({self.restore(core)} if core and core != text else set())
        return tuple(dict.fromkeys([*([plain] if plain.isalpha() else ()), *sorted(found), *sorted(map(_squeezed, found))]))


def trigrams(docs: DataFrame) -> np.ndarray:
    """Letter trigram counts (27 x 27 x 27) of all texts."""
    code = np.zeros(256, np.int64)
    code[97:123] = np.arange(1, 27)

    def count(batch):
        out = np.zeros(27**3)
        buf, bounds = column_bytes(batch.column("text"))
        for i, j in slices(bounds):
            c = code[LOWER[buf[bounds[i] : bounds[j]]]]
            c = np.concatenate([[0, 0], c, [0]])
            out += np.bincount(c[:-2] * 729 + c[1:-1] * 27 + c[2:], minlength=27**3)
        out[:27:27] = 0  # between words nothing is predicted
        return out

    total = sum_over(docs, ["text"], count)
    return np.zeros(27**3) if total is None else total


class _Reader:
    """Words of whole columns: distinct tokens are read once per slice, and kept for the next."""

    def __init__(self, channel: Channel):
        self.channel, self.kept = channel, {}

    def slices(self, column):
        """Per slice of rows i to j: readings of each distinct token, each place's token, row bounds, and letters spelled out singly as (row, string)."""
        buf, bounds = column_bytes(column)
        for i, j in slices(bounds):
            part, own = LOWER[buf[bounds[i] : bounds[j]]], bounds[i : j + 1] - bounds[i]
            s, e, rows = spans(part, own)
            # the gap after each word stays with it; stripped below
            offsets = np.append(s, len(part)).astype(np.int32)
            words = pa.Array.from_buffers(pa.binary(), len(s), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(part))]).dictionary_encode() if len(s) else None
            readings, of = [], np.empty(0, np.int64)
            if words is not None:
                of = words.indices.to_numpy()
                for raw in words.dictionary.to_pylist():
                    token = raw.rstrip()
                    got = self.kept.get(token)
                    if got is None:
                        got = self.channel.readings(token)
                        if len(self.kept) < KEPT:
                            self.kept[token] = got
                    readings.append(got)
            yield i, j, readings, of, rows, self._spelled(part, s, e, rows)

    @staticmethod
    def _spelled(part, s, e, rows):
        single = (e - s) == 1
        edge = np.diff(np.concatenate([[0], single.astype(np.int8), [0]]))
        found = []
        for a, b in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1), strict=True):
            if b - a >= 3:
                cuts = [a, *rows[(rows > a) & (rows < b)].tolist(), b]
                found += [(int(np.searchsorted(rows, x, "right")) - 1, part[s[x:y]].tobytes()) for x, y in zip(cuts, cuts[1:], strict=False) if y - x >= 3]
        return found


@dataclass
class Model:
    words: dict[str, float]  # a lower bound of the share of toxic documents among those with the word
    base: float  # the share among documents with none of them
    channel: Channel
    calls: tuple[np.ndarray, np.ndarray] | None = None  # evidence, rising, and the share of toxic documents there

    def __post_init__(self):
        keys = {_squeezed(w): w for w in sorted(self.words, reverse=True)}
        self.marks = {k: w for k, w in keys.items() if len(k) > SHORT} | {w: w for w in self.words}

    def evidence(self, found: set[str]) -> float:
        return -sum(math.log1p(-self.words[w]) for w in sorted(found))

    def score(self, found: set[str]) -> float:
        if not found or self.calls is None:
            return 1.0 - (1.0 - self.base) * math.exp(-self.evidence(found))
        return float(np.interp(self.evidence(found), *self.calls))

    def scores(self, column):
        """(score, marking words) of each row of a text column."""
        reader = _Reader(self.channel)
        for i, j, readings, of, rows, spelled in reader.slices(column):
            marks = [[self.marks[w] for w in r if w in self.marks] for r in readings]
            flagged = np.fromiter(map(bool, marks), bool, len(marks))
            found: list[set[str]] = [set() for _ in range(j - i)]
            places = np.flatnonzero(flagged[of]) if len(of) else of
            for place, row in zip(places.tolist(), (np.searchsorted(rows, places, "right") - 1).tolist(), strict=True):
                found[row].update(marks[of[place]])
            for row, letters in spelled:
                joined = letters.decode(errors="replace")
                for text in {joined, self.channel.restore(joined), _squeezed(joined)}:
                    found[row].update(w for w in self.words if len(w) > 2 and w in text)
            for words in found:
                yield self.score(words), sorted(words)


def _calls(toxic: np.ndarray, total: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each band's mean evidence and share of toxic documents, never falling.

    Words of one document don't tell independently, so their joint weight is
    held against what it's worth; ``PRIOR`` documents that bear it out stand in
    where a band has few.
    """
    at = np.where(total > 0, x / np.maximum(total, 1), np.append((BANDS[1:] + BANDS[:-1]) / 2, BANDS[-1]))
    weight = total + PRIOR
    share = (toxic + PRIOR * -np.expm1(-at)) / weight
    pools: list[list[float]] = []
    for s, w in zip(share, weight, strict=True):
        pools.append([s, w, 1])
        while len(pools) > 1 and pools[-2][0] > pools[-1][0]:
            (s1, w1, n1), (s2, w2, n2) = pools[-2:]
            pools[-2:] = [[(s1 * w1 + s2 * w2) / (w1 + w2), w1 + w2, n1 + n2]]
    return at, np.repeat([p[0] for p in pools], [int(p[2]) for p in pools])


def _remainder(column: str, n: int):
    return F.pmod(F.crc32(F.coalesce(F.col(column).cast("string"), F.lit(""))), F.lit(n))


def fit(docs: DataFrame, labels: DataFrame, s: Settings = Settings()) -> Model:
    """Fit on labelled documents whose crc32(doc_id as text) mod 5 isn't 0; the character model on all texts."""
    channel = Channel(trigrams(docs))
    known = labels.where("doc_id is not null and toxic is not null").where(_remainder("doc_id", 5) != 0).groupBy("doc_id").agg(F.max("toxic").alias("label"))
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(s.labelled)  # the bound that makes it safe to broadcast
    rows = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")

    def pairs(batches):
        reader = _Reader(channel)
        for batch in batches:
            for _, _, readings, of, bounds, _ in reader.slices(batch.column("text")):
                heads = set(bounds.tolist())
                seen = {(w, -1 if k in heads else int(of[k - 1])) for k in range(len(of)) for w in readings[of[k]] if w and w[0] != "~"}
                names = {t: zlib.crc32(" ".join(r).encode()) for t, r in enumerate(readings)} | {-1: 0}
                out = sorted({(w, names[b]) for w, b in seen})
                yield pa.RecordBatch.from_pydict({"word": pa.array([w for w, _ in out], pa.string()), "before": pa.array([b for _, b in out], pa.int64())})

    # copies repeat a word with the word before it: how many differ tells more than how often it occurs;
    # with ``sure ** 2`` or fewer even a share of 1 has a lower bound of at most one half, so such words mark nothing
    least = int(s.sure**2) + 1
    marked = rows.where("label = 1").select("text").mapInArrow(pairs, "word string, before long").distinct().groupBy("word").count().where(F.col("count") >= least)
    found = {r.word: r["count"] for r in marked.collect()}  # words of the labelled sample, whose size bounds them
    index = {w: k for k, w in enumerate(found)}

    def held(batch):
        """Documents with each candidate: those that aren't toxic, then those that are."""
        label = batch.column("label").to_numpy(zero_copy_only=False) == 1
        out = np.zeros(2 * len(index))
        reader = _Reader(channel)
        for i, j, readings, of, bounds, _ in reader.slices(batch.column("text")):
            ids = [[index[w] for w in r if w in index] for r in readings]
            hit = np.fromiter(map(bool, ids), bool, len(ids))
            places = np.flatnonzero(hit[of]) if len(of) else of
            seen = {(row, k + len(index) * bool(label[i + row])) for place, row in zip(places.tolist(), (np.searchsorted(bounds, places, "right") - 1).tolist(), strict=True) for k in ids[of[place]]}
            out += np.bincount(np.fromiter((k for _, k in seen), np.int64, len(seen)), minlength=2 * len(index))
        return out

    both = sum_over(rows, ["text", "label"], held) if index else None
    both = np.zeros(2 * len(index)) if both is None else both
    words = {}
    for w, k in index.items():
        t = min(found[w], both[k + len(index)])
        n = t + both[k]
        if not n:
            continue
        share, z = t / n, s.sure
        low = (share + z * z / (2 * n) - z * ((share * (1 - share) + z * z / (4 * n)) / n) ** 0.5) / (1 + z * z / n)
        if low > 0.5:
            words[w] = low
    model = Model(words, 0.0, channel)

    def weighed(batch):
        """By band of evidence: toxic documents, documents, and the sum of their evidence."""
        x = np.array([model.evidence(set(w)) for _, w in model.scores(batch.column("text"))])
        band = np.where(x > 0, np.searchsorted(BANDS, x, "right"), 0)
        label = batch.column("label").to_numpy(zero_copy_only=False) == 1
        return np.concatenate([np.bincount(band, weights, len(BANDS) + 1) for weights in (label.astype(float), np.ones(len(x)), x)])

    sums = sum_over(rows, ["text", "label"], weighed)
    toxic, total, x = np.zeros((3, len(BANDS) + 1)) if sums is None else sums.reshape(3, -1)
    model.base = float(min(0.49, (toxic[0] + 0.5) / (total[0] + 2.0)))
    model.calls = _calls(toxic[1:], total[1:], x[1:])
    return model


def toxicity(docs: DataFrame, labels: DataFrame, s: Settings = Settings()) -> DataFrame:
    """Per row of ``docs``: doc_id, held_out, score, predicted and the marking words found.

    Only doc_id and text of ``docs`` and doc_id and toxic of ``labels`` are read.
    Documents whose crc32(doc_id as text; null: empty) mod 5 is 0 are held out
    of the labels learned from. Null, empty and wordless texts get the share of
    toxic ones among documents without a marking word. Labels that contradict
    each other count as toxic; null labels are ignored. Repeated rows are scored
    one by one. Without labels no word marks anything. An empty table gives no
    rows.
    """
    model = fit(docs, labels, s)

    def run(batches):
        for batch in batches:
            got = list(model.scores(batch.column("text")))
            score = [x for x, _ in got]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(score, pa.float64()), pa.array([int(x >= 0.5) for x in score], pa.int32()), pa.array([w for _, w in got], pa.list_(pa.string()))], names=["doc_id", "held_out", "score", "predicted", "words"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), (_remainder("doc_id", 5) == 0).alias("held_out"), "text").mapInArrow(tidied(run), RESULT)


def without_toxic(docs: DataFrame, labels: DataFrame, s: Settings = Settings()) -> DataFrame:
    """The rows of ``docs``, with all their columns, that aren't predicted toxic.

    Null and empty texts stay unless most documents without a marking word are
    toxic, which the model's base share (at most 0.49) rules out. Rows that
    repeat a doc_id are judged one by one, by their own texts; rows without one
    too. Very long texts are read slice by slice. Columns of other names pass
    through untouched. An empty table stays empty.
    """
    model = fit(docs, labels, s)

    def run(batches):
        for batch in batches:
            keep = [x < 0.5 for x, _ in model.scores(batch.column("text"))]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(tidied(run), docs.schema)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(parquet(spark, sf_dir, "documents"), parquet(spark, sf_dir, "labels"))
