"""Words of a document's sentences, weighed where the document is: a row holds all that its sentences are held against."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Documents that are taken at a time.
STEP = 1024


@dataclass
class Terms:
    """Distinct words of each sentence of some documents, in order of sentences: the sentence (counted on over all documents), the word and how often it is
    there, in how many sentences of its document it is (df) and how often (of); and each sentence's document and rank, from 1."""

    sentence: np.ndarray
    word: pa.Array
    w: np.ndarray
    df: np.ndarray
    of: np.ndarray
    document: np.ndarray
    rank: np.ndarray

    @classmethod
    def read(cls, lists: pa.ListArray) -> Terms:
        """Of documents as lists of sentences, which are lists of words."""
        size = lambda x: x.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        inner = lists.flatten()
        sentences, words = size(lists), size(inner)
        document = np.repeat(np.arange(len(sentences)), sentences)
        rank = np.arange(len(document)) - np.repeat(np.cumsum(sentences) - sentences, sentences) + 1
        coded = inner.flatten().dictionary_encode()
        width = len(coded.dictionary) + 1
        key, w = np.unique(np.repeat(np.arange(len(document)), words) * width + coded.indices.to_numpy(zero_copy_only=False), return_counts=True)
        sentence, word = key // width, key % width
        _, group, df = np.unique(document[sentence] * width + word, return_inverse=True, return_counts=True)
        of = np.bincount(group, w, len(df)).astype(np.int64)
        return cls(sentence, coded.dictionary.take(pa.array(word)), w, df[group], of[group], document, rank)


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, Terms]]:
    for whole in batches:
        for at in range(0, whole.num_rows, STEP):
            batch = whole.slice(at, STEP)
            yield batch.column("doc_id"), Terms.read(batch.column("s"))


def unit_tfidf(documents: DataFrame) -> DataFrame:
    """(doc_id, rank, token, w) of documents (doc_id, s: arrays of sentences' words): tf-idf over the document's sentences that have words, of length 1 for each of them."""

    def run(batches):
        for ids, t in _pieces(batches):
            has = np.bincount(t.sentence, minlength=len(t.document)) > 0
            n = np.bincount(t.document[has], minlength=len(ids))[t.document[t.sentence]]
            x = t.w * (np.log((1 + n) / (1 + t.df)) + 1)
            norm = np.sqrt(np.bincount(t.sentence, x * x, len(t.document)))
            found = [ids.take(pa.array(t.document[t.sentence])), pa.array(t.rank[t.sentence]), t.word, pa.array(x / norm[t.sentence])]
            yield pa.RecordBatch.from_arrays(found, names=["doc_id", "rank", "token", "w"])

    return documents.select("doc_id", "s").mapInArrow(run, "doc_id long, rank long, token string, w double")


def centrality(documents: DataFrame) -> DataFrame:
    """(doc_id, sims) of documents (doc_id, s: arrays of sentences' words): rank and sim, the cosine to the document's own counts, of the sentences that have words."""

    def run(batches):
        for ids, t in _pieces(batches):
            n = len(t.document)
            dot, own, has = np.bincount(t.sentence, t.w * t.of, n), np.bincount(t.sentence, t.w * t.w, n), np.bincount(t.sentence, minlength=n) > 0
            # a word's share of its document's squares comes once for each sentence that has it
            length = np.bincount(t.document[t.sentence], t.of * t.of / t.df, len(ids)).round()
            of = t.document[has]
            sim = dot[has] / (np.sqrt(own[has]) * np.sqrt(length[of]))
            ends = np.concatenate([[0], np.cumsum(np.bincount(of, minlength=len(ids)))]).astype(np.int32)
            sims = pa.StructArray.from_arrays([pa.array(t.rank[has]), pa.array(sim)], names=["rank", "sim"])
            yield pa.RecordBatch.from_arrays([ids, pa.ListArray.from_arrays(pa.array(ends), sims)], names=["doc_id", "sims"])

    return documents.select("doc_id", "s").mapInArrow(run, "doc_id long, sims array<struct<rank: long, sim: double>>")
