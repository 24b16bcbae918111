"""License scans by template-markup matching.

A template is wording with ``[[optional]]`` parts and ``{{name:a-b}}``
replaceable parts of a to b words. It is compiled into an automaton over words,
and a text has the license where all mandatory words stand as the template has
them. All templates share one automaton, whose subsets of states are made as
texts need them.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .cluster import parquet
from .text import ALNUM, LOWER, column_bytes, slices, spans

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
RESULT = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, matches array<struct<label:string,start:long,end:long>>"

#: Phrases and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: License wording in template markup, by label.
TEMPLATES = [
    ("mit-notice", "[[is]] [[distributed]] [[released]] [[licensed]] under the [[terms of the]] mit license"),
    ("mit-text", "permission is hereby granted free of charge to any person obtaining a copy of this {{thing:1-4}} [[and associated documentation files]] [[the software]] to deal in the {{thing:1-4}} without restriction"),
    ("apache-2.0", "licensed under the apache license [[version]] 2 0 [[the license]]"),
    ("apache-2.0", "under the [[terms of the]] apache license version 2 0"),
    ("gpl-2.0", "licensed under the [[terms of the]] gnu general public license [[as published by the free software foundation]] [[either]] version 2"),
    ("gpl-3.0", "licensed under the [[terms of the]] gnu general public license [[as published by the free software foundation]] [[either]] version 3"),
    ("gpl-3.0-or-later", "redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("lgpl", "gnu lesser general public license [[version {{number:1-2}}]]"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted [[provided that the following conditions are met]]"),
    ("mpl-2.0", "subject to the terms of the mozilla public license [[v]] [[version]] 2 0"),
    ("isc", "permission to use copy modify and [[or]] distribute this software for any purpose with or without fee is hereby granted"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("cc-by-nc-4.0", "[[licensed]] under [[the]] [[a]] cc by nc [[license]] 4 0"),
    ("cc-by-sa-4.0", "[[licensed]] under [[the]] [[a]] cc by sa [[license]] 4 0"),
    ("cc-by-4.0", "[[licensed]] under [[the]] [[a]] cc by [[license]] 4 0"),
    ("cc-by", "creative commons attribution [[noncommercial]] [[sharealike]] {{version:0-3}} license"),
]


class Automaton:
    """States and edges of all templates; ``run`` follows one start."""

    def __init__(self, templates: list[tuple[str, str]]):
        self.words: list[dict[str, set[int]]] = []
        self.any: list[set[int]] = []
        self.free: list[set[int]] = []
        self.accept: dict[int, str] = {}
        self.start = self._state()
        self.required: list[bytes] = []
        for label, text in templates:
            parts = re.findall(r"\[\[|\]\]|\{\{\w+:\d+-\d+\}\}|[^\s\[\]{}]+", text)
            begin = self._state()
            self.free[self.start].add(begin)
            end, rest = self._sequence(begin, parts, 0)
            if rest != len(parts):
                raise ValueError(f"unbalanced markup: {text}")
            self.accept[end] = label
            self.required.append(max(self._mandatory(parts), key=len).encode())
        self.required = sorted(set(self.required))
        self.vocabulary = {w for state in self.words for w in state}
        self.subsets: dict[frozenset[int], int] = {}
        self.members: list[frozenset[int]] = []
        self.moves: list[dict[str | None, int]] = []
        self.labels: list[tuple[str, ...]] = []
        self.first = self._subset({self.start})
        self.heads = set() if any(self.any[x] for x in self.members[self.first]) else {w.encode() for x in self.members[self.first] for w in self.words[x]}

    def _state(self) -> int:
        self.words.append({})
        self.any.append(set())
        self.free.append(set())
        return len(self.words) - 1

    @staticmethod
    def _mandatory(parts: list[str]) -> list[str]:
        depth, out = 0, []
        for p in parts:
            depth += (p == "[[") - (p == "]]")
            if not depth and p[0] not in "[]{":
                out.append(p)
        if not out:
            raise ValueError("a template needs a mandatory word")
        return out

    def _sequence(self, at: int, parts: list[str], k: int) -> tuple[int, int]:
        while k < len(parts) and parts[k] != "]]":
            p = parts[k]
            if p == "[[":
                inner, k = self._sequence(at, parts, k + 1)
                if k == len(parts):
                    raise ValueError("unbalanced markup")
                after = self._state()
                self.free[inner].add(after)
                self.free[at].add(after)
                at = after
            elif p.startswith("{{"):
                least, most = map(int, p[2:-2].split(":")[1].split("-"))
                for n in range(most):
                    after = self._state()
                    self.any[at].add(after)
                    if n >= least:
                        self.free[at].add(after)
                    at = after
            else:
                after = self._state()
                self.words[at].setdefault(p, set()).add(after)
                at = after
            k += 1
        return at, k

    def _subset(self, states: set[int]) -> int:
        todo, closed = list(states), set(states)
        while todo:
            for x in self.free[todo.pop()] - closed:
                closed.add(x)
                todo.append(x)
        key = frozenset(closed)
        if key not in self.subsets:
            self.subsets[key] = len(self.members)
            self.members.append(key)
            self.moves.append({})
            self.labels.append(tuple(sorted({self.accept[x] for x in key if x in self.accept})))
        return self.subsets[key]

    def step(self, subset: int, word: str) -> int | None:
        key = word if word in self.vocabulary else None
        if key not in self.moves[subset]:
            then = {y for x in self.members[subset] for y in self.any[x] | self.words[x].get(key, set())}
            self.moves[subset][key] = self._subset(then) if then else -1
        found = self.moves[subset][key]
        return None if found < 0 else found

    def find(self, words: list[bytes]) -> list[tuple[str, int, int]]:
        """(label, start, end) of the longest match of each label at each start."""
        out = []
        for i, word in enumerate(words):
            if self.heads and word not in self.heads:
                continue
            state, j, best = self.first, i, {}
            while j < len(words):
                state = self.step(state, words[j].decode(errors="replace"))
                if state is None:
                    break
                j += 1
                for label in self.labels[state]:
                    best[label] = j
            out += [(label, i, end) for label, end in sorted(best.items())]
        return out


def scan(docs: DataFrame, templates: list[tuple[str, str]] | None = None) -> DataFrame:
    """Per row of ``docs``: words, places of the base phrases, labels, and the places where templates match.

    ``docs`` needs doc_id and text; other columns are ignored. Score is 1 where a
    template matches, 0.5 with base phrases only, else 0. Null and empty texts
    have no words. Each repeated row gets its own. An empty table gives no rows.
    """
    chosen = TEMPLATES if templates is None else templates

    def run(batches):
        automaton = Automaton(chosen)
        phrases = [(p.encode().split(), label) for p, label in PHRASES.items()]
        keys = sorted({max(p, key=len) for p, _ in phrases} | set(automaton.required))
        keys = [k for k in keys if not any(o != k and o in k for o in keys)]
        heads: dict[bytes, list] = {}
        for p, label in phrases:
            heads.setdefault(p[0], []).append((p, label))
        for batch in batches:
            buf, bounds = column_bytes(batch.column("text"))
            rows = []
            for i, j in slices(bounds):
                part, own = LOWER[buf[bounds[i] : bounds[j]]], bounds[i : j + 1] - bounds[i]
                _, _, words_at = spans(part, own, ALNUM)
                whole, cut = part.tobytes(), own.tolist()
                for k, n in enumerate(np.diff(words_at).tolist()):
                    text = whole[cut[k] : cut[k + 1]]
                    places, labels, found = [], set(), []
                    if any(key in text for key in keys):
                        words = WORD.findall(text)
                        for at, word in enumerate(words):
                            for p, label in heads.get(word, ()):
                                if words[at : at + len(p)] == p:
                                    places.append(at)
                                    labels.add(label)
                        found = automaton.find(words)
                    every = labels | {label for label, _, _ in found}
                    rows.append((n, len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels)), ",".join(sorted(every)), 1.0 if found else 0.5 if places else 0.0, [{"label": a, "start": b, "end": c} for a, b, c in found]))
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))]
            columns = list(zip(*rows, strict=True)) or [()] * 8
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(list(c), t) for c, t in zip(columns, kinds, strict=True))], names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "matches"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, RESULT)


def op3_license_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(parquet(spark, sf_dir, "documents"))
