"""Similarity joins and selection by rounds against plain loops."""

import math
import random
from collections import defaultdict

import numpy as np
import pytest

from newstide.operators import selection as G
from newstide.plans import selecting as S
from newstide.plans.base import Tables


def cosine(a, b):
    n = math.sqrt(sum(x * x for x in a) * sum(x * x for x in b))
    return sum(x * y for x, y in zip(a, b, strict=True)) / n if n else 0.0


def dense(seed, n=160, dim=5):
    """Vectors of a large and some small groups, with copies, zero vectors and a group without a name."""
    rnd = random.Random(seed)
    rows = []
    for k in range(n):
        v = [float(rnd.randint(-3, 3)) for _ in range(dim)] if rnd.random() > 0.1 or not rows else list(rows[rnd.randrange(len(rows))][3])
        rows.append((rnd.choice(["a", "a", "a", "b", None]), rnd.randrange(20), k, v if rnd.random() > 0.05 else [0.0] * dim))
    return rows


def by_group(rows):
    out = defaultdict(list)
    for r in sorted(rows, key=lambda r: (r[1], r[2])):
        out[r[0]].append(r)
    return out.values()


@pytest.mark.parametrize("tile", [7, 1024])
def test_dense_pairs_are_those_of_all_pairs(spark, tile):
    rows = dense(1)
    df = spark.createDataFrame(rows, "g string, at int, id long, vector array<double>")
    got = {(r.a, r.b): r.cosine for r in G.dense_pairs(df, ["g"], ["at"], 0.61, tile).collect()}
    want = {(x[2], y[2]): cosine(x[3], y[3]) for group in by_group(rows) for k, y in enumerate(group) for x in group[:k] if cosine(x[3], y[3]) >= 0.61}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)


@pytest.mark.parametrize("seed, most, tile", [(0, 0.5, 9), (1, 0.9, 1024), (2, 0.05, 30)])
def test_novel_rows_are_those_of_one_pass(spark, seed, most, tile):
    rows = dense(seed)
    df = spark.createDataFrame(rows, "g string, at int, id long, vector array<double>").repartition(3)
    got = sorted(r.id for r in G.greedy_novel(df, ["g"], ["at", "id"], most, ["at", "id"], tile).collect())
    want = []
    for group in by_group(rows):
        kept = []
        for r in group:
            if all(cosine(r[3], k[3]) < most for k in kept):
                kept.append(r)
        want += [r[2] for r in kept]
    assert got == sorted(want)


@pytest.mark.parametrize("tile", [100, 8192])
def test_rows_that_are_all_alike_make_no_pairs(spark, monkeypatch, tile):
    """600 rows of which any two are alike are 179,700 pairs; what is written is a few rows for each of them."""
    made, write = [], G.written
    monkeypatch.setattr(G, "written", lambda df: made.append(write(df)) or made[-1])
    monkeypatch.setattr(G, "_dropped", lambda df: None)
    rows = [("a", k, [100.0, float(k % 30), float(k // 30)]) for k in range(600)] + [("a", 1000, [0.0, -1.0, 0.0])]
    got = G.greedy_novel(spark.createDataFrame(rows, "g string, id long, vector array<double>"), ["g"], ["id"], 0.9, tile=tile)
    assert sorted(r.id for r in got.collect()) == [0, 1000]
    assert sum(df.count() for df in made) < 5 * len(rows)


def test_no_rows_to_select_from(spark):
    df = spark.createDataFrame([], "g string, at int, id long, vector array<double>")
    assert not G.greedy_novel(df, ["g"], ["at"], 0.5).collect()
    assert not G.streaming_dedup(spark.createDataFrame([], "g string, at int, id long, counts map<string,double>"), ["g"], ["at"]).collect()


def test_rounds_are_as_many_as_the_longest_wait(spark):
    """A chain settles two nodes a round, a star in one, a random graph in few; what goes is what one pass takes out."""
    rnd = random.Random(3)
    chain = [(k, k + 1) for k in range(12)]
    star = [(100, 101 + k) for k in range(50)]
    graph = sorted({tuple(sorted(rnd.sample(range(1000, 1400), 2))) for _ in range(1500)})
    for edges, most in ((chain, 6), (star, 1), (graph, 14), (chain + star + graph, 14), ([], 0)):
        before = defaultdict(list)
        for a, b in edges:
            before[b].append(a)
        gone = set()
        for b in sorted(before):
            if any(a not in gone for a in before[b]):
                gone.add(b)
        out, rounds = G.settled(spark.createDataFrame(edges, "a long, b long"))
        assert {r.node for r in out.collect()} == gone and rounds <= most


def word_rows(seed, n=90):
    """Documents of frequent and rare words: near copies, copies, disjoint ones and empty ones, in two groups."""
    rnd = random.Random(seed)
    rows = []
    for k in range(n):
        if rows and rnd.random() < 0.5:
            counts = dict(rows[rnd.randrange(len(rows))][3])
            for _ in range(rnd.randint(0, 3)):
                counts[f"w{rnd.randrange(60)}"] = float(rnd.randint(1, 4))
        else:
            counts = {f"w{min(rnd.randrange(60), rnd.randrange(60))}": float(rnd.randint(1, 4)) for _ in range(rnd.randint(0, 14))}
        rows.append((rnd.choice(["a", "a", None]), rnd.randrange(15), k, counts))
    return rows


def word_cosine(a, b):
    n = math.sqrt(sum(v * v for v in a.values())) * math.sqrt(sum(v * v for v in b.values()))
    return sum(v * b.get(w, 0.0) for w, v in a.items()) / n if n else 0.0


SCHEMA = "g string, at int, id long, counts map<string,double>"


@pytest.mark.parametrize("least, postings", [(0.8, 512), (0.8, 4), (0.3, 6), (1.0, 5)])
def test_sparse_pairs_are_those_of_all_pairs(spark, monkeypatch, least, postings):
    monkeypatch.setattr(G, "POSTINGS", postings)
    rows = word_rows(5)
    got = {(r.a, r.b): r.cosine for r in G.sparse_pairs(spark.createDataFrame(rows, SCHEMA), ["g"], least - 1e-12).collect()}
    want = {(x[2], y[2]): word_cosine(x[3], y[3]) for x in rows for y in rows if x[0] == y[0] and x[2] < y[2] and word_cosine(x[3], y[3]) >= least - 1e-12}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)
    assert len(got) > 5


def test_few_pairs_of_documents_are_looked_at(spark, sf):
    rows = S.document_counts(Tables(spark, sf)).cache()
    base = G.with_squares(rows, ["query_id"])
    looked = G.sparse_candidates(base, 0.8).count()
    every = sum(r["count"] * (r["count"] - 1) // 2 for r in base.groupBy("group").count().collect())
    assert G.sparse_pairs(rows, ["query_id"], 0.8).count() <= looked < 0.1 * every


@pytest.mark.parametrize("seed", [0, 1])
def test_streaming_dedup_is_that_of_one_pass(spark, seed):
    rows = word_rows(seed, 70)
    want = {}
    for group in by_group(rows):
        reps = []
        for r in group:
            best = max(((word_cosine(r[3], x[3]), -k) for k, x in enumerate(reps)), default=(0.0, 0))
            if best[0] >= 0.6 - 1e-12:
                want[r[2]] = reps[-best[1]][2]
            else:
                want[r[2]] = r[2]
                reps.append(r)
    got = {r.id: r.representative for r in G.streaming_dedup(spark.createDataFrame(rows, SCHEMA), ["g"], ["at"], 0.6).collect()}
    assert got == want


def test_penalty_is_that_of_the_rule(spark, sf):
    """Salience less the share of the update that is nearest, label by label, against matrices."""
    from newstide.plans.catalog import QUERIES

    groups = defaultdict(list)
    for r in Tables(spark, sf).embeddings.orderBy("vec_id").collect():
        groups[r.label].append((r.vec_id, np.array(r.embedding, float)))
    want = {}
    for rows in groups.values():
        x = np.array([v for _, v in rows])
        unit = x / np.linalg.norm(x, axis=1, keepdims=True)
        salience = np.abs(x[:, 0]).round(6)
        s = np.tril((unit @ unit.T).round(6), -1)  # of each row to the rows before it
        twice = (s > 0.95).any(1)
        s[twice] = 0
        s[s < 0.15] = 0
        share = (s / np.where(s.sum(0) == 0, 1, s.sum(0))).round(9)
        at = share.argmax(1)
        now = salience - share[np.arange(len(rows)), at] * salience[at]
        now[twice] = now.min()
        want |= {i: v for (i, _), v in zip(rows, now, strict=True)}
    got = {r.id: r.penalised for r in QUERIES["fl6_salience_penalty"](spark, sf).collect()}
    assert got.keys() == want.keys() and max(abs(got[i] - want[i]) for i in want) < 1e-4


@pytest.mark.parametrize("tile", [41, 1024])
def test_repeats_are_the_later_ones_of_all_pairs(spark, tile):
    rows = dense(4, 600)  # a group is more rows than a tile has at once
    df = spark.createDataFrame(rows, "g string, at int, id long, vector array<double>")
    got = sorted(r.id for r in G.repeats(df, ["g"], ["at"], 0.61, tile).collect())
    assert got == sorted(y[2] for group in by_group(rows) for k, y in enumerate(group) if any(cosine(x[3], y[3]) >= 0.61 for x in group[:k]))


def test_penalties_leave_tiles_as_rows(spark, sf, monkeypatch):
    """Small tiles give the same penalties, and of a tile leaves at most a row for each of its rows."""
    from newstide.plans.catalog import QUERIES

    def bounded(f):
        def run(table, first):
            out = f(table, first)
            if any(len(column) > table.num_rows for column in out.values()):
                raise ValueError("pairs leave a tile")
            return out

        return run

    whole = {r.id: r.penalised for r in QUERIES["fl6_salience_penalty"](spark, sf).collect()}
    monkeypatch.setattr(G, "WIDE", 16)
    monkeypatch.setattr(G.repeats, "__defaults__", (16,))
    for name in ("similarity_sums", "largest_shares"):
        monkeypatch.setattr(S, name, bounded(getattr(S, name)))
    assert {r.id: r.penalised for r in QUERIES["fl6_salience_penalty"](spark, sf).collect()} == whole
