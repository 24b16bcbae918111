"""Queries that SQL can't express, against plain loops over the smallest tables."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from newstide.operators import clustering as C
from newstide.operators import ordered as O
from newstide.plans import selecting as S
from newstide.plans.base import Tables
from newstide.plans.catalog import QUERIES


@pytest.fixture(scope="module")
def points(spark, sf):
    rows = S.points(Tables(spark, sf)).collect()
    return {r.id: (r.topic, r.bucket, r.epoch, np.bincount(r.bins, minlength=64).astype(float), r.salience) for r in rows}


def cosine(a, b):
    n = np.linalg.norm(a) * np.linalg.norm(b)
    return a @ b / n if n else 0.0


def greedy(rows, most):
    """Ids kept of (id, vector) in order."""
    kept = []
    for i, v in rows:
        if all(cosine(v, w) < most for _, w in kept):
            kept.append((i, v))
    return [i for i, _ in kept]


def run(spark, sf, name):
    return QUERIES[name](spark, sf).collect()


def test_points_are_each_hours_distinct_texts(spark, sf, points):
    sentences = {r.update_id: (r.query_id, r.hour, r.sent_text) for r in Tables(spark, sf).sentences.collect()}
    assert len({sentences[i] for i in points}) == len(points)


def test_streaming_dedup(spark, sf):
    docs = defaultdict(list)
    for r in S.document_counts(Tables(spark, sf)).collect():
        docs[r.query_id].append((r.epoch, r.id, dict(r.counts)))
    want = {}
    for rows in docs.values():
        reps = []
        for _, i, c in sorted(rows, key=lambda x: x[:2]):
            norm = math.sqrt(sum(v * v for v in c.values()))
            best = max(((sum(v * d.get(w, 0.0) for w, v in c.items()) / (norm * n), -k, j) for k, (j, d, n) in enumerate(reps)), default=(0, 0, None))
            if best[0] >= 0.8 - 1e-12:
                want[i] = best[2]
            else:
                want[i] = i
                reps.append((i, c, norm))
    got = {r.id: r.representative for r in run(spark, sf, "dd1_streaming_dedup")}
    assert got == want


def test_novel_against_kept(spark, sf):
    rows = defaultdict(list)
    for r in Tables(spark, sf).embeddings.orderBy("vec_id").collect():
        rows[r.label].append((r.vec_id, np.array(r.embedding, float)))
    assert sorted(r.id for r in run(spark, sf, "dd3_novel_against_kept")) == sorted(i for x in rows.values() for i in greedy(x, 0.25))


def test_carry_over(spark, sf):
    counts = Counter((r.query_id, r.epoch // 3600) for r in Tables(spark, sf).sentences.collect())
    want = {}
    for topic in {t for t, _ in counts}:
        waiting, rows, bucket = [], 0, 0
        for hour in sorted(h for t, h in counts if t == topic):
            waiting.append(hour)
            rows += counts[topic, hour]
            if rows > 1:
                want |= {(topic, h): bucket for h in waiting}
                waiting, rows, bucket = [], 0, bucket + 1
        want |= {(topic, h): -1 for h in waiting}
    assert {(r.query_id, r.hour): r.bucket for r in run(spark, sf, "cl5_bucket_carry_over")} == want


@pytest.mark.parametrize("name, least", [("cl1_affinity_propagation", 10), ("cl2_affinity_propagation_salience", 10), ("cl3_bucketed_salience_clusters", 2)])
def test_clusters_hold_every_point_of_hours_that_are_large_enough(spark, sf, points, name, least):
    hours = Counter((t, b) for t, b, *_ in points.values())
    got = run(spark, sf, name)
    assert all(points[r.id][:2] == (r.topic, r.bucket) and r.emitted == r.bucket + 3600 for r in got)
    sizes = Counter()
    for r in got:
        sizes[r.topic, r.bucket] += r.cluster_size
    assert sizes == {k: n for k, n in hours.items() if n >= least}


def test_geo_centres_are_the_nearest(spark, sf):
    from newstide.plans.joining import geo

    places = {r.k: (math.radians(r.lat), math.radians(r.lng)) for r in geo(Tables(spark, sf)).select("k", F.col("lat").cast("double"), F.col("lng").cast("double")).collect()}

    def miles(a, b):
        (p, x), (q, y) = places[a], places[b]
        return 3958.75 * math.acos(max(-1, min(1, math.sin(p) * math.sin(q) + math.cos(p) * math.cos(q) * math.cos(x - y))))

    got = run(spark, sf, "cl7_geo_clusters")
    centres = defaultdict(set)
    for r in got:
        centres[r.region].add(r.center)
    for r in got:
        assert miles(r.id, r.center) <= min(miles(r.id, c) for c in centres[r.region]) + 1e-3


def filtered(points, clusters, most, order, least=None):
    """The novelty filter over clusters of two or more, topic by topic."""
    found = [(r.id, *points[r.id]) for r in clusters if r.cluster_size >= 2]
    if least is not None:
        every = defaultdict(list)
        for r in clusters:
            every[r.topic, r.bucket].append(points[r.id][4])
        z = lambda s, x: (s - np.mean(x)) / np.std(x) if np.std(x) > 0 else None
        found = [x for x in found if (v := z(x[5], every[x[1], x[2]])) is not None and v >= least]
    topics = defaultdict(list)
    for x in sorted(found, key=order):
        topics[x[1]].append((x[0], x[4]))
    return sorted(i for rows in topics.values() for i in greedy(rows, most))


def test_cluster_filters(spark, sf, points):
    clusters = run(spark, sf, "cl1_affinity_propagation")
    by_time = lambda x: (x[2], x[3], x[0])
    assert sorted(r.id for r in run(spark, sf, "fl1_cluster_novelty_filter")) == filtered(points, clusters, 0.2264, by_time)
    assert sorted(r.id for r in run(spark, sf, "fl2_salience_ranked_filter")) == filtered(points, clusters, 0.4, lambda x: (x[2], -x[5], x[0]), 0)
    assert sorted(r.id for r in run(spark, sf, "fl3_salience_time_filter")) == filtered(points, clusters, 0.6, by_time, 0)


def test_linkage_filter(spark, sf, points):
    hours = defaultdict(list)
    for i, (t, b, *_) in sorted(points.items()):
        hours[t, b].append(i)
    leads = []
    for (topic, hour), ids in hours.items():
        group = {i: {i} for i in ids}
        for k, a in enumerate(ids):
            for b in ids[:k]:
                if group[a] is not group[b] and cosine(points[a][3], points[b][3]) >= 0.7:
                    group[a] |= group[b]
                    for m in group[b]:
                        group[m] = group[a]
        for members in {id(g): sorted(g) for g in group.values()}.values():
            unit = np.array([points[m][3] / np.linalg.norm(points[m][3]) for m in members])
            if len(members) >= 2:
                far = ((unit - unit.mean(0)) ** 2).sum(1).round(9)
                leads.append((topic, hour, members[int(far.argmin())]))
    topics = defaultdict(list)
    for topic, hour, i in sorted(leads, key=lambda x: (x[1], points[x[2]][2], x[2])):
        topics[topic].append((i, points[i][3]))
    assert sorted(r.id for r in run(spark, sf, "fl4_linkage_filter")) == sorted(i for x in topics.values() for i in greedy(x, 0.7))


def test_ranked_filter(spark, sf, points):
    hours = defaultdict(list)
    for i, (t, b, *_) in points.items():
        hours[t, b].append(i)
    want = set()
    for (t, b), ids in hours.items():
        s = np.array([points[i][4] for i in ids])
        z = dict(zip(ids, (s - s.mean()) / s.std(), strict=True)) if s.std() > 0 else {}
        kept = greedy([(i, points[i][3]) for i in sorted((i for i in z if z[i] > 0.4), key=lambda i: (-points[i][4], i))], 0.4)
        want |= {(t, b, i) for i in kept} or {(t, b, None)}
    assert {(r.topic, r.bucket, r.id) for r in run(spark, sf, "fl5_ranked_salience_filter")} == want


def test_oracles(spark, sf):
    topics = defaultdict(list)
    for r in S.sentence_sets(Tables(spark, sf)).orderBy("epoch", "doc_id", "sent_id").collect():
        topics[r.query_id].append((r.doc_id, r.update_id, set(r.nuggets)))
    first, second, third = set(), set(), set()
    for topic, rows in topics.items():
        every = set().union(*(s for *_, s in rows))
        first.add((topic, 0, None, len(rows), len(every)))
        seen = set()
        for step in range(1, 26):
            gain, k = max((len(s - seen), -k) for k, (*_, s) in enumerate(rows))
            if not gain:
                break
            seen |= rows[-k][2]
            first.add((topic, step, rows[-k][1], gain, len(seen)))
        seen, budget, held = set(), 25, set()
        for doc in dict.fromkeys(d for d, *_ in rows):
            own = [(u, s) for d, u, s in rows if d == doc]
            picked = 0
            while budget and max(len(s - seen) for _, s in own):
                seen |= max(own, key=lambda x: len(x[1] - seen))[1]
                picked, budget = picked + 1, budget - 1
            second.add((topic, doc, picked, len(seen), len(every)))
            u, s = max(own, key=lambda x: len(x[1] - held))
            gain, new = len(s - held), set().union(*(x for _, x in own)) - held
            third.add((topic, doc, u if gain else "NEXT", gain, len(new) - gain))
            held |= s if gain else set()
    assert set(map(tuple, run(spark, sf, "or1_retrospective_oracle"))) == first
    assert set(map(tuple, run(spark, sf, "or2_streaming_oracle"))) == second
    assert set(map(tuple, run(spark, sf, "or3_step_oracle"))) == third


def test_running_numbers_and_lags(spark):
    rnd = random.Random(0)
    rows = [(rnd.choice("ab"), rnd.randrange(40), k, rnd.randrange(5)) for k in range(3000)] + [(None, 1, 5000, 2)]
    df = spark.createDataFrame(rows, "g string, h long, k long, v long")
    run_ = {r.k: (r.nth, r.total) for r in O.cumulative(O.numbered(df, ["g"], F.col("h"), ["k"]), ["g"], "h", ["k"], {"total": "v"}).collect()}
    back = {r.k: (r.p1, r.p2) for r in O.lagged(df, ["g"], "h", ["k"], "v", ["p1", "p2"]).collect()}
    for g in ("a", "b", None):
        own, total = sorted((r for r in rows if r[0] == g), key=lambda r: r[1:3]), 0
        for n, (_, _, k, v) in enumerate(own):
            total += v
            assert run_[k] == (n + 1, total)
            assert back[k] == (own[n - 1][3] if n else None, own[n - 2][3] if n > 1 else None)


def test_exact_median_and_first_rows(spark):
    for values in ([3.0], [1.0, 2.0], [0.5, 0.5, 0.1, 0.9], [random.Random(1).random() for _ in range(999)]):
        df = spark.createDataFrame([(v,) for v in values], "x double")
        assert abs(O.exact_median(df, "x").first().x - float(np.median(values))) < 1e-12
    df = spark.createDataFrame([("g", k % 7, k) for k in range(50)], "g string, a long, k long")
    assert sorted((r.a, r.k) for r in O.top_per_group(df, ["g"], ["a", "k"], 10).collect()) == sorted((k % 7, k) for k in range(50))[:10]


def test_linkage_keeps_ids_of_one_group(spark):
    df = spark.createDataFrame([("g", "a", [1.0, 0.0]), ("g", "b", [1.0, 0.1]), ("g", "c", [0.0, 1.0])], "g string, id string, vector array<double>")
    assert sorted((r.id, r.cluster_size) for r in C.linkage_clusters(df, ["g"], 0.9).collect()) == [("a", 2), ("c", 1)]
