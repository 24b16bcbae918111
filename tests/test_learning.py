"""Learned queries predict every row, each from rows of other folds."""

import numpy as np
from pyspark.sql import functions as F

from newstide.functions import learning as L
from newstide.operators import boosting as B
from newstide.operators.components import written
from newstide.plans.base import Tables
from newstide.plans.catalog import QUERIES
from newstide.plans.learning import FEATURES, pair_features, sentence_features

from test_boosting import cells_of, grown


def test_every_topic_has_a_salience_from_the_others(spark, sf):
    f = sentence_features(Tables(spark, sf)).cache()
    got = {r.update_id: r.salience for r in QUERIES["ml3_salience_regressor"](spark, sf).collect()}
    assert set(got) == {r.update_id for r in f.select("update_id").collect()}
    last = max(r.query_id for r in f.select("query_id").distinct().collect())
    x = B.binned(f, FEATURES).select("query_id", "update_id", "x", "found").collect()
    cells = cells_of([({e.feature: e.bin for e in r.x}, r.found) for r in x if r.query_id != last])
    base, forest, _ = grown(cells, 10, 3, 0.3, 1.0, 1, False)
    for r in x:
        if r.query_id == last:
            want, own = base, {e.feature: e.bin for e in r.x}
            for tree in forest:
                at, value = 1, 0.0
                while at in tree:
                    feature, cut, low, high = tree[at]
                    over = own.get(feature, 0) >= cut
                    at, value = at * 2 + over, high if over else low
                want += value
            assert abs(got[r.update_id] - want) < 1e-5


def test_one_more_topic_is_no_more_jobs(spark, sf):
    """The jobs of boosting are as many for two topics as for all."""
    f = B.binned(sentence_features(Tables(spark, sf)), FEATURES).select(F.col("query_id").alias("model"), "x", "found").cache()
    topics = sorted(r.model for r in f.select("model").distinct().collect())
    assert len(topics) > 2
    counts = []
    for name, some in (("two", topics[:2]), ("all", topics)):
        cells = written(B.left_out(B.cells(f.where(F.col("model").isin(some)), "found")))
        spark.sparkContext.setJobGroup(name, name)
        B.boost(cells, 1, 2)
        counts.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(name)))
    spark.sparkContext.setJobGroup("", "")
    assert counts[1] <= counts[0] + 4


def test_each_nugget_has_its_own_model(spark, sf):
    """Every pair that is alike or judged is scored; nuggets with few positives get their share of them."""
    rows = pair_features(Tables(spark, sf)).collect()
    got = {(r.update_id, r.nugget_id): r.p for r in QUERIES["ml1_nugget_classifier"](spark, sf).collect()}
    assert set(got) == {(r.update_id, r.nugget_id) for r in rows}
    for nugget in {r.nugget_id for r in rows}:
        own = [r for r in rows if r.nugget_id == nugget]
        positive = sum(r.label for r in own)
        if positive < 11:
            assert all(abs(got[r.update_id, nugget] - positive / len(own)) < 1e-6 for r in own)
    soft = QUERIES["ml2_soft_match"](spark, sf).collect()
    assert sorted(r.update_id for r in soft) == sorted(r.update_id for r in Tables(spark, sf).sentences.select("update_id").collect())
    assert {(r.update_id, n): p for r in soft for n, p in r.probs.items()} == got and all(r.conf == max(r.probs.values(), default=0.0) for r in soft)
    judged = {(r.update_id, r.nugget_id) for r in Tables(spark, sf).matches.collect()}
    assert judged <= set(got)


def test_gaussian_process_by_hand():
    x, y, z = np.array([[0.0, 1.0], [2.0, 1.0], [4.0, 3.0]]), np.array([1.0, 2.0, 4.0]), np.array([[1.0, 2.0]])
    scale = [s * 2**0.5 for s in x.std(0)]
    k = lambda a, b: float(np.exp(-sum(((p - q) / s) ** 2 for p, q, s in zip(a, b, scale, strict=True)) / 2))
    gram = np.array([[k(a, b) + (0.1 if a is b else 0.0) for b in x] for a in list(x)])
    gram = np.array([[k(x[i], x[j]) + 0.1 * (i == j) for j in range(3)] for i in range(3)])
    want = np.array([k(z[0], b) for b in x]) @ np.linalg.inv(gram) @ (y - y.mean()) + y.mean()
    assert abs(L.gp_predict(x, y, z)[0] - want) < 1e-9


def test_kernels_of_many_rows_are_taken_by_strips():
    """A kernel of all rows would hold 20,000 x 100 x 5 differences, 80 MB, several times over."""
    import tracemalloc

    rnd = np.random.default_rng(2)
    x, y, z = rnd.normal(size=(100, 5)), rnd.random(100), rnd.normal(size=(20_000, 5))
    tracemalloc.start()
    got = L.gp_predict(x, y, z)
    held = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert held < 20_000_000
    assert np.allclose(got[::4000], [L.gp_predict(x, y, z[k : k + 1])[0] for k in range(0, 20_000, 4000)], atol=1e-12)


def test_pairs_are_found_once(spark, sf):
    """Their features are cut by quantiles of all of them: without a table the sentences met the nuggets for either use."""
    assert "MapInArrow" not in pair_features(Tables(spark, sf))._jdf.queryExecution().executedPlan().toString()
