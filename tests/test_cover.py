"""Covers by joins and rounds against loops over each topic."""

import random
from collections import defaultdict

import pytest

from newstide.operators import cover as K

SCHEMA = "topic string, epoch long, doc_id long, sent_id long, update_id string, nugget string"


def facts(seed, docs=24, nuggets=12):
    """Documents at equal and different times, facts that very many sentences carry, repeated rows."""
    rnd = random.Random(seed)
    rows = []
    for topic in ("a", "b", None):
        for d in range(docs):
            at, doc = rnd.randrange(6) * 1800, d + 100 * ord(topic or "c")
            for s in range(rnd.randint(1, 4)):
                own = rnd.sample(range(nuggets), rnd.randint(1, 4)) + [0] * (rnd.random() < 0.5)
                rows += [(topic, at, doc, s, f"{doc}-{s}", f"n{n}") for n in own]
    return rows + rows[:5]


def by_topic(rows):
    out = defaultdict(lambda: defaultdict(set))
    for topic, at, doc, s, update, n in rows:
        out[topic][at, doc, s, update].add(n)
    return {t: sorted(x.items()) for t, x in out.items()}


@pytest.mark.parametrize("seed, budget", [(0, 25), (1, 3)])
def test_cover_is_greedy(spark, seed, budget):
    want = set()
    for topic, rows in by_topic(facts(seed)).items():
        seen = set()
        for step in range(1, budget + 1):
            (*_, update), own = max(rows, key=lambda x: len(x[1] - seen))
            if not own - seen:
                break
            want.add((topic, step, update, len(own - seen)))
            seen |= own
    assert set(map(tuple, K.cover(spark.createDataFrame(facts(seed), SCHEMA), budget).collect())) == want


@pytest.mark.parametrize("seed, budget", [(2, 25), (3, 4)])
def test_streamed_cover_is_that_of_one_pass(spark, seed, budget):
    want = set()
    for topic, rows in by_topic(facts(seed)).items():
        seen, left = set(), budget
        for at, doc in dict.fromkeys(k[:2] for k, _ in rows):
            picked = 0
            own = [s for k, s in rows if k[:2] == (at, doc)]
            while left and max(len(s - seen) for s in own):
                seen |= max(own, key=lambda s: len(s - seen))
                picked, left = picked + 1, left - 1
            want.add((topic, doc, picked, len(seen), len(set().union(*(s for _, s in rows)))))
    assert set(map(tuple, K.streamed_cover(spark.createDataFrame(facts(seed), SCHEMA), budget).collect())) == want


@pytest.mark.parametrize("seed", [4, 5])
def test_step_choices_are_those_of_one_pass(spark, seed):
    want = set()
    for topic, rows in by_topic(facts(seed)).items():
        seen = set()
        for at, doc in dict.fromkeys(k[:2] for k, _ in rows):
            (*_, update), own = max(((k, s) for k, s in rows if k[:2] == (at, doc)), key=lambda x: len(x[1] - seen))
            gain, new = len(own - seen), set().union(*(s for k, s in rows if k[:2] == (at, doc))) - seen
            want.add((topic, doc, update if gain else "NEXT", gain, len(new) - gain))
            seen |= own if gain else set()
    got, rounds = K.step_choices(spark.createDataFrame(facts(seed), SCHEMA))
    assert set(map(tuple, got.collect())) == want
    assert rounds <= 16


def test_nothing_to_cover(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert not K.cover(none, 3).collect() and not K.streamed_cover(none, 3).collect() and not K.step_choices(none)[0].collect()
