"""A crawl of cyclic graphs, and units built where they are missing."""

import os
import random
import shutil

import pytest

from newstide.operators.crawl import crawl
from newstide.sources.resources import build_missing


@pytest.mark.parametrize("depth", [None, 0, 3])
def test_crawl_visits_every_node_once(spark, depth):
    rnd = random.Random(1)
    edges = [(rnd.randrange(60), rnd.randrange(60)) for _ in range(90)] + [(1, 2), (2, 3), (3, 1), (5, 5), (None, 7), (8, None)]
    seeds = [1, 5, 5, None]
    want, level = {}, {1, 5}
    while level and (depth is None or not want or max(want.values()) < depth):
        step = max(want.values(), default=-1) + 1
        want |= dict.fromkeys(level, step)
        level = {b for a, b in edges if a in level and b is not None} - want.keys()
    got = crawl(spark.createDataFrame(edges, "parent long, child long"), spark.createDataFrame([(s,) for s in seeds], "node long"), depth).collect()
    assert {r.node: r.depth for r in got} == want and len(got) == len(want)


def test_crawl_from_nowhere(spark):
    assert not crawl(spark.createDataFrame([(1, 2)], "parent long, child long"), spark.createDataFrame([], "node long")).collect()


def test_only_missing_units_are_built(spark, tmp_path):
    rows = spark.createDataFrame([("007", h, f"{h}-{k}") for h in (1, 2, 3) for k in range(4)] + [("b", 1, "x"), (None, 1, "y")], "topic string, hour long, text string")
    wanted, path, asked = rows.select("topic", "hour"), f"file:{tmp_path}/units", []

    def build(units):
        asked.append(sorted(map(tuple, units.collect())))
        return rows.join(units, ["topic", "hour"])

    times = lambda: {f: os.stat(f"{d}/{f}").st_mtime_ns for d, _, names in os.walk(tmp_path / "units") for f in names if f.startswith("part-")}
    assert build_missing(wanted.where("hour < 3"), path, build).count() == 3
    assert sorted(map(tuple, build_missing(wanted, path, build).collect())) == [("007", 3)]
    before = times()
    assert build_missing(wanted, path, build).count() == 0 and times() == before
    shutil.rmtree(tmp_path / "units" / "topic=007" / "hour=2")
    assert build_missing(wanted, path, build).count() == 1
    assert asked == [[("007", 1), ("007", 2), ("b", 1)], [("007", 3)], [("007", 2)]]
    assert all(times()[f] == t for f, t in before.items() if f in times())
    there = spark.read.schema("text string, topic string, hour long").parquet(path)
    assert sorted((r.topic, r.hour, r.text) for r in there.collect()) == sorted((r.topic, r.hour, r.text) for r in rows.collect() if r.topic)
