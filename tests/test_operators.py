"""Small hand-made cases."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from newstide.functions import math as M
from newstide.functions import text as T
from newstide.operators import clustering as C
from newstide.operators import selection as G
from newstide.operators import joins
from newstide.operators.joins import asof
from newstide.plans import scans
from newstide.plans.base import Tables
from newstide.plans.catalog import QUERIES
from newstide.sources import readers
from newstide.sources.resources import Registry, coverage, layers


def test_layers():
    assert layers({2: {11}, 9: {11, 8}, 10: {11, 3}, 11: {7, 5}, 8: {7, 3}}) == [[3, 5, 7], [8, 11], [2, 9, 10]]
    with pytest.raises(ValueError):
        layers({1: {2}, 2: {1}})


def test_registry_builds_once(spark):
    r, calls = Registry(), []

    @r.resource()
    def base():
        calls.append(1)
        return spark.range(4).withColumnRenamed("id", "k")

    @r.resource("base")
    def more(b):
        return b.where("k > 1")

    assert r.get("more").count() == 2 and r.get("base").count() == 4 and calls == [1]
    have = r.get("base").withColumn("topic", F.lit("t"))
    got = coverage(have, have.where("k < 3"), ["topic", "k"]).first()
    assert got.coverage == 0.75


def test_greedy_cover():
    assert C.greedy_cover([{"a", "b"}, {"b", "c"}, {"c"}, {"a", "b", "c", "d"}], 2) == [(3, 4)]
    assert C.greedy_cover([{"a", "b"}, {"b", "c"}, {"d"}], 2) == [(0, 2), (1, 1)]
    assert C.greedy_cover([], 3) == []


def test_carry_over():
    assert C.carried_buckets([1, 1, 3]) == [0, 0, 1]
    assert C.carried_buckets([0, 1, 1]) == [0, 0, 0]
    assert C.carried_buckets([2, 1]) == [0, -1]


def test_affinity_propagation_finds_blobs():
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(size=(8, 2)) * 0.1 + c for c in ((0, 0), (5, 5), (0, 6))])
    s = -((x[:, None] - x[None]) ** 2).sum(2)
    owner = C.affinity_propagation(s, float(np.median(s)))
    assert len(set(owner[:8])) == len(set(owner[8:16])) == len(set(owner[16:])) == 1 and len(set(owner)) == 3
    assert C.affinity_propagation(np.zeros((1, 1)), 0.0).tolist() == [0]


def test_novelty_against_all_differs_from_against_kept(spark):
    v = {1: [1.0, 0.0], 2: [0.9, 0.45], 3: [0.5, 0.87], 4: [0.0, 1.0]}
    df = spark.createDataFrame([("t", k, x) for k, x in v.items()], "topic string, id long, vector array<double>")
    kept = [r.id for r in G.greedy_novel(df, ["topic"], ["id"], 0.8).orderBy("id").collect()]
    assert kept == [1, 3]
    pairs = df.alias("a").join(df.alias("b"), F.col("a.id") < F.col("b.id")).where(M.cosine(F.col("a.vector"), F.col("b.vector")) >= 0.8).select(F.col("b.id").alias("id"))
    assert [r.id for r in df.select("id").join(pairs, "id", "left_anti").orderBy("id").collect()] == [1]


def test_streaming_dedup_by_hand(spark):
    docs = [("q", 1, 1, {"a": 2.0, "b": 1.0}), ("q", 2, 2, {"a": 2.0, "b": 1.0, "c": 0.5}), ("q", 3, 3, {"x": 1.0}), ("q", 4, 4, {"x": 1.0, "y": 0.5}), ("r", 5, 0, {"a": 1.0}), ("q", 6, 6, {})]
    df = spark.createDataFrame(docs, "query_id string, id long, epoch long, counts map<string,double>")
    got = {r.id: r.representative for r in G.streaming_dedup(df, ["query_id"], ["epoch"]).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 3, 5: 5, 6: 6}


def test_single_linkage(spark):
    nodes = spark.createDataFrame([(i,) for i in range(8)], "id long")
    edges = spark.createDataFrame([(0, 1), (1, 2), (2, 3), (5, 6)], "a long, b long")
    got = {r.id: r.cluster for r in C.single_linkage(nodes, edges).collect()}
    assert got == {0: 0, 1: 0, 2: 0, 3: 0, 4: 4, 5: 5, 6: 5, 7: 7}


def test_asof_never_looks_ahead(spark):
    left = spark.createDataFrame([("a", 5), ("a", 10), ("a", 11), ("b", 3)], "k string, at long")
    right = spark.createDataFrame([("a", 5, 1.0), ("a", 10, 2.0), ("b", 9, 3.0)], "k string, t long, v double")
    strict = {(r.k, r["at"]): r.v for r in asof(left, right, "k", "at", "t", "v").collect()}
    assert strict == {("a", 5): None, ("a", 10): 1.0, ("a", 11): 2.0, ("b", 3): None}
    equal = {(r.k, r["at"]): r.v for r in asof(left, right, "k", "at", "t", "v", strict=False, default=0.0).collect()}
    assert equal == {("a", 5): 1.0, ("a", 10): 2.0, ("a", 11): 2.0, ("b", 3): 0.0}


def edited(rnd, n, letters):
    """Texts of any length, and copies with up to a third of their characters changed; empty ones and other alphabets too."""
    out = ["", "a", "Ab", "日本語"]
    for _ in range(n):
        text = [rnd.choice(letters) for _ in range(rnd.choice([rnd.randint(1, 14), rnd.randint(20, 120)]))]
        for _ in range(3):
            copy = list(text)
            for _ in range(rnd.randint(0, 1 + len(text) // 3)):
                at = rnd.randrange(len(copy) + 1)
                copy[at : at + rnd.randint(0, 1)] = rnd.choice(["", rnd.choice(letters)])
            out.append("".join(copy))
    return sorted(set(out))


@pytest.mark.parametrize("letters, tile", [("ab", 512), ("abcdefgh é日", 7)])
def test_levenshtein_join_misses_nothing(spark, monkeypatch, letters, tile):
    import random

    monkeypatch.setattr(joins.levenshtein_candidates, "__defaults__", (tile,))
    texts = edited(random.Random(0), 40, letters)
    x = spark.createDataFrame([(k, w) for k, w in enumerate(texts[::2] + [None, "twice", "twice"])], "k int, x string")
    y = spark.createDataFrame([(w,) for w in texts[1::2] + [None, "TWICE"]], "y string")
    got = sorted((r.k, r.x, r.y, r.distance) for r in joins.levenshtein_join(x, y, "x", "y").collect())
    want = sorted(tuple(r) for r in x.crossJoin(y).withColumn("d", T.normalised_levenshtein("x", "y")).where("d <= 0.2").collect())
    assert got == want and len(want) > 9


def test_few_texts_are_compared(spark, sf):
    """Of the pairs of a band of lengths under one in twenty is a candidate."""
    t = Tables(spark, sf)
    x = t.nuggets.select(F.lower(T.ascii_folded("nugget_text")).alias("x")).distinct()
    y = t.sentences.select(F.lower(T.ascii_folded("sent_text")).alias("y")).distinct()
    every = x.join(y, F.abs(F.length("x") - F.length("y")) <= 0.2 * F.greatest(F.length("x"), F.length("y"))).count()
    assert joins.levenshtein_candidates(x, y, 0.2).count() < 0.05 * every


def test_latency_discount_and_f1(spark):
    r = spark.range(1).select(M.latency_discount(F.lit(0)).alias("a"), M.latency_discount(F.lit(21600)).alias("b"), M.latency_discount(F.lit(10**12)).alias("c"), M.f1(F.lit(0.0), F.lit(0.0)).alias("d"), M.f1(F.lit(0.5), F.lit(1.0)).alias("e")).first()
    assert (r.a, r.b, round(r.c, 4), r.d, round(r.e, 4)) == (1.0, 0.5, 0.0, 0.0, 0.6667)


def test_validation_names_the_first_broken_rule(spark):
    doc = "100-" + "a" * 32
    good = f"1 t run {doc} 0 150 1.0"
    lines = {
        good: None, f"1 t run {doc} 0 150": "not seven fields", f"1 t run {doc} 0 150 1.0 x": "not seven fields", f"9 t run {doc} 0 150 1.0": "unknown topic", f"1 t run_! {doc} 0 150 1.0": "bad run id",
        f"1 t runs {doc} 0 150 1.0": "another run id", "1 t run 100-xyz 0 150 1.0": "bad document id", f"1 t run {doc} -1 150 1.0": "bad sentence id", f"1 t run {doc} x 150 1.0": "bad sentence id",
        f"1 t run {doc} 0 99 1.0": "outside the topic", f"1 t run {doc} 0 150 0.0": "bad confidence", f"1 t run {doc} 1 200 1.0": None,
    }
    topics = spark.createDataFrame([(1, 100, 200)], "query_num long, start long, end long")
    rows = spark.createDataFrame([(x,) for x in lines], "line string")
    assert {r.line: r.error for r in scans.validated(rows, topics).collect()} == lines
    assert {r.error for r in scans.validated(rows.where(F.col("line") == good), topics, 0).collect()} == {"too many rows"}


def test_broken_files_go(spark):
    files = spark.createDataFrame([("a", "0cc175b9c0f1b6a831c399e269772661"), ("a", "b"), (None, "c"), ("b", None)], "text string, name string")
    assert [r.text for r in readers.intact(files, "text", "name").collect()] == ["a"]


def test_records_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([(1, "team", "run1", "5-ab", 2, 99, 0.5), (2, "team", "run1", 'q"uote', 0, 7, 1.0)], "qid int, team string, run string, stream_id string, sent_id int, ts long, conf double")
    readers.write_submission(rows, str(tmp_path / "s"))
    from newstide import schemas

    back = readers.read_records(spark, str(tmp_path / "s"), schemas.SUBMISSION, header=False)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, rows.collect()))


def test_topics_from_xml(spark, tmp_path):
    p = tmp_path / "topics.xml"
    p.write_text("<events>" + "".join(f"<event><id>{i}</id><title> Storm {i} </title><type>{k}</type><query>big storm</query><start>{i}00</start><end>{i}99</end></event>" for i, k in ((1, "storm"), (2, "riot"), (3, "storm"))) + "</events>")
    read = lambda **k: sorted(r.query_id for r in readers.read_topics(spark, str(p), **k).collect())
    assert read() == ["TS14.1", "TS14.2", "TS14.3"]
    assert read(types=["storm"]) == ["TS14.1", "TS14.3"]
    assert read(ids=[2, "TS14.3"], types=["storm"]) == ["TS14.2", "TS14.3"]


def test_mending(spark):
    cases = {"He said , \" yes \" .": None, "1 , 000 men at 5 p. m. in the U. S.": "1,000 men at 5 p.m. in the U.S.", "GENEVA, Switzerland — Talks began": "Talks began", "a ( b ) c": "a   c"}
    df = spark.createDataFrame([(k,) for k in cases], "t string").select("t", T.mended("t").alias("m"))
    got = {r.t: r.m for r in df.collect()}
    for k, v in cases.items():
        assert v is None or got[k] == v


def test_window_positions_keep_gaps(spark):
    from pyspark.sql import Window

    s = spark.createDataFrame([(1, 0, "one two"), (1, 1, "..."), (1, 2, "three")], "d long, i long, t string")
    r = s.withColumn("rank", F.row_number().over(Window.partitionBy("d").orderBy("i"))).where(F.size(T.words("t")) > 0)
    assert [x["rank"] for x in r.orderBy("rank").collect()] == [1, 3]


def test_words_of_other_alphabets(spark):
    texts = {"Größe über 3 Äpfel": ["größe", "über", "3", "äpfel"], "L'été à Noël": ["l", "été", "à", "noël"], "¿Qué pasó, señor?": ["qué", "pasó", "señor"], "Жизнь 日本 x2": ["жизнь", "日本", "x2"]}
    for text, want in texts.items():
        assert spark.createDataFrame([(text,)], "t string").select(T.words("t").alias("w")).first().w == want


@pytest.mark.parametrize("name", ["ev4_rouge_1", "ev4_rouge_2", "ev4_sampled_rouge"])
def test_every_reference_has_a_score(spark, sf, name):
    t = Tables(spark, sf)
    assert QUERIES[name](spark, sf).count() == t.conversations.where("role = 'assistant'").select("conv_id").distinct().count()


def test_every_checkpoint_has_a_score(spark, sf):
    t = Tables(spark, sf)
    spans = t.stream.groupBy("query_id").agg(F.min("epoch").alias("a"), F.max("epoch").alias("b")).collect()
    assert QUERIES["ev5_checkpoints"](spark, sf).count() == sum(len(range(12, (r.b - r.a) // 3600, 12)) for r in spans)
