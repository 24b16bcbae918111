"""What is shuffled: words are counted where their document is, and rows travel once."""

import math
import re
from collections import Counter

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from newstide.functions import text as T
from newstide.operators import affinity as A
from newstide.operators import clustering as C
from newstide.operators import selection as G
from newstide.operators.joins import levenshtein_candidates, sparse_matches
from newstide.operators.ordered import lookup
from newstide.plans import aggregating, computing, joining, learning
from newstide.plans import selecting as S
from newstide.plans.base import Tables

POINTS = "topic string, bucket long, id string, epoch long, bins array<int>, salience double"


@pytest.fixture()
def t(spark, sf):
    return Tables(spark, sf)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def shuffles(df):
    """The keys of every shuffle of a plan, the join of documents and events aside."""
    found = re.findall(r"Exchange (?:hash|range)partitioning\(([^)]*)\)|Exchange (SinglePartition)", plan(df))
    return [re.sub(r"#\d+L?", "", a or b) for a, b in found if not re.match(r"(doc_id|event_id)#\d+L?, \d+$", a)]


def some_points(spark, n=60):
    rows = [(f"t{k % 2}", 3600 * (k % 3), f"u{k:03}", k, [k % 7, k % 5, k % 11, 13], float(k % 9)) for k in range(n)]
    return rows, spark.createDataFrame(rows, POINTS).repartition(3)


def test_points_are_shuffled_once(t):
    assert "Window" not in plan(S.points(t))
    assert [s.split(",")[0] for s in shuffles(S.points(t))] == ["query_id"]


def test_similar_documents_shuffle_no_words(spark):
    """A row of a shuffle is a document, once for each block of its group, and never one of its words."""
    rows = [(f"t{k % 2}", k, {f"w{j}": float(1 + j * k % 3) for j in range(k % 5 + 1)}) for k in range(40)]
    pairs = G.sparse_pairs(spark.createDataFrame(rows, "topic string, id long, counts map<string,double>"), ["topic"], 0.8)
    assert {s.split(",")[0] for s in shuffles(pairs)} <= {"group", "_g"} and "Window" not in plan(pairs)


def test_factors_cells_are_made_without_shuffled_words(t, monkeypatch):
    """Words are counted in the document's row and find their numbers there; blocks grow with the cells."""
    seen = {}

    def taken(counts, **how):
        seen.update(how, counts=counts)
        return counts.select(F.col("doc").alias("id"), F.array(F.lit(0.5)).alias("features")).distinct(), None

    monkeypatch.setattr(learning.L, "weighted_factors", taken)
    monkeypatch.setattr(learning.L, "CELLS", 700)
    assert learning.ml6(t).count() == t.documents.count()
    assert not [s for s in shuffles(seen["counts"]) if "token" in s]
    rows = seen["counts"].collect()
    assert Counter(r.n for r in rows) == Counter(float(r.n) for r in t.document_counts.select("n").collect())
    assert len({(r.doc, r.word) for r in rows}) == len(rows) and max(r.word for r in rows) == t.document_counts.select("token").distinct().count()
    assert seen["blocks"] == max(10, -(-len(rows) // 700))


def test_exemplars_carry_their_own_columns(spark):
    rows, df = some_points(spark)
    own = {r[2]: (r[3], r[4]) for r in rows}
    found = A.ap_clusters(df, ["topic", "bucket"], least=2, carry=["epoch", "bins"]).collect()
    assert found and all((r.epoch, r.bins) == own[r.id] for r in found)


def test_linkage_clusters_carry_their_own_columns(spark):
    rows, df = some_points(spark)
    own = {r[2]: (r[3], r[4]) for r in rows}
    found = C.linkage_clusters(df, ["topic", "bucket"], 0.7, ["epoch", "bins"]).collect()
    assert found and all((r.epoch, r.bins) == own[r.id] for r in found)


def test_tokens_of_an_array_are_counted(spark):
    rows = [(0, []), (1, ["b"]), (2, ["b", "a", "b", "\u00e9", "a", "b"]), (3, ["z"] * 5)]
    got = spark.createDataFrame(rows, "id long, w array<string>").select("id", T.counted("w").alias("c")).collect()
    assert {r.id: [tuple(x) for x in r.c] for r in got} == {k: sorted(Counter(w).items()) for k, w in rows}


def test_words_are_counted_where_the_document_is(t):
    for f in (aggregating.ag1, aggregating.ag2):
        assert shuffles(f(t)) == []
    assert [s.split(",")[0] for s in shuffles(aggregating.ag3(t))] == ["update_id"]


def test_soft_matches_shuffle_no_sentence(t):
    assert shuffles(joining.soft_matches(t)) == []


def test_sentences_shuffle_no_words_for_their_idf(t):
    assert [s.split(", ")[:3] for s in shuffles(joining.jn16(t))] == [["doc_id", "epoch", "sent_id"]]


@pytest.mark.parametrize("most", [0, 3, 100])
@pytest.mark.parametrize("how", ["inner", "left"])
def test_lookup_is_a_join(spark, most, how):
    rows = spark.createDataFrame([(k, f"w{k % 9}") for k in range(40)], "id long, token string")
    table = spark.createDataFrame([(f"w{k}", k // 2, k * 10) for k in range(1, 8)], "token string, df long, x long")
    got = lookup(rows, table, "token", "df", "id", how, most).select("id", "token", "df", "x").collect()
    assert sorted(got, key=str) == sorted(rows.join(table, "token", how).select("id", "token", "df", "x").collect(), key=str)


@pytest.mark.parametrize(("most", "copies"), [(0, 0), (3, 0), (3, 16)])
def test_rare_keys_are_shuffled_not_broadcast(spark, monkeypatch, most, copies):
    """Copies of a table weren't in its estimated size, so the driver got sixteen of each row; now there are some only where a key has very many rows."""
    from newstide.operators import ordered

    monkeypatch.setattr(ordered, "SHARE", 1 if copies else 100_000)
    rows = spark.createDataFrame([(k, f"w{k % 90}") for k in range(400)], "id long, token string")
    table = spark.createDataFrame([(f"w{k}", 40 + k // 2, k * 10) for k in range(1, 70)], "token string, df long, x long")
    got = lookup(rows, table, "token", "df", "id", "left", most)
    assert plan(got).count("SortMergeJoin") == 1
    assert plan(got).count("Generate explode") == (1 if copies else 0)
    assert sorted(got.select("id", "x").collect(), key=str) == sorted(rows.join(table, "token", "left").select("id", "x").collect(), key=str)


def test_long_keys_count_for_several_rows_of_a_broadcast(spark):
    rows = spark.createDataFrame([(k, "w" * (1 + 1000 * (k % 3))) for k in range(9)], "id long, token string")
    table = spark.createDataFrame([("w" * (1 + 1000 * k), 3 - k, k) for k in range(3)], "token string, df long, x long")
    got = lookup(rows, table, "token", "df", "id", "inner", 20)  # three rows, 49 of 64 bytes
    assert "SortMergeJoin" in plan(got)
    assert sorted(r.x for r in got.collect()) == [0, 0, 0, 1, 1, 1, 2, 2, 2]


@pytest.mark.parametrize("postings", [5, 100_000])
def test_sparse_matches_are_all_pairs(spark, monkeypatch, postings, t):
    from newstide.operators import joins
    from newstide.sources.readers import scratch

    scratch(spark, "")
    monkeypatch.setattr(joins, "POSTINGS", postings)
    words = "alpha beta gamma delta epsilon".split()
    left = {k: [words[(k * j) % 5] for j in range(1, 2 + k % 4)] for k in range(12)}
    right = {f"n{k}": Counter(words[(k + j * j) % 5] for j in range(1 + k)) for k in range(5)}
    rows = spark.createDataFrame([(k, w) for k, w in left.items()], "id long, words array<string>")
    table = spark.createDataFrame([(k, w, n) for k, c in right.items() for w, n in c.items()], "nugget_id string, token string, w long")
    got = {(r.id, r.nugget_id): (r.dot, r.a, r.b) for r in sparse_matches(rows, "words", table, "nugget_id", 0.6).collect()}
    want = {}
    for k, w in left.items():
        c = Counter(w)
        for name, d in right.items():
            dot, a, b = sum(c[x] * d[x] for x in c), sum(v * v for v in c.values()), sum(v * v for v in d.values())
            if dot >= 0.6 * math.sqrt(a * b):
                want[k, name] = (dot, a, b)
    assert got == want


def test_stream_unigrams_shuffle_no_tokens(t):
    from newstide.plans import windows

    p = plan(windows.wn3(t))
    assert "regexp_extract_all(lower(sent_text" not in p and not [s for s in shuffles(windows.wn3(t)) if s.startswith("query_id, doc_id, epoch, token")]


def test_trigrams_are_made_where_the_sentence_is(spark, t):
    from newstide.functions import lm
    from newstide.plans import computing

    rows = spark.createDataFrame([(["x", "y", "z"],), (["x"],), ([],)], "w array<string>")
    got = sorted(tuple(r) for r in rows.select(F.inline(lm.trigrams("w"))).collect())
    assert got == [("<s>", "<s>", "x"), ("<s>", "<s>", "x"), ("<s>", "x", "y"), ("x", "y", "z")]
    assert "Window" not in plan(computing._grams(t)) and shuffles(computing._grams(t)) == []


def test_several_models_are_what_each_is_alone(spark):
    from newstide.functions import lm

    words = [["a", "b", "a", "c"], ["a", "b"], ["c", "a", "b", "a"], ["d"]]
    rows = spark.createDataFrame([(k, w) for k, w in enumerate(words)], "id long, w array<string>").select("id", F.inline(lm.trigrams("w")))
    models = {"all": F.lit(True), "some": F.col("id") < 2, "none": F.col("id") < 0}
    key = lambda r: (r.a, r.b, r.c)
    both = {key(r): r for r in lm.probabilities(rows, models).collect()}
    for m, on in models.items():
        assert {key(r): r[m] for r in lm.probabilities(rows, {m: on}).collect()} == {k: r[m] for k, r in both.items()}
    assert len(both) == rows.select("a", "b", "c").distinct().count() and all(r["none"] is None and 0 < r["some"] < 1 and 0 < r["all"] < 1 for r in both.values())


def test_ngrams_travel_with_their_first_words(spark, t):
    from newstide.operators import grams
    from newstide.plans import computing

    words = ["x y x y x y".split(), ["x"], [], "y x y z".split(), "z z z z z z".split()]
    rows = spark.createDataFrame([(k, w) for k, w in enumerate(words)], "id long, w array<string>").repartition(2)
    of = {k: Counter(tuple(w[i : i + n]) for n in (2, 3, 4, 5) for i in range(len(w) - n + 1)) for k, w in enumerate(words)}
    df = Counter(g for c in of.values() for g in c)
    got = grams.weighed(rows, "w", 5, lambda n, df: n / df).groupBy("id").agg(F.sum("grams").alias("n"), F.sum("squares").alias("s"), F.max("top").alias("m")).collect()
    want = {k: (len(c), round(sum((n / df[g]) ** 2 for g, n in c.items()), 9), max(n / df[g] for g, n in c.items())) for k, c in of.items() if c}
    assert {r.id: (r.n, round(r.s, 9), r.m) for r in got} == want
    p = plan(computing.tx18(t))
    assert p.count("array_join") == 0 and not [s for s in shuffles(computing.tx18(t)) if s.startswith("update_id")]


@pytest.mark.parametrize("most", [0, 1, 7, 60, 500])
def test_first_by_hash_are_those_of_a_window(spark, most):
    from newstide.operators.ordered import hash_first

    rows = spark.createDataFrame([(k, float(k % 3 == 0)) for k in range(300)], "id long, label double").repartition(5)
    h = F.md5(F.col("id").cast("string"))
    want = rows.withColumn("n", F.row_number().over(Window.partitionBy("label").orderBy(h))).where(F.col("n") <= most).drop("n")
    assert sorted(hash_first(rows, ["label"], h, most).collect()) == sorted(want.collect())


def test_sentences_meet_their_nuggets_where_they_are(t):
    from newstide.plans import learning

    assert [s for s in shuffles(joining.nugget_sets(t)) if not s.startswith("nugget_text")] == []
    assert [s for s in shuffles(learning.sentence_features(t)) if not s.startswith("nugget_text")] == []


def test_terms_are_weighed_where_the_document_is(spark, t, monkeypatch):
    from newstide.operators import terms
    from newstide.plans import computing, windows

    for f in (computing.tx17, windows.wn7, joining.sentence_terms):
        assert shuffles(f(t)) == [] and not re.search("Window|HashAggregate", plan(f(t)))
    docs = {1: [["a", "b", "a"], [], ["b"]], 2: [], 3: [[]], 4: [["c"]]}
    df = spark.createDataFrame([*docs.items(), (5, None)], "doc_id long, s array<array<string>>")
    got = {(r.doc_id, r.rank, r.token): r.w for r in terms.unit_tfidf(df).collect()}
    a, b = 2 * (math.log(3 / 2) + 1), 1.0
    want = {(1, 1, "a"): a / math.hypot(a, b), (1, 1, "b"): b / math.hypot(a, b), (1, 3, "b"): 1.0, (4, 1, "c"): 1.0}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)
    sims = {r.doc_id: [(x.rank, round(x.sim, 9)) for x in r.sims] for r in terms.centrality(df).collect()}
    assert sims == {1: [(1, round(6 / math.sqrt(5 * 8), 9)), (3, round(2 / math.sqrt(8), 9))], 2: [], 3: [], 4: [(1, 1.0)], 5: []}


@pytest.mark.parametrize("postings,cells", [(5, 8), (100_000, 1 << 21)])
def test_nearest_rows_are_the_first_of_the_best(spark, monkeypatch, postings, cells, t):
    from newstide.operators import joins
    from newstide.sources.readers import scratch

    scratch(spark, "")
    monkeypatch.setattr(joins, "POSTINGS", postings)
    monkeypatch.setattr(joins, "CELLS", cells)
    words = "alpha beta gamma delta epsilon".split()
    left = {(k // 3, k % 3): [words[(k * j) % 4] for j in range(1, 2 + k % 4)] for k in range(30, -1, -1)}
    right = {k: Counter(words[(k + j * j) % 5] for j in range(1 + k)) for k in range(5)} | {9: Counter(["omega"])}
    rows = spark.createDataFrame([(*k, w) for k, w in left.items()], "doc_id long, sent_id long, words array<string>").repartition(3)
    table = spark.createDataFrame([(k, w, n) for k, c in right.items() for w, n in c.items()], "item_id long, token string, w long")
    got = {r.item_id: (-round(r.score, 6), r.doc_id, r.sent_id) for r in joins.nearest_rows(rows, "words", ["doc_id", "sent_id"], table, "item_id").collect()}
    want = {}
    for name, d in right.items():
        all_ = [(-round(sum(n * d[w] for w, n in c.items()) / math.sqrt(sum(n * n for n in c.values())), 6), *k) for k, c in ((k, Counter(w)) for k, w in left.items())]
        if min(all_)[0] < 0:
            want[name] = min(all_)
    assert got == want and 9 not in got
    assert [s for s in shuffles(joining.jn13(t)) if "doc_id" in s] == []


def test_fuzzy_matches_shuffle_no_sentence(t, sf):
    """Nuggets go where the sentences are: what is shuffled, the join of documents and events aside, is nuggets and what matched."""
    folded = t.sentences.select(T.ascii_folded("sent_text").alias("y"))
    n = t.nuggets.select("nugget_id", T.ascii_folded("nugget_text").alias("x"))
    near = levenshtein_candidates(n.select(F.lower("x").alias("x")).distinct(), folded.select("y"), 0.2)
    assert not shuffles(near)
    found = joining.jn14(t).collect()
    assert len(set(found)) == len(found) and {(r.nugget_id, r.y) for r in found if r.exact} == {(r.nugget_id, r.x) for r in n.join(folded.distinct(), F.col("x") == F.col("y")).collect()}


def test_stem_vectors_shuffle_a_row_a_sentence(t):
    """Stems are counted where the sentence is and weighed there: no shuffle goes by a sentence's stem or by a word."""
    found = shuffles(computing.tx18_stems(t))
    assert not [s for s in found if "token" in s or "stem" in s]


def test_words_weigh_by_all_trigrams_that_end_with_them(spark):
    """They are looked up by that: a word that ends many trigrams after one and the same word is frequent."""
    from newstide.functions import lm
    from newstide.sources.readers import scratch

    scratch(spark, "")
    words, _ = lm._words(spark.createDataFrame([("x", "y", 50), ("x", "z", 1), ("z", "x", 2)], "b string, c string, n long"), "m")
    assert {r.word: r.seen_m for r in words.collect()} == {"x": 2, "y": 50, "z": 1}
