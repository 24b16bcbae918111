"""Near-duplicates, clustering, novelty filters, selection policies and learned components."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import math as M
from ..functions import text as T
from ..operators import affinity as A
from ..operators import clustering as C
from ..operators import cover as K
from ..operators import selection as G
from ..operators.components import written
from ..sources import readers
from .base import query, r6
from .joining import SETS, nugget_sets


def _ready(t):
    """Iterations cut their lineage in the session's checkpoint folder."""
    readers.scratch(t.spark, "")


def points(t):
    """Sentences to choose from: those that pass the simple quality test, each text once a topic and hour.

    Bins (hashes of words) stand for latent dimensions, and words and capitals for a model's salience.
    """
    parts = t.stream.select("query_id", "hour", "epoch", F.unhex(F.md5(F.col("doc_id").cast("string"))).alias("doc"), T.sentences("text").alias("parts"))
    s = parts.select("query_id", "hour", "epoch", "doc", F.size(F.filter("parts", lambda x: F.trim(x) != "")).alias("doclen"), F.posexplode("parts").alias("sent", "part"))
    s = s.withColumn("sent_text", F.trim("part")).where("sent_text <> ''").where(T.simple_quality("sent_text", "doclen"))
    # an update's id, in the parts it is made of: half as long in a shuffle, and in the same order
    first = s.groupBy("query_id", "hour", "sent_text").agg(F.min(F.struct("epoch", "doc", F.col("sent").cast("string").alias("sent"))).alias("x"))
    w = T.words("sent_text")
    return first.select(
        F.col("query_id").alias("topic"), F.unix_seconds("hour").alias("bucket"), F.concat_ws("-", F.col("x.epoch").cast("string"), F.lower(F.hex("x.doc")), "x.sent").alias("id"), F.col("x.epoch").alias("epoch"),
        F.transform(w, lambda x: F.pmod(F.xxhash64(x), F.lit(C.WIDTH)).cast("int")).alias("bins"), r6(F.log(1.0 + F.size(w)) + T.matches("sent_text", "[A-Z]") / 10).alias("salience"),
    )


def point_table(t):
    """The points as a table, for queries that need them more than once."""
    _ready(t)
    return written(points(t))


COS = "list_sum(list_transform(range(1, 65), lambda i: a.embedding[i]::DOUBLE * b.embedding[i])) / sqrt(list_sum(list_transform(a.embedding, lambda x: x::DOUBLE * x)) * list_sum(list_transform(b.embedding, lambda x: x::DOUBLE * x)))"


def labelled(t):
    """(label, id, vector) of the vectors that have a label."""
    return t.embeddings.where("label is not null").select("label", F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vector"))


def label_pairs(t, least: float):
    """(a, b, cosine) of the vectors with the same label and a cosine of ``least`` or more, a before b."""
    return G.dense_pairs(labelled(t), ["label"], ["id"], least)


def label_repeats(t, least: float):
    """(id) of the vectors with a cosine of ``least`` or more to one before them with the same label."""
    return G.repeats(narrow(t), ["label"], ["id"], least)


def narrow(t):
    """As ``labelled``, with the numbers as the table has them: in a tile they are doubles."""
    return t.embeddings.where("label is not null").select("label", F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))


def document_counts(t):
    """Word counts of each document's first 20 sentences, counted where the document is; those without words are left out."""
    first = F.slice(F.filter(F.transform(T.sentences("text"), lambda x: F.trim(x)), lambda x: x != ""), 1, 20)
    d = t.stream.select("query_id", F.col("doc_id").alias("id"), "epoch", F.flatten(F.transform(first, lambda x: T.words(x))).alias("w")).where(F.size("w") > 0)
    return d.select("query_id", "id", "epoch", F.map_from_entries(F.transform(T.counted("w"), lambda x: F.struct(x["token"].alias("token"), x["n"].cast("double").alias("n")))).alias("counts"))


@query("dd1_streaming_dedup")
def dd1(t):
    """Order-dependent: each topic's documents in time order against earlier representatives."""
    return G.streaming_dedup(document_counts(t), ["query_id"], ["epoch", "id"])


@query("dd1_similar_pairs", """WITH c AS (SELECT k.query_id, k.doc_id, token, count(*) AS n FROM top20 k JOIN tokens USING (update_id) GROUP BY ALL), s AS (SELECT doc_id, sqrt(sum(n * n)) AS norm FROM c GROUP BY doc_id),
    p AS (SELECT x.doc_id AS a, y.doc_id AS b, CAST(sum(x.n * y.n) AS DOUBLE) AS dot FROM c x JOIN c y ON x.query_id = y.query_id AND x.token = y.token AND x.doc_id < y.doc_id GROUP BY ALL)
    SELECT a, b, round(dot / (sa.norm * sb.norm), 6) AS cosine FROM p JOIN s sa ON sa.doc_id = a JOIN s sb ON sb.doc_id = b WHERE dot / (sa.norm * sb.norm) >= 0.8""")
def dd1_pairs(t):
    _ready(t)
    return G.sparse_pairs(written(document_counts(t)), ["query_id"], 0.8).select("a", "b", r6("cosine").alias("cosine"))


@query("dd2_novel_against_all", f"SELECT vec_id AS id FROM embeddings b WHERE NOT EXISTS (SELECT 1 FROM embeddings a WHERE a.label = b.label AND a.vec_id < b.vec_id AND {COS} >= 0.25)")
def dd2(t):
    """Kept iff every earlier row, kept or not, is less similar: no order of evaluation, so an anti-join."""
    return t.embeddings.select(F.col("vec_id").alias("id")).join(label_repeats(t, 0.25), "id", "left_anti")


@query("dd3_novel_against_kept")
def dd3(t):
    """Each vector against those of its label that were kept before it."""
    e = t.embeddings.select(F.col("label").cast("long").alias("topic"), F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vector"))
    return G.greedy_novel(e, ["topic"], ["id"], 0.25)


@query("cl1_affinity_propagation")
def cl1(t):
    """Exemplars by topic and hour, emitted when the hour ends; hours of fewer than ten sentences have none."""
    return A.ap_clusters(points(t), ["topic", "bucket"]).withColumn("emitted", F.col("bucket") + 3600)


def _top(s, m):
    return m.greatest(s.top_salience, 0.0)


#: Standardised cosines and saliences, both less the larger of their maxima.
SALIENT = A.Scale(lambda c, s, m: (c - s.top) / s.dev - _top(s, m), lambda p, s, m: p - _top(s, m))


@query("cl2_affinity_propagation_salience")
def cl2(t):
    return A.ap_clusters(points(t), ["topic", "bucket"], SALIENT, most=500).withColumn("emitted", F.col("bucket") + 3600)


#: Negative squared distances of unit vectors; the preference is a squashed salience over the median of the shifted cosine kernel.
SUPPORT = A.Scale(lambda c, s, m: 2 * c - 2, lambda p, s, m: 1 / (1 + m.exp(-p)) + A.middle(lambda c: -((1 - c) * (1 - c)) - 20, s))


@query("cl3_bucketed_salience_clusters")
def cl3(t):
    return A.ap_clusters(points(t), ["topic", "bucket"], SUPPORT, least=2).withColumn("emitted", F.col("bucket") + 3600)


#: Negative cosine distances; preferences at most -0.05, less an offset of 4.
LOWERED = A.Scale(lambda c, s, m: c - 1, lambda p, s, m: m.least(p + A.middle(lambda c: c - 1, s), -0.05) - 4.0)


@query("cl4_wide_bucket_clusters")
def cl4(t):
    """Buckets of four hours, exemplars filtered by what earlier buckets of the topic kept."""
    wide = points(t).withColumn("bucket", F.floor(F.col("bucket") / 14400) * 14400)
    rows = A.ap_clusters(wide, ["topic", "bucket"], LOWERED, least=2, carry=["bins"])
    return G.greedy_novel(rows, ["topic"], ["bucket", "id"], 0.4, ["bucket", "id", "cluster_size"])


@query("cl5_bucket_carry_over")
def cl5(t):
    """Hours of a topic with at most one sentence join the next."""
    return C.carry_over(t.sentences.select("query_id", F.floor(F.col("epoch") / 3600).alias("hour")), ["query_id"], "hour")


HAC = f"(SELECT a.vec_id AS a, b.vec_id AS b FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id < b.vec_id WHERE round({COS}, 6) >= 0.3)"


@query("cl6_single_linkage", f"""WITH RECURSIVE e AS (SELECT a, b FROM {HAC} UNION ALL SELECT b, a FROM {HAC}), reach AS (SELECT vec_id AS id, vec_id AS other FROM embeddings UNION SELECT r.id, e.b FROM reach r JOIN e ON e.a = r.other),
    n AS (SELECT id, min(other) AS cluster FROM reach GROUP BY id), v AS (SELECT n.id, n.cluster, unnest(range(1, 65)) AS i, unnest(embedding)::DOUBLE AS x FROM n JOIN embeddings ON vec_id = id), m AS (SELECT cluster, i, avg(x) AS c FROM v GROUP BY ALL),
    d AS (SELECT id, cluster, round(sum((x - c) * (x - c)), 5) AS far FROM v JOIN m USING (cluster, i) GROUP BY ALL)
    SELECT id, cluster, first_value(id) OVER (PARTITION BY cluster ORDER BY far, id) AS exemplar FROM d""")
def cl6(t):
    """Single linkage cut at a similarity is connected components of the pairs above it; the exemplar is nearest to the mean."""
    _ready(t)
    e = t.embeddings.select(F.col("vec_id").alias("id"), "embedding")
    c = C.single_linkage(e, label_pairs(t, 0.3 - 1e-6).where(F.round("cosine", 6) >= 0.3))
    v = c.join(e, "id").select("id", "cluster", F.posexplode(F.col("embedding").cast("array<double>")).alias("i", "x"))
    mean = v.groupBy("cluster", "i").agg(F.avg("x").alias("m"))
    far = v.join(mean, ["cluster", "i"]).groupBy("id", "cluster").agg(F.round(F.sum((F.col("x") - F.col("m")) * (F.col("x") - F.col("m"))), 5).alias("far"))
    lead = far.groupBy("cluster").agg(F.min(F.struct("far", "id")).alias("x")).select("cluster", F.col("x.id").alias("exemplar"))
    return c.join(lead, "cluster").select("id", "cluster", "exemplar")


@query("cl7_geo_clusters")
def cl7(t):
    """Places of a region by affinity propagation on negative great-circle miles."""
    from .joining import geo

    region = t.nation.select(F.col("n_nationkey").alias("k"), F.col("n_regionkey").cast("long").alias("region"))
    places = geo(t).join(region, "k").select("region", F.col("k").cast("long").alias("id"), F.array(F.col("lat").cast("double"), F.col("lng").cast("double")).alias("vector"))

    def f(table):
        d = -M.miles_between(C.vectors(table))
        owner = C.affinity_propagation(d, float(np.median(d[np.triu_indices(len(d), 1)])) if len(d) > 1 else 0.0)
        ids = table.column("id").to_pylist()
        return {"id": ids, "center": [ids[k] for k in owner]}

    return C.by_group(places, ["region"], ["id"], f, "region long, id long, center long")


def _clusters(t):
    return A.ap_clusters(points(t), ["topic", "bucket"], carry=["epoch", "bins", "salience"])


def _z(df, by):
    """Rows with their standardised salience within ``by``; the mean and deviation of a group are one row of it."""
    stats = df.groupBy(*by).agg(F.avg("salience").alias("_m"), F.stddev_pop("salience").alias("_s"))
    return df.join(stats, by).withColumn("z", (F.col("salience") - F.col("_m")) / F.nullif(F.col("_s"), F.lit(0.0))).drop("_m", "_s")


@query("fl1_cluster_novelty_filter")
def fl1(t):
    return G.greedy_novel(_clusters(t).where("cluster_size >= 2"), ["topic"], ["bucket", "epoch", "id"], 0.2264, ["bucket", "id"])


@query("fl2_salience_ranked_filter")
def fl2(t):
    rows = _z(_clusters(t), ["topic", "bucket"]).where("z >= 0 and cluster_size >= 2").withColumn("order", -F.col("salience"))
    return G.greedy_novel(rows, ["topic"], ["bucket", "order", "id"], 0.4, ["bucket", "id"])


@query("fl3_salience_time_filter")
def fl3(t):
    return G.greedy_novel(_z(_clusters(t), ["topic", "bucket"]).where("z >= 0 and cluster_size >= 2"), ["topic"], ["bucket", "epoch", "id"], 0.6, ["bucket", "id"])


@query("fl4_linkage_filter")
def fl4(t):
    """Linkage clusters of each hour; what stands nearest the centroid of two or more sentences is held against what was kept."""
    found = C.linkage_clusters(points(t), ["topic", "bucket"], 0.7, ["epoch", "bins"]).where("cluster_size >= 2")
    return G.greedy_novel(found, ["topic"], ["bucket", "epoch", "id"], 0.7, ["bucket", "id"])


@query("fl5_ranked_salience_filter")
def fl5(t):
    """Salient sentences of each hour, the most salient first; hours that keep none have a row without a sentence."""
    p = point_table(t)
    rows = _z(p, ["topic", "bucket"]).where("z > 0.4").withColumn("order", -F.col("salience"))
    kept = G.greedy_novel(rows, ["topic", "bucket"], ["order", "id"], 0.4)
    empty = p.select("topic", "bucket").distinct().join(kept, ["topic", "bucket"], "left_anti").withColumn("id", F.lit(None).cast("string"))
    return kept.unionByName(empty)


def _millionths(cosines):
    """Cosines rounded to six digits as whole numbers, those under .15 as 0: their sums are exact in any order."""
    c = np.floor(cosines * 1e6 + 0.5).astype(np.int64)
    return np.where(c >= 150_000, c, 0)


def similarity_sums(table, first):
    """Of a tile: the sum of each row's similarities to later ones that repeat nothing."""
    total, once = np.zeros(table.num_rows, np.int64), ~table.column("twice").to_numpy()
    for left, right, s, after in G.strips(table, first):
        c = _millionths(s)
        total[left] += (c * (after & once[right])).sum(1)
        if first is not None:
            total[right] += (c * (~after & once[left][:, None])).sum(0)
    some = np.flatnonzero(total)
    return {"past": table.column("id").take(pa.array(some)).combine_chunks(), "total": total[some]}


def largest_shares(table, first):
    """Of a tile: the largest share that each row which repeats nothing has of an earlier one's sum, the first one of equal ones, and that one's salience."""
    total, once = np.maximum(table.column("total").to_numpy(), 1) / 1e6, ~table.column("twice").to_numpy()
    share, past = np.zeros(table.num_rows), np.zeros(table.num_rows, np.int64)
    for left, right, s, after in G.strips(table, first):
        c = _millionths(s) / 1e6
        turned = [] if first is None else [(right, left, c.T, ~after.T)]
        for of, to, x, later in ((left, right, c, after), *turned):
            z = np.floor(np.where(later & once[to], x / total[of][:, None], 0.0) * 1e9 + 0.5) / 1e9
            at = z.argmax(0)  # rows are in order
            top = z[at, np.arange(len(to))]
            better = (top > share[to]) | ((top == share[to]) & (top > 0) & (of[at] < past[to]))
            share[to[better]], past[to[better]] = top[better], of[at][better]
    some = np.flatnonzero(share)
    ids, salience = table.column("id"), table.column("salience").to_numpy()
    return {"id": ids.take(pa.array(some)).combine_chunks(), "share": share[some], "past": ids.take(pa.array(past[some])).combine_chunks(), "weight": salience[past[some]]}


@query("fl6_salience_penalty", f"""WITH b AS (SELECT *, round(abs(embedding[1]::DOUBLE), 6) AS salience FROM embeddings), s AS (SELECT a.vec_id AS past, b.vec_id AS id, a.salience AS weight, round({COS}, 6) AS c FROM b JOIN b a ON a.label = b.label AND a.vec_id < b.vec_id),
    same AS (SELECT DISTINCT id FROM s WHERE c > 0.95), n AS (SELECT * FROM s WHERE c >= 0.15 AND id NOT IN (FROM same)), z AS (SELECT *, round(c / sum(c) OVER (PARTITION BY past), 9) AS share FROM n), p AS (SELECT id, arg_max(share * weight, (share, -past)) AS penalty FROM z GROUP BY id),
    j AS (SELECT b.vec_id AS id, label, b.vec_id IN (FROM same) AS twice, salience - coalesce(penalty, 0) AS now FROM b LEFT JOIN p ON p.id = b.vec_id WHERE label IS NOT NULL)
    SELECT id, round(CASE WHEN twice THEN min(now) OVER (PARTITION BY label) ELSE now END + 1e-9, 4) AS penalised FROM j""")
def fl6(t):
    """Salience less a past update's, in proportion: every earlier vector of the label is past.

    Similarities under .15 count nothing, and none of a row that is over .95 like
    any past one. An update's similarities are shares of their sum; a row loses
    its largest share's update's salience times that share (the first update of
    equal ones), and what repeats an update gets the least that is then left in its label.
    """
    _ready(t)
    rows = narrow(t).withColumn("salience", r6(F.abs(F.col("vector")[0].cast("double"))))
    e = rows.select("label", "id", "salience")
    same = written(label_repeats(t, 0.9500005).withColumn("twice", F.lit(True)))  # over .95 once rounded
    marked = rows.join(same, "id", "left").withColumn("twice", F.coalesce("twice", F.lit(False)))
    sums = G.tiled(marked.drop("salience"), ["label"], ["id"], similarity_sums, "past long, total long", G.WIDE)
    sums = written(sums.groupBy("past").agg(F.sum("total").alias("total")))
    known = marked.join(sums.select(F.col("past").alias("id"), "total"), "id", "left").withColumn("total", F.coalesce("total", F.lit(0)))
    z = G.tiled(known, ["label"], ["id"], largest_shares, "id long, share double, past long, weight double", G.WIDE)
    p = z.groupBy("id").agg(F.max_by(F.col("share") * F.col("weight"), F.struct("share", -F.col("past"))).alias("penalty"))
    j = e.join(p, "id", "left").join(same, "id", "left").withColumn("now", F.col("salience") - F.coalesce("penalty", F.lit(0.0)))
    low = j.groupBy("label").agg(F.min("now").alias("low"))
    return j.join(low, "label").select("id", F.round(F.when(F.coalesce("twice", F.lit(False)), F.col("low")).otherwise(F.col("now")) + 1e-9, 4).alias("penalised"))


@query("fl7_similar_to_prior", f"SELECT vec_id AS id FROM embeddings b WHERE NOT EXISTS (SELECT 1 FROM embeddings a WHERE a.vec_id < b.vec_id AND a.label = b.label AND {COS} >= 0.3)")
def fl7(t):
    """What isn't like any prior update of its label."""
    return t.embeddings.select(F.col("vec_id").alias("id")).join(label_repeats(t, 0.3), "id", "left_anti")


#: Cosines under .2 are masked; the others are scaled to -9 .. their maximum, preferences to -3 .. -1.
SCALED = A.Scale(
    lambda c, s, m: m.where(c < 0.2, -100.0, -9.0 + (c - s.least) / m.where(s.least < 1, 1 - s.least, 1.0) * (s.top + 9.0)),
    lambda p, s, m: -3.0 + 2.0 * (p - s.least_salience) / m.where(s.top_salience > s.least_salience, s.top_salience - s.least_salience, 1.0),
)


@query("fl8_rank_and_cluster")
def fl8(t):
    """Salient sentences first (z above a cutoff by topic), then clusters of more than one, then novelty."""
    rows = _z(point_table(t), ["topic"]).where("z > -0.5").drop("z")
    found = A.ap_clusters(rows, ["topic", "bucket"], SCALED, least=2, carry=["bins"]).where("cluster_size > 1")
    return G.greedy_novel(found, ["topic"], ["bucket", "id"], 0.5, ["bucket", "id", "cluster_size"])


def sentence_sets(t):
    """Sentences that carry nuggets, with their sets."""
    return nugget_sets(t).where("size(nuggets) > 0").select("query_id", "doc_id", "epoch", "sent_id", "update_id", "nuggets")


def facts(t):
    """A row for each nugget that a sentence carries, as the covers take them."""
    return sentence_sets(t).select(F.col("query_id").alias("topic"), "epoch", "doc_id", "sent_id", "update_id", F.explode("nuggets").alias("nugget"))


@query("or1_retrospective_oracle")
def or1(t):
    """Greedy cover of each topic's nuggets by at most 25 sentences, and a row (step 0) with the sentences and nuggets there were."""
    rows = facts(t)
    none, zero = F.lit(None).cast("string").alias("update_id"), F.lit(0).cast("long").alias("step")
    there = rows.groupBy("topic").agg(F.countDistinct("update_id").alias("gain"), F.countDistinct("nugget").alias("covered")).select("topic", zero, none, "gain", "covered")
    picks = K.cover(rows, 25)
    upto = F.sum("gain").over(Window.partitionBy("topic").orderBy("step"))  # 25 rows a topic at most
    return picks.withColumn("covered", upto).unionByName(there).select(F.col("topic").alias("query_id"), "step", "update_id", "gain", "covered")


@query("or2_streaming_oracle")
def or2(t):
    return K.streamed_cover(facts(t), 25).withColumnRenamed("topic", "query_id")


@query("or3_step_oracle")
def or3(t):
    """At each document the sentence with the largest gain, the first of equals, or go on; the loss is what else was new there."""
    return K.step_choices(facts(t))[0].withColumnRenamed("topic", "query_id")


FIRST = "(SELECT *, row_number() OVER (PARTITION BY query_id, nugget_id ORDER BY epoch, doc_id, sent_id) = 1 AS novel FROM matches)"


def first_matches(t):
    w = Window.partitionBy("query_id", "nugget_id").orderBy("epoch", "doc_id", "sent_id")
    return t.matches.withColumn("novel", F.row_number().over(w) == 1)


@query("or4_select_or_skip", f"SELECT update_id, CASE WHEN bool_or(novel) THEN 'SELECT' ELSE 'SKIP' END AS action FROM {FIRST} GROUP BY update_id")
def or4(t):
    """A sentence is selected iff it carries a nugget for the first time: with the oracle's policy that needs no fold."""
    return first_matches(t).groupBy("update_id").agg(F.when(F.bool_or("novel"), "SELECT").otherwise("SKIP").alias("action"))


@query("or5_random_policy", "SELECT update_id, substr(md5('coin' || update_id), 1, 1) < '8' AS selected FROM sentences")
def or5(t):
    return t.sentences.select("update_id", (F.substring(F.md5(F.concat(F.lit("coin"), "update_id")), 1, 1) < "8").alias("selected"))


FLAGSHIP = f"""SELECT s.query_id, coalesce(m.n_selected, 0) AS n_selected, coalesce(m.n_found, 0) AS n_found, round(coalesce(m.n_found / CAST(m.n_selected AS DOUBLE), 0), 6) AS egain FROM (SELECT DISTINCT query_id FROM stream) s LEFT JOIN
    (SELECT query_id, count(DISTINCT update_id) AS n_selected, count(DISTINCT nugget_id) AS n_found FROM {FIRST} WHERE novel GROUP BY query_id) m USING (query_id)"""


@query("flagship", FLAGSHIP)
def flagship(t):
    """Stream items, sentences, nugget matches, the oracle's selection, and its gain by topic."""
    m = first_matches(t).where("novel").groupBy("query_id").agg(F.countDistinct("update_id").alias("n_selected"), F.countDistinct("nugget_id").alias("n_found"))
    s = t.stream.select("query_id").distinct().join(m, "query_id", "left")
    return s.select("query_id", F.coalesce("n_selected", F.lit(0)).alias("n_selected"), F.coalesce("n_found", F.lit(0)).alias("n_found"), r6(F.coalesce(F.col("n_found") / F.col("n_selected"), F.lit(0.0))).alias("egain"))
