"""Evaluation of selections and models."""

from __future__ import annotations

import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import math as M
from ..functions import text as T
from ..operators.ordered import hash_numbered, top_per_group
from .base import query, r6, whole
from .joining import SOFT, soft_matches
from .selecting import FIRST, first_matches

POSSIBLE = "(SELECT count(*) AS possible FROM nuggets)"


def gains(t):
    """Per topic: selected (all matching sentences), found, possible."""
    m = t.matches.groupBy("query_id").agg(F.countDistinct("update_id").alias("selected"), F.countDistinct("nugget_id").alias("found"))
    return m.crossJoin(t.nuggets.agg(F.count("*").alias("possible")))


GAINS = f"(SELECT query_id, count(DISTINCT update_id) AS selected, count(DISTINCT nugget_id) AS found, possible FROM matches, {POSSIBLE} GROUP BY query_id, possible)"


@query("ev1_gain_comprehensiveness", f"SELECT query_id, round(found / selected, 6) AS egain, round(found / possible, 6) AS comp, round(2 * (found / selected) * (found / possible) / (found / selected + found / possible), 6) AS f1 FROM {GAINS}")
def ev1(t):
    g = gains(t).select("query_id", F.coalesce(F.col("found") / F.nullif(F.col("selected"), F.lit(0)), F.lit(0.0)).alias("e"), (F.col("found") / F.col("possible")).alias("c"))
    return g.select("query_id", r6("e").alias("egain"), r6("c").alias("comp"), r6(M.f1("e", "c")).alias("f1"))


@query("ev2_losses", f"SELECT query_id, round(1 - found / (selected + possible), 6) AS loss, round(1 - 2 * found / (selected + possible), 6) AS dice FROM {GAINS}")
def ev2(t):
    share = F.col("found") / (F.col("selected") + F.col("possible"))
    return gains(t).select("query_id", r6(1 - share).alias("loss"), r6(1 - 2 * share).alias("dice"))


@query("ev3_latency_discounted_gain", f"""WITH s AS (SELECT m.*, n.important, min(m.epoch) OVER (PARTITION BY m.nugget_id) AS t0 FROM {SOFT} m JOIN nuggets n USING (nugget_id)),
    b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY query_id, nugget_id ORDER BY sim DESC, epoch, update_id) = 1)
    SELECT query_id, round(sum(sim * important * (1 - {2 / math.pi!r} * atan((epoch - t0) / 21600.0))), 4) AS gain, count(*) AS found FROM b GROUP BY query_id""")
def ev3(t):
    """The best update of each nugget (similarity .6 or more; the first of equals), weighed by similarity, importance and delay."""
    s = soft_matches(t)
    best = s.groupBy("query_id", "nugget_id").agg(F.min_by(F.struct("sim", "epoch"), F.struct(-F.col("sim"), "epoch", "update_id")).alias("x")).select("query_id", "nugget_id", "x.*")
    j = best.join(s.groupBy("nugget_id").agg(F.min("epoch").alias("t0")), "nugget_id").join(t.nuggets.select("nugget_id", "important"), "nugget_id")
    return j.groupBy("query_id").agg(F.round(F.sum(F.col("sim") * F.col("important") * M.latency_discount(F.col("epoch") - F.col("t0"))), 4).alias("gain"), F.count("*").alias("found"))


def _grams(n: int, source: str, key: str, text: str) -> str:
    w = f"regexp_extract_all(lower({text}), '<word>')"
    return f"(SELECT {key}, g, count(*) AS n FROM (SELECT {key}, unnest(list_transform(range(1, len(w) - {n - 2}), lambda i: array_to_string(w[i:i + {n - 1}], ' '))) AS g FROM (SELECT {key}, {w} AS w FROM {source})) GROUP BY ALL)"


def rouge(candidate, reference, key: str, n: int):
    """Clipped n-gram overlap of texts with the same key: recall, precision, F of every reference, 0 where nothing is shared."""

    def grams(df):
        w = T.words("text")
        g = df.select(key, w.alias("w")).where(F.size("w") >= n).select(key, F.explode(F.transform(F.sequence(F.lit(1), F.size("w") - (n - 1)), lambda i: F.array_join(F.slice("w", i, F.lit(n)), " "))).alias("g"))
        return g.groupBy(key, "g").agg(F.count("*").alias("n"))

    a, b = grams(candidate), grams(reference)
    hit = a.join(b.withColumnRenamed("n", "m"), [key, "g"]).groupBy(key).agg(F.sum(F.least("n", "m")).alias("hit"))
    total = lambda g, c: g.groupBy(key).agg(F.sum("n").alias(c))
    j = reference.select(key).join(hit, key, "left").join(total(a, "na"), key, "left").join(total(b, "nb"), key, "left").na.fill(0, ["hit", "na", "nb"])
    share = lambda x, of: r6(F.when(of > 0, x / of).otherwise(0.0))
    return j.select(key, share(F.col("hit"), F.col("nb")).alias("recall"), share(F.col("hit"), F.col("na")).alias("precision"), share(2 * F.col("hit"), F.col("na") + F.col("nb")).alias("f"))


def _rouge_sql(n: int, a: str, b: str, key: str) -> str:
    return f"""WITH a AS {_grams(n, a, key, 'text')}, b AS {_grams(n, b, key, 'text')}, h AS (SELECT {key}, sum(least(a.n, b.n)) AS hit FROM a JOIN b USING ({key}, g) GROUP BY {key})
    SELECT {key}, coalesce(round(hit / nb, 6), 0) AS recall, coalesce(round(hit / na, 6), 0) AS precision, coalesce(round(2 * hit / (coalesce(na, 0) + coalesce(nb, 0)), 6), 0) AS f
    FROM (SELECT {key} FROM {b}) LEFT JOIN h USING ({key}) LEFT JOIN (SELECT {key}, sum(n) AS na FROM a GROUP BY {key}) USING ({key}) LEFT JOIN (SELECT {key}, sum(n) AS nb FROM b GROUP BY {key}) USING ({key})"""


def _turns(t, role):
    return t.conversations.where(F.col("role") == role).groupBy("conv_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]), " ").alias("text"))


def _turns_sql(role: str) -> str:
    return f"(SELECT conv_id, string_agg(text, ' ' ORDER BY turn) AS text FROM conversations WHERE role = '{role}' GROUP BY conv_id)"


for _n in (1, 2):

    @query(f"ev4_rouge_{_n}", _rouge_sql(_n, _turns_sql("user"), _turns_sql("assistant"), "conv_id"))
    def ev4(t, n=_n):
        return rouge(_turns(t, "user"), _turns(t, "assistant"), "conv_id", n)


DRAWS = 10


@query("ev4_sampled_rouge", f"""WITH u AS (SELECT conv_id, turn, text, len(regexp_extract_all(lower(text), '<word>')) AS words FROM conversations WHERE role = 'user'), m AS (SELECT conv_id, sum(len(regexp_extract_all(lower(text), '<word>'))) AS room FROM conversations WHERE role = 'assistant' GROUP BY conv_id),
    d AS (SELECT u.*, i, sum(words) OVER (PARTITION BY u.conv_id, i ORDER BY md5(i || '-' || u.conv_id || '-' || turn) ROWS UNBOUNDED PRECEDING) AS upto, room FROM u JOIN m USING (conv_id), (SELECT unnest(range({DRAWS})) AS i)),
    a AS (SELECT conv_id, i, g, count(*) AS n FROM (SELECT conv_id, i, unnest(regexp_extract_all(lower(text), '<word>')) AS g FROM d WHERE upto <= room) GROUP BY ALL), b AS (SELECT conv_id, g, count(*) AS m FROM (SELECT conv_id, unnest(regexp_extract_all(lower(text), '<word>')) AS g FROM conversations WHERE role = 'assistant') GROUP BY ALL),
    h AS (SELECT conv_id, i, sum(least(n, m)) AS hit FROM a JOIN b USING (conv_id, g) GROUP BY ALL)
    SELECT conv_id, coalesce(round(sum(hit) / CAST(max(nullif(room, 0)) AS DOUBLE) / {DRAWS}, 6), 0) AS recall, count(hit) AS draws FROM m LEFT JOIN h USING (conv_id) GROUP BY conv_id""")
def ev4_sampled(t, draws: int = DRAWS):
    """ROUGE-1 recall of random draws of turns no longer than the reference, averaged, and how many share a word with it; a draw's order is a hash."""
    w = T.words("text")
    u = t.conversations.where("role = 'user'").select("conv_id", "turn", w.alias("w"))
    m = t.conversations.where("role = 'assistant'").select("conv_id", w.alias("w"))
    room = m.groupBy("conv_id").agg(F.sum(F.size("w")).alias("room"))
    d = u.join(room, "conv_id").withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
    order = F.md5(F.concat_ws("-", F.col("i").cast("string"), F.col("conv_id").cast("string"), F.col("turn").cast("string")))
    upto = F.sum(F.size("w")).over(Window.partitionBy("conv_id", "i").orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    a = d.withColumn("upto", upto).where("upto <= room").select("conv_id", "i", F.explode("w").alias("g")).groupBy("conv_id", "i", "g").agg(F.count("*").alias("n"))
    b = m.select("conv_id", F.explode("w").alias("g")).groupBy("conv_id", "g").agg(F.count("*").alias("m"))
    h = a.join(b, ["conv_id", "g"]).groupBy("conv_id", "i").agg(F.sum(F.least("n", "m")).alias("hit"))
    j = room.join(h, "conv_id", "left").groupBy("conv_id")
    return j.agg(F.coalesce(r6(F.sum("hit") / F.nullif(F.max("room"), F.lit(0)).cast("double") / draws), F.lit(0.0)).alias("recall"), F.count("hit").alias("draws"))


@query("ev5_checkpoints", f"""WITH s AS (SELECT query_id, min(epoch) AS t0, (max(epoch) - min(epoch)) // 3600 AS hours FROM stream GROUP BY query_id), k AS (SELECT query_id, t0, unnest(range(12, hours, 12)) AS hours FROM s),
    m AS (SELECT f.query_id, f.epoch, f.nugget_id, regexp_extract_all(lower(n.nugget_text), '<word>') AS w FROM {FIRST} f JOIN nuggets n USING (nugget_id) WHERE novel),
    a AS (SELECT query_id, hours, g, count(*) AS n FROM (SELECT k.query_id, k.hours, unnest(w) AS g FROM k JOIN m ON m.query_id = k.query_id AND m.epoch < k.t0 + k.hours * 3600) GROUP BY ALL),
    b AS (SELECT query_id, g, count(*) AS n FROM (SELECT DISTINCT query_id, nugget_id, g, i FROM (SELECT query_id, nugget_id, unnest(w) AS g, unnest(range(len(w))) AS i FROM m)) GROUP BY ALL),
    h AS (SELECT query_id, hours, sum(least(a.n, b.n)) AS hit FROM a JOIN b USING (query_id, g) GROUP BY ALL)
    SELECT query_id, hours, coalesce(round(hit / CAST(total AS DOUBLE), 6), 0) AS recall FROM k LEFT JOIN h USING (query_id, hours) LEFT JOIN (SELECT query_id, sum(n) AS total FROM b GROUP BY query_id) USING (query_id)""")
def ev5(t):
    """ROUGE-1 recall of what is selected by every twelfth hour, to the topic's own end, against all that the topic reveals; 0 before its first."""
    s = t.stream.groupBy("query_id").agg(F.min("epoch").alias("t0"), F.floor((F.max("epoch") - F.min("epoch")) / 3600).alias("last"))
    k = s.where("last > 12").select("query_id", "t0", F.explode(F.sequence(F.lit(12).cast("long"), F.col("last") - 1, F.lit(12).cast("long"))).alias("hours"))
    words = t.nuggets.select("nugget_id", F.explode(T.words("nugget_text")).alias("g"))
    m = first_matches(t).where("novel").select("query_id", "epoch", "nugget_id").join(words, "nugget_id").groupBy("query_id", "epoch", "g").agg(F.count("*").alias("c"))
    a = k.join(m, "query_id").where("epoch < t0 + hours * 3600").groupBy("query_id", "hours", "g").agg(F.sum("c").alias("n"))
    b = m.groupBy("query_id", "g").agg(F.sum("c").alias("m"))
    total = b.groupBy("query_id").agg(F.sum("m").alias("total"))
    hit = a.join(b, ["query_id", "g"]).groupBy("query_id", "hours").agg(F.sum(F.least("n", "m")).alias("hit"))
    j = k.select("query_id", "hours").join(hit, ["query_id", "hours"], "left").join(total, "query_id", "left")
    return j.select("query_id", "hours", F.coalesce(r6(F.col("hit") / F.col("total").cast("double")), F.lit(0.0)).alias("recall"))


@query("ev6_signed_ranks", f"""WITH d AS (SELECT query_id, found / selected - 0.5 AS d FROM {GAINS} WHERE found / selected <> 0.5), r AS (SELECT d, rank() OVER (ORDER BY round(abs(d), 9)) + (count(*) OVER (PARTITION BY round(abs(d), 9)) - 1) / 2.0 AS r FROM d)
    SELECT count(*) AS n, round(coalesce(sum(r) FILTER (WHERE d > 0), 0), 3) AS w_plus, round(coalesce(sum(r) FILTER (WHERE d < 0), 0), 3) AS w_minus FROM r""")
def ev6(t):
    """Wilcoxon's rank sums of topic means against a baseline; there is one row a topic."""
    d = gains(t).select((F.col("found") / F.col("selected") - 0.5).alias("d")).where("d <> 0").withColumn("a", F.round(F.abs("d"), 9))
    rank = F.rank().over(Window.orderBy("a")) + (F.count("*").over(Window.partitionBy("a")) - 1) / 2
    r = d.withColumn("r", rank)
    side = lambda c: F.round(F.coalesce(F.sum(F.when(c, F.col("r"))), F.lit(0.0)), 3)
    return r.agg(F.count("*").alias("n"), side(F.col("d") > 0).alias("w_plus"), side(F.col("d") < 0).alias("w_minus"))


@query("ev6_permutation_test", f"""WITH d AS (SELECT query_id, found / selected - 0.5 AS d FROM {GAINS}), p AS (SELECT i, abs(sum(CASE WHEN substr(md5(i || query_id), 1, 1) < '8' THEN d ELSE -d END)) AS s FROM d, (SELECT unnest(range(0, 500)) AS i) GROUP BY i)
    SELECT count(*) FILTER (WHERE s >= (SELECT abs(sum(d)) FROM d) - 1e-12) AS extreme, count(*) AS draws FROM p""")
def ev6_permutation(t):
    d = gains(t).select("query_id", (F.col("found") / F.col("selected") - 0.5).alias("d"))
    own = d.agg(F.abs(F.sum("d")).alias("own"))
    flip = F.when(F.substring(F.md5(F.concat(F.col("i").cast("string"), "query_id")), 1, 1) < "8", F.col("d")).otherwise(-F.col("d"))
    p = d.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(499)))).groupBy("i").agg(F.abs(F.sum(flip)).alias("s")).crossJoin(own)
    return p.agg(F.count_if(F.col("s") >= F.col("own") - 1e-12).alias("extreme"), F.count("*").alias("draws"))


@query("ev7_precision_at_k", """WITH r AS (SELECT d.source, l.quality, row_number() OVER (PARTITION BY d.source ORDER BY d.n_chars DESC, d.doc_id) AS rn FROM documents d JOIN labels l USING (doc_id))
    SELECT source, round(sum(quality) FILTER (WHERE rn <= 100) / CAST(least(100, sum(quality)) AS DOUBLE), 6) AS p FROM r GROUP BY source HAVING sum(quality) > 0""")
def ev7(t):
    """Of each source's 100 longest judged documents, how many are good, relative to the best possible ranking."""
    r = t.documents.select("doc_id", "source", "n_chars").join(t.labels.select("doc_id", "quality"), "doc_id")
    top = top_per_group(r, ["source"], [F.desc("n_chars"), "doc_id"], 100).groupBy("source").agg(F.sum("quality").alias("hits"))
    best = r.groupBy("source").agg(F.least(F.lit(100), F.sum("quality")).alias("best")).where("best > 0")
    return top.join(best, "source").select("source", r6(F.col("hits") / F.col("best").cast("double")).alias("p"))


@query("ev8_sequence_metrics", f"""WITH a AS (SELECT s.query_id, bool_or(coalesce(m.novel, false)) AS truth, substr(md5('coin' || s.update_id), 1, 1) < '8' AS guess FROM sentences s LEFT JOIN {FIRST} m ON m.update_id = s.update_id GROUP BY s.query_id, s.update_id)
    SELECT query_id, round(avg(CAST(truth = guess AS INT)), 6) AS accuracy, round(count(*) FILTER (WHERE truth AND guess) / greatest(count(*) FILTER (WHERE truth), 1), 6) AS recall FROM a GROUP BY query_id""")
def ev8(t):
    truth = first_matches(t).where("novel").select("update_id").distinct().withColumn("truth", F.lit(True))
    a = t.sentences.select("query_id", "update_id").join(truth, "update_id", "left").withColumns({"truth": F.coalesce("truth", F.lit(False)), "guess": F.substring(F.md5(F.concat(F.lit("coin"), "update_id")), 1, 1) < "8"})
    return a.groupBy("query_id").agg(r6(F.avg((F.col("truth") == F.col("guess")).cast("int"))).alias("accuracy"), r6(F.count_if(F.col("truth") & F.col("guess")) / F.greatest(F.count_if("truth"), F.lit(1))).alias("recall"))


@query("ev9_mean_squared_error", "SELECT l_linenumber AS config, round(avg(pow(l_extendedprice / 10000 - l_quantity / 5, 2)), 5) AS mse FROM lineitem GROUP BY l_linenumber QUALIFY row_number() OVER (ORDER BY mse, config) <= 3")
def ev9(t):
    """The configurations with the least error."""
    m = t.lineitem.groupBy(F.col("l_linenumber").alias("config")).agg(F.round(F.avg(F.pow(F.col("l_extendedprice") / 10000 - F.col("l_quantity") / 5, F.lit(2))), 5).alias("mse"))
    return m.orderBy("mse", "config").limit(3)


FOLDS = "(SELECT doc_id, toxic, quality, (row_number() OVER (PARTITION BY toxic ORDER BY md5('f' || doc_id)) - 1) % 10 AS fold FROM labels)"


def folds(t):
    """Labels with one of ten folds, dealt in turn within each class by hash order."""
    return hash_numbered(t.labels, ["toxic"], F.md5(F.concat(F.lit("f"), F.col("doc_id").cast("string")))).withColumn("fold", whole((F.col("nth") - 1) % 10)).drop("nth")


@query("ev10_stratified_folds", f"SELECT doc_id, fold FROM {FOLDS}")
def ev10(t):
    return folds(t).select("doc_id", "fold")


@query("ev10_fold_accuracy", f"""WITH c AS (SELECT fold, quality, toxic, count(*) AS n FROM {FOLDS} GROUP BY ALL), k AS (SELECT DISTINCT fold, quality FROM c),
    p AS (SELECT k.fold, k.quality, CASE WHEN sum(CASE WHEN o.toxic = 1 THEN o.n ELSE -o.n END) > 0 THEN 1 ELSE 0 END AS guess FROM k JOIN c o ON o.quality = k.quality AND o.fold <> k.fold GROUP BY ALL)
    SELECT c.fold, round(sum(CASE WHEN coalesce(p.guess, 0) = c.toxic THEN n ELSE 0 END) / CAST(sum(n) AS DOUBLE), 6) AS accuracy FROM c LEFT JOIN p USING (fold, quality) GROUP BY c.fold""")
def ev10_accuracy(t):
    """Accuracy of each fold under what the other nine say of its quality mark: totals less the fold's own counts."""
    c = folds(t).groupBy("fold", "quality", "toxic").agg(F.count("*").alias("n"))
    vote = c.withColumn("v", F.when(F.col("toxic") == 1, F.col("n")).otherwise(-F.col("n")))
    others = F.sum("v").over(Window.partitionBy("quality")) - F.sum("v").over(Window.partitionBy("quality", "fold"))  # over counts
    guess = vote.withColumn("guess", F.when(others > 0, 1).otherwise(0))
    return guess.groupBy("fold").agg(r6(F.sum(F.when(F.col("guess") == F.col("toxic"), F.col("n")).otherwise(0)) / F.sum("n").cast("double")).alias("accuracy"))
