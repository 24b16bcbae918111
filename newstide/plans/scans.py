"""Sources, sinks, filters and projections."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators.crawl import crawl
from ..operators.ordered import numbered
from ..sources import readers
from ..sources.readers import select_topics
from ..sources.resources import build_missing
from .base import Tables, query, whole

DAY_TERMS = ["the", "on"]  # query terms that occur in the fixture


def topics(t: Tables):
    """A topic for each source: its number, type and window."""
    s = t.stream
    per = s.groupBy("query_id").agg(F.min("epoch").alias("start"), F.max("epoch").alias("end"), F.min("type").alias("type"))
    return per.select("query_id", F.regexp_replace("query_id", "[^0-9]", "").cast("long").alias("query_num"), "type", "start", "end")


TOPICS = "(SELECT query_id, CAST(regexp_replace(query_id, '[^0-9]', '', 'g') AS BIGINT) AS query_num, min(type) AS type, min(epoch) AS start, max(epoch) AS \"end\" FROM stream GROUP BY query_id)"


@query("src1_topic_selection", f"SELECT * FROM {TOPICS} WHERE query_id IN ('src.3', 'src3', 'src11')")
def src1(t):
    return select_topics(topics(t), ids=["src3", "src11", 3], types=["click"], prefix="src")


@query("src2_topics_concatenated", f"SELECT 'a' AS year, * FROM {TOPICS} WHERE query_num < 10 UNION ALL SELECT 'b', * FROM {TOPICS} WHERE query_num >= 10")
def src2(t):
    every = topics(t)
    return every.where("query_num < 10").select(F.lit("a").alias("year"), "*").unionByName(every.where("query_num >= 10").select(F.lit("b").alias("year"), "*"))


@query("src3_link_scrape", """SELECT page_id, link FROM (SELECT page_id, unnest(regexp_extract_all(html, '<a href="(.*?)">', 1)) AS link FROM pages)
    WHERE regexp_matches(link, '^/[a-z]{3}') AND link NOT LIKE '%index%'""")
def src3(t):
    """Links of the wanted kind (the fixture has no news: words of three letters or more), without the index."""
    links = t.pages.select("page_id", F.explode(F.regexp_extract_all("html", F.lit('<a href="(.*?)">'), F.lit(1))).alias("link"))
    return links.where(F.col("link").rlike("^/[a-z]{3}") & ~F.col("link").contains("index"))


CHUNK = "lower(regexp_extract(url, 'https?://([^/]+)', 1))"


@query("src5_path_metadata", f"""SELECT page_id, {CHUNK} AS host, split_part({CHUNK}, '.', 1) AS domain, CAST(nullif(regexp_extract(url, '/([0-9]+)', 1), '') AS BIGINT) AS number, regexp_extract(url, '/([a-z][a-z])/', 1) AS folder FROM pages""")
def src5(t):
    host = F.lower(F.regexp_extract("url", "https?://([^/]+)", 1))
    number = F.regexp_extract("url", "/([0-9]+)", 1)
    return t.pages.select("page_id", host.alias("host"), F.split_part(host, F.lit("."), F.lit(1)).alias("domain"), F.when(number != "", number).cast("long").alias("number"), F.regexp_extract("url", "/([a-z][a-z])/", 1).alias("folder"))


@query("src6_hourly_iteration", "SELECT query_id, CAST(epoch(hour) AS BIGINT) AS hour_epoch, stream_id, row_number() OVER (PARTITION BY query_id ORDER BY hour, stream_id) AS nth FROM stream")
def src6(t):
    """Rows are numbered hour by hour, so a topic's rows never meet in one task."""
    rows = t.stream.select("query_id", F.unix_seconds("hour").alias("hour_epoch"), "stream_id")
    return numbered(rows, ["query_id"], F.col("hour_epoch"), ["stream_id"])


@query("src7_checksum_validation", "SELECT doc_id, md5(text) AS digest FROM documents WHERE doc_id % 7 <> 0")
def src7(t):
    """Files whose content has another digest than their name go. Every seventh name is spoilt here, as the tables hold no broken file."""
    named = t.documents.withColumn("name", F.concat(F.md5("text"), F.when(F.col("doc_id") % 7 == 0, "0").otherwise("")))
    return readers.intact(named, "text", "name").select("doc_id", F.col("name").alias("digest"))


@query("src8_record_reader", "SELECT nugget_id, important, length, nugget_text AS text FROM nuggets")
def src8(t):
    """Records written as gzipped lines to the shared folder, and read back without quoting under a fixed schema."""
    path = readers.scratch(t.spark, "records")
    readers.write_records(t.nuggets.select("nugget_id", "important", "length", "nugget_text"), path)
    return readers.read_records(t.spark, path, "nugget_id string, important long, length long, text string")


@query("src10_written_stream", "SELECT query_id, update_id, rank, sent_text FROM top20")
def src10(t):
    """Sentences written by topic, in files of bounded size, and read back; the topic comes from the folder."""
    path = readers.scratch(t.spark, "stream")
    readers.write_stream(t.top20.select("query_id", "update_id", "rank", "sent_text"), path)
    return t.spark.read.schema("update_id string, rank long, sent_text string, query_id string").parquet(path).select("query_id", "update_id", "rank", "sent_text")


@query("src9_system_updates", "SELECT query_id, update_id, stream_id, epoch AS document_epoch, regexp_extract(stream_id, '-(.*)$', 1) AS document_hash FROM sentences")
def src9(t):
    s = t.sentences.select("query_id", F.concat_ws(" ", "query_id", "stream_id", F.col("sent_id").cast("string")).alias("line"))
    p = F.split("line", " ")
    return s.select("query_id", F.concat_ws("-", p[1], p[2]).alias("update_id"), p[1].alias("stream_id"), F.split_part(p[1], F.lit("-"), F.lit(1)).cast("long").alias("document_epoch"), F.split_part(p[1], F.lit("-"), F.lit(2)).alias("document_hash"))


@query("src11_rollover", "SELECT query_id, count(*) AS docs, max(n) <= 20 AS within, count(*) >= 0 AS read FROM (SELECT query_id, 1 AS n FROM stream) GROUP BY query_id")
def src11(t):
    """A new file every 20 documents of a topic: what the written files hold, and that none holds more."""
    path = readers.scratch(t.spark, "rollover")
    readers.write_stream(t.stream.select("query_id", "stream_id", "text"), path, 20)
    files = t.spark.read.schema("stream_id string, query_id string").parquet(path).groupBy("query_id", F.input_file_name().alias("file")).agg(F.count("*").alias("n"))
    return files.groupBy("query_id").agg(F.sum("n").alias("docs"), (F.max("n") <= 20).alias("within"), F.lit(True).alias("read"))


SUBMISSION = "SELECT CAST(regexp_replace(query_id, '[^0-9]', '', 'g') AS BIGINT) AS qid, 'newstide' AS team, 'run1' AS run, stream_id, sent_id, epoch + 3600 AS ts, CAST(1 + important AS DOUBLE) AS conf FROM matches"


def submission(t: Tables):
    return t.matches.select(F.regexp_replace("query_id", "[^0-9]", "").cast("long").alias("qid"), F.lit("newstide").alias("team"), F.lit("run1").alias("run"), "stream_id", "sent_id", (F.col("epoch") + 3600).alias("ts"), (F.lit(1) + F.col("important")).cast("double").alias("conf"))


@query("src12_submission", SUBMISSION)
def src12(t):
    return submission(t)


@query("src13_lockstep_join", """WITH bow AS (SELECT hour, stream_id, sent_id, count(*) AS n_tokens FROM tokens GROUP BY ALL), strings AS (SELECT hour, stream_id, sent_id, length(sent_text) AS n_chars FROM sentences)
    SELECT CAST(epoch(b.hour) AS BIGINT) AS hour_epoch, b.stream_id, b.sent_id, n_tokens, n_chars FROM bow b JOIN strings s ON b.hour = s.hour AND b.stream_id = s.stream_id AND b.sent_id = s.sent_id""")
def src13(t):
    """Two files of the same sentences, counts and strings, side by side: equal labels are the join."""
    keys = ["hour", "stream_id", "sent_id"]
    bow, strings = t.tokens.groupBy(*keys).agg(F.count("*").alias("n_tokens")), t.sentences.select(*keys, whole(F.length("sent_text")).alias("n_chars"))
    return bow.join(strings, keys).select(F.unix_seconds("hour").alias("hour_epoch"), "stream_id", "sent_id", "n_tokens", "n_chars")


@query("src14_category_crawl", """WITH RECURSIVE crawl AS (SELECT CAST(0 AS BIGINT) AS node, 0 AS depth UNION
    SELECT c.child, crawl.depth + 1 FROM crawl JOIN (SELECT p_partkey AS child, (p_partkey - 1) // 3 AS parent FROM part WHERE p_partkey > 0 AND p_size <> 13) c ON c.parent = crawl.node WHERE crawl.depth < 4)
    SELECT node, depth FROM crawl""")
def src14(t):
    """Pages under a category tree to a depth, without the blacklisted."""
    edges = t.part.where("p_partkey > 0 and p_size <> 13").select(F.floor((F.col("p_partkey") - 1) / 3).alias("parent"), F.col("p_partkey").alias("child"))
    return crawl(edges, t.spark.range(1).select(F.col("id").alias("node")), 4)


HREF = 'href="([^"]*)"'


@query("src14_link_crawl", f"""WITH RECURSIVE l AS (SELECT DISTINCT 'page ' || page_id AS page, unnest(regexp_extract_all(html, '{HREF}', 1)) AS link FROM pages), k AS (SELECT * FROM l WHERE link NOT IN (SELECT link FROM l GROUP BY link HAVING count(*) * 20 > (SELECT count(*) FROM pages))),
    e AS (SELECT page AS parent, link AS child FROM k UNION ALL SELECT link, page FROM k), crawl AS (SELECT DISTINCT 'page ' || min(page_id) AS node, 0 AS depth FROM pages UNION SELECT e.child, crawl.depth + 1 FROM crawl JOIN e ON e.parent = crawl.node WHERE crawl.depth < 8)
    SELECT node, min(depth) AS depth FROM crawl GROUP BY node""")
def src14_links(t):
    """Pages and links that the first page reaches in eight steps, from a page to its links and from a link to the pages that have it; what over a twentieth of the pages link to is blacklisted."""
    links = t.pages.select(F.concat(F.lit("page "), F.col("page_id").cast("string")).alias("page"), F.explode(F.regexp_extract_all("html", F.lit(HREF), F.lit(1))).alias("link")).distinct()
    every = t.pages.agg(F.count("*").alias("pages"))  # one row
    common = links.groupBy("link").count().crossJoin(every).where("count * 20 > pages").select("link")
    kept = links.join(common, "link", "left_anti")
    edges = kept.select(F.col("page").alias("parent"), F.col("link").alias("child")).unionByName(kept.select(F.col("link").alias("parent"), F.col("page").alias("child")))
    return crawl(edges, t.pages.agg(F.concat(F.lit("page "), F.min("page_id").cast("string")).alias("node")), 8)


@query("src15_paragraphs", r"""SELECT page_id, i - 1 AS nth, regexp_replace(ps[i], '\[[0-9]+\]', '', 'g') AS paragraph
    FROM (SELECT *, unnest(range(1, len(ps) + 1)) AS i FROM (SELECT page_id, regexp_extract_all(html, '<p>([^<]*)', 1) AS ps FROM pages))""")
def src15(t):
    p = t.pages.select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit("<p>([^<]*)"), F.lit(1))).alias("nth", "p"))
    return p.select("page_id", whole("nth").alias("nth"), F.regexp_replace("p", r"\[[0-9]+\]", "").alias("paragraph"))


@query("src16_story_reader", """SELECT conv_id, turn, regexp_replace(text, '\n', ' ', 'g') AS story FROM conversations WHERE role = 'user'""")
def src16(t):
    """Stories of one kind from tagged records, line breaks as spaces."""
    tagged = t.conversations.select("conv_id", "turn", F.concat(F.lit('<DOC type="'), F.col("role"), F.lit('"><P>'), F.col("text"), F.lit("</P></DOC>")).alias("sgml"))
    body = F.regexp_extract("sgml", r'(?s)<DOC type="user"><P>(.*)</P></DOC>$', 1)
    return tagged.where(F.col("sgml").startswith('<DOC type="user">')).select("conv_id", "turn", F.regexp_replace(body, "\n", " ").alias("story"))


@query("src17_coverage", """SELECT query_id, count(DISTINCT hour) AS present, CAST((max(epoch(hour)) - min(epoch(hour))) / 3600 AS BIGINT) + 1 AS wanted,
    round(count(DISTINCT hour) / (CAST((max(epoch(hour)) - min(epoch(hour))) / 3600 AS BIGINT) + 1), 6) AS coverage FROM stream GROUP BY query_id""")
def src17(t):
    wanted = F.size(F.sequence(F.min("hour"), F.max("hour"), F.expr("interval 1 hour"))).cast("long")
    g = t.stream.groupBy("query_id").agg(F.countDistinct("hour").alias("present"), wanted.alias("wanted"))
    return g.withColumn("coverage", F.round(F.col("present") / F.col("wanted"), 6))


@query("src18_missing_units", """WITH span AS (SELECT query_id, min(hour) AS a, max(hour) AS b FROM stream GROUP BY query_id),
    units AS (SELECT query_id, unnest(generate_series(a, b, INTERVAL 1 HOUR)) AS hour FROM span)
    SELECT query_id, CAST(epoch(hour) AS BIGINT) AS hour_epoch FROM units u WHERE NOT EXISTS (SELECT 1 FROM stream s WHERE s.query_id = u.query_id AND s.hour = u.hour)""")
def src18(t):
    span = t.stream.groupBy("query_id").agg(F.min("hour").alias("a"), F.max("hour").alias("b")).select("query_id", F.explode(F.expr("sequence(a, b, interval 1 hour)")).alias("hour"))
    return span.join(t.stream.select("query_id", "hour"), ["query_id", "hour"], "left_anti").select("query_id", F.unix_seconds("hour").alias("hour_epoch"))


@query("src18_rebuilt_units", """WITH s AS (SELECT query_id, CAST(epoch(hour) AS BIGINT) AS hour_epoch, count(*) AS sentences FROM sentences GROUP BY ALL), m AS (SELECT query_id, (min(hour_epoch) + max(hour_epoch)) / 2 AS half FROM s GROUP BY query_id)
    SELECT query_id, hour_epoch, sentences FROM s JOIN m USING (query_id) WHERE hour_epoch >= half""")
def src18_rebuilt(t):
    """The hours that a second run builds, after a first that knew each topic's earlier half, with what it wrote of them."""
    path = readers.scratch(t.spark, "units")
    rows = t.sentences.select("query_id", F.unix_seconds("hour").alias("hour_epoch"), "update_id", "sent_text")
    units = t.stream.select("query_id", F.unix_seconds("hour").alias("hour_epoch")).distinct()
    half = units.groupBy("query_id").agg(((F.min("hour_epoch") + F.max("hour_epoch")) / 2).alias("half"))
    build = lambda some: rows.join(some, ["query_id", "hour_epoch"])
    build_missing(units.join(half, "query_id").where("hour_epoch < half").drop("half"), path, build)
    built = build_missing(units, path, build)
    there = t.spark.read.schema("update_id string, query_id string, hour_epoch long").parquet(path)
    return there.join(built, ["query_id", "hour_epoch"]).groupBy("query_id", "hour_epoch").agg(F.count("*").alias("sentences"))


@query("src19_asof_revision", "SELECT o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS revision FROM orders WHERE o_orderdate <= TIMESTAMP '1998-01-01' GROUP BY o_custkey")
def src19(t):
    return t.orders.where("o_orderdate <= timestamp_ntz'1998-01-01'").groupBy("o_custkey").agg(F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("revision"))


@query("flt1_all_terms", "SELECT doc_id FROM documents WHERE regexp_matches(text, '(?i)the') AND regexp_matches(text, '(?i)on')")
def flt1(t):
    return t.documents.where(T.contains_all("text", DAY_TERMS)).select("doc_id")


@query("flt2_terms_in_top20", r"SELECT doc_id, regexp_matches(string_agg(sent_text, chr(10) ORDER BY sent_id), '(?i)the') AND regexp_matches(string_agg(sent_text, chr(10) ORDER BY sent_id), '(?i)on') AS match FROM top20 GROUP BY doc_id")
def flt2(t):
    lines = t.top20.groupBy("doc_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("sent_id", "sent_text"))), lambda x: x["sent_text"]), "\n").alias("top"))
    return lines.select("doc_id", T.contains_all("top", DAY_TERMS).alias("match"))


@query("flt3_any_term", "SELECT doc_id FROM documents WHERE regexp_matches(text, '(?i)license|idiot')")
def flt3(t):
    return t.documents.where(T.contains_any("text", ["license", "idiot"])).select("doc_id")


@query("flt4_relevance_counts", "SELECT CAST(epoch(hour) AS BIGINT) AS hour_epoch, count(*) AS total, count(*) FILTER (WHERE regexp_matches(text, '(?i)ation|the')) AS relevant FROM stream GROUP BY hour")
def flt4(t):
    return t.stream.groupBy("hour").agg(F.count("*").alias("total"), F.count_if(T.contains_any("text", ["ation", "the"])).alias("relevant")).select(F.unix_seconds("hour").alias("hour_epoch"), "total", "relevant")


@query("flt5_simple_quality", r"""SELECT update_id FROM (SELECT *, count(*) OVER (PARTITION BY doc_id) AS doclen FROM sentences)
    WHERE len(regexp_extract_all(sent_text, '\p{L}+')) > 9 AND doclen < 200
    AND len(regexp_extract_all(sent_text, 'Digg|del\.icio\.us|Facebook|Kwoff|Myspace')) < 2 AND len(regexp_extract_all(sent_text, '(?i)Flash|JavaScript|CSS')) < 2""")
def flt5(t):
    s = t.sentences.withColumn("doclen", F.count("*").over(Window.partitionBy("doc_id")))
    return s.where(T.simple_quality("sent_text", "doclen")).select("update_id")


@query("flt6_length_caps", r"SELECT update_id FROM sentences WHERE len(string_split(sent_text, ' ')) < 200 AND len(list_filter(regexp_extract_all(lower(sent_text), '<word>'), lambda x: length(x) < 50)) > 0")
def flt6(t):
    short = F.filter(T.words("sent_text"), lambda x: F.length(x) < 50)
    return t.sentences.where((F.size(F.split("sent_text", " ")) < 200) & (F.size(short) > 0)).select("update_id")


@query("flt7_single_row_documents", "SELECT update_id, rank FROM (SELECT *, count(*) OVER (PARTITION BY doc_id) AS n FROM top20) WHERE n > 1")
def flt7(t):
    return t.top20.withColumn("n", F.count("*").over(Window.partitionBy("doc_id"))).where("n > 1").select("update_id", "rank")


@query("flt8_zero_vectors", "SELECT vec_id FROM embeddings WHERE len(list_filter(embedding, lambda x: x <> 0)) > 0")
def flt8(t):
    return t.embeddings.where(F.exists("embedding", lambda x: x != 0)).select("vec_id")


@query("flt9_lemma_threshold", "SELECT update_id, len(list_distinct(regexp_extract_all(lower(sent_text), '<word>'))) AS lemmas FROM sentences WHERE len(list_distinct(regexp_extract_all(lower(sent_text), '<word>'))) > 5")
def flt9(t):
    return t.sentences.withColumn("lemmas", whole(F.size(F.array_distinct(T.words("sent_text"))))).where("lemmas > 5").select("update_id", "lemmas")


STOPS = ", ".join(f"'{w}'" for w in T.STOPWORDS)


@query("flt10_content_words", f"SELECT update_id FROM sentences WHERE len(list_filter(regexp_extract_all(lower(sent_text), '<word>'), lambda x: NOT list_contains([{STOPS}], x) AND NOT regexp_matches(x, '^[0-9]+$'))) > 2")
def flt10(t):
    content = F.filter(T.without_stopwords(T.words("sent_text"), longest=10**6), lambda x: ~x.rlike("^[0-9]+$"))
    return t.sentences.where(F.size(content) > 2).select("update_id")


@query("flt11_valid_hours", """SELECT e.event_id FROM events e JOIN (SELECT DISTINCT hour + to_hours(k) AS hour FROM (SELECT DISTINCT hour FROM stream WHERE query_id = 'src1'), (SELECT unnest(range(-5, 1)) AS k)) h
    ON date_trunc('hour', e.ts) = h.hour WHERE regexp_matches(e.event_type, '(?i)view|click')""")
def flt11(t):
    """Events of the topic's hours and the five before each, of the wanted kind."""
    hours = t.stream.where("query_id = 'src1'").select(F.explode(F.expr("sequence(hour - interval 5 hours, hour, interval 1 hour)")).alias("hour")).distinct()
    e = t.timed_events.withColumn("hour", F.date_trunc("hour", "ts")).where(F.col("event_type").rlike("(?i)view|click"))
    return e.join(hours, "hour", "left_semi").select("event_id")


@query("flt12_matching_clusters", """SELECT s.stream_id FROM stream s JOIN (SELECT text, bool_or(regexp_matches(text, '(?i)the')) AS match FROM stream GROUP BY text) c ON s.text = c.text WHERE c.match""")
def flt12(t):
    """Documents whose cluster (equal texts) matches: clusters are counted, not gathered."""
    rows = t.stream.select("stream_id", F.md5("text").alias("cluster"), T.contains_any("text", ["the"]).alias("match"))
    return rows.join(rows.where("match").select("cluster").distinct(), "cluster", "left_semi").select("stream_id")


@query("flt13_judged_rows", "SELECT s.update_id FROM sentences s JOIN labels l ON l.doc_id = s.doc_id WHERE l.quality = 1")
def flt13(t):
    return t.sentences.join(t.labels.where("quality = 1"), "doc_id", "left_semi").select("update_id")


@query("flt14_columns_by_pattern", "SELECT o_orderkey, o_orderstatus, o_orderdate, o_orderpriority FROM orders")
def flt14(t):
    return t.orders.select(t.orders.colRegex("`o_order.*`"))


@query("flt15_membership", "SELECT update_id, query_id FROM sentences WHERE update_id IN (SELECT update_id FROM matches)")
def flt15(t):
    return t.sentences.join(t.matches.select("update_id"), "update_id", "left_semi").select("update_id", "query_id")


def validated(lines, topics_df, most: int = 1000):
    """Submission lines (column line) with the first rule each breaks (null: none); topic rules are counted over the topic.

    The run id must be that of the first line in order, which is one row.
    """
    p = F.split("line", " ")
    get = lambda k: F.get(p, F.lit(k))
    rows = lines.select("line", F.size(p).alias("fields"), F.expr("try_cast(get(split(line, ' '), 0) AS BIGINT)").alias("qid"), get(2).alias("run"), get(3).alias("stream_id"), F.expr("try_cast(get(split(line, ' '), 4) AS BIGINT)").alias("sent_id"), F.expr("try_cast(get(split(line, ' '), 5) AS BIGINT)").alias("ts"), F.expr("try_cast(get(split(line, ' '), 6) AS DOUBLE)").alias("conf"))
    known = topics_df.select(F.col("query_num").alias("qid"), "start", "end")
    counts = rows.groupBy("qid").agg(F.count("*").alias("n"))
    only = rows.agg(F.min_by("run", "line").alias("only"))
    rule = (
        F.when(F.col("fields") != 7, "not seven fields")
        .when(F.col("start").isNull(), "unknown topic")
        .when(~F.col("run").rlike("^[A-Za-z0-9]{1,15}$"), "bad run id")
        .when(F.col("run") != F.col("only"), "another run id")
        .when(~F.col("stream_id").rlike("^[0-9]+-[0-9a-f]{32}$"), "bad document id")
        .when(F.col("sent_id").isNull() | (F.col("sent_id") < 0), "bad sentence id")
        .when((F.col("ts") < F.col("start")) | (F.col("ts") > F.col("end")), "outside the topic")
        .when(~(F.col("conf") > 0), "bad confidence")
        .when(F.col("n") > most, "too many rows")
    )
    return rows.join(known, "qid", "left").join(counts, "qid", "left").crossJoin(only).select("line", rule.alias("error"))


#: Submission lines, some spoilt so that every rule has its case.
LINES = f"""(SELECT CASE WHEN sent_id % 19 = 4 THEN concat_ws(' ', qid, team, run, stream_id, sent_id, ts) WHEN sent_id % 17 = 6 THEN concat_ws(' ', qid, team, 'run_2!', stream_id, sent_id, ts, 'x')
    ELSE concat_ws(' ', qid, team, CASE WHEN sent_id % 11 = 3 THEN 'run2' ELSE run END, stream_id, sent_id, ts, CASE WHEN sent_id % 13 = 5 THEN '0' ELSE '1' END) END AS line FROM ({SUBMISSION}))"""


def spoilt_lines(t):
    s = submission(t)
    text = lambda c: F.col(c).cast("string")
    head = ["qid", "team"]
    short = F.concat_ws(" ", *map(text, [*head, "run", "stream_id", "sent_id", "ts"]))
    bad = F.concat_ws(" ", *map(text, head), F.lit("run_2!"), *map(text, ["stream_id", "sent_id", "ts"]), F.lit("x"))
    run, conf = F.when(F.col("sent_id") % 11 == 3, "run2").otherwise(F.col("run")), F.when(F.col("sent_id") % 13 == 5, "0").otherwise("1")
    good = F.concat_ws(" ", *map(text, head), run, *map(text, ["stream_id", "sent_id", "ts"]), conf)
    return s.select(F.when(F.col("sent_id") % 19 == 4, short).when(F.col("sent_id") % 17 == 6, bad).otherwise(good).alias("line"))


VALIDATION = f"""WITH r AS (SELECT line, string_split(line, ' ') AS p FROM {LINES}),
    v AS (SELECT line, len(p) AS fields, TRY_CAST(p[1] AS BIGINT) AS qid, p[3] AS run, p[4] AS sid, TRY_CAST(p[5] AS BIGINT) AS sent_id, TRY_CAST(p[6] AS BIGINT) AS ts, TRY_CAST(p[7] AS DOUBLE) AS conf FROM r),
    j AS (SELECT v.*, t.start, t."end", count(*) OVER (PARTITION BY v.qid) AS n, (SELECT arg_min(run, line) FROM v) AS only_run FROM v LEFT JOIN {TOPICS} t ON t.query_num = v.qid AND t.query_num < 18)
    SELECT line, CASE WHEN fields <> 7 THEN 'not seven fields' WHEN start IS NULL THEN 'unknown topic' WHEN NOT regexp_matches(run, '^[A-Za-z0-9]{{1,15}}$') THEN 'bad run id' WHEN run <> only_run THEN 'another run id'
    WHEN NOT regexp_matches(sid, '^[0-9]+-[0-9a-f]{{32}}$') THEN 'bad document id' WHEN sent_id IS NULL OR sent_id < 0 THEN 'bad sentence id' WHEN ts < start OR ts > "end" THEN 'outside the topic' WHEN NOT conf > 0 THEN 'bad confidence' WHEN n > 1000 THEN 'too many rows' END AS error FROM j"""


@query("flt16_submission_validation", VALIDATION)
def flt16(t):
    return validated(spoilt_lines(t), topics(t).where("query_num < 18"))


@query("flt16_missing_topics", f"SELECT query_num FROM {TOPICS} WHERE query_num NOT IN (SELECT CAST(string_split(line, ' ')[1] AS BIGINT) FROM ({VALIDATION}) WHERE error IS NULL)")
def flt16_missing(t):
    """Topics without a valid line."""
    good = validated(spoilt_lines(t), topics(t).where("query_num < 18")).where("error is null").select(F.split("line", " ")[0].cast("long").alias("query_num"))
    return topics(t).join(good, "query_num", "left_anti").select("query_num")


def article_ranges(hits, gap: int = 5):
    """Gaps and islands: (doc_id, sent_id) hits within ``gap`` of each other are a range; single hits are none."""
    w = Window.partitionBy("doc_id").orderBy("sent_id")
    far = F.when(F.col("sent_id") - F.lag("sent_id").over(w) > gap, 1).otherwise(0)
    named = hits.withColumn("far", far).withColumn("island", F.sum("far").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return named.groupBy("doc_id", "island").agg(F.min("sent_id").alias("first"), F.max("sent_id").alias("last"), F.count("*").alias("n")).where("n >= 2")


RANGES = """(SELECT doc_id, island, min(sent_id) AS first, max(sent_id) AS last, count(*) AS n FROM (SELECT *, sum(far) OVER (PARTITION BY doc_id ORDER BY sent_id ROWS UNBOUNDED PRECEDING) AS island FROM
    (SELECT *, CASE WHEN sent_id - lag(sent_id) OVER (PARTITION BY doc_id ORDER BY sent_id) > 5 THEN 1 ELSE 0 END AS far FROM hits)) GROUP BY ALL HAVING count(*) >= 2)"""


@query("prj1_article_ranges", f"""WITH sized AS (SELECT *, len(regexp_extract_all(lower(sent_text), '<word>')) AS n FROM sentences), hits AS (SELECT doc_id, sent_id FROM sized WHERE n >= 12)
    SELECT s.update_id, r.first, r.last FROM sized s JOIN {RANGES} r ON s.doc_id = r.doc_id AND s.sent_id BETWEEN r.first AND r.last
    JOIN (SELECT r.doc_id, r.island FROM sized s JOIN {RANGES} r ON s.doc_id = r.doc_id AND s.sent_id BETWEEN r.first AND r.last WHERE s.n <= 45 GROUP BY ALL HAVING bool_or(regexp_matches(s.sent_text, '(?i)the')) AND bool_or(regexp_matches(s.sent_text, '(?i)on'))) ok
    ON ok.doc_id = r.doc_id AND ok.island = r.island WHERE s.n > 3 AND s.n <= 45""")
def prj1(t):
    """Sentences of ranges that hold all terms; a length rule stands for the detector's probability."""
    sized = t.sentences.withColumn("n", whole(F.size(T.words("sent_text"))))
    ranges = article_ranges(sized.where("n >= 12").select("doc_id", "sent_id")).drop("n")
    inside = sized.join(ranges, "doc_id").where("sent_id between first and last and n <= 45")
    w = Window.partitionBy("doc_id", "island")
    ok = inside.withColumns({f"has{k}": F.bool_or(F.col("sent_text").rlike(f"(?i){term}")).over(w) for k, term in enumerate(DAY_TERMS)})
    return ok.where("has0 and has1 and n > 3").select("update_id", "first", "last")


@query("prj2_detector_features", r"""SELECT update_id, sent_id, round((sent_id) / cnt, 6) AS place, w[-1] AS last1, CASE WHEN len(w) >= 2 THEN array_to_string(w[-2:], ' ') END AS last2, CASE WHEN len(w) >= 3 THEN array_to_string(w[-3:], ' ') END AS last3, len(w) AS tokens
    FROM (SELECT *, regexp_extract_all(lower(sent_text), '<word>') AS w, count(*) OVER (PARTITION BY doc_id) AS cnt FROM sentences) WHERE len(w) > 0""")
def prj2(t):
    s = t.sentences.withColumns({"w": T.words("sent_text"), "cnt": F.count("*").over(Window.partitionBy("doc_id"))}).where(F.size("w") > 0)
    tail = lambda k: F.when(F.size("w") >= k, F.array_join(F.slice("w", -k, k), " "))
    return s.select("update_id", "sent_id", F.round(F.col("sent_id") / F.col("cnt"), 6).alias("place"), tail(1).alias("last1"), tail(2).alias("last2"), tail(3).alias("last3"), whole(F.size("w")).alias("tokens"))
