import datetime
import gzip
import hashlib
import io
import math
import random
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from newstide.llm import funnel, lloyd, warc
from newstide.llm.queries import ORACLES, QUERIES

MINUTE = 60 * funnel.SECOND
CLICKS = "client_id long, kind string, ts timestamp_ntz, client int, cell string, at int, us int, taken int, n string"


def clicks(seed, n=900):
    """Dense and sparse clients, ties, repeats, nulls, other kinds, times before 1970."""
    rnd = random.Random(seed)
    zero = datetime.datetime(1969, 12, 31, 23, 0)
    rows = []
    for _ in range(n):
        client = rnd.choice([1, 1, 1, 2, 3, 4, None])
        kind = rnd.choice(["view", "click", "view", "click", "purchase", "signup", "error", "other", None])
        at = zero + datetime.timedelta(microseconds=rnd.choice([rnd.randrange(6 * 3600) * funnel.SECOND, rnd.randrange(6 * 3600 * funnel.SECOND), rnd.randrange(40) * 15 * MINUTE]))
        rows.append((client, kind, at if rnd.random() > 0.02 else None))
    return [(c, k, t, 1, "x", 2, 3, 4, "y") for c, k, t in rows + rows[:50]]


def plain_funnels(rows, wanted, limit, percent):
    """A loop over every attempt."""
    own = defaultdict(lambda: defaultdict(set))
    for c, k, t, *_ in rows:
        if c is not None and k is not None and t is not None:
            own[c][k].add(round((t - datetime.datetime(1970, 1, 1)) / datetime.timedelta(microseconds=1)))
    out = {}
    for f in wanted:
        for c, kinds in own.items():
            n, took = [0] * len(f.steps), [[] for _ in f.steps[1:]]
            for at in kinds.get(f.steps[0], ()):
                n[0] += 1
                for k, step in enumerate(f.steps[1:]):
                    then = min((t for t in kinds.get(step, ()) if t > at), default=None)
                    if then is None or then - at > limit or any(at < x <= then for e in f.excluded for x in kinds.get(e, ())):
                        break
                    n[k + 1] += 1
                    took[k].append(then - at)
                    at = then
            if n[0]:
                middle = [sorted(x)[math.ceil(percent * len(x) / 100) - 1] if x else None for x in took]
                out[f.name, c] = (n, sum(x > 0 for x in n), middle)
    depths = defaultdict(int)
    for (f, _), (_, d, _) in out.items():
        depths[f, d] += 1
    return {k: (*v, depths[k[0], v[1]]) for k, v in out.items()}


@pytest.mark.parametrize("seed, cell, limit, percent", [(0, 15 * MINUTE, 15 * MINUTE, 50), (1, MINUTE // 2, 15 * MINUTE, 90), (2, 7 * 3600 * funnel.SECOND, 20 * MINUTE, 1), (3, 4 * MINUTE, 10 * MINUTE, 100)])
def test_funnels_are_those_of_a_loop(spark, seed, cell, limit, percent):
    rows = clicks(seed)
    wanted = (*funnel.FUNNELS, funnel.Funnel("D", ("view", "view", "click", "view", "click"), ("error", "signup")), funnel.Funnel("E", ("click", "view")))
    got = funnel.funnels(spark.createDataFrame(rows, CLICKS).repartition(3), wanted, limit, percent, cell).collect()
    want = plain_funnels(rows, wanted, limit, percent)
    assert len(got) == len(want)
    for r in got:
        n, deepest, taken, same = want[r.funnel, r.client_id]
        assert (r.n[: len(n)], r.taken[: len(taken)], r.deepest, r.same_depth) == (n, taken, deepest, same)
        assert not any(r.n[len(n) :]) and not any(r.taken[len(taken) :])
    assert any(r.deepest == 4 for r in got)


def test_funnels_of_nothing(spark):
    assert not funnel.funnels(spark.createDataFrame([], CLICKS)).collect()
    assert not funnel.funnels(spark.createDataFrame([(None, "view", None, 1, "", 1, 1, 1, "")], CLICKS)).collect()


def test_nth_smallest_of_repeated_values():
    rnd = random.Random(0)
    for _ in range(200):
        values = np.array(sorted({rnd.randrange(50) for _ in range(rnd.randint(1, 30))}))
        rnd.shuffle(values)
        counts = np.array([rnd.randint(1, 9) for _ in values])
        every = sorted(np.repeat(values, counts))
        n = rnd.randint(1, len(every))
        assert funnel.nth_smallest(values, counts, n) == every[n - 1]


def plain(v):
    return float(v) if type(v).__name__ == "Decimal" else v


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_duckdb(spark, sf, name):
    c = duckdb.connect()
    for t in ("clicks", "pages", "embeddings"):
        c.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    df, relation = QUERIES[name](spark, sf), c.sql(ORACLES[name])
    columns = sorted(df.columns)
    assert sorted(relation.columns) == columns
    order = [relation.columns.index(x) for x in columns]
    assert sorted((tuple(r[x] for x in columns) for r in df.collect()), key=repr) == sorted((tuple(plain(r[k]) for k in order) for r in relation.fetchall()), key=repr)


PAGES = "page_id long, url string, html string, payload string, key int, spread int, n int, lead int, bytes int, path string"


def pages():
    rnd = random.Random(4)
    noise = lambda n: "".join(chr(rnd.choice([rnd.randrange(32, 127), rnd.randrange(0x4E00, 0x9FFF)])) for _ in range(n))
    same, edge = "<p>copied</p>" * 100, "x" * 1000
    rows = [(k, f"http://a.example/{k}?q=a%20b c\r\nX-Evil: 1", noise(rnd.randrange(600))) for k in range(40)]
    rows += [(100 + k, "http://b.example/é", same) for k in range(30)] + [(129, None, same), (None, "http://b.example/", same)]
    rows += [(200, None, None), (201, "", ""), (202, "u", None), (None, None, None), (None, "v", "no id")]
    rows += [(301, "u", edge), (300, "u", edge), (303, "u", edge[1:]), (302, "u", edge[1:]), (400, "long", noise(200_000)), (401, "u", "WARC/1.1\r\nWARC-Type: response\r\n\r\n\x1f\r\n\r\n")]
    rows += [(None, "x", "y" * 2000), (None, "x", "y" * 2000)]
    return [(*r, "a", 1, 2, 3, 4, 5, "b") for r in rows]


def plain_archive(rows, least):
    lead = {}
    for i, _, h, *_ in rows:
        if h and len(h.encode()) >= least and i is not None:
            lead[h] = max(i, lead.get(h, i))
    out = []
    for i, _, h, *_ in rows:
        whole = (h or "").encode()
        to = lead.get(h)
        to = None if to == i else to
        out.append((i, len(whole), hashlib.sha1(whole).hexdigest(), "response" if to is None else "revisit", to, None if to is not None else whole))
    return sorted(out, key=repr)


@pytest.mark.parametrize("range_bytes", [300, 4096, 4 << 20])
def test_archives_come_back_whole_from_any_ranges(spark, range_bytes):
    rows = pages()
    got = warc.archived(spark.createDataFrame(rows, PAGES).repartition(3), range_bytes=range_bytes).collect()
    key = lambda r: (r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, None if r.payload is None else bytes(r.payload))
    assert sorted(map(key, got), key=repr) == plain_archive(rows, 1000)
    assert all(r.sound is (None if r.record_type == "revisit" else True) for r in got)
    assert len({(r.path, r.start) for r in got}) == len(rows)
    assert all("\n" not in (r.target_uri or "") for r in got)


def test_no_pages(spark):
    assert not warc.archived(spark.createDataFrame([], PAGES)).collect()


def test_files_are_plain_gzip_and_roll_over(spark, tmp_path):
    rows = [("response", f"urn:page:{k}", None, f"http://a/{k}", "2024-01-01T00:00:00Z", random.Random(k).randbytes(500)) for k in range(50)]
    df = spark.createDataFrame(rows, "record_type string, record_id string, refers_to string, target_uri string, warc_date string, payload binary").coalesce(1)
    files = warc.write_archives(df, f"file:{tmp_path}/new/folder", 4000)
    found = files.collect()
    assert len(found) > 4 and sum(r.records for r in found) == 50 and all(r.bytes < 4000 + 1500 for r in found)
    text = b"".join(gzip.decompress(open(r.path.removeprefix("file:"), "rb").read()) for r in found)
    assert text.count(b"WARC/1.1\r\n") == 50
    assert sorted((r.record_id, bytes(r.payload)) for r in warc.read_archives(files, 700, 128).collect()) == sorted((r[1], r[5]) for r in rows)


def test_ranges_own_each_record_once_and_pass_over_what_is_none():
    """Magic inside payloads, members that aren't records, damaged ones and bytes between them."""
    rnd = random.Random(7)
    stored = zlib.compressobj(0, zlib.DEFLATED, 31)
    decoy = stored.compress(warc.MAGIC * 50 + gzip.compress(b"not a record") + b"WARC/1.1") + stored.flush()
    parts, want, at = [], [], 0
    for k in range(30):
        made = warc.record("response", f"urn:page:{k}", "http://x", "2024-01-01T00:00:00Z", warc.MAGIC * rnd.randrange(5) + rnd.randbytes(rnd.randrange(3000)))
        if k % 7 == 3:
            made = made[:-5] + b"\0" * 5  # its checksum is wrong
        elif k % 7 != 5:
            want.append((at, len(made)))
        if k % 7 == 5:
            made = decoy
        parts.append(made)
        at += len(made)
    data = b"".join(parts)
    for step in (97, 1000, len(data)):
        got = [(s, n) for a in range(0, len(data), step) for s, n, _ in warc.scan(io.BytesIO(data), a, a + step, len(data), 256)]
        assert got == want


VECTORS = "vec_id long, embedding array<float>, label int, v int, h string, cluster int, distance int, n int"


def vectors(seed, n=150, dim=64):
    rnd = random.Random(seed)
    made = lambda: [rnd.gauss(0, 1) for _ in range(dim)]
    rows = [(k, made()) for k in range(n)]
    rows += [rows[3], rows[3], (None, made()), (None, None), (900, []), (901, made()[:-1]), (902, [None, *made()[1:]]), (903, [math.inf, *made()[1:]]), (904, [math.nan, *made()[1:]]), (905, [0.0] * dim), (906, [1e30, *made()[1:]])]
    rows += [(910 + k, [float(k % 2)] * dim) for k in range(6)]
    return [(i, x, 1, 2, "z", 3, 4, 5) for i, x in rows]


def plain_lloyd(rows, k, rounds, dim=64):
    kept = []
    for i, x, *_ in rows:
        if x is not None and len(x) == dim and all(y is not None and math.isfinite(y) and abs(y) < 2**19 for y in x):
            kept.append((i, [math.floor(256 * float(np.float32(y))) for y in x]))
    begin = sorted((i is None, hashlib.sha256(f"2:{i}".encode()).hexdigest() if i is not None else "", v) for i, v in kept)[:k]
    centroids = [v for *_, v in begin]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), n) for n, c in enumerate(centroids))

    for _ in range(rounds):
        own = defaultdict(list)
        for _, v in kept:
            own[nearest(v)[1]].append(v)
        centroids = [[sum(x) // len(own[n]) for x in zip(*own[n], strict=True)] if own[n] else c for n, c in enumerate(centroids)]
    last = [(i, nearest(v)) for i, v in kept]
    inertia = defaultdict(int)
    for _, (d, n) in last:
        inertia[n] += d
    return sorted(((i, n, d, inertia[n], sum(inertia.values()), hashlib.sha256(",".join(map(str, centroids[n])).encode()).hexdigest()) for i, (d, n) in last), key=repr)


@pytest.mark.parametrize("seed, k, rounds, n", [(0, 7, 5, 150), (1, 40, 2, 90), (2, 40, 3, 4), (3, 1, 1, 20)])
def test_lloyd_is_that_of_a_loop(spark, seed, k, rounds, n):
    rows = vectors(seed, n)
    got = lloyd.clusters(spark.createDataFrame(rows, VECTORS).repartition(3), k, rounds).collect()
    assert sorted((tuple(r[c] for c in ("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")) for r in got), key=repr) == plain_lloyd(rows, k, rounds)


def test_first_by_hash_widens_its_share(spark):
    rows = spark.range(3000).select(F.col("id").alias("vec_id"), F.array(F.col("id").cast("int")).alias("v"))
    want = sorted(range(3000), key=lambda i: hashlib.sha256(f"s:{i}".encode()).hexdigest())[:5]
    assert lloyd.first_by_hash(rows, 5, "s") == [[i] for i in want]
    assert lloyd.first_by_hash(rows.where("vec_id < 0"), 5, "s") == []


def test_no_vectors(spark):
    assert not lloyd.clusters(spark.createDataFrame([], VECTORS)).collect()
    assert not lloyd.clusters(spark.createDataFrame([(1, [1.0], 1, 2, "", 3, 4, 5)], VECTORS)).collect()
