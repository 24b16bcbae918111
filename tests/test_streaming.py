"""Streaming forms give what the batch forms give."""

import datetime
import random
import time

import pytest
from pyspark.sql import functions as F

from newstide.plans.base import Tables
from newstide.plans.catalog import QUERIES
from newstide.plans.selecting import document_counts
from newstide.streaming import stateful as K
from newstide.streaming import streams as S


def files(spark, sf, tmp_path, parts=4):
    out = str(tmp_path / "in")
    spark.read.parquet(f"{sf}/events.parquet").orderBy("ts").coalesce(1).write.option("maxRecordsPerFile", 1000 // parts).parquet(out)
    return out


def test_buckets(spark, sf, tmp_path):
    path, t = files(spark, sf, tmp_path), Tables(spark, sf)
    stream = S.bucket_counts(S.event_stream(spark, path, t.events))
    got = S.run_to_end(stream, "buckets", str(tmp_path / "c"), "complete")
    want = S.bucket_counts(t.timed_events)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_append_emits_only_closed_buckets(spark, sf, tmp_path):
    path, t = files(spark, sf, tmp_path), Tables(spark, sf)
    got = S.run_to_end(S.bucket_counts(S.event_stream(spark, path, t.events)), "closed", str(tmp_path / "c")).collect()
    want = set(map(tuple, S.bucket_counts(t.timed_events).collect()))
    assert got and set(map(tuple, got)) <= want


ZERO = datetime.datetime(2024, 1, 1)


def batches(seed, n=4, rows=60):
    """Rows in batches, mostly in time, some late, some too late; (key, id, value, n, hours, counts)."""
    rnd, out = random.Random(seed), []
    for b in range(n):
        part = []
        for k in range(rows):
            hour = b * 30 + rnd.random() * 28 - (rnd.random() < 0.2) * rnd.choice([0.5, 3, 40])
            counts = {f"w{rnd.randrange(8)}": float(rnd.randint(1, 3)) for _ in range(rnd.randint(1, 3))}
            part.append((rnd.choice(["a", "a", "b", None]), b * 1000 + k, rnd.choice([1, 2, 3, 4, 5, 6, None]), rnd.randint(1, 4), max(hour, 0), counts))
        out.append(part)
    return out


def let_through(parts, stop_after, late_hours=1):
    """Each batch's rows in order, without those that were too late.

    What is too late goes by the watermark of the batch before (the largest time
    of the batches before that, less the lateness); a run ends with a batch
    without rows, by which the watermark catches up.
    """
    before, now = -1, -1
    for k, part in enumerate(parts):
        ms = lambda r: round(r[4] * 3_600_000)
        if k == stop_after:
            before = now
        yield [r for r in sorted(part, key=lambda r: (ms(r), r[1])) if ms(r) > before]
        before, now = now, max(now, *(ms(r) - late_hours * 3_600_000 for r in part))


def streamed(spark, folder, parts, form, stop_after):
    """All batches through ``form``, a file each; the query is stopped after some of them and started again on its checkpoint."""
    schema = "key string, id long, value long, n long, ts timestamp, counts map<string,double>"
    (folder / "in").mkdir()
    out = None
    for part in (parts[:stop_after], parts[stop_after:]):
        for rows in part:
            data = [(k, i, v, n, ZERO + datetime.timedelta(milliseconds=round(h * 3_600_000)), c) for k, i, v, n, h, c in rows]
            spark.createDataFrame(data, schema).coalesce(1).write.mode("append").parquet(f"file:{folder}/in")
            time.sleep(1.1)  # files are taken by their time of writing
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"file:{folder}/in")
        out = K.run(form(stream), f"file:{folder}/run")
    return out.collect()


@pytest.mark.parametrize("keep", [20 * 3600, None])
def test_novelty_with_late_rows_expiry_and_restart(spark, tmp_path, keep):
    parts = batches(1)
    got = sorted(r.id for r in streamed(spark, tmp_path, parts, lambda s: K.novel_rows(s, keep), 2))
    last, want = {}, []
    for rows in let_through(parts, 2):
        for k, i, v, _, h, _ in rows:
            ms = round(h * 3_600_000)
            if (k, v) not in last or keep and ms - last[k, v] > keep * 1000:
                want.append(i)
            last[k, v] = max(ms, last.get((k, v), ms))
    assert got == sorted(want)
    if keep:  # what had been seen came again
        assert len(want) > len({(k, v) for rows in parts for k, _, v, *_ in rows})


def test_counters_with_late_rows_and_restart(spark, tmp_path):
    parts = batches(2)
    got = {r.id: r.total for r in streamed(spark, tmp_path, parts, lambda s: K.running_counts(s, 20 * 3600), 2)}
    held, want = {}, {}
    for rows in let_through(parts, 2):
        for k, i, v, n, h, _ in rows:
            ms = round(h * 3_600_000)
            total, last = held.get((k, v), (0, ms))
            want[i] = n + (total if ms - last <= 20 * 3_600_000 else 0)
            held[k, v] = (want[i], max(last, ms))
    assert got == want


def test_representatives_with_late_rows_expiry_and_restart(spark, tmp_path):
    parts, keep = batches(3, rows=40), 12 * 3_600_000
    got = {r.id: r.representative for r in streamed(spark, tmp_path, parts, lambda s: K.representatives(s, keep // 1000), 2)}
    cosine = lambda a, b: sum(x * b.get(w, 0.0) for w, x in a.items()) / (sum(x * x for x in a.values()) * sum(x * x for x in b.values())) ** 0.5
    reps, want, missed = {}, {}, 0
    for rows in let_through(parts, 2):
        for k, i, _, _, h, counts in rows:
            ms = round(h * 3_600_000)
            near = sorted((-cosine(counts, c), first, j) for j, (key, first, c, last) in reps.items() if key == k and cosine(counts, c) >= 0.8 - 1e-12)
            alive = [x for x in near if ms - reps[x[2]][3] <= keep]
            missed += bool(near) and not alive
            if alive:
                want[i] = alive[0][2]
                reps[want[i]][3] = max(reps[want[i]][3], ms)
            else:
                want[i], reps[i] = i, [k, ms, counts, ms]
    assert got == want and missed and len(set(want.values())) < len(want)


def test_dedup_as_a_stream_is_that_of_the_batch(spark, sf, tmp_path):
    counts = document_counts(Tables(spark, sf)).select(F.col("query_id").alias("key"), "id", "counts", F.timestamp_seconds("epoch").alias("ts"))
    counts.write.parquet(f"file:{tmp_path}/in")
    got = K.run(K.representatives(spark.readStream.schema(counts.schema).parquet(f"file:{tmp_path}/in")), f"file:{tmp_path}/run")
    assert {r.id: r.representative for r in got.collect()} == {r.id: r.representative for r in QUERIES["dd1_streaming_dedup"](spark, sf).collect()}


@pytest.mark.parametrize("keep", [None, 40])
def test_index_of_representatives_is_a_plain_loop_and_sheds_what_expired(keep):
    rng = random.Random(5)
    index, plain, most = K._Index(keep), {}, 0
    index.limit = 8
    for i in range(1500):
        counts, ms = {f"w{rng.randrange(40)}": rng.randrange(1, 4) for _ in range(rng.randrange(0, 5))}, i // 2
        norm = lambda c: sum(n * n for n in c.values()) ** 0.5
        alive = {r: sum(n * c.get(w, 0) for w, n in counts.items()) / (norm(c) * norm(counts)) for r, (_, c, last) in plain.items() if c and counts and (keep is None or ms - last <= keep)}
        want = min(alive, key=lambda r: (-alive[r], plain[r][0], r), default=None)
        want = want if want is not None and alive[want] >= 0.8 else None
        assert index.nearest(counts, ms, 0.8) == want
        if want is None:
            plain[i] = [ms, counts, ms]
            index.add(i, ms, counts, ms)
        else:
            plain[want][2] = ms
            index.seen(want, ms)
        most = max(most, len(index.entries))
    assert keep is None or most <= 1024 < len(plain)
