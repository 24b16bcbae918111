import hashlib

import xxhash

from newstide.llm import simhash, substring

from . import corpus


def expected_removal(data, window=13):
    docs = sorted(((i if i is not None else 10**9 + k, t) for k, (i, t, *_) in enumerate(data)), key=lambda x: x[0])
    first, out = {}, {}
    split = [(i, (t or "").encode().split()) for i, t in docs]
    for i, w in split:
        for s in range(len(w) - window + 1):
            first.setdefault(tuple(w[s : s + window]), i)
    for i, w in split:
        gone = set()
        for s in range(len(w) - window + 1):
            if first[tuple(w[s : s + window])] < i:
                gone.update(range(s, s + window))
        kept = b" ".join(x for k, x in enumerate(w) if k not in gone)
        out.setdefault(i if i < 10**9 else None, []).append((len(w), len(gone), hashlib.sha256(kept).hexdigest(), kept.decode()))
    return out


def test_substring_removal_is_exact(spark):
    for seed in range(3):
        data = corpus.rows(seed)
        want = expected_removal(data)
        got = substring.remove_repeats(corpus.frame(spark, data)).collect()
        assert len(got) == len(data)
        for r in got:
            assert (r.n_words, r.n_removed, r.kept_sha256) in [x[:3] for x in want[r.doc_id]]
            assert sum(s.end - s.start for s in r.spans) == r.n_removed
        assert sum(r.n_removed for r in got) > 0


def test_substring_keeps_rows_and_columns(spark):
    data = corpus.rows(1)
    want = expected_removal(data)
    docs = corpus.frame(spark, data)
    out = substring.without_repeats(docs)
    assert out.columns == docs.columns
    got = out.collect()
    assert len(got) == len(data)
    texts = {(i, t) for i, t, *_ in data}
    for r in got:
        assert (r.doc_id, r.text) in texts or r.text in [x[3] for x in want[r.doc_id]]
        assert r.n_chars == len(r.text or "") and r.g == 1 and r.block == 7
    assert not substring.without_repeats(corpus.frame(spark, [])).collect()


def brute_fingerprint(text):
    w = (text or "").encode().lower().split()
    shingles = [b" ".join(w[k : k + 3]) for k in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_components(spark):
    data = corpus.rows(2)
    data += corpus.docs_of([(900 + k, data[5][1] + " tail" * k) for k in range(4)])
    ids = [i for i, *_ in data]
    fp = [brute_fingerprint(t) for _, t, *_ in data]
    root = list(range(len(data)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(data)):
        for b in range(a):
            if (fp[a] ^ fp[b]).bit_count() <= 2:
                root[find(a)] = find(b)
    least = {}
    for k, i in enumerate(ids):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    want = sorted((str(i), f"{f:016x}", str(least.get(find(k)))) for k, (i, f) in enumerate(zip(ids, fp, strict=True)))
    got = simhash.near_duplicates(corpus.frame(spark, data)).collect()
    assert sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in got) == want
    assert not simhash.near_duplicates(corpus.frame(spark, [])).collect()


def test_balls_meet_exactly_within_the_radius(spark):
    import random

    rnd = random.Random(4)
    base = [rnd.getrandbits(64) for _ in range(30)]
    values = set(base)
    for x in base:
        for bits in (1, 2, 3):
            values.add(x ^ sum(1 << b for b in rnd.sample(range(64), bits)))
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    links = simhash.linked(spark.createDataFrame([(v,) for v in signed], "fp long")).collect()
    mask = (1 << 64) - 1
    assert all(((r.a & mask) ^ (r.b & mask)).bit_count() <= 2 for r in links)
    root = {v: v for v in signed}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for r in links:
        root[find(r.a)] = find(r.b)
    for a in signed:
        for b in signed:
            if ((a & mask) ^ (b & mask)).bit_count() <= 2:
                assert find(a) == find(b)
