import collections
import itertools
import math
import zlib

import numpy as np
import pyarrow as pa
import pytest

from newstide.llm import components, embeddings, hmm, mixing, packing, tokens

from . import corpus


def test_base_scores_by_hand(spark):
    data = corpus.rows()
    got = hmm.score(corpus.frame(spark, data), hmm.Settings(seed_docs=50)).collect()
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    words = lambda t: (t or "").encode().lower().split() + [None]
    c = collections.Counter(w for i, t, *_ in data if not held(i) for w in words(t))
    n, v = sum(c.values()), len(c)
    want = collections.Counter((i, held(i), len(words(t)), sum(c[w] > 0 for w in words(t)), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in words(t)), 6)) for i, t, *_ in data)
    assert collections.Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    assert all(r.score < 0 and math.isfinite(r.score) for r in got)
    assert not hmm.score(corpus.frame(spark, [])).collect()


def small_model(k=3, m=5, seed=0):
    rng = np.random.default_rng(seed)
    one = lambda x, axis: x / x.sum(axis=axis, keepdims=True)
    return hmm.Model(one(rng.random(k), 0), one(rng.random((k, k)), 1), one(rng.random((m, k)), 0))


def test_forward_sums_all_state_paths():
    model, rng = small_model(), np.random.default_rng(1)
    tokens_, bounds = rng.integers(0, 5, 17), np.array([0, 1, 5, 11, 17])
    for chunk in (100, 4, 1):
        got = hmm.forward(model, tokens_, bounds, chunk)
        for i, (a, b) in enumerate(itertools.pairwise(bounds)):
            seq, total = tokens_[a:b], 0.0
            for path in itertools.product(range(3), repeat=len(seq)):
                p = model.start[path[0]] * model.emit[seq[0], path[0]]
                for x, y, t in zip(path, path[1:], seq[1:], strict=False):
                    p *= model.trans[x, y] * model.emit[t, y]
                total += p
            assert got[i] == pytest.approx(math.log(total))


def test_baum_welch_counts_are_posteriors_and_never_lower_the_likelihood():
    model, rng = small_model(), np.random.default_rng(2)
    seq = rng.integers(0, 5, 5)
    got = hmm.expected_counts(model, seq, np.array([0, 5]), 10)
    start, trans, emit, like = np.split(got, [3, 12, 27])
    weight, want_start, want_trans, want_emit = 0.0, np.zeros(3), np.zeros((3, 3)), np.zeros((5, 3))
    for path in itertools.product(range(3), repeat=5):
        p = model.start[path[0]] * np.prod([model.emit[t, s] for t, s in zip(seq, path, strict=True)]) * np.prod([model.trans[x, y] for x, y in itertools.pairwise(path)])
        weight += p
        want_start[path[0]] += p
        for x, y in itertools.pairwise(path):
            want_trans[x, y] += p
        for t, s in zip(seq, path, strict=True):
            want_emit[t, s] += p
    assert np.allclose(start, want_start / weight) and np.allclose(trans.reshape(3, 3), want_trans / weight) and np.allclose(emit.reshape(5, 3), want_emit / weight)
    assert like[0] == pytest.approx(math.log(weight))
    long = rng.integers(0, 5, 400)
    rows = np.array([0, 7, 8, 150, 400])
    whole = hmm.expected_counts(model, long, rows, 1000)
    for chunk in (1, 3, 64):  # where a text is cut changes nothing
        assert np.allclose(hmm.expected_counts(model, long, rows, chunk), whole)
        assert np.allclose(hmm.expected_counts(model, long, rows, chunk, lanes=2), whole)
    before = -math.inf
    for _ in range(6):
        c = hmm.expected_counts(model, long, np.array([0, 400]), 400)
        assert c[-1] >= before - 0.5  # smoothing moves it a little
        before, model = c[-1], hmm.Model.from_counts(c, 3, 4)


def test_ids_are_the_tokenizers(spark):
    tokenizers = pytest.importorskip("tokenizers")
    public = pytest.importorskip("public_tokenizers")
    t = tokenizers.Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    parts = ["'s", "'", "'re", " ", "  ", "\n", "\t", "a", "B", "é", "1", "²", "!", "...", "　", "日本", "'ll", "'l", "😀", "́", "\x1c", "\x85", "<|endoftext|>", " the", "Don't"]
    rng = np.random.default_rng(0)
    texts = ["".join(rng.choice(parts, rng.integers(0, 14))) for _ in range(3000)]
    want = [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]
    have = [ids[rows[k] : rows[k + 1]].tolist() for i, j, ids, rows in tokens.Encoder(packing.ranks_path()).column(pa.array(texts), 4096) for k in range(j - i)]
    assert have == want


def test_added_token_is_one_id_as_in_the_tokenizers_default(spark):
    tokenizers = pytest.importorskip("tokenizers")
    public = pytest.importorskip("public_tokenizers")
    t = tokenizers.Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    parts = ["<|endoftext|>", "<|endof", "text|>", "<|", "|>", " ", "  ", "\n", "a", "é", "1", "!", "'s", "日本", " the"]
    rng = np.random.default_rng(1)
    texts = ["".join(rng.choice(parts, rng.integers(0, 10))) for _ in range(3000)]
    want = [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]
    have = [ids[rows[k] : rows[k + 1]].tolist() for i, j, ids, rows in tokens.Encoder(packing.ranks_path(), packing.ADDED).column(pa.array(texts), 4096) for k in range(j - i)]
    assert have == want
    got = packing.pack(corpus.frame(spark, corpus.docs_of([(1, "a <|endoftext|> b")])), packing.ranks_path()).collect()
    assert [(r.length, r.ids_crc32) for r in got] == [(5, zlib.crc32(np.array([64, 220, 50256, 275, packing.END_ID], "<u4").tobytes()))]


def test_packing_places_every_piece(spark):
    data = corpus.rows()
    got = packing.pack(corpus.frame(spark, data), packing.ranks_path(), 64).collect()
    sequences = collections.defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append((r.offset, r.length))
    for rows in sequences.values():
        at = 0
        for offset, length in sorted(rows):
            assert offset == at
            at += length
        assert at <= 64
    by = collections.defaultdict(list)
    for r in got:
        by[r.doc_id].append(r)
    assert len(by) == len({i for i, *_ in data})
    for i, rows in by.items():
        for r in rows:
            assert r.length == 64 or r.piece == 0
        if i is not None and sum(d[0] == i for d in data) == 1:
            rows.sort(key=lambda r: r.piece)
            assert [r.start for r in rows] == [0, *np.cumsum([r.length for r in rows])[:-1].tolist()]
    assert by[500][0].length == 1 and by[500][0].ids_crc32 == zlib.crc32(b"\0\0\0\0")
    assert len(sequences) <= math.ceil(sum(r.length for r in got) / 64) + 2
    assert not packing.pack(corpus.frame(spark, []), packing.ranks_path()).collect()


def test_fullest_combination_is_the_best():
    rng = np.random.default_rng(3)
    for _ in range(60):
        counts = {int(s): int(rng.integers(1, 4)) for s in rng.integers(1, 20, 4)}
        room = int(rng.integers(1, 40))
        best = max(s for n in itertools.product(*[range(c + 1) for c in counts.values()]) if (s := sum(a * b for a, b in zip(n, counts, strict=True))) <= room)
        combo = packing.fullest(counts, room)
        assert sum(s * n for s, n in combo.items()) == best and all(n <= counts[s] for s, n in combo.items())
    counts = {7: 50, 5: 31, 3: 9, 1: 4}
    used = collections.Counter()
    for combo, times in packing.plan(counts, 16):
        assert sum(s * n for s, n in combo.items()) <= 16
        for s, n in combo.items():
            used[s] += n * times
    assert used == counts


def test_mixing_meets_limit_and_budget(spark):
    data = []
    for k, (source, n) in enumerate((("big", 600), ("mid", 120), ("small", 40), (None, 30))):
        data += [(k * 1000 + i, "w " * 10, "en", source, 20, 1, 2, 3, 4, 5, 6, 7) for i in range(n)]
    data += [(9000, None, "en", "empty", 0, 1, 2, 3, 4, 5, 6, 7), (9001, "", "en", "empty", 0, 1, 2, 3, 4, 5, 6, 7)]
    docs = corpus.frame(spark, data)
    s = mixing.Settings(max_repeats=2.5, bits=3)
    got = mixing.mix(docs, s).collect()
    assert len(got) == len(data) and all(r.copies >= 1 and len(r.order_keys) == r.copies for r in got)
    total = collections.Counter()
    for r in got:
        total[r.source] += r.copies * r.n_tokens
    repeats = {r.source: r.repeats for r in got}
    size = {"big": 6000, "mid": 1200, "small": 400, None: 300}
    assert max(repeats.values()) == pytest.approx(2.5, abs=1e-3) and repeats["big"] == 1
    for source, n in size.items():
        assert abs(total[source] - n * repeats[source]) <= 10
    weights = {r.source: r.weight for r in got}
    assert sum(weights.values()) == pytest.approx(1) and weights["empty"] == 0
    for source in size:
        assert total[source] / sum(total.values()) == pytest.approx(weights[source], abs=0.01)
    out = mixing.mixed(docs, s)
    assert out.columns == docs.columns
    assert collections.Counter(r.doc_id for r in out.collect()) == {r.doc_id: r.copies for r in got}
    assert not mixing.mix(corpus.frame(spark, []), s).collect()
    assert len(mixing.mix(corpus.frame(spark), s).collect()) == len(corpus.rows())


def test_entropy_target(spark):
    totals = spark.createDataFrame([("a", 1000), ("b", 100), ("c", 10)], "source string, tokens long")
    a = mixing.exponent(totals, mixing.Settings(max_repeats=1e9, entropy_share=0.9))
    w = np.array([1000.0, 100, 10]) ** a
    w /= w.sum()
    assert -(w * np.log(w)).sum() == pytest.approx(0.9 * math.log(3), abs=1e-4)


def vectors(seed=0, dim=16):
    rng = np.random.default_rng(seed)
    x = [rng.normal(size=dim) for _ in range(120)]
    x += [x[3] + rng.normal(size=dim) * e for e in (0.01, 0.05, 0.1, 0.2, 0.3)] + [x[5]] * 3 + [x[7] * 2.5]
    x += [x[9] + rng.normal(size=dim) * 0.02 for _ in range(40)]
    return [(i, [float(v) for v in row], 0) for i, row in enumerate(x)]


def test_embedding_links_against_brute_force(spark):
    data = vectors()
    odd = [(1000, None, 0), (1001, [0.0] * 16, 0), (1002, [1.0, None] * 8, 0), (1003, [float("nan")] * 16, 0), (1004, [1.0, 2.0], 1), (1005, [2.0, 4.0], 1), (1006, [], 0), (1007, [float("inf")] * 16, 0)]
    frame = spark.createDataFrame(data + odd, "vec_id long, embedding array<double>, label int").withColumn("node", lit(7)).withColumn("key", lit(1)).repartition(4)
    for tile in (512, 8):
        got = {r.vec_id: r for r in embeddings.near_duplicates(frame, embeddings.Settings(tile=tile)).collect()}
        x = np.array([v for _, v, _ in data])
        x /= np.sqrt((x * x).sum(1, keepdims=True))
        near = x @ x.T >= 0.9
        want, have = near.sum() - len(x), sum(got[i].n_links for i in range(len(x)))
        assert all(got[i].n_links <= near[i].sum() - 1 for i in range(len(x))) and have >= 0.97 * want
        assert got[5].n_links >= 3 and got[5].component_id == 5 and not got[125].kept
        assert got[1004].n_links == 1 and got[1005].component_id == 1004
        for i in (1000, 1001, 1002, 1003, 1006, 1007):
            assert (got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True)
    assert not embeddings.near_duplicates(frame.where("false")).collect()


def lit(x):
    from pyspark.sql import functions as F

    return F.lit(x)


def test_estimates_are_unbiased_and_bounded():
    rng = np.random.default_rng(0)
    x = embeddings._unit(rng.normal(size=(300, 32)))
    bits, factors = embeddings.codes_of(x, 3)
    guess, error = embeddings.estimate(bits, factors, x)
    off = ~np.eye(300, dtype=bool)
    miss = (guess - x @ x.T)[off]
    assert abs(miss.mean()) < 0.01
    assert (np.abs(guess - x @ x.T) <= 4 * error[:, None]).mean() > 0.999


def pairs_at(cosine, n, dim, rng):
    """Unit vectors and others at ``cosine`` to them."""
    x, z = embeddings._unit(rng.normal(size=(n, dim))), rng.normal(size=(n, dim))
    side = embeddings._unit(z - (z * x).sum(1, keepdims=True) * x)
    return x, cosine * x + math.sqrt(1 - cosine**2) * side


@pytest.mark.parametrize("dim", [16, 64])
def test_codes_alone_estimate_without_bias_and_within_their_bound(dim):
    rng = np.random.default_rng(4)
    for cosine in (0.9, 0.95, 0.5, 0.0):
        x, y = pairs_at(cosine, 2000, dim, rng)
        sides = []
        for v in (x, y):
            bits, factors = embeddings.codes_of(v, 4)
            sides.append(embeddings.code_products(bits, factors, dim))
        guess, error = embeddings.code_estimate(*sides, 0.9)
        guess, error = np.diag(guess), np.diag(error)
        assert abs(guess.mean() - cosine) < 0.01
        if cosine >= 0.9:
            assert (guess + 4 * error >= 0.9).mean() > 0.999


def test_only_undecided_vectors_are_fetched(spark):
    """Planted pairs are found; of the vectors that share no link, few are fetched with their components."""
    rng = np.random.default_rng(8)
    x, y = pairs_at(0.91, 300, 64, rng)
    alone = embeddings._unit(rng.normal(size=(3000, 64)))
    rows = [(i, [float(c) for c in v], 0) for i, v in enumerate(np.concatenate([x, y, alone]))]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(4)
    s = embeddings.Settings()
    _, nodes = embeddings.distinct_vectors(frame)
    bits, bands = embeddings.banding(nodes.count(), s)
    fetched = {r.node for r in embeddings.undecided(nodes, bits, bands, s).select("node").distinct().collect()}
    least = {r.node: r.least for r in nodes.select("node", "least").collect()}
    planted = {n for n in fetched if least[n] < 600}
    assert len(planted) >= 0.96 * 600 and len(fetched - planted) <= 0.02 * 3000
    found = [r for r in embeddings.near_duplicates(frame, s).collect() if r.n_links]
    assert len(found) >= 0.96 * 600 and all(r.vec_id < 600 and r.component_id == r.vec_id % 300 for r in found)


def test_components_of_paths_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, i) for i in range(101, 120)] + [(200, 201), (201, 202), (202, 200), (300, 300)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(31)) and all(got[i] == 100 for i in range(100, 120)) and {got[200], got[201], got[202]} == {200}
    assert 300 not in got
    assert not components.components(spark.createDataFrame([], "a long, b long")).collect()
