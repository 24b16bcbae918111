import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from newstide.llm import langid, license, toxicity

from . import corpus


def test_license_base_and_templates(spark):
    extra = [
        (800, "Released under the MIT License. MIT license; Apache-License!"),
        (801, "This work is licensed under the GNU General Public License, version 3."),
        (802, "Licensed under the Apache License, Version 2.0, see LICENSE"),
        (803, "licensed under the apache licence version 2.0"),
        (804, "Licensed under CC BY-NC 4.0"),
        (805, "admit license"),
    ]
    data = corpus.rows() + corpus.docs_of(extra)
    got = {}
    for r in license.scan(corpus.frame(spark, data)).collect():
        got.setdefault(r.doc_id, []).append(r)
    for i, t, *_ in data:
        w = re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").encode().lower())
        places, labels = [], set()
        for phrase, label in license.PHRASES.items():
            p = phrase.encode().split()
            hits = [k for k in range(len(w)) if w[k : k + len(p)] == p]
            places += hits
            labels |= {label} if hits else set()
        assert (len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))) in [(r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got[i]]
    label = {i: got[i][0].labels for i, _ in extra}
    assert label == {800: "apache,mit,mit-notice", 801: "gpl,gpl-3.0", 802: "apache,apache-2.0", 803: "", 804: "cc-by-nc-4.0", 805: ""}
    assert got[500][0].n_words == 0 and got[804][0].score == 1.0
    assert not license.scan(corpus.frame(spark, [])).collect()


def test_template_markup():
    a = license.Automaton([("x", "one [[two [[deep]] part]] {{any:1-2}} end"), ("y", "{{a:0-1}} tail")])
    find = lambda s: {(label, i, j) for label, i, j in a.find(s.encode().split()) if label == "x"}
    assert find("one q end") == {("x", 0, 3)}
    assert find("one two part q end") == {("x", 0, 5)}
    assert find("one two deep part q r end") == {("x", 0, 7)}
    assert not find("one two deep q end x") and not find("one end") and not find("one q r s end")
    for bad in ("[[only]]", "a [[b", "a ]] b"):
        with pytest.raises(ValueError):
            license.Automaton([("z", bad)])


def test_toxicity_learns_words_and_reads_through_noise(spark):
    import random

    rnd = random.Random(1)
    data, labels = [], []
    for i in range(400):
        text = corpus.words(rnd, 40)
        if i % 4 == 0:
            w = text.split()
            for _ in range(4):
                w.insert(rnd.randrange(len(w)), rnd.choice(["stupid", "idiot", "loser"]))
            text = " ".join(w)
        data.append((i, text))
        labels.append((i, int(i % 4 == 0)))
    noisy = [(1000, "a st.u.p-i-d thing alpha"), (1001, "alpha 1d10t beta"), (1002, "i d i o t gamma"), (1003, "loooser delta ***"), (1004, "alpha gamma idea"), (1005, "STUPID!!!"), (1006, None), (1007, "")]
    frame = corpus.frame(spark, corpus.docs_of(data + noisy) + corpus.rows()[:3])
    label = spark.createDataFrame([*labels, (5, None), (None, 1)], "doc_id long, toxic int")
    got = toxicity.toxicity(frame, label).collect()
    by = {r.doc_id: r for r in got if r.doc_id is not None and r.doc_id >= 400}
    assert [by[i].predicted for i in range(1000, 1008)] == [1, 1, 1, 1, 0, 1, 0, 0]
    held = [r for r in got if r.held_out and r.doc_id < 400]
    assert held and all(zlib.crc32(str(r.doc_id).encode()) % 5 == 0 for r in held)
    right = sum((r.doc_id % 4 == 0) == r.predicted for r in held)
    assert right >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in got)
    kept = toxicity.without_toxic(frame, label)
    assert kept.columns == frame.columns and not {1000, 1005} & {r.doc_id for r in kept.collect()}
    # no labels: nothing is marked, nothing fails
    assert all(r.predicted == 0 for r in toxicity.toxicity(frame, label.where("false")).collect())
    assert not toxicity.toxicity(corpus.frame(spark, []), label).collect()


def test_accents_tell_plain_words_apart_but_not_restored_ones():
    channel = toxicity.Channel(np.ones(27**3))
    assert channel.readings("réeuxoi".encode()) == ("réeuxoi",) and channel.readings("RÉeuxoi,".encode()) == ("réeuxoi",)
    assert channel.readings(b"reeuxoi") == ("reeuxoi",) and channel.readings("réêè".encode()) == ("réêè",)
    model = toxicity.Model({"réeuxoi": 0.9, "réêè": 0.9}, 0.01, channel)
    assert "~reuxoi" in model.marks and "reeuxoi" not in model.marks and "~re" not in model.marks
    assert any(model.marks.get(r) == "réeuxoi" for r in channel.readings("réeeeuxoi".encode()))


def test_joint_evidence_is_calibrated_without_falling():
    rnd, bands = np.random.default_rng(5), len(toxicity.BANDS)
    for _ in range(50):
        total = rnd.integers(0, 30, bands) * rnd.integers(0, 2, bands)
        toxic = rnd.binomial(total, rnd.random(bands))
        edges = np.append(toxicity.BANDS, 5.0)
        at, share = toxicity._calls(toxic.astype(float), total.astype(float), total * (edges[:-1] + edges[1:]) / 2)
        assert (np.diff(at) > 0).all() and (np.diff(share) >= 0).all() and 0 <= share[0] and share[-1] <= 1
    none = np.zeros(bands)
    at, share = toxicity._calls(none, none, none)
    assert np.allclose(share, 1 - np.exp(-at))
    # a single weak word that mostly clean documents have isn't enough, however sure it seemed
    few = np.eye(bands)[0]
    at, share = toxicity._calls(10 * few, 53 * few, 40 * few)
    assert share[0] < 0.25 < 0.5 < share[-1]


def test_viterbi_is_the_best_path():
    import itertools
    import math


    channel = toxicity.Channel(np.random.default_rng(0).integers(0, 50, 27**3).astype(float))

    def cost(reading):  # every way to read each sign, scored directly
        out, score = [], 0.0
        a = b = 0
        for c, how in reading:
            if how == "drop":
                score -= toxicity.DIGIT if c.isalnum() else toxicity.NOISE
            else:
                x, extra, again = how
                k = ord(x) - 96
                if again:
                    if b != k:
                        return -math.inf, ""
                    score -= extra + toxicity.AGAIN
                else:
                    score += channel.log[a][b][k] - extra
                    a, b = b, k
                    out.append(x)
        return score + channel.log[a][b][0], "".join(out)

    for token in ("a1b", "l00se", "s.t-u", "aab", "$$a"):
        ways = []
        for c in token:
            letters = [(c, 0.0)] if c.isalpha() else [(x, toxicity.AS_LETTER) for x in toxicity.STANDS_FOR.get(c, "")]
            ways.append([(c, (x, e, again)) for x, e in letters for again in (False, True)] + ([] if c.isalpha() else [(c, "drop")]))
        best = max(cost(r) for r in itertools.product(*ways))
        assert channel.restore(token) == best[1]


def test_language_network(spark):

    s = langid.Settings(hidden=3, segment=5)
    net = langid.Network(["a", "b", "c"], s)
    for cell in (net.ahead, net.behind):
        cell.table, cell.rec = cell.table.astype(float), cell.rec.astype(float)
    net.out, net.bias = net.out.astype(float), net.bias.astype(float)
    rng = np.random.default_rng(0)
    codes, label, live = rng.integers(0, 256, (5, 4)), np.array([0, 1, 2, 1]), np.ones((5, 4))
    live[3:, 1] = 0
    _, grads = net.gradients(codes, label, live)
    for p, g in zip(net.params(), grads, strict=True):
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        keep, e = p[at], 1e-4
        p[at] = keep + e
        up = net.gradients(codes, label, live)[0]
        p[at] = keep - e
        down = net.gradients(codes, label, live)[0]
        p[at] = keep
        assert abs(g[at] - (up - down) / (2 * e)) < 1e-6


def test_document_probabilities_are_those_of_a_plain_pass():
    """Byte by byte, both ways through the whole text, whatever the chunks."""
    rng = np.random.default_rng(1)
    rows = [rng.integers(0, 256, n).astype(np.uint8) for n in (1, 4, 5, 40, 0, 333)]
    bounds = np.cumsum([0, *map(len, rows)])
    for chunk, warm, lanes in ((5, 2, 3), (64, 64, 1000), (1000, 8, 2)):
        net = langid.Network(["a", "b", "c"], langid.Settings(hidden=3, chunk=chunk, warm=warm, lanes=lanes, settled=1e-6))

        def states(cell, text):
            out, s, h = [], np.zeros(3), 3
            for c in text:
                x = cell.table[:, c].astype(float)
                z, r = (1 / (1 + np.exp(-(x[k * h : (k + 1) * h] + cell.rec[k * h : (k + 1) * h] @ s))) for k in (0, 1))
                n = np.tanh(x[2 * h :] + cell.rec[2 * h :] @ (r * s))
                s = (1 - z) * n + z * s
                out.append(s)
            return out

        got = net.pooled(np.concatenate(rows), bounds)
        for text, p in zip(rows, got, strict=True):
            f, b = states(net.ahead, text), states(net.behind, text[::-1])[::-1]
            logits = [net.out @ np.concatenate(x) + net.bias[:, 0] for x in zip(f, b, strict=True)]
            want = np.mean([np.exp(x) / np.exp(x).sum() for x in logits], 0) if len(text) else np.zeros(3)
            assert np.abs(p - want).max() < 1e-4


def test_language_predictions(spark):
    import random

    rnd = random.Random(2)
    kinds = {"xx": ["foo", "bar", "ofo"], "yy": ["ščř", "žýá", "éíš"]}
    data = []
    for i in range(160):
        lang = rnd.choice(list(kinds))
        data.append((i, " ".join(rnd.choice(kinds[lang]) for _ in range(rnd.randint(3, 60))), lang, "s", 0, 1, 2, 3, 4, 5, 6, 7))
    data += [(900, None, "xx", "s", 0, 1, 2, 3, 4, 5, 6, 7), (901, "123 !?", "xx", "s", 0, 1, 2, 3, 4, 5, 6, 7), (902, "", None, "s", 0, 1, 2, 3, 4, 5, 6, 7), (None, "foo bar", None, "s", 0, 1, 2, 3, 4, 5, 6, 7)]
    s = langid.Settings(steps=60)
    got = {r.doc_id: r for r in langid.identify(corpus.frame(spark, data), s).collect()}
    held = [i for i in range(160) if zlib.crc32(str(i).encode()) % 4 == 2]
    assert all(got[i].held_out for i in held)
    assert sum(got[i].lang_pred == data[i][2] for i in held) >= 0.95 * len(held)
    assert [got[i].lang_pred for i in (900, 901, 902)] == ["und"] * 3 and got[None].lang_pred == "xx"
    assert all(0 <= r.score <= 1 for r in got.values())
    assert not langid.identify(corpus.frame(spark, []), s).collect()
    assert {r.lang_pred for r in langid.identify(corpus.frame(spark, [(1, "abc", None, "s", 0, 1, 2, 3, 4, 5, 6, 7)]), s).collect()} == {"und"}


def test_column_bytes_handles_slices_and_nulls():
    from newstide.llm.text import ALNUM, column_bytes, spans, word_hashes

    column = pa.chunked_array([pa.array(["x", None, "a bé"]), pa.array(["", "a"])])
    buf, bounds = column_bytes(column)
    assert buf.tobytes() == "xa béa".encode() and bounds.tolist() == [0, 1, 1, 6, 6, 7]
    s, e, rows = spans(buf, bounds)
    assert [buf[a:b].tobytes().decode() for a, b in zip(s, e, strict=True)] == ["x", "a", "bé", "a"] and rows.tolist() == [0, 1, 1, 3, 3, 4]
    h = word_hashes(buf, s, e)
    assert h[1] == h[3] and len(set(h.tolist())) == 3
    assert column_bytes(pa.array(["q", "ab"])[1:])[0].tobytes() == b"ab"
    assert len(spans(*column_bytes(pa.array([], pa.string())), ALNUM)[0]) == 0
