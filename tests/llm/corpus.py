"""A small corpus with what breaks things: nulls, empty and long texts, ties, repeated rows, clashing columns."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, g int, p int, part int, node long, label int, count long, block int"


def words(rnd, n):
    return " ".join(rnd.choice(["alpha", "Beta", "gamma", "delta", "eps", "zeta", "eta", "theta", "iota", "kappa", "la", "mu"]) + rnd.choice(["", "", "s", "x"]) for _ in range(n))


def rows(seed=0, n=40):
    rnd = random.Random(seed)
    shared = words(rnd, 30)
    out = []
    for i in range(n):
        text = words(rnd, rnd.randint(1, 80))
        if i % 5 == 0:
            text = f"{text} {shared} {words(rnd, 5)}"
        if i % 9 == 0 and out:
            text = out[rnd.randrange(len(out))][1]
        out.append((i * 3, text, rnd.choice(["en", "de", None]), rnd.choice(["a", "a", "b", None])))
    out += [(500, None, None, None), (501, "", "en", "a"), (502, " \t\n ", "en", "b"), (503, shared * 1, "en", "a"), (504, "é ü 日本 " * 9 + shared, "de", "b"), (505, words(rnd, 6000), "en", "a"), (506, "one", "en", "a")]
    out += [out[3], out[3], (None, shared, "en", "a"), (None, "loner words", None, None)]
    return [(i, t, lang, s, len(t or ""), 1, 2, 3, 4, 5, 6, 7) for i, t, lang, s in out]


def frame(spark, data=None):
    return spark.createDataFrame(rows() if data is None else data, SCHEMA).repartition(5)


def docs_of(pairs):
    return [(i, t, "en", "a", len(t or ""), 1, 2, 3, 4, 5, 6, 7) for i, t in pairs]
