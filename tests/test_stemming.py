"""Porter's stemmer: the published examples of each step, and a letter-by-letter form over all words."""

import pytest
from pyspark.sql import functions as F

from newstide.functions import stemming as P
from newstide.plans.base import Tables

#: The paper's examples by step.
EXAMPLES = {
    "plurals": "caresses caress ponies poni ties ti caress caress cats cat",
    "participles": "feed feed agreed agree plastered plaster bled bled motoring motor sing sing conflated conflate troubled trouble sized size hopping hop tanned tan falling fall hissing hiss fizzed fizz failing fail filing file",
    "final_y": "happy happi sky sky",
    "double_suffixes": "relational relate conditional condition rational rational valenci valence hesitanci hesitance digitizer digitize conformabli conformable radicalli radical differentli different vileli vile "
    "analogousli analogous vietnamization vietnamize predication predicate operator operate feudalism feudal decisiveness decisive hopefulness hopeful callousness callous formaliti formal sensitiviti sensitive sensibiliti sensible",
    "endings": "triplicate triplic formative form formalize formal electriciti electric electrical electric hopeful hope goodness good",
    "last_suffixes": "revival reviv allowance allow inference infer airliner airlin gyroscopic gyroscop adjustable adjust defensible defens irritant irrit replacement replac adjustment adjust dependent depend "
    "adoption adopt homologou homolog communism commun activate activ angulariti angular homologous homolog effective effect bowdlerize bowdler",
    "final_e": "probate probat rate rate cease ceas",
    "final_ll": "controll control roll roll",
}


@pytest.mark.parametrize("step", P.STEPS, ids=lambda f: f.__name__)
def test_published_examples(spark, step):
    words = EXAMPLES[step.__name__].split()
    pairs = spark.createDataFrame(list(zip(words[::2], words[1::2], strict=True)), "word string, want string")
    marked = F.regexp_replace("word", P.CONSONANT_Y, "$1Y")
    got = pairs.select("word", "want", F.lower(P.bound(marked, step)).alias("got")).collect()
    assert [r for r in got if r.got != r.want] == []


def consonants(word):
    """For each letter whether it's a consonant."""
    out = []
    for k, c in enumerate(word):
        out.append(c not in "aeiou" and (c != "y" or k == 0 or not out[-1]))
    return out


def measure(stem):
    kinds = consonants(stem)
    return sum(b and not a for a, b in zip(kinds, kinds[1:], strict=False))


def cvc(stem):
    return len(stem) > 2 and consonants(stem)[-3:] == [True, False, True] and stem[-1] not in "wxy"


def doubled(stem):
    return len(stem) > 1 and stem[-1] == stem[-2] and consonants(stem)[-1]


def suffix_of(word, suffixes):
    return max((s for s in suffixes if word.endswith(s)), key=len, default=None)


def swap(word, rules, least):
    s = suffix_of(word, rules)
    if s is None or measure(word[: len(word) - len(s)]) < least:
        return word
    return word[: len(word) - len(s)] + rules[s]


def plain(word):
    if len(word) < 3 or not (word.isascii() and word.isalpha()):
        return word
    word = swap(word, P.PLURALS, 0)
    s = suffix_of(word, ("eed", "ed", "ing"))
    if s == "eed":
        word = word[:-1] if measure(word[:-3]) > 0 else word
    elif s and not all(consonants(word[: -len(s)])):
        word = word[: -len(s)]
        if word.endswith(("at", "bl", "iz")):
            word += "e"
        elif doubled(word) and word[-1] not in "lsz":
            word = word[:-1]
        elif measure(word) == 1 and cvc(word):
            word += "e"
    if word.endswith("y") and not all(consonants(word[:-1])):
        word = word[:-1] + "i"
    word = swap(swap(word, P.DOUBLE_SUFFIXES, 1), P.ENDINGS, 1)
    s = suffix_of(word, P.LAST_SUFFIXES)
    if s and measure(word[: -len(s)]) > 1 and (s != "ion" or word[:-3].endswith(("s", "t"))):
        word = word[: -len(s)]
    if word.endswith("e"):
        m = measure(word[:-1])
        if m > 1 or (m == 1 and not cvc(word[:-1])):
            word = word[:-1]
    return word[:-1] if word.endswith("ll") and measure(word) > 1 else word


def test_all_words_as_letter_by_letter(spark, sf):
    got = Tables(spark, sf).tokens.select("token").distinct().select("token", P.porter("token").alias("stem")).collect()
    assert len(got) > 500
    assert [(r.token, r.stem, plain(r.token)) for r in got if r.stem != plain(r.token)] == []


def test_odd_words(spark):
    odd = ["", "y", "yy", "yyy", "syzygy", "sayyy", "yay", "ying", "eed", "ion", "s", "as", "sky", "größe", "abc1", "e", "lle", "generalizations", "oscillators", "a" * 5000 + "ing", None]
    rows = spark.createDataFrame([(w,) for w in odd], "token string").select("token", P.porter("token").alias("stem")).collect()
    got = {r.token: r.stem for r in rows}
    assert got == {w: None if w is None else plain(w) for w in odd}
    assert (got["generalizations"], got["oscillators"]) == ("gener", "oscil")


def test_stems_in_rows_are_the_columns(spark, sf):
    """Of every token of the tables and of made-up ones, in whatever batch and row."""
    from newstide.functions import stemming
    from newstide.plans.base import Tables

    import random

    rnd, parts = random.Random(0), ["y", "ee", "ll", "bb", "at", "iz", "s", *"aeiouwxtl", *stemming.DOUBLE_SUFFIXES, *stemming.ENDINGS, *stemming.LAST_SUFFIXES, *stemming.PLURALS, "ed", "ing", "eed"]
    made = ["".join(rnd.choice(parts) for _ in range(rnd.randint(1, 5))) for _ in range(3000)]
    tokens = Tables(spark, sf).tokens.select("token").distinct().union(spark.createDataFrame([(w,) for w in [*made, "été", "a1", "日本"]], "token string"))
    wrong = tokens.select("token", stemming.porter("token").alias("want")).toPandas()
    assert [w for w in wrong.itertuples() if stemming.stem(w.token) != w.want] == []
    rows = spark.createDataFrame([(1, ["ponies", "x", "ponies"]), (2, []), (3, ["flies"])], "k int, w array<string>")
    assert sorted((r.k, r.w) for r in stemming.stemmed_words(rows, "w").collect()) == [(1, ["poni", "x", "poni"]), (2, []), (3, ["fli"])]
