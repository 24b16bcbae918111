"""Porter's stemmer as column expressions: M. F. Porter, An algorithm for suffix stripping, Program 14(3), 1980.

A y after a consonant is a vowel, any other a consonant. The latter are written
Y first, so that what a step asks of a stem (its measure m, a vowel in it, its
last letters) is one pattern over letters. Steps cut at the end only, so the
letters that stay keep their kind. Each step's word is bound once, by a lambda
over an array of one, as a plain nest of columns would double at every step.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

V, C = "[aeiouy]", "[^aeiouy]"
CONSONANT_Y = f"(^|{V})y"
#: A stem's measure m counts its changes from vowels to consonants.
OVER_0, OVER_1, IS_1 = f"^{C}*{V}+{C}", f"^{C}*{V}+{C}+{V}+{C}", f"^{C}*{V}+{C}+{V}*$"
#: Consonant, vowel, consonant, the last neither w, x nor y.
CVC = f"{C}{V}[^aeiouwxyY]$"

#: The paper's suffixes and what takes their place, by step.
PLURALS = {"sses": "ss", "ies": "i", "ss": "ss", "s": ""}
DOUBLE_SUFFIXES = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al",
    "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al",
    "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble",
}
ENDINGS = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
LAST_SUFFIXES = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize"]


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def _shorter(word: Column, letters: Column | int) -> Column:
    return F.left(word, F.length(word) - letters)


def _ending(word: Column, suffixes) -> Column:
    """The longest suffix that ends the word, or nothing: a match at the end that starts first is the longest."""
    return F.regexp_extract(word, f"({'|'.join(suffixes)})$", 1)


def _replaced(word: Column, rules: dict[str, str], measure: str) -> Column:
    """The longest suffix alone decides, whether or not its stem has the measure."""
    new = F.create_map(*[F.lit(x) for rule in rules.items() for x in rule])

    def decided(suffix):
        return bound(_shorter(word, F.length(suffix)), lambda stem: F.when((suffix != "") & stem.rlike(measure), F.concat(stem, F.try_element_at(new, suffix))).otherwise(word))

    return bound(_ending(word, rules), decided)


def plurals(word: Column) -> Column:
    return _replaced(word, PLURALS, "")


def _mended(stem: Column) -> Column:
    e = F.concat(stem, F.lit("e"))
    return F.when(stem.rlike("(at|bl|iz)$"), e).when(stem.rlike(r"([^aeiouylsz])\1$"), _shorter(stem, 1)).when(stem.rlike(IS_1) & stem.rlike(CVC), e).otherwise(stem)


def participles(word: Column) -> Column:
    def decided(suffix):
        eed = F.when(_shorter(word, 3).rlike(OVER_0), _shorter(word, 1)).otherwise(word)
        other = bound(_shorter(word, F.length(suffix)), lambda stem: F.when(stem.rlike(V), _mended(stem)).otherwise(word))
        return F.when(suffix == "", word).when(suffix == "eed", eed).otherwise(other)

    return bound(_ending(word, ("eed", "ed", "ing")), decided)


def final_y(word: Column) -> Column:
    return F.when(word.rlike(f"{V}.*[yY]$"), F.concat(_shorter(word, 1), F.lit("i"))).otherwise(word)


def double_suffixes(word: Column) -> Column:
    return _replaced(word, DOUBLE_SUFFIXES, OVER_0)


def endings(word: Column) -> Column:
    return _replaced(word, ENDINGS, OVER_0)


def last_suffixes(word: Column) -> Column:
    def decided(suffix):
        kept = lambda stem: (suffix != "") & stem.rlike(OVER_1) & ((suffix != "ion") | stem.rlike("[st]$"))
        return bound(_shorter(word, F.length(suffix)), lambda stem: F.when(kept(stem), stem).otherwise(word))

    return bound(_ending(word, LAST_SUFFIXES), decided)


def final_e(word: Column) -> Column:
    goes = lambda stem: stem.rlike(OVER_1) | (stem.rlike(IS_1) & ~stem.rlike(CVC))
    return F.when(word.endswith("e"), bound(_shorter(word, 1), lambda stem: F.when(goes(stem), stem).otherwise(word))).otherwise(word)


def final_ll(word: Column) -> Column:
    return F.when(word.endswith("ll") & word.rlike(OVER_1), _shorter(word, 1)).otherwise(word)


#: The paper's steps 1a, 1b, 1c, 2, 3, 4, 5a and 5b, each a function of a word whose consonant y are Y.
STEPS = [plurals, participles, final_y, double_suffixes, endings, last_suffixes, final_e, final_ll]


def porter(token: Column | str) -> Column:
    """The stem of a lower-case token.

    Tokens of one or two letters, and those with anything but a-z, are their
    own stems; null gives null.
    """
    t = F.col(token) if isinstance(token, str) else token

    def stem(word):
        out = F.regexp_replace(word, CONSONANT_Y, "$1Y")
        for step in STEPS:
            out = bound(out, step)
        return F.when(word.rlike("^[a-z]{3,}$"), F.lower(out)).otherwise(word)

    return bound(t, stem)


def _cut(word: str, suffixes) -> tuple[str, str]:
    """The stem and the longest suffix that ends the word, or nothing."""
    found = max((x for x in suffixes if word.endswith(x)), key=len, default="")
    return word[: len(word) - len(found)], found


#: The patterns that a stem is asked for.
ASKED = {p: re.compile(p) for p in (V, OVER_0, OVER_1, IS_1, CVC, CONSONANT_Y, f"{V}.*[yY]$", "(at|bl|iz)$", r"([^aeiouylsz])\1$", "^[a-z]{3,}$")}


def stem(token: str) -> str:
    """``porter`` of one token."""
    has = lambda x, pattern: ASKED[pattern].search(x) is not None
    if not has(token, "^[a-z]{3,}$"):
        return token

    def replaced(x: str, rules: dict[str, str], measure: str) -> str:
        left, suffix = _cut(x, rules)
        return left + rules[suffix] if suffix and (not measure or has(left, measure)) else x

    x = replaced(ASKED[CONSONANT_Y].sub(r"\1Y", token), PLURALS, "")
    left, suffix = _cut(x, ("eed", "ed", "ing"))
    if suffix == "eed":
        x = x[:-1] if has(left, OVER_0) else x
    elif suffix and has(left, V):
        short = not has(left, r"([^aeiouylsz])\1$") and has(left, IS_1) and has(left, CVC)
        x = left + "e" if has(left, "(at|bl|iz)$") or short else left[:-1] if has(left, r"([^aeiouylsz])\1$") else left
    x = x[:-1] + "i" if has(x, f"{V}.*[yY]$") else x
    x = replaced(replaced(x, DOUBLE_SUFFIXES, OVER_0), ENDINGS, OVER_0)
    left, suffix = _cut(x, LAST_SUFFIXES)
    x = left if suffix and has(left, OVER_1) and (suffix != "ion" or left.endswith(("s", "t"))) else x
    if x.endswith("e") and (has(x[:-1], OVER_1) or (has(x[:-1], IS_1) and not has(x[:-1], CVC))):
        x = x[:-1]
    x = x[:-1] if x.endswith("ll") and has(x, OVER_1) else x
    return x.lower()


#: Words whose stems a task remembers.
REMEMBERED = 500_000


def stemmed_words(rows: DataFrame, words: str) -> DataFrame:
    """``rows`` with the column ``words``, arrays of tokens without nulls, as arrays of their stems: a task stems a word once for as many as it remembers."""
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(rows.schema)

    def run(batches):
        known: dict[str, str] = {}
        for batch in batches:
            lists = batch.column(words)
            code = lists.flatten().dictionary_encode()
            if len(known) > REMEMBERED:
                known.clear()
            stems = []
            for word in code.dictionary.to_pylist():
                if word not in known:
                    known[word] = stem(word)
                stems.append(known[word])
            sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            out = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(stems, pa.string()).take(code.indices))
            yield pa.RecordBatch.from_arrays([out if c == words else batch.column(c) for c in arrow.names], names=arrow.names)

    return rows.mapInArrow(run, rows.schema)
