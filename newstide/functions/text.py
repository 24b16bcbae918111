"""Text functions: columns in, columns out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SENTENCE = r"[^.!?\n]+[.!?]?"
#: Letters and digits of every alphabet.
WORD = r"[\p{L}\p{N}]+"

#: Rewrites that mend tokenised newswire text, in order (pattern, replacement).
MENDING = [
    ("[A-Z ]+, [A-Z][a-z ]+\\( [A-Z]+ \\) [-—_]+ ", ""),
    ("^.*?[A-Z ]+, [A-Z][a-z]+ [-—_]+ ", ""),
    ("^.*?[A-Z ]+\\([^\\)]+\\) [-—_]+ ", ""),
    ("^.*?[A-Z]+ +[-—_]+ ", ""),
    ("\\([^)]+\\)", " "),
    ("^ *[-—_]+", ""),
    (" ([,.;?!]+)([\"“”'])", "$1$2"),
    (" ([:-]) ", "$1"),
    ("([^0-9][0-9]{1,3}) , ([0-9][0-9][0-9])([^0-9]|$)", "$1,$2$3"),
    ("^([0-9]{1,3}) , ([0-9][0-9][0-9])([^0-9]|$)", "$1,$2$3"),
    (" ('|’) ([a-z]|ll|ve|re)( |$)", "$1$2 "),
    (" ([',.;?!]+) ", "$1 "),
    (" ([',.;?!]+)$", "$1"),
    ("([0-9]\\.) ([0-9])", "$1$2"),
    ("(a|p)\\. m\\.", "$1.m."),
    ("U\\. (S|N)\\.", "U.$1."),
    ("“ ([^\\s])", "“$1"),
    ("([^\\s]) ”", "$1”"),
    ("‘ ([^\\s])", "‘$1"),
    ("([^\\s]) ’", "$1’"),
    ("â", "'"),
    ("^Photo:Reuters|^Photo:AP", ""),
    ("\n", " "),
]

#: Common words of the fixture's languages; pass another list for other corpora.
STOPWORDS = "a an and are as at be by for from had has have he her his i in is it its not of on or she that the their they this to was were which with you de la le les des et en un une du que qui est dans pour par sur der die das und den von mit ist im ein eine el los las y una se no es".split()

#: Event types by domain.
DOMAIN = {
    "accident": "accidents",
    "shooting": "terrorism",
    "hostage": "terrorism",
    "storm": "natural_disaster",
    "earthquake": "natural_disaster",
    "bombing": "terrorism",
    "conflict": "terrorism",
    "riot": "social_unrest",
    "protest": "social_unrest",
    "impact event": "natural_disaster",
}


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def sentences(text) -> Column:
    return F.regexp_extract_all(_c(text), F.lit(SENTENCE), F.lit(0))


def words(text, pattern: str = WORD) -> Column:
    return F.regexp_extract_all(F.lower(_c(text)), F.lit(pattern), F.lit(0))


def let(value: Column, body) -> Column:
    """``body`` of a value that is evaluated once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def counted(tokens) -> Column:
    """(token, n) of the distinct tokens of an array, in order: runs of the sorted array, so the work is that of a sort."""

    def runs(s):
        starts = F.filter(F.transform(s, lambda x, i: F.when((i == 0) | (x != F.get(s, i - 1)), i)), lambda i: i.isNotNull())
        count = lambda b, k: F.coalesce(F.get(b, k + 1), F.size(s)) - F.get(b, k)
        return let(starts, lambda b: F.transform(b, lambda at, k: F.struct(F.get(s, at).alias("token"), count(b, k).cast("long").alias("n"))))

    return let(F.sort_array(_c(tokens)), runs)


def matches(text, pattern: str) -> Column:
    """How often a pattern occurs."""
    return F.regexp_count(_c(text), F.lit(pattern)).cast("long")


def mended(text) -> Column:
    out = _c(text)
    for pattern, new in MENDING:
        out = F.regexp_replace(out, pattern, new)
    return out


def without_stopwords(tokens, stop: list[str] = STOPWORDS, longest: int = 50) -> Column:
    """Tokens that are neither stop words nor ``longest`` characters or more."""
    stops = F.array(*[F.lit(w) for w in stop])
    return F.filter(_c(tokens), lambda t: ~F.array_contains(stops, t) & (F.length(t) < longest))


def stem(token) -> Column:
    """A light suffix stemmer (an approximation; no dictionary)."""
    out = _c(token)
    for pattern, new in (("(sses)$", "ss"), ("(ies)$", "y"), ("([^s])s$", "$1"), ("(.{3,})(ingly|edly|ing|ed|ly)$", "$1")):
        out = F.regexp_replace(out, pattern, new)
    return out


def entity(token) -> Column:
    """A rule's guess at the kind of a cased token (an approximation): number, capitalised name, or O."""
    t = _c(token)
    return F.when(t.rlike("^[0-9]+$"), "NUMBER").when(t.rlike(r"^\p{Lu}{2,}$"), "ORGANIZATION").when(t.rlike(r"^\p{Lu}\p{Ll}+$"), "PERSON").otherwise("O")


def contains_all(text, terms: list[str]) -> Column:
    """Every term occurs, as a case-insensitive pattern."""
    found = F.lit(True)
    for term in terms:
        found &= _c(text).rlike(f"(?i){term}")
    return found


def contains_any(text, terms: list[str]) -> Column:
    return _c(text).rlike("(?i)" + "|".join(terms))


def simple_quality(text, sentences_in_doc) -> Column:
    """Over nine words in a document of under 200 sentences, with at most one social and one web-language word."""
    # fixed values: the two word lists
    social, web = r"Digg|del\.icio\.us|Facebook|Kwoff|Myspace", "(?i)Flash|JavaScript|CSS"
    return (matches(text, r"\p{L}+") > 9) & (_c(sentences_in_doc) < 200) & (matches(text, social) < 2) & (matches(text, web) < 2)


def ascii_folded(text) -> Column:
    return F.regexp_replace(_c(text), "[^ -~]", "")


def normalised_levenshtein(a, b) -> Column:
    """Edit distance of lower-cased texts by the longer one's length."""
    x, y = F.lower(_c(a)), F.lower(_c(b))
    return F.levenshtein(x, y) / F.greatest(F.length(x), F.length(y), F.lit(1))


def event_name(title) -> Column:
    """Brackets dropped, spaces as underscores, lower case."""
    return F.lower(F.regexp_replace(F.regexp_replace(_c(title), r"[()]", ""), " +", "_"))


def domain(kind) -> Column:
    out = F.lit(None).cast("string")
    for k, d in DOMAIN.items():
        out = F.when(_c(kind) == k, d).otherwise(out)
    return out
