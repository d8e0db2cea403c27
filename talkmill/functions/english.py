"""English lexemes: stop words left out, other words cut to their stems by the public Snowball rules (Porter's second)."""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

# The stop words of the English search configuration.
STOP_WORDS = frozenset("""
i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself
they them their theirs themselves what which who whom this that these those am is are was were be been being have has had
having do does did doing a an the and but if or because as until while of at by for with about against between into through
during before after above below to from up down in out on off over under again further then once here there when where why
how all any both each few more most other some such no nor not only own same so than too very s t can will just don should now
""".split())

# Fixed values of the Snowball rules: words that keep a form of their own, prefixes that end the first region, and suffixes.
OWN_FORMS = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl"}
UNCHANGED = {"sky", "news", "howe", "atlas", "cosmos", "bias", "andes"}
UNCHANGED_LATER = {"inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"}
FIRST_REGION = ("gener", "commun", "arsen")
DOUBLES = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
SECOND = {
    "ization": "ize", "ational": "ate", "fulness": "ful", "ousness": "ous", "iveness": "ive", "tional": "tion", "biliti": "ble", "lessli": "less", "entli": "ent", "ation": "ate", "alism": "al", "aliti": "al",
    "ousli": "ous", "iviti": "ive", "fulli": "ful", "enci": "ence", "anci": "ance", "abli": "able", "izer": "ize", "ator": "ate", "alli": "al", "bli": "ble", "ogi": "og", "li": "",
}
THIRD = {"ational": "ate", "tional": "tion", "alize": "al", "icate": "ic", "iciti": "ic", "ative": "", "ical": "ic", "ness": "", "ful": ""}
FOURTH = ("ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion", "al", "er", "ic")
VOWELS = "aeiouy"


def region(word: str, begin: int) -> int:
    """Where the part after the first consonant that follows a vowel begins, looking from ``begin`` on."""
    found = re.search(r"[aeiouy][^aeiouy]", word[begin:])
    return begin + found.end() if found else len(word)


def short_end(word: str) -> bool:
    """Whether the word ends in a short syllable."""
    return re.search(r"(?:[^aeiouy][aeiouy][^aeiouywxY]|^[aeiouy][^aeiouy])$", word) is not None


def longest(word: str, suffixes) -> str | None:
    return max((s for s in suffixes if word.endswith(s)), key=len, default=None)


@lru_cache(maxsize=100_000)
def stem(word: str) -> str:
    """The stem of a lower-case word; words of one or two letters, and any with other letters' suffixes, stay."""
    if word in OWN_FORMS:
        return OWN_FORMS[word]
    if len(word) < 3 or word in UNCHANGED:
        return word
    w = re.sub(r"(^|[aeiouy])y", r"\1Y", word)
    prefix = next((p for p in FIRST_REGION if w.startswith(p)), None)
    r1 = len(prefix) if prefix else region(w, 0)
    r2 = region(w, r1)
    # plurals
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and re.search(r"[aeiouy]", w[:-2]):
        w = w[:-1]
    if w in UNCHANGED_LATER:
        return w
    # participles
    end = longest(w, ("eedly", "ingly", "edly", "eed", "ing", "ed"))
    if end in ("eed", "eedly"):
        if len(w) - len(end) >= r1:
            w = w[: -len(end)] + "ee"
    elif end and re.search(r"[aeiouy]", w[: -len(end)]):
        w = w[: -len(end)]
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif w.endswith(DOUBLES):
            w = w[:-1]
        elif r1 >= len(w) and short_end(w):
            w += "e"
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in VOWELS:
        w = w[:-1] + "i"
    # suffixes of nouns, adverbs and adjectives, in their regions
    end = longest(w, SECOND)
    if end and len(w) - len(end) >= r1:
        before = w[: -len(end)]
        if not (end == "ogi" and not before.endswith("l")) and not (end == "li" and not before.endswith(tuple("cdeghkmnrt"))):
            w = before + SECOND[end]
    end = longest(w, THIRD)
    if end and len(w) - len(end) >= (r2 if end == "ative" else r1):
        w = w[: -len(end)] + THIRD[end]
    end = longest(w, FOURTH)
    if end and len(w) - len(end) >= r2 and not (end == "ion" and not w[:-3].endswith(("s", "t"))):
        w = w[: -len(end)]
    if w.endswith("e") and (len(w) > r2 or (len(w) > r1 and not short_end(w[:-1]))):
        w = w[:-1]
    elif w.endswith("ll") and len(w) > r2:
        w = w[:-1]
    return w.lower()


def lexeme(word: str) -> str:
    """The stem of a word; '' for a stop word, so that places still count it."""
    return "" if word in STOP_WORDS else stem(word)


@F.pandas_udf(ArrayType(StringType()))
def lexemes(words: pd.Series) -> pd.Series:
    """The lexemes of arrays of words, in their places."""
    return words.map(lambda own: None if own is None else [lexeme(w) for w in own])
