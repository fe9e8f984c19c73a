"""Full-text terms: word tokens, stop words and English stems.

Tokens, stop words and duplicates are handled by native expressions. Stems come
from a small helper behind an Arrow function that looks only at the distinct
words of a batch; a chain of native array transforms was measured at about 30
microseconds per word and lost by far.
"""

from __future__ import annotations

import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, SparkSession, functions as F, types as T

from cinderlog.fixed import (
    STEM_KEPT_AFTER_PLURAL,
    STEM_R1_PREFIX,
    STEM_STEP2,
    STEM_STEP3,
    STEM_STEP4,
    STEM_WHOLE,
    STOP_WORDS,
)

_LETTER = r"[\p{L}\p{M}\p{N}]"
WORD = _LETTER + "+"


def tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits; hyphenated words fall into parts."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


_REGION = re.compile("[^aeiouy]*[aeiouy]+[^aeiouy]")
_PREFIX = re.compile(STEM_R1_PREFIX)
_VOWEL = re.compile("[aeiouy]")
_SHORT = re.compile("(?:[^aeiouy][aeiouy][^aeiouywxY]|^[aeiouy][^aeiouy])$")


def _longest(endings):
    return re.compile("(?:" + "|".join(sorted(endings, key=len, reverse=True)) + ")$")


_PLURAL = _longest(["sses", "ied", "ies", "us", "ss", "s"])
_PAST = _longest(["eedly", "ingly", "edly", "eed", "ing", "ed"])
_ENDINGS2, _ENDINGS3, _ENDINGS4 = map(_longest, (STEM_STEP2, STEM_STEP3, STEM_STEP4))


@lru_cache(maxsize=1 << 18)
def stem(word: str) -> str:
    """English Snowball stem of a lower-case word."""
    if len(word) <= 2:
        return word
    if word in STEM_WHOLE:
        return STEM_WHOLE[word]
    # A consonant y is written Y until the end.
    w = "Y" + word[1:] if word[0] == "y" else word
    w = re.sub("([aeiouy])y", r"\1Y", w)
    region = _PREFIX.match(w) or _REGION.match(w)
    r1 = region.end() if region else len(w)
    region = _REGION.match(w, r1)
    r2 = region.end() if region else len(w)

    if m := _PLURAL.search(w):
        found = m.group()
        if found == "sses":
            w = w[:-2]
        elif found in ("ied", "ies"):
            w = w[:-2] if len(w) > 4 else w[:-1]
        elif found == "s" and _VOWEL.search(w[:-2]):
            w = w[:-1]
    if w in STEM_KEPT_AFTER_PLURAL:
        return w

    if m := _PAST.search(w):
        base = w[: m.start()]
        if m.group().startswith("eed"):
            if m.start() >= r1:
                w = base + "ee"
        elif _VOWEL.search(base):
            w = base
            if w.endswith(("at", "bl", "iz")):
                w += "e"
            elif w.endswith(("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")):
                w = w[:-1]
            elif r1 >= len(w) and _SHORT.search(w):
                w += "e"
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in "aeiouy":
        w = w[:-1] + "i"

    if (m := _ENDINGS2.search(w)) and m.start() >= r1:
        found, base = m.group(), w[: m.start()]
        if not (found == "ogi" and not base.endswith("l")) and not (found == "li" and base[-1] not in "cdeghkmnrt"):
            w = base + STEM_STEP2[found]
    if (m := _ENDINGS3.search(w)) and m.start() >= r1 and (m.group() != "ative" or m.start() >= r2):
        w = w[: m.start()] + STEM_STEP3[m.group()]
    if (m := _ENDINGS4.search(w)) and m.start() >= r2 and (m.group() != "ion" or w[m.start() - 1] in "st"):
        w = w[: m.start()]
    last = len(w) - 1
    if w.endswith("e") and (last >= r2 or last >= r1 and not _SHORT.search(w[:-1])):
        w = w[:-1]
    elif w.endswith("ll") and last >= r2:
        w = w[:-1]
    return w.lower()


@F.arrow_udf(T.ArrayType(T.StringType()))
def _stems(words: pa.Array) -> pa.Array:
    """Stem every word of every array; the word list is dictionary-encoded first."""
    coded = words.values.dictionary_encode()
    stemmed = pa.array([None if w is None else stem(w) for w in coded.dictionary.to_pylist()], pa.string())
    return pa.ListArray.from_arrays(words.offsets, stemmed.take(coded.indices))


def stems(words: Column) -> Column:
    """English stems of an array of words; a null array gives an empty one."""
    return _stems(F.coalesce(words, F.array().cast("array<string>")))


def terms(text: Column, config: str = "english") -> Column:
    """Distinct search terms of a text."""
    words = F.array_distinct(tokens(text))
    if config == "simple":
        return words
    if config != "english":
        raise ValueError(f"unknown text configuration {config!r}")
    kept = F.filter(words, lambda w: ~w.isin(STOP_WORDS))
    return F.array_distinct(stems(kept))


def query_terms(keyword: str, config: str = "english") -> list[str]:
    """Terms of a search keyword, found by the expression that makes stored terms."""
    spark = SparkSession.getActiveSession()
    return spark.range(0, 1, 1, 1).select(terms(F.lit(keyword), config).alias("t")).first()["t"]


def _all_in(found: Column, wanted: list[str]) -> Column:
    if not wanted:
        return F.lit(False)
    return F.size(F.array_intersect(F.array(*map(F.lit, wanted)), found)) == len(wanted)


def word_start(word: str) -> str:
    """First two letters with y read as i.

    Stemming leaves them alone (``tying`` becomes ``tie``, ``using`` ``use``),
    so words that differ here cannot share a stem.
    """
    return word[:2].replace("y", "i")


def _words_like(text: Column, pattern: str) -> Column:
    """Distinct words of a text that match from their first letter on."""
    found = F.regexp_extract_all(F.lower(text), F.lit(rf"(?<!{_LETTER})(?:{pattern})"), F.lit(0))
    return F.array_distinct(found)


def matches(text: Column, keyword: str, config: str = "english") -> Column:
    """All terms of ``keyword`` occur in ``text``; a keyword without terms matches nothing.

    One pass over the text picks out the words in question: for ``simple`` the
    terms themselves, for ``english`` all words that start like a wanted stem.
    Only those are stemmed.
    """
    wanted = query_terms(keyword, config)
    if not wanted:
        return F.lit(False)
    if config == "simple":
        return _all_in(_words_like(text, rf"(?:{'|'.join(wanted)})(?!{_LETTER})"), wanted)
    starts = sorted({word_start(t) for t in wanted if len(t) > 1})
    patterns = [s.replace("i", "[iy]") + f"{_LETTER}*" for s in starts]
    patterns += [f"{t}{_LETTER}*" for t in wanted if len(t) == 1]
    near = _words_like(text, "|".join(patterns))
    return _all_in(stems(F.filter(near, lambda w: ~w.isin(STOP_WORDS))), wanted)


def matches_terms(body_terms: Column, keyword: str, config: str = "english") -> Column:
    """The same test against a stored term array."""
    return _all_in(body_terms, query_terms(keyword, config))
