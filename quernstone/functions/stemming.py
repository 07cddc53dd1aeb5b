"""The English (Porter2) and German stemmers, and the chain of stemmers that the analyser applies to tokens of 3 to 40 bytes. Stemmers are registered by
language; a chain takes the first whose result has another length, else the last one's."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

V = "aeiouy"
_DOUBLE = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
_FIXED = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl"}
_FIXED |= dict(zip(*[("sky", "news", "howe", "atlas", "cosmos", "bias", "andes")] * 2))
_FIXED_1A = ("inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed")
_STEP2 = {"tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ational": "ate", "ation": "ate", "ator": "ate", "alism": "al", "aliti": "al", "alli": "al", "fulness": "ful", "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble", "fulli": "ful", "lessli": "less", "ogi": "og", "li": ""}
_STEP3 = {"ational": "ate", "tional": "tion", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": "", "ative": ""}
_STEP4 = ("ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion", "al", "er", "ic")


def _region(w: str, start: int) -> int:
    m = re.compile(f"[{V}][^{V}]").search(w, start)
    return m.end() if m else len(w)


def _short(w: str) -> bool:
    """Whether the word ends in a short syllable."""
    return bool(re.search(rf"(^[{V}][^{V}]|[^{V}][{V}][^{V}wxY])$", w))


def _longest(w: str, suffixes) -> str:
    return max((s for s in suffixes if w.endswith(s)), key=len, default="")


def english(word: str) -> str:
    if len(word) <= 2:
        return word
    w = word.replace("’", "'").replace("‘", "'").removeprefix("'")
    if w in _FIXED:
        return _FIXED[w]
    w = re.sub(rf"(^|(?<=[{V}]))y", "Y", w)
    head = next((len(p) for p in ("gener", "commun", "arsen") if w.startswith(p)), None)
    r1 = head if head is not None else _region(w, 0)
    r2 = _region(w, r1)
    w = w[: len(w) - len(_longest(w, ("'s'", "'s", "'")))]
    # plurals
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and re.search(f"[{V}]", w[:-2]):
        w = w[:-1]
    if w in _FIXED_1A:
        return w.replace("Y", "y")
    # past and progressive forms
    s = _longest(w, ("eedly", "ingly", "edly", "eed", "ing", "ed"))
    if s in ("eed", "eedly"):
        if len(w) - len(s) >= r1:
            w = w[: -len(s)] + "ee"
    elif s and re.search(f"[{V}]", w[: -len(s)]):
        w = w[: -len(s)]
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif w.endswith(_DOUBLE):
            w = w[:-1]
        elif r1 >= len(w) and _short(w):
            w += "e"
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in V:
        w = w[:-1] + "i"
    s = _longest(w, _STEP2)
    if s and len(w) - len(s) >= r1:
        ok = {"ogi": w[-4:-3] == "l", "li": w[-3:-2] in tuple("cdeghkmnrt")}.get(s, True)
        if ok:
            w = w[: -len(s)] + _STEP2[s]
    s = _longest(w, _STEP3)
    if s and len(w) - len(s) >= (r2 if s == "ative" else r1):
        w = w[: -len(s)] + _STEP3[s]
    s = _longest(w, _STEP4)
    if s and len(w) - len(s) >= r2 and (s != "ion" or w[-4:-3] in ("s", "t")):
        w = w[: -len(s)]
    if w.endswith("e"):
        if len(w) - 1 >= r2 or (len(w) - 1 >= r1 and not _short(w[:-1])):
            w = w[:-1]
    elif w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.replace("Y", "y")


_GERMAN, _S_ENDING, _ST_ENDING = "aeiouyäöü", "bdfghklmnrt", "bdfghklmnt"


def german(word: str) -> str:
    """The published German stemmer: three steps over the regions after the first and second consonant that follows a vowel."""
    w = word.replace("ß", "ss")
    w = re.sub(f"(?<=[{_GERMAN}])[uy](?=[{_GERMAN}])", lambda m: m.group().upper(), w)
    region = lambda start: m.end() if (m := re.compile(f"[{_GERMAN}][^{_GERMAN}]").search(w, start)) else len(w)
    first = region(0)
    second = region(first)
    first = max(first, 3)

    def within(suffix: str, start: int) -> bool:
        return w.endswith(suffix) and len(w) - len(suffix) >= start

    end = _longest(w, ("em", "ern", "er", "e", "en", "es", "s"))
    if end and within(end, first) and (end != "s" or w[-2:-1] in tuple(_S_ENDING)):
        w = w[: -len(end)]
        if end in ("e", "en", "es") and w.endswith("niss"):
            w = w[:-1]
    end = _longest(w, ("en", "er", "est", "st"))
    if end and within(end, first) and (end != "st" or (len(w) >= 6 and w[-3] in _ST_ENDING)):
        w = w[: -len(end)]
    end = _longest(w, ("end", "ung", "ig", "ik", "isch", "lich", "heit", "keit"))
    if end and within(end, second):
        if end in ("ig", "ik", "isch"):
            w = w if w[: -len(end)].endswith("e") else w[: -len(end)]
        else:
            w = w[: -len(end)]
            if end in ("end", "ung") and within("ig", second) and not w[:-2].endswith("e"):
                w = w[:-2]
            elif end in ("lich", "heit") and (within("er", first) or within("en", first)):
                w = w[:-2]
            elif end == "keit":
                more = _longest(w, ("lich", "ig"))
                w = w[: -len(more)] if more and within(more, second) else w
    return w.lower().translate(str.maketrans("äöü", "aou"))


STEMMERS: dict[str, Callable[[str], str]] = {"english": english, "german": german}


def register(language: str, stemmer: Callable[[str], str]) -> None:
    STEMMERS[language] = stemmer


def stem(token: str, languages: tuple[str, ...] = ("english",)) -> str:
    """The chain applied to one token."""
    size = len(token.encode())
    if not 3 <= size <= 40:
        return token
    out = token
    for name in languages:
        out = STEMMERS[name](token)
        if len(out.encode()) != size:
            break
    return out


def stem_of(c, languages: tuple[str, ...] = ("english",)) -> Column:
    """Stems of a column of tokens; best applied to distinct terms, see stemmed()."""
    chain = tuple((n, STEMMERS[n]) for n in languages)

    @F.pandas_udf(T.StringType())
    def run(tokens: pd.Series) -> pd.Series:
        for n, f in chain:
            STEMMERS.setdefault(n, f)
        one = lru_cache(200_000)(lambda t: stem(t, languages))
        return tokens.map(lambda t: None if t is None else one(t))

    return run(c)


def stemmed(rows: DataFrame, term: str = "term", languages: tuple[str, ...] = ("english",)) -> DataFrame:
    """rows with `term` stemmed: each distinct term is stemmed once, and joined back."""
    stems = rows.select(term).distinct().select(term, stem_of(term, languages).alias("__stem"))
    return rows.join(stems, term).withColumn(term, F.col("__stem")).drop("__stem").select(*rows.columns)
