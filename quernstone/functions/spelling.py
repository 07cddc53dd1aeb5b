"""Spelling functions over words: phonetic hash, class-weighted edit distance, edit distance with configurable costs,
transliteration to ASCII, script code. Plain Python on single words, and Arrow-batched column functions that work on
distinct inputs of a batch."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

SILENT, VOWEL, LIP, BACK, TEETH, ASPIRATE, LATERAL, RHOTIC, NASAL, GLIDE, DIGIT, SPACE, OTHER = range(13)
_SYMBOLS = ".ABCDHLRMY9 ?"
_LETTERS = {"aeiou": VOWEL, "bfpvw": LIP, "cgjkqsxz": BACK, "dt": TEETH, "h": SILENT, "l": LATERAL, "r": RHOTIC, "mn": NASAL}


def _classes(initial: bool) -> dict[str, int]:
    found = {c: k for letters, k in _LETTERS.items() for c in letters + letters.upper()}
    found |= {c: GLIDE if initial else VOWEL for c in "yY"} | dict.fromkeys("0123456789", DIGIT) | dict.fromkeys("\t\f\r ", SPACE)
    return found if initial else found | {"'": SILENT}


_FIRST, _MIDDLE = _classes(True), _classes(False)


def phonehash(word: str | None) -> str | None:
    """A word's sound as a string of classes: doubled classes, vowels beside R and L, and some silent letters are left out."""
    if word is None:
        return None
    if len(word) > 2 and word[:2] in ("gn", "kn"):
        word = word[1:]
    out: list[str] = []
    before = spoken = None
    table = _FIRST
    for i, c in enumerate(word):
        tail = word[i + 1 : i + 3]
        if (c == "w" and tail[:1] == "r") or (c == "d" and tail[:1] in ("j", "g") and tail) or (c == "t" and tail == "ch"):
            continue
        k = table.get(chr(ord(c) & 0x7F), OTHER)
        if k == SPACE or (k == OTHER and before != DIGIT):
            continue
        table = _MIDDLE
        if k == VOWEL and spoken in (RHOTIC, LATERAL):
            continue
        if k in (RHOTIC, LATERAL) and spoken == VOWEL:
            del out[-1:]
        before = k
        if k == SILENT:
            continue
        spoken = k
        if not out or out[-1] != _SYMBOLS[k]:
            out.append(_SYMBOLS[k])
    return "".join(out)


def _kind(before: str, c: str) -> int:
    return (_MIDDLE if before else _FIRST).get(c, OTHER)


def _gap(before: str, c: str, after: str) -> int:
    """Cost of one more or one less letter c between two others."""
    k = _kind(before, c)
    if k == SILENT:
        return 1
    if before == c:
        return 10
    if k == VOWEL and "r" in (before, after):
        return 20
    if k == _kind(before, before):
        return 15 if k == VOWEL else 50
    return 100


def _swap(before: str, a: str, b: str) -> int:
    if a == b or (a.isascii() and a.isalpha() and a.swapcase() == b):
        return 0
    x, y = _kind(before, a), _kind(before, b)
    if x == y:
        return 40
    return 75 if LIP <= x <= GLIDE and LIP <= y <= GLIDE else 100


def editdist(a: str | None, b: str | None) -> int | None:
    """Cost of turning a into b, both ASCII; letters of like sound are near, endings of b are cheap, and an a that ends with * needs to match
    a beginning of b only. None for null, -2 for text that isn't ASCII."""
    if a is None or b is None:
        return None
    same = 0
    while same < min(len(a), len(b)) and a[same] == b[same]:
        same += 1
    first, a, b = a[same - 1] if same else "", a[same:], b[same:]
    if not a and not b:
        return 0
    if not a.isascii() or not b.isascii():
        return -2
    if not a:
        return sum(_gap(p, c, n) // 4 for p, c, n in zip([first, *b], b, [*b[1:], ""]))
    if not b:
        return sum(_gap(p, c, n) for p, c, n in zip([first, *a], a, [*a[1:], ""]))
    if a == "*":
        return 0
    cost, last = [0], [first, *b]  # last: the letter that stands before, on the best way to each cell
    for p, c, n in zip([first, *b], b, [*b[1:], ""]):
        cost.append(cost[-1] + _gap(p, c, n))
    prefix = a[-1] == "*"
    body = a[:-1] if prefix else a
    for i, x in enumerate(body):
        ending = i == len(a) - 1
        diagonal = cost[0]
        cost[0] += _gap(a[i - 1] if i else first, x, a[i + 1] if i + 1 < len(a) else "")
        for j, y in enumerate(b, 1):
            after = b[j] if j < len(b) else ""
            add = _gap(last[j - 1], y, after)
            best, via = cost[j - 1] + (add // 4 if ending else add), y
            drop = cost[j] + _gap(last[j], x, after)
            if drop < best:
                best, via = drop, x
            best = min(best, diagonal + _swap(last[j - 1], x, y))
            diagonal = cost[j]
            cost[j], last[j] = best, via
    return min(cost[1:]) if prefix else cost[-1]


def editdist3(a: str | None, b: str | None, costs: dict[tuple[str, str], int] | None = None, insert: int = 100, delete: int = 100, substitute: int = 150) -> int | None:
    """Least cost of turning a into b. costs: (from, to) -> cost, of strings of any length; an empty from is an insertion, an empty to a deletion.
    ("?", "") , ("", "?") and ("?", "?") set the defaults. An a that ends with * needs to match a beginning of b only."""
    if a is None or b is None:
        return None
    costs = dict(costs or {})
    delete, insert, substitute = costs.pop(("?", ""), delete), costs.pop(("", "?"), insert), costs.pop(("?", "?"), substitute)
    prefix = a.endswith("*")
    a = a[:-1] if prefix else a
    by_end = sorted(costs.items())
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) + 1):
        for j in range(len(b) + 1):
            if not i and not j:
                continue
            best = []
            if i:
                best.append(table[i - 1][j] + delete)
            if j:
                best.append(table[i][j - 1] + insert)
            if i and j:
                best.append(table[i - 1][j - 1] + (0 if a[i - 1] == b[j - 1] else substitute))
            best += [table[i - len(x)][j - len(y)] + c for (x, y), c in by_end if len(x) <= i and len(y) <= j and a[i - len(x) : i] == x and b[j - len(y) : j] == y]
            table[i][j] = min(best)
    return min(table[-1]) if prefix else table[-1][-1]


_SPECIAL = {
    " ": "\xa0", "u": "µуў", "Ae": "Ä", "Aa": "Å", "AE": "Æ", "D": "ÐĐΔЂЋЏД", "Oe": "Ö", "x": "×ξ", "O": "ØΌΏΟΩО", "Ue": "Ü", "Th": "ÞΘ", "ss": "ß", "ae": "äæ", "aa": "å", "d": "ðđδдђћџ",
    "oe": "öœ", ":": "÷", "o": "øοωόо", "ue": "ü", "th": "þθ", "Ch": "ĈΧЧ", "ch": "ĉχч", "Gh": "Ĝ", "gh": "ĝ", "Hh": "Ĥ", "hh": "ĥ", "H": "Ħ", "h": "ħ", "i": "ıΐήίηιϊώийіїљѝ", "IJ": "Ĳ",
    "ij": "ĳ", "Jh": "Ĵ", "jh": "ĵ", "k": "ĸκкќ", "L.": "Ŀ", "l.": "ŀ", "L": "ŁΛЛ", "l": "łλл", "'n": "ŉ", "NG": "Ŋ", "ng": "ŋ", "OE": "Œ", "Sh": "ŜШ", "sh": "ŝш", "T": "ŦΤТ", "t": "ŧτт",
    "s": "ſσс", "f": "ƒφф", "A": "ΆΑА", "E": "ΈΕЀЁЄЕЭ", "I": "ΉΊΗΙΪІЇЉЍИЙ", "Y": "ΎΥΫЫЬ", "B": "ΒБ", "G": "ΓЃГ", "Z": "ΖЅЗ", "K": "ΚЌК", "M": "ΜМ", "N": "ΝЊН", "X": "Ξ", "P": "ΠП", "R": "ΡР",
    "S": "ΣС", "F": "ΦФ", "Ps": "Ψ", "a": "άαЪаъ", "e": "έεеэѐёє", "b": "βб", "g": "γгѓ", "z": "ζзѕ", "m": "μм", "n": "νнњ", "p": "πп", "r": "ρр", "y": "υϋύыь", "ps": "ψ", "J": "Ј", "U": "ЎУ",
    "V": "В", "Zh": "Ж", "Kh": "Х", "Tc": "Ц", "Shch": "Щ", "Iu": "Ю", "Ia": "Я", "v": "в", "zh": "ж", "kh": "х", "tc": "ц", "shch": "щ", "iu": "ю", "ia": "я", "j": "ј", "ff": "ﬀ", "fi": "ﬁ",
    "fl": "ﬂ", "st": "ﬅﬆ",
}
_TO_ASCII = {c: t for t, chars in _SPECIAL.items() for c in chars}


@lru_cache(4096)
def _ascii(c: str) -> str:
    if c < "\x80":
        return c
    if c in _TO_ASCII:
        return _TO_ASCII[c]
    plain = "".join(x for x in unicodedata.normalize("NFD", c) if not unicodedata.combining(x))
    return plain if plain.isascii() and plain and (c < "ƀ" or c in "ȘșȚțḂḃḊḋḞḟṀṁṖṗṠṡṪṫẀẁẂẃẄẅỲỳ") else "?"


def translit(word: str | None) -> str | None:
    """The word in ASCII: one to four letters for each other character, ? for an unknown one."""
    return None if word is None else "".join(map(_ascii, word))


def score(distance: int, rank: int) -> int:
    """Distance lowered by the size of the word's frequency, so that common words come first."""
    return distance + 32 - max(rank, 0).bit_length()


def _column(f: Callable, kind: T.DataType) -> Callable[..., Column]:
    """A column function that calls f once for each distinct combination of inputs in a batch."""

    def on_batch(*columns: pd.Series) -> pd.Series:
        memo: dict = {}
        out = []
        for key in zip(*(c.astype(object).where(c.notna(), None) for c in columns)):
            if key not in memo:
                memo[key] = f(*key)
            out.append(memo[key])
        return pd.Series(out, dtype=object)

    if f.__code__.co_argcount == 1:

        @F.pandas_udf(kind)
        def one(a: pd.Series) -> pd.Series:
            return on_batch(a)

        return one

    @F.pandas_udf(kind)
    def two(a: pd.Series, b: pd.Series) -> pd.Series:
        return on_batch(a, b)

    return two


def phonehash_of(c) -> Column:
    return _column(phonehash, T.StringType())(c)


def translit_of(c) -> Column:
    return _column(translit, T.StringType())(c)


def editdist_of(a, b) -> Column:
    return _column(editdist, T.LongType())(a, b)


def editdist3_of(a, b, costs: dict[tuple[str, str], int] | None = None) -> Column:
    return _column(lambda x, y: editdist3(x, y, costs), T.LongType())(a, b)


def score_of(distance: Column, rank: Column) -> Column:
    """score() as an expression."""
    return distance + 32 - F.when(rank > 0, F.length(F.bin(rank))).otherwise(0)


def scriptcode_of(c: Column) -> Column:
    """215 Latin, 220 Cyrillic, 200 Greek, 125 Hebrew, 160 Arabic; 998 for several, 999 for none. Digits alone are Latin."""
    scripts = [(215, r"[A-Za-z'\u0080-ʮ]"), (220, r"[Ѐ-ӿ]"), (200, r"[Ά-ώ]"), (125, r"[֐-׿]"), (160, r"[؀-ۿ]")]
    found = [c.rlike(p) for _, p in scripts]
    n = sum((x.cast("int") for x in found), F.lit(0))
    code = F.when(n > 1, 998)
    for (k, _), x in zip(scripts, found):
        code = code.when(x, k)
    return code.when(c.rlike("[0-9]"), 215).when(c.isNotNull(), 999).cast("int")
