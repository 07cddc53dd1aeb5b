"""Text analysis in built-in functions: tokens, folding, token spans; hashes of document ids; the codec of stored texts; versions."""

from __future__ import annotations

import unicodedata
import zlib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def token_pattern(extra: str = "", separators: str = "") -> str:
    """The pattern of a token: letters and numbers, with extra token characters and without given separators."""
    quote = lambda s: "".join("\\" + c if not c.isalnum() and c != " " else c for c in s)
    body = rf"\p{{L}}\p{{N}}\p{{Co}}{quote(extra)}"
    return f"[{body}&&[^{quote(separators)}]]+" if separators else f"[{body}]+"


def tokens(c: Column, extra: str = "", separators: str = "", least_bytes: int = 2) -> Column:
    """The tokens of a text in order, lower-cased. A token of less than least_bytes bytes counts only if it is all digits; places are numbered after it is dropped."""
    found = F.regexp_extract_all(F.lower(c), F.lit(token_pattern(extra, separators)), F.lit(0))
    return F.filter(found, lambda t: (F.octet_length(t) >= least_bytes) | t.rlike("^[0-9]+$"))


def fold(word: str) -> str:
    """Without diacritics: the canonical decomposition less its combining marks."""
    if word.isascii():
        return word
    return unicodedata.normalize("NFC", "".join(x for x in unicodedata.normalize("NFD", word) if not unicodedata.combining(x)))


@F.pandas_udf(T.StringType())
def fold_of(words: pd.Series) -> pd.Series:
    return words.map(lambda w: None if w is None else fold(w))


def _token_char(c: str, extra: str = "", separators: str = "") -> bool:
    return c not in separators and (c in extra or unicodedata.category(c)[0] in "LN" or unicodedata.category(c) == "Co")


def spans(text: str, extra: str = "", separators: str = "", least_bytes: int = 2) -> list[tuple[str, int, int]]:
    """(token, start, end) of each token of a text, as tokens() finds them; offsets in code points of the text as it is."""
    out, begin = [], None
    for i, c in enumerate(text + "\0"):
        if i < len(text) and _token_char(c, extra, separators):
            begin = i if begin is None else begin
        elif begin is not None:
            t = text[begin:i].lower()
            if len(t.encode()) >= least_bytes or (t.isascii() and t.isdigit()):
                out.append((t, begin, i))
            begin = None
    return out


def words_of(text: str, extra: str = "", separators: str = "", least_bytes: int = 2) -> list[str]:
    return [t for t, _, _ in spans(text, extra, separators, least_bytes)]


def excerpt(text: str, start: int, n: int, extra: str = "", separators: str = "", least_bytes: int = 2) -> str:
    """The part of a text from its token number start to the n-th token from there, as it stands."""
    found = spans(text, extra, separators, least_bytes)[start : start + n]
    return text[found[0][1] : found[-1][2]] if found else ""


def fnv1a(c: Column) -> Column:
    """32-bit FNV-1a of a string's bytes, as a long."""
    raw = F.encode(c, "utf-8")
    n = F.octet_length(c)
    byte = lambda i: F.conv(F.hex(F.substring(raw, i, F.lit(1))), 16, 10).cast("long")
    step = lambda h, b: (h.bitwiseXOR(b) * F.lit(16777619)) % F.lit(4294967296)
    numbers = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(F.transform(numbers, byte), F.lit(2166136261).cast("long"), step)


def shard_of(doc_id: Column, shards: int) -> Column:
    return (fnv1a(doc_id) % F.lit(shards)).cast("int")


def compress(text: str | None) -> bytes | None:
    """0xF8, the size in groups of 7 bits (the last one's top bit set), and a zlib stream."""
    if text is None:
        return None
    raw = text.encode()
    n, groups = len(raw), []
    while n or not groups:
        groups.append(n & 0x7F)
        n >>= 7
    groups[0] |= 0x80
    return bytes([0xF8, *reversed(groups)]) + zlib.compress(raw)


_EMPTY = compress("")


def _stream(blob: bytes) -> int:
    """Where the zlib stream of a compressed text begins, 0 if it is none."""
    if not blob or blob[0] != 0xF8:
        return 0
    size, i = 0, 1
    while i < min(len(blob), 6):
        size = size << 7 | blob[i] & 0x7F
        i += 1
        if blob[i - 1] & 0x80:
            break
    head = blob[i : i + 2]
    return i if size and len(head) == 2 and head[0] == 0x78 and (head[0] * 256 + head[1]) % 31 == 0 else 0


def iscompressed(blob: bytes | None) -> bool | None:
    return None if blob is None else _stream(bytes(blob)) > 0


def _packed(blob: bytes) -> bool:
    """Whether compress() made this: a compressed text, or the blob of the empty text, which iscompressed() doesn't count as one."""
    return _stream(blob) > 0 or blob == _EMPTY


def uncompress(blob: bytes | None) -> str | None:
    """The text; what isn't a compressed text is returned as it is."""
    if blob is None:
        return None
    blob = bytes(blob)
    if blob == _EMPTY:
        return ""
    at = _stream(blob)
    try:
        return (zlib.decompress(blob[at:]) if at else blob).decode("utf-8", "replace")
    except zlib.error:
        return blob.decode("utf-8", "replace")


@F.pandas_udf(T.BinaryType())
def compress_of(c: pd.Series) -> pd.Series:
    return c.map(compress)


@F.pandas_udf(T.BinaryType())
def packed_of(c: pd.Series) -> pd.Series:
    """Bytes of texts, compressed unless they are already."""
    return c.map(lambda b: None if b is None else bytes(b) if _packed(bytes(b)) else compress(bytes(b).decode("utf-8", "replace")))


@F.pandas_udf(T.StringType())
def uncompress_of(c: pd.Series) -> pd.Series:
    return c.map(uncompress)


@F.pandas_udf(T.BooleanType())
def iscompressed_of(c: pd.Series) -> pd.Series:
    return c.map(iscompressed)


@F.pandas_udf(T.BooleanType())
def ispacked_of(c: pd.Series) -> pd.Series:
    """Whether packed_of() would leave a blob as it is."""
    return c.map(lambda b: None if b is None else _packed(bytes(b)))


def version_of(c: Column) -> Column:
    """struct(major, minor, revision) of "1", "1.2" or "1.2.3"; null if it isn't a version. Structs compare in order."""
    parts = F.split(c, r"\.")
    part = lambda i: F.coalesce(F.try_element_at(parts, F.lit(i)), F.lit("0")).cast("int")
    return F.when(c.rlike(r"^[+-]?\d+(\.[+-]?\d+){0,2}$"), F.struct(part(1).alias("major"), part(2).alias("minor"), part(3).alias("revision")))


def compatible(a: Column, b: Column) -> Column:
    return version_of(a)["major"] == version_of(b)["major"]


def newer(a: Column, b: Column) -> Column:
    return version_of(a) > version_of(b)


@F.pandas_udf(T.MapType(T.StringType(), T.DoubleType()))
def unpack_metrics(c: pd.Series) -> pd.Series:
    """Metrics packed as base64 of zlib of JSON."""
    import base64
    import json

    return c.map(lambda x: None if x is None else {k: float(v) for k, v in json.loads(zlib.decompress(base64.b64decode(x))).items()})


@F.pandas_udf(T.StringType())
def pack_metrics(c: pd.Series) -> pd.Series:
    """JSON text -> base64 of zlib."""
    import base64

    return c.map(lambda x: None if x is None else base64.b64encode(zlib.compress(x.encode())).decode())


def si(value: float) -> str:
    """A number with its metric prefix, for display."""
    for limit, unit in ((1e12, "T"), (1e9, "G"), (1e6, "M"), (1e3, "k")):
        if abs(value) >= limit:
            return f"{value / limit:.3g}{unit}"
    return f"{value:.3g}"
