"""Byte-level BPE encoding and decoding (operator 8) by two tiers: a minimal perfect hash over the vocabulary resolves whole
pre-tokens that are in it; what misses is merged with a heap over a linked list of its bytes.

Each match of the pattern is encoded separately and without special tokens, so their strings are ordinary text. Null counts as
empty and has no tokens. Texts of any length are encoded whole. Repeated rows are encoded alike; an empty table gives an empty result;
other columns, whatever their names, play no part. The vocabulary file's path is a parameter; the driver reads it, builds the
hash and sends both to the workers by broadcast, whose size is the vocabulary's (a few MB), whatever the corpus.

A worker remembers pre-tokens it has met. Beyond MEMO_BYTES it forgets those it has seen least, so frequent ones are never merged again;
what is remembered changes no result."""

from __future__ import annotations

import base64
import functools
import hashlib
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.llm.common import U64, by_bytes, mix, text_of, text_pieces, tidily
from quernstone.session import table

#: Memory for the pre-tokens that a worker remembers: about WORD_BYTES and the word's length for each.
MEMO_BYTES, WORD_BYTES = 64 << 20, 190
CHUNK = 1 << 20


class PerfectHash:
    """A minimal perfect hash (hash and displace): as many slots as keys. Keys go to buckets by one hash; each bucket of
    several keys has a displacement that sends all to free slots, a bucket of one key has its slot itself."""

    def __init__(self, keys: list[bytes]):
        self.n = n = len(keys)
        self.buckets = max(1, n // 2)
        h = self._hash(keys)
        bucket = (h % U64(self.buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        sizes = np.bincount(bucket, minlength=self.buckets)
        ends = np.cumsum(sizes)
        self.shift = np.zeros(self.buckets, np.int64)
        taken, self.slot_key = np.zeros(max(n, 1), bool), np.full(max(n, 1), -1, np.int64)
        big = np.argsort(-sizes, kind="stable")
        for b in big[sizes[big] > 1].tolist():
            own = order[ends[b] - sizes[b] : ends[b]]
            hb, d = h[own], 1
            while True:
                slots = self._slot(hb, np.array([d], U64))
                if not taken[slots].any() and len(set(slots.tolist())) == len(slots):
                    break
                d += 1
            taken[slots], self.slot_key[slots], self.shift[b] = True, own, d
        free = np.flatnonzero(~taken)
        single = big[sizes[big] == 1]
        own = order[ends[single] - 1]
        self.slot_key[free[: len(single)]], self.shift[single] = own, -free[: len(single)] - 1
        self.keys = [keys[i] if i >= 0 else b"" for i in self.slot_key.tolist()]

    @staticmethod
    def _hash(keys: list[bytes]) -> np.ndarray:
        data = np.frombuffer(b"".join(keys) + b"\0", np.uint8).astype(U64) + U64(1)
        lens = np.fromiter(map(len, keys), np.int64, len(keys))
        ends = np.cumsum(lens)
        place = np.arange(len(data) - 1) - np.repeat(ends - lens, lens)
        most = int(lens.max(initial=0))
        power = np.cumprod(np.full(most + 1, U64(0x9E3779B97F4A7C15)), dtype=U64)
        sums = np.concatenate([[U64(0)], np.cumsum(mix(data[:-1] * power[place]), dtype=U64)])
        return mix(sums[ends] - sums[ends - lens] + lens.astype(U64))

    def _slot(self, h: np.ndarray, d) -> np.ndarray:
        return (mix(h + d * U64(0x9E3779B97F4A7C15)) % U64(self.n)).astype(np.int64)

    def find(self, tokens: list[bytes]) -> np.ndarray:
        """The key number of each token, -1 for one that is no key; the found key is compared byte by byte."""
        if not tokens or not self.n:
            return np.full(len(tokens), -1, np.int64)
        h = self._hash(tokens)
        d = self.shift[(h % U64(self.buckets)).astype(np.int64)]
        slot = np.where(d < 0, -d - 1, self._slot(h, np.maximum(d, 0).astype(U64)))
        keys = self.keys
        same = np.fromiter((keys[s] == t for s, t in zip(slot.tolist(), tokens)), bool, len(tokens))
        return np.where(same, self.slot_key[slot], -1)


def _grown(a: np.ndarray, n: int) -> np.ndarray:
    if n <= len(a):
        return a
    out = np.zeros(max(n, 2 * len(a)), a.dtype)
    out[: len(a)] = a
    return out


class Tokenizer:
    """Plain arrays and lists once built, so that it can be sent to workers."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        keys = list(ranks)
        pairs = []
        for key, r in ranks.items():  # ids of the halves of each token -> its id
            for i in range(1, len(key)):
                a, b = ranks.get(key[:i]), ranks.get(key[i:])
                if a is not None and b is not None:
                    pairs.append((a, b, r))
        rank_of_key = np.fromiter(ranks.values(), np.int64, len(keys))
        self.__setstate__((pattern, PerfectHash(keys), rank_of_key, [ranks[bytes([i])] for i in range(256)], np.array(pairs, np.int64).reshape(-1, 3)))

    def __getstate__(self):
        return self.pattern, self.hash, self.rank_of_key, self.byte, self.pairs

    def __setstate__(self, state) -> None:
        import regex

        self.pattern, self.hash, self.rank_of_key, self.byte, self.pairs = state
        self.split = regex.compile(self.pattern).findall
        keys, slots = self.hash.keys, np.argsort(self.hash.slot_key)
        self.ranks = {keys[s]: r for s, r in zip(slots.tolist(), self.rank_of_key.tolist())}
        self.token = {r: b for b, r in self.ranks.items()}
        nothing: dict[int, int] = {}
        self.after: list[dict[int, int]] = [nothing] * (max(self.token, default=0) + 1)  # id -> {next id -> id of both}
        for a, b, r in self.pairs.tolist():
            if self.after[a] is nothing:
                self.after[a] = {}
            self.after[a][b] = r
        self.bytes = [[self.after[a].get(b, -1) for b in self.byte] for a in self.byte]  # the same by byte values
        self.trim(0)

    def trim(self, limit: int) -> None:
        """Keeps what fits in limit bytes of the words seen most often; counts are halved, so that what was frequent once ages."""
        kept: list[str] = []
        if limit and self.memo:
            words = list(self.memo)
            order = np.argsort(-self.seen[: len(words)], kind="stable")
            size = np.cumsum(np.array([WORD_BYTES + len(words[i]) for i in order]))
            order = order[: int(np.searchsorted(size, limit, side="right"))]
            order = order[self.seen[order] > 1]
            kept = [words[i] for i in order]
            first, lens = self.start[order], self.start[order + 1] - self.start[order]
            ends = np.cumsum(lens)
            flat = self.flat[np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - lens - first, lens)]
            seen = self.seen[order] >> 1
        self.memo: dict[str, int] = dict(zip(kept, range(len(kept))))
        self.held = sum(map(len, kept)) + WORD_BYTES * len(kept)
        self.flat, self.start, self.seen = np.empty(1 << 16, np.uint32), np.zeros(1 << 15, np.int64), np.zeros(1 << 15, np.int64)
        if kept:
            n = len(kept)
            self.flat, self.start, self.seen = _grown(self.flat, len(flat)), _grown(self.start, n + 1), _grown(self.seen, n)
            self.flat[: len(flat)], self.start[1 : n + 1], self.seen[:n] = flat, ends, seen

    def merge(self, word: bytes) -> list[int]:
        """Merges the pair of least rank, leftmost first, until none is left: a heap of (rank, left) over linked nodes. An entry
        is stale if its left node is gone or the pair there has another rank by now."""
        byte, two, n = self.byte, self.bytes, len(word)
        now = [two[a][b] for a, b in zip(word, word[1:])]  # rank of the pair that begins at a node
        heap = [r * n + i for i, r in enumerate(now) if r >= 0]  # one number for (rank, left)
        ids = [byte[b] for b in word]
        if not heap:
            return ids
        now.append(-1)
        heapify(heap)
        following = self.after
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while heap:
            e = heappop(heap)
            r = e // n
            i = e - r * n
            if now[i] != r:
                continue
            j = after[i]
            ids[i], ids[j], now[j] = r, -1, -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                x = now[i] = following[r].get(ids[k], -1)
                if x >= 0:
                    heappush(heap, x * n + i)
            else:
                now[i] = -1
            h = before[i]
            if h >= 0:
                x = now[h] = following[ids[h]].get(r, -1)
                if x >= 0:
                    heappush(heap, x * n + h)
        return [x for x in ids if x >= 0]

    def _learn(self, words: list[str]) -> None:
        raw = [w.encode() for w in words]
        hit = self.hash.find(raw)
        flat, lens, merge = [], [], self.merge
        for b, r in zip(raw, np.where(hit >= 0, self.rank_of_key[hit], -1).tolist()):
            if r >= 0:
                flat.append(r)
                lens.append(1)
            else:
                ids = merge(b)
                flat += ids
                lens.append(len(ids))
        n = len(self.memo)
        self.memo.update(zip(words, range(n, n + len(words))))
        self.held += sum(map(len, words)) + WORD_BYTES * len(words)
        end = int(self.start[n])
        self.flat, self.start, self.seen = _grown(self.flat, end + len(flat)), _grown(self.start, n + len(words) + 1), _grown(self.seen, n + len(words))
        self.flat[end : end + len(flat)] = flat
        self.start[n + 1 : n + len(words) + 1] = end + np.cumsum(lens)
        self.seen[n : n + len(words)] = 0

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts one after another, as unsigned 32-bit integers, and where each text's ids end."""
        if self.held > MEMO_BYTES:
            self.trim(MEMO_BYTES // 2)
        split, words, counts = self.split, [], []
        for t in texts:
            found = split(t)
            counts.append(len(found))
            words += found
        memo = self.memo
        new = set(words).difference(memo)
        if new:
            self._learn(list(new))
        at = np.fromiter(map(memo.__getitem__, words), np.int64, len(words))
        self.seen[: len(memo)] += np.bincount(at, minlength=len(memo))
        first = self.start[at]
        lens = self.start[at + 1] - first
        ends = np.concatenate([[0], np.cumsum(lens)])
        ids = self.flat[np.arange(ends[-1]) - np.repeat(ends[:-1] - first, lens)]
        return ids, ends[np.cumsum(counts, dtype=np.int64)]

    def decode(self, ids) -> bytes:
        return b"".join(map(self.token.__getitem__, ids))


@functools.cache
def tokenizer(path: str, pattern: str) -> Tokenizer:
    """One tokenizer for each driver."""
    return Tokenizer(path, pattern)


def sent(spark: SparkSession, path: str, pattern: str) -> Broadcast:
    """The tokenizer as a broadcast: built by the driver, unpacked once by each worker process."""
    return spark.sparkContext.broadcast(tokenizer(path, pattern))


@tidily
def _encoded(shared: Broadcast, ids_too: bool, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    tok = shared.value
    for b in batches:
        for lo, hi, texts in text_pieces(b.column(1), CHUNK):
            ids, ends = tok.encode(texts)
            raw, n, sha, back, prev = ids.astype("<u4").tobytes(), [], [], [], 0
            for e in ends.tolist():
                n.append(e - prev)
                sha.append(hashlib.sha256(raw[4 * prev : 4 * e]).hexdigest())
                back.append(hashlib.sha256(tok.decode(ids[prev:e].tolist())).hexdigest())
                prev = e
            cols = [b.column(0).slice(lo, hi - lo), pa.array(n, pa.int64()), pa.array(sha, pa.string()), pa.array(back, pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if ids_too:
                cols.append(pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), pa.array(ids.astype(np.int32))))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(cols, names)
    tok.trim(MEMO_BYTES // 8)  # workers live on


def encode(docs: DataFrame, path: str, pattern: str, ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and, if asked for, the ids themselves. One pass over the texts; nothing is shuffled."""
    by_bytes(docs.sparkSession)
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * ids
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    return plain.mapInArrow(functools.partial(_encoded, sent(docs.sparkSession, path, pattern), ids), schema)


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id and text (bytes) from doc_id and ids; null ids give null."""
    shared = sent(encoded.sparkSession, path, pattern)

    def run(batches):
        tok = shared.value
        for b in batches:
            found = [None if x is None else tok.decode(x) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.binary())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text binary")


def public() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"), *public())
