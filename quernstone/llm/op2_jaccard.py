"""N-gram Jaccard join (operator 2): documents link when 100 * |intersection| >= 70 * |union| of their sets of 3-word shingles.
A prefix-tree join: sets are ordered by one global order, rarest shingle first, and stored in tries; every probe goes down a trie together, so the
overlap with a common prefix is counted once; a subtree is left as soon as what remains of its sets cannot make up the needed overlap.

What goes into the tries is made small by bounds that lose nothing:
1. A shingle that one document alone has can't be shared. Shingles are counted in blocks of hashes (4 bytes and a place each, sorted and packed, so the
   shuffle moves a few large rows); a document of whose shingles less than 70 % are in another document links with nothing.
2. Of the rest, documents with equal sets become one class; shingles are counted again, in full, among the classes, and the bound is
   applied again.
3. Two sets that link share one of their first |s| - ceil(0.7 |s|) + 1 shingles in the global order. Classes that share such a shingle and are near enough in size, directly or
   through others, form a component; only within components tries are built. A component of more than BLOCK shingles is split into blocks by
   size of set and hash, and each pair of blocks that may hold a link is a task of its own, so no task's size depends on the largest group.

Results carry sums of links and a spanning forest, never a group's pairs. Words are `[^\\x20\\x09-\\x0D]+` of the text with A-Z lower-cased; with fewer
than 3 words the whole sequence is one shingle; an empty or null text has no shingle and links with nothing. Sets are compared by 64-bit hashes of shingles.
Repeated rows are documents of their own. A null doc_id takes part, but is a component's id only where nothing else is. Texts of any length are compared
whole; an empty table gives an empty result; columns with other names, whatever they are, play no part."""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.llm.common import U64, attach, as_bytes, by_bytes, may_broadcast, mix, partitions_for, pieces, text_of, tidily, word_bounds, word_hashes
from quernstone.llm.components import components
from quernstone.session import cut, release, table

PERCENT = 70
CHUNK_SHINGLES, CHUNK_DOCS, MANY = 1_000_000, 60_000, 0xFFFF
BLOCK = 1_000_000
_C = [U64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5)]


def least_overlap(n):
    """ceil(PERCENT / 100 * n): a linked document shares at least so many of n shingles."""
    return (n * PERCENT + 99) // 100


def shingle_sets(texts: list[bytes]) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    for lo, hi in pieces(texts, 1 << 21):
        part = texts[lo:hi]
        buf = np.frombuffer(b"".join(part), np.uint8)
        cuts = np.cumsum([len(t) for t in part], dtype=np.int64)
        starts, ends = word_bounds(buf, cuts)
        w = word_hashes(buf, starts, ends)
        last = np.searchsorted(starts, cuts).tolist()
        s = mix(w[:-2] * _C[0] + mix(w[1:-1] * _C[1] + w[2:] * _C[2])) if len(w) > 2 else w[:0]
        a = 0
        for b in last:
            if b - a >= 3:
                x = np.sort(s[a : b - 2])
                keep = np.empty(len(x), bool)
                keep[0] = True
                np.not_equal(x[1:], x[:-1], out=keep[1:])
                yield x[keep]
            elif b > a:
                h = w[a:b] if b - a == 1 else w[a : a + 1] * _C[1] + mix(w[a + 1 : b] * _C[2] + U64(1))
                yield mix(h * _C[3] + U64(b - a))
            else:
                yield np.empty(0, U64)
            a = b


def _digest(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


# Packing: arrays as planes of bytes, of which the upper ones are mostly zero and shrink in the shuffle's compression.


def _planes(a: np.ndarray) -> bytes:
    return np.ascontiguousarray(a.view(np.uint8).reshape(-1, a.itemsize).T).tobytes()


def _unplanes(raw: bytes, kind, n: int, at: int = 0) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8, n * size, at).reshape(size, n).T).view(kind).ravel()


def _pack(*arrays: np.ndarray) -> bytes:
    return b"".join([np.array([len(arrays), *(len(a) for a in arrays)], np.int64).tobytes(), *(np.ascontiguousarray(a).tobytes() for a in arrays)])


def _unpack(raw: bytes, *kinds) -> list[np.ndarray]:
    k = int(np.frombuffer(raw, np.int64, 1)[0])
    sizes = np.frombuffer(raw, np.int64, k, 8)
    out, at = [], 8 * (k + 1)
    for kind, n in zip(kinds, sizes.tolist()):
        out.append(np.frombuffer(raw, kind, n, at))
        at += n * np.dtype(kind).itemsize
    return out


_ROWS = "bucket long, kind int, chunk long, payload binary"
_ROW_SCHEMA = pa.schema([("bucket", pa.int64()), ("kind", pa.int32()), ("chunk", pa.int64()), ("payload", pa.binary())])


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(_ROW_SCHEMA)], schema=_ROW_SCHEMA)


def _by(column: int, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple]]]:
    """Rows of a partition sorted by a column, one group of equal values at a time."""
    key, held = None, []
    for b in batches:
        for row in zip(*(c.to_pylist() for c in b.columns)):
            if held and row[column] != key:
                yield key, held
                held = []
            key = row[column]
            held.append(row)
    if held:
        yield key, held


# 1. Which documents can link at all.


@tidily
def _scan(buckets: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, text, h -> for each chunk of documents one row of kind 0 (ids, which are null, h, sizes, digests, shingles known to be shared within the chunk) and for each
    bucket one of kind 1: the low 32 bits of the bucket's shingles, ascending, and the document of each (MANY: several of this chunk)."""
    part, seq = TaskContext.get().partitionId(), 0
    ids: list[int | None] = []
    hs: list[int] = []
    sets: list[np.ndarray] = []
    held = 0

    def flush() -> pa.RecordBatch:
        nonlocal ids, hs, sets, held, seq
        chunk = part << 24 | seq
        n = np.array([len(s) for s in sets], np.int64)
        place = np.repeat(np.arange(len(sets), dtype=U64), n)
        every = np.concatenate(sets)
        packed = ((every >> U64(32)) * U64(buckets) >> U64(32)) << U64(48) | (every & U64(0xFFFFFFFF)) << U64(16) | place
        packed.sort()
        key = packed >> U64(16)
        begins = np.ones(len(key), bool)
        np.not_equal(key[1:], key[:-1], out=begins[1:])
        single = begins & np.append(begins[1:], True)
        doc = (packed & U64(0xFFFF)).astype(np.uint16)
        shared = np.bincount(doc[~single], minlength=len(sets)).astype(np.uint32)
        doc[~single] = MANY
        key, doc = key[begins], doc[begins]
        low = (key & U64(0xFFFFFFFF)).astype(np.uint32)
        edges = np.searchsorted(key >> U64(32), np.arange(buckets + 1, dtype=U64))
        digests = np.frombuffer(b"".join(map(_digest, sets)), np.uint8)
        lost = np.array([i is None for i in ids], np.uint8)
        rows = [(chunk % buckets, 0, chunk, _pack(np.array([i or 0 for i in ids], np.int64), lost, np.array(hs, np.int64), n, shared, digests))]
        for k in range(buckets):
            a, b = int(edges[k]), int(edges[k + 1])
            if b > a:
                t = low[a:b]
                rows.append((k, 1, chunk, _planes(np.concatenate([t[:1], np.diff(t)])) + _planes(doc[a:b])))
        ids, hs, sets, held, seq = [], [], [], 0, seq + 1
        return _batch(rows)

    for b in batches:
        texts = as_bytes(b.column(1))
        for i, h, s in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), shingle_sets(texts)):
            ids.append(i)
            hs.append(h)
            sets.append(s)
            held += len(s)
            if held >= CHUNK_SHINGLES or len(sets) == CHUNK_DOCS:
                yield flush()
    if sets:
        yield flush()


@tidily
def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a bucket -> for each chunk, how many shingles of each of its documents another chunk has as well. Rows of kind 0 pass."""
    for bucket, rows in _by(0, batches):
        out = [r for r in rows if r[1] == 0]
        rows = [r for r in rows if r[1] == 1]
        tokens, docs = [], []
        for _, _, _, raw in rows:
            n = len(raw) // 6
            tokens.append(np.cumsum(_unplanes(raw, np.uint32, n), dtype=np.uint32))
            docs.append(_unplanes(raw, np.uint16, n, 4 * n).astype(np.int64) + (len(docs) << 16))
        if rows:
            t, d = np.concatenate(tokens), np.concatenate(docs)
            packed = t.astype(U64) << U64(32) | np.arange(len(t), dtype=U64)
            packed.sort()
            t = packed >> U64(32)
            twin = np.zeros(len(t), bool)
            same = t[1:] == t[:-1]
            twin[1:] |= same
            twin[:-1] |= same
            d = d[(packed[twin] & U64(0xFFFFFFFF)).astype(np.int64)]
            d, n = np.unique(d[(d & 0xFFFF) != MANY], return_counts=True)
            edges = np.searchsorted(d >> 16, np.arange(len(rows) + 1))
            for k, (a, b) in enumerate(zip(edges.tolist(), edges[1:].tolist())):
                if b > a:
                    out.append((bucket, 1, rows[k][2], _pack((d[a:b] & 0xFFFF).astype(np.uint16), n[a:b].astype(np.uint32))))
        if out:
            yield _batch(out)


@tidily
def _settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a chunk -> doc_id, h, n, digest, live (whether enough of its shingles are shared)."""
    for _, rows in _by(2, batches):
        ids, lost, hs, n, shared, digests = _unpack(next(r[3] for r in rows if r[1] == 0), np.int64, np.uint8, np.int64, np.int64, np.uint32, np.uint8)
        total = shared.astype(np.int64)
        for r in rows:
            if r[1] == 1:
                d, c = _unpack(r[3], np.uint16, np.uint32)
                total[d] += c
        raw = digests.tobytes()
        cols = [pa.array(ids, mask=lost > 0), pa.array(hs), pa.array(n), pa.array([raw[16 * i : 16 * i + 16] for i in range(len(ids))], pa.binary()), pa.array((n > 0) & (total >= least_overlap(n)))]
        yield pa.RecordBatch.from_arrays(cols, ["doc_id", "h", "n", "digest", "live"])


def _exchange(df: DataFrame, n: int, *by: str) -> DataFrame:
    return df.repartition(n, by[0]).sortWithinPartitions(*by)


def _plain(docs: DataFrame) -> DataFrame:
    """doc_id, text, h: a hash of the text, which tells rows apart that repeat a doc_id or have none."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"), F.xxhash64(text_of()).alias("h"))


def screened(docs: DataFrame, partitions: int) -> DataFrame:
    buckets = min(0xFFFF, 3 * partitions)
    plain = _plain(docs)
    blocks = _exchange(plain.mapInArrow(functools.partial(_scan, buckets), _ROWS), partitions, "bucket")
    counts = _exchange(blocks.mapInArrow(_count, _ROWS), partitions, "chunk")
    return cut(counts.mapInArrow(_settle, "doc_id long, h long, n long, digest binary, live boolean"))


# 2. Classes of equal sets, their shingles in the global order.


@tidily
def _class_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """cid, n, csize, digest, text -> cid, n, csize, shingles; a row whose text has another set than its class is left out."""
    for b in batches:
        digests = b.column(3).to_pylist()
        texts = as_bytes(b.column(4))
        found = list(shingle_sets(texts))
        ok = [i for i, s in enumerate(found) if len(s) and _digest(s) == digests[i]]
        rest = b.take(pa.array(ok, pa.int64()))
        yield pa.RecordBatch.from_arrays([*rest.columns[:3], pa.array([found[i].tobytes() for i in ok], pa.binary())], ["cid", "n", "csize", "shingles"])


@tidily
def _spread(buckets: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """cid, n, csize, shingles -> rows as those of _scan, with whole shingles: kind 1 for each bucket, kind 0 with the classes."""
    part, seq = TaskContext.get().partitionId(), 0
    held: list[tuple] = []

    def flush() -> pa.RecordBatch:
        nonlocal held, seq
        chunk = part << 24 | seq
        sets = [np.frombuffer(r[3], U64) for r in held]
        every = np.concatenate(sets)
        place = np.repeat(np.arange(len(sets)), [len(s) for s in sets]).astype(np.uint16)
        bucket = ((every >> U64(32)) * U64(buckets) >> U64(32)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        edges = np.searchsorted(bucket[order], np.arange(buckets + 1))
        rows = [(chunk % buckets, 0, chunk, _pack(*(np.array([r[i] for r in held], np.int64) for i in range(3))))]
        for k in range(buckets):
            own = order[edges[k] : edges[k + 1]]
            if len(own):
                rows.append((k, 1, chunk, _pack(every[own], place[own])))
        held, seq = [], seq + 1
        return _batch(rows)

    size = 0
    for b in batches:
        for row in zip(*(c.to_pylist() for c in b.columns)):
            held.append(row)
            size += len(row[3]) // 8
            if size >= CHUNK_SHINGLES // 2 or len(held) == CHUNK_DOCS:
                yield flush()
                size = 0
    if held:
        yield flush()


@tidily
def _frequency(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a bucket -> for each chunk the shingles that at least two classes have, with the number of classes."""
    for bucket, rows in _by(0, batches):
        out = [r for r in rows if r[1] == 0]
        rows = [r for r in rows if r[1] == 1]
        parts = [_unpack(r[3], U64, np.uint16) for r in rows]
        if parts:
            t = np.concatenate([p[0] for p in parts])
            _, inverse, n = np.unique(t, return_inverse=True, return_counts=True)
            n, at = n[inverse], 0
            for r, (tokens, place) in zip(rows, parts):
                own = n[at : at + len(tokens)]
                at += len(tokens)
                keep = own > 1
                if keep.any():
                    out.append((bucket, 1, r[2], _pack(tokens[keep], place[keep], own[keep].astype(np.uint32))))
        if out:
            yield _batch(out)


@tidily
def _ordered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a chunk -> cid, n, csize, shared shingles in the global order (rarest first, then by hash), their frequencies."""
    for _, rows in _by(2, batches):
        cid, n, csize = _unpack(next(r[3] for r in rows if r[1] == 0), np.int64, np.int64, np.int64)
        parts = [_unpack(r[3], U64, np.uint16, np.uint32) for r in rows if r[1] == 1]
        if not parts:
            continue
        t, p, f = (np.concatenate([x[i] for x in parts]) for i in range(3))
        order = np.lexsort((t, f, p))
        t, p, f = t[order], p[order], f[order]
        edges = np.searchsorted(p, np.arange(len(cid) + 1))
        keep = [i for i in range(len(cid)) if edges[i + 1] - edges[i] >= least_overlap(int(n[i]))]
        yield pa.RecordBatch.from_arrays(
            [pa.array(cid[keep]), pa.array(n[keep]), pa.array(csize[keep]), pa.array([int(edges[i + 1] - edges[i]) for i in keep], pa.int64()), *(pa.array([x[edges[i] : edges[i + 1]].tobytes() for i in keep], pa.binary()) for x in (t, f))],
            ["cid", "n", "csize", "live", "shingles", "frequencies"],
        )


def ordered(sets: DataFrame, partitions: int) -> DataFrame:
    """cid, n, csize, live, shingles, frequencies of the classes that may still link."""
    buckets = min(0xFFFF, 3 * partitions)
    spread = _exchange(sets.mapInArrow(functools.partial(_spread, buckets), _ROWS), partitions, "bucket")
    counted = _exchange(spread.mapInArrow(_frequency, _ROWS), partitions, "chunk")
    return cut(counted.mapInArrow(_ordered, "cid long, n long, csize long, live long, shingles binary, frequencies binary"))


# 3. Components of classes that share a shingle of their prefixes.


@tidily
def _prefixes(buckets: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        heads, cids, sizes = [], [], []
        for cid, n, live, raw in zip(*(b.column(i).to_pylist() for i in (0, 1, 3, 4))):
            k = live - least_overlap(n) + 1  # shingles of no other class come first in the order and are left out already
            heads.append(np.frombuffer(raw, U64, k))
            cids.append(np.full(k, cid, np.int64))
            sizes.append(np.full(k, n, np.int64))
        if not heads:
            continue
        t, c, size = np.concatenate(heads), np.concatenate(cids), np.concatenate(sizes)
        bucket = ((t >> U64(32)) * U64(buckets) >> U64(32)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        edges = np.searchsorted(bucket[order], np.arange(buckets + 1))
        yield _batch([(k, 1, 0, _pack(t[own], c[own], size[own])) for k in range(buckets) if len(own := order[edges[k] : edges[k + 1]])])


@tidily
def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each shingle of a bucket, edges from one class that has it in its prefix to the others; each edge once. By size of set the classes fall apart
    wherever the next is too large to link with the one before: no link crosses such a gap."""
    for _, rows in _by(0, batches):
        parts = [_unpack(r[3], U64, np.int64, np.int64) for r in rows]
        t, c, n = (np.concatenate([p[i] for p in parts]) for i in range(3))
        order = np.lexsort((c, n, t))
        t, c, n = t[order], c[order], n[order]
        begins = np.ones(len(t), bool)
        begins[1:] = (t[1:] != t[:-1]) | (100 * n[:-1] < PERCENT * n[1:])
        a = c[np.maximum.accumulate(np.where(begins, np.arange(len(t)), 0))]
        pairs = np.unique(np.stack([a, c], 1)[a != c], axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])


# 4. Tries.


class Trie:
    """Sets (ascending ranks in the global order), sorted, so that the sets below a node of the trie are a range; lcp[i] is the
    length of the prefix that sets i-1 and i share."""

    def __init__(self, seqs: list[np.ndarray], n: np.ndarray):
        keys = [s.astype(">u4").tobytes() for s in seqs]
        self.order = np.array(sorted(range(len(seqs)), key=keys.__getitem__), int)
        self.seqs = [seqs[i] for i in self.order]
        self.n = n[self.order]
        self.len = np.array([len(s) for s in self.seqs])
        self.lcp = np.zeros(len(seqs), int)
        for i in range(1, len(seqs)):
            a, b = self.seqs[i - 1], self.seqs[i]
            m = min(len(a), len(b))
            differ = np.flatnonzero(a[:m] != b[:m])
            self.lcp[i] = differ[0] if len(differ) else m

    def probe(self, member: np.ndarray, n: np.ndarray, live: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """member[rank, p]: whether probe p has the shingle; n and live: sizes of the probes' sets, in all and of shared shingles. Yields each set
        (its number as it was given) that any probe links with, and the probes."""
        stack = [(0, len(self.seqs), 0, np.arange(len(n)), np.zeros(len(n), np.int64))]
        while stack:
            lo, hi, depth, active, overlap = stack.pop()
            end = int(self.lcp[lo + 1 : hi].min()) if hi - lo > 1 else int(self.len[lo])
            run = self.seqs[lo][depth:end]
            if len(run):
                rows = member[run]
                overlap = overlap + (rows if len(active) == member.shape[1] else rows[:, active]).sum(0, dtype=np.int64)
            sizes = self.n[lo:hi]
            least, most = int(sizes.min()), int(sizes.max())
            own, left = n[active], int(self.len[lo:hi].max()) - end
            possible = overlap + np.minimum(left, live[active] - overlap)
            keep = ((100 + PERCENT) * possible >= PERCENT * (own + least)) & (100 * own >= PERCENT * least) & (100 * most >= PERCENT * own)
            if not keep.any():
                continue
            if not keep.all():
                active, overlap, own = active[keep], overlap[keep], own[keep]
            i = lo
            while i < hi and self.len[i] == end:
                linked = (100 + PERCENT) * overlap >= PERCENT * (own + self.n[i])
                if linked.any():
                    yield int(self.order[i]), active[linked]
                i += 1
            if i < hi:
                cuts = [i, *(np.flatnonzero(self.lcp[i + 1 : hi] == end) + i + 1).tolist(), hi]
                stack += [(a, b, end, active, overlap) for a, b in zip(cuts, cuts[1:])]


def _join(rows: list[tuple]) -> Iterator[tuple[int, int, int]]:
    """Rows (task, role, cid, n, csize, shingles, frequencies) of a task: links among those of role 0, or between those of roles 1 (in the trie) and
    2 (probes). Yields (cid, documents linked with, a class it is connected with) for each class with links."""
    seqs = [np.frombuffer(r[5], U64) for r in rows]
    lens = [len(s) for s in seqs]
    every, f = np.concatenate(seqs), np.concatenate([np.frombuffer(r[6], np.uint32) for r in rows])
    tokens, first, inverse = np.unique(every, return_index=True, return_inverse=True)
    rank = np.empty(len(tokens), np.int64)
    rank[np.lexsort((tokens, f[first]))] = np.arange(len(tokens))
    seqs = np.split(rank[inverse], np.cumsum(lens)[:-1])
    role, cid, n, csize = (np.array([r[i] for r in rows], np.int64) for i in (1, 2, 3, 4))
    live = np.array(lens)
    stored, probes = np.flatnonzero(role < 2), np.flatnonzero(role != 1)
    links, parent = np.zeros(len(rows), np.int64), np.arange(len(rows))

    def roots(x: np.ndarray) -> np.ndarray:
        while True:
            up = parent[x]
            if (up == x).all():
                return x
            x = up

    if len(stored) and len(probes):
        trie = Trie([seqs[i] for i in stored], n[stored])
        at_once = max(1, (1 << 25) // len(tokens))
        for o in range(0, len(probes), at_once):
            own = probes[o : o + at_once]
            member = np.zeros((len(tokens), len(own)), np.uint8)
            for p, i in enumerate(own):
                member[seqs[i], p] = 1
            for x, hits in trie.probe(member, n[own], live[own]):
                i, hits = stored[x], own[hits]
                hits = hits[hits != i]
                if not len(hits):
                    continue
                links[hits] += csize[i]
                if role[i] == 1:
                    links[i] += csize[hits].sum()
                tops = np.unique(roots(np.append(hits, i)))
                parent[tops] = tops[0]
                parent[hits] = tops[0]
    tops = roots(np.arange(len(rows)))
    for i in np.flatnonzero(links).tolist():
        yield int(cid[i]), int(links[i]), int(cid[tops[i]])


@tidily
def _tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for _, rows in _by(0, batches):
        found = list(_join(rows))
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in range(3)], ["cid", "links", "other"])


def _planned(seqs: DataFrame, member: DataFrame, partitions: int, block: int) -> DataFrame:
    """Rows of seqs with the tasks they take part in: task, role."""
    rows = cut(seqs.join(member.toDF("cid", "component"), "cid").withColumn("grade", F.floor(F.log(F.col("n").cast("double")) / F.lit(float(np.log(100 / (PERCENT - 1)))))))
    total = rows.groupBy("component").agg(F.sum("live").alias("shingles"))
    big = total.where(F.col("shingles") > block).select("component", F.lit(True).alias("big"))
    # sets that link differ in grade by one at most
    grades = rows.join(big, "component").groupBy("component", "grade").agg(F.ceil(F.sum("live") / F.lit(block)).alias("blocks"))
    columns = ["cid", "n", "csize", "shingles", "frequencies"]
    tagged = rows.join(big, "component", "left")
    small = tagged.where("big is null").select(F.col("component").cast("string").alias("task"), F.lit(0).alias("role"), *columns)
    large = tagged.where("big")
    for name, step in (("same", 0), ("up", 1), ("down", -1)):
        large = large.join(grades.select("component", (F.col("grade") - step).alias("grade"), F.col("blocks").alias(name)), ["component", "grade"], "left")
    own = F.pmod(F.xxhash64("cid"), F.col("same"))

    def each(count, key, role):
        numbers = F.sequence(F.lit(0).cast("long"), F.coalesce(F.col(count), F.lit(0)) - 1)
        made = F.transform(numbers, lambda j: F.struct(key(j).alias("task"), role(j).alias("role")))
        return F.when(F.col(count) > 0, made).otherwise(F.array().cast("array<struct<task:string,role:int>>"))

    def key(grade_a, i, grade_b, j):
        return F.concat_ws(":", *(x.cast("string") for x in (F.col("component"), grade_a, i, grade_b, j)))

    g = F.col("grade")
    tasks = F.concat(
        each("same", lambda j: key(g, F.least(own, j), g, F.greatest(own, j)), lambda j: F.when(j == own, 0).when(own < j, 1).otherwise(2)),
        each("up", lambda j: key(g, own, g + 1, j), lambda j: F.lit(1)),
        each("down", lambda j: key(g - 1, j, g, own), lambda j: F.lit(2)),
    )
    large = large.withColumn("t", F.explode(tasks)).select("t.task", "t.role", *columns)
    return small.unionByName(large).repartition(partitions, "task").sortWithinPartitions("task")


def linked(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """doc_id, h, n, n_similar, and of every row's component least: null_id, doc_id and h of its first row (rows without doc_id come last)."""
    spark = docs.sparkSession
    by_bytes(spark)
    partitions = partitions_for(docs.select("doc_id", "text"))
    buckets = min(0xFFFF, 3 * partitions)
    every = screened(docs, partitions)
    release(spark)  # the largest shuffle of all is over
    place = F.struct(F.col("doc_id").isNull().alias("null_id"), "doc_id", "h")
    grouped = every.where("live").groupBy("digest").agg(F.min(place).alias("first"), F.count("*").alias("csize"), F.max("n").alias("n"))
    classes = cut(grouped.withColumn("cid", F.monotonically_increasing_id()))
    n_classes = classes.count()
    wanted = classes.select(F.col("first.doc_id").alias("__id"), F.col("first.h").alias("__h"), "cid", "n", "csize", "digest")
    own = (F.col("h") == F.col("__h")) & F.col("doc_id").eqNullSafe(F.col("__id"))
    chosen = _plain(docs).join(may_broadcast(wanted, n_classes, 72), own).select("cid", "n", "csize", "digest", "text")
    sets = cut(chosen.mapInArrow(_class_sets, "cid long, n long, csize long, shingles binary"))
    if sets.count() > n_classes:  # rows that repeat a doc_id and its text
        sets = cut(sets.dropDuplicates(["cid"]))
    seqs = ordered(sets, partitions)
    heads = _exchange(seqs.mapInArrow(functools.partial(_prefixes, buckets), _ROWS), partitions, "bucket")
    member = cut(components(heads.mapInArrow(_stars, "a long, b long")))
    del sets, heads
    release(spark)
    found = cut(_planned(seqs, member, partitions, block).mapInArrow(_tasks, "cid long, links long, other long"))
    sums = found.groupBy("cid").agg(F.sum("links").alias("links"))
    top = components(found.where("cid <> other").select(F.col("cid").alias("a"), F.col("other").alias("b"))).toDF("cid", "top")
    full = cut(classes.join(sums, "cid", "left").join(top, "cid", "left").withColumn("top", F.coalesce("top", "cid")))
    least = full.groupBy("top").agg(F.min("first").alias("least"))
    info = cut(full.join(least, "top").select("digest", "csize", (F.col("csize") - 1 + F.coalesce("links", F.lit(0))).alias("n_similar"), "least"))
    total = every.count()
    some = attach(every.where("live"), info, "digest", total, count="csize")
    none = every.where("not live").select("doc_id", "h", "n", F.lit(0).cast("long").alias("n_similar"), place.alias("least"))
    return some.select("doc_id", "h", "n", F.col("n_similar").cast("long").alias("n_similar"), "least").unionByName(none)


def link(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """doc_id, n_shingles, n_similar, component_id of every row."""
    return linked(docs, block).select("doc_id", F.col("n").alias("n_shingles"), "n_similar", F.col("least.doc_id").alias("component_id"))


def thin(docs: DataFrame) -> DataFrame:
    """One row of each component: the one with the smallest doc_id (rows without doc_id come last), of several such the one whose text has the least hash, of
    equal rows any. Rows that are linked with nothing all stay."""
    found = cut(linked(docs).where("n_similar > 0").select("doc_id", "h", ((F.col("h") == F.col("least.h")) & F.col("doc_id").eqNullSafe(F.col("least.doc_id"))).alias("stays")))
    rows = found.groupBy("doc_id", "h").agg(F.count("*").alias("n"), F.max("stays").alias("stays"))
    gone, twins = rows.where("not stays"), rows.where("stays and n > 1")
    n_gone, n_twins = rows.agg(F.count_if(~F.col("stays")), F.count_if(F.expr("stays and n > 1"))).first()

    def only(df: DataFrame, keys: DataFrame, n: int, how: str) -> DataFrame:
        keys = may_broadcast(keys.select(F.col("doc_id").alias("__id"), F.col("h").alias("__of")), n, 24)
        return df.join(keys, (F.col("__h") == F.col("__of")) & F.col("doc_id").cast("long").eqNullSafe(F.col("__id")), how)

    kept = only(docs.withColumn("__h", F.xxhash64(text_of())), gone, n_gone, "left_anti")
    if n_twins:
        kept = only(kept, twins, n_twins, "left_anti").unionByName(only(kept, twins, n_twins, "left_semi").dropDuplicates(["doc_id", "__h"]))
    return kept.select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link(table(spark, sf_dir, "documents"))


SQL = r"""
with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') w from documents),
s as (select distinct doc_id, unnest(case when len(w) = 0 then []::varchar[] when len(w) < 3 then [array_to_string(w, ' ')]
      else list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) end) g from w),
n as (select doc_id, count(*) n from s group by 1),
p as (select a.doc_id a, b.doc_id b, count(*) k from s a join s b on a.g = b.g and a.doc_id <> b.doc_id group by 1, 2),
l as materialized (select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 100 * k >= 70 * (x.n + y.n - k)),
r as (select a, b from l union select r.a, l.b from r join l on l.a = r.b)
select doc_id, coalesce(n.n, 0)::bigint as n_shingles, coalesce(c.k, 0)::bigint as n_similar, least(doc_id, coalesce(m.b, doc_id)) as component_id
from documents left join n using (doc_id) left join (select a as doc_id, count(*) k from l group by 1) c using (doc_id)
     left join (select a as doc_id, min(b) b from r group by 1) m using (doc_id)
"""
