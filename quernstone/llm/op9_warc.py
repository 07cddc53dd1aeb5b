"""WARC (operator 9): writes a table of pages as WARC 1.1 archives, reads them back, and merges the archives' captures into histories.

Each task writes its archives (each record a gzip member of its own; a new file beyond ROLL bytes or ROLL_ROWS records). Each archive is read back once, from
start to end; what its records say is sorted by URL key, timestamp and id and kept as a run, a file with an index of its row groups. Runs are merged by
loser trees, FAN at a time, until FAN or fewer are left; the last merge is cut into ranges of about RANGE_ROWS captures, each of which seeks its place in every
run and streams from there. A merge holds a few row groups of each run, whatever their size, and what it yields are the captures of the whole
collection in order, numbered within their URL key: capture histories. Every result comes out of this merge.

Of records with equal payloads of at least `at_least` bytes, the one with the largest page_id is a response and the others are revisits that refer
to it; smaller payloads are all responses. Rows that repeat that largest page_id are all responses; a page_id of null counts as smaller than any other.
Null html is an empty payload; a null url is written as about:blank; line breaks in URLs are percent-encoded. An empty table gives no archive. Payloads of any length
are written and read whole, a record at a time; columns of other names play no part. Captures with the same key, timestamp and id are ordered by their place
in the archives. Files have names of their own for every attempt; only those that a successful task reports are read, so tasks may be repeated.

What the driver gets: of each run a key for every SAMPLE captures, of each range two keys and a number."""

from __future__ import annotations

import base64
import functools
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator
from datetime import datetime, timedelta, timezone
from urllib.parse import urlsplit

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.llm.common import by_bytes, heavy_split, may_broadcast, text_of, tidily
from quernstone.session import cut, delete, shared_dir, table

ROLL, ROLL_ROWS, LEVEL = 256 << 20, 100_000, 5
FAN, GROUP_ROWS, RANGE_ROWS, SAMPLE = 64, 1024, 250_000, 25_000
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"
EPOCH = datetime(2024, 1, 1, tzinfo=timezone.utc)
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def url_key(url: str) -> str:
    """The host's parts in reverse, then the rest, as capture indexes sort them."""
    try:
        p = urlsplit(url)
        host, port = (p.hostname or "").lower(), f":{p.port}" if p.port and p.port not in (80, 443) else ""
    except ValueError:
        return url.lower()
    if not host:
        return url.lower()
    return ",".join(reversed(host.split("."))) + port + ")" + (p.path or "/") + (f"?{p.query}" if p.query else "")


def date_of(page_id: int | None) -> str:
    """Pages have no date: the capture's is made from its number."""
    return (EPOCH + timedelta(seconds=(page_id or 0) % (10 * 365 * 86400))).strftime("%Y-%m-%dT%H:%M:%SZ")


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One record. A revisit has the HTTP header alone, whose Content-Length is that of the full payload."""
    uri = "".join(c if c > " " and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in url) if url else "about:blank"
    head = HTTP % len(payload)
    body = head if refers_to is not None else head + payload
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{'none' if page_id is None else page_id}>", f"WARC-Target-URI: {uri}", f"WARC-Date: {date_of(page_id)}", f"WARC-Payload-Digest: sha1:{digest}"]
    if refers_to is not None:
        lines += [f"WARC-Profile: {REVISIT}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}", "", ""]
    return "\r\n".join(lines).encode() + body + b"\r\n\r\n"


def members(stream, size: int = 1 << 20) -> Iterator[tuple[int, int, bytes]]:
    """(offset, length, content) of each gzip member of a stream, which is read once from start to end."""
    at, begun, inflate, parts = 0, 0, zlib.decompressobj(31), []
    data = stream.read(size)
    while data:
        parts.append(inflate.decompress(data))
        at += len(data)
        if inflate.eof:
            data = inflate.unused_data
            at -= len(data)
            yield begun, at - begun, b"".join(parts)
            begun, inflate, parts = at, zlib.decompressobj(31), []
            data = data or stream.read(size)
        else:
            data = stream.read(size)
    if any(parts):
        raise ValueError(f"the archive ends within the record at {begun}")


def parse(content: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (names in lower case) and block of a record."""
    head, _, rest = content.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
    return headers, rest[: int(headers["content-length"])]


def _id(urn: str) -> int | None:
    x = urn.removeprefix("<urn:page:").removesuffix(">")
    return None if x == "none" else int(x)


def _open(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder)


_CAPTURE = "url_key string, captured string, page_id long, file string, position long, payload_bytes long, payload_digest string, record_type string, refers_to long"
_ARCHIVE = "file string, records long"
_RUN = "run string, records long, samples string"
_HISTORY = "span long, pos long, " + _CAPTURE


def _schema(ddl: str) -> pa.Schema:
    kinds = {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_()}
    return pa.schema([(n, kinds[t]) for n, t in (x.split() for x in ddl.split(", "))])


def _rows(ddl: str, rows: list[tuple]) -> pa.RecordBatch:
    schema = _schema(ddl)
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)


@tidily
def _write(folder: str, roll: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """page_id, url, html, digest (hex), refers_to -> archives; yields their names."""
    system, path = _open(folder)
    out, name, at, n = None, "", 0, 0
    done: list[tuple] = []
    for b in batches:
        for page_id, url, html, digest, refers_to in zip(*(c.to_pylist() for c in b.columns)):
            if out is None:
                name, at, n = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                out = system.open_output_stream(f"{path}/{name}", compression=None)
            sha = base64.b32encode(bytes.fromhex(digest)).decode()
            deflate = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
            data = deflate.compress(record(page_id, url, (html or "").encode(), sha, refers_to)) + deflate.flush()
            out.write(data)
            at, n = at + len(data), n + 1
            if at >= roll or n >= ROLL_ROWS:
                out.close()
                out = None
                done.append((name, n))
    if out is not None:
        out.close()
        done.append((name, n))
    yield _rows(_ARCHIVE, done)


def resolved(pages: DataFrame, at_least: int) -> DataFrame:
    """page_id, url, html, digest, refers_to of each row. Digests of which there are several are found by a shuffle of digests alone. If these are few they are
    broadcast, and pages stay where they are; else the frequent ones are, and the other pages are shuffled by digest, once."""
    by_bytes(pages.sparkSession)
    text = text_of("html")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), text.alias("html"), F.sha1(text.cast("binary")).alias("digest"))
    big = F.octet_length("html") >= at_least
    groups = cut(rows.where(big).groupBy("digest").agg(F.count("*").alias("group_size"), F.max("page_id").alias("keep")).where("group_size > 1"))
    n, total = groups.agg(F.count("*"), F.sum("group_size")).first()
    if not n:
        return rows.withColumn("refers_to", F.lit(None).cast("long"))
    refers = F.when(big & F.col("keep").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("keep")), F.col("keep")).alias("refers_to")
    out = ["page_id", "url", "html", "digest", refers]
    small = may_broadcast(groups, n, 80)
    if small is not groups:
        return rows.join(small, "digest", "left").select(*out)
    hot, cold = heavy_split(groups, "digest", total)  # fewer than a thousand hot ones
    marked = rows.join(F.broadcast(hot.withColumn("hot", F.lit(True))), "digest", "left")
    rest = marked.where("hot is null").select("page_id", "url", "html", "digest").join(cold.hint("merge"), "digest", "left")
    return marked.where("hot").select(*out).unionByName(rest.select(*out))


def write(pages: DataFrame, folder: str, at_least: int = 0, roll: int = ROLL) -> DataFrame:
    """Writes the archives and returns their names and numbers of records."""
    system, path = _open(folder)
    system.create_dir(path, recursive=True)
    return cut(resolved(pages, at_least).mapInArrow(functools.partial(_write, folder, roll), _ARCHIVE))


class LoserTree:
    """Merges sorted iterators: each inner node keeps the loser of its match, so the next smallest takes one path of matches."""

    def __init__(self, runs: list[Iterator], key):
        self.runs, self.key = runs, key
        self.k = k = max(1, len(runs))
        self.head: list = [None] * k
        self.keys: list = [None] * k  # None: the run has ended
        self.loser = [-1] * k
        for i in range(len(runs)):
            self._advance(i)
        for i in range(k):
            self._play(i)

    def _advance(self, i: int) -> None:
        x = next(self.runs[i], None)
        self.head[i], self.keys[i] = x, None if x is None else (*self.key(x), i)

    def _beats(self, a: int, b: int) -> bool:
        ka, kb = self.keys[a], self.keys[b]
        return kb is None or (ka is not None and ka < kb)

    def _play(self, i: int) -> None:
        node = (i + self.k) // 2
        while node > 0:
            if self.loser[node] == -1:
                self.loser[node] = i  # first to come: waits for the other side
                return
            if self._beats(self.loser[node], i):
                self.loser[node], i = i, self.loser[node]
            node //= 2
        self.loser[0] = i

    def __iter__(self):
        if not self.runs:
            return
        while self.keys[self.loser[0]] is not None:
            i = self.loser[0]
            yield self.head[i]
            self._advance(i)
            self._play(i)


def _order(row: tuple) -> tuple:
    """The place of a row of _CAPTURE: url_key, captured, page_id (null first), file, position."""
    return row[0], row[1], row[2] is not None, row[2] or 0, row[3], row[4]


class _Run:
    """A sorted run as a file in small row groups; keeps the key of every SAMPLE-th capture."""

    def __init__(self, folder: str):
        system, path = _open(folder)
        self.name, self.n, self.held, self.samples = f"{uuid.uuid4().hex}.run", 0, [], []
        self.sink = system.open_output_stream(f"{path}/{self.name}", compression=None)
        self.file = pq.ParquetWriter(self.sink, _schema(_CAPTURE), compression="zstd")

    def add(self, row: tuple) -> None:
        if self.n % SAMPLE == 0:
            self.samples.append(_order(row))
        self.n += 1
        self.held.append(row)
        if len(self.held) == GROUP_ROWS:
            self._flush()

    def _flush(self) -> None:
        if self.held:
            self.file.write_batch(_rows(_CAPTURE, self.held), row_group_size=GROUP_ROWS)
            self.held = []

    def close(self) -> tuple[str, int, str]:
        self._flush()
        self.file.close()
        self.sink.close()
        return self.name, self.n, json.dumps(self.samples)


def captures_of(folder: str, name: str) -> Iterator[tuple]:
    """The records of an archive, each checked against its digest."""
    system, path = _open(folder)
    with system.open_input_stream(f"{path}/{name}", compression=None) as stream:
        for at, _, content in members(stream):
            headers, block = parse(content)
            http, _, payload = block.partition(b"\r\n\r\n")
            size = int(next(x for x in http.decode().split("\r\n") if x.lower().startswith("content-length: "))[16:])
            digest = headers["warc-payload-digest"].removeprefix("sha1:")
            kind = headers["warc-type"]
            if kind != "revisit" and (len(payload) != size or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
                raise ValueError(f"the record at {at} of {name} differs from its digest")
            yield url_key(headers["warc-target-uri"]), headers["warc-date"], _id(headers["warc-record-id"]), name, at, size, digest, kind, _id(headers["warc-refers-to"]) if kind == "revisit" else None


@tidily
def _runs(folder: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """file -> the archive's run; an archive has about ROLL_ROWS records at most, so they can be sorted here."""
    for b in batches:
        for name in b.column(0).to_pylist():
            run = _Run(folder)
            for row in sorted(captures_of(folder, name), key=_order):
                run.add(row)
            yield _rows(_RUN, [run.close()])


def stream_run(folder: str, name: str, lo: tuple | None = None, hi: tuple | None = None) -> Iterator[tuple]:
    """The captures of a run from lo on and before hi, a row group at a time; row groups that end before lo aren't read."""
    system, path = _open(folder)
    with pq.ParquetFile(system.open_input_file(f"{path}/{name}")) as file:
        for g in range(file.num_row_groups):
            if lo is not None:
                key, time = (file.metadata.row_group(g).column(i).statistics for i in (0, 1))
                if key is not None and key.has_min_max and (key.max < lo[0] or (key.min == key.max == lo[0] and time is not None and time.has_min_max and time.max < lo[1])):
                    continue
            for row in zip(*(c.to_pylist() for c in file.read_row_group(g).columns)):
                if lo is not None and _order(row) < lo:
                    continue
                if hi is not None and _order(row) >= hi:
                    return
                yield row


def merge_runs(folder: str, names: list[str], lo: tuple | None = None, hi: tuple | None = None) -> Iterator[tuple]:
    return iter(LoserTree([stream_run(folder, n, lo, hi) for n in sorted(names)], _order))


@tidily
def _fewer(folder: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """bundle, runs -> each bundle's runs as one."""
    for b in batches:
        for names in b.column(1).to_pylist():
            run = _Run(folder)
            for row in merge_runs(folder, names):
                run.add(row)
            yield _rows(_RUN, [run.close()])


@tidily
def _histories(folder: str, names: list[str], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """span, lo, hi (keys as JSON) -> the captures of each span in order, numbered within their URL key."""
    for b in batches:
        for span, lo, hi in zip(*(c.to_pylist() for c in b.columns)):
            out, key, pos = [], None, 0
            for row in merge_runs(folder, names, *(None if x is None else tuple(json.loads(x)) for x in (lo, hi))):
                pos = pos + 1 if row[0] == key else 0
                key = row[0]
                out.append((span, pos, *row))
                if len(out) == 10_000:
                    yield _rows(_HISTORY, out)
                    out = []
            if out:
                yield _rows(_HISTORY, out)


def histories(archives: DataFrame, folder: str, fan: int | None = None, range_rows: int | None = None) -> DataFrame:
    """The captures of archives (file) in the order of url_key, captured, page_id, with history_pos: their number within the URL key. The result stands in
    the shared folder by itself; span numbers the ranges in order."""
    spark = archives.sparkSession
    fan, range_rows = fan or FAN, range_rows or RANGE_ROWS
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    runs = cut(archives.select("file").repartition(n, "file").mapInArrow(functools.partial(_runs, folder), _RUN))
    count = runs.count()
    while count > fan:
        bundles = -(-count // max(2, fan // 2))
        bundled = runs.groupBy(F.pmod(F.xxhash64("run"), F.lit(bundles)).alias("bundle")).agg(F.collect_list("run").alias("runs"))  # half of FAN names each, more or less
        runs = cut(bundled.repartition(min(n, bundles), "bundle").mapInArrow(functools.partial(_fewer, folder), _RUN))
        count = runs.count()
    last = runs.collect()  # FAN at most
    keys = sorted(tuple(k) for r in last for k in json.loads(r["samples"]))
    spans = max(1, -(-sum(r["records"] for r in last) // range_rows))
    bounds = sorted({keys[i * len(keys) // spans] for i in range(1, spans)}) if keys else []
    edges = [None, *map(json.dumps, bounds), None]
    asked = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(zip(edges, edges[1:]))], "span long, lo string, hi string").repartition(max(1, len(edges) - 1), "span")
    merged = cut(asked.mapInArrow(functools.partial(_histories, folder, [r["run"] for r in last]), _HISTORY))
    # a key that began in an earlier range goes on counting
    ends = merged.groupBy("span").agg(F.min("url_key").alias("first"), F.max(F.struct("url_key", "pos")).alias("last")).orderBy("span").collect()
    before, key, offsets = 0, None, []
    for r in ends:
        carried = before if r["first"] == key else 0
        offsets.append((r["span"], r["first"], carried))
        key, before = r["last"]["url_key"], r["last"]["pos"] + 1 + (carried if r["first"] == r["last"]["url_key"] else 0)
    added = spark.createDataFrame(offsets, "span long, first string, carried long")
    whole = merged.join(F.broadcast(added), "span")
    return whole.select("span", *[c.split()[0] for c in _CAPTURE.split(", ")], (F.col("pos") + F.when(F.col("url_key") == F.col("first"), F.col("carried")).otherwise(0)).alias("history_pos"))


def round_trip(pages: DataFrame, at_least: int = 0) -> DataFrame:
    """Writes archives into the shared folder and returns each record as it is read back, in the order of the merged histories. The archives and runs are
    deleted: to keep them, call write() and histories() with a folder of your own."""
    spark = pages.sparkSession
    folder = f"{shared_dir(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"
    out = histories(write(pages, folder, at_least), folder)
    delete(spark, folder)
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "captured", "history_pos")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "pages"))


SQL = """
with p as (select page_id, coalesce(html, '') h, sha1(coalesce(html, '')) d, coalesce(url, 'about:blank') url from pages),
b as (select *, max(page_id) over (partition by d) keep, lower(regexp_extract(url, '^[A-Za-z]+://([^/?#]*)', 1)) host, regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^#]*)', 1) rest,
      list_aggregate(list_transform(range(0, 8), lambda i: list_aggregate(list_transform([15, 10, 5, 0], lambda s:
        substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(d, (5 * i + 1)::int, 5))::bigint >> s) & 31)::int + 1, 1)), 'string_agg', '')), 'string_agg', '') b32 from p),
k as (select *, case when host = '' then lower(url) else array_to_string(list_reverse(string_split(host, '.')), ',') || ')' || case when rest[1:1] = '/' then '' else '/' end || rest end url_key,
      strftime(timestamp '2024-01-01' + to_seconds(page_id % 315360000), '%Y-%m-%dT%H:%M:%SZ') captured from b)
select page_id, octet_length(encode(h))::bigint as payload_bytes, b32 as payload_digest,
       case when page_id = keep then 'response' else 'revisit' end as record_type, case when page_id <> keep then keep end as refers_to,
       url_key, captured, row_number() over (partition by url_key order by captured, page_id) - 1 as history_pos from k
"""
