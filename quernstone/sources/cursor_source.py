"""A streaming source of document references that is pulled by a cursor: each pull asks for the next `limit` references after (updated, doc_id), as an
index asks a document server. The cursor is the stream's offset, so a restarted stream goes on where its checkpoint stands.

spark.dataSource.register(CursorSource); spark.readStream.format("quernstone_updates").option("path", ...).load()

The server here is a table of documents in Parquet; another one only needs another `pull`."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

SCHEMA = "space string, doc_id string, updated long"
LIST = 500


def pull(path: str, space: str | None, after: tuple[int, str], limit: int) -> list[tuple[str, str, int]]:
    """The next references of a space in the order of (updated, doc_id)."""
    import pyarrow.compute as pc
    import pyarrow.dataset as ds

    updated, doc_id = pc.field("updated"), pc.field("doc_id")
    wanted = (updated > after[0]) | ((updated == after[0]) & (doc_id > after[1]))
    if space:
        wanted &= pc.field("space") == space
    found: list[tuple[int, str, str]] = []
    for batch in ds.dataset(path, format="parquet").to_batches(columns=["updated", "doc_id", "space"], filter=wanted):
        rows = zip(*(batch.column(i).to_pylist() for i in range(3)))
        found = sorted([*found, *rows])[:limit]  # never more than a list and a batch
    return [(s, d, u) for u, d, s in found]


class Reader(SimpleDataSourceStreamReader):
    def __init__(self, options: dict):
        self.path, self.space, self.limit = options["path"], options.get("space"), int(options.get("limit", LIST))

    def initialOffset(self) -> dict:
        return {"updated": -(2**62), "doc_id": ""}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        rows = pull(self.path, self.space, (start["updated"], start["doc_id"]), self.limit)
        end = {"updated": rows[-1][2], "doc_id": rows[-1][1]} if rows else start
        return iter(rows), end

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        rows = pull(self.path, self.space, (start["updated"], start["doc_id"]), self.limit)
        return (r for r in rows if (r[2], r[1]) <= (end["updated"], end["doc_id"]))


class CursorSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "quernstone_updates"

    def schema(self) -> str:
        return SCHEMA

    def simpleStreamReader(self, schema) -> Reader:
        return Reader(self.options)
