"""Listings from folders of feeds as a data source of its own: one partition a file, filters pushed to the reader."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThanOrEqual, In, InputPartition

#: The canonical listing; an adapter turns a record of its source into a dictionary of these fields.
SCHEMA = "id string, source string, title string, customer string, region string, price double, end_text string"
FIELDS = tuple(x.split()[0] for x in SCHEMA.split(", "))


def canonical(record: dict) -> dict:
    """A record that has the listing's fields already."""
    return record


def portal(record: dict) -> dict:
    """A portal's record: numbered id, first customer, price 0 by default."""
    customers = record.get("customers") or [{}]
    return {"id": f"pp_{record['id']}", "title": record.get("name"), "customer": customers[0].get("name"), "price": record.get("startCost") or 0.0, "end_text": record.get("endDate")}


ADAPTERS: dict[str, Callable[[dict], dict]] = {"portal": portal}


def _opened(path: str) -> tuple:
    """The file system of a path or address and the place in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if ":/" in path else (fs.LocalFileSystem(), path)


def _files(path: str) -> list[str]:
    from pyarrow import fs

    system, root = _opened(path)
    found = system.get_file_info(fs.FileSelector(root, recursive=True))
    return sorted(f.path for f in found if f.is_file and f.path.endswith((".json", ".jsonl")))


class FeedFile(InputPartition):
    def __init__(self, source: str, file: str):
        self.source, self.file = source, file


class FeedReader(DataSourceReader):
    """Reads ``<path>/<source>/*.json``, one record a line. A filter on the source leaves files out, one on price or region rows.

    Lines that aren't JSON objects, or that their adapter can't read, are left out as the other readers do.
    """

    def __init__(self, path: str):
        self.path, self.sources, self.tests = path, None, []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            name = ".".join(f.attribute) if isinstance(f, EqualTo | In | GreaterThanOrEqual) else ""
            values = set(f.value) if isinstance(f, In) else {f.value} if isinstance(f, EqualTo) else None
            if name == "source" and values is not None:
                self.sources = values if self.sources is None else self.sources & values
            elif name == "price" and isinstance(f, GreaterThanOrEqual):
                self.tests.append(("price", f.value))
            elif name == "region" and values is not None:
                self.tests.append(("region", values))
            else:
                yield f

    def partitions(self) -> list[FeedFile]:
        named = [(f.rsplit("/", 2)[-2], f) for f in _files(self.path)]
        return [FeedFile(s, f) for s, f in named if self.sources is None or s in self.sources] or [FeedFile("", "")]

    def _passes(self, row: dict) -> bool:
        return all((row["price"] is not None and row["price"] >= v) if name == "price" else row["region"] in v for name, v in self.tests)

    def read(self, partition: FeedFile) -> Iterator[pa.RecordBatch]:
        if not partition.file:
            return
        system, _ = _opened(self.path)
        adapt, rows = ADAPTERS.get(partition.source, canonical), []
        with system.open_input_stream(partition.file) as stream:
            for line in _lines(stream):
                try:
                    own = {k: adapt(json.loads(line)).get(k) for k in FIELDS} | {"source": partition.source}
                    own["price"] = None if own["price"] is None else float(own["price"])
                except (ValueError, TypeError, KeyError, AttributeError):
                    continue
                if self._passes(own):
                    rows.append(own)
                if len(rows) == 4096:
                    yield _batch(rows)
                    rows = []
        if rows:
            yield _batch(rows)


def _lines(stream) -> Iterator[str]:
    """Lines of a stream, read in pieces."""
    rest = b""
    while piece := stream.read(1 << 20):
        *whole, rest = (rest + piece).split(b"\n")
        yield from (x.decode("utf-8", "replace") for x in whole if x.strip())
    if rest.strip():
        yield rest.decode("utf-8", "replace")


def _batch(rows: list[dict]) -> pa.RecordBatch:
    texts = lambda k: pa.array([None if r[k] is None else str(r[k]) for r in rows], pa.string())
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.float64()) if k == "price" else texts(k) for k in FIELDS], names=list(FIELDS))


class FeedSource(DataSource):
    """``spark.read.format("feeds").load(path)`` after ``spark.dataSource.register(FeedSource)``.

    Filters reach the reader where ``spark.sql.python.filterPushdown.enabled`` is true.
    """

    @classmethod
    def name(cls) -> str:
        return "feeds"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> FeedReader:
        return FeedReader(self.options["path"])
