"""WARC archives in capture-key order with a two-level capture index."""

from __future__ import annotations

import base64
import bisect
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bidlake.functions.shared import new_path, saved

REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_BLOCK = "archive long, block int, first_key string, last_key string, records int, index_file string, index_at long, index_bytes long, warc_file string, warc_at long, warc_bytes long"
_CAPTURE = "key string, page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string"
_HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "
_SLAB, _PIECE = 1 << 19, 1 << 23
_ARCHIVES = 1 << 20  # at most in one range


def capture_key(url: Column, page_id: Column) -> Column:
    """Reversed host, path and capture number: ``com,example)/a 17``. Null parts are written as ``-``."""
    plain = F.regexp_replace(F.coalesce(url, F.lit("-")), r"\s", "%20")
    host = F.lower(F.regexp_extract(plain, r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//(?:[^/@?#]*@)?([^/?#]*)", 1))
    path = F.regexp_replace(plain, r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//[^/?#]*", "")
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), path, F.lit(" "), F.coalesce(page_id.cast("string"), F.lit("-")))


def _same(payload: Column) -> Column:
    """Equal exactly for equal payloads: length, SHA-1 and SHA-256."""
    return F.concat_ws(" ", F.octet_length(payload), F.sha1(payload), F.sha2(payload, 256))


def revisits(pages: DataFrame, min_bytes: int = 0, salts: int = 32) -> DataFrame:
    """key, same and refers_to of the pages that repeat another page's payload: the one of the smallest page_id.

    Payloads are known by length, SHA-1 and SHA-256 together and do not move. Only (payload, salt) groups
    are merged across the cluster, so a payload shared by a third of all pages is dealt over ``salts`` tasks
    by page_id and url.
    """
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.where(F.octet_length(payload) >= min_bytes).select(
        "page_id", capture_key(F.col("url"), F.col("page_id")).alias("key"), _same(payload).alias("same"), F.pmod(F.xxhash64("page_id", "url"), F.lit(salts)).cast("int").alias("salt")
    )
    by_salt = rows.groupBy("same", "salt").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
    groups = by_salt.groupBy("same").agg(F.min("first").alias("first"), F.sum("n").alias("n"), F.collect_list("salt").alias("salts")).where("n > 1")
    joined = rows.join(groups.select("same", "first", F.explode("salts").alias("salt")), ["same", "salt"])
    return joined.where("not (page_id <=> first)").select("key", "same", F.col("first").alias("refers_to"))


def _header(key: str, page_id: int | None, url: str | None, http: bytes, sha1: bytes, block_sha1: bytes, length: int, refers_to: int | None, date: str) -> bytes:
    """Headers of one WARC/1.1 record up to its payload. A revisit carries the HTTP header with the payload's length, not the payload."""
    name = lambda page: f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page}')}>"
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {name(page_id)}",
        f"WARC-Date: {date}",
        f"WARC-Capture: {json.dumps({'key': key, 'page_id': page_id, 'url': url, 'refers_to': refers_to})}",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(sha1).decode()}",
        f"WARC-Block-Digest: sha1:{base64.b32encode(block_sha1).decode()}",
    ]
    if url is not None:
        head.append("WARC-Target-URI: " + url.encode("unicode_escape").decode().replace(" ", "%20"))
    if refers_to is not None:
        head += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: {name(refers_to)}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {length}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + http


class _Archives:
    """Archives and their index files of one task: rolled over by size, blocks closed by records or bytes."""

    def __init__(self, path: str, first: int, tag: str, block_records: int, block_bytes: int, archive_bytes: int):
        from pyarrow import fs

        self.store, self.folder = fs.FileSystem.from_uri(path)
        self.store.create_dir(self.folder, recursive=True)
        self.limits, self.tag, self.next = (block_records, block_bytes, archive_bytes), tag, first
        self.warc = self.index = None
        self.lines: list[tuple[str, int, int]] = []
        self.closed: list[dict] = []

    def begin(self) -> None:
        if self.warc is None:
            self.names = {"archive": self.next, "warc_file": f"{self.tag}-{self.next % _ARCHIVES}.warc.gz", "index_file": f"{self.tag}-{self.next % _ARCHIVES}.cdx.z"}
            self.warc, self.index = (self.store.open_output_stream(f"{self.folder}/{self.names[x]}", compression=None) for x in ("warc_file", "index_file"))
            self.next, self.at, self.block = self.next + 1, 0, 0
        self.start, self.gzip = self.at, zlib.compressobj(3, zlib.DEFLATED, 31)

    def write(self, data: bytes) -> None:
        packed = self.gzip.compress(data)
        self.warc.write(packed)
        self.at += len(packed)

    def end(self, key: str) -> None:
        self.write(b"\r\n\r\n")
        packed = self.gzip.flush()
        self.warc.write(packed)
        self.at += len(packed)
        self.lines.append((key, self.start, self.at - self.start))
        records, size, archive = self.limits
        if len(self.lines) >= records or self.at - self.lines[0][1] >= size:
            self.close_block()
        if self.at >= archive:
            self.close()

    def close_block(self) -> None:
        lines = self.lines
        if lines:
            packed = zlib.compress("\n".join(f"{k} {o} {n}" for k, o, n in lines).encode(), 6)
            self.closed.append({**self.names, "block": self.block, "first_key": lines[0][0], "last_key": lines[-1][0], "records": len(lines),
                                "index_at": self.index.tell(), "index_bytes": len(packed), "warc_at": lines[0][1], "warc_bytes": self.at - lines[0][1]})
            self.index.write(packed)
            self.lines, self.block = [], self.block + 1

    def close(self) -> None:
        if self.warc is not None:
            self.close_block()
            self.warc.close()
            self.index.close()
            self.warc = None


def write_archives(
    pages: DataFrame, path: str, block_records: int = 256, block_bytes: int = 4 << 20, archive_bytes: int = 1 << 30, parts: int | None = None, date: str = "1970-01-01T00:00:00Z", min_bytes: int = 0
) -> DataFrame:
    """Writes archives and their index files by key range under ``path``; returns the sparse block directory.

    Payloads move once, in slabs of 512 KB dealt by key range, so a task holds slabs and never a long page
    whole; their digests are taken before. What :func:`revisits` found comes with them, one small row per
    revisit that sorts before its page. Records are gzip members in key order; every ``block_records`` of
    them, or ``block_bytes``, have their index lines (key, offset, length) compressed into one block of the
    index file, and the directory has a row per block with its first and last key and where both the
    block and its records lie. An archive of ``archive_bytes`` is followed by another. Files carry the task
    attempt in their names and only the attempts that Spark accepted are named in the directory, so a
    repeated task does no harm.
    """
    spark = pages.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        out = _Archives(path, task.partitionId() * _ARCHIVES, f"part-{task.partitionId():06d}-{task.taskAttemptId()}", block_records, block_bytes, archive_bytes)
        told, told_key = {}, None
        revisit = False
        for batch in batches:
            slabs = batch.column("slab")
            rows = zip(*(batch.column(c).to_pylist() for c in ("key", "same", "refers_to", "mark", "page_id", "url", "n", "sha1", "block_sha1", "at", "slabs")), strict=True)
            for i, (key, same, refers, mark, page, url, n, sha1, block_sha1, at, count) in enumerate(rows):
                if key != told_key:
                    told, told_key = {}, key
                if mark:
                    told[same] = refers
                    continue
                if at == 0:
                    first = told.get(same)
                    revisit = first is not None
                    http = f"{_HTTP}{n}\r\n\r\n".encode()
                    block = hashlib.sha1(http).digest() if revisit else bytes.fromhex(block_sha1)
                    out.begin()
                    out.write(_header(key, page, url, http, bytes.fromhex(sha1), block, len(http) + (0 if revisit else n), first, date))
                if not revisit:
                    out.write(slabs[i].as_buffer())
                if at == count - 1:
                    out.end(key)
        out.close()
        if out.closed:
            table = pd.DataFrame(out.closed)[[x.split()[0] for x in _BLOCK.split(", ")]].astype({"block": "int32", "records": "int32"})
            yield from pa.Table.from_pandas(table, preserve_index=False).to_batches()

    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    none = lambda kind: F.lit(None).cast(kind)
    whole = pages.select(capture_key(F.col("url"), F.col("page_id")).alias("key"), F.col("page_id").cast("long").alias("page_id"), "url", payload.alias("payload"), F.monotonically_increasing_id().alias("row"))
    n = F.octet_length("payload")
    http = F.concat(F.lit(_HTTP), n.cast("string"), F.lit("\r\n\r\n")).cast("binary")

    def cut(column: str, size: int) -> Column:
        last = F.floor(F.greatest(F.octet_length(column) - 1, F.lit(0)) / size).cast("int")
        return F.posexplode(F.transform(F.sequence(F.lit(0), last), lambda i: F.col(column).substr(i * size + 1, F.lit(size))))

    # In two steps, as each cut copies what it cuts from.
    captured = (
        whole.select(
            "key", _same(F.col("payload")).alias("same"), none("long").alias("refers_to"), F.lit(False).alias("mark"), "page_id", "url", n.cast("long").alias("n"),
            F.sha1("payload").alias("sha1"), F.sha1(F.concat(http, F.col("payload"))).alias("block_sha1"), "row", cut("payload", _PIECE).alias("piece", "body"),
        )
        .select("*", cut("body", _SLAB).alias("within", "slab"))
        .withColumn("at", F.col("piece") * (_PIECE // _SLAB) + F.col("within"))
        .withColumn("slabs", F.floor(F.greatest(F.col("n") - 1, F.lit(0)) / _SLAB).cast("int") + 1)
        .drop("piece", "body", "within")
    )
    marks = revisits(pages, min_bytes).distinct().select(
        "key", "same", F.col("refers_to").cast("long").alias("refers_to"), F.lit(True).alias("mark"),
        *[none(captured.schema[c].dataType).alias(c) for c in ("page_id", "url", "n", "sha1", "block_sha1", "row", "slab", "at", "slabs")],
    )
    rows = captured.unionByName(marks).repartitionByRange(parts, "key").sortWithinPartitions("key", F.col("mark").desc(), "row", "at")
    return saved(rows.mapInArrow(write, _BLOCK), "warc_directory")


def _member(slabs: Iterator[bytes], want_payload: bool) -> dict:
    """One record from the slabs of its gzip member; its digest is checked without holding the payload unless that is asked for."""
    gunzip, head, kept, digest, n = zlib.decompressobj(31), b"", [], hashlib.sha1(), 0
    fields = capture = None
    for packed in slabs:
        while packed:
            data = gunzip.decompress(packed, _SLAB)
            packed = gunzip.unconsumed_tail
            if fields is None:
                head += data
                parts = head.split(b"\r\n\r\n", 2)
                if len(parts) < 3:
                    continue
                fields = dict(x.split(": ", 1) for x in parts[0].decode().split("\r\n")[1:])
                capture, revisit = json.loads(fields["WARC-Capture"]), fields["WARC-Type"] == "revisit"
                long = int(parts[1].rpartition(b"Content-Length: ")[2])
                left, data = (0 if revisit else long), parts[2]
            data = data[: left - n]
            n += len(data)
            digest.update(data)
            if want_payload:
                kept.append(data)
    told = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if not gunzip.eof or not revisit and (n != long or base64.b32encode(digest.digest()).decode() != told):
        raise ValueError(f"damaged record of {capture['key']}")
    return {**capture, "record_type": fields["WARC-Type"], "payload_bytes": long, "payload_digest": told, "payload": None if revisit else b"".join(kept)}


def lookup(directory: DataFrame, path: str, keys: DataFrame, payload: bool = True) -> DataFrame:
    """The captures of ``keys`` (one string column ``key``), with payload unless that is off; several if a key was captured repeatedly.

    The directory's key ranges (one per archive, all that reaches the driver) deal the distinct keys to
    archives. A task reads the sparse directory of an archive, which sorts before the archive's keys, and
    streams the keys: each is binary-searched in the directory, then in its index block, and its records
    are fetched by range reads, in slabs. Results leave in batches of bounded bytes.
    """
    spans = directory.groupBy("archive").agg(F.min("first_key").alias("lo"), F.max("last_key").alias("hi")).toPandas().sort_values(["lo", "archive"])
    lows, highs, ids = spans["lo"].tolist(), spans["hi"].tolist(), spans["archive"].tolist()
    schema = _CAPTURE + ", payload binary" * payload
    names = [x.split()[0] for x in schema.split(", ")]
    kinds = pa.schema([(n, {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}[k]) for n, k in (x.split() for x in schema.split(", "))])

    @F.pandas_udf("array<long>")
    def archives(keys: pd.Series) -> pd.Series:
        # A key that fills several archives is the last of one and the first of the next.
        return pd.Series([ids[bisect.bisect_left(highs, k) : bisect.bisect_right(lows, k)] for k in keys])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, folder = fs.FileSystem.from_uri(path)
        blocks, lasts, firsts, archive, files, held, held_at = [], [], [], None, [], [], -1
        found, size = [], 0

        def slabs(start: int, length: int) -> Iterator[bytes]:
            for at in range(start, start + length, _SLAB):
                yield files[1].read_at(min(_SLAB, start + length - at), at)

        def batch_out() -> pa.RecordBatch:
            out = pa.RecordBatch.from_pylist([{c: f[c] for c in names} for f in found], kinds)
            found.clear()
            return out

        for batch in batches:
            for row in batch.to_pylist():
                if row["archive"] != archive:
                    archive, blocks, lasts, firsts, held_at = row["archive"], [], [], [], -1
                    for f in files:
                        f.close()
                    files = []
                if row["key"] is None:
                    blocks.append(row)
                    lasts.append(row["last_key"])
                    firsts.append(row["first_key"])
                    continue
                key = row["key"]
                for at in range(bisect.bisect_left(lasts, key), bisect.bisect_right(firsts, key)):
                    files = files or [store.open_input_file(f"{folder}/{blocks[0][f]}") for f in ("index_file", "warc_file")]
                    if at != held_at:
                        text = zlib.decompress(files[0].read_at(blocks[at]["index_bytes"], blocks[at]["index_at"])).decode()
                        held, held_at = [x.rsplit(" ", 2) for x in text.split("\n")], at
                    lo, hi = (side(held, key, key=lambda x: x[0]) for side in (bisect.bisect_left, bisect.bisect_right))
                    for _, start, length in held[lo:hi]:
                        found.append(_member(slabs(int(start), int(length)), payload))
                        size += len(found[-1]["payload"] or b"")
                        if len(found) >= 1000 or size >= 8 << 20:
                            yield batch_out()
                            size = 0
        if found:
            yield batch_out()
        for f in files:
            f.close()

    columns = ["index_file", "index_at", "index_bytes", "warc_file", "first_key", "last_key", "block"]
    dealt = keys.distinct().where("key is not null").select("key", F.explode(archives("key")).alias("archive"))
    sparse = directory.select("archive", *columns, F.lit(None).cast("string").alias("key"))
    both = dealt.select("archive", *[F.lit(None).cast(directory.schema[c].dataType).alias(c) for c in columns], "key").unionByName(sparse)
    # A given number of partitions, as the few bytes of a key stand for a whole record to read.
    sorted_rows = both.repartition(max(1, len(ids)), "archive").sortWithinPartitions("archive", F.col("key").asc_nulls_first(), "block")
    return sorted_rows.mapInArrow(search, schema)


def read_index(spark: SparkSession, directory: DataFrame, path: str) -> DataFrame:
    """All index lines: archive, key, offset and length, read block by block."""

    def lines(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        store, folder = fs.FileSystem.from_uri(path)
        for batch in batches:
            for row in batch.itertuples():
                with store.open_input_file(f"{folder}/{row.index_file}") as index:
                    text = zlib.decompress(index.read_at(row.index_bytes, row.index_at)).decode()
                out = pd.DataFrame([x.rsplit(" ", 2) for x in text.split("\n")], columns=["key", "offset", "length"])
                yield out.astype({"offset": "int64", "length": "int64"}).assign(archive=row.archive)[["archive", "key", "offset", "length"]]

    return directory.mapInPandas(lines, "archive long, key string, offset long, length long")


def archive_round_trip(pages: DataFrame, path: str | None = None, payload: bool = True, **options) -> DataFrame:
    """Writes ``pages`` (page_id, url, html) as archives and looks every page up again through the index.

    Returns page_id, url, record_type, refers_to, payload_bytes, payload_digest and, unless that is off,
    payload (null for a revisit), one row per page. Payloads are written and read back in slabs, digests checked. Null html is an empty payload; null url and null page_id are indexed
    as ``-``. Repeated rows with a group's smallest page_id are a response each; a page without an id
    never names a group unless it has no other member. No pages give no rows. Other columns are not read.
    """
    path = path or new_path(pages.sparkSession, "warc")
    directory = write_archives(pages, path, **options)
    return lookup(directory, path, pages.select(capture_key(F.col("url"), F.col("page_id")).alias("key")), payload).drop("key")


__all__ = ["archive_round_trip", "capture_key", "lookup", "read_index", "revisits", "write_archives"]
