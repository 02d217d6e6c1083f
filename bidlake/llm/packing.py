"""Best-fit-decreasing packing of token pieces into sequences."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bidlake.functions.shared import saved
from bidlake.llm.tokens import MEMORY, default_tokenizer, encoder, forget

_AT_ONCE = 128
#: Buckets of a length at most, so that the counts by length and bucket stay small whatever the number of partitions.
_BUCKETS = 128


class CapacityTree:
    """Segment tree over remaining capacities 0..capacity: is any bin open there, and the least such from a bound."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.bins = [0] * (2 * self.leaves)

    def add(self, remaining: int, bins: int) -> None:
        at = self.leaves + remaining
        while at:
            self.bins[at] += bins
            at //= 2

    def tightest(self, least: int) -> int | None:
        """The smallest remaining capacity of at least ``least`` that an open bin has."""
        at = self.leaves + least
        if not self.bins[at]:
            while at % 2 or not self.bins[at + 1]:
                at //= 2
                if at <= 1:
                    return None
            at += 1
            while at < self.leaves:
                at = 2 * at + (not self.bins[2 * at])
        return at - self.leaves


def best_fit_plan(counts: dict[int, int], capacity: int) -> pd.DataFrame:
    """Best-fit decreasing over a histogram of lengths: where the n-th piece of each length goes.

    Bins that have the same remaining capacity are interchangeable, so they are kept as ranges of
    numbers and a length fills whole ranges at a time. The result is the same as piece by piece: a bin
    that still has room for the same length after taking one is the tightest for the next. Rows:
    length, first (rank), bin (number of the range's first), each (pieces a bin takes), offset. A
    length splits at most one range and opens at most two, and a bin that takes a length is left with
    less than half its room, so there are at most about 4 * capacity * log2(capacity) rows, whatever
    the number of pieces.
    """
    tree, open_bins, rows, bins = CapacityTree(capacity), [[] for _ in range(capacity + 1)], [], 0

    def put(remaining: int, base: int, n: int) -> None:
        if n:
            open_bins[remaining].append((base, n))
            tree.add(remaining, n)

    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            room = tree.tightest(length)
            if room is None:
                room, base = capacity, bins
                n = -(-left // (capacity // length))
                bins += n
            else:
                base, n = open_bins[room].pop()
                tree.add(room, -n)
            each = room // length
            full, rest = min(n, left // each), 0
            if full:
                rows.append((length, rank, base, each, capacity - room))
                put(room - each * length, base, full)
            if full < n:
                rest = min(left - full * each, each)
                if rest:
                    rows.append((length, rank + full * each, base + full, rest, capacity - room))
                put(room - rest * length, base + full, bool(rest))
                put(room, base + full + bool(rest), n - full - bool(rest))
            rank, left = rank + full * each + rest, left - full * each - rest
    return pd.DataFrame(rows, columns=["length", "first", "bin", "each", "offset"], dtype="int64")


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int, end_id: int, with_ids: bool, memory: int = MEMORY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and, if asked for, ids (unsigned 32-bit, little-endian)."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pa.default_memory_pool().release_unused()  # what batches of earlier stages took
        encode = encoder(tokenizer, memory=memory).encode
        for batch in batches:
            for lo in range(0, batch.num_rows, _AT_ONCE):
                part = batch.slice(lo, _AT_ONCE)
                rows = []
                for doc, ids in zip(part["doc_id"].to_pylist(), encode(part["text"].to_pylist()), strict=True):
                    data = ids.tobytes() + np.array([end_id], "<u4").tobytes()
                    n, start, piece = len(data) // 4, 0, 0
                    while start < n:
                        length = (n - start - 1) % capacity + 1
                        own = data[4 * start : 4 * (start + length)]
                        rows.append((doc, piece, start, length, zlib.crc32(own), own))
                        start, piece = start + length, piece + 1
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=False)], names)

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    names = [x.split()[0] for x in schema.split(", ")]
    types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()][: len(names)]
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(cut, schema)


def pack(docs: DataFrame, tokenizer: str | None = None, capacity: int = 2048, end_id: int = 0, with_ids: bool = True, buckets: int | None = None, memory: int = MEMORY) -> DataFrame:
    """Every piece of every document with its sequence_id and offset, and its ids unless ``with_ids`` is off.

    A document is its ids and ``end_id``; only one of more than ``capacity`` is cut, into full pieces
    after a first that may be shorter. The bins are those of best-fit decreasing over all pieces: the
    histogram of lengths (``capacity`` rows at most) settles the plan, and a piece finds its place by
    its rank among the pieces of its length. Ranks are counted within (length, bucket) and shifted by
    what the lower buckets hold, so no length meets in one task. Those counts (``capacity`` times ``buckets`` rows at
    most) go to every task with the plan: one shuffle and one sort place the pieces.

    Null text is empty (one piece with only ``end_id``). Repeated rows are packed like others, null
    doc_ids too. An empty table gives an empty result; other columns are not read. ``memory`` bounds the pieces of text
    that a worker remembers and changes no result.
    """
    spark = docs.sparkSession
    buckets = buckets or min(_BUCKETS, 2 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    own = F.pmod(F.xxhash64("doc_id", "piece"), F.lit(buckets)).cast("int").alias("bucket")
    pieces = saved(token_pieces(docs, tokenizer or default_tokenizer(), capacity, end_id, with_ids, memory).select("*", own, F.monotonically_increasing_id().alias("row")), "pieces")
    held = pieces.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n")).toArrow()
    cells = held["length"].to_numpy() * buckets + held["bucket"].to_numpy()
    cells, n = cells[by := np.argsort(cells)], held["n"].to_numpy()[by]
    lengths, at, per = np.unique(cells // buckets, return_index=True, return_counts=True)
    through = np.cumsum(n)
    base = through - n
    base -= np.repeat(base[at], per)  # what a length's lower buckets hold
    counts = np.add.reduceat(n, at) if len(n) else n
    plan = best_fit_plan(dict(zip(lengths.tolist(), counts.tolist(), strict=True)), capacity)
    starts = (plan["length"].to_numpy() << 44) + plan["first"].to_numpy()
    order = np.argsort(starts)
    starts, columns = starts[order], {c: plan[c].to_numpy()[order] for c in ("first", "bin", "each", "offset")}

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, bucket: pd.Series, nth: pd.Series) -> pd.DataFrame:
        forget()
        length = length.to_numpy()
        rank = base[np.searchsorted(cells, length * buckets + bucket.to_numpy())] + nth.to_numpy()
        at = np.searchsorted(starts, (length << 44) + rank, side="right") - 1
        beyond = rank - columns["first"][at]
        each = columns["each"][at]
        return pd.DataFrame({"sequence_id": columns["bin"][at] + beyond // each, "offset": columns["offset"][at] + beyond % each * length})

    nth = F.row_number().over(Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32")) - 1
    placed = pieces.drop("ids").withColumn("nth", nth).withColumn("at", place("length", "bucket", "nth"))
    if with_ids:  # they join their places once those are known
        placed = placed.join(pieces.select("row", "ids"), "row")
    return placed.select(*[c for c in pieces.columns if c not in ("bucket", "row")], "at.sequence_id", "at.offset")


def sequences(packed: DataFrame) -> DataFrame:
    """The packed sequences themselves: sequence_id, tokens and ids in offset order (a sequence holds ``capacity`` ids at most)."""
    inside = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.sum("length").alias("tokens"), inside.alias("parts")).select(
        "sequence_id", "tokens", F.aggregate("parts", F.lit(b"").cast("binary"), lambda a, p: F.concat(a, p["ids"])).alias("ids")
    )
