"""Row keys, bitmaps over them, and decisions brought back to rows without moving the texts of the others."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_PRIME = np.uint64(0x9E3779B97F4A7C15)
_PIECE = 15


def row_key(text: Column | None = None) -> Column:
    """A 64-bit hash of doc_id and text; null text is empty. Rows that repeat both share it."""
    return F.xxhash64(F.col("doc_id"), F.coalesce(F.col("text") if text is None else text, F.lit("")))


def _slots(keys: np.ndarray, bits: int) -> np.ndarray:
    return ((keys.astype(np.uint64) * _PRIME) >> np.uint64(64 - bits)).astype(np.int64)


def marked(keys: np.ndarray, marks: np.ndarray) -> np.ndarray:
    """Which keys a bitmap may hold; none that it holds is missed."""
    at = _slots(keys, (len(marks) * 8).bit_length() - 1)
    return (marks[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def bitmap(keys: DataFrame, most: int = 27) -> np.ndarray:
    """A bitmap with one bit for each key of the one long column: some other keys share a bit, none is missed.

    16 bits a key, 2^``most`` (16 MB) in all at most; it is put together in pieces of 4 KB.
    """
    bits = int(np.clip((16 * keys.count()).bit_length(), _PIECE, most))

    def slots(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            at = np.unique(_slots(batch["key"].to_numpy(np.int64), bits))
            piece, first = np.unique(at >> _PIECE, return_index=True)
            yield pd.DataFrame({"piece": piece, "places": [x.astype("<u2").tobytes() for x in np.split(at & ((1 << _PIECE) - 1), first[1:])][: len(piece)]})

    def merge(part: pd.DataFrame) -> pd.DataFrame:
        own = np.zeros(1 << _PIECE, bool)
        for places in part["places"]:
            own[np.frombuffer(places, "<u2")] = True
        return pd.DataFrame({"piece": part["piece"].iloc[:1], "own": [np.packbits(own, bitorder="little").tobytes()]})

    marks = np.zeros((1 << (bits - _PIECE), 1 << (_PIECE - 3)), np.uint8)
    for r in keys.toDF("key").mapInPandas(slots, "piece long, places binary").groupBy("piece").applyInPandas(merge, "piece long, own binary").collect():
        marks[r.piece] = np.frombuffer(r.own, np.uint8)
    return marks.reshape(-1)


def may_hold(docs: DataFrame, marks: np.ndarray, key: Column) -> Column:
    """Whether the bitmap may hold a row's key."""
    held = docs.sparkSession.sparkContext.broadcast(marks)

    @F.pandas_udf("boolean")
    def may(keys: pd.Series) -> pd.Series:
        return pd.Series(marked(keys.to_numpy(np.int64), held.value))

    return may(key)


def settle(docs: DataFrame, decided: DataFrame, native: bool = False) -> DataFrame:
    """``docs`` (all columns) without the rows that ``decided`` (key, kept; saved, keys of :func:`row_key`) drops.

    Rows whose key isn't there stay; of rows that repeat a kept key, one stays. A bitmap of the keys (its
    size is bounded) lets all other rows pass where they are, so only rows that may be decided are
    shuffled, by key; the join is exact. A key's rows fall to one task: they are repeats of one row.
    ``native`` leaves the bitmap out: DataFrame operations only, and all rows are shuffled once.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    rows = docs.select(row.alias("row"), row_key().alias("key"))
    may = F.lit(True) if native else may_hold(docs, bitmap(decided.select("key")), F.col("key"))
    asked = rows.where(may).join(decided.groupBy("key").agg(F.max("kept").alias("kept")), "key", "left").where("coalesce(kept, true)")
    own = F.when(F.col("kept").isNull(), F.monotonically_increasing_id())
    once = asked.withColumn("own", own).groupBy("key", "own").agg(F.first("row").alias("row"))
    once = once.select("row.*")
    return once if native else rows.where(~may).select("row.*").unionAll(once)
