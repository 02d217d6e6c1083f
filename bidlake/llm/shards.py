"""Range shards of near equal bytes from size-weighted splitters."""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bidlake.functions.shared import saved

_LOW = 24


def _range_of(bounds: np.ndarray, key: str) -> Column:
    edges = np.sort(bounds)

    @F.pandas_udf("int")
    def of(keys: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(edges, keys.to_numpy(np.int64), side="right").astype(np.int32))

    return of(F.col(key))


def _splitters(rows: DataFrame, total: int, pieces: int, oversample: int, seed: int) -> np.ndarray:
    """Quantile boundaries for ``pieces`` ranges, from about pieces * oversample rows drawn in proportion to size."""
    wanted = pieces * oversample
    rate = F.col("size") * F.lit(wanted / max(total, 1))
    draw = F.shiftrightunsigned(F.xxhash64("key", "doc_id", F.lit(seed)), 11) / F.lit(float(1 << 53))
    sample = rows.where(draw < rate).select("key", F.greatest(rate, F.lit(1.0)).alias("weight")).toPandas().sort_values("key")
    if sample.empty:
        return np.empty(0, np.int64)
    reach = sample["weight"].cumsum().to_numpy()
    cuts = np.searchsorted(reach, reach[-1] * np.arange(1, pieces) / pieces)
    return np.unique(sample["key"].to_numpy(np.int64)[np.minimum(cuts, len(sample) - 1)])


def shard_by_bytes(docs: DataFrame, shards: int = 8, ranges: int | None = None, oversample: int = 32) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row of ``docs``.

    Size is the text's UTF-8 bytes plus one. Rows are ordered by a key that holds the hash of the
    text above the hash of the doc_id, so equal texts lie side by side and a large group of them can
    still be cut. A sample drawn in proportion to size (``ranges`` * ``oversample`` keys at most on
    average, all the driver sees of the rows) gives quantile splitters; ranges with over twice their
    share of the bytes are subdivided by splitters drawn within them until none holds several keys. Each
    range then numbers its rows, the ranges' totals are summed up, and a row goes to the shard in
    which the middle of its bytes falls: shards differ by less than about two rows' size.

    ``ranges`` defaults to the shuffle partitions, 64 at least. Null text counts as empty (size 1).
    Rows that repeat a doc_id and text have the same key and stay in one range. grown_shard is null
    under this law. An empty table gives an empty result; other columns are not read.
    """
    spark = docs.sparkSession
    ranges = ranges or max(64, int(spark.conf.get("spark.sql.shuffle.partitions")))
    text, low = F.coalesce(F.col("text"), F.lit("")), (1 << _LOW) - 1
    key = F.xxhash64(text).bitwiseAND(F.lit(~low)).bitwiseOR(F.xxhash64("doc_id").bitwiseAND(F.lit(low)))
    rows = saved(
        docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), key.alias("key")),
        "shard_keys",
    )
    total = rows.agg(F.sum("size")).first()[0] or 0
    bounds = _splitters(rows, total, ranges, oversample, 0)
    for attempt in itertools.count():
        placed = rows.withColumn("range", _range_of(bounds, "key"))
        sums = placed.groupBy("range").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"), F.min("key").alias("lo"), F.max("key").alias("hi"))
        sums = sums.toPandas().sort_values("range")
        over = sums[(sums["bytes"] > 2 * total / ranges) & (sums["lo"] < sums["hi"])]
        if over.empty:
            break
        inside = placed.where(F.col("range").isin(over["range"].tolist()))
        excess = int(over["bytes"].sum())
        more = _splitters(inside, excess, max(2, 2 * ranges * excess // max(total, 1)), oversample, attempt + 1)
        bounds = np.unique(np.concatenate([bounds, more, over["hi"].to_numpy(np.int64)]))
    if sums.empty:
        sums = pd.DataFrame({"range": [0], "bytes": [0], "rows": [0]})
    base = pd.DataFrame({"range": sums["range"].astype("int32"), "bytes_before": sums["bytes"].cumsum() - sums["bytes"], "rows_before": sums["rows"].cumsum() - sums["rows"]})
    order = Window.partitionBy("range").orderBy("key", "doc_id", "size", "text_crc32")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    at = (
        placed.withColumns({"upto": F.sum("size").over(upto), "nth": F.row_number().over(order)})
        .join(F.broadcast(spark.createDataFrame(base, "range int, bytes_before long, rows_before long")), "range")
        .select(
            "doc_id", "size", "text_crc32",
            F.expr(f"cast(least({shards - 1}, ((bytes_before + upto) * 2 - size) * {shards} div {2 * max(total, 1)}) as int)").alias("shard"),
            (F.col("rows_before") + F.col("nth") - 1).alias("place"),
        )
    )
    at = saved(at, "shard_places")
    firsts = at.groupBy("shard").agg(F.min("place").alias("first"))
    return at.join(F.broadcast(firsts), "shard").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("place") - F.col("first")).alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )


def write_shards(docs: DataFrame, placed: DataFrame, path: str) -> None:
    """The documents as one folder per shard, in slot order within each file; doc_id must be unique."""
    rows = docs.join(placed.select("doc_id", "shard", "slot"), "doc_id")
    rows.repartition("shard", F.floor(F.col("slot") / 100_000)).sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
