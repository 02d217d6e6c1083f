"""Shared storage for intermediate tables and the iterative graph operator built on it."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """Folder that all executors share: ``spark.checkpoint.dir``; where that is unset, a temporary one if driver and executors are one process."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def saved(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it back: cuts the lineage and survives lost executors."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def running_sum(rows: DataFrame, order: list[Column], value: Column, name: str = "place") -> DataFrame:
    """``rows`` with the running sum of ``value`` (a long) over a total order, the row itself included; of ones it is the place.

    Rows are written in ranges of the order, the ranges' sums give what lies before each, and the rest is summed
    within a range: no task sees more than one. The driver takes one sum a range. Rows that the order doesn't
    tell apart share a range, so a column that does should end it.
    """
    ranges = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = saved(rows.repartitionByRange(ranges, *order).withColumns({"_range": F.spark_partition_id(), "_value": value.cast("long")}), "ranges")
    sums, before = [], 0
    for r in sorted(parts.groupBy("_range").agg(F.sum("_value").alias("own")).collect()):
        sums.append((r["_range"], before))
        before += r["own"] or 0
    offsets = rows.sparkSession.createDataFrame(sums, "_range int, _before long")
    within = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    summed = parts.join(F.broadcast(offsets), "_range").withColumn(name, F.col("_before") + F.sum("_value").over(within))
    return summed.select(*rows.columns, name)


def connected_components(edges: DataFrame, a: str, b: str, max_rounds: int = 200) -> DataFrame:
    """Components of an undirected graph: ``(node, component)`` with the smallest node of each.

    Every round takes the smallest label among the neighbours and then the label of the own label
    (pointer jumping), so paths shrink geometrically. Labels are written to the shared folder each
    round. Self loops and repeated edges are harmless; nodes without an edge do not appear.
    """
    both = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null")
    both = saved(both.union(both.select(F.col("v"), F.col("u"))).distinct(), "edges")
    labels = saved(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("label")), "labels")
    for _ in range(max_rounds):
        near = both.join(labels.select(F.col("u").alias("v"), "label"), "v").groupBy("u").agg(F.min("label").alias("near"))
        hooked = labels.join(near, "u").select("u", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = hooked.select(F.col("u").alias("label"), F.col("label").alias("next"))
        labels = saved(hooked.join(jump, "label").select("u", "old", F.least("label", "next").alias("label")), "labels")
        moved = labels.where("label <> old").limit(1).count()
        labels = labels.select("u", "label")
        if not moved:
            return labels.select(F.col("u").alias("node"), F.col("label").alias("component"))
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
