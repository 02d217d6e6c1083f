"""Versioned snapshots with sidecar tables, publishing, invoices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bidlake.functions.shared import new_path
from bidlake.streaming.twins import differences

SIDES = ("documents", "terms", "spec")


def write_snapshot(rows: DataFrame, path: str, version: str) -> None:
    """A light feed with counts, and a keyed side table for each heavy column; the pointer is written last.

    Readers follow the pointer, so all tables of a version appear together.
    """
    light = rows.drop(*SIDES).join(rows.select("id", *[F.size(c).alias(f"{c}_count") for c in SIDES]), "id")
    light.write.mode("overwrite").parquet(f"{path}/v={version}/feed")
    for side in SIDES:
        rows.where(F.col(side).isNotNull()).select("id", side).write.mode("overwrite").parquet(f"{path}/v={version}/{side}")
    rows.sparkSession.createDataFrame([(version,)], "version string").coalesce(1).write.mode("overwrite").parquet(f"{path}/pointer")


def read_snapshot(spark, path: str) -> DataFrame:
    """The current version with its sidecars joined back; never-looked (null) stays apart from empty."""
    version = spark.read.parquet(f"{path}/pointer").first()["version"]
    rows = spark.read.parquet(f"{path}/v={version}/feed").drop(*[f"{c}_count" for c in SIDES])
    for side in SIDES:
        rows = rows.join(spark.read.parquet(f"{path}/v={version}/{side}"), "id", "left")
    return rows.withColumn("documents", F.coalesce("documents", F.array().cast("array<string>")))


def with_lots(rows: DataFrame) -> DataFrame:
    """Listings whose lots are missing or empty get one, made of their title and price. lots: array of name, qty, unit, price."""
    lot = F.struct(F.col("title").alias("name"), F.lit(None).cast("double").alias("qty"), F.lit("").alias("unit"), F.col("price").cast("double").alias("price"))
    return rows.withColumn("lots", F.when(F.coalesce(F.size("lots"), F.lit(0)) > 0, F.col("lots")).otherwise(F.array(lot)))


def round_trip(rows: DataFrame) -> DataFrame:
    path = new_path(rows.sparkSession, "snapshot")
    write_snapshot(rows, path, "1")
    return read_snapshot(rows.sparkSession, path)


def published_versions(batches: list[DataFrame]) -> DataFrame:
    """Publishes each batch that differs from the last published one; (version, listings) of those."""
    out, last = None, None
    for i, rows in enumerate(batches, 1):
        if last is None or differences(last, rows).limit(1).count():
            own = rows.agg(F.lit(i).alias("version"), F.count(F.lit(1)).alias("listings"))
            out, last = own if out is None else out.union(own), rows
    return out


def invoices(orders: DataFrame, companies: DataFrame) -> DataFrame:
    """Unpaid first, then newest: VAT within the amount rounded to even, number ``IN-yyyymm-id``."""
    rows = orders.join(companies, orders["o_custkey"] == companies["c_custkey"])
    paid = F.col("o_orderstatus") == "F"
    number = F.concat(F.lit("IN-"), F.date_format("o_orderdate", "yyyyMM"), F.lit("-"), F.col("o_orderkey"))
    return rows.orderBy(paid, F.desc("o_orderdate"), "o_orderkey").select(
        F.col("o_orderkey").alias("id"), F.col("c_name").alias("company"), F.bround(F.col("o_totalprice") * 0.05 / 1.05, 0).cast("long").alias("vat"), number.alias("number"), paid.alias("paid")
    )


def renewed(expires: Column, paid: Column, days: int = 30) -> Column:
    """A subscription's end after a payment: from its present end on if that is still ahead, so paying early loses nothing."""
    return F.greatest(expires, paid) + F.make_dt_interval(F.lit(days))
