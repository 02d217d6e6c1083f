"""A snapshot built over runs: what sources show is merged into a store, expired listings go, files are read under a budget, changes are published."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bidlake.functions.shared import saved
from bidlake.operators.enrich import enrich
from bidlake.operators.search import nearest
from bidlake.streaming.twins import accumulate, eviction, first_seen

#: A listing in the store; every run's sources have the columns up to docs_fetched.
LISTING = "id long, title string, region string, price double, end_ts timestamp_ntz, docs_fetched boolean, doc string, terms array<string>, items array<string>, seen_at timestamp_ntz"
#: What a fresh listing leaves as it was where it says nothing.
CARRY = ["region", "end_ts", "docs_fetched", "doc", "terms", "items"]
CACHE = "id long, status string, doc string, terms array<string>, items array<string>"


def content_hash(rows: DataFrame) -> str:
    """One hash of a table that doesn't depend on the order of its rows: their number and the sums of two hashes of each row."""
    cells = [F.col(f"`{c}`") for c in sorted(rows.columns)]
    total = lambda h: F.coalesce(F.sum(h.cast("decimal(38,0)")), F.lit(0)).cast("string")
    parts = rows.agg(F.count(F.lit(1)).cast("string"), total(F.xxhash64(*cells)), total(F.xxhash64(F.lit("again"), *cells))).first()
    return "-".join(parts)


def _current(spark: SparkSession, path: str) -> tuple[int, int, str]:
    """Number of the last run, the version it left published and that one's hash; zeros before the first run."""
    fs = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/runs")
    if not fs.getFileSystem(spark._jsc.hadoopConfiguration()).exists(fs):
        return 0, 0, ""
    last = spark.read.parquet(f"{path}/runs").orderBy(F.desc("run")).first()
    return last["run"], last["version"], last["hash"]


def read_published(spark: SparkSession, path: str) -> DataFrame:
    """The feed that the last run left published, with its ``version``."""
    _, version, _ = _current(spark, path)
    return spark.read.parquet(f"{path}/feed/{version}").withColumn("version", F.lit(version))


def build_snapshot(sources: list[DataFrame], documents: DataFrame, parsed: DataFrame, path: str, now: Column, budget: int, most: int, ttl_days: int = 30) -> dict[str, int]:
    """One run of the build under ``path``; what it did as counts.

    Of listings that several sources show the first source's counts. They are merged into the store of the last run,
    what they don't say is carried over, and listings that ended, or have no end and weren't seen for ``ttl_days``,
    go. Attachments are read within the budget and what is known of a listing is never lost. The ``most`` listings that end
    soonest are the feed. It is written as a new version only if its hash differs from the published one; the row that
    names run and version is appended last, so readers see a whole run or none, and a run that was cut short
    leaves the last one in place.
    """
    spark = documents.sparkSession
    run, version, old_hash = _current(spark, path)
    said = [c.split()[0] for c in LISTING.split(", ")][:6]
    nothing = {"doc": "string", "terms": "array<string>", "items": "array<string>"}
    fresh = first_seen([s.select(*said) for s in sources], "id", []).drop("pool")
    fresh = fresh.withColumn("docs_fetched", F.when(F.col("docs_fetched"), True)).withColumns({c: F.lit(None).cast(kind) for c, kind in nothing.items()})
    store = spark.read.parquet(f"{path}/store/{run}").drop("status") if run else spark.createDataFrame([], LISTING)
    cache = spark.read.parquet(f"{path}/cache/{run}") if run else spark.createDataFrame([], CACHE)
    merged = saved(accumulate(store, fresh, now, CARRY), "merged")
    live = merged.where(eviction(F.col("end_ts"), F.col("seen_at"), now, ttl_days).isNull())
    known = live.withColumn("docs_fetched", F.coalesce("docs_fetched", F.lit(False)))
    after, cache = enrich(known, documents, parsed, cache, budget)
    rows = live.drop("doc", "terms", "items", "is_new").join(after, "id")
    rows.select(*store.columns, "status").write.mode("overwrite").parquet(f"{path}/store/{run + 1}")
    rows = spark.read.parquet(f"{path}/store/{run + 1}")
    cache.write.mode("overwrite").parquet(f"{path}/cache/{run + 1}")
    feed = saved(nearest(rows.drop("seen_at"), most, [F.col("end_ts").asc_nulls_last(), F.col("id").asc()]), "feed")
    new_hash = content_hash(feed)
    if new_hash != old_hash:
        version = run + 1
        feed.write.mode("overwrite").parquet(f"{path}/feed/{version}")
    spark.createDataFrame([(run + 1, version, new_hash)], "run int, version int, hash string").coalesce(1).write.mode("append").parquet(f"{path}/runs")
    counts = merged.agg(F.count(F.lit(1)).alias("all"), F.count_if("is_new").alias("new")).first()
    return {"run": run + 1, "version": version, "new": counts["new"], "expired": counts["all"] - rows.count(), "listings": feed.count()}
