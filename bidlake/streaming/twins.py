"""Batch forms of the incremental operators: accumulation, eviction, versions, alerts, lockouts, notices, ledgers."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def empty(c: Column, kind: str) -> Column:
    """Null, or an empty text or array; an empty value never erases a carried one."""
    if kind == "string":
        return c.isNull() | (c == "")
    if kind.startswith("array"):
        return c.isNull() | (F.size(c) == 0)
    return c.isNull()


def accumulate(store: DataFrame, fresh: DataFrame, now: Column, carry: list[str], key: str = "id") -> DataFrame:
    """Upsert: fresh rows win field by field, but carry fields that are empty keep the stored value.

    Both have ``seen_at``; rows in ``fresh`` are seen now. ``is_new`` marks keys not stored before.
    """
    a, b = store.alias("a"), fresh.alias("b")
    kinds = dict(store.dtypes)
    here = F.col(f"b.{key}").isNotNull()
    out = [F.coalesce(F.col(f"b.{key}"), F.col(f"a.{key}")).alias(key)]
    for c in store.columns:
        if c in (key, "seen_at"):
            continue
        new, old = F.col(f"b.{c}"), F.col(f"a.{c}")
        out.append((F.when(here & ~empty(new, kinds[c]), new).otherwise(old) if c in carry else F.when(here, new).otherwise(old)).alias(c))
    out += [F.when(here, now).otherwise(F.col("a.seen_at")).alias("seen_at"), (here & F.col(f"a.{key}").isNull()).alias("is_new")]
    return a.join(b, F.col(f"a.{key}") == F.col(f"b.{key}"), "full").select(*out)


def eviction(end: Column, seen_at: Column, now: Column, ttl_days: int = 30) -> Column:
    """``expired`` at or after the end; ``stale`` without an end and not seen for the time to live; else null."""
    return F.when(end <= now, "expired").when(end.isNull() & (seen_at < now - F.make_dt_interval(F.lit(ttl_days))), "stale")


def classify_versions(runs: DataFrame, on: list[str], order: str) -> DataFrame:
    """change: material for another fingerprint, formal for another source time alone, else unchanged; sticky: the highest so far.

    runs: keys, order, content_hash, updated_at. The first run is unchanged.
    """
    w = Window.partitionBy(*on).orderBy(order)
    before = lambda c: F.lag(c).over(w)
    first = F.row_number().over(w) == 1
    level = F.when(first, 0).when(~F.col("content_hash").eqNullSafe(before("content_hash")), 2).when(~F.col("updated_at").eqNullSafe(before("updated_at")), 1).otherwise(0)
    rows = runs.withColumn("level", level)
    name = lambda c: F.when(c == 2, "material").when(c == 1, "formal").otherwise("unchanged")
    top = F.max("level").over(w.rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumns({"change": name(F.col("level")), "sticky": name(top)}).drop("level")


def window_alerts(events: DataFrame, key: str, seconds: int, hits: int) -> DataFrame:
    """Events that are at least the ``hits``-th of their key within the last ``seconds``, with the time to wait."""
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    w = Window.partitionBy(key).orderBy("at").rangeBetween(-seconds * 1_000_000, 0)
    rows = events.withColumn("at", at).withColumns({"recent": F.count(F.lit(1)).over(w), "first": F.min("at").over(w)})
    return rows.where(F.col("recent") >= hits).withColumn("retry_after", F.ceil((F.col("first") + seconds * 1_000_000 - F.col("at")) / 1e6).cast("long")).drop("at", "first")


def lockouts(events: DataFrame, failures: int = 5, seconds: int = 900) -> DataFrame:
    """(key, ts): moments at which a key is locked. events: key, ts, ok.

    ``failures`` in a row lock for ``seconds``; attempts while locked are refused and change nothing. A lock
    that runs out does not clear the count, so the next failure locks again; success resets it.
    """

    lock = pd.Timedelta(seconds=seconds)

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, count, until = None, 0, None
        for batch in batches:
            out = []
            for key, ts, ok in batch.itertuples(index=False):
                if key != now:
                    now, count, until = key, 0, None
                if until is not None and ts < until:
                    continue
                count = 0 if ok else count + 1
                if count >= failures:
                    until = ts + lock
                    out.append((key, ts))
            yield pd.DataFrame(out, columns=["key", "ts"]).astype({"ts": "datetime64[ns]"})

    # A key's events come one after the other in a task, in batches; only three values are kept between them.
    ordered = events.where("key is not null").select("key", "ts", F.coalesce("ok", F.lit(False)).alias("ok")).repartition("key").sortWithinPartitions("key", "ts")
    return ordered.mapInPandas(fold, "key long, ts timestamp_ntz")


def expiry_notices(rows: DataFrame, sent: DataFrame, now: Column) -> DataFrame:
    """Accounts to remind once per expiry: it lies within the lead (1 day demo, 7 days paid), no renewal, a contact known."""
    lead = F.when(F.col("plan") == "demo", F.make_dt_interval(F.lit(1))).otherwise(F.make_dt_interval(F.lit(7)))
    due = (F.col("expires") >= now) & (F.col("expires") <= now + lead) & ~F.col("auto_renew") & F.col("contact").isNotNull()
    return rows.where(due).join(sent, ["account", "expires"], "left_anti")


def backfill_slices(ledger: DataFrame, days: int, k: int, today: Column, laws: list[str]) -> DataFrame:
    """The ``k`` (law, day) slices to sweep: not done, never touched first, then the oldest touch, then the latest day."""
    spark = ledger.sparkSession
    dim = spark.createDataFrame([(x,) for x in laws], "law string")
    live = dim.select("law", F.explode(F.sequence(F.lit(1), F.lit(days))).alias("back")).withColumn("day", F.date_sub(today, F.col("back")))
    rows = live.join(ledger, ["law", "day"], "left").where(~F.coalesce("done", F.lit(False)))
    return rows.orderBy(F.coalesce("swept_at", F.lit(-1)), "back", "law").limit(k).select("law", "day", F.coalesce("page", F.lit(1)).alias("page"))


def ledger_stats(ledger: DataFrame) -> DataFrame:
    return ledger.agg(F.count(F.lit(1)).alias("total"), F.count("swept_at").alias("touched"), F.count_if("done").alias("done"), F.sum("got").alias("got"))


def first_seen(pools: list[DataFrame], key: str, order: list[str]) -> DataFrame:
    """Union of pools in their priority; of a repeated key the first occurrence stays, with its pool's number."""
    rows = None
    for i, pool in enumerate(pools):
        own = pool.withColumn("pool", F.lit(i))
        rows = own if rows is None else rows.unionByName(own, allowMissingColumns=True)
    w = Window.partitionBy(key).orderBy("pool", *order)
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def latest_state(log: DataFrame, on: list[str], order: Column) -> DataFrame:
    """The last entry of each key in an event log; a key whose last entry is a tombstone is gone."""
    fields = [c for c in log.columns if c not in on]
    last = log.groupBy(*on).agg(F.max_by(F.struct(*fields), order).alias("last"))
    return last.select(*on, "last.*").where("not deleted").drop("deleted")


def differences(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows only in one of two snapshots, with the side; none means there is nothing to publish."""
    return old.exceptAll(new).withColumn("side", F.lit("gone")).union(new.exceptAll(old).withColumn("side", F.lit("new")))


def cache_join(wanted: DataFrame, cache: DataFrame, key: str, now: Column, ttl_days: int) -> DataFrame:
    """Known and fresh rows are reused, known stale ones requeued, unknown ones queued first."""
    rows = wanted.join(cache.select(key, "cached_at"), key, "left")
    state = F.when(F.col("cached_at").isNull(), "queue").when(F.col("cached_at") >= now - F.make_dt_interval(F.lit(ttl_days)), "reuse").otherwise("requeue")
    return rows.withColumn("state", state)


def stale_entries(cache: DataFrame, algo: int, pick: int, items: int) -> Column:
    """Entries to redo after a rule change: all on another algorithm, failed ones on another pick, empty ones on another items version."""
    return (F.col("algo") != algo) | ((F.col("pick") != pick) & (F.col("status") != "ok")) | ((F.col("items_version") != items) & (F.col("status") == "ok") & (F.col("items") == 0))
