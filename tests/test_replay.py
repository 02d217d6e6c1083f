"""The events table replayed as a file stream, with late and repeated rows, against the batch forms."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from bidlake.streaming import streams, twins
from test_streams import rocksdb, run  # noqa: F401

DATA = "/root/testdata/sf0.001"
SCHEMA = "event_id long, user_id long, event_type string, value double, ts timestamp"


@pytest.fixture(scope="module")
def events(spark):
    rows = spark.read.parquet(f"{DATA}/events.parquet").select("event_id", "user_id", "event_type", "value", F.col("ts").cast("timestamp").alias("ts"))
    return sorted(map(tuple, rows.collect()), key=lambda r: (r[4], r[0]))


@pytest.fixture(scope="module")
def replay(events):
    """Six files by time. Of the first one some rows come in the fifth, far behind the watermark; others come twice, at once or in the next file."""
    n = len(events) // 6
    files = [events[i * n : (i + 1) * n if i < 5 else None] for i in range(6)]
    late, files[0] = files[0][::10], [r for i, r in enumerate(files[0]) if i % 10]
    accepted = [r for f in files for r in f]
    sent = [list(f) for f in files]
    for i, f in enumerate(files):
        sent[i] += f[::7]
        if i < 5:
            sent[i + 1] += f[-5:]
    # Rows that are late, but within the time that is waited for.
    sent[3] += sent[2][-8:-5]
    sent[2] = sent[2][:-8] + sent[2][-5:]
    sent[4] += late
    span = events[-1][4] - events[0][4]
    return sent, accepted, int(span.total_seconds() / 8)


def test_hopping_alerts_with_late_and_repeated_events(spark, replay, tmp_path):
    sent, accepted, wait = replay
    hour = wait // 2
    out = run(spark, sent, SCHEMA, lambda s: streams.hopping_alerts(s, "user_id", 2 * hour, hour, 2, f"{wait} seconds", "event_id"), tmp_path)
    last = {}
    for r in out:
        last[r.user_id, r.start] = max(r.n, last.get((r.user_id, r.start), 0))
    twin = streams.hopping_counts(spark.createDataFrame(accepted, SCHEMA), "user_id", 2 * hour, hour, 2).collect()
    assert last == {(r.user_id, r.start): r.n for r in twin} and len(last) > 20


def test_discovery_with_late_and_repeated_records(spark, replay, tmp_path):
    sent, accepted, wait = replay
    keyed = lambda rows: [(r[0], r[1], r[2], r[3], r[4]) for r in rows]
    schema = SCHEMA.replace("event_id", "id")
    known = spark.createDataFrame([(r[0],) for r in accepted[::9]], "id long")
    relevant = F.col("value") >= 20
    out = run(spark, [keyed(f) for f in sent], schema, lambda s: streams.discovery(s, known, relevant, f"{wait} seconds"), tmp_path, "append")
    batch = spark.createDataFrame(keyed(accepted), schema)
    want = twins.first_seen([batch.where(relevant)], "id", ["ts"]).join(known, "id", "left_anti")
    assert sorted(r.id for r in out) == sorted(r.id for r in want.collect()) and len(out) > 100


def test_accumulator_equals_upserts_batch_by_batch(spark, rocksdb, replay, tmp_path):  # noqa: F811
    sent, _, _ = replay
    files = []
    for f in sent:
        once = {r[1]: r for r in f}  # one record of a listing a run
        files.append([(r[1], r[0], r[2], r[2] if r[0] % 3 == 0 else "", None, r[4]) for r in once.values()])
        files[-1] += files[-1][:3]  # the same record again changes nothing
    schema = "id long, seq long, title string, note string, end_us long, ts timestamp"
    out = run(spark, files, schema, lambda s: streams.accumulator_stream(s.withWatermark("ts", "3650 days")), tmp_path)
    got = {}
    for r in out:
        got[r.id] = (r.seq, r.title, r.note)
    store = spark.createDataFrame([], "id long, seq long, title string, note string, seen_at timestamp_ntz")
    for i, f in enumerate(files):
        fresh = spark.createDataFrame(f, schema).select("id", "seq", "title", "note").dropDuplicates(["id"])
        after = twins.accumulate(store, fresh, F.lit(dt.datetime(2024, 1, 1 + i)).cast("timestamp_ntz"), ["note"]).drop("is_new")
        store = spark.createDataFrame(after.collect(), store.schema)
    assert got == {r.id: (r.seq, r.title, r.note) for r in store.collect()} and len(got) > 10
    assert {r.event for r in out} == {"new", "updated"}
