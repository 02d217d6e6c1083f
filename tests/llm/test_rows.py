import numpy as np
from pyspark.sql import functions as F

from bidlake.functions.shared import saved
from bidlake.llm.rows import bitmap, marked, row_key, settle


def test_bitmap_misses_no_key(spark):
    keys = spark.range(30_000).select(F.xxhash64("id").alias("k")).unionAll(spark.createDataFrame([(0,), (-1,), (1 << 62,)], "k long"))
    own = np.array([r.k for r in keys.collect()], np.int64)
    marks = bitmap(keys)
    assert marked(own, marks).all() and len(marks) * 8 == 1 << 19
    other = np.random.default_rng(1).integers(-(1 << 63), (1 << 63) - 1, 50_000)
    assert 0.02 < marked(other, marks).mean() < 0.1
    small = bitmap(keys, most=16)
    assert len(small) == 1 << 13 and marked(own, small).all()
    assert not marked(own, bitmap(keys.limit(0))).any()


def test_settle_drops_decided_rows_and_repeats_of_kept_ones(spark):
    rows = [(1, "a", "x"), (2, "b", "y"), (2, "b", "z"), (3, "c", None), (3, "c", None), (None, None, "n"), (None, "", "m"), (4, "d", "key")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, key string")
    keyed = docs.withColumn("k", row_key()).select("doc_id", F.col("k").alias("key")).distinct()
    decided = saved(keyed.select("key", F.coalesce(F.col("doc_id") != 1, F.lit(False)).alias("kept")).where(~F.coalesce(F.col("key") == 0, F.lit(False))), "d")
    decided = saved(decided.join(keyed.where("doc_id = 3"), "key", "left_anti"), "d")
    got = settle(docs, decided)
    assert got.columns == docs.columns
    out = sorted(map(str, (tuple(r) for r in got.collect())))
    native = settle(docs, decided, native=True)
    assert sorted(str(tuple(r)[:2]) for r in native.collect()) == sorted(str(tuple(r)[:2]) for r in got.collect()) and native.columns == docs.columns
    plan = native._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan
    assert len(out) == 4 and out.count("(3, 'c', None)") == 2 and "(4, 'd', 'key')" in out
    assert settle(docs.limit(0), decided).count() == 0 and settle(docs, decided.limit(0)).count() == len(rows)
