import zlib

from pyspark.sql import functions as F

from bidlake.llm.shards import shard_by_bytes, write_shards


def check(rows, out, shards, slack):
    got = out.toPandas()
    size = lambda t: len((t or "").encode()) + 1
    want = sorted((str(i), size(t), zlib.crc32((t or "").encode())) for i, t in rows)
    ids = ["None" if x != x or x is None else str(int(x)) for x in got["doc_id"].astype(object)]
    assert sorted(zip(ids, got["size"], got["text_crc32"], strict=True)) == want
    assert set(got["law"]) <= {"bytes"} and got["grown_shard"].isna().all() and got["shard"].between(0, shards - 1).all()
    for _, part in got.groupby("shard"):
        assert sorted(part["slot"]) == list(range(len(part)))
    sums = got.groupby("shard")["size"].sum().reindex(range(shards), fill_value=0)
    assert sums.max() - sums.min() <= slack, sums


def test_near_equal_bytes(spark):
    rows = [(i, "é" * (i * 37 % 900)) for i in range(3000)] + [(None, None), (None, "a"), (5, ""), (5, "")]
    check(rows, shard_by_bytes(spark.createDataFrame(rows, "doc_id long, text string")), 8, 2 * 1801)


def test_hot_text_is_subdivided(spark):
    rows = [(i, "the same text" * 5 if i % 3 else f"text {i}") for i in range(4000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    check(rows, shard_by_bytes(docs), 8, 2 * 70)
    check(rows, shard_by_bytes(docs, ranges=2, oversample=1), 8, 2 * 70)


def test_repeated_rows_and_one_giant(spark):
    rows = [(1, "same")] * 500 + [(2, "x" * 100_000)] + [(i, "y") for i in range(3, 50)]
    check(rows, shard_by_bytes(spark.createDataFrame(rows, "doc_id long, text string"), shards=2), 2, 100_002)


def test_fewer_rows_than_shards_and_none(spark):
    check([(1, "a"), (2, None)], shard_by_bytes(spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string")), 8, 2)
    assert shard_by_bytes(spark.createDataFrame([], "doc_id long, text string, shard int")).count() == 0


def test_equal_texts_stay_together_unless_cut(spark):
    rows = [(i, f"text {i // 4}") for i in range(2000)]
    out = shard_by_bytes(spark.createDataFrame(rows, "doc_id long, text string"))
    assert out.groupBy("text_crc32").agg(F.countDistinct("shard").alias("n")).where("n > 1").count() <= 7


def test_written_shards(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"text {i}", "x") for i in range(100)], "doc_id long, text string, lang string")
    placed = shard_by_bytes(docs, shards=3)
    write_shards(docs, placed, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(map(tuple, back.select("doc_id", "shard", "slot").collect())) == sorted(map(tuple, placed.select("doc_id", "shard", "slot").collect()))
