import hashlib
import re

from pyspark.sql import functions as F

from bidlake.llm.dedup import exact_dedup

ROWS = [(5, "a  b"), (3, "a\tb"), (9, "a b"), (1, None), (2, ""), (None, "a b"), (None, "alone"), (7, "x" * 200_000), (8, "x" * 200_000), (3, "a b"), (4, " a b"), (6, " a b")]


def brute(rows):
    norm = [re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for _, t in rows]
    out = []
    for (i, _), t in zip(rows, norm, strict=True):
        ids = [j for (j, _), u in zip(rows, norm, strict=True) if u == t and j is not None]
        keep = min(ids, default=None)
        out.append((i, keep, sum(u == t for u in norm), i == keep, hashlib.sha256(t.encode()).hexdigest()))
    return sorted(out, key=str)


def result(df):
    return sorted(map(tuple, df.select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()), key=str)


def test_brute_force(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string")
    assert result(exact_dedup(docs)) == brute(ROWS)


def test_shared_digest_never_merges_different_texts(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string")
    assert result(exact_dedup(docs, digest=lambda t: F.lit("same"))) == brute(ROWS)
    assert result(exact_dedup(docs, digest=lambda t: F.substring(F.sha2(t, 256), 1, 1))) == brute(ROWS)


def test_empty_and_clashing_columns(spark):
    assert exact_dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    docs = spark.createDataFrame([(1, "a", "k", 7), (2, "a", "l", 8)], "doc_id long, text string, key string, Kept int")
    out = exact_dedup(docs)
    assert out.columns == ["doc_id", "text", "key", "keep_id", "group_size", "kept", "text_sha256"]
    assert sorted((r.doc_id, r.key, r.kept) for r in out.collect()) == [(1, "k", True), (2, "l", False)]


def test_hot_group(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, F.lit("hot text")).otherwise(F.concat(F.lit("t "), F.col("id"))).alias("text"))
    out = exact_dedup(docs)
    assert out.where("kept").count() == 2001
    assert out.where("keep_id = 0").select("group_size").distinct().collect() == [(1000,)]
