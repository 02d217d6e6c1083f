import hashlib
import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from bidlake.llm import queries, resample
from bidlake.llm.resample import Splitter, importance_scores, joined_crc

DATA = "/root/testdata/sf0.001"


def features(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    return len(words), [zlib.crc32(x.encode()) % 10_000 for x in words + [f"{a} {b}" for a, b in zip(words, words[1:])]]


def brute(docs, target):
    found = [features(t) for _, t in docs]
    s, t = [0] * 10_000, [0] * 10_000
    for _, own in found:
        for b in own:
            s[b] += 1
    for text in target:
        for b in features(text)[1]:
            t[b] += 1
    gain = [math.floor(1000 * math.log((b + 1) * (sum(s) + 10_000) / ((a + 1) * (sum(t) + 10_000)))) for a, b in zip(s, t)]
    out = []
    for (i, _), (n, own) in zip(docs, found):
        weight = math.floor(sum(gain[b] for b in own) / len(own)) if own else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, n, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    able = sorted((r for r in out if r[1] >= 20), key=lambda r: (-r[4], r[0] is None, r[0]))
    rank = {id(r): k + 1 for k, r in enumerate(able[: 25 * len(able) // 100])}
    return sorted([(r[0], *r[2:], rank.get(id(r))) for r in out], key=str)


def result(df):
    return sorted([tuple(r) for r in df.select("doc_id", "n_features", "weight", "score", "rank").collect()], key=str)


def test_query_equals_brute_force_on_whole_tables(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()]
    target = [r.text for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    want = brute(docs, target)
    assert result(queries.op11_importance_resampling(spark, DATA)) == want
    assert sum(r[-1] is not None for r in want) > 30


def odd_rows():
    words = "Alpha beta. γάμμα-δ 7x ZETA_η\x00 ÀÉ 日本 don't"
    rows = [(i, f"{words} " * (1 + i % 5) + f"w{i}") for i in range(60)]
    return rows + [(None, words * 9), (1, rows[1][1]), (1, rows[1][1]), (70, None), (71, ""), (72, " \n."), (73, "long " * 60_000 + "end"), (74, "x" * 70_000)]


def test_edges_and_repeats_against_brute_force(spark, monkeypatch):
    rows, target = odd_rows(), ["beta 7x zeta", None, "", "γάμμα δ w3 w4"]
    docs, goal = spark.createDataFrame(rows, "doc_id long, text string").repartition(3), spark.createDataFrame([(t,) for t in target], "text string")
    assert result(importance_scores(docs, goal)) == brute(rows, target)
    drawn = resample.resample(docs.withColumn("Score", F.lit("mine")), goal)
    want = [r[0] for r in brute(rows, target) if r[-1]]
    assert drawn.columns == ["doc_id", "text", "Score"] and sorted((r.doc_id for r in drawn.collect()), key=str) == sorted(want, key=str)


def test_empty_tables_and_clashing_columns(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert importance_scores(none, none.select("text")).count() == 0 and resample.resample(none, none.select("text")).count() == 0
    docs = spark.createDataFrame([(1, "a b", 5, "x")], "doc_id long, text string, Rank int, lang string")
    out = importance_scores(docs, none.select("text"))
    assert out.columns == ["doc_id", "lang", "n_words", "n_features", "weight", "score", "rank"] and out.first().n_features == 3
    with pytest.raises(ValueError):
        importance_scores(docs, none.select("text"), buckets=70_000)


def test_slabs_and_crc_of_joined_words(monkeypatch):
    text = " ".join(f"w{i}é" for i in range(3000))
    whole = Splitter(10_000).features(text)
    monkeypatch.setattr(resample, "_STEP", 50)
    assert (whole[0], whole[1].tolist()) == (features(text)[0], features(text)[1])
    assert Splitter(10_000).features(text)[1].tolist() == whole[1].tolist()
    words = [b"a", b"", b"\xff" * 7, b"z" * 5000, bytes(range(256)) * 40]
    crc, length = np.array([zlib.crc32(w) for w in words], np.uint32), np.array([len(w) for w in words])
    for left in words:
        got = joined_crc(np.full(len(words), zlib.crc32(left), np.uint32), crc, length)
        assert got.tolist() == [zlib.crc32(left + b" " + w) for w in words]
