import base64
import gzip
import hashlib
import re

import pandas as pd
from pyspark.sql import functions as F

from bidlake.functions.shared import new_path, saved
from bidlake.llm.warc import archive_round_trip, capture_key, lookup, read_index, write_archives

SCHEMA = "page_id long, url string, html string, payload string"
ROWS = [
    (1, "https://b.example.com/a", "<p>é</p>", "x"), (2, "http://user@a.example.com:80/x y?q#f", "<p>é</p>", None), (3, None, None, None), (4, "", "", None),
    (5, "not a url\nat all", "<b>" * 50_000, None), (6, "https://b.example.com/a", "new", None), (None, "https://n.org/", "<p>é</p>", None), (None, None, "only", None),
    (7, "https://b.example.com/a", "<p>é</p>", None), (8, "u", "rep", None), (8, "u", "rep", None), (9, "u", "rep", None), (10, "v", "one", None), (10, "v", "rep", None),
]


def brute(rows):
    out = []
    for page, url, html, _ in rows:
        data = (html or "").encode()
        first = min((p for p, _, h, _ in rows if (h or "") == (html or "") and p is not None), default=None)
        own = page == first
        out.append((page, url, "response" if own else "revisit", None if own else first, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), html or "" if own else None))
    return sorted(out, key=str)


def test_round_trip(spark):
    for options in ({}, {"block_records": 2, "parts": 3}, {"block_bytes": 1, "archive_bytes": 600, "parts": 2}):
        got = archive_round_trip(spark.createDataFrame(ROWS, SCHEMA), **options)
        rows = [(r.page_id, r.url, r.record_type, r.refers_to, r.payload_bytes, r.payload_digest, None if r.payload is None else bytes(r.payload).decode()) for r in got.collect()]
        assert sorted(rows, key=str) == brute(ROWS)


def test_archives_are_plain_warc_members_and_the_index_is_sorted(spark, tmp_path):
    path = f"file://{tmp_path}/w"
    pages = spark.range(300).select(F.col("id").alias("page_id"), F.concat(F.lit("https://h"), F.col("id") % 7, F.lit(".org/"), F.col("id") % 50).alias("url"), F.concat(F.lit("p"), F.col("id") % 200).alias("html"))
    directory = write_archives(pages, path, block_records=16, parts=4, archive_bytes=20_000)
    lines = read_index(spark, directory, path).toPandas()
    blocks = directory.toPandas()
    assert len(lines) == 300 and blocks["records"].max() == 16
    names = blocks.drop_duplicates("archive").set_index("archive")["warc_file"]
    assert len(names) > 6
    for part, own in lines.groupby("archive"):
        assert list(own["key"]) == sorted(own["key"])
        data = (tmp_path / "w" / names[part]).read_bytes()
        assert sum(own["length"]) == len(data)
        at = own.iloc[len(own) // 2]
        record = gzip.decompress(data[at["offset"] : at["offset"] + at["length"]])
        assert record.startswith(b"WARC/1.1\r\n") and record.endswith(b"\r\n\r\n")
        whole = gzip.decompress(data)
        assert len(re.findall(rb"WARC-Type: (?:response|revisit)", whole)) == len(own)
    ends = blocks.sort_values(["first_key"])
    assert (ends["last_key"].shift().fillna("") <= ends["first_key"]).all()


def test_lookup_of_single_and_missing_keys(spark):
    path = new_path(spark, "warc")
    pages = spark.createDataFrame(ROWS, SCHEMA)
    directory = write_archives(pages, path, block_records=2, parts=3)
    want = pages.where("page_id in (2, 8)").select(capture_key(F.col("url"), F.col("page_id")).alias("key"))
    keys = want.union(spark.createDataFrame([("com,example,zzz)/ 1",), ("",), ("~~~~",)], "key string"))
    assert sorted(r.page_id for r in lookup(directory, path, keys).collect()) == [2, 8, 8]
    key = spark.range(1).select(capture_key(F.lit("https://News.Example.COM/A?b=1"), F.lit(7))).first()[0]
    assert key == "com,example,news)/A?b=1 7"


def test_nothing(spark):
    assert archive_round_trip(spark.createDataFrame([], SCHEMA)).count() == 0


def test_hot_payload_and_host(spark):
    pages = spark.range(900).select(F.col("id").alias("page_id"), F.concat(F.lit("https://one.org/"), F.col("id")).alias("url"), F.when(F.col("id") % 3 > 0, F.lit("hot")).otherwise(F.col("id").cast("string")).alias("html"))
    got = archive_round_trip(pages).toPandas()
    assert len(got) == 900 and (got["record_type"] == "revisit").sum() == 599 and set(got["refers_to"].dropna()) == {1}
    assert isinstance(got, pd.DataFrame)


def test_very_long_pages_pass_in_slabs(spark, tmp_path):
    path = f"file://{tmp_path}/w"
    long = F.concat(F.repeat(F.lit("<p>é 0123456789</p>"), 2_500_000), F.col("id").cast("string"))
    pages = spark.range(60).select(F.col("id").alias("page_id"), F.lit("https://one.org/").alias("url"), F.when(F.col("id") % 30 == 1, long).otherwise(F.col("id").cast("string")).alias("html"))
    pages = saved(pages, "pages")
    directory = write_archives(pages, path, parts=2)
    keys = pages.select(capture_key(F.col("url"), F.col("page_id")).alias("key"))
    got = {r.page_id: r for r in lookup(directory, path, keys, payload=False).collect()}
    assert len(got) == 60 and got[1].payload_bytes == 50_000_001
    want = hashlib.sha1(("<p>é 0123456789</p>" * 2_500_000 + "31").encode()).digest()
    assert got[31].payload_digest == base64.b32encode(want).decode()
