"""The snapshot build over three runs and the feed data source."""

import datetime as dt
import json

from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThanOrEqual, In, IsNotNull

from bidlake.operators import build
from bidlake.sources.feeds import FeedReader, FeedSource

SOURCE = "id long, title string, region string, price double, end_ts timestamp_ntz, docs_fetched boolean"


def day(n):
    return dt.datetime(2024, 1, 1) + dt.timedelta(days=n)


def test_three_runs_carry_expire_and_stay(spark, tmp_path):
    path = f"file://{tmp_path}/build"
    docs = spark.createDataFrame([(1, 0, "a.docx", "u"), (2, 0, "b.pdf", "u")], "id long, n int, name string, url string")
    files = lambda rows: spark.createDataFrame(rows, "id long, n int, status string, terms array<string>, items array<string>")
    at = lambda n: F.lit(day(n)).cast("timestamp_ntz")
    first = spark.createDataFrame([(1, "one", "R", 5.0, day(30), True), (2, "two", "", 6.0, day(9), False), (3, "three", None, 7.0, None, None)], SOURCE)
    other = spark.createDataFrame([(1, "one again", "X", 9.0, day(30), True), (4, "four", "Y", 1.0, day(3), True)], SOURCE)
    told = build.build_snapshot([first, other], docs, files([(1, 0, "ok", ["t"], None)]), path, at(0), 5, 10)
    assert told == {"run": 1, "version": 1, "new": 4, "expired": 0, "listings": 4}
    # Listing 1 comes back with less, 4 has ended, 2 and 3 aren't shown; the file of 1 can't be read any more.
    second = spark.createDataFrame([(1, "one b", "", 5.5, None, None)], SOURCE)
    told = build.build_snapshot([second], docs, files([]), path, at(5), 5, 10)
    assert told == {"run": 2, "version": 2, "new": 0, "expired": 1, "listings": 3}
    rows = {r.id: r for r in build.read_published(spark, path).collect()}
    one = rows[1]
    assert (one.title, one.region, one.price, one.end_ts, one.terms, one.status, one.docs_fetched) == ("one b", "R", 5.5, day(30), ["t"], "ok", True)
    assert rows[2].status == "unsupported" and rows[3].status == "pending"
    # The same again: the store is seen anew, but nothing is published.
    told = build.build_snapshot([second], docs, files([]), path, at(6), 5, 10)
    assert told == {"run": 3, "version": 2, "new": 0, "expired": 0, "listings": 3}
    assert {r.version for r in build.read_published(spark, path).collect()} == {2}
    # After the time to live the listing without an end goes, and so does the one that ended.
    told = build.build_snapshot([second.limit(0)], docs, files([]), path, at(32), 5, 10)
    assert told == {"run": 4, "version": 4, "new": 0, "expired": 3, "listings": 0}


def test_content_hash_ignores_order_and_counts_repeats(spark):
    rows = spark.createDataFrame([(1, "a", ["x"]), (2, None, None), (2, None, None)], "id int, t string, l array<string>")
    assert build.content_hash(rows) == build.content_hash(rows.orderBy(F.desc("id")).repartition(3).select("l", "t", "id"))
    assert len({build.content_hash(x) for x in (rows, rows.distinct(), rows.limit(0), rows.withColumn("t", F.lit("a")))}) == 4


def feeds(folder):
    own = {
        "alpha/1.json": [{"id": "a1", "region": "R", "price": 5, "title": "A"}, {"id": "a2", "region": "S", "price": None}],
        "alpha/2.jsonl": [{"id": "a3", "region": "R", "price": 50.5}],
        "portal/x.json": [{"id": 7, "name": "P", "customers": [{"name": "C"}], "startCost": 20, "endDate": "01.02.2024"}, {"name": "no id"}],
        "empty/none.json": [],
    }
    for name, rows in own.items():
        (folder / name).parent.mkdir(exist_ok=True)
        (folder / name).write_text("\n".join(map(json.dumps, rows)) + ("\nnot json\n[1]\n" if rows else ""))


def test_filters_reach_the_reader(tmp_path):
    feeds(tmp_path)
    reader = FeedReader(str(tmp_path))
    assert len(reader.partitions()) == 4
    left = list(reader.pushFilters([EqualTo(("source",), "alpha"), GreaterThanOrEqual(("price",), 6), IsNotNull(("title",))]))
    assert left == [IsNotNull(("title",))]
    parts = reader.partitions()
    assert [p.file.rsplit("/", 1)[1] for p in parts] == ["1.json", "2.jsonl"]
    assert [r["id"] for p in parts for b in reader.read(p) for r in b.to_pylist()] == ["a3"]
    both = FeedReader(f"file://{tmp_path}")
    assert list(both.pushFilters([In(("source",), ("alpha", "portal")), EqualTo(("source",), "portal"), EqualTo(("region",), "R")])) == []
    assert [p.source for p in both.partitions()] == ["portal"] and [b.num_rows for b in both.read(both.partitions()[0])] == []


def test_feeds_as_a_format(spark, tmp_path):
    feeds(tmp_path)
    spark.dataSource.register(FeedSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        rows = spark.read.format("feeds").load(str(tmp_path))
        assert rows.rdd.getNumPartitions() == 4
        assert {tuple(r) for r in rows.select("id", "source", "title", "customer", "price").collect()} == {("a1", "alpha", "A", None, 5.0), ("a2", "alpha", None, None, None), ("a3", "alpha", None, None, 50.5), ("pp_7", "portal", "P", "C", 20.0)}
        assert [r.id for r in rows.where("source = 'alpha' and price >= 6").collect()] == ["a3"]
        assert rows.where("source = 'alpha'").rdd.getNumPartitions() == 2
        assert rows.where("source = 'nowhere'").count() == 0
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_coverage_judges_equal_positions_and_cards_once(spark):
    import glob

    from pyspark.sql import functions as F

    from bidlake.functions.shared import shared_dir
    from bidlake.operators import characteristics as C
    from bidlake.operators import evaluate as E

    folder = shared_dir(spark).removeprefix("file://")
    seen = set(glob.glob(f"{folder}/card_pairs-*"))
    cells = [("Размер", "≥ 5"), ("Тип", "ring")]
    rows = spark.createDataFrame([(d, i, "ring", k, v) for d in (1, 2, 3) for i, (k, v) in enumerate(cells)], "doc int, row_no int, name string, key string, value string")
    codes = spark.createDataFrame([(1, 0, "01.02"), (2, 0, "01.02"), (3, 0, "77.01")], "doc int, pos int, code string")
    cards = spark.createDataFrame([("b", 2, "01.02"), ("a", 3, "01.02"), ("c", 1, "01.02")], "card_id string, place int, code string")
    own = spark.createDataFrame([(c, i, k, v) for c, size in (("b", "7"), ("a", "7"), ("c", "4")) for i, (k, v) in enumerate((("Размер", size), ("Тип", "ring")))], "card_id string, attr_idx int, key string, t string")
    own = own.select("card_id", "attr_idx", "key", F.lit("declared").alias("attr_status"), E.value_of("str", F.col("t")).alias("attr"))
    got = C.catalog_coverage(rows, codes, cards, own, spark.createDataFrame([("Тип",)], "key string"), "гарант").select("doc", "pos", "card_id", "score", "class").collect()
    assert sorted(map(tuple, got), key=str) == [(1, 0, "b", 100, "ours"), (2, 0, "b", 100, "ours"), (3, 0, None, None, "not in catalog")]
    (pairs,) = set(glob.glob(f"{folder}/card_pairs-*")) - seen
    assert spark.read.parquet(pairs).count() == 2
