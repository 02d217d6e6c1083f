"""Streams against their batch twins and fixtures."""

import zipfile

import pytest
from pyspark.sql import functions as F

from bidlake.functions.shared import connected_components
from bidlake.sources import extract as X
from bidlake.sources import snapshots as N
from bidlake.streaming import streams, twins


@pytest.fixture()
def rocksdb(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", streams.ROCKSDB)
    yield
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def run(spark, batches, schema, build, folder, mode="update"):
    """Feeds the batches one file each and returns all rows emitted."""
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(str(folder / "in" / f"b={i}"))
    out = []
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").json(str(folder / "in"))
    query = build(source).writeStream.outputMode(mode).foreachBatch(lambda df, _: out.extend(df.collect())).option("checkpointLocation", str(folder / "ck")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    return out


def test_lead_versions_equal_the_batch_twin(spark, rocksdb, tmp_path):
    schema = "lead long, run long, content_hash string, updated_at long"
    batches = [[(1, 0, "a", 1), (2, 0, "x", 1)], [(1, 1, "a", 2), (2, 1, "x", 1), (1, 2, "b", 2)], [(1, 3, "b", 2), (3, 3, "q", 1)]]
    got = run(spark, batches, schema, streams.lead_version_stream, tmp_path)
    want = twins.classify_versions(spark.createDataFrame([r for b in batches for r in b], schema), ["lead"], "run").select("lead", "run", "change", "sticky")
    assert sorted(map(tuple, got)) == sorted(map(tuple, want.collect()))
    assert (1, 3, "unchanged", "material") in set(map(tuple, got))


def test_accumulator_stream_carries_and_expires(spark, rocksdb, tmp_path):
    schema = "id long, seq long, title string, note string, end_us long, ts timestamp"
    at = lambda s: f"2024-01-01 00:00:{s:02d}"
    ms = 1_704_067_200_000
    batches = [
        [(1, 1, "one", "kept", (ms + 20_000) * 1000, at(1)), (2, 1, "two", "", None, at(1))],
        [(1, 2, "one b", "", (ms + 20_000) * 1000, at(5))],
        [(3, 3, "late", "n", None, at(50))],
        [(3, 4, "later", None, None, at(59))],
    ]
    rows = [[(*r[:5], __import__("datetime").datetime.fromisoformat(r[5])) for r in b] for b in batches]
    got = run(spark, rows, schema, lambda s: streams.accumulator_stream(s.withWatermark("ts", "1 second")), tmp_path)
    events = sorted(map(tuple, got))
    assert (1, 2, "one b", "kept", "updated") in events and (1, 2, "one b", "kept", "expired") in events
    assert (3, 4, "later", "n", "updated") in events and (2, 1, "two", None, "new") in events


def test_lockouts(spark):
    import pandas as pd

    t0 = pd.Timestamp("2024-01-01")
    at = lambda s: (t0 + pd.Timedelta(seconds=s)).to_pydatetime()
    rows = [(1, at(i), False) for i in range(5)] + [(1, at(10), True), (1, at(905), False)] + [(2, at(0), False), (2, at(1), True)] + [(2, at(2 + i), False) for i in range(4)]
    got = twins.lockouts(spark.createDataFrame(rows, "key long, ts timestamp_ntz, ok boolean")).collect()
    assert sorted((r.key, r.ts) for r in got) == [(1, at(4)), (1, at(905))]


def test_snapshot_pointer_and_null_sidecars(spark, tmp_path):
    schema = "id long, title string, documents array<string>, terms array<string>, spec array<string>"
    path = f"file://{tmp_path}/snap"
    N.write_snapshot(spark.createDataFrame([(1, "a", ["d"], None, []), (2, "b", None, ["t"], None)], schema), path, "1")
    N.write_snapshot(spark.createDataFrame([(1, "a2", [], None, None)], schema), path, "2")
    assert [tuple(r) for r in N.read_snapshot(spark, path).collect()] == [(1, "a2", [], None, None)]


def docx(path, tables):
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    cell = lambda c: f"<w:tc>{c if c.startswith('<') else f'<w:p><w:r><w:t>{c}</w:t></w:r></w:p>'}</w:tc>"
    table = lambda rows: "<w:tbl>" + "".join("<w:tr>" + "".join(map(cell, r)) + "</w:tr>" for r in rows) + "</w:tbl>"
    body = "".join(table([[table(c) + "<w:p/>" if isinstance(c, list) else c for c in r] for r in t]) for t in tables)
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{w}"><w:body>{body}</w:body></w:document>')


def test_docx_tables_keep_nested_tables_apart(spark, tmp_path):
    docx(tmp_path / "a.docx", [[["Name", "Value"], ["Blade", [["inner", "1"]]]], [["x"]]])
    (tmp_path / "broken.docx").write_bytes(b"no zip")
    files = spark.read.format("binaryFile").load(str(tmp_path))
    got = sorted((r.table_no, r.row_no, r.cells) for r in X.docx_tables(files).collect())
    assert got == [(0, 0, ["Name", "Value"]), (0, 1, ["Blade", ""]), (1, 0, ["inner", "1"]), (2, 0, ["x"])]


def test_catalog_and_profiles(spark, tmp_path):
    (tmp_path / "p").mkdir()
    (tmp_path / "p" / "a.json").write_text('{"id": "p1", "name": "Blade",\n "ktru": ["26.60"], "attributes": [{"key": "size", "value": 3, "status": "declared"}, {"key": "steel", "value": true}]}')
    products, attributes = X.read_catalog(spark, str(tmp_path / "p"))
    assert products.first().ktru == ["26.60"]
    assert [(r.attr_idx, r.key, r.value) for r in attributes.orderBy("attr_idx").collect()] == [(0, "size", "3"), (1, "steel", "true")]
    (tmp_path / "q").mkdir()
    (tmp_path / "q" / "c.json").write_text('{"category": "c", "okpd2_ktru": ["1"], "keywords": ["k", "l"], "synonyms": {"a": ["b", "c"]}, "critical_attributes": []}')
    dims = X.read_profiles(spark, str(tmp_path / "q"))
    assert {r.word for r in dims["synonyms"].collect()} == {"a", "b", "c"} and dims["keywords"].count() == 2 and dims["critical"].count() == 0


def test_components_of_a_long_path(spark):
    edges = spark.range(60).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")).union(spark.createDataFrame([(100, 101), (101, 100), (102, 102), (None, 5)], "a long, b long"))
    got = {r.node: r.component for r in connected_components(edges, "a", "b").collect()}
    assert {got[i] for i in range(61)} == {0} and got[101] == 100 and got[102] == 102


def test_positions_start_at_a_new_name_or_a_repeated_key(spark):
    from bidlake.operators.specs import positions_with_reset

    rows = [(1, i, n, k) for i, (n, k) in enumerate([("A", "x"), ("A", "y"), ("A", "x"), ("A", "y"), ("B", "y"), ("B", "z"), ("C", "q")])]
    got = positions_with_reset(spark.createDataFrame(rows, "doc long, row_no long, name string, key string")).orderBy("pos").collect()
    assert [r["keys"] for r in got] == [["x", "y"], ["x", "y"], ["y", "z"]]
