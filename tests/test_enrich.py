"""Attachments under a budget of downloads and what enrichment keeps over runs."""

import random

from pyspark.sql import functions as F

from bidlake.functions.shared import running_sum
from bidlake.operators import enrich as N

DOCS = "id int, n int, name string, url string"
LISTED = "id int, end_ts timestamp_ntz, docs_fetched boolean, doc string, terms array<string>, items array<string>"
KNOWN = "id int, status string, doc string, terms array<string>, items array<string>"


def test_running_sums_over_several_ranges(spark):
    rng = random.Random(2)
    data = [(i, rng.choice([None, 1, 1, 1, 2]), rng.randint(0, 4)) for i in range(700)]
    rows = spark.createDataFrame(data, "id int, k int, v int").repartition(5)
    order = [F.col("k").asc_nulls_last(), F.col("id").desc()]
    total, want = 0, {}
    for i, _, v in sorted(data, key=lambda r: (r[1] is None, r[1] or 0, -r[0])):
        total += v
        want[i] = total
    out = running_sum(rows, order, F.col("v"), "through")
    assert out.columns == ["id", "k", "v", "through"] and {r.id: r.through for r in out.collect()} == want
    assert running_sum(rows.where("id < 0"), order, F.col("v")).count() == 0


def test_names_rank_attachments(spark):
    docs = [(1, 0, "смета.docx", "u"), (1, 1, "Описание объекта закупки", "u"), (1, 2, "ТЗ", "u"), (1, 3, "Техническое задание.docx", "u"), (1, 4, "техническое задание.pdf", "u"), (1, 5, "спецификация.docx", ""), (1, 6, None, "u"), (2, 0, "a.zip", "u")]
    got = N.ranked_attachments(spark.createDataFrame(docs, DOCS)).orderBy("id", "place").collect()
    assert [(r.id, r.n) for r in got] == [(1, 3), (1, 2), (1, 1), (1, 0)]


def test_budget_against_a_loop(spark):
    rng = random.Random(7)
    rows = [(i, rng.randint(1, 4), rng.randint(0, 50)) for i in range(300)]
    df = spark.createDataFrame(rows, "id int, cost int, due int").repartition(6)
    for budget in (0, 1, 137, 10_000):
        left, want = budget, {}
        for i, cost, _ in sorted(rows, key=lambda r: (r[2], r[0])):
            want[i] = (cost > left, min(cost, left))
            left -= min(cost, left)
        got = N.within_budget(df, [F.col("due").asc(), F.col("id").asc()], budget)
        assert {r.id: (r.pending, r.spent) for r in got.collect()} == want


def state(run):
    return {r.id: (r.status, r.doc, r.terms or [], r["items"] or []) for r in run.collect()}


def test_two_runs_keep_what_is_known(spark):
    import datetime as dt

    day = lambda n: dt.datetime(2024, 1, n)
    listed = [
        (1, day(5), True, None, None, None), (2, day(1), True, "old.docx", ["old"], ["i"]), (3, day(2), True, None, [], None), (4, day(3), False, None, None, None),
        (5, None, True, None, None, None), (6, day(4), True, None, None, None), (7, day(1), True, "seven", ["kept"], None),
    ]
    docs = [(1, 0, "a.docx", "u"), (1, 1, "b.docx", "u"), (2, 0, "c.docx", "u"), (3, 0, "d.pdf", "u"), (3, 1, "e.zip", "u"), (6, 0, "f.docx", "u"), (6, 1, "g.docx", "u"), (7, 0, "h.pdf", "u")]
    parsed = spark.createDataFrame([(1, 0, "unsupported", None, None), (1, 1, "ok", ["t1"], ["x"]), (2, 0, "error", None, None), (6, 0, "empty", None, None), (6, 1, "error", None, None)], "id int, n int, status string, terms array<string>, items array<string>")
    documents, none = spark.createDataFrame(docs, DOCS), spark.createDataFrame([], KNOWN)
    after, cache = N.enrich(spark.createDataFrame(listed, LISTED), documents, parsed, none, 3)
    assert state(after) == {
        1: ("pending", "", [], []), 2: ("ok", "", ["old"], ["i"]), 3: ("unsupported", "d.pdf", [], []), 4: ("pending", "", [], []), 5: ("no-doc", "", [], []), 6: ("error", "g.docx", [], []), 7: ("ok", "seven", ["kept"], []),
    }
    assert {r.id: r.status for r in cache.collect()} == {3: "unsupported", 6: "error"}
    # The second run starts from what the first left; 2's refetch fails and takes nothing away.
    again = spark.createDataFrame([(i, dict((x[0], x[1]) for x in listed)[i], True, d, t, x) for i, (_, d, t, x) in state(after).items()], LISTED)
    later, cache = N.enrich(again, documents, parsed, cache, 10)
    got = state(later)
    assert got[1] == ("ok", "b.docx", ["t1"], ["x"]) and got[2] == ("ok", "c.docx", ["old"], ["i"]) and got[6][0] == "error" and got[4][0] == "no-doc"
    assert {r.id: r.status for r in cache.collect()} == {1: "ok", 2: "error", 3: "unsupported", 6: "error"}


def test_empty_tables(spark):
    listed, docs, known = spark.createDataFrame([], LISTED), spark.createDataFrame([], DOCS), spark.createDataFrame([], KNOWN)
    parsed = spark.createDataFrame([], "id int, n int, status string, terms array<string>, items array<string>")
    after, cache = N.enrich(listed, docs, parsed, known, 5)
    assert after.count() == 0 and cache.count() == 0
