"""Operators over blocks and ranges against brute force, at sizes that need several of them."""

import datetime
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from bidlake.operators import search, terms


def vectors(n, dim=8, seed=3):
    v = np.random.default_rng(seed).normal(size=(n, dim))
    return (v / np.linalg.norm(v, axis=1, keepdims=True)).astype(np.float32)


@pytest.mark.parametrize("block", [7, 1024])
def test_pairs_and_ranks_meet_every_vector(spark, block):
    v = vectors(60)
    v[50:] = v[50]  # copies
    odd = [(100, None), (101, []), (102, [1.0] + [None] * 7), (103, [1.0, 0.0]), (104, [1.0, 0.0]), (None, v[0].tolist())]
    rows = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)] + odd, "item long, vector array<float>")
    sims = np.round(v.astype(float) @ v.astype(float).T, 6)
    want = {(a, b) for a in range(60) for b in range(a + 1, 60) if sims[a, b] >= 0.4} | {(103, 104)}
    got = [(r.a, r.b) for r in terms.similar_pairs(rows, 0.4, block).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    asked = rows.where("item % 5 = 0").withColumnRenamed("item", "query")
    want = {(a, b) for a in range(0, 60, 5) for b in range(60) if sims[a, b] >= 0.4}
    got = [(r.query, r.item) for r in terms.semantic_rank(rows, asked, 0.4, block).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_no_vectors(spark):
    none = spark.createDataFrame([], "item long, vector array<float>")
    assert terms.similar_pairs(none, 0.4).count() == 0
    assert terms.semantic_rank(none, none.withColumnRenamed("item", "query"), 0.4).count() == 0


def test_deep_pages_and_large_heads(spark):
    random.seed(5)
    data = [(i, random.choice([None, 1, 1, 2, 3])) for i in range(500)]
    rows = spark.createDataFrame(data, "id long, k long").repartition(3)
    order = [F.col("k").asc_nulls_last(), F.col("id").desc()]
    want = [i for i, k in sorted(data, key=lambda r: (r[1] is None, r[1] or 0, -r[0]))]
    for number in (1, 4, 9, 10**6):
        at = (min(number, 9) - 1) * 60
        for one_task in (0, 10_000):
            out = search.page(rows, order, number, 60, one_task).collect()
            assert [r.id for r in out] == want[at : at + 60] and {r.total for r in out} == {500}
    for n in (0, 1, 333, 500, 900):
        assert [r.id for r in search.nearest(rows, n, order, -1).collect()] == want[:n]
    assert search.page(rows.where("id < 0"), order, 3, 60, 0).count() == 0


def test_exact_median_over_ranges(spark):
    random.seed(11)
    data = [(random.choice(["hot", "hot", "hot", "a", "b", None]), random.choice([None, *range(1, 40)])) for _ in range(900)] + [("one", 7), ("two", 3), ("two", 8), ("none", None)]
    rows = spark.createDataFrame([(k, None if v is None else float(v)) for k, v in data], "k string, v double").repartition(5)
    want = {}
    for key in {k for k, _ in data}:
        own = sorted(v for k, v in data if k == key and v is not None)
        if own:
            want[key] = float(np.median(own))
    assert {r.k: r.median for r in terms.exact_median(rows, "k", "v").collect()} == want
    assert terms.exact_median(rows.where("v < 0"), "k", "v").count() == 0


def test_lockouts_of_the_events_table_against_a_loop(spark):
    from bidlake.plans import registry

    rows = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("user_id", F.col("ts").cast("timestamp_ntz").alias("ts"), "value").collect()
    want, state = [], {}
    for user, ts, value in sorted((r.user_id, r.ts, r.value) for r in rows):
        count, until = state.get(user, (0, None))
        if until is None or (ts - until).total_seconds() >= 0:
            count = 0 if value > 60 else count + 1
            if count >= 3:
                until = ts + datetime.timedelta(seconds=86_400)
                want.append((user, ts))
            state[user] = (count, until)
    got = registry.queries()["str6_lockouts"](spark, "/root/testdata/sf0.001").collect()
    assert sorted(map(tuple, got)) == sorted(want) and len(want) > 20


def test_reset_positions_of_the_turns_against_a_loop(spark):
    from bidlake.plans import registry

    rows = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").orderBy("conv_id", "turn").collect()
    want, by_doc = [], {}
    for r in rows:
        by_doc.setdefault(r.conv_id, []).append((r.text or "" if r.role == "user" else "", str(len(r.text or "") % 6)))
    for doc, turns in by_doc.items():
        name, groups, last = "", [], None
        for own, key in turns:
            name = own or name
            if not name:
                continue
            if name != last or key in groups[-1]:
                groups.append([])
            groups[-1].append(key)
            last = name
        want += [(doc, i, ",".join(g)) for i, g in enumerate(g for g in groups if len(g) >= 2)]
    got = registry.queries()["rnk7_reset_positions"](spark, "/root/testdata/sf0.001").collect()
    assert sorted(map(tuple, got)) == sorted(want) and want


@pytest.mark.parametrize("block", [7, 1024])
def test_pairs_are_chosen_and_linked_where_blocks_meet(spark, monkeypatch, block):
    v = vectors(60)
    v[50:] = v[50]  # copies
    rows = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)] + [(100, None), (103, [1.0, 0.0]), (104, [1.0, 0.0]), (105, [1.0, 0.0])], "item long, vector array<float>")
    names = spark.createDataFrame([(i, ["Red ring", "ring, red", "bolt", "", None][i % 5]) for i in range(55)], "item long, name string")
    known = spark.createDataFrame([(i, g) for i in range(0, 50, 3) for g in ("x" if i % 2 else "y", None, f"own {i}", "z" if i % 7 == 0 else f"{i}")], "item long, `group` string")
    plain = terms.similar_pairs(rows, 0.4, block)
    want = terms.new_name_pairs(plain, names, known)
    told = lambda df: sorted((r.a, r.b, r.sim) for r in df.collect())
    assert told(terms.new_similar_pairs(rows, names, known, 0.4, block)) == told(want) and want.count() < plain.count()
    seen, whole = [], terms.mined_groups
    monkeypatch.setattr(terms, "mined_groups", lambda pairs: (seen.append(pairs.count()), whole(pairs))[1])
    groups = lambda df: sorted(map(tuple, df.collect()))
    assert groups(terms.linked_groups(rows, 0.4, block=block)) == groups(whole(plain))
    assert groups(terms.linked_groups(rows, 0.4, names, known, block)) == groups(whole(want))
    assert seen[0] < plain.count() and (block < 60 or seen[0] <= 2 * 63)
