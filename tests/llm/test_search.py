import math
import random
import re

import duckdb
import numpy as np
from pyspark.sql import functions as F

from bidlake.llm import queries, search
from bidlake.llm.search import ranked_search

DATA = "/root/testdata/sf0.001"


def terms(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", low)


def brute(docs, items, k=10):
    own = [(i, terms(t)) for i, t in docs]
    own = [(i, t) for i, t in own if t]
    n_docs, total, wanted = len(own), sum(len(t) for _, t in own), {}
    for i, t in items:
        wanted.setdefault(i, set()).update(terms(t))
    out = []
    for item, words in wanted.items():
        w = {x: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * sum(x in t for _, t in own) + 1))) for x in words}
        rows = []
        for i, t in own:
            m = 10 + 90 * len(t) * n_docs // total
            rows.append((-sum(w[x] * (1_000_000_000 * t.count(x) // (1000 * t.count(x) + 8 * m)) for x in words), i is None, i))
        rows = sorted(r for r in rows if r[0] < 0)[:k]
        out += [(item, r + 1, i, -s) for r, (s, _, i) in enumerate(rows)]
    return sorted(out, key=str)


def result(df):
    return sorted([tuple(r) for r in df.select("item_id", "rank", "doc_id", "score").collect()], key=str)


def test_query_equals_sql(spark):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"create view {t} as select * from read_parquet('{DATA}/{t}.parquet')")
    want = con.execute(queries.OP12_SQL).fetchall()
    assert result(queries.op12_ranked_search(spark, DATA)) == sorted([tuple(r) for r in want], key=str)


def tables(spark):
    rng = random.Random(5)
    words = ["w%d" % i for i in range(40)] + ["É", "日本", "the"]
    docs = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(1, 30))) + " the") for i in range(150)]
    docs += [(i, docs[3][1]) for i in range(200, 230)]  # ties beyond any k
    docs += [(None, docs[3][1]), (231, None), (232, ""), (233, "-- .."), (5, docs[5][1]), (5, docs[5][1]), (234, "w1, " * 60_000 + "W2")]
    items = [(i, " ".join(rng.choice(words) for _ in range(5))) for i in range(12)] + [(20, docs[3][1]), (20, "w7"), (21, None), (22, "absent"), (None, "the É")]
    return docs, items, spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")


def test_brute_force_with_ties_nulls_and_blocks(spark):
    docs, items, d, i = tables(spark)
    want = brute(docs, items)
    assert sum(r[0] == 20 for r in want) == 10
    assert result(ranked_search(d.repartition(5), i)) == want
    assert result(ranked_search(d.repartition(2), i, most=24, tile=2)) == want


def test_empty_tables_other_types_and_columns(spark):
    _, _, d, i = tables(spark)
    assert ranked_search(d.limit(0), i).count() == 0 and ranked_search(d, i.limit(0)).count() == 0
    named = d.where("doc_id < 9").withColumn("doc_id", F.concat(F.lit("d"), "doc_id")).withColumns({"n": F.lit(1), "Score": F.lit(2)})
    out = ranked_search(named, i.withColumn("rank", F.lit(0)))
    assert out.columns == ["item_id", "rank", "doc_id", "score"] and out.first().doc_id.startswith("d")


def test_partial_sums_stay_exact():
    rng, n = np.random.default_rng(1), 3000
    w, impact = np.full(n, 900_000_001, np.int64), rng.integers(1, 1_000_000, n)
    rows, cols = np.zeros(n, np.int64), np.arange(n)
    got = search.tile_scores(rows, cols, w, 1, cols, np.zeros(n, np.int64), impact, 1)
    assert int(got[0, 0]) == sum(int(a) * int(b) for a, b in zip(w, impact)) > 1 << 53


def test_top_takes_the_first_of_equal_scores():
    scores, order = np.array([5, 7, 5, 0, 5, 7, 5]), np.array([6, 5, 4, 3, 2, 1, 0])
    assert search.top(scores, order, 4).tolist() == [5, 1, 6, 4]
    assert search.top(np.array([0, 3]), np.array([0, 1]), 4).tolist() == [1]


def test_slabs_end_between_terms(monkeypatch):
    monkeypatch.setattr(search, "_STEP", 7)
    text = "Abc, défg 日本語日本語 x_y " * 9
    assert [w.decode() for part in search.terms(text) for w in part] == terms(text)
