import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from bidlake.llm.mixing import mix, mixed, probabilities, rake, tempered

DATA = "/root/testdata/sf0.01"


def cells(seed=0):
    rng = np.random.default_rng(seed)
    rows = [(s, la, t, int(rng.integers(1, 10_000))) for s in ["a", "b", None, "d"] for la in ["en", "de"] for t in ["x", "y", "z"] if rng.random() < 0.9]
    return pd.DataFrame(rows, columns=["source", "lang", "topic", "tokens"])


def test_raked_marginals_meet_the_targets():
    table = cells()
    targets = {"source": {"a": 0.4, "b": 0.3, None: 0.2, "d": 0.1}, "lang": {"en": 0.5, "de": 0.5}, "topic": {"x": 0.2, "y": 0.3, "z": 0.5}}
    share = rake(table, targets)
    for dim, wanted in targets.items():
        got = pd.Series(share).groupby([str(v) if pd.notna(v) else "None" for v in table[dim]]).sum()
        assert all(abs(got[str(k)] - v) < 1e-6 for k, v in wanted.items())
    # Raking keeps the odds ratios of the data: share / tokens is a product of one factor a dimension.
    gain = np.log(share / table["tokens"].to_numpy())
    design = pd.get_dummies(table[["source", "lang", "topic"]].fillna("None")).to_numpy(float)
    assert np.abs(gain - design @ np.linalg.lstsq(design, gain, rcond=None)[0]).max() < 1e-5


def test_values_without_target_or_tokens():
    table = cells()
    share = rake(table, {"source": {"a": 1.0, "nowhere": 1.0}, "lang": {"en": 0.25, "de": 0.75}})
    assert abs(share.sum() - 1) < 1e-9 and share[(table["source"] != "a").to_numpy()].sum() == 0
    assert abs(share[(table["lang"] == "de").to_numpy()].sum() - 0.75) < 1e-6


def test_probabilities():
    tokens, share = np.array([100.0, 300.0, 600.0]), np.array([0.5, 0.3, 0.2])
    p = probabilities(tokens, share, None)
    assert p.max() == 1 and np.allclose(p * tokens / (p * tokens).sum(), share)
    p = probabilities(tokens, share, 500)
    assert abs((p * tokens).sum() - 500) < 1e-3 and p[0] == 1
    assert np.allclose(probabilities(tokens, share, 1e9), 1)


def test_mixture_follows_the_probabilities(spark):
    docs = spark.range(20_000).select(
        F.col("id").alias("doc_id"), F.concat(F.lit("w "), F.col("id")).alias("text"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), F.col("id") % 10)).alias("source"),
        F.when(F.col("id") % 7 == 0, None).otherwise("en").alias("lang"), F.lit("x").alias("kept"),
    )
    rows = mix(docs, powers={"source": 0.0, "lang": 0.5, "topic": 1.0})
    got = rows.toPandas()
    assert len(got) == 20_000
    for _, part in got.groupby(["source", "lang"], dropna=False):
        p = part["probability"].iloc[0]
        assert abs(part["kept"].mean() - p) < 5 * (p * (1 - p) / len(part)) ** 0.5 + 1e-9
    spread = got[got["kept"]].groupby("source")["tokens"].sum()
    assert spread.max() / spread.min() < 1.25
    kept = mixed(docs, powers={"source": 0.0, "lang": 0.5, "topic": 1.0})
    assert kept.columns == docs.columns and kept.count() == got["kept"].sum()


def test_nulls_repeats_and_none(spark):
    schema = "doc_id long, text string, source string, lang string, topic string"
    docs = spark.createDataFrame([(None, None, None, None, "q"), (1, "a", "s", "en", "q"), (1, "a", "s", "en", "q"), (2, "", "s", None, "q"), (3, "x" * 200_000, "s", "en", "q")], schema)
    got = mix(docs).toPandas()
    assert len(got) == 5 and got[got["doc_id"] == 1]["kept"].nunique() == 1
    assert mix(docs.limit(0)).count() == 0 and mixed(docs.limit(0)).count() == 0


def test_given_tables_keep_the_tempered_marginals(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    got = mix(docs).toPandas()
    table = got.groupby(["source", "lang", "topic"], as_index=False)["tokens"].sum()
    expected = got["tokens"] * got["probability"]
    for dim, wanted in tempered(table, {"source": 0.7, "lang": 0.85, "topic": 1.0}).items():
        share = expected.groupby(got[dim]).sum() / expected.sum()
        assert all(abs(share[k] - v) < 1e-6 for k, v in wanted.items())


def test_a_rare_source_barely_moves_the_kept_share(spark):
    docs = spark.range(10_000).select(
        F.col("id").alias("doc_id"), F.concat(F.lit("w w w w "), F.col("id")).alias("text"), F.concat(F.lit("s"), F.col("id") % 20).alias("source"), F.lit("en").alias("lang")
    )
    odd = docs.withColumn("source", F.when(F.col("doc_id") == 5, "odd").otherwise(F.col("source")))
    shares = [mix(d).agg(F.avg(F.col("kept").cast("double"))).first()[0] for d in (docs, odd)]
    assert abs(shares[0] - shares[1]) < 0.01 and min(shares) > 0.65
    assert mix(odd).where("source = 'odd' and kept").count() == 1


def test_given_targets_stay_exact_without_a_budget(spark):
    docs = spark.range(1000).select(F.col("id").alias("doc_id"), F.lit("w").alias("text"), F.lit("s").alias("source"), F.when(F.col("id") % 10 == 0, "de").otherwise("en").alias("lang"))
    got = mix(docs, targets={"lang": {"de": 0.5, "en": 0.5}}).toPandas().groupby("lang")["probability"].first()
    assert abs(got["de"] - 1) < 1e-9 and abs(got["en"] - 1 / 9) < 1e-6


def test_cells_raked_as_a_table_get_the_same_probabilities(spark):
    docs = spark.createDataFrame(
        [(i, f"{'w ' * (i % 17 + 1)}{'|' if i % 3 else ' | '}", None if i % 11 == 0 else f"s{i * i % 7}", "en" if i % 4 else "de") for i in range(400)],
        "doc_id long, text string, source string, lang string",
    )
    targets = {"source": {**{f"s{i}": 1.0 + i for i in range(6)}, None: 2.0}, "lang": {"en": 0.6, "de": 0.4}}
    for options in ({}, {"targets": targets}, {"targets": targets, "budget": 900.0}):
        here, there = (mix(docs, driver_cells=n, **options).orderBy("doc_id").collect() for n in (100, 1))
        assert [(r.doc_id, r.kept) for r in here] == [(r.doc_id, r.kept) for r in there]
        assert len(there) == 400 and max(abs(a.probability - b.probability) for a, b in zip(here, there, strict=True)) < 1e-6


def test_contradicting_targets_are_reported():
    cells = pd.DataFrame({"source": ["a", "b"], "lang": ["x", "y"], "tokens": [5, 5]})
    with pytest.warns(UserWarning, match="off by"):
        rake(cells, {"source": {"a": 0.9, "b": 0.1}, "lang": {"x": 0.2, "y": 0.8}})
