"""What takes part in a step is bounded by what differs, not by the rows."""

from pyspark.sql import functions as F

from bidlake.operators import characteristics as C
from bidlake.operators import evaluate as E
from bidlake.operators import lots as L
from bidlake.plans import bindings as B
from bidlake.plans import registry

DATA = "/root/testdata/sf0.001"


def test_list_fingerprints_equal_those_of_rows_and_shuffle_no_requirement(spark):
    rows = B.positions(spark, DATA)
    whole = {(r[0], r[1]): r[2] for r in rows.select("purchase_id", "pos", E.fingerprint_of(B.wants())).collect()}
    assert whole == {(r[0], r[1]): r[2] for r in E.fingerprint(B.requirements(spark, DATA), ["purchase_id", "pos"]).collect()}
    assert "Generate" not in registry.queries()["agg17_fingerprint_classes"](spark, DATA)._jdf.queryExecution().sparkPlan().toString()


def test_equal_products_take_part_once(spark, monkeypatch):
    seen, plain = [], L._shared_tokens
    monkeypatch.setattr(L, "_shared_tokens", lambda wanted, own, on: (seen.append(own.count()), plain(wanted, own, on))[1])
    names = ["red bolt", "red nut", "blue bolt"]
    products = spark.createDataFrame([(i, names[i % 3], ["01.02.03.004", "09.09.09.009"][i % 2]) for i in range(1, 301)], "product_id long, name string, code string")
    lines = spark.createDataFrame([(1, 1, "01.02.03", "blue bolt"), (1, 2, "77.77.77", "nut"), (1, 3, "01.02.03", "none at all"), (2, 1, None, "bolt")], "purchase_id long, pos int, code string, name string")
    tokens = lambda df: df.withColumn("tokens", L.long_tokens(F.col("name")))
    got = L.pick_product(products.select("product_id", "code"), tokens(products), lines.drop("name"), tokens(lines))
    assert sorted((r.purchase_id, r.pos, r.product_id, r.reason) for r in got.collect()) == [(1, 1, 2, "group"), (1, 2, 1, "name"), (1, 3, 2, "group"), (2, 1, 2, "name")]
    assert max(seen) <= 6, seen


def test_products_counted_at_their_best_position(spark):
    products, lines = B.product_codes(spark, DATA), B.position_codes(spark, DATA).drop("product_id")
    sets = L.code_sets(products, ["product_id"])
    best = L.best_position(sets, lines).join(sets.withColumnRenamed("codes", "l_codes"), "l_codes").groupBy("purchase_id", "pos", "rank").count()
    out = L.best_position_counts(products, lines)
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, best.collect()))
    plan = out._jdf.queryExecution().sparkPlan().toString()
    assert "Window" not in plan and "lineitem" not in plan  # positions were read once, before


def test_names_are_judged_once_a_pair(spark, monkeypatch):
    seen, plain = [], E.evaluate
    monkeypatch.setattr(E, "evaluate", lambda rows, *more: (seen.append(rows.count()), plain(rows, *more))[1])
    assert registry.queries()["joi6_synonym_groups"](spark, DATA).count() > 625
    assert seen and max(seen) <= 625


def test_equal_positions_are_judged_once_and_no_requirement_is_shuffled(spark, monkeypatch):
    """Equal positions of many lots, some with nulls and some without characteristics: what is evaluated doesn't grow with the lots."""
    seen, plain = [], E.evaluate
    monkeypatch.setattr(E, "evaluate", lambda rows, *more: (seen.append(rows), plain(rows, *more))[1])
    told = F.when(F.col("size").isNull(), F.array().cast("array<string>")).otherwise(F.array(F.concat(F.lit("не менее "), "size"), F.lit("≤ 900")))
    cells = F.transform(told, lambda x: C.characteristic(F.lit("Размер"), x, F.lit("мм"), F.lit("не может изменяться")))
    kinds = [("red bolt", ["01.02.03"], 10), ("red bolt", ["01.02.03"], 90), ("red bolt", ["01.02.03"], None), (None, ["01.02.03.004"], 10), ("", None, 10)]
    rows = [(lot, pos, *kind) for lot in range(200) for pos, kind in enumerate(kinds)]
    positions = spark.createDataFrame(rows, "purchase_id long, pos int, name string, codes array<string>, size int")
    products = spark.createDataFrame([(1, "red bolt", ["01.02.03.004-00000001"]), (2, "blue bolt", ["01.02.03"])], "product_id long, name string, codes array<string>")
    card = lambda id, size: spark.range(1).select(F.lit(id).cast("long").alias("product_id"), F.lit("declared").alias("attr_status"), F.lit(0).alias("attr_idx"), F.lit("Размер").alias("key"), E.value_of("num", F.lit(size)).cast(E.VALUE).alias("attr"))
    got = C.position_matches(positions, products, card(1, 50.0).union(card(2, 5.0)), cells)
    want = [(1, "group", 100, "eligible", 2), (1, "group", 50, "disqualified", 2), (1, "group", 0, "eligible", 0), (1, "group", 100, "eligible", 2), (None, "none", 0, "disqualified", 0)]
    assert sorted(map(tuple, got.collect()), key=lambda r: r[:2]) == [(lot, pos, *w) for lot in range(200) for pos, w in enumerate(want)]
    assert [rows.count() for rows in seen] == [7]
    plan = got._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("Generate") == 1 and plan.count("Join") == 3


def test_every_document_with_subject_terms_is_a_subject(spark):
    queries = registry.queries()
    subjects = {r.id for r in queries["rnk2_subject_terms"](spark, DATA).select("id").distinct().collect()}
    met = {(r.id, r.listing) for r in queries["rnk3_subject_match"](spark, DATA).select("id", "listing").collect()}
    assert {(i, i) for i in subjects} <= met and {i for i, _ in met} == subjects and any(i % 100 for i in subjects)
