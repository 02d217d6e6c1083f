"""Texts for readers, regions, prices and profile tables by hand."""

import datetime as dt

from pyspark.sql import functions as F

from bidlake.functions import text as T
from bidlake.operators import evaluate as E
from bidlake.operators import terms as M
from bidlake.sources import extract as X
from bidlake.sources.snapshots import renewed


def column(spark, pairs, f):
    rows = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, c string, want string").orderBy("i")
    return [(r.c, r.got) for r in rows.select("c", f(F.col("c")).alias("got")).collect()]


def test_regions(spark):
    tidy = [("МАГАДАНСКАЯ  ОБЛАСТЬ", "Магаданская область"), ("ханты-мансийский Автономный округ - югра", "Ханты-Мансийский автономный округ - Югра"), ("Москва", "Москва"), ("  ", ""), (None, ""), ("PERM КРАЙ", "Perm край")]
    assert column(spark, tidy, T.tidy_region) == tidy
    canonical = [("Р-н Хвойнинский", "Новгородская область"), ("г.москва", "г. москва"), ("Г. Санкт Петербург", "г. Санкт Петербург"), (" Пермский край ", "Пермский край"), ("Республика Коми", "Республика Коми"), ("г. Тверь", ""), ("", ""), (None, "")]
    assert column(spark, canonical, T.canonical_region) == canonical


def test_units_clips_and_rows(spark):
    units = [("мм (Миллиметр)", "мм"), ("шт", "шт"), ("(Штука)", "(Штука)"), (None, "")]
    assert column(spark, units, T.unit_label) == units
    texts = [("a" * 120, "a" * 120), ("b" * 118 + " cd", "b" * 118 + "…"), (None, None)]
    assert column(spark, texts, T.clipped) == texts
    rows = spark.createDataFrame([(1, ["a", None, " b\nc "]), (2, ["", None]), (3, [])], "i int, c array<string>").select("i", T.piped(F.col("c")).alias("line"))
    got = {r.i: (r.line, r.back) for r in rows.withColumn("back", T.unpiped(F.col("line"))).collect()}
    assert got == {1: ("| a |  | b c |", ["a", "", "b c"]), 2: (None, None), 3: (None, None)}


def test_unit_prices_and_renewals(spark):
    rows = spark.createDataFrame([("Портал", 5.0, "2"), ("ЕИС", 5.0, "2,5 шт"), (None, 5.0, "1 000"), ("ЕИС", 5.0, "—"), ("ЕИС", 5.0, "0"), ("ЕИС", 5.0, None)], "s string, p double, q string")
    assert [r[0] for r in rows.select(T.unit_price(F.col("s"), F.col("p"), F.col("q"))).collect()] == [5.0, 2.0, 0.005, None, None, None]
    day = lambda n: F.lit(dt.datetime(2024, 1, n)).cast("timestamp_ntz")
    assert tuple(spark.range(1).select(renewed(day(9), day(5)), renewed(day(1), day(5))).first()) == (dt.datetime(2024, 2, 8), dt.datetime(2024, 2, 4))


def test_requirements_in_words(spark):
    one = spark.range(1)
    v = lambda kind, x: E.value_of(kind, x).cast(E.VALUE)
    cases = [("gte", v("num", F.lit(5.0)), "мм (Миллиметр)", "≥ 5 мм", "≥ 5 мм (Миллиметр)"), ("range", v("list", F.array(F.lit("1"), F.lit("2"))), "", "1–2", "диапазон ['1', '2']"), ("present", v("bool", F.lit(True)), "", "требуется", "наличие True"), ("eq", v("str", F.lit("v1.0")), "", "v1.0", "= v1.0"), ("lte", v("num", F.lit(2.5)), "кг", "≤ 2.5 кг", "≤ 2.5 кг")]
    for operator, value, unit, shown, signed in cases:
        row = one.select(value.alias("v")).select(E.requirement_text(F.lit(operator), F.col("v"), F.lit(unit)), E.signed_text(F.lit(operator), F.col("v"), F.lit(unit))).first()
        assert tuple(row) == (shown, signed)


def test_profiles_hold_tiers_groups_and_documents(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"category": "c", "tier": "core", "keywords": ["k"], "key_synonyms": [["x", "y"], ["z"]], "required_documents": ["d1", "d2"], "synonyms": {"a": ["b"]}}', encoding="utf-8")
    dims = X.read_profiles(spark, str(tmp_path))
    assert dims["tiers"].first().tier == "core" and {r.value for r in dims["documents"].collect()} == {"d1", "d2"}
    assert {(r["group"], r["word"]) for r in dims["key_groups"].collect()} == {(0, "x"), (0, "y"), (1, "z")}


def test_new_name_pairs(spark):
    pairs = spark.createDataFrame([(1, 2, 0.9), (1, 3, 0.8), (2, 3, 0.7), (3, 4, 0.6)], "a int, b int, sim double")
    names = spark.createDataFrame([(1, "Red ring"), (2, "ring, red"), (3, "bolt")], "item int, name string")
    known = spark.createDataFrame([(2, "g"), (3, "g"), (1, "h")], "item int, `group` string")
    assert sorted((r.a, r.b) for r in M.new_name_pairs(pairs, names, known).collect()) == [(1, 3), (3, 4)]


def test_remaining_time_and_lots(spark):
    from bidlake.operators.search import remaining
    from bidlake.sources.snapshots import with_lots

    at = lambda *x: dt.datetime(2024, 1, *x)
    ends = [(1, at(3, 5, 7, 59)), (2, at(1)), (3, None), (4, at(1, 0, 0, 30))]
    rows = spark.createDataFrame(ends, "i int, e timestamp_ntz").select("i", remaining(F.col("e"), F.lit(at(1, 0, 0, 0)).cast("timestamp_ntz")).alias("r"))
    assert {r.i: tuple(r.r) if r.r else None for r in rows.collect()} == {1: (2, 5, 7), 2: (0, 0, 0), 3: None, 4: (0, 0, 0)}
    lots = spark.createDataFrame([(1, "t", 5.0, None), (2, "t", 5.0, []), (3, "t", 5.0, [("a", 1.0, "шт", 2.0)])], "id int, title string, price double, lots array<struct<name:string,qty:double,unit:string,price:double>>")
    assert {r.id: [tuple(x) for x in r.lots] for r in with_lots(lots).collect()} == {1: [("t", None, "", 5.0)], 2: [("t", None, "", 5.0)], 3: [("a", 1.0, "шт", 2.0)]}


def test_notes_say_what_is_missing(spark):
    one = spark.range(1)
    v = lambda x: E.value_of("num", F.lit(x)).cast(E.VALUE)
    row = lambda status, own: one.select(F.lit("длина").alias("key"), F.lit("gte").alias("operator"), v(5.0).alias("req"), F.lit("мм").alias("req_unit"), own.alias("attr"), F.lit(status).alias("status"))
    rows = row("violation", v(3.5)).union(row("gap", F.lit(None).cast(E.VALUE))).union(row("pass", v(6.0)))
    assert [r.note for r in E.notes(rows).collect()] == ["товар: 3.5, требуется: ≥ 5 мм", "указать/подтвердить: длина (≥ 5 мм)", None]


def test_notes_spell_lists_as_they_are(spark):
    number = lambda x: F.struct(F.lit("num").alias("kind"), F.lit(str(x)).alias("s"), F.lit(x).alias("d"), F.lit(None).cast("boolean").alias("b"))
    price = F.struct(F.lit("list").alias("kind"), F.lit("860.0..940.0").alias("s"), F.lit(None).cast("double").alias("d"), F.lit(None).cast("boolean").alias("b"), F.array(number(860.0), number(940.0)).alias("items")).cast(E.VALUE)
    row = spark.range(1).select(price.alias("v"), E.value_of("num", F.lit(940.0)).alias("n"))
    assert tuple(row.select(E.signed_text(F.lit("range"), F.col("v"), F.lit("")), E.short_text(F.col("n"))).first()) == ("диапазон 860.0..940.0", "940")


def test_fields_decode_the_entities_asked_for(spark):
    page = spark.createDataFrame([(1, "<b>a &lt; &quot;b&quot; &amp;lt;</b>")], "page_id int, html string")
    pattern = {"t": "<b>([^<]*)</b>"}
    assert X.extract_fields(page, pattern).first().t == 'a < "b" &lt;'
    assert X.extract_fields(page, pattern, entities=T.MARKUP).first().t == "a < &quot;b&quot; &lt;"


def test_number_of_texts_with_and_without_one(spark):
    cases = [("", None), (None, None), ("нет", None), ("-", None), ("-3,5 и 7", -3.5), ("до 1.2.3", 1.2), ("12мм", 12.0), ("5,", 5.0)]
    number = T.number(F.col("s"))
    rows = spark.createDataFrame(cases, "s string, want double").repartition(2).select("s", "want", number.alias("n"))
    assert all(r.n == r.want for r in rows.collect())
    assert "regexp_extract_all" in rows._jdf.queryExecution().optimizedPlan().toString()  # null, not an empty text, goes into the cast
