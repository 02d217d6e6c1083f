"""Twelve pairs of our own, three of them hard negatives, with verdicts and scores worked out by hand."""

import json

import pytest
from pyspark.sql import functions as F

from bidlake.operators import golden


def pair(id, verdict, score, attributes, requirements, synonyms=None):
    cards = [{"key": k, "value": v, "status": "declared"} for k, v in attributes]
    names = ("key", "operator", "value", "unit", "hardness", "type")
    asked = [dict(zip(names, (*r, *("", "soft", "technical")[len(r) - 3 :]), strict=True)) if isinstance(r, tuple) else r for r in requirements]
    return {"id": id, "expected_verdict": verdict, "expected_score": score, "synonyms": synonyms or {}, "product": {"id": id, "name": id, "attributes": cards}, "requirements": asked}


PAIRS = [
    pair("all met", "eligible", 100, [("длина", "24 см"), ("материал", "Сталь нержавеющая"), ("стерильно", True)], [("длина", "gte", 240, "мм"), ("материал", "eq", "сталь"), ("стерильно", "eq", True)]),
    pair("a gap", "eligible_with_gaps", 67, [("a", 1), ("b", "x")], [("a", "eq", 1), ("b", "eq", "X"), ("c", "present", True)]),
    pair("half to even", "eligible_with_gaps", 12, [("a", 1)], [("a", "eq", 1)] + [{"key": f"d{i}", "operator": "present", "value": True, "hardness": "soft", "type": "documentary"} for i in range(14)]),
    pair("soft violation", "eligible_with_gaps", 50, [("a", 5), ("b", 5)], [("a", "lte", 5), ("b", "gte", 6)]),
    pair("range and list", "eligible", 100, [("толщина", "0,12"), ("размеры", ["S", "M", "L"])], [("толщина", "range", [0.1, 0.2], "мм"), ("размеры", "set", ["m", "s"])]),
    pair("synonyms", "eligible", 100, [("свет", "светодиодная лампа"), ("цвет", "белый")], [("свет", "one_of", ["LED", "ксенон"]), ("цвет", "one_of", ["синий", "Белый"])], {"led": ["светодиодная лампа"]}),
    pair("number in a text", "eligible", 100, [("напряжение", "3,5 В")], [("напряжение", "eq", 3.5, "В")]),
    pair("remapped fails softly", "eligible_with_gaps", 0, [("тип", "прямой")], [{"key": "тип", "operator": "eq", "value": "изогнутый", "hardness": "hard", "type": "technical", "remapped": True, "remap_locked": False}]),
    pair("nothing asked", "eligible", 0, [("a", 1)], []),
    pair("hard bound NEGATIVE", "disqualified", 50, [("длина", "230 мм"), ("цвет", "синий")], [("длина", "gte", 24, "см", "hard"), ("цвет", "eq", "синий")]),
    pair("wrong unit NEGATIVE", "disqualified", 67, [("ток", "3 А"), ("a", "да"), ("b", 0)], [("ток", "gte", 2, "В", "hard"), ("a", "present", True), ("b", "eq", 0)]),
    pair("denied NEGATIVE", "disqualified", 0, [("одноразовый", "нет")], [("одноразовый", "eq", True, "", "hard")]),
]


@pytest.fixture(scope="module")
def report(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("pairs")
    for i, p in enumerate(PAIRS):
        (folder / f"{i:02}.json").write_text(json.dumps(p, ensure_ascii=False, indent=1))
    return golden.report(golden.read_pairs(spark, str(folder))).cache()


def test_every_pair(report):
    got = {r.id: r for r in report.collect()}
    assert len(got) == 12
    assert not [(r.id, r.verdict, r.score, r.expected_verdict, r.expected_score) for r in got.values() if not r.ok]


def test_confusion(report):
    r = golden.accuracy(report).first()
    assert (r.tp, r.tn, r.fp, r.fn, r.accuracy, r.specificity) == (9, 3, 0, 0, 1.0, 1.0)


def test_values_of_any_kind(spark):
    texts = ['"3"', "3", "2.5", "true", '["a", 1, false]', "[]", "null", '{"a": 1}', None]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", golden.value_of_json(F.parse_json("t")).alias("v")).orderBy("i").collect()
    assert [(r.v.kind, r.v.s) if r.v else None for r in rows] == [("str", "3"), ("num", "3.0"), ("num", "2.5"), ("bool", "True"), ("list", "['a', 1.0, False]"), ("list", "[]"), None, None, None]
