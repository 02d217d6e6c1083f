"""Golden pairs: products and requirements with the verdict an expert gave, read from JSON and held against the engine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bidlake.operators import evaluate as E
from bidlake.operators import lots as L


def value_of_json(v: Column) -> Column:
    """The value of any kind in a variant: text, number, boolean or list; null for null and objects."""

    def plain(x: Column) -> Column:
        kind = F.schema_of_variant(x)
        number = kind.rlike("^(BIGINT|DOUBLE|DECIMAL|FLOAT)")
        as_type = lambda t: F.try_variant_get(x, "$", t)
        return F.when(kind == "STRING", E.value_of("str", as_type("string"))).when(number, E.value_of("num", as_type("double"))).when(kind == "BOOLEAN", E.value_of("bool", as_type("boolean")))

    items = F.transform(F.try_variant_get(v, "$", "array<variant>"), plain)
    spelled = F.concat(F.lit("["), F.array_join(F.transform(items, lambda x: F.when(x["kind"] == "str", F.concat(F.lit("'"), x["s"], F.lit("'"))).otherwise(x["s"])), ", "), F.lit("]"))
    members = F.transform(items, lambda x: F.struct(x["kind"].alias("kind"), x["s"].alias("s"), x["d"].alias("d"), x["b"].alias("b")))
    null = F.lit(None)
    many = F.struct(F.lit("list").alias("kind"), spelled.alias("s"), null.cast("double").alias("d"), null.cast("boolean").alias("b"), members.alias("items")).cast(E.VALUE)
    return F.when(F.schema_of_variant(v).startswith("ARRAY"), many).otherwise(plain(v))


ATTRIBUTE = "struct<key:string,value:variant,status:string>"
REQUIREMENT = "struct<key:string,operator:string,value:variant,unit:string,hardness:string,type:string,remapped:boolean,remap_locked:boolean>"


def read_pairs(spark: SparkSession, path: str) -> DataFrame:
    """id, expected_verdict, expected_score, synonyms, attributes, requirements of each file under ``path``, one pair a file."""
    schema = f"id string, expected_verdict string, expected_score int, synonyms map<string,array<string>>, product struct<attributes:array<{ATTRIBUTE}>>, requirements array<{REQUIREMENT}>"
    rows = spark.read.schema(schema).json(path, multiLine=True)
    return rows.select("id", "expected_verdict", "expected_score", "synonyms", F.col("product.attributes").alias("attributes"), "requirements")


def report(pairs: DataFrame) -> DataFrame:
    """id, expected_verdict, verdict, expected_score, score and ok of each pair: all pairs are judged in one pass, each by its own synonyms."""
    on = ["id"]
    groups = E.group_table(pairs.select("id", F.explode("synonyms").alias("canon", "others")).select("id", "canon", F.explode(F.concat(F.array("canon"), "others")).alias("word")), ["id", "canon"])
    wanted = pairs.select("id", F.posexplode("requirements").alias("req_idx", "r"))
    wanted = wanted.select(
        "id", F.col("id").alias("product_id"), "req_idx", "r.key", "r.operator", value_of_json(F.col("r.value")).alias("req"), F.coalesce("r.unit", F.lit("")).alias("req_unit"), F.coalesce("r.hardness", F.lit("soft")).alias("hardness"),
        F.coalesce("r.type", F.lit("technical")).alias("type"), F.coalesce("r.remapped", F.lit(False)).alias("remapped"), F.coalesce("r.remap_locked", F.lit(False)).alias("remap_locked"),
    )
    own = pairs.select("id", F.posexplode("attributes").alias("attr_idx", "a"))
    own = own.select(F.col("id").alias("product_id"), "attr_idx", "a.key", value_of_json(F.col("a.value")).alias("attr"), F.coalesce("a.status", F.lit("declared")).alias("attr_status"))
    met = E.meet_attributes(wanted, own)
    key = ["id", "req_idx"]
    met = E.with_groups(E.with_groups(met, key, "req", groups, "req_groups"), key, "attr", groups, "attr_groups")
    judged = E.verdicts(pairs, E.evaluate(met), on).select("id", "verdict", "score")
    rows = pairs.select("id", "expected_verdict", "expected_score").join(judged, "id")
    return rows.withColumn("ok", (F.col("verdict") == F.col("expected_verdict")) & (F.col("score") == F.col("expected_score")))


def accuracy(rows: DataFrame) -> DataFrame:
    """The confusion matrix of a :func:`report`: fits are all verdicts but disqualified."""
    fits = lambda c: F.col(c) != "disqualified"
    return L.accuracy(rows.select(fits("expected_verdict").alias("expected"), fits("verdict").alias("fits")))
