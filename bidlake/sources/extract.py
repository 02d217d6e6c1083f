"""Tables from raw pages, JSON texts and office documents."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bidlake.functions import text as T


def blocks(pages: DataFrame, html: str, marker: str) -> DataFrame:
    """One row per block after each marker, the head of the page dropped: page_id, block, body."""
    parts = F.split(F.coalesce(F.col(html), F.lit("")), marker)
    return pages.select("page_id", F.posexplode(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0)))).alias("block", "body"))


def first_of(body: Column, *patterns: str) -> Column:
    """The first pattern that finds something; group 1."""
    return F.coalesce(*[F.nullif(F.regexp_extract(body, p, 1), F.lit("")) for p in patterns])


def extract_listings(pages: DataFrame, marker: str, rules: dict[str, list[str]], html: str = "html") -> DataFrame:
    """Listing rows from registry pages: each rule is a field with patterns tried in order; rows without ``number`` go.

    Law is 223 if its text has it, else 44; competitive unless the type is another method or a single supplier.
    """
    rows = blocks(pages, html, marker)
    fields = [T.strip_tags(first_of(F.col("body"), *patterns)).alias(name) for name, patterns in rules.items()]
    rows = rows.select("page_id", "block", "body", *fields).where(F.col("number").isNotNull())
    law = F.when(F.contains("body", F.lit("223")), "223").otherwise("44")
    competitive = ~F.lower("body").rlike("иным способом|единственн|single supplier|other method")
    return rows.select("page_id", "block", *rules, law.alias("law"), competitive.alias("competitive"))


def extract_contracts(pages: DataFrame, marker: str, rules: dict[str, list[str]], html: str = "html") -> DataFrame:
    """As for listings; rows without a customer or a price are dropped."""
    rows = blocks(pages, html, marker)
    fields = [T.strip_tags(first_of(F.col("body"), *patterns)).alias(name) for name, patterns in rules.items()]
    rows = rows.select("page_id", "block", *fields).withColumn("price", T.money(F.col("price")))
    return rows.where((F.coalesce("customer", F.lit("")) != "") & (F.col("price") > 0))


def extract_fields(pages: DataFrame, fields: dict[str, str], html: str = "html", entities: tuple[tuple[str, str], ...] = T.ENTITIES) -> DataFrame:
    """Label to value pairs of a card page as columns; each field is a pattern, an absent one null; ``entities`` are those decoded."""
    text = lambda p: T.strip_tags(F.regexp_extract(F.coalesce(F.col(html), F.lit("")), p, 1), entities)
    return pages.select("page_id", *[F.nullif(text(p), F.lit("")).alias(n) for n, p in fields.items()])


def extract_attachments(pages: DataFrame, uid: str, html: str = "html", most: int = 20, longest: int = 160) -> DataFrame:
    """Anchors whose attributes carry a uid: the first per uid, named by text, title or uid; ``most`` a page."""
    anchor = F.regexp_extract_all(F.coalesce(F.col(html), F.lit("")), F.lit(r"(?is)(<a\s[^>]*>.*?</a>)"))
    rows = pages.select("page_id", F.posexplode(anchor).alias("place", "a")).withColumn("uid", F.regexp_extract("a", uid, 1)).where("uid <> ''")
    title = F.regexp_extract("a", r"""(?i)\btitle=["']([^"']*)""", 1)
    name = F.coalesce(F.nullif(T.strip_tags(F.regexp_replace("a", r"(?is)^<a\s[^>]*>|</a>$", "")), F.lit("")), F.nullif(title, F.lit("")), F.concat(F.lit("document "), F.substring("uid", 1, 8)))
    once = Window.partitionBy("page_id", "uid").orderBy("place")
    rows = rows.withColumns({"name": name, "n": F.row_number().over(once)}).where((F.col("n") == 1) & (F.length("name") <= longest))
    return rows.withColumn("n", F.row_number().over(Window.partitionBy("page_id").orderBy("place"))).where(F.col("n") <= most).select("page_id", "n", "uid", "name")


def hopeful_attachment(name: Column) -> Column:
    """Kept: .docx and names without an extension."""
    return F.lower(name).rlike(r"\.docx$") | ~name.rlike(r"\.[A-Za-z0-9]{2,4}$")


def read_catalog(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Product cards, one JSON file each: products and their attributes in card order; values keep their JSON spelling."""
    cards = spark.read.schema("id string, name string, ktru array<string>, attributes array<struct<key:string,value:string,status:string,doc:string>>").json(path, multiLine=True)
    attributes = cards.select(F.col("id").alias("product_id"), F.posexplode_outer("attributes").alias("attr_idx", "a")).select("product_id", "attr_idx", "a.*")
    return cards.select("id", "name", "ktru"), attributes.where("key is not null")


def read_profiles(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Category profiles as dimension tables: tiers, keywords, stop words, codes, synonyms, groups of keys, critical keys, required documents."""
    lists = ("okpd2_ktru", "keywords", "stop_keywords", "critical_attributes", "required_documents")
    schema = "category string, tier string, synonyms map<string,array<string>>, key_synonyms array<array<string>>, " + ", ".join(f"{c} array<string>" for c in lists)
    rows = spark.read.schema(schema).json(path, multiLine=True)
    one = lambda c: rows.select("category", F.explode(c).alias("value"))
    words = rows.select("category", F.explode("synonyms").alias("canon", "others"))
    return {
        "codes": one("okpd2_ktru"), "keywords": one("keywords"), "stop": one("stop_keywords"), "critical": one("critical_attributes"), "documents": one("required_documents"), "tiers": rows.select("category", "tier"),
        "key_groups": rows.select("category", F.posexplode("key_synonyms").alias("group", "words")).select("category", "group", F.explode("words").alias("word")),
        "synonyms": words.select("category", "canon", F.explode(F.concat(F.array("canon"), "others")).alias("word")),
    }


PORTAL = "struct<id:long,number:string,name:string,beginDate:string,endDate:string,startCost:double,customers:array<struct<name:string,inn:string>>,items:array<struct<name:string,qty:double,unit:string,cost:double>>,deliveries:array<struct<days:int>>>"


def normalize_portal(rows: DataFrame, json: str) -> DataFrame:
    """Listings from a portal's JSON: first customer, price 0 by default, lots from items, delivery days as their maximum."""
    p = F.from_json(json, PORTAL)
    return rows.select(p.alias("p")).select(
        F.concat(F.lit("pp_"), "p.id").alias("id"), "p.number", F.col("p.name").alias("title"), F.get("p.customers", F.lit(0))["name"].alias("customer"), F.get("p.customers", F.lit(0))["inn"].alias("inn"),
        F.coalesce("p.startCost", F.lit(0.0)).alias("price"), T.local_timestamp(F.col("p.endDate")).alias("end_ts"),
        F.transform("p.items", lambda x: F.struct(x["name"].alias("name"), x["qty"].alias("qty"), x["unit"].alias("unit"), x["cost"].alias("price"))).alias("lots"),
        F.array_max(F.filter(F.transform("p.deliveries", lambda d: d["days"]), lambda d: d > 0)).alias("delivery_days"),
    )


def normalize_aggregator(rows: DataFrame, json: str) -> DataFrame:
    """Listings from an aggregator's JSON: codes of both kinds together, a scalar or a list alike, comma decimals."""
    j = F.try_parse_json(F.col(json))
    text = lambda path: F.try_variant_get(j, path, "string")
    as_list = lambda path: F.coalesce(F.try_variant_get(j, path, "array<string>"), F.when(text(path).isNotNull(), F.array(text(path))), F.array().cast("array<string>"))
    price = F.replace(F.regexp_replace(text("$.price"), r"\s", ""), F.lit(","), F.lit(".")).try_cast("double")
    return rows.select(
        text("$.id").alias("id"), text("$.subject").alias("subject"), F.concat(as_list("$.okpd2"), as_list("$.okpd")).alias("codes"), price.alias("price"),
        F.coalesce(text("$.deliveryPlaces[0]"), text("$.deliveryPlace"), text("$.region"), F.lit("")).alias("place"),
    )


def extract_positions(rows: DataFrame, json: str) -> DataFrame:
    """Positions in a table nested as JSON text within JSON: ``0.fv.0.fv.tb`` of cells {fn, fv}; any structural error gives none."""
    outer = F.try_variant_get(F.try_parse_json(F.col(json)), "$[0].fv[0].fv.tb", "string")
    table = F.from_json(outer, "array<array<struct<fn:string,fv:string>>>")
    lines = rows.select("id", F.posexplode(table).alias("pos", "cells")).withColumn("m", F.map_from_entries(F.filter("cells", lambda c: c["fn"].isNotNull())))
    out = lines.select("id", "pos", *[F.try_element_at("m", F.lit(n)).alias(c) for n, c in (("Name", "name"), ("Code", "code"), ("Quantity", "qty"), ("Price", "price"))])
    return out.where((F.coalesce("name", F.lit("")) != "") | (F.coalesce("code", F.lit("")) != ""))


# The closed vocabulary of requirement rows.
OPERATORS, HARDNESS, KINDS = ("eq", "gte", "lte", "range", "one_of", "set", "present"), ("hard", "soft"), ("technical", "documentary")


def validate_requirements(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows that satisfy the closed schema, and the others; an unknown operator is never replaced."""
    ok = F.coalesce(F.col("operator").isin(*OPERATORS) & F.col("hardness").isin(*HARDNESS) & F.col("type").isin(*KINDS) & (F.col("key") != "") & F.col("value").isNotNull(), F.lit(False))
    return rows.where(ok), rows.where(~ok)


def write_verdicts(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").partitionBy("product_id").json(path)


def read_verdicts(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def _cell_text(cell) -> str:
    """Text of a cell without the tables nested in it: runs glued, tabs and paragraph ends as spaces."""
    out = []

    def walk(node):
        for child in node:
            if child.tag == f"{_W}tbl":
                continue
            if child.tag == f"{_W}t":
                out.append(child.text or "")
            elif child.tag in (f"{_W}tab", f"{_W}br"):
                out.append(" ")
            walk(child)
            if child.tag == f"{_W}p":
                out.append(" ")

    walk(cell)
    return " ".join("".join(out).split())


def docx_tables(files: DataFrame) -> DataFrame:
    """Rows of all tables in .docx files (``binaryFile`` rows): path, table_no, row_no, cells. Unreadable files give none."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for path, content in batch[["path", "content"]].itertuples(index=False):
                try:
                    root = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(content)).read("word/document.xml"))
                except (zipfile.BadZipFile, KeyError, ElementTree.ParseError):
                    continue
                for t, table in enumerate(root.iter(f"{_W}tbl")):
                    for r, row in enumerate(table.findall(f"{_W}tr")):
                        out.append((path, t, r, [_cell_text(c) for c in row.findall(f"{_W}tc")]))
            yield pd.DataFrame(out, columns=["path", "table_no", "row_no", "cells"])

    return files.select("path", "content").mapInPandas(read, "path string, table_no int, row_no int, cells array<string>")
