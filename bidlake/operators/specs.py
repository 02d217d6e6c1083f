"""Positions and characteristics rebuilt from rows of specification tables; contract terms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bidlake.functions import text as T

# Fixed values that must equal the reference's: roles of a specification table's columns and the patterns of their headers, in the order they are tried.
ROLES = (
    ("charName", r"наименование\s+характеристик|требуемый\s+параметр|^характеристик"),
    ("charValue", r"значение\s+характеристик|требуемое\s+значение|^значение"),
    ("unit", r"ед\.?\s*изм|единиц[аы]\s+измерения"),
    ("qty", "кол-?во|количество"),
    ("hardness", "инструкц"),
    ("name", r"наименование|товар|объект\s+закупки"),
    ("code", r"ктру|код\s+позиции|окпд"),
)


def column_roles(cells: Column, roles: tuple = ROLES) -> Column:
    """Role to column number of a header row. Cells claim roles from left to right: each the first that fits and isn't taken yet."""
    claimed = F.array().cast("array<struct<role:string,col:int>>")

    def claim(acc: Column, cell: Column) -> Column:
        taken = F.transform(acc, lambda x: x["role"])
        fits = [F.when(cell["text"].rlike(pattern) & ~F.array_contains(taken, role), F.struct(F.lit(role).alias("role"), cell["col"].alias("col"))) for role, pattern in roles]
        own = F.array_compact(F.array(*fits))
        return F.concat(acc, F.slice(own, 1, 1))

    texts = F.transform(cells, lambda c, i: F.struct(T.plain(F.translate(F.coalesce(c, F.lit("")), "\u00a0", " ")).alias("text"), i.alias("col")))
    return F.map_from_entries(F.aggregate(texts, claimed, claim))


def pick_table(rows: DataFrame, roles: tuple = ROLES) -> DataFrame:
    """doc, table_no, roles, header, body: the specification table of each document, the one of most rows below its header, the first on ties.

    rows: doc, table_no, row_no, cells. The header is the first of the first three rows that names a product and a
    code or a characteristic; it tells a specification from longer tables of another kind.
    """
    heads = rows.where("row_no < 3").select("doc", "table_no", "row_no", column_roles(F.col("cells"), roles).alias("roles"))
    has = lambda role: F.map_contains_key("roles", F.lit(role))
    first = heads.where(has("name") & (has("code") | has("charName"))).groupBy("doc", "table_no").agg(F.min_by("roles", "row_no").alias("roles"), F.min("row_no").alias("header"))
    sizes = rows.groupBy("doc", "table_no").agg(F.max("row_no").alias("last"), F.count(F.lit(1)).alias("n"))
    sized = first.join(sizes.where("n >= 2"), ["doc", "table_no"]).withColumn("body", F.col("last") - F.col("header"))
    best = Window.partitionBy("doc").orderBy(F.desc("body"), "table_no")
    return sized.withColumn("n", F.row_number().over(best)).where("n = 1").select("doc", "table_no", "roles", "header", "body")


def fill_positions(rows: DataFrame) -> DataFrame:
    """Rows with the position they belong to: a non-empty name starts one, merged cells below continue it. rows: doc, row_no, name, ..."""
    order = Window.partitionBy("doc").orderBy("row_no")
    start = F.col("name") != ""
    out = rows.withColumn("pos", F.sum(start.cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0))).where("pos > 0")
    whole = Window.partitionBy("doc", "pos").orderBy("row_no").rowsBetween(Window.unboundedPreceding, 0)
    return out.withColumn("name", F.first(F.when(start, F.col("name")), ignorenulls=True).over(whole))


def positions_with_reset(rows: DataFrame, least: int = 2) -> DataFrame:
    """doc, pos, name, keys and cells: a position starts when the name changes or a key comes again in it; ones of under ``least`` keys go.

    rows: doc, row_no, name, key, and value where cells are wanted with theirs. The start depends on what the position
    holds so far, so the ordered rows of a document are folded (a document's table has bounded rows; documents are
    spread over the cluster).
    """
    value = F.col("value") if "value" in rows.columns else F.lit(None).cast("string")
    cell = F.struct("row_no", "name", "key", value.alias("value"))
    per = rows.groupBy("doc").agg(F.array_sort(F.collect_list(cell)).alias("cells"))
    kind = "struct<name:string,cells:array<struct<key:string,value:string>>>"
    empty = F.struct(F.array().cast(f"array<{kind}>").alias("done"), F.lit(None).cast(kind).alias("open"))

    def step(acc: Column, x: Column) -> Column:
        own, held = F.struct(x["key"].alias("key"), x["value"].alias("value")), acc["open"]
        fresh = held.isNull() | ~held["name"].eqNullSafe(x["name"]) | F.exists(held["cells"], lambda c: c["key"].eqNullSafe(x["key"]))
        done = F.when(fresh & held.isNotNull(), F.concat(acc["done"], F.array(held))).otherwise(acc["done"])
        cells = F.when(fresh, F.array(own)).otherwise(F.concat(held["cells"], F.array(own)))
        return F.struct(done.alias("done"), F.struct(x["name"].alias("name"), cells.alias("cells")).alias("open"))

    folded = per.select("doc", F.aggregate("cells", empty, step, lambda a: F.concat(a["done"], F.array(a["open"]))).alias("groups"))
    rows = folded.select("doc", F.posexplode(F.filter("groups", lambda g: F.size(g["cells"]) >= least)).alias("pos", "g"))
    return rows.select("doc", "pos", "g.name", F.transform("g.cells", lambda c: c["key"]).alias("keys"), F.col("g.cells").alias("cells"))


def without_repeats(positions: DataFrame, least: int = 3) -> DataFrame:
    """Positions whose ordered keys differ from those of the last one kept. positions: doc, pos, keys."""
    w = Window.partitionBy("doc").orderBy("pos")
    rows = positions.where(F.size("keys") >= least).withColumn("before", F.lag("keys").over(w))
    return rows.where(~F.col("keys").eqNullSafe(F.col("before"))).drop("before")


# Fixed values that must equal the reference's: keys that are a customer's details and no characteristics.
JUNK_KEY = r"(?iu)заказчик|адрес|почт|тел\.|факс|(?<![\p{L}\p{N}_])инн(?![\p{L}\p{N}_])|огрн|кпп|литер|e-?mail|@"


def quality_gate(keys: DataFrame, most_junk: float = 0.5) -> DataFrame:
    """Documents whose keys are under ``most_junk`` junk (numbers alone, a customer's details); ones without keys don't pass. keys: doc, key."""
    junk = F.col("key").rlike(r"^[\d\s.,]+$") | F.col("key").rlike(JUNK_KEY)
    return keys.groupBy("doc").agg(F.avg(junk.cast("int")).alias("junk")).where(F.col("junk") < most_junk)


# Fixed values that must equal the reference's: dates, durations and their phrases, and what announces a contract's term, in the order they are tried.
_DATE = r"(?:\d{1,2}[.\-/]\d{1,2}[.\-/]\d{2,4}|\d{1,2}\s+[а-яё]{3,9}\s+\d{4}(?:\s*(?:года|г\.?))?)"
_DURATION = r"\d+\s*(?:\([^)]*\)\s*)?(?:календарн\w+|рабоч\w+)?\s*(?:дн\w+|месяц\w*|недел\w+|год\w*)"
_UNTIL = rf"(?:не\s+позднее|до|по)\s+{_DATE}"
_WITHIN = rf"(?:в\s+течение|в\s+срок(?:\s+не\s+более)?)\s+{_DURATION}"
TERM_FORMS = (_WITHIN, _UNTIL, _DURATION, _DATE)
TRIGGERS = (
    "срок исполнения контракт", "срок исполнения договор", "срок исполнения обязательств", "срок поставки", "срок выполнения работ", "срок оказания услуг",
    "поставка товара осуществляется", "товар поставляется", "срок передачи товара",
)
STAGE = r"этап\s*(?:№\s*)?(\d+)"
LOOSE = rf"(?:контракт\w*|поставк\w*)[^.;\n]{{0,120}}?({_WITHIN}|{_UNTIL})"
_ANY_CASE = "(?iU)"


def first_term(window: Column) -> Column:
    """The first form of term found in a window, white space as single spaces; null if none."""
    forms = [F.nullif(F.regexp_extract(window, f"{_ANY_CASE}{form}", 0), F.lit("")) for form in TERM_FORMS]
    return T.squeeze(F.coalesce(*forms))


def stages(text: Column, window: int = 90) -> Column:
    """``Этап N: term`` of each stage number in the order of the text, from its first mention with a term within ``window`` characters.

    Mentions are found at once, their places by summing the lengths of what lies between them.
    """
    pattern = f"{_ANY_CASE}{STAGE}"
    found = F.struct(
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("whole"), F.regexp_extract_all(text, F.lit(pattern), F.lit(1)).alias("number"), F.split(text, pattern, -1).alias("between"), text.alias("text")
    )

    def place(x: Column) -> Column:
        start = F.struct(F.lit(1).alias("at"), F.array().cast("array<int>").alias("all"))
        lengths = F.transform(x["whole"], lambda w, i: F.struct(F.length(F.get(x["between"], i)).alias("before"), F.length(w).alias("own")))

        def step(acc: Column, n: Column) -> Column:
            at = acc["at"] + n["before"]
            return F.struct((at + n["own"]).alias("at"), F.concat(acc["all"], F.array(at)).alias("all"))

        places = F.aggregate(lengths, start, step, lambda acc: acc["all"])
        return F.zip_with(x["number"], places, lambda n, at: F.struct(n.alias("number"), first_term(F.substr(x["text"], at, F.lit(window))).alias("term")))

    told = F.filter(T.bound(found, place), lambda x: x["term"].isNotNull())
    numbers = lambda xs: F.transform(xs, lambda x: x["number"])
    first = T.bound(told, lambda xs: F.filter(xs, lambda x, i: F.array_position(numbers(xs), x["number"]) == i + 1))
    return F.transform(first, lambda x: F.concat(F.lit("Этап "), x["number"], F.lit(": "), x["term"]))


def contract_terms(texts: DataFrame, window: int = 240) -> DataFrame:
    """id, execution_period, stages, confidence and summary of each contract's text.

    The first trigger phrase, in their order, whose first mention has a term within ``window`` characters gives the
    period. Confidence is high with a period or stages, medium for a term near the word contract or delivery, else
    none: nothing is made up.
    """
    rows = texts.select("id", F.regexp_replace(F.coalesce("text", F.lit("")), "[ \t]+", " ").alias("t")).withColumn("low", F.lower("t"))
    at = lambda phrase: F.instr("low", phrase)
    near = [first_term(F.when(at(p) > 0, F.substr(F.col("t"), at(p), F.lit(window)))) for p in TRIGGERS]
    rows = rows.withColumns({"execution": F.coalesce(*near), "stages": F.when(F.trim("t") == "", F.array().cast("array<string>")).otherwise(stages(F.col("t")))})
    rows = rows.withColumn("loose", T.squeeze(F.nullif(F.regexp_extract("low", f"{_ANY_CASE}{LOOSE}", 1), F.lit(""))))
    sure = F.col("execution").isNotNull() | (F.size("stages") > 0)
    period = F.when(sure, F.col("execution")).otherwise(F.col("loose"))
    confidence = F.when(sure, "high").when(F.col("loose").isNotNull(), "medium").otherwise("none")
    parts = F.array_compact(F.array(F.concat(F.lit("Срок исполнения: "), period), F.when(F.size("stages") > 0, F.concat(F.lit("Этапы — "), F.array_join("stages", "; ")))))
    return rows.select("id", period.alias("execution_period"), "stages", confidence.alias("confidence"), F.nullif(F.array_join(parts, " | "), F.lit("")).alias("summary"))
