"""Codes, choice of products, coverage of lots, leads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from bidlake.functions import text as T
from bidlake.functions.shared import saved


def lot_coverage(purchases: DataFrame, verdicts: DataFrame) -> DataFrame:
    """All-or-nothing coverage of each purchase; one without positions is ``no-spec``."""
    lots = verdicts.groupBy("purchase_id").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("verdict") != "disqualified").alias("covered"), F.bround(F.avg("score"), 0).cast("int").alias("score")
    )
    rows = purchases.join(lots, "purchase_id", "left")
    status = F.when(F.col("total").isNull(), "no-spec").when(F.col("covered") == F.col("total"), "eligible").otherwise("partial")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return rows.select("purchase_id", zero("total"), zero("covered"), zero("score"), status.alias("status"))


def coverage_class(min_score: int = 60, min_tech: int = 1) -> Column:
    """Why a position counts as ours or not, from verdict, score and tech_passed."""
    return (
        F.when(F.col("verdict") == "disqualified", "critical mismatch")
        .when(F.col("tech_passed") < min_tech, "supply only")
        .when(F.col("score") < min_score, "below threshold")
        .otherwise("ours")
    )


def best_lead(verdicts: DataFrame, min_score: int) -> DataFrame:
    """The best-scored lead of each purchase, the first on ties, unless disqualified or below ``min_score``."""
    best = Window.partitionBy("purchase_id").orderBy(F.desc("score"), "pos")
    rows = verdicts.withColumn("_n", F.row_number().over(best)).where("_n = 1")
    return rows.where((F.col("verdict") != "disqualified") & (F.col("score") >= min_score)).select("purchase_id", "pos", "product_id", "score", "verdict")


def best_card(verdicts: DataFrame, on: list[str], tie: str) -> DataFrame:
    """Of the cards tried for a position the one not disqualified with the highest score, the first on ties."""
    best = Window.partitionBy(*on).orderBy(F.desc(F.col("verdict") != "disqualified"), F.desc("score"), tie)
    return verdicts.withColumn("_n", F.row_number().over(best)).where("_n = 1").drop("_n")


def accuracy(rows: DataFrame) -> DataFrame:
    """Confusion matrix of boolean expected and fits; specificity is null without negatives."""
    e, f = F.col("expected"), F.col("fits")
    return rows.agg(
        F.count_if(e & f).alias("tp"), F.count_if(~e & ~f).alias("tn"), F.count_if(~e & f).alias("fp"), F.count_if(e & ~f).alias("fn"),
        F.round(F.count_if(e == f) / F.count(F.lit(1)), 6).alias("accuracy"),
        F.round(F.try_divide(F.count_if(~e & ~f).cast("double"), F.count_if(~e).cast("double")), 6).alias("specificity"),
    )


def status_word(status: Column) -> Column:
    return F.when(status == "violation", "fail").otherwise(status)


def key_category(key: Column, documentary: str) -> Column:
    """Documentary for keys that the pattern names, else technical."""
    return F.when(F.lower(key).rlike(documentary), "documentary").otherwise("technical")


def missing_items(wanted: Column, own: Column) -> Column:
    return F.filter(wanted, lambda x: ~F.array_contains(own, x))


def long_tokens(name: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(name), r"[^\p{L}\p{N}]+"), lambda t: F.length(t) >= 3))


def code_sets(rows: DataFrame, on: list[str]) -> DataFrame:
    """``on`` (unique) and ``codes``, the sorted distinct codes of a row's ``code`` or list of codes: rows with equal sets relate alike."""
    code = F.col("code") if isinstance(rows.schema["code"].dataType, ArrayType) else F.array("code")
    return rows.where("code is not null").select(*on, F.sort_array(F.array_distinct(code)).alias("codes"))


def set_relation(left: DataFrame, right: DataFrame) -> DataFrame:
    """l_codes, r_codes and rank of the related ``codes`` of two tables: 2 for equal positions, 1 for the same group.

    The okpd parts must be equal or one a dot-bounded ancestor of the other. Each side's codes meet the
    other's ancestors by equi-join, so no pair is formed that isn't related. Only distinct code sets take
    part, so the result grows with the classification in use and not with the rows on either side.
    """
    sets = lambda df, side: df.select(F.col("codes").alias(f"{side}_codes")).distinct().select(f"{side}_codes", F.explode(f"{side}_codes").alias(f"{side}_code"))
    left, right = sets(left, "l"), sets(right, "r")
    split = lambda df, side: df.select(f"{side}_code").distinct().withColumns(
        dict(zip((f"{side}_okpd", f"{side}_pos"), T.code_parts(F.col(f"{side}_code")), strict=True))
    )
    a, b = split(left, "l"), split(right, "r")
    up = lambda df, side: df.withColumn("at", F.explode(T.code_ancestors(F.col(f"{side}_okpd"))))
    down = a.withColumn("at", F.col("l_okpd")).join(up(b, "r"), "at")
    above = up(a, "l").where("at <> l_okpd").join(b.withColumn("at", F.col("r_okpd")), "at")
    rank = F.when(F.col("l_pos") == F.col("r_pos"), 2).otherwise(1)
    codes = down.unionByName(above).select("l_code", "r_code", rank.alias("rank"))
    return left.join(codes, "l_code").join(right, "r_code").groupBy("l_codes", "r_codes").agg(F.max("rank").alias("rank"))


def related_products(products: DataFrame, positions: DataFrame) -> DataFrame:
    """purchase_id, pos, rank, number of related products and the first of them, summed up by code set."""
    left, right = code_sets(products, ["product_id"]), code_sets(positions, ["purchase_id", "pos"])
    sizes = left.groupBy(F.col("codes").alias("l_codes")).agg(F.count(F.lit(1)).alias("n"), F.min("product_id").alias("first"))
    by_set = set_relation(left, right).join(sizes, "l_codes").groupBy(F.col("r_codes").alias("codes"), "rank").agg(F.sum("n").alias("products"), F.min("first").alias("first_product"))
    return right.join(by_set, "codes").select("purchase_id", "pos", "rank", "products", "first_product")


def _best(positions: DataFrame, relation: DataFrame, *more: str) -> DataFrame:
    """The best related position of each l_codes in a lot, the lowest on ties, and ``more`` columns of the relation that l_codes decide; placed by lot."""
    related = positions.withColumnRenamed("codes", "r_codes").join(relation, "r_codes").repartition("purchase_id")
    best = related.groupBy("purchase_id", "l_codes", *more).agg(F.max(F.struct("rank", (-F.col("pos")).alias("least"))).alias("best"))
    return best.select("purchase_id", "l_codes", (-F.col("best.least")).alias("pos"), "best.rank", *more)


def best_position(products: DataFrame, positions: DataFrame) -> DataFrame:
    """The best related position of each set of product codes (l_codes) in a lot, the lowest on ties; join :func:`code_sets` for products."""
    right = saved(code_sets(positions, ["purchase_id", "pos"]), "line_codes").hint("merge")
    return _best(right, set_relation(products, right))


def best_position_counts(products: DataFrame, positions: DataFrame) -> DataFrame:
    """purchase_id, pos, rank and how many products have their best position of the lot there; positions are read once and dealt by lot once."""
    left = code_sets(products, ["product_id"])
    sizes = left.groupBy(F.col("codes").alias("l_codes")).agg(F.count(F.lit(1)).alias("n"))
    right = saved(code_sets(positions, ["purchase_id", "pos"]), "line_codes").hint("merge")
    best = _best(right, set_relation(left, right).join(sizes, "l_codes"), "n")
    return best.groupBy("purchase_id", "pos", "rank").agg(F.sum("n").alias("products"))


def placement(best: DataFrame, totals: DataFrame) -> DataFrame:
    """``position N of M`` in lots of more than one position."""
    text = F.concat(F.lit("position "), F.col("pos"), F.lit(" of "), F.col("total"))
    return best.join(totals.where("total > 1"), "purchase_id").withColumn("placement", text).drop("pos", "rank", "total")


def _shared_tokens(wanted: DataFrame, own: DataFrame, on: list[str]) -> DataFrame:
    """``on``, tokens, product_id and overlap: shared tokens by the smaller set, of pairs that share one."""
    a = wanted.select(*on, "tokens", F.explode("tokens").alias("t"))
    b = own.select(*on, "product_id", F.size("tokens").alias("b"), F.explode("tokens").alias("t"))
    shared = a.join(b, [*on, "t"]).groupBy(*on, "tokens", "product_id", "b").agg(F.count(F.lit(1)).alias("n"))
    return shared.select(*on, "tokens", "product_id", (F.col("n").cast("double") / F.least(F.size("tokens"), "b")).alias("overlap"))


def pick_by_kind(kinds: DataFrame, left: DataFrame, products: DataFrame) -> DataFrame:
    """codes, tokens, product_id and reason: what :func:`pick_product` picks for ``kinds``, the distinct codes and tokens of positions.

    left: :func:`code_sets` of products. The kinds are read more than once, so they should be stored.
    """
    kind = ["codes", "tokens"]
    sets = set_relation(left, kinds)
    firsts = left.groupBy(F.col("codes").alias("l_codes")).agg(F.min("product_id").alias("product_id"))
    by_rank = sets.join(firsts, "l_codes").groupBy(F.col("r_codes").alias("codes"), "rank").agg(F.min("product_id").alias("product_id"))
    exact = kinds.join(by_rank.where("rank = 2").drop("rank"), "codes").withColumn("reason", F.lit("exact"))
    other = kinds.join(by_rank.where("rank = 2").select("codes"), "codes", "left_anti")
    least = F.min("product_id").alias("product_id")
    own = products.select("product_id", "tokens").join(left.withColumnRenamed("codes", "l_codes"), "product_id").groupBy("l_codes", "tokens").agg(least)
    near = own.join(sets.where("rank = 1").withColumnRenamed("r_codes", "codes"), "l_codes").join(other.select("codes").distinct(), "codes").groupBy("codes", "tokens").agg(least)
    named = _shared_tokens(other.where(F.size("tokens") > 0), near, ["codes"]).select(*kind, "product_id", (F.col("overlap") + 1).alias("worth"), F.lit("group").alias("reason"))
    group = other.join(by_rank.where("rank = 1").drop("rank"), "codes").select(*kind, "product_id", F.lit(1.0).alias("worth"), F.lit("group").alias("reason"))
    first = F.max(F.struct("overlap", (-F.col("product_id")).alias("least"))).alias("best")
    by_name = _shared_tokens(other.select("tokens").distinct(), products.groupBy("tokens").agg(least), []).groupBy("tokens").agg(first)
    name = other.join(by_name, "tokens").select(*kind, (-F.col("best.least")).alias("product_id"), F.col("best.overlap").alias("worth"), F.lit("name").alias("reason"))
    # A group product wins over a bare name of the same worth and id.
    ahead = F.struct("worth", (-F.col("product_id")).alias("least"), (F.col("reason") == "group").alias("group"))
    chosen = named.union(group).union(name).groupBy(*kind).agg(F.max(ahead).alias("best"))
    reason = F.when(F.col("best.group"), "group").otherwise("name")
    chosen = chosen.select(*kind, (-F.col("best.least")).alias("product_id"), reason.alias("reason"))
    return chosen.unionByName(exact)


def pick_product(codes: DataFrame, products: DataFrame, lines: DataFrame, wanted: DataFrame) -> DataFrame:
    """A product for each position: the first exact one, else the best of group relation plus name overlap.

    codes and lines have ``code``, products and wanted ``tokens`` of their names. Positions of equal codes and
    tokens are decided once, and of products with equal tokens that are related alike only the first takes part,
    as a later one can't win. Those with an exact product need no names; of the others' related products the
    best by overlap counts, or the first where none shares a token, against the one product of all that
    overlaps most (the first on ties).
    """
    on, kind = ["purchase_id", "pos"], ["codes", "tokens"]
    left, right = code_sets(codes, ["product_id"]), code_sets(lines, on)
    rows = wanted.select(*on, "tokens").join(right, on, "left").withColumn("codes", F.coalesce("codes", F.array().cast("array<string>")))
    rows = saved(rows, "lines").hint("merge")  # read twice, as are their kinds
    kinds = saved(rows.select(*kind).distinct(), "line_kinds").hint("merge")
    return rows.join(pick_by_kind(kinds, left, products), kind).select(*on, "product_id", "reason")


def unseen(rows: DataFrame, seen: DataFrame, key: str) -> DataFrame:
    return rows.join(seen.select(key).distinct(), key, "left_anti")


def expand_variants(products: DataFrame) -> DataFrame:
    """Products x variants as (product_id, key, value); a variant's fields override and name it ``id#a/b``."""
    rows = products.select("product_id", "fields", F.explode_outer("variants").alias("variant"))
    name = F.when(F.col("variant").isNull(), F.col("product_id")).otherwise(F.concat("product_id", F.lit("#"), F.array_join(F.map_values("variant"), "/")))
    own = F.map_filter("fields", lambda k, _: F.col("variant").isNull() | ~F.map_contains_key("variant", k))
    merged = F.when(F.col("variant").isNull(), F.col("fields")).otherwise(F.map_concat(own, F.col("variant")))
    return rows.select(name.alias("product_id"), F.explode(merged).alias("key", "value"))
