"""Exact duplicates of normalised texts, DataFrame operations only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bidlake.functions.shared import saved
from bidlake.llm.rows import row_key, settle

#: Runs of ASCII white space count as one space.
SPACES = r"[\x20\x09-\x0D]+"


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def exact_dedup(docs: DataFrame, salts: int = 16, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """All rows and columns of ``docs`` plus keep_id, group_size, kept and text_sha256.

    Texts are equal when their white-space normalised forms are identical; the smallest doc_id of a
    group stays. The map side first merges equal texts within each task, the shuffle merges the rows
    of a (digest, text, salt) group, and what is left of each salt meets by digest. The text itself is
    a grouping key at all three stages, so a shared digest never merges different texts. Decisions go
    back to the rows by (digest, salt), so a group with a third of all rows is dealt over ``salts``
    tasks there too; only if two different texts do share a digest does the text join as well.

    Null text counts as empty. Null doc_ids lose to any other; a group of null ids alone keeps them.
    Rows that repeat a doc_id and its text share one decision. An empty table gives an empty result.
    Input columns named like a result column are replaced.
    """
    own = ["keep_id", "group_size", "kept", "text_sha256"]
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in own])
    norm = F.regexp_replace(F.coalesce(F.col("text"), F.lit("")), SPACES, " ")
    rows = docs.select(row.alias("row"), F.col("doc_id").alias("id"), norm.alias("norm")).select(
        "*", sha256(F.col("norm")).alias("sha"), digest(F.col("norm")).alias("key"), F.pmod(F.xxhash64("id"), F.lit(salts)).cast("int").alias("salt")
    )
    by_salt = rows.groupBy("key", "norm", "salt").agg(F.min("id").alias("keep"), F.count(F.lit(1)).alias("n"))
    by_text = (
        by_salt.repartition("key")
        .groupBy("key", "norm")
        .agg(F.min("keep").alias("keep"), F.sum("n").alias("n"), F.collect_list("salt").alias("salts"))
    )
    # One row per digest: its only text, or a mark that it has several.
    by_key = by_text.groupBy("key").agg(
        F.count(F.lit(1)).alias("texts"), F.min("keep").alias("keep"), F.sum("n").alias("n"), F.flatten(F.collect_list("salts")).alias("salts")
    )
    groups = saved(by_key.where("n > 1"), "exact_groups")
    on = ["key", "salt"]
    if groups.where("texts > 1").limit(1).count():
        on, groups = ["key", "norm", "salt"], by_text.where("n > 1")
    groups = groups.select(*on[:-1], "keep", "n", F.explode("salts").alias("salt"))
    found = rows.join(groups, on, "left")
    keep = F.when(F.col("n").isNull(), F.col("id")).otherwise(F.col("keep"))
    return found.select(
        "row.*",
        keep.alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        F.col("id").eqNullSafe(keep).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )


def without_copies(docs: DataFrame, **options) -> DataFrame:
    """Rows of ``docs``, all columns, with one row of each group of equal texts: the smallest doc_id, once if its row repeats.

    Only decisions on groups of several rows go back to the rows.
    """
    found = exact_dedup(docs.select("doc_id", "text", row_key().alias("key")), **options)
    return settle(docs, saved(found.where("group_size > 1").select("key", "kept"), "exact_decided"), native=True)
