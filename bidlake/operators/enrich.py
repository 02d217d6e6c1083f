"""Attachments tried under a budget of downloads, and what is known of each listing carried over runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bidlake.functions.shared import running_sum, saved
from bidlake.sources.extract import hopeful_attachment

# Fixed values that must equal the reference's: words in a file's name that tell a specification, the most telling first.
NAME_HINTS = ("техническое задание", "тех. задание", "техзадание", "тз", "описание объекта", "объект закупки", "характеристик", "спецификац")
TRIES = 4
#: Statuses that a parsed attachment can have; the others are found here.
PARSED = ("ok", "unsupported", "empty", "error")


def name_worth(name: Column) -> Column:
    """How much a file's name promises a specification: the place of its best hint from the end, half a point more for .docx."""
    low = F.lower(F.coalesce(name, F.lit("")))
    hint = F.lit(0.0)
    for i, word in reversed(list(enumerate(NAME_HINTS))):
        hint = F.when(F.contains(low, F.lit(word)), float(len(NAME_HINTS) - i)).otherwise(hint)
    return hint + F.when(low.endswith(".docx"), 0.5).otherwise(0.0)


def ranked_attachments(documents: DataFrame, tries: int = TRIES) -> DataFrame:
    """The attachments worth a download, most promising first, ``tries`` a listing: documents with ``place`` from 1.

    documents: id, n (order on the page), name, url, ... Formats that can't be read and files without an address are
    left out; equal names keep the page's order.
    """
    best = Window.partitionBy("id").orderBy(name_worth(F.col("name")).desc(), "n")
    hopeful = documents.where(hopeful_attachment(F.coalesce("name", F.lit(""))) & (F.coalesce("url", F.lit("")) != ""))
    return hopeful.withColumn("place", F.row_number().over(best)).where(F.col("place") <= tries)


def fall_through(candidates: DataFrame) -> DataFrame:
    """id, name, status, cost and the columns of the attachment that decides: the first that worked, else the last that failed; cost is how many were tried.

    candidates: id, place, name, status, ...
    """
    fields = F.struct(*[F.col(f"`{c}`") for c in candidates.columns if c not in ("id", "place")])
    worked = F.col("status") == "ok"
    per = candidates.groupBy("id").agg(
        F.min_by(fields, F.when(worked, F.col("place"))).alias("first"), F.max_by(fields, "place").alias("last"), F.min(F.when(worked, F.col("place"))).alias("at"), F.max("place").alias("tried")
    )
    found = per.select("id", F.when(F.col("at").isNotNull(), F.col("first")).otherwise(F.col("last")).alias("found"), F.coalesce("at", "tried").alias("cost"))
    return found.select("id", "found.*", "cost")


def within_budget(decided: DataFrame, order: list[Column], budget: int) -> DataFrame:
    """``decided`` (id, cost, ...) with ``pending``: whether the downloads run out before its verdict, taken in ``order``; and how many were spent on it.

    What comes before is a running sum over ranges of the order, so no task sees the whole queue. A listing that the
    budget ends in has no verdict: not having read on is not a failure.
    """
    summed = running_sum(decided, order, F.col("cost"), "_through")
    before = F.col("_through") - F.col("cost")
    spent = F.greatest(F.lit(0), F.least(F.col("cost"), F.lit(budget) - before)).cast("int")
    return summed.withColumns({"pending": F.col("_through") > budget, "spent": spent}).drop("_through")


def enrich(listings: DataFrame, documents: DataFrame, parsed: DataFrame, cache: DataFrame, budget: int, tries: int = TRIES) -> tuple[DataFrame, DataFrame]:
    """One run of enrichment: the listings' (id, status, doc, terms, items) after it, and the cache for the next run.

    listings: id, end_ts, docs_fetched, and doc, terms and items known so far; documents: id, n, name, url;
    parsed: id, n, status (ok, unsupported, empty, error), terms, items of an attachment; cache: id, status, doc,
    terms, items. Terms and items are arrays, empty or null where nothing is known.

    A cached verdict counts as it is. Of the others those without any terms are tried first, then by deadline, until
    the budget of downloads is spent. A listing without readable attachments is unsupported for good; without any it
    is pending until its page was fetched, then no-doc. A verdict that the budget cut short is pending and isn't
    cached. What is known of one listing, what the cache says and what this run found meet in one aggregation by id:
    the newest word that says something wins field by field, so a failed refetch never takes terms away, and a
    listing with terms is ok whatever was written before. Listings of equal id are one.
    """
    some = lambda c: F.size(F.coalesce(c, F.array())) > 0
    known = some(F.col("terms"))
    fresh = listings.join(cache.select("id"), "id", "left_anti")
    ranked = ranked_attachments(documents, tries).join(fresh.select("id"), "id", "left_semi")
    candidates = ranked.join(parsed.select("id", "n", "status", "terms", "items"), ["id", "n"], "left")
    tried = candidates.select("id", "place", "name", F.coalesce("status", F.lit("error")).alias("status"), "terms", "items")
    decided = fall_through(tried).join(fresh.select("id", "end_ts", known.alias("known")), "id")
    order = [F.col("known").asc(), F.col("end_ts").asc_nulls_last(), F.col("id").asc()]
    outcome = saved(within_budget(decided, order, budget), "outcomes")
    # Listings without candidates: what their attachments alone tell.
    first = documents.groupBy("id").agg(F.min_by(F.coalesce("name", F.lit("")), "n").alias("name"))
    bare = fresh.where(~known).join(outcome.select("id"), "id", "left_anti").join(first, "id", "left")
    fetched = F.coalesce("docs_fetched", F.lit(True))
    verdict = F.when(F.col("name").isNotNull(), "unsupported").when(fetched, "no-doc").otherwise("pending")
    nothing = F.lit(None).cast(listings.schema["terms"].dataType).alias("terms"), F.lit(None).cast(listings.schema["items"].dataType).alias("items")
    # A page without attachments says nothing of the document, so its name stays.
    hopeless = bare.select("id", F.lit(2).alias("age"), verdict.alias("status"), F.col("name").alias("doc"), *nothing)
    pending = F.col("pending")
    found = outcome.select("id", F.lit(2).alias("age"), F.when(pending, "pending").otherwise(F.col("status")).alias("status"), F.when(pending, "").otherwise(F.col("name")).alias("doc"),
                           F.when(~pending, F.col("terms")).alias("terms"), F.when(~pending, F.col("items")).alias("items"))
    own = listings.select("id", F.lit(0).alias("age"), F.lit(None).cast("string").alias("status"), "doc", "terms", "items")
    hit = cache.join(listings.select("id"), "id", "left_semi").select("id", F.lit(1).alias("age"), "status", "doc", "terms", "items")
    newest = lambda c, told: F.max_by(c, F.when(told, F.col("age"))).alias(c)
    merged = own.unionAll(hit).unionAll(hopeless).unionAll(found).groupBy("id").agg(
        newest("status", F.col("status").isNotNull()), newest("doc", F.col("doc").isNotNull()), newest("terms", some(F.col("terms"))), newest("items", some(F.col("items")))
    )
    after = merged.select("id", F.when(some(F.col("terms")), "ok").otherwise(F.coalesce("status", F.lit("pending"))).alias("status"), F.coalesce("doc", F.lit("")).alias("doc"), "terms", "items")
    lasting = found.where("status <> 'pending'").unionAll(hopeless.where("status = 'unsupported'")).select("id", "status", "doc", "terms", "items")
    return after, cache.select("id", "status", "doc", "terms", "items").unionAll(lasting)
