"""Listing predicates, facets, keyword search, sorting, paging, queues and counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bidlake.functions import text as T
from bidlake.functions.shared import saved

# Stages in which an offer can still be made, and the one that ends a listing.
SUBMITTABLE, COMPLETED = ("O",), "F"
# Board statuses before the award; later ones are always shown.
PRE_AWARD = ("new", "review", "preparing")


def _days(end: Column, now: Column) -> Column:
    return (F.unix_micros(end.cast("timestamp")) - F.unix_micros(now.cast("timestamp"))) / F.lit(86_400_000_000.0)


def days_left(end: Column, now: Column) -> Column:
    """Whole days to the end, rounded up, at least 0; 0 without an end."""
    return F.coalesce(F.greatest(F.ceil(_days(end, now)), F.lit(0)), F.lit(0)).cast("int")


def published_days_ago(begin: Column, now: Column) -> Column:
    return F.greatest(T.js_round(_days(now, begin)), F.lit(0)).cast("int")


def remaining(end: Column, now: Column) -> Column:
    """Whole days, hours and minutes that are left to the end; null without one, zeros once it has passed."""
    left = F.greatest(F.floor((F.unix_micros(end.cast("timestamp")) - F.unix_micros(now.cast("timestamp"))) / 60_000_000), F.lit(0))
    part = lambda size, of: F.floor(left / size) % of if of else F.floor(left / size)
    return F.when(end.isNotNull(), F.struct(part(1440, 0).cast("int").alias("days"), part(60, 24).cast("int").alias("hours"), part(1, 60).cast("int").alias("minutes")))


def in_regions(region: Column, wanted: list[str]) -> Column:
    """Membership; an empty list passes everything."""
    return region.isin(*wanted) if wanted else F.lit(True)


def in_window(end: Column, now: Column, least: int = 1, most: int = 29) -> Column:
    """The deadline lies ``least`` to ``most`` days ahead, inclusive; no deadline fails."""
    return F.coalesce(_days(end, now).between(least, most), F.lit(False))


def live_stage(stage: Column, end: Column, now: Column) -> Column:
    """The stored stage, unless a known end has passed."""
    return F.when(end <= now, COMPLETED).otherwise(stage)


def is_open(end: Column, stage: Column, competitive: Column, now: Column) -> Column:
    """Not expired, not completed, competitive (unknown: yes) and submittable (unknown stage: yes)."""
    stage = live_stage(stage, end, now)
    return ~F.coalesce(end <= now, F.lit(False)) & F.coalesce(stage != COMPLETED, F.lit(True)) & F.coalesce(competitive, F.lit(True)) & F.coalesce(stage.isin(*SUBMITTABLE), F.lit(True))


def facets(
    customer: str | None = None, region: str | None = None, delivery_days: int | None = None, law: str | None = None, source: str | None = None, price_min: float | None = None, price_max: float | None = None
) -> Column:
    """One condition from optional facets; customer is a substring of name and tax number, unknown delivery passes."""
    out = F.lit(True)
    if customer:
        out = out & F.contains(F.lower(F.concat_ws(" ", "customer", "inn")), F.lit(customer.lower()))
    if region:
        out = out & (F.col("region") == region)
    if delivery_days is not None:
        out = out & F.coalesce(F.col("delivery_days") >= delivery_days, F.lit(True))
    if law:
        out = out & (F.col("law") == law)
    if source:
        out = out & (F.col("source") == source)
    if price_min is not None:
        out = out & (F.col("price") >= price_min)
    if price_max is not None:
        out = out & (F.col("price") <= price_max)
    return out


def keyword_match(haystack: Column, query: str, pack: T.LanguagePack) -> Column:
    """Every plus-word starts some token and no minus-word does; stems and fleeting-vowel variants count."""
    toks = T.tokens(haystack, pack)

    def hit(word: str) -> Column:
        stems = T.stem(F.lit(word.lower()), pack)
        other = T.fleeting(stems, pack)
        return F.exists(toks, lambda t: t.startswith(stems) | F.coalesce(t.startswith(other), F.lit(False)) | F.coalesce(T.fleeting(t, pack).startswith(stems), F.lit(False)))

    out = F.lit(True)
    for word in query.split():
        out = out & (~hit(word[1:]) if word.startswith("-") and len(word) > 1 else hit(word.lstrip("+")))
    return out


def keyword_loose(haystack: Column, query: str) -> Column:
    """Any word, without its last two letters, anywhere in the text."""
    out = F.lit(False)
    for word in query.lower().split():
        out = out | F.contains(F.lower(haystack), F.lit(word[:-2] if len(word) > 4 else word))
    return out


def relevance(rows: DataFrame, codes: list[str], keywords: list[str], stop: list[str], min_score: int = 1) -> DataFrame:
    """Coarse score of subject and code: 10 for a code prefix either way, 1 for each distinct keyword; 0 on a stop word."""
    text = T.plain(F.col("subject"))
    begins = lambda word: text.rlike(r"(^|[^\p{L}\p{N}_])\Q" + word + r"\E")
    words = sorted({w.strip().lower().replace("ё", "е") for w in keywords if w.strip()})
    code = F.lit(False)
    for c in codes:
        code = code | F.col("code").startswith(c) | F.lit(c).startswith(F.col("code"))
    score = F.when(F.coalesce(code, F.lit(False)), 10).otherwise(0)
    for w in words:
        score = score + F.when(begins(w), 1).otherwise(0)
    stopped = F.lit(False)
    for w in stop:
        stopped = stopped | begins(w.lower().replace("ё", "е"))
    return rows.withColumn("score", F.when(stopped, 0).otherwise(score)).where(F.col("score") >= min_score)


def funnel(rows: DataFrame, stages: list[tuple[str, Column]]) -> DataFrame:
    """How many rows each stage drops, in order; the others are ``kept``."""
    label = F.lit("kept")
    for name, keeps in reversed(stages):
        label = F.when(~F.coalesce(keeps, F.lit(False)), name).otherwise(label)
    return rows.groupBy(label.alias("stage")).agg(F.count(F.lit(1)).alias("n"))


# Sort modes of the feed; all end with deadline order and the id, so pages are stable.
def feed_order(mode: str, now: Column) -> list[Column]:
    tail = [F.col("end_ts").asc_nulls_last(), F.col("id").asc()]
    head = {
        "fresh": [published_days_ago(F.col("begin_ts"), now).asc()],
        "deadline": [(~F.coalesce(F.col("end_ts") > now, F.lit(False))).asc(), days_left(F.col("end_ts"), now).asc()],
        "price_asc": [F.col("price").asc()],
        "price_desc": [F.col("price").desc()],
        "score": [F.col("score").desc()],
        "nearest": [],
    }
    return [*head[mode], *tail]


def ranked(rows: DataFrame, order: list[Column], start: int, size: int) -> DataFrame:
    """The rows at places ``start`` to ``start + size - 1`` of a total order, sorted, at any depth.

    Rows are written in ranges of the order; the ranges' counts, one row each, tell which ranges hold the
    places, and only those are numbered, each by itself. No task sees more than a range.
    """
    ranges = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = saved(rows.repartitionByRange(ranges, *order).withColumn("_range", F.spark_partition_id()), "ranked")
    before, first = 0, {}
    for r in sorted(parts.groupBy("_range").count().collect()):
        if before < start + size and before + r["count"] > start:
            first[r["_range"]] = before
        before += r["count"]
    if not first:
        return rows.limit(0)
    offset = F.create_map(*[F.lit(x) for pair in first.items() for x in pair])[F.col("_range")]
    place = offset + F.row_number().over(Window.partitionBy("_range").orderBy(*order)) - 1
    held = parts.where(F.col("_range").isin(list(first))).withColumn("_place", place)
    return held.where(F.col("_place").between(start, start + size - 1)).drop("_range", "_place").orderBy(*order)


def page(rows: DataFrame, order: list[Column], number: int, size: int, one_task: int = 10_000) -> DataFrame:
    """A page in the given order, with the total; a number beyond the pages gives the last one.

    Pages that end within ``one_task`` rows come from a top-n, deeper ones from :func:`ranked`.
    """
    total = rows.count()
    number = min(max(1, number), max(1, -(-total // size)))
    start = (number - 1) * size
    found = ranked(rows, order, start, size) if start + size > one_task else rows.orderBy(*order).offset(start).limit(size)
    return found.withColumn("total", F.lit(total))


def nearest(rows: DataFrame, n: int, order: list[Column], one_task: int = 10_000) -> DataFrame:
    """The first ``n`` rows: a top-n up to ``one_task`` rows, by :func:`ranked` beyond."""
    return ranked(rows, order, 0, n) if n > one_task else rows.orderBy(*order).limit(n)


def latest_per_key(rows: DataFrame, key: str, order: list[Column], n: int) -> DataFrame:
    """The first ``n`` rows of each key in the given order."""
    w = Window.partitionBy(key).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")


def work_queue(rows: DataFrame, order: list[Column], budget: int) -> DataFrame:
    """The first ``budget`` rows, numbered; the limit comes before the numbering, so one task gets no more."""
    head = rows.orderBy(*order).limit(budget)
    return head.withColumn("place", F.row_number().over(Window.orderBy(*order)))


def status_counts(board: DataFrame, statuses: list[str], visible: Column) -> DataFrame:
    """Visible cards per status, zeros included."""
    dim = board.sparkSession.createDataFrame([(s,) for s in statuses], "status string")
    counts = board.where(visible).groupBy("status").agg(F.count(F.lit(1)).alias("n"))
    return dim.join(counts, "status", "left").select("status", F.coalesce("n", F.lit(0)).alias("n"))


def board_visible(status: Column, open_now: Column) -> Column:
    """Cards before the award need an open listing; later ones are always visible."""
    return F.when(status.isin(*PRE_AWARD), open_now).otherwise(True)
