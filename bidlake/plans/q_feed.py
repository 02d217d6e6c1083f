"""Queries on listings: predicates, search, order, pages, queues and counts."""

from __future__ import annotations

from pyspark.sql import functions as F

from bidlake.functions import text as T
from bidlake.operators import search as S
from bidlake.plans import bindings as B

Q, O = {}, {}  # noqa: E741
NOW = f"TIMESTAMP '{B.NOW}'"
LIVE = f"case when end_ts <= {NOW} then 'F' else proc_stage end"
OPEN = f"(not coalesce(end_ts <= {NOW}, false) and coalesce({LIVE} <> 'F', true) and coalesce(competitive, true) and coalesce({LIVE} in ('O'), true))"
DAYS = f"((epoch_us(end_ts) - epoch_us({NOW})) / 86400000000.0)"
LEFT = f"cast(coalesce(greatest(ceil({DAYS}), 0), 0) as integer)"
AGO = f"cast(greatest(floor((epoch_us({NOW}) - epoch_us(begin_ts)) / 86400000000.0 + 0.5), 0) as integer)"
W = f"with {B.LISTINGS} "


def query(name, sql=None):
    def add(f):
        Q[name] = f
        if sql:
            O[name] = sql
        return f

    return add


def _open():
    return S.is_open(F.col("end_ts"), F.col("proc_stage"), F.col("competitive"), B.now())


@query("flt1_coarse_relevance", """with s as (select p_partkey as id, lower(p_name) as subject, p_brand as code from part),
  r as (select id, case when regexp_matches(subject, '(^|[^a-z0-9_])part 7') then 0 else (case when starts_with(code, 'Brand#1') or starts_with('Brand#1', code) then 10 else 0 end)
    + (case when regexp_matches(subject, '(^|[^a-z0-9_])part') then 1 else 0 end) + (case when regexp_matches(subject, '(^|[^a-z0-9_])1') then 1 else 0 end) end as score from s)
  select id, score from r where score >= 1""")  # fmt: skip
def _(spark, sf):
    rows = B.table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("subject"), F.col("p_brand").alias("code"))
    return S.relevance(rows, ["Brand#1"], ["part", "1", "Part"], ["part 7"]).select("id", "score")


@query("flt2_region", W + "select id, region from listings where region in ('FRANCE', 'NATION_3', 'CHINA')")
def _(spark, sf):
    return B.listings(spark, sf).where(S.in_regions(F.col("region"), ["FRANCE", "NATION_3", "CHINA"])).select("id", "region")


MINUTES = f"greatest(floor((epoch_us(end_ts + to_minutes(id % 1440)) - epoch_us({NOW})) / 60000000), 0)::bigint"


@query("sca4_remaining", W + f", m as (select id, case when end_ts is not null then {MINUTES} end as left_over from listings) select id, cast(left_over // 1440 as integer) as days, cast(left_over // 60 % 24 as integer) as hours, cast(left_over % 60 as integer) as minutes from m")
def _(spark, sf):
    end = F.col("end_ts") + F.make_dt_interval(F.lit(0), F.lit(0), (F.col("id") % 1440).cast("int"))
    return B.listings(spark, sf).select("id", S.remaining(end, B.now()).alias("left")).select("id", "left.*")


@query("flt3_deadline_window", W + f"select id, end_ts from listings where coalesce({DAYS} between 1 and 29, false)")
def _(spark, sf):
    return B.listings(spark, sf).where(S.in_window(F.col("end_ts"), B.now())).select("id", "end_ts")


@query("flt4_open_listings", W + f"select id, {LIVE} as stage from listings where {OPEN}")
def _(spark, sf):
    return B.listings(spark, sf).where(_open()).select("id", S.live_stage(F.col("proc_stage"), F.col("end_ts"), B.now()).alias("stage"))


@query("flt5_facets", W + "select id from listings where contains(lower(customer || ' ' || inn), '00001') and coalesce(delivery_days >= 5, true) and law = '44' and price between 1000 and 200000")
def _(spark, sf):
    return B.listings(spark, sf).where(S.facets(customer="00001", delivery_days=5, law="44", price_min=1000, price_max=200_000)).select("id")


ENDING = "|".join(T.LATIN.endings)
TOKENS = f"regexp_extract_all(lower(title), '[{T.LATIN.letters}0-9]+')"


def _starts(word):
    return f"len(list_filter({TOKENS}, lambda t: starts_with(t, '{word}'))) > 0"


@query("flt6_keyword_search", f"with {B.TEXTS} select id from texts where {_starts('the')} and not {_starts('idiot')} and {_starts('re')}")
def _(spark, sf):
    return B.texts(spark, sf).where(S.keyword_match(F.col("title"), "the -idiot re", T.LATIN)).select("id")


@query("flt7_loose_search", f"with {B.TEXTS} select id from texts where contains(lower(title), 'licen') or contains(lower(title), 'clo')")
def _(spark, sf):
    return B.texts(spark, sf).where(S.keyword_loose(F.col("title"), "license clown")).select("id")


BOARD = """board as (select l.*, case id % 6 when 0 then 'new' when 1 then 'review' when 2 then 'preparing' when 3 then 'submitted' when 4 then 'won' else 'lost' end as status from listings l)"""


def _board(spark, sf):
    names = ["new", "review", "preparing", "submitted", "won", "lost"]
    return B.listings(spark, sf).withColumn("status", F.element_at(F.array(*map(F.lit, names)), (F.col("id") % 6 + 1).cast("int")))


VISIBLE = f"(status not in ('new', 'review', 'preparing') or {OPEN})"


@query("flt9_board_visibility", W + f", {BOARD} select id, status from board where {VISIBLE}")
def _(spark, sf):
    return _board(spark, sf).where(S.board_visible(F.col("status"), _open())).select("id", "status")


@query("agg14_board_counts", W + f", {BOARD} select s.status, count(b.id) as n from (values ('new'), ('review'), ('preparing'), ('submitted'), ('won'), ('lost'), ('archived')) s(status) left join (select * from board where {VISIBLE}) b using (status) group by 1")
def _(spark, sf):
    return S.status_counts(_board(spark, sf), ["new", "review", "preparing", "submitted", "won", "lost", "archived"], S.board_visible(F.col("status"), _open()))


@query("flt12_recheck_candidates", W + f"select id, end_ts from listings where source = 'src1' and coalesce(competitive, true) and {DAYS} > 0 and {DAYS} <= 3 order by end_ts, id limit 300")
def _(spark, sf):
    soon = F.unix_micros(F.col("end_ts").cast("timestamp")) - F.unix_micros(B.now().cast("timestamp"))
    rows = B.listings(spark, sf).where((F.col("source") == "src1") & F.coalesce("competitive", F.lit(True)) & (soon > 0) & (soon <= 3 * 86_400_000_000))
    return S.nearest(rows, 300, S.feed_order("nearest", B.now())).select("id", "end_ts")


for mode, order in (
    ("fresh", f"{AGO}, end_ts nulls last, id"), ("deadline", f"not coalesce(end_ts > {NOW}, false), {LEFT}, end_ts nulls last, id"), ("price_asc", "price, end_ts nulls last, id"),
    ("price_desc", "price desc, end_ts nulls last, id"), ("nearest", "end_ts nulls last, id"),
):

    @query(f"srt1_feed_{mode}", W + f"select id, price, {LEFT} as days_left, {AGO} as days_ago, (select count(*) from listings where {OPEN}) as total from listings where {OPEN} order by {order} limit 50 offset 50")
    def _(spark, sf, mode=mode):
        rows = B.listings(spark, sf).where(_open())
        out = S.page(rows, S.feed_order(mode, B.now()), 2, 50)
        return out.select("id", "price", S.days_left(F.col("end_ts"), B.now()).alias("days_left"), S.published_days_ago(F.col("begin_ts"), B.now()).alias("days_ago"), "total")


@query("srt3_last_page", W + "select id, (select count(*) from listings) as total from listings order by end_ts nulls last, id offset (select (count(*) - 1) // 70 * 70 from listings)")
def _(spark, sf):
    return S.page(B.listings(spark, sf), S.feed_order("nearest", B.now()), 10**6, 70).select("id", "total")


LEADS = f"leads as (select id, cast(id * 7 % 101 as integer) as score, end_ts, begin_ts, region, id % 9 = 0 as disqualified, id % 4 = 0 as changed from listings)"


def _leads(spark, sf):
    k = F.col("id")
    return B.listings(spark, sf).select("id", (k * 7 % 101).cast("int").alias("score"), "end_ts", "begin_ts", "region", (k % 9 == 0).alias("disqualified"), (k % 4 == 0).alias("changed"))


@query("srt2_leads_page", W + f", {LEADS}, f as (select * from leads where score >= 40 and not disqualified and changed) select id, score, (select count(*) from f) as total from f order by score desc, end_ts nulls last, begin_ts desc, id limit 40 offset 40")
def _(spark, sf):
    rows = _leads(spark, sf).where("score >= 40 and not disqualified and changed")
    return S.page(rows, [F.desc("score"), F.col("end_ts").asc_nulls_last(), F.desc("begin_ts"), F.asc("id")], 2, 40).select("id", "score", "total")


@query("srt5_latest_per_user", "with r as (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as k from events) select event_id, user_id from r where k <= 3")
def _(spark, sf):
    return S.latest_per_key(B.table(spark, sf, "events"), "user_id", [F.desc("ts"), F.desc("event_id")], 3).select("event_id", "user_id")


@query("rnk9_work_queue", W + "select id, row_number() over (order by delivery_days is not null, id % 3, end_ts nulls last, id) as place from listings order by place limit 200")
def _(spark, sf):
    order = [F.col("delivery_days").isNotNull().asc(), (F.col("id") % 3).asc(), F.col("end_ts").asc_nulls_last(), F.col("id").asc()]
    return S.work_queue(B.listings(spark, sf), order, 200).select("id", F.col("place").cast("long").alias("place"))


@query("rnk11_capacity_eviction", W + "select id from listings order by end_ts nulls last, id limit (select count(*) * 3 // 4 from listings)")
def _(spark, sf):
    rows = B.listings(spark, sf)
    return S.nearest(rows, rows.count() * 3 // 4, S.feed_order("nearest", B.now())).select("id")


@query("rnk12_nearest_snapshot", W + "select id, end_ts from listings order by end_ts nulls last, id limit 500")
def _(spark, sf):
    return S.nearest(B.listings(spark, sf), 500, S.feed_order("nearest", B.now())).select("id", "end_ts")


@query("agg19_snapshot_stats", W + "select coalesce(source, 'all') as source, count(*) as listings, count(*) filter (delivery_days is not null) as with_delivery, count(*) filter (end_ts is not null) as with_end from listings group by rollup(source)")
def _(spark, sf):
    rows = B.listings(spark, sf).rollup("source").agg(F.count(F.lit(1)).alias("listings"), F.count("delivery_days").alias("with_delivery"), F.count("end_ts").alias("with_end"))
    return rows.withColumn("source", F.coalesce("source", F.lit("all")))


@query("agg20_provenance_stats", W + "select count(*) filter (proc_stage = 'O') as from_card, count(*) filter (proc_stage = 'F') as guessed, count(*) filter (proc_stage is null) as missing from listings")
def _(spark, sf):
    return B.listings(spark, sf).agg(F.count_if(F.col("proc_stage") == "O").alias("from_card"), F.count_if(F.col("proc_stage") == "F").alias("guessed"), F.count_if(F.col("proc_stage").isNull()).alias("missing"))


@query("agg22_facet_values", W + "select 'region' as facet, region as value, count(*) as n from listings group by 2 union all select 'source', source, count(*) from listings group by 2")
def _(spark, sf):
    rows = B.listings(spark, sf)
    one = lambda c: rows.groupBy(F.col(c).alias("value")).agg(F.count(F.lit(1)).alias("n")).select(F.lit(c).alias("facet"), "value", "n")
    return one("region").union(one("source")).orderBy("facet", F.expr("collate(value, 'ru')"))


@query("agg24_max_delivery", W + "select customer, max(delivery_days) as delivery_days from listings group by 1")
def _(spark, sf):
    return B.listings(spark, sf).groupBy("customer").agg(F.max("delivery_days").alias("delivery_days"))


WINDOW = f"coalesce({DAYS} between 1 and 29, false)"


@query("agg25_funnel", W + f"select case when not {WINDOW} then 'deadline' when law <> '44' then 'law' when not {OPEN} then 'closed' else 'kept' end as stage, count(*) as n from listings group by 1")
def _(spark, sf):
    return S.funnel(B.listings(spark, sf), [("deadline", S.in_window(F.col("end_ts"), B.now())), ("law", F.col("law") == "44"), ("closed", _open())])


@query("job7_feed_query", f"with {B.LISTINGS}, f as (select * from listings where {OPEN} and price >= 50000 and len(list_filter(regexp_extract_all(lower(title), '[a-zß-öø-ÿ0-9]+'), lambda t: starts_with(t, 'urg'))) > 0) select id, price, (select count(*) from f) as total from f order by price desc, end_ts nulls last, id limit 20")
def _(spark, sf):
    rows = B.listings(spark, sf).where(_open() & S.facets(price_min=50_000) & S.keyword_match(F.col("title"), "urg", T.LATIN))
    return S.page(rows, S.feed_order("price_desc", B.now()), 1, 20).select("id", "price", "total")


QUERIES, ORACLES = Q, O
