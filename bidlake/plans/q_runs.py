"""Queries on runs, versions, events, ledgers, snapshots and accounts."""

from __future__ import annotations

from pyspark.sql import functions as F

from bidlake.plans import bindings as B
from bidlake.sources import snapshots as N
from bidlake.streaming import twins as W

Q, O = {}, {}  # noqa: E741
NOW = f"TIMESTAMP '{B.NOW}'"


def query(name, sql=None):
    def add(f):
        Q[name] = f
        if sql:
            O[name] = sql
        return f

    return add


def _events(spark, sf):
    return B.table(spark, sf, "events")


HALVES = """old as (select id, customer, case when id % 7 = 0 then '' else region end as region, price, end_ts, TIMESTAMP '1998-04-01' as seen_at from listings where id % 3 <> 0),
fresh as (select id, customer, case when id % 5 = 0 then '' else source end as region, price + 1 as price, end_ts from listings where id % 2 = 0 or id % 3 = 0)"""
STORE = f"""{B.LISTINGS}, {HALVES}, store as (select coalesce(f.id, o.id) as id, coalesce(f.customer, o.customer) as customer,
  case when f.id is not null and coalesce(f.region, '') <> '' then f.region else o.region end as region, case when f.id is not null then f.price else o.price end as price,
  case when f.id is not null then f.end_ts else o.end_ts end as end_ts, case when f.id is not null then {NOW} else o.seen_at end as seen_at, f.id is not null and o.id is null as is_new from old o full join fresh f on o.id = f.id)"""


def _store(spark, sf):
    rows = B.listings(spark, sf)
    old = rows.where("id % 3 <> 0").select("id", "customer", F.when(F.col("id") % 7 == 0, "").otherwise(F.col("region")).alias("region"), "price", "end_ts", F.lit("1998-04-01").cast("timestamp_ntz").alias("seen_at"))
    fresh = rows.where("id % 2 = 0 or id % 3 = 0").select("id", "customer", F.when(F.col("id") % 5 == 0, "").otherwise(F.col("source")).alias("region"), (F.col("price") + 1).alias("price"), "end_ts")
    return W.accumulate(old, fresh, B.now(), ["region"])


@query("str1_accumulator", f"with {STORE} select id, region, price, seen_at, is_new from store")
def _(spark, sf):
    return _store(spark, sf).select("id", "region", "price", "seen_at", "is_new")


@query("str2_eviction", f"with {STORE} select case when end_ts <= {NOW} then 'expired' when end_ts is null and seen_at < {NOW} - interval 30 day then 'stale' else 'live' end as state, count(*) as n from store group by 1")
def _(spark, sf):
    state = F.coalesce(W.eviction(F.col("end_ts"), F.col("seen_at"), B.now()), F.lit("live"))
    return _store(spark, sf).groupBy(state.alias("state")).agg(F.count(F.lit(1)).alias("n"))


RUNS = """runs as (select user_id as lead, event_id as run, cast(floor(value) as bigint) // 60 as content_hash, event_type as updated_at from events),
levels as (select *, case when row_number() over w = 1 then 0 when content_hash is distinct from lag(content_hash) over w then 2 when updated_at is distinct from lag(updated_at) over w then 1 else 0 end as level from runs window w as (partition by lead order by run)),
tops as (select *, max(level) over (partition by lead order by run rows unbounded preceding) as top from levels)"""


def _runs(spark, sf):
    return _events(spark, sf).select(F.col("user_id").alias("lead"), F.col("event_id").alias("run"), F.expr("cast(floor(value) as bigint) div 60").alias("content_hash"), F.col("event_type").alias("updated_at"))


NAMES = "case {} when 2 then 'material' when 1 then 'formal' else 'unchanged' end"


@query("rnk15_version_classes", f"with {RUNS} select lead, run, {NAMES.format('level')} as change from tops")
def _(spark, sf):
    return W.classify_versions(_runs(spark, sf), ["lead"], "run").select("lead", "run", "change")


@query("rnk14_sticky_status", f"with {RUNS} select lead, run, {NAMES.format('top')} as sticky from tops")
def _(spark, sf):
    return W.classify_versions(_runs(spark, sf), ["lead"], "run").select("lead", "run", "sticky")


@query("str4_lead_upsert", f"with {RUNS} select lead, arg_max(run, run) as run, arg_max(content_hash, run) as content_hash, {NAMES.format('max(level)')} as sticky, count(*) filter (level > 0) as messages from tops group by lead")
def _(spark, sf):
    rows = W.classify_versions(_runs(spark, sf), ["lead"], "run")
    return rows.groupBy("lead").agg(F.max("run").alias("run"), F.max_by("content_hash", "run").alias("content_hash"), F.max_by("sticky", "run").alias("sticky"), F.count_if(F.col("change") != "unchanged").alias("messages"))


@query("str5_window_alerts", """with r as (select event_id, user_id, epoch_us(ts) as t, count(*) over w as recent, min(epoch_us(ts)) over w as first from events window w as (partition by user_id order by epoch_us(ts) range between 86400000000 preceding and current row))
  select event_id, user_id, recent, cast(ceil((first + 86400000000 - t) / 1000000.0) as bigint) as retry_after from r where recent >= 4""")  # fmt: skip
def _(spark, sf):
    return W.window_alerts(_events(spark, sf).select("event_id", "user_id", "ts"), "user_id", 86_400, 4).drop("ts")


@query("str6_lockouts")
def _(spark, sf):
    rows = _events(spark, sf).select(F.col("user_id").alias("key"), F.col("ts").cast("timestamp_ntz").alias("ts"), (F.col("value") > 60).alias("ok"))
    return W.lockouts(rows, 3, 86_400)


ACCOUNTS = f"""accounts as (select c_custkey as account, case when c_custkey % 4 = 0 then 'demo' else 'paid' end as plan, {NOW} + to_hours(cast(c_custkey * 7 % 400 - 50 as integer)) as expires, c_custkey % 5 = 0 as auto_renew, case when c_custkey % 6 > 0 then c_name end as contact from customer),
sent as (select account, expires from accounts where account % 10 = 3)"""


def _accounts(spark, sf):
    k = F.col("c_custkey")
    return B.table(spark, sf, "customer").select(k.alias("account"), F.when(k % 4 == 0, "demo").otherwise("paid").alias("plan"), (B.now() + F.make_dt_interval(F.lit(0), (k * 7 % 400 - 50).cast("int"))).alias("expires"), (k % 5 == 0).alias("auto_renew"), F.when(k % 6 > 0, F.col("c_name")).alias("contact"))


@query("str7_expiry_notices", f"with {ACCOUNTS} select account, plan, expires from accounts where expires >= {NOW} and expires <= {NOW} + case plan when 'demo' then interval 1 day else interval 7 day end and not auto_renew and contact is not null and account % 10 <> 3")
def _(spark, sf):
    rows = _accounts(spark, sf)
    return W.expiry_notices(rows, rows.where("account % 10 = 3").select("account", "expires"), B.now()).select("account", "plan", "expires")


LEDGER = "ledger as (select law, cast(begin_ts as date) as day, max(id) as swept_at, count(*) as got, cast(1 + count(*) % 5 as integer) as page, max(id) % 3 = 0 as done from listings group by all)"


def _ledger(spark, sf):
    return B.listings(spark, sf).groupBy("law", F.to_date("begin_ts").alias("day")).agg(F.max("id").alias("swept_at"), F.count(F.lit(1)).alias("got")).select("law", "day", "swept_at", "got", (1 + F.col("got") % 5).cast("int").alias("page"), (F.col("swept_at") % 3 == 0).alias("done"))


@query("str9_backfill_slices", f"with {B.LISTINGS}, {LEDGER}, live as (select law, back, cast(DATE '1998-06-01' - back as date) as day from (values ('44'), ('223')) l(law), (select cast(unnest(range(1, 22)) as integer) as back)) select law, day::varchar as day, coalesce(page, 1) as page from live left join ledger using (law, day) where not coalesce(done, false) order by coalesce(swept_at, -1), back, law limit 15")
def _(spark, sf):
    return W.backfill_slices(_ledger(spark, sf), 21, 15, F.lit("1998-06-01").cast("date"), ["44", "223"]).withColumn("day", F.col("day").cast("string"))


@query("rnk17_least_recent_slices", f"with {B.LISTINGS}, {LEDGER} select law, day::varchar as day, got from ledger where not done order by swept_at, day desc limit 9")
def _(spark, sf):
    return _ledger(spark, sf).where("not done").orderBy("swept_at", F.desc("day")).limit(9).select("law", F.col("day").cast("string").alias("day"), "got")


@query("agg21_ledger_stats", f"with {B.LISTINGS}, {LEDGER} select count(*) as total, count(swept_at) as touched, count(*) filter (done) as done, sum(got)::bigint as got from ledger")
def _(spark, sf):
    return W.ledger_stats(_ledger(spark, sf))


POOLS = "pools as (select id, 0 as pool, price from listings where id % 4 = 0 union all select id, 1, price + 1 from listings where id % 6 = 0 union all select id, 2, price + 2 from listings where id % 4 > 0)"


@query("rnk18_first_seen", f"with {B.LISTINGS}, {POOLS} select id, pool, price from (select *, row_number() over (partition by id order by pool) as n from pools) where n = 1")
def _(spark, sf):
    rows = B.listings(spark, sf).select("id", "price")
    return W.first_seen([rows.where("id % 4 = 0"), rows.where("id % 6 = 0").withColumn("price", F.col("price") + 1), rows.where("id % 4 > 0").withColumn("price", F.col("price") + 2)], "id", ["id"])


@query("str8_discovery", f"with {B.LISTINGS}, {POOLS} select distinct id from pools where id % 7 <> 0")
def _(spark, sf):
    rows = B.listings(spark, sf).select("id", "price")
    found = W.first_seen([rows.where("id % 4 = 0"), rows.where("id % 6 = 0"), rows.where("id % 4 > 0")], "id", ["id"])
    return found.join(rows.where("id % 7 = 0"), "id", "left_anti").select("id")


@query("set1_union_sources", f"with {B.LISTINGS}, {POOLS} select pool, count(*) as n from pools group by 1")
def _(spark, sf):
    rows = B.listings(spark, sf).select("id", "price")
    parts = [rows.where("id % 4 = 0").withColumn("pool", F.lit(0)), rows.where("id % 6 = 0").drop("price").withColumn("pool", F.lit(1)), rows.where("id % 4 > 0").withColumn("pool", F.lit(2))]
    return parts[0].unionByName(parts[1], allowMissingColumns=True).unionByName(parts[2]).groupBy("pool").agg(F.count(F.lit(1)).alias("n"))


BOARD = "log as (select user_id as company, event_id % 40 as purchase, event_id, event_type as status, event_id % 11 = 0 as deleted from events)"


def _log(spark, sf):
    return _events(spark, sf).select(F.col("user_id").alias("company"), (F.col("event_id") % 40).alias("purchase"), "event_id", F.col("event_type").alias("status"), (F.col("event_id") % 11 == 0).alias("deleted"))


LAST = f"{BOARD}, last as (select * from (select *, row_number() over (partition by company, purchase order by event_id desc) as n from log) where n = 1)"


@query("str14_board_state", f"with {LAST} select company, purchase, event_id, status from last where not deleted")
def _(spark, sf):
    return W.latest_state(_log(spark, sf), ["company", "purchase"], F.col("event_id"))


@query("rnk8_latest_per_pair", f"with {LAST} select company, purchase, event_id from last")
def _(spark, sf):
    return _log(spark, sf).groupBy("company", "purchase").agg(F.max("event_id").alias("event_id"))


@query("joi15_board_assignee", f"with {LAST} select company, purchase, c_name as assignee from last left join customer on c_custkey = company * 3 where not deleted order by event_id desc")
def _(spark, sf):
    state = W.latest_state(_log(spark, sf), ["company", "purchase"], F.col("event_id"))
    people = B.table(spark, sf, "customer")
    return state.join(people, people["c_custkey"] == state["company"] * 3, "left").orderBy(F.desc("event_id")).select("company", "purchase", F.col("c_name").alias("assignee"))


@query("joi16_invoices", """select o_orderkey as id, c_name as company, cast(round_even(o_totalprice * 0.05 / 1.05, 0) as bigint) as vat, 'IN-' || strftime(o_orderdate, '%Y%m') || '-' || o_orderkey as number, o_orderstatus = 'F' as paid
  from orders join customer on o_custkey = c_custkey""")  # fmt: skip
def _(spark, sf):
    return N.invoices(B.table(spark, sf, "orders"), B.table(spark, sf, "customer"))


CACHE = f"cache as (select id, {NOW} - to_days(cast(id % 9 as integer)) as cached_at from listings where id % 4 > 0)"


@query("joi18_cache_ttl", f"with {B.LISTINGS}, {CACHE} select id, case when cached_at is null then 'queue' when cached_at >= {NOW} - interval 5 day then 'reuse' else 'requeue' end as state from listings left join cache using (id)")
def _(spark, sf):
    rows = B.listings(spark, sf).select("id")
    cache = rows.where("id % 4 > 0").withColumn("cached_at", B.now() - F.make_dt_interval((F.col("id") % 9).cast("int")))
    return W.cache_join(rows, cache, "id", B.now(), 5).select("id", "state")


@query("set5_prune_cache", f"with {B.LISTINGS}, {CACHE} select id from cache where id in (select id from listings where end_ts > {NOW})")
def _(spark, sf):
    rows = B.listings(spark, sf)
    return rows.where("id % 4 > 0").select("id").join(rows.where(F.col("end_ts") > B.now()).select("id"), "id", "left_semi")


@query("src16_stale_entries", f"with {B.LISTINGS} select id from listings where id % 10 = 0 or (id % 4 = 0 and id % 3 > 0) or (id % 7 = 0 and id % 3 = 0 and id % 2 = 0)")
def _(spark, sf):
    k = F.col("id")
    pick = lambda c: F.when(c, 1).otherwise(2)
    rows = B.listings(spark, sf).select("id", pick(k % 10 == 0).alias("algo"), pick(k % 4 == 0).alias("pick"), F.when(k % 3 > 0, "error").otherwise("ok").alias("status"), pick(k % 7 == 0).alias("items_version"), (k % 2).alias("items"))
    return rows.where(W.stale_entries(rows, 2, 2, 2)).select("id")


@query("set4_snapshot_diff", f"with {B.LISTINGS} select id, case when id % 5 = 0 then 'gone' else 'new' end as side from listings where id % 5 in (0, 1)")
def _(spark, sf):
    rows = B.listings(spark, sf).select("id")
    return W.differences(rows.where("id % 5 <> 1"), rows.where("id % 5 <> 0"))


@query("str11_publish_if_changed", f"with {B.LISTINGS}, v as (select 1 as version, count(*) as listings from listings where id % 2 = 0 union all select 3, count(*) from listings) select * from v")
def _(spark, sf):
    rows = B.listings(spark, sf).select("id", "price")
    return N.published_versions([rows.where("id % 2 = 0"), rows.where("id % 2 = 0"), rows])


@query("src11_snapshot_round_trip", f"with {B.LISTINGS} select id, title, case when id % 3 > 0 then id % 4 else 0 end as docs, case when id % 3 > 0 then region end as term from listings")
def _(spark, sf):
    k = F.col("id")
    rows = B.listings(spark, sf).select(
        "id", "title", "price", F.when(k % 3 > 0, F.slice(F.array(*map(F.lit, "abc")), F.lit(1), (k % 4).cast("int"))).alias("documents"), F.when(k % 3 > 0, F.array("region")).alias("terms"), F.lit(None).cast("array<string>").alias("spec")
    )
    back = N.round_trip(rows)
    return back.select("id", "title", F.size("documents").cast("long").alias("docs"), F.get("terms", F.lit(0)).alias("term"))


@query("src12_lots", f"with {B.LISTINGS}, n as (select id, unnest(case when id % 3 = 0 then [0] when id % 3 = 1 then [1] else [1, 2] end) as i from listings) select id, i, case when i = 0 then title else region || i end as name, case when i > 0 then id % 9 * 1.0::double end as qty, case when i = 0 then price else price / i end as price from listings join n using (id)")
def _(spark, sf):
    k = F.col("id")
    lot = lambda i: F.struct(F.concat("region", F.lit(str(i))).alias("name"), (k % 9).cast("double").alias("qty"), F.lit("шт").alias("unit"), (F.col("price") / i).alias("price"))
    lots = F.when(k % 6 == 0, F.array().cast("array<struct<name:string,qty:double,unit:string,price:double>>")).when(k % 3 == 1, F.array(lot(1))).when(k % 3 == 2, F.array(lot(1), lot(2)))
    rows = N.with_lots(B.listings(spark, sf).withColumn("lots", lots)).select("id", F.posexplode("lots").alias("i", "lot"))
    return rows.select("id", F.when(k % 3 > 0, F.col("i") + 1).otherwise(0).alias("i"), "lot.name", "lot.qty", "lot.price")


@query("joi11_sidecars", f"with {B.LISTINGS}, s as (select id, count(*) as n from listings where id % 3 > 0 group by 1) select l.id, coalesce(s.n, 0) as n from listings l left join s using (id)")
def _(spark, sf):
    rows = B.listings(spark, sf).select("id")
    side = rows.where("id % 3 > 0").groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    return rows.join(side, "id", "left").select("id", F.coalesce("n", F.lit(0)).alias("n"))


@query("str10_saved_search_counts", f"with {STORE}, s as (select * from (values (1, 'NATION_1', 0), (2, '', 100000), (3, 'src0', 50000)) t(search, region, price_min)) select search, count(st.id) as new_count from s left join store st on st.is_new and contains(coalesce(st.region, ''), s.region) and st.price >= s.price_min group by 1")
def _(spark, sf):
    searches = spark.createDataFrame([(1, "NATION_1", 0), (2, "", 100_000), (3, "src0", 50_000)], "search int, s_region string, price_min int")
    hits = _store(spark, sf).where("is_new").crossJoin(F.broadcast(searches)).where(F.contains(F.coalesce("region", F.lit("")), F.col("s_region")) & (F.col("price") >= F.col("price_min")))
    return searches.join(hits.groupBy("search").agg(F.count(F.lit(1)).alias("n")), "search", "left").select("search", F.coalesce("n", F.lit(0)).alias("new_count"))


QUERIES, ORACLES = Q, O
