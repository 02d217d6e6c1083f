"""Queries on attachments, download budgets and enrichment over runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from bidlake.functions.shared import new_path
from bidlake.operators import enrich as N
from bidlake.operators import terms as M
from bidlake.operators.build import build_snapshot, read_published
from bidlake.plans import bindings as B
from bidlake.plans.q_sources import ANCHORS, attachments
from bidlake.plans.q_terms import SPLIT, P

Q, O = {}, {}  # noqa: E741
BUDGET = 40


def query(name, sql=None):
    def add(f):
        Q[name] = f
        if sql:
            O[name] = sql
        return f

    return add


def _documents(spark, sf):
    """id, n, name, url of the files linked on a page; every ninth page has none, and another ninth only ones that can't be read."""
    uid, id, n = F.col("uid"), F.col("page_id"), F.col("n")
    kind = F.length(uid) % 5
    name = (
        F.when((kind == 2) | (id % 9 == 7), F.concat(uid, F.lit(".pdf"))).when(kind == 0, F.concat(F.lit("Техническое задание "), uid, F.lit(".docx")))
        .when(kind == 1, F.concat(F.lit("Описание объекта закупки "), uid)).when(kind == 3, F.concat(uid, F.lit(".DOCX"))).otherwise(F.concat(uid, F.lit(" ТЗ")))
    )
    return attachments(spark, sf).where(id % 9 != 8).select(id.alias("id"), n.cast("long").alias("n"), name.alias("name"), F.when(n % 6 == 0, "").otherwise(uid).alias("url"))


def _parsed(spark, sf):
    """What a file holds: the text of the document numbered after page and place, none where there is no such one."""
    texts = B.texts(spark, sf).select("id", F.when(F.col("id") % 3 > 0, F.col("text")).otherwise("").alias("text"))
    best = M.split_budget_terms(M.term_counts(texts, "text", P), P.measured, 20)
    terms = best.groupBy("id").agg(F.sort_array(F.collect_list(F.struct((~F.col("measured")).alias("m"), "n", "term"))).alias("found"))
    files = texts.join(terms, "id", "left").select((F.col("id") % 4 + 1).alias("n"), F.floor(F.col("id") / 4).alias("page"), F.transform("found", lambda x: x["term"]).alias("terms"))
    status = F.when((F.col("page") + F.col("n")) % 5 == 0, "unsupported").when(F.size(F.coalesce("terms", F.array())) > 0, "ok").otherwise("empty")
    items = F.when((status == "ok") & (F.col("page") % 2 == 0), F.array(F.concat(F.lit("i"), "page"))).otherwise(F.array().cast("array<string>"))
    return files.select(F.col("page").alias("id"), "n", status.alias("status"), F.when(status == "ok", F.col("terms")).alias("terms"), items.alias("items"))


def _listings(spark, sf):
    id = F.col("page_id")
    days = F.make_dt_interval((id * 37 % 100).cast("int"))
    return B.table(spark, sf, "pages").select(
        id.alias("id"), F.when(id % 11 > 0, B.now() + days).alias("end_ts"), (id % 6 != 0).alias("docs_fetched"), F.when(id % 5 == 0, "old.docx").alias("doc"),
        F.when(id % 5 == 0, F.array(F.lit("old"))).alias("terms"), F.lit(None).cast("array<string>").alias("items"),
    )


def _cache(spark, sf):
    id = F.col("page_id")
    ok = id % 10 == 3
    rows = B.table(spark, sf, "pages").where(ok | (id % 10 == 7) | (id % 20 == 5))
    return rows.select(id.alias("id"), F.when(ok, "ok").otherwise("unsupported").alias("status"), F.when(ok, "c").otherwise("u").alias("doc"), F.when(ok, F.array(F.lit("cached"))).alias("terms"), F.lit(None).cast("array<string>").alias("items"))


HINTS = " ".join(f"when contains(lower(name), '{h}') then {len(N.NAME_HINTS) - i}" for i, h in enumerate(N.NAME_HINTS))
FILES = f"""{ANCHORS}, files as (select page_id as id, n, case when length(uid) % 5 = 2 or page_id % 9 = 7 then uid || '.pdf' when length(uid) % 5 = 0 then 'Техническое задание ' || uid || '.docx'
    when length(uid) % 5 = 1 then 'Описание объекта закупки ' || uid when length(uid) % 5 = 3 then uid || '.DOCX' else uid || ' ТЗ' end as name, case when n % 6 = 0 then '' else uid end as url from docs where n <= 20 and page_id % 9 <> 8),
worth as (select *, case {HINTS} else 0 end + case when lower(name) like '%.docx' then 0.5 else 0 end as w from files where url <> '' and (lower(name) like '%.docx' or not regexp_matches(name, '[.][A-Za-z0-9]{{2,4}}$'))),
placed as (select *, row_number() over (partition by id order by w desc, n) as place from worth)"""


@query("rnk10_ranked_files", f"with {FILES} select id, n, place from placed where place <= 4")
def _(spark, sf):
    return N.ranked_attachments(_documents(spark, sf)).select("id", "n", F.col("place").cast("long").alias("place"))


RUN = f"""{SPLIT}, {FILES},
best as (select id, list(term order by measured desc, n) as terms from split where id % 3 > 0 group by 1),
parsed as (select t.id // 4 as id, t.id % 4 + 1 as n, case when (t.id // 4 + t.id % 4 + 1) % 5 = 0 then 'unsupported' when terms is not null then 'ok' else 'empty' end as status, terms from texts t left join best using (id)),
cached as (select page_id as id, case when page_id % 10 = 3 then 'ok' else 'unsupported' end as status, case when page_id % 10 = 3 then 'c' else 'u' end as doc, case when page_id % 10 = 3 then ['cached'] end as terms
  from pages where page_id % 10 in (3, 7) or page_id % 20 = 5),
listed as (select page_id as id, case when page_id % 11 > 0 then TIMESTAMP '{B.NOW}' + to_days(cast(page_id * 37 % 100 as integer)) end as end_ts, page_id % 6 <> 0 as fetched, page_id % 5 = 0 as known from pages),
tried as (select p.id, p.place, p.name, coalesce(s.status, 'error') as status, s.terms from placed p left join parsed s on s.id = p.id and s.n = p.n where place <= 4 and p.id not in (select id from cached)),
decided as (select id, coalesce(min(place) filter (status = 'ok'), max(place)) as cost from tried group by 1),
queue as (select d.*, sum(cost) over (order by known, end_ts nulls last, d.id) as through from decided d join listed using (id)),
spent as (select q.id, through > {BUDGET} as pending, greatest(0, least(cost, {BUDGET} - (through - cost)))::integer as spent, t.name, t.status, t.terms from queue q join tried t on t.id = q.id and t.place = q.cost)"""


@query("rnk10_budget", f"with {RUN} select id, case when pending then 'pending' else status end as status, case when pending then '' else name end as name, spent from spent")
def _(spark, sf):
    cached = _cache(spark, sf).select("id")
    ranked = N.ranked_attachments(_documents(spark, sf)).join(cached, "id", "left_anti")
    tried = ranked.join(_parsed(spark, sf).select("id", "n", "status"), ["id", "n"], "left").select("id", "place", "name", F.coalesce("status", F.lit("error")).alias("status"))
    queue = N.fall_through(tried).join(_listings(spark, sf).select("id", "end_ts", F.col("terms").isNotNull().alias("known")), "id")
    out = N.within_budget(queue, [F.col("known").asc(), F.col("end_ts").asc_nulls_last(), F.col("id").asc()], BUDGET)
    pending = F.col("pending")
    return out.select("id", F.when(pending, "pending").otherwise(F.col("status")).alias("status"), F.when(pending, "").otherwise(F.col("name")).alias("name"), "spent")


@query("job2_enrichment", f"""with {RUN}, counted as (select id, arg_min(name, n) as name from files group by 1),
  merged as (select l.id, case when c.id is not null then c.status when s.id is not null then case when pending then 'pending' else s.status end when known then null when f.name is not null then 'unsupported' when fetched then 'no-doc' else 'pending' end as status,
    case when c.id is not null then c.doc when s.id is not null then case when pending then '' else s.name end when known then 'old.docx' when f.name is not null then f.name else '' end as doc,
    coalesce(c.terms, case when not pending then s.terms end, case when known then ['old'] end) as terms, case when c.id is null and s.id is not null and not pending and s.status = 'ok' and l.id % 2 = 0 then 1 else 0 end as items
    from listed l left join cached c using (id) left join spent s using (id) left join counted f using (id))
  select id, case when terms is not null then 'ok' else status end as status, doc, array_to_string(coalesce(terms, []), '|') as terms, items from merged""")  # fmt: skip
def _(spark, sf):
    after, _ = N.enrich(_listings(spark, sf), _documents(spark, sf), _parsed(spark, sf), _cache(spark, sf), BUDGET)
    return after.select("id", "status", "doc", F.array_join(F.coalesce("terms", F.array().cast("array<string>")), "|").alias("terms"), F.size(F.coalesce("items", F.array().cast("array<string>"))).alias("items"))


# -- a snapshot over two runs: each shows part of the listings, and says less or more of a region ----------


LATER = "1998-06-01 00:00:00"
RUNS = f"""{B.LISTINGS}, one as (select id, title, case when id % 7 = 0 then '' else region end as region, price, end_ts, id % 4 = 0 as fetched from listings where id % 2 = 0),
two as (select id, title, case when id % 5 = 0 then '' else source end as region, price + 1 as price, end_ts, id % 9 = 0 as fetched from listings where id % 3 = 0),
store as (select coalesce(t.id, o.id) as id, coalesce(t.title, o.title) as title, coalesce(nullif(t.region, ''), nullif(o.region, '')) as region, coalesce(t.price, o.price) as price, coalesce(t.end_ts, o.end_ts) as end_ts,
    coalesce(t.fetched, false) or coalesce(o.fetched, false) as fetched, t.id is not null as seen_now from one o full join two t on t.id = o.id),
live as (select * from store where not coalesce(end_ts <= TIMESTAMP '{LATER}', false) and (end_ts is not null or seen_now))"""


@query("job1_snapshot_build", f"""with {RUNS}, files as (select id, case when id % 10 = 0 then case when id % 20 = 0 then 'ok' else 'error' end end as outcome from live)
  select id, region, price, case when outcome is not null then outcome when fetched then 'no-doc' else 'pending' end as status, case when outcome = 'ok' then 't' || id else '' end as terms, 2 as version
  from (select * from live join files using (id) order by end_ts nulls last, id limit 5000)""")  # fmt: skip
def _(spark, sf):
    path, id = new_path(spark, "build"), F.col("id")
    rows = B.listings(spark, sf)
    one = rows.where("id % 2 = 0").withColumns({"region": F.when(id % 7 == 0, "").otherwise(F.col("region")), "docs_fetched": id % 4 == 0})
    two = rows.where("id % 3 = 0").withColumns({"region": F.when(id % 5 == 0, "").otherwise(F.col("source")), "price": F.col("price") + 1, "docs_fetched": id % 9 == 0})
    documents = rows.where("id % 10 = 0").select("id", F.lit(0).alias("n"), F.lit("ТЗ.docx").alias("name"), F.lit("u").alias("url"))
    texts = "array<string>"
    parsed = rows.where("id % 20 = 0").select("id", F.lit(0).alias("n"), F.lit("ok").alias("status"), F.array(F.concat(F.lit("t"), id)).alias("terms"), F.lit(None).cast(texts).alias("items"))
    at = lambda t: F.lit(t).cast("timestamp_ntz")
    build_snapshot([one.where("id % 4 = 0"), one], documents, parsed, path, at("1998-04-01"), 10**9, 5000)
    build_snapshot([two], documents, parsed, path, at(LATER), 10**9, 5000)
    return read_published(spark, path).select("id", "region", "price", "status", F.array_join(F.coalesce("terms", F.array().cast(texts)), "|").alias("terms"), "version")


QUERIES, ORACLES = Q, O
