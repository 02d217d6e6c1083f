"""Queries on texts for readers and vectors: regions, units, requirements, prices, table rows; market figures joined to listings."""

from __future__ import annotations

from pyspark.sql import functions as F

from bidlake.functions import text as T
from bidlake.operators import characteristics as C
from bidlake.operators import evaluate as E
from bidlake.operators import terms as M
from bidlake.plans import bindings as B
from bidlake.plans.q_lots import ASKED, WANTED, asked_lines
from bidlake.plans.q_terms import BENCH, BUYERS
from bidlake.sources.snapshots import renewed

Q, O = {}, {}  # noqa: E741


def query(name, sql=None):
    def add(f):
        Q[name] = f
        if sql:
            O[name] = sql
        return f

    return add


def _customers(spark, sf):
    """Customers with ``l``, letters that stand for their nation and number."""
    digits = F.concat(F.col("c_nationkey"), F.lit("0"), F.col("c_custkey") % 100)
    return B.table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.translate(digits, "0123456789", "абвгдежзик").alias("l"))


LETTERS = "c as (select c_custkey as id, translate(c_nationkey || '0' || (c_custkey % 100), '0123456789', 'абвгдежзик') as l from customer), i as (select *, upper(substr(l, 1, 1)) || substr(l, 2) as n from c)"


@query("sca5_tidy_region", f"with {LETTERS} select id, case id % 4 when 0 then n || '-' || n || ' автономный округ' when 1 then 'РеспУблика ' || n when 2 then 'край ' || n else '' end as region from i")
def _(spark, sf):
    id, l = F.col("id"), F.col("l")  # noqa: E741
    raw = F.when(id % 4 == 0, F.upper(F.concat(l, F.lit("-"), l, F.lit(" автономный  округ ")))).when(id % 4 == 1, F.concat(F.lit("респУблика "), l)).when(id % 4 == 2, F.upper(F.concat(F.lit("край "), l)))
    return _customers(spark, sf).select("id", T.tidy_region(raw).alias("region"))


@query("sca6_canonical_region", f"with {LETTERS} select id, case id % 6 when 0 then 'Новгородская область' when 1 then 'г. Москва' when 2 then 'Область ' || l when 4 then l || ' КРАЙ' else '' end as region from c")
def _(spark, sf):
    id, l = F.col("id"), F.col("l")  # noqa: E741
    raw = F.when(id % 6 == 0, F.lit("р-н Боровичский ")).when(id % 6 == 1, "Г.Москва").when(id % 6 == 2, F.concat(F.lit(" Область "), l)).when(id % 6 == 3, F.concat(F.lit("г. "), l)).when(id % 6 == 4, F.concat(l, F.lit(" КРАЙ")))
    return _customers(spark, sf).select("id", T.canonical_region(raw).alias("region"))


SHOWN = """case when req_idx in (2, 7) then 'требуется' when req_idx = 0 then case operator when 'gte' then '≥ ' when 'lte' then '≤ ' else '' end || replace(replace(trim(spelled, '[]'), '.0', ''), ', ', '–')
  when req_idx in (3, 4) then replace(replace(trim(spelled, '[]'), chr(39), ''), ', ', '–') else spelled end || case when unit <> '' then ' ' || unit else '' end"""


@query("sca23_requirement_texts", f"with {B.POSITIONS}, {WANTED}, {ASKED} select purchase_id, pos, req_idx, {SHOWN} as shown from asked")
def _(spark, sf):
    rows = C.to_requirements(asked_lines(spark, sf), ["purchase_id", "pos"])
    unit = F.when(F.col("req_unit") != "", F.concat("req_unit", F.lit(" (полное название)"))).otherwise("")
    return rows.select("purchase_id", "pos", "req_idx", E.requirement_text(F.col("operator"), F.col("req"), unit).alias("shown"))


@query("sca24_unit_price", """select l_orderkey, l_partkey, l_linenumber, l_suppkey, l_extendedprice, case when l_linenumber % 3 = 0 then l_extendedprice when l_linenumber % 3 = 1 and l_quantity > 10 then l_extendedprice / (1000 + l_quantity + 0.5) when l_linenumber % 3 = 2 then l_extendedprice / l_quantity end as price from lineitem""")
def _(spark, sf):
    n, q = F.col("l_linenumber"), F.col("l_quantity").cast("int")
    source = F.when(n % 3 == 0, F.when(n == 3, "Портал поставщиков").otherwise("zakupki.MOS.ru")).when(n % 3 == 1, "ЕИС")
    quantity = F.when(n % 3 == 1, F.when(q > 10, F.concat(F.lit("1 0"), F.lpad(q.cast("string"), 2, "0"), F.lit(",5 шт"))).otherwise("—")).otherwise(q.cast("string"))
    price = T.unit_price(source, F.col("l_extendedprice"), quantity)
    return B.table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_suppkey", "l_extendedprice", price.alias("price"))


@query("sca25_renewals", f"select c_custkey as account, greatest(TIMESTAMP '{B.NOW}' + to_hours(cast(c_custkey * 7 % 400 - 50 as integer)), TIMESTAMP '{B.NOW}') + interval 30 day as expires from customer")
def _(spark, sf):
    expires = B.now() + F.make_dt_interval(F.lit(0), (F.col("c_custkey") * 7 % 400 - 50).cast("int"))
    return B.table(spark, sf, "customer").select(F.col("c_custkey").alias("account"), renewed(expires, B.now()).alias("expires"))


@query("sca26_product_texts", "select p_partkey as product_id, concat_ws('. ', p_name, p_brand, p_type, case when p_size % 2 = 0 then 'размер ' || p_size end) as text from part")
def _(spark, sf):
    size = F.col("p_size")
    products = B.table(spark, sf, "part").select(F.col("p_partkey").alias("product_id"), F.col("p_name").alias("name"), F.when(size % 2 == 0, F.concat(F.lit("размер "), size)).alias("extra"))
    return E.product_text(products, B.attributes(spark, sf), ("type", "brand", "size"), F.col("extra"))


ROWS = "r as (select conv_id, turn, role, replace(substr(coalesce(text, ''), 1, 30), '|', '/') as t from conversations)"


@query("sca31_table_rows", f"with {ROWS} select conv_id, turn, '| ' || case when turn % 3 > 0 then role else '' end || ' | ' || regexp_replace(replace(t, chr(10), ' '), '^\\s+|\\s+$', '', 'g') || ' |' as line, regexp_replace(replace(t, chr(10), ' '), '^\\s+|\\s+$', '', 'g') as back from r where turn % 3 > 0 or regexp_replace(t, '\\s', '', 'g') <> ''")
def _(spark, sf):
    text = F.replace(F.substring(F.coalesce("text", F.lit("")), 1, 30), F.lit("|"), F.lit("/"))
    line = T.piped(F.array(F.when(F.col("turn") % 3 > 0, F.col("role")), text))
    rows = B.table(spark, sf, "conversations").select("conv_id", "turn", line.alias("line")).where("line is not null")
    return rows.withColumn("back", F.get(T.unpiped(F.col("line")), F.lit(1)))


@query("job6_market", f"with {BENCH}, {BUYERS} select c.seq as id, c.theme, b.median, case when c.price <> 0 and b.median <> 0 then cast(floor((c.price - b.median) / b.median::double * 100 + 0.5) as integer) end as deviation, h.count as contracts, h.total from contracts c join bench b using (theme) left join history h on h.buyer = upper(replace(replace(replace(c.customer, '#', ' '), '«', ''), '»', ''))")
def _(spark, sf):
    rows = B.contracts(spark, sf)
    return M.market(rows, rows).select(F.col("seq").alias("id"), "theme", "median", "deviation", "contracts", "total")


QUERIES, ORACLES = Q, O
