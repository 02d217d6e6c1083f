"""Queries on terms, subjects, markets, vectors and names."""

from __future__ import annotations

from pyspark.sql import functions as F

from bidlake.functions import text as T
from bidlake.functions.shared import saved
from bidlake.operators import evaluate as E
from bidlake.operators import terms as M
from bidlake.plans import bindings as B

Q, O = {}, {}  # noqa: E741
P = T.LATIN
STEM = "regexp_replace({}, '^(.{{4,}}?)(" + "|".join(P.endings) + ")$', '\\1')"
STOPS = ", ".join(f"'{s}'" for s in P.stop_prefixes)
WORDS = f"words as (select id, source, unnest(regexp_extract_all(lower(text), '[{P.letters}0-9]+')) as word from texts)"
JUNK = "(?:19|20)[0-9]{2}\\s*г$|^(?:19|20)[0-9]{2}$|[0-9]{6,}"
#: A number with its unit ends before anything but a letter; what ends it is matched, too, and can't begin the next one here.
MEASURED = f"((?:[≥≤=<>]\\s*)?(?:[0-9]+(?:[.,][0-9]+)?\\s*[-–—]\\s*)?[0-9]+(?:[.,][0-9]+)?\\s*(?:{M.UNITS}))(?:[^а-яёa-z]|$)"
TERMS = f"""{B.TEXTS}, {WORDS}, terms as (select id, trim(regexp_replace(unnest(regexp_extract_all(lower(text), '{MEASURED}', 1)), '\\s+', ' ', 'g')) as term from texts
  union all select id, {STEM.format('word')} from words where length(word) >= 4 and substr({STEM.format('word')}, 1, 5) not in ({STOPS})),
counts as (select id, term, count(*) as tf from terms where not regexp_matches(term, '{JUNK}') group by all),
dfs as (select term, count(*) as df, ln(((select count(distinct id) from counts) + 1) / (count(*) + 1)::double) as idf from counts group by 1),
subj as (select id, term, weight, n from (select id, term, round(tf * idf, 9) as weight, row_number() over (partition by id order by round(tf * idf, 9) desc, term) as n
  from counts join dfs using (term) where length(term) >= 5 and not regexp_matches(term, '[0-9]')) where n <= 8)"""


def query(name, sql=None):
    def add(f):
        Q[name] = f
        if sql:
            O[name] = sql
        return f

    return add


def _counts(spark, sf):
    return M.term_counts(B.texts(spark, sf), "text", P)


def _kept_counts(spark, sf):
    """The counts as a written table, for queries that read them more than once."""
    return saved(_counts(spark, sf), "term_counts")


@query("agg10_term_frequency", f"with {TERMS} select id, count(*) as terms, sum(tf)::bigint as tokens, max(tf) as most from counts group by 1")
def _(spark, sf):
    return _counts(spark, sf).groupBy("id").agg(F.count(F.lit(1)).alias("terms"), F.sum("tf").alias("tokens"), F.max("tf").alias("most"))


@query("agg11_document_frequency", f"with {TERMS} select term, df, round(idf, 9) as idf from dfs where df > 1")
def _(spark, sf):
    return M.idf(_kept_counts(spark, sf)).where("df > 1").select("term", "df", F.round("idf", 9).alias("idf"))


@query("rnk2_subject_terms", f"with {TERMS} select id, term, n from subj")
def _(spark, sf):
    c = _kept_counts(spark, sf)
    return M.subject_terms(c, M.idf(c), 8).select("id", "term", F.col("n").cast("long").alias("n"))


SPLIT = f"""{TERMS}, m as (select *, regexp_matches(term, '[0-9]') and regexp_matches(term, '[{P.measured}]|%') as measured from counts where length(term) <= 24 and not regexp_matches(term, '^[0-9]{{5,}}$')),
  ms as (select *, row_number() over (partition by id, measured order by case when measured then 0 else -tf end, length(term) desc, term) as n, sum(measured::int) over (partition by id) as m, sum((not measured)::int) over (partition by id) as w from m),
  split as (select id, term, measured, n from ms where n <= case when measured then least(m, greatest(10, 20 - w)) else 20 - least(m, greatest(10, 20 - w)) end)"""


@query("rnk1_split_budget", f"with {SPLIT} select * from split")
def _(spark, sf):
    return M.split_budget_terms(_counts(spark, sf), P.measured, 20).withColumn("n", F.col("n").cast("long"))


def _matched(queries: str) -> str:
    return f"""{TERMS}, queries as ({queries}), titles as (select distinct id as listing, {STEM.format('word')} as term from (select id, unnest(regexp_extract_all(lower(title || ' ' || lots), '[{P.letters}0-9]+')) as word from texts) where length(word) >= 4),
scored as (select q.id, t.listing, cast(floor(100 * sum(weight) / any_value(total) + 0.5) as integer) as score, string_agg(term, ' ' order by n) as matched from queries q join titles t using (term) join (select id, sum(weight) as total from queries group by 1) s on s.id = q.id group by all)"""


MATCH = _matched("select * from subj where id % 100 = 0")


def _match_sides(spark, sf, queries="id % 100 = 0"):
    c = _kept_counts(spark, sf)
    terms = saved(M.subject_terms(c.where(queries), M.idf(c), 8), "subjects")
    return terms, M.listing_stems(B.texts(spark, sf).withColumnRenamed("id", "listing"), ["title", "lots"], P)


def _scored(spark, sf, least=1, shown=False, **sides):
    terms, stems = _match_sides(spark, sf, **sides)
    return M.subject_match(terms, saved(stems, "stems"), least, shown)


@query("rnk3_subject_match", f"with {_matched('select * from subj')} select id, listing, score, matched from scored where score > 0")
def _(spark, sf):
    return _scored(spark, sf, shown=True, queries="id is not null").where("score > 0").withColumn("matched", F.array_join("matched", " "))


@query("flt8_match_filter", f"with {MATCH} select distinct listing from scored where score >= 25")
def _(spark, sf):
    return _scored(spark, sf, 25).select("listing").distinct()


@query("rnk4_combined_rank", f"with {MATCH}, r as (select *, row_number() over (partition by id order by score * 100 + case when listing % 3 = 0 then -1 else listing % 100 end desc, listing desc) as place from scored) select id, listing, place from r where place <= 10")
def _(spark, sf):
    terms, stems = _match_sides(spark, sf)
    fit = F.when(F.col("listing") % 3 == 0, -1).otherwise(F.col("listing") % 100)
    return M.best_listings(terms, saved(stems.withColumn("fit", fit.cast("long")), "stems"), 10).withColumn("place", F.col("place").cast("long"))


@query("agg5_subject_coverage", f"with {MATCH} select id, count(*) filter (score > 0) as hits, count(*) filter (score >= 60) as strong, max(score) as best from scored group by 1")
def _(spark, sf):
    return _scored(spark, sf).groupBy("id").agg(F.count_if(F.col("score") > 0).alias("hits"), F.count_if(F.col("score") >= 60).alias("strong"), F.max("score").alias("best"))


@query("agg12_weighted_coverage", f"""with {TERMS}, own as (select distinct term from counts join documents on doc_id = id where lang = 'fr'), r as (select c.id, sum(idf) as t, sum(case when own.term is not null then idf else 0 end) as g, count(own.term) as covered, count(*) filter (own.term is null) as missing
  from (select id, term from subj) c join dfs using (term) left join own using (term) group by 1)
  select id, cast(floor(100 * g / t + 0.5) as integer) as score, covered, missing, case when floor(100 * g / t + 0.5) >= 60 then 'good' when floor(100 * g / t + 0.5) >= 30 then 'partial' else 'gaps' end as verdict from r""")  # fmt: skip
def _(spark, sf):
    c = _kept_counts(spark, sf)
    w = M.idf(c).select("term", "idf")
    french = B.table(spark, sf, "documents").where("lang = 'fr'").select(F.col("doc_id").alias("id"))
    return M.weighted_coverage(M.subject_terms(c, w, 8), c.join(french, "id", "left_semi"), w)


PARTS = "p as (select p_partkey as id, string_split(lower(p_type), ' ') as own, string_split(lower(p_name), ' ') as want from part)"


@query("agg13_text_coverage", f"with {PARTS}, c as (select id, len(want) as n, len(list_filter(want, lambda r: len(list_filter(own, lambda o: contains(o, r) or contains(r, o))) > 0)) as k from p) select id, k as covered, cast(round_even(100.0::double * k / n, 0) as integer) as score from c")
def _(spark, sf):
    part = B.table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.split(F.lower("p_type"), " ").alias("own"), F.split(F.lower("p_name"), " ").alias("want"))
    k = F.size(M.text_coverage(F.col("want"), F.col("own")))
    return part.select("id", k.alias("covered"), F.bround(F.lit(100.0) * k / F.size("want"), 0).cast("int").alias("score"))


@query("set2_covered_missing", f"with {PARTS} select id, len(list_intersect(list_distinct(want), own)) as covered, len(list_filter(list_distinct(want), lambda x: not list_contains(own, x))) as missing from p")
def _(spark, sf):
    part = B.table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.split(F.lower("p_type"), " ").alias("own"), F.split(F.lower("p_name"), " ").alias("want"))
    return part.select("id", F.size(F.array_intersect("want", "own")).alias("covered"), F.size(F.array_except("want", "own")).alias("missing"))


@query("set6_term_union", f"with {PARTS} select id, len(list_distinct(list_concat(own, want))) as n from p")
def _(spark, sf):
    part = B.table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.split(F.lower("p_type"), " ").alias("own"), F.split(F.lower("p_name"), " ").alias("want"))
    return part.select("id", F.size(F.array_union("own", "want")).alias("n"))


@query("agg23_surface_forms", f"""with {B.TEXTS}, w as (select id, unnest(regexp_extract_all(lower(title), '[{P.letters}0-9]+')) as form, generate_subscripts(regexp_extract_all(lower(title), '[{P.letters}0-9]+'), 1) - 1 as i from texts),
  f as (select {STEM.format('form')} as stem, form, count(*) as n, min(id * 1000000 + i) as first from w group by all) select stem, form, n from (select *, row_number() over (partition by stem order by n desc, first, form) as k from f) where k = 1""")  # fmt: skip
def _(spark, sf):
    words = B.texts(spark, sf).select("id", F.posexplode(T.tokens(F.col("title"), P)).alias("i", "form"))
    return M.surface_forms(words.select(T.stem(F.col("form"), P).alias("stem"), "form", (F.col("id") * 1_000_000 + F.col("i")).alias("place")))


BENCH = f"""{B.CONTRACTS}, bench as (select theme, case when count(*) filter (price > 0) > 0 then count(*) else 0 end as count, cast(floor(avg(price) filter (price > 0) + 0.5) as bigint) as avg, cast(floor(median(price) filter (price > 0) + 0.5) as bigint) as median,
  cast(floor(min(price) filter (price > 0) + 0.5) as bigint) as min, cast(floor(max(price) filter (price > 0) + 0.5) as bigint) as max from contracts group by 1)"""
BUYER = "trim(regexp_replace(regexp_replace(upper(customer), '[\"«»]', '', 'g'), '[^A-Z0-9_ А-ЯЁ]', ' ', 'g'))"
BUYERS = f"""d as (select * from (select *, row_number() over (partition by reg_no order by theme, seq) as n from contracts) where n = 1),
history as (select {BUYER} as buyer, min_by(customer, seq) as customer, count(*) as count, sum(price::decimal(18,2))::double as total, min(date) as first, max(date) as last, cast(floor(sum(price::decimal(18,2))::double / count(*) + 0.5) as bigint) as avg from d group by 1)"""
HISTORY = f"{B.CONTRACTS}, {BUYERS}"


@query("agg6_price_benchmark", f"with {BENCH} select * from bench")
def _(spark, sf):
    return M.price_benchmark(B.contracts(spark, sf))


@query("agg7_buyer_history", f"with {HISTORY} select * from history")
def _(spark, sf):
    return M.buyer_history(B.contracts(spark, sf))


@query("agg8_price_deviation", f"with {BENCH}, d as (select seq, case when price <> 0 and median <> 0 then cast(floor((price - median) / median::double * 100 + 0.5) as integer) end as deviation from contracts join bench using (theme)) select seq, deviation, case when deviation > 5 then 'high' when deviation < -5 then 'low' else 'usual' end as class from d")
def _(spark, sf):
    rows = B.contracts(spark, sf)
    d = M.price_deviation(F.col("price"), F.col("median").cast("double"))
    out = rows.join(M.price_benchmark(rows).select("theme", "median"), "theme").select("seq", d.alias("deviation"))
    return out.withColumn("class", F.when(F.col("deviation") > 5, "high").when(F.col("deviation") < -5, "low").otherwise("usual"))


@query("joi13_theme", f"""with {B.TEXTS}, t as (select id, regexp_extract_all(lower(title), '[{P.letters}0-9]+') as toks from texts), h as (select id, len(list_filter(toks, lambda t: starts_with(t, 'the'))) > 0 as a, len(list_filter(toks, lambda t: starts_with(t, 'un'))) > 0 as b, len(list_filter(toks, lambda t: starts_with(t, 'of'))) > 0 as c from t)
  select id, case when a and c then 'both' when a then 'the' when b then 'un' end as theme from h""")  # fmt: skip
def _(spark, sf):
    return M.assign_theme(B.texts(spark, sf), {"the": ["the"], "un": ["un"], "both": ["the", "of"]}, P).select("id", "theme")


@query("joi14_buyer_lookup", f"with {HISTORY} select o_orderkey as id, count, total from orders join customer on o_custkey = c_custkey left join history on buyer = upper(replace(c_name, '#', ' '))")
def _(spark, sf):
    history = M.buyer_history(B.contracts(spark, sf))
    orders = B.table(spark, sf, "orders").join(B.table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return orders.withColumn("buyer", T.buyer_key(F.col("c_name"))).join(history, "buyer", "left").select(F.col("o_orderkey").alias("id"), "count", "total")


INDEX = "idx as (select source, lang, n, total from (select source, lang, count(*) as n, sum(count(*)) over (partition by source) as total, row_number() over (partition by source order by count(*) desc, lang) as k from documents group by 1, 2) where k = 1 and total >= 5 and n >= 0.65 * total)"


@query("agg9_majority_index", f"with {INDEX} select source, lang, n, total::bigint as \"all\" from idx")
def _(spark, sf):
    return M.majority_index(B.table(spark, sf, "documents"), "source", "lang", 5, 0.65)


@query("joi12_fill_region", f"with {INDEX} select doc_id, coalesce(case when doc_id % 4 > 0 then d.lang end, idx.lang) as lang, doc_id % 4 = 0 and idx.lang is not null as guessed from documents d left join idx using (source)")
def _(spark, sf):
    docs = B.table(spark, sf, "documents").select("doc_id", "source", "lang")
    index = M.majority_index(docs, "source", "lang", 5, 0.65)
    holes = docs.withColumn("lang", F.when(F.col("doc_id") % 4 > 0, F.col("lang")))
    return M.fill_by_index(holes, index, "source", "lang").select("doc_id", "lang", "guessed")


SIMS = "sims as (select q.vec_id as query, v.vec_id as item, round(list_dot_product(q.embedding::double[], v.embedding::double[]), 6) as sim from embeddings q, embeddings v where q.vec_id % 100 = 0)"


def _sims(spark, sf, least):
    v = B.table(spark, sf, "embeddings")
    return M.semantic_rank(v.select(F.col("vec_id").alias("item"), F.col("embedding").alias("vector")), v.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query"), F.col("embedding").alias("vector")), least)


@query("joi9_semantic_rank", f"with {SIMS} select query, item, sim from sims where sim >= 0.3")
def _(spark, sf):
    return _sims(spark, sf, 0.3)


@query("flt10_semantic_filter", f"with {SIMS} select distinct item from sims where sim >= 0.33 and query <> item")
def _(spark, sf):
    return _sims(spark, sf, 0.33).where("query <> item").select("item").distinct()


FIELDS = """fields as (select vec_id // 20 as pair, 'f' || vec_id as key, case label % 3 when 0 then 'num' when 1 then 'text' end as kind, vec_id as idx, embedding::double[] as v from embeddings)"""


@query("joi8_vector_alignment", f"""with {FIELDS}, met as (select w.pair, w.key, w.kind, c.key as card_key, c.kind as card_kind, c.idx, round(list_dot_product(w.v, c.v), 6) as sim from fields w join fields c on w.pair = c.pair and w.idx % 2 = 0 and c.idx % 2 = 1),
  b as (select *, row_number() over (partition by pair, key order by sim desc, idx) as n from met) select pair, key, card_key, sim from b where n = 1 and sim >= 0.15 and coalesce(kind = card_kind, true)""")  # fmt: skip
def _(spark, sf):
    id = F.col("vec_id")
    kind = F.when(F.col("label") % 3 == 0, "num").when(F.col("label") % 3 == 1, "text")
    fields = B.table(spark, sf, "embeddings").select(F.floor(id / 20).alias("pair"), F.concat(F.lit("f"), id).alias("key"), kind.alias("kind"), id.alias("idx"), F.col("embedding").alias("vector"))
    card = fields.where("idx % 2 = 1").withColumnsRenamed({"key": "card_key", "kind": "card_kind"})
    return M.align_vectors(fields.where("idx % 2 = 0").drop("idx"), card, 0.15)


PAIRS = "pairs as (select x.vec_id as a, y.vec_id as b, round(list_dot_product(x.embedding::double[], y.embedding::double[]), 6) as sim from embeddings x join embeddings y on x.vec_id < y.vec_id)"
#: Edges both ways to the nodes that each node reaches, and the smallest of them.
REACH = "r(node, seen) as (select distinct a, a from e union select r.node, e.b from r join e on e.a = r.seen) select node, min(seen) as component from r group by 1"


#: Part names by the number of a vector; pairs of one normal form, or known to belong together, propose nothing new.
NAMED = """named as (select p_partkey as id, list_sort(list_distinct(string_split(lower(p_name), ' '))) as toks, p_brand as known from part),
  proposed as (select a, b, sim from pairs left join named x on x.id = a left join named y on y.id = b where sim >= 0.32 and not coalesce(x.toks = y.toks, false) and not coalesce(x.known = y.known, false))"""


def _vectors(spark, sf):
    return B.table(spark, sf, "embeddings").select(F.col("vec_id").alias("item"), F.col("embedding").alias("vector"))


def _known(spark, sf):
    part = B.table(spark, sf, "part")
    names = part.select(F.col("p_partkey").alias("item"), F.col("p_name").alias("name"))
    return names, part.select(F.col("p_partkey").alias("item"), F.col("p_brand").alias("group"))


@query("joi10_name_pairs", f"with {PAIRS}, {NAMED} select a, b, sim from proposed")
def _(spark, sf):
    return M.new_similar_pairs(_vectors(spark, sf), *_known(spark, sf), 0.32)


@query("agg18_components", f"with recursive {PAIRS}, e as (select a, b from pairs where sim >= 0.3 union all select b, a from pairs where sim >= 0.3), {REACH}")
def _(spark, sf):
    return M.linked_groups(_vectors(spark, sf), 0.3)


@query("job8_synonym_groups", f"with recursive {PAIRS}, {NAMED}, n as (select a, b from proposed), e as (select a, b from n union all select b, a from n), {REACH}")
def _(spark, sf):
    return M.linked_groups(_vectors(spark, sf), 0.32, *_known(spark, sf))


KEY_GROUPS = [(0, "производитель"), (0, "Бренд"), (0, "марка товара"), (1, "цвет"), (1, "окраска")]


@query("joi7_align_keys", """with p as (select *, p_partkey as k from part), pairs as (
    select k as pair, case k % 3 when 0 then 'Размер товара' when 1 then 'товара_размер' else 'Размер, товара!' end as key, 'размер_товара' as card_key, case when k % 2 = 1 then 'num' else 'text' end as a, case when k % 5 = 0 then 'text' else 'num' end as b from p
    union all select k, 'Производитель', case when k % 6 = 0 then 'товара марка' else 'бренд' end, case when regexp_matches(p_brand, '[0-9]') then 'num' else 'text' end, case when k % 4 > 0 then case when k % 6 = 0 then 'text' when regexp_matches(p_brand, '[0-9]') then 'num' else 'text' end end from p
    union all select k, 'Цвет', 'окраска', 'text', 'text' from p where k % 7 = 0) select pair, key, card_key from pairs where coalesce(a = b, true)""")  # fmt: skip
def _(spark, sf):
    k = F.col("p_partkey")
    part = B.table(spark, sf, "part")
    text, number = (lambda c: E.value_of("str", c)), E.value_of("num", F.col("p_size").cast("double"))
    field = lambda key, value: F.struct((F.lit(key) if isinstance(key, str) else key).alias("key"), value.cast(E.VALUE).alias("value"))
    size = F.when(k % 3 == 0, "Размер товара").when(k % 3 == 1, "товара_размер").otherwise("Размер, товара!")
    wanted = F.array(field(size, F.when(k % 2 == 1, number).otherwise(text(F.col("p_type")))), field("Производитель", text(F.col("p_brand"))), field("тип", text(F.col("p_type"))), field("Цвет", text(F.lit("красный"))))
    brand = F.when(k % 4 == 0, E.value_of("list", F.array("p_brand"))).otherwise(text(F.col("p_brand")))
    first = F.when(k % 6 == 0, field("товара марка", F.when(k % 4 > 0, text(F.lit("своя"))).otherwise(brand))).otherwise(field("артикул", number))
    card = F.array(first, field("бренд", brand), field("размер_товара", F.when(k % 5 == 0, text(F.lit("большой"))).otherwise(number)), field("тип", text(F.col("p_type"))), field(F.when(k % 7 == 0, "окраска").otherwise("ширина"), text(F.lit("синий"))))
    asked = part.select(k.alias("pair"), F.explode(wanted).alias("f")).select("pair", "f.key", M.value_kind(F.col("f.value")).alias("kind"))
    own = part.select(k.alias("pair"), F.posexplode(card).alias("idx", "f")).select("pair", "idx", F.col("f.key").alias("card_key"), M.value_kind(F.col("f.value")).alias("card_kind"))
    return M.align_keys(asked, own, spark.createDataFrame(KEY_GROUPS, "`group` long, word string"))


QUERIES, ORACLES = Q, O
