"""URL filters: rules by host and path, and boosted trees over lexical features for the URLs that no rule fits.

DataFrame functions and the DataFrame API of Spark's own trees only.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bidlake.functions.shared import saved

#: (verdict, host, path): fits the host and all its subdomains where the path starts with the rule's.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
LEVELS = ("top", "suffix", "site")
FOLDS = 5
FEATURES = ("url_length", "host_length", "path_length", "host_depth", "path_depth", "digit_ratio", "entropy", "parameters", "hyphens", "host_digits") + tuple(f"{x}_{y}" for x in LEVELS for y in ("rate", "count"))
#: A suffix with more than one in so many of the URLs is common; there are fewer than that many.
_COMMON = 1000
#: In the counts of a suffix with so many URLs or fewer a label tells of itself.
_FEW = 100


def url_parts(url: Column) -> tuple[Column, Column, Column]:
    """Host (A-Z lower-cased), path and query; all empty without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    host = F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    part = lambda pattern: F.coalesce(F.regexp_extract(rest, pattern, 1), F.lit(""))
    return F.coalesce(host, F.lit("")), part("^[^/?#]*([^?#]*)"), part(r"^[^?#]*\?([^#]*)")


def fitting_rule(host: Column, path: Column, rules: tuple = RULES) -> Column:
    """(length, verdict, rule) of the longest rule that fits, else null; of equally long ones a block, then the last by name."""
    fits = [
        F.when(
            ((host == h) | host.endswith("." + h)) & path.startswith(p),
            F.struct(F.lit(len(h + p)).alias("length"), F.lit(verdict == "block").alias("blocks"), F.lit(h + p).alias("rule")),
        )
        for verdict, h, p in rules
    ]
    return F.array_max(F.array(*fits)) if fits else F.lit(None).cast("struct<length:int,blocks:boolean,rule:string>")


def entropy(text: Column) -> Column:
    """Nats per character: runs of the sorted characters are counted in one pass."""
    chars = F.sort_array(F.filter(F.split(text, ""), lambda c: c != ""))
    worth = lambda run: run * F.log(F.greatest(run, F.lit(1.0)))
    start = F.struct(F.lit("").alias("last"), F.lit(0.0).alias("run"), F.lit(0.0).alias("sum"), F.lit(0.0).alias("n"))

    def step(acc: Column, c: Column) -> Column:
        same = acc["last"] == c
        run, total = F.when(same, acc["run"] + 1).otherwise(1.0), F.when(same, acc["sum"]).otherwise(acc["sum"] + worth(acc["run"]))
        return F.struct(c.alias("last"), run.alias("run"), total.alias("sum"), (acc["n"] + 1).alias("n"))

    return F.aggregate(chars, start, step, lambda acc: F.log(F.greatest(acc["n"], F.lit(1.0))) - (acc["sum"] + worth(acc["run"])) / F.greatest(acc["n"], F.lit(1.0)))


def _lexical(rows: DataFrame) -> DataFrame:
    """``rows`` (with url) and their parts, lexical features, fold, and the suffixes of one, two and three labels of the host."""
    url = F.coalesce(F.col("url"), F.lit(""))
    host, path, query = url_parts(F.col("url"))
    count = lambda c, pattern: F.length(F.regexp_replace(c, f"[^{pattern}]", "")).cast("double")
    parts = rows.withColumns({"host": host, "path": path, "_query": query})
    labels = F.split(F.regexp_replace("host", r":\d*$", ""), r"\.")
    suffix = lambda n: F.array_join(F.slice(labels, -F.least(F.lit(n), F.size(labels)), F.lit(n)), ".")
    return parts.withColumns({
        **{level: suffix(i + 1) for i, level in enumerate(LEVELS)}, "_fold": F.pmod(F.xxhash64(url), F.lit(FOLDS)).cast("int"),
        "url_length": F.length(url).cast("double"), "host_length": F.length("host").cast("double"), "path_length": F.length("path").cast("double"),
        "host_depth": count(F.col("host"), "."), "path_depth": count(F.col("path"), "/"),
        "digit_ratio": F.coalesce(F.try_divide(count(url, "0-9"), F.length(url)), F.lit(0.0)), "entropy": entropy(url),
        "parameters": F.when(F.col("_query") == "", 0.0).otherwise(count(F.col("_query"), "&") + 1), "hyphens": count(url, "-"), "host_digits": count(F.col("host"), "0-9"),
    }).drop("_query")


def _total(counts: Column) -> Column:
    return F.aggregate(counts, F.lit(0).cast("long"), lambda a, b: a + b)


def suffix_statistics(urls: DataFrame, labelled: DataFrame) -> dict[str, DataFrame]:
    """For each level: suffix, n (URLs) and by fold ns (URLs) and bads (labels of 1), counted over all rows of both tables (lexical columns)."""
    both = urls.select(*LEVELS, "_fold", F.lit(1).alias("n"), F.lit(0).alias("bad")).unionAll(labelled.select(*LEVELS, "_fold", F.lit(0), F.col("label").cast("int")))
    folds = lambda c: [F.sum(F.when(F.col("_fold") == i, F.col(c)).otherwise(0)).alias(f"{c}{i}") for i in range(FOLDS)]
    counts = saved(both.groupBy(*LEVELS).agg(*folds("n"), *folds("bad")), "sites")
    sums = lambda c: F.array(*[F.sum(f"{c}{i}") for i in range(FOLDS)])
    per = {level: counts.groupBy(F.col(level).alias("suffix")).agg(sums("n").alias("ns"), sums("bad").alias("bads")) for level in LEVELS}
    return {level: saved(t.select("suffix", _total(F.col("ns")).alias("n"), "ns", "bads"), f"{level}_statistics") for level, t in per.items()}


def _met(rows: DataFrame, level: str, statistics: DataFrame) -> DataFrame:
    """``rows`` with the ``ns`` and ``bads`` of their suffix, null where it isn't known, as ``level``_facts.

    Suffixes of over a thousandth of the URLs, fewer than a thousand, are broadcast; rows that have one are dealt
    evenly in the join of the others, where no suffix is common.
    """
    total = statistics.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    facts, is_common = F.struct("ns", "bads"), F.col("n") * _COMMON > total
    common = statistics.where(is_common).select(F.col("suffix").alias("_key"), facts.alias("_facts"))
    rare = statistics.where(~is_common).select(F.col("suffix").alias("_rare"), facts.alias("_rare_facts"))
    found = rows.join(F.broadcast(common), F.col(level) == F.col("_key"), "left")
    spread = F.concat(F.lit("/"), F.monotonically_increasing_id())  # no host holds a slash
    found = found.withColumn("_asked", F.when(F.col("_key").isNotNull(), spread).otherwise(F.col(level))).join(rare, F.col("_asked") == F.col("_rare"), "left")
    return found.withColumn(f"{level}_facts", F.coalesce("_facts", "_rare_facts")).drop("_key", "_facts", "_asked", "_rare", "_rare_facts")


def _assembled(rows: DataFrame, statistics: dict[str, DataFrame], prior: float, held_out: bool) -> DataFrame:
    """``rows`` (lexical) with the vector of all features; with ``held_out`` a row's own fold is left out of the counts of suffixes that few URLs have."""
    for level in LEVELS:
        rows = _met(rows, level, statistics[level])
        facts = F.col(f"{level}_facts")
        whole = lambda c: F.coalesce(_total(facts[c]), F.lit(0))
        left_out = F.lit(held_out) & (whole("ns") <= _FEW)
        other = lambda c: (whole(c) - F.coalesce(F.get(facts[c], F.col("_fold")), F.lit(0))) * (FOLDS / (FOLDS - 1))
        n, bad = (F.when(left_out, other(c)).otherwise(whole(c)) for c in ("ns", "bads"))
        rows = rows.withColumns({f"{level}_rate": (bad + prior) / (n + 1), f"{level}_count": F.log1p(n)})
    return VectorAssembler(inputCols=list(FEATURES), outputCol="_features", handleInvalid="keep").transform(rows)


class UrlModel:
    """What :func:`train` learns: trees (none without labels), suffix statistics as tables, and the share of bad labels among all URLs."""

    def __init__(self, trees: GBTClassificationModel | None, statistics: dict[str, DataFrame], prior: float):
        self.trees, self.statistics, self.prior = trees, statistics, prior


def train(urls: DataFrame, labelled: DataFrame, per_class: int = 10_000, presumed: float = 0.2, trees: int = 40, depth: int = 4, step: float = 0.2, seed: int = 7) -> UrlModel:
    """Gradient-boosted trees from the labelled URLs (url, label: 1 is bad) among all ``urls``, and suffix statistics over both tables.

    The trees are fitted on up to ``per_class`` distinct labelled URLs a class, those with the smallest hashes. Lists of
    bad URLs say little of the rest, so as many URLs without a label enter as good ones of weight ``presumed`` (0: none).
    The statistics take every row; of rare suffixes a fitted row sees only the folds that its own label isn't in. Labels other than 0 and 1 are left out; a URL with both counts as bad.
    """
    known = labelled.where("label in (0, 1) and url is not null").groupBy("url").agg(F.max(F.col("label").cast("int")).alias("label"))
    known = saved(_lexical(known), "labelled_urls")
    everything = _lexical(urls.select("url"))
    statistics = suffix_statistics(everything, _lexical(labelled.where("label in (0, 1)").select("url", "label")))
    bad, n = statistics["top"].agg(F.sum(_total(F.col("bads"))), F.sum("n")).first()
    prior = ((bad or 0) + 0.5) / ((n or 0) + 1)
    first = lambda df: df.orderBy(F.xxhash64("url"), "url").limit(per_class)
    picked = saved(first(known.where("label = 1")).unionAll(first(known.where("label = 0"))).withColumn("weight", F.lit(1.0)), "picked_urls")
    if not picked.limit(1).count():
        return UrlModel(None, statistics, prior)
    if presumed:
        some = saved(first(urls.select("url").where("url is not null").distinct()), "some_urls")
        seen = known.join(F.broadcast(some), "url", "left_semi").select("url")
        rest = _lexical(some.join(seen, "url", "left_anti")).withColumns({"label": F.lit(0), "weight": F.lit(float(presumed))})
        picked = picked.unionByName(rest)
    rows = _assembled(picked, statistics, prior, True).select("url", "_features", F.col("label").cast("double").alias("label"), "weight")
    fitted = saved(rows.orderBy("url").coalesce(1), "fitted_urls")  # one order, so the same trees on every run
    learner = GBTClassifier(featuresCol="_features", labelCol="label", weightCol="weight", maxIter=trees, maxDepth=depth, stepSize=step, seed=seed, checkpointInterval=-1)
    return UrlModel(learner.fit(fitted), statistics, prior)


def rule_labels(urls: DataFrame, rules: tuple = RULES) -> DataFrame:
    """(url, label) of the URLs that a rule decides: 1 where it blocks."""
    host, path, _ = url_parts(F.col("url"))
    return urls.select("url", fitting_rule(host, path, rules)["blocks"].cast("int").alias("label")).where("label is not null")


def filter_urls(urls: DataFrame, model: UrlModel, rules: tuple = RULES) -> DataFrame:
    """All rows and columns of ``urls`` with host, path, rule, verdict (allow or block) and bad (the trees' probability).

    The longest fitting rule decides; where none fits, the trees block from a probability of one half. ``rules`` is a
    short list that stands in the plan. Null URLs and those without ``://`` have empty parts, which no rule with a
    host fits, and are judged by the trees like all others; URLs of any length are read whole; repeated rows fall alike.
    Without any labels ``bad`` is 0 and such URLs are allowed. An empty table gives an empty
    result. Input columns named like a result column are replaced. The columns given are shuffled where their
    host's suffixes are looked up, so leave page bodies out.
    """
    own = ("host", "path", "rule", "verdict", "bad")
    row = F.struct(*[F.col(f"`{c}`") for c in urls.columns if c.lower() not in own])
    rows = _lexical(urls.select(row.alias("_row"), "url"))
    rows = rows.withColumn("_rule", fitting_rule(F.col("host"), F.col("path"), rules))
    if model.trees is None:
        judged = rows.withColumn("bad", F.lit(0.0))
    else:
        judged = model.trees.transform(_assembled(rows, model.statistics, model.prior, False)).withColumn("bad", F.element_at(vector_to_array("probability"), 2))
    blocked = F.coalesce(F.col("_rule.blocks"), F.col("bad") >= 0.5)
    return judged.select("_row.*", "host", "path", F.col("_rule.rule").alias("rule"), F.when(blocked, "block").otherwise("allow").alias("verdict"), "bad")
