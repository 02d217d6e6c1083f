"""Mixing of sources to target marginals by iterative proportional fitting."""

from __future__ import annotations

import warnings

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bidlake.functions.shared import saved
from bidlake.llm.rows import row_key, settle

Targets = dict[str, dict[str | None, float]]


def tempered(cells: pd.DataFrame, powers: dict[str, float]) -> Targets:
    """Target shares in proportion to a power of each value's tokens: 1 keeps the shares, 0 evens them out."""
    out = {}
    for dim, power in powers.items():
        tokens = cells.groupby(dim, dropna=False)["tokens"].sum().astype(float) ** power
        out[dim] = {None if pd.isna(k) else k: v for k, v in (tokens / tokens.sum()).items()}
    return out


def rake(cells: pd.DataFrame, targets: Targets, tolerance: float = 1e-9, max_rounds: int = 500) -> np.ndarray:
    """Share of the mixture for each cell, starting from its tokens, with the target marginals.

    Each round scales the cells of every value to its share, one dimension after another, until no
    marginal is off by more than ``tolerance``. Targets of values without tokens are given to the
    others in proportion; cells of values without a target get nothing. Targets that no mixture of the
    cells can meet never settle: after ``max_rounds`` the nearest share found is used, with a warning.
    """
    if cells.empty:
        return np.zeros(0)
    share = cells["tokens"].to_numpy(float) / max(cells["tokens"].sum(), 1)
    groups = []
    for dim, wanted in targets.items():
        values = [None if pd.isna(v) else v for v in cells[dim].astype(object)]
        names = sorted(set(values), key=str)
        place = {n: i for i, n in enumerate(names)}
        code = np.array([place[v] for v in values], np.int64)
        share = share * np.array([v in wanted for v in values], bool)
        goal = np.array([wanted.get(n, 0.0) for n in names], float)
        groups.append((code, goal))
    for _ in range(max_rounds):
        off = 0.0
        for code, goal in groups:
            now = np.bincount(code, share, len(goal))
            live = goal * (now > 0)
            live = live / max(live.sum(), 1e-300)
            off = max(off, np.abs(now - live).max(initial=0))
            share = share * np.divide(live, now, out=np.zeros_like(now), where=now > 0)[code]
        if off <= tolerance:
            return share
    _unsettled(off, max_rounds)
    return share


def _unsettled(off: float, rounds: int) -> None:
    warnings.warn(f"raking stopped after {rounds} rounds with a marginal off by {off:.3g}: the targets may contradict each other", stacklevel=3)


def probabilities(tokens: np.ndarray, share: np.ndarray, budget: float | None) -> np.ndarray:
    """Sampling probability of each cell: in proportion to share / tokens.

    Without a budget the scale is the largest at which none exceeds 1, so the mixture is exactly the
    raked one. A budget in tokens takes the scale at which the expected tokens meet it, cells that
    would exceed 1 being taken whole.
    """
    gain = np.divide(share, tokens, out=np.zeros(len(tokens)), where=tokens > 0)
    if not gain.any():
        return gain
    if budget is None:
        return gain / gain.max()
    low, high = 0.0, 1 / gain[gain > 0].min()
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if (tokens * np.minimum(1, middle * gain)).sum() < budget else (low, middle)
    return np.minimum(1, high * gain)


def rake_table(cells: DataFrame, targets: Targets | None, powers: dict[str, float], budget: float | None, tolerance: float = 1e-9, max_rounds: int = 500) -> DataFrame:
    """:func:`rake` and :func:`probabilities` for cells of any number: dimensions, tokens and probability.

    Shares, marginals and goals stay tables; a round joins each dimension's factors to the cells and is
    written to the shared folder. Only sums and the largest deviation reach the driver.
    """
    spark, dims = cells.sparkSession, list(targets or powers)
    cells = saved(cells.withColumn("tokens", F.col("tokens").cast("double")), "mix_cells")
    total = cells.agg(F.sum("tokens")).first()[0] or 1.0
    goals = {}
    for dim in dims:
        if targets:
            goals[dim] = spark.createDataFrame(list(targets[dim].items()), "value string, goal double")
        else:
            tempering = cells.groupBy(F.col(dim).cast("string").alias("value")).agg(F.pow(F.sum("tokens"), F.lit(powers[dim])).alias("goal"))
            goals[dim] = saved(tempering, "mix_goals")
    now = cells.withColumn("share", F.col("tokens") / F.lit(total))
    for dim in dims:
        known = goals[dim].select(F.col("value"))
        now = now.join(known, F.col(dim).cast("string").eqNullSafe(F.col("value")), "left_semi")
    now = saved(now, "mix_share")
    for _ in range(max_rounds):
        off = 0.0
        for dim in dims:
            sums = now.groupBy(F.col(dim).cast("string").alias("of")).agg(F.sum("share").alias("now"))
            live = saved(sums.join(goals[dim], F.col("of").eqNullSafe(F.col("value"))).select("of", "now", F.when(F.col("now") > 0, F.col("goal")).otherwise(0.0).alias("goal")), "mix_marginal")
            whole = live.agg(F.sum("goal")).first()[0] or 1e-300
            factor = live.withColumn("goal", F.col("goal") / F.lit(whole))
            off = max(off, factor.agg(F.max(F.abs(F.col("now") - F.col("goal")))).first()[0] or 0.0)
            factor = factor.select("of", F.coalesce(F.try_divide("goal", "now"), F.lit(0.0)).alias("factor"))
            joined = now.join(factor, F.col(dim).cast("string").eqNullSafe(F.col("of")))
            now = joined.select(*cells.columns, (F.col("share") * F.col("factor")).alias("share"))
        now = saved(now, "mix_share")
        if off <= tolerance:
            break
    else:
        _unsettled(off, max_rounds)
    gain = now.withColumn("gain", F.when(F.col("tokens") > 0, F.col("share") / F.col("tokens")).otherwise(0.0))
    ends = gain.where("gain > 0").agg(F.min("gain"), F.max("gain")).first()
    if ends[0] is None:
        scale = 0.0
    elif budget is None:
        scale = 1 / ends[1]
    else:  # sixty scales a pass narrow the place down sixtyfold
        low, scale = 0.0, 1 / ends[0]
        for _ in range(9):
            tries = np.linspace(low, scale, 61)
            sums = gain.agg(*[F.sum(F.col("tokens") * F.least(F.lit(1.0), F.col("gain") * F.lit(float(x)))) for x in tries]).first()
            at = min(next((i for i, x in enumerate(sums) if x >= budget), 60), 60)
            low, scale = float(tries[max(at - 1, 0)]), float(tries[at])
    out = gain.select(*cells.columns, F.least(F.lit(1.0), F.col("gain") * F.lit(float(scale))).alias("probability"))
    rest = cells.join(out.select(*[F.col(c).alias(f"_{c}") for c in dims]), [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in dims], "left_anti")
    return out.unionByName(rest.withColumn("probability", F.lit(0.0)))


def uniform(*columns: str, seed: int) -> Column:
    """A number in [0, 1) that depends on the columns' values and the seed only."""
    return F.shiftrightunsigned(F.xxhash64(*columns, F.lit(seed)), 11) / F.lit(float(1 << 53))


def layout_topic(text: Column) -> Column:
    """A topic for texts that carry none: the kind of writing, from its most telling signs."""
    signs = F.length(F.regexp_replace(text, r"[^#*$%&|<>]", "")) * 50 > F.length(text)
    return (
        F.when(F.length(F.trim(text)) == 0, "empty")
        .when(F.contains(text, F.lit(" | ")), "table")
        .when(signs, "symbols")
        .when(text.rlike("(?i)licen[sc]e|copyright"), "legal")
        .when(F.contains(F.trim(text), F.lit("\n")), "prose")
        .otherwise("line")
    )


def word_tokens(text: Column) -> Column:
    return F.greatest(F.size(F.split(F.trim(text), r"\s+")), F.lit(1)).cast("long")


def mix(
    docs: DataFrame, targets: Targets | None = None, powers: dict[str, float] | None = None, budget: float | None = None, seed: int = 8, driver_cells: int = 100_000, keep: float = 0.7
) -> DataFrame:
    """source, lang, topic, tokens, probability and kept beside doc_id, key (:func:`row_key`) and text_key, for every row.

    The cells source x language x topic are summed up over all rows. Up to ``driver_cells`` of them are
    raked on the driver and broadcast; more are raked as a table (:func:`rake_table`), to the same
    probabilities, and meet the rows by salted keys. Token weights are raked to the
    ``targets``, or without them to the tempered marginals given by ``powers``. Tempering gives a rare
    value a gain without bound, so there the budget is ``keep`` of all tokens unless one is given: rare
    cells are taken whole and don't shrink the others. Given targets are met exactly unless a budget is
    given. A row is kept if its
    uniform number, a hash of doc_id and text, lies below its cell's probability: repeated rows fall
    alike, and the same rows are kept on every run and every cluster. Nulls are values of their own;
    null text is empty and weighs one token. An empty table gives an empty result.
    """
    dims = ["source", "lang", "topic"]
    powers = powers or {"source": 0.7, "lang": 0.85, "topic": 1.0}
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = saved(
        docs.select("doc_id", row_key().alias("key"), F.xxhash64(text).alias("text_key"), "source", "lang", layout_topic(text).alias("topic"), word_tokens(text).alias("tokens")), "mix_rows"
    )
    sums = rows.groupBy(*dims).agg(F.sum("tokens").alias("tokens"))
    cells = sums.limit(driver_cells + 1).toPandas()
    if budget is None and not targets:
        budget = keep * float(rows.agg(F.sum("tokens")).first()[0] or 0)
    if len(cells) > driver_cells:
        salts = F.sequence(F.lit(0), F.lit(15))
        cell = saved(rake_table(sums, targets, powers, budget), "mix_probabilities").withColumn("c_salt", F.explode(salts)).drop("tokens")
        rows = rows.withColumn("salt", F.pmod("key", F.lit(16)).cast("int"))
        cell = cell.withColumnsRenamed({d: f"c_{d}" for d in dims})
    else:
        cells["probability"] = probabilities(cells["tokens"].to_numpy(float), rake(cells, targets or tempered(cells, powers)), budget)
        table = [(*[None if pd.isna(x) else x for x in r[:3]], float(r[3])) for r in cells[[*dims, "probability"]].itertuples(index=False)]
        cell = F.broadcast(docs.sparkSession.createDataFrame(table, "c_source string, c_lang string, c_topic string, probability double"))
    on = F.col("source").eqNullSafe(F.col("c_source")) & F.col("lang").eqNullSafe(F.col("c_lang")) & F.col("topic").eqNullSafe(F.col("c_topic"))
    if "salt" in rows.columns:
        on = on & (F.col("salt") == F.col("c_salt"))
    return rows.join(cell, on).select("doc_id", "key", "text_key", *dims, "tokens", "probability", (uniform("doc_id", "text_key", seed=seed) < F.col("probability")).alias("kept"))


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The sampled rows of ``docs`` with all their columns; options as for :func:`mix`."""
    return settle(docs, saved(mix(docs, **options).where("not kept").select("key", "kept").distinct(), "mix_gone"))
