"""SimHash fingerprints of word shingles, linked by a pigeonring filter."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bidlake.functions.shared import connected_components, saved
from bidlake.llm.rows import row_key, settle

BITS = 64
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_STEP = 1 << 16


def text_fingerprint(text: str | None, shingle: int = 3) -> int:
    """Signed 64-bit SimHash: XXH64 (seed 42) of each shingle, a bit set if set in over half of them."""
    import xxhash

    words = _WORD.findall((text or "").encode("utf-8", "surrogatepass").translate(_LOWER))
    if not words:
        return 0
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    at = np.cumsum([0, *(len(w) + 1 for w in words)]).tolist()
    n = max(1, len(words) - shingle + 1)
    last = min(shingle, len(words))
    counts = np.zeros(BITS, np.int64)
    for lo in range(0, n, _STEP):
        hashes = np.array([digest(joined[at[i] : at[i + last] - 1], 42) for i in range(lo, min(n, lo + _STEP))], "<u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<i8")[0])


def fingerprint(text: Column, shingle: int = 3) -> Column:
    @F.pandas_udf("long")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([text_fingerprint(t, shingle) for t in texts], dtype="int64")

    return of(text)


def _budgets(distance: int, segments: int) -> list[int]:
    """Most differing bits in the first 1, 2, ... segments of a chain: the proportional share of ``distance``."""
    return [length * distance // segments for length in range(1, segments + 1)]


def _bits(value: int) -> Column:
    return F.lit(value - (1 << BITS) if value >> (BITS - 1) else value).cast("long")


def links(prints: DataFrame, distance: int = 2, segments: int = 8) -> DataFrame:
    """Edges ``(a, b)``: all pairs of fingerprints that differ in ``distance`` or fewer bits, some of them repeatedly.

    ``prints`` has distinct signed fingerprints in ``fp``. The fingerprint is a ring of ``segments``
    equal segments. By the pigeonring principle a pair within the distance has a start from which
    every prefix of the chain of following segments stays within its proportional budget. Fingerprints
    that share no prefix of budget zero with another leave first. The longest prefix of budget one is
    the join key: one side announces its prefix and every prefix with one more bit set past the part of
    budget zero, the other stands under its own, so a pair meets exactly if its prefixes differ in one
    bit at most there. The longer prefixes filter inside the join, before the full Hamming distance.
    A key holds only fingerprints that differ in the rest of the ring (8 bits for the defaults), so its
    size doesn't grow with the table and no bucket is hot, whatever the copies.
    """
    if distance == 0:
        return prints.select(F.col("fp").alias("a"), F.col("fp").alias("b")).limit(0)
    if BITS % segments or distance >= segments:
        raise ValueError("segments must divide 64 and exceed the distance")
    width, budgets = BITS // segments, _budgets(distance, segments)
    exact, near = (sum(b <= most for b in budgets) * width for most in (0, 1))
    turned = [
        F.struct(F.lit(i).alias("start"), (F.shiftrightunsigned("fp", i * width).bitwiseOR(F.shiftleft("fp", BITS - i * width)) if i else F.col("fp")).alias("ring"))
        for i in range(segments)
    ]
    keys = prints.select("fp", F.explode(F.array(*turned)).alias("t")).select("fp", "t.start", "t.ring", F.col("t.ring").bitwiseAND(_bits((1 << exact) - 1)).alias("key"))
    shared = keys.groupBy("start", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    prefix = F.col("ring").bitwiseAND(_bits((1 << near) - 1))
    rings = saved(keys.join(shared, ["start", "key"]).select("start", "fp", "ring", prefix.alias("prefix")), "simhash_rings")

    more = [F.when(F.col("ring").bitwiseAND(_bits(1 << i)) == 0, F.col("prefix").bitwiseOR(_bits(1 << i))) for i in range(exact, near)]
    points = F.explode(F.array(F.col("prefix"), *more)).alias("point")
    left = rings.select("start", F.col("fp").alias("a"), F.col("ring").alias("ring_a"), F.col("prefix").alias("own"), points).where("point is not null")
    right = rings.select("start", F.col("fp").alias("b"), F.col("ring").alias("ring_b"), "prefix")
    differs = F.col("ring_a").bitwiseXOR(F.col("ring_b"))
    chain = (F.col("point") != F.col("own")) | (F.col("a") < F.col("b"))
    for length, budget in enumerate(budgets, 1):
        if length * width > exact:
            chain = chain & (F.bit_count(differs.bitwiseAND(_bits((1 << length * width) - 1))) <= budget)
    on = (left["start"] == right["start"]) & (left["point"] == right["prefix"]) & chain
    return left.join(right, on).select("a", "b")


def simhash_groups(docs: DataFrame, distance: int = 2, shingle: int = 3, segments: int = 8, salts: int = 32) -> DataFrame:
    """One row per row of ``docs``: doc_id, key (:func:`row_key`), fingerprint (16 hex digits), component_id.

    Equal fingerprints
    form one class before any search, so copies cost one row each; components run over the classes
    that have a link. component_id is the smallest doc_id of the component. Null and empty texts have
    fingerprint zero and link like any other; null doc_ids belong to their component but never name
    it unless it has no other. An empty table gives an empty result; other columns are not read.
    """
    raw = F.coalesce(F.col("text"), F.lit(""))
    prints = saved(
        docs.select("doc_id", row_key().alias("key"), fingerprint(raw, shingle).alias("fp")).withColumn(
            "salt", F.pmod("key", F.lit(salts)).cast("int")
        ),
        "simhash",
    )
    by_salt = prints.groupBy("fp", "salt").agg(F.min("doc_id").alias("first"))
    classes = saved(by_salt.groupBy("fp").agg(F.min("first").alias("first"), F.collect_list("salt").alias("salts")), "simhash_classes")
    parts = connected_components(links(classes.select("fp"), distance, segments), "a", "b")
    joined = classes.join(parts.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    firsts = joined.groupBy("component").agg(F.min("first").alias("component_id"))
    named = joined.join(firsts, "component").select("fp", "component_id", F.explode("salts").alias("salt"))
    return prints.join(named, ["fp", "salt"]).select(
        "doc_id", "key", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


def simhash_dedup(docs: DataFrame, **options) -> DataFrame:
    """Rows of ``docs``, all columns, with one document of each component: the one with the smallest doc_id, once if its row repeats."""
    groups = saved(simhash_groups(docs, **options).select("key", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept")), "simhash_groups")
    repeated = groups.where("kept").groupBy("key", "kept").count().where("count > 1").select("key", "kept")
    return settle(docs, saved(groups.where("not kept").unionByName(repeated), "simhash_decided"))
