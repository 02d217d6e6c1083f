import random
import re

import xxhash
from pyspark.sql import functions as F

from bidlake.llm.simhash import links, simhash_dedup, simhash_groups, text_fingerprint


def slow_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    parts = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(prints, distance):
    label = list(range(len(prints)))
    for i, a in enumerate(prints):
        for j in range(i):
            if (a ^ prints[j]).bit_count() <= distance:
                old, new = label[i], label[j]
                label = [new if x == old else x for x in label]
    return label


def corpus(seed=3):
    rng = random.Random(seed)
    words = ["w%d" % i for i in range(400)]
    texts = [None, "", " \t", "one", "one two", "One\x0bTWO", "É é", "x y z", "long " * 70_000]
    for _ in range(25):
        base = [rng.choice(words) for _ in range(rng.randint(30, 400))]
        for _ in range(4):
            copy = list(base)
            if rng.random() < 0.8:
                copy[rng.randrange(len(copy))] = "changed"
            texts.append(" ".join(copy))
    return list(enumerate(texts))


def test_brute_force(spark):
    rows = corpus() + [(None, "one"), (None, "a lonely text of null id"), (3, "one")]
    prints = [slow_fingerprint(t) for _, t in rows]
    label = components(prints, 2)
    want = []
    for (i, _), p, own in zip(rows, prints, label, strict=True):
        want.append((i, f"{p:016x}", min((j for (j, _), x in zip(rows, label, strict=True) if x == own and j is not None), default=None)))
    got = simhash_groups(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "fingerprint", "component_id")
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    assert sum(a != b for a, _, b in want) > 5


def test_long_text_in_steps(monkeypatch):
    from bidlake.llm import simhash

    text = " ".join(str(i * 7919 % 1000) for i in range(500))
    monkeypatch.setattr(simhash, "_STEP", 64)
    assert text_fingerprint(text) % (1 << 64) == slow_fingerprint(text)


def test_links_are_complete_for_every_bucket_size(spark):
    rng = random.Random(5)
    prints = set()
    for _ in range(12):
        base = rng.getrandbits(64)
        prints |= {base ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 3))) for _ in range(12)}
    hot = rng.getrandbits(64)
    prints |= {hot ^ (rng.getrandbits(4) << 40) ^ (1 << rng.randrange(40, 60)) for _ in range(60)}
    prints = sorted(prints)
    signed = [(p - (1 << 64) if p >> 63 else p,) for p in prints]
    table = spark.createDataFrame(signed, "fp long")
    for distance, segments in ((2, 8), (2, 4), (3, 8), (1, 4), (4, 16)):
        want = components(prints, distance)
        edges = [(a % (1 << 64), b % (1 << 64)) for a, b in links(table, distance, segments).collect()]
        assert {(min(e), max(e)) for e in edges} == {(a, b) for a in prints for b in prints if a < b and (a ^ b).bit_count() <= distance}
        got = {p: p for p in prints}

        def root(x, got=got):
            while got[x] != x:
                x = got[x]
            return x

        for a, b in edges:
            got[root(a)] = root(b)
        same = lambda labels: {tuple(labels.index(x) for x in labels)}
        assert same([root(p) for p in prints]) == same(want)


def test_dedup_keeps_one_of_each_group_and_all_columns(spark):
    docs = spark.createDataFrame([(2, "a b c d", "x"), (1, "a b c d", "y"), (3, None, "z"), (4, "", "q"), (None, "other words here", "n"), (2, "quite different text", "t"), (5, "two rows alike", "r"), (5, "two rows alike", "r")], "doc_id long, text string, fingerprint string")
    out = simhash_dedup(docs)
    assert out.columns == docs.columns
    assert sorted(r.fingerprint for r in out.collect()) == ["n", "r", "t", "y", "z"]


def test_empty(spark):
    assert simhash_groups(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_hot_copies(spark):
    docs = spark.range(2000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, F.lit("hot text of copies")).otherwise(F.concat_ws(" ", *[F.xxhash64("id", F.lit(i)).cast("string") for i in range(30)])).alias("text"))
    assert simhash_groups(docs).where("component_id = 0").count() == 667
