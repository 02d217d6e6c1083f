import random
import re
import zlib
from collections import Counter
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from bidlake.llm import quality_cnn, quality_rules, toxicity
from bidlake.llm.labelled import fit_logistic, id_remainder, labelled_sample
from bidlake.llm.queries import op2_toxicity_kneser_ney, op7_quality_cnn

DATA = "/root/testdata/sf0.01"


def corpus(n=600, seed=1):
    rng = random.Random(seed)
    words = [f"{a}{b}" for a in "bcdfgh" for b in ("ana", "ero", "ilu", "oti", "ude")]
    rows = []
    for i in range(n):
        text = [rng.choice(words) for _ in range(rng.randint(5, 60))]
        toxic = i % 4 == 0
        if toxic:
            for _ in range(3):
                text[rng.randrange(len(text))] = rng.choice(["scoundrel", "fool", "vile"])
        rows.append((i, " ".join(text), int(toxic)))
    return rows


def test_models_catch_held_out_toxic_documents(spark):
    rows = corpus() + [(10_000, None, 0), (10_001, "", 0), (10_002, "x" * 300_000, 0), (None, "fool vile fool", 1)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows] + [(999_999, 1), (3, None)], "doc_id long, toxic int")
    models = toxicity.train(docs, labels)
    found = {r.doc_id: r for r in toxicity.score_toxicity(docs, models).collect()}
    got = pd.DataFrame([found[r[0]] for r in rows], columns=["doc_id", "text", "score", "predicted"])
    assert len(found) == len(rows) and got["score"].between(0, 1).all()
    held = [zlib.crc32(str(r[0]).encode()) % 5 == 0 for r in rows]
    truth = np.array([r[2] for r in rows])
    assert (got["predicted"].to_numpy() == truth)[np.array(held)].mean() > 0.97
    assert got["predicted"].iloc[-4:-1].tolist() == [0, 0, 0] and got["predicted"].iloc[-1] == 1
    kept = toxicity.without_toxic(docs.withColumn("score", F.lit("mine")), labels)
    assert kept.columns == ["doc_id", "text", "score"] and kept.first()["score"] == "mine"
    assert kept.count() == (got["predicted"] == 0).sum()


def test_held_out_labels_change_nothing(spark):
    rows = corpus(300)
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    turned = labels.withColumn("toxic", F.when(id_remainder(F.col("doc_id"), 5) == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    scores = [{r.doc_id: r.score for r in toxicity.score_toxicity(docs, toxicity.train(docs, x)).collect()} for x in (labels, turned)]
    assert scores[0] == scores[1] and len(scores[0]) == len(rows)


def test_models_equal_brute_force_and_sum_to_one(spark):
    rng = random.Random(3)
    words = {"".join(rng.choice("abcé") for _ in range(rng.randint(1, 11))): [rng.randint(1, 9), rng.randint(0, 5), rng.randint(0, 3)] for _ in range(60)}
    table = spark.createDataFrame([(w, *n) for w, n in words.items()], "word string, n long, n0 long, n1 long")
    got = {r.gram: (r.shared, r.p0, r.p1) for r in toxicity.class_models(table, 1.0, 20.0).collect()}

    top = Counter(), Counter(), Counter()
    for w, n in words.items():
        s = f"^{w}$"
        for i in range(1, len(s)):
            for k in range(3):
                top[k][s[max(0, i - 7) : i + 1]] += n[k]
    back = lambda h: h[len(h) - max(x for x in (4, 2, 0) if x < len(h)) :]
    counts = Counter(top[0])
    for k in range(7, 0, -1):
        for g in [g for g in counts if len(g) == k + 1]:
            counts[(back(g[:-1]) if k not in (1, 2) else "") + g[-1]] += 1
    letters = {g[-1] for g in counts}

    def shared(h, x):
        own = {y: counts[h + y] for y in letters if counts[h + y]}
        below = 1 / (len(letters) + 1) if not h else shared(back(h) if len(h) > 2 else "", x)
        kept = sum(max(n - 0.75, 0) for n in own.values())
        return (max(own.get(x, 0) - 0.75, 0) + (sum(own.values()) - kept) * below) / sum(own.values())

    def of_class(k, h, x):
        own = [top[k][h + y] for y in letters]
        free = sum(n - max(n - 1, 0) for n in own) + 20
        return (max(top[k][h + x] - 1, 0) + free * shared(h, x)) / (sum(own) + 20)

    assert set(got) == set(top[0])
    for g, (s, p0, p1) in got.items():
        assert np.allclose([s, p0, p1], [shared(g[:-1], g[-1]), of_class(1, g[:-1], g[-1]), of_class(2, g[:-1], g[-1])])
    for h in {g[:-1] for g in got}:
        for p in (shared, lambda h, x: of_class(1, h, x), lambda h, x: of_class(2, h, x)):
            unseen = p(h, "~")  # one letter that was never seen
            assert abs(sum(p(h, x) for x in letters) + unseen - 1) < 1e-9
    grams = toxicity.telling_grams(toxicity.class_models(table, 1.0, 20.0), 0.05)
    ratio = {w: [np.log(got[g][2] / got[g][1]) for g in (f"^{w}$"[max(0, i - 7) : i + 1] for i in range(1, len(w) + 2))] for w in words}
    ratio = {w: sum(x for x in r if abs(x) > 0.05) for w, r in ratio.items()}
    keys = {r.word: r.key for r in table.select("word", F.xxhash64("word").alias("key")).collect()}
    found = {r.key: r.evidence for r in toxicity.telling_words(table, grams, 0.2).collect()}
    want = {keys[w]: np.sign(r) * (abs(r) - 0.2) for w, r in ratio.items() if abs(r) > 0.2}
    assert found.keys() == want.keys() and len(want) > 5 and all(abs(found[k] - want[k]) < 1e-9 for k in want)


def test_trains_without_labels_or_with_one_class(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string")
    for labels in ([], [(1, 0), (2, 0)]):
        table = spark.createDataFrame(labels, "doc_id long, toxic int").withColumn("quality", F.col("toxic"))
        assert toxicity.score_toxicity(docs, toxicity.train(docs, table)).count() == 2
        assert quality_cnn.score_quality(docs, quality_cnn.train(docs, table)).count() == 2
        assert quality_rules.apply_rules(docs, *quality_rules.train(docs, table)).count() == 2


def test_sample_is_bounded_and_joins_each_id_once(spark):
    docs = spark.createDataFrame([(i, f"t{i}") for i in range(50)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(50)] + [(4, 1), (4, 1)], "doc_id long, y int")
    rows, population = labelled_sample(docs, labels, "y", F.lit(True), 10)
    assert rows.groupBy("label").count().orderBy("label").collect() == [(0, 10), (1, 10)]
    assert population == {0: 24, 1: 26}


def test_logistic_weights_classes():
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(0, 1, (500, 1)), rng.normal(2, 1, (500, 1))])
    y = np.repeat([0, 1], 500)
    even, rare = fit_logistic(x, y, {0: 1, 1: 1}), fit_logistic(x, y, {0: 90, 1: 10})
    assert abs(even[0] - 2) < 0.4 and rare[1] < even[1] - 1.5


def test_registered_scores_on_the_given_tables(spark):
    truth = spark.read.parquet(f"{DATA}/labels.parquet").toPandas().set_index("doc_id")
    for query, label, folds, held, least in ((op2_toxicity_kneser_ney, "toxic", 5, 0, 0.93), (op7_quality_cnn, "quality", 3, 1, 0.93)):
        got = query(spark, DATA).toPandas()
        assert len(got) == 1000 and got["score"].between(0, 1).all() and ((got["score"] >= 0.5) == got["predicted"]).all()
        assert (got["held_out"] == [zlib.crc32(str(i).encode()) % folds == held for i in got["doc_id"]]).all()
        own = got[got["held_out"]].set_index("doc_id").join(truth, how="inner")
        assert (own["predicted"] == own[label]).mean() >= least


def test_network_sees_the_whole_document_and_slabs_agree(monkeypatch):
    rng = np.random.default_rng(2)
    net = quality_cnn.Network(rng.normal(size=(5, 256, 4)).astype("f4"), np.zeros(4, "f4"), rng.normal(size=9).astype("f4"), np.array([1.0, 0.0]))
    data = rng.integers(0, 256, 3000).astype(np.uint8)
    whole = net.halves(data)
    slow = []
    padded = np.concatenate([data, np.zeros(4, np.uint8)])
    for lo in range(0, 3000, quality_cnn.HALF):
        z = [sum(net.filters[k][padded[i + k]] for k in range(5)) for i in range(lo, min(lo + quality_cnn.HALF, 3000))]
        slow.append(np.maximum(np.max(z, axis=0), 0))
    assert np.allclose(whole, slow, atol=1e-4)
    monkeypatch.setattr(quality_cnn, "_SLAB", 2 * quality_cnn.HALF)
    assert np.allclose(net.halves(data), whole, atol=1e-5)
    assert net.logit("a" * 2000) != net.logit("a" * 1999 + "#") and np.isfinite([net.logit(None), net.logit(""), net.logit("é")]).all()


def slow_base(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    inside = {i + j for i, w in enumerate(windows) if windows.count(w) > 1 for j in range(5)}
    return {"n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": sum(c in "#*$%&|<>" for c in text), "n_dup_lines": sum(x in lines[:i] for i, x in enumerate(lines)), "n_repeat_words": len(inside)}


def test_base_counts_brute_force():
    rng = random.Random(3)
    texts = [None, "", " \n\t", "a\n\na\n \n a", "é# *|<> $%&", "x " * 40, "a b c d e a b c d e", "a a a a a a a"]
    texts += [" ".join(rng.choice(["a", "b", "c\n", "#", "\n", "d\n"]) for _ in range(rng.randint(0, 60))) for _ in range(200)]
    for text in texts:
        assert quality_rules.base_counts(text) == slow_base(text), text


def test_viterbi_brute_force():
    rng = np.random.default_rng(4)
    for n in range(1, 8):
        emit, move = rng.normal(size=(n, 2)), rng.normal(size=(2, 2))
        score = lambda path, emit=emit, move=move: sum(emit[i, k] for i, k in enumerate(path)) + sum(move[a, b] for a, b in zip(path, path[1:], strict=False))
        assert tuple(quality_rules.viterbi(emit, move)) == max(product((0, 1), repeat=n), key=score)
    assert len(quality_rules.viterbi(np.zeros((0, 2)), np.zeros((2, 2)))) == 0


def test_crf_learns_lines_and_context():
    rng = np.random.default_rng(5)
    lines, labels = [], []
    for _ in range(150):
        y = np.repeat(rng.integers(0, 2, 4), 8)
        x = np.zeros((32, len(quality_rules.FEATURES)), "f4")
        x[:, 0] = 1
        x[:, 2] = rng.random(32) < np.where(y == 1, 0.25, 0.75)
        lines.append(x)
        labels.append(y)
    emit_w, move = quality_rules.fit_crf(lines, labels)
    assert move[0, 0] + move[1, 1] > move[0, 1] + move[1, 0] and emit_w[2, 0] > emit_w[2, 1]
    right = np.mean([(quality_rules.viterbi(x @ emit_w, move) == y).mean() for x, y in zip(lines, labels, strict=True)])
    alone = np.mean([((x[:, 2] == 0) == y).mean() for x, y in zip(lines, labels, strict=True)])
    assert right > alone + 0.03


def test_latent_lines_mix_within_documents():
    rng = random.Random(6)
    prose = lambda: " ".join(rng.choice(["stone", "river", "of", "walking", "green"]) for _ in range(rng.randint(9, 18))) + "."
    menu = lambda: " | ".join(rng.choice(["home", "shop", "help", "news"]) for _ in range(rng.randint(3, 7)))
    texts = []
    for i in range(400):
        kinds = [1] * rng.randint(6, 9) + [0] * rng.randint(0, 3) if i % 2 else [0] * rng.randint(6, 9) + [1] * rng.randint(0, 2)
        rng.shuffle(kinds)
        texts.append((kinds, "\n".join(prose() if k else menu() for k in kinds), i % 2))
    parts = [quality_rules.line_features(t) for _, t, _ in texts]
    emit_w, move = quality_rules.fit_latent([x for x, _ in parts[:200]], [n for _, n in parts[:200]], [y for *_, y in texts[:200]])
    paths = [quality_rules.viterbi(x @ emit_w, move) for x, _ in parts[200:]]
    right = np.concatenate([p == np.array(k) for p, (k, *_) in zip(paths, texts[200:], strict=True)])
    assert right.mean() > 0.95  # the lines' kinds are never shown, only the documents' labels
    mixed = np.mean([len(set(p)) == 2 for p, (k, *_) in zip(paths, texts[200:], strict=True) if len(set(k)) == 2])
    assert mixed > 0.9
    for x, n in parts[:50]:
        for label in (0, 1):
            y = quality_rules._settled(x @ emit_w, move, n, label, 0.5)
            assert (n[y == 1].sum() >= 0.5 * n.sum()) == (label == 1)


def test_training_takes_long_documents_in_runs_and_no_rows(spark):
    long = "\n".join(" ".join(f"word{i}x{k}" for k in range(11)) for i in range(1000))
    docs = spark.createDataFrame([(1, long, "x"), (2, "a | b | c", "y"), (None, None, "z")], "doc_id long, text string, kept string")
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int")
    sample, _ = quality_rules.labelled_sample(docs, labels, "quality", F.lit(True), 10)
    runs = quality_rules.training_sequences(sample, 64).where("label = 1").collect()
    assert sorted(r["at"] for r in runs) == list(range(0, 1000, 64)) and sum(len(r["words"]) // 8 for r in runs) == 1000
    rules = quality_rules.train(docs, labels)
    assert {r.doc_id: r.kept for r in quality_rules.apply_rules(docs, *rules).collect()} == {1: True, 2: False, None: False}
    empty = docs.where("false")
    assert quality_rules.apply_rules(empty, *quality_rules.train(empty, labels.where("false"))).count() == 0


def test_rules_on_the_given_tables(spark):
    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    extra = spark.createDataFrame([(None, "null id " * 12), (5_000_000, None), (5_000_001, "")], "doc_id long, text string")
    rules = quality_rules.train(docs, labels)
    got = quality_rules.apply_rules(docs.select("doc_id", "text").union(extra), *rules).toPandas()
    assert len(got) == 1003 and got["doc_id"].isna().sum() == 1
    assert got["base_failed"].equals((got["n_words"] < 10) | (100 * got["n_repeat_words"] > 20 * got["n_words"]))
    assert not (got["kept"] & got["base_failed"]).any()
    known = got.merge(labels.toPandas(), on="doc_id")
    passed = known[~known["base_failed"]]
    assert passed[passed["quality"] == 1]["kept"].mean() > 0.98 and passed[passed["quality"] == 0]["kept"].mean() < 0.1
    again = quality_rules.apply_rules(docs, *rules).where("doc_id < 50").collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in again:
        assert {k: getattr(r, k) for k in slow_base("")} == slow_base(texts[r.doc_id])


def test_counts_take_every_document(spark):
    rows = [(i, text + (" vile fool" if y else " vile day"), y) for i, text, y in corpus(400)]
    docs = spark.createDataFrame([r[:2] for r in rows] + [(1000, "only HERE here unlabelled"), (1001, None), (1002, "y" * 200)], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    wide, narrow = (toxicity.train(docs, labels, per_class=n) for n in (12_000, 40))
    assert sorted(wide.grams.collect()) == sorted(narrow.grams.collect()) and sorted(wide.words.collect()) == sorted(narrow.words.collect())
    want = Counter()
    for r in docs.collect():
        want.update(set(re.findall(r"\w{1,64}", (r.text or "").lower())))
    learn = docs.join(labels.withColumnRenamed("toxic", "label"), "doc_id")
    got = toxicity.word_counts(docs, learn).collect()
    assert {r.word: r.n for r in got} == dict(want) and all(r.n >= r.n0 + r.n1 for r in got)
    by_label = [Counter(), Counter()]
    for r in learn.collect():
        by_label[r.label].update(set(re.findall(r"\w{1,64}", r.text.lower())))
    assert all((r.n0, r.n1) == (by_label[0][r.word], by_label[1][r.word]) for r in got)


def test_evidence_equals_brute_force_and_repeats_are_alike(spark):
    rows = [(i, text + (" vile fool" if y else " vile day"), y) for i, text, y in corpus(400)]
    docs = spark.createDataFrame([r[:2] for r in rows] + [rows[0][:2]] * 3 + [(None, "fool"), (500, None)], "doc_id long, text string")
    models = toxicity.train(docs, spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int"))
    keys = {r.word: r.key for r in docs.select(F.explode(F.split(F.lower("text"), " ")).alias("word")).distinct().select("word", F.xxhash64("word").alias("key")).collect()}
    listed = {r.key: r.evidence for r in models.words.collect()}
    got = toxicity.evidence(docs, models, "doc_id", "text").collect()
    assert len(got) == len(rows) + 5 and listed
    for r in got:
        words = re.findall(r"\w{1,64}", (r.text or "").lower())
        mean = sum(listed.get(keys[w], 0) for w in words) / max(len(words), 1)
        assert abs(r.x - np.sign(mean) * abs(mean) ** 0.5) < 1e-9
    kept = toxicity.without_toxic(docs, spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int"))
    flagged = {(r.doc_id, r.text) for r in toxicity.score_toxicity(docs, models).where("predicted = 1").collect()}
    assert sorted(map(str, ((r.doc_id, r.text) for r in kept.collect()))) == sorted(str((r.doc_id, r.text)) for r in docs.collect() if (r.doc_id, r.text) not in flagged)


def test_network_learns_from_long_documents_in_slabs(spark):
    rng = random.Random(8)
    text = lambda good, n: " ".join(rng.choice(["calm", "river", "stone"] if good else ["zzz#", "qq$q", "x*x"]) for _ in range(n))
    docs = spark.createDataFrame([(i, text(i % 2, 400)) for i in range(120)] + [(500, None), (501, ""), (502, text(1, 60_000))], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(120)], "doc_id long, quality int")
    # Every labelled document is longer than the limit, so all of them enter in slabs.
    net = quality_cnn.train(docs, labels, max_bytes=1000, epochs=3)
    scored = {r.doc_id: r for r in quality_cnn.score_quality(docs.withColumns({"Score": F.lit("mine"), "lang": F.lit("x")}), net).collect()}
    assert len(scored) == 123 and sum(scored[i].predicted == i % 2 for i in range(120)) >= 118 and scored[502].predicted == 1
    assert set(scored[0].asDict()) == {"doc_id", "text", "lang", "score", "predicted"}
    assert quality_cnn.score_quality(docs.limit(0), net).count() == 0
