import corpus_pipeline
from bidlake.llm import mixing, simhash, toxicity

DATA = "/root/testdata/sf0.001"


def norm(text):
    import re

    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    outs, now = {}, docs
    for name, stage in corpus_pipeline.STAGES:
        now = corpus_pipeline.saved(stage(spark, now, DATA), name)
        outs[name] = now
    rows = {n: {r.doc_id: r for r in d.collect()} for n, d in outs.items() if n != "packing"}
    for d in list(outs.values())[:-1]:
        assert d.columns == docs.columns
    scores = {r.doc_id: r.predicted for r in toxicity.score_toxicity(docs, toxicity.train(docs, labels)).collect()}
    assert set(rows["toxicity"]) == {i for i, p in scores.items() if p == 0}
    first = {}
    for i in sorted(rows["toxicity"]):
        first.setdefault(norm(rows["toxicity"][i].text), i)
    assert set(rows["exact_dedup"]) == set(first.values())
    prints = {i: simhash.text_fingerprint(r.text) for i, r in rows["exact_dedup"].items()}
    label = {i: i for i in prints}
    for a in sorted(prints):
        for b in prints:
            if a < b and ((prints[a] ^ prints[b]) % (1 << 64)).bit_count() <= 2:
                lo, hi = sorted((label[a], label[b]))
                label = {i: lo if x == hi else x for i, x in label.items()}
    assert set(rows["simhash_dedup"]) == set(label.values())
    kept = {r.doc_id for r in mixing.mix(outs["simhash_dedup"]).where("kept").collect()}
    assert set(rows["mixture"]) == kept
    packed = outs["packing"].collect()
    assert {r.doc_id for r in packed} == kept
    at = {}
    for r in sorted(packed, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == at.get(r.sequence_id, 0)
        at[r.sequence_id] = r.offset + r.length
    assert max(at.values()) <= 2048


def test_run_and_extra_columns(spark, tmp_path):
    assert corpus_pipeline.run(spark, DATA).count() > 100
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long, score string")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, DATA)
        assert docs.count() == 0
