"""The thin queries of the corpus operators, and SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bidlake.llm import dedup, mixing, packing, quality_cnn, quality_rules, resample, search, shards, simhash, tokencount, toxicity, urls, warc
from bidlake.llm.labelled import id_remainder


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")


def op1_warc_capture_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return warc.archive_round_trip(pages, payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op4_sampled_splitters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.shard_by_bytes(_documents(spark, sf_dir))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.exact_dedup(_documents(spark, sf_dir)).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


OP9_SQL = r"""
with n as (select doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') as t from documents),
g as (select t, min(doc_id) as keep_id, count(*) as group_size from n group by t)
select doc_id, keep_id, group_size, doc_id = keep_id as kept, sha256(t) as text_sha256 from n join g using (t)
"""


def op10_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_groups(_documents(spark, sf_dir)).select("doc_id", "fingerprint", "component_id")


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def op2_toxicity_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    scored = toxicity.toxicity_scores(docs, toxicity.train(docs, _labels(spark, sf_dir)), "doc_id")
    return scored.select("doc_id", (id_remainder(F.col("doc_id"), 5) == 0).alias("held_out"), "score", "predicted")


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_documents(spark, sf_dir), with_ids=False)


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.token_counts(_documents(spark, sf_dir))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    return quality_rules.apply_rules(docs, *quality_rules.train(docs, _labels(spark, sf_dir)))


def op7_quality_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    scored = quality_cnn.score_quality(docs, quality_cnn.train(docs, _labels(spark, sf_dir)))
    return scored.select("doc_id", (id_remainder(F.col("doc_id"), 3) == 1).alias("held_out"), "score", "predicted")


def op8_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source", "lang")
    return mixing.mix(docs).drop("key", "text_key")


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = resample.importance_scores(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return scored.select("doc_id", "n_features", "weight", "score", "rank")


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    return search.ranked_search(_documents(spark, sf_dir), items)


_TERMS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
OP12_SQL = f"""
with d as (select doc_id, {_TERMS} as t from documents), c as (select count(*)::bigint as docs, sum(len(t))::bigint as total from d where len(t) > 0),
tf as (select doc_id, n, term, count(*) as tf from (select doc_id, len(t)::bigint as n, unnest(t) as term from d) group by all),
i as (select distinct item_id, unnest({_TERMS}) as term from benchmark),
w as (select term, floor(1000 * ln((2 * docs + 2)::double / (2 * df + 1)::double))::bigint as w from (select term, count(*) as df from tf group by 1), c),
s as (select item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + ((90 * n * docs) // total)))))::bigint as score from i join w using (term) join tf using (term), c group by all)
select item_id, rank::integer as rank, doc_id, score from (select *, row_number() over (partition by item_id order by score desc, doc_id) as rank from s where score > 0) where rank <= 10
"""


def op13_url_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    judged = urls.filter_urls(pages, urls.train(pages, urls.rule_labels(pages)))
    return judged.select("page_id", "host", "path", "rule", "verdict")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    f.__name__: f
    for f in (
        op1_warc_capture_index, op2_toxicity_kneser_ney, op3_best_fit_packing, op4_sampled_splitters, op5_token_counts,
        op6_quality_rules, op7_quality_cnn, op8_mixture, op9_exact_dedup, op10_simhash_groups, op11_importance_resampling,
        op12_ranked_search, op13_url_trees, pipeline,
    )
}
ORACLES = {"op9_exact_dedup": OP9_SQL, "op12_ranked_search": OP12_SQL}
