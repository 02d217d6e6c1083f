"""Toxicity from class-conditional Kneser-Ney language models of words by their letters."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bidlake.functions.shared import saved
from bidlake.llm.labelled import fit_logistic, id_remainder, labelled_sample
from bidlake.llm.rows import bitmap, marked, may_hold, row_key, settle
from bidlake.llm.tokens import forget

#: Longer runs of letters are cut into words of 64.
_WORD = re.compile(r"\w{1,64}")
_GRAM = 8
#: Texts counted together before their words leave the task.
_AT_ONCE = 4096
#: Lengths of the grams that back off to one length: 7, 4, 2 and 0 letters of context.
_BANDS = ((6, 8, 5), (4, 5, 3), (2, 3, 1))


def words_of(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


@dataclass
class Models:
    """The class models as tables of any size, and the calibration."""

    grams: DataFrame  # key, ratio: the telling grams
    words: DataFrame  # key, evidence: the telling words of the documents learnt from
    weights: np.ndarray


def word_counts(docs: DataFrame, learn: DataFrame) -> DataFrame:
    """word, n, n0, n1: in how many texts of ``docs``, and of ``learn`` (text, label) by label, each word stands.

    Whole texts, counted in each batch before the shuffle.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            for lo in range(0, batch.num_rows, _AT_ONCE):
                part = batch.slice(lo, _AT_ONCE)
                seen = {-1: Counter(), 0: Counter(), 1: Counter()}
                for text, label in zip(part.column(0), part.column(1).to_pylist(), strict=True):
                    seen[label].update(set(words_of(text.as_py())))
                words = list(set().union(*seen.values()))
                yield pa.RecordBatch.from_pydict({"word": pa.array(words, pa.string())} | {c: pa.array([seen[k][w] for w in words], pa.int64()) for c, k in (("n", -1), ("n0", 0), ("n1", 1))})

    texts = docs.select("text", F.lit(-1).alias("label")).unionAll(learn.select("text", "label"))
    return texts.mapInArrow(count, "word string, n long, n0 long, n1 long").groupBy("word").agg(*[F.sum(c).alias(c) for c in ("n", "n0", "n1")])


def grams_of(words: DataFrame) -> DataFrame:
    """``words`` with a row for each letter (and the word's end): the letter after up to seven before it, ``^`` first and ``$`` last."""
    padded = F.concat(F.lit("^"), F.col("word"), F.lit("$"))
    each = F.transform(F.sequence(F.lit(2), F.length(padded)), lambda i: padded.substr(F.greatest(i - _GRAM + 1, F.lit(1)), F.least(i, F.lit(_GRAM))))
    return words.select("*", F.explode(each).alias("gram"))


def _suffix(length: int) -> Column:
    return F.substring("gram", -length, length)


def class_models(words: DataFrame, discount: float = 1.0, strength: float = 20.0, shared_discount: float = 0.75) -> DataFrame:
    """gram, shared, p0, p1: the probability of a gram's last letter after the others, shared and by class.

    ``words`` has their counts n (all documents), n0 and n1 (texts of each class). The shared model is
    interpolated Kneser-Ney: grams at a word's beginning and the longest ones count texts, shorter ones
    count the distinct longer grams that end in them, each level interpolates with the one below it, and
    below single letters all seen letters and one unseen are alike. A class takes an absolute discount
    from its own count of a gram; what that frees, and ``strength`` texts more, back off to the shared
    model, so a rare expression has nearly the same probability in both. Each of the three sums to one
    over the letters that follow a context. A context has as many rows as letters follow it, so none is hot.
    """
    own = ["n", "n0", "n1"]
    top = saved(grams_of(words).groupBy("gram").agg(*[F.sum(c).alias(c) for c in own]), "toxicity_grams")
    none = F.lit(0).cast("long")
    continued = lambda rows, length: rows.groupBy(_suffix(length).alias("gram")).agg(F.count(F.lit(1)).alias("n")).select("gram", "n", none.alias("n0"), none.alias("n1"))
    bands = []
    for low, high, _ in _BANDS:
        rows = top.where(F.length("gram").between(low, high))
        bands.append(saved(rows.unionByName(continued(bands[-1], high)), "toxicity_band") if bands else rows)

    def level(rows: DataFrame, below: Column) -> DataFrame:
        context = Window.partitionBy("context")
        less = lambda c, d: F.greatest(F.col(c) - d, F.lit(0.0))
        total = lambda c: F.sum(c).over(context)
        sums = {"all": total("n"), "kept": F.sum(less("n", shared_discount)).over(context), "types": F.count(F.lit(1)).over(context)}
        sums |= {f"all{k}": total(f"n{k}") + strength for k in (0, 1)} | {f"kept{k}": F.sum(less(f"n{k}", discount)).over(context) for k in (0, 1)}
        rows = rows.withColumn("context", F.expr("substring(gram, 1, length(gram) - 1)")).withColumns(sums)
        rows = rows.withColumn("shared", (less("n", shared_discount) + (F.col("all") - F.col("kept")) * below) / F.col("all"))
        return rows.select("gram", "shared", *[((less(f"n{k}", discount) + (F.col(f"all{k}") - F.col(f"kept{k}")) * F.col("shared")) / F.col(f"all{k}")).alias(f"p{k}") for k in (0, 1)])

    model, found = level(continued(bands[-1], 1), 1 / (F.col("types") + 1)), []
    for at, (rows, (_, _, below)) in enumerate(zip(reversed(bands), reversed(_BANDS), strict=True)):
        lower = model.select(F.col("gram").alias("lower"), F.col("shared").alias("below"))
        model = level(rows.join(lower, _suffix(below) == F.col("lower")), F.col("below"))
        model = model if at == len(bands) - 1 else saved(model, "toxicity_level")
        found.append(model if at == len(bands) - 1 else model.where(F.startswith("gram", F.lit("^"))))
    return found[0].unionByName(found[1]).unionByName(found[2])


def telling_grams(models: DataFrame, least: float = 0.2) -> DataFrame:
    """key (xxhash64 of the gram), ratio: grams whose class probabilities differ by over ``least`` nats; others count as alike."""
    ratio = F.log(F.col("p1") / F.col("p0"))
    return saved(models.select(F.xxhash64("gram").alias("key"), ratio.alias("ratio")).where(F.abs("ratio") > least), "toxicity_ratios")


def _signed(key: int) -> int:
    return key - (1 << 64) if key >> 63 else key


def telling_words(words: DataFrame, grams: DataFrame, floor: float = 1.5) -> DataFrame:
    """key (xxhash64 of the word), evidence: what a word's log-likelihood ratio exceeds ``floor`` by, in either direction.

    The ratio sums up the word's telling grams. Words of smaller ratios differ by chance as a rule and are not listed.
    A bitmap of the grams keeps others out of the join.
    """
    held = words.sparkSession.sparkContext.broadcast(bitmap(grams.select("key")))

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh64_intdigest as digest

        for batch in batches:
            texts = [f"^{w}$" for w in batch.column(0).to_pylist()]
            found = np.array([digest(s[max(0, i - _GRAM + 1) : i + 1].encode(), 42) for s in texts for i in range(1, len(s))], np.uint64).view(np.int64)
            word = np.repeat([_signed(digest(s[1:-1].encode(), 42)) for s in texts], [len(s) - 1 for s in texts])
            may = marked(found, held.value)
            yield pa.RecordBatch.from_pydict({"word": pa.array(word[may], pa.int64()), "key": pa.array(found[may], pa.int64())})

    hits = words.select("word").mapInArrow(asked, "word long, key long").join(grams, "key")
    ratio = hits.groupBy(F.col("word").alias("key")).agg(F.sum("ratio").alias("ratio"))
    return saved(ratio.where(F.abs("ratio") > floor).select("key", (F.signum("ratio") * (F.abs("ratio") - floor)).alias("evidence")), "toxicity_words")


def labelled_rows(docs: DataFrame, labels: DataFrame, label: str, usable: Column) -> DataFrame:
    """text and label of all labelled documents, equal texts of a label once.

    Which rows they are is found by hashes; a bitmap of those keeps all other texts out of the join.
    """
    known = labels.where(usable & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(label).cast("int").alias("label")).where("label in (0, 1)")
    rows = docs.select("doc_id", row_key().alias("key"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("h"), F.octet_length("text").alias("n"))
    first = saved(rows.join(known, "doc_id").groupBy("label", "h", "n").agg(F.min("key").alias("key")).select("key", "label"), "toxicity_known")
    may = may_hold(docs, bitmap(first.select("key")), F.col("key"))
    once = docs.select(row_key().alias("key"), "text").where(may).join(first, "key")
    return once.dropDuplicates(["key", "label"]).select("text", "label")


def train(
    docs: DataFrame, labels: DataFrame, label: str = "toxic", folds: int = 5, per_class: int = 12_000, discount: float = 1.0, strength: float = 20.0, least: float = 0.2, floor: float = 1.5
) -> Models:
    """Learns from labelled rows whose id remainder modulo ``folds`` is not 0.

    Remainders below ``folds`` - 1 give the class counts, all of them; the last one calibrates, with at
    most ``per_class`` documents of each class. A word counts once a document, so neither a repeated line
    nor a group of copies (equal texts enter once) dominates. The shared counts come from all documents.
    Words, grams and levels are tables of any size; only the calibration sample reaches the driver.
    """
    fold = id_remainder(F.col("doc_id"), folds)
    words = saved(word_counts(docs, labelled_rows(docs, labels, label, (fold != 0) & (fold != folds - 1))), "toxicity_vocabulary")
    grams = telling_grams(class_models(words, discount, strength), least)
    models = Models(grams, telling_words(words, grams, floor), np.zeros(2))
    sample, population = labelled_sample(docs, labels, label, fold == folds - 1, per_class)
    held = evidence(sample, models, "label").select("label", "x").toPandas()
    models.weights = fit_logistic(held[["x"]].to_numpy(float), held["label"].to_numpy(int), population)
    return models


def evidence(docs: DataFrame, models: Models, *keep: str, salts: int = 16) -> DataFrame:
    """The columns ``keep`` of each row of ``docs`` and x, its evidence by word: the signed square root of the length-normalised sum.

    Only occurrences that may be telling words leave the scan, as hashes by row number; a common word is
    dealt over ``salts`` keys.
    """
    held = docs.sparkSession.sparkContext.broadcast(bitmap(models.words.select("key")))

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        forget()
        known: dict[str, int] = {}
        for batch in batches:
            keys, n = [], []
            for text in batch.column(batch.num_columns - 1):
                words = words_of(text.as_py())
                for w in set(words).difference(known):
                    known[w] = _signed(xxhash.xxh64_intdigest(w.encode(), 42))
                all_keys = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
                keys.append(all_keys[marked(all_keys, held.value)])
                n.append(len(words))
                if len(known) > 50_000:
                    known.clear()
            ends = np.cumsum([0, *map(len, keys)]).astype(np.int32)
            found = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(keys) if keys else np.zeros(0, np.int64), pa.int64()))
            own = [batch.column(i) for i in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*own, pa.array(n, pa.int64()), found], names=["row", *keep, "n", "keys"])

    fields = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in keep)
    rows = docs.select(F.monotonically_increasing_id().alias("row"), *[F.col(f"`{c}`") for c in keep], "text")
    rows = saved(rows.mapInArrow(told, f"row long, {fields}n long, keys array<long>"), "toxicity_rows")
    asked = rows.select("row", F.explode("keys").alias("key"), F.pmod("row", F.lit(salts)).alias("salt"))
    listed = models.words.select("key", "evidence", F.explode(F.array(*[F.lit(i).cast("long") for i in range(salts)])).alias("salt"))
    sums = asked.join(listed, ["key", "salt"]).groupBy("row").agg(F.sum("evidence").alias("sum"))
    mean = F.coalesce(F.col("sum"), F.lit(0.0)) / F.greatest("n", F.lit(1))
    return rows.join(sums, "row", "left").select(*[F.col(f"`{c}`") for c in keep], (F.signum(mean) * F.sqrt(F.abs(mean))).alias("x"))


def toxicity_scores(docs: DataFrame, models: Models, *keep: str, threshold: float = 0.5) -> DataFrame:
    """The columns ``keep`` of each row with score (0 to 1) and predicted (1 from ``threshold`` on); texts are read once and never shuffled.

    Null and empty texts get the score of no evidence, as does a text of words that tell nothing.
    Every row is scored on its own, so repeated rows and null ids are like others; texts of any length
    are read whole. An empty table gives an empty result; other columns, clashing names too, are not read.
    """
    w = [float(x) for x in models.weights]
    logit = F.greatest(F.least(F.col("x") * w[0] + w[1], F.lit(500.0)), F.lit(-500.0))
    scored = evidence(docs, models, *keep).select(*[F.col(f"`{c}`") for c in keep], (1 / (1 + F.exp(-logit))).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def score_toxicity(docs: DataFrame, models: Models, threshold: float = 0.5) -> DataFrame:
    """All rows and columns of ``docs`` with score and predicted, as in :func:`toxicity_scores`; columns of those names are replaced."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in ("score", "predicted")])
    return toxicity_scores(docs.select(row.alias("row_"), "text"), models, "row_", threshold=threshold).select("row_.*", "score", "predicted")


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, **options) -> DataFrame:
    """The rows of ``docs`` that the models don't find toxic, with the columns of ``docs``; rows that repeat another's id and text fall alike."""
    scored = toxicity_scores(docs.withColumn("key", row_key()), train(docs, labels, **options), "key", threshold=threshold)
    return settle(docs, saved(scored.where("predicted = 1").select("key", F.lit(False).alias("kept")), "toxicity_gone"))
