"""Importance resampling of documents towards a target corpus by hashed word and pair features."""

from __future__ import annotations

import math
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bidlake.functions.shared import running_sum, saved

#: Runs of digits, lower-case ASCII letters and all code points from U+0080.
WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_BREAK = re.compile(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]")
_STEP = 1 << 20
_OWN = ("n_words", "n_features", "weight", "score", "rank")


class _Crc(dict):
    """crc32 of words met by this worker; forgotten when ``memory`` words are held."""

    def __init__(self, memory: int = 1 << 19):
        self.memory = memory

    def __missing__(self, word: str) -> int:
        if len(self) >= self.memory:
            self.clear()
        crc = zlib.crc32(word.encode())
        if len(word) <= 48:
            self[word] = crc
        return crc


def _apply(table: np.ndarray, crc: np.ndarray) -> np.ndarray:
    return table[0][crc & 255] ^ table[1][crc >> 8 & 255] ^ table[2][crc >> 16 & 255] ^ table[3][crc >> 24]


def _zeros() -> list[np.ndarray]:
    """For each k the map, linear in the crc, that 2^k zero bytes make, as what each byte of a crc contributes."""
    byte = np.arange(256, dtype=np.uint32)
    one = byte.copy()
    for _ in range(8):
        one = np.where(one & 1, one >> 1 ^ np.uint32(0xEDB88320), one >> 1)
    tables = [np.stack([one, *(byte << 8 * j >> 8 for j in (1, 2, 3))]).astype(np.uint32)]
    for _ in range(31):
        tables.append(_apply(tables[-1], tables[-1]))
    return tables


_ZEROS = _zeros()


def joined_crc(left: np.ndarray, right: np.ndarray, length: np.ndarray) -> np.ndarray:
    """crc32 of each ``left``'s bytes, one space and ``right``'s bytes, of which there are ``length``."""
    inner = left ^ np.uint32(0xFFFFFFFF)
    crc = _ZEROS[0][0][(inner ^ 32) & 255] ^ inner >> 8 ^ np.uint32(0xFFFFFFFF)
    for k in range(int(length.max(initial=0)).bit_length()):
        at = np.flatnonzero(length >> k & 1)
        crc[at] = _apply(_ZEROS[k], crc[at])
    return crc ^ right


def _lowered(text: str) -> str:
    return text.encode().lower().decode()  # bytes know ASCII letters only


def _slabs(text: str) -> Iterator[str]:
    """The text in parts of at least ``_STEP`` characters that end where no word is."""
    at = 0
    while at < len(text):
        cut = _BREAK.search(text, at + _STEP)
        end = cut.start() if cut else len(text)
        yield text[at:end]
        at = end


class Splitter:
    """Buckets of a text's features: words by a Split pre-tokeniser, and windows of two neighbouring offset pairs."""

    def __init__(self, buckets: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import PreTokenizedString, Regex
        from tokenizers.pre_tokenizers import Split

        self.string, self.split = PreTokenizedString, Split(Regex(WORDS), "removed", invert=True)
        self.buckets, self.crc = buckets, _Crc()

    def words(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """crc32 and byte length of each word of a lowered text."""
        crcs, lengths = [], []
        for slab in _slabs(text):
            cut = self.string(slab)
            self.split.pre_tokenize(cut)
            found = cut.get_splits(offset_referential="original", offset_type="byte")
            crcs.append(np.fromiter((self.crc[word] for word, _, _ in found), np.uint32, len(found)))
            lengths.append(np.fromiter((end - start for _, (start, end), _ in found), np.int64, len(found)))
        return (np.concatenate(crcs), np.concatenate(lengths)) if crcs else (np.zeros(0, np.uint32), np.zeros(0, np.int64))

    def features(self, text: str | None) -> tuple[int, np.ndarray]:
        """Number of words, and the bucket of each word and each pair."""
        crc, length = self.words(_lowered(text or ""))
        pairs = joined_crc(crc[:-1], crc[1:], length[1:])
        return len(crc), (np.concatenate([crc, pairs]) % self.buckets).astype("<u2")


def _featured(docs: DataFrame, buckets: int) -> DataFrame:
    """The rows without their text, with n_words and the buckets of all features as unsigned 16-bit numbers."""
    kept = [c for c in docs.columns if c != "text"]  # of a row kept whole the text is in there

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splitter = Splitter(buckets)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):  # what leaves at once stays small
                part = batch.slice(at, 256)
                found = [splitter.features(t.as_py()) for t in part.column("text")]
                own = [pa.array([n for n, _ in found], pa.int64()), pa.array([b.tobytes() for _, b in found], pa.binary())]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), *own], names=[*kept, "n_words", "buckets"])

    fields = docs.select(*[F.col(f"`{c}`") for c in kept]).schema.add("n_words", "long").add("buckets", "binary")
    return docs.mapInArrow(run, fields)


def _histogram(featured: DataFrame, buckets: int) -> np.ndarray:
    """How many features fall into each bucket: counted in each task, then summed; the driver gets one row a bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(buckets, np.int64)
        for batch in batches:
            for b in batch.column("buckets"):
                own += np.bincount(np.frombuffer(b.as_buffer(), "<u2"), minlength=buckets)
        at = np.flatnonzero(own)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(own[at], pa.int64())], names=["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for r in featured.select("buckets").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r.bucket] = r.n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """A thousand times the log ratio of a bucket's share in the target to that in the source, each with one feature more a bucket; floored."""
    s, t, k = int(source.sum()), int(target.sum()), len(source)
    return np.array([math.floor(1000 * math.log((b + 1) * (s + k) / ((a + 1) * (t + k)))) for a, b in zip(source.tolist(), target.tolist(), strict=True)], np.int64)


def _weighed(featured: DataFrame, gain: np.ndarray) -> DataFrame:
    """n_features, weight and score in place of the buckets and the hash."""
    kept = [c for c in featured.columns if c not in ("_hash", "buckets")]
    held = featured.sparkSession.sparkContext.broadcast(gain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, weights = [], []
            for b in batch.column("buckets"):
                at = np.frombuffer(b.as_buffer(), "<u2")
                counts.append(len(at))
                weights.append(int(held.value[at].sum()) // len(at) if len(at) else 0)
            noise = [math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))) for h in batch.column("_hash").to_pylist()]
            own = [pa.array(x, pa.int64()) for x in (counts, weights, [w + g for w, g in zip(weights, noise, strict=True)])]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *own], names=[*kept, "n_features", "weight", "score"])

    fields = featured.select(*[F.col(f"`{c}`") for c in kept]).schema
    for name in ("n_features", "weight", "score"):
        fields = fields.add(name, "long")
    return featured.mapInArrow(run, fields)


def _noise_hash(doc_id: Column, seed: int) -> Column:
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")


def _scored(docs: DataFrame, target: DataFrame, buckets: int, seed: int) -> DataFrame:
    """``docs`` (all columns) with n_words, n_features, weight and score, and _tie, a number of the row's own; a written table."""
    if not 0 < buckets <= 1 << 16:
        raise ValueError("buckets are kept as 16-bit numbers")
    rows = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in (*_OWN, "_hash", "_tie", "buckets")])
    featured = saved(_featured(rows.withColumn("_hash", _noise_hash(F.col("doc_id"), seed)), buckets), "features")
    gain = gains(_histogram(featured, buckets), _histogram(_featured(target.select(F.lit("").alias("_text"), "text"), buckets), buckets))
    return saved(_weighed(featured, gain).withColumn("_tie", F.monotonically_increasing_id()), "scores")


def _drawn(scored: DataFrame, percent: int, min_words: int) -> DataFrame:
    """_tie, doc_id, score and rank of the rows drawn."""
    able = scored.where(F.col("n_words") >= min_words)
    n = percent * able.count() // 100
    order = [F.desc("score"), F.col("doc_id").asc_nulls_last(), F.col("_tie").asc()]
    return running_sum(able.select("score", "doc_id", "_tie"), order, F.lit(1), "rank").where(F.col("rank") <= n)


def importance_scores(docs: DataFrame, target: DataFrame, percent: int = 25, min_words: int = 20, buckets: int = 10_000, seed: int = 7) -> DataFrame:
    """Rows of ``docs`` (all columns but the text) with n_words, n_features, weight, score and rank.

    A document's weight is the floored mean gain of its word and pair features; the score adds Gumbel noise from a
    hash of its id, so the highest ``percent`` of the documents of at least ``min_words`` words are a sample without
    replacement that leans to ``target``. They are numbered by falling score, equal scores by doc_id.

    Texts are pre-tokenised once; their buckets, two bytes a feature, are written and read for the histogram and for
    the weights. Only a histogram of ``buckets`` rows (at most 65,536) reaches the driver. Null and empty texts, and
    those without words, have no features and weight 0, and like all below ``min_words`` no rank; very long texts are
    split in slabs and enter whole. A null doc_id hashes as empty text and comes last among equal scores; rows that
    repeat an id are numbered one by one. An empty table gives an empty result; an empty target makes rare features
    gain. Input columns named like a result column are replaced.
    """
    scored = _scored(docs, target, buckets, seed)
    return scored.join(_drawn(scored, percent, min_words).select("_tie", "rank"), "_tie", "left").drop("_tie", *[c for c in scored.columns if c == "text"])


def resample(docs: DataFrame, target: DataFrame, percent: int = 25, min_words: int = 20, buckets: int = 10_000, seed: int = 7) -> DataFrame:
    """The drawn rows of ``docs`` with their texts and all columns; see :func:`importance_scores`.

    Rows are kept where they lie, by the place of the last one drawn, so no text is shuffled.
    """
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "doc_id", "text")
    scored = _scored(keyed, target, buckets, seed)
    last = _drawn(scored, percent, min_words).orderBy(F.desc("rank")).limit(1).collect()
    if not last:
        return docs.limit(0)
    score, id, tie = last[0].score, F.lit(last[0].doc_id), last[0]["_tie"]
    same_id = F.col("doc_id").eqNullSafe(id) & (F.col("_tie") <= tie)
    before = F.coalesce(F.col("doc_id") < id, F.col("doc_id").isNotNull() & id.isNull())
    kept = (F.col("score") > score) | (F.col("score") == score) & (same_id | before)
    return scored.where((F.col("n_words") >= min_words) & kept).select("row.*")
