"""Ranked lexical search: a stated set of items against all documents by dense blocked matrix products."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bidlake.functions.shared import saved

#: Letters and digits of ASCII and all bytes of other code points stay, A-Z in lower case; all else parts terms.
_TERM = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_STEP = 1 << 20
#: Impacts stay below this, see :func:`impacts`.
_MOST = 1_000_000
_EXACT = 1 << 53


def terms(text: str | None) -> Iterator[list[bytes]]:
    """The terms of a whole text in order, in slabs that end between terms."""
    data, at = (text or "").encode().translate(_TERM), 0
    while at < len(data):
        end = data.find(b" ", at + _STEP)
        end = len(data) if end < 0 else end
        yield data[at:end].split()
        at = end


def weight(docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * docs + 2) / (2 * df + 1)))


def impacts(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """What one unit of a term's weight adds to a document: (1000000000*tf) div (1000*tf+8*m), less than a million as m is 10 at least."""
    return 1_000_000_000 * tf // (1000 * tf + 8 * m)


def _counted(docs: DataFrame, vocabulary: list[bytes]) -> DataFrame:
    """doc_id, n, and the numbers and counts of the vocabulary's terms of each document that has terms."""
    held = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = {t: i for i, t in enumerate(held.value)}
        for batch in batches:
            for start in range(0, batch.num_rows, 1024):
                part = batch.slice(start, 1024)
                ns, ats, tfs = [], [], []
                for text in part.column("text"):
                    n, hits = 0, []
                    for words in terms(text.as_py()):
                        n += len(words)
                        hits.append(np.fromiter((known[w] for w in words if w in known), np.int32))
                    at, tf = np.unique(np.concatenate(hits), return_counts=True) if hits else (np.zeros(0, np.int32), np.zeros(0, np.int64))
                    ns.append(n)
                    ats.append(at.astype("<i4").tobytes())
                    tfs.append(tf.astype("<i8").tobytes())
                out = pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(ns, pa.int64()), pa.array(ats, pa.binary()), pa.array(tfs, pa.binary())], names=["doc_id", "n", "ats", "tfs"])
                yield out.filter(pa.array([n > 0 for n in ns], pa.bool_()))

    fields = docs.select("doc_id").schema.add("n", "long").add("ats", "binary").add("tfs", "binary")
    return docs.select("doc_id", "text").mapInArrow(run, fields)


def _frequencies(counted: DataFrame, size: int) -> np.ndarray:
    """In how many documents each term of the vocabulary is: counted in each task, then summed; one row a term reaches the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(size, np.int64)
        for batch in batches:
            for at in batch.column("ats"):
                own[np.frombuffer(at.as_buffer(), "<i4")] += 1
        at = np.flatnonzero(own)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(own[at], pa.int64())], names=["term", "df"])

    out = np.zeros(size, np.int64)
    for r in counted.select("ats").mapInArrow(run, "term int, df long").groupBy("term").agg(F.sum("df").alias("df")).collect():
        out[r.term] = r.df
    return out


def tile_scores(rows: np.ndarray, cols: np.ndarray, w: np.ndarray, items: int, at: np.ndarray, doc: np.ndarray, impact: np.ndarray, docs: int, widest: int = 4096) -> np.ndarray:
    """Scores of a tile of items (``rows`` hold terms ``cols``, of weights ``w``) with a tile of documents (``doc`` holds ``at``, of ``impact``).

    Only terms on both sides are columns. Products are summed in float64 over so few columns that no partial sum
    reaches 2^53, so each is exact; the slices' sums are added as integers.
    """
    terms = np.intersect1d(cols, at)
    out = np.zeros((items, docs), np.int64)
    step = max(1, min(widest, (_EXACT - 1) // (_MOST * max(1, int(w.max(initial=1))))))
    for k in range(0, len(terms), step):
        own = terms[k : k + step]
        i, j = np.searchsorted(own, cols), np.searchsorted(own, at)
        left, right = own[np.minimum(i, len(own) - 1)] == cols, own[np.minimum(j, len(own) - 1)] == at
        a, b = np.zeros((items, len(own))), np.zeros((len(own), docs))
        a[rows[left], i[left]] = w[left]
        b[j[right], doc[right]] = impact[right]
        out += (a @ b).astype(np.int64)
    return out


def top(scores: np.ndarray, order: np.ndarray, k: int) -> np.ndarray:
    """Columns of the ``k`` highest scores above 0, the first in ``order`` among equal ones: none that ties with the last is passed over unseen."""
    least = np.partition(scores, -k)[-k] if len(scores) > k else 1
    at = np.flatnonzero(scores >= max(1, least))
    return at[np.lexsort((order[at], -scores[at]))[:k]]


def _scored(counted: DataFrame, pairs: np.ndarray, w: np.ndarray, docs: int, length: int, k: int, tile: int) -> DataFrame:
    """The ``k`` best documents of each item within each task: item (its number), doc_id, score. pairs: item and term numbers, by item."""
    held = counted.sparkSession.sparkContext.broadcast((pairs, w))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (item, term), weights = held.value
        items = int(item.max(initial=-1)) + 1
        cuts = np.searchsorted(item, np.arange(0, items + tile, tile))
        best: list[list[tuple]] = [[] for _ in range(items)]
        key = lambda x: (-x[0], x[1] is None, x[1])
        for batch in batches:
            for start in range(0, batch.num_rows, 2 * tile):
                part = batch.slice(start, 2 * tile)
                ids, n = part.column("doc_id").to_pylist(), part.column("n").to_pylist()
                ats = [np.frombuffer(x.as_buffer(), "<i4") for x in part.column("ats")]
                at, tf = np.concatenate(ats), np.concatenate([np.frombuffer(x.as_buffer(), "<i8") for x in part.column("tfs")])
                doc = np.repeat(np.arange(len(ids)), [len(x) for x in ats])
                m = np.array([10 + 90 * x * docs // length for x in n], np.int64)
                impact = impacts(tf, m[doc])
                order = np.empty(len(ids), np.int64)
                order[sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i]))] = np.arange(len(ids))
                for g, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                    if a < b:
                        first, size = g * tile, min(tile, items - g * tile)
                        found = tile_scores(item[a:b] - first, term[a:b], weights[term[a:b]], size, at, doc, impact, len(ids))
                        for i in np.flatnonzero(found.max(1) > 0):
                            own, row = best[first + i], found[i]
                            if len(own) == k and row.max() < own[-1][0]:
                                continue
                            own.extend((int(row[c]), ids[c]) for c in top(row, order, k))
                            own.sort(key=key)
                            del own[k:]
        flat = [(i, id, score) for i, own in enumerate(best) for score, id in own]
        for at in range(0, len(flat), 10_000):
            i, id, score = zip(*flat[at : at + 10_000], strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(id, kind), pa.array(score, pa.int64())], names=["item", "doc_id", "score"])

    from pyspark.sql.pandas.types import to_arrow_type

    kind = to_arrow_type(counted.schema["doc_id"].dataType)
    return counted.mapInArrow(run, f"item int, doc_id {counted.schema['doc_id'].dataType.simpleString()}, score long")


def _blocks(items: DataFrame, most: int) -> tuple[DataFrame, int]:
    """The distinct (item_id, term) with a block of the item's, and the number of blocks: each holds ``most`` pairs at most, or one item alone."""
    terms_of = F.explode(F.array_distinct(F.filter(F.split(_ascii_lower(F.col("text")), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), lambda t: t != "")))
    pairs = saved(items.select("item_id", terms_of.alias("term")).distinct(), "items")
    sizes, n = pairs.groupBy("item_id").count(), 1
    while True:
        block = F.pmod(F.xxhash64("item_id", F.lit(n)), F.lit(n)).cast("int")
        loads = sizes.groupBy(block.alias("block")).agg(F.sum("count").alias("pairs"), F.count(F.lit(1)).alias("items"))
        if not loads.where((F.col("pairs") > most) & (F.col("items") > 1)).limit(1).count():
            return pairs.withColumn("block", block), n
        n *= 2


def _ascii_lower(c):
    return F.translate(F.coalesce(c, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def ranked_search(docs: DataFrame, items: DataFrame, k: int = 10, most: int = 1 << 18, tile: int = 256) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` highest-scoring documents of each item, those above 0 only.

    Items are taken in blocks of at most ``most`` (item, term) pairs, so a block's vocabulary and weights, which every
    task gets, are bounded; the documents are read once a block, and a short table of their counts of the
    vocabulary's terms is written. A task multiplies tiles of ``tile`` items and twice as many documents and keeps
    ``k`` rows an item; what tasks found meets in two steps, by (item, salt) and then by item.

    Equal scores rank by ascending doc_id, a null doc_id last. Rows that repeat a doc_id are documents of their own;
    rows that share an item_id make one item together. Null, empty and term-free texts have no terms, are no
    documents of the counts and match nothing; very long ones are read whole, in slabs. Empty tables give an
    empty result. Other columns are left out.
    """
    pairs, blocks = _blocks(items, most)
    out, docs_n, length = None, None, None
    for b in range(blocks):
        mine = [(r.item_id, r.term) for r in pairs.where(F.col("block") == b).select("item_id", "term").collect()]
        if not mine:
            continue
        vocabulary = sorted({t for _, t in mine})
        number = {t: i for i, t in enumerate(vocabulary)}
        ids = sorted({i for i, _ in mine}, key=lambda i: (i is None, i))
        place = {x: i for i, x in enumerate(ids)}
        at = np.array(sorted((place[i], number[t]) for i, t in mine), np.int64).T
        counted = saved(_counted(docs, [t.encode() for t in vocabulary]), "counted")
        if docs_n is None:
            docs_n, length = counted.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
        if not docs_n:
            break
        w = np.array([weight(docs_n, int(df)) for df in _frequencies(counted, len(vocabulary))], np.int64)
        found = saved(_best(_scored(counted, at, w, docs_n, length, k, tile), k), "found")
        named = docs.sparkSession.createDataFrame(list(enumerate(ids)), items.select(F.lit(0).alias("item"), "item_id").schema)
        found = found.join(F.broadcast(named), "item").select("item_id", "rank", "doc_id", "score")
        out = found if out is None else out.unionAll(found)
    if out is None:
        return docs.select(F.col("doc_id")).crossJoin(items.select("item_id").limit(0)).select("item_id", F.lit(0).alias("rank"), "doc_id", F.lit(0).cast("long").alias("score")).limit(0)
    return out


def _best(found: DataFrame, k: int, salts: int = 64) -> DataFrame:
    """item, rank, doc_id and score of the best ``k`` an item, first within (item, salt), then of what those leave."""
    order = [F.desc("score"), F.col("doc_id").asc_nulls_last()]
    some = Window.partitionBy("item", "salt").orderBy(*order)
    left = found.withColumn("salt", F.spark_partition_id() % salts).withColumn("rank", F.row_number().over(some)).where(F.col("rank") <= k)
    whole = Window.partitionBy("item").orderBy(*order)
    return left.withColumn("rank", F.row_number().over(whole)).where(F.col("rank") <= k).select("item", "rank", "doc_id", "score")
