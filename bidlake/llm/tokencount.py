"""Token counts of documents in flat token files that have no index."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bidlake.functions.shared import new_path, saved
from bidlake.llm.tokens import default_tokenizer, encoder

_AT_ONCE = 128


def write_token_files(docs: DataFrame, path: str, end_id: int, dtype: str = "<u2", tokenizer: str | None = None) -> DataFrame:
    """Writes the ids of ``docs``, each closed by ``end_id``, as one flat file per task under ``path``.

    Returns the order of writing: file, doc_no, doc_id. Only the files of accepted attempts appear. The
    string of a special token in a text is encoded as ordinary text, so ``end_id`` only closes documents.
    Null text is empty; repeated rows and null ids are written like others, long texts whole.
    """
    tokenizer = tokenizer or default_tokenizer()

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        encode, task = encoder(tokenizer, special=False).encode, TaskContext.get()
        name = f"part-{task.partitionId():06d}-{task.taskAttemptId()}.bin"
        store, folder = fs.FileSystem.from_uri(path)
        store.create_dir(folder, recursive=True)
        end, done = np.array([end_id], dtype).tobytes(), 0
        with store.open_output_stream(f"{folder}/{name}", compression=None) as out:
            for batch in batches:
                for lo in range(0, len(batch), _AT_ONCE):
                    for ids in encode(batch["text"].iloc[lo : lo + _AT_ONCE].tolist()):
                        out.write(ids.astype(dtype).tobytes() + end)
                yield pd.DataFrame({"file": name, "doc_no": np.arange(done, done + len(batch)), "doc_id": batch["doc_id"].astype("Int64")})
                done += len(batch)

    return saved(docs.select("doc_id", "text").mapInPandas(write, "file string, doc_no long, doc_id long"), "token_file_order")


def count_tokens(files: DataFrame, path: str, end_id: int, dtype: str = "<u2", block_bytes: int = 1 << 24) -> DataFrame:
    """file, doc_no, tokens, ended for every document in the flat token files of ``path``.

    ``files`` names them in ``file``. Each is cut into blocks of ``block_bytes``. A task searches its
    blocks for ``end_id`` in one vectorised pass and reports the run of ids before each hit and after
    the last one. A prefix scan over the blocks of a file then gives every block the number of
    documents that ended before it and the ids carried into it, which complete its first run; blocks
    without a hit pass on what they got plus their own length. tokens leaves out the closing id; ids
    after the last one in a file are a document with ended = false. Empty files have none.
    """
    width = np.dtype(dtype).itemsize
    if block_bytes % width:
        raise ValueError("a block must hold whole ids")

    def sizes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        store, folder = fs.FileSystem.from_uri(path)
        for batch in batches:
            yield pd.DataFrame({"file": batch["file"], "bytes": [store.get_file_info(f"{folder}/{f}").size for f in batch["file"]]})

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        store, folder = fs.FileSystem.from_uri(path)
        for batch in batches:
            for file, block in batch[["file", "block"]].itertuples(index=False):
                with store.open_input_file(f"{folder}/{file}") as source:
                    ids = np.frombuffer(source.read_at(block_bytes, int(block) * block_bytes), dtype)
                hits = np.flatnonzero(ids == end_id)
                runs = np.diff(np.concatenate([[-1], hits])) - 1
                tail = len(ids) - (hits[-1] + 1 if len(hits) else 0)
                yield pd.DataFrame({"file": file, "block": block, "nth": np.arange(len(hits) + 1), "run": np.append(runs, tail), "last": np.arange(len(hits) + 1) == len(hits)})

    known = files.select("file").distinct().mapInPandas(sizes, "file string, bytes long").where("bytes > 0")
    blocks = known.select("file", F.explode(F.expr(f"sequence(0L, (bytes - 1) div {block_bytes}L)")).alias("block"))
    found = saved(blocks.repartition("file", "block").mapInPandas(scan, "file string, block long, nth long, run long, last boolean"), "token_runs")

    # The last row of a block has as many hits before it as the block has, and the ids it passes on.
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    ends = found.where("last").select("file", "block", F.col("nth").alias("hits"), F.col("run").alias("tail"))
    ends = ends.withColumn("passed", F.coalesce(F.sum("tail").over(before), F.lit(0)))
    reset = F.last(F.when(F.col("hits") > 0, F.col("passed")), ignorenulls=True).over(before)
    ends = ends.select(
        "file", "block", F.coalesce(F.sum("hits").over(before), F.lit(0)).alias("docs_before"), (F.col("passed") - F.coalesce(reset, F.lit(0))).alias("carried"),
        F.lead("block").over(Window.partitionBy("file").orderBy("block")).isNull().alias("final"),
    )
    tokens = F.col("run") + F.when(F.col("nth") == 0, F.col("carried")).otherwise(0)
    joined = found.join(ends, ["file", "block"]).select("file", (F.col("docs_before") + F.col("nth")).alias("doc_no"), tokens.alias("tokens"), (~F.col("last")).alias("ended"), "final")
    return joined.where("ended or (final and tokens > 0)").drop("final")


def token_counts(docs: DataFrame, end_id: int = 50256, dtype: str = "<u2", tokenizer: str | None = None, path: str | None = None, **options) -> DataFrame:
    """doc_id and tokens of every row of ``docs``, counted in flat token files written from it.

    The counts come from the files alone; the order of writing only names them. Null text is an empty
    document with 0 tokens. Repeated rows and null doc_ids keep a row each. An empty table gives an
    empty result; other columns are not read.
    """
    path = path or new_path(docs.sparkSession, "token_files")
    order = write_token_files(docs, path, end_id, dtype, tokenizer)
    counts = count_tokens(order, path, end_id, dtype, **options)
    return order.join(counts, ["file", "doc_no"]).select("doc_id", "tokens")
