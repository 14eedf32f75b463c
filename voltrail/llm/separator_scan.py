"""Token counts of flat token files: a vectorised search for the end-of-document id, block by block.

A flat file is nothing but ids of a fixed width, each document's followed by the end id; it has no index. Blocks of the
files are searched on their own; a prefix scan over the blocks' summaries (how many ends, where the last one is) gives
every document its number in the file and the beginning of documents that lie across blocks.

Defined cases: null text counts as empty (0 tokens); repeated rows are counted each; an empty table gives no rows; a
file's tokens after its last end id count as a last, unterminated document; columns other than id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from voltrail.llm import bpe
from voltrail.llm.common import open_fs, pieces, shared_dir, stored, texts


def write_flat(df: DataFrame, folder: str, ranks: str, pattern: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes flat files of 16-bit ids, one per task. Returns what was written: path, ordinal and id of each document,
    and a row with ordinal -1 and the size in bytes of each file. Tasks that run again write files of their own."""
    size_of_vocabulary = len(bpe.vocabulary(ranks).tokens)
    if not size_of_vocabulary <= end_id < 1 << 16:
        raise ValueError("the end id must lie beyond the vocabulary and fit in 16 bits, as must the vocabulary")
    encoding = bpe.encoding(df, ranks, pattern)
    kind = df.schema[id_col].dataType.simpleString()
    one = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        path = f"{folder}/flat-{task.partitionId()}-{task.taskAttemptId()}-{uuid4().hex}.bin"
        fs, inner = open_fs(path)
        fs.create_dir(inner.rsplit("/", 1)[0], recursive=True)
        n, size = 0, 0
        with fs.open_output_stream(inner, compression=None) as out:
            for batch in pieces(batches):
                flat = np.concatenate([x for ids in encoding(texts(batch)) for x in (ids, [end_id])]).astype("<u2")
                out.write(flat.tobytes())
                size += flat.nbytes
                yield pa.RecordBatch.from_arrays(
                    [pa.array([path] * batch.num_rows), pa.array(range(n, n + batch.num_rows), pa.int64()), batch.column("id"), pa.nulls(batch.num_rows, pa.int64())],
                    ["path", "ordinal", "id", "bytes"],
                )
                n += batch.num_rows
                id_type = batch.column("id").type
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([-1], pa.int64()), pa.nulls(1, id_type), pa.array([size], pa.int64())], ["path", "ordinal", "id", "bytes"])

    return stored(one.mapInArrow(run, f"path string, ordinal long, id {kind}, bytes long"), "flat-manifest")


def scan(files: DataFrame, end_id: int, width: int = 2, block_tokens: int = 4_000_000) -> DataFrame:
    """Per document of the files (path, bytes): path, ordinal, n_tokens (without the end id)."""
    last_block = F.floor((F.col("bytes") - 1) / (width * block_tokens))
    blocks = files.where("bytes > 0").select("path", "bytes", F.explode(F.sequence(F.lit(0), last_block)).alias("block"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, size, block in zip(*(batch.column(c).to_pylist() for c in ("path", "bytes", "block"))):
                fs, inner = open_fs(path)
                first = block * block_tokens
                with fs.open_input_file(inner) as f:
                    data = f.read_at(min(width * block_tokens, size - width * first), width * first)
                at = first + np.flatnonzero(np.frombuffer(data, f"<u{width}") == end_id)
                if width * (first + block_tokens) >= size and (not len(at) or at[-1] != size // width - 1):
                    at = np.append(at, size // width)  # as if an end followed
                k, n = np.arange(len(at)), len(at)
                if n == 0:  # still a block, for the scan
                    at, k = np.array([-1]), np.array([-1])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([path] * len(at)), pa.array(np.full(len(at), block, np.int64)), pa.array(k, pa.int64()), pa.array(at, pa.int64()), pa.array(np.diff(at, prepend=-1) - 1, pa.int64())],
                    ["path", "block", "k", "at", "gap"],
                )

    ends = stored(blocks.repartition("path", "block").mapInArrow(run, "path string, block long, k long, at long, gap long"), "flat-ends")
    summary = ends.groupBy("path", "block").agg(F.count(F.when(F.col("k") >= 0, 1)).alias("ends"), F.max(F.when(F.col("k") >= 0, F.col("at"))).alias("last"))
    earlier = W.partitionBy("path").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    carried = summary.select("path", "block", F.coalesce(F.sum("ends").over(earlier), F.lit(0)).alias("base"), F.coalesce(F.max("last").over(earlier), F.lit(-1)).alias("from"))
    found = ends.where("k >= 0").join(carried, ["path", "block"])
    n_tokens = F.when(F.col("k") == 0, F.col("at") - F.col("from") - 1).otherwise(F.col("gap"))
    return found.select("path", (F.col("base") + F.col("k")).alias("ordinal"), n_tokens.alias("n_tokens"))


def count_tokens(df: DataFrame, ranks: str, pattern: str, end_id: int = 50256) -> DataFrame:
    """op7: flat files of df's texts, and per document what the scan of the files counts."""
    written = write_flat(df, shared_dir(df.sparkSession, "flat"), ranks, pattern, end_id)
    counted = scan(written.where("ordinal < 0").select("path", "bytes"), end_id)
    return written.where("ordinal >= 0").join(counted, ["path", "ordinal"]).select(F.col("id").alias("doc_id"), "n_tokens")
