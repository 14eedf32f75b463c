"""Tables that several jobs read, in the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
from collections.abc import Iterator, Sequence
from uuid import uuid4

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}  # by application: the folder in which its tables are


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder's address under the folder that the cluster names in ``spark.checkpoint.dir``.

    Only where that is unset and everything runs on this machine (tests, local mode) a temporary folder takes its place; on a
    cluster without the setting this is an error, as executors would write to their own disks.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", base)
    own = _own.setdefault(spark.sparkContext.applicationId, f"voltrail-{uuid4().hex}")
    return f"{base.rstrip('/')}/{own}/{name}-{uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """df as a table written in the shared folder, so that what reads it several times does not make it several times, whatever
    executors are lost."""
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def in_order(df: DataFrame, name: str, key: str, files: int) -> list[str]:
    """df written in the shared folder in order of a key without nulls; the addresses of its files, of which each goes on where the one before it ends."""
    path = shared_dir(df.sparkSession, name)
    df.repartitionByRange(files, key).sortWithinPartitions(key).write.option("parquet.block.size", 8 << 20).parquet(path)
    return sorted(df.sparkSession.read.schema(df.schema).parquet(path).inputFiles())


def streamed(files: Sequence[str], columns: Sequence[str], n: int) -> Iterator[pa.RecordBatch]:
    """The rows of such files in batches of n at most, for tasks that meet a table of any size row by row."""
    from pyarrow import fs
    from pyarrow import parquet as pq

    for uri in files:
        system, path = fs.FileSystem.from_uri(uri)
        with system.open_input_file(path) as f:
            for batch in pq.ParquetFile(f).iter_batches(n, columns=list(columns), use_threads=False):
                if batch.num_rows:
                    yield batch


def release(spark: SparkSession) -> None:
    """Deletes what this application has stored. Results that are not yet written can't be read any more."""
    own, base = _own.pop(spark.sparkContext.applicationId, None), spark.conf.get("spark.checkpoint.dir", None)
    if own and base:
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{base.rstrip('/')}/{own}")
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
