"""Helpers shared by the text operators."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from voltrail.functions.storage import shared_dir, stored

__all__ = ["shared_dir", "stored"]

#: A word is a run without ASCII white space.
WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: The same in Spark's and DuckDB's regular expressions.
WORD_SQL = r"[^\x20\x09-\x0D]+"
#: Which bytes are ASCII white space.
SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True


def column(name: str) -> Column:
    """The column of this very name, whatever signs are in it."""
    return F.col("`" + name.replace("`", "``") + "`")


def together(columns: list[str]) -> Column:
    """The columns as one struct, rest; null if there are none."""
    return (F.struct(*map(column, columns)) if columns else F.lit(None).cast("string")).alias("rest")


def open_fs(uri: str):
    """File system and path of an address, for tasks that read or write binary files."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def pieces(batches: Iterable[pa.RecordBatch], mb: float = 8, column: str = "text") -> Iterator[pa.RecordBatch]:
    """The batches in pieces of about so many MB of the column, one row at least, so that a task holds few results."""
    import pyarrow.compute as pc

    for batch in batches:
        if batch.num_rows == 0:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        part = (np.cumsum(sizes + 64, dtype=np.int64) - 1) // int(mb * 1e6)
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for start, stop in zip(cuts, cuts[1:]):
            yield batch.slice(start, stop - start)


def rows(batches: Iterable[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of n rows at most."""
    for batch in batches:
        for start in range(0, batch.num_rows, n):
            yield batch.slice(start, n)


def texts(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """The column's strings; null counts as empty."""
    return [t or "" for t in batch.column(name).to_pylist()]


def list_array(flat, lengths, kind: pa.DataType) -> pa.ListArray:
    """A list column from its flat values (numpy) and the rows' lengths."""
    offsets = np.zeros(len(lengths) + 1, np.int32)
    np.cumsum(lengths, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, kind))


def distinct(data, starts: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    """Of the strings that begin at starts and fill the data: which of the distinct ones each is, and these."""
    if not len(starts):
        return np.empty(0, np.int64), []
    offsets = np.append(starts, len(data)).astype(np.int64)
    coded = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data)]).dictionary_encode()
    return coded.indices.to_numpy(), coded.dictionary.to_pylist()


def spread(ids: list[bytes], at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The packed 32-bit ids of the distinct strings, in the order of their occurrences, and each occurrence's count."""
    sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
    flat, begins = np.frombuffer(b"".join(ids), np.int32), np.cumsum(sizes) - sizes
    counts = sizes[at]
    place = np.repeat(begins[at] - (np.cumsum(counts) - counts), counts)
    place += np.arange(len(place))
    return flat[place], counts


class Cache:
    """What a worker has learnt of strings, in two generations: when the younger one takes half of the MB, it becomes the
    older one, and what is asked for again moves on. Strings over 64 long hardly come again and are not kept."""

    def __init__(self, mb: float):
        self.most, self.size, self.young, self.old = int(mb * 5e5), 0, {}, {}

    def look_up(self, keys: list, learn) -> list:
        """The values of the distinct keys; learn gives those of a list of unknown ones."""
        values = list(map(self.young.get, keys))
        old, keep, unknown = self.old.get, {}, []
        for i in [i for i, v in enumerate(values) if v is None]:
            k = keys[i]
            v = old(k)
            if v is None:
                unknown.append(i)
            else:
                values[i] = keep[k] = v
        if unknown:
            asked = [keys[i] for i in unknown]
            for i, k, v in zip(unknown, asked, learn(asked)):
                values[i] = v
                if len(k) <= 64:
                    keep[k] = v
        self.size += sum(map(len, keep)) + sum(map(len, keep.values())) + 190 * len(keep)  # objects and their places
        if self.size > self.most:
            self.young, self.old, self.size = {}, self.young, 0
        self.young.update(keep)
        return values
