"""Token ids as Parquet list columns: dictionary-coded tokens, delta-coded positions, bounded row groups, page indexes.

Documents are dealt to files by ranges of their id and sorted within, so files in order hold the ids in ascending order.
A row has the id, the number of the file, the ids before it in the file, its token count and its tokens. Readers
that want only metadata read no token pages; a filter on the id reaches row groups and pages by their indexes.

Defined cases: null text counts as empty and gets the end id alone; a null id sorts first; equal ids are ordered by
text; an empty table gives empty files; columns other than id and text are not read.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections.abc import Iterable, Iterator
from struct import Struct

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, DataFrameWriter, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from voltrail.llm.common import WORD, Cache, distinct, list_array, pieces, rows, shared_dir, spread, texts
from voltrail.llm.substrings import Words

#: MB of words and of their parts that a Python worker remembers.
WORDS_MB, PARTS_MB = 96, 64
#: ASCII signs that are neither letters nor digits: a run of them after a word's letters is one part.
SIGNS = "".join(c for c in map(chr, range(0x21, 0x7F)) if not c.isalnum())
LETTERS, MARKS = (np.array([chr(i).isascii() and f(chr(i)) for i in range(256)]) for f in (str.isalpha, lambda c: c in SIGNS))
#: Printable Latin-1: normalisation leaves it alone but for lower case, one character for one.
PLAIN = re.compile(r"[!-~¡-¬®-ÿ]*\Z")
#: How the tokenizer splits a word; parts of plain words are looked up one by one.
_PRINTED = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
#: Byte-level vocabularies write bytes that are not printable, in order, as characters from 256 on.
BYTES = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in set(_PRINTED))}
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+"


_packed = Struct("=I").pack


class WordEncoder:
    """Encodes by words where the tokenizer drops white space, as its encodings of words don't depend on neighbours."""

    def __init__(self, definition: str):
        import regex
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks are the parallelism
        self.tokenizer = Tokenizer.from_str(definition)
        probe = ["Hello, World's 42nd", "\tté  |  x_y\n", "É!! <|a|> don't", "1 2.5 %%% a-b"]
        by_word = [sum((self._ids(w) for w in WORD.findall(t)), []) for t in probe]
        self.by_word = by_word == [self._ids(t) for t in probe]
        by_part = [np.frombuffer(b"".join(self._part(p) for w in WORD.findall(t) for p in regex.findall(SPLIT, w.lower())), np.uint32).tolist() for t in probe]
        self.by_part = self.by_word and by_part == by_word
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.control = re.compile("|".join(map(re.escape, added)) or r"\Z.").search
        self.by_letters = self.by_part and not any(t.isalpha() for t in added)  # then letters alone are a part and hold no control string
        self.split = regex.compile(SPLIT).findall
        self.cache, self.parts = Cache(WORDS_MB), Cache(PARTS_MB)

    def _ids(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _part(self, part: str) -> bytes:
        """The ids of a part in lower case, by the model alone; bytes stand as the characters of the vocabulary."""
        if not part.isascii():
            part = part.encode().decode("latin-1").translate(BYTES)
        return array("I", [t.id for t in self.tokenizer.model.tokenize(part)]).tobytes()

    def _encode_all(self, several: list[str]) -> Iterator[bytes]:
        for start in range(0, len(several), 4096):
            for e in self.tokenizer.encode_batch_fast(several[start : start + 4096], add_special_tokens=False):
                yield array("I", e.ids).tobytes()

    def _learn(self, words: list[bytes]) -> list[bytes]:
        """The ids of words or of parts of words; spaces after them don't count."""
        if not self.by_letters:
            return self._learn_parts(words)
        # most are small letters alone: such a part is not looked up again
        tokenize, out, rest = self.tokenizer.model.tokenize, [], []
        for w in words:
            w = w.rstrip(b" ")
            if w.isalpha() and w.islower():
                found = tokenize(w.decode())
                out.append(_packed(found[0].id) if len(found) == 1 else array("I", [t.id for t in found]).tobytes())
            else:
                out.append(None)
                rest.append(w)
        others = iter(self._learn_parts(rest))
        return [next(others) if x is None else x for x in out]

    def _learn_parts(self, words: list[bytes]) -> list[bytes]:
        plain = PLAIN.match if self.by_part else (lambda w: None)
        control = self.control if self.control(b"".join(words).decode()) else (lambda w: None)
        split, rest = [], []
        for w in words:
            w = w.rstrip(b" ").decode()
            if plain(w) and not control(w):
                low = w.lower()
                core = low.rstrip(SIGNS)
                if not core.isalpha():
                    split.append(self.split(low))
                elif len(core) == len(low):
                    split.append((core,))
                else:
                    split.append((core, low[len(core) :]))
            else:
                split.append(None)
                rest.append(w)
        parts = list({p for ps in split if ps for p in ps})
        found = dict(zip(parts, self.parts.look_up(parts, lambda unknown: list(map(self._part, unknown)))))
        others = self._encode_all(rest)
        return [next(others) if ps is None else found[ps[0]] if len(ps) == 1 else b"".join([found[p] for p in ps]) for ps in split]

    def encode_flat(self, several: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids (int32) of all texts in a row, and how many each has."""
        if not self.by_word:
            ids = list(self._encode_all(several))
            return np.frombuffer(b"".join(ids), np.int32), np.array([len(x) // 4 for x in ids], np.int64)
        words = Words(several)
        data, starts, first = words.norm, words.starts, np.append(words.first, len(words.stops))
        if self.by_part and not self.control(data.tobytes().decode()):
            # letters and the signs after them are parts of their own, so they are looked up one by one, in lower case
            capital = np.flatnonzero((data >= 65) & (data <= 90))
            if len(capital):  # in words up to Latin-1 no character depends on its neighbours
                if data.max() >= 0xC4:
                    high = np.maximum.reduceat(data, starts) >= 0xC4
                    capital = capital[~high[np.searchsorted(starts, capital, "right") - 1]]
                data = data.copy()
                data[capital] += np.uint8(32)
            cut = np.flatnonzero(LETTERS[data[:-1]] & MARKS[data[1:]]) + 1
            at = np.concatenate([starts, cut])
            at.sort(kind="stable")
            first = np.searchsorted(at, np.append(starts, len(data))[first])
            starts = at
        which, strings = distinct(data.tobytes(), starts)
        ids, counts = spread(self.cache.look_up(strings, self._learn), which)
        upto = np.concatenate([[0], np.cumsum(counts)])
        return ids, np.diff(upto[first])

    def encode_batch(self, several: list[str]) -> list[bytes]:
        """The ids of each text as packed 32-bit integers."""
        ids, sizes = self.encode_flat(several)
        ends = np.cumsum(sizes)
        return [ids[b - n : b].tobytes() for b, n in zip(ends, sizes)]


_encoders: dict[str, WordEncoder] = {}


def coded_writer(df: DataFrame, row_group_mb: int = 16) -> DataFrameWriter:
    """Parquet with dictionary-coded tokens, delta-coded numbers, bounded row groups and pages."""
    writer = df.write.option("compression", "zstd").option("parquet.writer.version", "v2").option("parquet.block.size", row_group_mb << 20)
    writer = writer.option("parquet.page.row.count.limit", 2000).option("parquet.enable.dictionary", "false").option("parquet.enable.dictionary#tokens.list.element", "true")
    return writer.option("parquet.dictionary.page.size", 1 << 20)


def write_tokens(df: DataFrame, folder: str, tokenizer: str, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", row_group_mb: int = 16) -> None:
    """Encodes df's texts with the tokenizer file, appends the end id to each and writes the files in folder."""
    with open(tokenizer, encoding="utf-8") as f:
        shared = df.sparkSession.sparkContext.broadcast(f.read())  # a vocabulary, not data
    kind = df.schema[id_col].dataType.simpleString()
    one = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if shared.value not in _encoders:
            _encoders[shared.value] = WordEncoder(shared.value)
        encode = _encoders[shared.value].encode_flat
        part, before = TaskContext.get().partitionId(), 0
        for batch in pieces(batches, mb=4):
            ids, sizes = encode(texts(batch))
            flat = np.insert(ids, np.cumsum(sizes), end_id)
            sizes = sizes + 1
            starts = before + np.cumsum(sizes) - sizes
            before += int(sizes.sum())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(np.full(len(sizes), part, np.int32)), pa.array(starts), pa.array(sizes), list_array(flat, sizes, pa.int32())],
                ["doc_id", "part", "part_start", "n_tokens", "tokens"],
            )

    coded = one.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text").mapInArrow(run, f"doc_id {kind}, part int, part_start long, n_tokens long, tokens array<int>")
    coded_writer(coded, row_group_mb).parquet(folder)


def read_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """The rows of the files, with start (the ids of all documents before it) in place of the place in the file."""
    stored = spark.read.parquet(folder)
    totals = stored.groupBy("part").agg(F.sum("n_tokens").alias("part_tokens"))  # one row per file
    before = F.sum("part_tokens").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1))
    bases = totals.select("part", F.coalesce(before, F.lit(0)).alias("base"))
    joined = stored.join(F.broadcast(bases), "part")
    return joined.select("doc_id", (F.col("base") + F.col("part_start")).alias("start"), "n_tokens", "tokens")


def crc32_of(df: DataFrame) -> DataFrame:
    """The rows of ``read_tokens`` with the crc32 of the little-endian 32-bit ids in place of the ids."""
    kind = df.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows(batches, 1000):
            column = batch.column("tokens")
            data = memoryview(np.ascontiguousarray(column.flatten().to_numpy(zero_copy_only=False), "<u4").view(np.uint8))
            ends = np.concatenate([[0], np.cumsum(batch.column("n_tokens").to_numpy())]) * 4
            sums = [zlib.crc32(data[a:b]) for a, b in zip(ends, ends[1:])]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "start", "n_tokens")), pa.array(sums, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return df.mapInArrow(run, f"doc_id {kind}, start long, n_tokens long, ids_crc32 long")


def round_trip(df: DataFrame, tokenizer: str) -> DataFrame:
    """op4: writes the token files of df and reports what is read back from them."""
    folder = shared_dir(df.sparkSession, "token-tables")
    write_tokens(df, folder, tokenizer)
    return crc32_of(read_tokens(df.sparkSession, folder))
