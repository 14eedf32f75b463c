"""Packing of documents into token sequences by linear grouping.

Tasks encode documents and cut those longer than a sequence. How many pieces there are of each length is all that the plan needs:
a bounded table, whatever the corpus. Large pieces, by falling length, fall into groups of equal cardinality, and each counts as
long as its group's longest. For these few sizes, configurations of a sequence are optimised by column generation: a linear
program over the configurations found so far, whose prices a knapsack uses to find a better one. Whole numbers of
configurations are taken; their places are given to the actual pieces of the groups by rank, and the room that these leave follows
from the table. Sequences that would keep much room are dissolved again. What is left over and the small pieces then go, by falling length,
where they fit best.

The plan says, for ranges of ranks, which sequences they go to. A piece's rank is its place by falling length, then by the task that made
it and its place there, so every task finds its pieces' sequences alone. Pieces meet by sequence, of at most the capacity each, and
are written as rows of tokens, with what each piece is and where it lies.

Defined cases: null and empty texts have the end id alone; repeated rows and rows with a null id are packed like others; an empty table
gives empty tables; other columns are not read. Texts are taken whole. Control strings of the vocabulary in a text get their ids, as
the tokenizers library has it.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from array import array
from collections import defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import tiktoken
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from voltrail.llm.bpe import Segmented
from voltrail.llm.common import list_array, pieces, rows, shared_dir, stored, texts
from voltrail.llm.token_tables import BYTES

#: Rows of a table that goes to every task; with more, the tables are joined by shuffling.
SENT_ROWS = 500_000


@dataclass(frozen=True)
class Packing:
    capacity: int = 2048
    end_id: int = 0
    groups: int = 64  # of large pieces
    small: int = 8  # a piece of at most a so-manieth of the capacity is small
    columns: int = 3000  # configurations tried at most


class TextEncoder(Segmented):
    """A byte-level definition of the tokenizers library. Where no match crosses the borders of segments, each new segment is
    encoded once, by the ranks of its merges if these follow the order of the ids; texts that hold a control string, and all texts
    under another kind of definition, go to the library whole."""

    def __init__(self, definition: str, pattern: str):
        super().__init__(pattern)
        self.definition = definition
        d = json.loads(definition)
        before, ranks = d["pre_tokenizer"] or {}, ranks_of(d)
        self.by_segment &= ranks is not None and before.get("type") == "ByteLevel" and not before.get("add_prefix_space") and before.get("use_regex", True) and not d["normalizer"]
        if self.by_segment:
            self.coded = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.control = re.compile("|".join(re.escape(t["content"]) for t in d["added_tokens"]) or r"\Z.").search

    @cached_property
    def library(self):
        """The library's own encoder, made only where a text asks for it."""
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks are the parallelism
        return Tokenizer.from_str(self.definition)

    def _encoded(self, several: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.int32) for e in self.library.encode_batch_fast(several, add_special_tokens=False)]

    def _learn(self, segments: list[bytes]) -> list[bytes]:
        coded = self.coded
        return [array("i", coded(s.decode())).tobytes() for s in segments]

    def encode_flat(self, several: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids (int32) of all texts in a row, and how many each has."""
        if not self.by_segment:
            odd = list(range(len(several)))
        else:
            odd = [i for i, t in enumerate(several) if self.control(t)] if self.control("".join(several)) else []
        if not odd:
            return super().encode_flat(several)
        found = dict(zip(odd, self._encoded([several[i] for i in odd])))
        rest = [i for i in range(len(several)) if i not in found]
        if rest:
            ids, sizes = super().encode_flat([several[i] for i in rest])
            found.update(zip(rest, np.split(ids, np.cumsum(sizes)[:-1])))
        each = [found[i] for i in range(len(several))]
        return np.concatenate(each).astype(np.int32), np.array([len(e) for e in each], np.int64)


def ranks_of(d: dict) -> dict[bytes, int] | None:
    """The tokens' ranks, if the definition merges byte pairs in the order of their ids."""
    model = d["model"]
    if model["type"] != "BPE" or model.get("ignore_merges"):
        return None
    byte = {chr(c): b for b, c in BYTES.items()} | {chr(b): b for b in range(256) if b not in BYTES}
    ids = model["vocab"]
    made = [ids["".join(m.split(" ") if isinstance(m, str) else m)] for m in model["merges"]]
    if made != sorted(made) or len(ids) != len(made) + 256 or not all(c in byte for t in ids for c in t):
        return None
    return {bytes(byte[c] for c in t): i for t, i in ids.items()}


_encoders: dict[tuple, TextEncoder] = {}


def as_bytes(ids: np.ndarray, lengths: np.ndarray) -> list[bytes]:
    """The ids of each piece, in two bytes each if they fit; a byte ahead tells how many."""
    width = 2 if ids.max(initial=0) < 1 << 16 else 4
    data, ends = memoryview(ids.astype(f"<u{width}").view(np.uint8)), np.cumsum(lengths) * width
    return [bytes([width]) + data[b - n : b] for b, n in zip(ends.tolist(), (lengths * width).tolist())]


def squeezed(tokens: Iterable[bytes]) -> list[bytes]:
    """The same, compressed, for the shuffle."""
    press = zstandard.ZstdCompressor(level=3).compress
    return [t[:1] + press(memoryview(t)[1:]) for t in tokens]


def released(tokens: Iterable[bytes]) -> np.ndarray:
    """The ids (little-endian, 32 bits) of compressed pieces, in a row."""
    out = zstandard.ZstdDecompressor().decompress
    parts = [np.frombuffer(out(memoryview(t)[1:]), f"<u{t[0]}").astype("<u4") for t in tokens]
    return np.concatenate(parts) if parts else np.empty(0, "<u4")


def cut(df: DataFrame, tokenizer: str, pattern: str, how: Packing) -> DataFrame:
    """Stored pieces: doc_id, piece, start (its document's ids before it), length, tokens (packed ids), the task that made it
    and how many pieces of this length came before it there. The first piece of a document that is cut may be shorter."""
    with open(tokenizer, encoding="utf-8") as f:
        definition = f.read()
    shared = df.sparkSession.sparkContext.broadcast(definition)  # a vocabulary, not data
    one = df.select("doc_id", F.col("text").cast("string").alias("text"))
    kind = one.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "piece", "start", "length", "tokens", "part", "before"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = (hash(shared.value), pattern)
        if key not in _encoders:
            _encoders[key] = TextEncoder(shared.value, pattern)
        part, seen = TaskContext.get().partitionId(), np.zeros(how.capacity + 1, np.int64)
        for batch in pieces(batches, mb=4):
            ids, sizes = _encoders[key].encode_flat(texts(batch))
            flat = np.insert(ids, np.cumsum(sizes), how.end_id)
            sizes = sizes + 1
            many = -(-sizes // how.capacity)
            doc = np.repeat(np.arange(len(sizes)), many)
            piece = np.arange(len(doc)) - np.repeat(np.cumsum(many) - many, many)
            first = sizes - how.capacity * (many - 1)
            length = np.where(piece == 0, first[doc], how.capacity)
            start = np.where(piece == 0, 0, first[doc] + how.capacity * (piece - 1))
            # of equal lengths, how many came before
            order = np.argsort(length, kind="stable")
            ordered = length[order]
            before = np.empty(len(length), np.int64)
            before[order] = np.arange(len(length)) - np.searchsorted(ordered, ordered) + seen[ordered]
            seen += np.bincount(length, minlength=how.capacity + 1)
            tokens = pa.array(as_bytes(flat, length), pa.binary())
            columns = [batch.column("doc_id").take(pa.array(doc)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int32()), tokens, pa.array(np.full(len(doc), part, np.int32)), pa.array(before)]
            yield pa.RecordBatch.from_arrays(columns, names)

    made = one.mapInArrow(run, f"doc_id {kind}, piece int, start long, length int, tokens binary, part int, before long")
    path = shared_dir(df.sparkSession, "pieces")
    made.write.option("compression", "zstd").option("parquet.block.size", 8 << 20).option("parquet.enable.dictionary#tokens", "false").parquet(path)
    return df.sparkSession.read.schema(made.schema).parquet(path)


@dataclass
class Plan:
    """Pieces of ranks from begin on, up to the next begin, go to sequence first + (rank - begin) // each."""

    begin: np.ndarray
    first: np.ndarray
    each: np.ndarray
    sequences: int

    def of(self, rank: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.begin, rank, "right") - 1
        return self.first[at] + (rank - self.begin[at]) // self.each[at]


def best_configuration(prices: np.ndarray, sizes: np.ndarray, most: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The worthiest configuration of a sequence, and its worth: how many pieces of each size, and no more than there are."""
    size = [int(s) for s in sizes]
    often = [min(capacity // s, int(m)) if price > 1e-12 else 0 for s, m, price in zip(size, most, prices)]
    worth = np.zeros((len(size) + 1, capacity + 1))  # with the first sizes only, in so much room
    for i, s in enumerate(size):
        worth[i + 1] = worth[i]
        for m in range(1, often[i] + 1):
            np.maximum(worth[i + 1, m * s :], worth[i, : capacity + 1 - m * s] + m * prices[i], out=worth[i + 1, m * s :])
    chosen, room = np.zeros(len(size), np.int64), capacity
    value = float(worth[-1, room])
    for i in range(len(size) - 1, -1, -1):
        ways = [worth[i, room - m * size[i]] + m * prices[i] for m in range(min(often[i], room // size[i]) + 1)]
        chosen[i] = int(np.argmax(ways))
        room -= int(chosen[i]) * size[i]
    return value, chosen


def configurations(sizes: np.ndarray, demand: np.ndarray, how: Packing) -> list[tuple[np.ndarray, int]]:
    """Configurations (how many pieces of each size) and how often each is used, for at most the demand.

    The simplex method over configurations, a new one at a time, until none is worth more than a sequence. The whole part of each
    number is used, and once more those, by falling fraction, for which all pieces are still there. What is used never exceeds the
    demand, however the numbers were rounded.
    """
    k = len(sizes)
    if not k:
        return []
    used = [np.eye(k, dtype=np.int64)[i] * min(how.capacity // int(sizes[i]), int(demand[i])) for i in range(k)]
    inverse = np.diag([1 / u[i] for i, u in enumerate(used)])
    x = inverse.diagonal() * demand
    for _ in range(how.columns):
        value, new = best_configuration(inverse.sum(axis=0), sizes, demand, how.capacity)
        if value <= 1 + 1e-7:
            break
        step = (inverse * new).sum(axis=1)
        can = np.flatnonzero(step > 1e-9)
        out = can[np.argmin(x[can] / step[can])]
        t = x[out] / step[out]
        x = np.maximum(x - t * step, 0)
        x[out] = t
        inverse[out] /= step[out]
        rest = step.copy()
        rest[out] = 0
        inverse -= rest[:, None] * inverse[out]
        used[out] = new
    left, times = demand.copy(), np.zeros(k, np.int64)
    for whole in (True, False):
        for i in np.argsort(-x if whole else -(x % 1), kind="stable"):
            want = int(x[i] + 1e-7) if whole else 1
            has = used[i] > 0
            times[i] += (fit := min(want, int((left[has] // used[i][has]).min())))
            left -= fit * used[i]
    return [(u, int(t)) for u, t in zip(used, times) if t]


def planned(counts: np.ndarray, how: Packing) -> Plan:
    """The plan for so many pieces of each length (0 to the capacity): the one with the fewest sequences, of several limits to the room that a
    configuration may leave when actual pieces stand in for its sizes. Sequences with more room are dissolved, and their pieces go where they fit best."""
    c = how.capacity
    by_rank = np.arange(c, -1, -1)  # lengths by falling length
    upto = np.cumsum(counts[by_rank])  # ranks behind each of them
    length_at = lambda rank: by_rank[np.searchsorted(upto, rank, "right")]
    full = int(counts[c])
    large = int(upto[c - c // how.small - 1]) - full
    # groups of equal cardinality, as long as their longest; those of one length are one size
    size = -(-large // how.groups) or 1
    begins = np.arange(full, full + large, size)
    sizes, first = np.unique(-length_at(begins), return_index=True) if large else (np.empty(0, np.int64), np.empty(0, np.int64))
    sizes, start = -sizes, begins[first] if large else begins
    demand = np.diff(np.append(start, full + large))
    blocks: list[tuple[int, int, list[tuple[int, int]]]] = []  # room left, sequences, and of each size the first rank and pieces of a sequence
    taken = start.copy()
    for config, times in configurations(sizes, demand, how):
        which = np.flatnonzero(config)
        cuts = {0, times}
        for i in which:  # where the lengths of actual pieces change, the room that is left does
            a, e = int(taken[i]), int(config[i])
            ends = upto[np.searchsorted(upto, a, "right") : np.searchsorted(upto, a + times * e, "left")] - a
            cuts |= {int(v) for v in ends // e} | {int(v) for v in -(-ends // e)}
        cuts = sorted(cuts)
        for a, b in zip(cuts, cuts[1:]):
            filled = sum(int(length_at(taken[i] + a * config[i] + np.arange(config[i])).sum()) for i in which)
            blocks.append((c - filled, b - a, [(int(taken[i] + a * config[i]), int(config[i])) for i in which]))
        taken[which] += times * config[which]
    rest = [*zip(taken.tolist(), np.append(start, full + large)[1:].tolist()), (full + large, int(upto[-1]))]  # large ones left over, and small ones
    plans = [_filled(blocks, rest, limit, full, upto, length_at, c) for limit in dict.fromkeys([c, *(c >> k for k in (4, 5, 6, 7, 8, 10)), 0])]
    return min(plans, key=lambda p: p.sequences)


def _filled(blocks: list, rest: list[tuple[int, int]], limit: int, full: int, upto: np.ndarray, length_at, c: int) -> Plan:
    """The plan that keeps the blocks with no more room than the limit; all other pieces go, by falling length, where they fit best."""
    ranges = [(0, 0, 1)] if full else []  # begin, first sequence, pieces of each
    sequences, loose = full, list(rest)
    room: dict[int, list[tuple[int, int]]] = defaultdict(list)  # by room left: sequences from one on, so many
    for left, times, parts in blocks:
        if left > limit:
            loose += [(a, a + times * e) for a, e in parts]
            continue
        ranges += [(a, sequences, e) for a, e in parts]
        room[left].append((sequences, times))
        sequences += times
    runs = []
    for a, b in loose:
        while a < b:
            stop = min(b, int(upto[np.searchsorted(upto, a, "right")]))
            runs.append((int(length_at(a)), a, stop - a))
            a = stop
    free = np.zeros(c + 1, bool)
    free[list(room)] = True
    for length, a, n in sorted(runs, key=lambda r: (-r[0], r[1])):
        while n:
            at = int(free[length:].argmax())
            if free[length + at]:
                r = length + at
                begin, many = room[r].pop()
                free[r] = bool(room[r])
            else:
                r, begin, many = c, sequences, -(-n // (c // length))
                sequences += many
            e = min(r // length, n)  # the room that is left of a sequence stays the smallest one that fits
            use = min(many, n // e)
            ranges.append((a, begin, e))
            for left, first, count in ((r - e * length, begin, use), (r, begin + use, many - use)):
                if count:
                    room[left].append((first, count))
                    free[left] = True
            a, n = a + use * e, n - use * e
    ranges.sort()
    return Plan(*(np.array([r[i] for r in ranges], np.int64) for i in range(3)), sequences)


def placed(cuts: DataFrame, how: Packing) -> DataFrame:
    """The pieces with their rank and sequence."""
    spark = cuts.sparkSession
    counts = stored(cuts.groupBy("part", "length").agg(F.count("*").alias("n")), "lengths")
    total = np.zeros(how.capacity + 1, np.int64)
    for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect():  # a row per length
        total[r["length"]] = r["n"]
    shared = spark.sparkContext.broadcast(planned(total, how))  # bounded by the number of lengths
    longer = np.append(np.cumsum(total[::-1])[::-1][1:], 0)
    above = spark.createDataFrame([(i, int(n)) for i, n in enumerate(longer)], "length int, longer long")
    earlier = F.coalesce(F.sum("n").over(W.partitionBy("length").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))  # a row per task
    bases = counts.withColumn("earlier", earlier).join(F.broadcast(above), "length").select("part", "length", (F.col("earlier") + F.col("longer")).alias("base"))
    bases = F.broadcast(bases) if counts.count() <= SENT_ROWS else bases
    ranked = cuts.join(bases, ["part", "length"]).withColumn("rank", F.col("base") + F.col("before")).select("doc_id", "piece", "start", "length", "tokens", "rank")
    kind = cuts.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows(batches, 2000):
            columns = {c: batch.column(c) for c in batch.schema.names} | {"tokens": pa.array(squeezed(batch.column("tokens").to_pylist()), pa.binary())}
            columns["sequence_id"] = pa.array(shared.value.of(batch.column("rank").to_numpy()), pa.int64())
            yield pa.RecordBatch.from_pydict(columns)

    return ranked.mapInArrow(run, f"doc_id {kind}, piece int, start long, length int, tokens binary, rank long, sequence_id long")


def assembled(pieces: DataFrame) -> DataFrame:
    """sequence_id, n_tokens, tokens (little-endian 32-bit ids, packed) and pieces (doc_id, piece, start, length, offset) of each sequence,
    longest piece first."""
    kind = pieces.schema["doc_id"].dataType.simpleString()
    fields = ["doc_id", "piece", "start", "length", "offset"]

    def made(table: pa.Table) -> Iterator[pa.RecordBatch]:
        batch = table.combine_chunks().to_batches()[0]
        seq, length = batch.column("sequence_id").to_numpy(), batch.column("length").to_numpy().astype(np.int64)
        begins = np.flatnonzero(np.append(True, seq[1:] != seq[:-1]))
        before = np.cumsum(length) - length
        sizes = np.add.reduceat(length, begins)
        many = np.diff(np.append(begins, len(seq)))
        flat = released(batch.column("tokens").to_pylist())
        offsets = np.append(0, np.cumsum(sizes * 4)).astype(np.int32)
        tokens = pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(flat)])
        columns = {c: batch.column(c) for c in fields[:4]} | {"offset": pa.array(before - np.repeat(before[begins], many), pa.int64())}
        inner = pa.StructArray.from_arrays([columns[f] for f in fields], fields)
        held = pa.ListArray.from_arrays(pa.array(np.append(begins, len(seq)).astype(np.int32)), inner)
        yield pa.RecordBatch.from_arrays([pa.array(seq[begins]), pa.array(sizes), tokens, held], ["sequence_id", "n_tokens", "tokens", "pieces"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None  # the rows of a sequence that may go on
        for batch in batches:
            for b in rows([batch], 2000):
                t = pa.Table.from_batches([b])
                t = t if held is None else pa.concat_tables([held, t])
                seq = t.column("sequence_id").to_numpy()
                last = int(np.searchsorted(seq, seq[-1]))
                if last:
                    yield from made(t.slice(0, last))
                held = t.slice(last)
        if held is not None:
            yield from made(held)

    one = pieces.repartition("sequence_id").sortWithinPartitions("sequence_id", "rank").select("doc_id", "piece", "start", "length", "tokens", "sequence_id")
    inner = f"struct<doc_id:{kind},piece:int,start:bigint,length:int,offset:bigint>"
    return one.mapInArrow(run, f"sequence_id long, n_tokens long, tokens binary, pieces array<{inner}>")


def unpacked(sequences: DataFrame) -> DataFrame:
    """The sequences with their tokens as arrays."""
    schema = StructType([StructField("tokens", ArrayType(IntegerType())) if f.name == "tokens" else f for f in sequences.schema])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows(batches, 500):
            flat = np.frombuffer(b"".join(batch.column("tokens").to_pylist()), "<i4")
            columns = {c: batch.column(c) for c in batch.schema.names}
            yield pa.RecordBatch.from_pydict(columns | {"tokens": list_array(flat, columns["n_tokens"].to_numpy(), pa.int32())})

    return sequences.mapInArrow(run, schema)


def pack(df: DataFrame, folder: str, tokenizer: str, pattern: str, how: Packing = Packing()) -> None:
    """Packs df's texts (doc_id, text) and writes the sequences in folder: sequence_id, n_tokens, tokens and their pieces."""
    made = assembled(placed(cut(df, tokenizer, pattern, how), how))
    made.write.option("compression", "zstd").option("parquet.block.size", 16 << 20).option("parquet.enable.dictionary#tokens", "false").parquet(folder)


def read_pieces(sequences: DataFrame) -> DataFrame:
    """Per piece of the sequences: what it is, where it lies, and the crc32 of its ids as little-endian 32-bit integers."""
    kind = sequences.schema["pieces"].dataType.elementType["doc_id"].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows(batches, 500):
            inner = batch.column("pieces")
            data = memoryview(b"".join(batch.column("tokens").to_pylist()))
            at = pa.array(np.repeat(np.arange(batch.num_rows), pc.list_value_length(inner).to_numpy()))
            flat = inner.flatten()
            get = lambda c, flat=flat: pc.struct_field(flat, c)
            sizes = batch.column("n_tokens").to_numpy()
            begin = ((np.cumsum(sizes) - sizes)[at.to_numpy()] + get("offset").to_numpy()) * 4
            stop = begin + get("length").to_numpy().astype(np.int64) * 4
            sums = [zlib.crc32(data[a:b]) for a, b in zip(begin.tolist(), stop.tolist())]
            yield pa.RecordBatch.from_arrays(
                [*(get(c) for c in ("doc_id", "piece", "start")), get("length").cast(pa.int64()), pa.array(sums, pa.int64()), batch.column("sequence_id").take(at), get("offset")],
                ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    return sequences.mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def packed(df: DataFrame, tokenizer: str, pattern: str, how: Packing = Packing()) -> DataFrame:
    """op11: writes the sequences of df and reports the pieces that are read back from them."""
    folder = shared_dir(df.sparkSession, "sequences")
    pack(df, folder, tokenizer, pattern, how)
    return read_pieces(df.sparkSession.read.parquet(folder))
