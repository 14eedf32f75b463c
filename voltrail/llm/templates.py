"""Benchmark decontamination by template windows.

Numbers, units and names become typed placeholders, so that a question with other values has the same template. Windows of
template tokens of the benchmark are joined by hash with those of the documents; along each alignment of an item with a
document the values behind the placeholders must map one to one, or the windows that break the mapping do not count.

Defined cases: null and empty texts have no windows; items with fewer tokens than a window are one window of their own
length (items under ``least`` tokens have none); windows that are mostly placeholders are not used; repeated rows and
repeated items are matched each; rows with a null id are matched and keep the null; empty tables give an empty table;
other columns are not read. Texts are taken whole.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voltrail.llm.common import pieces, stored, texts, together
from voltrail.llm.substrings import Words, mixed

UNITS = frozenset(
    "km kg cm mm ml mg mph kmh kwh mile miles hour hours minute minutes second seconds day days week weeks month months year years "
    "dollar dollars euro euros pound pounds cent cents metre metres meter meters litre litres liter liters gram grams percent".split()
)
NUMBER = re.compile(r"[-+]?[$€£]?\d[\d.,:/]*(?:%|st|nd|rd|th)?\Z")
EDGES = "\"'“”‘’«»()[]{}<>.,;:!?…*#$%&|_-"
ENDS = tuple(".!?…:")
LITERAL, NUM, UNIT, NAME, NOTHING = range(5)
#: Hashes of the placeholders.
CODES = np.array([0, 0x6E756D, 0x756E6974, 0x6E616D65, 0], np.uint64)
#: Cached words in a Python worker.
CACHE = 200_000


class Lexicon:
    """Kind and hash of each word, looked up by a number."""

    def __init__(self):
        self.number: dict[bytes, int] = {}
        self.rows: list[tuple[int, int, bool]] = []
        self.arrays = (np.empty(0, np.int8), np.empty(0, np.uint64), np.empty(0, bool))

    def numbers(self, words: list[bytes]) -> np.ndarray:
        if len(self.number) > CACHE:
            self.__init__()
        number = self.number
        for w in set(words).difference(number):
            number[w] = len(self.rows)
            self.rows.append(self.describe(w))
        out = np.fromiter(map(number.__getitem__, words), np.int64, len(words))
        if len(self.arrays[0]) < len(self.rows):
            more = self.rows[len(self.arrays[0]) :]
            self.arrays = tuple(np.concatenate([a, np.array(x, a.dtype)]) for a, x in zip(self.arrays, zip(*more)))
        return out

    @staticmethod
    def describe(word: bytes) -> tuple[int, int, bool]:
        """Kind (NAME: only if not first in its sentence), hash as a literal, whether it ends a sentence."""
        text = word.decode()
        core = text.strip(EDGES)
        ends = text.rstrip("\"'”’»)]").endswith(ENDS)
        if not core:
            return NUM if any(map(str.isdigit, text)) else NOTHING, 0, ends
        low = core.lower()
        if NUMBER.match(core):
            kind = NUM
        elif low in UNITS:
            kind = UNIT
        elif len(core) > 1 and core[0].isupper() and core[1:].islower():
            kind = NAME
        else:
            kind = LITERAL
        h = 0
        for b in low.encode():
            h = (h * 0x100000001B3 + b + 1) & 0xFFFFFFFFFFFFFFFF
        return kind, h, ends


class Tokens:
    """The template tokens of several texts."""

    def __init__(self, several: list[str], lexicon: Lexicon):
        words = Words(several)
        self.words = words.norm.tobytes().split(b" ")[: len(words.stops)]
        number = lexicon.numbers(self.words)
        kind, literal, ends = (a[number] for a in lexicon.arrays)
        first = np.ones(len(number), bool)
        first[1:] = ends[:-1] | (words.text[1:] != words.text[:-1])
        kind = np.where((kind == NAME) & first, LITERAL, kind)
        keep = np.flatnonzero(kind != NOTHING)
        self.at, self.kind, self.text = keep, kind[keep], words.text[keep]
        self.code = mixed(np.where(self.kind == LITERAL, literal[keep], CODES[self.kind]))
        self.first = np.searchsorted(self.text, np.arange(len(several) + 1))

    def value(self, i: int) -> bytes:
        return self.words[self.at[i]].strip(EDGES.encode()).lower()

    def windows(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """First tokens and hashes of all windows of n tokens of one text."""
        count = len(self.code) - n + 1
        if count <= 0:
            return np.empty(0, np.int64), np.empty(0, np.uint64)
        h = np.full(count, n, np.uint64)
        for i in range(n):
            h = h * np.uint64(0xD6E8FEB86659FD93) + self.code[i : i + count]
        at = np.flatnonzero(self.text[:count] == self.text[n - 1 :])
        return at, mixed(h[at])


@dataclass
class Index:
    """The benchmark's windows by hash, and each item's slots."""

    window: int
    hashes: dict[int, np.ndarray] = field(default_factory=dict)  # by length
    places: dict[int, list[tuple[int, int]]] = field(default_factory=dict)  # item, position
    items: list = field(default_factory=list)
    counts: list[int] = field(default_factory=list)  # windows per item
    slots: list[dict[int, tuple[int, bytes]]] = field(default_factory=list)  # position -> kind, value

    @classmethod
    def build(cls, rows: list[tuple], window: int, least: int) -> Index:
        out = cls(window)
        found: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
        for item, text in rows:
            t = Tokens([text or ""], Lexicon())
            n = min(window, len(t.code))
            if n < least:
                continue
            at, h = t.windows(n)
            literal = np.convolve(t.kind == LITERAL, np.ones(n, int), "valid") * 2 > n
            k = len(out.items)
            found[n] += [(int(x), k, int(a)) for a, x in zip(at, h) if literal[a]]
            out.items.append(item)
            out.counts.append(int(literal.sum()))
            out.slots.append({i: (int(t.kind[i]), t.value(i)) for i in np.flatnonzero(t.kind != LITERAL).tolist()})
        for n, entries in found.items():
            entries.sort()
            out.hashes[n] = np.array([e[0] for e in entries], np.uint64)
            out.places[n] = [e[1:] for e in entries]
        return out

    def matches(self, tokens: Tokens) -> dict[tuple[int, int, int], list[tuple[int, int]]]:
        """By text, item and shift of the alignment: positions in the item and lengths of the windows found."""
        out: dict[tuple[int, int, int], list[tuple[int, int]]] = defaultdict(list)
        for n, known in self.hashes.items():
            if not len(known):
                continue
            at, h = tokens.windows(n)
            seen = np.zeros(1 << 20, bool)
            seen[(known >> np.uint64(44)).astype(np.int64)] = True
            some = np.flatnonzero(seen[(h >> np.uint64(44)).astype(np.int64)])
            low, high = np.searchsorted(known, h[some], "left"), np.searchsorted(known, h[some], "right")
            for i in np.flatnonzero(high > low):
                a = int(at[some[i]])
                for item, position in self.places[n][low[i] : high[i]]:
                    out[int(tokens.text[a]), item, a - position].append((position, n))
        return out


def consistent(slots: dict[int, tuple[int, bytes]], tokens: Tokens, shift: int, found: list[tuple[int, int]]) -> tuple[int, int, int]:
    """Of the windows found on one alignment: how many keep the slots' mapping one to one; their slots, and those changed."""
    there: dict[tuple[int, bytes], bytes] = {}
    back: dict[tuple[int, bytes], bytes] = {}
    good, used = 0, set()
    for position, n in sorted(found):
        own = [(i, slots[i][0], slots[i][1], tokens.value(shift + i)) for i in range(position, position + n) if i in slots]
        if all(there.get((k, v), w) == w and back.get((k, w), v) == v for _, k, v, w in own):
            good += 1
            for i, k, v, w in own:
                there[k, v], back[k, w] = w, v
                used.add((i, v == w))
    return good, len(used), sum(not same for _, same in used)


def contaminated(df: DataFrame, benchmark: DataFrame, window: int = 8, least: int = 5, share: float = 0.3, block_mb: int = 32) -> DataFrame:
    """Pairs of a document of df and an item of benchmark whose windows it holds, at least ``share`` of the item's:
    doc_id, item_id, n_windows, matched, n_slots, n_changed, kind (exact or reparameterised).

    The benchmark is taken in blocks of at most about ``block_mb`` of text, each shared with all tasks in turn.
    """
    spark = df.sparkSession
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = ceil(total / (block_mb << 20)) or 1
    one = df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = "doc_id long, item_id long, n_windows long, matched long, n_slots long, n_changed long, kind string"
    found = None
    for k in range(blocks):
        block = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k) if blocks > 1 else items
        index = spark.sparkContext.broadcast(Index.build([tuple(r) for r in block.collect()], window, least))  # a block of bounded size
        part = one.mapInArrow(_scanner(index, share), schema)
        found = part if found is None else found.unionByName(part)
    return found


def _scanner(shared, share: float):
    names = ["doc_id", "item_id", "n_windows", "matched", "n_slots", "n_changed", "kind"]
    kinds = [pa.int64()] * 6 + [pa.string()]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, lexicon = shared.value, Lexicon()
        for batch in pieces(batches, mb=2):
            tokens = Tokens(texts(batch), lexicon)
            docs = batch.column("doc_id").to_pylist()
            best: dict[tuple[int, int], tuple[int, int, int]] = {}
            for (text, item, shift), found in index.matches(tokens).items():
                result = consistent(index.slots[item], tokens, shift, found)
                best[text, item] = max(best.get((text, item), (0, 0, 0)), result)
            rows = [
                (docs[t], index.items[i], index.counts[i], good, slots, changed, "reparameterised" if changed else "exact")
                for (t, i), (good, slots, changed) in sorted(best.items())
                if good and good >= share * index.counts[i]
            ]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    return run


def without_contaminated(df: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of df whose document is not contaminated. Columns other than doc_id and text may have any names."""
    hits = stored(contaminated(df, benchmark).select("doc_id").distinct(), "contaminated")
    rest = [c for c in df.columns if c != "doc_id"]
    one = df.select("doc_id", together(rest))
    left = one.join(hits, one["doc_id"].cast("long").eqNullSafe(hits["doc_id"]), "left_anti")
    return left.select(*(F.col("doc_id") if c == "doc_id" else F.col("rest").getField(c).alias(c) for c in df.columns))
