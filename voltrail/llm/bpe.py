"""Byte-level BPE encoding and decoding by prefix dynamic programming.

The encoding of every byte prefix of a piece ends in exactly one token. ``PrefixTable`` stores that token for each
prefix: a candidate suffix token is right when the token before it (already known, from the shorter prefix) and the
candidate would stay two tokens, whatever merges run across their border. So appending bytes only adds entries, and an
edit only recomputes entries until the table repeats itself.

Defined cases: null text encodes as the empty list; empty text likewise; a piece that is itself a vocabulary entry is
that one token; very long pieces take time in proportion to their length; repeated rows give repeated rows; an empty
table gives an empty table. Columns other than the id and the text are not read.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Callable, Iterable, Iterator
from hashlib import sha256
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from voltrail.llm.common import SPACES, Cache, column, distinct, list_array, pieces, rows, spread, texts, together

#: White space of Unicode (property White_Space), as the tokenizers' patterns understand it.
SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: MB of segments and of pieces that a Python worker remembers, and verdicts on token pairs.
SEGMENTS_MB, PIECES_MB, PAIRS = 40, 24, 60_000


def read_ranks(path: str) -> list[bytes]:
    """The byte strings of a rank file, by rank."""
    with open(path, "rb") as f:
        pairs = [line.split() for line in f if line.strip()]
    tokens = [b""] * (1 + max(int(rank) for _, rank in pairs))
    for token, rank in pairs:
        tokens[int(rank)] = base64.b64decode(token)
    return tokens


class Vocabulary:
    """Tokens by rank, and for each the two tokens whose merge makes it."""

    def __init__(self, tokens: list[bytes]):
        self.tokens = tokens
        self.rank = {t: i for i, t in enumerate(tokens) if t}
        self.longest = max(map(len, self.rank))
        self.left = list(range(len(tokens)))
        self.right = list(range(len(tokens)))
        self.usable = dict(self.rank)  # without those to which no merges lead
        for i, t in enumerate(tokens):
            if len(t) > 1:
                last = self._merge(t)
                if len(last) == 2:
                    self.left[i], self.right[i] = last
                else:
                    del self.usable[t]
        self.apart: dict[int, bool] = {}

    def _merge(self, text: bytes) -> list[int]:
        """Merges by lowest rank, leftmost first, until two tokens are left or none merge."""
        parts = [text[i : i + 1] for i in range(len(text))]
        while len(parts) > 2:
            ranks = [self.rank.get(a + b, 1 << 30) for a, b in zip(parts, parts[1:])]
            low = min(ranks)
            if low == 1 << 30:
                break
            at = ranks.index(low)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.rank[p] for p in parts]

    def stay_apart(self, a: int, b: int) -> bool:
        """Whether tokens a and b, side by side, are never merged across their border.

        The last merges are undone one by one, youngest first; at each step the two tokens that touch the border must
        not have a merge that comes before the one undone.
        """
        known = self.apart.get(a << 32 | b)
        if known is not None:
            return known
        x, y, below, verdict = a, b, 1 << 30, True
        while True:
            joined = self.rank.get(self.tokens[x] + self.tokens[y])
            if joined is not None and joined < below:
                verdict = False
                break
            whole_x, whole_y = self.left[x] == x, self.left[y] == y
            if whole_x and whole_y:
                break
            if not whole_x and (whole_y or x > y):
                # among equal ranks the left one merges first, so x exists before a merge of rank x at the border
                below, x = x, self.right[x]
            else:
                below, y = y + 1, self.left[y]
        if len(self.apart) >= PAIRS:
            self.apart.clear()
        self.apart[a << 32 | b] = verdict
        return verdict


class PrefixTable:
    """The last token of every prefix of a byte string that may grow and change."""

    def __init__(self, vocabulary: Vocabulary, text: bytes = b""):
        self.vocabulary = vocabulary
        self.text = b""
        self.last = [-1]
        self.append(text)

    def _extend(self, begin: int, stop: int) -> None:
        """Adds the entries of the prefixes longer than begin, up to stop."""
        v, text, last = self.vocabulary, self.text, self.last
        rank, apart, known, longest = v.usable.get, v.stay_apart, v.apart.get, v.longest
        for end in range(begin + 1, stop + 1):
            for start in range(end - 1, (end - longest if end > longest else 0) - 1, -1):
                token = rank(text[start:end])
                if token is not None:
                    if not start:
                        break
                    before = last[start]
                    fits = known(before << 32 | token)
                    if fits or fits is None and apart(before, token):
                        break
            else:
                raise ValueError("a byte is not in the vocabulary")
            last.append(token)

    def append(self, more: bytes) -> None:
        begin = len(self.text)
        self.text += more
        self._extend(begin, len(self.text))

    def become(self, text: bytes) -> None:
        """Turns into the table of text; the entries of the common prefix stay."""
        same = 0
        for a, b in zip(self.text, text):
            if a != b:
                break
            same += 1
        self.text = text
        del self.last[same + 1 :]
        self._extend(same, len(text))

    def replace(self, start: int, stop: int, new: bytes) -> int:
        """Puts new in place of text[start:stop]; returns how many entries were computed."""
        old, tail, longest = self.last, self.last[stop + 1 :], self.vocabulary.longest
        self.text = self.text[:start] + new + self.text[stop:]
        self.last = old[: start + 1]
        same, done = 0, 0
        for end in range(start + 1, len(self.text) + 1):
            self._extend(end - 1, end)
            done += 1
            beyond = end - start - len(new) - 1  # its place in tail
            same = same + 1 if beyond >= 0 and self.last[-1] == tail[beyond] else 0
            if same >= longest:  # later entries look back no further
                self.last += tail[beyond + 1 :]
                break
        return done

    def tokens(self) -> list[int]:
        """The encoding of the whole text, from its last token back."""
        out, end = [], len(self.text)
        while end:
            out.append(self.last[end])
            end -= len(self.vocabulary.tokens[out[-1]])
        return out[::-1]


#: Texts by which an encoder finds out whether a pattern can be matched segment by segment.
PROBE = ["It's  a\n\n test,  don't\t\tstop. ", " 1234 56\r\n\u00a0x\u3000y \n", "\u00e9t\u00e9 \u00c9T\u00c9!? \u4f60\u597d 'll  'LL 's\n x", "a_b (c)  [d]\n\n\n e\x0b\x0cf \u2028g"]


_BORDER = r"(?<=[A-Za-z])(?=[!-/:-@\[-`{-~])"
LETTERS, MARKS = (np.array([bool(re.match(f"[{c}]", chr(i))) for i in range(256)]) for c in ("A-Za-z", r"!-/:-@\[-`{-~"))
#: White space that is not ASCII, in UTF-8.
_WIDE = re.compile(rb"\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80")


class Segmented:
    """Encodes texts segment by segment: white space, and words with the space before them. Each distinct segment of a batch
    is looked up once; ``_learn`` gives the packed ids of those that are new."""

    def __init__(self, pattern: str):
        import regex

        self.split = regex.compile(pattern).findall
        segments = re.compile(f" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+").findall
        # in a pattern that the probes agree with, no match crosses the borders of segments
        self.by_segment = all(self.split(t) == [p for s in segments(t) for p in self.split(s)] for t in PROBE)
        # nor does one cross the border of an ASCII letter and a sign after it
        self.by_letters = self.by_segment and all(self.split(t) == [p for s in re.split(_BORDER, t) for p in self.split(s)] for t in PROBE)
        self.segments = segments if self.by_segment else self.split
        self.cache = Cache(SEGMENTS_MB)

    def _learn(self, segments: list[bytes]) -> list[bytes]:
        raise NotImplementedError

    def _cut(self, several: list[str]) -> tuple[bytes, np.ndarray, np.ndarray]:
        """The texts as bytes, where their segments begin, and how many each text has."""
        encoded = [t.encode() for t in several]
        data = b"".join(encoded)
        if not self.by_segment or _WIDE.search(data):
            split = [self.segments(t) for t in several]
            sizes = np.array([len(s.encode()) for ss in split for s in ss], np.int64)
            return data, np.cumsum(sizes) - sizes, np.array([len(ss) for ss in split], np.int64)
        raw = np.frombuffer(data, np.uint8)
        begins = np.cumsum([0, *map(len, encoded)])
        first = np.zeros(len(raw) + 1, bool)
        first[begins] = True
        space = SPACES[raw]
        before = np.empty_like(space)
        before[1:], before[:1] = space[:-1], False
        start = first[:-1] | (space & ~before)  # a text or a run of white space begins
        word = np.flatnonzero(~space & before & ~first[:-1])  # words after white space
        start[word[raw[word - 1] != 0x20]] = True
        start[word - 1] = True  # the last of the run goes with the word, or stands alone
        if self.by_letters:
            start[1:] |= LETTERS[raw[:-1]] & MARKS[raw[1:]]
        at = np.flatnonzero(start)
        return data, at, np.diff(np.searchsorted(at, begins))

    def encode_flat(self, several: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids (int32) of all texts in a row, and how many each has."""
        data, starts, segments = self._cut(several)
        which, strings = distinct(data, starts)
        ids, counts = spread(self.cache.look_up(strings, self._learn), which)
        ends = np.cumsum([0, *segments])
        upto = np.concatenate([[0], np.cumsum(counts)])
        return ids, np.diff(upto[ends])

    def encode_batch(self, several: list[str]) -> list[np.ndarray]:
        """The ids (int32) of each text."""
        ids, sizes = self.encode_flat(several)
        ends = np.cumsum(sizes)
        return [ids[b - n : b] for b, n in zip(ends, sizes)]


class Encoder(Segmented):
    """New segments are split into pieces, and new pieces go through the prefix table."""

    def __init__(self, vocabulary: Vocabulary, pattern: str):
        super().__init__(pattern)
        self.vocabulary = vocabulary
        self.packed = [np.int32(i).tobytes() for i in range(len(vocabulary.tokens))]
        self.pieces = Cache(PIECES_MB)
        self.strings = pa.array(vocabulary.tokens, pa.binary())
        self.decimals = pa.array([f"{i},".encode() for i in range(len(vocabulary.tokens))], pa.binary())

    def _learn_pieces(self, pieces: list[str]) -> list[bytes]:
        """The pieces' ids. They are taken in order, so that one table keeps the common prefixes."""
        rank, packed = self.vocabulary.rank.get, self.packed
        table, found = PrefixTable(self.vocabulary), {}
        for piece in sorted(pieces):
            data = piece.encode()
            token = rank(data)
            if token is not None:
                found[piece] = packed[token]
            else:
                table.become(data)
                found[piece] = b"".join([packed[t] for t in table.tokens()])
        return [found[p] for p in pieces]

    def _learn(self, segments: list[bytes]) -> list[bytes]:
        split = [self.split(s.decode()) for s in segments]
        pieces = list(set(chain.from_iterable(split)))
        found = dict(zip(pieces, self.pieces.look_up(pieces, self._learn_pieces)))
        return [found[ps[0]] if len(ps) == 1 else b"".join([found[p] for p in ps]) for ps in split]

    def joined(self, strings: pa.Array, ids: np.ndarray, sizes: np.ndarray) -> list[memoryview]:
        """Of each text, the joined strings of its ids."""
        taken = strings.take(pa.array(ids))
        offsets = np.frombuffer(taken.buffers()[1], np.int32)[taken.offset : taken.offset + len(ids) + 1]
        data, ends = memoryview(taken.buffers()[2] or b""), np.cumsum([0, *sizes])
        return [data[offsets[a] : offsets[b]] for a, b in zip(ends, ends[1:])]

    def decode_flat(self, ids: np.ndarray, sizes: np.ndarray) -> list[memoryview]:
        """The bytes of each text's ids."""
        return self.joined(self.strings, ids, sizes)


_encoders: dict[tuple, Encoder] = {}  # one for each vocabulary and pattern in a Python worker


def _encoder(shared, pattern: str) -> Encoder:
    key = (hash(tuple(shared.value.tokens)), pattern)
    if key not in _encoders:
        _encoders[key] = Encoder(shared.value, pattern)
    return _encoders[key]


_vocabularies: dict[str, Vocabulary] = {}


def vocabulary(path: str) -> Vocabulary:
    if path not in _vocabularies:
        _vocabularies[path] = Vocabulary(read_ranks(path))
    return _vocabularies[path]


def _share(df: DataFrame, path: str):
    # a vocabulary of fixed size (a few MB), not of the data's
    return df.sparkSession.sparkContext.broadcast(vocabulary(path))


def encoding(df: DataFrame, path: str, pattern: str) -> Callable[[list[str]], list[np.ndarray]]:
    """For tasks of other operators: the function that encodes a batch of texts."""
    shared = _share(df, path)
    return lambda several: _encoder(shared, pattern).encode_batch(several)


def encode_documents(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """One row (id, tokens array<int>, and the columns to carry) per row of df."""
    shared = _share(df, path)
    one = df.select(column(id_col).alias("id"), column(text_col).cast("string").alias("text"), together(list(carry)))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(shared, pattern).encode_flat
        for batch in pieces(batches, mb=4):
            ids, sizes = encode(texts(batch))
            yield pa.RecordBatch.from_arrays([batch.column("id"), list_array(ids, sizes, pa.int32()), batch.column("rest")], ["id", "tokens", "rest"])

    schema = one.select("id").schema.add("tokens", ArrayType(IntegerType())).add(one.schema["rest"])
    out = one.mapInArrow(run, schema)
    return out.select(F.col("id").alias(id_col), "tokens", *(F.col("rest").getField(c).alias(c) for c in carry))


def decode_documents(df: DataFrame, path: str, tokens_col: str = "tokens", into: str = "decoded") -> DataFrame:
    """df with the bytes of its tokens (null tokens: no bytes) in place of the tokens column."""
    shared = _share(df, path)
    keep = [c for c in df.columns if c not in (tokens_col, into)]
    schema = df.select(*keep).schema.add(into, "binary")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token = shared.value.tokens.__getitem__
        for batch in rows(batches, 1000):
            column = batch.column(tokens_col).fill_null([])
            flat, ends = column.flatten().to_pylist(), np.cumsum([0, *(len(x) for x in column)]) if batch.num_rows else [0]
            decoded = [b"".join(map(token, flat[a:b])) for a, b in zip(ends, ends[1:])]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(decoded, pa.binary())], schema=_arrow(batch, keep, into))

    return df.select(*keep, tokens_col).mapInArrow(run, schema)


def _arrow(batch: pa.RecordBatch, keep: list[str], into: str) -> pa.Schema:
    return pa.schema([*(batch.schema.field(c) for c in keep), pa.field(into, pa.binary())])


def digests(df: DataFrame, path: str, pattern: str) -> DataFrame:
    """The digest columns of op1. A task encodes a piece of its texts, decodes the ids and keeps the digests of both, so
    that neither ids nor decoded bytes leave it."""
    shared = _share(df, path)
    one = df.select("doc_id", F.col("text").cast("string").alias("text"))
    kind = one.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(shared, pattern)
        for batch in pieces(batches, mb=4):
            ids, sizes = encoder.encode_flat(texts(batch))
            coded = [sha256(x[:-1]).hexdigest() for x in encoder.joined(encoder.decimals, ids, sizes)]
            decoded = [sha256(x).hexdigest() for x in encoder.decode_flat(ids, sizes)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes), pa.array(coded, pa.string()), pa.array(decoded, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return one.mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
