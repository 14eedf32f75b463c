"""LM scoring with a small causal self-attention model over subword ids, trained in numpy.

Words are split into subwords of a public vocabulary by longest match. The model attends over a window of the subwords
before each position and predicts a class of the next one. Classes are single frequent subwords, clusters of others that
keep the same company, and the rest by frequency; within a class, subwords follow their counts in the whole training
corpus. A word's probability is that of its first class times a mixture of its share of the class in the corpus, as a
whole word, and of its spelling in subwords. Shares are smoothed as in the base score, where all words that training lacks
are one type: in each class those of its words and of that type add up to 1. Windows overlap: each holds some subwords as context
only, and every subword is scored once. Training is distributed: in each round tasks run Adam from the same weights through the
documents that are dealt to the round, piece by piece, and the weights are averaged. Each training document is in one round, with
all its windows.

Beside the model's score stands the base score, a unigram of words. The counts of words meet the documents in buckets of
packed words, where both scores are finished; the most frequent words, a bounded number, are resolved where the documents
are. How many these are changes no score.

Defined cases: null and empty texts are one end token; a null id counts as the empty text where folds are dealt; without
training documents all counts are 0 and the model keeps its first weights; equal rows are counted and scored each, as rows of their own; an
empty table gives an empty table; columns other than id and text are not read. Texts are scored whole. Words and subwords
are counted by 64-bit hashes and ids.
"""

from __future__ import annotations

from array import array
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers.models import WordPiece

from voltrail.llm.bpe import read_ranks
from voltrail.llm.common import Cache, distinct, pieces, spread, stored, texts
from voltrail.llm.substrings import Words

LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
#: The hash under which the end of a text is counted.
END = 1
#: MB of words that a Python worker remembers.
CACHE_MB = 64
#: Bytes that a short word has at most, and a name that no token has, as it is no byte's character.
SHORT, UNKNOWN = 64, "\u2603"


@dataclass(frozen=True)
class Shape:
    """Sizes of the model and of its training."""

    inputs: int = 2048  # most frequent subwords with an embedding of their own
    spare: int = 64  # embeddings that the others share
    single: int = 40  # most frequent subwords that are a class of their own
    clusters: int = 20  # classes of subwords that keep the same company
    clustered: int = 8192  # most frequent subwords that are put into clusters
    bins: int = 4  # classes of the others, by frequency
    width: int = 8
    context: int = 16  # subwords of a window that are context only
    step: int = 32  # subwords that a window scores
    rounds: int = 3  # each trains on the documents dealt to it
    passes: int = 1  # over the training documents
    batch: int = 128
    rate: float = 0.01
    known: int = 1 << 20  # most frequent words whose counts are sent to the documents; the others' meet them in buckets
    whole: float = 0.9  # weight of whole words against spellings

    @property
    def classes(self) -> int:
        return self.single + self.clusters + self.bins

    @property
    def span(self) -> int:
        return self.context + self.step


# words and subwords


def lowered(several: list[str]) -> Words:
    words = Words(several)
    words.norm = np.where((words.norm >= 65) & (words.norm <= 90), words.norm + np.uint8(32), words.norm)
    return words


class Subwords:
    """Ids of words by longest match over a vocabulary of byte strings; a word begins with a space."""

    def __init__(self, tokens: list[bytes]):
        self.rank = {t: i for i, t in enumerate(tokens) if t}
        self.longest = max(map(len, self.rank))
        self.end = len(tokens)
        self.cache = Cache(CACHE_MB)
        #: The same match in the tokenizers library, for words of few bytes (a byte is a character there); it needs all bytes to be known.
        whole = all(bytes([b]) in self.rank for b in range(256))
        self.model = whole and WordPiece({t.decode("latin-1"): i for t, i in self.rank.items()} | {UNKNOWN: self.end}, unk_token=UNKNOWN, max_input_chars_per_word=SHORT, continuing_subword_prefix="")

    def split_all(self, words: list[bytes]) -> list[bytes]:
        """As ``split``, of several words."""
        if not self.model:
            return list(map(self.split, words))
        match = self.model.tokenize
        return [self.split(w) if len(w) > SHORT else array("i", [x.id for x in match(" " + w[:-1].decode("latin-1"))]).tobytes() for w in words]

    def split(self, word: bytes) -> bytes:
        """The packed ids of a word with a space after it."""
        text, at, out, get = b" " + word[:-1], 0, [], self.rank.get
        while at < len(text):
            for stop in range(min(len(text), at + self.longest), at, -1):
                token = get(text[at:stop])
                if token is not None:
                    break
            else:
                raise ValueError("a byte is not in the vocabulary")
            out.append(token)
            at = stop
        return array("i", out).tobytes()


class Stream:
    """The subwords of several texts, an end after each, and their words and ends as entries in order."""

    def __init__(self, several: list[str], splitter: Subwords):
        words = lowered(several)
        n, bounds = len(several), np.append(words.first, len(words.stops))
        which, self.strings = distinct(words.norm.tobytes(), words.starts)
        self.packed = splitter.cache.look_up(self.strings, splitter.split_all)
        flat, sizes = spread(self.packed, which)
        before = np.concatenate([[0], np.cumsum(sizes)])
        self.ids = np.insert(flat, before[bounds[1:]], splitter.end)
        self.lengths = np.diff(before[bounds]) + 1
        #: Of each entry: its first id's place, its text, and its word's number among the distinct ones (that of an end is the last).
        self.begins = np.insert(before[:-1] + words.text, bounds[1:], before[bounds[1:]] + np.arange(n))
        self.text = np.insert(words.text, bounds[1:], np.arange(n))
        self.which = np.insert(which.astype(np.int64), bounds[1:], len(self.strings))

    def hashes(self) -> np.ndarray:
        """Of the distinct words and of the end."""
        return np.append(Words([b"".join(self.strings).decode()]).hashes(), np.uint64(END)).view(np.int64)

    def firsts(self, end: int) -> np.ndarray:
        """The first ids of the distinct words, and the end's."""
        return np.array([*(int.from_bytes(p[:4], "little") for p in self.packed), end], np.int64)


def windows(flat: np.ndarray, lengths: np.ndarray, shape: Shape, pad: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows of span + 1 ids (the targets are the last ``step``), the text of each, and which targets are real.

    A text is laid out as context + 1 pads, its ids, and pads up to a whole number of steps.
    """
    steps = -(-lengths // shape.step)
    size = shape.context + 1 + steps * shape.step
    begin = np.cumsum(size) - size
    laid = np.full(int(size.sum()), pad, np.int32)
    text = np.repeat(np.arange(len(lengths)), lengths)
    laid[np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths) + np.repeat(begin + shape.context + 1, lengths)] = flat
    of = np.repeat(np.arange(len(lengths)), steps)
    number = np.arange(len(of)) - np.repeat(np.cumsum(steps) - steps, steps)
    index = (begin[of] + number * shape.step)[:, None] + np.arange(shape.span + 1)
    real = number[:, None] * shape.step + np.arange(shape.step) < lengths[of][:, None]
    return laid[index], of, real


# the model


class Mapping:
    """What counts of subwords fix: input numbers, classes, and log probabilities within classes."""

    def __init__(self, counts: np.ndarray, firsts: np.ndarray, types: np.ndarray, company: np.ndarray, shape: Shape):
        """counts and firsts: of each subword, anywhere and at the beginning of words; types: how many different words it begins;
        company: of the subwords to be clustered (rows, by frequency), how often they are beside each single one."""
        n = len(counts)  # vocabulary and the end
        place = frequency_places(counts)
        self.input = np.where(place < shape.inputs, place, shape.inputs + np.arange(n) % shape.spare).astype(np.int32)
        self.input = np.append(self.input, shape.inputs + shape.spare).astype(np.int32)  # the pad
        tail = shape.single + shape.clusters
        spread = np.log((place + 1) / shape.single).clip(0) / np.log((n + 1) / shape.single)
        self.output = np.where(place < shape.single, place, tail + np.minimum((spread * shape.bins).astype(np.int64), shape.bins - 1)).astype(np.int32)
        middle = (place >= shape.single) & (place < shape.clustered) & (counts > 0)
        group = cluster(company, shape.clusters)
        self.output[middle] = shape.single + group[place[middle]]
        mass = np.bincount(self.output, counts + 0.5, shape.classes)
        self.within = np.log((counts + 0.5) / mass[self.output]).astype(np.float32)
        self.start = np.log(mass / mass.sum() + 1e-9).astype(np.float32)
        #: Counts of the words that begin with a class, each one more, and one for all that training lacks.
        self.word_mass = np.bincount(self.output, firsts + types, shape.classes) + 1


def frequency_places(counts: np.ndarray) -> np.ndarray:
    place = np.empty(len(counts), np.int64)
    place[np.argsort(-counts, kind="stable")] = np.arange(len(counts))
    return place


def cluster(company: np.ndarray, k: int, turns: int = 12) -> np.ndarray:
    """k-means on the directions of square roots of shares."""
    x = np.sqrt(company / np.maximum(company.sum(axis=1, keepdims=True), 1) + 1e-6)
    x -= x.mean(axis=0)
    x /= np.linalg.norm(x, axis=1, keepdims=True) + 1e-9
    centres = x[np.random.default_rng(5).permutation(len(x))[:k]]
    for _ in range(turns):
        near = np.argmax(x @ centres.T, axis=1)
        centres = np.stack([x[near == i].sum(axis=0) if (near == i).any() else centres[i] for i in range(len(centres))])
        centres /= np.linalg.norm(centres, axis=1, keepdims=True) + 1e-9
    return near


#: Scores that can't be farther from 0 need no shift before their exponentials are summed; windows whose arrays a core's cache holds.
LIMIT, CACHED = 60.0, 64


class Ready(NamedTuple):
    """Tables by input number, the scores of distances, and whether scores of pairs and of classes may be beyond the limit (``Model.ready``)."""

    query: np.ndarray
    key: np.ndarray
    value: np.ndarray
    skip: np.ndarray
    bias: np.ndarray
    steep: bool
    wide: bool


class Model:
    """One layer of causal self-attention; all weights in one vector."""

    def __init__(self, shape: Shape, start: np.ndarray, weights: np.ndarray | None = None):
        n, d, c = shape.inputs + shape.spare + 1, shape.width, shape.classes
        self.shape = shape
        self.parts = {"embed": (n, d), "query": (d, d), "key": (d, d), "value": (d, d), "skip": (d, d), "near": (shape.span + 1,), "out": (d, c), "bias": (c,)}
        if weights is None:
            draw = np.random.default_rng(11)
            weights = np.concatenate([
                start if k == "bias" else np.zeros(s) if k == "near" else (draw.normal(size=s) / (1 if k == "embed" else d**0.5)).ravel()
                for k, s in self.parts.items()
            ])
        self.vector = weights.astype(np.float32)
        self.w = self.views(self.vector)
        span = shape.span
        back = np.arange(shape.context, span)[:, None] - np.arange(span)[None, :]
        self.distance = np.where(back >= 0, back, span)
        self.mask = np.where(back >= 0, 0, -1e9).astype(np.float32)

    def views(self, vector: np.ndarray) -> dict[str, np.ndarray]:
        out, at = {}, 0
        for k, s in self.parts.items():
            size = int(np.prod(s))
            out[k] = vector[at : at + size].reshape(s)
            at += size
        return out

    def tables(self) -> tuple[np.ndarray, ...]:
        e = self.w["embed"]
        return tuple(np.ascontiguousarray(e @ self.w[k]) for k in ("query", "key", "value", "skip"))

    def forward(self, x: np.ndarray, tables: tuple[np.ndarray, ...]) -> tuple:
        """x: input numbers (windows, span). Attention weights, the hidden states and the class scores."""
        q, k, v, r = tables
        own = x[:, self.shape.context :]
        scores = np.matmul(q[own] * np.float32(self.shape.width**-0.5), k[x].transpose(0, 2, 1))
        scores += self.w["near"][self.distance] + self.mask
        scores -= scores.max(axis=2, keepdims=True)
        np.exp(scores, out=scores)
        scores /= scores.sum(axis=2, keepdims=True)
        hidden = np.matmul(scores, v[x])
        hidden += r[own]
        np.maximum(hidden, 0, out=hidden)
        flat = hidden.reshape(-1, self.shape.width)
        return scores, flat, flat @ self.w["out"] + self.w["bias"]

    def ready(self) -> Ready:
        """What ``scorer`` and ``gradient`` need of the weights: tables instead of projections, with a column of ones beside the values that gives the
        sums, and whether scores can be so large that they must be shifted by their largest."""
        q, k, v, r = self.tables()
        q, near = q * np.float32(self.shape.width**-0.5), self.w["near"]
        top = np.maximum(v.max(axis=0) + r.max(axis=0), 0)  # of the hidden states, as values are averaged
        steep = float(np.linalg.norm(q, axis=1).max() * np.linalg.norm(k, axis=1).max() + np.abs(near).max())
        wide = float((top @ np.abs(self.w["out"]) + np.abs(self.w["bias"])).max())
        return Ready(q, k, np.hstack([v, np.ones((len(v), 1), np.float32)]), r, near[self.distance] + self.mask, not steep <= LIMIT, not wide <= LIMIT)

    def attend(self, t: Ready, x: np.ndarray) -> tuple[np.ndarray, ...]:
        """Of input numbers (windows, span): attention before it is divided by its sums, these, what it averages, hidden states, and the
        scores of the classes; with the gathered keys, values and queries. It computes what ``forward`` does."""
        own = x[:, self.shape.context :]
        kx, vx, qo = t.key.take(x, axis=0), t.value.take(x, axis=0), t.query.take(own, axis=0)
        att = np.matmul(qo, kx.transpose(0, 2, 1))
        att += t.bias
        if t.steep:
            att -= att.max(axis=2, keepdims=True)
        np.exp(att, out=att)
        mixed = np.matmul(att, vx)
        total = mixed[:, :, -1:]
        mean = mixed[:, :, :-1] / total
        hidden = t.skip.take(own, axis=0)
        hidden += mean
        np.maximum(hidden, 0, out=hidden)
        hidden = hidden.reshape(-1, self.shape.width)
        logits = hidden @ self.w["out"]
        logits += self.w["bias"]
        if t.wide:
            logits -= logits.max(axis=1, keepdims=True)
        return kx, vx, qo, att, total, mean, hidden, logits

    def scorer(self) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
        """A function of input numbers (windows, span) and classes (windows, step): natural logs of the probabilities of the
        classes."""
        t, ones = self.ready(), np.ones(self.shape.classes, np.float32)

        def score(x: np.ndarray, classes: np.ndarray) -> np.ndarray:
            logits = self.attend(t, x)[-1]
            chosen = logits.ravel().take(np.arange(len(logits)) * self.shape.classes + classes.ravel())
            np.exp(logits, out=logits)
            return (chosen - np.log(logits @ ones)).reshape(classes.shape)

        return score

    def gradient(self, x: np.ndarray, classes: np.ndarray, real: np.ndarray) -> np.ndarray:
        """Of the mean loss over the real targets; some windows at a time, as many as a core's cache holds."""
        s, w, t = self.shape, self.w, self.ready()
        e, width, ones = w["embed"], s.width, np.ones(s.classes, np.float32)
        weights = (real / max(1, real.sum())).astype(np.float32)
        grad, near, parts = np.zeros_like(self.vector), np.zeros_like(t.bias), []
        g = self.views(grad)
        for start in range(0, len(x), CACHED):
            some = slice(start, start + CACHED)
            kx, vx, qo, att, total, mean, hidden, odds = self.attend(t, x[some])
            np.exp(odds, out=odds)
            weight = weights[some].ravel()
            odds *= (weight / (odds @ ones))[:, None]
            odds.ravel()[np.arange(len(odds)) * s.classes + classes[some].ravel()] -= weight
            g["out"] += hidden.T @ odds
            g["bias"] += np.ones(len(odds), np.float32) @ odds
            dh = ((odds @ w["out"].T) * (hidden > 0)).reshape(mean.shape)
            part = dh / total
            dv = np.matmul(att.transpose(0, 2, 1), part)
            # the mean's share stands in the column of ones, so that one product gives what the attention is multiplied by
            att *= np.matmul(np.concatenate([part, -(part * mean).sum(axis=2, keepdims=True)], axis=2), vx.transpose(0, 2, 1))
            near += att.sum(axis=0)
            parts.append((np.matmul(att, kx) * np.float32(width**-0.5), np.matmul(att.transpose(0, 2, 1), qo), dv, dh))
        dq, dk, dv, dh = (np.concatenate(p).reshape(-1, width) for p in zip(*parts))
        ex, eo = e.take(x.ravel(), axis=0), e.take(x[:, s.context :].ravel(), axis=0)
        g["near"][:] = np.bincount(self.distance.ravel(), near.ravel(), s.span + 1)
        g["near"][s.span] = 0
        g["query"][:], g["skip"][:] = eo.T @ dq, eo.T @ dh
        g["key"][:], g["value"][:] = ex.T @ dk, ex.T @ dv
        dx = dk @ w["key"].T + dv @ w["value"].T
        dx.reshape(len(x), s.span, width)[:, s.context :] += (dq @ w["query"].T + dh @ w["skip"].T).reshape(len(x), s.step, width)
        for i in range(width):
            g["embed"][:, i] = np.bincount(x.ravel(), dx[:, i], len(e))
        return grad


class Adam:
    """Steps on a model's weights."""

    def __init__(self, model: Model, rate: float):
        self.model, self.rate, self.t = model, rate, 0
        self.m, self.v = np.zeros_like(model.vector), np.zeros_like(model.vector)

    def fit(self, x: np.ndarray, classes: np.ndarray, real: np.ndarray) -> None:
        """One pass over the windows, in drawn order."""
        order, size = np.random.default_rng(self.t).permutation(len(x)), self.model.shape.batch
        for start in range(0, len(x), size):
            own = order[start : start + size]
            g = self.model.gradient(x[own], classes[own], real[own])
            self.t += 1
            self.m += 0.1 * (g - self.m)
            self.v += 0.01 * (g * g - self.v)
            self.model.vector -= np.float32(self.rate) * (self.m / (1 - 0.9**self.t)) / (np.sqrt(self.v / (1 - 0.99**self.t)) + np.float32(1e-8))


# Spark jobs


def _documents(df: DataFrame) -> DataFrame:
    fold = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(7))
    return df.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), (fold == 2).alias("held_out"))


_splitters: dict[int, Subwords] = {}


def _splitter(tokens: list[bytes]) -> Subwords:
    """The splitter of this vocabulary, by its content; a worker keeps one."""
    key = hash(tuple(tokens))
    if key not in _splitters:
        _splitters.clear()
        _splitters[key] = Subwords(tokens)
    return _splitters[key]


def gather(docs: DataFrame, shared, shape: Shape) -> DataFrame:
    """From the training documents: counts of words (kind 0, key a hash, first their first subword) and of subwords (kind 1, key
    an id; kind 3: at the beginning of words), summed per task, and each document's packed subwords (kind 2)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splitter = _splitter(shared.value)
        seen: list[tuple[np.ndarray, ...]] = []
        ids_seen, firsts_seen = np.zeros(splitter.end + 1, np.int64), np.zeros(splitter.end + 1, np.int64)
        for batch in pieces(batches, mb=4):
            s = Stream(texts(batch), splitter)
            counts, firsts = np.bincount(s.which, minlength=len(s.strings) + 1), s.firsts(splitter.end)
            seen.append((s.hashes(), counts, firsts))
            ids_seen += np.bincount(s.ids, minlength=len(ids_seen))
            firsts_seen += np.bincount(firsts, counts, len(ids_seen)).astype(np.int64)
            ends = np.cumsum(s.lengths)
            yield _kinds(2, None, None, None, [s.ids[b - n : b].tobytes() for b, n in zip(ends, s.lengths)])
            if len(seen) >= 8:
                yield _sums(seen)
                seen = []
        if seen:
            yield _sums(seen)
        for kind, counts in ((1, ids_seen), (3, firsts_seen)):
            there = np.flatnonzero(counts)
            yield _kinds(kind, there, counts[there], there, None)

    def _sums(seen: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        h, c, f = (np.concatenate(x) for x in zip(*seen))
        keys, place, inverse = np.unique(h, return_index=True, return_inverse=True)
        return _kinds(0, keys, np.bincount(inverse, c).astype(np.int64), f[place], None)

    def _kinds(kind: int, keys, counts, firsts, ids) -> pa.RecordBatch:
        n = len(keys if ids is None else ids)
        numbers = [pa.nulls(n, pa.int64()) if x is None else pa.array(x, pa.int64()) for x in (keys, counts, firsts)]
        column = pa.nulls(n, pa.binary()) if ids is None else pa.array(ids, pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(np.full(n, kind, np.int32)), *numbers, column], ["kind", "key", "count", "first", "ids"])

    return docs.where("NOT held_out").select("text").mapInArrow(run, "kind int, key long, count long, first long, ids binary")


def _unpacked(batches: Iterable[pa.RecordBatch], mb: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The subwords of several documents in a row, and how many each has."""
    for batch in pieces(batches, mb=mb, column="ids"):
        several = batch.column("ids").to_pylist()
        yield np.frombuffer(b"".join(several), np.int32), np.array([len(x) // 4 for x in several], np.int64)


def frequent_words(counts: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes (in order) and counts of the words from that count on which at most so many words reach."""
    total, least = 0, 1 << 62
    for c, k in counts.groupBy("count").agg(F.count("*").alias("k")).orderBy(F.desc("count")).collect():  # a row per frequency
        if total + k > most:
            break
        total, least = total + k, c
    table = counts.where(F.col("count") >= F.lit(least)).toArrow()
    keys, found = table.column("key").to_numpy(), table.column("count").to_numpy()
    order = np.argsort(keys)
    return keys[order], found[order]


def company_of(documents: DataFrame, counts: np.ndarray, shape: Shape) -> np.ndarray:
    """How often each of the most frequent subwords stands one or two places after, and before, each single one."""
    shared = documents.sparkSession.sparkContext.broadcast(frequency_places(counts))
    width = 2 * shape.single

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(shape.clustered * width, np.int64)
        for flat, lengths in _unpacked(batches, 4):
            place, text = shared.value[flat], np.repeat(np.arange(len(lengths)), lengths)
            for step in (1, 2):
                a, b, one = place[:-step], place[step:], text[:-step] == text[step:]
                for x, y, shift in ((a, b, 0), (b, a, shape.single)):
                    own = one & (x < shape.single) & (y >= shape.single) & (y < shape.clustered)
                    sums += np.bincount(y[own] * width + x[own] + shift, minlength=len(sums))
        there = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(there), pa.array(sums[there])], ["place", "n"])

    table = documents.select("ids").mapInArrow(run, "place long, n long").groupBy("place").agg(F.sum("n").alias("n")).toArrow()  # of the model's size
    out = np.zeros(shape.clustered * width)
    out[table.column("place").to_numpy()] = table.column("n").to_numpy()
    return out.reshape(shape.clustered, width)


def train(spark: SparkSession, documents: DataFrame, mapping: Mapping, shape: Shape) -> np.ndarray:
    """The weights after some rounds in parallel, averaged after each. documents: ids."""
    model = Model(shape, mapping.start)
    blocks = 64
    width = -(-len(model.vector) // blocks)
    for number in range(shape.rounds * shape.passes):
        shared = spark.sparkContext.broadcast((mapping, model.vector))
        rate = shape.rate * (1 - number / (shape.rounds * shape.passes))

        def run(batches: Iterable[pa.RecordBatch], shared=shared, rate=rate) -> Iterator[pa.RecordBatch]:
            mapping, vector = shared.value
            adam, n, pad = Adam(Model(shape, mapping.start, vector.copy()), rate), 0, len(mapping.output)
            for flat, lengths in _unpacked(batches, 1):
                ids, _, real = windows(flat, lengths, shape, pad)
                adam.fit(mapping.input[ids[:, :-1]], mapping.output[np.minimum(ids[:, shape.context + 1 :], pad - 1)], real)
                n += len(ids)
            if n:
                padded = np.zeros(blocks * width, np.float32)
                padded[: len(vector)] = adam.model.vector
                yield pa.RecordBatch.from_arrays([pa.array(range(blocks), pa.int32()), pa.array([b.tobytes() for b in padded.reshape(blocks, width)], pa.binary()), pa.array([n] * blocks, pa.int64())], ["block", "weights", "n"])

        def mean(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums: dict[int, list] = {}
            for b in batches:
                for block, weights, n in zip(*(b.column(c).to_pylist() for c in ("block", "weights", "n"))):
                    have = sums.setdefault(block, [np.zeros(width), 0])
                    have[0] += n * np.frombuffer(weights, np.float32).astype(np.float64)
                    have[1] += n
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([(s / n).astype(np.float32).tobytes() for s, n in sums.values()], pa.binary())], ["block", "weights"])

        own = documents.where(F.pmod(F.xxhash64("ids"), F.lit(shape.rounds)) == number % shape.rounds)
        trained = own.select("ids").mapInArrow(run, "block int, weights binary, n long")
        averaged = trained.repartition("block").sortWithinPartitions("block", "n", "weights").mapInArrow(mean, "block int, weights binary")
        rows = sorted(averaged.collect())  # the model's own size
        if rows:
            model = Model(shape, mapping.start, np.frombuffer(b"".join(bytes(r["weights"]) for r in rows), np.float32)[: len(model.vector)].copy())
    return model.vector


def model_scores(docs: DataFrame, shared, shape: Shape, buckets: int) -> DataFrame:
    """Per document: row (a number of its own), doc_id, held_out, n_tokens, score (whose words that are not hot lack their mixture); and
    of the hot words, hot_known and hot_logs. Beside them, rows of the words that are not hot: bucket (of their hash), packed.

    shared: the subwords' strings, the mapping, the weights, and the hot words' hashes (in order) and counts.
    """
    names = ["row", "doc_id", "held_out", "n_tokens", "score", "hot_known", "hot_logs", "bucket", "packed"]
    kinds = [pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.float64(), pa.int64(), pa.float64(), pa.int64(), pa.binary()]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, mapping, vector, hot, counts = shared.value
        splitter, model = _splitter(tokens), Model(shape, mapping.start, vector)
        score, next_row = model.scorer(), TaskContext.get().partitionId() << 36
        within, output = np.append(mapping.within, np.float32(0)), np.append(mapping.output, 0)
        for batch in pieces(batches, mb=1):
            n = batch.num_rows
            s = Stream(texts(batch), splitter)
            ids, _, real = windows(s.ids, s.lengths, shape, splitter.end + 1)
            logs = []
            for start in range(0, len(ids), CACHED):
                some = ids[start : start + CACHED]
                found = score(mapping.input[some[:, :-1]], output[some[:, shape.context + 1 :]])
                logs.append(found[real[start : start + CACHED]])
            classes = np.concatenate(logs).astype(np.float64)  # of each id, in order
            first = classes[s.begins]
            spelled = np.add.reduceat(classes + within[s.ids], s.begins) - first
            h = s.hashes()
            known, place = _among(hot, h)  # of the distinct words
            times = np.where(known, counts[place] if len(counts) else 0, 0)
            mass = mapping.word_mass[output[s.firsts(splitter.end)]]
            which, times, mass = known[s.which], times[s.which], mass[s.which]
            first[which] += mixture(times[which], mass[which], spelled[which], shape)
            of = s.text[which]
            row = next_row + np.arange(n)
            next_row += n
            columns = [pa.array(row), batch.column("doc_id"), batch.column("held_out"), pa.array(np.bincount(s.text, minlength=n)), pa.array(np.bincount(s.text, first, n) / np.log(10)), pa.array(np.bincount(of, times[which] > 0, n).astype(np.int64)), pa.array(np.bincount(of, np.log10(times[which] + 1.0), n), pa.float64())]
            yield pa.RecordBatch.from_arrays([*columns, *(pa.nulls(n, k) for k in kinds[7:])], names)
            training = ~batch.column("held_out").to_numpy(zero_copy_only=False)
            full, packs = _bucketed(h[s.which][~which], s.text[~which], mass[~which], spelled[~which], row, training, buckets)
            if packs:
                yield pa.RecordBatch.from_arrays([*(pa.nulls(len(packs), k) for k in kinds[:7]), pa.array(full, pa.int64()), pa.array(packs, pa.binary())], names)

    return docs.mapInArrow(run, "row long, doc_id long, held_out boolean, n_tokens long, score double, hot_known long, hot_logs double, bucket long, packed binary")


def mixture(counts: np.ndarray, mass: np.ndarray, spelled: np.ndarray, shape: Shape) -> np.ndarray:
    """Logs of the probabilities of words within their first classes: shares of the class as whole words, and spellings."""
    return np.log(shape.whole * (counts + 1) / mass + (1 - shape.whole) * np.exp(spelled) + 1e-300)


def _bucketed(h: np.ndarray, text: np.ndarray, mass: np.ndarray, spelled: np.ndarray, row: np.ndarray, training: np.ndarray, buckets: int) -> tuple[np.ndarray, list[bytes]]:
    """The words by the bucket of their hash: the buckets that have any, and what goes there."""
    order = np.lexsort((text, h))
    order = order[np.argsort((h[order].view(np.uint64) % np.uint64(buckets)).astype(np.int64), kind="stable")]
    h, text, mass, spelled = (x[order] for x in (h, text, mass, spelled))
    cuts = np.searchsorted((h.view(np.uint64) % np.uint64(buckets)).astype(np.int64), np.arange(buckets + 1))
    full = np.flatnonzero(np.diff(cuts))
    return full, [_pack(*(x[cuts[b] : cuts[b + 1]] for x in (h, text, mass, spelled)), row, training) for b in full]


def _among(hot: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each hash is among the hot ones (in order), and where."""
    if not len(hot):
        return np.zeros(len(h), bool), np.zeros(len(h), np.int64)
    place = np.minimum(np.searchsorted(hot, h), len(hot) - 1)
    return hot[place] == h, place


def rest_sums(sent: DataFrame, shape: Shape) -> DataFrame:
    """Of the words that are not hot, per document: row, n_known, logs (the sum of log10(count + 1)), mixed (the sum of log10
    of their mixtures).

    sent: bucket, packed. In the bucket of a word its training counts are added up, and its logs are given back to the
    documents, so a word's count is exact however rare it is.
    """
    def meet(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            for b, packed in zip(*(batch.column(c).to_pylist() for c in ("bucket", "packed"))):
                if b != now and held:
                    yield _meet(held, shape)
                    held = []
                now = b
                held.append(packed)
        if held:
            yield _meet(held, shape)

    met = sent.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(meet, "row long, n_known long, logs double, mixed double")
    return met.groupBy("row").agg(*(F.sum(c).alias(c) for c in ("n_known", "logs", "mixed")))


def _changes(values: np.ndarray) -> np.ndarray:
    out = np.ones(len(values), bool)
    out[1:] = values[1:] != values[:-1]
    return out


#: Of a packed bucket: hashes of words, rows, whether they are for training; per word its entries and the smoothed mass of its
#: first class, per entry its text and the log probability of its spelling.
_LAYOUT = ("i8", "i8", "u1", "u4", "f8", "u4", "f8")


def _pack(h: np.ndarray, text: np.ndarray, mass: np.ndarray, spelled: np.ndarray, row: np.ndarray, training: np.ndarray) -> bytes:
    rows, inner = np.unique(text, return_inverse=True)
    first = np.flatnonzero(_changes(h))
    parts = (h[first], row[rows], training[rows], np.diff(np.append(first, len(h))), mass[first], inner, spelled)
    sizes = np.array([len(p) for p in parts], np.int64)
    return sizes.tobytes() + zstandard.compress(b"".join(p.astype(k).tobytes() for p, k in zip(parts, _LAYOUT)), 1)


def _unpack(blob: bytes) -> list[np.ndarray]:
    head = 8 * len(_LAYOUT)
    sizes = np.frombuffer(blob[:head], np.int64)
    body, at, parts = zstandard.decompress(blob[head:]), 0, []
    for kind, size in zip(_LAYOUT, sizes):
        parts.append(np.frombuffer(body, kind, size, at))
        at += parts[-1].nbytes
    return parts


def _meet(held: list[bytes], shape: Shape) -> pa.RecordBatch:
    """The sums per row of one bucket."""
    opened = [_unpack(blob) for blob in held]
    keys, word = np.unique(np.concatenate([p[0] for p in opened]), return_inverse=True)
    spread = np.repeat(word, np.concatenate([p[3] for p in opened]))  # the word of each entry
    row = np.concatenate([p[1][p[5]] for p in opened])
    training = np.concatenate([p[2][p[5]] for p in opened])
    mass = np.concatenate([np.repeat(p[4], p[3]) for p in opened])
    spelled = np.concatenate([p[6] for p in opened])
    counts = np.bincount(spread, training, len(keys))
    rows, of = np.unique(row, return_inverse=True)
    known = np.bincount(of, (counts > 0)[spread], len(rows)).astype(np.int64)
    logs = np.bincount(of, np.log10(counts + 1)[spread], len(rows))
    mixed = np.bincount(of, mixture(counts[spread], mass, spelled, shape), len(rows)) / np.log(10)
    return pa.RecordBatch.from_arrays([pa.array(rows), pa.array(known), pa.array(logs), pa.array(mixed)], ["row", "n_known", "logs", "mixed"])


def scores(df: DataFrame, ranks: str, shape: Shape = Shape()) -> DataFrame:
    """op5: per document doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spark = df.sparkSession
    docs = _documents(df)
    tokens = read_ranks(ranks)
    strings = spark.sparkContext.broadcast(tokens)  # a vocabulary of fixed size
    found = stored(gather(docs, strings, shape), "lm-gathered")
    counts = stored(found.where("kind = 0").groupBy("key").agg(F.sum("count").alias("count"), F.min("first").alias("first")), "lm-words")
    n, v = counts.agg(F.coalesce(F.sum("count"), F.lit(0)), F.count("*")).first()
    hot, hot_counts = frequent_words(counts.select("key", "count"), shape.known)
    by_id, firsts, types = (np.zeros(len(tokens) + 1) for _ in range(3))
    for r in found.where("kind IN (1, 3)").groupBy("kind", "key").agg(F.sum("count").alias("count")).collect():  # of the vocabulary's size
        (by_id if r["kind"] == 1 else firsts)[r["key"]] = r["count"]
    for r in counts.groupBy("first").agg(F.count("*").alias("types")).collect():  # of the vocabulary's size
        types[r["first"]] = r["types"]
    documents = found.where("kind = 2").select("ids")
    mapping = Mapping(by_id, firsts, types, company_of(documents, by_id, shape), shape)
    vector = train(spark, documents, mapping, shape)
    shared = spark.sparkContext.broadcast((tokens, mapping, vector, hot, hot_counts))
    made = stored(model_scores(docs, shared, shape, 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))), "lm-scored")
    scored = made.where("bucket IS NULL").drop("bucket", "packed")
    sums = rest_sums(made.where("bucket IS NOT NULL").select("bucket", "packed"), shape)
    both = scored.join(sums, "row", "left")
    known = F.col("hot_known") + F.coalesce("n_known", F.lit(0))
    logs = F.col("hot_logs") + F.coalesce("logs", F.lit(0.0))
    score = F.col("score") + F.coalesce("mixed", F.lit(0.0))
    base = logs - F.col("n_tokens") * F.lit(float(np.log10(n + v + 1)))
    return both.select("doc_id", "held_out", "n_tokens", known.alias("n_known"), F.lit(int(n)).alias("train_tokens"), base.alias("base_score"), score.alias("score"))
