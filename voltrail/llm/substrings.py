"""Substring dedup by super-k-mers: words that a window shares with a document of a smaller id are removed.

A window is some number of consecutive words. Each window has a minimiser, the least hash of its runs of a few words.
Consecutive windows with one minimiser form a super-k-mer, whose words travel as one packed string to the bucket of the
minimiser; equal windows have equal minimisers and so meet there. A task keeps, per distinct string, only the smallest
id it has seen and where: an occurrence in a larger id is known to be covered at once. So copies are folded before the
shuffle, and a bucket needs memory for its distinct strings only, however often each occurs. Strings that differ are then
compared window by window, by their words.

Defined cases: null and empty texts have no words; rows with a null id neither cover others nor are covered; rows of
equal ids never cover each other, and rows with the same id and text get the same result; windows are judged on the
input; an empty table gives an empty table. Columns other than id and text are not read. Texts are taken whole.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voltrail.llm.common import SPACES, column, pieces, texts, together

#: An odd factor and its inverse modulo 2**64: hashes of words from sums over a text.
FACTOR = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
#: MB of text that a task folds before it sends its buckets.
FOLD_MB = 16
_powers: dict[str, np.ndarray] = {}


def _power(name: str, factor: np.uint64, n: int) -> np.ndarray:
    have = _powers.get(name)
    if have is None or len(have) < n:
        full = np.full(max(n, 1 << 21), factor, np.uint64)
        full[0] = 1
        _powers[name] = have = np.cumprod(full, dtype=np.uint64)
    return have[:n]


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


class Words:
    """The words of several texts, one space after each, with their places, hashes and texts. outside: which bytes are no part
    of a word."""

    def __init__(self, several: list[str], outside: np.ndarray = SPACES):
        encoded = [t.encode() for t in several]
        data = np.frombuffer(b"\n".join([*encoded, b""]), np.uint8)
        space = outside[data]
        before = np.concatenate([[True], space[:-1]])[: len(space)]
        begins = np.flatnonzero(~space & before)
        self.text = np.searchsorted(np.cumsum([0, *(len(e) + 1 for e in encoded)]), begins, "right") - 1
        keep = ~(space & before)
        norm = np.where(space, np.uint8(0x20), data)[keep]
        self.stops = np.flatnonzero(norm == 0x20)
        self.starts = np.concatenate([[0], self.stops[:-1] + 1])[: len(self.stops)].astype(np.int64)
        self.norm = norm
        self.first = np.searchsorted(self.text, np.arange(len(several)))  # the texts' first words

    def hashes(self) -> np.ndarray:
        if not len(self.stops):
            return np.empty(0, np.uint64)
        sums = np.cumsum((self.norm.astype(np.uint64) + np.uint64(1)) * _power("up", FACTOR, len(self.norm)), dtype=np.uint64)
        upto = sums[self.stops] - np.where(self.starts > 0, sums[self.starts - 1], np.uint64(0))
        return mixed(upto * _power("down", INVERSE, len(self.norm))[self.starts])


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """The minimum of each run of so many values."""
    done, out = 1, values
    while done * 2 <= width:
        out = np.minimum(out[:-done], out[done:])
        done *= 2
    rest = width - done
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def super_kmers(words: Words, window: int, run: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and last window (by first word) of each super-k-mer, and its minimiser."""
    h = words.hashes()
    n = len(h) - window + 1
    if n <= 0:
        return (np.empty(0, np.int64),) * 2 + (np.empty(0, np.uint64),)
    runs = np.zeros(len(h) - run + 1, np.uint64)
    for i in range(run):
        runs = runs * np.uint64(0xD6E8FEB86659FD93) + h[i : i + len(runs)]
    least = sliding_min(mixed(runs), window - run + 1)
    whole = words.text[:n] == words.text[window - 1 :]
    change = np.concatenate([[True], (least[1:] != least[:-1]) | (words.text[1:n] != words.text[: n - 1])])
    begins = np.flatnonzero(whole & (change | ~np.concatenate([[False], whole[:-1]])))
    ends_here = whole & np.concatenate([change[1:] | ~whole[1:], [True]])
    return begins, np.flatnonzero(ends_here), least[begins]


class Folded:
    """Distinct strings, each with its smallest id and its occurrences there; and what is known to be covered."""

    def __init__(self):
        self.best: dict[bytes, list] = {}  # string -> [minimiser, id, text hash, start, more (hash, start)...]
        self.covered: list[tuple[int, int, int, int]] = []  # id, text hash, first word, number of words

    def add(self, string: bytes, minimiser: int, doc: int, text: int, start: int) -> None:
        have = self.best.get(string)
        if have is None:
            self.best[string] = [minimiser, doc, text, start]
        elif doc > have[1]:
            self.covered.append((doc, text, start, string.count(b" ") + 1))
        elif doc == have[1]:
            have += (text, start)
        else:
            n = string.count(b" ") + 1
            self.covered += [(have[1], have[i], have[i + 1], n) for i in range(2, len(have), 2)]
            self.best[string] = [minimiser, doc, text, start]

    def pack(self) -> bytes:
        strings = b"\n".join(self.best)
        flat = [x for b in self.best.values() for i in range(2, len(b), 2) for x in (b[1], b[i], b[i + 1])]
        entries = np.array(flat, np.int64).reshape(-1, 3)
        counts = np.array([(len(b) - 2) // 2 for b in self.best.values()], np.uint32)
        minimisers = np.array([b[0] for b in self.best.values()], np.uint32)
        covered = np.array(self.covered, np.int64).reshape(-1, 4)
        head = np.array([len(strings), len(counts), len(entries), len(covered)], np.int64)
        body = [strings, counts.tobytes(), minimisers.tobytes()]
        body += [a.T[i].astype(k).tobytes() for a, kinds in ((entries, ("i8", "u4", "u4")), (covered, ("i8", "u4", "u4", "u4"))) for i, k in enumerate(kinds)]
        return head.tobytes() + zstandard.compress(b"".join(body), 3)

    def unpack(self, blob: bytes) -> None:
        """Adds what was packed."""
        size, n, m, k = np.frombuffer(blob[:32], np.int64).tolist()
        body = zstandard.decompress(blob[32:])
        at = size

        def take(kind: str, count: int) -> list[int]:
            nonlocal at
            out = np.frombuffer(body, kind, count, at)
            at += out.nbytes
            return out.tolist()

        counts, minimisers = take("u4", n), take("u4", n)
        entries = zip(take("i8", m), take("u4", m), take("u4", m))
        covered = zip(take("i8", k), take("u4", k), take("u4", k), take("u4", k))
        self.covered += covered
        for string, count, minimiser in zip(body[:size].split(b"\n") if n else (), counts, minimisers):
            for _ in range(count):
                self.add(string, minimiser, *next(entries))

    def resolve(self, window: int) -> None:
        """Compares the windows of distinct strings; what smaller ids have too is covered."""
        groups: dict[int, list[bytes]] = defaultdict(list)
        for string, b in self.best.items():
            groups[b[0]].append(string)
        for strings in groups.values():
            if len(strings) == 1 or len({self.best[s][1] for s in strings}) == 1:
                continue
            first: dict[bytes, int] = {}
            own = []
            for s in strings:
                doc, cuts = self.best[s][1], [-1, *_spaces(s), len(s)]
                parts = [s[cuts[i] + 1 : cuts[i + window]] for i in range(len(cuts) - window)]
                own.append(parts)
                for p in parts:
                    if first.setdefault(p, doc) > doc:
                        first[p] = doc
            for s, parts in zip(strings, own):
                b = self.best[s]
                begin = None
                for i, p in enumerate([*parts, None]):
                    hit = p is not None and first[p] < b[1]
                    if hit and begin is None:
                        begin = i
                    elif not hit and begin is not None:
                        self.covered += [(b[1], b[j], b[j + 1] + begin, i - begin + window - 1) for j in range(2, len(b), 2)]
                        begin = None


def _spaces(s: bytes) -> list[int]:
    return np.flatnonzero(np.frombuffer(s, np.uint8) == 0x20).tolist()


def covered_words(df: DataFrame, window: int, run: int, buckets: int) -> DataFrame:
    """Rows (doc_id, text_hash, start, n): n words from start on that df's row doc_id shares with smaller ids."""

    def send(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, Folded] = defaultdict(Folded)
        size = 0
        for batch in pieces(batches, mb=2):
            words = Words(texts(batch))
            begins, ends, least = super_kmers(words, window, run)
            docs, hashes = batch.column("doc_id").to_pylist(), batch.column("text_hash").to_pylist()
            of = words.text[begins]
            where = zip((least % np.uint64(buckets)).tolist(), (least >> np.uint64(32)).tolist(), of.tolist(), (begins - words.first[of]).tolist(), words.starts[begins].tolist(), words.stops[ends + window - 1].tolist())
            norm = words.norm.tobytes()
            for bucket, minimiser, t, start, a, b in where:
                held[bucket].add(norm[a:b], minimiser, docs[t], hashes[t], start)
            size += len(norm)
            if size > FOLD_MB * 1_000_000:
                yield _sent(held)
                size = 0
        yield _sent(held)

    def _sent(held: dict[int, Folded]) -> pa.RecordBatch:
        keys = list(held)
        out = pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array([held.pop(k).pack() for k in keys], pa.binary())], ["bucket", "packed"])
        return out

    def meet(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, folded = None, Folded()
        for batch in batches:
            for bucket, packed in zip(batch.column("bucket").to_pylist(), batch.column("packed")):
                if bucket != now:
                    yield _found(folded)
                    now, folded = bucket, Folded()
                folded.unpack(packed.as_py())
                if len(folded.covered) > 100_000:
                    yield _rows(folded)
        yield _found(folded)

    def _found(folded: Folded) -> pa.RecordBatch:
        folded.resolve(window)
        return _rows(folded)

    def _rows(folded: Folded) -> pa.RecordBatch:
        table = np.array(folded.covered, np.int64).reshape(-1, 4)
        folded.covered.clear()
        return pa.RecordBatch.from_arrays([pa.array(table[:, 0]), pa.array(table[:, 1]), *(pa.array(table[:, i].astype(np.int32)) for i in (2, 3))], ["doc_id", "text_hash", "start", "n"])

    sent = df.where("doc_id IS NOT NULL").select("doc_id", "text_hash", "text").mapInArrow(send, "bucket long, packed binary")
    return sent.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(meet, "doc_id long, text_hash long, start int, n int")


def remove_repeats(df: DataFrame, window: int = 13, run: int = 2, joined: bool = False, id_col: str = "doc_id", text_col: str = "text", counts: tuple[str, ...] = ("n_words", "n_removed")) -> DataFrame:
    """df's columns with the kept text in place of the text, and the numbers of words and of removed words under the names in counts (or
    without them, if there are none); a name that df has already is an error. Other columns may have any names.

    The kept text has its white space as it was, without that after removed words; if joined, one space between words.
    A run of ``run`` words is hashed for minimisers; the buckets are a few per shuffle partition.
    """
    if set(counts) & set(df.columns):
        raise ValueError(f"columns {counts} are there already")
    spark = df.sparkSession
    buckets = 8 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    rest = [c for c in df.columns if c not in (id_col, text_col)]
    text = F.coalesce(column(text_col).cast("string"), F.lit(""))
    keyed = df.select(column(id_col).cast("long").alias("doc_id"), text.alias("text"), (F.xxhash64(text).bitwiseAND(F.lit(0xFFFFFFFF))).alias("text_hash"), together(rest))
    spans = covered_words(keyed, window, run, buckets)
    # the spans of a document are no more than its windows
    grouped = spans.groupBy("doc_id", "text_hash").agg(F.collect_list(F.struct("start", "n")).alias("spans")).hint("shuffle_hash")
    both = keyed.join(grouped, ["doc_id", "text_hash"], "left")
    schema = both.select("doc_id", "rest").schema.add("text", "string").add("n_words", "long").add("n_removed", "long")

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            found = [_cut(t, s, joined) for t, s in zip(texts(batch), batch.column("spans").to_pylist())]
            kept, n, removed = zip(*found)
            arrays = [batch.column("doc_id"), batch.column("rest"), pa.array(kept, pa.string()), pa.array(n, pa.int64()), pa.array(removed, pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "rest", "text", "n_words", "n_removed"])

    out = both.select("doc_id", "rest", "text", "spans").mapInArrow(cut, schema)
    columns = {id_col: F.col("doc_id").cast(df.schema[id_col].dataType), text_col: F.col("text")}
    named = [(columns[c] if c in columns else F.col("rest").getField(c)).alias(c) for c in df.columns]
    return out.select(*named, *(F.col(own).alias(c) for own, c in zip(("n_words", "n_removed"), counts)))


def _cut(text: str, spans: list[dict] | None, joined: bool) -> tuple[str, int, int]:
    """The kept text, the number of words and how many of them are removed."""
    data = text.encode()
    words = data.split()  # of bytes: by ASCII white space alone
    if not spans:
        return (b" ".join(words).decode() if joined else text), len(words), 0
    gone = np.zeros(len(words) + 1, np.int32)
    np.add.at(gone, [s["start"] for s in spans], 1)
    np.add.at(gone, [s["start"] + s["n"] for s in spans], -1)
    gone = np.cumsum(gone[:-1]) > 0
    if joined:
        return b" ".join([w for w, g in zip(words, gone) if not g]).decode(), len(words), int(gone.sum())
    places = np.frombuffer(data, np.uint8)
    space = SPACES[places]
    number = np.cumsum(~space & np.concatenate([[True], space[:-1]])) - 1  # of the word at or before each byte
    keep = np.where(number >= 0, ~gone[np.maximum(number, 0)], True)
    return places[keep].tobytes().decode(), len(words), int(gone.sum())


def digests(df: DataFrame) -> DataFrame:
    """The columns of op2."""
    kept = remove_repeats(df.select("doc_id", "text"), joined=True)
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


#: DuckDB SQL for ``digests``.
ORACLE = r"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
windows AS (SELECT r, doc_id, p, list_slice(w, p, p + 12) AS k FROM docs, unnest(range(1, len(w) - 11)) AS u(p)),
later AS (SELECT r, p FROM (SELECT *, min(doc_id) OVER (PARTITION BY k) AS least FROM windows) WHERE least < doc_id),
gone AS (SELECT DISTINCT r, p + i AS p FROM later, range(13) AS x(i)),
lists AS (SELECT r, list(p) AS ps FROM gone GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(len(ps), 0)::BIGINT AS n_removed,
       sha256(array_to_string(CASE WHEN ps IS NULL THEN w ELSE list_filter(w, lambda a, i: NOT list_contains(ps, i)) END, ' ')) AS kept_sha256
FROM docs LEFT JOIN lists USING (r)"""
