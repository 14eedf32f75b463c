"""Ranked lexical search by presence masks.

One pass over the documents keeps, of each, its number of terms and its occurrences of the queries' terms. Documents then stream
in blocks through the tasks that hold them. In a block, bits are set for each item's terms in the words of a mask per
document, and the documents of equal masks are a group. A mask's terms bound the scores of its group: each adds at most the
largest contribution that it makes in the block. Groups are scored by descending bound, until the bound falls below the tenth score
that the task has found for the item; no document of the groups left can be among the ten. The tasks' best are merged, in two steps.

Scores: terms are the maximal runs of letters A-Z (lower-cased), a-z, digits and characters beyond ASCII. N counts the documents with
terms, L their terms with repeats, n a document's, df the documents that hold a term, tf its occurrences in one. A term weighs
w = floor(1000 * ln((2N + 2) / (2df + 1))), m is 25 + (75 n N) div L, and a document's score sums
w * ((10**9 tf) div (1000 tf + 8m)) over the item's terms, repeats included, in 64-bit integers.

Defined cases: null and empty texts have no terms; items without terms, or whose terms no document holds, have no rows; every row is a
document or an item of its own, also with an id that repeats; rows with a null id count like others and come last among equal
scores; an empty table gives an empty table; other columns are not read. Texts are taken whole.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from voltrail.llm.common import list_array, pieces, stored, texts
from voltrail.llm.substrings import Words

#: Which bytes are no part of a term.
OUTSIDE = np.array([i < 0x80 and not chr(i).isalnum() for i in range(256)])
TERM_SQL = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: MB of items that are searched for in one pass; documents and occurrences of a block; documents scored at a time.
ITEMS_MB, BLOCK, OCCURRENCES, STEP = 16, 32_768, 2_000_000, 512
_LAST = np.iinfo(np.int64).max


def terms_of(several: list[str]) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The distinct terms of the texts, each with a space behind it, and of each occurrence its term and its text."""
    words = Words(several, OUTSIDE)
    data = np.where((words.norm >= 65) & (words.norm <= 90), words.norm + np.uint8(32), words.norm)
    offsets = np.append(words.starts, len(data)).astype(np.int64)
    coded = pa.Array.from_buffers(pa.large_binary(), len(words.starts), [None, pa.py_buffer(offsets), pa.py_buffer(data.tobytes())]).dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy(), words.text


def postings(df: DataFrame, vocabulary: list[bytes]) -> DataFrame:
    """Per row of df (doc_id, text): doc_id, n, and the vocabulary's terms that it holds with how often."""
    shared = df.sparkSession.sparkContext.broadcast(vocabulary)  # of one block of items

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = pa.array(shared.value, pa.large_binary())
        for batch in pieces(batches, mb=4):
            strings, which, text = terms_of(texts(batch))
            number = pc.fill_null(pc.index_in(strings, wanted), -1).to_numpy(zero_copy_only=False)[which] if len(which) else which
            has = number >= 0
            key, tf = np.unique(text[has].astype(np.int64) * len(wanted) + number[has], return_counts=True)
            doc, term = np.divmod(key, max(1, len(wanted)))
            held = np.bincount(doc, minlength=batch.num_rows)
            n = np.bincount(text, minlength=batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), list_array(term.astype(np.int32), held, pa.int32()), list_array(tf.astype(np.int32), held, pa.int32())], ["doc_id", "n", "terms", "tf"])

    return df.mapInArrow(run, "doc_id long, n long, terms array<int>, tf array<int>")


class Best:
    """The highest scores so far, equal ones by ascending id, missing ids last."""

    def __init__(self, k: int):
        self.k, self.score, self.doc, self.lost = k, np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool)

    @property
    def least(self) -> int:
        """What a document must reach."""
        return int(self.score[-1]) if len(self.score) == self.k else 1

    def add(self, score: np.ndarray, doc: np.ndarray, lost: np.ndarray) -> None:
        score, doc, lost = (np.concatenate(x) for x in ((self.score, score), (self.doc, doc), (self.lost, lost)))
        order = np.lexsort((doc, lost, -score))[: self.k]
        self.score, self.doc, self.lost = score[order], doc[order], lost[order]


class Block:
    """Documents side by side: for each term the rows that hold it, in order, with what it adds to their scores."""

    def __init__(self, doc: np.ndarray, lost: np.ndarray, n: np.ndarray, held: np.ndarray, term: np.ndarray, tf: np.ndarray, weights: np.ndarray, count: int, length: int):
        self.doc, self.lost = doc, lost
        row = np.repeat(np.arange(len(doc)), held)
        m = 25 + 75 * n.astype(np.int64) * count // length
        tf = tf.astype(np.int64)
        adds = weights[term] * (1_000_000_000 * tf // (1000 * tf + 8 * m[row]))
        order = np.argsort(term, kind="stable")
        self.row, self.adds = row[order], adds[order]
        self.begins = np.searchsorted(term[order], np.arange(len(weights) + 1))
        some = np.flatnonzero(np.diff(self.begins))
        self.most = np.zeros(len(weights), np.int64)
        if len(some):
            self.most[some] = np.maximum.reduceat(self.adds, self.begins[some])

    def _of(self, term: int) -> slice:
        return slice(self.begins[term], self.begins[term + 1])

    def search(self, terms: list[tuple[int, int]], best: Best) -> int:
        """Adds an item's (terms, each with its number) best documents; returns how many were scored."""
        terms = [(t, q) for t, q in terms if self.begins[t] < self.begins[t + 1]]
        if not terms or sum(q * int(self.most[t]) for t, q in terms) < best.least:
            return 0
        masks = np.zeros((-(-len(terms) // 64), len(self.doc)), np.uint64)
        for j, (t, _) in enumerate(terms):
            masks[j // 64, self.row[self._of(t)]] |= np.uint64(1) << np.uint64(j % 64)
        rows = np.flatnonzero(np.bitwise_or.reduce(masks, axis=0))
        group = np.zeros(len(rows), np.int64)
        for word in masks:  # equal masks get equal numbers, word by word
            distinct, at = np.unique(word[rows], return_inverse=True)
            group = np.unique(group * len(distinct) + at, return_inverse=True)[1]
        one = np.empty(group.max() + 1, np.int64)
        one[group] = rows  # a document of each group
        bound = np.zeros(len(one), np.int64)
        for j, (t, q) in enumerate(terms):
            bound += np.where(masks[j // 64, one] >> np.uint64(j % 64) & np.uint64(1) != 0, q * self.most[t], 0)
        order = np.argsort(-bound[group], kind="stable")
        rows, bounds = rows[order], bound[group][order]
        done = 0
        while done < len(rows) and bounds[done] >= best.least:
            upto = min(done + STEP, int(np.searchsorted(-bounds, -best.least, "right")))
            at = np.sort(rows[done:upto])
            score = np.zeros(len(at), np.int64)
            for t, q in terms:
                held, adds = self.row[self._of(t)], self.adds[self._of(t)]
                place = np.searchsorted(held, at)
                place[place == len(held)] = 0
                score += np.where(held[place] == at, q * adds[place], 0)
            fit = score >= best.least
            best.add(score[fit], self.doc[at[fit]], self.lost[at[fit]])
            done = upto
        return done


def _blocks(batches: Iterable[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """Blocks of rows: ids (and whether they are missing), n, how many terms each holds, the terms and how often."""
    held: list[list[np.ndarray]] = []
    docs = many = 0
    for batch in batches:
        for start in range(0, batch.num_rows, 1024):
            b = batch.slice(start, 1024)
            doc, terms, tf = b.column("doc_id"), b.column("terms"), b.column("tf")
            flat = terms.flatten().to_numpy(zero_copy_only=False)
            held.append([pc.fill_null(doc, _LAST).to_numpy(), doc.is_null().to_numpy(zero_copy_only=False), b.column("n").to_numpy(), pc.list_value_length(terms).to_numpy(), flat, tf.flatten().to_numpy(zero_copy_only=False)])
            docs, many = docs + b.num_rows, many + len(flat)
            if docs >= BLOCK or many >= OCCURRENCES:
                yield [np.concatenate(x) for x in zip(*held)]
                held, docs, many = [], 0, 0
    if held:
        yield [np.concatenate(x) for x in zip(*held)]


def _best_of(found: DataFrame, k: int) -> DataFrame:
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    # a task sends k rows of an item at most; several tasks' are merged before all meet
    some = found.withColumn("r", F.row_number().over(W.partitionBy("item", "share").orderBy(*order))).where(F.col("r") <= k)
    return some.withColumn("rank", F.row_number().over(W.partitionBy("item").orderBy(*order))).where(F.col("rank") <= k).drop("r", "share")


def _searched(df: DataFrame, items: list, k: int) -> DataFrame:
    """item_id, rank, doc_id, score for a block of items (rows of item_id and text)."""
    strings, which, text = terms_of([r["text"] or "" for r in items])
    asked = [sorted(Counter(which[a:b].tolist()).items()) for a, b in zip(*(lambda at: (at[:-1], at[1:]))(np.searchsorted(text, np.arange(len(items) + 1))))]
    spark = df.sparkSession
    found = stored(postings(df, strings.to_pylist()), "postings")
    total = found.agg(F.count(F.when(F.col("n") > 0, 1)).alias("count"), F.sum("n").alias("length")).first()
    count, length = total["count"], total["length"] or 1
    weights = np.zeros(len(strings), np.int64)
    for r in found.select(F.explode("terms").alias("t")).groupBy("t").count().collect():  # a row per term of the items
        weights[r["t"]] = math.floor(1000 * math.log((2 * count + 2) / (2 * r["count"] + 1)))
    shared = spark.sparkContext.broadcast((asked, weights))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, weights = shared.value
        best = [Best(k) for _ in asked]
        for block in _blocks(batches):
            here = Block(*block, weights, count, length)
            for terms, own in zip(asked, best):
                here.search(terms, own)
        item = np.repeat(np.arange(len(best)), [len(b.doc) for b in best])
        doc, lost, score = (np.concatenate([getattr(b, c) for b in best]) for c in ("doc", "lost", "score"))
        yield pa.RecordBatch.from_arrays([pa.array(item, pa.int32()), pa.array(doc, mask=lost), pa.array(score)], ["item", "doc_id", "score"])

    ids = spark.createDataFrame([(i, r["item_id"]) for i, r in enumerate(items)], "item int, item_id long")  # of one block
    made = found.where(F.size("terms") > 0).mapInArrow(run, "item int, doc_id long, score long").withColumn("share", F.spark_partition_id() % 64)
    return _best_of(made, k).join(F.broadcast(ids), "item").select("item_id", "rank", "doc_id", "score")


def search(df: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """item_id, rank (from 1), doc_id, score: the k best rows of df (doc_id, text) with scores above 0 for each row of items (item_id, text).

    Items are taken in blocks of about ITEMS_MB, as each block's terms go to every task; a block is one pass over the documents.
    """
    docs = df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    asked = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    size = asked.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 16)).first()[0] or 0
    blocks = -(-size // int(ITEMS_MB * 1_000_000)) or 1
    dealt = asked.withColumn("block", F.pmod(F.xxhash64("item_id", F.monotonically_increasing_id()), F.lit(blocks)))
    dealt = dealt if blocks == 1 else stored(dealt, "items")
    parts = [_searched(docs, dealt.where(F.col("block") == b).orderBy("item_id", "text").collect(), k) for b in range(blocks)]
    return reduce(DataFrame.unionByName, parts)


#: DuckDB SQL for ``search``.
ORACLE = rf"""
WITH pieces AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{TERM_SQL}') AS ts FROM documents),
asked AS (SELECT row_number() OVER () AS i, item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{TERM_SQL}') AS ts FROM benchmark),
total AS (SELECT count(*) FILTER (len(ts) > 0) AS c, sum(len(ts))::BIGINT AS l FROM pieces),
tf AS (SELECT r, t, count(*) AS f FROM (SELECT r, unnest(ts) AS t FROM pieces) GROUP BY r, t),
weights AS (SELECT t, floor(1000 * ln((2 * c + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM tf, total GROUP BY t, c),
sizes AS (SELECT r, doc_id, 100 - 75 + (75 * len(ts) * c) // l AS m FROM pieces, total WHERE len(ts) > 0),
wanted AS (SELECT i, item_id, t, count(*) AS q FROM (SELECT i, item_id, unnest(ts) AS t FROM asked) GROUP BY ALL),
scored AS (SELECT i, item_id, doc_id, r, sum(q * w * ((1000000000 * f) // (1000 * f + 8 * m)))::BIGINT AS score
  FROM wanted JOIN weights USING (t) JOIN tf USING (t) JOIN sizes USING (r) GROUP BY i, item_id, doc_id, r),
places AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id ASC NULLS LAST) AS rank FROM scored WHERE score > 0)
SELECT item_id, rank::INT AS rank, doc_id, score FROM places WHERE rank <= 10"""
