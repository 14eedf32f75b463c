"""Search of similar cases: blocks of queries against blocks of references, distances of pairs, selection, weights."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence
from math import ceil
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyarrow import compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from voltrail.functions.columns import array_count, array_mean, array_std, bound, clip01
from voltrail.functions.ranks import exact, sketched
from voltrail.functions.storage import in_order, stored, streamed


#: MB that the queries of a cell and what is kept for them may take.
CELL_MB = 160


def search(queries: DataFrame, refs: DataFrame, k: int, metric: str = "cosine", cells: int | None = None) -> DataFrame:
    """query, ref, score and rank of the k best references of each query; as ``search_lists``, a row for each."""
    found = search_lists(queries, refs, k, metric, cells)
    return found.select("query", F.posexplode("found").alias("_at", "_f")).select("query", "_f.ref", "_f.score", (F.col("_at") + 1).alias("rank"))


def references(refs: DataFrame, cells: int | None = None) -> list[str]:
    """The files of a search's references, stored in order of their ids (``search_lists``)."""
    return in_order(_side(refs), "references", "id", cells or int(refs.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def _side(df: DataFrame) -> DataFrame:
    extra = [c for c in ("group", "until", "kind") if c in df.columns]
    whole = df.where(F.col("id").isNotNull() & F.col("vector").isNotNull() & F.forall(F.col("vector").cast("array<double>"), lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False))))
    tagged = whole if "tag" in df.columns else whole.withColumn("tag", F.lit(0))
    return tagged.select(F.col("id").cast("long").alias("id"), F.col("tag").cast("long").alias("tag"), F.col("vector").cast("array<double>").alias("vector"), *(F.col(c).cast("long").alias(c) for c in extra))


def search_lists(queries: DataFrame, refs: DataFrame | list[str], k: int, metric: str = "cosine", cells: int | None = None, serve: int | None = None) -> DataFrame:
    """query, its tag, and found: an array of ref, score and tag of its k best references, best first; with serve, of these only as many as hold the
    first so many that may serve (``servable``).

    Both sides: id (long, unique), vector, and optionally group, until, kind, tag (long; a tag only comes along). References of a query's own
    id or group, those that end after the query (until) and those of another kind are left out before the choice; so are rows of either side whose
    vector is missing or has an element that is missing or not finite. References are stored once, in order of their ids (or come as the files of ``references``), and stream
    through the cells: a cell has a block of queries and meets all of them or, where queries are too few for about so many cells (unless given, as many as the tasks that run at
    once), a part. There are more cells if a cell's queries would take more than CELL_MB. Only lists of parts are shuffled and merged, so there are no more parts than tasks need. A cell keeps its k best, of equals the smaller ids.
    Scores (l2: squared distances) are those of the elements themselves, however far the vectors lie from 0; products of blocks only choose which pairs are computed.
    """
    asked, files = _side(queries), refs if isinstance(refs, list) else references(refs, cells)
    extra = asked.columns[3:]
    spare = cells or queries.sparkSession.sparkContext.defaultParallelism
    cells = cells or int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = asked.agg(F.count("*").alias("n"), F.max(F.size("vector")).alias("width")).first()
    fit = max(64, int(CELL_MB * 1e6 / (24 * (k + 2 * TILE) + 12 * (size["width"] or 1))))
    down = max(1, ceil(size["n"] / fit), min(cells, ceil(size["n"] / SLICE)))
    aside = min(max(1, ceil(spare / down)), max(1, len(files)))
    parts = F.explode(F.sequence(F.lit(0), F.lit(aside - 1)))
    dealt = asked.withColumn("part", parts).withColumn("cell", (F.pmod(F.xxhash64("id"), F.lit(down)) * aside + F.col("part")).cast("int"))
    found = dealt.repartitionById(down * aside, "cell").drop("cell").mapInArrow(_nearest(k, metric, extra, files, aside, serve), LISTS)
    if aside > 1:
        found = found.repartition("query").sortWithinPartitions("query").mapInArrow(_merged(k, metric), LISTS)
    return found.select("query", "tag", F.arrays_zip(F.col("refs").alias("ref"), F.col("scores").alias("score"), F.col("tags").alias("tag")).alias("found"))


#: Rows between the two steps of a search.
LISTS = "query long, tag long, refs array<long>, scores array<double>, tags array<long>"
#: References that meet a slice of a cell's queries at once, the queries of a slice, and the references that a query may gain before its best are told apart.
BLOCK, SLICE, TILE = 2048, 1024, 256


def _lists(query: np.ndarray, tag: np.ndarray, sizes: np.ndarray, refs: np.ndarray, scores: np.ndarray, tags: np.ndarray) -> pa.RecordBatch:
    """A row for each query, which has the next so many of the references."""
    ends = pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())
    lists = [pa.ListArray.from_arrays(ends, pa.array(x)) for x in (refs, scores, tags)]
    return pa.RecordBatch.from_arrays([pa.array(query), pa.array(tag), *lists], ["query", "tag", "refs", "scores", "tags"])


def _places(hits: np.ndarray) -> np.ndarray:
    """Where a few hits are, as ``np.flatnonzero``; eight are looked at at once."""
    flat = hits.ravel()
    if len(flat) % 8:
        return np.flatnonzero(flat)
    words = np.flatnonzero(flat.view(np.uint64))
    word, place = np.divmod(np.flatnonzero(flat.reshape(-1, 8)[words]), 8)
    return words[word] * 8 + place


class _Kept:
    """For each query of a cell its k best references so far, and those that came since they were last told apart. References come by ascending
    id, so of equal scores those that came first stay. Scores are such that less is better; limit is a query's k-th one."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, given: dict[str, np.ndarray], k: int, metric: str):
        self.ids, self.given, self.k, self.metric, self.vectors = ids, given, k, metric, vectors
        self.norms = (vectors * vectors).sum(axis=1)
        self.rough = -vectors.astype(np.float32) if metric == "cosine" else vectors
        shape = (len(ids), k + 2 * TILE)
        self.score, self.ref, self.tag = np.full(shape, np.inf), np.full(shape, -1, np.int64), np.zeros(shape, np.int64)
        self.filled, self.limit = np.zeros(len(ids), np.int64), np.full(len(ids), np.inf)

    def _free(self, q: np.ndarray, r: dict[str, np.ndarray], j: np.ndarray) -> np.ndarray:
        """Whether the references may serve the queries, pair by pair."""
        out = self.ids[q] != r["id"][j]
        if "group" in r:
            out &= self.given["group"][q] != r["group"][j]
        if "until" in r:
            out &= self.given["until"][q] >= r["until"][j]
        if "kind" in r:
            out &= self.given["kind"][q] == r["kind"][j]
        return out

    def meet(self, q: slice, r: dict[str, np.ndarray], vectors: np.ndarray) -> None:
        """A block of references. Those that rounding may have put too far are computed anew."""
        limit, own = self.limit[q], self.vectors[q]
        if len(vectors) > TILE and not np.isfinite(limit).all():  # while nothing bounds them, all are computed
            for at in range(0, len(vectors), TILE):
                self.meet(q, {c: x[at : at + TILE] for c, x in r.items()}, vectors[at : at + TILE])
            return
        if self.metric == "cosine":  # of unit vectors, in single precision
            d = self.rough[q] @ vectors.astype(np.float32).T
            edge = limit + 4 * np.finfo(np.float32).eps * (vectors.shape[1] + 8)
        else:
            norms = (vectors * vectors).sum(axis=1)
            d = self.norms[q, None] + norms - 2 * (self.rough[q] @ vectors.T)
            edge = limit + 16 * np.finfo(float).eps * vectors.shape[1] * (self.norms[q] + norms.max())
        i, j = np.divmod(_places(d <= edge.astype(d.dtype)[:, None]), len(vectors))
        free = self._free(q.start + i, r, j)
        i, j = i[free], j[free]
        score = np.empty(len(i))
        for start in range(0, len(i), 65_536):
            at = slice(start, start + 65_536)
            a, b = own[i[at]], vectors[j[at]]
            score[at] = -(a * b).sum(axis=1) if self.metric == "cosine" else ((a - b) ** 2).sum(axis=1)
        keep = score < limit[i]
        i, j, score = i[keep], j[keep], score[keep]
        if not len(i):
            return
        if np.bincount(i).max() <= TILE:
            self._add(q, i, j, score, r)
            return
        for start in range(0, len(vectors), TILE):
            some = (j >= start) & (j < start + TILE) & (score < self.limit[q][i])
            if some.any():
                self._add(q, i[some], j[some], score[some], r)

    def _add(self, q: slice, i: np.ndarray, j: np.ndarray, score: np.ndarray, r: dict[str, np.ndarray]) -> None:
        """At most TILE references for each query, in order of the queries and then of the references."""
        row, new = q.start + i, np.bincount(i)
        place = self.filled[row] + np.arange(len(row)) - np.repeat(np.cumsum(new) - new, new)
        self.score[row, place], self.ref[row, place], self.tag[row, place] = score, r["id"][j], r["tag"][j]
        self.filled[q.start : q.start + len(new)] += new
        self._told(q.start + np.flatnonzero(self.filled[q] > self.k + TILE))

    def _told(self, rows: np.ndarray) -> None:
        """Of the rows that have more than k, the k best stay, in the order in which they came."""
        if not len(rows):
            return
        s = self.score[rows]
        last = np.partition(s, self.k - 1, axis=1)[:, self.k - 1 : self.k]
        less, equal = s < last, s == last
        keep = less | (equal & (np.cumsum(equal, axis=1) <= self.k - less.sum(axis=1, keepdims=True)))  # k of each row
        for x in (self.ref, self.tag):
            x[rows, : self.k] = x[rows][keep].reshape(-1, self.k)
        self.score[rows, : self.k], self.score[rows, self.k :] = s[keep].reshape(-1, self.k), np.inf
        self.filled[rows], self.limit[rows] = self.k, last[:, 0]

    def rows(self, serve: int | None) -> Iterator[pa.RecordBatch]:
        """A list for each query that found any, best first, which ends with the last that is needed."""
        for start in range(0, len(self.ids), TILE):
            self._told(start + np.flatnonzero(self.filled[start : start + TILE] > self.k))
            some = start + np.flatnonzero(self.filled[start : start + TILE])
            order = np.argsort(self.score[some, : self.k], axis=1, kind="stable")
            score, ref, tag = (np.take_along_axis(x[some, : self.k], order, axis=1) for x in (self.score, self.ref, self.tag))
            take = np.arange(self.k) < self.filled[some, None]
            if serve is not None:
                may = (tag >= 0) & (tag != self.given["tag"][some, None]) & (ref != self.ids[some, None])
                take &= np.cumsum(may, axis=1) - may < serve
            yield _lists(self.ids[some], self.given["tag"][some], take.sum(axis=1), ref[take], -score[take] if self.metric == "cosine" else score[take], tag[take])


def _nearest(k: int, metric: str, extra: list[str], files: list[str], aside: int, serve: int | None):
    names = ["id", "tag", *extra]

    def matrix(column: pa.Array) -> np.ndarray:
        v = column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)
        return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12) if metric == "cosine" else v

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = [b for b in batches if b.num_rows]
        if not asked:
            return
        part = asked[0].column("part")[0].as_py()  # a task has one cell
        given = {c: np.concatenate([b.column(c).to_numpy() for b in asked]) for c in names}
        kept = _Kept(given["id"], np.concatenate([matrix(b.column("vector")) for b in asked]), given, k, metric)
        del asked
        for batch in streamed(files[part * len(files) // aside : (part + 1) * len(files) // aside], [*names, "vector"], BLOCK):
            r, vectors = {c: batch.column(c).to_numpy() for c in names}, matrix(batch.column("vector"))
            for start in range(0, len(kept.ids), SLICE):
                kept.meet(slice(start, start + SLICE), r, vectors)
        yield from kept.rows(serve)

    return run


def _merged(k: int, metric: str):
    """Of each query's lists, which come one after the other, the k best, of equals the smaller ids."""

    def best(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        flat = lambda c: np.concatenate([p.column(c).flatten().to_numpy() for p in parts])
        refs, scores, tags = flat("refs"), flat("scores"), flat("tags")
        top = np.lexsort((refs, -scores if metric == "cosine" else scores))[:k]
        one = lambda c: parts[0].column(c).to_numpy()[:1]
        return _lists(one("query"), one("tag"), np.array([len(top)]), refs[top], scores[top], tags[top])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts = None, []
        for batch in batches:
            query = batch.column("query").to_numpy()
            cuts = [0, *(np.flatnonzero(query[1:] != query[:-1]) + 1).tolist(), len(query)]
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                if query[a] != now and parts:
                    yield best(parts)
                    parts = []
                now = query[a]
                parts.append(batch.slice(a, b - a))
        if parts:
            yield best(parts)

    return run


def servable(found: DataFrame, m: int) -> DataFrame:
    """query, ref, score and rank of the first m of each query's found references (``search_lists``) that may serve: tags are cells, -1 for those that
    never may, and a query's own cell does not serve it."""
    may = F.filter("found", lambda x: (x["tag"] >= 0) & (x["tag"] != F.col("tag")) & (x["ref"] != F.col("query")))
    return found.select("query", F.posexplode(F.slice(may, 1, m)).alias("_at", "_f")).select("query", "_f.ref", "_f.score", (F.col("_at") + 1).alias("rank"))


#: Pairs, and queries among them, that a task holds; four times as many while the cases stream by, as each time reads all of them.
PAIRS, ASKED = 500_000, 8192


class Made(NamedTuple):
    """Numbers of pairs that the task that finds their sides makes in place of these: what is prepared of some cases (columns as a table), the numbers
    of pairs of prepared cases (places in both), and their names."""

    prepare: Callable[[pa.Table], object]
    compare: Callable[[object, np.ndarray, object, np.ndarray], Sequence[np.ndarray]]
    names: Sequence[str]


def with_sides(pairs: DataFrame, cases: DataFrame, key: str = "id", files: Sequence[str] | None = None, made: Made | None = None, kept: Sequence[str] | None = None) -> DataFrame:
    """pairs (query, ref and other numbers) with the columns of their two cases, as q_… and r_…; cases: a key (long, unique) and columns.

    The cases are stored once, in any order; if they are already, in files that have these columns, nothing is stored. A task holds some of its pairs, looks up their queries and lets the cases stream by, so that neither pairs nor
    what they carry are shuffled. Pairs should come query by query, as a search gives them. Of the sides' columns only those kept come out, if they are named, and numbers made of both sides come after them.
    """
    names, types = [c for c in cases.columns if c != key], dict(cases.dtypes)
    kept = [f"{p}_{c}" for p in "qr" for c in names] if kept is None else list(kept)
    files = sorted(files or stored(cases.withColumn(key, F.col(key).cast("long")), "sides").inputFiles())
    schema = ", ".join([f"`{c}` {t}" for c, t in pairs.dtypes] + [f"`{c}` {types[c[2:]]}" for c in kept] + [f"`{c}` double" for c in (made.names if made else ())])
    own = {p: [c[2:] for c in kept if c[0] == p] for p in "qr"}

    def told(held: pa.Table) -> Iterator[pa.RecordBatch]:
        query, ref = held.column("query").to_numpy(), held.column("ref").to_numpy()
        asked, order = np.unique(query), np.argsort(ref, kind="stable")
        sought, parts = ref[order], []
        for batch in streamed(files, [key, *names], 4096):
            some = np.isin(batch.column(key).to_numpy(), asked)
            if some.any():
                parts.append(batch.filter(pa.array(some)))
        if not parts:
            return
        left = pa.Table.from_batches(parts).combine_chunks().sort_by(key)
        known = left.column(key).to_numpy()
        queries = made.prepare(left) if made else None
        for batch in streamed(files, [key, *names], 4096):
            low, high = (np.searchsorted(sought, batch.column(key).to_numpy(), side) for side in ("left", "right"))
            some = np.flatnonzero(high > low)
            if not len(some):
                continue
            right, low, high = pa.Table.from_batches([batch]).take(some), low[some], high[some]
            found, upto = high - low, np.cumsum(high - low)
            refs = made.prepare(right) if made else None
            for start in range(0, int(upto[-1]), 4096):
                n = np.arange(start, min(start + 4096, int(upto[-1])))  # of the batch's pairs
                j = np.searchsorted(upto, n, "right")
                at = order[low[j] + n - (upto[j] - found[j])]
                i = np.searchsorted(known, query[at]).clip(max=len(known) - 1)
                both = known[i] == query[at]
                at, i, j = at[both], i[both], j[both]
                sides = {"q": left.select(own["q"]).take(i), "r": right.select(own["r"]).take(j)}
                columns = [*held.take(at).columns, *(sides[c[0]].column(c[2:]) for c in kept)]
                arrays = [pa.concat_arrays(c.chunks) if c.num_chunks else pa.array([], c.type) for c in columns]
                numbers = [pa.array(x) for x in made.compare(queries, i, refs, j)] if made else []
                yield pa.RecordBatch.from_arrays([*arrays, *numbers], [*held.column_names, *kept, *(made.names if made else ())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, queries = [], 0, 0
        for batch in batches:
            held.append(batch)
            n, queries = n + batch.num_rows, queries + len(np.unique(batch.column("query").to_numpy()))
            if n >= 4 * PAIRS or queries >= 4 * ASKED:
                yield from told(pa.Table.from_batches(held).combine_chunks())
                held, n, queries = [], 0, 0
        if n:
            yield from told(pa.Table.from_batches(held).combine_chunks())

    return pairs.where("query IS NOT NULL AND ref IS NOT NULL").mapInArrow(run, schema)


def hard_filter(same_cell: str = "exclude", same_chemistry: bool = False, splits: Sequence[str] = ()) -> Column:
    """Whether a reference may serve a query (columns q_… and r_… of id, cell, end, chemistry, split, future).

    Never one of the target queries, nor itself, nor one with another horizon or an unknown future; of the query's own cell none, those that end before
    it does (past_only), or all (allow); of the splits, if any are named.
    """
    keep = (F.col("q_id") != F.col("r_id")) & (F.col("r_split") != "target_query")
    keep &= (F.size("q_future") == F.size("r_future")) & ~F.exists("r_future", lambda x: x.isNull() | F.isnan(x))
    if splits:
        keep &= F.col("r_split").isin(*splits)
    same = F.col("q_cell") == F.col("r_cell")
    if same_cell == "exclude":
        keep &= ~same
    elif same_cell == "past_only":
        keep &= ~same | (F.col("r_end") <= F.col("q_end"))
    elif same_cell != "allow":
        raise ValueError("same_cell: exclude, past_only or allow")
    return keep & (F.col("q_chemistry") == F.col("r_chemistry")) if same_chemistry else keep


def first_m(pairs: DataFrame, keep: Column, m: int) -> DataFrame:
    """Of each query's coarse candidates in order of their rank, the first m that may serve."""
    return pairs.where(keep).withColumn("rank", F.row_number().over(W.partitionBy("query").orderBy("rank"))).where(F.col("rank") <= m)


# the first stage's embedding


def resampled(seq: Column, points: int) -> Column:
    """Linear interpolation of a sequence at so many equal steps; unknown elements are 0."""
    n = F.size(seq)
    at = lambda i: F.coalesce(F.get(seq, i.cast("int")), F.lit(0.0))

    def value(i: Column) -> Column:
        place = i * (n - 1) / F.lit(max(points - 1, 1)) if points > 1 else F.lit(0.0)
        low = F.floor(place)
        return at(low) + (place - low) * (at(F.least(low + 1, n - 1)) - at(low))

    return F.transform(F.sequence(F.lit(0), F.lit(points - 1)), value)


def summary(seq: Column) -> Column:
    """Mean, population deviation and last of the known elements, zeros if there are none."""
    known = F.filter(seq, lambda x: x.isNotNull())
    parts = bound(known, lambda k: F.array(array_mean(k), array_std(k), F.get(k, F.size(k) - 1)))
    return F.transform(parts, lambda x: F.coalesce(x, F.lit(0.0)))


def stage1_embedding(state: Column, history: Column, curve_stats: Column, stress: Column, sequences: Sequence[Column], points: int = 16) -> Column:
    """State, the resampled history less its last value, curve statistics, stress features, and summaries of sequences."""
    zero = lambda c: F.transform(c, lambda x: F.coalesce(x, F.lit(0.0)))
    anchored = F.transform(history, lambda x: x - F.try_element_at(history, F.lit(-1)))
    return F.concat(zero(state), bound(anchored, lambda h: resampled(h, points)), zero(curve_stats), zero(stress), *map(summary, sequences))


def robust_scaled(df: DataFrame, bank: Column, column: str, width: int, accuracy: int | None = None, limit: float = 8.0, again: bool = False) -> DataFrame:
    """df with the column's dimensions less their medians by their interquartile ranges, both of the bank's rows; where a range is nothing
    the deviation stands in, then 1. Unknown values are 0; all are cut at the limit. Percentiles are exact, by counting in bins,
    or with an accuracy approximate, in one pass; again: df is a stored table that each pass may read (``ranks.exact``)."""
    long = df.where(bank).select(F.posexplode(column).alias("key", "x"))
    found = sketched(long, "key", "x", (0.25, 0.5, 0.75), accuracy) if accuracy else exact(long, "key", "x", (0.25, 0.5, 0.75), again=again)
    marks = [found.get(i) for i in range(width)]
    middles = [m.quantiles[1] if m else 0.0 for m in marks]
    scales = [1.0 if m is None else high - low if (high := m.quantiles[2]) - (low := m.quantiles[0]) > 1e-8 else m.std if m.std > 1e-8 else 1.0 for m in marks]
    literal = F.array(*(F.struct(F.lit(m).alias("m"), F.lit(s).alias("s")) for m, s in zip(middles, scales)))
    inside = lambda z: F.when(z.isNull() | F.isnan(z), 0.0).otherwise(F.greatest(F.lit(-limit), F.least(F.lit(limit), z)))
    return df.withColumn(column, F.zip_with(column, literal, lambda x, m: inside((x - m["m"]) / m["s"])))


# distances of pairs; q and r are arrays or columns of either side


def history_slope(seq: str) -> Column:
    """Least-squares slope over all known points of a sequence; 0 with fewer than three."""
    points = F.filter(F.transform(seq, lambda x, i: F.struct(i.cast("double").alias("t"), x.alias("x"))), lambda p: p["x"].isNotNull())
    total = lambda ps, f: F.aggregate(ps, F.lit(0.0), lambda a, p: a + f(p))

    def slope(ps: Column) -> Column:
        n = F.size(ps)
        middle = F.struct((total(ps, lambda p: p["t"]) / n).alias("t"), (total(ps, lambda p: p["x"]) / n).alias("x"))
        return bound(middle, lambda m: total(ps, lambda p: (p["t"] - m["t"]) * (p["x"] - m["x"])) / total(ps, lambda p: (p["t"] - m["t"]) * (p["t"] - m["t"])))

    return F.when(array_count(F.col(seq)) >= 3, bound(points, slope)).otherwise(0.0)


def recency(n: int, power: float = 1.5) -> list[float]:
    w = [((i + 1) / n) ** power for i in range(n)]
    return [x / (sum(w) / n) for x in w]


def weighted_rmse(q: Column, r: Column, weights: Sequence[float], scale: float) -> Column:
    """1 if no element is known on both sides."""
    w = F.array(*map(F.lit, weights))
    both = F.zip_with(F.zip_with(q, r, lambda a, b: (a - b) / scale), w, lambda d, x: F.when(d.isNotNull(), F.struct(x.alias("w"), (x * d * d).alias("s"))))
    sums = F.aggregate(both, F.struct(F.lit(0.0).alias("w"), F.lit(0.0).alias("s")), lambda a, x: F.when(x.isNull(), a).otherwise(F.struct((a["w"] + x["w"]).alias("w"), (a["s"] + x["s"]).alias("s"))))
    return bound(sums, lambda t: F.when(t["w"] > 0, F.sqrt(t["s"] / F.greatest(t["w"], F.lit(1e-6)))).otherwise(1.0))


def masked_l2(q: Column, r: Column, scales: Sequence[float] | None = None) -> Column:
    """Root mean square of the scaled differences known on both sides, 1 if there are none; without scales they are
    relative to the larger side."""
    if scales is not None:
        both = F.zip_with(F.zip_with(q, r, lambda a, b: a - b), F.array(*map(F.lit, scales)), lambda d, s: d / s)
    else:
        both = F.zip_with(q, r, lambda a, b: (a - b) / F.greatest(F.abs(a), F.abs(b), F.lit(1e-4)))
    return bound(array_mean(F.transform(both, lambda x: x * x)), lambda m: F.when(m.isNotNull(), F.sqrt(m)).otherwise(1.0))


def differences(seq: Column) -> Column:
    return F.zip_with(F.slice(seq, 2, F.size(seq) - 1), F.slice(seq, 1, F.size(seq) - 1), lambda a, b: a - b)


def soh_state_distance(length: int, weights: tuple[float, float, float, float] = (0.03, 0.9, 0.05, 0.02)) -> Column:
    """Of q_/r_ state (anchor, slope, curvature), seq and stage."""
    a, b, c, e = weights
    q, r = F.col("q_seq"), F.col("r_seq")
    last = lambda s: F.element_at(F.filter(s, lambda x: x.isNotNull()), -1)
    centred = lambda s: bound(last(s), lambda m: F.transform(s, lambda x: x - m))
    state = masked_l2(F.col("q_state"), F.col("r_state"), [0.1, 0.01, 0.005])
    history = weighted_rmse(centred(q), centred(r), recency(length), 0.015)
    slope = weighted_rmse(differences(q), differences(r), recency(length - 1), 0.0008)
    stage = F.when(F.col("q_stage") != F.col("r_stage"), 1.0).otherwise(0.0)
    return (a * state + b * history + c * slope + e * stage) / (a + b + c + e)


def curve_distance(q: Column, r: Column) -> Column:
    """Of two curves where both are known: the root mean square difference of their standardised shapes (.85) and the relative difference
    of their levels (.15); 1 if they share nothing. One pass over the elements sums what both need."""
    names = ["n", "a", "b", "aa", "bb", "ab"]
    start = F.struct(*(F.lit(0.0).alias(x) for x in names))

    def add(s: Column, x: Column) -> Column:
        a, b = x["a"], x["b"]
        more = dict(zip(names, (F.lit(1.0), a, b, a * a, b * b, a * b)))
        return F.struct(*((s[n] + F.when(a.isNotNull() & b.isNotNull(), v).otherwise(0.0)).alias(n) for n, v in more.items()))

    def spread(s: Column) -> Column:
        m = {c: s[c] / s["n"] for c in ("a", "b")}
        var = {c: F.greatest(s[c + c] / s["n"] - m[c] * m[c], F.lit(0.0)) for c in m}
        return F.struct(m["a"].alias("ma"), m["b"].alias("mb"), var["a"].alias("va"), var["b"].alias("vb"), (s["ab"] / s["n"] - m["a"] * m["b"]).alias("cov"), *(F.greatest(F.sqrt(var[c]), F.lit(1e-4)).alias(f"s{c}") for c in m))

    def distance(x: Column) -> Column:
        shape = F.sqrt(F.greatest(x["va"] / (x["sa"] * x["sa"]) + x["vb"] / (x["sb"] * x["sb"]) - 2 * x["cov"] / (x["sa"] * x["sb"]), F.lit(0.0)))
        return 0.85 * shape + 0.15 * F.abs(x["ma"] - x["mb"]) / F.greatest(F.abs(x["ma"]), F.abs(x["mb"]), x["sa"], x["sb"], F.lit(1e-4))

    sums = F.aggregate(F.zip_with(q, r, lambda a, b: F.struct(a.alias("a"), b.alias("b"))), start, add)
    return bound(sums, lambda s: F.when(s["n"] > 0, bound(spread(s), distance)).otherwise(1.0))


def qv_distance(channels: Sequence[tuple[str, float]], stats: str | None = "curve_stats") -> Column:
    """Of q_/r_ curves: the weighted mean of the distances of the channels that both have (a channel that is null or all unknown is
    absent), and of their statistics, relative, with weight 1; 1 if they have nothing in common."""
    terms, weights = [], []
    there = lambda c: F.coalesce(F.exists(c, lambda x: x.isNotNull()), F.lit(False))
    for c, w in channels:
        common = there(f"q_{c}") & there(f"r_{c}")
        terms.append(F.when(common, w * curve_distance(F.col(f"q_{c}"), F.col(f"r_{c}"))).otherwise(0.0))
        weights.append(F.when(common, w).otherwise(0.0))
    if stats:
        q, r = F.col(f"q_{stats}"), F.col(f"r_{stats}")
        common = there(F.zip_with(q, r, lambda a, b: a + b))
        terms.append(F.when(common, masked_l2(q, r)).otherwise(0.0))
        weights.append(F.when(common, 1.0).otherwise(0.0))
    total = sum(weights)
    return F.when(total > 0, sum(terms) / total).otherwise(1.0)


def availability(masks: str = "masks") -> Column:
    """Share of the features that both sides of a pair have (q_/r_ arrays of booleans)."""
    both = F.zip_with(f"q_{masks}", f"r_{masks}", lambda a, b: F.when(a & b, 1.0).otherwise(0.0))
    return F.aggregate(both, F.lit(0.0), lambda a, x: a + x) / F.size(both)


def physics_distance() -> Column:
    """Of the first four stress features, relative."""
    return masked_l2(F.slice("q_stress", 1, 4), F.slice("r_stress", 1, 4))


def metadata_distance(categories: Sequence[tuple[str, float]], sequences: Sequence[tuple[str, float]], shares: tuple[float, float] = (0.4, 0.6)) -> Column:
    """Penalties of categories that differ or are unknown, and weighted distances of sequences."""
    penalty = sum(p * F.when((F.col(f"q_{c}") != F.col(f"r_{c}")) | (F.col(f"q_{c}") == "unknown"), 1.0).otherwise(0.0) for c, p in categories) / sum(p for _, p in categories)
    if not sequences:
        return penalty
    number = sum(w * masked_l2(F.col(f"q_{c}"), F.col(f"r_{c}")) for c, w in sequences) / sum(w for _, w in sequences)
    return shares[0] * penalty + shares[1] * number


def composite(weights: dict[str, float]) -> Column:
    """Weighted mean of the components that are known."""
    on = {c: w for c, w in weights.items() if w > 0}
    total = sum(F.when(F.col(c).isNotNull(), w).otherwise(0.0) for c, w in on.items())
    value = sum(w * F.coalesce(F.col(c), F.lit(0.0)) for c, w in on.items())
    return F.when(total > 0, value / total).otherwise(0.0)


# selection and what follows from it


def capped_topk(pairs: DataFrame, k: int, per: str | None = None, cap: int = 2, distance: str = "distance") -> DataFrame:
    """The k nearest references of each query, at most ``cap`` of one cell (or domain)."""
    order = [F.asc_nulls_last(distance), F.col("ref")]
    pairs = foremost(pairs, ["query"], k, per, cap, distance)  # what moves is what may be chosen
    if per:
        pairs = pairs.repartition("query")  # moved once for both ranks
        pairs = pairs.withColumn("_c", F.row_number().over(W.partitionBy("query", per).orderBy(*order))).where(F.col("_c") <= cap).drop("_c")
    return pairs.withColumn("rank", F.row_number().over(W.partitionBy("query").orderBy(*order))).where(F.col("rank") <= k)


def foremost(pairs: DataFrame, by: Sequence[str], k: int, per: str | None = None, cap: int = 2, distance: str = "distance") -> DataFrame:
    """pairs without those that can't be among the k nearest of their group (``capped_topk``), as other pairs of their task show; nothing is shuffled.

    What a choice from some of the pairs leaves out, a choice from all of them leaves out too.
    """
    columns = pairs.columns

    def code(column: pa.ChunkedArray) -> np.ndarray:
        return pc.fill_null(column.combine_chunks().dictionary_encode().indices, -1).to_numpy(zero_copy_only=False)

    def place(keys: list[np.ndarray], order: np.ndarray) -> np.ndarray:
        """Of rows in an order that begins with the keys: the place within rows of equal keys."""
        new = np.ones(len(order), bool)
        new[1:] = np.any([x[order][1:] != x[order][:-1] for x in keys], axis=0)
        first = np.flatnonzero(new)
        return np.arange(len(order)) - np.repeat(first, np.diff(np.append(first, len(order))))

    def best(held: list[pa.RecordBatch]) -> list[pa.RecordBatch]:
        table = pa.Table.from_batches(held)
        d = table.column(distance)
        near = [table.column("ref").to_numpy(), d.cast(pa.float64()).to_numpy(), d.is_null().to_numpy()]  # NaN, then null come last
        groups, left = [code(table.column(c)) for c in by], np.arange(table.num_rows)
        capped = [([*groups, code(table.column(per))], cap)] if per else []
        for keys, most in [*capped, (groups, k)]:
            order = np.lexsort([x[left] for x in [*near, *keys]])
            left = left[order[place([x[left] for x in keys], order) < most]]
        return table.take(np.sort(left)).combine_chunks().to_batches()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= PAIRS:
                held = best(held)
                n = sum(b.num_rows for b in held)
                if n > PAIRS // 2:  # groups are many, or have few pairs each
                    yield from held
                    held, n = [], 0
        if n:
            yield from best(held)

    return pairs.mapInArrow(run, ", ".join(f"`{c}` {t}" for c, t in pairs.dtypes)).select(*columns)


def mmr_select(pairs: DataFrame, k: int, cap: int = 2, trade: float = 0.75, max_domain: int | None = None, vectors: DataFrame | list[str] | None = None, together: bool = False) -> DataFrame:
    """Greedy choice by nearness and distance from what is chosen, with caps on cells and domains.

    pairs: query, ref, distance, cell, domain, vector (of the reference). Queries have few candidates (the coarse cut). With vectors (id, vector) of all references these are
    stored once (or come as files of ``references``) and let pass by for some queries at a time, so that pairs move without them; together: a query's pairs are in one task, as a
    search gives them, and do not move.
    """

    def select(table: pa.Table, v: np.ndarray) -> tuple[np.ndarray, list[float]]:
        """Places and diversity of the chosen of a query's pairs, which come by distance and then by ref."""
        d = table.column("distance").to_numpy()
        if len(d) <= k:
            return np.arange(len(d)), [0.0] * len(d)
        v = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
        cells, domains = table.column("cell").to_pylist(), table.column("domain").to_pylist()
        chosen, diversity, left = [], [], list(range(len(d)))
        while left and len(chosen) < k:
            free = [i for i in left if sum(cells[j] == cells[i] for j in chosen) < cap and (max_domain is None or sum(domains[j] == domains[i] for j in chosen) < max_domain)]
            if not free:
                break
            near = (v[free] @ v[chosen].T).max(axis=1) if chosen else np.zeros(len(free))
            best = int(np.argmax(-trade * d[free] - (1 - trade) * near))
            chosen.append(free[best])
            diversity.append(float(near[best]))
            left.remove(free[best])
        return (np.array(chosen), diversity) if chosen else (np.arange(k), [0.0] * k)

    names, schema = ["query", "ref", "distance", "rank", "diversity"], "query long, ref long, distance double, rank int, diversity double"

    def result(table: pa.Table, chosen: np.ndarray, diversity: list[float]) -> pa.Table:
        out = table.take(chosen)
        return pa.table([out.column("query"), out.column("ref"), out.column("distance"), pa.array(range(1, len(chosen) + 1), pa.int32()), pa.array(diversity, pa.float64())], names)

    order = ["distance", "ref"]
    if vectors is None:

        def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
            table = table.sort_by([(c, "ascending") for c in order])
            return result(table, *select(table, np.array(table.column("vector").to_pylist(), np.float64)))

        return pairs.select("query", *order, "cell", "domain", "vector").groupBy("query").applyInArrow(run, schema)
    side = lambda v: v.select(F.col("id").cast("long").alias("id"), F.col("vector").cast("array<double>").alias("vector"))
    files = vectors if isinstance(vectors, list) else sorted(stored(side(vectors), "vectors").inputFiles())

    def told(held: pa.Table) -> Iterator[pa.RecordBatch]:
        refs, at = np.unique(held.column("ref").to_numpy(), return_inverse=True)
        ids, parts = [], []
        for batch in streamed(files, ["id", "vector"], 4096):
            own = np.isin(batch.column("id").to_numpy(), refs)
            if own.any():
                some = batch.filter(pa.array(own))
                ids.append(some.column("id").to_numpy())
                parts.append(some.column("vector").flatten().to_numpy().reshape(len(some), -1))
        v, query = np.concatenate(parts)[np.argsort(np.concatenate(ids))], held.column("query").to_numpy()
        cuts = [0, *(np.flatnonzero(query[1:] != query[:-1]) + 1).tolist(), len(query)]
        made = [result(part, *select(part, v[at[a:b]])) for a, b in zip(cuts, cuts[1:]) for part in [held.slice(a, b - a)]]
        yield from pa.concat_tables(made).combine_chunks().to_batches()

    def run_all(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            if n >= PAIRS // 2:
                table = pa.Table.from_batches(held).combine_chunks()
                query = table.column("query").to_numpy()
                whole = int(np.searchsorted(query, query[-1]))  # the last one may go on
                if whole:
                    yield from told(table.slice(0, whole))
                    held = table.slice(whole).to_batches()
                    n = table.num_rows - whole
            held.append(batch)
            n += batch.num_rows
        if n:
            yield from told(pa.Table.from_batches(held).combine_chunks())

    needed = pairs.select("query", *order, "cell", "domain")
    moved = (needed if together else needed.repartition("query")).sortWithinPartitions("query", *order)
    return moved.mapInArrow(run_all, schema)


def alpha(distance: str = "distance", temperature: float = 0.1) -> Column:
    """Softmax of the negative distances of a query's references."""
    q = W.partitionBy("query")
    e = F.exp((F.min(distance).over(q) - F.col(distance)) / temperature)
    return e / F.sum(F.exp((F.min(distance).over(q) - F.col(distance)) / temperature)).over(q)


def agreement(results: DataFrame, future: str = "future", cell: str = "cell") -> DataFrame:
    """Per query: dispersion of the futures, entropy of the weights, and share of different cells."""
    long = results.select("query", "alpha", F.posexplode(future).alias("h", "x"))
    mean = long.groupBy("query", "h").agg(F.sum(F.col("alpha") * F.col("x")).alias("m"), F.sum(F.col("alpha") * F.col("x") * F.col("x")).alias("s"))
    spread = mean.groupBy("query").agg(F.avg(F.sqrt(F.greatest(F.col("s") - F.col("m") * F.col("m"), F.lit(0.0)))).alias("dispersion"))
    n = F.count("*")
    entropy = -F.sum(F.when(F.col("alpha") > 0, F.col("alpha") * F.ln("alpha")).otherwise(0.0)) / F.ln(n)
    rest = results.groupBy("query").agg(F.when(n > 1, entropy).otherwise(0.0).alias("entropy"), (F.countDistinct(cell) / n).alias("unique_cells"), n.alias("n"))
    return rest.join(spread, "query")


def confidence(results: DataFrame, agreed: DataFrame, match: str = "same_chemistry", available: str = "available") -> DataFrame:
    """Per query: the clipped mean of eight scores of its references."""
    per = results.groupBy("query").agg(
        F.exp(-F.avg("distance")).alias("a"), F.exp(-F.stddev_pop("distance")).alias("b"), F.exp(-F.min("distance")).alias("c"),
        F.avg(F.col(match).cast("double")).alias("d"), F.avg(available).alias("e"),
    )
    both = per.join(agreed, "query")
    scores = [F.col("a"), F.col("b"), F.col("c"), clip01(F.col("e")), clip01(F.col("d")), F.exp(-F.col("dispersion") / 0.015), clip01(1 - 0.7 * F.col("entropy")), clip01(F.col("unique_cells"))]
    return both.select("query", clip01(sum(scores) / len(scores)).alias("confidence"))


def compatibility(components: Sequence[str]) -> Column:
    """1 less the mean distance, with bonuses for equal chemistry, domain and stage, less what is missing."""
    known = sum(F.when(F.col(c).isNotNull(), 1.0).otherwise(0.0) for c in components)
    mean = sum(F.coalesce(F.col(c), F.lit(0.0)) for c in components) / F.greatest(known, F.lit(1.0))
    bonus = lambda c, yes, no: F.when(F.col(c), yes).otherwise(no)
    return clip01(1 - mean + bonus("same_chemistry", 0.1, -0.05) + bonus("same_domain", 0.05, 0.0) + bonus("same_stage", 0.1, -0.05) - 0.2 * F.col("missing_penalty"))


def unique_series(hits: DataFrame, k: int) -> DataFrame:
    """The first hit of each series, then the others, k in all."""
    n = F.row_number().over(W.partitionBy("query", "series").orderBy("rank"))
    hits = hits.withColumn("_n", n)
    place = F.row_number().over(W.partitionBy("query").orderBy((F.col("_n") > 1).cast("int"), "rank"))
    return hits.withColumn("place", place).where(F.col("place") <= k).drop("_n")


def weighted_future(results: DataFrame, future: str = "future") -> DataFrame:
    """Per query and horizon: the weighted mean of the references' futures."""
    long = results.select("query", "alpha", F.posexplode(future).alias("h", "x"))
    return long.groupBy("query", (F.col("h") + 1).alias("horizon")).agg((F.sum(F.col("alpha") * F.col("x")) / F.sum("alpha")).alias("prediction"))


def trend(seq: Column, window: int = 16) -> Column:
    """Least-squares slope of the last values over 0, 1, …; the forecast of step h is h times it."""
    tail = F.slice(seq, -F.least(F.size(seq), F.lit(window)), F.least(F.size(seq), F.lit(window)))
    n = F.size(tail)
    middle = (n - 1) / 2
    top = F.aggregate(F.transform(tail, lambda y, i: (i - middle) * y), F.lit(0.0), lambda a, x: a + x)
    return top / (n * (n * n - 1) / 12)


def reliability_gate(floors: tuple[float, float, float] = (0.3, 0.3, 0.5), scale: float = 0.004, mid: float = 0.85, sharpness: float = 20.0) -> Column:
    """Of confidence, dispersion and anchor."""
    f1, f2, f3 = floors
    sure = f1 + (1 - f1) * F.col("confidence")
    agree = f2 + (1 - f2) * F.exp(-F.col("dispersion") / scale)
    stage = f3 + (1 - f3) / (1 + F.exp(-(mid - F.col("anchor")) * sharpness))
    return clip01(sure * agree * stage)


def blended_rerank(pairs: DataFrame, applies: Column, weight: float = 0.45, distance: str = "distance", extra: str = "d_dqdv") -> DataFrame:
    """pairs with base_distance and the distance blended with another one, where it applies and is known."""
    w = min(1.0, max(0.0, weight))
    known = applies & F.col(extra).isNotNull() & ~F.isnan(extra)
    return pairs.withColumn("base_distance", F.col(distance)).withColumn(distance, F.when(known, (1 - w) * F.col(distance) + w * F.col(extra)).otherwise(F.col(distance)))


def reordered(results: DataFrame, extra: str = "d_dqdv", distance: str = "distance") -> DataFrame:
    """Results with new_rank: by another distance, unknown ones last, then by the distance."""
    order = [F.asc_nulls_last(extra), F.asc(distance), F.asc("rank")]
    return results.withColumn("new_rank", F.row_number().over(W.partitionBy("query").orderBy(*order)))


def blended_trend(confidence: Column, weighted: Column, trend: Column, share: float = 0.6) -> Column:
    """A forecast from references and a trend: the less confidence, the more of the trend."""
    b = share * (1 - clip01(confidence))
    return (1 - b) * weighted + b * trend


def training_arrays(results: DataFrame, bank: DataFrame, k: int, arrays: dict[str, int]) -> DataFrame:
    """Rows of fixed shape: a query's own arrays, and side by side those of its k references, by rank.

    bank: case_id and the arrays, each with its length; bucketed by case_id it stays where it is, and only the results move. Unknown elements are 0.
    Where there are fewer references, ids are -1, weights and elements 0, and the mask is 0.
    """
    filled = [F.transform(c, lambda x: F.coalesce(x.cast("double"), F.lit(0.0))).alias(c) for c in arrays]
    side = bank.select("case_id", *filled)
    named = lambda key: side.withColumnsRenamed({"case_id": key})
    refs = results.select("query", "rank", "ref", "alpha").join(named("ref"), "ref")
    rows = refs.groupBy("query").agg(F.sort_array(F.collect_list(F.struct("rank", "ref", "alpha", *arrays))).alias("_refs"))  # k at most
    places = F.sequence(F.lit(0), F.lit(k - 1))
    at = lambda j: F.get("_refs", j)
    side_by_side = lambda c, n: F.transform(places, lambda j: F.coalesce(at(j)[c], F.array_repeat(F.lit(0.0), n)))
    columns = {
        "ref_ids": F.transform(places, lambda j: F.coalesce(at(j)["ref"], F.lit(-1).cast("long"))),
        "ref_alpha": F.transform(places, lambda j: F.coalesce(at(j)["alpha"], F.lit(0.0))),
        "ref_mask": F.transform(places, lambda j: at(j).isNotNull().cast("int")),
    } | {f"ref_{c}": side_by_side(c, n) for c, n in arrays.items()}
    return rows.withColumns(columns).drop("_refs").join(named("query"), "query")
