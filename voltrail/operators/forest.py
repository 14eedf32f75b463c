"""Regression forests grown level by level from histograms.

Features are cut into bins at quantiles. How often a row counts in a tree is drawn from a Poisson distribution by a hash of the row and the
tree, so that no resampled table is made. For each level the weights and the weighted targets are added up for each (tree, node, feature, bin).
A task has the sums of some trees and lets all rows, stored once as bins, stream by: no sums are moved, and only the cuts come to the driver. All trees
of all feature groups grow together.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Mapping, Sequence
from dataclasses import dataclass
from math import ceil, exp, factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voltrail.functions.ranks import summaries
from voltrail.functions.storage import stored, streamed

#: MB of sums that a task holds, or those of one tree, and rows that meet them at once.
HELD_MB, ROWS = 64, 16_384
_POISSON = np.cumsum([exp(-1) / factorial(k) for k in range(12)])


@dataclass(frozen=True)
class Growth:
    trees: int = 80  # of each feature group
    depth: int = 8
    bins: int = 32
    seed: int = 7
    least_gain: float = 1e-12
    accuracy: int = 10_000  # of the quantiles between bins


@dataclass
class Forests:
    """Trees as heaps: the children of node i are 2i + 1 (feature at most the edge) and 2i + 2. A feature of -1 ends a branch."""

    groups: list[str]
    members: list[list[int]]  # of each group, its features' places
    features: list[str]
    edges: list[np.ndarray]
    feature: np.ndarray  # (trees, nodes)
    cut: np.ndarray
    value: np.ndarray  # (trees, nodes, targets)
    gain: np.ndarray

    def binned(self, x: np.ndarray) -> np.ndarray:
        return _binned(x, self.edges)

    def node(self, tree: int, bins: np.ndarray, depth: int) -> np.ndarray:
        """The node of each row after at most so many cuts."""
        at, rows = np.zeros(len(bins), np.int64), np.arange(len(bins))
        for _ in range(depth):
            f = self.feature[tree, at]
            at = np.where(f < 0, at, 2 * at + 1 + (bins[rows, np.maximum(f, 0)] > self.cut[tree, at]))
        return at

    def predict(self, group: int, bins: np.ndarray, depth: int) -> np.ndarray:
        own = range(group * len(self.feature) // len(self.groups), (group + 1) * len(self.feature) // len(self.groups))
        return sum(self.value[t, self.node(t, bins, depth)] for t in own) / len(own)

    def importances(self) -> list[tuple[str, str, float]]:
        """Group, feature and the share of the gains, a mean over the group's trees."""
        out, per = [], len(self.feature) // len(self.groups)
        for g, name in enumerate(self.groups):
            shares = np.zeros(len(self.features))
            for t in range(g * per, (g + 1) * per):
                used = self.feature[t] >= 0
                own = np.bincount(self.feature[t, used], self.gain[t, used], len(self.features))
                shares += own / max(own.sum(), 1e-300) / per
            out += [(name, self.features[i], float(shares[i])) for i in self.members[g]]
        return out


def _binned(x: np.ndarray, edges: Sequence[np.ndarray]) -> np.ndarray:
    return np.column_stack([np.searchsorted(e, x[:, i], "left") for i, e in enumerate(edges)]).astype(np.uint8)


def weights(row: np.ndarray, tree: int, seed: int) -> np.ndarray:
    """How often each row (by its hash) counts in a tree."""
    h = row.view(np.uint64) ^ np.uint64(((tree + 1) * 0x9E3779B97F4A7C15 + seed * 0xD1B54A32D192ED03) % (1 << 64))
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        h = (h ^ (h >> np.uint64(shift))) * np.uint64(factor)
    h ^= h >> np.uint64(31)
    return np.searchsorted(_POISSON, (h >> np.uint64(11)).astype(np.float64) / (1 << 53), "right").astype(np.float64)


def best_cut(sums: np.ndarray) -> tuple[float, int, int, np.ndarray, np.ndarray]:
    """Of sums (features, bins, 1 + targets): the largest gain in squared error, its feature and bin (the first of equals), and the sums on either side."""
    left = np.cumsum(sums, axis=1)
    whole = left[:, -1:, :]
    right = whole - left
    part = lambda s: (s[..., 1:] ** 2).sum(axis=-1) / np.maximum(s[..., 0], 1e-300)
    gains = np.where((left[..., 0] > 0.5) & (right[..., 0] > 0.5), part(left) + part(right) - part(whole), -1.0)
    f, b = np.unravel_index(int(gains.argmax()), gains.shape)
    return float(gains[f, b]), int(f), int(b), left[f, b], right[f, b]


def grow(df: DataFrame, id_col: str, groups: Mapping[str, Sequence[str]], targets: Sequence[str], how: Growth = Growth()) -> Forests:
    """A forest for each feature group. Missing numbers count as 0; rows with equal ids get equal weights."""
    features = sorted({f for names in groups.values() for f in names})
    place = {f: i for i, f in enumerate(features)}
    zero = lambda c: F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(0.0)), F.lit(0.0))
    rows = stored(df.select(F.xxhash64(id_col).alias("row"), *(zero(c).alias(c) for c in dict.fromkeys([*features, *targets]))), "forest-rows")
    marks = summaries(rows, {f: F.col(f) for f in features}, [k / how.bins for k in range(1, how.bins)], how.accuracy)
    edges = [np.unique(marks[f].quantiles) if f in marks else np.empty(0) for f in features]
    trees, nodes, h = how.trees * len(groups), 2 ** (how.depth + 1) - 1, len(targets)
    members = [[place[f] for f in names] for names in groups.values()]
    out = Forests(list(groups), members, features, edges, np.full((trees, nodes), -1, np.int16), np.zeros((trees, nodes), np.uint8), np.zeros((trees, nodes, h)), np.zeros((trees, nodes)))

    def packed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = _binned(np.column_stack([batch.column(c).to_numpy() for c in features]), edges)
                yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array([r.tobytes() for r in x], pa.binary()), *(batch.column(c) for c in targets)], ["row", "bins", *targets])

    files = sorted(stored(rows.mapInArrow(packed, ", ".join(["row long, bins binary", *(f"`{c}` double" for c in targets)])), "forest-bins").inputFiles())
    open_ = np.zeros((trees, nodes), bool)
    open_[:, 0] = True
    for depth in range(how.depth):
        cuts = _level(df.sparkSession, files, out, open_, targets, depth, how).collect()  # a row per node of the level
        open_[:] = False
        for r in cuts:
            t, i = r["tree"], r["node"]
            sides = [np.array(r[s]) for s in ("left", "right")]
            if depth == 0:
                out.value[t, 0] = sum(s[1:] for s in sides) / max(sum(s[0] for s in sides), 1e-300)
            if r["gain"] <= how.least_gain:
                continue
            out.feature[t, i], out.cut[t, i], out.gain[t, i] = r["feature"], r["bin"], r["gain"]
            for child, s in zip((2 * i + 1, 2 * i + 2), sides):
                out.value[t, child] = s[1:] / s[0]
                open_[t, child] = s[0] > 1.5
        if not open_.any():
            break
    return out


def _level(spark: SparkSession, files: Sequence[str], forests: Forests, open_: np.ndarray, targets: Sequence[str], depth: int, how: Growth) -> DataFrame:
    """The best cut of each open node."""
    bins, many = how.bins, 1 + len(targets)
    group = np.arange(len(open_)) * len(forests.groups) // len(open_)
    size = open_.sum(axis=1) * np.array([len(own) for own in forests.members])[group] * bins * many * 8
    order = np.argsort(-size, kind="stable")[: np.count_nonzero(size)]
    spare = spark.sparkContext.defaultParallelism
    parts = min(len(order), spare * ceil(size.sum() / max(HELD_MB * 1e6, 1) / spare))
    shared = spark.sparkContext.broadcast((forests, open_.copy(), [order[p::parts] for p in range(parts)]))  # as large as the forests may grow

    def cuts(trees: np.ndarray, forests: Forests, open_: np.ndarray) -> Iterator[tuple]:
        members = [np.array(own) for own in forests.members]
        place = {t: np.cumsum(open_[t]) - 1 for t in trees}  # of an open node among those of its tree
        held = {t: np.zeros((many, (place[t][-1] + 1) * len(members[group[t]]) * bins)) for t in trees}
        for batch in streamed(files, ["row", "bins", *targets], ROWS):
            row, wide = batch.column("row").to_numpy(), batch.column("bins").cast(pa.binary(len(forests.features)))
            binned = np.frombuffer(wide.buffers()[1], np.uint8, len(row) * wide.type.byte_width, wide.offset * wide.type.byte_width).reshape(len(row), -1)
            y = [batch.column(c).to_numpy() for c in targets]
            coded = {g: np.arange(len(members[g])) * bins + binned[:, members[g]] for g in set(group[trees])}
            for t in trees:
                w, at, own = weights(row, int(t), how.seed), forests.node(t, binned, depth), members[group[t]]
                use = np.flatnonzero((w > 0) & open_[t, at])
                if not len(use):
                    continue
                flat = (coded[group[t]][use] + (place[t][at[use]] * len(own) * bins)[:, None]).ravel()
                for j, x in enumerate([w[use], *(w[use] * v[use] for v in y)]):
                    held[t][j] += np.bincount(flat, np.repeat(x, len(own)), held[t].shape[1])
        for t in trees:
            own, sums = members[group[t]], np.moveaxis(held.pop(t).reshape(many, -1, len(members[group[t]]), bins), 0, -1)
            for node, s in zip(np.flatnonzero(open_[t]).tolist(), sums):
                whole = s[0].sum(axis=0)
                if whole[0] == 0:
                    continue
                gain, f, b, left, right = best_cut(s)
                if gain < 0:  # all rows in one bin of each feature
                    left, right = whole, np.zeros(many)
                yield int(t), node, int(own[f]), b, gain, left.tolist(), right.tolist()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forests, open_, dealt = shared.value
        kinds = [pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.list_(pa.float64()), pa.list_(pa.float64())]
        for batch in batches:
            for part in batch.column("id").to_pylist():
                found = list(cuts(dealt[part], forests, open_))
                yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], k) for i, k in enumerate(kinds)], ["tree", "node", "feature", "bin", "gain", "left", "right"])

    return spark.range(0, parts, 1, parts).mapInArrow(run, "tree int, node int, feature int, bin int, gain double, left array<double>, right array<double>")


def scored(df: DataFrame, forests: Forests, targets: Sequence[str], depth: int) -> DataFrame:
    """Per feature group and target (horizon 1, 2, ...): n and sums of errors, as ``regress.scored`` gives them. One scan."""
    shared = df.sparkSession.sparkContext.broadcast(forests)
    zero = lambda c: F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(0.0)), F.lit(0.0))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forests = shared.value
        total = np.zeros((len(forests.groups), 4, len(targets)))
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = (np.column_stack([batch.column(c).to_numpy() for c in names]) for names in (forests.features, targets))
            binned = forests.binned(x)
            for g in range(len(forests.groups)):
                e = np.abs(forests.predict(g, binned, depth) - y)
                total[g] += np.stack([np.full(y.shape[1], len(y), float), e.sum(axis=0), (e * e).sum(axis=0), (e / np.maximum(np.abs(y), 1e-6)).sum(axis=0)])
        rows = [(name, j + 1, *total[g, :, j]) for g, name in enumerate(forests.groups) for j in range(len(targets))]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.int32(), *[pa.float64()] * 4))], ["feature_group", "horizon", "n", "absolute", "squared", "relative"])

    one = df.select(*(zero(c).alias(c) for c in dict.fromkeys([*forests.features, *targets])))
    sums = one.mapInArrow(run, "feature_group string, horizon int, n double, absolute double, squared double, relative double")
    return sums.groupBy("feature_group", "horizon").agg(*(F.sum(m).alias(m) for m in ("n", "absolute", "squared", "relative")))
