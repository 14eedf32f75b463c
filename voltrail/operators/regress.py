"""Ridge regressions of many feature groups and weightings from sums of products, and their errors.

One scan adds up, for each key (a split), the products of all features with each other and with the targets: a packed triangle per key.
A feature group's regression is a block of it, rows counted several times are a multiple of their key's sums, and what a
constant shift would be follows from sums too. A second scan scores all models at once and keeps sums of errors per group of rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voltrail.functions.ranks import shuffled
from voltrail.functions.storage import stored


@dataclass
class Gram:
    """Sums over rows of z z', where z is a 1, the features and the targets. Grams of disjoint rows add up; a multiple counts rows as often."""

    features: list[str]
    targets: list[str]
    sums: np.ndarray

    def __add__(self, other: Gram) -> Gram:
        return Gram(self.features, self.targets, self.sums + other.sums)

    def __mul__(self, times: float) -> Gram:
        return Gram(self.features, self.targets, self.sums * times)

    @property
    def n(self) -> float:
        return float(self.sums[0, 0])

    def at(self, names: Sequence[str]) -> list[int]:
        place = {f: i + 1 for i, f in enumerate(self.features)}
        return [place[f] for f in names]

    def ridge(self, names: Sequence[str], reg: float = 1.0, intercept: bool = False) -> np.ndarray:
        """Weights (features in their order, targets). With an intercept, features and targets are taken less their means, and its row comes last."""
        x, y = self.at(names), range(1 + len(self.features), len(self.sums))
        xx, xy = self.sums[np.ix_(x, x)], self.sums[np.ix_(x, y)]
        if not intercept:
            return np.linalg.solve(xx + reg * np.eye(len(x)), xy)
        mx, my = self.sums[0, x] / self.n, self.sums[0, list(y)] / self.n
        w = np.linalg.solve(xx - self.n * np.outer(mx, mx) + reg * np.eye(len(x)), xy - self.n * np.outer(mx, my))
        return np.vstack([w, my - mx @ w])

    def mean_residual(self, names: Sequence[str], weights: np.ndarray) -> np.ndarray:
        """Per target: how far the predictions are too low on average."""
        y = list(range(1 + len(self.features), len(self.sums)))
        return (self.sums[0, y] - self.sums[0, self.at(names)] @ weights) / self.n


def _matrix(batch: pa.RecordBatch, columns: Sequence[str]) -> np.ndarray:
    """The columns as a matrix; what is missing or not finite is 0."""
    return np.nan_to_num(np.column_stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.float64) for c in columns]), posinf=0.0, neginf=0.0)


def grams(df: DataFrame, features: Sequence[str], targets: Sequence[str], key: str) -> dict[object, Gram]:
    """The sums of each key's rows, in one scan. There are few keys; a task sends a packed triangle for each that it met."""
    columns, size = [*features, *targets], 1 + len(features) + len(targets)
    upper = np.triu_indices(size)
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[object, np.ndarray] = {}
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            last = batch.column("key").type
            z = np.hstack([np.ones((batch.num_rows, 1)), _matrix(batch, columns)])
            coded = batch.column("key").dictionary_encode()
            for i, name in enumerate(coded.dictionary.to_pylist()):
                own = z[coded.indices.to_numpy(zero_copy_only=False) == i]
                held[name] = held.get(name, 0.0) + (own.T @ own)[upper]
        if held:
            n = len(upper[0])
            yield pa.RecordBatch.from_arrays([pa.array([k for k in held for _ in range(n)], last), pa.array(np.tile(np.arange(n, dtype=np.int32), len(held))), pa.array(np.concatenate(list(held.values())))], ["key", "i", "v"])

    one = df.where(F.col(key).isNotNull()).select(F.col(key).alias("key"), *(F.col(c).cast("double").alias(c) for c in columns))
    rows = one.mapInArrow(run, f"key {kind}, i int, v double").groupBy("key", "i").agg(F.sum("v").alias("v")).collect()  # a triangle per key
    out: dict[object, Gram] = {}
    for r in rows:
        g = out.setdefault(r["key"], Gram(list(features), list(targets), np.zeros((size, size))))
        a, b = int(upper[0][r["i"]]), int(upper[1][r["i"]])
        g.sums[a, b] = g.sums[b, a] = r["v"]
    return out


@dataclass
class Model:
    """A linear model of all targets for rows of one key: weights by feature, and a shift."""

    name: tuple[str, ...]
    key: object
    features: list[str]
    weights: np.ndarray
    shift: np.ndarray | float = 0.0


def scored(df: DataFrame, models: Sequence[Model], targets: Sequence[str], key: str, by: Sequence[str] = (), labels: Sequence[str] = ("model",)) -> DataFrame:
    """Per model (its name in the label columns), target (horizon 1, 2, ...) and group of rows: n, and the sums of absolute errors, squared
    errors and errors relative to the target. All models score a batch at once; a task sends its sums."""
    features = sorted({f for m in models for f in m.features})
    place = {f: i for i, f in enumerate(features)}
    keys = sorted({m.key for m in models})
    h = len(targets)
    weights = {k: np.zeros((len(features), h * sum(m.key == k for m in models))) for k in keys}
    shifts = {k: np.zeros(w.shape[1]) for k, w in weights.items()}
    names: dict[object, list[tuple[str, ...]]] = {k: [] for k in keys}
    for m in models:
        at = h * len(names[m.key])
        weights[m.key][[place[f] for f in m.features], at : at + h] = m.weights
        shifts[m.key][at : at + h] = m.shift
        names[m.key].append(m.name)
    groups = ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in by)
    measures = ["n", "absolute", "squared", "relative"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, np.ndarray] = {}
        types: list[pa.DataType] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            types = [batch.column(c).type for c in by]
            x, y = _matrix(batch, features), _matrix(batch, targets)
            rows = list(zip(batch.column(key).to_pylist(), *(batch.column(c).to_pylist() for c in by)))
            for group in set(rows):
                if group[0] not in weights:
                    continue
                use = np.array([r == group for r in rows])
                e = x[use] @ weights[group[0]] + shifts[group[0]] - np.tile(y[use], len(names[group[0]]))
                scale = np.maximum(np.abs(np.tile(y[use], len(names[group[0]]))), 1e-6)
                sums = np.stack([np.full(e.shape[1], len(e), float), np.abs(e).sum(axis=0), (e * e).sum(axis=0), (np.abs(e) / scale).sum(axis=0)])
                held[group] = held.get(group, 0.0) + sums
        rows = [(*name, j + 1, *group[1:], *sums[:, i * h + j]) for group, sums in held.items() for i, name in enumerate(names[group[0]]) for j in range(h)]
        kinds = [*[pa.string()] * len(labels), pa.int32(), *types, *[pa.float64()] * 4]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], [*labels, "horizon", *by, *measures])

    one = df.where(F.col(key).isin(*keys)).select(key, *by, *(F.col(c).cast("double").alias(c) for c in dict.fromkeys([*features, *targets])))
    schema = ", ".join(filter(None, [*(f"{c} string" for c in labels), "horizon int", groups, *(f"{m} double" for m in measures)]))
    return one.mapInArrow(run, schema).groupBy(*labels, "horizon", *by).agg(*(F.sum(m).alias(m) for m in measures))


def errors_of(sums: DataFrame, *by: str, last: int | None = None) -> DataFrame:
    """mae, rmse, mape and n of the sums of ``scored`` by some of its columns; with a last horizon, its mae too."""
    n = F.sum("n")
    parts = [(F.sum("absolute") / n).alias("mae"), F.sqrt(F.sum("squared") / n).alias("rmse"), (F.sum("relative") / n).alias("mape"), n.cast("long").alias("n")]
    if last:
        parts.append((F.sum(F.when(F.col("horizon") == last, F.col("absolute"))) / F.sum(F.when(F.col("horizon") == last, F.col("n")))).alias("last_step_mae"))
    return sums.groupBy(*by).agg(*parts)


def ablation(sums: Gram, groups: Mapping[str, Sequence[str]], key: object, reg: float = 1.0) -> list[Model]:
    """A ridge regression per feature group, all from the same sums."""
    return [Model((g,), key, list(names), sums.ridge(names, reg)) for g, names in groups.items() if names]


def importances(models: Sequence[Model]) -> list[tuple[str, str, float]]:
    """Group, feature, and the mean absolute weight over targets."""
    return [(m.name[0], f, float(v)) for m in models for f, v in zip(m.features, np.abs(m.weights).mean(axis=1))]


def few_shot(source: Gram, support: Gram, groups: Mapping[str, Sequence[str]], key: object, repeats: Sequence[int] = (2, 4, 8), reg: float = 1.0) -> list[Model]:
    """Per feature group: the source's regression; the same shifted by its mean error on the support; and refits on the source and the support
    counted several times, and so often that it weighs like the source (2 to 8 times)."""
    balanced = int(max(2, min(8, np.ceil(source.n / max(support.n, 1)))))
    refits = {f"support_x{k}": k for k in repeats} | {"support_weighted_refit": balanced}
    out = []
    for g, names in groups.items():
        if not names:
            continue
        w = source.ridge(names, reg)
        out += [Model((g, "source_only"), key, list(names), w), Model((g, "support_bias"), key, list(names), w, support.mean_residual(names, w))]
        out += [Model((g, r), key, list(names), (source + support * k).ridge(names, reg)) for r, k in refits.items()]
    return out


def permutation_importance(df: DataFrame, id_col: str, model: Model, targets: Sequence[str], seeds: Sequence[int]) -> DataFrame:
    """Per feature: the mean rise of the absolute error over all targets when the feature's values are dealt anew over all rows, by several
    permutations (mean and population deviation over these), and the error without. Rows of df are scored as they are."""
    numbers = stored(df.select(id_col, *(F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in [*model.features, *targets])), "scored-rows")
    pairs = shuffled(numbers, id_col, seeds, model.features)
    w, shift = model.weights, np.broadcast_to(model.shift, model.weights.shape[1])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            x, y = _matrix(batch, model.features), _matrix(batch, targets)
            other = _matrix(batch, [f"{c}_other" for c in model.features])
            e, seed = x @ w + shift - y, batch.column("seed").to_numpy()
            moved = [np.abs(e).mean(axis=1)] + [np.abs(e + np.outer(other[:, i] - x[:, i], w[i])).mean(axis=1) for i in range(len(w))]
            for s in np.unique(seed):
                held[int(s)] = held.get(int(s), 0.0) + np.array([[m[seed == s].sum(), (seed == s).sum()] for m in moved])
        rows = [(s, f, *v) for s, sums in held.items() for f, v in zip([None, *model.features], sums.tolist())]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int32(), pa.string(), pa.float64(), pa.float64()))], ["seed", "feature", "total", "n"])

    sums = pairs.mapInArrow(run, "seed int, feature string, total double, n double").groupBy("seed", "feature").agg((F.sum("total") / F.sum("n")).alias("mae"))
    base = sums.where("feature IS NULL").select("seed", F.col("mae").alias("base"))
    rise = sums.where("feature IS NOT NULL").join(base, "seed").withColumn("rise", F.col("mae") - F.col("base"))
    return rise.groupBy("feature").agg(F.avg("rise").alias("importance"), F.stddev_pop("rise").alias("deviation"), F.first("base").alias("mae"))
