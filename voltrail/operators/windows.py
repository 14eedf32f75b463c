"""Sliding windows over cells, and what is derived from each: targets, state, labels, statistics, encodings.

A case is a window of ``lookback`` cycles and the ``horizon`` cycles after it; its key is (cell_uid, window_start).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from voltrail.functions.columns import array_count, array_mean, array_std, clip01, sigmoid
from voltrail.functions.ranks import exact, numbered, sketched, summaries


def sliding(df: DataFrame, columns: Sequence[str], lookback: int, horizon: int, stride: int, carry: Sequence[str] = (), order: str = "cycle_idx") -> DataFrame:
    """Windows by position: x_seq and x_future for each column, window and target bounds, and the anchor row's carried
    columns. Gaps stay in place as nulls; cells that are too short have no windows. A row gathers only the rows of its own window."""
    whole, cell = lookback + horizon, W.partitionBy("cell_uid")
    row = F.struct(*dict.fromkeys([*columns, *carry]))
    at = F.row_number().over(cell.orderBy(order)) - 1
    df = df.select("cell_uid", at.alias("_at"), F.count("*").over(cell).alias("n_cycles"), row.alias("_row"))
    # windows begin at every stride-th row alone, so runs of so many rows are gathered first, and each window then takes a few runs
    inside = W.partitionBy("cell_uid", "_run").orderBy("_at").rowsBetween(0, stride - 1)
    runs = df.withColumn("_run", F.floor(F.col("_at") / stride)).withColumn("_rows", F.collect_list("_row").over(inside)).where(F.col("_at") % stride == 0)
    runs = runs.select("cell_uid", F.col("_at").alias("window_start"), "n_cycles", "_rows")
    ahead = cell.orderBy("window_start").rowsBetween(0, -(-whole // stride) - 1)
    gathered = runs.withColumn("rows", F.flatten(F.collect_list("_rows").over(ahead)))
    cases = gathered.where(F.col("window_start") + whole <= F.col("n_cycles"))
    cut = lambda c, at, size: F.slice(F.col(f"rows.{c}"), at + 1, size)
    start, anchor = F.col("window_start").cast("long"), F.get("rows", F.lit(lookback - 1))
    return cases.select(
        "cell_uid", start.alias("window_start"), (start + lookback).alias("window_end"), (start + whole).alias("target_end"), F.col("n_cycles").cast("long").alias("n_cycles"),
        *(cut(c, 0, lookback).alias(f"{c}_seq") for c in columns), *(cut(c, lookback, horizon).alias(f"{c}_future") for c in columns), *(anchor[c].alias(c) for c in carry),
    )


def usable(cases: DataFrame, column: str = "soh") -> DataFrame:
    """Cases whose anchor and whole future are known; gaps within the lookback are allowed."""
    return cases.where(F.try_element_at(f"{column}_seq", F.lit(-1)).isNotNull() & ~F.exists(f"{column}_future", lambda x: x.isNull()))


def deltas(column: str = "soh") -> Column:
    """The future less the anchor."""
    anchor = F.try_element_at(f"{column}_seq", F.lit(-1))
    return F.transform(f"{column}_future", lambda x: x - anchor)


def recent_slope(seq: Column | str, last: int = 5) -> Column:
    """Mean of the last differences; null if one of them is."""
    seq = F.col(seq) if isinstance(seq, str) else seq
    tail = F.slice(seq, -(last + 1), last + 1)
    whole = ~F.exists(tail, lambda x: x.isNull())
    return F.when(whole, (F.try_element_at(tail, F.lit(-1)) - F.try_element_at(tail, F.lit(1))) / (F.size(tail) - 1))


def curvature(seq: Column | str) -> Column:
    """Mean second difference; null if an element is."""
    seq = F.col(seq) if isinstance(seq, str) else seq
    n = F.size(seq)
    at = lambda i: F.try_element_at(seq, F.lit(i))
    return F.when(~F.exists(seq, lambda x: x.isNull()) & (n > 2), ((at(-1) - at(-2)) - (at(2) - at(1))) / (n - 2))


def degradation_stage(soh: Column) -> Column:
    return F.when(soh >= 0.95, "fresh").when(soh >= 0.9, "early").when(soh >= 0.8, "mid").when(soh >= 0.7, "late").otherwise("end")


def future_operation(column: str, mode: str, horizon: int) -> tuple[Column, Column]:
    """Future operation and its mask: known, repeat_last or none."""
    if mode == "known":
        c = F.col(f"{column}_future")
        return F.transform(c, lambda x: F.coalesce(x, F.lit(0.0))), F.transform(c, lambda x: x.isNotNull().cast("int"))
    last = F.coalesce(F.try_element_at(f"{column}_seq", F.lit(-1)), F.lit(0.0)) if mode == "repeat_last" else F.lit(0.0)
    return F.array_repeat(last, horizon), F.array_repeat(F.lit(1 if mode == "repeat_last" else 0), horizon)


def availability(seq: str) -> Column:
    """Share of the elements that are known."""
    return array_count(F.col(seq)) / F.size(seq)


def robust_z(df: DataFrame, columns: Sequence[str], accuracy: int | None = None) -> DataFrame:
    """df with x_z: by the median and the interquartile range of all rows; missing is 0. Quantiles are exact, found by counting in
    bins, or with an accuracy approximate, in one pass."""
    marks = summaries(df, {c: F.col(c) for c in columns}, (0.25, 0.5, 0.75), accuracy)
    for c in columns:
        low, middle, high = marks[c].quantiles if c in marks else (0.0, 0.0, 0.0)
        spread = high - low if high - low >= 1e-6 else marks[c].std if c in marks and marks[c].std > 1e-6 else 1.0
        df = df.withColumn(f"{c}_z", F.coalesce((F.col(c) - middle) / spread, F.lit(0.0)))
    return df


MODES = ("thermal", "current", "cycle", "power")


def semantic_labels(df: DataFrame) -> DataFrame:
    """Scores of four stress modes, the strongest (the first of equals) and those with evidence.

    Needs thermal, current, power, aging (values of each case) and anchor_soh.
    """
    df = df.withColumn("below", F.greatest(F.lit(0.0), 0.9 - F.coalesce("anchor_soh", F.lit(1.0))))
    df = robust_z(df, ["thermal", "current", "power", "aging", "below"])
    scores = {"thermal": F.col("thermal_z"), "current": F.col("current_z"), "cycle": 0.7 * F.col("aging_z") + 0.8 * F.col("below_z"), "power": F.col("power_z")}
    df = df.withColumns({f"{m}_score": sigmoid(scores[m]) for m in MODES})
    top = F.greatest(*(F.col(f"{m}_score") for m in MODES))
    label = F.coalesce(*(F.when(F.col(f"{m}_score") == top, F.lit(m)) for m in MODES))
    evidence = F.array_join(F.array_compact(F.array(*(F.when(F.col(f"{m}_score") >= 0.55, F.lit(m)) for m in MODES))), ",")
    return df.withColumns({"semantic_label": label, "evidence": evidence})


def normalization_stats(cases: DataFrame, blocks: Sequence[str], fit: Column, accuracy: int | None = None) -> DataFrame:
    """Per block of arrays: mean, population deviation (1 if none) and quantiles of its known elements over the fit rows, exact or with an accuracy approximate."""
    long = cases.where(fit).select(F.explode(F.array(*(F.struct(F.lit(b).alias("block"), F.col(b).alias("x")) for b in blocks))).alias("b")).select("b.block", F.explode("b.x").alias("x"))
    marks = sketched(long, "block", "x", (0.05, 0.5, 0.95), accuracy) if accuracy else exact(long, "block", "x", (0.05, 0.5, 0.95))
    rows = [(b, m.mean, m.std if m.std > 1e-8 else 1.0, *m.quantiles) for b, m in marks.items()]  # a row per block
    return cases.sparkSession.createDataFrame(rows, "block string, mean double, std double, q05 double, q50 double, q95 double")


def factor_scores(df: DataFrame, train: Column, accuracy: int | None = None) -> DataFrame:
    """Scores in [0, 1] of heat, current, power and cycling, scaled by the training rows' 50th to 90th percentiles."""
    marks = summaries(df.where(train), {c: F.col(c) for c in ("current", "power")}, (0.5, 0.9), accuracy)

    def scaled(c: str) -> Column:
        low, high = marks[c].quantiles if c in marks else (None, None)
        return clip01((F.col(c) - low) / max(high - low, 1e-6)) if c in marks else F.lit(None).cast("double")

    scores = {
        "temp_score": clip01((F.col("thermal") - 30) / 15), "current_score": scaled("current"), "power_score": scaled("power"),
        "cycle_score": clip01(F.greatest(F.col("aging"), (0.9 - F.col("anchor_soh")) / 0.15)),
    }
    df = df.withColumns(scores)
    return df.withColumns({k.replace("score", "active"): F.col(k) >= 0.5 for k in scores})


def encode_categories(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """df with x_id: 1.. in sorted order of the known values, 0 for the rest."""
    for c in columns:
        names = df.select(c).where(F.col(c).isNotNull() & (F.col(c) != "unknown")).distinct()
        ids = names.withColumn(f"{c}_id", F.row_number().over(W.orderBy(c)))  # a row per category
        df = df.join(ids, c, "left").withColumn(f"{c}_id", F.coalesce(f"{c}_id", F.lit(0)))
    return df


def folds(df: DataFrame, k: int) -> DataFrame:
    """df with fold: the place of its cell among the sorted cells, modulo k. Cells are sorted by ranges of their ids."""
    cells = numbered(df.select("cell_uid").distinct(), ["cell_uid"], "fold")
    return df.join(cells.withColumn("fold", F.col("fold") % k), "cell_uid")


def residual_stats(df: DataFrame, target: str, baseline: str) -> DataFrame:
    """Per horizon: mean and population deviation (at least 1e-6) of target less baseline."""
    long = df.select(F.posexplode(F.zip_with(target, baseline, lambda a, b: a - b)).alias("h", "x"))
    return long.groupBy((F.col("h") + 1).alias("horizon")).agg(F.avg("x").alias("mean"), F.greatest(F.stddev_pop("x"), F.lit(1e-6)).alias("std"))


def extend_horizon(cases: DataFrame, length: int, column: str = "soh") -> DataFrame:
    """Cases with a longer future: each cell's cycles are rebuilt as means over all windows that hold them."""
    values = F.concat(F.col(f"{column}_seq"), F.col(f"{column}_future"))
    long = cases.select("cell_uid", "window_start", F.posexplode(values).alias("i", "x")).where(F.col("x").isNotNull())
    truth = long.groupBy("cell_uid", (F.col("window_start") + F.col("i")).alias("cycle")).agg(F.avg("x").alias("x"))
    wanted = cases.select("cell_uid", "window_start", F.explode(F.sequence(F.col("window_end"), F.col("window_end") + length - 1)).alias("cycle"))
    found = wanted.join(truth, ["cell_uid", "cycle"]).groupBy("cell_uid", "window_start").agg(F.sort_array(F.collect_list(F.struct("cycle", "x"))).alias("f"))
    return found.where(F.size("f") == length).select("cell_uid", "window_start", F.col("f.x").alias(f"{column}_future"))


def extended(cases: DataFrame, length: int, column: str, operations: Sequence[str]) -> DataFrame:
    """Cases whose next cycles are all known for so long: future, an array of structs of the column, the operations and a mask.

    Each cell's cycles are rebuilt as means over all windows that hold them; operations of a cycle count where one of them is known, the
    others as 0, and where no window knows any, the last ones of the case's history stand in, with mask 0. Runs of consecutive
    cycles are islands of equal cycle less place, so a case needs its first cycle's run alone, and is matched with its cycles only if they suffice.
    """
    whole = [column, *operations]
    zipped = F.arrays_zip(*(F.concat(f"{c}_seq", f"{c}_future").alias(c) for c in whole))
    long = cases.select("cell_uid", "window_start", F.posexplode(zipped).alias("i", "z")).select("cell_uid", (F.col("window_start") + F.col("i")).alias("cycle"), "z.*")
    some = F.coalesce(*(F.col(c) for c in operations)).isNotNull()
    means = [F.avg(column).alias(column), *(F.avg(F.when(some, F.coalesce(c, F.lit(0.0)))).alias(c) for c in operations)]
    cycles = long.groupBy("cell_uid", "cycle").agg(*means)
    known = cycles.where(F.col(column).isNotNull())
    island = F.col("cycle") - F.row_number().over(W.partitionBy("cell_uid").orderBy("cycle"))
    runs = known.withColumn("_run", island).withColumn("_end", F.max("cycle").over(W.partitionBy("cell_uid", "_run")))
    enough = runs.where(F.col("_end") - F.col("cycle") + 1 >= length).select("cell_uid", F.col("cycle").alias("window_end"))
    last = [F.coalesce(F.element_at(f"{c}_seq", -1), F.lit(0.0)).alias(f"_{c}") for c in operations]
    fit = cases.join(enough, ["cell_uid", "window_end"]).select("cell_uid", "window_start", "anchor_soh", *last, F.explode(F.sequence(F.col("window_end"), F.col("window_end") + length - 1)).alias("cycle"))
    found = F.col(operations[0]).isNotNull()
    step = F.struct("cycle", column, *(F.when(found, F.col(c)).otherwise(F.col(f"_{c}")).alias(c) for c in operations), found.cast("int").alias("mask"))
    return fit.join(cycles, ["cell_uid", "cycle"]).groupBy("cell_uid", "window_start", "anchor_soh").agg(F.sort_array(F.collect_list(step)).alias("future"))


def embedding(columns: Sequence[str], eps: float = 1e-8) -> Column:
    """Mean, deviation, minimum, maximum, last and slope of each window, by statistic; what is not finite is 0."""
    zero = lambda c: F.coalesce(c, F.lit(0.0))

    def slope(c: str) -> Column:
        n = F.size(c)
        x = F.transform(F.sequence(F.lit(0), n - 1), lambda i: i / (n - 1) - 0.5)
        m = array_mean(F.col(c))
        top = F.aggregate(F.zip_with(x, F.col(c), lambda a, y: F.coalesce(a * (y - m), F.lit(0.0))), F.lit(0.0), lambda a, y: a + y)
        return top / (F.aggregate(x, F.lit(0.0), lambda a, y: a + y * y) + eps)

    seqs = [f"{c}_seq" for c in columns]
    stats = [lambda c: array_mean(F.col(c)), lambda c: array_std(F.col(c)), F.array_min, F.array_max, lambda c: F.element_at(c, -1), slope]
    return F.array(*(zero(f(c)) for f in stats for c in seqs))


def unit(vector: Column) -> Column:
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda a, x: a + x * x))
    return F.transform(vector, lambda x: x / F.greatest(norm, F.lit(1e-12)))
