"""Curves of cycles: phases, windows, smoothing, voltage-indexed maps, and distances of curves."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from voltrail.functions import curves as fn


def elapsed(df: DataFrame, time: str, unit: str = "s", keys: tuple[str, ...] = ("cell", "cycle"), order: str = "sample") -> DataFrame:
    """df with minutes since the cycle's first sample; unit: s, min or h."""
    w = W.partitionBy(*keys).orderBy(order)
    first = F.first(time, True).over(w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    return df.withColumn("minutes", (F.col(time) - first) / {"s": 60, "min": 1, "h": 1 / 60}[unit])


def inferred_time(df: DataFrame, column: str, into: str = "minutes", keys: tuple[str, ...] = ("cell", "cycle"), order: str = "sample") -> DataFrame:
    """df with the time column in minutes or hours, whatever its unit.

    The column's name says minutes (min) or seconds (time/s, (s)); otherwise a cycle whose largest value is over 200 is in
    seconds and others are in the unit asked for. Gaps are filled by position between the values around them, ends by the nearest.
    Texts are timestamps and count from the cycle's first row, if two or more are known. Without any value the row's number (from 0)
    stands in: as minutes, or as seconds where hours are asked for.
    """
    w = W.partitionBy(*keys)
    ordered = w.orderBy(order)
    per_hour = into == "hours"
    ordinal = (F.row_number().over(ordered) - 1).cast("double") / (3600.0 if per_hour else 1.0)
    if dict(df.dtypes)[column] == "string":
        at = F.expr(f"try_cast(`{column}` AS timestamp)").cast("double")
        first = F.first(at).over(ordered.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
        passed = (at - first) / (3600.0 if per_hour else 60.0)
        return df.withColumn(into, F.when(F.count(at).over(w) >= 2, passed).otherwise(ordinal))
    name, seconds = column.lower(), 3600.0 if per_hour else 60.0
    df = df.withColumns({"_m": F.nanvl(F.col(column).cast("double"), F.lit(None).cast("double")), "_at": F.row_number().over(ordered)})
    known = F.when(F.col("_m").isNotNull(), F.struct(F.col("_at").alias("at"), F.col("_m").alias("m")))
    df = df.withColumns({"_a": F.last(known, True).over(ordered.rowsBetween(W.unboundedPreceding, 0))})
    # from the end on, as a frame that ends there is gone through anew for each row
    df = df.withColumn("_b", F.last(known, True).over(w.orderBy(F.desc("_at")).rowsBetween(W.unboundedPreceding, 0)))
    a, b = F.col("_a"), F.col("_b")
    filled = F.when(a["at"] == b["at"], a["m"]).otherwise(a["m"] + (F.col("_at") - a["at"]) / (b["at"] - a["at"]) * (b["m"] - a["m"]))
    filled = F.coalesce(filled, a["m"], b["m"])
    if "min" in name:
        value = filled / 60.0 if per_hour else filled
    elif "time/s" in name or "(s)" in name:
        value = filled / seconds
    else:
        value = F.when(F.max("_m").over(w) > 200, filled / seconds).otherwise(filled)
    return df.withColumn(into, F.coalesce(value, ordinal)).drop("_m", "_at", "_a", "_b")


def charge_mask(step: str = "step", current: str = "current", eps: float = 1e-4, strict: bool = False) -> Column:
    """By the step's text where there is one (which takes discharge for charge too, unless strict), else by the sign."""
    text = F.lower(step).contains("charge") & (~F.lower(step).contains("discharge") if strict else F.lit(True))
    return F.when(F.col(step).isNotNull(), text).otherwise(F.col(current) > eps)


def discharge_mask(step: str = "step", current: str = "current", eps: float = 1e-4) -> Column:
    return F.when(F.col(step).isNotNull(), F.lower(step).contains("discharge")).otherwise(F.col(current) < -eps)


def voltage_window(dataset: str, chemistry: str, low: Column | None = None, high: Column | None = None) -> Column:
    """Limits by chemistry or dataset; explicit limits win, 0 to 1 where nothing is known."""
    d, c = F.lower(dataset), F.upper(chemistry)
    iron = c.contains("LFP") | (c.isNull() | (c == "")) & d.isin("mit", "hust")
    nickel = c.rlike("NCM|NMC|NCA") | (c.isNull() | (c == "")) & d.isin("tju", "xjtu")
    pick = lambda x, y, given: F.coalesce(given if given is not None else F.lit(None).cast("double"), F.when(iron, x).when(nickel, y))
    return F.struct(F.coalesce(pick(2.8, 3.6, low), F.lit(0.0)).alias("low"), F.coalesce(pick(3.6, 4.1, high), F.lit(1.0)).alias("high"))


def smoothed(column: str, window: int = 5, keys: tuple[str, ...] = ("cell", "cycle"), order: str = "sample") -> Column:
    half = window // 2
    return F.percentile(column, F.lit(0.5)).over(W.partitionBy(*keys).orderBy(order).rowsBetween(-half, half))


def spectral_features(df: DataFrame, columns: list[str], window: int = 16) -> DataFrame:
    """df with x_fft_entropy_w and x_fft_low_ratio_w of the trailing windows; null where too little is known."""
    least = min(max(window // 2, 4), window)
    over = W.partitionBy("cell_uid").orderBy("cycle_idx").rowsBetween(-(window - 1), 0)

    @F.pandas_udf("entropy double, low double")
    def both(series: pd.Series) -> pd.DataFrame:
        out = np.full((len(series), 2), np.nan)
        sizes = series.map(len).to_numpy()
        for n in np.unique(sizes):
            if n >= least:
                at = np.flatnonzero(sizes == n)
                out[at] = np.stack(fn.spectral(np.stack(series.iloc[at].to_list())), axis=1)
        return pd.DataFrame(out, columns=["entropy", "low"])

    for c in columns:
        df = df.withColumn("_s", both(F.collect_list(c).over(over)))
        df = df.withColumns({f"{c}_fft_entropy_{window}": F.nanvl("_s.entropy", F.lit(None)), f"{c}_fft_low_ratio_{window}": F.nanvl("_s.low", F.lit(None))}).drop("_s")
    return df


def _cycles(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[int, int, dict[str, np.ndarray]]]:
    """The cycles of a sorted partition, one after the other, with their samples as arrays."""
    held: list[pa.RecordBatch] = []
    for batch in chain(batches, [None]):
        if batch is not None:
            held.append(batch)
        if not sum(b.num_rows for b in held):
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        arrays = {c: table.column(c).to_numpy() for c in table.column_names}
        cell, cycle = arrays["cell"], arrays["cycle"]
        begins = [0, *(np.flatnonzero((cell[1:] != cell[:-1]) | (cycle[1:] != cycle[:-1])) + 1).tolist(), len(cell)]
        held = []
        if batch is not None:  # the last one may go on
            begins.pop()
            held = table.slice(begins[-1]).to_batches()
        for begin, end in zip(begins, begins[1:]):
            yield int(cell[begin]), int(cycle[begin]), {c: a[begin:end] for c, a in arrays.items()}


def _column(values: list, kind: pa.DataType) -> pa.Array:
    """An Arrow array of values of a kind; a list of lists comes as a matrix."""
    if not (pa.types.is_list(kind) and pa.types.is_list(kind.value_type)):
        return pa.array(values, kind)
    ends = lambda sizes: pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())
    flat = pa.array(np.concatenate([v.ravel() for v in values]) if values else np.zeros(0))
    return pa.ListArray.from_arrays(ends([len(v) for v in values]), pa.ListArray.from_arrays(ends([v.shape[1] for v in values for _ in v]), flat))


def _per_cycle(raw: DataFrame, columns: Sequence[str], f, kinds: dict[str, tuple[str, pa.DataType]]) -> DataFrame:
    """Rows of cell, cycle and what f makes of the arrays of a cycle's samples, in order. Cycles are spread over the tasks, which
    take them one by one. kinds: the columns that f makes, with their types."""
    names, schema = ["cell", "cycle", *kinds], pa.schema([("cell", pa.int64()), ("cycle", pa.int64()), *((c, k) for c, (_, k) in kinds.items())])

    def made(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([_column([x[i] for x in out], schema.field(c).type) for i, c in enumerate(names)], schema=schema)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        for cell, cycle, g in _cycles(batches):
            out.append((cell, cycle, *f(g)))
            if len(out) >= 500:
                yield made(out)
                out = []
        yield made(out)

    one = raw.select(F.col("cell").cast("long").alias("cell"), F.col("cycle").cast("long").alias("cycle"), "sample", *columns)
    ddl = "cell long, cycle long, " + ", ".join(f"{c} {t}" for c, (t, _) in kinds.items())
    return one.repartition("cell", "cycle").sortWithinPartitions("cell", "cycle", "sample").mapInArrow(run, ddl)


NUMBERS = ("array<double>", pa.list_(pa.float64()))


def discharge_maps(raw: DataFrame, size: int = 100, skip_first: Column | None = None, whole: bool = True) -> DataFrame:
    """Per cell and cycle: channels on the voltage grid and masks (unless whole is false), and statistics. raw: cell, cycle, sample, hours, voltage,
    current, capacity, temperature, discharging, low, high. Of the cells of skip_first (those of a lab that calibrates in the first
    cycle) the first cycle counts as one without samples."""
    if skip_first is not None:
        first = F.col("cycle") == F.min("cycle").over(W.partitionBy("cell"))
        raw = raw.withColumn("discharging", F.col("discharging") & ~(first & F.coalesce(skip_first, F.lit(False))))
    maps = {"channels": ("array<array<double>>", pa.list_(pa.list_(pa.float64()))), "masks": NUMBERS} if whole else {}
    kinds = maps | {f"qv_{s}": ("double", pa.float64()) for s in fn.STATS}
    raw = raw.withColumn("discharging", F.coalesce("discharging", F.lit(False)).cast("int"))

    def made(g: dict[str, np.ndarray]) -> tuple:
        c, m, s = fn.discharge_map(g["hours"], g["voltage"], g["current"], g["capacity"], g["temperature"], g["discharging"], g["low"][0], g["high"][0], size)
        return *((c, m) if whole else ()), *s.tolist()

    return _per_cycle(raw, ["hours", "voltage", "current", "capacity", "temperature", "discharging", "low", "high"], made, kinds)


def charge_curves(raw: DataFrame, size: int = 50) -> DataFrame:
    """Per cell and cycle: the partial charge curve, null where there is too little."""

    def made(g: dict[str, np.ndarray]) -> tuple:
        q = fn.partial_charge(g["minutes"], g["voltage"], g["current"], g["charging"], size)
        return (q,)

    raw = raw.withColumn("charging", F.coalesce("charging", F.lit(False)).cast("int"))
    return _per_cycle(raw, ["minutes", "voltage", "current", "charging"], made, {"curve": NUMBERS})


def dqdv_curves(raw: DataFrame, **sizes) -> DataFrame:
    """Per cell and cycle: voltages and dQ/dV of the charge, nulls where there is too little. raw: cell, cycle, sample, voltage,
    capacity, charging; sizes: of ``charge_dqdv``."""

    def made(g: dict[str, np.ndarray]) -> tuple:
        curve = fn.charge_dqdv(g["voltage"], g["capacity"], g["charging"], **sizes)
        return (None, None) if curve is None else curve

    raw = raw.withColumn("charging", F.coalesce("charging", F.lit(False)).cast("int"))
    return _per_cycle(raw, ["voltage", "capacity", "charging"], made, {"grid": NUMBERS, "dqdv": NUMBERS})


def charging_rows(step: str = "step", current: str = "current", keys: tuple[str, ...] = ("cell", "cycle")) -> Column:
    """Positive current, in rows whose step says charge if any row of the cycle does."""
    says = F.coalesce(F.lower(step).contains("charge"), F.lit(False))
    positive = F.coalesce(F.col(current) > 0, F.lit(False))
    return positive & (says | ~F.max(says).over(W.partitionBy(*keys)))


def dqdv_distances(pairs: DataFrame, least: float | None = None, points: int = 20) -> DataFrame:
    """pairs (q_grid, q_dqdv, r_grid, r_dqdv and others) with d_dqdv of the curves, or of their parts from a voltage on; null where a curve is
    missing or they share too little."""

    @F.pandas_udf("double")
    def distance(v1: pd.Series, d1: pd.Series, v2: pd.Series, d2: pd.Series) -> pd.Series:
        out = []
        for a, b, c, d in zip(v1, d1, v2, d2):
            x, y = (None if v is None else (v, w) for v, w in ((a, b), (c, d)))
            if least is not None:
                x, y = fn.above(x, least, points), fn.above(y, least, points)
            out.append(np.nan if x is None or y is None else fn.dqdv_distance(*x, *y, least))
        return pd.Series(out, dtype=float)

    return pairs.withColumn("d_dqdv", F.nanvl(distance("q_grid", "q_dqdv", "r_grid", "r_dqdv"), F.lit(None).cast("double")))


def map_curves(maps: DataFrame, least: float = 3.2, points: int = 20) -> DataFrame:
    """maps (channels, masks) with grid and dqdv from the stored voltages, nulls where there is too little."""

    @F.pandas_udf("grid array<double>, dqdv array<double>")
    def curve(voltages: pd.Series, known: pd.Series) -> pd.DataFrame:
        found = [fn.map_dqdv(v, least, points) if k > 0 else None for v, k in zip(voltages, known)]
        return pd.DataFrame([(None, None) if f is None else tuple(x.tolist() for x in f) for f in found], columns=["grid", "dqdv"])

    made = maps.withColumn("_c", curve(F.element_at("channels", 1), F.element_at("masks", 1)))
    return made.withColumns({"grid": F.col("_c.grid"), "dqdv": F.col("_c.dqdv")}).drop("_c")


def life_curves(cycles: DataFrame, key: str = "cell_uid") -> DataFrame:
    """Per cell: capacities by cycle, relative to the first; as they are if that is nothing."""
    rows = F.sort_array(F.collect_list(F.struct("cycle_idx", "capacity")))
    one = cycles.where("capacity IS NOT NULL").groupBy(key).agg(rows.alias("r"))
    first = F.element_at("r.capacity", 1)
    base = F.when(F.abs(first) > 1e-6, first).otherwise(1.0)
    return one.select(key, F.transform("r.capacity", lambda x: x / base).alias("life"))


def life_distances(pairs: DataFrame, lives: DataFrame, key: str = "cell_uid") -> DataFrame:
    """pairs (a, b) with rmse of their lives."""
    side = lambda n: lives.select(F.col(key).alias(n), F.col("life").alias(f"life_{n}"))

    @F.pandas_udf("double")
    def rmse(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([fn.life_rmse(x, y) for x, y in zip(a, b)], dtype=float)

    both = pairs.join(side("a"), "a").join(side("b"), "b")
    return both.select("a", "b", F.nanvl(rmse("life_a", "life_b"), F.lit(None)).alias("rmse"))


def window_stress(seq: str) -> list[Column]:
    """Mean, deviation, last known and change of a window of one feature, and the share that is known."""
    from voltrail.functions.columns import array_count, array_mean, array_std

    c = F.col(seq)
    known = F.filter(c, lambda x: x.isNotNull())
    return [array_mean(c).alias("mean"), array_std(c).alias("std"), F.element_at(known, -1).alias("last"), (F.element_at(known, -1) - F.element_at(known, 1)).alias("change"), (array_count(c) / F.size(c)).alias("available")]
