"""Raw samples to cycles, and cycles cleaned, labelled and given features. Keys: cell_uid, cycle_idx."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from voltrail.functions.columns import EARLIEST, by_cell, median, whole_cell
from voltrail.functions.ranks import numbered

NUMERIC = (
    "capacity soh voltage_mean voltage_max voltage_min current_mean current_abs_mean current_max current_min temp_mean temp_max temp_min "
    "cc_time cv_time charge_throughput discharge_throughput energy_charge energy_discharge"
).split()


# samples to cycles


def roll_up(raw: DataFrame, keys: tuple[str, ...] = ("cell", "cycle")) -> DataFrame:
    """Per cycle: capacity (first known in sample order), charge_capacity (largest while charging), means and extremes."""
    charging = F.col("step").contains("charge") & ~F.col("step").contains("discharge")
    return raw.groupBy(*keys).agg(
        F.min_by("capacity", F.when(F.col("capacity").isNotNull(), F.col("sample"))).alias("capacity"),
        F.max(F.when(charging, F.col("capacity"))).alias("charge_capacity"),
        F.avg("voltage").alias("voltage_mean"), F.max("voltage").alias("voltage_max"), F.min("voltage").alias("voltage_min"),
        F.avg("current").alias("current_mean"), F.avg(F.abs("current")).alias("current_abs_mean"),
        F.max("current").alias("current_max"), F.min("current").alias("current_min"),
        F.avg("temperature").alias("temp_mean"), F.max("temperature").alias("temp_max"), F.min("temperature").alias("temp_min"),
        F.count("*").alias("samples"),
    )


def _statistics() -> list[Column]:
    return [
        F.avg("voltage").alias("voltage_mean"), F.max("voltage").alias("voltage_max"), F.min("voltage").alias("voltage_min"),
        F.avg("current").alias("current_mean"), F.avg(F.abs("current")).alias("current_abs_mean"),
        F.max("current").alias("current_max"), F.min("current").alias("current_min"),
        F.avg("temperature").alias("temp_mean"), F.max("temperature").alias("temp_max"), F.min("temperature").alias("temp_min"),
    ]


def _rolled(raw: DataFrame, keys: tuple[str, ...], capacity: Column, charged: Column, charging: Column, cc: Column, cv: Column, time: str) -> DataFrame:
    found = raw.groupBy(*keys).agg(
        capacity.alias("capacity"), charged.alias("charge_capacity"), *_statistics(), duration(cc, time).alias("cc_time"), duration(cv, time).alias("cv_time"),
        F.avg(F.when(charging, F.col("voltage"))).alias("_up"), F.avg(F.when(F.col("current") < 0, F.col("voltage"))).alias("_down"),
    )
    cell, cycle = keys
    return found.withColumns({
        "charge_throughput": cumulative("charge_capacity", cell, cycle), "discharge_throughput": cumulative("capacity", cell, cycle),
        "energy_charge": F.col("charge_capacity") * F.col("_up"), "energy_discharge": F.col("capacity") * F.col("_down"),
    }).drop("_up", "_down")


def roll_up_hust(raw: DataFrame, keys: tuple[str, str] = ("cell", "cycle"), time: str = "clock") -> DataFrame:
    """Cycles of a lab that writes the discharged capacity (dq) into some rows: its first known value in sample order. Charged: the
    largest capacity of rows whose step says charge, in any case, and whose current is positive; throughputs are running sums."""
    current = F.coalesce(F.col("current") > 0, F.lit(False))
    charging = F.coalesce(F.lower("step").contains("charge"), F.lit(False)) & current
    cv = F.coalesce(constant_voltage(), F.lit(False))
    capacity = F.min_by("dq", F.when(F.col("dq").isNotNull(), F.col("sample")))
    return _rolled(raw, keys, capacity, F.max(F.when(charging, F.col("capacity"))), charging, charging & ~cv, cv, time)


def roll_up_tju(raw: DataFrame, keys: tuple[str, str] = ("cell", "cycle"), time: str = "clock") -> DataFrame:
    """Cycles of a lab with separate counters: capacity and charged capacity are the largest of q_discharge and q_charge; the steps say whether
    the current or the voltage was held. Isolated outliers of the capacity are for ``repair_capacity``."""
    charging = F.coalesce(F.col("current") > 0, F.lit(False))
    held = lambda text: charging & F.coalesce(F.lower("step").contains(text), F.lit(False))
    return _rolled(raw, keys, F.max("q_discharge"), F.max("q_charge"), charging, held("constant current"), held("constant voltage"), time)


def duration(phase: Column, time: str = "clock") -> Column:
    """Aggregate: last less first time of the rows of a phase, null if there are none."""
    at = F.when(phase, F.col(time))
    return F.max(at) - F.min(at)


def energy(capacity: Column, phase: Column, voltage: str = "voltage") -> Column:
    """Aggregate: capacity times the phase's mean voltage."""
    return capacity * F.avg(F.when(phase, F.col(voltage)))


def constant_voltage() -> Column:
    return F.lower("step").contains("constant voltage")


# cells cleaned


def cumulative(c: str | Column, key: str = "cell_uid", order: str = "cycle_idx") -> Column:
    """Running sum in cycle order, nulls as 0."""
    c = F.col(c) if isinstance(c, str) else c
    return F.sum(F.coalesce(c, F.lit(0.0))).over(by_cell(key, order).rowsBetween(EARLIEST, 0))


def nominal_capacity(df: DataFrame, skip: int = 0, window: int = 5, column: str = "capacity") -> DataFrame:
    """Per cell: nominal, the median of some known capacities after the first ones; at least one is left after skipping."""
    known = df.where(F.col(column).isNotNull()).select("cell_uid", "cycle_idx", F.col(column).alias("c"))
    known = known.withColumn("k", F.row_number().over(by_cell())).withColumn("n", F.count("*").over(whole_cell()))
    skipped = F.least(F.lit(skip), F.col("n") - 1)
    return known.where((F.col("k") > skipped) & (F.col("k") <= skipped + window)).groupBy("cell_uid").agg(median("c").alias("nominal"))


def with_soh(df: DataFrame, skip: int = 0, window: int = 5) -> DataFrame:
    """df with nominal and soh; a soh that the cell has already is left alone."""
    df = df.join(nominal_capacity(df, skip, window), "cell_uid", "left")
    made = F.when(F.col("nominal") > 0, F.col("capacity") / F.col("nominal"))
    if "soh" in df.columns:
        made = F.when(F.count("soh").over(whole_cell()) == 0, made).otherwise(F.col("soh"))
    return df.withColumn("soh", made)


def with_throughput(df: DataFrame, column: str) -> DataFrame:
    """Where a whole cell has no throughput, the running sum of its capacity stands in."""
    own = F.count(column).over(whole_cell())
    return df.withColumn(column, F.when(own == 0, cumulative("capacity")).otherwise(F.col(column)))


def charge_rate(df: DataFrame, hint: str | None = None) -> DataFrame:
    """Per cell: rate, the hint or else the median of the largest currents by the nominal capacity."""
    per = df.groupBy("cell_uid").agg(median(F.abs("current_max")).alias("top"), F.first("nominal", True).alias("nominal"), *([F.first(hint, True).alias("hint")] if hint else []))
    rate = F.when(F.col("nominal") > 0, F.col("top") / F.col("nominal"))
    return per.select("cell_uid", (F.coalesce("hint", rate) if hint else rate).alias("rate"))


def bucket(c: Column, limits: list[float], names: list[str]) -> Column:
    """The name of the first limit above c, the last name beyond; null for null."""
    out = None
    for limit, name in zip(limits, names):
        out = F.when(c < limit, name) if out is None else out.when(c < limit, name)
    return F.when(c.isNotNull(), out.otherwise(names[-1]))


def bucket_temperature(c: Column) -> Column:
    return bucket(c, [15, 30, 40], ["cold", "room", "warm", "hot"])


def bucket_rate(c: Column) -> Column:
    return bucket(c, [0.4, 1.5, 3.5], ["low", "medium", "high", "very_high"])


def bucket_nominal(c: Column) -> Column:
    return bucket(c, [1, 2, 3], ["sub_1ah", "1_to_2ah", "2_to_3ah", "3ah_plus"])


def voltage_label(low: Column, high: Column) -> Column:
    return F.concat(F.format_number(low, 1), F.lit("_"), F.format_number(high, 1), F.lit("V"))


def cell_buckets(df: DataFrame) -> DataFrame:
    """Per cell: buckets of its median temperature, its nominal capacity and its voltage window."""
    per = df.groupBy("cell_uid").agg(median("temp_mean").alias("t"), F.first("nominal", True).alias("c"), F.min("voltage_min").alias("low"), F.max("voltage_max").alias("high"))
    return per.select(
        "cell_uid", bucket_temperature(F.col("t")).alias("temperature_bucket"), bucket_nominal(F.col("c")).alias("nominal_capacity_bucket"),
        voltage_label(F.col("low"), F.col("high")).alias("voltage_window_bucket"),
    )


def missing_mask(columns: list[str], kinds: dict[str, str]) -> Column:
    """Sorted names of the null (or empty) columns of a row."""
    missing = lambda c: F.col(c).isNull() | ((F.col(c) == "") if kinds[c] == "string" else F.lit(False))
    return F.array_sort(F.array_compact(F.array(*(F.when(missing(c), F.lit(c)) for c in columns))))


def repair_capacity(df: DataFrame, column: str = "capacity", window: int = 7, floor: float = 0.6, least: float = 1e-4) -> DataFrame:
    """df with repaired (capacity) and outlier.

    An outlier is at or below ``least``, or below ``floor`` of its local median; it and gaps are interpolated by position
    between the nearest good values, and the ends take the nearest. Cells with under five known values are left alone.
    """
    w = max(3, window | 1)
    half, order, cell = w // 2, by_cell(), whole_cell()
    c = F.col(column)
    near = order.rowsBetween(-half, half)
    local = F.when(F.count(c).over(near) >= max(3, w // 2), F.percentile(c, F.lit(0.5)).over(near))
    local = F.coalesce(local, F.percentile(F.when(c > least, c), F.lit(0.5)).over(cell))
    df = df.withColumn("_local", local).withColumn("_known", F.count(c).over(cell)).withColumn("_at", F.row_number().over(order))
    outlier = (c <= least) | ((c < floor * F.col("_local")) & (F.col("_local") > least))
    df = df.withColumn("outlier", F.coalesce(outlier, F.lit(False)) & (F.col("_known") >= 5))
    good = F.when(~F.col("outlier") & c.isNotNull(), F.struct(F.col("_at").alias("at"), c.alias("c")))
    df = df.withColumn("_before", F.last(good, True).over(order.rowsBetween(EARLIEST, 0))).withColumn("_after", F.first(good, True).over(order.rowsBetween(0, W.unboundedFollowing)))
    a, b = F.col("_before"), F.col("_after")
    share = (F.col("_at") - a["at"]) / (b["at"] - a["at"])
    between = F.when(a["at"] == b["at"], a["c"]).otherwise(a["c"] + share * (b["c"] - a["c"]))
    repaired = F.when(F.col("_known") < 5, c).otherwise(F.coalesce(between, a["c"], b["c"]))
    return df.withColumn("repaired", repaired).drop("_local", "_known", "_at", "_before", "_after")


def assign_ids(df: DataFrame, keys: list[str], prefix: str = "cell") -> DataFrame:
    """One row per cell with cell_uid, numbered by the keys over ranges of them, so that no task sorts all cells."""
    cells = numbered(df.select(*keys).distinct(), [F.asc_nulls_first(k) for k in keys])
    return cells.withColumn("cell_uid", F.concat(F.lit(prefix + "_"), F.lpad((F.col("place") + 1).cast("string"), 5, "0"))).drop("place")


# protocol texts


def fastcharge_rate(c: Column) -> Column:
    """The largest rate in a protocol text such as 5.4C(60%)-3.6C."""
    rates = F.regexp_extract_all(c, F.lit(r"(\d+(?:\.\d+)?)C"), F.lit(1))
    return F.array_max(F.transform(rates, lambda x: x.cast("double")))


def rate_token(c: Column) -> Column:
    """025 is 0.25 and 05 is 0.5: a leading zero stands for the point."""
    point = F.when(c.contains("."), c).when(c.rlike("^0[0-9]+$"), F.concat(F.lit("0."), F.substring(c, 2, 10))).otherwise(c)
    return point.cast("double")


def test_protocol(c: Column) -> Column:
    """temperature, rates, group and cell of a name such as CY25-05_1-#3."""
    part = lambda i: F.regexp_extract(c, r"CY(\d+)-([\d.]+)(?:_([\d.]+))?-#(\d+)", i)
    return F.struct(part(1).cast("double").alias("temperature"), rate_token(part(2)).alias("charge_rate"), F.nullif(part(3), F.lit("")).alias("discharge_group"), part(4).cast("int").alias("cell"))


def condition_policy(c: Column) -> Column:
    """Policy and completeness of a condition name: R… regular, RW random walk, Sim_satellite satellite."""
    policy = F.when(c.startswith("Sim_satellite"), "satellite").when(c.startswith("RW"), "irregular").when(c.startswith("R"), "multistage").otherwise("regular")
    return F.struct(policy.alias("policy"), F.when(policy.isin("satellite", "irregular"), "partial").otherwise("full").alias("completeness"))


# features of cycles


def with_derived(df: DataFrame) -> DataFrame:
    """soh_pct, capacity_ratio, ranges, and the absolute current with a fallback for whole cells."""
    own = F.abs("current_abs_mean") if "current_abs_mean" in df.columns else F.lit(None).cast("double")
    df = df.withColumn("current_abs_mean", own)
    fallback = F.when(F.count("current_abs_mean").over(whole_cell()) == 0, F.abs("current_mean")).otherwise(F.col("current_abs_mean"))
    return df.withColumns({
        "soh_pct": F.col("soh") * 100, "capacity_ratio": F.col("soh"), "voltage_range": F.col("voltage_max") - F.col("voltage_min"),
        "temp_range": F.col("temp_max") - F.col("temp_min"), "current_abs_mean": fallback,
    })


def delta(c: str, periods: int = 1) -> Column:
    return F.col(c) - F.lag(c, periods).over(by_cell())


def slope(df: DataFrame, c: str, window: int = 5) -> DataFrame:
    """c_slope_w: the mean of the last w - 1 differences that are known."""
    df = df.withColumn("_d", delta(c))
    return df.withColumn(f"{c}_slope_{window}", F.avg("_d").over(by_cell().rowsBetween(-(window - 2), 0))).drop("_d")


def rolling_std(c: str, window: int = 5) -> Column:
    return F.stddev_samp(c).over(by_cell().rowsBetween(-(max(window, 2) - 1), 0))


def normalized(df: DataFrame, rules: dict[str, str]) -> DataFrame:
    """df with x_norm for each x of rules: identity, percent, first, robust or scale. Cells are their own standard."""
    cell = whole_cell()
    for x, rule in rules.items():
        c = F.col(x)
        if rule == "identity":
            out = c
        elif rule == "percent":
            out = c / 100
        elif rule == "first":
            first = F.first(c, True).over(by_cell().rowsBetween(EARLIEST, W.unboundedFollowing))
            out = c / F.when(F.abs(first) > 1e-8, first).otherwise(1.0)
        else:
            df = df.withColumn("_q", F.percentile(F.abs(c), F.lit(0.95)).over(cell))
            if rule == "robust":
                df = df.withColumn("_m", F.percentile(c, F.lit(0.5)).over(cell))
                df = df.withColumn("_mad", F.percentile(F.abs(c - F.col("_m")), F.lit(0.5)).over(cell))
                scale = F.when(F.col("_mad") > 1e-8, 1.4826 * F.col("_mad")).when(F.col("_q") >= 1e-8, F.col("_q")).otherwise(1.0)
                out = (c - F.col("_m")) / scale
            else:
                top = F.max(F.abs(c)).over(cell)
                out = c / F.when(F.col("_q") >= 1e-8, F.col("_q")).when(top >= 1e-8, top).otherwise(1.0)
        df = df.withColumn(f"{x}_norm", F.coalesce(out, F.lit(0.0)))
    return df.drop("_q", "_m", "_mad")


def operation_vector() -> Column:
    """Eight operating features of a cycle, nulls as 0; needs the features above."""
    parts = [
        F.col("current_abs_mean"), F.abs("current_mean_std_5"), F.greatest(F.abs("current_max"), F.abs("current_min")), F.col("temp_mean"),
        F.abs("temp_mean_std_5"), F.col("temp_max"), F.col("energy_charge_delta_1"), F.col("energy_discharge_delta_1"),
    ]
    return F.array(*(F.coalesce(p, F.lit(0.0)) for p in parts))


def aging_index() -> Column:
    n = F.count("*").over(whole_cell())
    return (F.row_number().over(by_cell()) - 1) / F.greatest(n - 1, F.lit(1))


def power_proxy(df: DataFrame, column: str | None = None) -> Column:
    """The column, or where a whole cell has nothing but 0 in it, the absolute energy differences."""
    energy = sum(F.coalesce(F.abs(f"energy_{k}_delta_1"), F.lit(0.0)) for k in ("charge", "discharge"))
    if column is None or column not in df.columns:
        return energy
    top = F.coalesce(F.max(F.abs(column)).over(whole_cell()), F.lit(0.0))
    return F.when(top == 0, energy).otherwise(F.coalesce(column, F.lit(0.0)))


def expert_vector(df: DataFrame) -> Column:
    """Fourteen features of a cycle: state, curve, operation, aging."""
    zero = lambda c: F.coalesce(F.col(c) if c in df.columns else F.lit(0.0), F.lit(0.0))
    soh = zero("soh")
    curve = [zero(f"qv_{c}") for c in ("dqdv_peak_value", "dqdv_peak_voltage", "dqdv_area", "capacity_span")]
    return F.array(
        soh, *curve, zero("temp_mean"), F.abs(zero("temp_mean_std_5")), zero("temp_max"), zero("current_abs_mean"), F.abs(zero("current_mean_std_5")),
        F.greatest(F.abs(zero("current_max")), F.abs(zero("current_min"))), power_proxy(df, "qv_power_energy_proxy"), aging_index(), F.greatest(F.lit(0.0), 0.9 - soh),
    )


def stress_vector(df: DataFrame, strict_masks: bool = False) -> tuple[Column, Column]:
    """Twelve features and their masks. Unless masks are strict, curve features that a cycle lacks count as known zeros."""
    curve = [f"qv_{c}" for c in ("dqdv_peak_value", "dqdv_peak_voltage", "dqdv_area", "capacity_span")]
    there = [F.col(c) if c in df.columns else F.lit(None).cast("double") for c in curve]
    parts = [
        *there, F.col("temp_mean"), F.abs("temp_mean_std_5"), F.col("temp_max"), F.col("current_abs_mean"), F.abs("current_mean_std_5"),
        F.greatest(F.abs("current_max"), F.abs("current_min")), power_proxy(df, "qv_power_energy_proxy"), aging_index(),
    ]
    masks = [F.when(p.isNotNull(), 1.0).otherwise(0.0) if strict_masks else F.lit(1.0) for p in parts]
    return F.array(*(F.coalesce(p, F.lit(0.0)) for p in parts)), F.array(*masks)


def with_features(df: DataFrame, window: int = 5) -> DataFrame:
    """All rolling features of a cycle table in one pass over its cells."""
    df = with_derived(df)
    for c in ("soh", "voltage_mean", "temp_mean", "current_mean"):
        df = slope(df.withColumn(f"{c}_diff_1", delta(c)).withColumn(f"{c}_std_{window}", rolling_std(c, window)), c, window)
    for c in ("charge_throughput", "discharge_throughput", "energy_charge", "energy_discharge"):
        df = df.withColumn(f"{c}_delta_1", delta(c))
    return df
