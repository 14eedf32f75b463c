"""Phases, curves and spectra."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voltrail.functions.columns import r6
from voltrail.functions.curves import STATS
from voltrail.operators import curves as op
from voltrail.plans.registry import query
from voltrail.plans.window_plans import CASES_SQL, cases_of
from voltrail.sources.roles import CYCLES_SQL, RAW_SQL, cycles, raw_samples


@query(RAW_SQL + " SELECT cell, cycle, sample, round((clock - first_value(clock) OVER (PARTITION BY cell, cycle ORDER BY sample)) / 60, 6) AS minutes FROM raw")
def elapsed_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.elapsed(raw_samples(spark, sf_dir), "clock").select("cell", "cycle", "sample", r6("minutes", "minutes"))


@query(RAW_SQL + " SELECT cell, cycle, count(*) FILTER (step LIKE '%charge%') AS charge, count(*) FILTER (step LIKE '%charge%' AND step NOT LIKE '%discharge%') AS strict_charge, count(*) FILTER (step LIKE '%discharge%') AS discharge, count(*) FILTER (current > 1e-4) AS by_sign FROM raw GROUP BY cell, cycle")
def phase_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = raw_samples(spark, sf_dir).withColumn("none", F.lit(None).cast("string"))
    count = lambda c: F.count(F.when(c, 1))
    return df.groupBy("cell", "cycle").agg(count(op.charge_mask()).alias("charge"), count(op.charge_mask(strict=True)).alias("strict_charge"), count(op.discharge_mask()).alias("discharge"), count(op.charge_mask("none")).alias("by_sign"))


@query(CYCLES_SQL + " SELECT DISTINCT cell_uid, CASE WHEN chemistry_family = 'LFP' THEN 2.8 ELSE 3.6 END::DOUBLE AS low, CASE WHEN chemistry_family = 'LFP' THEN 3.6 ELSE 4.1 END::DOUBLE AS high FROM cycles")
def voltage_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = op.voltage_window("source_dataset", "chemistry_family")
    return cycles(spark, sf_dir).select("cell_uid", w["low"].alias("low"), w["high"].alias("high")).distinct()


@query(RAW_SQL + " SELECT cell, cycle, sample, round(quantile_cont(voltage, 0.5) OVER (PARTITION BY cell, cycle ORDER BY sample ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), 6) AS voltage FROM raw")
def smooth_signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw_samples(spark, sf_dir).select("cell", "cycle", "sample", r6(op.smoothed("voltage"), "voltage"))


@query()
def spectral_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ["voltage_mean", "temp_mean"]
    out = op.spectral_features(cycles(spark, sf_dir), names)
    return out.select("cell_uid", "cycle_idx", *(r6(f"{c}_fft_{k}_16", f"{c}_{k}") for c in names for k in ("entropy", "low_ratio")))


def maps_of(spark: SparkSession, sf_dir: str, whole: bool = True) -> DataFrame:
    raw = op.inferred_time(raw_samples(spark, sf_dir), "clock", "hours").withColumns({"discharging": op.discharge_mask(), "low": F.lit(2.8), "high": F.lit(3.6)})
    return op.discharge_maps(raw, skip_first=F.col("cell") % 4 == 3, whole=whole)


@query()
def qv_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maps_of(spark, sf_dir, False).select("cell", "cycle", *(r6(f"qv_{s}", f"qv_{s}") for s in STATS))


@query()
def partial_charge(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = op.elapsed(raw_samples(spark, sf_dir), "clock").withColumn("charging", op.charge_mask(strict=True))
    return op.charge_curves(raw).select("cell", "cycle", r6(F.element_at("curve", -1), "charge"), F.size("curve").alias("points"))


def dqdv_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples are few per cycle in the test tables, so that ten bins are enough here."""
    raw = raw_samples(spark, sf_dir)
    return op.dqdv_curves(raw.withColumn("charging", op.charging_rows()), least=10)


@query()
def charge_dqdv(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dqdv_of(spark, sf_dir)
    top = F.array_max("dqdv")
    return out.select("cell", "cycle", F.size("grid").alias("points"), r6(top, "peak"), r6(F.element_at("grid", F.array_position("dqdv", top).cast("int")), "peak_voltage"))


@query()
def dqdv_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each cycle's charge curve against the cell's next cycle, whole and from 3.2 V on."""
    curves = dqdv_of(spark, sf_dir)
    side = lambda p, shift: curves.select("cell", (F.col("cycle") - shift).alias("cycle"), F.col("grid").alias(f"{p}_grid"), F.col("dqdv").alias(f"{p}_dqdv"))
    pairs = side("q", 0).join(side("r", 1), ["cell", "cycle"])
    both = op.dqdv_distances(op.dqdv_distances(pairs).withColumnRenamed("d_dqdv", "whole"), 3.2)
    return both.select("cell", "cycle", r6("whole", "whole"), r6("d_dqdv", "high"))


@query()
def map_dqdv(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = op.map_curves(maps_of(spark, sf_dir))
    return out.select("cell", "cycle", F.size("grid").alias("points"), r6(F.array_max("dqdv"), "peak"))


@query()
def life_rmse(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = cycles(spark, sf_dir)
    cells = df.select("user_id", F.col("cell_uid").alias("a")).distinct()
    pairs = cells.join(cells.select((F.col("user_id") - 1).alias("user_id"), F.col("a").alias("b")), "user_id").select("a", "b")
    return op.life_distances(pairs, op.life_curves(df)).withColumn("rmse", r6("rmse"))


@query(CASES_SQL + """ SELECT cell_uid, window_start, round(list_avg(soh_seq), 8) AS mean, round(list_stddev_pop(soh_seq), 6) AS std, round(list_last(list_filter(soh_seq, lambda x: x IS NOT NULL)), 6) AS last,
  round(list_last(list_filter(soh_seq, lambda x: x IS NOT NULL)) - list_first(list_filter(soh_seq, lambda x: x IS NOT NULL)), 6) AS change, round(list_count(soh_seq) / 16, 6) AS available FROM cases""")
def window_stress(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = cases_of(spark, sf_dir).select("cell_uid", "window_start", *op.window_stress("soh_seq"))
    return out.select("cell_uid", "window_start", F.round("mean", 8).alias("mean"), *(r6(c, c) for c in ("std", "last", "change", "available")))
