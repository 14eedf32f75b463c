"""Cycle roll-up, cleaning, labels and features."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voltrail.functions.columns import r6
from voltrail.operators import cycles as op
from voltrail.plans.registry import query
from voltrail.sources.roles import CYCLES_SQL, RAW_SQL, cycles, pick, raw_samples, table

KEYS = ["cell_uid", "cycle_idx"]


def rounded(df: DataFrame, *columns: str, keys: list[str] = KEYS) -> DataFrame:
    return df.select(*keys, *(r6(c, c) for c in columns))


def rounds(*columns: str) -> str:
    return ", ".join(f"round({c}, 6) AS {c}" for c in columns)


ROLLED = "capacity charge_capacity voltage_mean voltage_max voltage_min current_mean current_abs_mean current_max current_min temp_mean temp_max temp_min".split()


@query(RAW_SQL + f""", r AS (
  SELECT cell, cycle, arg_min(capacity, sample) FILTER (capacity IS NOT NULL) AS capacity,
    max(capacity) FILTER (step LIKE '%charge%' AND step NOT LIKE '%discharge%') AS charge_capacity,
    avg(voltage) AS voltage_mean, max(voltage) AS voltage_max, min(voltage) AS voltage_min, avg(current) AS current_mean,
    avg(abs(current)) AS current_abs_mean, max(current) AS current_max, min(current) AS current_min,
    avg(temperature) AS temp_mean, max(temperature) AS temp_max, min(temperature) AS temp_min, count(*) AS samples
  FROM raw GROUP BY cell, cycle)
SELECT cell, cycle, samples, {rounds(*ROLLED)} FROM r""")
def cycle_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(op.roll_up(raw_samples(spark, sf_dir)), *ROLLED, keys=["cell", "cycle", "samples"])


LAB = [*ROLLED, "cc_time", "cv_time", "charge_throughput", "discharge_throughput", "energy_charge", "energy_discharge"]


def lab_sql(capacity: str, charged: str, charging: str, cc: str, cv: str) -> str:
    """Both labs' samples have dq in some rows, and counters by the sign of the current."""
    running = lambda c: f"sum(coalesce({c}, 0)) OVER (PARTITION BY cell ORDER BY cycle ROWS UNBOUNDED PRECEDING)"
    return RAW_SQL + f""", lab AS (SELECT *, CASE WHEN sample % 5 = 2 THEN capacity * 0.9::DOUBLE END AS dq, CASE WHEN current > 0 THEN capacity END AS q_charge, CASE WHEN current < 0 THEN capacity END AS q_discharge,
  CASE WHEN step = 'charge' THEN 'CC Charge, constant current' WHEN step = 'discharge' THEN 'DISCHARGE' ELSE 'Constant Voltage charge' END AS state FROM raw),
marked AS (SELECT *, {charging} AS charging, {cc} AS cc, {cv} AS cv FROM lab),
r AS (SELECT cell, cycle, {capacity} AS capacity, {charged} AS charge_capacity, avg(voltage) AS voltage_mean, max(voltage) AS voltage_max, min(voltage) AS voltage_min, avg(current) AS current_mean,
    avg(abs(current)) AS current_abs_mean, max(current) AS current_max, min(current) AS current_min, avg(temperature) AS temp_mean, max(temperature) AS temp_max, min(temperature) AS temp_min,
    max(clock) FILTER (cc) - min(clock) FILTER (cc) AS cc_time, max(clock) FILTER (cv) - min(clock) FILTER (cv) AS cv_time, avg(voltage) FILTER (charging) AS up, avg(voltage) FILTER (current < 0) AS down FROM marked GROUP BY cell, cycle),
t AS (SELECT *, {running("charge_capacity")} AS charge_throughput, {running("capacity")} AS discharge_throughput, charge_capacity * up AS energy_charge, capacity * down AS energy_discharge FROM r)
SELECT cell, cycle, {rounds(*LAB)} FROM t"""


def lab_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    current, capacity = F.col("current"), F.col("capacity")
    step = F.when(F.col("step") == "charge", "CC Charge, constant current").when(F.col("step") == "discharge", "DISCHARGE").otherwise("Constant Voltage charge")
    return raw_samples(spark, sf_dir).withColumns({"dq": F.when(F.col("sample") % 5 == 2, capacity * 0.9), "q_charge": F.when(current > 0, capacity), "q_discharge": F.when(current < 0, capacity), "step": step})


@query(lab_sql("arg_min(dq, sample) FILTER (dq IS NOT NULL)", "max(capacity) FILTER (charging)", "contains(lower(state), 'charge') AND current > 0", "contains(lower(state), 'charge') AND current > 0 AND NOT contains(lower(state), 'constant voltage')", "contains(lower(state), 'constant voltage')"))
def rollup_hust(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(op.roll_up_hust(lab_samples(spark, sf_dir)), *LAB, keys=["cell", "cycle"])


@query(lab_sql("max(q_discharge)", "max(q_charge)", "current > 0", "current > 0 AND contains(lower(state), 'constant current')", "current > 0 AND contains(lower(state), 'constant voltage')"))
def rollup_tju(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(op.roll_up_tju(lab_samples(spark, sf_dir)), *LAB, keys=["cell", "cycle"])


@query(RAW_SQL + """
SELECT cell, cycle, max(clock) FILTER (cv) - min(clock) FILTER (cv) AS cv_time, max(clock) FILTER (step = 'charge') - min(clock) FILTER (step = 'charge') AS cc_time
FROM (SELECT *, step LIKE '%constant voltage%' AS cv FROM raw) GROUP BY cell, cycle""")
def phase_durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw_samples(spark, sf_dir).groupBy("cell", "cycle").agg(op.duration(op.constant_voltage()).alias("cv_time"), op.duration(F.col("step") == "charge").alias("cc_time"))


@query(RAW_SQL + """
SELECT cell, cycle, round(max(capacity) * avg(voltage) FILTER (step = 'discharge'), 6) AS energy_discharge, round(max(capacity) * avg(voltage) FILTER (step = 'charge'), 6) AS energy_charge
FROM raw GROUP BY cell, cycle""")
def phase_energy(spark: SparkSession, sf_dir: str) -> DataFrame:
    of = lambda s: r6(op.energy(F.max("capacity"), F.col("step") == s))
    return raw_samples(spark, sf_dir).groupBy("cell", "cycle").agg(of("discharge").alias("energy_discharge"), of("charge").alias("energy_charge"))


@query(CYCLES_SQL + """
SELECT cell_uid, cycle_idx, round(sum(coalesce(capacity, 0)) OVER (PARTITION BY cell_uid ORDER BY cycle_idx ROWS UNBOUNDED PRECEDING), 6) AS throughput FROM cycles""")
def cumulative_throughput(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cycles(spark, sf_dir).select(*KEYS, r6(op.cumulative("capacity"), "throughput"))


def nominal_sql(skip: int, window: int) -> str:
    return f"""SELECT cell_uid, quantile_cont(capacity, 0.5) AS nominal
  FROM (SELECT cell_uid, capacity, row_number() OVER (PARTITION BY cell_uid ORDER BY cycle_idx) AS k, count(*) OVER (PARTITION BY cell_uid) AS n FROM cycles WHERE capacity IS NOT NULL)
  WHERE k > least({skip}, n - 1) AND k <= least({skip}, n - 1) + {window} GROUP BY cell_uid"""


@query(CYCLES_SQL + f", m AS ({nominal_sql(3, 5)}) SELECT cell_uid, round(nominal, 6) AS nominal FROM m")
def nominal_capacity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(op.nominal_capacity(cycles(spark, sf_dir), skip=3), "nominal", keys=["cell_uid"])


SOH_SQL = CYCLES_SQL + f""", nominal AS ({nominal_sql(0, 5)}),
s AS (SELECT c.*, nominal, CASE WHEN nominal > 0 THEN capacity / nominal END AS soh FROM cycles c LEFT JOIN nominal USING (cell_uid))"""


def soh(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.with_soh(cycles(spark, sf_dir))


@query(SOH_SQL + f" SELECT cell_uid, cycle_idx, {rounds('soh')} FROM s")
def soh_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(soh(spark, sf_dir), "soh")


@query(CYCLES_SQL + """
SELECT cell_uid, cycle_idx, round(CASE WHEN count(charge_throughput) OVER (PARTITION BY cell_uid) = 0
  THEN sum(coalesce(capacity, 0)) OVER (PARTITION BY cell_uid ORDER BY cycle_idx ROWS UNBOUNDED PRECEDING) ELSE charge_throughput END, 6) AS charge_throughput FROM cycles""")
def throughput_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(op.with_throughput(cycles(spark, sf_dir), "charge_throughput"), "charge_throughput")


@query(CYCLES_SQL + """, l AS (
  SELECT cell_uid, cycle_idx, raw_capacity AS c, row_number() OVER w AS k, count(raw_capacity) OVER (PARTITION BY cell_uid) AS known,
    count(raw_capacity) OVER near AS n, quantile_cont(raw_capacity, 0.5) OVER near AS m
  FROM cycles WINDOW w AS (PARTITION BY cell_uid ORDER BY cycle_idx), near AS (PARTITION BY cell_uid ORDER BY cycle_idx ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)),
g AS (SELECT cell_uid, quantile_cont(c, 0.5) AS g FROM l WHERE c > 1e-4 GROUP BY cell_uid),
o AS (SELECT l.*, coalesce((c <= 1e-4 OR (c < 0.6 * loc AND loc > 1e-4)) AND known >= 5, false) AS outlier
      FROM (SELECT l.*, coalesce(CASE WHEN n >= 3 THEN m END, g) AS loc FROM l LEFT JOIN g USING (cell_uid)) l),
b AS (SELECT *, last_value(CASE WHEN NOT outlier AND c IS NOT NULL THEN k END IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS a1,
             first_value(CASE WHEN NOT outlier AND c IS NOT NULL THEN k END IGNORE NULLS) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS a2,
             last_value(CASE WHEN NOT outlier THEN c END IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS c1,
             first_value(CASE WHEN NOT outlier THEN c END IGNORE NULLS) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS c2
      FROM o WINDOW w AS (PARTITION BY cell_uid ORDER BY cycle_idx))
SELECT cell_uid, cycle_idx, outlier, round(CASE WHEN known < 5 THEN c ELSE coalesce(CASE WHEN a1 = a2 THEN c1 ELSE c1 + (k - a1) / (a2 - a1) * (c2 - c1) END, c1, c2) END, 6) AS repaired FROM b""")
def capacity_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.repair_capacity(cycles(spark, sf_dir), "raw_capacity").select(*KEYS, "outlier", r6("repaired", "repaired"))


@query(SOH_SQL + """ SELECT cell_uid, round(CASE WHEN any_value(nominal) > 0 THEN quantile_cont(abs(current_max), 0.5) / any_value(nominal) END, 6) AS rate FROM s GROUP BY cell_uid""")
def charge_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(op.charge_rate(soh(spark, sf_dir)), "rate", keys=["cell_uid"])


@query(SOH_SQL + """ SELECT cell_uid,
  CASE WHEN t < 15 THEN 'cold' WHEN t < 30 THEN 'room' WHEN t < 40 THEN 'warm' WHEN t IS NOT NULL THEN 'hot' END AS temperature_bucket,
  CASE WHEN c < 1 THEN 'sub_1ah' WHEN c < 2 THEN '1_to_2ah' WHEN c < 3 THEN '2_to_3ah' WHEN c IS NOT NULL THEN '3ah_plus' END AS nominal_capacity_bucket,
  printf('%.1f_%.1fV', low, high) AS voltage_window_bucket
FROM (SELECT cell_uid, quantile_cont(temp_mean, 0.5) AS t, any_value(nominal) AS c, min(voltage_min) AS low, max(voltage_max) AS high FROM s GROUP BY cell_uid)""")
def buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.cell_buckets(soh(spark, sf_dir))


@query(SOH_SQL + """ SELECT cell_uid, cycle_idx, array_to_string(list_sort(list_filter([
  CASE WHEN capacity IS NULL THEN 'capacity' END, CASE WHEN soh IS NULL THEN 'soh' END, CASE WHEN charge_throughput IS NULL THEN 'charge_throughput' END,
  CASE WHEN energy_charge IS NULL THEN 'energy_charge' END, CASE WHEN voltage_mean IS NULL THEN 'voltage_mean' END], lambda x: x IS NOT NULL)), ',') AS missing FROM s""")
def missing_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = soh(spark, sf_dir)
    columns = ["capacity", "soh", "charge_throughput", "energy_charge", "voltage_mean"]
    return df.select(*KEYS, F.array_join(op.missing_mask(columns, dict(df.dtypes)), ",").alias("missing"))


@query("""WITH t AS (SELECT c_custkey,
  printf('%d.%dC(%d%%)-%d.5C', c_custkey % 6 + 1, c_custkey % 10, c_custkey % 80, c_custkey % 9) AS fast,
  printf('CY%d-%s_%s-#%d', ([25, 35, 45])[c_custkey % 3 + 1], (['05', '025', '1', '0.5'])[c_custkey % 4 + 1], (['05', '1'])[c_custkey % 2 + 1], c_custkey % 40) AS test,
  (['2C', 'R2.5', 'R3', 'RW', 'Sim_satellite'])[c_custkey % 5 + 1] AS condition FROM customer)
SELECT c_custkey, round(greatest((c_custkey % 6 + 1) + c_custkey % 10 / 10, c_custkey % 9 + 0.5), 6)::DOUBLE AS fast_rate,
  ([25, 35, 45])[c_custkey % 3 + 1]::DOUBLE AS temperature, ([0.5, 0.25, 1, 0.5])[c_custkey % 4 + 1]::DOUBLE AS rate, (['05', '1'])[c_custkey % 2 + 1] AS discharge_group,
  (c_custkey % 40)::INTEGER AS cell, (['regular', 'multistage', 'multistage', 'irregular', 'satellite'])[c_custkey % 5 + 1] AS policy,
  (['full', 'full', 'full', 'partial', 'partial'])[c_custkey % 5 + 1] AS completeness FROM t""")
def protocol_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    df = table(spark, sf_dir, "customer").select(
        k, F.format_string("%d.%dC(%d%%)-%d.5C", k % 6 + 1, k % 10, k % 80, k % 9).alias("fast"),
        F.format_string("CY%s-%s_%s-#%d", pick(k, ["25", "35", "45"]), pick(k, ["05", "025", "1", "0.5"]), pick(k, ["05", "1"]), k % 40).alias("test"),
        pick(k, ["2C", "R2.5", "R3", "RW", "Sim_satellite"]).alias("condition"),
    )
    p, c = op.test_protocol(F.col("test")), op.condition_policy(F.col("condition"))
    return df.select(
        k, r6(op.fastcharge_rate(F.col("fast")), "fast_rate"), p["temperature"].alias("temperature"), p["charge_rate"].alias("rate"),
        p["discharge_group"].alias("discharge_group"), p["cell"].alias("cell"), c["policy"].alias("policy"), c["completeness"].alias("completeness"),
    )


@query("""SELECT n_name AS source_dataset, c_name AS raw_cell_id, 'cell_' || lpad((row_number() OVER (ORDER BY n_name, c_name))::VARCHAR, 5, '0') AS cell_uid
FROM customer JOIN nation ON c_nationkey = n_nationkey""")
def cell_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return op.assign_ids(both.select(F.col("n_name").alias("source_dataset"), F.col("c_name").alias("raw_cell_id")), ["source_dataset", "raw_cell_id"])


W = "(PARTITION BY cell_uid ORDER BY cycle_idx)"
SIGNALS = ["soh", "voltage_mean", "temp_mean", "current_mean"]
FEATURES_SQL = SOH_SQL + f""", d AS (
  SELECT *, soh * 100 AS soh_pct, soh AS capacity_ratio, voltage_max - voltage_min AS voltage_range, temp_max - temp_min AS temp_range, abs(current_mean) AS current_abs_mean,
    {", ".join(f"{c} - lag({c}) OVER {W} AS {c}_diff_1" for c in SIGNALS)},
    {", ".join(f"{c} - lag({c}) OVER {W} AS {c}_delta_1" for c in ("charge_throughput", "discharge_throughput", "energy_charge", "energy_discharge"))},
    {", ".join(f"stddev_samp({c}) OVER (PARTITION BY cell_uid ORDER BY cycle_idx ROWS 4 PRECEDING) AS {c}_std_5" for c in SIGNALS)},
    (row_number() OVER {W} - 1) / greatest(count(*) OVER (PARTITION BY cell_uid) - 1, 1) AS aging
  FROM s),
f AS (SELECT *, {", ".join(f"avg({c}_diff_1) OVER (PARTITION BY cell_uid ORDER BY cycle_idx ROWS 3 PRECEDING) AS {c}_slope_5" for c in SIGNALS)} FROM d)"""


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.with_features(soh(spark, sf_dir))


DERIVED = ["soh_pct", "capacity_ratio", "voltage_range", "temp_range", "current_abs_mean"]
DELTAS = [f"{c}_diff_1" for c in SIGNALS] + ["charge_throughput_delta_1", "discharge_throughput_delta_1", "energy_charge_delta_1", "energy_discharge_delta_1"]


@query(FEATURES_SQL + f" SELECT cell_uid, cycle_idx, {rounds(*DERIVED)} FROM f")
def derived_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(op.with_derived(soh(spark, sf_dir)), *DERIVED)


@query(FEATURES_SQL + f" SELECT cell_uid, cycle_idx, {rounds(*DELTAS)} FROM f")
def cycle_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(features(spark, sf_dir), *DELTAS)


@query(FEATURES_SQL + f" SELECT cell_uid, cycle_idx, {rounds(*(f'{c}_slope_5' for c in SIGNALS))} FROM f")
def rolling_slope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(features(spark, sf_dir), *(f"{c}_slope_5" for c in SIGNALS))


@query(FEATURES_SQL + f" SELECT cell_uid, cycle_idx, {rounds(*(f'{c}_std_5' for c in SIGNALS))} FROM f")
def rolling_std(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(features(spark, sf_dir), *(f"{c}_std_5" for c in SIGNALS))


@query(FEATURES_SQL + """, q AS (
  SELECT cell_uid, quantile_cont(temp_mean, 0.5) AS m, quantile_cont(abs(temp_mean), 0.95) AS tq, quantile_cont(abs(energy_discharge), 0.95) AS eq,
         max(abs(energy_discharge)) AS et, arg_min(capacity, cycle_idx) FILTER (capacity IS NOT NULL) AS c1 FROM f GROUP BY cell_uid),
mad AS (SELECT cell_uid, quantile_cont(abs(temp_mean - m), 0.5) AS mad FROM f JOIN q USING (cell_uid) GROUP BY cell_uid)
SELECT cell_uid, cycle_idx, round(coalesce(soh, 0), 6) AS soh_norm, round(coalesce(soh_pct / 100, 0), 6) AS soh_pct_norm,
  round(coalesce(capacity / CASE WHEN abs(c1) > 1e-8 THEN c1 ELSE 1 END, 0), 6) AS capacity_norm,
  round(coalesce((temp_mean - m) / CASE WHEN mad > 1e-8 THEN 1.4826 * mad WHEN tq >= 1e-8 THEN tq ELSE 1 END, 0), 6) AS temp_mean_norm,
  round(coalesce(energy_discharge / CASE WHEN eq >= 1e-8 THEN eq WHEN et >= 1e-8 THEN et ELSE 1 END, 0), 6) AS energy_discharge_norm
FROM f JOIN q USING (cell_uid) JOIN mad USING (cell_uid)""")
def robust_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = {"soh": "identity", "soh_pct": "percent", "capacity": "first", "temp_mean": "robust", "energy_discharge": "scale"}
    return rounded(op.normalized(features(spark, sf_dir), rules), *(f"{c}_norm" for c in rules))


def unnested(df: DataFrame, column: str, keys: list[str] = KEYS, name: str = "value") -> DataFrame:
    return df.select(*keys, F.posexplode(column).alias("i", name)).withColumn(name, r6(name))


def unnest_sql(items: str, source: str, keys: str = "cell_uid, cycle_idx") -> str:
    return f"SELECT {keys}, (i - 1)::INTEGER AS i, round(a[i], 6) AS value FROM (SELECT *, {items} AS a FROM {source}), unnest(range(1, len(a) + 1)) AS u(i)"


ENERGY = "coalesce(abs(energy_charge_delta_1), 0) + coalesce(abs(energy_discharge_delta_1), 0)"
OPERATION_SQL = "[abs(current_mean), coalesce(current_mean_std_5, 0), greatest(abs(current_max), abs(current_min)), temp_mean, coalesce(temp_mean_std_5, 0), temp_max, coalesce(energy_charge_delta_1, 0), coalesce(energy_discharge_delta_1, 0)]"
EXPERT_SQL = f"[coalesce(soh, 0), 0, 0, 0, 0, temp_mean, coalesce(temp_mean_std_5, 0), temp_max, current_abs_mean, coalesce(current_mean_std_5, 0), greatest(abs(current_max), abs(current_min)), {ENERGY}, aging, greatest(0, 0.9 - coalesce(soh, 0))]"
STRESS_SQL = f"[0, 0, 0, 0, temp_mean, coalesce(temp_mean_std_5, 0), temp_max, current_abs_mean, coalesce(current_mean_std_5, 0), greatest(abs(current_max), abs(current_min)), {ENERGY}, aging]"


@query(FEATURES_SQL + " " + unnest_sql(OPERATION_SQL, "f"))
def operation_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unnested(features(spark, sf_dir).withColumn("a", op.operation_vector()), "a")


@query(FEATURES_SQL + " " + unnest_sql(EXPERT_SQL, "f"))
def expert_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = features(spark, sf_dir)
    return unnested(df.withColumn("a", op.expert_vector(df)), "a")


@query(FEATURES_SQL + " " + unnest_sql(STRESS_SQL, "f"))
def stress_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = features(spark, sf_dir)
    return unnested(df.withColumn("a", op.stress_vector(df)[0]), "a")
