"""Catalogs, labels and splits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voltrail.functions.columns import r6
from voltrail.operators import catalogs as op
from voltrail.plans.registry import query
from voltrail.sources.roles import CYCLES_SQL, cell_uid, cell_uid_sql, cycles, pick, table

META = ["source_dataset", "chemistry_family"]


@query(CYCLES_SQL + " SELECT cell_uid, arg_min(source_dataset, cycle_idx) AS source_dataset, arg_min(chemistry_family, cycle_idx) AS chemistry_family, count(*) AS n_cycles FROM cycles GROUP BY cell_uid")
def cell_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.cell_catalog(cycles(spark, sf_dir), META)


#: Customers as cells: the nation is the dataset, the market segment the condition.
CELLS_SQL = f"""WITH cells AS (
  SELECT {cell_uid_sql("c_custkey")} AS cell_uid, c_custkey, (['tju', 'xjtu', 'hust', 'mit', 'other'])[c_nationkey % 5 + 1] AS source_dataset,
    (['LFP', 'NCM', '', 'NCA'])[c_custkey % 4 + 1] AS chemistry_family, (['fastcharge', 'multistage', 'random_walk', 'regular', ''])[c_custkey % 5 + 1] AS discharge_policy_family,
    (['full', 'partial', ' '])[c_custkey % 3 + 1] AS full_or_partial, n_name AS folder, r_name AS region,
    CASE c_nationkey % 5 WHEN 0 THEN n_name || '/' || c_mktsegment || '-#' || c_custkey WHEN 1 THEN c_mktsegment || '_battery-' || c_custkey ELSE (c_custkey % 9) || '-' || c_custkey END AS raw_cell_id,
    n_name || '/' || c_name || '.csv' AS file_path, (['cold', 'room', NULL])[c_custkey % 3 + 1] AS temperature_bucket, (['low', NULL])[c_custkey % 2 + 1] AS charge_rate_bucket
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, n, r = (table(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    k, key = F.col("c_custkey"), F.col("c_custkey").cast("string")
    both = c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    raw = F.when(F.col("c_nationkey") % 5 == 0, F.concat("n_name", F.lit("/"), "c_mktsegment", F.lit("-#"), key))
    raw = raw.when(F.col("c_nationkey") % 5 == 1, F.concat("c_mktsegment", F.lit("_battery-"), key)).otherwise(F.concat((k % 9).cast("string"), F.lit("-"), key))
    return both.select(
        cell_uid("c_custkey").alias("cell_uid"), k, pick(F.col("c_nationkey"), ["tju", "xjtu", "hust", "mit", "other"]).alias("source_dataset"),
        pick(k, ["LFP", "NCM", "", "NCA"]).alias("chemistry_family"), pick(k, ["fastcharge", "multistage", "random_walk", "regular", ""]).alias("discharge_policy_family"),
        pick(k, ["full", "partial", " "]).alias("full_or_partial"), F.col("n_name").alias("folder"), F.col("r_name").alias("region"), raw.alias("raw_cell_id"),
        F.concat("n_name", F.lit("/"), "c_name", F.lit(".csv")).alias("file_path"), pick(k, ["cold", "room", None]).alias("temperature_bucket"), pick(k, ["low", None]).alias("charge_rate_bucket"),
    )


STRATA_SQL = CELLS_SQL + """, labelled AS (SELECT *, source_dataset || '|' || chemistry_family || '|' || condition_label AS split_stratum FROM (
  SELECT *, CASE source_dataset WHEN 'tju' THEN folder || ':' || split_part(split_part(raw_cell_id, '/', 2), '-#', 1) WHEN 'xjtu' THEN folder || ':' || split_part(raw_cell_id, '_battery-', 1)
    WHEN 'hust' THEN 'hust_group_' || split_part(raw_cell_id, '-', 1) WHEN 'mit' THEN 'mit_fastcharge:' || coalesce(temperature_bucket, 'unknown_temp') || ':' || coalesce(charge_rate_bucket, 'unknown_rate')
    ELSE coalesce(nullif(discharge_policy_family, ''), 'unknown_policy') || ':' || coalesce(temperature_bucket, 'unknown_temp') || ':' || coalesce(charge_rate_bucket, 'unknown_rate') END AS condition_label FROM cells))"""


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cells(spark, sf_dir).withColumn("condition_label", op.condition_label()).withColumn("split_stratum", op.stratum())


@query(STRATA_SQL + " SELECT cell_uid, condition_label, split_stratum FROM labelled")
def condition_strata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labelled(spark, sf_dir).select("cell_uid", "condition_label", "split_stratum")


@query(CELLS_SQL + """ SELECT cell_uid, ch AS chemistry_only, ch || '_' || po AS chemistry_policy,
  ch || '_' || CASE WHEN po = 'fastcharge' THEN 'fastcharge' WHEN po = 'multistage' THEN 'multistage' WHEN po = 'random_walk' THEN 'irregular_' || fu WHEN fu = 'full' THEN 'regular' ELSE 'regular_' || fu END AS protocol_aware
FROM (SELECT cell_uid, coalesce(nullif(trim(chemistry_family), ''), 'Unknown') AS ch, coalesce(nullif(trim(discharge_policy_family), ''), 'regular') AS po, coalesce(nullif(trim(full_or_partial), ''), 'full') AS fu FROM cells)""")
def domain_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cells(spark, sf_dir).select("cell_uid", *(op.domain_label(op.DomainRules(mode=m)).alias(m) for m in ("chemistry_only", "chemistry_policy", "protocol_aware")))


@query(CELLS_SQL + " SELECT cell_uid, raw_cell_id FROM cells WHERE NOT (chemistry_family IN ('NCA') OR contains(file_path, 'CHINA') OR starts_with(raw_cell_id, '3-') OR raw_cell_id LIKE '%5-%1')")
def split_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.exclude(cells(spark, sf_dir), ["NCA"], ["CHINA"], ["3-"], ["*5-*1"], require=False).select("cell_uid", "raw_cell_id")


@query(CELLS_SQL + " SELECT cell_uid, source_dataset FROM (SELECT *, row_number() OVER (PARTITION BY source_dataset ORDER BY raw_cell_id COLLATE C) AS k FROM cells) WHERE k <= 7".replace(" COLLATE C", ""))
def input_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.first_cells(cells(spark, sf_dir), 7).select("cell_uid", "source_dataset")


def split_sql(source: str, target: str, frac: float, few: int, seed: int) -> str:
    return CELLS_SQL + f""", sides AS (SELECT *, CASE WHEN {source} THEN 'source' WHEN {target} THEN 'target' ELSE 'unassigned' END AS side, md5(cell_uid || '|{seed}') AS h FROM cells),
ranks AS (SELECT *, row_number() OVER (PARTITION BY side, source_dataset ORDER BY h, cell_uid) AS r, count(*) OVER (PARTITION BY side, source_dataset) AS n, row_number() OVER (PARTITION BY side ORDER BY h, cell_uid) AS a FROM sides)
SELECT cell_uid, source_dataset, CASE side WHEN 'source' THEN CASE WHEN n > 1 AND r <= greatest(1, least(n - 1, round_even(n * {frac}, 0))) THEN 'source_val' ELSE 'source_train' END
  WHEN 'target' THEN CASE WHEN a <= {few} THEN 'target_support' ELSE 'target_query' END ELSE 'unassigned' END AS split FROM ranks"""


@query(split_sql("source_dataset IN ('tju', 'xjtu')", "source_dataset IN ('mit')", 0.2, 3, 7))
def split_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("source_dataset")
    return op.split_by_predicate(cells(spark, sf_dir), d.isin("tju", "xjtu"), d.isin("mit"), 0.2, 3, 7).select("cell_uid", "source_dataset", "split")


@query(split_sql("source_dataset != 'hust'", "source_dataset = 'hust'", 0.25, 0, 3))
def split_holdout(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("source_dataset")
    return op.split_by_predicate(cells(spark, sf_dir), d != "hust", d == "hust", 0.25, 0, 3).select("cell_uid", "source_dataset", "split")


@query(split_sql("region != 'ASIA'", "region = 'ASIA'", 0.1, 5, 1))
def split_domain_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("region")
    return op.split_by_predicate(cells(spark, sf_dir), d != "ASIA", d == "ASIA", 0.1, 5, 1).select("cell_uid", "source_dataset", "split")


STRATIFIED_SQL = STRATA_SQL + """, ranked AS (SELECT *, row_number() OVER (PARTITION BY split_stratum ORDER BY md5(cell_uid || '|11'), cell_uid) AS r, count(*) OVER (PARTITION BY split_stratum) AS n FROM labelled),
t1 AS (SELECT *, least(CASE WHEN n >= 20 THEN 4 WHEN n >= 8 THEN 2 WHEN n >= 2 THEN 1 ELSE 0 END, n - 1) AS t FROM ranked),
t2 AS (SELECT *, least(CASE WHEN n >= 20 THEN 2 WHEN n >= 4 THEN 1 ELSE 0 END, n - 1 - t) AS v FROM t1),
t3 AS (SELECT *, least(CASE WHEN n >= 20 THEN 2 WHEN n >= 3 THEN 1 ELSE 0 END, n - 1 - t - v) AS s FROM t2),
manifest AS (SELECT *, CASE WHEN r <= t THEN 'source_train' WHEN r <= t + v THEN 'source_val' WHEN r <= t + v + s THEN 'target_support' ELSE 'target_query' END AS split FROM t3)"""


def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.split_stratified(labelled(spark, sf_dir), seed=11)


@query(STRATIFIED_SQL + " SELECT cell_uid, split_stratum, split FROM manifest")
def split_stratified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest(spark, sf_dir).select("cell_uid", "split_stratum", "split")


@query(STRATIFIED_SQL + """ SELECT cell_uid, count(DISTINCT split) AS splits FROM (SELECT cell_uid, split FROM manifest UNION ALL SELECT cell_uid, 'target_query' FROM manifest WHERE c_custkey % 10 = 0) GROUP BY cell_uid HAVING count(DISTINCT split) > 1""")
def split_leakage(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = manifest(spark, sf_dir)
    return op.leaks(m.select("cell_uid", "split").unionAll(m.where("c_custkey % 10 = 0").select("cell_uid", F.lit("target_query"))))


@query(CYCLES_SQL + " " + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", round(avg(({c} IS NULL)::INTEGER), 6) AS missing_ratio FROM cycles" for c in ("capacity", "charge_throughput", "energy_charge", "voltage_mean")))
def dataset_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = op.missing_ratios(cycles(spark, sf_dir), ["capacity", "charge_throughput", "energy_charge", "voltage_mean"])
    return out.select("column", r6("missing_ratio", "missing_ratio"))


@query(STRATIFIED_SQL + " SELECT source_dataset, chemistry_family, split, count(*) AS cells FROM manifest GROUP BY GROUPING SETS ((source_dataset, split), (chemistry_family, split), (split))")
def split_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    sets = [[F.col("source_dataset"), F.col("split")], [F.col("chemistry_family"), F.col("split")], [F.col("split")]]
    return manifest(spark, sf_dir).groupingSets(sets, "source_dataset", "chemistry_family", "split").agg(F.count("*").alias("cells"))


@query(CELLS_SQL + " SELECT cell_uid, source_dataset FROM (SELECT *, row_number() OVER (PARTITION BY source_dataset ORDER BY md5(cell_uid || '|5'), cell_uid) AS k FROM cells) WHERE k <= 9")
def cell_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.sample_cells(cells(spark, sf_dir), 9, seed=5).select("cell_uid", "source_dataset")


@query(CYCLES_SQL + """, m AS (SELECT *, CASE WHEN user_id % 10 = 0 THEN 'target_query' WHEN user_id % 10 < 3 THEN 'source_val' ELSE 'source_train' END AS split FROM cycles)
SELECT cell_uid, cycle_idx, split, 'train' AS bank, row_number() OVER (PARTITION BY cell_uid ORDER BY cycle_idx) - 1 AS bank_row FROM m WHERE split = 'source_train'
UNION ALL SELECT cell_uid, cycle_idx, split, 'all', row_number() OVER (PARTITION BY cell_uid ORDER BY cycle_idx) - 1 FROM m WHERE split IN ('source_train', 'source_val')""")
def bank_by_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("user_id") % 10
    rows = cycles(spark, sf_dir).withColumn("split", F.when(u == 0, "target_query").when(u < 3, "source_val").otherwise("source_train")).select("cell_uid", "cycle_idx", "split")
    return op.bank(rows, "train", ["source_train"], ["cycle_idx"]).unionByName(op.bank(rows, "all", ["source_train", "source_val"], ["cycle_idx"]))
