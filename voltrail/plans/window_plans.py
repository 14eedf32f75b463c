"""Windows and the case bank."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voltrail.functions.columns import array_mean, r6
from voltrail.operators import windows as op
from voltrail.plans.cycle_plans import ENERGY, FEATURES_SQL, features, rounds
from voltrail.plans.registry import query
from voltrail.operators.cycles import aging_index, power_proxy

L, H, STRIDE = 16, 4, 4
KEYS = ["cell_uid", "window_start"]
SERIES = ["soh", "temp_mean", "current_mean", "voltage_mean", "temp_max", "current_max", "power", "capacity"]
CARRY = ["user_id", "source_dataset", "chemistry_family", "aging", "event_type", "cycle_idx"]


def base(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = features(spark, sf_dir)
    return df.withColumn("power", power_proxy(df)).withColumn("aging", aging_index())


def split_of(user):
    return F.when(user % 10 == 0, "target_query").when(user % 10 < 3, "source_val").otherwise("source_train")


def windows_of(spark: SparkSession, sf_dir: str, series: list[str] = SERIES, carry: list[str] = CARRY) -> DataFrame:
    return op.sliding(base(spark, sf_dir), series, L, H, STRIDE, carry)


def cases_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Usable cases with id, split, anchor, deltas and state."""
    df = op.usable(windows_of(spark, sf_dir))
    return df.withColumns({
        "case_id": F.col("user_id") * 1_000_000 + F.col("window_start"), "split": split_of(F.col("user_id")), "anchor_soh": F.element_at("soh_seq", -1),
        "delta": op.deltas(), "slope": op.recent_slope("soh_seq"), "curvature": op.curvature("soh_seq"),
    }).withColumns({
        "stage": op.degradation_stage(F.col("anchor_soh")), "thermal": F.array_max("temp_max_seq"), "current": F.array_max(F.transform("current_max_seq", F.abs)), "power": array_mean(F.col("power_seq")),
    })


def cut(c: str, a: str, b: str) -> str:
    return f"{c}[{a}:{b}]"


CASES_SQL = FEATURES_SQL + f""", g AS (SELECT *, {ENERGY} AS power FROM f),
cells AS (SELECT cell_uid, any_value(user_id) AS user_id, any_value(source_dataset) AS source_dataset, any_value(chemistry_family) AS chemistry_family, count(*) AS n_cycles,
  {", ".join(f"list({c} ORDER BY cycle_idx) AS {c}" for c in [*SERIES, "aging", "event_type"])} FROM g GROUP BY cell_uid),
windows AS (SELECT cell_uid, user_id, source_dataset, chemistry_family, n_cycles, w AS window_start, w + {L} AS window_end, w + {L + H} AS target_end, aging[w + {L}] AS aging, event_type[w + {L}] AS event_type, w + {L} AS cycle_idx,
  {", ".join(f"{c}[w + 1:w + {L}] AS {c}_seq, {c}[w + {L + 1}:w + {L + H}] AS {c}_future" for c in SERIES)}
  FROM cells, unnest(range(0, n_cycles - {L + H - 1}, {STRIDE})) AS u(w)),
c0 AS (SELECT *, user_id * 1000000 + window_start AS case_id, CASE WHEN user_id % 10 = 0 THEN 'target_query' WHEN user_id % 10 < 3 THEN 'source_val' ELSE 'source_train' END AS split, soh_seq[{L}] AS anchor_soh
  FROM windows WHERE soh_seq[{L}] IS NOT NULL AND len(list_filter(soh_future, lambda x: x IS NULL)) = 0),
cases AS (SELECT *, list_transform(soh_future, lambda x: x - anchor_soh) AS delta,
  CASE WHEN len(list_filter(soh_seq[{L - 5}:{L}], lambda x: x IS NULL)) = 0 THEN (soh_seq[{L}] - soh_seq[{L - 5}]) / 5 END AS slope,
  CASE WHEN len(list_filter(soh_seq, lambda x: x IS NULL)) = 0 THEN ((soh_seq[{L}] - soh_seq[{L - 1}]) - (soh_seq[2] - soh_seq[1])) / {L - 2} END AS curvature,
  CASE WHEN anchor_soh >= 0.95 THEN 'fresh' WHEN anchor_soh >= 0.9 THEN 'early' WHEN anchor_soh >= 0.8 THEN 'mid' WHEN anchor_soh >= 0.7 THEN 'late' ELSE 'end' END AS stage,
  list_max(temp_max_seq) AS thermal, list_max(list_transform(current_max_seq, lambda x: abs(x))) AS "current", list_avg(power_seq) AS power FROM c0)"""


def long(df: DataFrame, column: str, keys: list[str] = KEYS, name: str = "value") -> DataFrame:
    return df.select(*keys, F.posexplode(column).alias("i", name)).withColumn(name, r6(name))


def long_sql(column: str, source: str = "cases", keys: str = "cell_uid, window_start", name: str = "value") -> str:
    return f" SELECT {keys}, (i - 1)::INTEGER AS i, round(({column})[i], 6) AS {name} FROM {source}, unnest(range(1, len({column}) + 1)) AS u(i)"


@query(CASES_SQL + long_sql("list_concat(soh_seq, soh_future)", "windows"))
def windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return long(windows_of(spark, sf_dir).withColumn("a", F.concat("soh_seq", "soh_future")), "a")


@query(CASES_SQL + " SELECT cell_uid, window_start, window_end, target_end, case_id, split FROM cases")
def windows_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cases_of(spark, sf_dir).select(*KEYS, "window_end", "target_end", "case_id", "split")


@query(CASES_SQL + long_sql("delta"))
def window_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return long(cases_of(spark, sf_dir), "delta")


@query(CASES_SQL + f" SELECT cell_uid, window_start, {rounds('anchor_soh', 'slope', 'curvature')}, round(list_sum(capacity_seq[{L - 4}:{L}]), 6) AS throughput_recent FROM cases")
def recent_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    recent = F.aggregate(F.slice("capacity_seq", -5, 5), F.lit(0.0), lambda a, x: a + F.coalesce(x, F.lit(0.0)))
    return cases_of(spark, sf_dir).select(*KEYS, *(r6(c, c) for c in ("anchor_soh", "slope", "curvature")), r6(recent, "throughput_recent"))


@query(CASES_SQL + " SELECT stage, split, count(*) AS cases FROM cases GROUP BY stage, split")
def degradation_stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cases_of(spark, sf_dir).groupBy("stage", "split").agg(F.count("*").alias("cases"))


@query(CASES_SQL + " SELECT cell_uid, window_start, m AS mode, i::INTEGER AS i, round(CASE m WHEN 'known' THEN current_mean_future[i + 1] WHEN 'repeat_last' THEN current_mean_seq[16] ELSE 0 END, 6) AS value, (m != 'none')::INTEGER AS mask FROM cases, unnest(['known', 'repeat_last', 'none']) AS t(m), range(4) AS u(i)")
def future_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The windows are made once, of what is needed alone; each gives the rows of all modes."""
    df = op.usable(windows_of(spark, sf_dir, ["soh", "current_mean"], []))
    made = {m: op.future_operation("current_mean", m, H) for m in ("known", "repeat_last", "none")}
    each = F.array(*(F.struct(F.lit(m).alias("mode"), F.arrays_zip(v.alias("v"), mask.alias("m")).alias("steps")) for m, (v, mask) in made.items()))
    long = df.select(*KEYS, F.explode(each).alias("o")).select(*KEYS, "o.mode", F.posexplode("o.steps").alias("i", "x"))
    return long.select(*KEYS, "mode", "i", r6("x.v", "value"), F.col("x.m").alias("mask"))


@query(CASES_SQL + " SELECT cell_uid, window_start, window_start + 1 AS cycle_idx_start, cycle_idx AS cycle_idx_end, chemistry_family, event_type, source_dataset FROM cases")
def case_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cases_of(spark, sf_dir).select(*KEYS, (F.col("window_start") + 1).alias("cycle_idx_start"), F.col("cycle_idx").alias("cycle_idx_end"), "chemistry_family", "event_type", "source_dataset")


@query(CASES_SQL + f" SELECT cell_uid, window_start, round(list_count(soh_seq) / {L}, 6) AS soh, round(list_count(power_seq) / {L}, 6) AS power FROM cases")
def case_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cases_of(spark, sf_dir).select(*KEYS, r6(op.availability("soh_seq"), "soh"), r6(op.availability("power_seq"), "power"))


def z_sql(c: str) -> str:
    return f"coalesce(({c} - (SELECT quantile_cont({c}, 0.5) FROM cases)) / (SELECT CASE WHEN i >= 1e-6 THEN i WHEN s > 1e-6 THEN s ELSE 1 END FROM (SELECT quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25) AS i, stddev_pop({c}) AS s FROM cases)), 0)"


LABELS_SQL = CASES_SQL.replace("\ncases AS (SELECT *,", "\ncases AS (SELECT *, greatest(0, 0.9 - anchor_soh) AS below,") + f""", z AS (SELECT *, {z_sql('thermal')} AS zt, {z_sql('"current"')} AS zc, {z_sql('power')} AS zp, {z_sql('aging')} AS za, {z_sql('below')} AS zb FROM cases),
sc AS (SELECT *, 1 / (1 + exp(-greatest(-20, least(20, zt)))) AS thermal_score, 1 / (1 + exp(-greatest(-20, least(20, zc)))) AS current_score, 1 / (1 + exp(-greatest(-20, least(20, zp)))) AS power_score,
  1 / (1 + exp(-greatest(-20, least(20, 0.7 * za + 0.8 * zb)))) AS cycle_score FROM z)"""
SCORES = ["thermal_score", "current_score", "power_score", "cycle_score"]


@query(LABELS_SQL + f""" SELECT cell_uid, window_start, {rounds(*SCORES)},
  CASE greatest(thermal_score, current_score, power_score, cycle_score) WHEN thermal_score THEN 'thermal' WHEN current_score THEN 'current' WHEN cycle_score THEN 'cycle' ELSE 'power' END AS semantic_label,
  array_to_string(list_filter([CASE WHEN thermal_score >= 0.55 THEN 'thermal' END, CASE WHEN current_score >= 0.55 THEN 'current' END, CASE WHEN cycle_score >= 0.55 THEN 'cycle' END, CASE WHEN power_score >= 0.55 THEN 'power' END], lambda x: x IS NOT NULL), ',') AS evidence FROM sc""")
def semantic_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.semantic_labels(cases_of(spark, sf_dir)).select(*KEYS, *(r6(c, c) for c in SCORES), "semantic_label", "evidence")


@query(CASES_SQL + " " + " UNION ALL ".join(f"""SELECT '{b}' AS block, round(avg(x), 6) AS mean, round(CASE WHEN stddev_pop(x) <= 1e-8 THEN 1 ELSE stddev_pop(x) END, 6) AS std, round(quantile_cont(x, 0.05), 6) AS q05, round(quantile_cont(x, 0.5), 6) AS q50, round(quantile_cont(x, 0.95), 6) AS q95
FROM (SELECT unnest({b}) AS x FROM cases WHERE split = 'source_train') WHERE x IS NOT NULL""" for b in ("soh_seq", "temp_mean_seq", "delta")))
def norm_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = op.normalization_stats(cases_of(spark, sf_dir), ["soh_seq", "temp_mean_seq", "delta"], F.col("split") == "source_train")
    return out.select("block", *(r6(c, c) for c in ("mean", "std", "q05", "q50", "q95")))


@query(CASES_SQL + " SELECT split, source_dataset, chemistry_family, count(*) AS cases FROM cases GROUP BY GROUPING SETS ((split), (source_dataset), (chemistry_family))")
def build_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    sets = [[F.col(c)] for c in ("split", "source_dataset", "chemistry_family")]
    return cases_of(spark, sf_dir).groupingSets(sets, "split", "source_dataset", "chemistry_family").agg(F.count("*").alias("cases"))


@query(CASES_SQL + f""" SELECT chemistry_family, round(avg(list_count(soh_seq) / {L}) FILTER (split = 'source_train'), 6) AS source_train, round(avg(list_count(soh_seq) / {L}) FILTER (split = 'source_val'), 6) AS source_val,
  round(avg(list_count(soh_seq) / {L}) FILTER (split = 'target_query'), 6) AS target_query FROM cases GROUP BY chemistry_family""")
def availability(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = cases_of(spark, sf_dir).withColumn("a", op.availability("soh_seq"))
    return df.groupBy("chemistry_family").pivot("split", ["source_train", "source_val", "target_query"]).agg(F.round(F.avg("a"), 6))


FLAT = ["anchor_soh", "thermal", "current", "power", "aging"]


@query(CASES_SQL + f""" SELECT cell_uid, window_start, {rounds('anchor_soh', 'thermal', 'power', 'aging')}, round("current", 6) AS "current", round(list_avg(temp_mean_seq), 6) AS temp_mean, round(list_stddev_pop(temp_mean_seq), 6) AS temp_std,
  round(delta[1], 6) AS y_first, round(delta[{H}], 6) AS y_last, round(list_avg(delta), 8) AS y_mean, round(delta[{H}] - delta[1], 6) AS y_change FROM cases""")
def flat_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat_of(spark, sf_dir).select(*KEYS, *(r6(c, c) for c in [*FLAT, "temp_mean", "temp_std", "y_first", "y_last", "y_change"]), F.round("y_mean", 8).alias("y_mean"))


def flat_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    from voltrail.functions.columns import array_std

    return cases_of(spark, sf_dir).withColumns({
        "temp_mean": array_mean(F.col("temp_mean_seq")), "temp_std": array_std(F.col("temp_mean_seq")), "y_first": F.element_at("delta", 1), "y_last": F.element_at("delta", -1),
        "y_mean": array_mean(F.col("delta")), "y_change": F.element_at("delta", -1) - F.element_at("delta", 1),
    })


@query(CASES_SQL + """, m AS (SELECT quantile_cont("current", 0.5) AS c5, quantile_cont("current", 0.9) AS c9, quantile_cont(power, 0.5) AS p5, quantile_cont(power, 0.9) AS p9 FROM cases WHERE split = 'source_train'),
x AS (SELECT cell_uid, window_start, greatest(0, least(1, (thermal - 30) / 15)) AS temp_score, greatest(0, least(1, ("current" - c5) / greatest(c9 - c5, 1e-6))) AS current_score, greatest(0, least(1, (power - p5) / greatest(p9 - p5, 1e-6))) AS power_score,
  greatest(0, least(1, greatest(aging, (0.9 - anchor_soh) / 0.15))) AS cycle_score FROM cases, m)
SELECT cell_uid, window_start, round(temp_score, 6) AS temp_score, round(current_score, 6) AS current_score, round(power_score, 6) AS power_score, round(cycle_score, 6) AS cycle_score, temp_score >= 0.5 AS temp_active, cycle_score >= 0.5 AS cycle_active FROM x""")
def factor_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = op.factor_scores(cases_of(spark, sf_dir), F.col("split") == "source_train")
    return out.select(*KEYS, *(r6(f"{c}_score", f"{c}_score") for c in ("temp", "current", "power", "cycle")), "temp_active", "cycle_active")


@query(CASES_SQL + " SELECT cell_uid, window_start, dense_rank() OVER (ORDER BY chemistry_family) AS chemistry_family_id, dense_rank() OVER (ORDER BY stage) AS stage_id FROM cases")
def meta_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.encode_categories(cases_of(spark, sf_dir), ["chemistry_family", "stage"]).select(*KEYS, "chemistry_family_id", "stage_id")


@query(CASES_SQL + " SELECT DISTINCT cell_uid, (dense_rank() OVER (ORDER BY cell_uid) - 1) % 5 AS fold FROM cases")
def folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.folds(cases_of(spark, sf_dir), 5).select("cell_uid", "fold").distinct()


@query(CASES_SQL + """, x AS (SELECT i, delta[i] - slope * i AS x FROM cases, unnest(range(1, 5)) AS u(i) WHERE slope IS NOT NULL)
SELECT i::INTEGER AS horizon, round(avg(x), 6) AS mean, round(greatest(stddev_pop(x), 1e-6), 6) AS std FROM x GROUP BY i""")
def residual_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = cases_of(spark, sf_dir).where("slope IS NOT NULL").withColumn("base", F.transform(F.sequence(F.lit(1), F.lit(H)), lambda i: F.col("slope") * i))
    return op.residual_stats(df, "delta", "base").select("horizon", r6("mean", "mean"), r6("std", "std"))


@query(CASES_SQL + f""", l AS (SELECT cell_uid, window_start + i - 1 AS cycle, list_concat(soh_seq, soh_future)[i] AS x FROM cases, unnest(range(1, {L + H + 1})) AS u(i)),
t AS (SELECT cell_uid, cycle, avg(x) AS x FROM l WHERE x IS NOT NULL GROUP BY cell_uid, cycle),
j AS (SELECT c.cell_uid, c.window_start, t.cycle - c.window_end AS i, t.x FROM cases c JOIN t ON t.cell_uid = c.cell_uid AND t.cycle >= c.window_end AND t.cycle < c.window_end + 8)
SELECT cell_uid, window_start, i::INTEGER AS i, round(x, 6) AS value FROM (SELECT *, count(*) OVER (PARTITION BY cell_uid, window_start) AS n FROM j) WHERE n = 8""")
def extend_horizon(spark: SparkSession, sf_dir: str) -> DataFrame:
    return long(op.extend_horizon(cases_of(spark, sf_dir), 8), "soh_future")


EMBED = ["soh", "temp_mean", "current_mean"]
SLOPE = "(list_sum(list_transform(range(1, {n} + 1), lambda i: coalesce(((i - 1) / ({n} - 1) - 0.5) * ({c}[i] - list_avg({c})), 0))) / (list_sum(list_transform(range(1, {n} + 1), lambda i: pow((i - 1) / ({n} - 1) - 0.5, 2))) + 1e-8))"
EMBED_SQL = "[" + ", ".join(f"coalesce({f}, 0)" for s in ("list_avg({c})", "list_stddev_pop({c})", "list_min({c})", "list_max({c})", "{c}[" + str(L) + "]", SLOPE) for f in [s.replace("{c}", f"{c}_seq").replace("{n}", str(L)) for c in EMBED]) + "]"


@query(CASES_SQL + f", e AS (SELECT cell_uid, window_start, {EMBED_SQL} AS v FROM cases)" + long_sql("v", "e").replace(", 6) AS value", ", 9) AS value"))
def window_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = cases_of(spark, sf_dir).select(*KEYS, F.posexplode(op.embedding(EMBED)).alias("i", "value"))
    return df.withColumn("value", F.round("value", 9))
