"""Summaries of retrieval, forecasts and features by groups, operating policies, and what a longer horizon needs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voltrail.functions.columns import array_count, array_mean, array_std, r6
from voltrail.functions.storage import shared_dir, stored
from voltrail.operators import evaluate as ev
from voltrail.operators import retrieval as rt
from voltrail.operators import windows as op
from voltrail.plans.feature_plans import FEATURES, VIEWS, _sql, feature_table
from voltrail.plans.registry import query
from voltrail.plans.retrieval_plans import AGREED_SQL, COSINE, FORECASTS_SQL, RAW_CASES_SQL, RESULTS_SQL, VECTORS_SQL, WEIGHTS, forecasts_of, raw_cases, results_of, vectors
from voltrail.plans.window_plans import CASES_SQL, H, KEYS, L, cases_of
from voltrail.sources.files import bucketed, cached_results

DISTANCES = [*WEIGHTS, "distance"]
GROUPED = ["split", "chemistry", "domain"]


def _numbers(distances: list[str]) -> list[str]:
    return [f"{d}_{s}" for d in distances for s in ("mean", "std")] + ["chemistry_match", "domain_match", "confidence"]


SUMMARY_SQL = AGREED_SQL + f""", each AS (SELECT r.query, any_value(q_chemistry) AS chemistry, any_value(q_dataset) AS domain, {", ".join(f"avg({d}) AS {d}_mean, stddev_pop({d}) AS {d}_std" for d in DISTANCES)},
  avg(same_chemistry::INTEGER) AS chemistry_match, avg(same_domain::INTEGER) AS domain_match, any_value(confidence) AS confidence FROM results r JOIN confident c ON c.query = r.query GROUP BY r.query),
told AS (SELECT each.*, cases.split FROM each JOIN cases ON case_id = query)"""


@query(SUMMARY_SQL + f""" SELECT split, chemistry, domain, count(*) AS queries, {", ".join(f"round(avg({n}), 6) AS {n}" for n in _numbers(DISTANCES))} FROM told GROUP BY GROUPING SETS ((split), (chemistry), (domain))""")
def retrieval_summary_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The summaries of the queries' references, averaged by split, by chemistry and by domain."""
    r = stored(results_of(spark, sf_dir), "results")
    return ev.summary_by_group(r, rt.confidence(r, rt.agreement(r)), DISTANCES, GROUPED).select(*GROUPED, "queries", *(r6(n, n) for n in _numbers(DISTANCES)))


@query(SUMMARY_SQL + " " + " UNION ALL ".join(f"SELECT * FROM (SELECT '{by}' AS \"by\", {by} AS value, round(avg(distance_mean), 6) AS distance, row_number() OVER (ORDER BY avg(distance_mean) DESC, {by}) AS place FROM told GROUP BY {by}) WHERE place <= 3" for by in ("chemistry", "domain")))
def weakest_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three chemistries and the three domains whose queries lie farthest from their references."""
    r = stored(results_of(spark, sf_dir), "results")
    groups = stored(ev.summary_by_group(r, rt.confidence(r, rt.agreement(r)), ["distance"], GROUPED), "groups")
    return ev.weakest(groups, ["chemistry", "domain"], "distance_mean", 3).select("by", "value", r6("distance_mean", "distance"), "place")


@query(FORECASTS_SQL + """, homes AS (SELECT case_id, source_dataset FROM cases), told AS (SELECT query, method, any_value(chemistry) AS chemistry, any_value(source_dataset) AS domain, avg(abs(p - y)) AS mae FROM forecasts JOIN homes ON case_id = query GROUP BY query, method)
SELECT method, chemistry, domain, round(avg(mae), 6) AS mae, count(*) AS queries FROM told GROUP BY GROUPING SETS ((method, chemistry), (method, domain))""")
def forecast_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean over the queries of each method's mean absolute error, by chemistry and by domain."""
    domains = cases_of(spark, sf_dir).select(F.col("case_id").alias("query"), F.col("source_dataset").alias("domain"))
    each = forecasts_of(spark, sf_dir).groupBy("query", "method").agg(F.first("chemistry").alias("chemistry"), F.avg(F.abs(F.col("p") - F.col("y"))).alias("mae")).join(domains, "query")
    sets = [[F.col("method"), F.col("chemistry")], [F.col("method"), F.col("domain")]]
    return each.groupingSets(sets, "method", "chemistry", "domain").agg(r6(F.avg("mae")).alias("mae"), F.count("*").alias("queries"))


# features


EXPLORED_SQL = RAW_CASES_SQL + f""", flat AS (SELECT split, {", ".join(_sql(c, 15) for c in [*FEATURES, *VIEWS])} FROM raw WHERE split IN ('source_train', 'source_val')),
long AS ({" UNION ALL ".join(f"SELECT '{f}' AS feature, '{t}' AS target, {f}::DOUBLE AS x, {t} AS y FROM flat" for f in FEATURES for t in VIEWS)}),
pearson AS (SELECT feature, target, CASE WHEN stddev_pop(x) < 1e-8 OR stddev_pop(y) < 1e-8 THEN 0 ELSE corr(x, y) END AS r FROM long WHERE x IS NOT NULL AND y IS NOT NULL GROUP BY feature, target)"""


def explored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.correlations(feature_table(spark, sf_dir).where("split IN ('source_train', 'source_val')"), FEATURES, VIEWS)


@query(EXPLORED_SQL + " SELECT feature, " + ", ".join(f"round(coalesce(max(r) FILTER (target = '{t}'), 0), 6) AS {t}" for t in VIEWS) + " FROM pearson GROUP BY feature")
def correlation_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All features by the four views of the target."""
    return ev.correlation_matrix(explored(spark, sf_dir), VIEWS).select("feature", *(r6(t, t) for t in VIEWS))


@query(EXPLORED_SQL + " SELECT feature, target, round(r, 6) AS pearson FROM pearson ORDER BY round(abs(r), 9) DESC, feature, target LIMIT 20")
def correlation_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty pairs of feature and target with the largest absolute correlations."""
    return ev.strongest(explored(spark, sf_dir)).select("feature", "target", r6("pearson", "pearson"))


@query(RAW_CASES_SQL + """ SELECT source_dataset, chemistry_family, round(avg(list_avg(list_transform(stress, lambda x: (x IS NOT NULL)::INTEGER))), 6) AS available FROM raw GROUP BY GROUPING SETS ((source_dataset), (chemistry_family))""")
def availability_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of known stress features, by dataset and by chemistry."""
    known = F.aggregate("stress", F.lit(0.0), lambda a, x: a + x.isNotNull().cast("double")) / F.size("stress")
    sets = [[F.col("source_dataset")], [F.col("chemistry_family")]]
    return raw_cases(spark, sf_dir).withColumn("known", known).groupingSets(sets, "source_dataset", "chemistry_family").agg(r6(F.avg("known")).alias("available"))


@query(RAW_CASES_SQL + " SELECT chemistry_family, " + ", ".join(f"round(avg((stress[{i + 1}] IS NULL)::INTEGER), 6) AS physics_{i}" for i in range(12)) + " FROM raw GROUP BY chemistry_family")
def missing_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chemistries by stress features: the share that is missing."""
    return ev.missing_matrix(raw_cases(spark, sf_dir), "chemistry_family", "stress", [f"physics_{i}" for i in range(12)])


# a longer horizon, and trends of the whole history


LONGER = 8


@query(CASES_SQL + f""", o AS (SELECT cell_uid, window_start + i - 1 AS cycle, list_concat(soh_seq, soh_future)[i] AS x, list_concat(temp_mean_seq, temp_mean_future)[i] AS t, list_concat(current_mean_seq, current_mean_future)[i] AS c FROM cases, unnest(range(1, {L + H + 1})) AS u(i)),
t AS (SELECT cell_uid, cycle, avg(x) AS x, avg(CASE WHEN t IS NOT NULL OR c IS NOT NULL THEN coalesce(t, 0) END) AS t, avg(CASE WHEN t IS NOT NULL OR c IS NOT NULL THEN coalesce(c, 0) END) AS c FROM o GROUP BY cell_uid, cycle),
w AS (SELECT cell_uid, window_start, window_end, coalesce(temp_mean_seq[{L}], 0) AS lt, coalesce(current_mean_seq[{L}], 0) AS lc, anchor_soh FROM cases),
j AS (SELECT w.*, i, x, t, c FROM w JOIN unnest(range(0, {LONGER})) AS u(i) ON true LEFT JOIN t ON t.cell_uid = w.cell_uid AND t.cycle = w.window_end + i),
k AS (SELECT *, count(x) OVER (PARTITION BY cell_uid, window_start) AS n FROM j)
SELECT cell_uid, window_start, i::INTEGER AS i, round(x, 6) AS soh, round(x - anchor_soh, 6) AS delta, round(coalesce(t, lt), 6) AS temp_mean, round(coalesce(c, lc), 6) AS current_mean, (t IS NOT NULL)::INTEGER AS mask FROM k WHERE n = {LONGER}""")
def extended_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cases with eight known cycles ahead: their truth, and operations averaged over all windows that hold the cycle; where none does, the last of
    the history, with mask 0."""
    out = op.extended(cases_of(spark, sf_dir), LONGER, "soh", ["temp_mean", "current_mean"])
    long = out.select(*KEYS, "anchor_soh", F.posexplode("future").alias("i", "f"))
    return long.select(*KEYS, "i", r6("f.soh", "soh"), r6(F.col("f.soh") - F.col("anchor_soh"), "delta"), r6("f.temp_mean", "temp_mean"), r6("f.current_mean", "current_mean"), F.col("f.mask").alias("mask"))


@query(CASES_SQL + f""", p AS (SELECT case_id, i - 1 AS t, soh_seq[i] AS x FROM cases, unnest(range(1, {L + 1})) AS u(i) WHERE soh_seq[i] IS NOT NULL)
SELECT case_id, count(*) AS points, round(CASE WHEN count(*) >= 3 THEN regr_slope(x, t) ELSE 0 END, 8) AS slope FROM p GROUP BY case_id""")
def history_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The least-squares slope over all known points of each history; 0 with fewer than three."""
    return cases_of(spark, sf_dir).select("case_id", array_count(F.col("soh_seq")).cast("long").alias("points"), F.round(rt.history_slope("soh_seq"), 8).alias("slope"))


# operating policies


def _policy_columns() -> dict[str, Column]:
    magnitude = lambda c: F.transform(f"{c}_seq", F.abs)
    return {
        "current_abs_mean": array_mean(magnitude("current_mean")), "current_abs_std": array_std(magnitude("current_mean")), "current_abs_max": array_mean(magnitude("current_max")),
        "temperature_mean": array_mean(F.col("temp_mean_seq")), "temperature_std": array_std(F.col("temp_mean_seq")), "temperature_max": array_mean(F.col("temp_max_seq")),
        "voltage_min": F.array_min("voltage_mean_seq"), "voltage_max": F.array_max("voltage_mean_seq"), "qv_ratio": array_count(F.col("dq")) / F.size("dq"),
        "qv_peak_value": F.get("curve_stats", F.lit(0)), "qv_peak_voltage": F.get("curve_stats", F.lit(1)), "qv_area": F.get("curve_stats", F.lit(2)),
    }


POLICY_SQL = {
    "current_abs_mean": "list_avg(list_transform(current_mean_seq, lambda x: abs(x)))", "current_abs_std": "list_stddev_pop(list_transform(current_mean_seq, lambda x: abs(x)))", "current_abs_max": "list_avg(list_transform(current_max_seq, lambda x: abs(x)))",
    "temperature_mean": "list_avg(temp_mean_seq)", "temperature_std": "list_stddev_pop(temp_mean_seq)", "temperature_max": "list_avg(temp_max_seq)",
    "voltage_min": "list_min(voltage_mean_seq)", "voltage_max": "list_max(voltage_mean_seq)", "qv_ratio": f"list_count(dq) / {L - 1}", "qv_peak_value": "curve_stats[1]", "qv_peak_voltage": "curve_stats[2]", "qv_area": "curve_stats[3]",
}
_text = lambda c, digits, unit: f"CASE WHEN {c} IS NULL THEN 'unknown' ELSE format('{{:.{digits}f}} {unit}', round({c}::DECIMAL(18, 9), {digits})::DOUBLE) END"


@query(RAW_CASES_SQL + f""", pol AS (SELECT case_id, list_count(capacity_seq) = {L} AS complete, {", ".join(f"{e} AS {n}" for n, e in POLICY_SQL.items())} FROM raw WHERE split = 'target_query')
SELECT case_id, {", ".join(f"round({c}, 9) AS {c}" for c in POLICY_SQL)}, round(coalesce(current_abs_max, current_abs_mean), 9) AS active_current,
  'max ' || {_text("current_abs_max", 3, "A")} || ', mean ' || {_text("current_abs_mean", 3, "A")} || ', std ' || {_text("current_abs_std", 3, "A")} AS current_text,
  'mean ' || {_text("temperature_mean", 2, "degC")} || ', max ' || {_text("temperature_max", 2, "degC")} || ', std ' || {_text("temperature_std", 2, "degC")} AS temperature_text,
  CASE WHEN voltage_min IS NULL THEN 'unknown' ELSE {_text("voltage_min", 3, "V")} || ' to ' || {_text("voltage_max", 3, "V")} END AS voltage_text,
  CASE WHEN complete THEN 'full' WHEN qv_ratio >= 0.5 THEN 'not confirmed' ELSE 'unknown' END AS full_text FROM pol""")
def policy_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How each target query's cell was run in its window: currents, temperatures, voltages and curve features in numbers and texts, and whether its
    charges are known to be full (here: all capacities are known), not confirmed (half of the curve is there) or unknown."""
    columns = _policy_columns()
    df = raw_cases(spark, sf_dir).where("split = 'target_query'").withColumns(columns)
    full = F.when(array_count(F.col("capacity_seq")) == L, "full").when(F.col("qv_ratio") >= 0.5, "not confirmed").otherwise("unknown")
    return ev.policy_texts(df, full).select("case_id", *(F.round(c, 9).alias(c) for c in [*columns, "active_current"]), "current_text", "temperature_text", "voltage_text", "full_text")


# rows for training, and results that are kept


ARRAYS = {"soh_seq": L, "delta": H}


def arrays_of(spark: SparkSession, sf_dir: str, k: int = 5) -> DataFrame:
    bank = bucketed(cases_of(spark, sf_dir).select("case_id", *ARRAYS), "cases", "case_id")
    return rt.training_arrays(results_of(spark, sf_dir, 3), bank, k, ARRAYS)


@query(RESULTS_SQL + f""", own AS (SELECT case_id, list_transform(soh_seq, lambda x: coalesce(x, 0)) AS seq, delta AS ahead FROM cases),
side AS (SELECT query, rank, ref, alpha, seq, ahead FROM results JOIN own ON case_id = ref WHERE rank <= 3), asked AS (SELECT DISTINCT query FROM side),
flat AS (SELECT a.query, j, coalesce(ref, -1) AS ref, coalesce(alpha, 0) AS alpha, (ref IS NOT NULL)::INTEGER AS mask, coalesce(s.seq, [0.0 FOR x IN range({L})]) AS seq, coalesce(s.ahead, [0.0 FOR x IN range({H})]) AS ahead, o.seq AS q_seq
  FROM asked a JOIN range(0, 5) AS u(j) ON true LEFT JOIN side s ON s.query = a.query AND s.rank = j + 1 JOIN own o ON o.case_id = a.query),
weights AS (SELECT query, sum(exp(-distance / 2)) AS total FROM results WHERE rank <= 3 GROUP BY query)
SELECT f.query, j::INTEGER AS j, f.ref, mask, round(CASE WHEN mask = 1 THEN exp(-r.distance / 2) / total ELSE 0 END, 6) AS alpha, i::INTEGER AS i, round(f.seq[i + 1], 6) AS soh, round(f.q_seq[i + 1], 6) AS own, round(CASE WHEN i < {H} THEN f.ahead[i + 1] END, 6) AS ahead
FROM flat f JOIN weights w ON w.query = f.query LEFT JOIN results r ON r.query = f.query AND r.ref = f.ref, unnest(range(0, {L})) AS v(i)""")
def training_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries with three references in rows for five, element by element: ids, masks, weights and sequences side by side."""
    each = F.posexplode(F.arrays_zip("ref_ids", "ref_mask", "ref_alpha", "ref_soh_seq", "ref_delta")).alias("j", "r")
    wide = arrays_of(spark, sf_dir).select("query", "soh_seq", each)
    long = wide.select("query", "j", F.col("r.ref_ids").alias("ref"), F.col("r.ref_mask").alias("mask"), r6("r.ref_alpha", "alpha"), "r.ref_delta", "soh_seq", F.posexplode("r.ref_soh_seq").alias("i", "x"))
    return long.select("query", "j", "ref", "mask", "alpha", "i", r6("x", "soh"), r6(F.get("soh_seq", "i"), "own"), r6(F.get("ref_delta", "i"), "ahead"))


@query(VECTORS_SQL.format(COSINE, "", "DESC") + " SELECT query, ref, rank, round(score, 6) AS score FROM k WHERE rank <= 5")
def cached_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest vectors, asked for in two calls under the same settings: the second computes what the first has not."""
    v, folder = vectors(spark, sf_dir).drop("label"), shared_dir(spark, "results-cache")
    asked = v.where("id % 10 = 0").select(F.col("id").alias("query"))
    compute = lambda missing: rt.search(v.join(missing, F.col("id") == F.col("query")).drop("query"), v, 5)
    settings = {"metric": "cosine", "k": 5}
    cached_results(asked.where("query % 20 = 0"), folder, settings, compute)
    return cached_results(asked, folder, settings, compute).withColumn("score", r6("score"))
