"""The flat feature table, and regressions on it: groups of features, few-shot refits, permutations, forests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voltrail.functions.columns import array_mean, array_std, array_sum, r6
from voltrail.functions.storage import stored
from voltrail.operators import forest, regress
from voltrail.plans.registry import query
from voltrail.plans.retrieval_plans import RAW_CASES_SQL, raw_cases
from voltrail.plans.window_plans import H, KEYS, L

#: What the anchor cycle says, and the statistics of its curves among it.
CYCLE = ["voltage_mean", "temp_mean", "temp_max", "current_mean", "current_max", "power", "capacity"]
CURVE = ["cycle_vc_peak", "cycle_vc_peak_at", "cycle_vc_area", "cycle_vc_span"]
OPERATION = ["temp_mean", "current_mean", "power"]
STRESS = [f"physics_{i}" for i in range(12)]
SOH = ["anchor_soh", "recent_soh_slope"]
CYCLE_STATS = [*(f"cycle_{c}" for c in CYCLE), *CURVE]
MAP, PARTIAL = ["qv_map_mean", "qv_map_std"], ["partial_charge_mean", "partial_charge_std"]
OPERATIONS = [*(f"operation_{c}" for c in OPERATION), *(f"future_operation_{c}" for c in OPERATION)]
FEATURES = [*SOH, *CYCLE_STATS, *MAP, *PARTIAL, *STRESS, *OPERATIONS]
VIEWS = ["future_delta_h1", "future_delta_last", "future_delta_mean", "future_slope"]
DELTAS = [f"delta_{h}" for h in range(1, H + 1)]
#: The ten groups of features whose regressions are compared.
GROUPS = {
    "soh_only": SOH, "cycle_stats_only": CYCLE_STATS, "qv_curve_stats_only": CURVE, "qv_map_pooled_stats": MAP, "partial_charge_only": PARTIAL, "physics_12d_only": STRESS,
    "operation_only": OPERATIONS, "soh_plus_operation": [*SOH, *OPERATIONS], "soh_plus_qv_physics": [*SOH, *CURVE, *STRESS],
    "all_numerical_features": [*CYCLE_STATS, *MAP, *PARTIAL, *STRESS, *OPERATIONS],
}


def _mean_with_gaps(c: str) -> Column:
    """Mean over all steps; a step that is not known counts as 0."""
    return array_sum(F.col(c)) / F.size(c)


def feature_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per case: features, the single deltas, and four views of them. Of the target cells every second one serves as support."""
    df = raw_cases(spark, sf_dir)
    last = lambda c: F.element_at(f"{c}_seq", -1)
    columns = {"anchor_soh": F.col("anchor_soh"), "recent_soh_slope": F.col("slope")} | {f"cycle_{c}": last(c) for c in CYCLE}
    columns |= {n: F.get("curve_stats", F.lit(i)) for i, n in enumerate(CURVE)} | {n: F.get("stress", F.lit(i)) for i, n in enumerate(STRESS)}
    for name, curve in (("qv_map", "q_curve"), ("partial_charge", "dq")):
        columns |= {f"{name}_mean": array_mean(F.col(curve)), f"{name}_std": array_std(F.col(curve))}
    columns |= {f"operation_{c}": _mean_with_gaps(f"{c}_seq") for c in OPERATION} | {f"future_operation_{c}": _mean_with_gaps(f"{c}_future") for c in OPERATION}
    delta = lambda h: F.element_at("delta", h)
    columns |= {n: delta(h + 1) for h, n in enumerate(DELTAS)} | dict(zip(VIEWS, [delta(1), delta(H), array_mean(F.col("delta")), delta(H) - delta(1)]))
    role = F.when((F.col("split") == "target_query") & (F.floor(F.col("user_id") / 10) % 2 == 1), "target_support").otherwise(F.col("split"))
    return df.select("case_id", *KEYS, role.alias("split"), "chemistry_family", F.col("source_dataset").alias("domain_label"), *(columns[c].alias(c) for c in [*FEATURES, *DELTAS, *VIEWS]))


def _sql(c: str, digits: int = 9) -> str:
    """Means over 4 or 16 steps of numbers with up to five decimals have nine; with fewer digits, noise decides which way a half is rounded."""
    gaps = lambda seq, n: f"coalesce(list_sum({seq}), 0) / {n}"
    known = {
        "anchor_soh": "anchor_soh", "recent_soh_slope": "slope", "qv_map_mean": "list_avg(q_curve)", "qv_map_std": "list_stddev_pop(q_curve)", "partial_charge_mean": "list_avg(dq)",
        "partial_charge_std": "list_stddev_pop(dq)", "future_delta_h1": "delta[1]", "future_delta_last": f"delta[{H}]", "future_delta_mean": "list_avg(delta)", "future_slope": f"delta[{H}] - delta[1]",
    } | {f"cycle_{x}": f"{x}_seq[{L}]" for x in CYCLE} | {x: f"curve_stats[{i + 1}]" for i, x in enumerate(CURVE)} | {x: f"stress[{i + 1}]" for i, x in enumerate(STRESS)}
    known |= {f"operation_{x}": gaps(f"{x}_seq", L) for x in OPERATION} | {f"future_operation_{x}": gaps(f"{x}_future", H) for x in OPERATION}
    return f"round({known[c]}, {digits}) AS {c}"


@query(RAW_CASES_SQL + f""" SELECT cell_uid, window_start, CASE WHEN split = 'target_query' AND (user_id // 10) % 2 = 1 THEN 'target_support' ELSE split END AS split,
  {", ".join(map(_sql, [*FEATURES, *VIEWS]))} FROM raw""")
def flat_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feature_table(spark, sf_dir).select(*KEYS, "split", *(F.round(c, 9).alias(c) for c in [*FEATURES, *VIEWS]))


def _rounded(df: DataFrame, *keys: str) -> DataFrame:
    return df.select(*keys, *(r6(c, c) for c in df.columns if c not in (*keys, "n", "mape")), F.round("mape", 4).alias("mape"), "n")


def _fitted(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, dict[object, regress.Gram]]:
    table = stored(feature_table(spark, sf_dir), "features")
    return table, regress.grams(table, FEATURES, DELTAS, "split")


@query()
def ridge_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten feature groups fitted on training cases: errors on validation cases. Two scans of the table."""
    table, sums = _fitted(spark, sf_dir)
    found = regress.scored(table, regress.ablation(sums["source_train"], GROUPS, "source_val"), DELTAS, "split", labels=["feature_group"])
    return _rounded(regress.errors_of(found, "feature_group", last=H), "feature_group")


@query()
def ablation_horizons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by step, by chemistry and by domain."""
    table, sums = _fitted(spark, sf_dir)
    found = regress.scored(table, regress.ablation(sums["source_train"], GROUPS, "source_val"), DELTAS, "split", ["chemistry_family", "domain_label"], ["feature_group"])
    found, out = stored(found, "ablation"), None
    for by in ("horizon", "chemistry_family", "domain_label"):
        one = regress.errors_of(found, "feature_group", by).withColumns({"by": F.lit(by), "value": F.col(by).cast("string")}).drop(by)
        out = one if out is None else out.unionByName(one)
    return _rounded(out, "feature_group", "by", "value")


@query()
def ridge_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each group's features, the mean absolute weight; one scan."""
    _, sums = _fitted(spark, sf_dir)
    found = regress.importances(regress.ablation(sums["source_train"], GROUPS, "source_val"))
    return spark.createDataFrame(found, "feature_group string, feature string, importance double").withColumn("importance", F.round("importance", 8))


@query()
def fewshot_sanity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten feature groups, each from the source alone, shifted by the support, and refitted with the support counted several times: errors on target queries."""
    table, sums = _fitted(spark, sf_dir)
    models = regress.few_shot(sums["source_train"], sums["target_support"], GROUPS, "target_query")
    found = regress.scored(table, models, DELTAS, "split", labels=["feature_group", "adaptation"])
    return _rounded(regress.errors_of(found, "feature_group", "adaptation", last=H), "feature_group", "adaptation")


@query()
def permutation_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best group of ``ridge_ablation``, fitted with an intercept: how much each feature's permutation over all validation cases adds to the error."""
    table, sums = _fitted(spark, sf_dir)
    train = sums["source_train"]
    found = regress.errors_of(regress.scored(table, regress.ablation(train, GROUPS, "source_val"), DELTAS, "split", labels=["feature_group"]), "feature_group")
    best = found.orderBy("mae", "feature_group").first()["feature_group"]  # of ten rows
    weights = train.ridge(GROUPS[best], intercept=True)
    model = regress.Model((best,), "source_val", list(GROUPS[best]), weights[:-1], weights[-1])
    out = regress.permutation_importance(table.where("split = 'source_val'"), "case_id", model, DELTAS, [1, 2, 3, 4, 5])
    return out.select(F.lit(best).alias("feature_group"), "feature", *(F.round(c, 8).alias(c) for c in ("importance", "deviation", "mae")))


@query()
def rf_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A forest of 80 trees of depth 8 for each of the ten groups, grown together on training cases: errors on validation cases."""
    table, how = stored(feature_table(spark, sf_dir), "features"), forest.Growth()
    grown = forest.grow(table.where("split = 'source_train'"), "case_id", GROUPS, DELTAS, how)
    found = forest.scored(table.where("split = 'source_val'"), grown, DELTAS, how.depth)
    return _rounded(regress.errors_of(found, "feature_group", last=H), "feature_group")


@query()
def rf_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each group's features, their share of the gains of its forest."""
    grown = forest.grow(feature_table(spark, sf_dir).where("split = 'source_train'"), "case_id", GROUPS, DELTAS)
    return spark.createDataFrame(grown.importances(), "feature_group string, feature string, importance double").withColumn("importance", F.round("importance", 8))
