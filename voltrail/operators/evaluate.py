"""Forecast and retrieval quality: errors by any grouping, summaries of results, lifecycles, associations, regressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from voltrail.functions.columns import sigmoid
from voltrail.functions.ranks import ranked_within, summaries


def errors(y: str = "y", p: str = "p") -> list[Column]:
    """mae, rmse, mape (guarded) and n."""
    d = F.col(p) - F.col(y)
    return [F.avg(F.abs(d)).alias("mae"), F.sqrt(F.avg(d * d)).alias("rmse"), F.avg(F.abs(d) / F.greatest(F.abs(y), F.lit(1e-6))).alias("mape"), F.count(d).alias("n")]


def metric_library(df: DataFrame, series: str, order: str, y: str = "y", p: str = "p") -> DataFrame:
    """Per series: the metrics as first written down (suffix _ref where that is not the usual form) and usual ones."""
    w = W.partitionBy(series).orderBy(order)
    df = df.withColumn("_step", F.abs(F.col(y) - F.lag(y).over(w)))
    df = df.withColumns({"_ry": F.row_number().over(W.partitionBy(series).orderBy(y, order)), "_rp": F.row_number().over(W.partitionBy(series).orderBy(p, order))})
    d = F.abs(F.col(p) - F.col(y))
    n = F.count("*")
    gap = F.col("_ry") - F.col("_rp")
    return df.groupBy(series).agg(
        F.avg(d * d).alias("mse"), F.sqrt(F.avg(d * d)).alias("rmse"), F.avg(d).alias("mae"), (100 * F.avg(d / F.abs(y))).alias("mape"),
        (F.avg(d) / F.avg("_step")).alias("mase"), (200 * F.avg(d / (F.abs(y) + F.abs(p)))).alias("smape"), F.corr(y, p).alias("corr"),
        (1 - 6 * F.sum(gap * gap) / (n * (n * n - 1))).alias("spearman"), (F.sum(d) / F.sum(F.abs(y))).alias("nd"),
    )


def hits(results: DataFrame, k: int) -> DataFrame:
    """Shares of queries with a match first and among k, and the mean reciprocal rank. Needs query, rank, match."""
    first = results.groupBy("query").agg(F.min(F.when(F.col("match"), F.col("rank"))).alias("at"))
    share = lambda c: F.avg(F.coalesce(c, F.lit(0.0)))
    return first.agg(share((F.col("at") <= 1).cast("double")).alias("hit_1"), share((F.col("at") <= k).cast("double")).alias("hit_k"), share(1 / F.col("at")).alias("mrr"), F.count("*").alias("queries"))


def retrieval_summary(results: DataFrame, distances: Sequence[str]) -> DataFrame:
    """Per query: mean and population deviation of each distance over its references, and match rates."""
    parts = [f(c).alias(f"{c}_{n}") for c in distances for f, n in ((F.avg, "mean"), (F.stddev_pop, "std"))]
    return results.groupBy("query").agg(*parts, F.avg(F.col("same_chemistry").cast("double")).alias("chemistry_match"), F.count("*").alias("n"))


def summary_by_group(results: DataFrame, sure: DataFrame, distances: Sequence[str], groups: Sequence[str]) -> DataFrame:
    """``retrieval_summary`` with the match of domains and the confidence of each query, averaged by each of the groups (columns q_… of the results; domain
    is the dataset) in one pass of grouping sets."""
    named = {"split": "q_split", "chemistry": "q_chemistry", "domain": "q_dataset"}
    parts = [f(c).alias(f"{c}_{n}") for c in distances for f, n in ((F.avg, "mean"), (F.stddev_pop, "std"))]
    rates = [F.avg(F.col(c).cast("double")).alias(n) for c, n in (("same_chemistry", "chemistry_match"), ("same_domain", "domain_match"))]
    each = results.groupBy("query").agg(*(F.first(named[g]).alias(g) for g in groups), *parts, *rates).join(sure.select("query", "confidence"), "query")
    numbers = [c for c in each.columns if c not in ("query", *groups)]
    return each.groupingSets([[F.col(g)] for g in groups], *groups).agg(F.count("*").alias("queries"), *(F.avg(c).alias(c) for c in numbers))


def weakest(groups: DataFrame, by: Sequence[str], measure: str, n: int) -> DataFrame:
    """by, value, the measure and place: of each grouping the n values with the largest measure."""
    out = None
    for g in by:
        top = groups.where(F.col(g).isNotNull()).orderBy(F.desc(measure), g).limit(n)  # as few rows as groups
        one = top.select(F.lit(g).alias("by"), F.col(g).alias("value"), measure, F.row_number().over(W.orderBy(F.desc(measure), g)).cast("long").alias("place"))
        out = one if out is None else out.unionByName(one)
    return out


def missing_matrix(df: DataFrame, group: str, array: str, names: Sequence[str]) -> DataFrame:
    """Per group: the share of missing values of each element of the array."""
    return df.groupBy(group).agg(*(F.round(F.avg(F.get(array, F.lit(i)).isNull().cast("double")), 6).alias(n) for i, n in enumerate(names)))


def policy_texts(df: DataFrame, full: Column) -> DataFrame:
    """df (currents, temperatures and voltages of a window) with the current that was active and texts for reports. Texts round halves up;
    nine digits come first, so that the noise of a mean does not decide what is a half."""

    def text(c: str, digits: int, unit: str) -> Column:
        return F.when(F.col(c).isNull(), "unknown").otherwise(F.format_string(f"%.{digits}f {unit}", F.round(F.round(c, 9), digits)))

    both = F.concat(text("voltage_min", 3, "V"), F.lit(" to "), text("voltage_max", 3, "V"))
    return df.withColumns({
        "active_current": F.coalesce("current_abs_max", "current_abs_mean"),
        "current_text": F.concat(F.lit("max "), text("current_abs_max", 3, "A"), F.lit(", mean "), text("current_abs_mean", 3, "A"), F.lit(", std "), text("current_abs_std", 3, "A")),
        "temperature_text": F.concat(F.lit("mean "), text("temperature_mean", 2, "degC"), F.lit(", max "), text("temperature_max", 2, "degC"), F.lit(", std "), text("temperature_std", 2, "degC")),
        "voltage_text": F.when(F.col("voltage_min").isNull(), "unknown").otherwise(both), "full_text": full,
    })


def lifecycle(cases: DataFrame, predictions: DataFrame, seq: str = "soh_seq", future: str = "soh_future") -> DataFrame:
    """Per cell and cycle: the truth (mean over all windows that hold it), and mean, deviation and votes of the predictions."""
    long = cases.select("cell_uid", "window_start", F.posexplode(F.concat(seq, future)).alias("i", "x")).where(F.col("x").isNotNull())
    truth = long.groupBy("cell_uid", (F.col("window_start") + F.col("i")).alias("cycle")).agg(F.avg("x").alias("truth"))
    votes = predictions.select("cell_uid", "window_end", F.posexplode("prediction").alias("i", "p"))
    made = votes.groupBy("cell_uid", (F.col("window_end") + F.col("i")).alias("cycle")).agg(F.avg("p").alias("p_mean"), F.stddev_pop("p").alias("p_std"), F.count("*").alias("votes"))
    return truth.join(made, ["cell_uid", "cycle"], "left")


def associations(df: DataFrame, features: Sequence[str], targets: Sequence[str], bins: int = 8) -> DataFrame:
    """Per feature and target: Pearson (0 for constants), Spearman (mean ranks of ties) and mutual information of bins. Ranks come from
    ranges of the values, so no task holds a pair's rows."""
    pairs = [F.struct(F.lit(f).alias("feature"), F.lit(t).alias("target"), F.col(f).cast("double").alias("x"), F.col(t).cast("double").alias("y")) for f in features for t in targets]
    long = df.select("id", F.explode(F.array(*pairs)).alias("p")).select("id", "p.*").where("x IS NOT NULL AND y IS NOT NULL")
    key = ["feature", "target"]
    long = ranked_within(ranked_within(long, key, "x", "id", bins), key, "y", "id", bins)
    steady = (F.stddev_pop("x") < 1e-8) | (F.stddev_pop("y") < 1e-8)
    linear = long.groupBy(*key).agg(F.when(steady, 0.0).otherwise(F.corr("x", "y")).alias("pearson"), F.when(steady, 0.0).otherwise(F.corr("x_rank", "y_rank")).alias("spearman"))
    cells = long.groupBy(*key, "x_tile", "y_tile").agg(F.count("*").alias("c"))
    total = lambda *by: F.sum("c").over(W.partitionBy(*key, *by))
    cells = cells.withColumns({"n": total(), "cx": total("x_tile"), "cy": total("y_tile")})
    mi = cells.groupBy(*key).agg(F.sum(F.col("c") / F.col("n") * F.ln(F.col("c") * F.col("n") / (F.col("cx") * F.col("cy")))).alias("mutual_information"))
    return linear.join(mi, key)


def correlations(df: DataFrame, features: Sequence[str], targets: Sequence[str]) -> DataFrame:
    """Pearson's correlation per feature and target (0 for constants) of the rows that know both: one aggregation, combined before its shuffle."""
    number = lambda c: F.col(c).cast("double")
    each = lambda names, key, value: F.explode(F.array(*(F.struct(F.lit(n).alias(key), number(n).alias(value)) for n in names)))
    long = df.select(each(features, "feature", "x").alias("f"), *targets).select("f.*", each(targets, "target", "y").alias("t")).select("feature", "x", "t.*")
    steady = (F.stddev_pop("x") < 1e-8) | (F.stddev_pop("y") < 1e-8)
    return long.where("x IS NOT NULL AND y IS NOT NULL").groupBy("feature", "target").agg(F.when(steady, 0.0).otherwise(F.corr("x", "y")).alias("pearson"))


def strongest(found: DataFrame, n: int = 20) -> DataFrame:
    """The pairs of ``associations`` with the largest absolute correlations."""
    return found.orderBy(F.desc(F.round(F.abs("pearson"), 9)), "feature", "target").limit(n)


def correlation_matrix(found: DataFrame, targets: Sequence[str]) -> DataFrame:
    """A row per feature, a column of Pearson correlations per target; 0 where there is none."""
    return found.groupBy("feature").pivot("target", list(targets)).agg(F.first("pearson")).fillna(0.0)


def quality(df: DataFrame, columns: Sequence[str], accuracy: int | None = None) -> DataFrame:
    """Per column: shares that are missing, infinite, and above the 99th percentile of absolute values (exact, or with an accuracy approximate)."""
    marks = summaries(df, {c: F.abs(F.col(c).cast("double")) for c in columns}, (0.99,), accuracy)
    one = lambda c: F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("x"), F.lit(marks[c].quantiles[0] if c in marks else None).cast("double").alias("q"))
    long = df.select(F.explode(F.array(*map(one, columns))).alias("p")).select("p.*")
    share = lambda c: F.avg(F.when(c, 1.0).otherwise(0.0))
    return long.groupBy("column").agg(share(F.col("x").isNull() | F.isnan("x")).alias("missing"), share(F.abs("x") == float("inf")).alias("infinite"), share(F.abs("x") > F.col("q")).alias("beyond"))


def plausibility(seq: str, epsilon: float = 5e-4) -> list[Column]:
    """Mean rise beyond epsilon and mean second difference of a trajectory, as roughness."""
    c = F.col(seq)
    n = F.size(c)
    d = F.zip_with(F.slice(c, 2, n - 1), F.slice(c, 1, n - 1), lambda a, b: a - b)
    dd = F.zip_with(F.slice(d, 2, n - 2), F.slice(d, 1, n - 2), lambda a, b: F.abs(a - b))
    mean = lambda x: F.aggregate(x, F.lit(0.0), lambda a, v: a + v) / F.size(x)
    return [mean(F.transform(d, lambda x: F.greatest(x - epsilon, F.lit(0.0)))).alias("rise"), mean(dd).alias("roughness")]


def concept_scores() -> dict[str, Column]:
    """Scores of heat, current, aging and power by fixed thresholds, from the columns of a case."""
    return {
        "heat": sigmoid((F.col("thermal") - 35) / 5), "high_current": sigmoid((F.col("current") - 2) / 0.75),
        "aged": sigmoid((0.9 - F.col("anchor_soh")) / 0.05), "high_power": sigmoid(F.log1p(F.abs("power")) - 1),
    }


def category_summary(long: DataFrame, name: str, category: str, value: str) -> DataFrame:
    """Per name and category: rows, their share of the name's, and mean, population deviation, smallest and largest of the values."""
    out = long.groupBy(name, category).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.min(value).alias("low"), F.max(value).alias("high"))
    return out.withColumn("share", F.col("n") / F.sum("n").over(W.partitionBy(name)))
