"""Choice of queries, comparison of settings and baselines, and what is read off the chosen references."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from voltrail.functions.columns import r6, sigmoid
from voltrail.functions.ranks import numbered
from voltrail.operators import retrieval as op
from voltrail.plans.registry import query
from voltrail.plans.retrieval_plans import PAIRS_SQL, RESULTS_SQL, TOLD, chosen, coarse, components_sql, found_sides, pairs_of, query_rows, results_of, with_components
from voltrail.plans.window_plans import CASES_SQL, H, L, cases_of
from voltrail.functions.storage import stored


@query(CASES_SQL + """, sel AS (SELECT cell_uid, window_start, split, chemistry_family, cycle_idx / n_cycles AS life, list_stddev_pop(soh_seq) + list_max(soh_seq) - list_min(soh_seq) + abs(soh_seq[16] - soh_seq[1]) AS score FROM cases),
q1 AS (SELECT cell_uid, window_start, 'representative' AS how FROM (SELECT *, row_number() OVER (PARTITION BY cell_uid ORDER BY score DESC NULLS LAST, window_start) AS k FROM sel) WHERE k = 1),
q2 AS (SELECT cell_uid, window_start, 'latest' AS how FROM (SELECT *, row_number() OVER (PARTITION BY cell_uid ORDER BY window_start DESC) AS k FROM sel) WHERE k = 1),
q3 AS (SELECT cell_uid, window_start, 'stratum' AS how FROM (SELECT *, row_number() OVER (PARTITION BY chemistry_family, split ORDER BY md5(cell_uid || '|' || window_start || '|3'), cell_uid, window_start) AS k FROM sel) WHERE k = 1),
q4 AS (SELECT cell_uid, window_start, 'stage' AS how FROM (SELECT *, row_number() OVER (PARTITION BY cell_uid, CASE WHEN life < 0.35 THEN 0 WHEN life < 0.65 THEN 1 ELSE 2 END ORDER BY md5(cell_uid || '|' || window_start || '|3'), window_start) AS k FROM sel WHERE life >= 0.1 AND life < 0.9) WHERE k = 1)
SELECT * FROM q1 UNION ALL SELECT * FROM q2 UNION ALL SELECT * FROM q3 UNION ALL SELECT * FROM q4""")
def query_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Most eventful window per cell, latest per cell, one drawn per stratum, one drawn per stage of life."""
    df = cases_of(spark, sf_dir)
    from voltrail.functions.columns import array_std

    score = array_std(F.col("soh_seq")) + F.array_max("soh_seq") - F.array_min("soh_seq") + F.abs(F.element_at("soh_seq", -1) - F.element_at("soh_seq", 1))
    df = df.withColumns({"score": score, "life": F.col("cycle_idx") / F.col("n_cycles"), "drawn": F.md5(F.concat_ws("|", "cell_uid", F.col("window_start").cast("string"), F.lit("3")))})
    stage = F.when(F.col("life") < 0.35, 0).when(F.col("life") < 0.65, 1).otherwise(2)

    def first(name: str, rows: DataFrame, by: list, *order) -> DataFrame:
        return rows.withColumn("_k", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where("_k = 1").select("cell_uid", "window_start", F.lit(name).alias("how"))

    parts = [
        first("representative", df, ["cell_uid"], F.desc_nulls_last("score"), "window_start"), first("latest", df, ["cell_uid"], F.desc("window_start")),
        first("stratum", df, ["chemistry_family", "split"], "drawn", "cell_uid", "window_start"), first("stage", df.where("life >= 0.1 AND life < 0.9"), ["cell_uid", stage], "drawn", "window_start"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


PRESETS = {"full": {"d_soh_state": 0.85, "d_qv_shape": 0.08, "d_physics": 0.03, "d_metadata": 0.04}, "state": {"d_soh_state": 1.0}, "curves": {"d_qv_shape": 0.7, "d_physics": 0.3}, "metadata": {"d_metadata": 1.0}}
SETTINGS_SQL = PAIRS_SQL + """, settings AS (SELECT 'full' AS setting, *, distance AS d FROM scored UNION ALL SELECT 'state', *, d_soh_state FROM scored UNION ALL SELECT 'curves', *, 0.7 * d_qv_shape + 0.3 * d_physics FROM scored
  UNION ALL SELECT 'metadata', *, d_metadata FROM scored), one AS (SELECT *, row_number() OVER (PARTITION BY setting, query, r_cell ORDER BY d, ref) AS c FROM settings),
k AS (SELECT *, row_number() OVER (PARTITION BY setting, query ORDER BY d, ref) AS rank FROM one WHERE c = 1), top3 AS (SELECT * FROM k WHERE rank <= 3)"""


def settings_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The components are computed once; each setting only weighs them anew."""
    df, found = coarse(spark, sf_dir)
    pairs = with_components(df, found).select("query", "ref", "r_cell", "d_soh_state", "d_qv_shape", "d_physics", "d_metadata")
    each = F.array(*(F.struct(F.lit(n).alias("setting"), op.composite(w).alias("d")) for n, w in PRESETS.items()))
    long = pairs.withColumn("s", F.explode(each)).select("*", "s.*").drop("s")
    long = op.foremost(long, ["setting", "query"], 3, "r_cell", 1, "d").repartition("query")  # moved once for both ranks
    order = ["d", "ref"]
    one = long.withColumn("_c", F.row_number().over(Window.partitionBy("setting", "query", "r_cell").orderBy(*order))).where("_c = 1").drop("_c")
    best = one.withColumn("rank", F.row_number().over(Window.partitionBy("setting", "query").orderBy(*order))).where("rank <= 3")
    return found_sides(df, best.drop("r_cell"), ["cell", "dataset", "chemistry", "future"])


@query(SETTINGS_SQL + " SELECT setting, query, ref, rank, round(d, 6) AS distance FROM top3")
def setting_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    return settings_of(spark, sf_dir).select("setting", "query", "ref", "rank", r6("d", "distance"))


DIAGNOSED_SQL = SETTINGS_SQL + f""", diagnosed AS (SELECT *, q_chemistry = r_chemistry AS same, sqrt(list_avg(list_transform(range(1, {H + 1}), lambda i: pow(future[i] - truth[i], 2)))) AS rmse FROM top3),
per_query AS (SELECT setting, query, any_value(q_dataset) AS dataset, arg_min(ref, rank) AS top1_ref, arg_min(rmse, rank) AS top1_rmse, min(rmse) AS best_rmse, avg(rmse) AS mean_rmse, arg_min(d, rank) AS top1_distance, avg(d) AS mean_distance, avg(same::INTEGER) AS match FROM diagnosed GROUP BY setting, query)"""
MEASURES = ["top1_rmse", "best_rmse", "mean_rmse", "top1_distance", "mean_distance", "match"]


def diagnosed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per setting and query: the first reference, and the errors of the first, of the best and on average if its future is the forecast."""
    error = F.sqrt(F.aggregate(F.zip_with("r_future", "q_future", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda a, x: a + x) / F.size("q_future"))
    pairs = settings_of(spark, sf_dir).withColumns({"rmse": error, "same": (F.col("q_chemistry") == F.col("r_chemistry")).cast("int")})
    first = lambda c: F.min_by(c, "rank")
    return pairs.groupBy("setting", "query").agg(
        F.first("q_dataset").alias("dataset"), first("ref").alias("top1_ref"), first("rmse").alias("top1_rmse"), F.min("rmse").alias("best_rmse"), F.avg("rmse").alias("mean_rmse"),
        first("d").alias("top1_distance"), F.avg("d").alias("mean_distance"), F.avg("same").alias("match"),
    )


@query(DIAGNOSED_SQL + ", ".join(["SELECT setting, query, dataset, top1_ref", *(f"round({c}, 6) AS {c}" for c in MEASURES)]).replace("SELECT", " SELECT", 1) + " FROM per_query")
def pair_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diagnosed(spark, sf_dir).select("setting", "query", "dataset", "top1_ref", *(r6(c, c) for c in MEASURES))


@query(DIAGNOSED_SQL + " SELECT setting, dataset, " + ", ".join(f"round(avg({c}) FILTER (isfinite({c})), 6) AS {c}" for c in MEASURES) + ", count(*) AS queries FROM per_query GROUP BY GROUPING SETS ((setting), (setting, dataset))")
def setting_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means by setting, and by setting and dataset, of what is known and finite."""
    d = diagnosed(spark, sf_dir)
    finite = lambda c: F.when((F.abs(c) < float("inf")) & ~F.isnan(c), F.col(c))
    sets = [[F.col("setting")], [F.col("setting"), F.col("dataset")]]
    return d.groupingSets(sets, "setting", "dataset").agg(*(r6(F.avg(finite(c))).alias(c) for c in MEASURES), F.count("*").alias("queries"))


@query(RESULTS_SQL + """, w AS (SELECT query, ref, list_transform(q_seq, lambda x: x - list_avg(q_seq)) AS a, list_transform(r.soh_seq, lambda x: x - list_avg(r.soh_seq)) AS b FROM results JOIN e r ON r.case_id = ref)
SELECT query, ref, round(list_sum(list_transform(range(1, 17), lambda i: coalesce(a[i] * b[i], 0))) / (sqrt(list_sum(list_transform(a, lambda x: coalesce(x * x, 0)))) * sqrt(list_sum(list_transform(b, lambda x: coalesce(x * x, 0))))), 6) AS similarity FROM w""")
def shape_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cosine of the centred histories of a query and its references."""
    from voltrail.functions.columns import array_mean, array_sum

    centred = lambda c: F.transform(c, lambda x: x - array_mean(F.col(c)))
    df = results_of(spark, sf_dir).select("query", "ref", centred("q_seq").alias("a"), centred("r_seq").alias("b"))
    dot = lambda x, y: array_sum(F.zip_with(x, y, lambda u, v: u * v))
    return df.select("query", "ref", r6(dot("a", "b") / (F.sqrt(dot("a", "a")) * F.sqrt(dot("b", "b"))), "similarity"))


DRAWN_SQL = RESULTS_SQL + """, shuffled AS (SELECT case_id AS ref, row_number() OVER (ORDER BY md5(case_id || '|1'), case_id) - 1 AS place, count(*) OVER () AS n FROM e WHERE split != 'target_query'),
drawn AS (SELECT query, ref FROM (SELECT DISTINCT query FROM results), unnest(range(0, 5)) AS u(j) JOIN shuffled ON place = (query * 7919 + j) % n)"""


@query(DRAWN_SQL + components_sql("drawn", "random") + f""", told AS (SELECT 'random' AS how, query, distance, 1 / 5 AS alpha, future, truth FROM random UNION ALL SELECT 'retrieved', query, distance, alpha, future, truth FROM results),
hz AS (SELECT how, query, i, sum(alpha * future[i]) / sum(alpha) AS p, any_value(truth[i]) AS y FROM told, unnest(range(1, {H + 1})) AS u(i) GROUP BY how, query, i),
mz AS (SELECT how, query, avg(abs(p - y)) AS mae FROM hz GROUP BY how, query), dz AS (SELECT how, query, avg(distance) AS distance FROM told GROUP BY how, query)
SELECT mz.how, mz.query, round(mae, 6) AS mae, round(distance, 6) AS distance FROM mz JOIN dz ON dz.how = mz.how AND dz.query = mz.query""")
def random_forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Retrieved against as many random references per query: mean distance, and error of the weighted (random: plain) mean of the futures.

    References stand in the order of their digests; a query takes those from a place of its own on, so that all can be drawn and no
    query meets them all."""
    df, found = coarse(spark, sf_dir)
    real = chosen(df, with_components(df, found)).select(F.lit("retrieved").alias("how"), "query", "distance", "alpha", "r_future", "q_future")
    digest = F.md5(F.concat(F.col("case_id").cast("string"), F.lit("|1")))
    refs = df.where("split != 'target_query'").select("case_id", digest.alias("digest"))
    refs = numbered(refs, ["digest", "case_id"]).select(F.col("case_id").alias("ref"), "place")
    n = refs.agg(F.count("*").alias("n"))  # one row
    asked = query_rows(df).select(F.col("case_id").alias("query"), F.explode(F.sequence(F.lit(0), F.lit(4))).alias("j")).crossJoin(F.broadcast(n))
    pairs = asked.withColumn("place", (F.col("query") * 7919 + F.col("j")) % F.col("n")).join(refs, "place").select("query", "ref")
    drawn = with_components(df, pairs.repartition("query"), ("r_future", "q_future")).select(F.lit("random").alias("how"), "query", "distance", F.lit(0.2).alias("alpha"), "r_future", "q_future")
    both = stored(drawn.unionByName(real), "drawn")
    long = both.select("how", "query", "alpha", F.posexplode(F.arrays_zip("r_future", "q_future")).alias("i", "z"))
    mean = long.groupBy("how", "query", "i").agg((F.sum(F.col("alpha") * F.col("z.r_future")) / F.sum("alpha")).alias("p"), F.first("z.q_future").alias("y"))
    errors = mean.groupBy("how", "query").agg(r6(F.avg(F.abs(F.col("p") - F.col("y")))).alias("mae"))
    return errors.join(both.groupBy("how", "query").agg(r6(F.avg("distance")).alias("distance")), ["how", "query"])


@query(RESULTS_SQL + """ SELECT query, string_agg(ref::VARCHAR, ',' ORDER BY rank) AS refs, count(*) AS n, round(sum(alpha), 6) AS weight FROM results GROUP BY query""")
def training_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per query with its references in order."""
    refs = F.transform(F.array_sort(F.collect_list(F.struct("rank", "ref"))), lambda x: x["ref"].cast("string"))
    return results_of(spark, sf_dir).groupBy("query").agg(F.array_join(refs, ",").alias("refs"), F.count("*").alias("n"), F.round(F.sum("alpha"), 6).alias("weight"))


@query(RESULTS_SQL + f""" SELECT query, ref, side, i::INTEGER AS i, round(value, 6) AS value FROM (
  SELECT r.query, r.ref, 'query' AS side, i, q.soh_seq[i] - q.anchor_soh AS value FROM results r JOIN e q ON q.case_id = r.query, unnest(range(1, {L + 1})) AS u(i)
  UNION ALL SELECT query, ref, 'reference', i, c.soh_seq[i] - c.anchor_soh FROM results JOIN e c ON c.case_id = ref, unnest(range(1, {L + 1})) AS u(i)
  UNION ALL SELECT query, ref, 'query', {L} + i, truth[i] FROM results, unnest(range(1, {H + 1})) AS u(i) UNION ALL SELECT query, ref, 'reference', {L} + i, future[i] FROM results, unnest(range(1, {H + 1})) AS u(i))""")
def aligned_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Histories and futures of queries and references, both from their anchors."""
    whole = lambda s: F.concat(F.transform(f"{s}_seq", lambda x: x - F.col(f"{s}_anchor")), F.col(f"{s}_future"))
    sides = F.array(F.struct(F.lit("query").alias("side"), whole("q").alias("x")), F.struct(F.lit("reference").alias("side"), whole("r").alias("x")))
    long = results_of(spark, sf_dir).select("query", "ref", F.explode(sides).alias("s")).select("query", "ref", "s.side", F.posexplode("s.x").alias("i", "value"))
    return long.select("query", "ref", "side", (F.col("i") + 1).alias("i"), r6("value", "value"))


@query(RESULTS_SQL + f""", x AS (SELECT *, sqrt(list_avg(list_transform(range(1, {H + 1}), lambda i: pow(future[i] - truth[i], 2)))) AS rmse, CASE WHEN r_stage != 'end' THEN d_qv_shape END AS d FROM results),
best AS (SELECT query, arg_min(ref, rank) AS before, first(ref ORDER BY d NULLS LAST, distance, rank) AS after, arg_min(rmse, rank) AS rmse_before, first(rmse ORDER BY d NULLS LAST, distance, rank) AS rmse_after FROM x GROUP BY query)
SELECT query, before, after, before != after AS changed, rmse_after < rmse_before AS improved, round(rmse_before, 6) AS rmse_before, round(rmse_after, 6) AS rmse_after FROM best""")
def rerank_effect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether ordering the chosen references by their curves (unknown here at the end of life, and then last) changes the first, and
    whether its future is nearer to the query's."""
    error = F.sqrt(F.aggregate(F.zip_with("r_future", "q_future", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda a, x: a + x) / F.size("q_future"))
    r = results_of(spark, sf_dir).withColumns({"rmse": error, "d": F.when(F.col("r_stage") != "end", F.col("d_qv_shape"))})
    at = lambda c, place: F.max(F.when(F.col(place) == 1, F.col(c)))
    out = op.reordered(r, "d").groupBy("query").agg(at("ref", "rank").alias("before"), at("ref", "new_rank").alias("after"), at("rmse", "rank").alias("rmse_before"), at("rmse", "new_rank").alias("rmse_after"))
    return out.select("query", "before", "after", (F.col("before") != F.col("after")).alias("changed"), (F.col("rmse_after") < F.col("rmse_before")).alias("improved"), r6("rmse_before", "rmse_before"), r6("rmse_after", "rmse_after"))


@query(PAIRS_SQL + """, blended AS (SELECT *, CASE WHEN q_dataset = 'hust' AND r_stage != 'end' THEN 0.55 * distance + 0.45 * d_qv_shape ELSE distance END AS d FROM scored),
one AS (SELECT *, row_number() OVER (PARTITION BY query, r_cell ORDER BY d, ref) AS c FROM blended), k AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY d, ref) AS rank FROM one WHERE c <= 2)
SELECT query, ref, rank, round(d, 6) AS distance, round(distance, 6) AS base_distance FROM k WHERE rank <= 5""")
def curve_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One dataset's queries order their candidates by the distance blended with that of the curves."""
    pairs = pairs_of(spark, sf_dir, ("q_dataset", "r_stage", "r_cell")).select(*TOLD, "q_dataset", "r_stage", "r_cell").withColumns({"cell": F.col("r_cell"), "d": F.when(F.col("r_stage") != "end", F.col("d_qv_shape"))})
    out = op.capped_topk(op.blended_rerank(pairs, F.col("q_dataset") == "hust", extra="d"), 5, per="cell", cap=2)
    return out.select("query", "ref", "rank", r6("distance", "distance"), r6("base_distance", "base_distance"))


@query(RESULTS_SQL + """, v AS (SELECT r.query, sum(alpha / (1 + exp(-greatest(-20, least(20, (c.thermal - 35) / 5))))) / sum(alpha) AS heat, sum(alpha / (1 + exp(-greatest(-20, least(20, (0.9 - c.anchor_soh) / 0.05))))) / sum(alpha) AS aged FROM results r JOIN e c ON c.case_id = r.ref GROUP BY r.query)
SELECT query, round(heat, 6) AS heat, round(aged, 6) AS aged FROM v""")
def neighbor_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Concept scores of the references, weighted."""
    thermal = F.col("r_thermal")
    scores = {"heat": sigmoid((thermal - 35) / 5), "aged": sigmoid((0.9 - F.col("r_anchor")) / 0.05)}
    return results_of(spark, sf_dir).groupBy("query").agg(*(r6(F.sum(F.col("alpha") * s) / F.sum("alpha")).alias(n) for n, s in scores.items()))


@query(CASES_SQL + f""", x AS (SELECT split, i, delta[i] AS y, CASE WHEN slope IS NULL THEN 0 ELSE slope * i END AS p FROM cases, unnest(range(1, {H + 1})) AS u(i))
SELECT split, round(avg(abs(y)), 6) AS persistence_mae, round(avg(abs(p - y)), 6) AS linear_mae, round(sqrt(avg(pow(p - y, 2))), 6) AS linear_rmse, count(*) AS n FROM x GROUP BY split""")
def segment_baselines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Persistence and the recent slope, scored on all cases."""
    x = cases_of(spark, sf_dir).select("split", "slope", F.posexplode("delta").alias("i", "y")).withColumn("p", F.coalesce(F.col("slope") * (F.col("i") + 1), F.lit(0.0)))
    d = F.col("p") - F.col("y")
    return x.groupBy("split").agg(r6(F.avg(F.abs("y"))).alias("persistence_mae"), r6(F.avg(F.abs(d))).alias("linear_mae"), r6(F.sqrt(F.avg(d * d))).alias("linear_rmse"), F.count("*").alias("n"))
