"""Operators on small hand-made tables: gaps, short cells, constants, ties."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from voltrail.functions import curves as fn
from voltrail.operators import catalogs, curves, cycles, evaluate, regress, retrieval, windows
from voltrail.sources import files


def series(spark, values, cell="a"):
    return spark.createDataFrame([(cell, i + 1, v) for i, v in enumerate(values)], "cell_uid string, cycle_idx long, capacity double")


def test_repair(spark):
    df = series(spark, [1.0, 1.0, 0.0, 1.2, None, 1.0, 1.0])
    got = [r["repaired"] for r in cycles.repair_capacity(df).orderBy("cycle_idx").collect()]
    assert got == pytest.approx([1.0, 1.0, 1.1, 1.2, 1.1, 1.0, 1.0])
    short = cycles.repair_capacity(series(spark, [1.0, 0.0, None])).orderBy("cycle_idx").collect()
    assert [r["repaired"] for r in short] == [1.0, 0.0, None]


def test_nominal_skips_but_leaves_one(spark):
    assert cycles.nominal_capacity(series(spark, [2.0, 3.0]), skip=5).first()["nominal"] == 3.0
    assert cycles.nominal_capacity(series(spark, [None, 4.0, 2.0, None, 6.0]), skip=0).first()["nominal"] == 4.0


@pytest.mark.parametrize("n, count", [(0, 0), (1, 0), (19, 0), (20, 1), (23, 1), (24, 2), (31, 3)])
def test_window_counts(spark, n, count):
    df = series(spark, [1.0] * n).withColumnRenamed("capacity", "soh")
    assert windows.sliding(df, ["soh"], 16, 4, 4).count() == count


def test_gaps_in_the_lookback_are_kept(spark):
    df = series(spark, [1.0, None, 3.0, 4.0, 5.0, None, 7.0]).withColumnRenamed("capacity", "soh")
    got = windows.usable(windows.sliding(df, ["soh"], 3, 1, 1)).orderBy("window_start").collect()
    assert [(r["window_start"], list(r["soh_seq"])) for r in got] == [(0, [1.0, None, 3.0]), (1, [None, 3.0, 4.0])]


def test_constant_series_normalise_to_zero(spark):
    df = series(spark, [2.0, 2.0, 2.0]).withColumnRenamed("capacity", "temp_mean")
    assert {r["temp_mean_norm"] for r in cycles.normalized(df, {"temp_mean": "robust"}).collect()} == {0.0}


def test_voltage_label_rounds_half_even(spark):
    assert spark.range(1).select(cycles.voltage_label(F.lit(2.65), F.lit(4.2))).first()[0] == "2.6_4.2V"


def test_strata(spark):
    sizes = [1, 2, 3, 4, 7, 8, 19, 20]
    df = spark.createDataFrame([(f"c{n}_{i}", f"s{n}") for n in sizes for i in range(n)], "cell_uid string, split_stratum string")
    got = {(r["split_stratum"], r["split"]): r["count"] for r in catalogs.split_stratified(df).groupBy("split_stratum", "split").count().collect()}
    want = {1: (0, 0, 0), 2: (1, 0, 0), 3: (1, 0, 1), 4: (1, 1, 1), 7: (1, 1, 1), 8: (2, 1, 1), 19: (2, 1, 1), 20: (4, 2, 2)}
    for n, counts in want.items():
        assert tuple(got.get((f"s{n}", s), 0) for s in ("source_train", "source_val", "target_support")) == counts
        assert got[f"s{n}", "target_query"] == n - sum(counts)
    catalogs.assert_no_leakage(catalogs.split_stratified(df))
    with pytest.raises(ValueError):
        catalogs.assert_no_leakage(spark.createDataFrame([("a", "source_train"), ("a", "target_query")], "cell_uid string, split string"))
    with pytest.raises(ValueError):
        catalogs.exclude(spark.createDataFrame([("LFP", "p", "r")], "chemistry_family string, file_path string, raw_cell_id string"), ["LFP"])


def test_distances_of_equals_are_zero(spark):
    seq = [1.0, None, 0.97, 0.96]
    row = [(seq, seq, [0.96, -0.01, 0.0], [0.96, -0.01, 0.0], "mid", "mid", [1.0] * 12, [1.0] * 12)]
    df = spark.createDataFrame(row, "q_seq array<double>, r_seq array<double>, q_state array<double>, r_state array<double>, q_stage string, r_stage string, q_stress array<double>, r_stress array<double>")
    got = df.select(retrieval.soh_state_distance(4).alias("a"), retrieval.physics_distance().alias("b")).first()
    assert (got["a"], got["b"]) == (0.0, 0.0)
    nothing = spark.range(1).select(retrieval.masked_l2(F.array(F.lit(None).cast("double")), F.array(F.lit(1.0)))).first()[0]
    assert nothing == 1.0


@pytest.mark.parametrize("metric", ["cosine", "l2"])
def test_search_against_brute_force(spark, metric):
    """Any grid gives the k best; ties go to the smaller ids; groups, ends and kinds are left out before the choice."""
    rng = np.random.default_rng(3)
    v = rng.integers(-2, 3, size=(80, 3)).astype(float)
    v[:, 0] += 0.5
    rows = [(i, v[i].tolist(), i % 7, i % 40, i % 2) for i in range(80)]
    df = spark.createDataFrame(rows, "id long, vector array<double>, group long, until long, kind long").repartition(5)
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    for columns in (["id", "vector"], ["id", "vector", "group", "until", "kind"]):
        want = {}
        for i in range(80):
            allowed = [j for j in range(80) if j != i and ("group" not in columns or (i % 7 != j % 7 and j % 40 <= i % 40 and i % 2 == j % 2))]
            score = {j: round(float(-(unit[i] @ unit[j]) if metric == "cosine" else ((v[i] - v[j]) ** 2).sum()), 9) for j in allowed}
            want[i] = [score[j] for j in sorted(allowed, key=lambda j: (score[j], j))[:4]]
        for cells in (1, 3, 12):
            got = retrieval.search(df.select(*columns), df.select(*columns), 4, metric, cells).orderBy("query", "rank").collect()
            made = {}
            for r in got:
                made.setdefault(r["query"], []).append(round(-r["score"] if metric == "cosine" else r["score"], 9))
            assert {i: made.get(i, []) for i in range(80)} == {i: pytest.approx(x) for i, x in want.items()}
    assert retrieval.search(df.limit(0), df, 3).count() == 0 and retrieval.search(df, df.limit(0), 3).count() == 0


def test_search_far_vectors(spark):
    """Distances of vectors far from 0 and from each other are those of their differences, and ranks follow them."""
    rng = np.random.default_rng(5)
    v = np.concatenate([rng.normal(size=(60, 3)) * 1e-3 + shift for shift in (1e6, -1e6, 0.0)])
    v[:3] = [[1e6, 1.0, 0.0], [1e6, 1.001, 0.0], [1e6, 1.003, 0.0]]
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, vector array<double>").repartition(4)
    d = ((v[:, None] - v[None]) ** 2).sum(axis=2)
    np.fill_diagonal(d, np.inf)
    for cells in (1, 6):
        got = retrieval.search(df, df, 5, "l2", cells).orderBy("query", "rank").collect()
        for i in range(len(v)):
            own = [r for r in got if r["query"] == i]
            order = sorted(range(len(v)), key=lambda j: (d[i, j], j))[:5]
            assert [r["ref"] for r in own] == order and [r["score"] for r in own] == pytest.approx([d[i, j] for j in order], rel=1e-9)


def test_search_leaves_out_what_is_no_vector(spark):
    rows = [(1, [1.0, 0.0]), (2, [0.9, 0.1]), (3, None), (4, [None, 1.0]), (5, [float("nan"), 1.0]), (6, [float("inf"), 1.0]), (None, [1.0, 0.0]), (7, [0.0, 1.0])]
    df = spark.createDataFrame(rows, "id long, vector array<double>").repartition(3)
    for metric in ("cosine", "l2"):
        got = retrieval.search(df, df, 9, metric).collect()
        assert {(r["query"], r["ref"]) for r in got} == {(a, b) for a in (1, 2, 7) for b in (1, 2, 7) if a != b}


def test_search_cells_are_bounded(spark, monkeypatch):
    """With little room for the queries of a cell the grid grows, and finds the same."""
    v = np.random.default_rng(2).normal(size=(500, 4))
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, vector array<double>")
    want = retrieval.search(df, df, 7, "l2", 1).orderBy("query", "rank").collect()
    monkeypatch.setattr(retrieval, "CELL_MB", 0.001)
    got = retrieval.search(df, df, 7, "l2", 1)
    assert got.orderBy("query", "rank").collect() == want


def test_caps_weights_and_mmr(spark):
    rows = [(1, i, float(i), "c" if i < 4 else f"d{i}", "x", [1.0, float(i)]) for i in range(7)]
    df = spark.createDataFrame(rows, "query long, ref long, distance double, cell string, domain string, vector array<double>")
    assert [r["ref"] for r in retrieval.capped_topk(df, 3, "cell", 2).orderBy("rank").collect()] == [0, 1, 4]
    weights = [r[0] for r in df.select(retrieval.alpha()).collect()]
    assert sum(weights) == pytest.approx(1)
    chosen = [r["ref"] for r in retrieval.mmr_select(df, 3, cap=2).orderBy("rank").collect()]
    assert chosen[0] == 0 and len(chosen) == 3 and sum(c < 4 for c in chosen) <= 2
    assert [r["ref"] for r in retrieval.mmr_select(df, 9, cap=1).orderBy("rank").collect()] == list(range(7))  # no more than k: no caps


def test_trend(spark):
    assert spark.range(1).select(retrieval.trend(F.array(*(F.lit(1.0 + 0.5 * i) for i in range(20))))).first()[0] == pytest.approx(0.5)


def test_spectral():
    t = np.arange(16)
    entropy, low = fn.spectral(np.stack([np.sin(2 * np.pi * t / 16), np.ones(16)]))
    assert entropy[0] == pytest.approx(0, abs=1e-6) and low[0] == pytest.approx(1) and np.isnan(entropy[1])


def test_discharge_map():
    n = 40
    v = np.linspace(4.0, 2.5, n)
    q = (4.0 - v) * 2
    hours = np.arange(n) / 60
    c, masks, stats = fn.discharge_map(hours, v, -np.ones(n), q, np.full(n, 25.0), np.ones(n, bool), 2.8, 3.6)
    named = dict(zip(fn.STATS, stats))
    assert masks.all() and c.shape == (6, 100) and c[0, 0] == pytest.approx(2.8) and c[0, -1] == pytest.approx(3.6)
    assert named["available"] == 1 and named["peak_value"] == pytest.approx(2, rel=0.05) and (named["voltage_min"], named["voltage_max"]) == (2.8, 3.6)
    few = fn.discharge_map(hours[:3], v[:3], -np.ones(3), q[:3], np.full(3, 25.0), np.ones(3, bool), 2.8, 3.6)
    assert few[2].tolist() == [0, 0, 0, 0, 2.8, 3.6, 0, 0] and not few[1].any()
    assert math.isnan(fn.life_rmse([1] * 9, [1] * 20)) and fn.life_rmse([1] * 12, [1] * 20) == 0


def test_power_proxy_takes_all_samples_in_order_of_voltage():
    """Eight voltages an hour apart, falling and one of them twice, current -2: in order of voltage time runs back, so nothing adds up; rising,
    all hours do, although two samples are of one voltage."""
    v = np.array([2.9, 3.0, 3.1, 3.1, 3.1, 3.2, 3.3, 3.4])
    n, rest = len(v), (np.arange(8) / 10, np.full(8, 25.0), np.ones(8, bool), 2.8, 3.6)
    smoothed = [np.median(v[max(0, i - 2) : i + 3]) for i in range(n)]
    assert len(set(smoothed)) < n
    up = dict(zip(fn.STATS, fn.discharge_map(np.arange(n), v, np.full(n, -2.0), *rest)[2]))
    down = dict(zip(fn.STATS, fn.discharge_map(np.arange(n)[::-1], v, np.full(n, -2.0), *rest)[2]))
    assert up["power_proxy"] == pytest.approx(2 * sum(smoothed[1:])) and down["power_proxy"] == 0 and down["available"] == 1


def test_curve_distances_are_relative_point_by_point():
    """Curves 1 and 2 everywhere: (2 - 1) / 2; curves 0 and 1e-5: relative to 1e-4."""
    v = np.linspace(3, 4, 50)
    assert fn.dqdv_distance(v, np.ones(50), v, np.full(50, 2.0)) == pytest.approx(0.5)
    assert fn.dqdv_distance(v, np.zeros(50), v, np.full(50, 1e-5)) == pytest.approx(0.1)
    mixed = np.where(v < 3.5, 1.0, 3.0)
    assert fn.dqdv_distance(v, mixed, v, mixed * 2) == pytest.approx(0.5)  # not the global maximum's share
    assert math.isnan(fn.dqdv_distance([0, 0.04], [1, 1], [0, 0.04], [1, 1])) and math.isnan(fn.dqdv_distance(v, mixed, v, mixed, 3.96))


def test_partial_charge_needs_a_span():
    t = np.arange(4.0)
    assert fn.partial_charge(t, [3.0, 3.001, 3.002, 3.004], np.ones(4), np.ones(4, bool)) is None
    got = fn.partial_charge(t * 60, [3.0, 3.1, 3.2, 3.3], np.full(4, 2.0), np.ones(4, bool), 4)
    assert got == pytest.approx([0, 2, 4, 6])


def test_charge_dqdv_of_a_line():
    """Capacity rises by 5 per volt: the derivative is 5."""
    v = np.linspace(3.0, 3.5, 400)
    grid, d = fn.charge_dqdv(v, 5 * v, np.ones(400, bool))
    assert len(grid) == 300 and d[50:250] == pytest.approx(np.full(200, 5.0), rel=2e-2)
    assert fn.charge_dqdv(v[:20], 5 * v[:20], np.ones(20, bool)) is None and fn.charge_dqdv(v, 5 * v, np.zeros(400, bool)) is None
    assert fn.above((grid, d), 3.49) is None and fn.above((grid, d), 3.2)[0][0] >= 3.2
    x, slope = fn.map_dqdv(np.linspace(3.0, 3.6, 100))
    assert x[0] >= 3.2 and slope[10:-10] == pytest.approx(np.full(len(x) - 20, 1 / 0.6), rel=1e-6)
    assert fn.rolling_mean(np.array([1.0, 2.0, 6.0]), 3) == pytest.approx([1.5, 3.0, 4.0])


def test_time_is_inferred(spark):
    """Seconds by size, minutes by name, gaps filled by position, timestamps, and the row's number."""
    rows = [(1, 1, i, x, m, s, None) for i, (x, m, s) in enumerate([(0.0, 1.0, "2020-01-01 00:00:00"), (None, 2.0, "2020-01-01 00:03:00"), (600.0, None, "x"), (None, 4.0, None)])]
    df = spark.createDataFrame(rows, "cell long, cycle long, sample long, clock double, relative_time_min double, stamp string, none double")
    of = lambda c, into="minutes": [r[into] for r in curves.inferred_time(df, c, into).orderBy("sample").collect()]
    assert of("clock") == [0, 5, 10, 10] and of("clock", "hours") == pytest.approx([0, 300 / 3600, 600 / 3600, 600 / 3600])
    assert of("relative_time_min") == [1, 2, 3, 4] and of("stamp") == [0, 3, None, None] and of("none") == [0, 1, 2, 3]


def test_first_cycle_is_skipped(spark):
    rows = [(c, k, i, i / 60, 3.6 - 0.02 * i, -1.0, 0.01 * i, 25.0, True, 2.8, 3.6) for c in (1, 2) for k in (1, 2) for i in range(30)]
    df = spark.createDataFrame(rows, "cell long, cycle long, sample long, hours double, voltage double, current double, capacity double, temperature double, discharging boolean, low double, high double").repartition(3)
    got = {(r["cell"], r["cycle"]): r["qv_available"] for r in curves.discharge_maps(df, skip_first=F.col("cell") == 2).collect()}
    assert got == {(1, 1): 1.0, (1, 2): 1.0, (2, 1): 0.0, (2, 2): 1.0}


def test_lab_roll_ups(spark):
    """Discharged capacity by the first dq, or by the largest counter; charge only where the current is positive; running sums."""
    rows = [("c", 1, 0, "CC Charge", 2.0, 3.0, 1.0, None, 1.5, None), ("c", 1, 1, "discharge", -2.0, 3.5, 9.0, 0.8, None, 0.7), ("c", 1, 2, "Discharge", -2.0, 3.1, 9.5, 0.9, None, 0.6), ("c", 2, 0, "constant voltage charge", 1.0, 4.0, 1.2, 0.7, 1.1, 0.2)]
    df = spark.createDataFrame([(*r, float(r[2] * 10)) for r in rows], "cell string, cycle long, sample long, step string, current double, voltage double, capacity double, dq double, q_charge double, q_discharge double, clock double").withColumn("temperature", F.lit(30.0))
    h = cycles.roll_up_hust(df).orderBy("cycle").collect()
    assert [(r["capacity"], r["charge_capacity"], r["cc_time"], r["cv_time"]) for r in h] == [(0.8, 1.0, 0.0, None), (0.7, 1.2, None, 0.0)]
    assert [r["discharge_throughput"] for r in h] == pytest.approx([0.8, 1.5]) and h[0]["energy_discharge"] == pytest.approx(0.8 * 3.3) and h[1]["energy_discharge"] is None
    t = cycles.roll_up_tju(df).orderBy("cycle").collect()
    assert [(r["capacity"], r["charge_capacity"]) for r in t] == [(0.7, 1.5), (0.2, 1.1)] and t[1]["cv_time"] == 0 and t[0]["energy_charge"] == pytest.approx(4.5)


def test_labels_scale_the_shortfall(spark):
    """Four cases; soh below .9 by 0, 0, .1, .2: median .05, quartiles 0 and .125. Of equal modes the first wins: thermal, current, cycle, power."""
    df = spark.createDataFrame([(i, 1.0, 1.0, 1.0, 1.0, s) for i, s in enumerate([0.95, 0.9, 0.8, 0.7])], "i int, thermal double, current double, power double, aging double, anchor_soh double")
    got = windows.semantic_labels(df).orderBy("i").collect()
    z = [(b - 0.05) / 0.125 for b in (0, 0, 0.1, 0.2)]
    assert [r["cycle_score"] for r in got] == pytest.approx([1 / (1 + math.exp(-0.8 * x)) for x in z])
    assert [r["semantic_label"] for r in got] == ["thermal", "thermal", "cycle", "cycle"] and windows.MODES == ("thermal", "current", "cycle", "power")


def test_patterns_match_whole_names(spark):
    df = spark.createDataFrame([("a_1",), ("ab1",), ("a1",), ("xa_1",), ("a.1",), ("a_2",)], "raw_cell_id string").withColumns({"chemistry_family": F.lit("x"), "file_path": F.lit("p")})
    left = lambda p: sorted(r["raw_cell_id"] for r in catalogs.exclude(df, patterns=[p]).collect())
    assert left("a_1") == ["a.1", "a1", "a_2", "ab1", "xa_1"] and left("a?1") == ["a1", "a_2", "xa_1"] and left("*_[!2]") == ["a.1", "a1", "a_2", "ab1"] and left("a.*") == ["a1", "a_1", "a_2", "ab1", "xa_1"]


def test_stage1_embedding(spark):
    """Two states, a history of three resampled to five, statistics, stress, one sequence; then the bank's medians and ranges."""
    rows = [(1, [0.9, None], [1.0, 0.9, 0.8], [2.0], [None], [1.0, None, 3.0])]
    df = spark.createDataFrame(rows, "id long, state array<double>, h array<double>, c array<double>, s array<double>, x array<double>")
    got = df.select(retrieval.stage1_embedding(F.col("state"), F.col("h"), F.col("c"), F.col("s"), [F.col("x")], 5)).first()[0]
    assert got == pytest.approx([0.9, 0, 0.2, 0.15, 0.1, 0.05, 0, 2, 0, 2, 1, 3])
    v = spark.createDataFrame([(i, [float(i), 5.0, 0.0 if i < 9 else 1.0]) for i in range(10)] + [(99, [1000.0, 6.0, None])], "id long, v array<double>")
    out = {r["id"]: r["v"] for r in retrieval.robust_scaled(v, F.col("id") < 10, "v", 3).collect()}
    assert out[0] == pytest.approx([-1.0, 0, 0]) and out[9] == pytest.approx([1.0, 0, 1 / 0.3]) and out[99] == pytest.approx([8.0, 1.0, 0])
    near = {r["id"]: r["v"] for r in retrieval.robust_scaled(v, F.col("id") < 10, "v", 3, accuracy=1000).collect()}
    assert near[99][0] == 8.0


def test_qv_distance(spark):
    """Curves 1, 2, 3 and 2, 4, 6 have one shape; levels 2 and 4 differ by half of 4. Statistics 1 and 2: half of 2."""
    rows = [([1.0, 2.0, 3.0, None], [2.0, 4.0, 6.0, 7.0], None, [1.0], [1.0], [2.0])]
    df = spark.createDataFrame(rows, "q_a array<double>, r_a array<double>, q_b array<double>, r_b array<double>, q_curve_stats array<double>, r_curve_stats array<double>")
    d = 0.15 * 0.5
    got = df.select(retrieval.qv_distance([("a", 0.35), ("b", 0.65)]), retrieval.qv_distance([("a", 0.35)], None), retrieval.qv_distance([("b", 0.65)], None)).first()
    assert tuple(got) == pytest.approx(((0.35 * d + 0.5) / 1.35, d, 1.0))


def test_hard_filter(spark):
    rows = [(1, "a", 10, "x", "q", [0.1], i, *r) for i, r in enumerate([("b", 5, "x", "source_train", [0.1]), ("a", 5, "x", "source_train", [0.1]), ("a", 15, "x", "source_val", [0.1]), ("b", 5, "y", "target_query", [0.1]), ("b", 5, "y", "source_val", [0.1]), ("b", 5, "x", "source_val", [None]), ("b", 5, "x", "source_val", [0.1, 0.2])], 1)]
    rows = [(1, "a", 10, "x", [0.1], i + 1, c, e, k, s, f) for *_, i, c, e, k, s, f in rows]
    df = spark.createDataFrame(rows, "q_id long, q_cell string, q_end long, q_chemistry string, q_future array<double>, r_id long, r_cell string, r_end long, r_chemistry string, r_split string, r_future array<double>")
    kept = lambda *a, **k: [r["r_id"] - 1 for r in df.where(retrieval.hard_filter(*a, **k)).orderBy("r_id").collect()]
    assert kept() == [1, 5] and kept("past_only") == [1, 2, 5] and kept("allow") == [1, 2, 3, 5] and kept(same_chemistry=True) == [1] and kept(splits=["source_val"]) == [5]
    with pytest.raises(ValueError):
        retrieval.hard_filter("other")


def test_rerank_by_curves(spark):
    df = spark.createDataFrame([(1, 1, 1, 0.2, 0.9), (1, 2, 2, 0.3, 0.1), (1, 3, 3, 0.4, None)], "query long, ref long, rank int, distance double, d_dqdv double")
    got = {r["ref"]: (r["distance"], r["base_distance"]) for r in retrieval.blended_rerank(df, F.lit(True)).collect()}
    assert got[1] == pytest.approx((0.55 * 0.2 + 0.45 * 0.9, 0.2)) and got[3] == (0.4, 0.4)
    assert {r["ref"]: r["new_rank"] for r in retrieval.reordered(df).collect()} == {2: 1, 1: 2, 3: 3}
    assert spark.range(1).select(retrieval.blended_trend(F.lit(0.5), F.lit(1.0), F.lit(2.0))).first()[0] == pytest.approx(0.7 + 0.6)


def test_places_of_names(spark):
    from voltrail.functions.ranks import numbered

    names = [f"{a}{b}" for a in "bac" for b in range(5)] + [None]
    df = spark.createDataFrame([(n,) for n in names], "name string").repartition(3)
    got = {r["name"]: r["place"] for r in numbered(df, [F.asc_nulls_first("name")]).collect()}
    assert got == {n: i for i, n in enumerate(sorted(names, key=lambda n: (n is not None, n or "")))}


def test_charge_mask_takes_discharge_unless_strict(spark):
    df = spark.createDataFrame([("Discharge", 1.0), ("charge", 1.0), (None, 1.0), (None, -1.0)], "step string, current double")
    got = df.select(curves.charge_mask(), curves.charge_mask(strict=True), curves.discharge_mask()).collect()
    assert [tuple(r) for r in got] == [(True, False, True), (True, True, False), (True, True, False), (False, False, True)]


def test_ridge_recovers_weights(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, 2))
    df = spark.createDataFrame([(float(a), float(b), float(2 * a - b)) for a, b in x], "a double, b double, y double").repartition(3).withColumn("k", F.lit("all"))
    assert regress.grams(df, ["a", "b"], ["y"], "k")["all"].ridge(["a", "b"], reg=1e-6)[:, 0] == pytest.approx([2, -1], abs=1e-4)


def test_readers(spark, tmp_path):
    (tmp_path / "h").mkdir()
    (tmp_path / "h" / "1-2.csv").write_text("cycle_index,Status,Current (mA),Voltage (V),Capacity (mAh),Time (s),dq\n1,charge,1000,3.1,5,0,\n1,discharge,-500,x,6,10,900\n")
    got = files.read_hust(spark, str(tmp_path / "h")).orderBy("time").collect()
    assert [(r["raw_cell_id"], r["current"], r["voltage"], r["temperature"]) for r in got] == [("1-2", 1.0, 3.1, 30.0), ("1-2", -0.5, None, 30.0)]
    assert [r["dq"] for r in got] == [None, 0.9]
    (tmp_path / "t" / "Dataset_1_NCA_battery").mkdir(parents=True)
    (tmp_path / "t" / "Dataset_1_NCA_battery" / "CY25-05_1-#3.csv").write_text("time/s,control/V,Ecell/V,<I>/mA,Q discharge/mA.h,Q charge/mA.h,cycle number\n0,0,3.5,100,7,8,1\n1,4.2,3.6,-100,7,8,1\n")
    got = files.read_tju(spark, str(tmp_path / "t")).orderBy("time").collect()
    assert [(r["raw_cell_id"], r["capacity"], r["temperature"], r["step"], r["chemistry_family"]) for r in got] == [
        ("Dataset_1_NCA_battery/CY25-05_1-#3", 0.008, 25.0, "constant current", "NCA"), ("Dataset_1_NCA_battery/CY25-05_1-#3", 0.007, 25.0, "constant voltage", "NCA"),
    ]
    assert files.config_hash({"b": 1, "a": 2}) == files.config_hash({"a": 2, "b": 1})


def test_bank_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, None, "a"), (2, "x", "b")], "id long, name string, split string")
    files.write_bank(df, str(tmp_path / "bank"))
    assert {(r["id"], r["name"], r["split"]) for r in files.read_bank(spark, str(tmp_path / "bank")).collect()} == {(1, "unknown", "a"), (2, "x", "b")}


def test_ids_of_more_than_five_digits_are_whole(spark):
    from voltrail.sources.roles import cell_uid, cell_uid_sql

    keys = [7, 12345, 100000, 1000001, None]
    want = ["cell_00007", "cell_12345", "cell_100000", "cell_1000001", None]
    assert [r[0] for r in spark.createDataFrame([(k,) for k in keys], "k long").select(cell_uid("k")).collect()] == want
    duckdb = pytest.importorskip("duckdb")
    assert [duckdb.execute(f"SELECT {cell_uid_sql('k')} FROM (SELECT ?::BIGINT AS k)", [k]).fetchone()[0] for k in keys] == want


def test_policy_texts_round_halves_up_whatever_the_noise(spark):
    numbers = {"current_abs_max": 0.12349999999999999, "current_abs_mean": 0.1235, "current_abs_std": 0.12350000000000001, "temperature_mean": 20.124999999999996, "temperature_max": 20.125, "temperature_std": 0.124999999, "voltage_min": None, "voltage_max": 3.2}
    df = spark.createDataFrame([tuple(numbers.values())], ", ".join(f"{c} double" for c in numbers))
    r = evaluate.policy_texts(df, F.lit("full")).first()
    assert r["current_text"] == "max 0.124 A, mean 0.124 A, std 0.124 A"
    assert r["temperature_text"] == "mean 20.13 degC, max 20.13 degC, std 0.12 degC"
    assert r["voltage_text"] == "unknown"


@pytest.mark.parametrize("cells", [1, 9])
def test_found_lists_bring_tags_and_serve_by_them(spark, cells):
    """Lists of more than a chunk; of each query's nearest, those of its own cell (and -1) are left out after the choice, by what came along."""
    rng = np.random.default_rng(5)
    v, tags = rng.normal(size=(260, 6)), rng.integers(-1, 6, 260)
    v[200:] = v[:60]  # equals: the smaller id comes first
    df = spark.createDataFrame([(i, x.tolist(), int(t)) for i, (x, t) in enumerate(zip(v, tags))], "id long, vector array<double>, tag long")
    got = {}
    for r in retrieval.servable(retrieval.search_lists(df.where("id % 10 = 0"), df, 150, "l2", cells), 40).orderBy("rank").collect():
        got.setdefault(r["query"], []).append(r["ref"])
    for q in range(0, 260, 10):
        near = sorted((i for i in range(260) if i != q), key=lambda i: (((v[i] - v[q]) ** 2).sum(), i))[:150]
        assert got[q] == [i for i in near if tags[i] >= 0 and tags[i] != tags[q]][:40]


def test_future_operations_make_their_windows_once(spark):
    """One scan of the events for the windows (and one for nominal capacities), not one for each mode."""
    from voltrail.plans import window_plans

    sf = "/root/testdata/sf0.001"
    scans = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("Relation [")
    assert 0 < scans(window_plans.future_ops(spark, sf)) == scans(window_plans.windows_of(spark, sf, ["soh"], []))


@pytest.mark.parametrize("stride", [1, 3, 7, 30])
def test_windows_of_any_stride(spark, stride):
    df = series(spark, [float(i) for i in range(53)]).withColumnRenamed("capacity", "soh")
    got = windows.sliding(df, ["soh"], 16, 4, stride).orderBy("window_start").collect()
    assert [r["soh_seq"] + r["soh_future"] for r in got] == [[float(i) for i in range(s, s + 20)] for s in range(0, 53 - 19, stride)]


def test_a_search_sends_final_lists_alone(spark, monkeypatch):
    """Where queries are enough for all cells, nothing is shuffled but the queries; a list ends with the last reference that is needed."""
    monkeypatch.setattr(retrieval, "SLICE", 16)
    rng = np.random.default_rng(7)
    v, tags = rng.normal(size=(300, 5)), rng.integers(-1, 4, 300)
    df = spark.createDataFrame([(i, x.tolist(), int(t)) for i, (x, t) in enumerate(zip(v, tags))], "id long, vector array<double>, tag long")
    found = retrieval.search_lists(df, df, 120, "cosine", 4, serve=10)
    assert found._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    want = retrieval.servable(retrieval.search_lists(df, df, 120, "cosine", 4), 10)
    assert sorted(map(tuple, retrieval.servable(found, 10).collect())) == sorted(map(tuple, want.collect()))
    for r in found.collect():
        may = [x["tag"] >= 0 and x["tag"] != r["tag"] for x in r["found"]]
        assert sum(may) <= 10 and (may[-1] or len(may) == 120)


@pytest.mark.parametrize("held", [3, 1000])
def test_sides_and_vectors_are_found_where_pairs_are(spark, monkeypatch, held):
    """The same as joins, for any number of pairs that a task holds; sides are not shuffled with pairs."""
    monkeypatch.setattr(retrieval, "PAIRS", held)
    rng = np.random.default_rng(8)
    cases = spark.createDataFrame([(i, f"c{i % 7}", [float(i), None] if i % 5 else None) for i in range(90)], "id long, cell string, seq array<double>").repartition(3)
    pairs = spark.createDataFrame([(q, int(r), float(d)) for q in range(0, 90, 4) for r, d in zip(rng.permutation(100)[:12], rng.random(12))], "query long, ref long, distance double")
    side = lambda p: cases.toDF(*(f"{p}_{c}" for c in cases.columns))
    want = pairs.join(side("q"), F.col("query") == F.col("q_id")).join(side("r"), F.col("ref") == F.col("r_id")).drop("q_id", "r_id")
    got = retrieval.with_sides(pairs, cases)
    assert got.columns == want.columns and sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    vectors = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(rng.normal(size=(100, 4)))], "id long, vector array<double>")
    named = pairs.withColumns({"cell": F.concat(F.lit("c"), (F.col("ref") % 5).cast("string")), "domain": (F.col("ref") % 3).cast("string")})
    want = retrieval.mmr_select(named.join(vectors, F.col("ref") == F.col("id")), 4, cap=1)
    assert sorted(map(tuple, retrieval.mmr_select(named, 4, cap=1, vectors=vectors).collect())) == sorted(map(tuple, want.collect()))


def test_choice_comes_before_pairs_move(spark, monkeypatch):
    """The same choice as with ranks over all pairs, of which only those that may be chosen are shuffled, wherever a query's pairs are and with NaN and null among the distances."""
    rng = np.random.default_rng(4)
    d = [None if x < 0.1 else float("nan") if x < 0.2 else round(x, 1) for x in rng.random(900).tolist()]
    df = spark.createDataFrame([(i % 9, i, f"c{rng.integers(12)}" if i % 11 else None, d[i]) for i in range(900)], "query long, ref long, cell string, distance double").repartition(3, "ref")
    order = [F.asc_nulls_last("distance"), "ref"]
    for per, cap, held in (("cell", 1, 500_000), ("cell", 2, 200), ("cell", 1, 50), (None, 2, 120)):
        monkeypatch.setattr(retrieval, "PAIRS", held)
        want = df.withColumn("_c", F.row_number().over(W.partitionBy("query", per or "ref").orderBy(*order))).where(F.col("_c") <= cap).drop("_c")
        want = want.withColumn("rank", F.row_number().over(W.partitionBy("query").orderBy(*order))).where("rank <= 5")
        assert sorted(map(str, retrieval.capped_topk(df, 5, per, cap).collect())) == sorted(map(str, want.collect()))
        assert held == 50 or retrieval.foremost(df, ["query"], 5, per, cap).count() <= 9 * 5 * 3
    together = df.coalesce(1).withColumns({"domain": F.lit("d"), "cell": F.coalesce("cell", F.lit("-"))}).where("distance IS NOT NULL AND NOT isnan(distance)")
    files = retrieval.references(spark.createDataFrame([(i, rng.normal(size=4).tolist()) for i in range(900)], "id long, vector array<double>"))
    got = retrieval.mmr_select(together, 4, vectors=files, together=True)
    assert "hashpartitioning(query" not in got._jdf.queryExecution().executedPlan().toString() and sorted(map(str, got.collect())) == sorted(map(str, retrieval.mmr_select(together, 4, vectors=files).collect()))


def test_retrieval_stores_cases_and_references_alone(spark):
    """Cycles move once and cases are stored once, and neither values nor sides are stored anew; lists are merged only where queries are too few for the tasks."""
    from pathlib import Path

    from voltrail.functions import storage
    from voltrail.plans import retrieval_plans

    storage.shared_dir(spark, "any")
    own = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file://")) / storage._own[spark.sparkContext.applicationId]
    before = set(own.glob("*"))
    chosen = retrieval_plans.results_of(spark, "/root/testdata/sf0.001")
    assert sorted(f.name.split("-")[0] for f in set(own.glob("*")) - before) == ["cases", "references"]
    assert "ShuffledHashJoin" not in chosen._jdf.queryExecution().executedPlan().toString()
    assert retrieval_plans.raw_cases(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 2  # and once more, narrow, for the first capacities
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        df = spark.range(5000).select("id", F.array(F.rand(1), F.rand(2)).alias("vector"))
        assert retrieval.search_lists(df, df, 3)._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_maps_run_through_cycles_once(spark):
    """No frame that ends with the partition (each row would go through the rest of its cycle), and statistics alone where maps are not asked for; medians as numpy has them."""
    from voltrail.functions.curves import smooth
    from voltrail.plans import curve_plans

    sf = "/root/testdata/sf0.001"
    maps = curve_plans.maps_of(spark, sf, False)
    assert "UNBOUNDED FOLLOWING" not in maps._jdf.queryExecution().optimizedPlan().toString().upper().replace("UNBOUNDEDFOLLOWING", "UNBOUNDED FOLLOWING").replace("UNBOUNDED PRECEDING, UNBOUNDED FOLLOWING", "").replace("UNBOUNDEDPRECEDING$(), UNBOUNDED FOLLOWING$()", "")
    assert "channels" not in maps.columns
    whole = {(r["cell"], r["cycle"]): r for r in curve_plans.maps_of(spark, sf).collect()}
    for r in maps.collect():
        other = whole[r["cell"], r["cycle"]]
        assert len(other["channels"]) == len(other["masks"]) == 6 and {len(c) for c in other["channels"]} == {100}
        assert all(r[c] == other[c] for c in maps.columns)
    x = np.random.default_rng(3).normal(size=40)
    x[[0, 1, 2, 3, 7, 20, 21, 22, 23, 24, 25, 39]] = np.nan
    views = [x[max(i - 2, 0) : i + 3] for i in range(40)]
    want = [np.nan if np.isnan(v).all() else np.nanmedian(v) for v in views]
    assert np.array_equal(smooth(x), want, equal_nan=True)
