"""Kept results, training rows, islands of cycles and policies on small tables."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from voltrail.operators import evaluate, retrieval, windows
from voltrail.sources import files


def test_results_are_kept(spark, tmp_path):
    """The second call reads, another setting computes anew, new queries are computed alone, and half a write counts as none."""
    calls = []

    def compute(missing):
        calls.append(sorted(r["query"] for r in missing.collect()))
        return missing.where("query <> 3").select("query", (F.col("query") * 10).alias("ref"))

    ask = lambda ids, config={"k": 1}: sorted(map(tuple, files.cached_results(spark.createDataFrame([(i,) for i in ids], "query long"), str(tmp_path / "c"), config, compute).collect()))  # noqa: B006, E731
    assert ask([1, 2, 3]) == [(1, 10), (2, 20)] and calls == [[1, 2, 3]]
    assert ask([2, 3]) == [(2, 20)] and len(calls) == 1
    assert ask([1, 2, 3, 4]) == [(1, 10), (2, 20), (4, 40)] and calls[1] == [4]
    assert ask([2], {"k": 2}) == [(2, 20)] and calls[2] == [2]

    def broken(missing):
        raise RuntimeError("lost")

    queries = spark.createDataFrame([(7,)], "query long")
    with pytest.raises(RuntimeError):
        files.cached_results(queries, str(tmp_path / "c"), {"k": 1}, broken)
    assert ask([7]) == [(7, 70)] and calls[3] == [7]
    assert ask([]) == []


def test_training_rows(spark):
    bank = files.bucketed(spark.createDataFrame([(i, [float(i), None], [i * 0.5]) for i in range(6)], "case_id long, s array<double>, f array<double>"), "small", "case_id")
    results = spark.createDataFrame([(1, 2, 3, 0.25), (1, 1, 5, 0.75), (2, 1, 4, 1.0)], "query long, rank int, ref long, alpha double")
    out = retrieval.training_arrays(results, bank, 3, {"s": 2, "f": 1})
    got = {r["query"]: r for r in out.collect()}
    assert got[1]["ref_ids"] == [5, 3, -1] and got[1]["ref_mask"] == [1, 1, 0] and got[1]["ref_alpha"] == [0.75, 0.25, 0.0]
    assert got[1]["ref_s"] == [[5.0, 0.0], [3.0, 0.0], [0.0, 0.0]] and got[1]["ref_f"] == [[2.5], [1.5], [0.0]] and got[1]["s"] == [1.0, 0.0] and got[1]["f"] == [0.5]
    assert got[2]["ref_ids"] == [4, -1, -1] and len(got) == 2
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = retrieval.training_arrays(results, bank, 3, {"s": 2, "f": 1})._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    # the results move by reference and by query, the bank not at all
    assert plan.count("Exchange ") == 2 and plan.count("Bucketed: true") == 2, plan


def test_islands_of_cycles(spark):
    """Eight known cycles in a row are needed; a cycle that no window's operations know takes the last of the history."""
    none = None
    rows = [("a", 0, 2, 0.9, [1.0, 0.9], [0.8, 0.7], [5.0, none], [7.0, none]), ("a", 2, 4, 0.7, [0.8, 0.7], [0.6, 0.5], [7.0, none], [none, none]), ("b", 0, 2, 0.5, [0.6, 0.5], [0.4, none], [1.0, 2.0], [3.0, 4.0])]
    df = spark.createDataFrame(rows, "cell_uid string, window_start long, window_end long, anchor_soh double, soh_seq array<double>, soh_future array<double>, t_seq array<double>, t_future array<double>")
    got = {(r["cell_uid"], r["window_start"]): r["future"] for r in windows.extended(df, 4, "soh", ["t"]).collect()}
    assert set(got) == {("a", 0)}
    assert [(f["soh"], f["t"], f["mask"]) for f in got["a", 0]] == [(0.8, 7.0, 1), (0.7, 0.0, 0), (0.6, 0.0, 0), (0.5, 0.0, 0)]
    assert {(r["cell_uid"], r["window_start"]) for r in windows.extended(df, 1, "soh", ["t"]).collect()} == {("a", 0), ("a", 2), ("b", 0)}


def test_trend_and_policy(spark):
    df = spark.createDataFrame([([1.0, None, 0.8, 0.75],), ([None, 1.0, 0.9, None],), ([2.0, 2.0, 2.0, 2.0],)], "s array<double>")
    got = [r[0] for r in df.select(retrieval.history_slope("s")).collect()]
    assert got == [pytest.approx(-0.0857142857), 0.0, 0.0]
    columns = "current_abs_mean double, current_abs_std double, current_abs_max double, temperature_mean double, temperature_std double, temperature_max double, voltage_min double, voltage_max double"
    rows = spark.createDataFrame([(1.0625, 0.5, None, 20.125, 0.0, 30.0, None, 4.0), (None, None, 2.0, None, None, None, 2.5, 4.2)], columns)
    one, two = evaluate.policy_texts(rows, F.lit("full")).collect()
    assert one["active_current"] == 1.0625 and one["current_text"] == "max unknown, mean 1.063 A, std 0.500 A" and one["voltage_text"] == "unknown" and one["temperature_text"].startswith("mean 20.13 degC")
    assert two["active_current"] == 2.0 and two["voltage_text"] == "2.500 V to 4.200 V" and two["temperature_text"] == "mean unknown, max unknown, std unknown"
