"""Queries on tables with odd cells, against their SQL."""

from __future__ import annotations

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from voltrail.catalog import ORACLES, QUERIES
from voltrail.functions.storage import stored
from voltrail.operators import curves, retrieval
from voltrail.plans import retrieval_plans

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def far(spark, tmp_path_factory):
    """Events in which a query's cell and one of another chemistry begin with almost nothing, so that their health is huge and all other references lie far behind."""
    folder = str(tmp_path_factory.mktemp("far"))
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    con.execute(f"""COPY (SELECT * EXCLUDE (p) REPLACE (CASE WHEN user_id IN (0, 5) AND p <= 8 THEN 0.001 ELSE value END AS value)
      FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM '{SF}/events.parquet')) TO '{folder}/events.parquet' (FORMAT parquet)""")
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{folder}/events.parquet'")
    return folder, con


@pytest.mark.parametrize("name", ["rag_forecast", "metrics_overall", "metrics_by_group", "method_table", "forecast_by_group"])
def test_weights_that_vanish(spark, far, name):
    """Where all references of a query's chemistry have weight 0, their forecast is not a number, in the query as in its SQL."""
    folder, con = far
    got, want = QUERIES[name](spark, folder).toPandas(), con.execute(ORACLES[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns) and len(got) == len(want)
    keys = [c for c in columns if c in ("query", "horizon", "method", "chemistry", "domain")]
    got, want = (x.sort_values(keys).reset_index(drop=True) for x in (got, want))
    numbers = [c for c in columns if c not in keys]
    assert got[numbers].isna().any().any()
    assert np.allclose(got[numbers].astype(float), want[numbers].astype(float), rtol=2e-5, atol=2e-5, equal_nan=True)


def test_life_that_begins_with_nothing(spark):
    rows = [("a", i, 0.0 if i == 1 else 5.0 + i) for i in range(1, 13)] + [("b", i, float(i)) for i in range(1, 13)]
    lives = curves.life_curves(spark.createDataFrame(rows, "cell_uid string, cycle_idx int, capacity double"))
    got = {r["cell_uid"]: r["life"] for r in lives.collect()}
    assert got == {"a": [0.0, *(5.0 + i for i in range(2, 13))], "b": [float(i) for i in range(1, 13)]}
    pairs = spark.createDataFrame([("a", "b")], "a string, b string")
    assert curves.life_distances(pairs, lives).first()["rmse"] > 0


def test_numbers_of_pairs_are_those_on_columns(spark):
    """Gaps, constants, NaN, what one side lacks, and lists that are unknown throughout give what the operators on columns give; pairs are not computed row by row in Spark."""
    rng = np.random.default_rng(6)
    n, length = 40, retrieval_plans.L
    some = lambda size, gaps=0.2: [None if x < gaps else float(v) for x, v in zip(rng.random(size), rng.normal(1, 0.3, size))]
    rows = []
    for i in range(n):
        seq = [*some(length - 1), 1.0]
        if i % 9 == 0:
            seq = [1.0] * length
        q = [None] * length if i % 11 == 0 else [float("nan")] * 3 + some(length - 3) if i % 13 == 0 else some(length)
        text = lambda names: None if rng.random() < 0.1 else str(rng.choice(names))
        rows.append((i, f"c{i}", seq, [1.0, None if i % 3 else 0.1, None if i % 2 else 0.2], text(["mid", "end"]), text(["LFP", "unknown"]), [*some(3, 0.4), 1.0], q, (rng.random(18) < 0.8).tolist(), some(length, 0.9), some(length), text(["hust", "mit"])))
    schema = "case_id long, cell_uid string, soh_seq array<double>, state array<double>, stage string, chemistry_family string, curve_stats array<double>, q_curve array<double>, masks array<boolean>, temp_mean_seq array<double>, current_mean_seq array<double>, source_dataset string"
    cases = stored(spark.createDataFrame(rows, schema), "cases")
    pairs = spark.createDataFrame([(a, b) for a in range(n) for b in range(n) if a != b], "query long, ref long")
    got = retrieval_plans.with_components(cases, pairs)
    assert "zip_with" not in got._jdf.queryExecution().executedPlan().toString()
    both = retrieval_plans.found_sides(cases, pairs, retrieval_plans.NEEDED)
    both = retrieval_plans.changes(both).withColumns({f"{p}_stress": F.col(f"{p}_curve_stats") for p in "qr"})
    want = both.withColumns({
        "d_soh_state": retrieval.soh_state_distance(length), "d_qv_shape": retrieval.qv_distance(retrieval_plans.CURVES), "d_physics": retrieval.physics_distance(),
        "d_metadata": retrieval.metadata_distance([("chemistry", 1.0), ("dataset", 0.5)], [("temp", 0.25), ("amps", 0.25)]), "available": retrieval.availability(),
    }).withColumn("distance", retrieval.composite(retrieval_plans.WEIGHTS))
    names = ["query", "ref", *retrieval_plans.NUMBERS]
    got, want = (x.select(names).toPandas().sort_values(["query", "ref"]).to_numpy(float) for x in (got, want))
    assert got.shape == (n * (n - 1), len(names)) and np.isnan(got).any()
    for c, name in enumerate(names):
        assert np.allclose(got[:, c], want[:, c], rtol=1e-9, atol=1e-7, equal_nan=True), (name, [(a[:2], a[c], b[c]) for a, b in zip(got, want) if not np.isclose(a[c], b[c], equal_nan=True)][:6])


@pytest.mark.parametrize("shape", [(5, 8), (7, 5), (0, 8), (3, 0), (64, 256)])
def test_places_of_hits(shape):
    for share in (0, 0.02, 1):
        hits = np.random.default_rng(1).random(shape) < share
        assert retrieval._places(hits).tolist() == np.flatnonzero(hits).tolist()


def test_embedding_is_that_on_columns(spark, far):
    """To the last bit, with gaps and sequences that are unknown throughout; cases are not embedded row by row in Spark."""
    folder, _ = far
    raw = retrieval_plans.raw_cases(spark, folder)
    power = F.when(F.col("window_start") % 3 != 0, F.col("power_seq")).otherwise(F.array_repeat(F.lit(None).cast("double"), retrieval_plans.L))
    raw = stored(raw.withColumn("power_seq", power).select("case_id", "state", "soh_seq", "curve_stats", "stress", "temp_mean_seq", "current_mean_seq", "power_seq"), "raw")
    others = [F.transform("current_mean_seq", F.abs), F.col("temp_mean_seq"), F.col("power_seq"), F.concat(F.array(F.lit(0.0)), retrieval.differences(F.col("soh_seq")))]
    want = raw.select("case_id", retrieval.stage1_embedding(F.col("state"), F.col("soh_seq"), F.col("curve_stats"), F.col("stress"), others).alias("embedding"))
    got = retrieval_plans.with_embedding(raw)
    assert set(got.columns) == {*raw.columns, "embedding"} - {"stress", "power_seq"}
    got, want = ({r["case_id"]: r["embedding"] for r in x.collect()} for x in (got, want))
    assert len(got) > 100 and got == want and all(len(v) == retrieval_plans.WIDTH for v in got.values())
