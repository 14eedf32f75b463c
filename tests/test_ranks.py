"""Places, ranks, permutations and quantiles over all partitions against plain Python."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from voltrail.functions import ranks
from voltrail.functions.storage import release, shared_dir, stored
from voltrail.operators import retrieval, windows
from voltrail.sources import files


def test_numbered(spark):
    """0 to n - 1 in order, over several partitions, with ties that a second column tells apart."""
    rows = [(random.Random(i).choice([None, -1.5, 0.0, 2.0, 7.25]), i) for i in range(500)]
    df = spark.createDataFrame(rows, "v double, id long").repartition(7)
    got = ranks.numbered(df, ["v", "id"]).collect()
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    assert [(r["v"], r["id"]) for r in sorted(got, key=lambda r: r["place"])] == order and sorted(r["place"] for r in got) == list(range(500))
    assert ranks.numbered(df.where("id < 0"), ["v", "id"]).collect() == []


def test_ranks_and_tiles_within_keys(spark):
    r = random.Random(3)
    rows = [(f"k{r.randrange(4)}" if i % 9 else "alone", r.choice([0.0, 1.0, 1.0, 5.5, -2.0, r.random()]), i) for i in range(400)] + [("one", 4.0, 1000)]
    df = spark.createDataFrame(rows, "key string, x double, id long")
    got = {q["id"]: q for q in ranks.ranked_within(df, ["key"], "x", "id", 8).collect()}
    assert len(got) == len(rows)
    for key in {k for k, _, _ in rows}:
        own = sorted((x, i) for k, x, i in rows if k == key)
        n = len(own)
        for at, (x, i) in enumerate(own):
            places = [j + 1 for j, (y, _) in enumerate(own) if y == x]
            assert got[i]["x_rank"] == sum(places) / len(places)
            sizes = [n // 8 + (t < n % 8) for t in range(8)]
            assert got[i]["x_tile"] == next(t + 1 for t in range(8) if at < sum(sizes[: t + 1]))


def test_no_task_holds_a_key(spark):
    """All rows under one key and value, and they still are sorted in several tasks, each with a file of its own."""
    df = spark.range(4000).select(F.lit("hot").alias("key"), F.lit(1.0).alias("x"), "id")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        placed = ranks.numbered(df, ["key", "x", "id"])
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(placed.inputFiles()) == 4
    assert ranks.ranked_within(df, ["key"], "x", "id").where("x_rank <> 2000.5").count() == 0


def test_shuffled(spark):
    df = spark.range(300).select("id", (F.col("id") * 2).alias("v"))
    got = ranks.shuffled(df, "id", [1, 2, 3], ["v"]).collect()
    dealt = {s: {r["id"]: r["v_other"] for r in got if r["seed"] == s} for s in (1, 2, 3)}
    for d in dealt.values():
        assert sorted(d) == list(range(300)) and sorted(d.values()) == [2 * i for i in range(300)]
        assert sum(d[i] == 2 * i for i in d) < 15
    assert dealt[1] != dealt[2] != dealt[3]
    again = {(r["seed"], r["id"]): r["v_other"] for r in ranks.shuffled(df.repartition(5), "id", [1, 2], ["v"]).collect()}
    assert all(again[s, i] == dealt[s][i] for s, i in again)


@pytest.mark.parametrize("few, bins", [(20_000, 1024), (40, 8), (1, 3)])
def test_exact_quantiles(spark, few, bins):
    """With few values looked through at once, several rounds of bins lead there."""
    r = np.random.default_rng(5)
    inf = float("inf")
    lists = {
        "plain": r.normal(size=700).tolist(), "ties": r.choice([1.0, 1.0, 1.0, 2.0, 9.0], 300).tolist(), "one": [3.25], "same": [7.0] * 50, "wide": (10.0 ** r.uniform(-200, 300, 200) * r.choice([-1, 1], 200)).tolist(),
        "ends": [-inf, -inf, 1.0, 2.0, inf, inf, inf], "odd": [float("nan"), 4.0, 5.0],
    }
    df = spark.createDataFrame([(k, v) for k, vs in lists.items() for v in [*vs, None]] + [("none", None)], "k string, x double").repartition(3)
    probabilities = (0.0, 0.05, 0.25, 0.5, 0.95, 1.0)
    got = ranks.exact(df, "k", "x", probabilities, few, bins)
    assert got.keys() == lists.keys()
    for k, vs in lists.items():
        known = sorted(v for v in vs if v == v)
        assert got[k].n == len(known)
        for p, q in zip(probabilities, got[k].quantiles):
            at = p * (len(known) - 1)
            low, high = known[int(at)], known[min(int(at) + 1, len(known) - 1)] if at > int(at) else known[int(at)]
            assert q == low if low == high else q == pytest.approx(low + (high - low) * (at - int(at)), rel=1e-12) or abs(q) == inf, (k, p)
        if k in ("plain", "ties"):
            assert got[k].mean == pytest.approx(np.mean(vs)) and got[k].std == pytest.approx(np.std(vs))


def test_sketches_keep_their_error(spark):
    x = np.random.default_rng(1).lognormal(0, 3, 30_000)
    df = spark.createDataFrame([("a", float(v)) for v in x], "k string, x double").repartition(9)
    own = np.sort(x)
    for accuracy in (50, 1000):
        for p, q in zip((0.1, 0.5, 0.99), ranks.sketched(df, "k", "x", (0.1, 0.5, 0.99), accuracy)["a"].quantiles):
            assert abs(np.searchsorted(own, q) - p * len(own)) <= len(own) / accuracy + 1


def test_exact_and_approximate_scaling_agree(spark):
    r = np.random.default_rng(2)
    df = spark.createDataFrame([(i, "a" if i % 3 else "b", [float(v) for v in r.normal(size=4)], float(r.normal())) for i in range(900)], "id long, split string, v array<double>, x double")
    one, two = ({q["id"]: q["v"] for q in retrieval.robust_scaled(df, F.col("split") == "a", "v", 4, a).collect()} for a in (None, 10_000))
    assert all(abs(a - b) < 0.05 for i in one for a, b in zip(one[i], two[i]))
    one, two = ({q["id"]: q["x_z"] for q in windows.robust_z(df, ["x"], a).collect()} for a in (None, 10_000))
    assert all(abs(one[i] - two[i]) < 0.05 for i in one)
    nothing = windows.robust_z(df.withColumn("x", F.lit(None).cast("double")), ["x"])
    assert nothing.where("x_z <> 0").count() == 0


def test_wide_series_positions(spark, tmp_path):
    """Positions are consecutive over all partitions and follow the files' rows."""
    rows = [(f"t{i}", float(i), i * 2, "text") for i in range(100)]
    frame = spark.createDataFrame(rows, "t string, a double, `b.c` int, s string")
    got = files.wide_series(frame.repartition(4)).collect()
    assert {r["series"] for r in got} == {"a", "b.c"}
    for s in ("a", "b.c"):
        assert sorted(r["position"] for r in got if r["series"] == s) == list(range(100))
    frame.coalesce(1).drop("s").write.option("header", True).csv(str(tmp_path / "f"))
    read = spark.read.option("header", True).schema("t string, a double, `b.c` int").csv(str(tmp_path / "f"))
    assert {(r["position"], r["value"]) for r in files.wide_series(read, ["a"]).collect()} == {(i, float(i)) for i in range(100)}
    assert [r["value"] for r in files.wide_series(frame.repartition(3), ["a"], ["a"]).orderBy("position").collect()] == [float(i) for i in range(100)]


def test_union_of_unlike_parts(spark):
    one = spark.createDataFrame([("x", 1, 2.5)], "cell string, n int, v double")
    two = spark.createDataFrame([("y", "fast", 7.0)], "cell string, protocol string, n double")
    got = files.union_cycles([one, two], ["cell", "protocol", "n", "v", "nowhere"])
    assert dict(got.dtypes) == {"cell": "string", "protocol": "string", "n": "double", "v": "double", "nowhere": "double"}
    assert sorted(map(tuple, got.collect())) == [("x", None, 1.0, 2.5, None), ("y", "fast", 7.0, None, None)]


def test_storage(spark):
    path = shared_dir(spark, "x")
    assert path != shared_dir(spark, "x")
    t = stored(spark.range(10).toDF("n"), "numbers")
    assert t.count() == 10
    release(spark)
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist|FILE_NOT_EXIST|No such file"):
        spark.read.parquet(t.inputFiles()[0]).count()
