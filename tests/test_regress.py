"""Regressions, refits, permutations and forests against plain numpy, row by row."""

from __future__ import annotations

import math

import numpy as np
import pytest

from voltrail.catalog import QUERIES
from voltrail.operators import forest, regress
from voltrail.plans import feature_plans as plan

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def table(spark):
    return plan.feature_table(spark, SF).collect()


def result(spark, name, *keys):
    return {tuple(r[k] for k in keys): r.asDict() for r in QUERIES[name](spark, SF).collect()}


def matrix(rows, names):
    number = lambda v: 0.0 if v is None or math.isnan(v) or math.isinf(v) else float(v)
    return np.array([[number(r[c]) for c in names] for r in rows]).reshape(len(rows), len(names))


def of(table, split):
    return [r for r in table if r["split"] == split]


def ridge(rows, names, weights=None):
    x, y = matrix(rows, names), matrix(rows, plan.DELTAS)
    w = np.ones(len(rows)) if weights is None else weights
    return np.linalg.solve(x.T @ (x * w[:, None]) + np.eye(len(names)), x.T @ (y * w[:, None]))


def check(got, p, y, last=True):
    e = p - y
    want = {"mae": np.abs(e).mean(), "rmse": math.sqrt((e * e).mean()), "mape": (np.abs(e) / np.maximum(np.abs(y), 1e-6)).mean()} | ({"last_step_mae": np.abs(e[:, -1]).mean()} if last else {})
    assert got["n"] == e.size
    for k, v in want.items():
        assert got[k] == pytest.approx(v, rel=2e-4, abs=2e-5), k


def test_ridge_ablation(spark, table):
    got = result(spark, "ridge_ablation", "feature_group")
    assert [len(v) for v in plan.GROUPS.values()] == [2, 11, 4, 2, 2, 12, 6, 8, 18, 33] and {g for (g,) in got} == set(plan.GROUPS)
    val = of(table, "source_val")
    for g, names in plan.GROUPS.items():
        check(got[g,], matrix(val, names) @ ridge(of(table, "source_train"), names), matrix(val, plan.DELTAS))


def test_ablation_horizons(spark, table):
    got = result(spark, "ablation_horizons", "feature_group", "by", "value")
    val, seen = of(table, "source_val"), 0
    for g, names in plan.GROUPS.items():
        w = ridge(of(table, "source_train"), names)
        for by in ("chemistry_family", "domain_label"):
            for value in {r[by] for r in val}:
                own = [r for r in val if r[by] == value]
                check(got[g, by, value], matrix(own, names) @ w, matrix(own, plan.DELTAS), last=False)
                seen += 1
        for h in range(len(plan.DELTAS)):
            check(got[g, "horizon", str(h + 1)], (matrix(val, names) @ w)[:, [h]], matrix(val, plan.DELTAS)[:, [h]], last=False)
            seen += 1
    assert seen == len(got)


def test_ridge_importance(spark, table):
    got = result(spark, "ridge_importance", "feature_group", "feature")
    assert len(got) == sum(map(len, plan.GROUPS.values()))
    for g, names in plan.GROUPS.items():
        for f, v in zip(names, np.abs(ridge(of(table, "source_train"), names)).mean(axis=1)):
            assert got[g, f]["importance"] == pytest.approx(v, rel=1e-4, abs=1e-6)


def test_fewshot_sanity(spark, table):
    got = result(spark, "fewshot_sanity", "feature_group", "adaptation")
    train, support, asked = (of(table, s) for s in ("source_train", "target_support", "target_query"))
    assert support and asked and len(got) == 6 * len(plan.GROUPS)
    balanced = max(2, min(8, math.ceil(len(train) / len(support))))
    y = matrix(asked, plan.DELTAS)
    for g, names in plan.GROUPS.items():
        w = ridge(train, names)
        check(got[g, "source_only"], matrix(asked, names) @ w, y)
        bias = (matrix(support, plan.DELTAS) - matrix(support, names) @ w).mean(axis=0)
        check(got[g, "support_bias"], matrix(asked, names) @ w + bias, y)
        for name, k in {"support_x2": 2, "support_x4": 4, "support_x8": 8, "support_weighted_refit": balanced}.items():
            check(got[g, name], matrix(asked, names) @ ridge(train + support * k, names), y)


def test_permutation_importance(spark, table):
    """The permutations themselves are tested in test_ranks; here their effect, from the rows that they deal."""
    got = result(spark, "permutation_importance", "feature")
    train, val = of(table, "source_train"), of(table, "source_val")
    y = matrix(val, plan.DELTAS)
    mae = {g: np.abs(matrix(val, names) @ ridge(train, names) - y).mean() for g, names in plan.GROUPS.items()}
    best = min(mae, key=mae.get)
    names = plan.GROUPS[best]
    assert {r["feature_group"] for r in got.values()} == {best} and {f for (f,) in got} == set(names)
    x, t = matrix(train, names), matrix(train, plan.DELTAS)
    w = np.linalg.solve((x - x.mean(axis=0)).T @ (x - x.mean(axis=0)) + np.eye(len(names)), (x - x.mean(axis=0)).T @ (t - t.mean(axis=0)))
    e = matrix(val, names) @ w + t.mean(axis=0) - x.mean(axis=0) @ w - y
    from voltrail.functions.ranks import shuffled

    ids = spark.createDataFrame([(r["case_id"],) for r in val], "case_id long").selectExpr("case_id", "case_id AS other")
    dealt = {(r["seed"], r["case_id"]): r["other_other"] for r in shuffled(ids, "case_id", [1, 2, 3, 4, 5], ["other"]).collect()}
    row = {r["case_id"]: i for i, r in enumerate(val)}
    v = matrix(val, names)
    for i, f in enumerate(names):
        rises = []
        for s in (1, 2, 3, 4, 5):
            other = np.array([v[row[dealt[s, r["case_id"]]], i] for r in val])
            rises.append(np.abs(e + np.outer(other - v[:, i], w[i])).mean() - np.abs(e).mean())
        assert got[f,]["importance"] == pytest.approx(np.mean(rises), rel=1e-3, abs=1e-6) and got[f,]["deviation"] == pytest.approx(np.std(rises), rel=1e-3, abs=1e-6)
        assert got[f,]["mae"] == pytest.approx(np.abs(e).mean(), rel=1e-5)


def test_sums_add_up(spark):
    """Sums of disjoint rows add up, and a key without rows of a feature has zeros for it."""
    rows = [(i, "ab"[i % 2], float(i), None if i % 3 else 1.5 * i, float(i * i)) for i in range(40)] + [(99, None, 1.0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "id long, k string, p double, q double, y double").repartition(6)
    both = regress.grams(df, ["p", "q"], ["y"], "k")
    assert both.keys() == {"a", "b"}
    z = np.array([[1.0, r[2], r[3] or 0.0, r[4]] for r in rows[:-1]])
    assert np.allclose((both["a"] + both["b"]).sums, z.T @ z) and np.allclose((both["a"] * 3).sums, 3 * z[::2].T @ z[::2]) and both["a"].n == 20
    assert regress.grams(df.where("id < 0"), ["p"], ["y"], "k") == {}


# forests


def plain_forest(rows, ids, groups, features, targets, edges, how):
    """Trees grown node by node, with recursion over plain lists of rows."""
    bins = np.column_stack([np.searchsorted(edges[i], rows[f], "left") for i, f in enumerate(features)])
    y = np.column_stack([rows[t] for t in targets])
    trees = []
    for g, names in enumerate(groups.values()):
        own = [features.index(f) for f in names]
        for k in range(how.trees):
            w = forest.weights(ids, g * how.trees + k, how.seed)

            def node(use, depth, w=w, own=own):
                n = w[use].sum()
                value = (w[use, None] * y[use]).sum(axis=0) / max(n, 1e-300)
                best = None
                if depth < how.depth and (n > 1.5 or depth == 0):
                    error = lambda at: (w[at, None] * (y[at] - (w[at, None] * y[at]).sum(axis=0) / w[at].sum()) ** 2).sum()
                    for f in own:
                        for b in range(how.bins):
                            left, right = use[bins[use, f] <= b], use[bins[use, f] > b]
                            if w[left].sum() < 0.5 or w[right].sum() < 0.5:
                                continue
                            gain = error(use) - error(left) - error(right)
                            if best is None or gain > best[0] + 1e-9:
                                best = (gain, f, b, left, right)
                if best is None or best[0] <= how.least_gain:
                    return value
                return best[1], best[2], node(best[3], depth + 1), node(best[4], depth + 1)

            trees.append(node(np.flatnonzero(w > 0), 0))
    return trees, bins


def answer(tree, row):
    while isinstance(tree, tuple):
        tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
    return tree


def test_forest_as_plain_trees(spark):
    r = np.random.default_rng(3)
    n = 200
    x = {"a": r.normal(size=n), "b": r.integers(0, 5, n).astype(float), "c": r.normal(size=n), "still": np.ones(n)}
    x |= {"y": x["a"] * 2 + (x["b"] > 2) + r.normal(0, 0.1, n), "z": np.where(x["c"] > 0, x["b"], -x["a"])}
    names = list(x)
    df = spark.createDataFrame([(i, *(float(x[c][i]) for c in names)) for i in range(n)], "id long, " + ", ".join(f"{c} double" for c in names)).repartition(5)
    groups, how = {"one": ["a", "b"], "all": ["a", "b", "c", "still"], "still": ["still"]}, forest.Growth(trees=3, depth=4, bins=8)
    grown = forest.grow(df, "id", groups, ["y", "z"], how)
    ids = {q["id"]: q["h"] for q in df.selectExpr("id", "xxhash64(id) AS h").collect()}
    plain, bins = plain_forest(x, np.array([ids[i] for i in range(n)]), groups, grown.features, ["y", "z"], grown.edges, how)
    got = grown.binned(np.column_stack([x[f] for f in grown.features]))
    assert (got == bins).all()
    y = np.column_stack([x["y"], x["z"]])
    sums = {(q["feature_group"], q["horizon"]): q for q in forest.scored(df, grown, ["y", "z"], how.depth).collect()}
    for g, name in enumerate(groups):
        for t in range(g * 3, g * 3 + 3):
            own = grown.value[t, grown.node(t, got, how.depth)]
            assert np.allclose(own, np.array([answer(plain[t], row) for row in bins]))
        e = grown.predict(g, got, how.depth) - y
        for j in (0, 1):
            assert sums[name, j + 1]["absolute"] == pytest.approx(np.abs(e[:, j]).sum()) and sums[name, j + 1]["n"] == n
    shares = {(g, f): v for g, f, v in grown.importances()}
    assert sum(shares["all", f] for f in groups["all"]) == pytest.approx(1) and shares["all", "still"] == 0 and shares["still", "still"] == 0 and shares["one", "a"] > 0.3


def test_forest_sends_bounded_sums(spark, monkeypatch):
    """Sums that are sent in several parts give the same trees."""
    r = np.random.default_rng(8)
    df = spark.createDataFrame([(i, *map(float, r.normal(size=3))) for i in range(150)], "id long, a double, b double, y double").repartition(3)
    make = lambda: forest.grow(df, "id", {"g": ["a", "b"]}, ["y"], forest.Growth(trees=4, depth=3, bins=6))
    want = make()
    monkeypatch.setattr(forest, "HELD_MB", 0)
    got = make()
    assert (want.feature == got.feature).all() and np.allclose(want.value, got.value)


def test_weights_are_poisson():
    w = forest.weights(np.arange(1, 200_001, dtype=np.int64) * 7919, 5, 7)
    assert abs(w.mean() - 1) < 0.02 and abs(w.var() - 1) < 0.03 and abs((w == 0).mean() - math.exp(-1)) < 0.01
    assert abs(np.corrcoef(w, forest.weights(np.arange(1, 200_001, dtype=np.int64) * 7919, 6, 7))[0, 1]) < 0.01


def test_rf_ablation(spark, table):
    """The query's forests, scored row by row: errors, and that they do better than the mean on what they were fitted to."""
    got = result(spark, "rf_ablation", "feature_group")
    how, train = forest.Growth(), plan.feature_table(spark, SF).where("split = 'source_train'")
    grown = forest.grow(train, "case_id", plan.GROUPS, plan.DELTAS, how)
    val, own = of(table, "source_val"), of(table, "source_train")
    bins, seen = (grown.binned(matrix(rows, grown.features)) for rows in (val, own))
    y, t = matrix(val, plan.DELTAS), matrix(own, plan.DELTAS)
    assert {g for (g,) in got} == set(plan.GROUPS)
    for g, name in enumerate(plan.GROUPS):
        check(got[name,], grown.predict(g, bins, how.depth), y)
        assert np.abs(grown.predict(g, seen, how.depth) - t).mean() < 0.75 * np.abs(t - t.mean(axis=0)).mean()
    shares = result(spark, "rf_importance", "feature_group", "feature")
    for g, f, v in grown.importances():
        assert shares[g, f]["importance"] == pytest.approx(v, abs=1e-6)


def test_flat_table_without_rows(spark):
    empty = plan.feature_table(spark, SF).where("case_id < 0")
    assert regress.grams(empty, plan.FEATURES, plan.DELTAS, "split") == {}
    assert regress.scored(empty, [regress.Model(("g",), "source_val", ["anchor_soh"], np.ones((1, 4)))], plan.DELTAS, "split").collect() == []
    grown = forest.grow(empty, "case_id", {"g": ["anchor_soh"]}, plan.DELTAS, forest.Growth(trees=2, depth=2))
    assert (grown.feature == -1).all() and (grown.value == 0).all()


def test_features_are_those_of_the_sql_to_the_last_digit(spark):
    """Halves at a result's last digit are not left to the noise of sums."""
    from pathlib import Path

    import duckdb

    from voltrail.catalog import ORACLES, QUERIES

    sf, con = "/root/testdata/sf0.01", duckdb.connect()
    for p in Path(sf).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    keys = ["cell_uid", "window_start"]
    got, want = (t.sort_values(keys).reset_index(drop=True) for t in (QUERIES["flat_table"](spark, sf).toPandas(), con.execute(ORACLES["flat_table"]).df()))
    numbers = [c for c in want.columns if want[c].dtype.kind == "f"]
    assert len(got) == len(want) > 1000
    for c in numbers:
        np.testing.assert_allclose(got[c].astype(float), want[c], rtol=1e-12, atol=0, err_msg=c)


def test_forest_moves_no_sums(spark):
    """What is shuffled does not grow with the rows times the nodes of all trees."""
    status = spark.sparkContext._jsc.sc().statusStore()
    moved = lambda: sum(status.executorList(False).apply(i).totalShuffleWrite() for i in range(status.executorList(False).size()))
    r = np.random.default_rng(5)
    df = spark.createDataFrame([(i, *map(float, r.normal(size=4))) for i in range(3000)], "id long, a double, b double, c double, y double").repartition(4)
    before = moved()
    forest.grow(df, "id", {"g": ["a", "b", "c"]}, ["y"], forest.Growth(trees=40, depth=6))
    spark.range(1).count()
    assert moved() - before < 1_000_000
