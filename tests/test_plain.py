"""Queries without SQL against plain Python and numpy, row by row."""

from __future__ import annotations

import math
from collections import defaultdict

import numpy as np
import pytest

from voltrail.catalog import QUERIES
from voltrail.plans import retrieval_plans
from voltrail.sources.roles import cycles, raw_samples

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def raw(spark):
    """The samples of each cycle in order, as columns."""
    rows = raw_samples(spark, SF).orderBy("cell", "cycle", "sample").collect()
    held = defaultdict(list)
    for r in rows:
        held[r["cell"], r["cycle"]].append(r)
    return {k: {c: [r[c] for r in g] for c in rows[0].__fields__} for k, g in held.items()}


def result(spark, name, *keys):
    return {tuple(r[k] for k in keys): r.asDict() for r in QUERIES[name](spark, SF).collect()}


def same(x, y, places=2e-6):
    return (x is None and (y is None or math.isnan(y))) or (x is not None and y is not None and abs(x - y) <= places * max(1, abs(y)))


def interpolated(x, xs, ys):
    """Linear interpolation at one point within the ends."""
    for a, b, c, d in zip(xs, xs[1:], ys, ys[1:]):
        if a <= x <= b:
            return c + (d - c) * (x - a) / (b - a)
    raise ValueError(x)


def test_qv_map(spark, raw):
    got = result(spark, "qv_map", "cell", "cycle")
    assert got.keys() == raw.keys()
    firsts = {c: min(k for cc, k in raw if cc == c) for c, _ in raw}
    low, high, size = 2.8, 3.6, 100
    found = 0
    for (cell, cycle), g in raw.items():
        median = lambda c: [float(np.median(g[c][max(0, i - 2) : i + 3])) for i in range(len(g[c]))]
        v, i, q = median("voltage"), median("current"), median("capacity")
        hours = [x / 3600 if max(g["clock"]) > 200 else x for x in g["clock"]]
        use = [k for k in range(len(v)) if g["step"][k] == "discharge" and low <= v[k] <= high and not (cell % 4 == 3 and cycle == firsts[cell])]
        want = dict(peak_value=0, peak_voltage=0, area=0, capacity_span=0, voltage_min=low, voltage_max=high, power_proxy=0, available=0)
        rel = {k: abs(q[k] - q[use[0]]) for k in use}
        order = sorted(use, key=lambda k: (v[k], k))
        xs = sorted({v[k] for k in use})
        if len(use) >= 4 and len(xs) >= 4 and xs[-1] - xs[0] >= 1e-3:
            ys = [rel[min(k for k in use if v[k] == x)] for x in xs]
            grid = [low + (high - low) * j / (size - 1) for j in range(size)]
            curve = [interpolated(x, xs, ys) if xs[0] <= x <= xs[-1] else None for x in grid]
            there = [j for j, y in enumerate(curve) if y is not None]
            if len(there) >= 4:
                found += 1
                full = [curve[min(max(j, there[0]), there[-1])] for j in range(size)]
                slope = np.abs([(full[min(j + 1, size - 1)] - full[max(j - 1, 0)]) / (grid[min(j + 1, size - 1)] - grid[max(j - 1, 0)]) for j in range(size)])
                slope = np.minimum(slope, np.quantile(slope, 0.99))
                top = int(np.argmax(slope))
                proxy = sum(abs(v[k] * i[k]) * max(0, hours[k] - hours[b]) for b, k in zip(order, order[1:]))
                area = sum((slope[j] + slope[j + 1]) / 2 * (grid[j + 1] - grid[j]) for j in range(size - 1))
                want |= dict(peak_value=slope[top], peak_voltage=grid[top], area=area, capacity_span=max(rel.values()) - min(rel.values()), power_proxy=proxy, available=1)
        for k, x in want.items():
            if k != "peak_voltage" or want["available"] == 0 or same(got[cell, cycle]["qv_" + k], x):  # equal peaks may stand elsewhere
                assert same(got[cell, cycle]["qv_" + k], x), (cell, cycle, k)
    assert found > 20


def test_partial_charge(spark, raw):
    got = result(spark, "partial_charge", "cell", "cycle")
    assert got.keys() == raw.keys()
    for key, g in raw.items():
        use = [k for k, s in enumerate(g["step"]) if "charge" in s and "discharge" not in s]
        minutes = [(x - g["clock"][0]) / 60 for x in g["clock"]]
        total, q = 0.0, {}
        for b, k in zip([use[0] if use else 0, *use], use):
            total += abs(g["current"][k]) * max(0, minutes[k] - minutes[b]) / 60
            q.setdefault(g["voltage"][k], total)
        xs = sorted(q)
        enough = len(use) >= 3 and len(xs) >= 3 and xs[-1] - xs[0] >= 5e-3
        assert same(got[key]["charge"], q[xs[-1]] - q[xs[0]] if enough else None) and got[key]["points"] == (50 if enough else None)


def plain_dqdv(g, least=10, step=0.002):
    says = any("charge" in (s or "").lower() for s in g["step"])
    use = [k for k in range(len(g["step"])) if g["current"][k] > 0 and (not says or "charge" in g["step"][k].lower())]
    if not use:
        return None
    bins = defaultdict(list)
    low = min(g["capacity"][k] for k in use)
    for k in use:
        bins[round(g["voltage"][k] / step)].append((g["voltage"][k], g["capacity"][k] - low))
    if len(bins) < least:
        return None
    points = sorted((sum(v for v, _ in b) / len(b), float(np.median([q for _, q in b]))) for b in bins.values())
    xs, ys = [p[0] for p in points], [p[1] for p in points]
    grid = [xs[0] + (xs[-1] - xs[0]) * j / 299 for j in range(300)]
    mean = lambda z: [sum(z[max(0, j - 5) : j + 6]) / len(z[max(0, j - 5) : j + 6]) for j in range(len(z))]
    flat = mean([interpolated(min(max(x, xs[0]), xs[-1]), xs, ys) for x in grid])
    d = [(flat[min(j + 1, 299)] - flat[max(j - 1, 0)]) / (grid[min(j + 1, 299)] - grid[max(j - 1, 0)]) for j in range(300)]
    d = mean(d)
    limit = float(np.quantile(np.abs(d), 0.995))
    return grid, [max(-limit, min(limit, x)) for x in d]


def test_charge_dqdv_and_distances(spark, raw):
    curves = {k: plain_dqdv(g) for k, g in raw.items()}
    got = result(spark, "charge_dqdv", "cell", "cycle")
    assert got.keys() == raw.keys() and sum(c is not None for c in curves.values()) > 10
    for k, c in curves.items():
        assert got[k]["points"] == (None if c is None else 300) and same(got[k]["peak"], None if c is None else max(c[1]), 1e-5)
    apart = result(spark, "dqdv_distance", "cell", "cycle")
    assert apart.keys() == {(a, b) for a, b in raw if (a, b + 1) in raw}

    def distance(x, y, least=None):
        if least is not None and x and y:
            x, y = ([[v for v, _ in p], [d for _, d in p]] if len(p := [(v, d) for v, d in zip(*c) if v >= least]) >= 20 else None for c in (x, y))
        if x is None or y is None:
            return None
        low, high = max(x[0][0], y[0][0], least or 0), min(x[0][-1], y[0][-1])
        if high - low <= 0.05:
            return None
        total = 0.0
        for j in range(240):
            at = low + (high - low) * j / 239
            a, b = (float(np.interp(at, *c)) for c in (x, y))
            total += ((a - b) / max(abs(a), abs(b), 1e-4)) ** 2
        return math.sqrt(total / 240)

    for (cell, cycle), r in apart.items():
        x, y = curves[cell, cycle], curves[cell, cycle + 1]
        assert same(r["whole"], distance(x, y), 1e-4) and same(r["high"], distance(x, y, 3.2), 1e-4)


def test_map_dqdv(spark, raw):
    """The stored voltages are the grid from 2.8 to 3.6, so from 3.2 on the derivative of the share of columns is 1 / .8."""
    got, maps = result(spark, "map_dqdv", "cell", "cycle"), result(spark, "qv_map", "cell", "cycle")
    for k, r in got.items():
        assert (r["points"], r["peak"]) == (None, None) if not maps[k]["qv_available"] else r["points"] == 50 and same(r["peak"], 1 / 0.8, 1e-3)


def test_spectral_entropy(spark):
    got = result(spark, "spectral_entropy", "cell_uid", "cycle_idx")
    rows = defaultdict(list)
    for r in cycles(spark, SF).orderBy("cell_uid", "cycle_idx").collect():
        rows[r["cell_uid"]].append(r)
    for cell, series in rows.items():
        for at, r in enumerate(series):
            for c in ("voltage_mean", "temp_mean"):
                x = [s[c] for s in series[max(0, at - 15) : at + 1] if s[c] is not None]
                entropy = low = None
                if len(x) >= 8:
                    n, m = len(x), sum(x) / len(x)
                    power = [abs(sum((y - m) * complex(math.cos(2 * math.pi * f * t / n), -math.sin(2 * math.pi * f * t / n)) for t, y in enumerate(x))) ** 2 for f in range(1, n // 2 + 1)]
                    total = sum(power)
                    if total >= 1e-12:
                        entropy = -sum(p / total * math.log(p / total + 1e-12) for p in power) / math.log(len(power))
                        low = sum(power[: max(1, len(power) // 3)]) / total
                own = got[cell, r["cycle_idx"]]
                assert same(own[f"{c}_entropy"], entropy) and same(own[f"{c}_low_ratio"], low)


def test_life_rmse(spark):
    lives = defaultdict(list)
    for r in cycles(spark, SF).where("capacity IS NOT NULL").orderBy("cell_uid", "cycle_idx").collect():
        lives[r["cell_uid"]].append(r["capacity"])
    got = result(spark, "life_rmse", "a", "b")
    names = sorted(lives)
    assert set(got) == {(a, b) for a in names for b in names if int(b[5:]) == int(a[5:]) + 1}
    for (a, b), r in got.items():
        x, y = ([v / s[0] for v in s] for s in (lives[a], lives[b]))
        at = lambda s, j: float(np.interp(j / 399 * (len(s) - 1), range(len(s)), s))
        assert same(r["rmse"], math.sqrt(sum((at(x, j) - at(y, j)) ** 2 for j in range(400)) / 400))


def test_mmr_select(spark):
    pairs = defaultdict(list)
    for r in retrieval_plans.pairs_of(spark, SF).select("query", "ref", "distance", "r_cell", "r_vector").collect():
        pairs[r["query"]].append(r)
    got = defaultdict(list)
    for r in QUERIES["mmr_select"](spark, SF).orderBy("query", "rank").collect():
        got[r["query"]].append(r["ref"])
    assert got.keys() == pairs.keys()
    unit = lambda v: np.array(v) / max(np.linalg.norm(v), 1e-12)
    for q, rows in pairs.items():
        chosen = []
        while len(chosen) < 5:
            free = [r for r in rows if r not in chosen and sum(c["r_cell"] == r["r_cell"] for c in chosen) < 2]
            score = lambda r: -0.75 * r["distance"] - 0.25 * max((float(unit(r["r_vector"]) @ unit(c["r_vector"])) for c in chosen), default=0)
            chosen.append(max(free, key=lambda r: (round(score(r), 12), -r["distance"], -r["ref"])))
        assert got[q] == [c["ref"] for c in chosen]
