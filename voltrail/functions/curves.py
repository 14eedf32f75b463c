"""Vectorised helpers for one cycle's samples: spectra of windows and voltage-indexed curves."""

from __future__ import annotations

import numpy as np


def spectral(windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Normalised spectral entropy and share of low frequencies of each window (a row); NaN where there is too little."""
    x = windows - windows.mean(axis=1, keepdims=True)
    power = np.abs(np.fft.rfft(x, axis=1))[:, 1:] ** 2
    total = power.sum(axis=1)
    bins = power.shape[1]
    with np.errstate(invalid="ignore", divide="ignore"):
        p = power / total[:, None]
        entropy = -(p * np.log(p + 1e-12)).sum(axis=1) / np.log(bins) if bins > 1 else np.full(len(x), np.nan)
        low = power[:, : max(1, bins // 3)].sum(axis=1) / total
    few = (total < 1e-12) | (windows.shape[1] < 4)
    return np.where(few, np.nan, entropy), np.where(few, np.nan, low)


def smooth(x: np.ndarray, window: int = 5) -> np.ndarray:
    """Centred rolling median of what is known."""
    half = window // 2
    padded = np.concatenate([np.full(half, np.nan), x, np.full(half, np.nan)])
    views = np.lib.stride_tricks.sliding_window_view(padded, 2 * half + 1)
    ordered, known, row = np.sort(views, axis=1), (~np.isnan(views)).sum(axis=1), np.arange(len(x))  # unknown ones come last
    return (ordered[row, np.maximum(known - 1, 0) // 2] + ordered[row, np.minimum(known // 2, window - 1)]) / 2


CHANNELS = ("voltage", "q", "dqdv", "current", "temperature", "power")
STATS = ("peak_value", "peak_voltage", "area", "capacity_span", "voltage_min", "voltage_max", "power_proxy", "available")


def discharge_map(hours, voltage, current, capacity, temperature, discharging, low: float, high: float, size: int = 100, clip: float = 0.99) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Channels on a voltage grid (zeros where unknown), their masks, and statistics, of the discharge within a window.

    Where there is too little, all are zero but for the window's bounds. The power proxy sums all samples of the window in
    order of their voltage, as they are before equal voltages are merged.
    """
    empty = np.zeros((len(CHANNELS), size)), np.zeros(len(CHANNELS)), np.array([0, 0, 0, 0, low, high, 0, 0], float)
    if len(voltage) == 0:
        return empty
    v, i, t, q = (smooth(np.asarray(x, float)) for x in (voltage, current, temperature, capacity))
    keep = np.asarray(discharging, bool) & (v >= low) & (v <= high) & np.isfinite(v) & np.isfinite(i) & np.isfinite(q)
    if keep.sum() < 4:
        return empty
    v, i, t, q, clock = v[keep], i[keep], t[keep], q[keep], np.asarray(hours, float)[keep]
    q = np.abs(q - q[0])
    span = q.max() - q.min()
    order = np.argsort(v, kind="stable")
    v, i, t, q, clock = (x[order] for x in (v, i, t, q, clock))
    proxy = float(np.nansum(np.abs(v * i) * np.diff(clock, prepend=clock[0]).clip(0)))
    v, first = np.unique(v, return_index=True)
    i, t, q = (x[first] for x in (i, t, q))
    if len(v) < 4 or v[-1] - v[0] < 1e-3:
        return empty
    grid = np.linspace(low, high, size)
    on = lambda y: np.interp(grid, v, y, left=np.nan, right=np.nan)
    curve = on(q)
    known = np.isfinite(curve)
    if known.sum() < 4:
        return empty
    filled = np.interp(np.arange(size), np.flatnonzero(known), curve[known])
    slope = np.abs(np.gradient(filled, grid))
    limit = np.quantile(slope, clip)
    slope = np.minimum(slope, limit) if limit > 0 else slope
    channels = np.stack([grid, curve, slope, on(np.abs(i)), on(t) if np.isfinite(t).all() else np.full(size, np.nan), on(np.abs(v * i))])
    top = int(np.argmax(slope))
    stats = np.array([slope[top], grid[top], np.trapezoid(slope, grid), span, low, high, proxy, 1.0])
    return np.nan_to_num(channels), np.isfinite(channels).any(axis=1).astype(float), stats


def partial_charge(minutes, voltage, current, charging, size: int = 50) -> np.ndarray | None:
    """Charge taken in, on a grid over the charged voltages, from zero; None where there is too little."""
    t, v, i = (np.asarray(x, float) for x in (minutes, voltage, current))
    charging = np.asarray(charging, bool)
    keep = charging & np.isfinite(v) & np.isfinite(i) & np.isfinite(t)
    if keep.sum() < 3:
        return None
    t, v, i = t[keep], v[keep], i[keep]
    q = np.cumsum(np.abs(i) * np.diff(t, prepend=t[0]).clip(0) / 60)
    order = np.argsort(v, kind="stable")
    v, first = np.unique(v[order], return_index=True)
    q = q[order][first]
    if len(v) < 3 or v[-1] - v[0] < 5e-3:
        return None
    out = np.interp(np.linspace(v[0], v[-1], size), v, q)
    return out - out[0]


def rolling_mean(x: np.ndarray, window: int) -> np.ndarray:
    """Centred mean of what there is; a window has half its width, rounded down, after its middle."""
    half = window // 2
    sums = np.concatenate([[0.0], np.cumsum(x)])
    low, high = np.maximum(np.arange(len(x)) - half, 0), np.minimum(np.arange(len(x)) + (window - 1) // 2 + 1, len(x))
    return (sums[high] - sums[low]) / (high - low)


def _derived(y: np.ndarray, x: np.ndarray, window: int, clip: float = 0.995) -> np.ndarray:
    """The smoothed derivative of smoothed y, cut at a quantile of its size."""
    out = rolling_mean(np.gradient(rolling_mean(y, min(window, len(x))), x), min(window, len(x)))
    limit = np.quantile(np.abs(out), clip)
    return out.clip(-limit, limit) if limit > 0 else out


def charge_dqdv(voltage, capacity, charging, step: float = 0.002, least: int = 25, points: int = 300, window: int = 11) -> tuple[np.ndarray, np.ndarray] | None:
    """Voltages and dQ/dV of a charge: mean voltage and median capacity of bins, interpolated, smoothed, derived. None where
    there is too little."""
    v, q = np.asarray(voltage, float), np.asarray(capacity, float)
    keep = np.asarray(charging, bool) & np.isfinite(v) & np.isfinite(q)
    if not keep.any():
        return None
    v, q = v[keep], q[keep] - q[keep].min()
    bins, of = np.unique(np.round(v / step), return_inverse=True)
    if len(bins) < least:
        return None
    order = np.lexsort((q, of))
    sizes = np.bincount(of)
    begin = np.cumsum(sizes) - sizes
    sorted_q = q[order]
    middle = (sorted_q[begin + (sizes - 1) // 2] + sorted_q[begin + sizes // 2]) / 2
    v = np.bincount(of, v) / sizes
    if np.ptp(v) <= 1e-3 or np.ptp(middle) <= 1e-6:
        return None
    grid = np.linspace(v.min(), v.max(), points)
    return grid, _derived(np.interp(grid, v, middle), grid, window)


def above(curve: tuple[np.ndarray, np.ndarray] | None, least: float, points: int = 20) -> tuple[np.ndarray, np.ndarray] | None:
    """The part of a curve from a voltage on; None if it has too few points."""
    if curve is None:
        return None
    v, y = curve
    keep = np.isfinite(v) & np.isfinite(y) & (v >= least)
    return (v[keep], y[keep]) if keep.sum() >= points else None


def map_dqdv(voltage, least: float = 3.2, points: int = 20) -> tuple[np.ndarray, np.ndarray] | None:
    """dQ/dV from the voltages of a stored map whose columns are equal shares of the charge."""
    v = np.asarray(voltage, float)
    share = np.linspace(0, 1, len(v))
    keep = np.isfinite(v) & (v >= least)
    if keep.sum() < points:
        return None
    order = np.argsort(v[keep], kind="stable")
    v, first = np.unique(v[keep][order], return_index=True)
    if len(v) < points:
        return None
    return v, _derived(share[keep][order][first], v, 9)


def dqdv_distance(v1, d1, v2, d2, least: float | None = None, size: int = 240) -> float:
    """Root mean square of the differences of two curves on their common voltages, each relative to the larger of both
    there; NaN if they share too little."""
    low, high = max(v1[0], v2[0]), min(v1[-1], v2[-1])
    if least is not None:
        low = max(low, least)
    if not high - low > 0.05:
        return float("nan")
    grid = np.linspace(low, high, size)
    a, b = np.interp(grid, v1, d1), np.interp(grid, v2, d2)
    return float(np.sqrt(np.mean(((a - b) / np.maximum(np.maximum(np.abs(a), np.abs(b)), 1e-4)) ** 2)))


def life_rmse(a, b, size: int = 400, least: int = 10) -> float:
    """Root mean square of two lives on a normalised axis; NaN if one is short."""
    a, b = (np.asarray(x, float) for x in (a, b))
    if min(len(a), len(b)) < least:
        return float("nan")
    on = lambda x: np.interp(np.linspace(0, 1, size), np.linspace(0, 1, len(x)), x)
    return float(np.sqrt(np.mean((on(a) - on(b)) ** 2)))
