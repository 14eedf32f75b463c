"""Embeddings of cases and distances of pairs in numpy, as ``operators.retrieval`` has them on columns: rows are cases or pairs, columns the elements of their sequences."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyarrow import compute as pc


class Known(NamedTuple):
    """Numbers (0 where unknown), and whether they are known. NaN is a known number."""

    x: np.ndarray
    known: np.ndarray

    def take(self, at: np.ndarray) -> Known:
        return Known(self.x[at], self.known[at])

    def less(self, other: Known) -> Known:
        known = self.known & other.known
        return Known(np.where(known, self.x - other.x, 0.0), known)


def sequences(column: pa.Array | pa.ChunkedArray) -> Known:
    """Lists of numbers or booleans as rows of one width; what a shorter list lacks is unknown."""
    column = pa.chunked_array(column.chunks if isinstance(column, pa.ChunkedArray) else [column]).combine_chunks()
    sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    flat = column.flatten()
    x = np.zeros((len(sizes), int(sizes.max(initial=0))))
    known, there = np.zeros(x.shape, bool), np.arange(x.shape[1]) < sizes[:, None]
    known[there] = flat.is_valid().to_numpy(zero_copy_only=False)
    x[there] = pc.fill_null(flat.cast(pa.float64()), 0.0).to_numpy(zero_copy_only=False)
    return Known(x, known)


def differences(s: Known) -> Known:
    return Known(s.x[:, 1:], s.known[:, 1:]).less(Known(s.x[:, :-1], s.known[:, :-1]))


def centred(s: Known) -> Known:
    """Less the last known element."""
    last = s.known.shape[1] - 1 - np.argmax(s.known[:, ::-1], axis=1)
    return Known(np.where(s.known, s.x - s.x[np.arange(len(last)), last][:, None], 0.0), s.known)


def _total(x: np.ndarray, known: np.ndarray) -> np.ndarray:
    return np.where(known, x, 0.0).sum(axis=1)


def weighted_rmse(q: Known, r: Known, weights: Sequence[float], scale: float) -> np.ndarray:
    """1 if no element is known on both sides."""
    d, w = q.less(r), np.asarray(weights)
    d, t = Known(d.x / scale, d.known), np.where(d.known, w, 0.0).sum(axis=1)
    return np.where(t > 0, np.sqrt(_total(w * d.x * d.x, d.known) / np.maximum(t, 1e-6)), 1.0)


def masked_l2(q: Known, r: Known, scales: Sequence[float] | None = None) -> np.ndarray:
    """Root mean square of the scaled differences known on both sides, 1 if there are none; without scales relative to the larger side."""
    d = q.less(r)
    by = np.asarray(scales) if scales is not None else np.maximum(np.maximum(np.abs(q.x), np.abs(r.x)), 1e-4)
    x, n = np.where(d.known, d.x / by, 0.0), d.known.sum(axis=1)
    return np.where(n > 0, np.sqrt((x * x).sum(axis=1) / np.maximum(n, 1)), 1.0)


def curve_distance(q: Known, r: Known) -> np.ndarray:
    """Of two curves where both are known: the root mean square difference of their standardised shapes (.85) and the relative difference
    of their levels (.15); 1 if they share nothing."""
    known = q.known & r.known
    n = known.sum(axis=1)
    some = np.maximum(n, 1)
    mean = [_total(s.x, known) / some for s in (q, r)]
    apart = [np.where(known, s.x - m[:, None], 0.0) for s, m in zip((q, r), mean)]
    spread = [np.maximum(np.sqrt((d * d).sum(axis=1) / some), 1e-4) for d in apart]
    z = apart[0] / spread[0][:, None] - apart[1] / spread[1][:, None]
    largest = np.maximum.reduce([np.abs(mean[0]), np.abs(mean[1]), *spread, np.full(len(n), 1e-4)])
    return np.where(n > 0, 0.85 * np.sqrt((z * z).sum(axis=1) / some) + 0.15 * np.abs(mean[0] - mean[1]) / largest, 1.0)


def qv_distance(channels: Sequence[tuple[Known, Known, float]], q_stats: Known, r_stats: Known) -> np.ndarray:
    """The weighted mean of the distances of the channels that both have, and of their statistics, relative, with weight 1; 1 if they have nothing in common."""
    common = (q_stats.known & r_stats.known).any(axis=1)
    terms, weights = np.where(common, masked_l2(q_stats, r_stats), 0.0), np.where(common, 1.0, 0.0)
    for q, r, w in channels:
        common = q.known.any(axis=1) & r.known.any(axis=1)
        terms, weights = terms + np.where(common, w * curve_distance(q, r), 0.0), weights + np.where(common, w, 0.0)
    return np.where(weights > 0, terms / np.where(weights > 0, weights, 1.0), 1.0)


def differ(q: pa.Array, r: pa.Array) -> np.ndarray:
    """Whether two texts differ; not where one is null."""
    return pc.fill_null(pc.not_equal(q, r), False).to_numpy(zero_copy_only=False)


def composite(parts: Sequence[tuple[np.ndarray, float]]) -> np.ndarray:
    """Weighted mean of components that are all known."""
    return sum(w * x for x, w in parts if w > 0) / sum(w for _, w in parts if w > 0)


def _sum(x: np.ndarray) -> np.ndarray:
    """Of each row, element by element, as a fold over an array adds them."""
    out = np.zeros(len(x))
    for c in x.T:
        out += c
    return out


def resampled(s: Known, points: int) -> np.ndarray:
    """Linear interpolation of sequences of one length at so many equal steps; unknown elements are 0."""
    last = s.x.shape[1] - 1
    place = np.arange(points) * last / max(points - 1, 1) if points > 1 else np.zeros(1)
    low = np.floor(place).astype(int)
    return s.x[:, low] + (place - low) * (s.x[:, np.minimum(low + 1, last)] - s.x[:, low])


def summary(s: Known) -> np.ndarray:
    """Mean, population deviation and last of the known elements, zeros if there are none."""
    n = s.known.sum(axis=1)
    mean = _sum(s.x) / np.maximum(n, 1)
    apart = np.where(s.known, s.x - mean[:, None], 0.0)
    last = s.x[np.arange(len(n)), s.known.shape[1] - 1 - np.argmax(s.known[:, ::-1], axis=1)]
    return np.where(n[:, None] > 0, np.column_stack([mean, np.sqrt(_sum(apart * apart) / np.maximum(n, 1)), last]), 0.0)


def stage1_embedding(state: Known, history: Known, curve_stats: Known, stress: Known, others: Sequence[Known], points: int = 16) -> np.ndarray:
    """State, the resampled history less its last value, curve statistics, stress features, and summaries of sequences."""
    end = Known(np.repeat(history.x[:, -1:], history.x.shape[1], axis=1), np.repeat(history.known[:, -1:], history.x.shape[1], axis=1))
    return np.column_stack([state.x, resampled(history.less(end), points), curve_stats.x, stress.x, *map(summary, others)])
