"""Waveform distances, each over all pairs of a batch at once: arrays of shape (pairs, points)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.config import CostWeights


def z_scores(v: np.ndarray) -> np.ndarray:
    """Each row less its mean, over its population deviation; zeros where that is below 1e-6."""
    std = v.std(axis=1, keepdims=True)
    return np.where(std < 1e-6, 0.0, (v - v.mean(axis=1, keepdims=True)) / np.where(std < 1e-6, 1.0, std))


def segment_medians(v: np.ndarray, segment: int, steps: int) -> np.ndarray:
    """Medians of consecutive segments; one that begins past the end has the median of the whole row."""
    cut = [v[:, k * segment : (k + 1) * segment] for k in range(steps)]
    return np.stack([np.median(c if c.shape[1] else v, axis=1) for c in cut], axis=1)


def banded_dtw(x: np.ndarray, y: np.ndarray, band: int) -> np.ndarray:
    """Squared-difference warping cost inside a band of the diagonal."""
    p, n = x.shape
    far = np.full(p, 1e18)
    before = {0: np.zeros(p)}
    for i in range(1, n + 1):
        now: dict[int, np.ndarray] = {}
        for j in range(max(1, i - band), min(n, i + band) + 1):
            least = np.minimum(np.minimum(before.get(j, far), now.get(j - 1, far)), before.get(j - 1, far))
            now[j] = (x[:, i - 1] - y[:, j - 1]) ** 2 + least
        before = now
    return before[n]


def path_dtw(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Absolute-difference warping cost over the steps of its path; values as float32. Of equal ways back the diagonal goes first, then up.

    The way back from a cell depends on its neighbours alone, so the number of steps is carried along with the cost.
    """
    x, y = x.astype(np.float32).astype(np.float64), y.astype(np.float32).astype(np.float64)
    p, n = x.shape
    m = y.shape[1]
    cost, steps = np.full((m + 1, p), np.inf), np.tile(np.arange(m + 1.0)[:, None], (1, p))
    cost[0] = 0
    for i in range(1, n + 1):
        new, way = np.full((m + 1, p), np.inf), np.full((m + 1, p), float(i))
        for j in range(1, m + 1):
            diagonal, up, left = cost[j - 1], cost[j], new[j - 1]
            least = np.minimum(np.minimum(diagonal, up), left)
            new[j] = np.abs(x[:, i - 1] - y[:, j - 1]) + least
            way[j] = 1 + np.where(diagonal == least, steps[j - 1], np.where(up == least, steps[j], way[j - 1]))
        cost, steps = new, way
    return cost[m] / steps[m]


def correlations(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Pearson's correlation, 0 where a deviation is 1e-8 or less or a row has one point, clipped to -1..1."""
    dx, dy = x - x.mean(axis=1, keepdims=True), y - y.mean(axis=1, keepdims=True)
    sx, sy = x.std(axis=1), y.std(axis=1)
    ok = (sx > 1e-8) & (sy > 1e-8) & (x.shape[1] > 1)
    return np.clip(np.where(ok, (dx * dy).mean(axis=1) / np.where(ok, sx * sy, 1.0), 0.0), -1.0, 1.0)


def terms(e: np.ndarray, s: np.ndarray, w: CostWeights) -> dict[str, np.ndarray]:
    """The parts of the waveform cost: banded warping over the points, step medians, mean gap."""
    steps = np.abs(segment_medians(e, w.segment, w.steps) - segment_medians(s, w.segment, w.steps)).mean(axis=1)
    return {"dtw": banded_dtw(z_scores(s), z_scores(e), w.band) / e.shape[1], "step": steps, "mean": np.abs(e.mean(axis=1) - s.mean(axis=1))}


def waveform_cost(e: np.ndarray, s: np.ndarray, w: CostWeights) -> np.ndarray:
    t = terms(e, s, w)
    return w.dtw * t["dtw"] + w.step * t["step"] + w.mean * t["mean"]


def coarse_cost(e: np.ndarray, s: np.ndarray, w: CostWeights) -> np.ndarray:
    steps = np.abs(segment_medians(e, w.segment, w.steps) - segment_medians(s, w.segment, w.steps)).mean(axis=1)
    return 0.95 * steps + 0.05 * np.abs(e.mean(axis=1) - s.mean(axis=1))


def over_pairs(es, ss, names: list[str], f: Callable[[np.ndarray, np.ndarray], dict[str, np.ndarray]], min_shared: int = 1) -> pd.DataFrame:
    """f over pairs of rows, each cut down to the places where both sides are known; null with fewer than min_shared.

    Pairs that keep the same number of points go through f together.
    """
    out = pd.DataFrame(np.nan, index=range(len(es)), columns=names)
    groups: dict[int, list] = {}
    for i, (e, s) in enumerate(zip(es, ss, strict=True)):
        if e is None or s is None:
            continue
        e, s = np.asarray(e, dtype=np.float64), np.asarray(s, dtype=np.float64)
        n = min(len(e), len(s))
        ok = np.isfinite(e[:n]) & np.isfinite(s[:n])
        if ok.sum() >= max(min_shared, 1):
            groups.setdefault(int(ok.sum()), []).append((i, e[:n][ok], s[:n][ok]))
    for rows in groups.values():
        at = [r[0] for r in rows]
        for name, x in f(np.stack([r[1] for r in rows]), np.stack([r[2] for r in rows])).items():
            out.loc[at, name] = x
    return out


def cost_column(e: str, s: str, w: CostWeights | None = None, min_shared: int = 4) -> Column:
    """The waveform cost of two array columns; null with too few shared points."""
    w = w or CostWeights()

    @F.pandas_udf("double")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for es, ss in batches:
            yield over_pairs(es, ss, ["c"], lambda x, y: {"c": waveform_cost(x, y, w)}, min_shared)["c"]

    return F.nanvl(run(F.col(e), F.col(s)), F.lit(None))


def terms_column(e: str, s: str, w: CostWeights | None = None, min_shared: int = 4) -> Column:
    """struct(dtw, step, mean, corr, path) of two array columns; nulls with too few shared points."""
    w = w or CostWeights()

    @F.pandas_udf("dtw double, step double, mean double, corr double, path double, coarse double")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for es, ss in batches:
            yield over_pairs(es, ss, ["dtw", "step", "mean", "corr", "path", "coarse"], lambda x, y: terms(x, y, w) | {"corr": correlations(x, y), "path": path_dtw(x, y), "coarse": coarse_cost(x, y, w)}, min_shared)

    return run(F.col(e), F.col(s))
