"""Robust consensus of point correspondences, for one image pair at a time (NumPy, no Spark).

Samples are drawn in order of confidence from a pool that widens until it holds all points
(so good matches are tried first), each solved exactly and scored on all points. A new best
is refined on the spot by weighted least squares. The search stops when samples so far would
have met an all-inlier one with the confidence asked for, or at ``most`` samples.

Similarities are scored by the number of points within the threshold. Homographies are
scored over all thresholds up to the given one at once: the mean over t in (0, T] of a
point's truncated quadratic gain max(0, 1 - (r / t)^2) is (1 - r / T)^2, so no single noise
level is assumed.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np

#: Samples at most, and the confidence that one of them was all inliers.
MOST, CONFIDENCE = 5000, 0.9999
#: Samples scored at a time, and residuals held at a time.
BATCH, CELLS = 256, 1 << 19


def pool_sizes(n: int, m: int, most: int) -> np.ndarray:
    """For each of ``most`` samples of m, how many of the most confident n points it may use.

    A pool of k points lasts for as many samples as uniform samples of all points would
    fall into it.
    """
    k = np.arange(m, n + 1)
    expected = most * np.prod([(k - i) / (n - i) for i in range(m)], axis=0)
    last = np.cumsum(np.concatenate([[1], np.maximum(np.ceil(np.diff(expected)), 1)]))
    return np.minimum(m + np.searchsorted(last, np.arange(most), "right"), n)


def draw(rng: np.random.Generator, pools: np.ndarray, n: int, m: int) -> np.ndarray:
    """A sample of m different points for each pool: its newest point and m - 1 others, or any m where the pool holds all n."""
    out = np.empty((len(pools), m), np.int64)
    newest = pools < n
    for i in range(m):
        free = np.where(newest, pools - 1, pools) - i
        x = np.floor(rng.random(len(pools)) * np.maximum(free, 1)).astype(np.int64)
        # The x-th of the points not taken yet.
        for taken in np.sort(out[:, :i], axis=1).T:
            x += x >= taken
        out[:, i] = x
    out[newest, m - 1] = pools[newest] - 1
    return out


def search(n: int, m: int, solve: Callable, residuals: Callable, fit: Callable, gain: Callable, threshold: float, seed: int, most: int = MOST, confidence: float = CONFIDENCE, rough: Callable | None = None) -> tuple[np.ndarray | None, np.ndarray, int]:
    """(model, inliers, samples) of n points in falling confidence; no model where none has m inliers.

    ``solve(samples)`` gives models (NaN: none), ``residuals(models)`` their distances at
    all points, ``fit(weights)`` the weighted least-squares model, ``gain(r)`` what a point
    at distance r adds to a score. ``rough(models)``, if given, are their scores within
    1e-6 by a cheaper way: models that it puts below the best are not scored again.
    """
    rng = np.random.default_rng(seed)
    pools = pool_sizes(n, m, most)
    best, score, inliers = None, 0.0, np.zeros(n, bool)
    needed, used = most, 0
    while used < min(needed, most):
        models = solve(draw(rng, pools[used : used + BATCH], n, m))
        used += len(models)
        step = max(1, CELLS // n)
        if rough is not None:
            near = np.concatenate([rough(models[i : i + step]) for i in range(0, len(models), step)])
            # Samples that are worse than the best of their batch or of those before can't win.
            models = models[near > max(score, float(near.max())) - 1e-5]
            if not len(models):
                continue
        scores = np.concatenate([gain(residuals(models[i : i + step])).sum(axis=1) for i in range(0, len(models), step)])
        i = int(np.argmax(scores))
        if scores[i] <= score:
            continue
        model, now = models[i], float(scores[i])
        for _ in range(10):
            r = residuals(model[None])[0]
            again = fit(gain(r))
            if again is None:
                break
            value = float(gain(residuals(again[None])[0]).sum())
            if value <= now:
                break
            model, now = again, value
        best, score = model, now
        inliers = residuals(best[None])[0] < threshold
        share = min(inliers.mean(), 1 - 1e-9) ** m
        needed = math.ceil(math.log(1 - confidence) / math.log1p(-share)) if share > 0 else most
    return (best, inliers, used) if inliers.sum() >= m else (None, np.zeros(n, bool), used)


def similarity(p: np.ndarray, q: np.ndarray, threshold: float, seed: int, most: int = MOST, confidence: float = CONFIDENCE) -> tuple[np.ndarray | None, np.ndarray, int]:
    """((a, b, tx, ty), inliers, samples): u = a x - b y + tx, v = b x + a y + ty. Points in falling confidence."""
    z, t = p[:, 0] + 1j * p[:, 1], q[:, 0] + 1j * q[:, 1]

    def solve(i):
        d = z[i[:, 0]] - z[i[:, 1]]
        ok = np.abs(d) > 1e-9
        s = np.where(ok, (t[i[:, 0]] - t[i[:, 1]]) / np.where(ok, d, 1), np.nan)
        return np.stack([s, t[i[:, 0]] - s * z[i[:, 0]]], axis=1)

    def residuals(models):
        return np.nan_to_num(np.abs(models[:, :1] * z + models[:, 1:] - t), nan=np.inf)

    def fit(w):
        total = w.sum()
        if (w > 0).sum() < 2:
            return None
        zm, tm = (w * z).sum() / total, (w * t).sum() / total
        den = (w * np.abs(z - zm) ** 2).sum()
        if den < 1e-12:
            return None
        s = (w * (z - zm).conj() * (t - tm)).sum() / den
        return np.array([s, tm - s * zm])

    model, inliers, used = search(len(z), 2, solve, residuals, fit, lambda r: (r < threshold).astype(float), threshold, seed, most, confidence)
    return (None if model is None else np.array([model[0].real, model[0].imag, model[1].real, model[1].imag])), inliers, used


def homography(p: np.ndarray, q: np.ndarray, threshold: float, seed: int, most: int = MOST, confidence: float = CONFIDENCE) -> tuple[np.ndarray | None, np.ndarray, int]:
    """(h row by row with h[8] = 1, inliers, samples). Points in falling confidence."""
    scale = max(float(np.abs(np.concatenate([p, q])).max()), 1.0)
    x, y, u, v = *(p / scale).T, *(q / scale).T

    def rows(x, y, u, v):
        o, z = np.ones_like(x), np.zeros_like(x)
        a = np.concatenate([np.stack([x, y, o, z, z, z, -u * x, -u * y], -1), np.stack([z, z, z, x, y, o, -v * x, -v * y], -1)], axis=-2)
        return a, np.concatenate([u, v], axis=-1)

    def solve(i):
        a, b = rows(x[i], y[i], u[i], v[i])
        out = np.full((len(i), 9), np.nan)
        ok = np.abs(np.linalg.det(a)) > 1e-14
        if ok.any():
            out[ok, :8] = np.linalg.solve(a[ok], b[ok][..., None])[..., 0]
            out[ok, 8] = 1.0
        return out

    def residuals(h):
        with np.errstate(all="ignore"):
            w = h[:, 6:7] * x + h[:, 7:8] * y + 1
            du = (h[:, 0:1] * x + h[:, 1:2] * y + h[:, 2:3]) / w - u
            dv = (h[:, 3:4] * x + h[:, 4:5] * y + h[:, 5:6]) / w - v
            r = np.sqrt(du * du + dv * dv) * scale
        return np.where(np.isfinite(r), r, np.inf)

    def fit(w):
        on = w > 0
        if on.sum() < 4:
            return None
        a, b = rows(x[on], y[on], u[on], v[on])
        s = np.sqrt(np.tile(w[on], 2))
        h, _, rank, _ = np.linalg.lstsq(a * s[:, None], b * s, rcond=1e-12)
        return np.append(h, 1.0) if rank == 8 else None

    def gain(r):
        return np.square(np.clip(1 - r / threshold, 0, None))

    xy1, most_far = np.stack([x, y, np.ones_like(x)]), (threshold / scale) ** 2

    def rough(h):
        # Without quotients or roots, which only the few points near a model need.
        with np.errstate(all="ignore"):
            w = h[:, 6:9] @ xy1
            du, dv = h[:, 0:3] @ xy1, h[:, 3:6] @ xy1
            du -= u * w
            dv -= v * w
            du *= du
            dv *= dv
            du += dv
            w *= w
            at = np.flatnonzero(du < w * most_far)
            r = np.sqrt(du.ravel()[at] / w.ravel()[at]) * scale
        return np.bincount(at // len(x), weights=gain(r), minlength=len(h))

    model, inliers, used = search(len(x), 4, solve, residuals, fit, gain, threshold, seed, most, confidence, rough)
    return (None if model is None else model * np.array([1, 1, scale, 1, 1, scale, 1 / scale, 1 / scale, 1])), inliers, used
