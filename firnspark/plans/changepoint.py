"""Exact posterior of changepoints in a series: segment likelihoods, then a forward and a backward pass.

For a segment t..s with likelihood P(t, s) and a constant prior g on its length, Q(t) sums over
where the segment that starts at t may end, and F(t) over how the series may come to end a segment at
t; a changepoint after t has probability F(t) Q(t+1) / Q(1). O(n^2) in all, in logarithms.
"""

from __future__ import annotations

import math

import numpy as np


def log_gamma_halves(n: int) -> np.ndarray:
    """ln Gamma(k / 2) for k = 1 .. n (index k), by the recurrence."""
    out = np.zeros(max(3, n + 1))
    out[1], out[2] = 0.5 * math.log(math.pi), 0.0
    for k in range(3, len(out)):
        out[k] = out[k - 2] + math.log((k - 2) / 2)
    return out


def _sums(x: np.ndarray) -> np.ndarray:
    return np.concatenate([np.zeros((1, *x.shape[1:])), np.cumsum(x, axis=0)])


#: Numbers a block of segment statistics may hold.
BLOCK = 1 << 21


def _spans(x: np.ndarray, width: int):
    """Blocks of first samples t, with lengths m and mask ok of all segments t..s: arrays of shape (t, s)."""
    n = len(x)
    step = max(1, BLOCK // max(1, n * width))
    for lo in range(0, n, step):
        t = np.arange(lo, min(n, lo + step))
        length = np.arange(1, n + 1)[None, :] - t[:, None]
        yield t, np.maximum(length, 1), length > 0


def gaussian(x: np.ndarray) -> np.ndarray:
    """ln P(t, s) of a normal with unknown mean and variance (normal-inverse-gamma of one weak observation).

    The series is brought to mean 0 and variance 1 first, so the prior suits any unit.
    """
    y = x[:, 0] - x[:, 0].mean()
    y = y / (y.std() or 1.0)
    n = len(y)
    s1, s2 = _sums(y), _sums(y * y)
    lg = log_gamma_halves(n + 3)
    out = np.full((n, n), -np.inf)
    for t, m, ok in _spans(x, 1):
        total, square = s1[None, 1:] - s1[t, None], s2[None, 1:] - s2[t, None]
        scatter = square - total**2 / m + (m / (m + 1)) * (total / m) ** 2
        value = -m / 2 * math.log(math.pi) + lg[m + 1] - lg[1] - 0.5 * np.log1p(m) - (m + 1) / 2 * np.log1p(np.maximum(scatter, 0))
        out[t] = np.where(ok, value, -np.inf)
    return out


def _scale(x: np.ndarray, t: np.ndarray, m: np.ndarray, ok: np.ndarray) -> np.ndarray:
    """Prior scale of each segment: the variance of all its entries about their common mean.

    Channels have different levels, so even one sample has a spread. Where it has none, a small share of
    the whole series' variance stands in, which keeps every matrix below positive whatever the unit.
    """
    n, d = x.shape
    middle = x.mean()
    total, square = _sums((x - middle).sum(axis=1)), _sums(((x - middle) ** 2).sum(axis=1))
    whole = square[-1] / (n * d) or 1.0
    v = (square[None, 1:] - square[t, None]) / (m * d) - ((total[None, 1:] - total[t, None]) / (m * d)) ** 2
    return np.where(ok, np.maximum(v, 1e-9 * whole), 1.0)


def independent(x: np.ndarray) -> np.ndarray:
    """ln P(t, s) of independent zero-mean channels with a conjugate prior of weight d and the segment's scale."""
    n, d = x.shape
    lg = log_gamma_halves(n + d + 2)
    squares = _sums(x * x)
    out = np.full((n, n), -np.inf)
    for t, m, ok in _spans(x, d):
        v = _scale(x, t, m, ok)
        spread = np.where(ok[..., None], squares[None, 1:] - squares[t, None], 0.0)
        value = d * (-(m / 2) * math.log(math.pi) + d / 2 * np.log(v) - lg[d] + lg[d + m])
        out[t] = np.where(ok, value - ((d + m) / 2) * np.log(v[..., None] + np.maximum(spread, 0)).sum(axis=2), -np.inf)
    return out


def full(x: np.ndarray) -> np.ndarray:
    """As independent, with all covariances between channels.

    The determinant comes from a Cholesky factor of a matrix that the scale on its diagonal keeps positive.
    """
    n, d = x.shape
    lg = log_gamma_halves(n + 2 * d + 2)
    outer = _sums(x[:, :, None] * x[:, None, :])
    multi = d * (d - 1) / 4 * math.log(math.pi) + sum(lg[np.maximum(np.arange(n + d + 1) - j, 1)] for j in range(d))
    out = np.full((n, n), -np.inf)
    for t, m, ok in _spans(x, d * d):
        v = _scale(x, t, m, ok)
        gram = np.where(ok[..., None, None], outer[None, 1:] - outer[t, None], 0.0)
        # Rounding in the prefix sums is of the order of their size; the diagonal outweighs it.
        ridge = np.maximum(v, 1e-13 * np.trace(outer[-1]))
        factor = np.linalg.cholesky(gram + ridge[..., None, None] * np.eye(d))
        logdet = 2 * np.log(np.diagonal(factor, axis1=2, axis2=3)).sum(axis=2)
        value = -(d * m / 2) * math.log(math.pi) + d / 2 * d * np.log(ridge) + multi[d + m] - multi[d] - ((d + m) / 2) * logdet
        out[t] = np.where(ok, value, -np.inf)
    return out


MODELS = {"gauss": gaussian, "ifm": independent, "fullcov": full}


def marginals(log_p: np.ndarray, g: float, truncate: float = -np.inf) -> np.ndarray:
    """Probability of a changepoint between samples t and t + 1, for t = 0 .. n - 2.

    log_p[t, s] is ln P of the segment t..s, g the constant probability of each segment length.
    Terms more than `truncate` below the sum so far end an inner sum.
    """
    n = len(log_p)
    if not np.isfinite(log_p[np.triu_indices(n)]).all():
        raise ValueError("a segment's likelihood is not finite")
    lg = math.log(g)
    q = np.full(n + 1, -np.inf)
    q[n - 1] = log_p[n - 1, n - 1]
    for t in range(n - 2, -1, -1):
        terms = log_p[t, t : n - 1] + q[t + 1 : n] + lg
        if truncate > -np.inf:
            so_far = np.logaddexp.accumulate(terms)
            late = np.flatnonzero(terms - so_far < truncate)
            terms = terms[: late[0]] if len(late) else terms
        survive = max(1e-300, 1 - g * (n - 1 - t))
        q[t] = np.logaddexp(np.logaddexp.reduce(terms), log_p[t, n - 1] + math.log(survive))
    f = np.full(n, -np.inf)
    for t in range(n):
        f[t] = log_p[0, t] + lg
        if t:
            f[t] = np.logaddexp(f[t], np.logaddexp.reduce(f[:t] + log_p[1 : t + 1, t] + lg))
    return np.exp(f[: n - 1] + q[1:n] - q[0])


def posterior(x: np.ndarray, model: str, truncate: float = -50.0, trim: int = 0) -> np.ndarray:
    """Normalised marginals of one model, without `trim` places at either end."""
    if model not in MODELS:
        raise ValueError(f"unknown model {model}")
    cp = marginals(MODELS[model](x[:, :1] if model == "gauss" else x), 1 / (len(x) + 1), truncate)
    if trim and len(cp) > 2 * trim:
        cp[:trim] = cp[-trim:] = 0
    if not cp.sum() > 0:
        raise ValueError("posterior is empty")
    return cp / cp.sum()


def geometric_mean(posteriors: list[np.ndarray]) -> np.ndarray:
    log_mean = sum(np.log(p + 1e-15) for p in posteriors) / len(posteriors)
    return np.exp(log_mean - np.logaddexp.reduce(log_mean))


def boxcar(p: np.ndarray, size: int) -> np.ndarray:
    """Mean of `size` neighbours, mirrored at the ends."""
    if size <= 1:
        return p
    wide = np.concatenate([p[: size // 2][::-1], p, p[len(p) - (size - 1 - size // 2) :][::-1]])
    return np.convolve(wide, np.ones(size) / size, "valid")
