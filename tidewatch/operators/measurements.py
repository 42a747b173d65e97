"""Filters over measurement vectors, and scores of given networks."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .detectors import _in_order
from .scans import scan


def chi2_quantile(p: float, m: int) -> float:
    """The p quantile of the chi-squared distribution with m degrees of freedom, by bisection."""

    def below(x: float) -> float:
        a, h = m / 2, x / 2
        term, total, n = 1.0, 1.0, 0
        while term > 1e-17 * total:
            n += 1
            term *= h / (a + n)
            total += term
        return total * math.exp(a * math.log(h) - h - math.lgamma(a + 1))

    low, high = 0.0, 2.0 * m
    while below(high) < p:
        high *= 2
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if below(mid) < p else (low, mid)
    return high


def _filter_maps(f: np.ndarray, h: np.ndarray, q: np.ndarray, r: np.ndarray) -> tuple:
    """(maps, then): the filter's rows as elements of an associative scan, after Sarkka and Garcia-Fernandez (2021).

    An element is (A, C, J, b, eta): a state with covariance C of what lies before gives A x + b with covariance C, and eta, J are the
    information that the rows hold on it. A, C and J are the same for every row, b and eta follow the measurement.
    """
    d = len(f)
    s = h @ q @ h.T + r
    gain = np.linalg.solve(s, h @ q).T
    kept = np.eye(d) - gain @ h
    back = np.linalg.solve(s, h @ f).T
    fixed = np.concatenate([(kept @ f).ravel(), (kept @ q).ravel(), (back @ h @ f).ravel()])

    def maps(z: np.ndarray, _place: np.ndarray) -> tuple[np.ndarray, dict]:
        return np.concatenate([np.tile(fixed, (len(z), 1)), z @ gain.T, z @ back.T], axis=1), {}

    return maps, _then(d)


def _parts(e: np.ndarray, d: int) -> tuple:
    at = d * d
    return (*(e[:, i * at : (i + 1) * at].reshape(-1, d, d) for i in range(3)), e[:, 3 * at : 3 * at + d, None], e[:, 3 * at + d :, None])


def _then(d: int):
    def then(first: np.ndarray, second: np.ndarray) -> np.ndarray:
        (a, c, j, b, eta), (a2, c2, j2, b2, eta2) = _parts(first, d), _parts(second, d)
        turn = lambda x: x.transpose(0, 2, 1)
        ahead = a2 @ np.linalg.inv(np.eye(d) + c @ j2)
        back = turn(a) @ np.linalg.inv(np.eye(d) + j2 @ c)
        out = (ahead @ a, ahead @ c @ turn(a2) + c2, back @ j2 @ a + j, ahead @ (b + c @ eta2) + b2, back @ (eta2 - j2 @ b) + eta)
        return np.concatenate([x.reshape(len(first), -1) for x in out], axis=1)

    return then


def kalman_chi2_by_key(df: DataFrame, key: str, order: list[str], cols: list[str], h, q, r, x0, p0=None, f=None, alpha: float = 0.05) -> DataFrame:
    """(key, order, adi, alarm): a linear Kalman filter with full matrices in order for each key.

    The state moves by f (stays, if None) with noise q and is measured in ``cols`` by h with noise r; it starts at x0 with
    covariance p0 (the identity, if None). alarm: adi is above the (1 - alpha) quantile of the chi-squared distribution
    with one degree for each measurement. The whole filter, covariances and all, is an associative scan (see scans.scan): a key with any share of
    the rows spreads over tasks. A null measurement gives null adi from there on for its key, and no alarms.
    """
    h, q, r, x0 = (np.array(v, float) for v in (h, q, r, x0))
    d = len(x0)
    p0, f = (np.eye(d) if v is None else np.array(v, float) for v in (p0, f))
    limit = chi2_quantile(1 - alpha, len(cols))
    maps, then = _filter_maps(f, h, q, r)
    none = np.concatenate([np.eye(d).ravel(), np.zeros(2 * d * d + 2 * d)])
    prior = np.concatenate([np.zeros(d * d), p0.ravel(), np.zeros(d * d), x0, np.zeros(d)])
    found = scan(df, key, order, cols, maps, then, none.tolist())

    def judged(batches):
        for pdf in batches:
            if not len(pdf):
                continue
            start = np.array([none if x is None else x for x in pdf["_start"]])
            state = then(then(np.tile(prior, (len(pdf), 1)), start), np.array(pdf["_before"].tolist()))
            _, p, _, x, _ = _parts(state, d)
            innovation = pdf[cols].to_numpy(float)[:, :, None] - h @ f @ x
            s = h @ (f @ p @ f.T + q) @ h.T + r
            adi = (innovation * np.linalg.solve(s, innovation)).sum(axis=(1, 2))
            yield pdf[[key, *order]].assign(adi=adi, alarm=(adi > limit).astype(np.int32))

    kinds = dict(df.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in [key, *order])
    out = found.mapInPandas(judged, f"{schema}, adi double, alarm int")
    return out.withColumn("adi", F.when(~F.isnan("adi"), F.col("adi")))


def residual_embedding(energy: dict[str, float], k: int = 4) -> Column:
    """The residual columns with the most energy on benign rows, largest first (by name on ties), 0 beyond; signs stay."""
    chosen = sorted(energy, key=lambda c: (-energy[c], c))[:k]
    return F.array(*[F.col(c).cast("double") for c in chosen], *[F.lit(0.0)] * (k - len(chosen)))


def mlp_forward(x: np.ndarray, layers: list[tuple]) -> np.ndarray:
    """x through layers ('linear', weights, bias), ('batch_norm', mean, var, gamma, beta, eps) and ('leaky_relu', slope)."""
    for kind, *w in layers:
        if kind == "linear":
            x = x @ np.asarray(w[0]).T + np.asarray(w[1])
        elif kind == "batch_norm":
            mean, var, gamma, beta = (np.asarray(v) for v in w[:4])
            x = (x - mean) / np.sqrt(var + w[4]) * gamma + beta
        elif kind == "leaky_relu":
            x = np.where(x >= 0, x, w[0] * x)
        else:
            raise ValueError(f"unknown layer {kind}")
    return x


def mlp_reconstruction_score(df: DataFrame, cols: list[str], layers: list[tuple]) -> DataFrame:
    """df with score: mean squared difference of each row to what a given network makes of it.

    The weights have the network's size, whatever df's, and go along with the function. A null or NaN gives null.
    """

    @F.pandas_udf("double")
    def score(*xs: pd.Series) -> pd.Series:
        x = np.column_stack([v.to_numpy(float) for v in xs])
        out = pd.Series(((x - mlp_forward(x, layers)) ** 2).mean(axis=1))
        return out.where(out.notna(), None)

    return df.withColumn("score", score(*[F.col(c).cast("double") for c in cols]))


def _floored(a: np.ndarray, least: float) -> np.ndarray:
    """The symmetric parts of matrices with eigenvalues of at least ``least``."""
    value, vector = np.linalg.eigh((a + a.transpose(0, 2, 1)) / 2)
    return (vector * np.maximum(value, least)[:, None, :]) @ vector.transpose(0, 2, 1)


def adaptive_kalman_by_key(df: DataFrame, key: str, order: list[str], cols: list[str], h, q0, r0, x0, p0=None, f=None, b: float = 0.97, warmup: int = 5, alpha: float = 0.05, xi_threshold: float | None = None) -> DataFrame:
    """(key, order, adi, alarm, xi, adapted): a Sage-Husa filter in order for each key.

    As ``kalman_chi2_by_key``, and the means and covariances of both noises follow the innovations with weight
    (1 - b) / (1 - b**(k + 1)) at row k, after ``warmup`` rows and on rows without an alarm only, so that an attack is not
    learnt as noise. Covariances keep eigenvalues of a thousandth of the smallest they began with. xi is the distance
    between the predicted and the corrected state; with an xi_threshold, rows that reach it are alarms too. What a filter learns depends on its own
    alarms, so a key is one chain, of any length; the keys of a batch step side by side.
    """
    h, q0, r0, x0 = (np.array(v, float) for v in (h, q0, r0, x0))
    p0, f = (np.eye(len(x0)) if v is None else np.array(v, float) for v in (p0, f))
    limit = chi2_quantile(1 - alpha, len(cols))
    least_q, least_r = (float(np.linalg.eigvalsh(v).min()) / 1000 for v in (q0, r0))

    d, m = len(x0), len(cols)
    outer = lambda v: v[:, :, None] * v[:, None, :]

    def step(z: np.ndarray, state: tuple) -> tuple[dict, tuple]:
        x, p, q, r, drift, offset, seen = state
        moved, spread = x @ f.T, f @ p @ f.T
        ahead, wide = moved + drift, spread + q
        innovation = z - ahead @ h.T - offset
        s = h @ wide @ h.T + r
        gain = np.linalg.solve(s, h @ wide).transpose(0, 2, 1)
        adi = (innovation * np.linalg.solve(s, innovation[:, :, None])[:, :, 0]).sum(axis=1)
        x = ahead + (gain @ innovation[:, :, None])[:, :, 0]
        p = wide - gain @ h @ wide
        p = (p + p.transpose(0, 2, 1)) / 2
        xi = np.linalg.norm(ahead - x, axis=1)
        alarm = adi > limit
        if xi_threshold is not None:
            alarm |= xi >= xi_threshold
        learns = (seen >= warmup) & (adi <= limit) & ~alarm
        on = np.flatnonzero(learns)
        if len(on):
            w = (1 - b) / (1 - b ** (seen[on] + 1.0))
            row, whole = w[:, None], w[:, None, None]
            offset[on] += row * (z[on] - x[on] @ h.T - offset[on])
            drift[on] += row * (x[on] - moved[on] - drift[on])
            square = outer(innovation[on])
            r[on] = _floored(r[on] + whole * (square - h @ wide[on] @ h.T - r[on]), least_r)
            q[on] = _floored(q[on] + whole * (gain[on] @ square @ gain[on].transpose(0, 2, 1) + p[on] - spread[on] - q[on]), least_q)
        return {"adi": adi, "alarm": alarm.astype(np.int32), "xi": xi, "adapted": learns.astype(np.int32)}, (x, p, q, r, drift, offset, seen + 1)

    def start(n: int) -> tuple:
        return (*(np.tile(v, (n, *[1] * v.ndim)) for v in (x0, p0, q0, r0)), np.zeros((n, d)), np.zeros((n, m)), np.zeros(n, np.int64))

    return _in_order(df, key, order, cols, "adi double, alarm int, xi double, adapted int", start, step)
