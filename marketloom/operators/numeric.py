"""Numeric kernels: implied probabilities, de-vigging, Poisson inversion, weighted medians, curve checks.

Sums and shares are built-in aggregates. Root finding is vectorised: an Arrow batch is one matrix, and the
bisection halves all its rows at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

HALVINGS = 100
# The brackets in which roots are looked for.
POWER_BRACKET, SHIN_BRACKET, RATE_BRACKET = (0.01, 100.0), (0.0, 0.999999999), (1e-4, 12.0)


def _matrix(prices: pd.Series) -> np.ndarray:
    """Rows of 1 / odds, padded with zeros; a row with a price that is not finite and above one, or with none, is all NaN."""
    wide = max((len(p) for p in prices if p is not None), default=1) or 1
    out = np.zeros((len(prices), wide))
    for i, p in enumerate(prices):
        ok = p is not None and len(p) > 0 and all(x is not None and 1 < x < float("inf") for x in p)
        out[i, : len(p) if ok else wide] = 1 / np.asarray(p, dtype=float) if ok else np.nan
    return out


def normalised(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Shares of each row's total; what rounding leaves over goes to its last one. NaN where a share is not within (0, 1)."""
    with np.errstate(invalid="ignore", divide="ignore"):
        out = values / values.sum(axis=1)[:, None]
    given = np.arange(values.shape[1]) < sizes[:, None]
    rows, last = np.arange(len(out)), np.maximum(sizes - 1, 0)
    out[rows, last] += 1.0 - np.where(given, out, 0.0).sum(axis=1)
    with np.errstate(invalid="ignore"):
        bad = (given & ~((out > 0) & (out < 1))).any(axis=1) | (sizes == 0)
    out[bad] = np.nan
    return out


def power_exponents(q: np.ndarray) -> np.ndarray:
    """k of each row with sum of q**k = 1, by bisection; NaN where the bracket holds no root."""
    positive = q > 0

    def total(k: np.ndarray) -> np.ndarray:
        with np.errstate(invalid="ignore"):
            return np.where(positive, np.where(positive, q, 1.0) ** k[:, None], 0.0).sum(axis=1)

    lo, hi = np.full(len(q), POWER_BRACKET[0]), np.full(len(q), POWER_BRACKET[1])
    outside = (total(lo) < 1) | (total(hi) > 1) | np.isnan(q).any(axis=1) | (positive.sum(axis=1) < 2)
    for _ in range(HALVINGS):
        mid = (lo + hi) / 2
        high = total(mid) > 1
        lo, hi = np.where(high, mid, lo), np.where(high, hi, mid)
    return np.where(outside, np.nan, np.where(np.abs(q.sum(axis=1) - 1) < 1e-14, 1.0, (lo + hi) / 2))


def shin_shares(q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Insider share z of each row, and the margin-free probabilities; NaN where the prices have no margin, are not three, or
    where the bracket holds no root."""
    total = q.sum(axis=1)

    def shares(z: np.ndarray) -> np.ndarray:
        z = z[:, None]
        with np.errstate(invalid="ignore"):
            return (np.sqrt(z**2 + 4 * (1 - z) * q**2 / total[:, None]) - z) / (2 * (1 - z))

    lo, hi = np.full(len(q), SHIN_BRACKET[0]), np.full(len(q), SHIN_BRACKET[1])
    with np.errstate(invalid="ignore"):
        outside = ~(total > 1) | ((q > 0).sum(axis=1) != 3) | ((shares(lo).sum(axis=1) - 1) * (shares(hi).sum(axis=1) - 1) > 0)
    for _ in range(HALVINGS):
        mid = (lo + hi) / 2
        high = shares(mid).sum(axis=1) > 1
        lo, hi = np.where(high, mid, lo), np.where(high, hi, mid)
    z = np.where(outside, np.nan, (lo + hi) / 2)
    return z, np.where(outside[:, None], np.nan, shares(z))


def _sizes(prices: pd.Series) -> np.ndarray:
    return np.array([0 if p is None else len(p) for p in prices], dtype=int)


def _solve(q: np.ndarray, sizes: np.ndarray, method: str) -> tuple[np.ndarray, np.ndarray]:
    """(parameter, probabilities) of each row, NaN where the method has none."""
    if method == "power":
        parameter = power_exponents(q)
        with np.errstate(invalid="ignore"):
            p = np.where(q > 0, np.where(q > 0, q, 1.0) ** parameter[:, None], 0.0)
    else:
        parameter, p = shin_shares(q)
    p = normalised(p, sizes)
    return np.where(np.isnan(p[:, 0]), np.nan, parameter), p


def _numbers(values: np.ndarray) -> list[float | None]:
    return [None if np.isnan(v) else float(v) for v in values]


def _lists(p: np.ndarray, sizes: np.ndarray) -> list[list[float] | None]:
    return [None if n == 0 or np.isnan(p[i, 0]) else list(map(float, p[i, :n])) for i, n in enumerate(sizes)]


def devigged(markets: DataFrame, key: str, prices: str, method: str) -> DataFrame:
    """(key, parameter, probabilities) of each market's array of prices, by ``power`` or ``shin``.

    A market with fewer than two prices, or with one that is not finite and above 1, gives nulls; so does Shin's method
    without a margin or with other than three prices, and a root outside the bracket. Prices stay in the order given.
    """

    def solved(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            sizes = _sizes(frame[prices])
            parameter, p = _solve(_matrix(frame[prices]), sizes, method)
            yield pd.DataFrame({key: frame[key], "parameter": _numbers(parameter), "probabilities": _lists(p, sizes)})

    kind = dict(markets.dtypes)[key]
    return markets.select(key, prices).mapInPandas(solved, f"{key} {kind}, parameter double, probabilities array<double>")


def devigged_or_shares(markets: DataFrame, key: str, prices: str, preferred: str) -> DataFrame:
    """(key, method, parameter, probabilities) by the method that each row of column ``preferred`` names (``SHIN``, else power);
    where that has no answer, plain shares, with ``MULTIPLICATIVE_FALLBACK`` as the method. Prices that are no
    prices give null."""

    def solved(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            q, sizes = _matrix(frame[prices]), _sizes(frame[prices])
            shin = frame[preferred].eq("SHIN").fillna(False).to_numpy(dtype=bool)
            (a, pa), (b, pb) = _solve(q, sizes, "shin"), _solve(q, sizes, "power")
            parameter, p = np.where(shin, a, b), np.where(shin[:, None], pa, pb)
            failed = np.isnan(p[:, 0])
            p = np.where(failed[:, None], normalised(q, sizes), p)
            none = np.isnan(p[:, 0])
            method = np.where(none, None, np.where(failed, "MULTIPLICATIVE_FALLBACK", np.where(shin, "SHIN", "POWER")))
            yield pd.DataFrame({key: frame[key], "method": method, "parameter": _numbers(parameter), "probabilities": _lists(p, sizes)})

    kind = dict(markets.dtypes)[key]
    return markets.select(key, prices, preferred).mapInPandas(solved, f"{key} {kind}, method string, parameter double, probabilities array<double>")


def poisson_rates(rows: DataFrame, line: str, target: str, out: str) -> DataFrame:
    """Add the rate at which a Poisson total exceeds ``line`` with probability ``target``; null outside (0, 1) and without a line."""

    @F.pandas_udf("double")
    def rate(lines: pd.Series, targets: pd.Series) -> pd.Series:
        goals = np.floor(lines.to_numpy(dtype=float)).astype(float)
        want = targets.to_numpy(dtype=float)
        lo, hi = np.full(len(want), RATE_BRACKET[0]), np.full(len(want), RATE_BRACKET[1])
        most = int(np.nanmax(goals, initial=0))
        for _ in range(HALVINGS):
            mid = (lo + hi) / 2
            term, below = np.exp(-mid), np.zeros(len(mid))
            for k in range(most + 1):
                below += np.where(k <= goals, term, 0)
                term = term * mid / (k + 1)
            short = 1 - below < want
            lo, hi = np.where(short, mid, lo), np.where(short, hi, mid)
        return pd.Series(np.where((want > 0) & (want < 1) & ~np.isnan(goals), (lo + hi) / 2, np.nan)).replace({np.nan: None})

    return rows.withColumn(out, rate(F.col(line), F.col(target)))


def weighted_median(rows: DataFrame, key: str, value: str, weight: str, ties: list[str]) -> DataFrame:
    """(key, median): the least value at which the running weight reaches half of the key's weight."""
    by_value = Window.partitionBy(key).orderBy(value, *ties)
    run = F.sum(weight).over(by_value.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    half = F.sum(weight).over(Window.partitionBy(key)) / 2
    return rows.withColumns({"run": run, "half": half}).where("run >= half").groupBy(key).agg(F.min(value).alias("median"))


def curve_breaks(points: DataFrame, keys: list[str], at: str, value: str, tolerance: float) -> DataFrame:
    """Adjacent points of a curve whose value falls by more than the tolerance, although it should not."""
    along = Window.partitionBy(*keys).orderBy(at, value)
    seen = points.withColumns({"prev_at": F.lag(at).over(along), "prev_value": F.lag(value).over(along)})
    return seen.where((F.col("prev_at") < F.col(at)) & (F.col(value) < F.col("prev_value") - tolerance)).select(*keys, "prev_at", at, "prev_value", value)
