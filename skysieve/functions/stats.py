"""Exact binomial statistics: on the driver as plain functions, in plans as Arrow-batched UDFs over a few aggregated rows."""

from __future__ import annotations

from math import exp, floor, isfinite, lgamma, log, nextafter

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function, by the modified Lentz rule."""
    tiny, c, d = 1e-300, 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 20_000):
        for step in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 + step * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + step / c
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1.0) < 1e-16:
            break
    return h


def beta_cdf(x: float, a: float, b: float) -> float:
    """Regularised incomplete beta function."""
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    front = exp(lgamma(a + b) - lgamma(a) - lgamma(b) + a * log(x) + b * log(1.0 - x))
    if x < (a + 1.0) / (a + b + 2.0):
        return front * _beta_fraction(a, b, x) / a
    return 1.0 - front * _beta_fraction(b, a, 1.0 - x) / b


def binom_cdf(k: int, n: int, p: float) -> float:
    """P(X <= k) of n draws with probability p."""
    if k < 0:
        return 0.0
    if k >= n:
        return 1.0
    return beta_cdf(1.0 - p, n - k, k + 1)


def cp_upper(k: int, n: int, confidence: float) -> float:
    """One-sided Clopper-Pearson upper bound of k failures in n."""
    if n <= 0 or not 0 <= k <= n:
        raise ValueError("failures must lie between 0 and a positive number of events")
    if k == n:
        return 1.0
    low, high = 0.0, 1.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if binom_cdf(k, n, mid) > 1 - confidence else (low, mid)
    return (low + high) / 2


def marginal_rank(n: int, alpha: float) -> int:
    return min(n, floor(alpha * (n + 1)))


def pac_rank(n: int, alpha: float, confidence: float) -> int:
    """The largest order statistic r whose coverage exceeds alpha with probability at most 1 - confidence, else 0."""
    low, high = 0, n  # binom_cdf grows with k, so the ranks that hold are 1..r
    while low < high:
        mid = (low + high + 1) // 2
        if binom_cdf(mid - 1, n, alpha) <= 1 - confidence:
            low = mid
        else:
            high = mid - 1
    return low


def calibration_rank(n: int, alpha: float, mode: str = "marginal", confidence: float = 0.95) -> int:
    if mode == "marginal":
        return marginal_rank(n, alpha)
    if mode == "pac":
        return pac_rank(n, alpha, confidence)
    raise ValueError("mode must be marginal or pac")


def strict_threshold(order_statistic: float | None) -> float:
    """The stored number for "below this score": one step under it; minus infinity where there is no rank."""
    return float("-inf") if order_statistic is None else nextafter(order_statistic, float("-inf"))


def maximum_passing_failures(n: int, alpha: float, confidence: float) -> int:
    """The most failures in n whose upper bound is within alpha; -1 if none."""
    return pac_rank(n, alpha, confidence) - 1


def minimum_positive_events(failures: int, alpha: float, confidence: float, limit: int = 100_000) -> int:
    for n in range(failures + 1, limit + 1):
        if cp_upper(failures, n, confidence) <= alpha:
            return n
    raise ValueError("no size within the limit passes")


def pass_probability(n: int, rate: float, alpha: float, confidence: float) -> float:
    return binom_cdf(maximum_passing_failures(n, alpha, confidence), n, rate)


def mcnemar_p(gained: int, lost: int) -> float:
    """Exact two-sided test of as many gains as losses; 1 where there are none."""
    total = gained + lost
    return 1.0 if total == 0 else min(1.0, 2 * binom_cdf(min(gained, lost), total, 0.5))


def net_change_interval(gained: int, lost: int, n: int, confidence: float = 0.95, resamples: int = 20_000, seed: int = 20260716) -> tuple[float, float]:
    """Percentile bootstrap of the mean paired change: resampling n outcomes of -1, 0 and 1 is a multinomial draw."""
    import numpy as np

    draws = np.random.default_rng(seed).multinomial(n, [gained / n, lost / n, 1 - (gained + lost) / n], size=resamples)
    change = (draws[:, 0] - draws[:, 1]) / n
    tail = (1 - confidence) / 2
    return float(np.quantile(change, tail)), float(np.quantile(change, 1 - tail))


def _nullable(function):
    def call(*values):
        return None if any(v is None or (isinstance(v, float) and not isfinite(v)) for v in values) else function(*values)

    return call


def _udf(function, kind: str, inputs: int = 2):
    call = _nullable(function)

    def batch(*columns: pd.Series) -> pd.Series:
        return pd.Series([call(*(None if pd.isna(v) else v for v in row)) for row in zip(*columns)])

    def two(first: pd.Series, second: pd.Series) -> pd.Series:
        return batch(first, second)

    def three(first: pd.Series, second: pd.Series, third: pd.Series) -> pd.Series:
        return batch(first, second, third)

    return F.pandas_udf(two if inputs == 2 else three, kind)


def cp_upper_column(k: Column, n: Column, confidence: float) -> Column:
    """Upper bound column; null where n is 0."""
    return _udf(lambda a, b: cp_upper(int(a), int(b), confidence) if b > 0 else None, "double")(k.cast("double"), n.cast("double"))


def rank_column(n: Column, alpha: float, mode: str, confidence: float) -> Column:
    if mode == "marginal":
        return F.least(n, F.floor(F.lit(float(alpha)) * (n + 1))).cast("int")
    return _udf(lambda a, b: calibration_rank(int(a), b, mode, confidence), "int")(n.cast("double"), F.lit(float(alpha)))


def mcnemar_column(gained: Column, lost: Column) -> Column:
    return _udf(lambda a, b: mcnemar_p(int(a), int(b)), "double")(gained.cast("double"), lost.cast("double"))


def net_change_column(gained: Column, lost: Column, n: Column) -> Column:
    """[low, high]: the bootstrap interval of the net change; null where n is 0."""
    return _udf(lambda a, b, c: [float(x) for x in net_change_interval(int(a), int(b), int(c))] if c > 0 else None, "array<double>", 3)(gained.cast("double"), lost.cast("double"), n.cast("double"))


def pass_column(n: Column, rate: Column, alpha: float, confidence: float) -> Column:
    """Chance that n events of a true rate pass the bound."""
    return _udf(lambda a, b: pass_probability(int(a), b, alpha, confidence), "double")(n.cast("double"), rate)


def register(spark: SparkSession) -> None:
    """binom_cdf(k, n, p), cp_upper(k, n, confidence), pac_rank(n, alpha, confidence) and mcnemar_p(gained, lost) for use in SQL text, in Arrow
    batches; null where an argument is."""
    spark.udf.register("binom_cdf", _udf(lambda k, n, p: float(binom_cdf(int(k), int(n), float(p))), "double", 3))
    spark.udf.register("cp_upper", _udf(lambda k, n, c: float(cp_upper(int(k), int(n), float(c))) if n else None, "double", 3))
    spark.udf.register("pac_rank", _udf(lambda n, a, c: pac_rank(int(n), float(a), float(c)), "int", 3))
    spark.udf.register("mcnemar_p", _udf(lambda g, l: float(mcnemar_p(int(g), int(l))), "double"))  # noqa: E741
