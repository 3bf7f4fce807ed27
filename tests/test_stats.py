from __future__ import annotations

import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from skysieve.functions import stats


def _cdf(k, n, p):
    return sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 300), st.floats(0.001, 0.999), st.data())
def test_binomial_cdf(n, p, data):
    k = data.draw(st.integers(0, n))
    assert stats.binom_cdf(k, n, p) == pytest.approx(_cdf(k, n, p), rel=1e-9, abs=1e-12)


def test_published_numbers():
    assert stats.cp_upper(12, 192, 0.95) == pytest.approx(0.099298, abs=1e-6)
    assert stats.cp_upper(4, 73, 0.95) == pytest.approx(0.121015, abs=1e-6)
    assert [stats.pac_rank(n, 0.1, 0.95) for n in (28, 29, 73, 96, 100, 153, 154)] == [0, 1, 3, 5, 5, 9, 10]
    assert [stats.pac_rank(73, a, 0.95) for a in (0.05, 0.1, 0.15, 0.2)] == [1, 3, 6, 9]
    assert stats.minimum_positive_events(0, 0.1, 0.95) == 29 and stats.minimum_positive_events(4, 0.1, 0.95) == 89
    assert stats.mcnemar_p(363, 194) == pytest.approx(7.3314e-13, rel=1e-4) and stats.mcnemar_p(0, 0) == 1.0
    assert stats.marginal_rank(99, 0.29) == 28
    assert stats.pass_probability(200, 0.05, 0.1, 0.95) == pytest.approx(0.79648, abs=1e-5)


def test_thresholds_and_bounds_refuse_nonsense():
    assert stats.strict_threshold(None) == float("-inf") and stats.strict_threshold(0.5) < 0.5
    with pytest.raises(ValueError):
        stats.cp_upper(3, 2, 0.95)
    with pytest.raises(ValueError):
        stats.calibration_rank(10, 0.1, "other")


def test_bootstrap_covers_the_change():
    low, high = stats.net_change_interval(363, 194, 6954)
    assert low < (363 - 194) / 6954 < high and low == pytest.approx(0.0177, abs=2e-3)


def test_sql_functions(spark):
    stats.register(spark)
    row = spark.sql("select cp_upper(4, 73, 0.95) a, pac_rank(73, 0.1, 0.95) b, mcnemar_p(0, 0) c, binom_cdf(1, 2, 0.5) d").first()
    assert row["a"] == pytest.approx(0.121015, abs=1e-6) and row["b"] == 3 and row["c"] == 1.0 and row["d"] == pytest.approx(0.75)
