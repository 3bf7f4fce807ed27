"""Quantiles by ranges are those of percentile, without its buffer."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from skysieve.operators.calibrate import policy_metrics
from skysieve.operators.experiments import paired_change
from skysieve.operators.gate import robust_scale
from skysieve.operators.ranking import quantiles

SHARES = (0.0, 0.05, 0.25, 0.5, 0.75, 0.95, 1.0)


def _rows(spark):
    r = random.Random(3)
    values = [(r.choice(["a", "a", "b", None]), r.choice([r.gauss(0, 1), -30.0, float(r.randrange(3))])) for _ in range(999)]
    return spark.createDataFrame(values + [("c", 1.5), ("d", None), ("d", None)], "g string, x double")


def test_quantiles_are_those_of_percentile(spark):
    df = _rows(spark)
    wanted = F.expr(f"percentile(x, array{SHARES})").alias("q")
    assert {tuple(map(str, r)) for r in quantiles(df, ("g",), "x", SHARES).collect()} == {tuple(map(str, r)) for r in df.filter("x is not null").groupBy("g").agg(wanted).collect()}
    assert quantiles(df, (), "x", SHARES).collect() == df.agg(wanted).collect()
    assert [tuple(r) for r in quantiles(df.filter("x > 1e9"), (), "x", (0.5,)).collect()] == [([None],)]


def _plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_no_plan_holds_a_column_in_a_buffer(spark):
    df = _rows(spark).withColumns({"y": F.lit(0), "safe_exclude": F.col("x") > 0, "shift_gate_blocked": F.lit(False), "first_safe_tca": F.col("x")})
    metrics = policy_metrics(df, ("g",), None)
    pairs = df.withColumns({"safe_baseline": F.col("x") > 0, "safe_candidate": F.col("x") > -1, "tca_baseline": F.lit(1.0), "tca_candidate": F.col("x")})
    change = paired_change(pairs, ("g",), False)
    for plan in (robust_scale(df, ("x",), ("g",)), metrics, change):
        assert "percentile" not in _plan(plan)
    assert {(r["g"], r["median_first_safe_tca"]) for r in metrics.collect()} == {tuple(r) for r in df.groupBy("g").agg(F.expr("percentile(CASE WHEN safe_exclude THEN x END, 0.5)")).collect()}
    assert {(r["g"], r["median_time_change"]) for r in change.collect()} == {tuple(r) for r in df.groupBy("g").agg(F.expr("percentile(CASE WHEN x > 0 THEN x - 1.0 END, 0.5)")).collect()}
