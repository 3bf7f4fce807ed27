"""Contracts of scored messages, labels and streams: what breaks them as rows, and checks that raise."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skysieve.functions.checks import ConstraintError, finite


def one_value_conflicts(rows: DataFrame, columns: tuple[str, ...], key: str = "event_id") -> DataFrame:
    """key, column_name, n_values: keys with more than one value of a column that must be one per key. Nulls are no value."""
    pairs = ", ".join(f"'{c}', cast(`{c}` as string)" for c in columns)
    long = rows.filter(F.col(key).isNotNull()).select(key, F.expr(f"stack({len(columns)}, {pairs}) as (column_name, value)")).filter("value is not null")
    return long.distinct().groupBy(key, "column_name").agg(F.count(F.lit(1)).alias("n_values")).filter("n_values > 1")


def roster_faults(scored: DataFrame, labels: DataFrame, key: str = "event_id") -> DataFrame:
    """key, fault of an exact-roster join of scored events and labels (key, y): unlabelled (scored without a label), unscored (labelled but not
    scored), bad_label (a label that is not 0 or 1), conflict (both labels)."""
    known = labels.filter(F.col(key).isNotNull()).groupBy(key).agg(F.min("y").alias("low"), F.max("y").alias("high"), F.count_if(F.col("y").isNull() | ~F.col("y").isin(0, 1)).alias("bad"))
    both = scored.select(key).filter(F.col(key).isNotNull()).distinct().withColumn("scored", F.lit(True)).join(known.withColumn("labelled", F.lit(True)), key, "full_outer")
    fault = (
        F.when(F.col("labelled").isNull(), "unlabelled").when(F.col("scored").isNull(), "unscored").when(F.col("bad") > 0, "bad_label").when(F.col("low") < F.col("high"), "conflict")
    )
    return both.select(key, fault.alias("fault")).filter("fault is not null")


def stream_faults(rows: DataFrame, score: str = "score", calibration: DataFrame | None = None, one_valued: tuple[str, ...] = (), expected: dict[str, str] | None = None) -> DataFrame:
    """rule, violations: how many rows of a stream of event_id, time_to_tca, `score` break each rule of a replay; one row per rule.

    An event is given; time is finite and not negative; the score is finite and lies in [0, 1]; no second update of an event at one time; no event of
    `calibration` (event_id) comes again; columns of `one_valued` (a model's or contract's digest) have the value given by `expected`, or one value in
    all rows, and are never null."""
    time, value = F.col("time_to_tca"), F.col(score)
    rules: dict[str, Column] = {
        "event_missing": F.col("event_id").isNull(), "time_invalid": ~finite(time) | (time < 0), "score_not_finite": ~finite(value), "score_out_of_range": finite(value) & ~value.between(0, 1),
    }
    rules |= {f"{c}_unexpected": ~F.col(c).eqNullSafe(F.lit(v)) for c, v in (expected or {}).items()}
    counts = rows.agg(*(F.count_if(F.coalesce(rule, F.lit(True))).alias(name) for name, rule in rules.items()), *(F.count_if(F.col(c).isNull()).alias(f"{c}_missing") for c in one_valued), *(F.greatest(F.lit(0), F.count_distinct(c) - 1).alias(f"{c}_differs") for c in one_valued))
    names = counts.columns
    parts = [counts.select(F.expr(f"stack({len(names)}, {', '.join(f'{chr(39)}{n}{chr(39)}, `{n}`' for n in names)}) as (rule, violations)"))]
    copies = rows.filter("event_id is not null and time_to_tca is not null").groupBy("event_id", "time_to_tca").agg(F.count(F.lit(1)).alias("n"))
    parts.append(copies.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("violations")).select(F.lit("repeated_update").alias("rule"), "violations"))
    if calibration is not None:
        again = rows.join(calibration.select("event_id").distinct(), "event_id", "left_semi")
        parts.append(again.agg(F.count(F.lit(1)).alias("violations")).select(F.lit("calibration_event").alias("rule"), "violations"))
    return reduce(DataFrame.unionByName, parts)


def demand(faults: DataFrame, what: str) -> None:
    """Raise where a table of faults has rows (those with violations = 0 aside); names the first few."""
    wrong = faults.filter("violations > 0") if "violations" in faults.columns else faults
    found = wrong.limit(6).collect()
    if found:
        raise ConstraintError(f"{what}: " + "; ".join(", ".join(str(v) for v in row) for row in found[:5]) + (" ..." if len(found) > 5 else ""))


def labelled(scored: DataFrame, labels: DataFrame) -> DataFrame:
    """Scored messages with the label of their event; raises unless the scores are blind to labels and both tables have exactly the same events, each
    with one label."""
    if "y" in scored.columns:
        raise ConstraintError("scores must not bring labels with them")
    demand(roster_faults(scored, labels), "labels")
    return scored.join(labels.groupBy("event_id").agg(F.max("y").alias("y")), "event_id")


def replay_ready(rows: DataFrame, score: str = "score", calibration: DataFrame | None = None, one_valued: tuple[str, ...] = (), expected: dict[str, str] | None = None) -> DataFrame:
    """`rows` once they break no rule of stream_faults and are not empty."""
    if rows.isEmpty():
        raise ConstraintError("a stream has no row")
    demand(stream_faults(rows, score, calibration, one_valued, expected), "stream")
    return rows


def enough_folds(rows: DataFrame, least: int = 5) -> DataFrame:
    """`rows` once they have at least `least` folds: one to evaluate, one for the policy, one for the gate's bound and two for its fit."""
    n = rows.select("fold").distinct().limit(least).count()
    if n < least:
        raise ConstraintError(f"{n} folds, and {least} are needed")
    return rows
