"""Event-level calibration of any lower-is-safer score, first decisions and their evaluation.

The decision is score <= threshold with the threshold one step under an order statistic s, which for finite scores is
score < s; plans use the strict form, and only the stored number is stepped (stats.strict_threshold)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skysieve.functions.stats import cp_upper_column, rank_column
from skysieve.operators.ranking import quantiles, ranked_within, with_quantiles
from skysieve.session import cut

INFINITE = float("inf")


def event_policy(rows: DataFrame, score: str = "score") -> DataFrame:
    """event_id, y, min_score, first_available_tca, last_available_tca."""
    return rows.groupBy("event_id").agg(
        F.min("y").alias("y"), F.min(score).alias("min_score"), F.max("time_to_tca").alias("first_available_tca"), F.min("time_to_tca").alias("last_available_tca")
    )


def history_gated_events(rows: DataFrame, minimum_history: int, score: str = "score", allowed: Column | None = None) -> DataFrame:
    """event_id, y, min_score over messages with enough history (and allowed by a gate); infinity for events without any, which stay."""
    open_ = F.col("eligible_history_count") >= minimum_history
    if allowed is not None:
        open_ = open_ & allowed
    return rows.groupBy("event_id").agg(F.min("y").alias("y"), F.coalesce(F.min(F.when(open_, F.col(score))), F.lit(INFINITE)).alias("min_score"))


def thresholds(events: DataFrame, groups: tuple[str, ...], alpha: float, mode: str = "marginal", confidence: float = 0.95, value: str = "min_score") -> DataFrame:
    """groups, n_positive, rank, bound: the order statistic of the positives' least scores under which (strictly) an event counts as
    safe. Rank 0 gives bound null: no decision."""
    ordered = ranked_within(events.filter("y = 1"), groups, (value, "event_id"), "__i", "n_positive")
    ranks = ordered.select(*groups, "n_positive").distinct().withColumn("rank", rank_column(F.col("n_positive"), alpha, mode, confidence))
    picks = ordered.select(*(F.col(g).alias(f"__{g}") for g in groups), F.col("__i"), F.col(value).alias("bound"))
    on = F.col("rank") == F.col("__i")
    for g in groups:
        on = on & F.col(g).eqNullSafe(F.col(f"__{g}"))
    return ranks.join(picks, on, "left").select(*groups, "n_positive", "rank", "bound")


def first_safe(rows: DataFrame, bound: Column, minimum_history: int, score: str = "score", allowed: Column | None = None, keys: tuple[str, ...] = ("event_id",)) -> DataFrame:
    """Per event: y, first_safe_tca and first_safe_score (the earliest message below the bound with enough history and an open
    gate), the same for messages that only the gate blocked, safe_exclude, shift_gate_blocked. Null bound: none is safe."""
    low = F.coalesce((F.col(score) < bound) & (F.col("eligible_history_count") >= minimum_history), F.lit(False))
    gate = F.lit(True) if allowed is None else F.coalesce(allowed, F.lit(False))
    at = F.struct("time_to_tca", F.col(score).alias("score"))
    return (
        rows.groupBy(*keys).agg(F.min("y").alias("y"), F.max(F.when(low & gate, at)).alias("s"), F.max(F.when(low & ~gate, at)).alias("b"))
        .select(
            *keys, "y", F.col("s.time_to_tca").alias("first_safe_tca"), F.col("s.score").alias("first_safe_score"), F.col("b.time_to_tca").alias("first_blocked_safe_tca"),
            F.col("b.score").alias("first_blocked_safe_score"), F.col("s").isNotNull().alias("safe_exclude"), (F.col("s").isNull() & F.col("b").isNotNull()).alias("shift_gate_blocked"),
        )
    )


def policy_metrics(decisions: DataFrame, groups: tuple[str, ...] = (), confidence: float | None = 0.95) -> DataFrame:
    """Counts and rates of decisions per group: danger (positives excluded), safe negatives, overall, gate-blocked, and the median
    time of first exclusion. Rates over no events are null."""
    safe = F.col("safe_exclude")
    decisions = cut(decisions.select(*groups, "y", "safe_exclude", "shift_gate_blocked", "first_safe_tca"))
    medians = quantiles(decisions.filter(safe), groups, "first_safe_tca", (0.5,))
    out = decisions.groupBy(*groups).agg(
        F.count(F.lit(1)).alias("n_events"), F.count_if(F.col("y") == 1).alias("n_positive"), F.count_if(F.col("y") == 0).alias("n_negative"),
        F.count_if(safe & (F.col("y") == 1)).alias("danger"), F.count_if(safe & (F.col("y") == 0)).alias("safe_negative"), F.count_if(F.col("shift_gate_blocked")).alias("gate_blocked"),
    )
    out = with_quantiles(out, groups, medians).withColumn("median_first_safe_tca", F.col("q")[0]).drop("q")
    out = out.withColumns({
        "danger_rate": F.try_divide("danger", "n_positive"), "safe_negative_rate": F.try_divide("safe_negative", "n_negative"),
        "safe_rate": F.try_divide(F.col("danger") + F.col("safe_negative"), F.col("n_events")),
    })
    return out if confidence is None else out.withColumn("danger_upper", cp_upper_column(F.col("danger"), F.col("n_positive"), confidence))


def evaluate_threshold(events: DataFrame, bound: float, confidence: float | None = 0.95) -> DataFrame:
    """Counts and rates of the rule min_score < bound over an event table."""
    safe = F.col("min_score") < F.lit(float(bound))
    out = events.agg(
        F.count_if(safe & (F.col("y") == 1)).alias("danger"), F.count_if(F.col("y") == 1).alias("n_positive"), F.count_if(safe & (F.col("y") == 0)).alias("safe_negative"),
        F.count_if(F.col("y") == 0).alias("n_negative"), F.count_if(safe).alias("safe"), F.count(F.lit(1)).alias("n_events"),
    ).withColumns({"danger_rate": F.try_divide("danger", "n_positive"), "safe_negative_rate": F.try_divide("safe_negative", "n_negative"), "safe_rate": F.try_divide("safe", "n_events")})
    return out if confidence is None else out.withColumn("danger_upper", cp_upper_column(F.col("danger"), F.col("n_positive"), confidence))
