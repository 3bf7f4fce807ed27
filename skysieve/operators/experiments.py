"""Cross-fitted calibration, ensembles, subgroups, paired comparisons and stability, each as one relational plan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skysieve.functions.stats import mcnemar_column
from skysieve.operators.calibrate import INFINITE, policy_metrics, thresholds
from skysieve.operators.contracts import enough_folds
from skysieve.operators.gate import event_gate_bounds, gate_score, robust_scale
from skysieve.operators.ranking import quantiles, ranked_within, with_quantiles
from skysieve.session import cut

ENSEMBLES = {
    "baseline": lambda a, b: a, "candidate": lambda a, b: b, "arithmetic": lambda a, b: (a + b) / 2,
    "geometric": lambda a, b: F.sqrt(a * b), "maximum": lambda a, b: F.greatest(a, b), "minimum": lambda a, b: F.least(a, b),
}


def ensemble_scores(rows: DataFrame, left: str, right: str) -> DataFrame:
    """Add the combinations of two scores in [0, 1] as columns named like ENSEMBLES; a missing score makes all but its own null."""
    a, b = F.col(left), F.col(right)
    both = a.isNotNull() & b.isNotNull()
    return rows.withColumns({name: F.when(both, f(a, b)) for name, f in ENSEMBLES.items()})


def unpivot_methods(rows: DataFrame, methods: tuple[str, ...]) -> DataFrame:
    keep = [c for c in rows.columns if c not in methods]
    pairs = ", ".join(f"'{m}', cast(`{m}` as double)" for m in methods)
    return rows.select(*keep, F.expr(f"stack({len(methods)}, {pairs}) as (method, score)"))


def _complement_bounds(events: DataFrame, keys: tuple[str, ...], folds: DataFrame, alpha: float, mode: str, confidence: float) -> DataFrame:
    """keys, eval_fold, n_positive, rank, bound calibrated on the positives of all other folds. The folds are a handful of rows
    and the positives few, so pairing them is cheap."""
    others = events.filter("y = 1").join(folds, F.col("fold") != F.col("eval_fold"))
    return thresholds(others, (*keys, "eval_fold"), alpha, mode, confidence)


def crossfit_decisions(rows: DataFrame, minimum_histories: tuple[int, ...] = (1,), alpha: float = 0.1, mode: str = "marginal", confidence: float = 0.95) -> DataFrame:
    """Decisions on each fold by bounds from the others, for each method (column `method`, score in `score`) and least history, in one
    plan: method, minimum_history, fold, event_id, y, rank, bound, first_safe_tca, first_safe_score, safe_exclude, shift_gate_blocked."""
    grid = F.array(*map(F.lit, minimum_histories))
    per_event = rows.groupBy("method", "event_id").agg(
        F.min("y").alias("y"), F.min("fold").alias("fold"),
        F.array(*(F.coalesce(F.min(F.when(F.col("eligible_history_count") >= m, F.col("score"))), F.lit(INFINITE)) for m in minimum_histories)).alias("least"),
    )
    events = per_event.select("method", "event_id", "y", "fold", F.explode(F.arrays_zip(grid.alias("minimum_history"), F.col("least").alias("min_score"))).alias("g")).select("method", "event_id", "y", "fold", F.col("g.minimum_history").alias("minimum_history"), F.col("g.min_score").alias("min_score"))
    folds = events.select(F.col("fold").alias("eval_fold")).distinct()
    bounds = _complement_bounds(events, ("method", "minimum_history"), folds, alpha, mode, confidence).select(
        F.col("method").alias("m"), F.col("minimum_history").alias("h"), "eval_fold", "rank", "bound"
    )
    decided = rows.join(bounds, (F.col("method") == F.col("m")) & (F.col("fold") == F.col("eval_fold")))
    low = F.coalesce((F.col("score") < F.col("bound")) & (F.col("eligible_history_count") >= F.col("h")), F.lit(False))
    return (
        decided.groupBy("method", F.col("h").alias("minimum_history"), "fold", "event_id")
        .agg(F.min("y").alias("y"), F.min("rank").alias("rank"), F.min("bound").alias("bound"), F.max(F.when(low, F.struct("time_to_tca", "score"))).alias("s"))
        .select("method", "minimum_history", "fold", "event_id", "y", "rank", "bound", F.col("s.time_to_tca").alias("first_safe_tca"), F.col("s.score").alias("first_safe_score"), F.col("s").isNotNull().alias("safe_exclude"), F.lit(False).alias("shift_gate_blocked"))
    )


def crossfit_summary(decisions: DataFrame, confidence: float | None = None) -> DataFrame:
    per_fold = decisions.groupBy("method", "minimum_history").agg(F.min("rank").alias("rank_min"), F.max("rank").alias("rank_max"), F.min("bound").alias("bound_min"), F.max("bound").alias("bound_max"))
    metrics = policy_metrics(decisions, ("method", "minimum_history"), confidence)
    return metrics.join(per_fold, ["method", "minimum_history"])


def fold_roles(folds: DataFrame) -> DataFrame:
    """eval_fold, fold, role: of the folds in order, the next one calibrates the policy, the one after it the gate, and the rest fit
    the gate."""
    ordered = ranked_within(folds.select("fold").distinct(), (), ("fold",), "position", "n")
    a, b = ordered.alias("a"), ordered.select("fold", "position").alias("b")
    ahead = F.pmod(F.col("b.position") - F.col("a.position"), F.col("a.n"))
    role = F.when(ahead == 0, "evaluation").when(ahead == 1, "policy_calibration").when(ahead == 2, "gate_calibration").otherwise("gate_fit")
    return a.join(b, F.col("a.n") >= 1).select(F.col("a.fold").alias("eval_fold"), F.col("b.fold").alias("fold"), role.alias("role"))


def crossfit_gate(rows: DataFrame, features: tuple[str, ...], minimum_history: int = 1, alpha: float = 0.1, gate_alpha: float = 0.05, mode: str = "marginal", confidence: float = 0.95) -> DataFrame:
    """Gated decisions on each fold: the gate is fitted and calibrated, and the bound calibrated, on folds by fold_roles. A blocked
    message is left out before the least score is taken, so an event with none left keeps infinity and its place. Under five folds are an error."""
    roles = fold_roles(enough_folds(rows))
    placed = rows.join(roles, "fold")
    scales = robust_scale(placed.filter("role = 'gate_fit'"), features, ("eval_fold",))
    wide = scales.groupBy("eval_fold").agg(*(x for f in features for x in (F.max(F.when(F.col("feature") == f, F.col("location"))).alias(f"__l_{f}"), F.max(F.when(F.col("feature") == f, F.col("scale"))).alias(f"__s_{f}"))))
    shifted = placed.filter("role <> 'gate_fit'").join(wide, "eval_fold").withColumn("shift_score", gate_score({f: (F.col(f"__l_{f}"), F.col(f"__s_{f}")) for f in features}))
    gates = event_gate_bounds(shifted.filter("role = 'gate_calibration'"), ("eval_fold",), gate_alpha).select("eval_fold", "gate_bound")
    gated = shifted.join(gates, "eval_fold").withColumn("allowed", (F.col("shift_score") < INFINITE) & (F.col("shift_score") <= F.col("gate_bound")))
    open_ = F.col("allowed") & (F.col("eligible_history_count") >= minimum_history)
    calibration = gated.filter("role = 'policy_calibration'").groupBy("eval_fold", "event_id").agg(F.min("y").alias("y"), F.coalesce(F.min(F.when(open_, F.col("score"))), F.lit(INFINITE)).alias("min_score"))
    bounds = thresholds(calibration, ("eval_fold",), alpha, mode, confidence).select("eval_fold", "rank", "bound")
    judged = gated.filter("role = 'evaluation'").join(bounds, "eval_fold", "left")
    low = F.coalesce((F.col("score") < F.col("bound")) & (F.col("eligible_history_count") >= minimum_history), F.lit(False))
    at = F.struct("time_to_tca", "score")
    return (
        judged.groupBy("fold", "event_id")
        .agg(F.min("y").alias("y"), F.max(F.when(low & F.col("allowed"), at)).alias("s"), F.max(F.when(low & ~F.col("allowed"), at)).alias("b"), F.bool_or(~F.col("allowed")).alias("flagged"))
        .select("fold", "event_id", "y", "flagged", F.col("s.time_to_tca").alias("first_safe_tca"), F.col("s").isNotNull().alias("safe_exclude"), (F.col("s").isNull() & F.col("b").isNotNull()).alias("shift_gate_blocked"))
    )


def subgroup_metrics(decisions: DataFrame, groups: tuple[str, ...]) -> DataFrame:
    """One row per value of each grouping column (null is a value), from one pass: grouping, value, counts, rates."""
    safe = F.col("safe_exclude")
    pairs = ", ".join(f"'{g}', cast(`{g}` as string)" for g in groups)
    out = decisions.select("y", "safe_exclude", F.expr(f"stack({len(groups)}, {pairs}) as (grouping, value)"))
    return out.groupBy("grouping", "value").agg(
        F.count(F.lit(1)).alias("n_events"), F.count_if(F.col("y") == 1).alias("n_positive"), F.count_if(safe & (F.col("y") == 1)).alias("danger"), F.count_if(safe & (F.col("y") == 0)).alias("safe_negative"), F.count_if(F.col("y") == 0).alias("n_negative"),
    ).withColumns({"danger_rate": F.try_divide("danger", "n_positive"), "safe_negative_rate": F.try_divide("safe_negative", "n_negative")})


def paired_decisions(baseline: DataFrame, candidate: DataFrame) -> DataFrame:
    """Decisions of two methods side by side; events that one of them lacks are left out."""
    a, b = baseline.alias("a"), candidate.alias("b")
    return a.join(b, (F.col("a.event_id") == F.col("b.event_id")) & (F.col("a.y") == F.col("b.y"))).select(
        "a.event_id", "a.y", F.col("a.safe_exclude").alias("safe_baseline"), F.col("b.safe_exclude").alias("safe_candidate"),
        F.col("a.first_safe_tca").alias("tca_baseline"), F.col("b.first_safe_tca").alias("tca_candidate"),
    )


def paired_change(pairs: DataFrame, groups: tuple[str, ...] = (), test: bool = True) -> DataFrame:
    """Gained, lost and net safe negatives of the candidate, the exact McNemar p, and the median change of time where both exclude."""
    negative = F.col("y") == 0
    pairs = cut(pairs.select(*groups, "y", "safe_baseline", "safe_candidate", "tca_baseline", "tca_candidate"))
    both = pairs.filter(negative & F.col("safe_candidate") & F.col("safe_baseline")).withColumn("__change", F.col("tca_candidate") - F.col("tca_baseline"))
    medians = quantiles(both, groups, "__change", (0.5,))
    out = pairs.groupBy(*groups).agg(
        F.count_if(negative).alias("n_negative"), F.count_if(negative & F.col("safe_candidate") & ~F.col("safe_baseline")).alias("gained"), F.count_if(negative & ~F.col("safe_candidate") & F.col("safe_baseline")).alias("lost"),
    )
    out = with_quantiles(out, groups, medians).withColumn("median_time_change", F.col("q")[0]).drop("q").withColumn("net", F.col("gained") - F.col("lost"))
    return out.withColumn("mcnemar_p", mcnemar_column(F.col("gained"), F.col("lost"))) if test else out


def pareto_frontier(summary: DataFrame, danger: str = "danger", coverage: str = "safe_negative") -> DataFrame:
    """Add on_frontier: no other row has at most as much danger and at least as much coverage with one of them better. As the
    frontier is monotone, each danger level is compared with the best coverage at or below it; the levels are few."""
    best = summary.groupBy(F.col(danger).alias("__d")).agg(F.max(coverage).alias("__c"))
    beaten = summary.alias("s").join(best.alias("o"), (F.col("o.__d") <= F.col(f"s.{danger}")) & (F.col("o.__c") >= F.col(f"s.{coverage}")) & ((F.col("o.__d") < F.col(f"s.{danger}")) | (F.col("o.__c") > F.col(f"s.{coverage}"))), "left_semi")
    lost = beaten.select(*summary.columns).withColumn("on_frontier", F.lit(False))
    kept = summary.alias("s").join(best.alias("o"), (F.col("o.__d") <= F.col(f"s.{danger}")) & (F.col("o.__c") >= F.col(f"s.{coverage}")) & ((F.col("o.__d") < F.col(f"s.{danger}")) | (F.col("o.__c") > F.col(f"s.{coverage}"))), "left_anti")
    return lost.unionByName(kept.withColumn("on_frontier", F.lit(True)))


def repeated_stability(rows: DataFrame, repeats: int, minimum_history: int = 1, alpha: float = 0.1, mode: str = "marginal", confidence: float = 0.95, seed: str = "stability") -> DataFrame:
    """method, repeat, n_positive, rank, danger, safe_negative, ... of `repeats` halvings of the events, stratified by label: in every repeat the
    events of a class are ranked by a hash of repeat and event, the first half of them (rounded down) calibrates and the rest is evaluated. All
    methods share the halves and all repeats are one plan."""
    events = rows.groupBy("method", "event_id").agg(F.min("y").alias("y"), F.coalesce(F.min(F.when(F.col("eligible_history_count") >= minimum_history, F.col("score"))), F.lit(INFINITE)).alias("min_score"))
    drawn = rows.groupBy("event_id").agg(F.min("y").alias("y")).withColumn("repeat", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    drawn = drawn.withColumn("__hash", F.sha2(F.concat_ws(":", F.lit(seed), F.col("repeat").cast("string"), "event_id"), 256))
    halves = ranked_within(drawn, ("repeat", "y"), ("__hash", "event_id"), "__i", "__n").select("event_id", "repeat", (2 * F.col("__i") > F.col("__n")).cast("int").alias("half"))
    halved = cut(events.join(halves, "event_id"))
    bounds = thresholds(halved.filter("half = 0"), ("method", "repeat"), alpha, mode, confidence)
    safe = F.coalesce(F.col("min_score") < F.col("bound"), F.lit(False))
    return (
        halved.filter("half = 1").join(bounds.select("method", "repeat", "rank", "bound"), ["method", "repeat"], "left").groupBy("method", "repeat")
        .agg(F.max("rank").alias("rank"), F.count_if(F.col("y") == 1).alias("n_positive"), F.count_if(safe & (F.col("y") == 1)).alias("danger"), F.count_if(F.col("y") == 0).alias("n_negative"), F.count_if(safe & (F.col("y") == 0)).alias("safe_negative"))
        .withColumns({"danger_rate": F.try_divide("danger", "n_positive"), "safe_negative_rate": F.try_divide("safe_negative", "n_negative")})
    )


def stability_summary(repeated: DataFrame, alpha: float) -> DataFrame:
    q = "percentile(safe_negative_rate, array(0.05, 0.5, 0.95))"
    return repeated.groupBy("method").agg(
        F.count(F.lit(1)).alias("repeats"), F.avg("safe_negative_rate").alias("mean_safe_negative_rate"), F.expr(q).alias("q"),
        F.avg((F.col("danger_rate") <= alpha).cast("double")).alias("within_alpha"),
    ).select("method", "repeats", "mean_safe_negative_rate", F.col("q")[0].alias("q05"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q95"), "within_alpha")
