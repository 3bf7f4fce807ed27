"""Causal features of message prefixes, decision windows, labels and weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skysieve.operators.ranking import ranked_within
from skysieve.session import cut

PREFIX_COLUMNS = ("risk", "max_risk_estimate", "miss_distance", "mahalanobis_distance")
SAFE_RISK = -6.0


#: Events with more messages than this are spread over tasks.
LARGE_EVENT = 500_000


def large_events(rows: DataFrame, limit: int = LARGE_EVENT) -> DataFrame | None:
    """event_id of the events with more than `limit` messages; None where there is none, as is usual."""
    large = rows.groupBy("event_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > limit).select("event_id")
    return None if large.isEmpty() else cut(large)


def _prefixes(rows: DataFrame, columns: tuple[str, ...], strict: bool, group: tuple[str, ...], carried: bool) -> DataFrame:
    """The features within a group; if carried, with what came before it in __min_, __max_, __last_, __first_, __before, __last_tca, __first_tca."""
    later = Window.partitionBy(*group).orderBy(F.desc("time_to_tca"))
    so_far, whole = later.rowsBetween(Window.unboundedPreceding, 0), later.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    out = rows
    for c in columns:
        x = F.col(c)
        low, high, first, previous = F.min(c).over(so_far), F.max(c).over(so_far), F.first(c, ignorenulls=True).over(so_far if strict else whole), F.lag(c).over(later)
        if carried:
            low, high = F.least(low, F.col(f"__min_{c}")), F.greatest(high, F.col(f"__max_{c}"))
            first = F.coalesce(f"__first_{c}", first)
            previous = F.when(F.row_number().over(later) == 1, F.col(f"__last_{c}")).otherwise(previous)
        low, high = F.when(x.isNotNull(), low), F.when(x.isNotNull(), high)
        out = out.withColumns({
            f"{c}_first": first, f"{c}_min_so_far": low, f"{c}_max_so_far": high, f"{c}_range_so_far": high - low, f"{c}_delta_first": x - first, f"{c}_delta_prev": x - previous,
        })
    n, before, start = F.row_number().over(later), F.lag("time_to_tca").over(later), F.max("time_to_tca").over(whole)
    if carried:
        n, before, start = (n + F.col("__before")).cast("int"), F.coalesce(before, F.col("__last_tca")), F.col("__first_tca")
    return out.withColumns({"n_cdm_so_far": n, "dt_prev": F.abs(F.col("time_to_tca") - before), "history_span_days": start - F.col("time_to_tca")})


def _prefixes_by_blocks(rows: DataFrame, columns: tuple[str, ...], strict: bool, blocks: int = 64) -> DataFrame:
    """The features of large events: each is cut into blocks of its time; what a block needs of those before it is one row per
    block, made by an aggregation and a window over the blocks."""
    share = F.array(*[F.lit(i / blocks) for i in range(1, blocks)])
    cuts = rows.groupBy("event_id").agg(F.array_distinct(F.percentile_approx("time_to_tca", share, 10000)).alias("__cuts"))
    placed = cut(rows.join(cuts, "event_id").withColumn("__block", F.size(F.filter("__cuts", lambda c: c >= F.col("time_to_tca")))).drop("__cuts"))
    at = lambda c, f: f(F.struct("time_to_tca", F.col(c).alias("v")))
    per = placed.groupBy("event_id", "__block").agg(
        F.count(F.lit(1)).alias("n"), F.min("time_to_tca").alias("t0"), F.max("time_to_tca").alias("t1"),
        *(x for c in columns for x in (F.min(c).alias(f"min_{c}"), F.max(c).alias(f"max_{c}"), at(c, F.min).alias(f"last_{c}"), F.max(F.when(F.col(c).isNotNull(), F.struct("time_to_tca", F.col(c).alias("v")))).alias(f"first_{c}"))),
    )
    order = Window.partitionBy("event_id").orderBy("__block")
    past = order.rowsBetween(Window.unboundedPreceding, -1)
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    carry = per.select(
        "event_id", "__block", F.coalesce(F.sum("n").over(past), F.lit(0)).alias("__before"), F.lag("t0").over(order).alias("__last_tca"), F.max("t1").over(whole).alias("__first_tca"),
        *(x for c in columns for x in (
            F.min(f"min_{c}").over(past).alias(f"__min_{c}"), F.max(f"max_{c}").over(past).alias(f"__max_{c}"), F.lag(f"last_{c}").over(order)["v"].alias(f"__last_{c}"),
            F.first(f"first_{c}", ignorenulls=True).over(past if strict else whole)["v"].alias(f"__first_{c}"),
        )),
    )
    out = _prefixes(placed.join(carry, ["event_id", "__block"]), columns, strict, ("event_id", "__block"), True)
    return out.drop(*(c for c in out.columns if c.startswith("__")))


def prefix_features(messages: DataFrame, columns: tuple[str, ...] = PREFIX_COLUMNS, strict: bool = False, limit: int = LARGE_EVENT) -> DataFrame:
    """Add, per column: _first (first value present in the event; up to the row only if strict), _min_so_far, _max_so_far,
    _range_so_far (null where the value is), _delta_first and _delta_prev; and n_cdm_so_far, dt_prev, history_span_days. One
    exchange by event serves all; events of over `limit` messages are spread over tasks."""
    large = large_events(messages, limit)
    if large is None:
        return _prefixes(messages, columns, strict, ("event_id",), False)
    usual = _prefixes(messages.join(large, "event_id", "left_anti"), columns, strict, ("event_id",), False)
    return usual.unionByName(_prefixes_by_blocks(messages.join(large, "event_id", "left_semi"), columns, strict))


def decision_window(rows: DataFrame, low: float = 2.0, high: float = 7.0) -> DataFrame:
    """Rows whose time to closest approach lies in the window, both ends included."""
    return rows.filter(F.col("time_to_tca").between(low, high))


def eligible_prefixes(rows: DataFrame, low: float = 2.0, high: float = 7.0, limit: int = LARGE_EVENT) -> DataFrame:
    """The decision window with eligible_history_count, which starts at 1 as the window opens."""
    return counted(decision_window(rows, low, high), "eligible_history_count", limit)


def counted(rows: DataFrame, name: str, limit: int = LARGE_EVENT) -> DataFrame:
    """Add the number of each message in its event as time passes."""
    large = large_events(rows, limit)
    number = F.row_number().over(Window.partitionBy("event_id").orderBy(F.desc("time_to_tca")))
    if large is None:
        return rows.withColumn(name, number)
    spread = ranked_within(rows.join(large, "event_id", "left_semi"), ("event_id",), (-F.col("time_to_tca"),), name).withColumn(name, F.col(name).cast("int"))
    return rows.join(large, "event_id", "left_anti").withColumn(name, number).unionByName(spread)


def event_labels(messages: DataFrame, mode: str = "literal") -> DataFrame:
    """event_id, y. literal: the risk of the very last message, a missing one counts as safe; literal_drop_null: such events are left out;
    first_finite: the last risk that is present, events without any are left out."""
    last = F.min_by("risk", "time_to_tca")
    if mode == "literal":
        return messages.groupBy("event_id").agg(last.alias("r")).select("event_id", F.coalesce(F.col("r") >= SAFE_RISK, F.lit(False)).cast("int").alias("y"))
    rows = messages.filter(F.col("risk").isNotNull()) if mode == "first_finite" else messages
    if mode not in ("first_finite", "literal_drop_null"):
        raise ValueError("mode must be literal, literal_drop_null or first_finite")
    return rows.groupBy("event_id").agg(last.alias("r")).filter("r is not null").select("event_id", (F.col("r") >= SAFE_RISK).cast("int").alias("y"))


def with_sizes(rows: DataFrame, name: str) -> DataFrame:
    """Add the number of messages of each message's event. They are counted per event in map tasks first and the counts joined, so no task holds
    an event."""
    counts = rows.groupBy(F.col("event_id").alias("__of")).agg(F.count(F.lit(1)).alias(name))
    return rows.join(counts, F.col("event_id").eqNullSafe(F.col("__of"))).drop("__of")


def event_weights(rows: DataFrame) -> DataFrame:
    """Add weight: every event weighs 1 in all."""
    return with_sizes(rows, "weight").withColumn("weight", F.lit(1.0) / F.col("weight"))


def tail_weights(rows: DataFrame, score: str = "score", hard_fraction: float = 0.25, hard_mass: float = 0.5) -> DataFrame:
    """Add weight: a positive event spreads 1 - hard_mass evenly over all its messages and hard_mass over its ceil(hard_fraction * n) lowest
    scores (ties by earlier message); other events weigh alike on every message. Each event weighs 1 in all."""
    if not 0 < hard_fraction <= 1 or not 0 <= hard_mass <= 1:
        raise ValueError("hard_fraction must lie in (0, 1] and hard_mass in [0, 1]")
    ranked = ranked_within(rows, ("event_id",), (score, -F.col("time_to_tca")), "__place", "__n")
    hard = F.greatest(F.lit(1), F.ceil(F.lit(hard_fraction) * F.col("__n")))
    tail = (1 - hard_mass) / F.col("__n") + F.when(F.col("__place") <= hard, hard_mass / hard).otherwise(0.0)
    return ranked.withColumn("weight", F.when(F.col("y") == 1, tail).otherwise(F.lit(1.0) / F.col("__n"))).drop("__n", "__place")


def quantile_groups(events: DataFrame, value: str, q: int, out: str = "quantile_group") -> DataFrame:
    """Add a group 1..q by rank of `value` with ties by event: edges at equal steps of the rank, the lower one open."""
    rows = ranked_within(events, (), (value, "event_id"), "__rn", "__all")
    step = F.when(F.col("__all") > 1, F.ceil((F.col("__rn") - 1) * q / (F.col("__all") - 1))).otherwise(1)
    return rows.withColumn(out, F.greatest(F.lit(1), step).cast("int")).drop("__rn", "__all")


def event_groups(window_rows: DataFrame, features: tuple[str, ...]) -> DataFrame:
    """event_id, history_group (1-4, 5-10, 11+ messages in the window), missing_group (share of features missing in the first message:
    none, low up to a tenth, high)."""
    missing = sum((F.col(f).isNull().cast("int") for f in features), F.lit(0)) / len(features)
    per = window_rows.groupBy("event_id").agg(F.count(F.lit(1)).alias("n"), F.max_by(missing, "time_to_tca").alias("m"))
    return per.select(
        "event_id", F.when(F.col("n") <= 4, "1-4").when(F.col("n") <= 10, "5-10").otherwise("11+").alias("history_group"),
        F.when(F.col("m") <= 0, "none").when(F.col("m") <= 0.10, "low").otherwise("high").alias("missing_group"),
    )


def allocation(event: Column, seed: str, fraction: float) -> Column:
    """calibration where the first 16 hex digits of SHA-256("seed:event"), as a share of 2^64, lie under `fraction`, else evaluation."""
    digits = F.substring(F.sha2(F.concat_ws(":", F.lit(seed), event), 256), 1, 16)
    share = F.conv(digits, 16, 10).cast("decimal(20,0)").cast("double") / float(2**64)
    return F.when(share < fraction, F.lit("calibration")).otherwise(F.lit("evaluation"))


def stratified_split(labels: DataFrame, fractions: dict[str, float], seed: str = "split") -> DataFrame:
    """event_id, y, part: exact class proportions in every part, in the order of a hash of the event."""
    rows = ranked_within(labels, ("y",), (F.sha2(F.concat_ws(":", F.lit(seed), "event_id"), 256), "event_id"), "__i", "__n")
    part, names = F.lit(list(fractions)[-1]), list(fractions)
    for i in range(len(names) - 2, -1, -1):
        part = F.when(F.col("__i") <= F.round(F.col("__n") * sum(fractions[x] for x in names[: i + 1])), F.lit(names[i])).otherwise(part)
    return rows.withColumn("part", part).select("event_id", "y", "part")
