"""Implausible readings: impossible values, stuck values and spikes against what a source usually reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skysieve.functions.keys import finite_or_null, usable, with_designator
from skysieve.session import cut

#: What no pair of objects in orbit round the Earth can exceed: metres of separation across the sphere in which the
#: Earth holds satellites (radius 1.5e9 m), m/s of closing speed at twice the escape velocity, and the determinant of a
#: position covariance with that separation as every standard deviation (m^6).
PHYSICAL_BOUNDS = {"miss_distance": 3.0e9, "relative_speed": 2.24e4, "t_position_covariance_det": 7.3e56}

FIELDS = tuple(PHYSICAL_BOUNDS)

#: The largest twentieth of absolute normal deviates: its least value, and mean and mean square of what exceeds it.
NORMAL_TAIL = (1.96, 0.378, 0.250)


def hour_band(time: Column) -> Column:
    """Season of a reading: the quarter of the day in which the message was made."""
    return F.floor(F.hour(time) / 6).cast("int")


def _cells(readings: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """One row per reading that is present: keys, field_name, x."""
    pairs = ", ".join(f"'{f}', `{f}`" for f in fields)
    keep = [c for c in readings.columns if c not in fields]
    return readings.select(*keep, F.expr(f"stack({len(fields)}, {pairs}) as (field_name, x)")).filter(F.col("x").isNotNull())


def impossible(field: Column, x: Column) -> Column:
    bound = reduce(lambda rest, f: F.when(field == f, F.lit(PHYSICAL_BOUNDS[f])).otherwise(rest), FIELDS, F.lit(float("inf")))
    return (x <= 0) | (x == float("inf")) | (x > bound)


def _weighted_median(counts: DataFrame, keys: list[str], value: str, out: str) -> DataFrame:
    """Median of `value` weighted by n, exact on the binned values. The rows of a key are distinct bins, whose number
    depends on the range of values and not on the number of readings."""
    w = Window.partitionBy(*keys).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    total = Window.partitionBy(*keys)
    return (
        counts.groupBy(*keys, value).agg(F.sum("n").alias("n"))
        .withColumn("c", F.sum("n").over(w)).withColumn("t", F.sum("n").over(total))
        .filter(F.col("c") * 2 >= F.col("t"))
        .groupBy(*keys).agg(F.min(value).alias(out), F.max("t").alias(f"{out}_n"))
    )


def source_profile(cells: DataFrame, source: str, bins_per_unit: int = 500, season_weight: float = 500.0, screen: float = 6.0, tail_share: float = 0.05, risk: float = 1e-7, prior_peaks: float = 50.0) -> DataFrame:
    """Per source, field and season: centre, season_shift, spread (all robust), and the tail's u, mean_excess, shape and cutoff in spreads.

    All statistics cover all readings. They come from one histogram of the natural logarithm (1/bins_per_unit wide, a bin
    stands at the mean of its readings), which map tasks combine before the shuffle; so a source with a third of all readings is no hot group. Season medians
    are drawn towards the source's own median by season_weight readings. The spread is the median absolute
    deviation of the seasonal residuals times 1.4826.

    Peaks over threshold: the peaks of a source are the residuals, in spreads, beyond its (1 - tail_share) quantile u and nearer than
    `screen`, as what lies further off is not the tail of ordinary readings. A generalised Pareto tail is fitted to their excesses by moments and cut where a
    reading has the probability `risk` of lying beyond. The tail counts as exponential at least (shape from 0 to 0.25): a bounded one would be cut just
    beyond the largest ordinary reading seen. u, the moments and the share of peaks are drawn towards those of all sources of the field by prior_peaks
    peaks, so a source with few readings leans on the others, without a switch at any size. The cutoff is at least three spreads."""
    keys = [source, "field_name"]
    hist = cut(
        cells.withColumn("l", F.log("x")).groupBy(*keys, "season", F.floor(F.col("l") * bins_per_unit).alias("b"))
        .agg(F.count(F.lit(1)).alias("n"), F.sum("l").alias("s")).select(*keys, "season", F.round(F.col("s") / F.col("n"), 7).alias("v"), "n")
    )
    centre = _weighted_median(hist, keys, "v", "centre")
    seasons = (
        _weighted_median(hist, [*keys, "season"], "v", "season_centre")
        .join(centre, keys)
        .withColumn("season_shift", (F.col("season_centre") - F.col("centre")) * F.col("season_centre_n") / (F.col("season_centre_n") + season_weight))
        .select(*keys, "season", "centre", "season_shift")
    )
    seasons = cut(seasons)
    residual = cut(
        hist.join(seasons, [*keys, "season"])
        .withColumn("r", F.round(F.abs(F.col("v") - F.col("centre") - F.col("season_shift")), 4))
        .groupBy(*keys, "r").agg(F.sum("n").alias("n"))
    )
    spread = _weighted_median(residual, keys, "r", "mad").withColumn("spread", F.greatest(F.col("mad") * 1.4826, F.lit(1.0 / bins_per_unit)))
    down = Window.partitionBy(*keys).orderBy(F.desc("z")).rowsBetween(Window.unboundedPreceding, 0)
    scaled = residual.join(spread.select(*keys, "spread"), keys).withColumn("z", F.col("r") / F.col("spread")).filter(F.col("z") < screen)
    tail = (
        scaled.withColumn("above", F.sum("n").over(down)).withColumn("all", F.sum("n").over(Window.partitionBy(*keys)))
        .withColumn("peak", F.col("above") <= F.greatest(F.col("all") * tail_share, F.lit(1)))
    )
    moment = lambda k: F.coalesce(F.sum(F.when(F.col("peak"), F.col("n") * F.pow("z", F.lit(k)))), F.lit(0.0))
    own = cut(
        tail.groupBy(*keys, "spread")
        .agg(F.coalesce(F.max(F.when(~F.col("peak"), F.col("z"))), F.lit(0.0)).alias("u"), F.max("all").alias("all"), moment(0).alias("peaks"), moment(1).alias("s1"), moment(2).alias("s2"))
        .withColumn("e1", F.col("s1") - F.col("peaks") * F.col("u")).withColumn("e2", F.col("s2") - 2 * F.col("u") * F.col("s1") + F.col("peaks") * F.col("u") * F.col("u"))
    )
    pooled = own.groupBy("field_name").agg(*(((F.sum(x) + prior_peaks * normal) / (F.sum("peaks") + prior_peaks)).alias(y) for x, y, normal in ((F.col("u") * F.col("peaks"), "u0", NORMAL_TAIL[0]), (F.col("e1"), "m0", NORMAL_TAIL[1]), (F.col("e2"), "q0", NORMAL_TAIL[2]))))
    drawn = lambda x, y: (F.col(x) + prior_peaks * F.col(y)) / (F.col("peaks") + prior_peaks)
    fitted = (
        own.withColumn("up", F.col("u") * F.col("peaks")).join(pooled, "field_name")
        .select(*keys, "spread", drawn("up", "u0").alias("u"), drawn("e1", "m0").alias("m"), drawn("e2", "q0").alias("q"), ((F.col("peaks") + prior_peaks) / (F.col("all") + prior_peaks / tail_share) / risk).alias("ratio"))
        .withColumn("shape", F.greatest(F.lit(0.0), F.least(F.lit(0.25), F.coalesce(0.5 * (1 - F.try_divide(F.col("m") * F.col("m"), F.col("q") - F.col("m") * F.col("m"))), F.lit(0.0)))))
        .withColumn("scale", F.col("m") * (1 - F.col("shape")))
        .withColumn("reach", F.when(F.col("shape") < 1e-6, F.log("ratio")).otherwise((F.pow("ratio", "shape") - 1) / F.col("shape")))
        .select(*keys, "spread", "u", F.col("m").alias("mean_excess"), "shape", F.greatest(F.lit(3.0), F.col("u") + F.col("scale") * F.col("reach")).alias("cutoff"))
    )
    return seasons.join(fitted, keys)


def spike_cells(readings: DataFrame, source: str, fields: tuple[str, ...] = FIELDS, row_id: str = "cdm_no", risk: float = 1e-7) -> DataFrame:
    """(row_id, field_name) of readings that are impossible, or beyond the tail cutoff that their source and field have at `risk`, measured
    in spreads from the source's centre in the season. Readings of an unknown source are judged by the physical bounds alone."""
    cells = _cells(readings, fields)
    bad = cells.filter(impossible(F.col("field_name"), F.col("x"))).select(row_id, "field_name")
    good = cells.filter(~impossible(F.col("field_name"), F.col("x")) & F.col(source).isNotNull())
    # Impossible speeds still tell nothing of the usual ones; all others, spikes too, enter the robust profile.
    profile = cut(source_profile(good, source, risk=risk))
    z = F.abs(F.log("x") - F.col("centre") - F.col("season_shift")) / F.col("spread")
    far = good.join(profile, [source, "field_name", "season"]).filter(z > F.col("cutoff"))
    return bad.unionByName(far.select(row_id, "field_name"))


def _with_blocks(messages: DataFrame, hot: DataFrame, group: str, time: str, key: list[str], halo: int) -> DataFrame:
    """Add block and lent. A group in `hot` is cut at 63 quantiles of its time into blocks, each of which is lent the last and first
    `halo` messages of its neighbours; all others are in block 0. Messages of a group differ here, but not always in time: they are
    ordered by time and then by the rest of `key`, as in the runs, and messages of one time are in one block."""
    plain = messages.join(hot, group, "left_anti").withColumn("block", F.lit(0)).withColumn("lent", F.lit(False))
    large = messages.join(hot, group, "left_semi")
    cuts = large.groupBy(group).agg(F.array_distinct(F.percentile_approx(time, F.array(*[F.lit(i / 64) for i in range(1, 64)]), 10000)).alias("cuts"))
    rows = cut(large.join(cuts, group).withColumn("block", F.size(F.filter("cuts", lambda c: c <= F.col(time)))).drop("cuts"))
    at = Window.partitionBy(group, "block")
    order = [time, *(c for c in key if c not in (group, time))]
    numbered = rows.withColumn("i", F.row_number().over(at.orderBy(*order))).withColumn("j", F.row_number().over(at.orderBy(*map(F.desc, order))))
    # Blocks that are not empty follow each other once they are ranked; only their outermost messages are ranked with them.
    edge = cut(numbered.filter((F.col("i") <= halo) | (F.col("j") <= halo)).withColumn("k", F.dense_rank().over(Window.partitionBy(group).orderBy("block"))))
    names = edge.select(group, F.col("k").alias("k2"), F.col("block").alias("to")).distinct()
    before, after = (F.col("k2") > F.col("k")) & (F.col("j") <= halo), (F.col("k2") < F.col("k")) & (F.col("i") <= halo)
    lent = edge.join(names, group).filter(F.abs(F.col("k") - F.col("k2")).between(1, halo) & (before | after)).select(*key, F.col("to").alias("block"), F.lit(True).alias("lent"))
    return plain.unionByName(rows.withColumn("lent", F.lit(False))).unionByName(lent)


def stuck_cells(readings: DataFrame, group: str = "event_id", time: str = "creation_date", fields: tuple[str, ...] = FIELDS, row_id: str = "cdm_no", run: int = 4, tolerance: float = 1e-6, block_rows: int = 500_000) -> DataFrame:
    """(row_id, field_name) of readings in a run of `run` or more consecutive messages of a group, by time, between which
    the field does not move (relative difference under `tolerance`). A missing reading ends a run. Copies of a message
    (same group, time and readings) count once, and every copy of a case comes out. Messages without group or time are in no run.

    A message is in such a run exactly if one of the `run` windows of `run` messages around it does not move, so
    `run` - 1 neighbours on either side decide. Groups of over block_rows messages are cut into blocks of time, each of
    which sees that many messages of its neighbours."""
    key = [group, time, *fields]
    known = readings.filter(F.col(group).isNotNull() & F.col(time).isNotNull())
    messages = known.select(*key).distinct()
    hot = cut(known.groupBy(group).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > block_rows).select(group))
    if hot.isEmpty():
        rows = messages.withColumn("block", F.lit(0)).withColumn("lent", F.lit(False))
    else:
        rows = _with_blocks(messages, hot, group, time, key, run - 1)

    ordered = Window.partitionBy(group, "block").orderBy(time, *fields)
    still = {f: f"__still_{f}" for f in fields}
    for f in fields:
        x, y = F.col(f), F.lag(f).over(ordered)
        same = (x == y) | (F.abs(x - y) < tolerance * F.greatest(F.abs(x), F.abs(y)))
        rows = rows.withColumn(still[f], F.coalesce(same, F.lit(False)))
    found = []
    for f in fields:
        e = {k: F.coalesce((F.lead(still[f], k) if k > 0 else F.lag(still[f], -k)).over(ordered) if k else F.col(still[f]), F.lit(False)) for k in range(2 - run, run)}
        windows = [reduce(lambda a, b: a & b, [e[k] for k in range(first, first + run - 1)]) for first in range(2 - run, 2)]
        found.append(F.when(reduce(lambda a, b: a | b, windows), F.lit(f)))
    stuck = (
        rows.withColumn("field_names", F.array_compact(F.array(*found)))
        .filter(~F.col("lent") & (F.size("field_names") > 0))
        .select(*key, "field_names")
    )
    matched = reduce(lambda a, b: a & b, [F.col(f"m.{c}").eqNullSafe(F.col(f"s.{c}")) if c in fields else F.col(f"m.{c}") == F.col(f"s.{c}") for c in key])
    return known.alias("m").join(stuck.alias("s"), matched).select(f"m.{row_id}", F.explode("s.field_names").alias("field_name"))


def implausible_cells(cdm: DataFrame, aliases: DataFrame | None = None, risk: float = 1e-7) -> DataFrame:
    """cdm_no, field_name of every implausible reading of miss_distance, t_position_covariance_det and relative_speed: impossible, beyond
    the peaks-over-threshold cutoff of its source at `risk`, or stuck.

    The source is the mission: mission_id in any spelling with aliases resolved, or where that is unusable the
    object of event_pair that is no plain catalogue number. Null and NaN are missing. Rows that repeat a
    message all come out; a cdm_no in several identical rows comes out once. An empty table gives an empty result; other
    columns are not read."""
    parts = F.split("event_pair", r"\|")
    named = F.get(F.filter(parts, lambda p: F.upper(F.btrim(p)).rlike("^[A-Z]+[- ][0-9]+$")), 0)
    base = cdm.select(
        "cdm_no", "event_id", "creation_date", F.coalesce(usable(F.col("mission_id")), named).alias("__mission"),
        *(finite_or_null(F.col(f)).alias(f) for f in FIELDS),
    )
    readings = with_designator(base, F.col("__mission"), "source_key", aliases).withColumn("season", F.coalesce(hour_band(F.col("creation_date")), F.lit(-1))).drop("__mission")
    spikes = spike_cells(readings.select("cdm_no", "source_key", "season", *FIELDS), "source_key", risk=risk)
    return spikes.unionByName(stuck_cells(readings.select("cdm_no", "event_id", "creation_date", *FIELDS))).distinct()
