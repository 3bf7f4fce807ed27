"""Normalized messages: derived columns of the adapter, clustering in time, and the message and score tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skysieve.functions.checks import finite
from skysieve.functions.keys import event_key, finite_or_null
from skysieve.operators.sessions import stretches

MESSAGE_FIELDS = (
    "risk", "max_risk_estimate", "max_risk_scaling", "miss_distance", "relative_speed", "mahalanobis_distance", "t_position_covariance_det", "c_position_covariance_det",
    "t_obs_available", "t_obs_used", "t_weighted_rms", "c_obs_available", "c_obs_used", "c_weighted_rms",
)


def first_rows(rows: DataFrame, keys: tuple[str, ...], row_id: str) -> DataFrame:
    """The row with the lowest `row_id` of each key. The aggregation holds one row per key and combines in map tasks, so a key with
    many copies is no hot task."""
    rest = [c for c in rows.columns if c not in (*keys, row_id)]
    return rows.groupBy(*keys).agg(F.min(F.struct(row_id, *rest)).alias("__r")).select(*keys, "__r.*")


def messages(cdm: DataFrame) -> DataFrame:
    """One row per event and time to closest approach (the lowest cdm_no), NaN as null."""
    rows = cdm.select(
        "cdm_no", event_key(F.col("event_id")).alias("event_id"), "event_pair", "source_message_id", F.col("creation_date").cast("timestamp").alias("creation_date"), F.col("tca").cast("timestamp").alias("tca"),
        finite_or_null(F.col("time_to_tca")).alias("time_to_tca"), *(finite_or_null(F.col(f)).alias(f) for f in MESSAGE_FIELDS), "mission_id", "c_object_type",
    )
    return first_rows(rows.filter(F.col("event_id").isNotNull() & F.col("time_to_tca").isNotNull()), ("event_id", "time_to_tca"), "cdm_no")


def scored(diagnostics: DataFrame) -> DataFrame:
    """Scored messages, one per event and time (the lowest diag_no), each event with one label (its greatest) and one fold
    (its least)."""
    keyed = diagnostics.select(
        "diag_no", event_key(F.col("event_id")).alias("event_id"), finite_or_null(F.col("time_to_tca")).alias("time_to_tca"), "y", "fold", finite_or_null(F.col("score")).alias("score"),
        *(finite_or_null(F.col(f)).alias(f) for f in ("risk", "max_risk_estimate", "miss_distance", "mahalanobis_distance")),
    ).filter("event_id is not null and time_to_tca is not null and score is not null")
    events = keyed.groupBy("event_id").agg(F.coalesce(F.max("y"), F.lit(0)).alias("y"), F.coalesce(F.min("fold"), F.lit(0)).alias("fold"))
    return first_rows(keyed.drop("y", "fold"), ("event_id", "time_to_tca"), "diag_no").join(events, "event_id")


def log_probability(p: Column) -> Column:
    """log10 of a probability; null unless it is positive and finite."""
    return F.when((p > 0) & (p < float("inf")), F.log10(p))


def number(text: Column) -> Column:
    """A number from text; null where there is none."""
    value = F.expr("try_cast({} as double)".format(f"`{text}`")) if isinstance(text, str) else text.try_cast("double")
    return F.when(~F.isnan(value), value)


def with_unit(value: Column, unit: Column, allowed: tuple[str, ...]) -> Column:
    """A number whose unit is missing or one of `allowed`; any other unit is an error."""
    plain = F.lower(F.btrim(unit))
    return F.when(plain.isNull() | (plain == "") | plain.isin(*(a.lower() for a in allowed)), number(value)).otherwise(F.raise_error(F.concat(F.lit("unexpected unit "), plain)).cast("double"))


def days_between(creation: Column, tca: Column) -> Column:
    return (F.unix_micros(tca) - F.unix_micros(creation)) / 86_400_000_000.0


def covariance_determinant(rr: Column, tr: Column, tt: Column, nr: Column, nt: Column, nn: Column) -> Column:
    """Determinant of a symmetric 3x3 matrix from its lower triangle; null unless positive and finite."""
    det = rr * (tt * nn - nt * nt) - tr * (tr * nn - nt * nr) + nr * (tr * nt - tt * nr)
    return F.when((det > 0) & (det < float("inf")), det)


def mahalanobis(r: tuple[Column, Column, Column], a: tuple[Column, ...], b: tuple[Column, ...], given: Column) -> Column:
    """The given distance, else the square root of r' (A + B)^-1 r from the lower triangles (rr, tr, tt, nr, nt, nn), by cofactors
    where A + B is well conditioned, and otherwise by a pseudo-inverse in Arrow batches."""
    import numpy as np
    import pandas as pd

    rr, tr, tt, nr, nt, nn = (x + y for x, y in zip(a, b))
    det = rr * (tt * nn - nt * nt) - tr * (tr * nn - nt * nr) + nr * (tr * nt - tt * nr)
    x, y, z = r
    form = (
        x * x * (tt * nn - nt * nt) + y * y * (rr * nn - nr * nr) + z * z * (rr * tt - tr * tr)
        + 2 * (x * y * (nr * nt - tr * nn) + x * z * (tr * nt - nr * tt) + y * z * (nr * tr - rr * nt))
    )
    scale = F.abs(rr) * F.abs(tt) * F.abs(nn)
    square = form / det
    square = F.when(finite(square), F.when(square < 0, 0.0).otherwise(square))

    def by_pinv(columns: pd.DataFrame) -> pd.Series:
        out = []
        for v in columns.to_numpy(dtype=float):
            if not np.isfinite(v).all():
                out.append(None)
                continue
            p, m = v[:3], np.array([[v[3], v[4], v[6]], [v[4], v[5], v[7]], [v[6], v[7], v[8]]])
            out.append(float(np.sqrt(max(0.0, p @ np.linalg.pinv(m) @ p))))
        return pd.Series(out, dtype="float64")

    by_pinv.__annotations__ = {"columns": pd.DataFrame, "return": pd.Series}
    pinv = F.pandas_udf(by_pinv, "double")
    named = [c.cast("double").alias(f"v{i}") for i, c in enumerate((x, y, z, rr, tr, tt, nr, nt, nn))]
    return F.coalesce(given, F.when(det > scale * 1e-9, F.sqrt(square)).otherwise(pinv(F.struct(*named))))


def tca_clusters(rows: DataFrame, tolerance_s: float = 1800.0, pair: str = "event_pair", time: str = "tca") -> DataFrame:
    """Add cluster_no and cluster_id: messages of a pair by closest approach, cut where the gap to the previous message exceeds the
    tolerance; an equal gap stays together, and gaps chain. Messages without a pair or a closest approach are left out. The cuts come from one
    row per pair and cell of time, so a pair costs its span of time and not its number of messages."""
    placed = rows.filter(F.col(pair).isNotNull() & F.col(time).isNotNull()).withColumns({"__pair_of": F.col(pair), "low_s": F.unix_micros(F.col(time)) / 1e6, "high_s": F.unix_micros(F.col(time)) / 1e6})
    return (
        stretches(placed, tolerance_s, "__pair_of").withColumn("cluster_no", F.col("stretch").cast("int")).drop("__pair_of", "low_s", "high_s", "stretch")
        .withColumn("cluster_id", F.concat(F.lit("ext-"), F.substring(F.sha2(F.concat_ws("|", pair, F.col("cluster_no").cast("string")), 256), 1, 24)))
    )
