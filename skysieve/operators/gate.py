"""A conformal applicability gate: robust distance of a message from calibration messages."""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass, field
from math import inf, isfinite
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skysieve.functions.checks import finite
from skysieve.operators.ranking import quantiles, ranked_within, with_quantiles


def robust_scale(rows: DataFrame, features: tuple[str, ...], groups: tuple[str, ...] = ()) -> DataFrame:
    """groups, feature, location, scale: the median and (q75 - q25) / 1.349 of present, finite values; where that is not positive the
    population standard deviation, and where that is not either, 1."""
    pairs = ", ".join(f"'{f}', cast(`{f}` as double)" for f in features)
    values = rows.select(*groups, F.expr(f"stack({len(features)}, {pairs}) as (feature, x)")).filter(finite(F.col("x")))
    found = quantiles(values, (*groups, "feature"), "x", (0.25, 0.5, 0.75))
    return (
        with_quantiles(values.groupBy(*groups, "feature").agg(F.stddev_pop("x").alias("sd")), (*groups, "feature"), found)
        .withColumn("iqr", (F.col("q")[2] - F.col("q")[0]) / 1.349)
        .select(*groups, "feature", F.col("q")[1].alias("location"), F.when(F.col("iqr") > 0, F.col("iqr")).when(F.col("sd") > 0, F.col("sd")).otherwise(1.0).alias("scale"))
    )


def gate_score(features: dict[str, tuple[Column, Column]]) -> Column:
    """Greatest |x - location| / scale over the features; infinity where any is missing or not finite."""
    present, parts = F.lit(True), []
    for name, (location, scale) in features.items():
        x = F.col(name).cast("double")
        present = present & finite(x)
        parts.append(F.abs(x - location) / scale)
    return F.when(present, F.greatest(*parts) if len(parts) > 1 else parts[0]).otherwise(F.lit(inf))


def event_gate_bounds(scores: DataFrame, groups: tuple[str, ...], alpha: float, value: str = "shift_score") -> DataFrame:
    """groups, n_events, rank, gate_bound: the ceil((n + 1)(1 - alpha))-th of the events' greatest scores, infinity if there are fewer."""
    events = scores.groupBy(*groups, "event_id").agg(F.max(value).alias("__v"))
    ordered = ranked_within(events, groups, ("__v", "event_id"), "__i", "n_events").withColumn("rank", F.ceil((F.col("n_events") + 1) * F.lit(1 - alpha)).cast("int"))
    return ordered.groupBy(*groups, "n_events", "rank").agg(F.coalesce(F.min(F.when(F.col("__i") == F.col("rank"), F.col("__v"))), F.lit(inf)).alias("gate_bound"))


@dataclass
class ShiftGate:
    """A fitted gate: fit and calibrate read tables, allows is a column for batch and streaming plans alike."""

    features: tuple[str, ...]
    alpha: float = 0.05
    location: dict[str, float] = field(default_factory=dict)
    scale: dict[str, float] = field(default_factory=dict)
    threshold: float | None = None

    def __post_init__(self) -> None:
        if not self.features or len(set(self.features)) != len(self.features) or not 0 < self.alpha < 1:
            raise ValueError("a gate needs distinct features and an alpha between 0 and 1")

    def fit(self, rows: DataFrame) -> ShiftGate:
        found = {r["feature"]: r for r in robust_scale(rows, self.features).collect()}
        missing = [f for f in self.features if f not in found]
        if missing:
            raise ValueError(f"no finite value of {', '.join(missing)}")
        self.location = {f: float(found[f]["location"]) for f in self.features}
        self.scale = {f: float(found[f]["scale"]) for f in self.features}
        return self

    def score(self) -> Column:
        return gate_score({f: (F.lit(self.location[f]), F.lit(self.scale[f])) for f in self.features})

    def calibrate(self, rows: DataFrame, by_event: bool = True) -> ShiftGate:
        scored = rows.withColumn("shift_score", self.score())
        if not by_event:
            scored = scored.withColumn("event_id", F.monotonically_increasing_id())
        found = event_gate_bounds(scored, (), self.alpha).first()
        self.threshold = float(found["gate_bound"]) if found else inf
        return self

    def allows(self) -> Column:
        """Finite and within the threshold; an infinite threshold still blocks messages with a missing feature."""
        if self.threshold is None:
            raise ValueError("the gate is not calibrated")
        return (self.score() < inf) & (self.score() <= F.lit(self.threshold))

    def payload(self) -> dict:
        out = asdict(self) | {"features": list(self.features), "schema": 1}
        return out | {"threshold": self.threshold if self.threshold is None or isfinite(self.threshold) else None, "unbounded": self.threshold == inf}

    def fingerprint(self) -> str:
        return hashlib.sha256(json.dumps(self.payload(), sort_keys=True).encode()).hexdigest()

    def save(self, path: str) -> None:
        with Path(path).open("x") as f:
            json.dump(self.payload() | {"fingerprint": self.fingerprint()}, f, sort_keys=True)

    @classmethod
    def load(cls, path: str) -> ShiftGate:
        p = json.loads(Path(path).read_text())
        gate = cls(tuple(p["features"]), p["alpha"], p["location"], p["scale"], inf if p["unbounded"] else p["threshold"])
        if gate.fingerprint() != p["fingerprint"]:
            raise ValueError("the gate file was changed")
        return gate


