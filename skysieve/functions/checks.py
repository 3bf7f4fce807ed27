"""Constraints of tables, counted in one job and raised together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OUTCOME_NAMES = ("y", "label", "target", "outcome")


class ConstraintError(ValueError):
    """One or more constraints of a table are violated."""


def expect(df: DataFrame, rules: dict[str, Column], unique: tuple[str, ...] = ()) -> DataFrame:
    """`df` itself, once every row satisfies every rule (null counts as violated) and the columns `unique` identify rows."""
    counts = df.agg(*(F.count_if(~F.coalesce(rule, F.lit(False))).alias(f"r{i}") for i, rule in enumerate(rules.values())), F.count(F.lit(1)).alias("all")).first()
    wrong = [f"{name}: {counts[f'r{i}']} of {counts['all']} rows" for i, name in enumerate(rules) if counts[f"r{i}"]]
    if unique and not df.groupBy(*unique).count().filter("count > 1").isEmpty():
        wrong.append(f"{', '.join(unique)}: repeated")
    if wrong:
        raise ConstraintError("; ".join(wrong))
    return df


def outcome_columns(columns: list[str]) -> list[str]:
    """Columns that would reveal an outcome: by name, or with `final` as a part of the name."""
    return [c for c in columns if c.lower() in OUTCOME_NAMES or "final" in c.lower().replace("-", "_").split("_")]


def outcome_blind(df: DataFrame) -> DataFrame:
    found = outcome_columns(df.columns)
    if found:
        raise ConstraintError(f"outcome columns present: {', '.join(found)}")
    return df


def finite(column: Column) -> Column:
    return column.isNotNull() & ~F.isnan(column) & (F.abs(column) != float("inf"))
