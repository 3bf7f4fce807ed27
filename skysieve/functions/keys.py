"""Canonical forms of identifiers, designators, pairs, cohorts and readings, as Spark columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Spellings, in upper case and without outer blanks, that stand for "no value" (fixed values).
PLACEHOLDERS = (
    "", "-", "--", "?", "??", "0", "N/A", "NA", "N.A.", "NAN", "NIL", "NONE", "NULL", "TBD", "UNCATALOGED", "UNCATALOGUED", "UNCORRELATED", "UNDEFINED",
    "UNIDENTIFIED", "UNKNOWN", "__MISSING__",
)

#: Characters that count as outer blanks.
BLANKS = " \t\r\n\x0b\x0c\u00a0\u2003\u2009\u200b\u3000\ufeff"


def stripped(column: Column) -> Column:
    return F.btrim(column, F.lit(BLANKS))


def usable(column: Column) -> Column:
    """Upper case without outer blanks; null where nothing or a placeholder is given."""
    key = F.upper(stripped(column))
    return F.when(~key.isin(*PLACEHOLDERS), key)


def message_key(column: Column) -> Column:
    """The form in which message identifiers are compared: letter case and outer blanks do not count; null, blank and
    placeholder identifiers are unusable and give null."""
    return usable(column)


def event_key(column: Column) -> Column:
    """Canonical event identifier `ext-` and 24 lower-case hex digits, from any spelling of prefix, case and blanks;
    identifiers of another form come back in lower case; null where nothing usable is given."""
    plain = F.lower(usable(column))
    digits = F.regexp_extract(plain, r"^(?:ext[-_ ]?)?([0-9a-f]{24})$", 1)
    return F.when(digits != "", F.concat(F.lit("ext-"), digits)).otherwise(plain)


def cohort_key(column: Column) -> Column:
    """`calibration` or `evaluation` from any unambiguous spelling or shortening of at least four letters, else null."""
    plain = F.lower(usable(column))
    long_enough = F.length(plain) >= 4
    return (
        F.when(long_enough & F.lit("calibration").startswith(plain), F.lit("calibration"))
        .when(long_enough & F.lit("evaluation").startswith(plain), F.lit("evaluation"))
    )


def finite_or_null(column: Column) -> Column:
    """NaN means missing; infinities are values."""
    value = column.cast("double")
    return F.when(~F.isnan(value), value)


def with_designator(df: DataFrame, source: Column, target: str, aliases: DataFrame | None, bare_words: bool = True) -> DataFrame:
    """Add `target`: the canonical designator of `source`, with aliases (alias_designator, designator) resolved
    regardless of letter case and outer blanks. Null where nothing or a placeholder is given; unless bare_words, also for words
    without a digit that are no alias: catalogue numbers, launch numbers and numbered names all have one. The alias table
    joins without a hint, so its measured size decides between broadcast and shuffle."""
    raw = f"__raw_{target}"
    df = df.withColumn(raw, usable(source))
    plain = F.col(raw) if bare_words else F.when(F.col(raw).rlike("[0-9]"), F.col(raw))
    if aliases is None:
        return df.withColumn(target, plain).drop(raw)
    table = (
        aliases.select(usable(F.col("alias_designator")).alias(f"__alias_{target}"), usable(F.col("designator")).alias(f"__to_{target}"))
        .filter(F.col(f"__alias_{target}").isNotNull() & F.col(f"__to_{target}").isNotNull())
        .groupBy(f"__alias_{target}")
        .agg(F.min(f"__to_{target}").alias(f"__to_{target}"))
    )
    return (
        df.join(table, F.col(raw) == F.col(f"__alias_{target}"), "left")
        .withColumn(target, F.coalesce(F.col(f"__to_{target}"), plain))
        .drop(raw, f"__alias_{target}", f"__to_{target}")
    )


def with_pair_key(df: DataFrame, aliases: DataFrame | None, source: str = "event_pair", target: str = "pair_key") -> DataFrame:
    """Add `target`: both designators of a `|`-joined pair in canonical form and order; null unless both objects are
    identified."""
    parts = F.split(F.col(source), r"\|")
    df = with_designator(df, F.try_element_at(parts, F.lit(1)), "__first", aliases, bare_words=False)
    df = with_designator(df, F.try_element_at(parts, F.lit(2)), "__second", aliases, bare_words=False)
    both = F.col("__first").isNotNull() & F.col("__second").isNotNull() & (F.size(parts) == 2)
    return df.withColumn(
        target, F.when(both, F.concat_ws("|", F.least("__first", "__second"), F.greatest("__first", "__second")))
    ).drop("__first", "__second")
