"""Registered queries of the core problems and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from skysieve.functions.keys import BLANKS, PLACEHOLDERS
from skysieve.operators.delivery import surplus_deliveries
from skysieve.operators.spikes import FIELDS, NORMAL_TAIL, PHYSICAL_BOUNDS, implausible_cells
from skysieve.plans.tables import table

#: Placeholder identifiers as an SQL list.
PLACEHOLDER_SQL = "(" + ", ".join(f"'{p}'" for p in PLACEHOLDERS) + ")"

#: Outer blanks as an SQL string.
BLANKS_SQL = "(" + " || ".join(f"chr({ord(c)})" for c in BLANKS) + ")"


def usable_sql(column: str) -> str:
    key = f"upper(trim({column}, {BLANKS_SQL}))"
    return f"(CASE WHEN {key} NOT IN {PLACEHOLDER_SQL} THEN {key} END)"


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return surplus_deliveries(table(spark, sf_dir, "external_collection"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return implausible_cells(table(spark, sf_dir, "external_cdm"), table(spark, sf_dir, "object_alias"))


QUERIES = {"p3_found": p3_found, "p5_found": p5_found}

_MISSION = f"""coalesce({usable_sql('mission_id')}, CASE WHEN regexp_matches(upper(trim(split_part(event_pair, chr(124), 1))), '^[A-Z]+[- ][0-9]+$') THEN {usable_sql('split_part(event_pair, chr(124), 1)')}
    WHEN regexp_matches(upper(trim(split_part(event_pair, chr(124), 2))), '^[A-Z]+[- ][0-9]+$') THEN {usable_sql('split_part(event_pair, chr(124), 2)')} END)"""


def _still_sql(field: str) -> str:
    return f"coalesce({field} = lag({field}) OVER w OR abs({field} - lag({field}) OVER w) < 0.000001::DOUBLE * greatest(abs({field}), abs(lag({field}) OVER w)), false) AS s_{field}"


def _runs_sql(field: str) -> str:
    at = {k: f"coalesce({'lead' if k > 0 else 'lag'}(s_{field}, {abs(k)}) OVER w, false)" if k else f"s_{field}" for k in range(-2, 4)}
    return " OR ".join("(" + " AND ".join(at[k] for k in range(first, first + 3)) + ")" for first in range(-2, 2)) + f" AS r_{field}"


def _far_sql(field: str, bound: float) -> str:
    """Readings beyond the tail cutoff, step by step: c centre, a residual, z in spreads, p peaks, o and g moments of a source and of all, t the cutoff."""
    return f"""SELECT cdm_no, '{field}' FROM (
        WITH c AS (SELECT cdm_no, mission, season, ln({field}) AS v, median(ln({field})) OVER (PARTITION BY mission) AS centre, median(ln({field})) OVER (PARTITION BY mission, season) AS own, count(*) OVER (PARTITION BY mission, season) AS n
            FROM x WHERE {field} > 0 AND {field} <= {bound}::DOUBLE AND mission IS NOT NULL),
        a AS (SELECT *, abs(v - centre - (own - centre) * n / (n + 500.0::DOUBLE)) AS r FROM c),
        z AS (SELECT *, r / greatest(0.002::DOUBLE, 1.4826::DOUBLE * median(r) OVER (PARTITION BY mission)) AS z FROM a),
        p AS (SELECT *, count(*) OVER (PARTITION BY mission ORDER BY z DESC) <= greatest(1, 0.05::DOUBLE * count(*) OVER (PARTITION BY mission)) AS peak FROM z WHERE z < 6),
        o AS (SELECT mission, coalesce(max(z) FILTER (WHERE NOT peak), 0) AS u, count(*)::DOUBLE AS n, count(*) FILTER (WHERE peak)::DOUBLE AS k, coalesce(sum(z) FILTER (WHERE peak), 0) AS s1, coalesce(sum(z * z) FILTER (WHERE peak), 0) AS s2 FROM p GROUP BY 1),
        e AS (SELECT *, s1 - k * u AS e1, s2 - 2 * u * s1 + k * u * u AS e2 FROM o),
        g AS (SELECT (sum(u * k) + 50 * {NORMAL_TAIL[0]}::DOUBLE) / (sum(k) + 50) AS u0, (sum(e1) + 50 * {NORMAL_TAIL[1]}::DOUBLE) / (sum(k) + 50) AS m0, (sum(e2) + 50 * {NORMAL_TAIL[2]}::DOUBLE) / (sum(k) + 50) AS q0 FROM e),
        d AS (SELECT mission, (u * k + 50 * u0) / (k + 50) AS u, (e1 + 50 * m0) / (k + 50) AS m, (e2 + 50 * q0) / (k + 50) AS q, (k + 50) / (n + 1000) / 0.0000001::DOUBLE AS ratio FROM e, g),
        h AS (SELECT *, greatest(0, least(0.25::DOUBLE, coalesce(0.5::DOUBLE * (1 - m * m / nullif(q - m * m, 0)), 0))) AS shape FROM d),
        t AS (SELECT mission, greatest(3, u + m * (1 - shape) * CASE WHEN shape < 0.000001::DOUBLE THEN ln(ratio) ELSE (pow(ratio, shape) - 1) / shape END) AS cutoff FROM h)
        SELECT cdm_no FROM z JOIN t USING (mission) WHERE z > cutoff)"""


def _found_sql(field: str, bound: float) -> str:
    return f"""
        SELECT cdm_no, '{field}' AS field_name FROM x WHERE {field} <= 0 OR {field} > {bound}::DOUBLE
        UNION SELECT x.cdm_no, '{field}' FROM x JOIN runs ON x.event_id = runs.event_id AND x.creation_date = runs.creation_date AND x.{field} IS NOT DISTINCT FROM runs.{field} WHERE r_{field} AND x.{field} IS NOT NULL
        UNION {_far_sql(field, bound)}"""


SQL = {
    "p5_found": f"""
        WITH v AS (SELECT *, {_MISSION} AS m FROM external_cdm), x AS (
            SELECT cdm_no, event_id, creation_date, coalesce(hour(creation_date) // 6, -1) AS season, coalesce((SELECT min({usable_sql('designator')}) FROM object_alias WHERE {usable_sql('alias_designator')} = m), m) AS mission,
                {', '.join(f'CASE WHEN NOT isnan({f}) THEN {f} END AS {f}' for f in FIELDS)} FROM v),
        y AS (SELECT DISTINCT event_id, creation_date, {', '.join(FIELDS)} FROM x WHERE event_id IS NOT NULL AND creation_date IS NOT NULL),
        z AS (SELECT *, {', '.join(map(_still_sql, FIELDS))} FROM y WINDOW w AS (PARTITION BY event_id ORDER BY creation_date, {', '.join(FIELDS)})),
        runs AS (SELECT *, {', '.join(map(_runs_sql, FIELDS))} FROM z WINDOW w AS (PARTITION BY event_id ORDER BY creation_date, {', '.join(FIELDS)}))
        {' UNION '.join(_found_sql(f, PHYSICAL_BOUNDS[f]) for f in FIELDS)}
    """,
    "p3_found": f"""
        WITH keyed AS (SELECT record_no, {usable_sql('source_message_id')} AS k FROM external_collection)
        SELECT record_no FROM (
            SELECT record_no, min(record_no) OVER (PARTITION BY k) AS kept FROM keyed WHERE k IS NOT NULL
        ) WHERE record_no <> kept
    """,
}
