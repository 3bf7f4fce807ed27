"""Registered queries over normalized messages, scored messages, labels and collections, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skysieve.functions.keys import event_key
from skysieve.functions.stats import net_change_column, rank_column
from skysieve.operators import calibrate, contracts, experiments, features, gate, messages, review
from skysieve.plans.core_queries import usable_sql
from skysieve.plans.tables import table
from skysieve.streaming import triage

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

#: Fixed parameters of the registered queries.
ALPHA, CONFIDENCE, MINIMUM_HISTORY, BOUND, ESCALATION = 0.2, 0.95, 2, 0.05, 0.9
GATE_FEATURES = ("risk", "miss_distance")


def query(sql: str | None = None) -> Callable:
    def register(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return register


def _event_sql(column: str) -> str:
    key = f"lower({usable_sql(column)})"
    return f"(CASE WHEN regexp_matches({key}, '^(ext[-_ ]?)?[0-9a-f]{{24}}$') THEN 'ext-' || right({key}, 24) ELSE {key} END)"


def _present(column: str) -> str:
    return f"CASE WHEN NOT isnan({column}) THEN {column} END AS {column}"


_FIELDS = ", ".join(_present(f) for f in messages.MESSAGE_FIELDS)
M = f"""m AS (
    SELECT * EXCLUDE (rn) FROM (
        SELECT *, row_number() OVER (PARTITION BY event_id, time_to_tca ORDER BY cdm_no) AS rn FROM (
            SELECT cdm_no, {_event_sql('event_id')} AS event_id, event_pair, source_message_id, creation_date, tca, {_present('time_to_tca')}, {_FIELDS}, mission_id, c_object_type FROM external_cdm
        ) WHERE event_id IS NOT NULL AND time_to_tca IS NOT NULL
    ) WHERE rn = 1
)"""
S = f"""s AS (
    SELECT * EXCLUDE (rn, y0, fold0) FROM (
        SELECT *, row_number() OVER (PARTITION BY event_id, time_to_tca ORDER BY diag_no) AS rn, coalesce(max(y0) OVER (PARTITION BY event_id), 0) AS y, coalesce(min(fold0) OVER (PARTITION BY event_id), 0) AS fold FROM (
            SELECT diag_no, {_event_sql('event_id')} AS event_id, {_present('time_to_tca')}, y AS y0, fold AS fold0, {_present('score')}, {_present('risk')}, {_present('max_risk_estimate')}, {_present('miss_distance')}, {_present('mahalanobis_distance')}
            FROM history_gate_diagnostics
        ) WHERE event_id IS NOT NULL AND time_to_tca IS NOT NULL AND score IS NOT NULL
    ) WHERE rn = 1
), e AS (
    SELECT *, CAST(row_number() OVER (PARTITION BY event_id ORDER BY time_to_tca DESC) AS INTEGER) AS eligible_history_count,
           CASE WHEN risk IS NULL THEN score ELSE greatest(0.0::DOUBLE, least(1.0::DOUBLE, (risk + 30.0::DOUBLE) / 30.0::DOUBLE)) END AS candidate
    FROM s WHERE time_to_tca BETWEEN 2.0 AND 7.0
)"""
L = f"l AS (SELECT {_event_sql('event_id')} AS event_id, max(y) AS y FROM event_labels WHERE event_id IS NOT NULL AND y IS NOT NULL GROUP BY 1)"


def _messages(spark: SparkSession, d: str) -> DataFrame:
    return messages.messages(table(spark, d, "external_cdm"))


def _scored(spark: SparkSession, d: str) -> DataFrame:
    return messages.scored(table(spark, d, "history_gate_diagnostics"))


def _eligible(spark: SparkSession, d: str) -> DataFrame:
    candidate = F.when(F.col("risk").isNull(), F.col("score")).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("risk") + 30.0) / 30.0)))
    return features.eligible_prefixes(_scored(spark, d)).withColumn("candidate", candidate)


def _labels(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "event_labels").select(event_key(F.col("event_id")).alias("event_id"), "y").filter("event_id is not null and y is not null").groupBy("event_id").agg(F.max("y").alias("y"))


def _methods(spark: SparkSession, d: str) -> DataFrame:
    rows = experiments.ensemble_scores(_eligible(spark, d), "score", "candidate")
    keep = rows.select("event_id", "time_to_tca", "y", "fold", "eligible_history_count", *experiments.ENSEMBLES)
    return experiments.unpivot_methods(keep, tuple(experiments.ENSEMBLES))


ENS = """k AS (
    SELECT event_id, time_to_tca, y, fold, eligible_history_count, unnest(['baseline', 'candidate', 'arithmetic', 'geometric', 'maximum', 'minimum']) AS method,
           unnest([score, candidate, (score + candidate) / 2, sqrt(score * candidate), greatest(score, candidate), least(score, candidate)]) AS score
    FROM e
)"""


def _finite_min(df: DataFrame, column: str = "min_score") -> DataFrame:
    """Infinity, which means none, as null."""
    return df.withColumn(column, F.when(F.col(column) < float("inf"), F.col(column)))


# --- normalization and scalar functions -------------------------------------------------------------------------------------


@query(f"WITH {M} SELECT cdm_no, CASE WHEN relative_speed > 0 AND relative_speed < 'infinity'::DOUBLE THEN round(log10(relative_speed), 9) END AS log_speed FROM m")
def log_risk(spark, d):
    return _messages(spark, d).select("cdm_no", F.round(messages.log_probability(F.col("relative_speed")), 9).alias("log_speed"))


@query(f"""WITH {M}, c AS (SELECT cdm_no, t_obs_used AS a, t_weighted_rms AS b, t_obs_available AS c, c_weighted_rms AS d, max_risk_scaling AS f, c_obs_available AS g FROM m),
    t AS (SELECT cdm_no, a * (c * g - f * f) - b * (b * g - f * d) + d * (b * f - c * d) AS det FROM c)
    SELECT cdm_no, CASE WHEN det > 0 AND det < 'infinity'::DOUBLE THEN round(det, 3) END AS det FROM t""")
def covariance_det(spark, d):
    c = messages.covariance_determinant(F.col("t_obs_used"), F.col("t_weighted_rms"), F.col("t_obs_available"), F.col("c_weighted_rms"), F.col("max_risk_scaling"), F.col("c_obs_available"))
    return _messages(spark, d).select("cdm_no", F.round(c, 3).alias("det"))


@query(f"WITH {M} SELECT cdm_no, round((epoch_us(tca) - epoch_us(creation_date)) / 86400000000.0::DOUBLE, 9) AS days FROM m")
def time_to_tca(spark, d):
    return _messages(spark, d).select("cdm_no", F.round(messages.days_between(F.col("creation_date"), F.col("tca")), 9).alias("days"))


@query(f"""WITH {M}, v AS (SELECT cdm_no, [miss_distance, relative_speed, max_risk_scaling] AS r, [t_obs_used + c_obs_used, t_obs_available + c_obs_available, t_weighted_rms + c_weighted_rms] AS c FROM m)
    SELECT cdm_no, CASE WHEN len(list_filter(list_concat(r, c), lambda x: x IS NULL OR NOT isfinite(x))) = 0 THEN round(sqrt(list_sum(list_transform(list_zip(r, c), lambda x: CASE WHEN x[2] = 0 THEN 0 ELSE x[1] * x[1] / x[2] END))), 2) END AS distance FROM v""")
def mahalanobis(spark, d):
    """Of each message, from its readings as a diagonal covariance; singular ones by pseudo-inverse."""
    r = (F.col("miss_distance"), F.col("relative_speed"), F.col("max_risk_scaling"))
    zero = F.lit(0.0)
    a = (F.col("t_obs_used"), zero, F.col("t_obs_available"), zero, zero, F.col("t_weighted_rms"))
    b = (F.col("c_obs_used"), zero, F.col("c_obs_available"), zero, zero, F.col("c_weighted_rms"))
    return _messages(spark, d).select("cdm_no", F.round(messages.mahalanobis(r, a, b, F.lit(None).cast("double")), 2).alias("distance"))


@query(f"WITH {M} SELECT cdm_no, event_id, time_to_tca FROM m WHERE time_to_tca BETWEEN 2.0 AND 7.0")
def decision_window(spark, d):
    return features.decision_window(_messages(spark, d)).select("cdm_no", "event_id", "time_to_tca")


@query(f"WITH {M} SELECT cdm_no, event_id, time_to_tca, risk FROM m WHERE time_to_tca >= 2.0")
def outcome_blind(spark, d):
    from skysieve.functions.checks import outcome_blind as blind

    return blind(_messages(spark, d).filter("time_to_tca >= 2.0").select("cdm_no", "event_id", "time_to_tca", "risk"))


@query(f"""WITH {S} SELECT event_id, time_to_tca, round((score + candidate) / 2, 12) AS arithmetic, round(sqrt(score * candidate), 12) AS geometric, greatest(score, candidate) AS maximum, least(score, candidate) AS minimum FROM e""")
def score_ensemble(spark, d):
    rows = experiments.ensemble_scores(_eligible(spark, d), "score", "candidate")
    return rows.select("event_id", "time_to_tca", F.round("arithmetic", 12).alias("arithmetic"), F.round("geometric", 12).alias("geometric"), "maximum", "minimum")


@query(f"""WITH {M}, v AS (SELECT DISTINCT event_id FROM m)
    SELECT event_id, CASE WHEN (('0x' || substr(sha256('prospective:' || event_id), 1, 16))::UBIGINT)::DOUBLE / 18446744073709551616.0::DOUBLE < 0.35 THEN 'calibration' ELSE 'evaluation' END AS cohort FROM v""")
def cohort_allocation(spark, d):
    return _messages(spark, d).select("event_id").distinct().select("event_id", features.allocation(F.col("event_id"), "prospective", 0.35).alias("cohort"))


@query(f"""WITH {M}, v AS (SELECT DISTINCT event_id, ('0x' || substr(sha256(event_id), 1, 4))::INTEGER % 65536 AS part FROM m),
    p AS (SELECT part, count(*) AS n, sha256(string_agg(event_id, chr(10) ORDER BY event_id)) AS d FROM v GROUP BY part)
    SELECT CAST(sum(n) AS BIGINT) AS n_events, sha256(string_agg(d, chr(10) ORDER BY part)) AS roster_sha256 FROM p""")
def roster_digest(spark, d):
    return review.roster_digest(_messages(spark, d))


@query()
def message_fingerprint(spark, d):
    """SHA-256 of each message's content; the JVM's JSON decides the digits, so there is no SQL twin."""
    return _messages(spark, d).select("cdm_no", review.fingerprint(("event_pair", "source_message_id", "tca", *messages.MESSAGE_FIELDS)).alias("fingerprint"))


# --- joins -------------------------------------------------------------------------------------------------------------------


@query(f"WITH {M}, {L} SELECT m.cdm_no, m.event_id, l.y FROM m LEFT JOIN l USING (event_id)")
def attach_labels(spark, d):
    return _messages(spark, d).join(_labels(spark, d), "event_id", "left").select("cdm_no", "event_id", "y")


@query(f"""WITH {M}, {S} SELECT s.diag_no, s.event_id, s.time_to_tca, m.relative_speed, m.cdm_no IS NULL AS unmatched FROM s LEFT JOIN m ON s.event_id = m.event_id AND s.time_to_tca = m.time_to_tca""")
def attach_gate_features(spark, d):
    m = _messages(spark, d).select("event_id", "time_to_tca", "relative_speed", "cdm_no")
    return _scored(spark, d).select("diag_no", "event_id", "time_to_tca").join(m, ["event_id", "time_to_tca"], "left").select("diag_no", "event_id", "time_to_tca", "relative_speed", F.col("cdm_no").isNull().alias("unmatched"))


@query(f"""WITH {S}, {L}, v AS (SELECT DISTINCT event_id FROM s) SELECT coalesce(v.event_id, l.event_id) AS event_id, CASE WHEN l.event_id IS NULL THEN 'left_only' ELSE 'right_only' END AS side
    FROM v FULL JOIN l ON v.event_id = l.event_id WHERE v.event_id IS NULL OR l.event_id IS NULL""")
def reconcile_scores(spark, d):
    return review.unmatched(_scored(spark, d), _labels(spark, d), ("event_id",))


@query(f"WITH {M}, {L} SELECT m.cdm_no, m.event_id FROM m WHERE m.event_id IN (SELECT event_id FROM l WHERE y = 1)")
def cohort_features(spark, d):
    return _messages(spark, d).join(_labels(spark, d).filter("y = 1"), "event_id", "left_semi").select("cdm_no", "event_id")


@query(f"WITH {S}, {L} SELECT DISTINCT s.event_id FROM s WHERE s.event_id NOT IN (SELECT event_id FROM l)")
def split_overlap(spark, d):
    return _scored(spark, d).select("event_id").distinct().join(_labels(spark, d), "event_id", "left_anti")


@query(f"WITH {S}, {L} (SELECT event_id FROM s) INTERSECT (SELECT event_id FROM l)")
def roster_intersect(spark, d):
    return _scored(spark, d).select("event_id").intersect(_labels(spark, d).select("event_id"))


@query(f"WITH {M}, {S} (SELECT event_id FROM m) EXCEPT (SELECT event_id FROM s)")
def roster_except(spark, d):
    return _messages(spark, d).select("event_id").subtract(_scored(spark, d).select("event_id"))


@query(f"WITH {L} SELECT event_id, y FROM l")
def label_roster(spark, d):
    return _labels(spark, d)


@query("SELECT event_id, time_to_tca, count(*) AS copies FROM history_gate_diagnostics GROUP BY 1, 2 HAVING count(*) > 1")
def duplicate_keys(spark, d):
    return table(spark, d, "history_gate_diagnostics").groupBy("event_id", "time_to_tca").agg(F.count(F.lit(1)).alias("copies")).filter("copies > 1")


@query(f"WITH {S} SELECT 0 AS part, event_id, score FROM s WHERE fold = 0 UNION ALL SELECT 1 AS part, event_id, score FROM s WHERE fold <> 0")
def fold_union(spark, d):
    s = _scored(spark, d)
    return s.filter("fold = 0").select(F.lit(0).alias("part"), "event_id", "score").unionByName(s.filter("fold <> 0").select(F.lit(1).alias("part"), "event_id", "score"))


# --- labels, features, weights ---------------------------------------------------------------------------------------------------


@query(f"WITH {M} SELECT event_id, CASE WHEN arg_min_null(risk, time_to_tca) >= -6 THEN 1 ELSE 0 END AS y FROM m GROUP BY 1")
def event_labels_literal(spark, d):
    return features.event_labels(_messages(spark, d), "literal")


@query(f"WITH {M} SELECT event_id, CASE WHEN arg_min(risk, time_to_tca) FILTER (WHERE risk IS NOT NULL) >= -6 THEN 1 ELSE 0 END AS y FROM m WHERE risk IS NOT NULL GROUP BY 1")
def event_labels_finite(spark, d):
    return features.event_labels(_messages(spark, d), "first_finite")


@query(f"WITH {M} SELECT event_id, CASE WHEN arg_min_null(risk, time_to_tca) >= -6 THEN 1 ELSE 0 END AS y FROM m GROUP BY 1 HAVING arg_min_null(risk, time_to_tca) IS NOT NULL")
def event_labels_dropped(spark, d):
    return features.event_labels(_messages(spark, d), "literal_drop_null")


def _prefix_sql(c: str) -> str:
    so_far = "(PARTITION BY event_id ORDER BY time_to_tca DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    whole = "(PARTITION BY event_id ORDER BY time_to_tca DESC ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"
    order = "(PARTITION BY event_id ORDER BY time_to_tca DESC)"
    first, low, high = f"first_value({c} IGNORE NULLS) OVER {whole}", f"CASE WHEN {c} IS NOT NULL THEN min({c}) OVER {so_far} END", f"CASE WHEN {c} IS NOT NULL THEN max({c}) OVER {so_far} END"
    return f"{first} AS {c}_first, {low} AS {c}_min_so_far, {high} AS {c}_max_so_far, ({high}) - ({low}) AS {c}_range_so_far, {c} - {first} AS {c}_delta_first, {c} - lag({c}) OVER {order} AS {c}_delta_prev"


@query(f"""WITH {M} SELECT cdm_no, {', '.join(_prefix_sql(c) for c in features.PREFIX_COLUMNS)}, CAST(row_number() OVER w AS INTEGER) AS n_cdm_so_far, abs(time_to_tca - lag(time_to_tca) OVER w) AS dt_prev,
    max(time_to_tca) OVER (PARTITION BY event_id) - time_to_tca AS history_span_days FROM m WINDOW w AS (PARTITION BY event_id ORDER BY time_to_tca DESC)""")
def prefix_features(spark, d):
    names = [f"{c}_{k}" for c in features.PREFIX_COLUMNS for k in ("first", "min_so_far", "max_so_far", "range_so_far", "delta_first", "delta_prev")]
    return features.prefix_features(_messages(spark, d)).select("cdm_no", *names, "n_cdm_so_far", "dt_prev", "history_span_days")


@query(f"WITH {M} SELECT cdm_no, event_id, CAST(row_number() OVER (PARTITION BY event_id ORDER BY time_to_tca DESC) AS INTEGER) AS eligible_history_count FROM m WHERE time_to_tca BETWEEN 2.0 AND 7.0")
def eligible_prefixes(spark, d):
    return features.eligible_prefixes(_messages(spark, d)).select("cdm_no", "event_id", "eligible_history_count")


@query(f"WITH {M} SELECT cdm_no, 1.0::DOUBLE / count(*) OVER (PARTITION BY event_id) AS weight FROM m")
def event_weights(spark, d):
    return features.event_weights(_messages(spark, d)).select("cdm_no", "weight")


@query(f"""WITH {S}, n AS (SELECT *, count(*) OVER (PARTITION BY event_id) AS n, row_number() OVER (PARTITION BY event_id ORDER BY score, time_to_tca DESC) AS i FROM e),
    h AS (SELECT *, greatest(1, ceil(0.25::DOUBLE * n)) AS h FROM n)
    SELECT diag_no, round(CASE WHEN y = 1 THEN 0.5::DOUBLE / n + CASE WHEN i <= h THEN 0.5::DOUBLE / h ELSE 0 END ELSE 1.0::DOUBLE / n END, 12) AS weight FROM h""")
def tail_weights(spark, d):
    return features.tail_weights(_eligible(spark, d)).select("diag_no", F.round("weight", 12).alias("weight"))


@query(f"""WITH {S}, v AS (SELECT event_id, min(score) AS v FROM e GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY v, event_id) AS rn, count(*) OVER () AS n FROM v)
    SELECT event_id, CAST(greatest(1, ceil((rn - 1) * 4::DOUBLE / (n - 1))) AS INTEGER) AS quantile_group FROM r""")
def quantile_groups(spark, d):
    return features.quantile_groups(_eligible(spark, d).groupBy("event_id").agg(F.min("score").alias("v")), "v", 4).select("event_id", "quantile_group")


@query(f"""WITH {M}, w AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY time_to_tca DESC) AS i, count(*) OVER (PARTITION BY event_id) AS n,
        ((risk IS NULL)::INT + (max_risk_estimate IS NULL)::INT + (miss_distance IS NULL)::INT + (mahalanobis_distance IS NULL)::INT) / 4.0::DOUBLE AS missing FROM m WHERE time_to_tca BETWEEN 2.0 AND 7.0)
    SELECT event_id, CASE WHEN n <= 4 THEN '1-4' WHEN n <= 10 THEN '5-10' ELSE '11+' END AS history_group, CASE WHEN missing <= 0 THEN 'none' WHEN missing <= 0.10 THEN 'low' ELSE 'high' END AS missing_group FROM w WHERE i = 1""")
def event_groups(spark, d):
    return features.event_groups(features.decision_window(_messages(spark, d)), features.PREFIX_COLUMNS)


@query(f"""WITH {L}, r AS (SELECT *, row_number() OVER (PARTITION BY y ORDER BY sha256('split:' || event_id), event_id) AS i, count(*) OVER (PARTITION BY y) AS n FROM l)
    SELECT event_id, y, CASE WHEN i <= round(n * 0.6::DOUBLE) THEN 'development' WHEN i <= round(n * (0.6::DOUBLE + 0.2::DOUBLE)) THEN 'calibration' ELSE 'evaluation' END AS part FROM r""")
def stratified_split(spark, d):
    return features.stratified_split(_labels(spark, d), {"development": 0.6, "calibration": 0.2, "evaluation": 0.2})


@query(f"""WITH {M}, {L}, r AS (SELECT *, row_number() OVER (PARTITION BY y ORDER BY sha256('split:' || event_id), event_id) AS i, count(*) OVER (PARTITION BY y) AS n FROM l),
    p AS (SELECT event_id, y, CASE WHEN i <= round(n * 0.6::DOUBLE) THEN 'development' WHEN i <= round(n * (0.6::DOUBLE + 0.2::DOUBLE)) THEN 'calibration' ELSE 'evaluation' END AS part FROM r)
    SELECT p.part, count(*) AS messages, count(DISTINCT m.event_id) AS events, count(DISTINCT CASE WHEN p.y = 1 THEN m.event_id END) AS positives FROM m JOIN p USING (event_id) WHERE m.time_to_tca BETWEEN 2.0 AND 7.0 GROUP BY 1""")
def partition_counts(spark, d):
    split = features.stratified_split(_labels(spark, d), {"development": 0.6, "calibration": 0.2, "evaluation": 0.2})
    rows = features.decision_window(_messages(spark, d)).join(split, "event_id")
    per = rows.groupBy("part", "event_id", "y").agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy("part").agg(F.sum("n").alias("messages"), F.count(F.lit(1)).alias("events"), F.count_if(F.col("y") == 1).alias("positives"))


# --- calibration and decisions -----------------------------------------------------------------------------------------------------


@query(f"WITH {S} SELECT event_id, min(y) AS y, min(score) AS min_score, max(time_to_tca) AS first_available_tca, min(time_to_tca) AS last_available_tca FROM s GROUP BY 1")
def event_policy(spark, d):
    return calibrate.event_policy(_scored(spark, d))


HG = f"g AS (SELECT event_id, min(y) AS y, min(fold) AS fold, min(score) FILTER (WHERE eligible_history_count >= {MINIMUM_HISTORY}) AS min_score FROM e GROUP BY 1)"


@query(f"WITH {S}, {HG} SELECT event_id, y, min_score FROM g")
def history_gated_events(spark, d):
    return _finite_min(calibrate.history_gated_events(_eligible(spark, d), MINIMUM_HISTORY))


def _thresholds_sql(mode: str) -> str:
    if mode == "marginal":
        rank = f"CAST(least(n, floor({ALPHA}::DOUBLE * (n + 1))) AS INTEGER)"
        ranks = f"r AS (SELECT n, {rank} AS rank FROM (SELECT count(*) AS n FROM g WHERE y = 1))"
    else:
        ranks = f"""c AS (SELECT n, k, sum(exp(lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1) + k * ln({ALPHA}::DOUBLE) + (n - k) * ln(1 - {ALPHA}::DOUBLE))) OVER (ORDER BY k) AS p
            FROM (SELECT count(*)::DOUBLE AS n FROM g WHERE y = 1), (SELECT unnest(range(0, 20000))::DOUBLE AS k) WHERE k <= n),
        r AS (SELECT CAST(max(n) AS BIGINT) AS n, CAST(count(*) FILTER (WHERE p <= 1 - {CONFIDENCE}::DOUBLE) AS INTEGER) AS rank FROM c)"""
    return f"""WITH {S}, {HG}, {ranks}, o AS (SELECT coalesce(min_score, 'infinity'::DOUBLE) AS v, row_number() OVER (ORDER BY coalesce(min_score, 'infinity'::DOUBLE), event_id) AS i FROM g WHERE y = 1)
        SELECT r.n AS n_positive, r.rank, CASE WHEN o.v < 'infinity'::DOUBLE THEN o.v END AS bound FROM r LEFT JOIN o ON o.i = r.rank"""


def _thresholds(spark, d, mode):
    return _finite_min(calibrate.thresholds(calibrate.history_gated_events(_eligible(spark, d), MINIMUM_HISTORY), (), ALPHA, mode, CONFIDENCE), "bound")


@query(_thresholds_sql("marginal"))
def calibrate_marginal(spark, d):
    return _thresholds(spark, d, "marginal")


@query(_thresholds_sql("pac"))
def calibrate_pac(spark, d):
    return _thresholds(spark, d, "pac")


@query(f"""WITH {S}, {HG}, t AS (SELECT *, coalesce(min_score < {BOUND}::DOUBLE, false) AS safe FROM g), a AS (
        SELECT count(*) FILTER (WHERE safe AND y = 1) AS danger, count(*) FILTER (WHERE y = 1) AS n_positive, count(*) FILTER (WHERE safe AND y = 0) AS safe_negative, count(*) FILTER (WHERE y = 0) AS n_negative, count(*) FILTER (WHERE safe) AS safe, count(*) AS n_events FROM t)
    SELECT *, danger::DOUBLE / nullif(n_positive, 0) AS danger_rate, safe_negative::DOUBLE / nullif(n_negative, 0) AS safe_negative_rate, safe::DOUBLE / n_events AS safe_rate FROM a""")
def evaluate_threshold(spark, d):
    return calibrate.evaluate_threshold(calibrate.history_gated_events(_eligible(spark, d), MINIMUM_HISTORY), BOUND, None)


@query(f"""WITH RECURSIVE {S}, {HG}, a AS (SELECT count(*) FILTER (WHERE y = 1 AND coalesce(min_score < {BOUND}::DOUBLE, false)) AS k, count(*) FILTER (WHERE y = 1) AS n FROM g),
    b AS (SELECT 0 AS i, 0.0::DOUBLE AS lo, 1.0::DOUBLE AS hi, k, n FROM a UNION ALL
        SELECT i + 1, CASE WHEN c > 1 - {CONFIDENCE}::DOUBLE THEN p ELSE lo END, CASE WHEN c > 1 - {CONFIDENCE}::DOUBLE THEN hi ELSE p END, k, n FROM (
            SELECT *, (lo + hi) / 2 AS p, list_sum(list_transform(range(0, k + 1), lambda j: exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln((lo + hi) / 2) + (n - j) * ln(1 - (lo + hi) / 2)))) AS c FROM b WHERE i < 60))
    SELECT k AS danger, n AS n_positive, round((lo + hi) / 2, 9) AS danger_upper FROM b WHERE i = 60""")
def cp_upper(spark, d):
    """The danger of a fixed bound with its Clopper-Pearson upper limit."""
    return calibrate.evaluate_threshold(calibrate.history_gated_events(_eligible(spark, d), MINIMUM_HISTORY), BOUND, CONFIDENCE).select("danger", "n_positive", F.round("danger_upper", 9).alias("danger_upper"))


FS = f"""f AS (SELECT event_id, min(y) AS y, min(fold) AS fold, max(time_to_tca) FILTER (WHERE score < {BOUND}::DOUBLE AND eligible_history_count >= {MINIMUM_HISTORY}) AS first_safe_tca,
    arg_max(score, time_to_tca) FILTER (WHERE score < {BOUND}::DOUBLE AND eligible_history_count >= {MINIMUM_HISTORY}) AS first_safe_score FROM e GROUP BY 1)"""


def _decisions(spark, d):
    return calibrate.first_safe(_eligible(spark, d), F.lit(BOUND), MINIMUM_HISTORY, keys=("event_id", "fold"))


@query(f"WITH {S}, {FS} SELECT event_id, y, first_safe_tca, first_safe_score, first_safe_tca IS NOT NULL AS safe_exclude FROM f")
def first_safe_decision(spark, d):
    return _decisions(spark, d).select("event_id", "y", "first_safe_tca", "first_safe_score", "safe_exclude")


GB = f"""b AS (SELECT event_id, min(y) AS y,
    max(time_to_tca) FILTER (WHERE score < {BOUND}::DOUBLE AND eligible_history_count >= {MINIMUM_HISTORY} AND coalesce(risk < -8, false)) AS first_safe_tca,
    max(time_to_tca) FILTER (WHERE score < {BOUND}::DOUBLE AND eligible_history_count >= {MINIMUM_HISTORY} AND NOT coalesce(risk < -8, false)) AS first_blocked_safe_tca FROM e GROUP BY 1)"""


@query(f"WITH {S}, {GB} SELECT event_id, y, first_safe_tca, first_blocked_safe_tca, first_safe_tca IS NOT NULL AS safe_exclude, first_safe_tca IS NULL AND first_blocked_safe_tca IS NOT NULL AS shift_gate_blocked FROM b")
def first_safe_gated(spark, d):
    return calibrate.first_safe(_eligible(spark, d), F.lit(BOUND), MINIMUM_HISTORY, allowed=F.col("risk") < -8).select("event_id", "y", "first_safe_tca", "first_blocked_safe_tca", "safe_exclude", "shift_gate_blocked")


_METRICS_SQL = """count(*) AS n_events, count(*) FILTER (WHERE y = 1) AS n_positive, count(*) FILTER (WHERE y = 0) AS n_negative, count(*) FILTER (WHERE y = 1 AND first_safe_tca IS NOT NULL) AS danger,
    count(*) FILTER (WHERE y = 0 AND first_safe_tca IS NOT NULL) AS safe_negative, round(quantile_cont(first_safe_tca, 0.5), 9) AS median_first_safe_tca"""


def _metrics(df, groups=()):
    return df.select(*groups, "n_events", "n_positive", "n_negative", "danger", "safe_negative", F.round("median_first_safe_tca", 9).alias("median_first_safe_tca"))


@query(f"WITH {S}, {FS} SELECT {_METRICS_SQL} FROM f")
def sequential_policy(spark, d):
    return _metrics(calibrate.policy_metrics(_decisions(spark, d), (), None))


@query(f"""WITH {S}, {FS}, {L}, j AS (SELECT l.event_id, l.y, f.first_safe_tca FROM l LEFT JOIN f USING (event_id)) SELECT {_METRICS_SQL} FROM j""")
def confirmation_metrics(spark, d):
    j = _labels(spark, d).join(_decisions(spark, d).drop("y"), "event_id", "left").withColumns({"safe_exclude": F.coalesce("safe_exclude", F.lit(False)), "shift_gate_blocked": F.coalesce("shift_gate_blocked", F.lit(False))})
    return _metrics(calibrate.policy_metrics(j, (), None))


# --- shift gate ----------------------------------------------------------------------------------------------------------------------


def _scale_sql(c: str, where: str = "TRUE") -> str:
    return f"SELECT '{c}' AS feature, quantile_cont({c}, 0.5) AS location, quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25) AS iqr, stddev_pop({c}) AS sd FROM e WHERE isfinite({c}) AND {where}"


GF = f"""q AS ({_scale_sql('risk')} UNION ALL {_scale_sql('miss_distance')}), z AS (SELECT feature, location, CASE WHEN iqr / 1.349::DOUBLE > 0 THEN iqr / 1.349::DOUBLE WHEN sd > 0 THEN sd ELSE 1 END AS scale FROM q),
    v AS (SELECT e.*, CASE WHEN NOT coalesce(isfinite(e.risk) AND isfinite(e.miss_distance), false) THEN 'infinity'::DOUBLE ELSE greatest(abs(e.risk - (SELECT location FROM z WHERE feature = 'risk')) / (SELECT scale FROM z WHERE feature = 'risk'),
        abs(e.miss_distance - (SELECT location FROM z WHERE feature = 'miss_distance')) / (SELECT scale FROM z WHERE feature = 'miss_distance')) END AS shift_score FROM e),
    ev AS (SELECT event_id, max(shift_score) AS v FROM v GROUP BY 1), eo AS (SELECT v, row_number() OVER (ORDER BY v, event_id) AS i, count(*) OVER () AS n FROM ev),
    gb AS (SELECT n, CAST(ceil((n + 1) * (1 - 0.05::DOUBLE)) AS INTEGER) AS rank, coalesce(max(v) FILTER (WHERE i = ceil((n + 1) * (1 - 0.05::DOUBLE))), 'infinity'::DOUBLE) AS gate_bound FROM eo GROUP BY n)"""


def _shifted(spark, d):
    rows = _eligible(spark, d)
    wide = gate.robust_scale(rows, GATE_FEATURES).groupBy().agg(*(x for f in GATE_FEATURES for x in (F.max(F.when(F.col("feature") == f, F.col("location"))).alias(f"l_{f}"), F.max(F.when(F.col("feature") == f, F.col("scale"))).alias(f"s_{f}"))))
    # One row of fitted numbers joins every message.
    return rows.join(F.broadcast(wide.limit(1)), F.lit(True)).withColumn("shift_score", gate.gate_score({f: (F.col(f"l_{f}"), F.col(f"s_{f}")) for f in GATE_FEATURES}))


@query(f"WITH {S}, {GF} SELECT feature, round(location, 6) AS location, round(scale, 6) AS scale FROM z")
def gate_fit(spark, d):
    return gate.robust_scale(_eligible(spark, d), GATE_FEATURES).select("feature", F.round("location", 6).alias("location"), F.round("scale", 6).alias("scale"))


@query(f"WITH {S}, {GF} SELECT diag_no, CASE WHEN shift_score < 'infinity'::DOUBLE THEN round(shift_score, 6) END AS shift_score FROM v")
def gate_score(spark, d):
    return _shifted(spark, d).select("diag_no", F.when(F.col("shift_score") < float("inf"), F.round("shift_score", 6)).alias("shift_score"))


@query(f"WITH {S}, {GF} SELECT n AS n_events, rank, CASE WHEN gate_bound < 'infinity'::DOUBLE THEN round(gate_bound, 6) END AS gate_bound FROM gb")
def gate_calibrate(spark, d):
    out = gate.event_gate_bounds(_shifted(spark, d), (), 0.05)
    return out.select("n_events", "rank", F.when(F.col("gate_bound") < float("inf"), F.round("gate_bound", 6)).alias("gate_bound"))


@query(f"WITH {S}, {GF} SELECT diag_no, shift_score < 'infinity'::DOUBLE AND shift_score <= gate_bound AS allowed FROM v, gb")
def gate_allows(spark, d):
    shifted = _shifted(spark, d)
    bound = gate.event_gate_bounds(shifted, (), 0.05).select("gate_bound").limit(1)
    return shifted.join(F.broadcast(bound), F.lit(True)).select("diag_no", ((F.col("shift_score") < float("inf")) & (F.col("shift_score") <= F.col("gate_bound"))).alias("allowed"))


@query(f"WITH {S}, {GF} SELECT event_id, bool_or(NOT (shift_score < 'infinity'::DOUBLE AND shift_score <= gate_bound)) AS flagged FROM v, gb GROUP BY 1")
def gate_flagged(spark, d):
    shifted = _shifted(spark, d)
    bound = gate.event_gate_bounds(shifted, (), 0.05).select("gate_bound").limit(1)
    return shifted.join(F.broadcast(bound), F.lit(True)).groupBy("event_id").agg(F.bool_or(~((F.col("shift_score") < float("inf")) & (F.col("shift_score") <= F.col("gate_bound")))).alias("flagged"))


@query(f"WITH {S}, {GF} SELECT event_id, min(score) FILTER (WHERE shift_score < 'infinity'::DOUBLE AND shift_score <= gate_bound AND eligible_history_count >= {MINIMUM_HISTORY}) AS min_score FROM v, gb GROUP BY 1")
def gate_calibrated_minima(spark, d):
    shifted = _shifted(spark, d)
    bound = gate.event_gate_bounds(shifted, (), 0.05).select("gate_bound").limit(1)
    allowed = (F.col("shift_score") < float("inf")) & (F.col("shift_score") <= F.col("gate_bound"))
    return _finite_min(calibrate.history_gated_events(shifted.join(F.broadcast(bound), F.lit(True)), MINIMUM_HISTORY, allowed=allowed)).select("event_id", "min_score")


# --- cross-fitting and comparisons -----------------------------------------------------------------------------------------------------


def _crossfit_sql(source: str, histories: str, columns: str) -> str:
    return f"""WITH {S}, {ENS}, h AS (SELECT unnest({histories}) AS mh),
        src AS ({source}),
        ev AS (SELECT method, mh, event_id, min(y) AS y, min(fold) AS fold, coalesce(min(score) FILTER (WHERE eligible_history_count >= mh), 'infinity'::DOUBLE) AS v FROM src, h GROUP BY 1, 2, 3),
        fo AS (SELECT DISTINCT fold AS eval_fold FROM ev),
        o AS (SELECT method, mh, eval_fold, v, row_number() OVER (PARTITION BY method, mh, eval_fold ORDER BY v, event_id) AS i, count(*) OVER (PARTITION BY method, mh, eval_fold) AS n FROM ev JOIN fo ON fold <> eval_fold WHERE y = 1),
        bd AS (SELECT method, mh, eval_fold, CAST(max(least(n, floor({ALPHA}::DOUBLE * (n + 1)))) AS INTEGER) AS rank, max(v) FILTER (WHERE i = least(n, floor({ALPHA}::DOUBLE * (n + 1)))) AS bound FROM o GROUP BY 1, 2, 3),
        dec AS (SELECT src.method, bd.mh, src.fold, src.event_id, min(src.y) AS y, min(bd.rank) AS rank, min(bd.bound) AS bound, max(src.time_to_tca) FILTER (WHERE src.score < bd.bound AND src.eligible_history_count >= bd.mh) AS first_safe_tca
            FROM src JOIN bd ON src.method = bd.method AND src.fold = bd.eval_fold GROUP BY 1, 2, 3, 4)
        {columns}"""


_SUMMARY = """SELECT method, CAST(mh AS INTEGER) AS minimum_history, count(*) AS n_events, count(*) FILTER (WHERE y = 1 AND first_safe_tca IS NOT NULL) AS danger, count(*) FILTER (WHERE y = 0 AND first_safe_tca IS NOT NULL) AS safe_negative,
    min(rank) AS rank_min, max(rank) AS rank_max FROM dec GROUP BY 1, 2"""


def _crossfit_summary(decisions):
    return experiments.crossfit_summary(decisions).select("method", "minimum_history", "n_events", "danger", "safe_negative", "rank_min", "rank_max")


@query(_crossfit_sql("SELECT * FROM k WHERE method IN ('baseline', 'candidate')", "[1]", _SUMMARY))
def crossfit_methods(spark, d):
    return _crossfit_summary(experiments.crossfit_decisions(_methods(spark, d).filter("method in ('baseline', 'candidate')"), (1,), ALPHA))


@query(_crossfit_sql("SELECT * FROM k WHERE method = 'baseline'", "[1, 2, 3, 4, 5]", _SUMMARY))
def crossfit_history(spark, d):
    return _crossfit_summary(experiments.crossfit_decisions(_methods(spark, d).filter("method = 'baseline'"), (1, 2, 3, 4, 5), ALPHA))


@query(_crossfit_sql("SELECT * FROM k WHERE method = 'baseline'", "[2]", "SELECT event_id, fold, y, first_safe_tca, first_safe_tca IS NOT NULL AS safe_exclude FROM dec"))
def crossfit_decisions(spark, d):
    return experiments.crossfit_decisions(_methods(spark, d).filter("method = 'baseline'"), (2,), ALPHA).select("event_id", "fold", "y", "first_safe_tca", "safe_exclude")


@query(_crossfit_sql("SELECT * FROM k", "[2]", _SUMMARY))
def ensemble_summary(spark, d):
    return _crossfit_summary(experiments.crossfit_decisions(_methods(spark, d), (2,), ALPHA))


@query(_crossfit_sql("SELECT * FROM k", "[2]", f""", su AS ({_SUMMARY}) SELECT a.method, a.danger, a.safe_negative, NOT EXISTS (SELECT 1 FROM su b WHERE b.danger <= a.danger AND b.safe_negative >= a.safe_negative AND (b.danger < a.danger OR b.safe_negative > a.safe_negative)) AS on_frontier FROM su a"""))
def pareto_frontier(spark, d):
    summary = experiments.crossfit_summary(experiments.crossfit_decisions(_methods(spark, d), (2,), ALPHA)).select("method", "danger", "safe_negative")
    return experiments.pareto_frontier(summary)


@query(f"""WITH {S}, fo AS (SELECT fold, row_number() OVER (ORDER BY fold) AS i, count(*) OVER () AS n FROM (SELECT DISTINCT fold FROM s))
    SELECT a.fold AS eval_fold, b.fold, CASE (b.i - a.i + a.n) % a.n WHEN 0 THEN 'evaluation' WHEN 1 THEN 'policy_calibration' WHEN 2 THEN 'gate_calibration' ELSE 'gate_fit' END AS role FROM fo a, fo b""")
def fold_roles(spark, d):
    return experiments.fold_roles(_scored(spark, d))


@query(f"""WITH {S}, fo AS (SELECT fold, row_number() OVER (ORDER BY fold) AS i, count(*) OVER () AS n FROM (SELECT DISTINCT fold FROM s)),
    ro AS (SELECT a.fold AS eval_fold, b.fold, (b.i - a.i + a.n) % a.n AS role FROM fo a, fo b), pl AS (SELECT e.*, ro.eval_fold, ro.role FROM e JOIN ro ON e.fold = ro.fold),
    q AS (SELECT eval_fold, quantile_cont(risk, 0.5) FILTER (WHERE isfinite(risk)) AS l1, (quantile_cont(risk, 0.75) FILTER (WHERE isfinite(risk)) - quantile_cont(risk, 0.25) FILTER (WHERE isfinite(risk))) / 1.349::DOUBLE AS s1, quantile_cont(miss_distance, 0.5) FILTER (WHERE isfinite(miss_distance)) AS l2, (quantile_cont(miss_distance, 0.75) FILTER (WHERE isfinite(miss_distance)) - quantile_cont(miss_distance, 0.25) FILTER (WHERE isfinite(miss_distance))) / 1.349::DOUBLE AS s2 FROM pl WHERE role > 2 GROUP BY 1),
    sh AS (SELECT pl.*, CASE WHEN NOT coalesce(isfinite(risk) AND isfinite(miss_distance), false) THEN 'infinity'::DOUBLE ELSE greatest(abs(risk - l1) / s1, abs(miss_distance - l2) / s2) END AS z FROM pl JOIN q USING (eval_fold) WHERE role <= 2),
    ge AS (SELECT eval_fold, event_id, max(z) AS v FROM sh WHERE role = 2 GROUP BY 1, 2), go AS (SELECT *, row_number() OVER (PARTITION BY eval_fold ORDER BY v, event_id) AS i, count(*) OVER (PARTITION BY eval_fold) AS n FROM ge),
    gt AS (SELECT eval_fold, coalesce(max(v) FILTER (WHERE i = ceil((n + 1) * (1 - 0.05::DOUBLE))), 'infinity'::DOUBLE) AS gate_bound FROM go GROUP BY 1),
    al AS (SELECT sh.*, z < 'infinity'::DOUBLE AND z <= gate_bound AS allowed FROM sh JOIN gt USING (eval_fold)),
    ce AS (SELECT eval_fold, event_id, min(y) AS y, coalesce(min(score) FILTER (WHERE allowed AND eligible_history_count >= 1), 'infinity'::DOUBLE) AS v FROM al WHERE role = 1 GROUP BY 1, 2),
    co AS (SELECT *, row_number() OVER (PARTITION BY eval_fold ORDER BY v, event_id) AS i, count(*) OVER (PARTITION BY eval_fold) AS n FROM ce WHERE y = 1),
    bd AS (SELECT eval_fold, max(v) FILTER (WHERE i = least(n, floor({ALPHA}::DOUBLE * (n + 1)))) AS bound FROM co GROUP BY 1)
    SELECT fold, event_id, min(y) AS y, bool_or(NOT allowed) AS flagged, max(time_to_tca) FILTER (WHERE score < bound AND allowed) AS first_safe_tca,
        count(*) FILTER (WHERE score < bound AND allowed) > 0 AS safe_exclude, count(*) FILTER (WHERE score < bound AND allowed) = 0 AND count(*) FILTER (WHERE score < bound AND NOT allowed) > 0 AS shift_gate_blocked
    FROM al LEFT JOIN bd USING (eval_fold) WHERE role = 0 GROUP BY 1, 2""")
def crossfit_gate(spark, d):
    return experiments.crossfit_gate(_eligible(spark, d), GATE_FEATURES, 1, ALPHA)


_PAIR = f"""pa AS (SELECT event_id, min(y) AS y, max(time_to_tca) FILTER (WHERE score < {BOUND}::DOUBLE AND eligible_history_count >= {MINIMUM_HISTORY}) AS ta,
    max(time_to_tca) FILTER (WHERE candidate < 0.6::DOUBLE AND eligible_history_count >= {MINIMUM_HISTORY}) AS tb FROM e GROUP BY 1)"""


def _pairs(spark, d):
    rows = _eligible(spark, d)
    return experiments.paired_decisions(calibrate.first_safe(rows, F.lit(BOUND), MINIMUM_HISTORY), calibrate.first_safe(rows, F.lit(0.6), MINIMUM_HISTORY, score="candidate"))


@query(f"WITH {S}, {_PAIR} SELECT event_id, y, ta IS NOT NULL AS safe_baseline, tb IS NOT NULL AS safe_candidate, ta AS tca_baseline, tb AS tca_candidate FROM pa")
def paired_decisions(spark, d):
    return _pairs(spark, d)


_CHANGE = "count(*) FILTER (WHERE y = 0) AS n_negative, count(*) FILTER (WHERE y = 0 AND tb IS NOT NULL AND ta IS NULL) AS gained, count(*) FILTER (WHERE y = 0 AND tb IS NULL AND ta IS NOT NULL) AS lost, round(quantile_cont(CASE WHEN y = 0 THEN tb - ta END, 0.5), 9) AS median_time_change"


def _change(df, groups=()):
    return df.select(*groups, "n_negative", "gained", "lost", F.round("median_time_change", 9).alias("median_time_change"))


@query(f"WITH {S}, {_PAIR} SELECT {_CHANGE} FROM pa")
def paired_change(spark, d):
    return _change(experiments.paired_change(_pairs(spark, d), (), test=False))


@query(f"WITH {S}, {_PAIR}, hg AS (SELECT event_id, CASE WHEN count(*) <= 4 THEN '1-4' WHEN count(*) <= 10 THEN '5-10' ELSE '11+' END AS history_group FROM e GROUP BY 1) SELECT history_group, {_CHANGE} FROM pa JOIN hg USING (event_id) GROUP BY 1")
def paired_subgroups(spark, d):
    groups = features.event_groups(_eligible(spark, d), ("risk",)).select("event_id", "history_group")
    return _change(experiments.paired_change(_pairs(spark, d).join(groups, "event_id"), ("history_group",), test=False), ("history_group",))


@query(f"""WITH {S}, {_PAIR}, hg AS (SELECT event_id, CASE WHEN count(*) <= 4 THEN '1-4' WHEN count(*) <= 10 THEN '5-10' ELSE '11+' END AS history_group FROM e GROUP BY 1), c AS (SELECT history_group, {_CHANGE} FROM pa JOIN hg USING (event_id) GROUP BY 1)
    SELECT history_group, gained, lost, gained - lost AS net, round(CASE WHEN gained + lost = 0 THEN 1 ELSE least(1, 2 * list_sum(list_transform(range(0, least(gained, lost) + 1), lambda j: exp(lgamma(gained + lost + 1) - lgamma(j + 1) - lgamma(gained + lost - j + 1) - (gained + lost) * ln(2))))) END, 9) AS mcnemar_p FROM c""")
def paired_tests(spark, d):
    """Gains and losses by history with the exact McNemar p."""
    groups = features.event_groups(_eligible(spark, d), ("risk",)).select("event_id", "history_group")
    change = experiments.paired_change(_pairs(spark, d).join(groups, "event_id"), ("history_group",))
    return change.select("history_group", "gained", "lost", "net", F.round("mcnemar_p", 9).alias("mcnemar_p"))


GROUPED = f"""gr AS (SELECT f.event_id, f.y, f.first_safe_tca, CAST(f.fold AS VARCHAR) AS fold, hg.history_group FROM f JOIN (SELECT event_id, CASE WHEN count(*) <= 4 THEN '1-4' WHEN count(*) <= 10 THEN '5-10' ELSE '11+' END AS history_group FROM e GROUP BY 1) hg USING (event_id))"""


def _grouped(spark, d):
    groups = features.event_groups(_eligible(spark, d), ("risk",)).select("event_id", "history_group")
    return _decisions(spark, d).join(groups, "event_id")


@query(f"""WITH {S}, {FS}, {GROUPED} SELECT history_group, count(*) AS n_events, count(*) FILTER (WHERE y = 1) AS n_positive, count(*) FILTER (WHERE y = 1 AND first_safe_tca IS NOT NULL) AS danger, count(*) FILTER (WHERE y = 0 AND first_safe_tca IS NOT NULL) AS safe_negative FROM gr GROUP BY 1""")
def subgroup_metrics(spark, d):
    return experiments.subgroup_metrics(_grouped(spark, d), ("history_group",)).select(F.col("value").alias("history_group"), "n_events", "n_positive", "danger", "safe_negative")


@query(f"""WITH {S}, {FS}, {GROUPED} SELECT CASE WHEN grouping(fold) = 0 THEN 'fold' ELSE 'history_group' END AS grouping, coalesce(fold, history_group) AS value, count(*) AS n_events, count(*) FILTER (WHERE y = 1 AND first_safe_tca IS NOT NULL) AS danger, count(*) FILTER (WHERE y = 0 AND first_safe_tca IS NOT NULL) AS safe_negative
    FROM gr GROUP BY GROUPING SETS ((fold), (history_group))""")
def robustness_grouping_sets(spark, d):
    return experiments.subgroup_metrics(_grouped(spark, d), ("fold", "history_group")).select("grouping", "value", "n_events", "danger", "safe_negative")


@query()
def paired_interval(spark, d):
    """Net change of safe negatives by history, with its bootstrap interval; the interval is drawn, so there is no SQL twin."""
    groups = features.event_groups(_eligible(spark, d), ("risk",)).select("event_id", "history_group")
    change = experiments.paired_change(_pairs(spark, d).join(groups, "event_id"), ("history_group",), test=False).withColumn("interval", net_change_column(F.col("gained"), F.col("lost"), F.col("n_negative")))
    return change.select("history_group", "n_negative", "gained", "lost", F.round(F.col("interval")[0], 6).alias("low"), F.round(F.col("interval")[1], 6).alias("high"))


_STABLE = f"""WITH {S}, ev AS (SELECT event_id, min(y) AS y, coalesce(min(score) FILTER (WHERE eligible_history_count >= 1), 'infinity'::DOUBLE) AS v FROM e GROUP BY 1),
    ha AS (SELECT *, CASE WHEN 2 * row_number() OVER (PARTITION BY repeat, y ORDER BY hash, event_id) > count(*) OVER (PARTITION BY repeat, y) THEN 1 ELSE 0 END AS half
        FROM (SELECT event_id, y, v, r AS repeat, sha256('stability:' || r || ':' || event_id) AS hash FROM ev, (SELECT unnest(range(0, 20))::INTEGER AS r))),
    o AS (SELECT repeat, v, row_number() OVER (PARTITION BY repeat ORDER BY v, event_id) AS i, count(*) OVER (PARTITION BY repeat) AS n FROM ha WHERE half = 0 AND y = 1),
    bd AS (SELECT repeat, max(v) FILTER (WHERE i = least(n, floor({ALPHA}::DOUBLE * (n + 1)))) AS bound FROM o GROUP BY 1),
    st AS (SELECT repeat, count(*) FILTER (WHERE y = 1) AS n_positive, count(*) FILTER (WHERE y = 1 AND v < bound) AS danger, count(*) FILTER (WHERE y = 0) AS n_negative, count(*) FILTER (WHERE y = 0 AND v < bound) AS safe_negative FROM ha LEFT JOIN bd USING (repeat) WHERE half = 1 GROUP BY 1)"""


def _stability(spark, d):
    rows = _methods(spark, d).filter("method = 'baseline'")
    return experiments.repeated_stability(rows, 20, 1, ALPHA)


@query(f"{_STABLE} SELECT repeat, n_positive, danger, n_negative, safe_negative FROM st")
def repeated_stability(spark, d):
    return _stability(spark, d).select("repeat", "n_positive", "danger", "n_negative", "safe_negative")


@query(f"""{_STABLE} SELECT 'baseline' AS method, count(*) AS repeats, round(avg(safe_negative::DOUBLE / nullif(n_negative, 0)), 9) AS mean_rate, round(quantile_cont(safe_negative::DOUBLE / nullif(n_negative, 0), 0.05), 9) AS q05, round(quantile_cont(safe_negative::DOUBLE / nullif(n_negative, 0), 0.5), 9) AS median,
    round(quantile_cont(safe_negative::DOUBLE / nullif(n_negative, 0), 0.95), 9) AS q95, round(avg((danger::DOUBLE / nullif(n_positive, 0) <= {ALPHA}::DOUBLE)::INT), 9) AS within_alpha FROM st""")
def stability_summary(spark, d):
    out = experiments.stability_summary(_stability(spark, d), ALPHA)
    return out.select("method", "repeats", *(F.round(a, 9).alias(b) for a, b in (("mean_safe_negative_rate", "mean_rate"), ("q05", "q05"), ("median", "median"), ("q95", "q95"), ("within_alpha", "within_alpha"))))


@query(f"""WITH {S}, n AS (SELECT fold, count(DISTINCT event_id) AS n FROM s WHERE y = 1 GROUP BY 1),
    c AS (SELECT fold, n, k, sum(exp(lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1) + k * ln({ALPHA}::DOUBLE) + (n - k) * ln(1 - {ALPHA}::DOUBLE))) OVER (PARTITION BY fold ORDER BY k) AS p FROM n, (SELECT unnest(range(0, 20000)) AS k) WHERE k <= n)
    SELECT fold, n, CAST(count(*) FILTER (WHERE p <= 1 - {CONFIDENCE}::DOUBLE) - 1 AS INTEGER) AS k_max FROM c GROUP BY 1, 2""")
def planning_max_failures(spark, d):
    n = _scored(spark, d).filter("y = 1").groupBy("fold").agg(F.count_distinct("event_id").alias("n"))
    return n.select("fold", "n", (rank_column(F.col("n"), ALPHA, "pac", CONFIDENCE) - 1).alias("k_max"))


# --- collections -------------------------------------------------------------------------------------------------------------------------


@query(f"""WITH {M}, g AS (SELECT cdm_no, event_pair, epoch_us(tca) - lag(epoch_us(tca)) OVER (PARTITION BY event_pair ORDER BY tca, cdm_no) AS gap, tca FROM m WHERE event_pair IS NOT NULL)
    SELECT cdm_no, CAST(sum(CASE WHEN gap > 1800000000 THEN 1 ELSE 0 END) OVER (PARTITION BY event_pair ORDER BY tca, cdm_no ROWS UNBOUNDED PRECEDING) AS INTEGER) AS cluster_no FROM g""")
def tca_clusters(spark, d):
    return messages.tca_clusters(_messages(spark, d)).select("cdm_no", "cluster_no")


@query(f"""WITH {M}, v AS (SELECT event_pair, event_id, min(tca) AS a, max(tca) AS b, count(*) AS messages FROM m WHERE event_pair IS NOT NULL GROUP BY 1, 2),
    w AS (SELECT *, (epoch_us(b) - epoch_us(a)) / 1000000.0::DOUBLE AS span_s, (epoch_us(a) - epoch_us(lag(b) OVER o)) / 1000000.0::DOUBLE AS gap_before_s, (epoch_us(lead(a) OVER o) - epoch_us(b)) / 1000000.0::DOUBLE AS gap_after_s FROM v WINDOW o AS (PARTITION BY event_pair ORDER BY a, event_id))
    SELECT event_id, messages, round(span_s, 3) AS span_s, round(gap_before_s, 3) AS gap_before_s, round(gap_after_s, 3) AS gap_after_s,
        concat_ws(',', CASE WHEN span_s > 1800 THEN 'wide' END, CASE WHEN least(gap_before_s, gap_after_s) <= 1800 THEN 'near' END, CASE WHEN least(gap_before_s, gap_after_s) <= 86400 THEN 'crowded' END) AS reasons FROM w""")
def grouping_review(spark, d):
    out = review.grouping_review(_messages(spark, d))
    return out.select("event_id", "messages", F.round("span_s", 3).alias("span_s"), F.round("gap_before_s", 3).alias("gap_before_s"), F.round("gap_after_s", 3).alias("gap_after_s"), "reasons")


@query(f"WITH {M} " + " UNION ALL ".join(f"SELECT '{c}' AS column_name, count(*) FILTER (WHERE {c} IS NULL) AS missing, count(*) FILTER (WHERE {c} IS NULL)::DOUBLE / count(*) AS share FROM m" for c in messages.MESSAGE_FIELDS))
def feature_missingness(spark, d):
    return review.feature_missingness(_messages(spark, d), messages.MESSAGE_FIELDS)


@query(f"""WITH {M}, v AS (SELECT event_id, count(*) AS n, count(*) FILTER (WHERE time_to_tca BETWEEN 2.0 AND 7.0) AS w, count(*) FILTER (WHERE risk IS NOT NULL AND miss_distance IS NOT NULL) AS c FROM m GROUP BY 1)
    SELECT CAST(sum(n) AS BIGINT) AS messages, count(*) AS events, CAST(sum(w) AS BIGINT) AS window_messages, count(*) FILTER (WHERE w > 0) AS window_events, count(*) FILTER (WHERE w >= 3) AS eligible_events, max(w) AS longest_history, CAST(sum(c) AS BIGINT) AS complete_messages FROM v""")
def readiness_report(spark, d):
    return review.readiness(_messages(spark, d), ("risk", "miss_distance"))


_C = f"""co AS (SELECT {_event_sql('event_id')} AS event_id, record_no, time_to_tca, collection_batch, CASE WHEN length({usable_sql('study_cohort')}) >= 4 AND starts_with('calibration', lower({usable_sql('study_cohort')})) THEN 'calibration'
    WHEN length({usable_sql('study_cohort')}) >= 4 AND starts_with('evaluation', lower({usable_sql('study_cohort')})) THEN 'evaluation' END AS c, {usable_sql('source_message_id')} AS k, miss_distance, relative_speed FROM external_collection)"""


@query(f"""WITH {_C}, v AS (SELECT event_id, arg_min(c, record_no) FILTER (WHERE c IS NOT NULL) AS study_cohort, count(*) AS n, count(*) FILTER (WHERE time_to_tca BETWEEN 2.0 AND 7.0) AS w FROM co WHERE event_id IS NOT NULL GROUP BY 1)
    SELECT study_cohort, count(*) AS events, CAST(sum(n) AS BIGINT) AS messages, count(*) FILTER (WHERE w > 0) AS window_events, count(*) FILTER (WHERE w >= 3) AS eligible_events FROM v GROUP BY 1""")
def collection_status(spark, d):
    return review.collection_status(table(spark, d, "external_collection"))


@query(f"""WITH {_C}, v AS (SELECT DISTINCT event_id, c FROM co WHERE event_id IS NOT NULL AND c IS NOT NULL) SELECT c AS cohort, count(*) AS events FROM v GROUP BY 1""")
def cohort_split_counts(spark, d):
    from skysieve.functions.keys import cohort_key

    rows = table(spark, d, "external_collection").select(event_key(F.col("event_id")).alias("event_id"), cohort_key(F.col("study_cohort")).alias("cohort")).filter("event_id is not null and cohort is not null")
    return rows.distinct().groupBy("cohort").agg(F.count(F.lit(1)).alias("events"))


@query(f"""WITH {_C}, n AS (SELECT record_no, k, CASE WHEN NOT isnan(miss_distance) THEN miss_distance END AS a, CASE WHEN NOT isnan(relative_speed) THEN relative_speed END AS b FROM co), f AS (SELECT k, min(record_no) AS first_no FROM n WHERE k IS NOT NULL GROUP BY 1)
    SELECT n.record_no, CASE WHEN n.k IS NULL THEN 'unidentified' WHEN n.record_no = f.first_no THEN 'new' WHEN n.a IS NOT DISTINCT FROM o.a AND n.b IS NOT DISTINCT FROM o.b THEN 'duplicate' ELSE 'conflict' END AS delivery
    FROM n LEFT JOIN f ON n.k = f.k LEFT JOIN n o ON o.record_no = f.first_no""")
def message_dedup(spark, d):
    from skysieve.functions.keys import finite_or_null

    rows = table(spark, d, "external_collection").select("record_no", "source_message_id", finite_or_null(F.col("miss_distance")).alias("a"), finite_or_null(F.col("relative_speed")).alias("b"))
    return review.delivery_classes(rows, ("a", "b"))


@query(f"""WITH {_C} SELECT record_no, event_id FROM (SELECT record_no, event_id, time_to_tca, lag(time_to_tca) OVER (PARTITION BY event_id ORDER BY record_no) AS p FROM co WHERE event_id IS NOT NULL) WHERE p <= time_to_tca""")
def out_of_order_updates(spark, d):
    rows = table(spark, d, "external_collection").select("record_no", event_key(F.col("event_id")).alias("event_id"), "time_to_tca").filter("event_id is not null")
    return review.out_of_order(rows, "record_no").select("record_no", "event_id")


_CHAIN = """c AS (SELECT *, sha256(concat_ws('|', collection_batch::VARCHAR, coalesce(source_export_sha256, ''), coalesce(received_messages::VARCHAR, ''))) AS entry_sha256 FROM collection_ledger),
    h AS (SELECT *, coalesce(lag(entry_sha256) OVER (ORDER BY collection_batch), '') AS previous_sha256 FROM c)"""


@query(f"WITH {_CHAIN} SELECT collection_batch, entry_sha256, previous_sha256 FROM h")
def chain_entries(spark, d):
    chain = review.chained(table(spark, d, "collection_ledger"), "collection_batch", ("source_export_sha256", "received_messages"))
    return chain.select("collection_batch", "entry_sha256", "previous_sha256")


@query(f"""WITH {_CHAIN}, t AS (SELECT *, lag(collection_batch) OVER (ORDER BY collection_batch) AS p FROM h WHERE collection_batch % 5 <> 4) SELECT collection_batch FROM t WHERE collection_batch % 7 = 2 OR p <> collection_batch - 1""")
def chain_verify(spark, d):
    """What verification finds in a chain of which entries were forged (numbers 2, 9, 16, ...: one message more) and others removed (4, 9, 14, ...)."""
    chain = review.chained(table(spark, d, "collection_ledger"), "collection_batch", ("source_export_sha256", "received_messages"))
    forged = chain.withColumn("received_messages", F.when(F.col("collection_batch") % 7 == 2, F.coalesce("received_messages", F.lit(0)) + 1).otherwise(F.col("received_messages")))
    return review.chain_breaks(forged.filter("collection_batch % 5 <> 4"), "collection_batch", ("source_export_sha256", "received_messages")).select("collection_batch")


@query("""SELECT l.collection_batch, l.received_messages, count(x.record_no) AS found FROM collection_ledger l LEFT JOIN external_collection x ON l.collection_batch = x.collection_batch GROUP BY 1, 2""")
def ledger_counts(spark, d):
    counts = table(spark, d, "external_collection").groupBy("collection_batch").agg(F.count(F.lit(1)).alias("c"))
    return table(spark, d, "collection_ledger").join(counts, "collection_batch", "left").select("collection_batch", "received_messages", F.coalesce("c", F.lit(0)).alias("found"))


@query("""WITH f AS (SELECT collection_batch, CASE WHEN collection_batch % 6 = 5 THEN 'other' ELSE source_export_sha256 END AS sha, opened_at + CASE collection_batch % 4 WHEN 2 THEN INTERVAL 3 HOURS WHEN 0 THEN -INTERVAL 600 HOURS ELSE INTERVAL 0 HOURS END AS opened_at FROM collection_ledger),
    l AS (SELECT *, lead(opened_at) OVER (ORDER BY collection_batch) AS ends_at FROM f),
    r AS (SELECT x.record_no, CASE WHEN l.collection_batch IS NULL THEN 'no_entry' WHEN x.received_at < l.opened_at THEN 'before_opening' WHEN x.received_at >= l.ends_at THEN 'after_end' WHEN x.source_export_sha256 IS DISTINCT FROM l.sha THEN 'other_export' END AS fault
        FROM external_collection x LEFT JOIN l ON x.collection_batch = l.collection_batch)
    SELECT record_no, fault FROM r WHERE fault IS NOT NULL""")
def period_violations(spark, d):
    """Records against a ledger in which periods were moved (of batches 2, 6, 10, ... three hours later and of 4, 8, 12, ... 25 days earlier) and digests
    forged (5, 11, 17, ...)."""
    n = F.col("collection_batch")
    hours = F.when(n % 4 == 2, 3).when(n % 4 == 0, -600).otherwise(0)
    moved = table(spark, d, "collection_ledger").select(n, F.when(n % 6 == 5, "other").otherwise(F.col("source_export_sha256")).alias("source_export_sha256"), (F.col("opened_at") + F.make_dt_interval(hours=hours)).alias("opened_at"))
    return review.period_faults(table(spark, d, "external_collection"), moved)


@query(f"WITH {_C} SELECT DISTINCT event_id FROM co WHERE event_id IS NOT NULL AND time_to_tca BETWEEN 2.0 AND 7.0")
def window_roster(spark, d):
    rows = table(spark, d, "external_collection").select(event_key(F.col("event_id")).alias("event_id"), "time_to_tca")
    return features.decision_window(rows).filter("event_id is not null").select("event_id").distinct()


# --- triage ------------------------------------------------------------------------------------------------------------------------------

POLICY = triage.TriagePolicy(BOUND, MINIMUM_HISTORY, 2.5, 6.5, ESCALATION)
AUDIT = f"""au AS (SELECT *, CASE WHEN score >= {ESCALATION}::DOUBLE THEN '{triage.ESCALATED}' WHEN time_to_tca > 6.5 THEN '{triage.NOT_OPEN}' WHEN time_to_tca < 2.5 THEN '{triage.CLOSED}' WHEN eligible_history_count < {MINIMUM_HISTORY} THEN '{triage.SHORT_HISTORY}'
        WHEN score < {BOUND}::DOUBLE AND NOT allowed THEN '{triage.GATE_BLOCKED}' WHEN score < {BOUND}::DOUBLE THEN '{triage.SAFE}' ELSE '{triage.BETWEEN}' END AS reason
    FROM (SELECT event_id, time_to_tca, score, miss_distance, coalesce(risk < -8, false) AS allowed, CAST(row_number() OVER w AS INTEGER) AS sequence_number, CAST(sum((time_to_tca BETWEEN 2.5 AND 6.5)::INT) OVER (w ROWS UNBOUNDED PRECEDING) AS INTEGER) AS eligible_history_count
        FROM s WINDOW w AS (PARTITION BY event_id ORDER BY time_to_tca DESC))),
    ad AS (SELECT *, CASE reason WHEN '{triage.ESCALATED}' THEN 'ESCALATE' WHEN '{triage.SAFE}' THEN 'SAFE-EXCLUDE' ELSE 'MONITOR' END AS decision FROM au),
    cu AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY sequence_number DESC) AS last_first FROM ad) WHERE last_first = 1)"""


def _audit(spark, d):
    rows = _scored(spark, d).select("event_id", "time_to_tca", "score", "miss_distance", "risk")
    return triage.batch_audit(rows, POLICY, F.col("risk") < -8)


@query(f"WITH {S}, {AUDIT} SELECT event_id, time_to_tca, sequence_number, eligible_history_count, decision FROM ad")
def triage_decisions(spark, d):
    return _audit(spark, d).select("event_id", "time_to_tca", "sequence_number", "eligible_history_count", "decision")


@query(f"WITH {S}, {AUDIT} SELECT reason, count(*) AS n FROM ad GROUP BY 1")
def triage_reasons(spark, d):
    return _audit(spark, d).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {S}, {AUDIT} SELECT event_id, sequence_number, reason, decision, allowed AS shift_gate_allowed, time_to_tca BETWEEN 2.5 AND 6.5 AS decision_window_eligible FROM ad")
def audit_log(spark, d):
    return _audit(spark, d).select("event_id", "sequence_number", "reason", "decision", "shift_gate_allowed", "decision_window_eligible")


@query(f"""WITH {S}, {AUDIT}, n AS (SELECT *, count(*) OVER (PARTITION BY event_id) AS n FROM ad)
    SELECT event_id, time_to_tca, CASE WHEN n = 1 OR n >= 6 AND sequence_number = n THEN 'missing' ELSE 'differs' END AS fault FROM n WHERE n = 1 OR n >= 6 AND sequence_number = n OR decision = 'ESCALATE' AND sequence_number = 1""")
def audit_reverify(spark, d):
    """Faults of an audit in which the first escalations were forged to exclusions, events with one message removed, and the last message of
    events with six and more: exactly these come out."""
    forged = (F.col("decision") == "ESCALATE") & (F.col("sequence_number") == 1)
    audit = features.with_sizes(_audit(spark, d).withColumn("decision", F.when(forged, "SAFE-EXCLUDE").otherwise(F.col("decision"))), "n")
    kept = audit.filter("n > 1 and not (n >= 6 and sequence_number = n)")
    updates = _scored(spark, d).select("event_id", "time_to_tca", "score", F.coalesce(F.col("risk") < -8, F.lit(False)).alias("gate_allowed"))
    return triage.audit_faults(kept, POLICY, updates)


@query(f"""WITH {S}, {AUDIT}, r AS (SELECT decision, sha256(concat_ws('|', event_id, sequence_number::VARCHAR, eligible_history_count::VARCHAR, reason, decision)) AS r FROM ad),
    p AS (SELECT decision, substr(r, 1, 3) AS k, count(*) AS n, sha256(string_agg(r, chr(10) ORDER BY r)) AS d FROM r GROUP BY 1, 2)
    SELECT decision AS delivery, CAST(sum(n) AS BIGINT) AS n_rows, sha256(string_agg(k || d, chr(10) ORDER BY k)) AS content_sha256 FROM p GROUP BY 1""")
def audit_digests(spark, d):
    """Digests of the audit's rows, with decisions standing for deliveries."""
    return triage.batch_digests(_audit(spark, d).withColumn("delivery", F.col("decision")), "delivery")


@query(f"WITH {S}, {AUDIT} SELECT event_id, max(sequence_number) AS sequence_number, max(eligible_history_count) AS eligible_history_count, min(time_to_tca) AS last_time_to_tca FROM ad GROUP BY 1")
def triage_state(spark, d):
    return triage.counters_of(_audit(spark, d))


@query(f"WITH {S}, {AUDIT} SELECT event_id, sequence_number, time_to_tca, decision, reason FROM cu")
def current_decisions(spark, d):
    return triage.current_decisions(_audit(spark, d)).select("event_id", "sequence_number", "time_to_tca", "decision", "reason")


@query(f"WITH {S}, {AUDIT} SELECT decision, count(*) AS messages, count(DISTINCT event_id) AS events FROM ad GROUP BY 1")
def decision_counts(spark, d):
    per = _audit(spark, d).groupBy("decision", "event_id").agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy("decision").agg(F.sum("n").alias("messages"), F.count(F.lit(1)).alias("events"))


@query(f"""WITH {S}, {AUDIT} SELECT event_id, decision, time_to_tca, score, CASE decision WHEN 'ESCALATE' THEN 0 WHEN 'MONITOR' THEN 1 ELSE 2 END AS priority FROM cu ORDER BY priority, time_to_tca, score DESC, event_id LIMIT 50""")
def operator_queue(spark, d):
    return triage.operator_queue(_audit(spark, d), 50).select("event_id", "decision", "time_to_tca", "score", "priority")


@query(f"""WITH {S}, {AUDIT} SELECT event_id, sequence_number, eligible_history_count >= {MINIMUM_HISTORY} AS history_sufficient, score < {BOUND}::DOUBLE AS below_safe_bound, score >= {ESCALATION}::DOUBLE AS above_escalation,
    min(CASE WHEN decision = 'SAFE-EXCLUDE' THEN sequence_number END) OVER (PARTITION BY event_id) AS first_safe_sequence, count(*) OVER (PARTITION BY event_id) AS total_updates FROM ad""")
def explain_timeline(spark, d):
    return triage.timelines(_audit(spark, d), POLICY).select("event_id", "sequence_number", "history_sufficient", "below_safe_bound", "above_escalation", "first_safe_sequence", "total_updates")


@query(f"""WITH {S}, {AUDIT}, v AS (SELECT event_id, arg_max(decision, sequence_number) AS c, min(sequence_number) FILTER (WHERE decision = 'SAFE-EXCLUDE') AS f, max(time_to_tca) FILTER (WHERE decision = 'SAFE-EXCLUDE') AS t, min(sequence_number) FILTER (WHERE decision = 'MONITOR') AS mo, count(*) AS n FROM ad GROUP BY 1)
    SELECT event_id, f AS first_safe_sequence, t AS first_safe_tca, n AS total_updates FROM v WHERE c = 'SAFE-EXCLUDE' AND mo < f ORDER BY t DESC, n DESC, event_id LIMIT 1""")
def showcase_monitor_to_safe(spark, d):
    return triage.showcase_monitor_to_safe(_audit(spark, d))


@query(f"""WITH {S}, {AUDIT}, v AS (SELECT event_id, arg_max(decision, sequence_number) AS current_decision, count(*) FILTER (WHERE reason = '{triage.GATE_BLOCKED}') AS blocked_updates, max(miss_distance) FILTER (WHERE reason = '{triage.GATE_BLOCKED}') AS max_shift_score FROM ad GROUP BY 1)
    SELECT * FROM v WHERE blocked_updates > 0 ORDER BY CASE current_decision WHEN 'MONITOR' THEN 0 ELSE 1 END, blocked_updates DESC, max_shift_score DESC NULLS LAST, event_id LIMIT 1""")
def showcase_gate_blocked(spark, d):
    return triage.showcase_gate_blocked(_audit(spark, d), "miss_distance")


@query(f"WITH {S}, {FS} SELECT round(1000.0::DOUBLE * count(*) FILTER (WHERE y = 0 AND first_safe_tca IS NOT NULL) / count(*), 6) AS safe_per_1000 FROM f")
def safe_per_1000(spark, d):
    return _decisions(spark, d).agg(F.round(F.lit(1000.0) * F.count_if(F.col("safe_exclude") & (F.col("y") == 0)) / F.count(F.lit(1)), 6).alias("safe_per_1000"))


# --- contracts -----------------------------------------------------------------------------------------------------------------------------


def _keyed_diagnostics(spark, d):
    return table(spark, d, "history_gate_diagnostics").select("diag_no", event_key(F.col("event_id")).alias("event_id"), "time_to_tca", "score", "y", "fold")


_G = f"g AS (SELECT {_event_sql('event_id')} AS event_id, time_to_tca, score, y, fold FROM history_gate_diagnostics)"


@query(f"""WITH {_G}, v AS (SELECT event_id, 'y' AS column_name, y AS v FROM g UNION SELECT event_id, 'fold', fold FROM g)
    SELECT event_id, column_name, count(v) AS n_values FROM v WHERE event_id IS NOT NULL GROUP BY 1, 2 HAVING count(v) > 1""")
def one_value_conflicts(spark, d):
    """Events with several labels or in several folds."""
    return contracts.one_value_conflicts(_keyed_diagnostics(spark, d), ("y", "fold"))


@query(f"""WITH {_G}, a AS (SELECT DISTINCT event_id FROM g WHERE event_id IS NOT NULL), b AS (SELECT {_event_sql('event_id')} AS event_id, min(y) AS lo, max(y) AS hi, count(*) FILTER (WHERE y IS NULL OR y NOT IN (0, 1)) AS bad FROM event_labels GROUP BY 1 HAVING event_id IS NOT NULL),
    f AS (SELECT coalesce(a.event_id, b.event_id) AS event_id, CASE WHEN b.event_id IS NULL THEN 'unlabelled' WHEN a.event_id IS NULL THEN 'unscored' WHEN bad > 0 THEN 'bad_label' WHEN lo < hi THEN 'conflict' END AS fault FROM a FULL JOIN b ON a.event_id = b.event_id)
    SELECT event_id, fault FROM f WHERE fault IS NOT NULL""")
def roster_faults(spark, d):
    labels = table(spark, d, "event_labels").select(event_key(F.col("event_id")).alias("event_id"), "y")
    return contracts.roster_faults(_keyed_diagnostics(spark, d), labels)


@query(f"""WITH {_G}, {_C}, k AS (SELECT DISTINCT event_id FROM co WHERE c = 'calibration'), u AS (SELECT count(*) - 1 AS n FROM g WHERE event_id IS NOT NULL AND time_to_tca IS NOT NULL GROUP BY event_id, time_to_tca)
    SELECT 'event_missing' AS rule, count(*) FILTER (WHERE event_id IS NULL) AS violations FROM g
    UNION ALL SELECT 'time_invalid', count(*) FILTER (WHERE NOT coalesce(isfinite(time_to_tca) AND time_to_tca >= 0, false)) FROM g
    UNION ALL SELECT 'score_not_finite', count(*) FILTER (WHERE NOT coalesce(isfinite(score), false)) FROM g
    UNION ALL SELECT 'score_out_of_range', count(*) FILTER (WHERE isfinite(score) AND NOT score BETWEEN 0 AND 1) FROM g
    UNION ALL SELECT 'fold_missing', count(*) FILTER (WHERE fold IS NULL) FROM g
    UNION ALL SELECT 'fold_differs', greatest(0, count(DISTINCT fold) - 1) FROM g
    UNION ALL SELECT 'repeated_update', CAST(coalesce(sum(n), 0) AS BIGINT) FROM u
    UNION ALL SELECT 'calibration_event', count(*) FROM g WHERE event_id IN (SELECT event_id FROM k WHERE event_id IS NOT NULL)""")
def stream_contract(spark, d):
    """What a replay of the raw diagnostics would break; fold stands for a column that must be one in all rows."""
    from skysieve.functions.keys import cohort_key

    calibration = table(spark, d, "external_collection").filter(cohort_key(F.col("study_cohort")) == "calibration").select(event_key(F.col("event_id")).alias("event_id"))
    return contracts.stream_faults(_keyed_diagnostics(spark, d), calibration=calibration, one_valued=("fold",))
