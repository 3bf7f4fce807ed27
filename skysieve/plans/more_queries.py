"""Registered queries of readers, event assignment, models and deliveries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skysieve.functions.checks import finite
from skysieve.functions.keys import with_pair_key
from skysieve.operators import features, messages, model, sessions
from skysieve.operators.delivery import exactly_once
from skysieve.plans.core_queries import usable_sql
from skysieve.functions.stats import pass_column
from skysieve.plans.reference_queries import ALPHA, AUDIT, CONFIDENCE, FS, GROUPED, POLICY, S, _grouped
from skysieve.plans.tables import table
from skysieve.session import scratch_path
from skysieve.sources import cdm
from skysieve.streaming import triage


def _present(column: str):
    return F.when(finite(F.col(column)), F.col(column).cast("string"))


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "external_cdm").filter("creation_date is not null and tca is not null and creation_date <= tca and event_pair is not null")


def parse_kvn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every message written as a KVN document and read back."""
    line = lambda key, value, unit="": F.concat(F.lit(f"{key} = "), value, F.lit(unit))
    text = F.concat_ws(
        "\n", F.lit("CCSDS_CDM_VERS = 1.0"), F.lit("COMMENT written for reading"), line("CREATION_DATE", F.col("creation_date").cast("string")), line("MESSAGE_ID", F.col("cdm_no").cast("string")), line("TCA", F.col("tca").cast("string")),
        line("MISS_DISTANCE", _present("miss_distance"), " [m]"), line("RELATIVE_SPEED", _present("relative_speed"), " [m/s]"), F.lit("OBJECT = OBJECT1"), line("OBS_USED", _present("t_obs_used")), F.lit("OBJECT = OBJECT2"), line("OBS_USED", _present("c_obs_used")),
    )
    rows = cdm.adapt(cdm.parse_kvn(_texts(spark, sf_dir).select(text.alias("value"))))
    return rows.select(F.col("source_message_id").cast("bigint").alias("cdm_no"), "miss_distance", "relative_speed", "t_obs_used", "c_obs_used", F.round("time_to_tca", 6).alias("days"))


def parse_ndjson(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every message written as a JSON line and read back."""
    record = F.to_json(F.struct(
        F.col("creation_date").cast("string").alias("creation_date"), F.col("tca").cast("string").alias("tca"), F.col("cdm_no").cast("string").alias("message_id"), _present("miss_distance").alias("miss_distance"), F.lit("metre").alias("miss_distance_unit"),
        _present("relative_speed").alias("relative_speed"), _present("t_obs_used").alias("sat1_obs_used"), _present("c_obs_used").alias("sat2_obs_used"),
    ))
    rows = cdm.adapt(cdm.parse_ndjson(_texts(spark, sf_dir).select(record.alias("value"))))
    return rows.select(F.col("source_message_id").cast("bigint").alias("cdm_no"), "miss_distance", "relative_speed", "t_obs_used", "c_obs_used", F.round("time_to_tca", 6).alias("days"))


#: Entries of full covariances and positions, made from columns of a message so that no entry is zero: the field and its expression.
_ENTRIES = {
    "relative_position_r": "miss_distance / 1000", "relative_position_t": "relative_speed / 1000", "relative_position_n": "max_risk_scaling",
    "sat1_cr_r": "t_obs_used + 10", "sat1_ct_r": "t_weighted_rms * 0.3", "sat1_ct_t": "t_obs_available + 20", "sat1_cn_r": "c_weighted_rms * -0.2", "sat1_cn_t": "max_risk_scaling * 0.1", "sat1_cn_n": "c_obs_available + 5",
    "sat2_cr_r": "c_obs_used + 10", "sat2_ct_r": "c_weighted_rms * -0.4", "sat2_ct_t": "c_obs_available + 20", "sat2_cn_r": "t_weighted_rms * 0.1", "sat2_cn_t": "max_risk_scaling * -0.3", "sat2_cn_n": "t_obs_available + 5",
}


def adapt_covariances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Determinants and Mahalanobis distance of messages with full covariances, read from JSON lines."""
    rows = _texts(spark, sf_dir).withColumns({name: F.expr(entry) for name, entry in _ENTRIES.items()})
    record = F.to_json(F.struct(F.col("creation_date").cast("string").alias("creation_date"), F.col("tca").cast("string").alias("tca"), F.col("cdm_no").cast("string").alias("message_id"), *(_present(name).alias(name) for name in _ENTRIES)))
    out = cdm.adapt(cdm.parse_ndjson(rows.select(record.alias("value"))))
    return out.select(F.col("source_message_id").cast("bigint").alias("cdm_no"), F.round("t_position_covariance_det", 2).alias("t_det"), F.round("c_position_covariance_det", 2).alias("c_det"), F.round("mahalanobis_distance", 6).alias("distance"))


def persistent_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The messages of all batches after the first, assigned to the events of the first and to new ones; a missing batch is the first."""
    rows = with_pair_key(table(spark, sf_dir, "external_collection"), table(spark, sf_dir, "object_alias"))
    rows = rows.select("record_no", F.coalesce("collection_batch", F.lit(1)).alias("collection_batch"), F.col("pair_key").alias("event_pair"), F.col("record_no").alias("message_id"), F.try_to_timestamp("tca").alias("tca"), F.col("record_no").alias("order_no"), "event_id")
    rows = rows.filter("event_pair is not null and tca is not null")
    first = rows.filter("collection_batch = 1 and event_id is not null").groupBy("event_id", "event_pair").agg(F.min("tca").alias("tca_min"), F.max("tca").alias("tca_max"))
    return sessions.persistent_events(rows.filter("collection_batch > 1"), first)


_MODEL_COLUMNS = tuple(f"{c}{k}" for c in features.PREFIX_COLUMNS for k in ("", "_min_so_far", "_delta_prev")) + ("time_to_tca", "n_cdm_so_far")


def _out_of_fold(spark: SparkSession, sf_dir: str, scorer: model.Scorer) -> DataFrame:
    rows = features.prefix_features(messages.scored(table(spark, sf_dir, "history_gate_diagnostics"))).drop("score")
    return model.out_of_fold(rows, scorer).select("diag_no", "event_id", "time_to_tca", "fold", F.round("score", 6).alias("score"))


def oof_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Out-of-fold scores of a logistic model on the prefix features of scored messages."""
    return _out_of_fold(spark, sf_dir, model.ml_scorer(_MODEL_COLUMNS, contract=model.feature_contract(_MODEL_COLUMNS)))


def oof_tail_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Out-of-fold scores of models whose weights lie on the messages that models of the inner folds score lowest."""
    return _out_of_fold(spark, sf_dir, model.tail_aligned_scorer(_MODEL_COLUMNS, iterations=5))


def delivered_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The collection with one record of each identifier."""
    return exactly_once(table(spark, sf_dir, "external_collection")).select("record_no", "source_message_id", "event_id", "collection_batch")


def planning_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chance to pass, for the positives of each fold and three true rates."""
    sizes = messages.scored(table(spark, sf_dir, "history_gate_diagnostics")).filter("y = 1").groupBy("fold").agg(F.count_distinct("event_id").alias("n"))
    grid = sizes.select("fold", "n", F.explode(F.array(F.lit(0.03), F.lit(0.05), F.lit(0.08))).alias("true_rate"))
    chance = pass_column(F.col("n"), F.col("true_rate"), ALPHA, CONFIDENCE)
    return grid.select("fold", "n", "true_rate", F.round(chance, 7).alias("pass_probability"))


def subgroup_heterogeneity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chi-square statistic of exclusion against history group and fold, over all events."""
    decisions = _grouped(spark, sf_dir).select("event_id", "safe_exclude", F.col("fold").cast("string").alias("fold"), "history_group")
    long = decisions.select("safe_exclude", F.expr("stack(2, 'fold', fold, 'history_group', history_group) as (grouping, value)"))
    cells = long.groupBy("grouping", "value").agg(F.count(F.lit(1)).alias("n"), F.count_if("safe_exclude").alias("s"))
    total = cells.groupBy("grouping").agg(F.sum("n").alias("all_n"), F.sum("s").alias("all_s"))
    share = F.col("all_s") / F.col("all_n")
    part = F.pow(F.col("s") - F.col("n") * share, 2)
    return (
        cells.join(total, "grouping").groupBy("grouping")
        .agg(F.sum(F.try_divide(part, F.col("n") * share) + F.try_divide(part, F.col("n") * (1 - share))).alias("x"), F.count(F.lit(1)).alias("k"))
        .select("grouping", F.round("x", 6).alias("chi_square"), (F.col("k") - 1).alias("degrees"))
    )


def stream_triage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All scored messages replayed as a stream of four deliveries, latest last, with state per event; the audit it leaves. A delivery is
    written by as many tasks as its rows take and read as one micro-batch before the next is written."""
    rows = messages.scored(table(spark, sf_dir, "history_gate_diagnostics")).select("event_id", "time_to_tca", "score", "risk")
    path = scratch_path(spark, "stream")
    for low, high in ((6.0, 1e9), (4.5, 6.0), (3.0, 4.5), (-1e9, 3.0)):
        rows.filter((F.col("time_to_tca") >= low) & (F.col("time_to_tca") < high)).write.mode("append").parquet(f"{path}/updates")
        source = spark.readStream.schema(rows.schema).parquet(f"{path}/updates")
        triage.replay(source, POLICY, f"{path}/audit", f"{path}/state", F.col("risk") < -8).awaitTermination()
    return spark.read.parquet(f"{path}/audit").select("event_id", "time_to_tca", "sequence_number", "eligible_history_count", "reason", "decision")


QUERIES = {
    "adapt_covariances": adapt_covariances, "parse_kvn": parse_kvn, "parse_ndjson": parse_ndjson, "persistent_events": persistent_events, "oof_scores": oof_scores, "oof_tail_scores": oof_tail_scores, "delivered_once": delivered_once, "planning_table": planning_table,
    "subgroup_heterogeneity": subgroup_heterogeneity, "stream_triage": stream_triage,
}

_READ = """
    SELECT cdm_no, CASE WHEN isfinite(miss_distance) THEN miss_distance END AS miss_distance, CASE WHEN isfinite(relative_speed) THEN relative_speed END AS relative_speed,
        CASE WHEN isfinite(t_obs_used) THEN t_obs_used END AS t_obs_used, CASE WHEN isfinite(c_obs_used) THEN c_obs_used END AS c_obs_used, round((epoch_us(tca) - epoch_us(creation_date)) / 86400000000.0::DOUBLE, 6) AS days
    FROM external_cdm WHERE creation_date <= tca AND event_pair IS NOT NULL
"""


def _det_sql(m: str) -> str:
    return f"({m}rr * ({m}tt * {m}nn - {m}nt * {m}nt) - {m}tr * ({m}tr * {m}nn - {m}nt * {m}nr) + {m}nr * ({m}tr * {m}nt - {m}tt * {m}nr))"


_TRIANGLE = ("rr", "tr", "tt", "nr", "nt", "nn")

SQL = {
    "adapt_covariances": f"""
        WITH v AS (SELECT cdm_no, {', '.join(f'({entry})::DOUBLE AS {name}' for name, entry in _ENTRIES.items())} FROM external_cdm WHERE creation_date <= tca AND event_pair IS NOT NULL),
        f AS (SELECT cdm_no, {', '.join(f'CASE WHEN isfinite({name}) THEN {name} END AS {name}' for name in _ENTRIES)} FROM v),
        m AS (SELECT cdm_no, relative_position_r AS x, relative_position_t AS y, relative_position_n AS z, {', '.join(f'sat{i}_c{k[0]}_{k[1]} AS {s}{k}' for i, s in ((1, 'a'), (2, 'b')) for k in _TRIANGLE)}, {', '.join(f'sat1_c{k[0]}_{k[1]} + sat2_c{k[0]}_{k[1]} AS {k}' for k in _TRIANGLE)} FROM f),
        d AS (SELECT *, {_det_sql('a')} AS da, {_det_sql('b')} AS db, {_det_sql('')} AS dd, x * x * (tt * nn - nt * nt) + y * y * (rr * nn - nr * nr) + z * z * (rr * tt - tr * tr)
            + 2 * (x * y * (nr * nt - tr * nn) + x * z * (tr * nt - nr * tt) + y * z * (nr * tr - rr * nt)) AS form FROM m)
        SELECT cdm_no, CASE WHEN da > 0 THEN round(da, 2) END AS t_det, CASE WHEN db > 0 THEN round(db, 2) END AS c_det, CASE WHEN form / dd IS NOT NULL THEN round(sqrt(greatest(form / dd, 0)), 6) END AS distance FROM d
    """,
    "planning_table": f"""
        WITH {S}, n AS (SELECT fold, count(DISTINCT event_id) AS n FROM s WHERE y = 1 GROUP BY 1), ks AS (SELECT unnest(range(0, 20000)) AS k),
        c AS (SELECT fold, n, k, sum(exp(lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1) + k * ln({ALPHA}::DOUBLE) + (n - k) * ln(1 - {ALPHA}::DOUBLE))) OVER (PARTITION BY fold ORDER BY k) AS p FROM n, ks WHERE k <= n),
        m AS (SELECT fold, n, count(*) FILTER (WHERE p <= 1 - {CONFIDENCE}::DOUBLE) - 1 AS k_max FROM c GROUP BY 1, 2),
        r AS (SELECT m.*, unnest([0.03::DOUBLE, 0.05::DOUBLE, 0.08::DOUBLE]) AS true_rate FROM m)
        SELECT fold, n, true_rate, round(coalesce(sum(exp(lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1) + k * ln(true_rate) + (n - k) * ln(1 - true_rate))) FILTER (WHERE k <= k_max), 0), 7) AS pass_probability
        FROM r, ks WHERE k <= n GROUP BY 1, 2, 3
    """,
    "subgroup_heterogeneity": f"""
        WITH {S}, {FS}, {GROUPED}, lo AS (SELECT 'fold' AS grouping, fold AS value, first_safe_tca IS NOT NULL AS safe FROM gr UNION ALL SELECT 'history_group', history_group, first_safe_tca IS NOT NULL FROM gr),
        ce AS (SELECT grouping, value, count(*) AS n, count(*) FILTER (WHERE safe) AS s FROM lo GROUP BY 1, 2), t AS (SELECT *, sum(s) OVER (PARTITION BY grouping)::DOUBLE / sum(n) OVER (PARTITION BY grouping) AS q FROM ce)
        SELECT grouping, round(sum(pow(s - n * q, 2) / nullif(n * q, 0) + pow(s - n * q, 2) / nullif(n * (1 - q), 0)), 6) AS chi_square, count(*) - 1 AS degrees FROM t GROUP BY 1
    """,
    "stream_triage": f"WITH {S}, {AUDIT} SELECT event_id, time_to_tca, sequence_number, eligible_history_count, reason, decision FROM ad",
    "parse_kvn": _READ,
    "parse_ndjson": _READ,
    "delivered_once": f"""
        SELECT record_no, source_message_id, event_id, collection_batch FROM (
            SELECT *, {usable_sql('source_message_id')} AS k, min(record_no) OVER (PARTITION BY {usable_sql('source_message_id')}) AS kept FROM external_collection
        ) WHERE k IS NULL OR record_no = kept
    """,
}
