"""Registered queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skysieve.llm import bpe, history, langid, packing, sample, splits
from skysieve.plans.core_queries import usable_sql
from skysieve.plans.tables import table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.repeated_messages(table(spark, sf_dir, "external_collection"), table(spark, sf_dir, "object_alias"))


def p2_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sample.stable_sample(table(spark, sf_dir, "external_collection"), table(spark, sf_dir, "sample_plan"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    members, _ = splits.related_groups(table(spark, sf_dir, "external_collection"), table(spark, sf_dir, "object_alias"))
    return members.filter("event <> group_id").select(F.col("group_id").alias("first_event_id"), F.col("event").alias("other_event_id"))


def p4_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.split_records(
        table(spark, sf_dir, "external_collection"), table(spark, sf_dir, "history_gate_diagnostics"), table(spark, sf_dir, "split_plan"), table(spark, sf_dir, "object_alias"),
    )


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_corpus(table(spark, sf_dir, "documents"))


def p7_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_texts(table(spark, sf_dir, "documents"), table(spark, sf_dir, "container_spec"))


def _languages(spark: SparkSession, sf_dir: str, every: bool = False) -> DataFrame:
    return langid.document_languages(table(spark, sf_dir, "documents"), table(spark, sf_dir, "lang_samples"), table(spark, sf_dir, "language_codes"), every)


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _languages(spark, sf_dir).filter("relabelled").select("doc_id", "line_no", "lang_code")


def p8_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _languages(spark, sf_dir, every=True).drop("relabelled")


QUERIES = {
    "p1_found": p1_found, "p2_sample": p2_sample, "p4_found": p4_found, "p4_split": p4_split, "p6_ids": p6_ids, "p7_pack": p7_pack,
    "p8_found": p8_found, "p8_languages": p8_languages,
}

_EVENT = f"""
    CASE WHEN regexp_matches(lower({usable_sql('event_id')}), '^(ext[-_ ]?)?[0-9a-f]{{24}}$')
         THEN 'ext-' || right(lower({usable_sql('event_id')}), 24) ELSE lower({usable_sql('event_id')}) END
"""
_COHORT = f"""
    CASE WHEN length({usable_sql('study_cohort')}) >= 4 AND starts_with('calibration', lower({usable_sql('study_cohort')})) THEN 'calibration'
         WHEN length({usable_sql('study_cohort')}) >= 4 AND starts_with('evaluation', lower({usable_sql('study_cohort')})) THEN 'evaluation' END
"""


def _designator_sql(part: int) -> str:
    given = usable_sql(f"split_part(event_pair, chr(124), {part})")
    return f"coalesce((SELECT min({usable_sql('designator')}) FROM object_alias WHERE {usable_sql('alias_designator')} = {given}), CASE WHEN regexp_matches({given}, '[0-9]') THEN {given} END)"


#: Records with canonical event, identifier and pair; null where unusable.
_KEYED = f"""
    d AS (SELECT *, {_EVENT} AS event, {usable_sql('source_message_id')} AS k, {_designator_sql(1)} AS d1, {_designator_sql(2)} AS d2 FROM external_collection),
    r AS (SELECT *, CASE WHEN d1 IS NOT NULL AND d2 IS NOT NULL AND len(string_split(event_pair, chr(124))) = 2 THEN least(d1, d2) || '|' || greatest(d1, d2) END AS pair FROM d)
"""
_SAME = " AND ".join(f"(coalesce(isnan(a.{x}) OR isnan(b.{x}), true) OR a.{x} = b.{x} OR abs(a.{x} - b.{x}) <= 0.001::DOUBLE * greatest(abs(a.{x}), abs(b.{x})))" for x in history.READINGS)

SQL = {
    "p1_found": f"""
        WITH RECURSIVE {_KEYED}, t AS (SELECT *, epoch_us(creation_date::TIMESTAMPTZ) AS c_us, epoch_us(tca::TIMESTAMPTZ) AS t_us FROM r),
        link AS (
            SELECT record_no AS u, min(record_no) OVER (PARTITION BY k) AS v FROM t WHERE k IS NOT NULL
            UNION SELECT a.record_no, b.record_no FROM t a JOIN t b ON a.pair = b.pair AND a.record_no > b.record_no AND abs(a.c_us - b.c_us) <= 60000000 AND abs(a.t_us - b.t_us) <= 5000000 WHERE {_SAME}
        ), pair_of AS (SELECT u, v FROM link WHERE u <> v UNION SELECT v, u FROM link WHERE u <> v),
        reach(u, v) AS (SELECT u, v FROM pair_of UNION SELECT reach.u, pair_of.v FROM reach JOIN pair_of ON reach.v = pair_of.u),
        root AS (SELECT u, least(u, min(v)) AS first_no FROM reach GROUP BY u)
        SELECT root.first_no AS first_record_no, root.u AS repeat_record_no FROM root JOIN t a ON a.record_no = root.u JOIN t b ON b.record_no = root.first_no WHERE coalesce(a.collection_batch, 0) > coalesce(b.collection_batch, 0)
    """,
    "p4_found": f"""
        WITH RECURSIVE {_KEYED}, uses AS (SELECT DISTINCT 'p' || pair AS key, event FROM r WHERE pair IS NOT NULL AND event IS NOT NULL UNION SELECT 'm' || k, event FROM r WHERE k IS NOT NULL AND event IS NOT NULL),
        link AS (SELECT event AS u, min(event) OVER (PARTITION BY key) AS v FROM uses), pair_of AS (SELECT u, v FROM link WHERE u <> v UNION SELECT v, u FROM link WHERE u <> v),
        reach(u, v) AS (SELECT u, v FROM pair_of UNION SELECT reach.u, pair_of.v FROM reach JOIN pair_of ON reach.v = pair_of.u)
        SELECT min(v) AS first_event_id, u AS other_event_id FROM reach GROUP BY u HAVING min(v) < u
    """,
    "p2_sample": f"""
        WITH r AS (
            SELECT {_EVENT} AS event_id, {_COHORT} AS cohort, record_no, coalesce(collection_batch, 0) AS batch FROM external_collection
        ), f AS (
            SELECT event_id, min(batch) AS first_batch FROM r WHERE event_id IS NOT NULL GROUP BY 1
        ), e AS (
            SELECT f.event_id, f.first_batch, min_by(r.cohort, r.record_no) FILTER (WHERE r.cohort IS NOT NULL) AS study_cohort
            FROM f JOIN r ON r.event_id = f.event_id AND r.batch = f.first_batch GROUP BY 1, 2
        ), u AS (
            SELECT *, CAST(('0x' || substr(sha256('permanent-1:' || event_id), 1, 13))::UBIGINT AS DOUBLE) / 4503599627370496.0 AS uniform_value FROM e
        )
        SELECT u.event_id, u.study_cohort, u.uniform_value, u.first_batch
        FROM u JOIN sample_plan p ON u.study_cohort IS NOT DISTINCT FROM p.study_cohort
        WHERE u.uniform_value < p.target_pct / 100.0
    """,
}
