from __future__ import annotations

import pytest

from skysieve.functions.checks import ConstraintError
from skysieve.operators.collection import Collection

ROWS = "record_no bigint, event_pair string, source_message_id string, tca timestamp, v double"


def delivery(spark, rows):
    return spark.createDataFrame([(n, p, m, None, v) for n, p, m, _, v in rows], ROWS).drop("tca").join(
        spark.createDataFrame([(n, t) for n, _, _, t, _ in rows], "record_no bigint, t string"), "record_no"
    ).selectExpr("record_no", "event_pair", "source_message_id", "cast(t as timestamp) as tca", "v")


def test_appending_twice_and_verifying(spark, tmp_path):
    c = Collection(spark, f"file://{tmp_path}/c", ("v",))
    first = [(1, "p", "a", "2031-01-01 00:00:00", 1.0), (2, "p", "b", "2031-01-01 00:20:00", 2.0), (3, "p", "A ", "2031-01-01 00:00:00", 1.0), (4, "q", None, "2031-01-01 00:00:00", 1.0), (5, None, "x", "2031-01-01 00:00:00", 1.0)]
    assert c.append(delivery(spark, first)) == {"new": 3, "duplicate": 1, "conflict": 0, "unplaceable": 1}
    second = [(6, "p", "a", "2031-01-01 00:00:00", 1.0), (7, "p", "c", "2031-01-01 00:45:00", 3.0), (8, "p", "d", "2031-01-02 00:00:00", 3.0)]
    assert c.append(delivery(spark, second)) == {"new": 2, "duplicate": 1, "conflict": 0, "unplaceable": 0}
    events = {r["record_no"]: r["event_id"] for r in c.messages().collect()}
    assert events[1] == events[2] == events[7] != events[8] and events[4] not in (events[1], events[8])
    cohorts = {r["event_id"]: r["study_cohort"] for r in c.messages().collect()}
    assert set(cohorts.values()) <= {"calibration", "evaluation"}
    assert c.verify() == []
    with pytest.raises(ConstraintError, match="other content"):
        c.append(delivery(spark, [(9, "p", "b", "2031-01-01 00:20:00", 9.0)]))
    assert c.append(delivery(spark, [(9, "p", "b", "2031-01-01 00:20:00", 9.0)]), "keep_first") == {"new": 0, "duplicate": 0, "conflict": 1, "unplaceable": 0}
    c.batch(2).filter("record_no <> 8").coalesce(1).write.parquet(f"file://{tmp_path}/forged")
    for old in (tmp_path / "c/messages/collection_batch=2").glob("*.parquet"):
        old.rename(tmp_path / old.name)
    for new in (tmp_path / "forged").glob("*.parquet"):
        new.rename(tmp_path / "c/messages/collection_batch=2" / new.name)
    for crc in (tmp_path / "c/messages/collection_batch=2").glob(".*.crc"):
        crc.rename(tmp_path / crc.name)
    assert c.verify() == [2]
