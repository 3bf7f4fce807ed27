"""The stream gives what the batch gives, across restarts, and sets late updates apart."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from skysieve.plans import more_queries
from skysieve.plans.reference_queries import _scored
from skysieve.streaming import triage

POLICY = triage.TriagePolicy(0.05, 2, 2.5, 6.5, 0.9)
SCHEMA = "event_id string, time_to_tca double, score double, risk double"


def test_stream_and_batch_agree_over_a_restart(spark, sf_dir, tmp_path):
    rows = _scored(spark, sf_dir).select("event_id", "time_to_tca", "score", "risk").cache()
    source, audit, state = str(tmp_path / "in"), str(tmp_path / "audit"), str(tmp_path / "state")
    stream = lambda: spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source)
    gate = F.col("risk") < -8
    for low, high in ((4.0, 9.0), (0.0, 4.0)):
        rows.filter((F.col("time_to_tca") >= low) & (F.col("time_to_tca") < high)).coalesce(1).write.mode("append").parquet(source)
        triage.replay(stream(), POLICY, audit, state, gate).awaitTermination()
    got = spark.read.parquet(audit)
    columns = ["event_id", "time_to_tca", "sequence_number", "eligible_history_count", "reason", "decision", "shift_gate_allowed"]
    want = triage.batch_audit(rows, POLICY, gate).select(*columns)
    assert got.filter("late").count() == 0 and got.count() == rows.count()
    assert got.select(*columns).exceptAll(want).count() == 0
    assert triage.audit_faults(got.drop("late"), POLICY).count() == 0


@pytest.mark.parametrize("on_late", ["quarantine", "fail"])
def test_late_updates(spark, tmp_path, on_late):
    source = str(tmp_path / "in")
    schema = "event_id string, time_to_tca double, score double"
    for part in ([("a", 6.0, 0.5), ("a", 5.0, 0.5), ("b", 6.0, 0.01)], [("a", 5.0, 0.1), ("a", 4.0, 0.01), ("b", 7.0, 0.5)]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(source)
        query = triage.replay(spark.readStream.schema(schema).parquet(source), POLICY, str(tmp_path / "audit"), str(tmp_path / "state"), on_late=on_late)
        if on_late == "fail" and part[0][1] == 5.0:
            with pytest.raises(Exception, match="decreasing"):
                query.awaitTermination()
        else:
            query.awaitTermination()
    rows = spark.read.parquet(str(tmp_path / "audit"))
    if on_late == "fail":
        assert rows.count() == 3
    else:
        assert {(r["event_id"], r["time_to_tca"]) for r in rows.filter("late").collect()} == {("a", 5.0), ("b", 7.0)} or rows.filter("late").count() == 2
        last = rows.filter("event_id = 'a' and time_to_tca = 4.0").first()
        assert (last["sequence_number"], last["decision"]) == (3, "SAFE-EXCLUDE")


@pytest.mark.parametrize(("limit", "rows_per_chunk"), [(500_000, 2), (3, 2), (500_000, 10_000)])
def test_chunks_and_order_of_a_micro_batch_change_nothing(spark, tmp_path, limit, rows_per_chunk):
    r = random.Random(7)
    rows = [(f"e{e}", 8.0 - k * 0.25 - e * 0.01, r.random(), r.choice([-9.0, -7.0])) for e in range(9) for k in range(2 + 3 * e)]
    expected = triage.batch_audit(spark.createDataFrame(rows, SCHEMA), POLICY, F.col("risk") < -8)
    columns = ["event_id", "time_to_tca", "sequence_number", "eligible_history_count", "reason", "decision"]
    first, second = [x for x in rows if x[1] >= 4.0], [x for x in rows if x[1] < 4.0] + [("e3", 7.0, 0.5, -9.0)]
    source, audit, state = str(tmp_path / "in"), str(tmp_path / "audit"), str(tmp_path / "state")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows_per_chunk)
    try:
        for part in (first, second):
            spark.createDataFrame(r.sample(part, len(part)), SCHEMA).coalesce(1).write.mode("append").parquet(source)
            more = {} if limit == 500_000 else {"limit": limit}
            triage.replay(spark.readStream.schema(SCHEMA).parquet(source), POLICY, audit, state, F.col("risk") < -8, **more).awaitTermination()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    got = spark.read.parquet(audit)
    assert [(x["event_id"], x["time_to_tca"], x["decision"]) for x in got.filter("late").collect()] == [("e3", 7.0, None)]
    assert sorted(map(tuple, got.filter("not late").select(*columns).collect())) == sorted(map(tuple, expected.select(*columns).collect()))


def test_counters_pass_from_one_whole_table_to_the_next(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(triage, "SNAPSHOT_EVERY", 2)
    source, audit, state = str(tmp_path / "in"), str(tmp_path / "audit"), str(tmp_path / "state")
    for day in (6.0, 5.0, 4.0, 3.0, 2.6):
        spark.createDataFrame([("a", day, 0.5, -9.0)] + [("b", 6.0, 0.5, -9.0)] * (day in (6.0, 2.6)), SCHEMA).coalesce(1).write.mode("append").parquet(source)
        triage.replay(spark.readStream.schema(SCHEMA).parquet(source), POLICY, audit, state).awaitTermination()
    rows = spark.read.parquet(audit).collect()
    assert sorted((r["time_to_tca"], r["sequence_number"], r["eligible_history_count"]) for r in rows if r["event_id"] == "a") == [(2.6, 5, 5), (3.0, 4, 4), (4.0, 3, 3), (5.0, 2, 2), (6.0, 1, 1)]
    assert sorted(((r["late"], r["sequence_number"]) for r in rows if r["event_id"] == "b"), key=str) == [(False, 1), (True, None)] and sum(r["late"] for r in rows) == 1


def test_deliveries_are_written_by_several_tasks(spark, sf_dir, tmp_path, monkeypatch):
    monkeypatch.setattr(more_queries, "scratch_path", lambda spark, name: str(tmp_path / name))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = more_queries.stream_triage(spark, sf_dir).count()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == _scored(spark, sf_dir).count()
    assert len(list((tmp_path / "stream/updates").glob("*.parquet"))) > 8 and len(list((tmp_path / "stream/audit").glob("batch_id=*"))) == 4
