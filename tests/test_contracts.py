from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from skysieve.functions.checks import ConstraintError
from skysieve.operators import contracts, model
from skysieve.streaming import triage

ROWS = "event_id string, time_to_tca double, score double, fold int, model string"
POLICY = triage.TriagePolicy(0.05, 2, 2.5, 6.5, 0.9)


def rows(spark, data):
    return spark.createDataFrame(data, ROWS)


def test_stream_faults_and_readiness(spark):
    good = [("a", 6.0, 0.5, 0, "m"), ("a", 5.0, 0.0, 0, "m"), ("b", 5.0, 1.0, 1, "m")]
    bad = [(None, 5.0, 0.5, 0, "m"), ("c", -1.0, 0.5, 0, "m"), ("c", None, 0.5, 0, "m"), ("d", float("nan"), float("inf"), 0, "m"), ("e", 1.0, 1.5, 0, None), ("a", 6.0, 0.4, 0, "n"), ("f", 1.0, None, 0, "m")]
    known = spark.createDataFrame([("b",), ("b",), (None,)], "event_id string")
    found = {r["rule"]: r["violations"] for r in contracts.stream_faults(rows(spark, good + bad), calibration=known, one_valued=("model",), expected={"model": "m"}).collect()}
    assert found == {"event_missing": 1, "time_invalid": 3, "score_not_finite": 2, "score_out_of_range": 1, "model_unexpected": 2, "model_missing": 1, "model_differs": 1, "repeated_update": 1, "calibration_event": 1}
    assert contracts.replay_ready(rows(spark, good), one_valued=("model",), expected={"model": "m"}).count() == 3
    for data, settings in ((good + bad[:1], {}), ([], {}), (good, {"expected": {"model": "x"}}), (good, {"calibration": known})):
        with pytest.raises(ConstraintError):
            contracts.replay_ready(rows(spark, data), **settings)


def test_labels_must_fit_the_roster(spark):
    scored = rows(spark, [("a", 6.0, 0.5, 0, "m"), ("a", 5.0, 0.5, 0, "m"), ("b", 5.0, 0.5, 1, "m")])
    label = lambda *pairs: spark.createDataFrame(pairs, "event_id string, y int")
    assert {(r["event_id"], r["y"]) for r in contracts.labelled(scored, label(("a", 1), ("a", 1), ("b", 0))).collect()} == {("a", 1), ("b", 0)}
    faults = {(r["event_id"], r["fault"]) for r in contracts.roster_faults(scored, label(("a", 1), ("a", 0), ("c", 0), ("d", 7), (None, 1))).collect()}
    assert faults == {("a", "conflict"), ("b", "unlabelled"), ("c", "unscored"), ("d", "unscored")}
    for labels in (label(("a", 1)), label(("a", 1), ("b", None)), label(("a", 1), ("b", 0), ("c", 0))):
        with pytest.raises(ConstraintError):
            contracts.labelled(scored, labels)
    with pytest.raises(ConstraintError):
        contracts.labelled(scored.withColumn("y", F.lit(1)), label(("a", 1), ("b", 0)))


def test_one_value_and_folds(spark):
    df = rows(spark, [("a", 6.0, 0.5, 0, "m"), ("a", 5.0, 0.5, 1, None), ("b", 5.0, 0.5, 1, "m"), (None, 1.0, 0.1, 3, "x")])
    assert [tuple(r) for r in contracts.one_value_conflicts(df, ("fold", "model")).collect()] == [("a", "fold", 2)]
    with pytest.raises(ConstraintError):
        contracts.enough_folds(df)
    assert contracts.enough_folds(df, 3).count() == 4


@pytest.fixture(scope="module")
def audit(spark):
    updates = rows(spark, [(e, float(t), 0.01 if e == "a" else 0.95, 0, "m") for e in ("a", "b", "c") for t in (6, 5, 4)]).select("event_id", "time_to_tca", "score", F.lit(True).alias("gate_allowed"))
    return updates, triage.batch_audit(updates, POLICY, F.col("gate_allowed")).withColumn("batch_id", (7 - F.col("time_to_tca")).cast("int"))


def test_removed_added_and_forged_audit_rows(audit):
    updates, log = audit
    assert triage.audit_faults(log, POLICY, updates).count() == 0 == triage.audit_faults(log, POLICY).count()
    wrong = log.filter("event_id <> 'b' and not (event_id = 'a' and time_to_tca = 4)").withColumn("decision", F.when(F.col("time_to_tca") == 6, "ESCALATE").otherwise(F.col("decision")))
    wrong = wrong.unionByName(log.filter("event_id = 'c' and time_to_tca = 5").withColumn("event_id", F.lit("z"))).unionByName(log.filter("event_id = 'c' and time_to_tca = 5"))
    found = {(r["event_id"], r["time_to_tca"], r["fault"]) for r in triage.audit_faults(wrong, POLICY, updates).collect()}
    assert found == {("a", 6.0, "differs"), ("a", 4.0, "missing"), ("b", 6.0, "missing"), ("b", 5.0, "missing"), ("b", 4.0, "missing"), ("z", 5.0, "unknown"), ("c", 5.0, "repeated")}
    assert {r["event_id"] for r in triage.audit_faults(log.filter("time_to_tca < 6"), POLICY).collect()} == {"a", "b", "c"}


def test_checkpoint_round_trip_and_tampering(spark, audit, tmp_path):
    _, log = audit
    path = f"file://{tmp_path}/checkpoint"
    triage.export_checkpoint(log, path)
    assert triage.checkpoint_faults(spark, path).count() == 0
    state = spark.read.parquet(f"{path}/counters")
    assert {tuple(r) for r in state.collect()} == {(e, 3, 3, 4.0) for e in "abc"}
    assert triage.without_events(state, spark.createDataFrame([("a",)], "event_id string")).count() == 2
    moved = f"file://{tmp_path}/moved"
    for part in ("counters", "audit", "chain"):
        df = spark.read.parquet(f"{path}/{part}")
        if part == "audit":
            df = df.withColumn("decision", F.when((F.col("event_id") == "a") & (F.col("batch_id") == 2), "MONITOR").otherwise(F.col("decision")))
        if part == "counters":
            df = df.withColumn("sequence_number", F.when(F.col("event_id") == "b", 4).otherwise(F.col("sequence_number")))
        df.write.parquet(f"{moved}/{part}")
    assert {tuple(r) for r in triage.checkpoint_faults(spark, moved).collect()} == {("delivery", "2"), ("event", "b")}


def test_invalid_updates_stop_a_replay(spark, tmp_path):
    source, schema = str(tmp_path / "in"), "event_id string, time_to_tca double, score double"
    spark.createDataFrame([("a", 6.0, 0.5), ("a", 5.0, None)], schema).write.parquet(source)
    query = triage.replay(spark.readStream.schema(schema).parquet(source), POLICY, str(tmp_path / "audit"), str(tmp_path / "state"), on_invalid="fail")
    with pytest.raises(Exception, match="score_not_finite"):
        query.awaitTermination()


def test_feature_contract_and_tail_aligned_fit(spark):
    columns = ("a", "b")
    with pytest.raises(ConstraintError):
        model.ml_scorer(columns, contract=model.feature_contract(("b", "a")))
    with pytest.raises(ConstraintError):
        model.feature_contract(("a", "a"))
    data = [(i, f"e{i // 4}", float(4 - i % 4), (i // 4) % 2, (i // 4) % 3, float(i % 4 + 3 * ((i // 4) % 2)), None if i % 7 == 0 else float(i % 5)) for i in range(96)]
    df = spark.createDataFrame(data, "diag_no bigint, event_id string, time_to_tca double, y int, fold int, a double, b double")
    out = model.out_of_fold(df, model.tail_aligned_scorer(columns, iterations=3)).join(df.select("diag_no", "y"), "diag_no").groupBy("y").agg(F.count("*").alias("n"), F.avg("score").alias("s")).collect()
    mean = {r["y"]: r["s"] for r in out}
    assert sum(r["n"] for r in out) == 96 and mean[1] > mean[0] + 0.2
