"""Hand-made cases of calibration, features, gate, triage and readers."""

from __future__ import annotations


import pytest
from pyspark.sql import functions as F

from skysieve.functions.checks import ConstraintError, expect, outcome_blind
from skysieve.operators import calibrate, experiments, features, gate, messages, review
from skysieve.operators.ranking import ranked_within
from skysieve.operators.sessions import persistent_events
from skysieve.sources import cdm
from skysieve.streaming import triage

INF = float("inf")


def test_ranks_across_ranges(spark):
    df = spark.range(5000).selectExpr("id", "id % 3 as g", "hash(id) as h")
    out = ranked_within(df, ("g",), ("h", "id"), "r", "n").toPandas()
    for _, part in out.groupby("g"):
        assert list(part.sort_values(["h", "id"])["r"]) == list(range(1, len(part) + 1)) and set(part["n"]) == {len(part)}


def test_strict_threshold_ties_and_rank_zero(spark):
    events = spark.createDataFrame([(str(i), 1, 0.5) for i in range(9)] + [("x", 1, INF), ("n", 0, 0.1)], "event_id string, y int, min_score double")
    row = calibrate.thresholds(events, (), 0.2).first()
    assert (row["n_positive"], row["rank"], row["bound"]) == (10, 2, 0.5)
    assert calibrate.evaluate_threshold(events, row["bound"], None).first()["danger"] == 0
    assert calibrate.thresholds(events, (), 0.01).first()["bound"] is None


def test_events_stay_in_the_denominator(spark):
    rows = spark.createDataFrame([("a", 6.0, 0, 0.1, 1), ("b", 5.0, 1, 0.2, 1), ("b", 4.0, 1, 0.05, 2)], "event_id string, time_to_tca double, y int, score double, eligible_history_count int")
    got = {r["event_id"]: r["min_score"] for r in calibrate.history_gated_events(rows, 2).collect()}
    assert got == {"a": INF, "b": 0.05}
    first = {r["event_id"]: r for r in calibrate.first_safe(rows, F.lit(0.15), 1).collect()}
    assert first["b"]["first_safe_tca"] == 4.0 and first["a"]["safe_exclude"]
    none = calibrate.first_safe(rows, F.lit(None).cast("double"), 1)
    assert none.filter("safe_exclude").count() == 0


def test_prefix_features_first_value_and_nulls(spark):
    df = spark.createDataFrame([("e", 9.0, None), ("e", 8.0, 2.0), ("e", 7.0, None), ("e", 6.0, 1.0)], "event_id string, time_to_tca double, risk double")
    loose = features.prefix_features(df, ("risk",)).orderBy(F.desc("time_to_tca")).collect()
    assert [r["risk_first"] for r in loose] == [2.0] * 4 and [r["risk_min_so_far"] for r in loose] == [None, 2.0, None, 1.0] and [r["risk_delta_prev"] for r in loose] == [None] * 4
    strict = features.prefix_features(df, ("risk",), strict=True).orderBy(F.desc("time_to_tca")).collect()
    assert [r["risk_first"] for r in strict] == [None, 2.0, 2.0, 2.0]
    later = features.prefix_features(df.filter("time_to_tca >= 7"), ("risk",), strict=True).orderBy(F.desc("time_to_tca")).collect()
    assert [r.asDict() for r in later] != [] and [r["risk_first"] for r in later] == [r["risk_first"] for r in strict[:3]]


def test_label_modes(spark):
    df = spark.createDataFrame([("a", 3.0, -1.0), ("a", 1.0, None), ("b", 2.0, -5.0), ("c", 2.0, None)], "event_id string, time_to_tca double, risk double")
    modes = {m: {r["event_id"]: r["y"] for r in features.event_labels(df, m).collect()} for m in ("literal", "literal_drop_null", "first_finite")}
    assert modes == {"literal": {"a": 0, "b": 1, "c": 0}, "literal_drop_null": {"b": 1}, "first_finite": {"a": 1, "b": 1}}


def test_tail_weights(spark):
    df = spark.createDataFrame([("a", float(i), 1, i / 10) for i in range(4)] + [("b", 1.0, 0, 0.1), ("b", 2.0, 0, 0.2), ("c", 1.0, 1, 0.1)], "event_id string, time_to_tca double, y int, score double")
    rows = features.tail_weights(df).collect()
    weights = {(r["event_id"], r["time_to_tca"]): round(r["weight"], 12) for r in rows}
    assert weights == {("a", 0.0): 0.625, ("a", 1.0): 0.125, ("a", 2.0): 0.125, ("a", 3.0): 0.125, ("b", 1.0): 0.5, ("b", 2.0): 0.5, ("c", 1.0): 1.0}
    whole = features.tail_weights(df, hard_fraction=1.0).groupBy("event_id").agg(F.sum("weight").alias("w")).collect()
    assert all(r["w"] == pytest.approx(1.0) for r in whole)
    assert {round(r["weight"], 12) for r in features.event_weights(df).collect()} == {0.25, 0.5, 1.0}


def test_repeats_halve_each_class(spark):
    rows = [("m", f"e{i}", int(i % 10 < 3), 3, i / 50) for i in range(50)]
    df = spark.createDataFrame(rows, "method string, event_id string, y int, eligible_history_count int, score double")
    out = experiments.repeated_stability(df, 6).collect()
    assert len(out) == 6 and all((r["n_positive"], r["n_negative"]) == (8, 18) for r in out)  # 15 and 35 events, the larger halves


def test_gate_round_trip_and_missing_features(spark, tmp_path):
    df = spark.createDataFrame([(str(i), float(i), float(i % 7)) for i in range(40)] + [("x", None, 1.0)], "event_id string, risk double, miss_distance double")
    g = gate.ShiftGate(("risk", "miss_distance"), 0.05).fit(df).calibrate(df.filter("risk is not null"))
    g.save(str(tmp_path / "gate.json"))
    again = gate.ShiftGate.load(str(tmp_path / "gate.json"))
    assert again == g and again.fingerprint() == g.fingerprint()
    blocked = df.filter(~again.allows())
    assert [r["event_id"] for r in blocked.collect()] == ["x"]
    g.threshold = INF
    assert df.filter(~g.allows()).count() == 1
    text = (tmp_path / "gate.json").read_text().replace('"alpha": 0.05', '"alpha": 0.06')
    (tmp_path / "gate.json").write_text(text)
    with pytest.raises(ValueError):
        gate.ShiftGate.load(str(tmp_path / "gate.json"))
    with pytest.raises(ValueError):
        gate.ShiftGate(("risk", "risk"))


def test_constraints(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 1.0), (None, -1.0)], "event_id string, time_to_tca double")
    with pytest.raises(ConstraintError, match="missing id: 1 of 3 rows; early: 1 of 3 rows; event_id, time_to_tca: repeated"):
        expect(df, {"missing id": F.col("event_id").isNotNull(), "early": F.col("time_to_tca") >= 0}, ("event_id", "time_to_tca"))
    with pytest.raises(ConstraintError):
        outcome_blind(df.withColumn("final_risk", F.lit(1)))
    assert outcome_blind(df) is df


def test_tolerance_of_clusters(spark):
    df = spark.sql("select * from values (1, 'p', timestamp'2031-01-01 00:00:00'), (2, 'p', timestamp'2031-01-01 00:30:00'), (3, 'p', timestamp'2031-01-01 01:00:01') as t(cdm_no, event_pair, tca)")
    assert [r["cluster_no"] for r in messages.tca_clusters(df).orderBy("cdm_no").collect()] == [0, 0, 1]


def test_persistent_events_compare_with_ends_and_reject_ambiguity(spark):
    m = spark.sql("select * from values ('p', 'm1', timestamp'2031-01-01 00:50:00', 1), ('p', 'm2', timestamp'2031-01-01 05:00:00', 2), ('p', 'm3', timestamp'2031-01-01 05:20:00', 3), ('p', 'm4', timestamp'2031-01-01 09:00:00', 4) as t(event_pair, message_id, tca, order_no)")
    known = spark.sql("select * from values ('k1', 'p', timestamp'2031-01-01 00:00:00', timestamp'2031-01-01 02:00:00'), ('k2', 'p', timestamp'2031-01-01 08:40:00', timestamp'2031-01-01 08:50:00'), ('k3', 'p', timestamp'2031-01-01 09:10:00', timestamp'2031-01-01 09:20:00') as t(event_id, event_pair, tca_min, tca_max)")
    got = {r["message_id"]: (r["event_id"], r["ambiguous"]) for r in persistent_events(m, known).collect()}
    assert got["m1"][0].startswith("ext-") and got["m2"][0] == got["m3"][0] != got["m1"][0] and got["m4"] == (None, True)


KVN = """CCSDS_CDM_VERS = 1.0
COMMENT nothing
CREATION_DATE = 2031-01-01T00:00:00
MESSAGE_ID = m-1
TCA = 2031-01-03T12:00:00
MISS_DISTANCE = 715 [m]
RELATIVE_SPEED = 14762 [m/s]
COLLISION_PROBABILITY = 0.001
RELATIVE_POSITION_R = 3
RELATIVE_POSITION_T = 0
RELATIVE_POSITION_N = 4
OBJECT = OBJECT1
OBJECT_DESIGNATOR = ALDER-1
CR_R = 1 [m**2]
CT_R = 0 [m**2]
CT_T = 1 [m**2]
CN_R = 0 [m**2]
CN_T = 0 [m**2]
CN_N = 1 [m**2]
OBJECT = OBJECT2
OBJECT_DESIGNATOR = 90001
CR_R = 0 [m**2]
CT_R = 0 [m**2]
CT_T = 0 [m**2]
CN_R = 0 [m**2]
CN_T = 0 [m**2]
CN_N = 0 [m**2]
"""


def test_kvn_to_message(spark, tmp_path):
    (tmp_path / "a.kvn").write_text(KVN + KVN.replace("m-1", "m-2"))
    rows = cdm.adapt(cdm.read_kvn(spark, str(tmp_path))).orderBy("source_message_id").collect()
    assert [r["source_message_id"] for r in rows] == ["m-1", "m-2"]
    r = rows[0]
    assert (r["event_pair"], r["time_to_tca"], r["miss_distance"], r["relative_speed"], r["mission_id"]) == ("90001|ALDER-1", 2.5, 715.0, 14762.0, "ALDER-1")
    assert r["risk"] == pytest.approx(-3.0) and r["mahalanobis_distance"] == pytest.approx(5.0) and r["t_position_covariance_det"] == 1.0 and r["c_position_covariance_det"] is None


@pytest.mark.parametrize("text", ["X", "= 1", "A =", "A = 1", KVN + "TCA = 2031\nTCA = 2031\n", KVN + "OBJECT = OBJECT3\n"])
def test_kvn_errors(text):
    with pytest.raises(ValueError):
        cdm.kvn_documents(text)


def test_json_forms_and_units(spark, tmp_path):
    one = '{"creation_date": "2031-01-01T00:00:00Z", "TCA": "2031-01-02T00:00:00Z", "Miss_Distance": "5", "miss_distance_unit": "%s"}'
    (tmp_path / "a.json").write_text(f"[{one % 'm'}, {one % ''}]")
    (tmp_path / "b.ndjson").write_text(one % "metre" + "\n\n" + one % "m" + "\n")
    assert cdm.adapt(cdm.read_json(spark, str(tmp_path / "a.json"))).filter("miss_distance = 5 and time_to_tca = 1").count() == 2
    assert cdm.adapt(cdm.read_ndjson(spark, str(tmp_path / "b.ndjson"))).filter("miss_distance = 5").count() == 2
    (tmp_path / "c.json").write_text(one % "km")
    with pytest.raises(Exception, match="unexpected unit"):
        cdm.adapt(cdm.read_json(spark, str(tmp_path / "c.json"))).collect()


def test_singular_covariance_by_pseudo_inverse(spark):
    df = spark.createDataFrame([(3.0, 4.0, 0.0)], "r double, t double, n double")
    one, zero = F.lit(1.0), F.lit(0.0)
    d = messages.mahalanobis((F.col("r"), F.col("t"), F.col("n")), (one, zero, one, zero, zero, zero), (zero,) * 6, F.lit(None).cast("double"))
    assert df.select(d.alias("d")).first()["d"] == pytest.approx(5.0)


def test_decision_order(spark):
    policy = triage.TriagePolicy(0.2, 2, 2.0, 7.0, 0.9)
    data = [(8.0, 0.95, 0, True), (8.0, 0.1, 0, True), (1.0, 0.1, 3, True), (5.0, 0.1, 1, True), (5.0, 0.1, 2, False), (5.0, 0.1, 2, True), (5.0, 0.2, 2, True), (2.0, 0.1, 2, True), (7.0, 0.1, 2, True)]
    df = spark.createDataFrame(data, "time_to_tca double, score double, eligible_history_count int, ok boolean")
    assert [r["reason"] for r in triage.decided(df, policy, F.col("ok")).collect()] == [triage.ESCALATED, triage.NOT_OPEN, triage.CLOSED, triage.SHORT_HISTORY, triage.GATE_BLOCKED, triage.SAFE, triage.BETWEEN, triage.SAFE, triage.SAFE]


def test_pareto_and_paired(spark):
    df = spark.createDataFrame([("a", 1, 5), ("b", 1, 6), ("c", 2, 6), ("d", 0, 1), ("e", 1, 6)], "method string, danger int, safe_negative int")
    assert {r["method"] for r in experiments.pareto_frontier(df).filter("on_frontier").collect()} == {"b", "d", "e"}


def test_delivery_classes_and_chain(spark):
    df = spark.createDataFrame([(1, "a", 1.0), (2, "A", 1.0), (3, "a", 2.0), (4, None, 1.0), (5, "b", None), (6, "b", None)], "record_no bigint, source_message_id string, v double")
    assert {r[0]: r[1] for r in review.delivery_classes(df, ("v",)).collect()} == {1: "new", 2: "duplicate", 3: "conflict", 4: "unidentified", 5: "new", 6: "duplicate"}
    chain = review.chained(spark.createDataFrame([(1, "x"), (2, None), (3, "z")], "n int, c string"), "n", ("c",))
    assert review.chain_breaks(chain, "n", ("c",)).count() == 0
    assert [r["n"] for r in review.chain_breaks(chain.filter("n <> 2"), "n", ("c",)).collect()] == [3]
    assert [r["n"] for r in review.chain_breaks(chain.withColumn("c", F.when(F.col("n") == 2, "w").otherwise(F.col("c"))), "n", ("c",)).collect()] == [2]


def test_log_probability(spark):
    df = spark.createDataFrame([(0.01,), (0.0,), (-1.0,), (None,), (INF,)], "p double")
    assert [r[0] for r in df.select(messages.log_probability(F.col("p"))).collect()] == [pytest.approx(-2.0), None, None, None, None]


@pytest.mark.parametrize("strict", [False, True])
def test_large_events_are_spread_without_a_difference(spark, strict):
    rows = spark.range(1500).selectExpr(
        "concat('e', id % 3 * id % 2) as event_id", "cast(id as double) / 200 as time_to_tca", "if(pmod(hash(id), 5) < 2, null, pmod(hash(id), 97) / 7.0) as risk", "pmod(hash(id, 1), 100) / 100.0 as score",
    )
    for f in (
        lambda limit: features.prefix_features(rows, ("risk",), strict, limit), lambda limit: features.eligible_prefixes(rows, limit=limit),
        lambda limit: triage.batch_audit(rows, triage.TriagePolicy(0.2, 2, 2.0, 5.0, 0.9), limit=limit),
    ):
        usual, spread = f(10**9), f(100)
        columns = sorted(usual.columns)
        assert sorted(spread.columns) == columns
        assert sorted(map(str, usual.select(columns).collect())) == sorted(map(str, spread.select(columns).collect()))
