from __future__ import annotations

import math
import random
from datetime import datetime, timedelta

import pytest

from skysieve.operators.spikes import FIELDS, implausible_cells, source_profile, spike_cells, stuck_cells

SCHEMA = "cdm_no bigint, event_id string, creation_date timestamp, mission_id string, event_pair string, miss_distance double, relative_speed double, t_position_covariance_det double, season int, z string"
START = datetime(2031, 1, 1)


def messages(n: int, mission: str, level: float, seed: int):
    r = random.Random(seed)
    return [[f"e{seed}-{i // 8}", START + timedelta(hours=i), mission, f"900|{mission}", level * math.exp(r.gauss(0, 0.5)), 7000 * math.exp(r.gauss(0, 0.05)), 1e9 * math.exp(r.gauss(0, 1)), 1, "z"] for i in range(n)]


def frame(spark, rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], SCHEMA)


def found(df):
    return sorted((r["cdm_no"], r["field_name"]) for r in df.collect())


def test_impossible_spiked_and_missing(spark):
    rows = messages(400, "ALDER-1", 1000.0, 1) + messages(400, "BETA-2", 10.0, 2)
    rows[10][4], rows[11][4], rows[12][5], rows[13][6], rows[14][4], rows[15][4] = -1.0, float("inf"), 5e9, 0.0, None, float("nan")
    rows[20][4] = 1000.0 * math.exp(0.5 * 9)  # ordinary for no mission
    rows[450][4] = 1000.0  # ordinary for the first mission, nine spreads off for the second
    rows[30][2] = "alder-1 "  # another spelling
    rows[31][2], rows[31][4] = None, 1000.0 * math.exp(0.5 * 10)  # the mission from the pair
    expected = sorted([(10, FIELDS[0]), (11, FIELDS[0]), (12, FIELDS[1]), (13, FIELDS[2]), (20, FIELDS[0]), (450, FIELDS[0]), (31, FIELDS[0])])
    assert found(implausible_cells(frame(spark, rows))) == expected


def test_stuck_runs_copies_and_breaks(spark):
    def run(values, event="e"):
        return [[event, START + timedelta(hours=i), "M-1", "1|M-1", v, None, None, 1, "z"] for i, v in enumerate(values)]

    rows = run([1.0, 5.0, 5.0 + 1e-9, 5.0, 5.0, 2.0], "a") + run([5.0, 5.0, 5.0, 2.0], "b") + run([5.0, 5.0, None, 5.0, 5.0], "c") + run([3.0] * 4, "d")
    rows += [list(rows[2]), list(rows[8])]  # copies: one of a case, one that must not lengthen a run
    cells = stuck_cells(frame(spark, rows).select("cdm_no", "event_id", "creation_date", *FIELDS))
    assert sorted(r["cdm_no"] for r in cells.collect()) == [1, 2, 3, 4, 15, 16, 17, 18, 19]


@pytest.mark.parametrize("seed", range(3))
def test_blocks_of_a_large_event_change_nothing(spark, seed):
    r = random.Random(seed)
    values = []
    while len(values) < 900:
        values += [r.random()] * r.choice([1, 1, 2, 3, 4, 5, 9])
    rows = [["hot", START + timedelta(minutes=i), "M-1", "1|M-1", v, None, None, 1, "z"] for i, v in enumerate(values)]
    df = frame(spark, rows).select("cdm_no", "event_id", "creation_date", *FIELDS)
    whole, cut = found(stuck_cells(df)), found(stuck_cells(df, block_rows=100))
    assert whole and whole == cut


def test_empty_and_all_null(spark):
    assert found(implausible_cells(frame(spark, []))) == []
    nothing = [[None, None, None, None, None, None, None, 1, "z"]] * 3
    assert found(implausible_cells(frame(spark, nothing))) == []


def test_messages_of_one_time_at_the_edges_of_blocks(spark):
    r = random.Random(4)
    rows = []
    for i in range(100):  # the last two of the six messages of a time and the first two of the next make a run
        for v, speed in enumerate((i, i, r.random() - 9, r.random() - 9, i + 1, i + 1)):
            rows.append(["hot", START + timedelta(minutes=i), "M-1", "1|M-1", 1.0 + v, 100.0 + speed, None, 1, "z"])
    r.shuffle(rows)
    df = frame(spark, rows).select("cdm_no", "event_id", "creation_date", *FIELDS)
    whole, cut = found(stuck_cells(df)), found(stuck_cells(df, block_rows=100))
    assert len(whole) == 4 * 99 and whole == cut


def test_the_fitted_tail_decides(spark):
    rows = messages(2000, "ALDER-1", 1000.0, 1)
    for i, spreads in enumerate((4.2, 5.0, 6.5, 9.0, 14.0)):
        rows[100 * i + 7][4] = 1000.0 * math.exp(0.5 * spreads)
    df = frame(spark, rows)
    far = {risk: {r["cdm_no"] for r in implausible_cells(df, risk=risk).filter("field_name = 'miss_distance'").collect()} for risk in (1e-3, 1e-7, 1e-20)}
    assert far[1e-20] < far[1e-7] < far[1e-3]
    assert {307, 407} <= far[1e-7] and 7 not in far[1e-7]


def test_cutoffs_follow_the_tail_of_a_source(spark):
    r = random.Random(5)
    light, heavy = messages(3000, "ALDER-1", 1000.0, 1), messages(3000, "BETA-2", 10.0, 2)
    for row in heavy:
        row[4] = 10 * math.exp(0.5 * r.gauss(0, 1) * r.choice([1, 1, 1, 1, 2]))
    cells = frame(spark, light + heavy).selectExpr("cdm_no", "mission_id as mission", "0 as season", "'miss_distance' as field_name", "miss_distance as x")
    cutoff = {row["mission"]: row["cutoff"] for row in source_profile(cells, "mission").collect()}
    assert 3 < cutoff["ALDER-1"] + 1 < cutoff["BETA-2"]


def test_equal_readings_are_no_spikes(spark):
    cells = frame(spark, [["e", START, "M-1", "1|M-1", 5.0, None, None, 1, "z"]] * 40).selectExpr("cdm_no", "mission_id as mission", "0 as season", *FIELDS)
    assert found(spike_cells(cells, "mission")) == []
