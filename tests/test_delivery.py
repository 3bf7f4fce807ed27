from __future__ import annotations

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from skysieve.operators.delivery import exactly_once, first_deliveries, surplus_deliveries

SCHEMA = "record_no bigint, source_message_id string, message_key string"


def rows(df):
    return sorted(r[0] for r in df.collect())


def test_case_blanks_and_placeholders(spark):
    data = [(5, " cdm-1 ", "x"), (2, "CDM-1\t", "x"), (9, "Cdm-1", "x"), (1, None, "x"), (3, " ", "x"), (4, "n/a", "x"), (6, "N/A", "x"), (7, "b", "x"), (8, "unknown", "x"), (10, "UNKNOWN", "x")]
    assert rows(surplus_deliveries(spark.createDataFrame(data, SCHEMA))) == [5, 9]


def test_exactly_once_keeps_unidentified_records_and_columns(spark):
    df = spark.createDataFrame([(1, "a", "p"), (2, "A", "q"), (3, None, "r"), (4, None, "r")], SCHEMA)
    kept = exactly_once(df)
    assert kept.columns == df.columns and rows(kept) == [1, 3, 4]


def test_order_by_delivery_time_with_ties(spark):
    df = spark.createDataFrame([(1, "a", 5), (2, "a", 3), (3, "a", 3)], "record_no bigint, source_message_id string, received_at int")
    assert rows(surplus_deliveries(df, order=("received_at",))) == [1, 3]


def test_repeated_rows_and_empty_table(spark):
    df = spark.createDataFrame([(1, "a", ""), (1, "a", ""), (2, "a", ""), (2, "a", "")], SCHEMA)
    assert rows(surplus_deliveries(df)) == [2, 2]
    assert rows(surplus_deliveries(spark.createDataFrame([], SCHEMA))) == []


def test_hot_identifier(spark):
    df = spark.range(30_000).selectExpr("id as record_no", "if(id % 3 = 0, 'hot', concat('m', id)) as source_message_id")
    assert surplus_deliveries(df).count() == 9_999


def test_orders_of_one_two_and_other_columns_agree(spark):
    rows = [(i, f"m{i % 7}", None if i % 11 == 0 else datetime(2031, 1, 1) + timedelta(minutes=(i * 37) % 5), -i % 3, float(i % 2)) for i in range(1, 90)]
    df = spark.createDataFrame(rows, "record_no bigint, source_message_id string, received_at timestamp, batch int, x double")
    kept = lambda *order: {r["message_key"]: r["kept"] for r in first_deliveries(df, F.col("source_message_id"), "record_no", order).collect()}

    def least(key):
        first = {}
        for r in sorted(rows, key=key, reverse=True):
            first[r[1]] = r[0]
        return first

    early = datetime(1, 1, 1)
    assert kept("record_no") == least(lambda r: r[0])
    assert kept("received_at") == least(lambda r: (r[2] or early, r[0]))
    assert kept("batch") == least(lambda r: (r[3], r[0]))
    assert kept("x", "batch") == least(lambda r: (r[4], r[3], r[0]))


@pytest.mark.parametrize("order", [("record_no",), ("received_at",)])
def test_hash_aggregation(spark, order):
    df = spark.createDataFrame([(1, "a", datetime(2031, 1, 1))], "record_no bigint, source_message_id string, received_at timestamp")
    plan = first_deliveries(df, F.col("source_message_id"), "record_no", order)._jdf.queryExecution().sparkPlan().toString()
    assert "HashAggregate" in plan and "SortAggregate" not in plan
