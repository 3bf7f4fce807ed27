"""Messages delivered more than once: keep exactly one copy of each identifier."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skysieve.functions.keys import message_key


def _rank(records: DataFrame, columns: list[str]) -> Column:
    """What min_by orders by. Spark aggregates by hash only where buffers have a fixed width, so one whole number or time stays as it is, and a time (or
    whole number) with a whole number to break ties is packed into one decimal; any other order is a struct, aggregated after a sort."""
    kinds = [records.schema[c].dataType.typeName() for c in columns]
    whole = {"byte", "short", "integer", "long"}
    if len(columns) == 1 and kinds[0] in whole | {"timestamp", "timestamp_ntz", "date"}:
        return F.col(columns[0])
    if len(columns) == 2 and kinds[0] in whole | {"timestamp"} and kinds[1] in whole:
        first = F.unix_micros(F.col(columns[0])) if kinds[0] == "timestamp" else F.col(columns[0])
        # Nulls come first, as in a struct.
        parts = [F.coalesce(x.cast("bigint"), F.lit(-(1 << 63)).cast("bigint")).cast("decimal(19,0)") for x in (first, F.col(columns[1]))]
        return (parts[0] * F.lit(str(1 << 63)).cast("decimal(19,0)")).cast("decimal(38,0)") + parts[1]
    return F.struct(*(F.col(c) for c in columns))


def first_deliveries(records: DataFrame, key: Column, row_id: str, order: tuple[str, ...]) -> DataFrame:
    """One row per usable key: message_key, kept (the `row_id` delivered first), copies.

    The aggregation keeps, by min_by over the delivery order and `row_id` as the deterministic tie-break, one
    row per key in a bounded buffer, so map tasks combine before the shuffle and a key with a third of all rows
    costs no more than any other. Rows whose key is null are no messages of this table and give nothing."""
    columns = list(dict.fromkeys((*order, row_id)))
    return (
        records.select(key.alias("message_key"), F.col(row_id), _rank(records, columns).alias("__rank"))
        .filter(F.col("message_key").isNotNull())
        .groupBy("message_key")
        .agg(F.min_by(row_id, "__rank").alias("kept"), F.count(F.lit(1)).alias("copies"))
    )


def surplus_deliveries(records: DataFrame, identifier: str = "source_message_id", row_id: str = "record_no", order: tuple[str, ...] = ("record_no",)) -> DataFrame:
    """`row_id` of every record that is not the kept copy of its identifier.

    Null, blank and placeholder identifiers are unusable: such records are never surplus. Repeated rows with one row_id
    give that row_id once per row beyond the kept row_id. An empty table gives an empty result; other columns are not read."""
    key = message_key(F.col(identifier))
    repeated = first_deliveries(records, key, row_id, order).filter("copies > 1").select("message_key", "kept")
    rows = records.select(key.alias("message_key"), F.col(row_id)).filter(F.col("message_key").isNotNull())
    return rows.join(repeated, "message_key").filter(F.col(row_id) != F.col("kept")).select(row_id)


def exactly_once(records: DataFrame, identifier: str = "source_message_id", row_id: str = "record_no", order: tuple[str, ...] = ("record_no",)) -> DataFrame:
    """All columns of `records`, with one record of each usable identifier; records without a usable one all stay."""
    return records.join(surplus_deliveries(records, identifier, row_id, order).distinct(), row_id, "left_anti")
