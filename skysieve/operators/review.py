"""Reviews of collections: grouping, readiness, missing values, status, duplicates, chains and rosters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skysieve.functions.keys import cohort_key, event_key, message_key


def grouping_review(messages: DataFrame, tolerance_s: float = 1800.0) -> DataFrame:
    """Per event: span of closest approaches, gaps to the neighbours on its pair, and the reasons to look at it: wide (span beyond
    the tolerance), near (a neighbour within it), crowded (more than one event on the pair within a day)."""
    events = messages.filter("event_pair is not null").groupBy("event_pair", "event_id").agg(F.min("tca").alias("tca_min"), F.max("tca").alias("tca_max"), F.count(F.lit(1)).alias("messages"))
    w = Window.partitionBy("event_pair").orderBy("tca_min", "event_id")
    seconds = lambda a, b: (F.unix_micros(a) - F.unix_micros(b)) / 1e6
    spans = events.withColumns({
        "span_s": seconds(F.col("tca_max"), F.col("tca_min")), "gap_before_s": seconds(F.col("tca_min"), F.lag("tca_max").over(w)), "gap_after_s": seconds(F.lead("tca_min").over(w), F.col("tca_max")),
    })
    least = F.least("gap_before_s", "gap_after_s")
    return spans.withColumn("reasons", F.array_compact(F.array(F.when(F.col("span_s") > tolerance_s, "wide"), F.when(least <= tolerance_s, "near"), F.when(least <= 86_400, "crowded")))).select(
        "event_pair", "event_id", "messages", "span_s", "gap_before_s", "gap_after_s", F.array_join("reasons", ",").alias("reasons")
    )


def feature_missingness(messages: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """column_name, missing, share: one wide aggregation, turned into rows."""
    counts = messages.agg(F.count(F.lit(1)).alias("__n"), *(F.count_if(F.col(c).isNull()).alias(c) for c in columns))
    pairs = ", ".join(f"'{c}', `{c}`" for c in columns)
    return counts.select("__n", F.expr(f"stack({len(columns)}, {pairs}) as (column_name, missing)")).select("column_name", "missing", F.try_divide("missing", "__n").alias("share"))


def readiness(messages: DataFrame, columns: tuple[str, ...], low: float = 2.0, high: float = 7.0, minimum_history: int = 3) -> DataFrame:
    inside = F.col("time_to_tca").between(low, high)
    complete = F.lit(True)
    for c in columns:
        complete = complete & F.col(c).isNotNull()
    per = messages.groupBy("event_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(inside).alias("w"), F.count_if(complete).alias("c"))
    return per.agg(
        F.sum("n").alias("messages"), F.count(F.lit(1)).alias("events"), F.sum("w").alias("window_messages"), F.count_if(F.col("w") > 0).alias("window_events"),
        F.count_if(F.col("w") >= minimum_history).alias("eligible_events"), F.max("w").alias("longest_history"), F.sum("c").alias("complete_messages"),
    )


def collection_status(collection: DataFrame, low: float = 2.0, high: float = 7.0, minimum_history: int = 3) -> DataFrame:
    """Per cohort (that of the lowest record_no with a usable one): events, messages, events with messages in the window and with enough of them."""
    inside = F.col("time_to_tca").between(low, high)
    cohort = cohort_key(F.col("study_cohort"))
    per = (
        collection.select(event_key(F.col("event_id")).alias("event_id"), cohort.alias("c"), "record_no", "time_to_tca").filter("event_id is not null")
        .groupBy("event_id").agg(F.min(F.when(F.col("c").isNotNull(), F.struct("record_no", "c"))).alias("s"), F.count(F.lit(1)).alias("n"), F.count_if(inside).alias("w"))
    )
    return per.groupBy(F.col("s.c").alias("study_cohort")).agg(
        F.count(F.lit(1)).alias("events"), F.sum("n").alias("messages"), F.count_if(F.col("w") > 0).alias("window_events"), F.count_if(F.col("w") >= minimum_history).alias("eligible_events")
    )


def fingerprint(columns: tuple[str, ...]) -> Column:
    """SHA-256 over the columns in the order given, as JSON with nulls written; NaN counts as null."""
    return F.sha2(F.to_json(F.struct(*(F.col(c) for c in columns)), {"ignoreNullFields": "false"}), 256)


def delivery_classes(collection: DataFrame, content: tuple[str, ...]) -> DataFrame:
    """record_no, delivery: new (the first record of its usable identifier), duplicate (same content as that record), conflict (other
    content), unidentified. Two aggregations and a join instead of a window, so a much-repeated identifier is no hot task."""
    keyed = collection.select("record_no", message_key(F.col("source_message_id")).alias("k"), *(c for c in content))
    first = keyed.filter("k is not null").groupBy("k").agg(F.min(F.struct("record_no", *content)).alias("f"))
    same = F.lit(True)
    for c in content:
        same = same & F.col(c).eqNullSafe(F.col(f"f.{c}"))
    joined = keyed.join(first, "k", "left")
    return joined.select("record_no", F.when(F.col("k").isNull(), "unidentified").when(F.col("record_no") == F.col("f.record_no"), "new").when(same, "duplicate").otherwise("conflict").alias("delivery"))


def out_of_order(rows: DataFrame, arrival: str) -> DataFrame:
    """Messages that arrive with no less time to closest approach than the previous one of their event."""
    before = F.lag("time_to_tca").over(Window.partitionBy("event_id").orderBy(arrival))
    return rows.withColumn("previous_tca", before).filter(F.col("previous_tca") <= F.col("time_to_tca"))


def chained(ledger: DataFrame, number: str, content: tuple[str, ...]) -> DataFrame:
    """Add entry_sha256 and previous_sha256 of a ledger: each entry's hash covers its content and number. The entries are few, one per batch."""
    entry = F.sha2(F.concat_ws("|", F.col(number).cast("string"), *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in content)), 256)
    w = Window.orderBy(number)
    return ledger.withColumn("entry_sha256", entry).withColumn("previous_sha256", F.coalesce(F.lag("entry_sha256").over(w), F.lit("")))


def chain_breaks(chain: DataFrame, number: str, content: tuple[str, ...]) -> DataFrame:
    """Entries whose own hash is not that of their number and content, whose previous_sha256 is not the hash of the entry before, or whose number
    does not follow it."""
    w = Window.orderBy(number)
    again = chained(chain.select(number, *content), number, content).select(F.col(number).alias("__no"), F.col("entry_sha256").alias("__e"))
    rows = chain.withColumn("__p", F.coalesce(F.lag("entry_sha256").over(w), F.lit(""))).withColumn("__n", F.lag(number).over(w)).join(again, F.col(number) == F.col("__no"))
    wrong = (F.col("__e") != F.col("entry_sha256")) | (F.col("__p") != F.col("previous_sha256")) | (F.col(number) != F.col("__n") + 1)
    return rows.filter(wrong).drop("__p", "__n", "__no", "__e")


def roster_digest(events: DataFrame, ranges: int = 65536) -> DataFrame:
    """n_events, roster_sha256 of a set of events: ids are hashed per range of the id's own hash, sorted, and the ranges' digests in
    order make the digest, so no task holds the roster."""
    parts = (
        events.select("event_id").distinct().withColumn("part", F.conv(F.substring(F.sha2("event_id", 256), 1, 4), 16, 10).cast("int") % ranges)
        .groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.sha2(F.array_join(F.array_sort(F.collect_list("event_id")), "\n"), 256).alias("d"))
    )
    return parts.agg(F.sum("n").alias("n_events"), F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "d"))), lambda x: x["d"]), "\n"), 256).alias("roster_sha256"))


def unmatched(left: DataFrame, right: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Full outer reconciliation: keys, side (left_only, right_only) of what the other table lacks."""
    a = left.select(*keys).distinct().withColumn("l", F.lit(1))
    b = right.select(*keys).distinct().withColumn("r", F.lit(1))
    return a.join(b, list(keys), "full_outer").filter("l is null or r is null").select(*keys, F.when(F.col("r").isNull(), "left_only").otherwise("right_only").alias("side"))


def period_faults(records: DataFrame, ledger: DataFrame) -> DataFrame:
    """record_no, fault of records (record_no, collection_batch, received_at, source_export_sha256) against their batch's entry in the ledger: no_entry,
    before_opening, after_end (a batch's period ends when the next one opens) or other_export. The ledger has one row per batch."""
    periods = ledger.select(F.col("collection_batch").alias("__b"), F.col("source_export_sha256").alias("__sha"), "opened_at", F.lead("opened_at").over(Window.orderBy("collection_batch")).alias("__end"))
    fault = (
        F.when(F.col("__b").isNull(), "no_entry").when(F.col("received_at") < F.col("opened_at"), "before_opening").when(F.col("received_at") >= F.col("__end"), "after_end")
        .when(~F.col("source_export_sha256").eqNullSafe(F.col("__sha")), "other_export")
    )
    return records.join(periods, F.col("collection_batch") == F.col("__b"), "left").select("record_no", fault.alias("fault")).filter("fault is not null")
