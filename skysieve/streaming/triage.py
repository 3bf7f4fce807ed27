"""Sequential triage: one decision expression for batch and stream, stateful replay, audit views."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skysieve.operators.contracts import demand, stream_faults
from skysieve.operators.features import LARGE_EVENT, large_events
from skysieve.operators.ranking import ranked_within
from skysieve.operators.review import chain_breaks, chained

#: Decision reasons (fixed values).
ESCALATED = "score_at_or_above_escalation_threshold"
NOT_OPEN = "decision_window_not_open"
CLOSED = "decision_window_closed"
SHORT_HISTORY = "minimum_history_not_reached"
GATE_BLOCKED = "safe_exclude_blocked_by_shift_gate"
SAFE = "score_at_or_below_calibrated_threshold"
BETWEEN = "score_between_decision_thresholds"


@dataclass(frozen=True)
class TriagePolicy:
    """Decision limits. `bound` is the order statistic under which, strictly, a score is safe."""

    bound: float
    minimum_history: int = 1
    min_days: float = 2.0
    max_days: float = 7.0
    escalation: float | None = None

    def reason(self, gate_allowed: Column) -> Column:
        """The reason of a message with time_to_tca, score and eligible_history_count, in the fixed order of the rules."""
        score, tca = F.col("score"), F.col("time_to_tca")
        raised = F.lit(False) if self.escalation is None else score >= self.escalation
        safe = score < F.lit(float(self.bound))
        return (
            F.when(raised, ESCALATED).when(tca > self.max_days, NOT_OPEN).when(tca < self.min_days, CLOSED)
            .when(F.col("eligible_history_count") < self.minimum_history, SHORT_HISTORY).when(safe & ~gate_allowed, GATE_BLOCKED).when(safe, SAFE).otherwise(BETWEEN)
        )


def decision_of(reason: Column) -> Column:
    return F.when(reason == ESCALATED, "ESCALATE").when(reason == SAFE, "SAFE-EXCLUDE").otherwise("MONITOR")


def decided(counted: DataFrame, policy: TriagePolicy, gate_allowed: Column | None = None) -> DataFrame:
    """Add decision_window_eligible, shift_gate_allowed, reason and decision to messages with their counters."""
    allowed = F.coalesce(gate_allowed, F.lit(False)) if gate_allowed is not None else F.lit(True)
    return (
        counted.withColumn("decision_window_eligible", F.col("time_to_tca").between(policy.min_days, policy.max_days)).withColumn("shift_gate_allowed", allowed)
        .withColumn("reason", policy.reason(F.col("shift_gate_allowed"))).withColumn("decision", decision_of(F.col("reason")))
    )


def batch_audit(messages: DataFrame, policy: TriagePolicy, gate_allowed: Column | None = None, limit: int = LARGE_EVENT) -> DataFrame:
    """The audit of a whole history at once: the batch twin of the stream. As time runs one way, messages before the window have no
    eligible history and those after it all of it. Events of over `limit` messages are spread over tasks."""
    inside = F.col("time_to_tca").between(policy.min_days, policy.max_days)
    large = large_events(messages, limit)
    w = Window.partitionBy("event_id").orderBy(F.desc("time_to_tca"))
    usual = messages if large is None else messages.join(large, "event_id", "left_anti")
    out = usual.withColumn("sequence_number", F.row_number().over(w)).withColumn("eligible_history_count", F.sum(inside.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("int"))
    if large is not None:
        spread = ranked_within(messages.join(large, "event_id", "left_semi"), ("event_id",), (-F.col("time_to_tca"),), "sequence_number")
        bounds = spread.groupBy("event_id").agg(F.count_if(F.col("time_to_tca") > policy.max_days).alias("__early"), F.count_if(inside).alias("__inside"))
        spread = spread.join(bounds, "event_id").withColumn("eligible_history_count", F.greatest(F.lit(0), F.least(F.col("__inside"), F.col("sequence_number") - F.col("__early"))).cast("int"))
        out = out.unionByName(spread.drop("__early", "__inside").withColumn("sequence_number", F.col("sequence_number").cast("int")))
    return decided(out, policy, gate_allowed)


#: Micro-batches between two whole tables of counters; the tables between them hold the events of one micro-batch each.
SNAPSHOT_EVERY = 10
_COUNTERS = "event_id string, sequence_number int, eligible_history_count int, last_time_to_tca double"


def counted_updates(updates: DataFrame, counters: DataFrame, policy: TriagePolicy, limit: int = LARGE_EVENT) -> DataFrame:
    """Add sequence_number, eligible_history_count and late to a micro-batch of event_id, time_to_tca, score, gate_allowed, given the
    counters of its events so far. Neither the order nor the chunks in which rows arrive matter: of several updates of one event and
    time the one with the highest score counts (missing above all, blocked before open), the others are late. Late updates have
    null counters. Updates without a time count after all others. Events of over `limit` updates are spread over tasks."""
    so_far = counters.select("event_id", F.col("sequence_number").alias("__n"), F.col("eligible_history_count").alias("__e"), "last_time_to_tca")
    time = F.col("time_to_tca")
    copies = Window.partitionBy("event_id", "time_to_tca").orderBy(F.desc_nulls_first("score"), "gate_allowed")
    known = updates.join(so_far, "event_id", "left").fillna(0, ["__n", "__e"]).withColumn("late", F.coalesce(time >= F.col("last_time_to_tca"), F.lit(False)) | (time.isNotNull() & (F.row_number().over(copies) > 1))).drop("last_time_to_tca")
    inside = F.coalesce(time.between(policy.min_days, policy.max_days), F.lit(False))
    large = large_events(updates, limit)
    w = Window.partitionBy("event_id").orderBy(F.desc_nulls_last("time_to_tca")).rowsBetween(Window.unboundedPreceding, 0)
    usual = known if large is None else known.join(large, "event_id", "left_anti")
    on_time = ~F.col("late")
    out = usual.withColumn("__i", F.sum(on_time.cast("int")).over(w)).withColumn("__h", F.sum((on_time & inside).cast("int")).over(w))
    if large is not None:
        spread = known.join(large, "event_id", "left_semi")
        ranked = ranked_within(spread.filter(on_time), ("event_id",), (F.coalesce(-time, F.lit(float("inf"))),), "__i")
        bounds = ranked.groupBy("event_id").agg(F.count_if(time > policy.max_days).alias("__early"), F.count_if(inside).alias("__inside"))
        ranked = ranked.join(bounds, "event_id").withColumn("__h", F.greatest(F.lit(0), F.least(F.col("__inside"), F.col("__i") - F.col("__early")))).drop("__early", "__inside")
        out = out.unionByName(ranked).unionByName(spread.filter("late").withColumns({"__i": F.lit(0), "__h": F.lit(0)}))
    return out.withColumns({
        "sequence_number": F.when(on_time, F.col("__n") + F.col("__i")).cast("int"), "eligible_history_count": F.when(on_time, F.col("__e") + F.col("__h")).cast("int"),
    }).drop("__n", "__e", "__i", "__h")


def audited_updates(updates: DataFrame, counters: DataFrame, policy: TriagePolicy, limit: int = LARGE_EVENT) -> DataFrame:
    """The audit of a micro-batch; late updates have no reason and no decision."""
    out = decided(counted_updates(updates, counters, policy, limit), policy, F.col("gate_allowed"))
    return out.withColumns({"reason": F.when(~F.col("late"), F.col("reason")), "decision": F.when(~F.col("late"), F.col("decision"))}).drop("gate_allowed")


def _merged(counters: DataFrame) -> DataFrame:
    """One row per event: counters only grow and times only fall."""
    return counters.groupBy("event_id").agg(F.max("sequence_number").alias("sequence_number"), F.max("eligible_history_count").alias("eligible_history_count"), F.min("last_time_to_tca").alias("last_time_to_tca"))


def _counters_before(spark: SparkSession, path: str, batch: int) -> DataFrame:
    """Counters after all micro-batches before this one: the last whole table and those of single micro-batches since."""
    if batch == 0:
        return spark.createDataFrame([], _COUNTERS)
    whole = (batch - 1) // SNAPSHOT_EVERY * SNAPSHOT_EVERY
    return _merged(spark.read.schema(_COUNTERS).parquet(*[f"{path}/after-{i}" for i in range(whole, batch)]))


def replay(source: DataFrame, policy: TriagePolicy, audit_path: str, checkpoint_path: str, gate_allowed: Column | None = None, on_late: str = "quarantine", limit: int = LARGE_EVENT, on_invalid: str = "pass"):
    """Run a stream of event_id, time_to_tca, score (and gate features) to its end into an append-only audit with one folder per
    micro-batch (batch_id); restarts go on where they stopped, and a micro-batch that is run again replaces its own folders, so each is written
    once. State per event is two counters and a time, in tables beside the checkpoint. Updates of one event within a micro-batch are taken
    by falling time_to_tca, whatever their number and order. An update that does not lower its event's time_to_tca is late: on_late="fail" stops
    the query before the micro-batch changes anything, "quarantine" passes it on with late = true, no counters, no decision and no effect
    on the state. With on_invalid="fail" a micro-batch in which an event, a time or a score is missing or impossible stops it likewise."""
    if on_late not in ("fail", "quarantine") or on_invalid not in ("fail", "pass"):
        raise ValueError("on_late must be fail or quarantine, and on_invalid fail or pass")
    allowed = F.coalesce(gate_allowed, F.lit(False)) if gate_allowed is not None else F.lit(True)
    number = lambda c: F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")).alias(c)
    updates = source.select(F.col("event_id").cast("string").alias("event_id"), number("time_to_tca"), number("score"), allowed.alias("gate_allowed"))
    state = f"{checkpoint_path}/counters"

    def write(rows: DataFrame, batch: int) -> None:
        spark, rows = rows.sparkSession, rows.persist()
        if on_invalid == "fail":
            demand(stream_faults(rows).filter("rule <> 'repeated_update'"), f"micro-batch {batch}")
        before = _counters_before(spark, state, batch)
        audit = audited_updates(rows, before, policy, limit)
        if on_late == "fail" and (late := audit.filter("late").first()):
            raise ValueError(f"event {late['event_id']}: updates must come with strictly decreasing time_to_tca")
        written = f"{audit_path}/batch_id={batch}"
        audit.write.mode("overwrite").parquet(written)
        after = spark.read.schema(audit.schema).parquet(written).filter("not late").select("event_id", "sequence_number", "eligible_history_count", F.col("time_to_tca").alias("last_time_to_tca"))
        _merged(after.unionByName(before) if batch % SNAPSHOT_EVERY == 0 else after).write.mode("overwrite").parquet(f"{state}/after-{batch}")
        rows.unpersist()

    return updates.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint_path).trigger(availableNow=True).start()


def current_decisions(audit: DataFrame) -> DataFrame:
    """The last row of each event."""
    last = audit.groupBy("event_id").agg(F.max_by(F.struct(*audit.columns), "sequence_number").alias("r"))
    return last.select("r.*")


def audit_faults(audit: DataFrame, policy: TriagePolicy, updates: DataFrame | None = None) -> DataFrame:
    """event_id, time_to_tca, fault of an audit against what the messages give: differs (a counter, flag, reason or decision), missing (an
    update without an audit row), unknown (an audit row without an update), repeated. `updates` are the messages (event_id, time_to_tca, score,
    gate_allowed); without them the audit's own rows stand for them, and only numbers that do not run from 1 without a gap tell of rows that
    are gone."""
    own = audit.select("event_id", "time_to_tca", "score", F.col("shift_gate_allowed").alias("gate_allowed"))
    again = batch_audit((own if updates is None else updates).dropDuplicates(["event_id", "time_to_tca"]), policy, F.col("gate_allowed"))
    fields = ("score", "sequence_number", "eligible_history_count", "decision_window_eligible", "shift_gate_allowed", "reason", "decision")
    kept = audit.groupBy("event_id", "time_to_tca").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(*fields)).alias("a"))
    b = again.select("event_id", "time_to_tca", F.struct(*fields).alias("b"))
    wrong = F.lit(False)
    for f in fields:
        wrong = wrong | ~F.col(f"a.{f}").eqNullSafe(F.col(f"b.{f}"))
    fault = F.when(F.col("a").isNull(), "missing").when(F.col("b").isNull(), "unknown").when(F.col("n") > 1, "repeated").when(wrong, "differs")
    return kept.join(b, ["event_id", "time_to_tca"], "full_outer").select("event_id", "time_to_tca", fault.alias("fault")).filter("fault is not null")


def batch_digests(audit: DataFrame, batch: str = "batch_id") -> DataFrame:
    """`batch`, n_rows, content_sha256 of each delivery of an audit, whatever the order of its rows: rows are hashed, their hashes sorted and hashed
    within each of 4096 ranges of the hash, and these in order."""
    row = F.sha2(F.concat_ws("|", "event_id", F.col("sequence_number").cast("string"), F.col("eligible_history_count").cast("string"), "reason", "decision"), 256)
    joined = lambda c: F.sha2(F.array_join(F.array_sort(F.collect_list(c)), "\n"), 256)
    parts = audit.select(batch, row.alias("r")).groupBy(batch, F.substring("r", 1, 3).alias("range")).agg(F.count(F.lit(1)).alias("n"), joined("r").alias("d"))
    return parts.groupBy(batch).agg(F.sum("n").alias("n_rows"), joined(F.concat("range", "d")).alias("content_sha256"))


def counters_of(audit: DataFrame) -> DataFrame:
    """event_id, sequence_number, eligible_history_count, last_time_to_tca: the state that an audit leaves, one row per event."""
    rows = audit.filter("sequence_number is not null").select("event_id", "sequence_number", "eligible_history_count", F.col("time_to_tca").alias("last_time_to_tca"))
    return _merged(rows)


def export_checkpoint(audit: DataFrame, path: str, batch: str = "batch_id") -> None:
    """Write state, audit and the chain of its deliveries' digests as tables under a new `path`."""
    counters_of(audit).write.mode("errorifexists").parquet(f"{path}/counters")
    audit.write.mode("errorifexists").parquet(f"{path}/audit")
    chained(batch_digests(audit, batch), batch, ("n_rows", "content_sha256")).coalesce(1).write.mode("errorifexists").parquet(f"{path}/chain")


def checkpoint_faults(spark: SparkSession, path: str, batch: str = "batch_id") -> DataFrame:
    """what, key: deliveries whose rows or place in the chain are not what the checkpoint says, and events whose counters are not what the audit gives."""
    audit, chain = spark.read.parquet(f"{path}/audit"), spark.read.parquet(f"{path}/chain")
    now = batch_digests(audit, batch).withColumnsRenamed({"n_rows": "n", "content_sha256": "c"})
    moved = chain.join(now, batch, "full_outer").filter(~(F.col("n").eqNullSafe(F.col("n_rows")) & F.col("c").eqNullSafe(F.col("content_sha256")))).select(batch)
    broken = chain_breaks(chain, batch, ("n_rows", "content_sha256")).select(batch)
    stored, given = spark.read.parquet(f"{path}/counters"), counters_of(audit)
    columns = ("event_id", "sequence_number", "eligible_history_count", "last_time_to_tca")
    events = stored.select(*columns).exceptAll(given.select(*columns)).unionByName(given.select(*columns).exceptAll(stored.select(*columns))).select("event_id").distinct()
    return moved.union(broken).distinct().select(F.lit("delivery").alias("what"), F.col(batch).cast("string").alias("key")).union(events.select(F.lit("event"), "event_id"))


def without_events(counters: DataFrame, events: DataFrame) -> DataFrame:
    """Counters with the state of `events` (event_id) forgotten, so that their next update counts as the first."""
    return counters.join(events.select("event_id").distinct(), "event_id", "left_anti")


def operator_queue(audit: DataFrame, limit: int = 100) -> DataFrame:
    """Current decisions in the order in which to look at them: escalations, monitored, excluded; nearest first, then highest score."""
    urgency = F.when(F.col("decision") == "ESCALATE", 0).when(F.col("decision") == "MONITOR", 1).otherwise(2)
    return current_decisions(audit).withColumn("priority", urgency).orderBy("priority", "time_to_tca", F.desc("score"), "event_id").limit(limit)


def timelines(audit: DataFrame, policy: TriagePolicy) -> DataFrame:
    """Each audited message with the conditions that led to its decision and its event's first exclusion."""
    event = Window.partitionBy("event_id")
    safe = F.when(F.col("decision") == "SAFE-EXCLUDE", F.col("sequence_number"))
    return audit.withColumns({
        "history_sufficient": F.col("eligible_history_count") >= policy.minimum_history, "below_safe_bound": F.col("score") < policy.bound,
        "above_escalation": F.lit(False) if policy.escalation is None else F.col("score") >= policy.escalation, "first_safe_sequence": F.min(safe).over(event), "total_updates": F.count(F.lit(1)).over(event),
    })


def showcase_monitor_to_safe(audit: DataFrame) -> DataFrame:
    """The event, now excluded, whose exclusion after monitoring came earliest; ties by more updates, then id."""
    safe = F.col("decision") == "SAFE-EXCLUDE"
    per = audit.groupBy("event_id").agg(
        F.max_by("decision", "sequence_number").alias("current"), F.min(F.when(safe, F.struct("sequence_number", "time_to_tca"))).alias("f"),
        F.min(F.when(F.col("decision") == "MONITOR", F.col("sequence_number"))).alias("m"), F.count(F.lit(1)).alias("total_updates"),
    )
    return (
        per.filter((F.col("current") == "SAFE-EXCLUDE") & (F.col("m") < F.col("f.sequence_number")))
        .select("event_id", F.col("f.sequence_number").alias("first_safe_sequence"), F.col("f.time_to_tca").alias("first_safe_tca"), "total_updates")
        .orderBy(F.desc("first_safe_tca"), F.desc("total_updates"), "event_id").limit(1)
    )


def showcase_gate_blocked(audit: DataFrame, shift_score: str = "shift_score") -> DataFrame:
    """The event most worth showing for its gate: monitored ones first, then most blocked messages, greatest shift score, id."""
    blocked = F.col("reason") == GATE_BLOCKED
    per = audit.groupBy("event_id").agg(F.max_by("decision", "sequence_number").alias("current_decision"), F.count_if(blocked).alias("blocked_updates"), F.max(F.when(blocked, F.col(shift_score))).alias("max_shift_score"))
    return per.filter("blocked_updates > 0").orderBy(F.when(F.col("current_decision") == "MONITOR", 0).otherwise(1), F.desc("blocked_updates"), F.desc_nulls_last("max_shift_score"), "event_id").limit(1)
