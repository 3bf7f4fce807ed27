"""Assignment of messages to persistent events, in order, with rejection of ambiguity."""

from __future__ import annotations

import hashlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Seconds by which the search for near endpoints is widened against rounding; what it finds is measured exactly.
_SLACK_S = 1e-3


class _Stretch:
    """The events of a stretch, found by their first and last approach."""

    def __init__(self, tolerance_s: float) -> None:
        self.tolerance_s, self.events, self.ends = tolerance_s, [], []

    def add(self, event_id: str, low: float, high: float) -> None:
        for end in {low, high}:
            insort(self.ends, (end, len(self.events)))
        self.events.append([event_id, low, high])

    def near(self, tca: float) -> set[int]:
        """The events within the tolerance; two of them at most, as more make no difference."""
        found, i = set(), bisect_left(self.ends, (tca - self.tolerance_s - _SLACK_S, -1))
        while i < len(self.ends) and len(found) < 2 and self.ends[i][0] <= tca + self.tolerance_s + _SLACK_S:
            if abs(tca - self.ends[i][0]) <= self.tolerance_s:
                found.add(self.ends[i][1])
            i += 1
        return found

    def widen(self, k: int, tca: float) -> None:
        _, low, high = self.events[k]
        if low <= tca <= high:
            return
        for end in {low, high}:
            del self.ends[bisect_left(self.ends, (end, k))]
        self.events[k][1:] = low, high = min(low, tca), max(high, tca)
        for end in {low, high}:
            insort(self.ends, (end, k))


def _assign(tolerance_s: float):
    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, stretch = None, None
        for batch in batches:
            out = []
            for pair, number, known, name, low, high in zip(*(batch.column(c).to_pylist() for c in ("event_pair", "stretch", "known", "name", "low_s", "high_s"))):
                if (pair, number) != now:
                    now, stretch = (pair, number), _Stretch(tolerance_s)
                if known:
                    stretch.add(name, low, high)
                    continue
                near = stretch.near(low)
                if len(near) > 1:
                    out.append((name, None, True))
                    continue
                if near:
                    k = near.pop()
                    stretch.widen(k, low)
                else:
                    k = len(stretch.events)
                    stretch.add("ext-" + hashlib.sha256(f"{pair}|{name}".encode()).hexdigest()[:24], low, low)
                out.append((name, stretch.events[k][0], False))
            columns = zip(*out) if out else ([], [], [])
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, (pa.string(), pa.string(), pa.bool_()))], ["message_id", "event_id", "ambiguous"])

    return assign


def stretches(rows: DataFrame, tolerance_s: float, pair: str = "event_pair") -> DataFrame:
    """Add stretch to rows of `pair`, low_s, high_s: the rows of a pair by low_s, cut wherever the next begins more than the tolerance after
    all before it have ended. What lies in different stretches is further apart than the tolerance, so no rule that looks no further
    sees across a cut. The cuts are found from one row per pair and cell of time as wide as the tolerance, made in map tasks first, so
    a pair costs its span of time and not its number of rows."""
    placed = rows.withColumn("__cell", F.floor(F.col("low_s") / max(tolerance_s, 1e-6)))
    cells = placed.groupBy(F.col(pair).alias("__pair"), "__cell").agg(F.min("low_s").alias("low"), F.max("high_s").alias("high"))
    order = Window.partitionBy("__pair").orderBy("__cell")
    reached = F.max("high").over(order.rowsBetween(Window.unboundedPreceding, -1))
    begun = cells.withColumn("begins", F.coalesce((F.col("low") - reached > tolerance_s).cast("int"), F.lit(0)))
    numbered = begun.select("__pair", F.col("__cell").alias("__at"), F.sum("begins").over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("stretch"))
    return placed.join(numbered, F.col(pair).eqNullSafe(F.col("__pair")) & (F.col("__cell") == F.col("__at"))).drop("__pair", "__cell", "__at")


def persistent_events(messages: DataFrame, known: DataFrame, tolerance_s: float = 1800.0) -> DataFrame:
    """message_id, event_id, ambiguous for messages (event_pair, message_id, tca, order_no) against events known so far
    (event_id, event_pair, tca_min, tca_max).

    A message joins the event of its pair whose first or last approach lies within the tolerance, and widens it; it opens a
    new event where there is none, and is ambiguous (no event) where there are several. Messages and events without a pair or
    an approach are in no event and left out.

    The rule depends on the order of messages, but not beyond stretches: a pair is cut where its messages and known events leave more than the
    tolerance free, and the stretches are spread over tasks. Within a stretch the order decides, so its messages are sorted (on disk where they
    are many) and pass by one after the other; what is held is the events of the stretch, searched by bisection, and never its messages."""
    seconds = lambda c: F.unix_micros(F.col(c)) / 1e6
    old = known.select("event_pair", F.lit(True).alias("known"), F.col("event_id").cast("string").alias("name"), seconds("tca_min").alias("low_s"), seconds("tca_max").alias("high_s"), F.lit(None).alias("order_no"))
    new = messages.select("event_pair", F.lit(False).alias("known"), F.col("message_id").cast("string").alias("name"), seconds("tca").alias("low_s"), seconds("tca").alias("high_s"), "order_no")
    rows = new.unionByName(old).filter("event_pair is not null and low_s is not null and high_s is not null")
    keys = ["event_pair", "stretch"]
    in_order = stretches(rows, tolerance_s).repartition(*keys).sortWithinPartitions(*keys, F.desc("known"), "order_no", "name")
    return in_order.select(*keys, "known", "name", "low_s", "high_s").mapInArrow(_assign(tolerance_s), "message_id string, event_id string, ambiguous boolean")
