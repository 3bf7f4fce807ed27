"""An append-only collection: deliveries are classified, assigned to persistent events and cohorts, and chained by hashes."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skysieve.functions.checks import ConstraintError
from skysieve.functions.keys import message_key
from skysieve.operators.features import allocation
from skysieve.operators.review import fingerprint
from skysieve.operators.sessions import persistent_events
from skysieve.session import cut

LEDGER = "collection_batch int, n_messages bigint, content_sha256 string, previous_sha256 string, entry_sha256 string"


def content_digest(rows: DataFrame, print_column: str = "fingerprint") -> str:
    """A digest of a set of rows that does not depend on their order: the sorted fingerprints of each of 16^5 ranges are hashed, the
    hashes of each 16^2 of those ranges in order, and the at most 16^3 hashes so made on the driver."""

    def level(df: DataFrame, value: str, key: str, digits: int) -> DataFrame:
        kept = F.struct(F.col(key), F.col(value).alias("v"))
        return df.groupBy(F.substring(key, 1, digits).alias("r")).agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(kept)), lambda x: x["v"]), "\n"), 256).alias("d"))

    parts = level(level(rows, print_column, print_column, 5), "d", "r", 3)
    return hashlib.sha256("\n".join(r["d"] for r in parts.orderBy("r").collect()).encode()).hexdigest()


class Collection:
    """Messages (record_no, event_pair, source_message_id, tca, content columns) in batches under `path`, and a ledger with one entry per batch.

    A message whose usable identifier is known with the same content is a duplicate and left out; one with other content is a
    conflict, which is an error or, with on_conflict="keep_first", left out too. Messages without a usable identifier are all new. New
    messages join the event of their pair within the tolerance or open one; ambiguity is an error. The cohort follows from a hash of
    the event, so it is the same in whatever order events come."""

    def __init__(self, spark: SparkSession, path: str, content: tuple[str, ...], tolerance_s: float = 1800.0, seed: str = "prospective", fraction: float = 0.35) -> None:
        self.spark, self.path, self.content = spark, path, content
        self.tolerance_s, self.seed, self.fraction = tolerance_s, seed, fraction

    def ledger(self) -> list:
        where = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/ledger")
        if not where.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(where):
            return []
        return sorted(self.spark.read.schema(LEDGER).parquet(f"{self.path}/ledger").collect(), key=lambda r: r["collection_batch"])

    def batch(self, number: int) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/messages/collection_batch={number}")

    def messages(self) -> DataFrame | None:
        entries = self.ledger()
        return self.spark.read.option("basePath", f"{self.path}/messages").parquet(*[f"{self.path}/messages/collection_batch={e['collection_batch']}" for e in entries]) if entries else None

    def append(self, delivery: DataFrame, on_conflict: str = "fail") -> dict[str, int]:
        """Counts of new, duplicate, conflict and unplaceable messages of the delivery (no pair or closest approach)."""
        known, entries = self.messages(), self.ledger()
        rows = delivery.filter("event_pair is not null and tca is not null").select("record_no", "event_pair", "source_message_id", "tca", *self.content).withColumn("k", message_key(F.col("source_message_id"))).withColumn("fingerprint", fingerprint(("event_pair", "tca", *self.content)))
        firsts = rows.filter("k is not null").groupBy("k").agg(F.min(F.struct("record_no", F.col("fingerprint").alias("p"))).alias("f")).select("k", F.col("f.record_no").alias("first_no"), F.col("f.p").alias("first_print"))
        if known is not None:
            old = known.filter("k is not null").select("k", F.col("fingerprint").alias("known_print"))
            firsts = firsts.join(old, "k", "left").select("k", F.when(F.col("known_print").isNull(), F.col("first_no")).alias("first_no"), F.coalesce("known_print", "first_print").alias("first_print"))
        kind = F.when(F.col("k").isNull() | F.coalesce(F.col("record_no") == F.col("first_no"), F.lit(False)), "new").when(F.col("fingerprint") == F.col("first_print"), "duplicate").otherwise("conflict")
        classed = cut(rows.join(firsts, "k", "left").withColumn("kind", kind).drop("first_no", "first_print"))
        counts = {r["kind"]: r["count"] for r in classed.groupBy("kind").count().collect()}
        if counts.get("conflict") and on_conflict != "keep_first":
            raise ConstraintError(f"{counts['conflict']} messages come again with other content")
        fresh = classed.filter("kind = 'new'").drop("kind")
        empty = self.spark.createDataFrame([], "event_id string, event_pair string, tca_min timestamp, tca_max timestamp")
        events = empty if known is None else known.groupBy("event_id", "event_pair").agg(F.min("tca").alias("tca_min"), F.max("tca").alias("tca_max"))
        placed = cut(persistent_events(fresh.select("event_pair", F.col("record_no").alias("message_id"), "tca", F.col("record_no").alias("order_no")), events, self.tolerance_s))
        if not placed.filter("ambiguous").isEmpty():
            raise ConstraintError("a message lies within the tolerance of several events of its pair")
        number = entries[-1]["collection_batch"] + 1 if entries else 1
        out = fresh.join(placed.select(F.col("message_id").cast("bigint").alias("record_no"), "event_id"), "record_no").withColumn("study_cohort", allocation(F.col("event_id"), self.seed, self.fraction))
        out.write.mode("errorifexists").parquet(f"{self.path}/messages/collection_batch={number}")
        self._enter(number, entries[-1]["entry_sha256"] if entries else "")
        total = delivery.count()
        return {"new": 0, "duplicate": 0, "conflict": 0} | counts | {"unplaceable": total - sum(counts.values())}

    def _entry(self, number: int, previous: str) -> tuple:
        rows = self.batch(number)
        n, digest = rows.count(), content_digest(rows)
        return number, n, digest, previous, hashlib.sha256(f"{number}|{n}|{digest}|{previous}".encode()).hexdigest()

    def _enter(self, number: int, previous: str) -> None:
        self.spark.createDataFrame([self._entry(number, previous)], LEDGER).coalesce(1).write.mode("append").parquet(f"{self.path}/ledger")

    def verify(self) -> list[int]:
        """Batches whose messages or place in the chain are not what the ledger says."""
        wrong, previous = [], ""
        for entry in self.ledger():
            if tuple(entry) != self._entry(entry["collection_batch"], previous):
                wrong.append(entry["collection_batch"])
            previous = entry["entry_sha256"]
        return wrong
