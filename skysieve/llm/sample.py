"""A reproducible sample that stays stable as data grow, by permanent random numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skysieve.functions.keys import cohort_key, event_key
from skysieve.session import cut, scratch_path, stored

NUMBERS = "event_id string, study_cohort string, uniform_value double, first_batch int"
LIMITS = "study_cohort string, share double, plan_no int"


def uniform(event: Column, seed: str) -> Column:
    """A number in [0, 1) from the first 13 hex digits (52 bits) of a SHA-256 over seed and identifier."""
    digits = F.substring(F.sha2(F.concat_ws(":", F.lit(seed), event), 256), 1, 13)
    return F.conv(digits, 16, 10).cast("bigint").cast("double") / float(1 << 52)


class PermanentNumbers:
    """A registry that gives each event, at first sight, a uniform number and the cohort under which it is sampled, and
    never changes either. Selected are all events whose number lies below the share of their cohort; shares may only grow (a
    lower one in a later plan counts as the highest so far), so what was once selected stays selected.

    Events are compared by their canonical spelling; records without a usable one are not sampled. An event's cohort is that of its
    lowest record_no with a usable cohort in the delivery in which it first appears, null if there is none; a null batch
    counts as 0. Null cohort is a cohort of its own in the plan; a cohort without a share is not sampled. Repeated rows
    count once. Other columns are not read."""

    def __init__(self, spark: SparkSession, path: str | None = None, seed: str = "permanent-1") -> None:
        self.spark, self.seed = spark, seed
        self.path = path or scratch_path(spark, "permanent-numbers")
        for name, schema in (("numbers", NUMBERS), ("limits", LIMITS)):
            where = spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
            if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
                spark.createDataFrame([], schema).write.mode("append").parquet(f"{self.path}/{name}")

    def _read(self, name: str, schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")

    def observe(self, records: DataFrame) -> None:
        """Register the events of a delivery that are not registered yet; deliveries come in order."""
        self.observe_seen(seen_events(records))

    def observe_seen(self, seen: DataFrame) -> None:
        """As `observe`, for rows of `seen_events`."""
        first = seen.groupBy("event_id").agg(F.min(F.struct("batch", F.col("c.cohort").alias("cohort"))).alias("first"))
        fresh = first.join(self._read("numbers", NUMBERS), "event_id", "left_anti")
        cut(fresh.select("event_id", F.col("first.cohort").alias("study_cohort"), uniform(F.col("event_id"), self.seed).alias("uniform_value"), F.col("first.batch").alias("first_batch"))) \
            .write.mode("append").parquet(f"{self.path}/numbers")

    def selected(self, plan: DataFrame) -> DataFrame:
        """event_id, study_cohort, uniform_value, first_batch of the events under the highest share that any plan so far,
        this one included, gives their cohort (study_cohort, target_pct)."""
        earlier = self._read("limits", LIMITS)
        number = (earlier.agg(F.max("plan_no")).first()[0] or 0) + 1
        now = plan.groupBy(cohort_key(F.col("study_cohort")).alias("study_cohort")).agg((F.max("target_pct") / 100.0).alias("share"))
        cut(now.filter(F.col("share").isNotNull() & ~F.isnan("share")).withColumn("plan_no", F.lit(number))).write.mode("append").parquet(f"{self.path}/limits")
        limits = self._read("limits", LIMITS).groupBy("study_cohort").agg(F.max("share").alias("share"))
        n, s = self._read("numbers", NUMBERS).alias("n"), limits.alias("s")
        return (
            n.join(s, F.col("n.study_cohort").eqNullSafe(F.col("s.study_cohort")))
            .filter(F.col("uniform_value") < F.col("share")).select("n.*")
        )


def seen_events(records: DataFrame) -> DataFrame:
    """event_id, batch, c: the events of each batch, with the lowest record_no that has a usable cohort, and that cohort; map tasks combine first."""
    return (
        records.select(event_key(F.col("event_id")).alias("event_id"), cohort_key(F.col("study_cohort")).alias("cohort"), "record_no", F.coalesce(F.col("collection_batch").cast("int"), F.lit(0)).alias("batch"))
        .filter(F.col("event_id").isNotNull())
        .groupBy("event_id", "batch")
        .agg(F.min(F.when(F.col("cohort").isNotNull(), F.struct("record_no", "cohort"))).alias("c"))
    )


def stable_sample(collection: DataFrame, plan: DataFrame, path: str | None = None, seed: str = "permanent-1", deliveries: int | None = 6) -> DataFrame:
    """The sample of a whole collection: its batches are observed in turn, consecutive ones together in so many deliveries (None: each by itself)."""
    registry = PermanentNumbers(collection.sparkSession, path, seed)
    seen = stored(seen_events(collection), "seen-events")
    batches = sorted(r["batch"] for r in seen.select("batch").distinct().collect())
    size = max(1, -(-len(batches) // deliveries)) if deliveries else 1
    for at in range(0, len(batches), size):
        registry.observe_seen(seen.filter(F.col("batch").isin(batches[at : at + size])))
    return registry.selected(plan)
