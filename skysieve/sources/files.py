"""Rosters, archives, audits and reports as files."""

from __future__ import annotations

import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skysieve.functions.checks import ConstraintError, expect
from skysieve.session import scratch_path


def read_roster(spark: SparkSession, path: str) -> DataFrame:
    """event_id of a denominator roster: Parquet with that column, or JSON with a list or {"event_ids": [...]}. Ids are unique and
    present, and there is at least one."""
    if path.endswith(".json"):
        whole = spark.read.text(path, wholetext=True).select(F.btrim("value").alias("v"))
        ids = F.when(F.col("v").startswith("["), F.from_json("v", "array<string>")).otherwise(F.from_json("v", "event_ids array<string>")["event_ids"])
        roster = whole.select(F.explode(ids).alias("event_id"))
    else:
        roster = spark.read.parquet(path).select(F.col("event_id").cast("string").alias("event_id"))
    if roster.isEmpty():
        raise ConstraintError("the roster is empty")
    return expect(roster, {"event_id": F.coalesce(F.btrim("event_id") != "", F.lit(False))}, ("event_id",))


def read_archive(spark: SparkSession, path: str, member: str = "train_data.csv", rows: int | None = None, events: int | None = None) -> DataFrame:
    """The one CSV of a zip archive. The archive is unpacked in pieces to the shared folder, so that tasks read it in parallel; the
    expected counts, if given, are checked in one job."""
    with zipfile.ZipFile(path) as archive:
        if archive.namelist() != [member]:
            raise ConstraintError(f"the archive must hold {member} alone")
        target = f"{scratch_path(spark, 'archive')}/{member}"
        where = spark._jvm.org.apache.hadoop.fs.Path(target)
        out = where.getFileSystem(spark._jsc.hadoopConfiguration()).create(where)
        with archive.open(member) as source:
            while piece := source.read(1 << 20):
                out.write(bytearray(piece))
        out.close()
    frame = spark.read.csv(target, header=True, inferSchema=True)
    if rows is not None or events is not None:
        found = frame.agg(F.count(F.lit(1)).alias("r"), F.count_distinct("event_id").alias("e")).first()
        if rows not in (None, found["r"]) or events not in (None, found["e"]):
            raise ConstraintError(f"the archive has {found['r']} rows and {found['e']} events")
    return frame


def read_audits(spark: SparkSession, paths: list[str], single_valued: tuple[str, ...] = ()) -> DataFrame:
    """Audits of several runs with audit_file; columns may differ. Each hash column has one value, of 64 hex digits, over all of them, and
    no message is in two audits."""
    parts = [spark.read.parquet(p).withColumn("audit_file", F.lit(p)) for p in paths]
    audits = parts[0]
    for part in parts[1:]:
        audits = audits.unionByName(part, allowMissingColumns=True)
    for c in single_valued:
        values = [r[0] for r in audits.select(c).distinct().limit(2).collect()]
        if len(values) != 1 or values[0] is None or audits.filter(~F.col(c).rlike("^[0-9a-f]{64}$")).limit(1).count():
            raise ConstraintError(f"{c} must be one hash")
    return expect(audits, {}, ("event_id", "sequence_number"))


def write_once(df: DataFrame, path: str, partition_by: tuple[str, ...] = ()) -> None:
    """Write a Parquet table that must not exist yet; readers see it by its _SUCCESS mark."""
    df.write.mode("errorifexists").partitionBy(*partition_by).parquet(path)


def write_report(df: DataFrame, path: str) -> None:
    """Write a small report as one CSV that must not exist yet."""
    df.coalesce(1).write.mode("errorifexists").csv(path, header=True)
