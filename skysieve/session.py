"""Session settings and lineage cuts shared by every operator."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A single-machine session for tests and benchmarks; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("skysieve")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def ship_package(spark: SparkSession) -> None:
    """Let Python workers import this package: where the driver's PYTHONPATH does not name its folder for them, Spark's file
    server sends them a copy, once per session."""
    root, context = Path(__file__).resolve().parents[1], spark.sparkContext
    if str(root) in os.environ.get("PYTHONPATH", "").split(os.pathsep) or getattr(context, "_skysieve_shipped", False):
        return
    archive = shutil.make_archive(os.path.join(tempfile.mkdtemp(prefix="spark-"), "skysieve"), "zip", root, "skysieve")
    context.addPyFile(archive)
    context._skysieve_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir of the session. Only on a local master, where that is unset, a temporary
    folder is made and set as the checkpoint folder; on a cluster its absence is an error, as executors share no local folder."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(configured)
        return configured.rstrip("/")
    current = spark.sparkContext.getCheckpointDir()
    if current is None:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        own = "file://" + os.path.join(tempfile.gettempdir(), "spark-" + uuid.uuid4().hex[:8])
        spark.sparkContext.setCheckpointDir(own)
        current = spark.sparkContext.getCheckpointDir()
    return current.rstrip("/")


#: Scratch tables of this process that release() may delete.
_scratch: list[str] = []


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path for a written table in the shared folder."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    _scratch.append(path)
    return path


def discard(spark: SparkSession, path: str) -> bool:
    """Delete a scratch table that nothing will read any more."""
    if path in _scratch:
        _scratch.remove(path)
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True))


def release(spark: SparkSession) -> int:
    """Delete the scratch tables written so far, once the results that read them are written; the number deleted. Tables at paths of
    the caller's own stay."""
    deleted = 0
    while _scratch:
        deleted += discard(spark, _scratch[-1])
    return deleted


def cut(df: DataFrame) -> DataFrame:
    """Compute once and cut the lineage with a table in the shared folder, which survives lost executors. In loops this also
    keeps plans small: a checkpointed Dataset would hand the constraints of its whole past on to the optimizer."""
    return stored(df, "cut")


def stored(df: DataFrame, name: str, partition_by: tuple[str, ...] = (), path: str | None = None) -> DataFrame:
    """Write as a Parquet table in the shared folder and read it back; columns can then be pruned and filters pushed."""
    spark = df.sparkSession
    path = path or scratch_path(spark, name)
    df.write.mode("append").partitionBy(*partition_by).parquet(path)
    return spark.read.schema(df.schema).parquet(path)
