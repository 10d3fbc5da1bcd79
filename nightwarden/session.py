"""Session settings the operators rely on, and the shared folder for intermediate state."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RUNTIME_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.maxBytesPerBatch": "4m",  # 10,000 texts are tens of megabytes, in the JVM and again in Python
}
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings every plan assumes."""
    for name, value in RUNTIME_SETTINGS.items():
        if spark.conf.get(name, None) != value:
            spark.conf.set(name, value)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a local one only where that is unset and all runs in one process.

    Without such a folder, a cluster's executors would each write to a disk of their own: RuntimeError.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    folder = spark.conf.get("nightwarden.checkpoint.dir", None)
    if not folder:
        folder = tempfile.mkdtemp(prefix="nightwarden-")
        spark.conf.set("nightwarden.checkpoint.dir", folder)
    return folder


_open_stages: list[list[str]] = []


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder."""
    path = f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    for paths in _open_stages[-1:]:
        paths.append(path)
    return path


@contextmanager
def stages(spark: SparkSession):
    """Intermediate results written inside the block are deleted at its end; what it returns must be written by then."""
    _open_stages.append([])
    try:
        yield
    finally:
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        for path in _open_stages.pop():
            where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(conf).delete(where, True)


def cut_lineage(df: DataFrame, *partition_by: str, release: bool = False) -> DataFrame:
    """Write an intermediate result to the shared folder and go on from there.

    It is computed once however often it is used, survives the loss of executors, and its size on disk is known to
    the optimizer when it chooses joins. With `release`, the shuffle files of this write leave the disks at its end, not when
    the driver next collects its garbage.
    """
    spark = df.sparkSession
    path = scratch_path(spark, "stage")
    _write(df, path, partition_by, release)
    return spark.read.schema(df.schema).parquet(path).select(*df.columns)


def cut_union(parts: list[DataFrame], *partition_by: str) -> DataFrame:
    """cut_lineage, with release, of the union by name of the parts, each written by itself.

    The driver plans and describes one part at a time. What it keeps of a plan grows with the plan's operators times its
    stages, so one plan of many parts costs it far more than the same parts one after the other.
    """
    whole = reduce(DataFrame.unionByName, parts)
    spark, path = whole.sparkSession, scratch_path(whole.sparkSession, "stage")
    for part in parts:
        _write(part.select(*[F.col(f.name).cast(f.dataType) for f in whole.schema]), path, partition_by, True)
    return spark.read.schema(whole.schema).parquet(path).select(*whole.columns)


def _write(df: DataFrame, path: str, partition_by: tuple[str, ...], release: bool) -> None:
    conf = df.sparkSession.conf
    before = conf.get(CLEANUP, "false")
    if release:
        conf.set(CLEANUP, "true")
    try:
        df.write.mode("append").partitionBy(*partition_by).parquet(path)
    finally:
        if release:
            conf.set(CLEANUP, before)


def cut_released(df: DataFrame, *partition_by: str) -> DataFrame:
    """cut_lineage with release."""
    return cut_lineage(df, *partition_by, release=True)
