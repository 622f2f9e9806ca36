"""Session settings and the checkpoint folder."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def build_session(app: str = "limnos", master: str | None = None, shuffle_partitions: int | None = None,
                  **conf: str) -> SparkSession:
    """Session with adaptive execution and skew-join splitting on, and UTC time."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.forceOptimizeSkewedJoin", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


PACKAGE = os.path.dirname(os.path.abspath(__file__))
_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the package to the Python workers, once per application. The archive goes out through the driver."""
    context = spark.sparkContext
    if context.applicationId not in _shipped:
        base = os.path.join(tempfile.mkdtemp(prefix="limnos-package-"), "limnos")
        context.addPyFile(shutil.make_archive(base, "zip", os.path.dirname(PACKAGE), os.path.basename(PACKAGE)))
        _shipped.add(context.applicationId)


def shared_folder(spark: SparkSession) -> str:
    """Folder that driver and executors share: spark.checkpoint.dir, or one in the warehouse where that is unset."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    return folder or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/limnos-checkpoints"


def application_folder(spark: SparkSession) -> str:
    """This application's own folder in the shared one; `clean_up` removes it."""
    return f"{shared_folder(spark).rstrip('/')}/limnos-{spark.sparkContext.applicationId}"


def clean_up(spark: SparkSession) -> None:
    """Remove the tables that this application has staged. Frames that read them, and are not written yet, are lost."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(application_folder(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage in the shared checkpoint folder, so a lost executor costs a re-read only."""
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(spark))
    return df.checkpoint(eager=True)


def staged(df: DataFrame) -> DataFrame:
    """Write to this application's folder and read back. Cuts the lineage as a checkpoint does; repeated values take little room there."""
    path = f"{application_folder(df.sparkSession)}/staged-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cores(df: DataFrame) -> int:
    return max(df.sparkSession.sparkContext.defaultParallelism, 1)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Hash rows over all cores ahead of heavy work per row; adaptive execution would merge small inputs into one task.

    The hash is taken by an expression, since a repartition by the very columns of a previous shuffle is dropped.
    """
    return df.repartition(cores(df), F.xxhash64(*keys))
