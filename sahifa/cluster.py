"""What every operator needs from the cluster: a shared folder to cut lineage with, and importable workers.

Intermediate tables go to the folder named by ``spark.checkpoint.dir`` as Parquet. Unlike blocks cached on
executors they outlive a lost executor, and unlike RDD checkpoints a reader still prunes columns.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = str(Path(__file__).resolve().parent.parent)


def workspace(spark: SparkSession) -> str:
    """The shared folder for intermediate tables; a folder of our own only in one process that names none."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='sahifa-')}"
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/sahifa-{spark.sparkContext.applicationId}"


def new_path(spark: SparkSession, tag: str) -> str:
    return f"{workspace(spark)}/{tag}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` to the shared folder once and go on from the written copy."""
    path = new_path(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of the workspace through Hadoop's file system, whatever store it is in."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def clear_workspace(spark: SparkSession) -> None:
    """Delete everything this application wrote; frames that still read from there stop working."""
    remove(spark, workspace(spark))


#: Arrow batches are cut by bytes, and by rows in case the byte limit is not honoured: texts may be very long.
BATCH_BYTES, BATCH_ROWS = 16 << 20, 1000


def expose(spark: SparkSession) -> None:
    """Bound Arrow batches, and let Python workers import this package where it lies.

    Clusters without a shared install ship the package with ``--py-files`` instead.
    """
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([*paths, ROOT])
