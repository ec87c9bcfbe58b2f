"""Scratch tables in the cluster's shared folder, to cut lineage between the steps of a job."""

from __future__ import annotations

import tempfile
import threading
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Paths that this thread has written and not yet discarded, oldest first.
_WRITTEN = threading.local()


def _written() -> list[str]:
    if not hasattr(_WRITTEN, "paths"):
        _WRITTEN.paths = []
    return _WRITTEN.paths


def checkpoint_dir(spark: SparkSession) -> str:
    """The cluster's shared folder (spark.checkpoint.dir). Where none is set, one is made in local mode only, as in tests."""
    sc = spark.sparkContext
    configured = sc.getConf().get("spark.checkpoint.dir", None)
    if configured:
        return configured
    current = sc.getCheckpointDir()
    if current:
        return current
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="terrane-checkpoint-"))
    return sc.getCheckpointDir()


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it again.

    This cuts lineage: a lost executor costs the running stage, never what was written. The table goes when discard_since
    names it, or when the driver's JVM ends.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/terrane-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    hadoop_path, files = _hadoop(spark, path)
    files.deleteOnExit(hadoop_path)
    _written().append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def mark() -> int:
    """A point in time, for discard_since."""
    return len(_written())


def discard_since(spark: SparkSession, since: int, *keep: DataFrame) -> None:
    """Delete what this thread has written since the mark, but for tables that are still to be read: frames as materialize
    returned them. To be called when everything else that reads those tables has itself been written."""
    paths, kept = _written(), {getattr(k, "scratch_path", None) for k in keep}
    for path in paths[since:]:
        if path not in kept:
            hadoop_path, files = _hadoop(spark, path)
            files.delete(hadoop_path, True)
    paths[since:] = [p for p in paths[since:] if p in kept]


def _hadoop(spark: SparkSession, path: str):
    hadoop_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path, hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
