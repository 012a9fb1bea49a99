"""Session helpers: where intermediate tables live and how lineage is cut."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: Catalyst takes an input without statistics for larger.
UNKNOWN = 1 << 62


def shared_dir(spark: SparkSession) -> str:
    """Folder for intermediate tables, as named by ``spark.checkpoint.dir``.

    A machine-local folder would be invisible to the other machines and die with its owner,
    so none is made up here: a session without the setting is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        base = current.get() if current.isDefined() else None
    if not base:
        raise RuntimeError("set spark.checkpoint.dir to a shared folder")
    return f"{base.rstrip('/')}/sluice-{spark.sparkContext.applicationId}"


def ensure_shared_dir(spark: SparkSession) -> None:
    """For callers that run as they are: a local session without the setting gets a folder.

    On a cluster, and in ``local-cluster`` mode, nothing is made up.
    """
    master = spark.sparkContext.master
    unset = not spark.conf.get("spark.checkpoint.dir", None)
    unset = unset and not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined()
    if unset and (master == "local" or master.startswith("local[")):
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="sluice-"))


def scratch_path(spark: SparkSession, label: str = "table") -> str:
    """A new, unused path below the shared folder."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str = "table") -> DataFrame:
    """Cut lineage by writing ``df`` to the shared folder and reading it back.

    A parquet table survives lost executors, keeps column pruning for the readers and
    gives Catalyst the true size, so later joins choose their strategy from facts. Its codec
    takes letters by their entropy: four bases need a byte.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path, compression="zstd")
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Delete every intermediate table this application wrote."""
    path = spark._jvm.org.apache.hadoop.fs.Path(shared_dir(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def plan_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate of ``df``; no job is run."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def bounded_bytes(df: DataFrame) -> int | None:
    """Upper estimate of ``df`` in bytes, or None where the estimate proves nothing.

    Catalyst takes an exploded side for as small as its input, so a plan with a generator, or
    a function that makes rows, has no bound until it is stored.
    """
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return None if "Generate " in plan or "MapInArrow " in plan else plan_bytes(df)
