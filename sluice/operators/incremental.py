"""Recompute only what changed, and keep the manifest that says so."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.operators.fingerprints import latest_by_uid


def incremental(
    df: DataFrame,
    manifest: DataFrame | None,
    key: str = "path",
    hash: str = "content_hash",
    resume: str = "on",
) -> DataFrame:
    """Add ``action``: ``reuse`` if the manifest holds this key with this hash.

    ``resume="off"`` or a missing manifest recomputes everything. Of several manifest entries
    for a key the newest counts (by ``mtime``, where the manifest has it).
    """
    if resume not in ("on", "off"):
        raise ValueError("resume is 'on' or 'off'")
    if resume == "off" or manifest is None:
        return df.withColumn("action", F.lit("recompute"))
    newest = newest_entries(manifest, key)
    known = newest.select(key, F.col(hash).alias("_known"))
    joined = df.join(known, key, "left")
    same = F.coalesce(F.col("_known") == F.col(hash), F.lit(False))
    return joined.withColumn("action", F.when(same, "reuse").otherwise("recompute")).drop("_known")


def run_incremental(
    df: DataFrame,
    previous: DataFrame | None,
    step: Callable[[DataFrame], DataFrame],
    key: str = "path",
    hash: str = "content_hash",
    resume: str = "on",
) -> DataFrame:
    """``step`` over new and changed rows only, earlier results of the others kept.

    ``previous`` holds earlier results with their ``key`` and ``hash``.
    """
    if resume == "off" or previous is None:
        return step(df)
    todo = df.join(previous.select(key, hash), [key, hash], "left_anti")
    kept = previous.join(df.select(key, hash), [key, hash], "left_semi")
    return step(todo).unionByName(kept)


def upsert_manifest(old: DataFrame, new: DataFrame, key: str = "path") -> DataFrame:
    """Entries of ``new`` replace those of ``old`` for the same key."""
    both = old.withColumn("_age", F.lit(0)).unionByName(new.withColumn("_age", F.lit(1)))
    return latest_by_uid(both, key, "_age").drop("_age")


def newest_entries(manifest: DataFrame, key: str = "path", created: str = "mtime") -> DataFrame:
    """One entry per key: the newest, and of equally new ones the largest."""
    rest = [c for c in manifest.columns if c != key]
    order = [created, *[c for c in rest if c != created]] if created in rest else rest
    newest = F.max(F.struct(*order)).alias("_entry")
    return manifest.groupBy(key).agg(newest).select(key, "_entry.*").select(*manifest.columns)


def write_manifest(df: DataFrame, path: str) -> DataFrame:
    """Write a manifest, replacing the one at ``path`` by a new version in one step.

    Every version is a folder of its own; the small file ``CURRENT`` names the valid one and
    is swapped last, so readers see the old manifest or the new one.
    """
    spark = df.sparkSession
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    version = f"v-{uuid.uuid4().hex}"
    df.write.parquet(f"{path}/{version}")
    system = jvm.org.apache.hadoop.fs.Path(path).getFileSystem(conf)
    fresh = jvm.org.apache.hadoop.fs.Path(f"{path}/CURRENT.{version}")
    out = system.create(fresh, True)
    out.write(bytearray(version.encode()))
    out.close()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fresh.toUri(), conf)
    swap = spark._sc._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    swap[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context.rename(fresh, jvm.org.apache.hadoop.fs.Path(f"{path}/CURRENT"), swap)
    return read_manifest(spark, path)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """The valid version of the manifest at ``path``."""
    version = spark.read.text(f"{path}/CURRENT", wholetext=True).first()[0]
    return spark.read.parquet(f"{path}/{version}")
