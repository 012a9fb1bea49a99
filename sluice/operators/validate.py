"""Data quality checks. Every check reports what it found, nothing is swallowed."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from sluice.functions.globs import glob_match
from sluice.operators.incremental import newest_entries


def check_non_empty(expected: DataFrame, present: DataFrame, path: str = "path") -> DataFrame:
    """Each expected path is ``ok``, ``empty`` or ``missing`` among the present files."""
    sizes = present.select(path, "length")
    state = (
        F.when(F.col("length").isNull(), "missing")
        .when(F.col("length") == 0, "empty")
        .otherwise("ok")
    )
    return expected.select(path).join(sizes, path, "left").select(path, state.alias("status"))


def _against(value: Column, known: Column) -> Column:
    return (
        F.when(known.isNull(), "not_in_manifest").when(value == known, "match").otherwise("mismatch")
    )


def _with_manifest(df: DataFrame, manifest: DataFrame, path: str, *columns: str) -> DataFrame:
    known = newest_entries(manifest, path).select(path, *[F.col(c).alias(f"_{c}") for c in columns])
    return df.join(known, path, "left")


def check_hash(df: DataFrame, manifest: DataFrame, path: str = "path") -> DataFrame:
    joined = _with_manifest(df, manifest, path, "content_hash")
    status = _against(F.col("content_hash"), F.col("_content_hash"))
    return joined.select(path, status.alias("status"))


def check_mtime(df: DataFrame, manifest: DataFrame, path: str = "path") -> DataFrame:
    joined = _with_manifest(df, manifest, path, "mtime")
    return joined.select(path, _against(F.col("mtime"), F.col("_mtime")).alias("status"))


def _statuses(checks: Sequence[str]) -> dict[str, Column]:
    size = F.when(F.col("size").isNull(), "missing").when(F.col("size") == 0, "empty")
    statuses = {
        "non_empty": size.otherwise("match"),
        "hash": _against(F.col("content_hash"), F.col("_content_hash")),
        "mtime": _against(F.col("mtime"), F.col("_mtime")),
    }
    unknown = set(checks) - set(statuses)
    if unknown:
        raise ValueError(f"unknown checks {sorted(unknown)}")
    return {c: statuses[c] for c in checks}


def validate(
    df: DataFrame,
    manifest: DataFrame,
    checks: Sequence[str] = ("non_empty", "hash", "mtime"),
    path: str = "path",
) -> DataFrame:
    """One row per path and check with ``ok`` and ``message``, from a single join."""
    joined = _with_manifest(df, manifest, path, "content_hash", "mtime")
    found = [F.struct(F.lit(c).alias("check"), s.alias("message")) for c, s in _statuses(checks).items()]
    return joined.select(path, F.inline(F.array(*found))).select(
        path, "check", (F.col("message") == "match").alias("ok"), "message"
    )


def write_validated(
    df: DataFrame,
    manifest: DataFrame,
    target: str,
    checks: Sequence[str] = ("non_empty", "hash", "mtime"),
    path: str = "path",
) -> DataFrame:
    """Write ``df`` to ``target`` and validate it in the same pass; nothing is read a second time.

    The rows meet the manifest on their way to the files, and what the checks find is observed
    as metrics of the writing job: one row per check with ``valid``, ``n_checks``, ``n_failed``,
    as ``all_valid(validate(...), "check")`` gives, and ``n_rows``, ``n_nulls`` (nulls in any
    column) and ``digest`` (a sum over rows, whatever their order) of what was written. A job
    that is run again after a lost executor counts each row once, as it writes it once.
    """
    spark = df.sparkSession
    columns = df.columns
    joined = _with_manifest(df, manifest, path, "content_hash", "mtime")
    statuses = _statuses(checks)
    nulls = [F.col(f"`{c}`").isNull().cast("long") for c in columns]
    text = F.to_json(F.struct(*[F.col(f"`{c}`") for c in columns]), {"ignoreNullFields": "false"})
    digest = F.conv(F.substring(F.md5(text), 1, 7), 16, 10).cast("long")
    metrics = [F.count(F.lit(1)).alias("n_rows"), F.sum(sum(nulls[1:], nulls[0])).alias("n_nulls"), F.sum(digest).alias("digest")]
    metrics += [F.count_if(F.coalesce(s != "match", F.lit(True))).alias(f"failed_{c}") for c, s in statuses.items()]
    seen = Observation(f"validated {target}")
    joined.observe(seen, *metrics).select(*[F.col(f"`{c}`") for c in columns]).write.parquet(target)
    got = seen.get
    n, n_nulls, total = int(got["n_rows"]), int(got["n_nulls"] or 0), int(got["digest"] or 0)
    failed = {c: int(got[f"failed_{c}"]) for c in checks}
    rows = [(c, failed[c] == 0, n, failed[c], n, n_nulls, total) for c in checks]  # one row per check
    kinds = "check string, valid boolean, n_checks long, n_failed long, n_rows long, n_nulls long, digest long"
    return spark.createDataFrame(rows, kinds)


def all_valid(report: DataFrame, *by: str) -> DataFrame:
    return report.groupBy(*by).agg(
        F.bool_and("ok").alias("valid"),
        F.count(F.lit(1)).alias("n_checks"),
        F.count_if(~F.col("ok")).alias("n_failed"),
    )


def expect_outputs(
    tasks: DataFrame, outputs: DataFrame, patterns: Sequence[str], uid: str = "uid"
) -> DataFrame:
    """Per task and declared pattern: number of matching outputs and whether there is one."""
    counts = outputs.groupBy(uid).agg(
        *[F.count_if(glob_match("path", p)).alias(f"_n{i}") for i, p in enumerate(patterns)]
    )
    found = [
        F.struct(F.lit(p).alias("pattern"), F.coalesce(f"_n{i}", F.lit(0)).alias("n"))
        for i, p in enumerate(patterns)
    ]
    joined = tasks.select(uid).join(counts, uid, "left")
    return joined.select(uid, F.inline(F.array(*found))).withColumn("ok", F.col("n") > 0)
