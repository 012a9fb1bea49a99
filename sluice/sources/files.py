"""File datasets: globs, manifests, nested specs, ordered concatenation, graph output."""

from __future__ import annotations

import subprocess
import threading
from collections.abc import Callable, Mapping, Sequence
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.functions.globs import glob_match, glob_match_any
from sluice.functions.text import count_newlines
from sluice.operators.skew import lookup, scan_before

# S1, S6, S7, S8, S10: files

#: Spark's own limit of a binary value.
HASHED_BYTES = (1 << 31) - 1


def glob_scan(spark: SparkSession, pattern: str, fmt: str = "text", **options) -> DataFrame:
    """Rows of every file matching ``pattern``, with the file's path in ``file``.

    ``a/b/**/name`` reads below ``a/b`` recursively and filters on the name. Paths are as
    written, not as URLs: a blank is a blank.
    """
    escaped = F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B"))
    path = F.url_decode(escaped)
    reader = spark.read.format(fmt).options(**options)
    if "**" in pattern:
        base, _, rest = pattern.partition("**")
        reader = reader.option("recursiveFileLookup", "true")
        reader = reader.option("pathGlobFilter", rest.rsplit("/", 1)[-1] or "*")
        found = reader.load(base or ".")
        if rest.strip("/").count("/"):
            found = found.where(glob_match(path, f"**{pattern}"))
    else:
        found = reader.load(pattern)
    return found.withColumn("file", path)


def manifest(spark: SparkSession, pattern: str) -> DataFrame:
    """Path, size, time and content hash of every file matching ``pattern``.

    A file is hashed as one value. One of ``HASHED_BYTES`` or more does not fit a value: it is
    listed with a null hash, so it counts as changed, and its content is not read.
    """
    listed = [F.col("length").alias("size"), F.col("modificationTime").alias("mtime")]
    files = glob_scan(spark, pattern, "binaryFile")
    small = files.where(F.col("length") < HASHED_BYTES)
    large = files.where(F.col("length") >= HASHED_BYTES)
    return small.select("path", *listed, F.sha2("content", 256).alias("content_hash")).unionByName(
        large.select("path", *listed, F.lit(None).cast("string").alias("content_hash"))
    )


def decompress(spark: SparkSession, pattern: str, out: str) -> DataFrame:
    """Write the lines of compressed text files as plain text."""
    spark.read.text(pattern, lineSep="\n").write.text(out, lineSep="\n")
    return spark.read.text(out, lineSep="\n")


def append(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    df.write.format(fmt).mode("append").save(path)


def per_file(df: DataFrame, key: str, **aggregates) -> DataFrame:
    """The same summary for each file, results kept apart."""
    return df.groupBy(key).agg(*[value.alias(name) for name, value in aggregates.items()])


# S1-S4 on a listing


def glob_filter(df: DataFrame, pattern: str, path: str = "path") -> DataFrame:
    return df.where(glob_match(path, pattern))


def expect_matches(
    df: DataFrame,
    patterns: Mapping[str, Any] | Sequence[str],
    path: str = "path",
) -> DataFrame:
    """``(pattern, n, ok)`` per pattern, counted in one pass.

    The expectation of a pattern is a number of matches, ``None`` for at least one, or a
    function from the count to a boolean column. A bare list of patterns expects one each.
    """
    if not isinstance(patterns, Mapping):
        patterns = {p: 1 for p in patterns}
    counts = df.agg(
        *[F.count_if(glob_match(path, p)).alias(f"n{i}") for i, p in enumerate(patterns)]
    )

    def verdict(n, expected):
        if expected is None:
            return n > 0
        return expected(n) if callable(expected) else n == expected

    checked = [
        F.struct(
            F.lit(p).alias("pattern"),
            F.col(f"n{i}").alias("n"),
            verdict(F.col(f"n{i}"), expected).alias("ok"),
        )
        for i, (p, expected) in enumerate(patterns.items())
    ]
    return counts.select(F.inline(F.array(*checked)))


def map_spec(spec: Any, fn: Callable[[str], Any]) -> Any:
    """Apply ``fn`` to every string of a nested list/dict spec, keeping its shape."""
    if isinstance(spec, str):
        return fn(spec)
    if isinstance(spec, Mapping):
        return {key: map_spec(value, fn) for key, value in spec.items()}
    if isinstance(spec, (list, tuple)):
        return [map_spec(value, fn) for value in spec]
    raise TypeError(f"a spec holds strings, lists and dicts, not {type(spec).__name__}")


def spec_leaves(spec: Any, at: str = "") -> dict[str, str]:
    """Leaves of a spec by their place, such as ``reads[0]`` or ``index.file``."""
    if isinstance(spec, str):
        return {at: spec}
    if isinstance(spec, Mapping):
        inner = [(f"{at}.{key}" if at else str(key), value) for key, value in spec.items()]
    elif isinstance(spec, (list, tuple)):
        inner = [(f"{at}[{i}]", value) for i, value in enumerate(spec)]
    else:
        raise TypeError(f"a spec holds strings, lists and dicts, not {type(spec).__name__}")
    return {place: pattern for key, value in inner for place, pattern in spec_leaves(value, key).items()}


def resolve_spec(df: DataFrame, spec: Any, path: str = "path") -> DataFrame:
    """``(leaf, path)`` for every file each leaf of the spec matches, in one pass."""
    found = [
        F.when(glob_match(path, pattern), F.lit(place))
        for place, pattern in spec_leaves(spec).items()
    ]
    return df.select(F.explode(F.array_compact(F.array(*found))).alias("leaf"), path)


def unresolved_leaves(df: DataFrame, spec: Any, path: str = "path") -> DataFrame:
    """Leaves that match nothing; a spec is resolved only if there are none."""
    places = spec_leaves(spec)
    counts = expect_matches(df, {p: None for p in places.values()}, path)
    pattern_of = F.create_map(*[F.lit(x) for kv in places.items() for x in kv])
    return counts.where("not ok").select(
        F.explode(F.map_keys(F.map_filter(pattern_of, lambda _, p: p == F.col("pattern")))).alias(
            "leaf"
        ),
        "pattern",
    )


def resolve_upstream(
    outputs: DataFrame,
    patterns: Sequence[str],
    run: str = "run_id",
    pos: str = "pos",
    uid: str = "uid",
    path: str = "path",
    fallback: DataFrame | None = None,
) -> DataFrame:
    """For every step of every run, the nearest earlier output matching each pattern.

    A pattern may match the file name or the whole path. Steps without an upstream match
    take the first matching path of ``fallback``, or null. One row per step and pattern.
    """
    hits = {
        f"_hit{i}": F.when(glob_match_any(path, pattern), F.col(path))
        for i, pattern in enumerate(patterns)
    }
    found = scan_before(outputs.select(run, pos, uid, path), [run], pos, hits, how="last")
    rows = found.select(
        run,
        uid,
        F.inline(
            F.array(
                *[
                    F.struct(F.lit(p).alias("pattern"), F.col(f"_hit{i}").alias("resolved"))
                    for i, p in enumerate(patterns)
                ]
            )
        ),
    )
    if fallback is None:
        return rows
    firsts = fallback.agg(
        *[
            F.min(F.when(glob_match_any(path, p), F.col(path))).alias(f"_first{i}")
            for i, p in enumerate(patterns)
        ]
    ).select(
        F.inline(
            F.array(
                *[
                    F.struct(F.lit(p).alias("pattern"), F.col(f"_first{i}").alias("_first"))
                    for i, p in enumerate(patterns)
                ]
            )
        )
    )
    # one row per pattern of the call
    return rows.join(F.broadcast(firsts), "pattern", "left").select(
        run, uid, "pattern", F.coalesce("resolved", "_first").alias("resolved")
    )


def resolve_trajectory(
    requests: DataFrame, outputs: DataFrame, pattern: str, fallback: str | None = None
) -> DataFrame:
    """Resolve ``pattern`` for ``requests(request, trajectory)`` with explicit lineages."""
    steps = requests.select("request", F.posexplode("trajectory").alias("at", "uid"))
    hits = outputs.where(glob_match_any("path", pattern)).groupBy("uid").agg(
        F.min("path").alias("path")
    )
    nearest = (
        lookup(steps, hits, ["uid"])  # a shared ancestor is a hot key
        .groupBy("request")
        .agg(F.max_by("path", "at").alias("resolved"))
    )
    return requests.join(nearest, "request", "left").select(
        "request", F.coalesce("resolved", F.lit(fallback)).alias("resolved")
    )


# S5: ordered concatenation


def concat_files(df: DataFrame, order: str, text: str = "text") -> DataFrame:
    """All lines of all files, numbered through in file order as one dataset.

    ``order`` is unique per file. Only line counts are scanned; a text moves once, to meet its
    start by key.
    """
    counts = df.select(order, (count_newlines(text) + 1).alias("_lines"))
    starts = scan_before(counts, [], order, F.col("_lines"), "_start").select(order, "_start")
    return lookup(df.select(order, text), starts, [order]).select(
        order, "_start", F.posexplode(F.split(text, "\n")).alias("line_no", "line")
    ).select((F.col("_start") + F.col("line_no")).alias("out_no"), order, "line")


# T2: external commands


def pipe_command(df: DataFrame, commands: str | Sequence[str], column: str = "line") -> DataFrame:
    """Feed the lines of a column to a shell command, or a chain of them, per partition.

    Each output line is a row. A null line is not sent. A command that fails anywhere in the
    chain fails the job. A partition is written and read in blocks by two threads.
    """
    chained = commands if isinstance(commands, str) else " | ".join(commands)
    shell = ["bash", "-o", "pipefail", "-c", chained]

    def talk(batches):
        run = subprocess.Popen(shell, stdin=subprocess.PIPE, stdout=subprocess.PIPE)

        def feed():
            try:
                for batch in batches:
                    lines = [line for line in batch.column(0).to_pylist() if line is not None]
                    if lines:
                        run.stdin.write(("\n".join(lines) + "\n").encode("utf-8"))
                run.stdin.close()
            except BrokenPipeError:  # a command such as head may stop reading
                run.stdin = None

        writer = threading.Thread(target=feed)
        writer.start()
        rest = b""
        while block := run.stdout.read1(1 << 20):
            *lines, rest = (rest + block).split(b"\n")
            if lines:
                texts = [line.decode("utf-8") for line in lines]
                yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], names=[column])
        if rest:
            yield pa.RecordBatch.from_arrays([pa.array([rest.decode("utf-8")], pa.string())], names=[column])
        writer.join()
        if run.wait():
            raise RuntimeError(f"{chained!r} ended with {run.returncode}")

    return df.select(column).mapInArrow(talk, f"{column} string")


# T3: batches


def map_batches(df: DataFrame, fn: Callable, schema: str) -> DataFrame:
    """Apply ``fn`` to each Arrow record batch."""

    def each(batches):
        for batch in batches:
            yield fn(batch)

    return df.mapInArrow(each, schema)
