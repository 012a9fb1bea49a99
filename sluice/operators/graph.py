"""Provenance graphs as ``vertices`` and ``edges(src, dst)`` tables."""

from __future__ import annotations

import itertools
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.operators.fingerprints import group_uid
from sluice.operators.skew import lookup, scan_before
from sluice.session import UNKNOWN, materialize, plan_bytes

TASK_BYTES = 1 << 20  # estimated bytes of vertices and edges that one task compares
MOST_TASKS = 20_000  # tasks that an estimate asks for at most
# The frame of the exported graph document.
GRAPH_OPEN = '{"graph":{"mode":"NORMAL","vertices":['
GRAPH_MIDDLE = '],"edges":['
GRAPH_CLOSE = "]}}"


def build_edges(tasks: DataFrame, run: str = "run_id", pos: str = "pos") -> DataFrame:
    """An edge from the previous step of a run to each step; none into its first."""
    linked = scan_before(tasks.select(run, pos, "uid"), [run], pos, F.col("uid"), "src", "last")
    return linked.where("src is not null").select(run, "src", F.col("uid").alias("dst"))


def trajectory_edges(tasks: DataFrame) -> DataFrame:
    """Edges of ``tasks(uid, trajectory)``: from the last trajectory entry to the task."""
    last = F.try_element_at("trajectory", F.lit(-1))
    return tasks.select(last.alias("src"), F.col("uid").alias("dst")).where("src is not null")


def add_junction(
    tasks: DataFrame,
    members: Sequence[str],
    run: str = "run_id",
    member: str = "name",
    pos: str = "pos",
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Junction of the named members per run: ``(vertices, contents, edges)``.

    The uid of a junction is that of the last steps of its members in the given order.
    What its members hold stays a table of rows, and each last step points to it.
    """
    place = F.array_position(F.array(*map(F.lit, members)), F.col(member)) - 1
    tasks = tasks.where(F.col(member).isin(*members))
    lasts = tasks.groupBy(run, member).agg(F.max_by("uid", pos).alias("src"))
    vertices = group_uid(lasts.withColumn("_at", place), [run], "_at", "src").select(
        run, F.col("group_uid").alias("uid"), F.lit("junction").alias("kind")
    )
    dst = vertices.select(run, F.col("uid").alias("dst"))
    edges = lookup(lasts, dst, [run]).select(run, "src", "dst")
    contents = lookup(tasks.select(run, member, pos, "uid"), dst, [run])
    return vertices, contents, edges


def _without(vertices: DataFrame, edges: DataFrame, end: str) -> DataFrame:
    """The vertices that are not at this end of any edge.

    Both sides are dealt to a number of tasks that follows their size: adaptive execution would
    put shuffled rows together by their packed size, many times less than what a sort holds.
    """
    size = plan_bytes(vertices) + plan_bytes(edges)
    by_size = min(size // TASK_BYTES, MOST_TASKS) if size < UNKNOWN else 0
    tasks = max(int(vertices.sparkSession.conf.get("spark.sql.shuffle.partitions")), by_size)
    there = edges.select(F.col(end).alias("uid")).repartition(tasks, "uid").distinct()
    return vertices.repartition(tasks, "uid").join(there.hint("merge"), "uid", "left_anti")


def sources(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    return _without(vertices, edges, "dst")


def sinks(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    return _without(vertices, edges, "src")


def degrees(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """In- and out-degree of every vertex."""
    ends = edges.select(
        F.inline(
            F.array(
                F.struct(F.col("src").alias("uid"), F.lit(0).alias("_in"), F.lit(1).alias("_out")),
                F.struct(F.col("dst").alias("uid"), F.lit(1).alias("_in"), F.lit(0).alias("_out")),
            )
        )
    )
    lone = vertices.select("uid", F.lit(0).alias("_in"), F.lit(0).alias("_out"))
    return (
        ends.unionByName(lone)
        .groupBy("uid")
        .agg(F.sum("_in").alias("in_degree"), F.sum("_out").alias("out_degree"))
    )


def graph_stats(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: vertices, edges, sources, sinks and the largest degrees."""
    return degrees(vertices, edges).agg(
        F.count(F.lit(1)).alias("n_vertices"),
        F.sum("out_degree").alias("n_edges"),
        F.count_if(F.col("in_degree") == 0).alias("n_sources"),
        F.count_if(F.col("out_degree") == 0).alias("n_sinks"),
        F.max("in_degree").alias("max_in"),
        F.max("out_degree").alias("max_out"),
    )


def descendants(
    vertices: DataFrame,
    edges: DataFrame,
    max_depth: int | None = None,
    distinct: bool = False,
    roots: DataFrame | None = None,
) -> DataFrame:
    """Everything below each root: ``(root, node, depth, path)``, shared nodes per path.

    Levels are walked one by one, each stored so that the plan stays short. The edges
    keep their place and the frontier comes to them, with hot parents salted. With
    ``distinct`` a node is listed once per root, at its smallest depth and first path;
    this mode also ends on cycles. Without it every path is listed, and a cycle never ends; a
    path longer than ``max_depth``, if one is given, is an error.
    """
    tops = (sources(vertices, edges) if roots is None else roots).select("uid")
    steps = edges.select("src", "dst")
    level = materialize(
        tops.select(
            F.col("uid").alias("root"),
            F.col("uid").alias("node"),
            F.lit(0).alias("depth"),
            F.array("uid").alias("path"),
        ),
        "level",
    )
    found = [level]
    for depth in itertools.count(1):
        here = level.select("root", F.col("node").alias("src"), "path")
        below = lookup(steps, here, ["src"]).select(
            "root",
            F.col("dst").alias("node"),
            F.lit(depth).alias("depth"),
            F.concat("path", F.array("dst")).alias("path"),
        )
        if distinct:
            below = below.groupBy("root", "node", "depth").agg(F.min("path").alias("path"))
            seen = reduce(DataFrame.unionByName, found).select("root", "node")
            below = below.join(seen, ["root", "node"], "left_anti").select(level.columns)
        level = materialize(below, "level")
        if level.isEmpty():
            return reduce(DataFrame.unionByName, found)
        if max_depth is not None and depth > max_depth:
            raise ValueError(f"a path is longer than {max_depth} steps")
        found.append(level)
    return reduce(DataFrame.unionByName, found)


def ancestors(edges: DataFrame, targets: DataFrame, max_depth: int | None = None) -> DataFrame:
    """Everything above each of the given targets: ``(node, ancestor, distance)``.

    The walk starts from the targets alone and doubles its reach: a round joins what was found
    with the jumps of twice the length of the round before, so a path of n steps takes about
    log2(n) rounds. An ancestor reached over several paths is listed at its smallest distance. The
    walk ends when a round finds nothing new, on cycles as well.
    """
    up = edges.select(F.col("dst").alias("at"), F.col("src").alias("above")).distinct()
    jump, reach = materialize(up, "jump"), 1
    starts = targets.select(F.col("uid").alias("node")).distinct()
    first = lookup(starts.withColumn("at", F.col("node")), jump, ["at"])
    found = first.select("node", F.col("above").alias("at"), F.lit(1).alias("distance"))
    found = materialize(found, "found")
    while not jump.isEmpty():
        farther = lookup(found, jump, ["at"])
        farther = farther.select("node", F.col("above").alias("at"), (F.col("distance") + reach).alias("distance"))
        least = found.union(farther).groupBy("node", "at").agg(F.min("distance").alias("distance"))
        known, found = found, materialize(least, "found")
        if max_depth is not None and not found.where(F.col("distance") > max_depth).isEmpty():
            raise ValueError(f"a path is longer than {max_depth} steps")
        if found.count() == known.count():
            break
        half = jump.select(F.col("at").alias("_from"), F.col("above").alias("at"))
        jump = lookup(half, jump, ["at"]).select(F.col("_from").alias("at"), "above").distinct()
        jump, reach = materialize(jump, "jump"), 2 * reach
    return found.select("node", F.col("at").alias("ancestor"), "distance")


def leaf_paths(vertices: DataFrame, edges: DataFrame, max_depth: int | None = None) -> DataFrame:
    """The path from a root to every leaf: ``(leaf, path)``."""
    walked = descendants(vertices, edges, max_depth)
    parents = edges.select(F.col("src").alias("node")).distinct()
    return walked.join(parents, "node", "left_anti").select(F.col("node").alias("leaf"), "path")


def final_outputs(tasks: DataFrame, run: str = "run_id", pos: str = "pos") -> DataFrame:
    """The last step of each run."""
    last = F.max_by(F.struct(pos, "name", "uid"), pos)
    return tasks.groupBy(run).agg(last.alias("_last")).select(run, "_last.*")


def leaf_outputs(paths: DataFrame, outputs: DataFrame, path: str = "path", uid: str = "uid") -> DataFrame:
    """The outputs of the last vertex of each path: what a user reads at every leaf of a fork.

    ``paths`` are lineages, as of ``leaf_paths`` or ``run(lineage=True)``; paths that end at the
    same vertex (a junction) read the same outputs. A leaf without an output has nulls.
    """
    ended = paths.withColumn(uid, F.element_at(path, -1))
    return lookup(ended, outputs, [uid], how="left")


def graph_to_json(vertices: DataFrame, edges: DataFrame, run: str = "run_id") -> DataFrame:
    """The graph of each run as lines of one JSON document: ``(run, part, key, line)``.

    The lines of a run, sorted by ``part`` and ``key`` and put together, are the document.
    A graph of any size is written this way without being gathered anywhere.
    """
    nodes = vertices.select(
        run,
        F.lit(1).alias("part"),
        F.col("uid").alias("key"),
        F.to_json(
            F.struct(
                F.col("uid").alias("_id"),
                F.lit("vertex").alias("_type"),
                F.struct(*[c for c in vertices.columns if c not in (run, "uid")]).alias("values"),
            )
        ).alias("line"),
    )
    links = edges.select(
        run,
        F.lit(3).alias("part"),
        F.concat("src", F.lit(">"), "dst").alias("key"),
        F.to_json(
            F.struct(
                F.col("src").alias("source"),
                F.col("dst").alias("target"),
                F.lit("edge").alias("_type"),
            )
        ).alias("line"),
    )
    items = nodes.unionByName(links)
    first = items.groupBy(run, "part").agg(F.min("key").alias("_first"))
    comma = F.when(F.col("key") == F.col("_first"), "").otherwise(",")
    listed = lookup(items, first, [run, "part"]).select(
        run, "part", "key", F.concat(comma, "line").alias("line")
    )
    frame = vertices.select(run).distinct().select(
        run,
        F.inline(
            F.array(
                *[
                    F.struct(F.lit(part).alias("part"), F.lit("").alias("key"), F.lit(text).alias("line"))
                    for part, text in ((0, GRAPH_OPEN), (2, GRAPH_MIDDLE), (4, GRAPH_CLOSE))
                ]
            )
        ),
    )
    return frame.unionByName(listed)


def write_graphs(lines: DataFrame, path: str, run: str = "run_id") -> None:
    """Write the document of each run as one file below ``path/run=...``.

    A file has one writer, which streams the sorted lines of its run.
    """
    ordered = lines.repartition(run).sortWithinPartitions(run, "part", "key")
    ordered.select(run, F.col("line").alias("value")).write.partitionBy(run).text(path, lineSep="\n")
