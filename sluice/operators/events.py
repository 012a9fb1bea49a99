"""Folds over the event log of task runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sluice.operators.skew import lookup, scan_before

CREATED = "STATUS_CREATED"
VALIDATED = "POST_VALIDATION"
CHUNK = 1000  # log entries put together in one row
INDENT = "  "


def status_aggregates():
    """The status fold as aggregates that combine partially, in batch and in streams."""
    known = F.when(F.col("status").isNotNull(), F.struct("seq", "status"))
    return [
        F.max(known)["status"].alias("status"),
        F.coalesce(F.bool_or(F.col("status") == VALIDATED), F.lit(False)).alias("validated"),
        F.count(F.lit(1)).alias("n_events"),
    ]


def fold_status(events: DataFrame) -> DataFrame:
    """Current status per task: the last event that changes it; others leave it alone."""
    return events.groupBy("uid").agg(*status_aggregates())


def transitions(events: DataFrame) -> DataFrame:
    """Every status change with the status before it."""
    changes = events.where("status is not null").select("uid", "seq", "status")
    return scan_before(changes, ["uid"], "seq", F.col("status"), "prev", "last")


def transition_counts(events: DataFrame) -> DataFrame:
    return transitions(events).groupBy("prev", "status").agg(F.count(F.lit(1)).alias("n"))


def concat_log(events: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """The log of each task and channel: every entry preceded by a newline.

    A log of up to ``chunk`` entries is one row. A longer one is several, in order of
    ``part``, so that no log, however long, has to fit in one value.
    """
    places = events.select("uid", "channel", "seq")
    places = scan_before(places, ["uid", "channel"], "seq", F.lit(1), "_n")
    places = places.withColumnsRenamed({"uid": "_u", "channel": "_c", "seq": "_s"})
    same = F.col("uid").eqNullSafe(F.col("_u")) & F.col("channel").eqNullSafe(F.col("_c"))
    numbered = events.join(places, same & (F.col("seq") == F.col("_s")))
    entries = F.array_sort(F.collect_list(F.struct("seq", "content")))
    lines = F.transform(entries, lambda e: F.concat(F.lit("\n"), e["content"]))
    return (
        numbered.groupBy("uid", "channel", F.floor(F.col("_n") / chunk).alias("part"))
        .agg(F.array_join(lines, "").alias("log"), F.count(F.lit(1)).alias("n_entries"))
    )


def last_n(events: DataFrame, n: int = 100, by: str = "uid", order: str = "seq") -> DataFrame:
    """The newest ``n`` events per task.

    The rank limit is applied before the shuffle as well, so a task with very many events
    sends at most ``n`` rows per input partition.
    """
    newest = Window.partitionBy(by).orderBy(F.col(order).desc())
    ranked = events.withColumn("_rank", F.row_number().over(newest))
    return ranked.where(f"_rank <= {int(n)}").drop("_rank")


def explode_lines(df: DataFrame, column: str, prefix: str, depth: int = 0) -> DataFrame:
    """One log entry per line of a chunk, prefixed and indented."""
    kept = [c for c in df.columns if c != column]
    head = F.lit(INDENT * depth + prefix)
    return df.select(*kept, F.posexplode(F.split(column, "\n")).alias("line_no", "_line")).select(
        *kept, "line_no", F.concat(head, "_line").alias("entry")
    )


def route(events: DataFrame, top_level: tuple[str, ...] = ("signup",)) -> DataFrame:
    """Where each action goes: ``create``, ``task``, or ``rejected`` with a reason.

    A task action is rejected without a uid, or before its task was created.
    """
    created = events.where(F.col("action").isin(*top_level)).groupBy("uid").agg(
        F.min("seq").alias("_created")
    )
    is_top = F.col("action").isin(*top_level)
    reason = (
        F.when(is_top, F.lit(None))
        .when(F.col("uid").isNull(), "no uid")
        .when(F.col("_created").isNull() | (F.col("_created") > F.col("seq")), "unknown uid")
    )
    joined = lookup(events, created, ["uid"], "left").withColumn("reason", reason)
    kind = F.when(is_top, "create").when(F.col("reason").isNotNull(), "rejected").otherwise("task")
    return joined.withColumn("route", kind).drop("_created")
