"""Connected components of an edge table by hooking and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.session import bounded_bytes, materialize

#: Stored bytes of edges for one file of a round, some million edges.
FILE_BYTES = 8 << 20


def _by_size(rows: DataFrame, size: int | None) -> DataFrame:
    """Rows made from ``size`` stored bytes of edges, in as many files as these need.

    On a local disk Hadoop starts some three processes for each file (``chmod``), so few rows
    are not written in as many files as a shuffle has partitions.
    """
    if size is None:
        return rows
    files = max(rows.sparkSession.sparkContext.defaultParallelism, -(-size // FILE_BYTES))
    return rows.coalesce(min(files, 1 << 20))


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node`` and ``label``, the smallest node reachable, for every node of an edge.

    Each round takes the smallest label among the neighbours, then the label of that label, so
    the number of rounds grows with the logarithm of the longest path, not with the path. Every
    round is written to the shared folder. Sums per node combine before the shuffle, and a node
    with very many edges is split by adaptive execution.
    """
    known = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a != b")
    both = materialize(_by_size(known.union(known.select("b", "a")).distinct(), bounded_bytes(edges)), "edges")
    size = bounded_bytes(both)
    labels = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("label"))
    labels = materialize(_by_size(labels.withColumn("label", F.least("node", "label")), size), "labels")
    while True:
        near = (
            both.join(labels, both.b == labels.node)
            .groupBy("a")
            .agg(F.min("label").alias("near"))
        )
        hooked = labels.join(near, labels.node == near.a).select(
            "node", F.col("label").alias("before"), F.least("label", "near").alias("label")
        )
        jump = labels.select(F.col("node").alias("_to"), F.col("label").alias("_further"))
        jumped = hooked.join(jump, hooked.label == jump["_to"], "left").select(
            "node", "before", F.least("label", "_further").alias("label")
        )
        stored = materialize(_by_size(jumped, size), "labels")
        labels = stored.select("node", "label")
        if stored.where("label != before").isEmpty():
            return labels
