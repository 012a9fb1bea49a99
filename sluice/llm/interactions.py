"""How filters interact: forward-backward path counting over the lattice of filter sets.

A state of the lattice is the set of filters applied so far; an edge adds one filter. Every
order of the filters is one path from the empty to the full set, so the number of orders that
use an edge is (paths reaching its state) x (paths leaving its end). What an edge removes does
not depend on the order in which its state was reached. The documents are therefore read
once, into one count for each part and pattern of failures. Each edge is counted from those;
the Shapley value of a filter is the sum over its edges of removed x paths, and the steps of
each order are read from the same edges.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.session import materialize

#: Runs of characters that are no blank.
BLANKS = r"[\x20\x09-\x0D]+"


def path_counts(k: int) -> tuple[list[int], list[int]]:
    """For every state (a bit set of ``k`` filters): paths that reach it, paths that leave it."""
    states = 1 << k
    reach, leave = [0] * states, [0] * states
    reach[0] = leave[states - 1] = 1
    for state in range(states):
        for f in range(k):
            if not state >> f & 1:
                reach[state | 1 << f] += reach[state]
    for state in reversed(range(states)):
        for f in range(k):
            if not state >> f & 1:
                leave[state] += leave[state | 1 << f]
    return reach, leave


def failure_counts(rows: DataFrame, part: Column, fails: Mapping[str, Column], marks: Mapping[str, Column]) -> DataFrame:
    """``part``, ``mask``, ``n`` and the marked rows of each pattern of failures.

    Bit i of ``mask`` is set where the i-th condition is true; a null condition counts as not
    failed, a null mark as not marked. At most 2^filters rows for each part, combined before the shuffle.
    """
    mask = F.lit(0)
    for i, condition in enumerate(fails.values()):
        mask = mask + F.when(condition, 1 << i).otherwise(0)
    flagged = {name: F.when(mark, 1).otherwise(0) for name, mark in marks.items()}
    narrow = rows.select(part.alias("part"), mask.alias("mask"), *[c.alias(n) for n, c in flagged.items()])
    sums = [F.sum(n).cast("long").alias(n) for n in marks]
    return narrow.groupBy("part", "mask").agg(F.count(F.lit(1)).alias("n"), *sums)


def edge_counts(counts: DataFrame, names: Sequence[str], marks: Sequence[str] = ()) -> DataFrame:
    """One row per part and edge (``state``, ``filter``), zeros included.

    ``paths`` is the number of orders that use the edge; ``kept`` what is left after it,
    ``removed`` what it takes, ``redundant`` what fails its filter but was gone before,
    ``unique_fails`` what fails its filter only, and each mark counts removed marked rows.
    """
    k = len(names)
    reach, leave = path_counts(k)
    table = {e: (e // k, e % k) for e in range(k << k) if not e // k >> e % k & 1}
    edges = F.array(
        *[
            F.struct(
                F.lit(state).alias("state"), F.lit(f).alias("filter"), F.lit(1 << f).alias("bit"),
                F.lit(reach[state] * leave[state | 1 << f]).cast("long").alias("paths"),
            )
            for state, f in table.values()
        ]
    )
    spread = counts.select("part", "mask", "n", *marks, F.inline(edges))
    here = F.col("mask").bitwiseAND(F.col("state")) == 0
    fails = F.col("mask").bitwiseAND(F.col("bit")) != 0

    def total(value: str, when: Column, name: str) -> Column:
        return F.sum(F.when(when, F.col(value)).otherwise(0)).cast("long").alias(name)

    return spread.groupBy("part", "state", "filter", "paths").agg(
        total("n", here & ~fails, "kept"),
        total("n", here & fails, "removed"),
        total("n", ~here & fails, "redundant"),
        total("n", F.col("mask") == F.col("bit"), "unique_fails"),
        *[total(m, here & fails, m) for m in marks],
    )


def shapley_values(edges: DataFrame) -> DataFrame:
    """``part``, ``filter`` and what the filter removes, summed over all orders (not divided)."""
    weighted = F.sum(F.col("removed") * F.col("paths")).cast("long").alias("shapley")
    return edges.groupBy("part", "filter").agg(weighted)


def order_steps(edges: DataFrame, names: Sequence[str], marks: Sequence[str] = ()) -> DataFrame:
    """Every step of every order for every part, read from the edges, with Shapley values.

    The table of steps has (filters)! x filters rows whatever the data, so it is broadcast.
    """
    k = len(names)
    steps = []
    for order in permutations(range(k)):
        state, name = 0, "".join(names[f] for f in order)
        for step, f in enumerate(order, 1):
            steps.append((name, step, state, f))
            state |= 1 << f
    spark = edges.sparkSession
    table = spark.createDataFrame(steps, "filter_order string, step int, state int, filter int")
    edges = materialize(edges, "edges")
    values = shapley_values(edges)
    joined = edges.join(F.broadcast(table), ["state", "filter"]).join(values, ["part", "filter"])
    counted = ["kept", "removed", "redundant", "unique_fails", *marks, "shapley"]
    return joined.select("part", "filter_order", "step", *counted)


def with_earlier_copy(rows: DataFrame, id_col: str, digest_col: str, new: str) -> DataFrame:
    """Add ``new``: whether a row of a smaller id has the same digest.

    A null id is neither smaller nor larger. Only digests that occur twice are joined, and the
    smallest ids combine before the shuffle; adaptive execution splits a hot digest.
    """
    least = rows.groupBy(F.col(digest_col).alias("_same")).agg(
        F.min(id_col).alias("_least"), F.count(F.lit(1)).alias("_copies")
    )
    least = least.where("_copies > 1").select("_same", "_least")
    joined = rows.join(least, F.col(digest_col) == F.col("_same"), "left")
    return joined.withColumn(new, F.coalesce(F.col("_least") < F.col(id_col), F.lit(False))).drop("_same", "_least")


def audit_filters(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source"
) -> DataFrame:
    """The five text filters A-E over ``docs``: one row per part, order and step.

    A: under 200 words. B: 100 * distinct words < 50 * words. C: 100 * capitals A-Z > 2 * code
    points. D: holds one of ``#$%&*|``. E: the text of a smaller id, anywhere in the table, is
    identical. A null text is an empty one, a null part the empty string. ``good_lost`` and
    ``toxic_lost`` count removed rows whose id has a label ``quality`` = 1 or ``toxic`` = 1;
    several labels of one id count once. Repeated rows count each. An empty table has no
    part, hence no row. Other columns are not read, so their names do not matter.
    """
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    words = F.array_remove(F.split(text, BLANKS), "")
    measured = docs.select(
        F.col(f"`{id_col}`").alias("_id"),
        F.coalesce(F.col(f"`{part_col}`"), F.lit("")).alias("part"),
        F.size(words).alias("_words"),
        F.size(F.array_distinct(words)).alias("_distinct"),
        F.length(F.regexp_replace(text, "[^A-Z]+", "")).alias("_capitals"),
        F.length(text).alias("_points"),
        text.rlike("[#$%&*|]").alias("_symbol"),
        F.unhex(F.sha2(text, 256)).alias("_digest"),
    )
    hundred = F.lit(100).cast("long")
    tested = measured.select(
        "_id", "part", "_digest",
        (F.col("_words") < 200).alias("A"),
        (hundred * F.col("_distinct") < F.lit(50).cast("long") * F.col("_words")).alias("B"),
        (hundred * F.col("_capitals") > F.lit(2).cast("long") * F.col("_points")).alias("C"),
        F.col("_symbol").alias("D"),
    )
    tested = with_earlier_copy(materialize(tested, "tested"), "_id", "_digest", "E")
    marked = labels.groupBy(F.col("doc_id").alias("_of")).agg(
        F.max(F.col("quality") == 1).alias("good_lost"), F.max(F.col("toxic") == 1).alias("toxic_lost")
    )
    rows = tested.join(marked, F.col("_id") == F.col("_of"), "left")
    names, marks = list("ABCDE"), ["good_lost", "toxic_lost"]
    counts = failure_counts(rows, F.col("part"), {n: F.col(n) for n in names}, {m: F.col(m) for m in marks})
    return order_steps(edge_counts(counts, names, marks), names, marks)
