"""Building blocks that keep one hot key from landing in one task.

``scan_before``  running value over an ordered group, computed partition by partition
``ordinal``      position in a total order, from a range-partitioned sort
``lookup``       join of a large side to a side with few rows per key, hot keys salted
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sluice.operators import packed as codes
from sluice.session import bounded_bytes, materialize, plan_bytes

SALTS = 64  # pieces a hot key is cut into
HOT_SHARE = 0.001  # a key is hot from this share of the rows, so at most 1000 are
BROADCAST_BYTES = 8 << 20  # a side is broadcast only if it is known to be below this
SALT_FROM_BYTES = 4 << 30  # below this size adaptive execution alone is enough


def scan_before(
    df: DataFrame,
    group: Sequence[str],
    order: str,
    value: Column | Mapping[str, Column],
    out: str | None = None,
    how: str = "sum",
) -> DataFrame:
    """Add ``out``: the running ``sum`` or ``last`` non-null value strictly before each row.

    ``order`` is unique within its group. ``value`` may be several named columns, which are
    scanned together. Rows are range-partitioned by group and order, so a partition holds
    about as many rows as any other, however the order is spaced and however large a group
    is. Each partition is summarised on its own; per group there is one summary for each
    partition it lies in, and only those are scanned. All columns of ``df`` travel along:
    give narrow rows, and join wide ones by key.
    """
    values = value if isinstance(value, Mapping) else {out: value}
    group = list(group)
    keys = [*group, "_part"]
    rows = df.withColumns({f"_v{i}": v for i, v in enumerate(values.values())})
    ranged = rows.repartitionByRange(*group, order).sortWithinPartitions(*group, order)
    placed = materialize(ranged.withColumn("_at", F.monotonically_increasing_id()), "scan")
    placed = placed.withColumn("_part", F.shiftright("_at", 33))
    # without a group there is one row for each partition
    before = Window.partitionBy(*group).orderBy("_part") if group else Window.orderBy("_part")
    before = before.rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy(*keys).orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    totals, carried, here, result = [], [], {}, {}
    for i, name in enumerate(values):
        own = f"_v{i}"
        if how == "sum":
            totals.append(F.sum(own).alias(f"_t{i}"))
            carried.append(F.coalesce(F.sum(f"_t{i}").over(before), F.lit(0)).alias(f"_c{i}"))
            here[f"_h{i}"] = F.coalesce(F.sum(own).over(inside), F.lit(0))
            result[name] = F.col(f"_c{i}") + F.col(f"_h{i}")
        elif how == "last":
            newest = F.max(F.when(F.col(own).isNotNull(), F.struct("_at", own)))
            totals.append(newest.alias(f"_t{i}"))
            carried.append(F.last(f"_t{i}", ignorenulls=True).over(before)[own].alias(f"_c{i}"))
            here[f"_h{i}"] = F.last(own, ignorenulls=True).over(inside)
            result[name] = F.coalesce(f"_h{i}", f"_c{i}")
        else:
            raise ValueError(f"unknown scan {how!r}")
    blocks = placed.groupBy(*keys).agg(*totals).select(*keys, *carried)
    if not group:  # one row for each partition
        blocks = F.broadcast(blocks)
    marked = placed.withColumns(here)
    made = [c for i in range(len(values)) for c in (f"_v{i}", f"_c{i}", f"_h{i}")]
    for k in keys:
        blocks = blocks.withColumnRenamed(k, f"_of_{k}")
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in keys])
    joined = marked.join(blocks, same, "left").withColumns(result)
    return joined.drop(*made, *[f"_of_{k}" for k in keys], "_at", "_part")


def ordinal(df: DataFrame, keys: Sequence[str], out: str = "ordinal") -> DataFrame:
    """Add ``out``: the 0-based position of each row in the total order of ``keys``.

    ``keys`` must identify a row. Rows are range-partitioned and sorted once, so a hot
    prefix of the key spreads over partitions; only partition sizes are scanned.
    """
    ranged = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    placed = materialize(ranged.withColumn("_at", F.monotonically_increasing_id()), "ordinal")
    part = F.shiftright("_at", 33)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        placed.groupBy(part.alias("_part"))
        .agg(F.count(F.lit(1)).alias("_n"))
        .select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    )
    # one row per shuffle partition, so the broadcast is bounded by the partition count
    return (
        placed.withColumn("_part", part)
        .join(F.broadcast(starts), "_part")
        .withColumn(out, F.col("_start") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)))
        .drop("_part", "_at", "_start")
    )


def join_reads(reads: DataFrame, other: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """Join of reads, whose ``seq`` travels in two bits a base."""
    return restored(shrunk(reads).join(other, list(on), how))


def shrunk(df: DataFrame) -> DataFrame:
    """``seq``, if there is one, in two bits a base, for a shuffle; :func:`restored` spells it again."""
    if dict(df.dtypes).get("seq") != "string":
        return df
    return df.withColumn("seq", F.arrow_udf(codes.shrunk, "binary")("seq"))


def restored(df: DataFrame) -> DataFrame:
    if dict(df.dtypes).get("seq") != "binary":
        return df
    return df.withColumn("seq", F.arrow_udf(codes.restored, "string")("seq"))


def hot_hashes(df: DataFrame, on: Sequence[str], share: float = HOT_SHARE) -> list[int]:
    """Hashes of every key that may hold more than ``share`` of the rows (at most 1/share)."""
    hashes = df.select(F.xxhash64(*on).alias("h"))
    return list(hashes.stat.freqItems(["h"], share).first()[0])


def lookup(
    big: DataFrame,
    small: DataFrame,
    on: Sequence[str],
    how: str = "inner",
    salt: bool | None = None,
    share: float = HOT_SHARE,
) -> DataFrame:
    """Join ``big`` to ``small``, which holds few rows per key, spreading big's hot keys.

    A ``small`` side of proven size is broadcast. Otherwise both sides are shuffled, as a
    sort-merge join, which spills and which adaptive execution splits where it is skewed.
    For a large ``big`` hot keys are found beforehand, in one bounded-memory pass. Their
    rows get one of ``SALTS`` salts and the matching rows of ``small`` are copied once per
    salt. The hash of the key decides on both sides, so a false alarm costs copies, never
    results.
    """
    on = list(on)
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"cannot salt a {how} join")
    size = bounded_bytes(small)
    if not salt and size is not None and size <= BROADCAST_BYTES:
        return big.join(F.broadcast(small), on, how)
    if salt is None:
        salt = plan_bytes(big) > SALT_FROM_BYTES
    hot = hot_hashes(big, on, share) if salt else []
    small = small.hint("merge")
    if not hot:
        return big.join(small, on, how)
    is_hot = F.xxhash64(*on).isin(hot)
    spread = F.pmod(F.xxhash64(*big.columns), F.lit(SALTS)).cast("int")
    copies = F.when(is_hot, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    left = big.withColumn("_salt", F.when(is_hot, spread).otherwise(F.lit(0)))
    right = small.withColumn("_salt", F.explode(copies)).hint("merge")
    return left.join(right, [*on, "_salt"], how).drop("_salt")
