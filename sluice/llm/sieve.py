"""A bitmap of fixed size that tells which rows cannot have a partner in a join.

It lets rows through that have no partner, never the reverse, so it only saves shuffling. The
bits are gathered by Spark; what reaches the driver and the executors is at most ``BITS``.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 1 << 25


def sieve(keys: DataFrame, key: Column):
    """A function from a column of 64-bit hashes to "may be among ``keys``"."""
    spark = keys.sparkSession
    words = BITS // 64
    bit = keys.select(F.pmod(key, F.lit(BITS)).alias("_bit"))
    rows = (
        bit.groupBy(F.floor(F.col("_bit") / 64).cast("int").alias("word"))
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(_bit % 64 as int))")).alias("bits"))
        .toArrow()  # BITS / 64 rows at most
    )
    table = np.zeros(words, np.int64)
    table[rows["word"].to_numpy()] = rows["bits"].to_numpy()
    shared = spark.sparkContext.broadcast(table.view(np.uint64))

    @F.pandas_udf("boolean")
    def may_match(keys: pd.Series) -> pd.Series:
        bit = np.mod(keys.to_numpy(np.int64), BITS).astype(np.uint64)
        hit = shared.value[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63))
        return pd.Series((hit & np.uint64(1)).astype(bool))

    return may_match
