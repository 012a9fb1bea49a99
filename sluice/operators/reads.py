"""Jobs on sequencing reads ``(read_id, mate, seq, qual)``."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sluice.functions.bases import fuzzy_regex, reverse_complement
from sluice.functions.rows import once
from sluice.operators.skew import ordinal


def read_fasta(spark: SparkSession, pattern: str) -> DataFrame:
    """Records of FASTA files: a line that begins with ``>`` names a sequence, the rest is joined.

    A ``>`` inside a header belongs to the header.
    """
    records = spark.read.text(pattern, lineSep="\n>").where("trim(value) not in ('', '>')")
    body = F.regexp_replace("value", r"^[^\n]*\n?", "")
    return records.select(
        F.regexp_extract("value", r"^>?(\S*)", 1).alias("contig"),
        F.regexp_replace(body, r"\s", "").alias("seq"),
    )


def to_fasta(contigs: DataFrame, width: int = 60) -> DataFrame:
    """Sequences as FASTA lines of ``width`` bases, one text value per record."""
    wrapped = F.regexp_replace("seq", f"(.{{{width}}})(?=.)", "$1\n")
    return contigs.select(F.concat(F.lit(">"), "contig", F.lit("\n"), wrapped).alias("value"))


def split_mates(reads: DataFrame) -> dict[int, DataFrame]:
    """The two mate datasets of one accession."""
    return {mate: reads.where(F.col("mate") == mate) for mate in (1, 2)}


def write_mates(reads: DataFrame, path: str) -> None:
    """One folder for each mate. A task keeps both files open, so that the reads are not sorted, which would spill them."""
    conf, name = reads.sparkSession.conf, "spark.sql.maxConcurrentOutputFileWriters"
    before = conf.get(name)
    conf.set(name, max(int(before), 4))  # past these, Spark sorts what is left
    try:
        reads.write.partitionBy("mate").parquet(path, compression="zstd")
    finally:
        conf.set(name, before)


def interleave(first: DataFrame, second: DataFrame) -> DataFrame:
    """Both mates of each pair in turn; ``slot`` is the place in the merged dataset."""
    return ordinal(first.unionByName(second), ["read_id", "mate"], "slot")


def _good_part(leading: int, trailing: int, width: int, mean: int):
    """Where the kept part of each read begins (1-based) and its length, by its quality values."""

    def first_from(at: np.ndarray, start: np.ndarray, none: int) -> np.ndarray:
        """The first of the sorted places ``at`` that is not before ``start``."""
        return np.r_[at, none][np.searchsorted(at, start)]

    def part(qual: pa.Array) -> pa.Array:
        bounds = qual.offsets.to_numpy().astype(np.int64)
        values = qual.values.slice(bounds[0], bounds[-1] - bounds[0])
        bounds = bounds - bounds[0]
        begin, end = bounds[:-1], bounds[1:]
        known = values.is_valid().to_numpy(zero_copy_only=False)
        q = pc.fill_null(values, 0).to_numpy(zero_copy_only=False)
        if q.dtype.kind in "iu":  # sums of bytes need more than a byte
            q = q.astype(np.int64 if q.dtype.itemsize > 2 else np.int32)
        head = first_from(np.flatnonzero(known & ~(q < leading)), begin, len(q))
        head = np.where(head < end, head, end)
        good = np.flatnonzero(known & ~(q < trailing))
        tail = np.r_[-1, good][np.searchsorted(good, end)] + 1
        tail = np.maximum(np.where(tail > begin, tail, begin), head)
        n = max(len(q) - max(width, 1) + 1, 0)
        total, whole = q[:n].copy(), known[:n].copy()
        for step in range(1, width):
            total += q[step : n + step]
            whole &= known[step : n + step]
        low = first_from(np.flatnonzero(whole & (total < width * mean)), head, len(q))
        stop = np.where(low + max(width, 1) <= tail, low, tail)
        found = [pa.array((x).astype(np.int32)) for x in (head - begin + 1, stop - head)]
        return pa.StructArray.from_arrays(found, names=["from", "len"], mask=qual.is_null())

    return part


def quality_trim(
    reads: DataFrame,
    leading: int = 3,
    trailing: int = 3,
    window: tuple[int, int] = (4, 20),
    minlen: int = 36,
) -> DataFrame:
    """Trim by quality, in this order: bad start, bad end, first bad window, short reads.

    The read is cut exactly at the start of the first window whose mean is too low.
    """
    ends = reads.select("*", F.arrow_udf(_good_part(leading, trailing, *window), "from int, len int")("qual").alias("_part"))
    cut = once(ends, _from=F.col("_part.from"), _len=F.col("_part.len"))
    return cut.where(F.col("_len") >= minlen).select(
        *[c for c in reads.columns if c not in ("seq", "qual")],
        F.col("seq").substr(F.col("_from"), F.col("_len")).alias("seq"),
        F.slice("qual", F.col("_from"), F.col("_len")).alias("qual"),
    )


def adapter_clip(
    reads: DataFrame, adapters: Sequence[str], mismatches: int = 2, seed: int = 16
) -> DataFrame:
    """Cut a read at the first place an adapter's seed matches with few mismatches.

    The adapters are part of the pattern, so nothing is joined and no pair is formed.
    Matching of both mates against each other is not done.
    """
    pattern = "|".join(fuzzy_regex(a[:seed], mismatches) for a in adapters)
    at = F.regexp_instr("seq", F.lit(pattern))
    clipped = once(reads, _at=at)
    end = F.when(F.col("_at") > 0, F.col("_at") - 1).otherwise(F.length("seq"))
    columns = {"seq": F.col("seq").substr(F.lit(1), end)}
    if "qual" in reads.columns:
        columns["qual"] = F.slice("qual", F.lit(1), end)
    return clipped.withColumns(columns).withColumnRenamed("_at", "clip_at")


def _longest_meeting(least: int):
    """The most letters, ``least`` or more and not all of either, that begin one text and end the other."""

    def longest(begins: pa.Array, ends: pa.Array) -> pa.Array:
        found = []
        for x, y in zip(begins.to_pylist(), ends.to_pylist(), strict=True):
            at = -1
            if x is not None and y is not None and min(len(x), len(y)) > least:
                head, at = x[:least], y.find(x[:least], max(1, len(y) - len(x) + 1))
                while at >= 0 and not x.startswith(y[at:]):
                    at = y.find(head, at + 1)
            found.append(len(y) - at if at >= 0 and len(y) - at >= least else None)
        return pa.array(found, pa.int32())

    return longest


def palindrome_clip(reads: DataFrame, min_overlap: int = 16) -> DataFrame:
    """Cut both mates where they read through their fragment, and add its length, ``fragment``.

    A fragment shorter than its reads shows as a beginning of mate 1 that is, reverse
    complemented, the beginning of mate 2; what follows in either is adapter, whatever its
    letters. The longest such beginning of ``min_overlap`` bases or more that is shorter than
    both mates counts, and has to match exactly. ``fragment`` is null where there is none, or
    no other mate; such reads stay as they are. Reads are shuffled once, by pair.
    """
    pair = Window.partitionBy("read_id")
    sides = {f"_seq{m}": F.max(F.when(F.col("mate") == m, F.col("seq"))).over(pair) for m in (1, 2)}
    pairs = reads.withColumns(sides).withColumn("_other", reverse_complement("_seq2"))
    found = pairs.withColumn("fragment", F.arrow_udf(_longest_meeting(min_overlap), "int")("_seq1", "_other"))
    end = F.coalesce("fragment", F.length("seq"))
    columns = {"seq": F.col("seq").substr(F.lit(1), end)}
    if "qual" in reads.columns:
        columns["qual"] = F.slice("qual", F.lit(1), F.least(end, F.size("qual")))
    return found.withColumns(columns).drop("_seq1", "_seq2", "_other")


def paired_split(trimmed: DataFrame) -> DataFrame:
    """Add ``output``: ``paired`` if both mates survived, else ``single``.

    A group is the at most two mates of one read, so the trimmed reads are computed and
    shuffled once.
    """
    mates = F.count(F.lit(1)).over(Window.partitionBy("read_id"))
    return trimmed.withColumn("output", F.when(mates == 2, "paired").otherwise("single"))


def read_sam(spark: SparkSession, pattern: str) -> DataFrame:
    """Alignment lines as typed rows; header lines are dropped."""
    lines = spark.read.text(pattern, lineSep="\n").where("not startswith(value, '@')")
    part = F.split("value", "\t")

    def at(i, kind="string"):
        return F.get(part, F.lit(i)).cast(kind)

    return lines.select(
        at(0).alias("read_id"),
        at(1, "int").alias("flag"),
        at(2).alias("contig"),
        at(3, "bigint").alias("pos"),
        at(4, "int").alias("mapq"),
        at(5).alias("cigar"),
        at(9).alias("seq"),
    )


def to_sam(aln: DataFrame) -> DataFrame:
    """Gapless alignments as alignment lines."""
    flag = F.when(F.col("mate") == 1, 64).otherwise(128)
    cigar = F.concat(F.col("len").cast("string"), F.lit("M"))
    columns = [
        "read_id", flag.cast("string"), "contig", F.col("pos").cast("string"), F.lit("60"), cigar,
        F.lit("*"), F.lit("0"), F.lit("0"), "seq", F.lit("*"),
    ]
    return aln.select(F.concat_ws("\t", *columns).alias("value"))


def sam_header(contigs: DataFrame) -> DataFrame:
    length = F.length("seq").cast("string")
    return contigs.select(F.concat(F.lit("@SQ\tSN:"), "contig", F.lit("\tLN:"), length).alias("value"))
