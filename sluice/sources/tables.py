"""Derived inputs: file listings, task runs, graphs, event logs and sequence reads.

The given tables hold no files, runs or sequencing reads; these views derive them, over
every row and every character, so that each operator can be run at the size of the data.
"""

from __future__ import annotations

from hashlib import md5

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.operators.packed import flat

READ_LEN = 80
TILES = 1 << 14  # pairs of reads that are made at once
PLANT_EVERY = 97  # every such position of the sample differs from the reference


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, key: str) -> DataFrame:
    """Put a scan that comes in fewer partitions than there are cores on all of them.

    Only tables of a few files need this; larger ones keep the partitions of their scan.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    few = df._jdf.queryExecution().toRdd().getNumPartitions() < cores
    return df.repartition(cores, key) if few else df


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """The named columns of the documents, ready for work that multiplies rows."""
    return spread(table(spark, sf_dir, "documents").select("doc_id", *columns), "doc_id")


def _text(value: Column | str) -> Column:
    return (F.col(value) if isinstance(value, str) else value).cast("string")


def artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A listing of output files: one per document."""
    docs = table(spark, sf_dir, "documents")
    uid = F.sha2(F.concat("source", F.lit(":"), _text("doc_id")), 256)
    name = F.concat("source", F.lit("_"), _text("doc_id"), F.lit("."), "lang", F.lit(".txt"))
    return docs.withColumn("uid", uid).select(
        "doc_id",
        (F.col("doc_id") % 8).alias("run_id"),
        "uid",
        F.concat(F.lit("data/"), F.substring("uid", 1, 7), F.lit("/"), name).alias("path"),
        F.col("n_chars").alias("size"),
        F.sha2("text", 256).alias("content_hash"),
        (F.col("doc_id") * 1000 + F.col("n_chars") % 2).alias("mtime"),
        "source",
        "lang",
    )


def manifest_old(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an earlier run recorded: two sources unknown, German files with another hash."""
    changed = F.col("lang") == "de"
    return artifacts(spark, sf_dir).where("source not in ('src3', 'src13')").select(
        "path",
        F.when(changed, F.sha2("content_hash", 256))
        .otherwise(F.col("content_hash"))
        .alias("content_hash"),
        (F.col("doc_id") * 1000).alias("mtime"),
    )


def present_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files found on disk: those of labelled documents, empty where quality is 0."""
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("length"))
    return artifacts(spark, sf_dir).join(labels, "doc_id").select("uid", "path", "length")


def tasks_conv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation is a run, each turn a step."""
    key = F.concat(_text("conv_id"), F.lit(":"), _text("turn"), F.lit(":"), "text")
    return table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("run_id"),
        F.col("turn").alias("pos"),
        F.col("role").alias("name"),
        F.sha2(key, 256).alias("uid"),
    )


def hier_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A three-level graph: region, nation, customer, order."""

    def level(name, up, src, down, dst):
        return table(spark, sf_dir, name).select(
            F.concat(F.lit(up), _text(src)).alias("src"),
            F.concat(F.lit(down), _text(dst)).alias("dst"),
        )

    return (
        level("nation", "r", "n_regionkey", "n", "n_nationkey")
        .unionAll(level("customer", "n", "c_nationkey", "c", "c_custkey"))
        .unionAll(level("orders", "c", "o_custkey", "o", "o_orderkey"))
    )


def hier_vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vertex of ``hier_edges`` with its name."""

    def level(name, prefix, key, label):
        return table(spark, sf_dir, name).select(
            F.concat(F.lit(prefix), _text(key)).alias("uid"), F.col(label).alias("name")
        )

    return (
        level("region", "r", "r_regionkey", "r_name")
        .unionAll(level("nation", "n", "n_nationkey", "n_name"))
        .unionAll(level("customer", "c", "c_custkey", "c_name"))
        .unionAll(level("orders", "o", "o_orderkey", "o_orderpriority"))
    )


# The status an event type stands for.
STATUS_OF = {
    "signup": "STATUS_CREATED",
    "view": "RESOLVING_INPUT",
    "click": "RUNNING_OPERATION",
    "purchase": "POST_VALIDATION",
}


def as_task_events(events: DataFrame) -> DataFrame:
    """Task events from rows of ``events``, batch or stream."""
    status = F.lit(None).cast("string")
    for action, name in STATUS_OF.items():
        status = F.when(F.col("event_type") == action, name).otherwise(status)
    return events.select(
        F.col("event_id").alias("seq"),
        "ts",
        F.col("user_id").alias("uid"),
        F.col("event_type").alias("action"),
        status.alias("status"),
        F.when(F.col("event_type") == "error", "stderr").otherwise("log").alias("channel"),
        F.concat("event_type", F.lit(" "), "props").alias("content"),
    )


def task_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_task_events(table(spark, sf_dir, "events"))


def doc_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line of every document."""
    return documents(spark, sf_dir, "text").select(
        "doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line")
    )


# sequences


def _letters(column: pa.Array) -> pa.Array:
    """The low half of each byte as a base, one string a row; null stays null."""
    column = column.cast(pa.large_binary())
    data, offsets = flat(column)
    text = np.frombuffer(b"ACGT", np.uint8)[data & 3]
    buffers = [None, pa.py_buffer(offsets), pa.py_buffer(text)]
    made = pa.LargeStringArray.from_buffers(len(column), *buffers[1:]).cast(pa.string())
    return pc.if_else(column.is_null(), None, made) if column.null_count else made


def contigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One reference sequence per document: the low half of each byte picks the base."""
    return documents(spark, sf_dir, "text").select(
        F.col("doc_id").alias("ord"),
        F.concat(F.lit("c"), _text("doc_id")).alias("contig"),
        F.arrow_udf(_letters, "string")(F.encode("text", "utf-8")).alias("seq"),
    )


def _digests(texts: list[bytes], end: bytes) -> np.ndarray:
    """The MD5 of each text with the end put to it, 16 bytes a row."""
    return np.frombuffer(b"".join([md5(t + end).digest() for t in texts]), np.uint8).reshape(-1, 16)


def _hashes(texts: list[bytes], end: bytes) -> np.ndarray:
    """The first seven hexadecimal digits of each MD5, as numbers."""
    first = np.ascontiguousarray(_digests(texts, end)[:, :4]).view(">u4").ravel()
    return first.astype(np.int64) >> 4


def _ragged(matrix: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The first values of each row, put together."""
    if (sizes == matrix.shape[1]).all():
        return np.ascontiguousarray(matrix).ravel()
    return matrix[np.arange(matrix.shape[1]) < sizes[:, None]]


def _sequenced(spark: SparkSession, sf_dir: str, qualities: bool) -> DataFrame:
    """``aln``, with ``qual`` if asked for: every document is cut into tiles, a pair of reads each.

    Both mates of a tile follow each other. Tiles are made a bounded number at a time, however
    long a document is.
    """

    def pairs(names: pa.Array, known: np.ndarray, bases, begin, sizes, doc, tile):
        start = tile * READ_LEN
        left = sizes[doc] - start
        ids = pc.binary_join_element_wise(names.take(pa.array(doc)), pa.array(tile).cast(pa.string()), "_")
        spelled = [t.encode() for t in pc.fill_null(ids, "").to_pylist()]
        shift = _hashes(spelled, b"/2") % np.minimum(left, READ_LEN)
        # both mates in turn: the second one has no place if the document has no name
        row = np.repeat(np.arange(len(doc)), 2)
        second = np.tile([False, True], len(doc))
        here = known[doc][row]
        lost = second & ~here
        off = start[row] + np.where(second, shift[row], 0)
        length = np.minimum(np.minimum(left[row], 2 * READ_LEN) - np.where(second, shift[row], 0), READ_LEN)
        length[lost] = 0
        at = (begin[doc][row] + off)[:, None] + np.arange(READ_LEN)
        read = bases[np.minimum(at, len(bases) - 1)]
        place = PLANT_EVERY - 1 - off % PLANT_EVERY
        hit = np.flatnonzero(place < length)
        read[hit, place[hit]] = (read[hit, place[hit]] + 1) & 3
        wrong = (tile[row] % 7 == 0) & (length >= 40)
        read[wrong, 39] = (read[wrong, 39] + 2) & 3
        ends = np.r_[0, np.cumsum(length)].astype(np.int32)
        letters = np.frombuffer(b"ACGT", np.uint8)[_ragged(read, length)]
        none = pa.array(lost)
        seq = pa.StringArray.from_buffers(len(row), pa.py_buffer(ends), pa.py_buffer(letters))
        columns = {
            "read_id": ids.take(pa.array(row)),
            "mate": pa.array(second.astype(np.int32) + 1),
            "contig": names.take(pa.array(doc[row])),
            "pos": pa.array(off + 1, mask=lost),
            "len": pa.array(length.astype(np.int32), mask=lost),
            "seq": pc.if_else(none, None, seq),
        }
        if qualities:
            noise, cut = np.empty((len(row), 48), np.uint8), np.empty(len(row), np.int64)
            for k, mate in enumerate((b"1", b"2")):
                noise[k::2] = np.hstack([_digests(spelled, end + mate) for end in (b"q", b"r", b"s")])
                cut[k::2] = 30 + _hashes(spelled, b"c" + mate) % 60
            digits = np.stack([noise >> 4, noise & 15], axis=2).reshape(len(row), -1)[:, :READ_LEN].astype(np.int32)
            i = np.arange(READ_LEN)
            digits += 24 * ((i > 0) & (i < cut[:, None]))
            qual = pa.ListArray.from_arrays(pa.array(ends), pa.array(_ragged(digits, length)))
            columns["qual"] = pc.if_else(pa.array(~here), None, qual) if not here.all() else qual
        return pa.RecordBatch.from_pydict(columns)

    def tiles(batches):
        for batch in batches:
            data, offsets = flat(batch.column(1).cast(pa.large_binary()))
            bases, sizes = data & 3, np.diff(offsets)
            names = batch.column(0)
            known = names.is_valid().to_numpy(zero_copy_only=False)
            before = np.r_[0, np.cumsum(-(-sizes // READ_LEN))]
            for first in range(0, int(before[-1]), TILES):
                number = np.arange(first, min(first + TILES, int(before[-1])))
                doc = np.searchsorted(before, number, "right") - 1
                yield pairs(names, known, bases, offsets[:-1], sizes, doc, number - before[doc])

    kind = "read_id string, mate int, contig string, pos long, len int, seq string"
    texts = documents(spark, sf_dir, "text").select(
        F.concat(F.lit("c"), _text("doc_id")).alias("contig"), F.encode("text", "utf-8").alias("bytes")
    )
    return texts.mapInArrow(tiles, kind + (", qual array<int>" if qualities else ""))


def aln(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Aligned read pairs that tile every sequence about twice.

    The second mate of a tile begins at a place of it that a hash picks. The sample carries a
    substitution at every position divisible by ``PLANT_EVERY``; every seventh pair has one read
    error at its 40th base.
    """
    return _sequenced(spark, sf_dir, qualities=False)


def plain_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The aligned pairs as raw reads without quality values."""
    return aln(spark, sf_dir).select("read_id", "mate", "seq")


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The aligned pairs as raw reads with quality values 0 to 39 and a bad tail."""
    return _sequenced(spark, sf_dir, qualities=True).select("read_id", "mate", "seq", "qual")
