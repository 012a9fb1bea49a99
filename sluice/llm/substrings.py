"""Removal of repeated word windows by super-k-mers.

Consecutive windows of a document that share a minimiser (the smallest hash of the word
m-grams inside a window) form a super-k-mer. Equal windows have equal minimisers, so only
super-k-mers whose minimiser occurs in two documents can hold a repeated window; only those
travel, each as one packed string, to the bucket of their minimiser. Equal packed strings are
combined before the shuffle. In a bucket the windows of all packed strings are sorted and each
run of equal windows learns the smallest document it starts in. A bucket of very many
different strings is split: its windows are dealt one by one by their own text, which gives
the same answer.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.llm.bytewords import Hasher, flat, not_blank, slices, windows, word_spans
from sluice.llm.sieve import sieve
from sluice.session import materialize

WINDOW = 50
#: Words of a minimiser.
MINIMISER = 8
#: Windows of one packed string at most; a longer run is cut, which loses nothing.
RUN = 1024
#: Different packed strings that a bucket takes before its windows are dealt one by one.
BUCKET = 2000


def _sliding_min(values: np.ndarray, size: int) -> np.ndarray:
    """Minimum of every ``size`` consecutive values, by doubling."""
    span, out = 1, values
    while span * 2 <= size:
        out = np.minimum(out[:-span], out[span:])
        span *= 2
    return np.minimum(out[: len(out) - (size - span)], out[size - span :]) if size > span else out


def super_kmers(
    data: np.ndarray, offsets: np.ndarray, hasher: Hasher, window: int = WINDOW
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, first window, number of windows and minimiser of every super-k-mer."""
    starts, ends, word_at = word_spans(data, offsets, not_blank())
    none = np.zeros(0, np.int64)
    if len(starts) < window:
        return none, none, none, none
    size = min(MINIMISER, window)
    grams = windows(hasher.words(data, starts, ends), size)
    least = _sliding_min(grams, window - size + 1)
    row_of = np.repeat(np.arange(len(offsets) - 1), np.diff(word_at))
    valid = row_of[window - 1 :] == row_of[: len(least)]
    row_of = row_of[: len(least)]
    new = np.ones(len(least), bool)
    new[1:] = (least[1:] != least[:-1]) | (row_of[1:] != row_of[:-1])
    new &= valid
    new[1:] |= valid[1:] & ~valid[:-1]
    first = np.flatnonzero(new)
    stop = np.flatnonzero(new | ~valid)
    after = np.r_[stop, len(least)][np.searchsorted(stop, first, "right")]
    count = after - first
    parts = -(-count // RUN)
    piece = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
    begin = np.repeat(first, parts) + piece * RUN
    count = np.minimum(np.repeat(after, parts) - begin, RUN)
    row = row_of[begin]
    return row, begin - word_at[row], count, least[begin].view(np.int64)


def _located(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.col(f"`{text_col}`")
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("_id"), F.xxhash64(text).alias("_hash"), text.alias("_text"))


def _scan(docs: DataFrame, window: int) -> DataFrame:
    """One narrow row for each super-k-mer."""

    def measure(batches):
        hasher = Hasher()
        for batch in batches:
            data, offsets = flat(batch.column(2))
            for first, last in slices(offsets):
                part = data[offsets[first] : offsets[last]]
                row, start, count, key = super_kmers(part, offsets[first : last + 1] - offsets[first], hasher, window)
                where = pa.array(row + first)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(where), batch.column(1).take(where), pa.array(key),
                     pa.array(start.astype(np.int32)), pa.array(count.astype(np.int32))],
                    names=["_id", "_hash", "key", "start", "n"],
                )

    return docs.where("_id is not null").mapInArrow(measure, "_id long, _hash long, key long, start int, n int")


def _cut(found: DataFrame, window: int) -> DataFrame:
    """Packed strings of the super-k-mers listed for each document."""

    def cut(batches):
        for batch in batches:
            out = []
            for ident, own, text, runs in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                words = text.encode().split()  # at ASCII blanks, as the words are defined
                for run in runs:
                    a, n = run["start"], run["n"]
                    packed = b" ".join(words[a : a + n + window - 1]).decode()
                    out.append((ident, own, run["key"], a, n, packed))
                if len(out) > 20_000:
                    yield _table(out)
                    out = []
            if out:
                yield _table(out)

    def _table(out):
        ident, own, key, start, n, packed = zip(*out, strict=True)
        return pa.RecordBatch.from_arrays(
            [pa.array(ident, pa.int64()), pa.array(own, pa.int64()), pa.array(key, pa.int64()),
             pa.array(start, pa.int32()), pa.array(n, pa.int32()), pa.array(packed, pa.string())],
            names=["_id", "_hash", "key", "start", "n", "packed"],
        )

    return found.mapInArrow(cut, "_id long, _hash long, key long, start int, n int, packed string")


def _windows_of(packed: str, n: int, window: int) -> list[str]:
    """The ``n`` windows of a packed string, as parts of it."""
    gaps = [-1]
    at = packed.find(" ")
    while at >= 0:
        gaps.append(at)
        at = packed.find(" ", at + 1)
    gaps.append(len(packed))
    return [packed[gaps[i] + 1 : gaps[i + window]] for i in range(n)]


def _bucket_minima(strings: DataFrame, window: int) -> DataFrame:
    """For each packed string the smallest document of each of its windows, bucket by bucket."""

    def settle(group: list[tuple]):
        if len(group) == 1:
            _, digest, _, n, low = group[0]
            return [(digest, [low] * n)]
        rows = []
        for k, (_, _, packed, n, low) in enumerate(group):
            rows += [(w, low, k, i) for i, w in enumerate(_windows_of(packed, n, window))]
        rows.sort()
        lows = [[0] * g[3] for g in group]
        for _, run in itertools.groupby(rows, key=lambda r: r[0]):
            least = None
            for _, low, k, i in run:
                least = low if least is None else least
                lows[k][i] = least
        return [(g[1], own) for g, own in zip(group, lows, strict=True)]

    def count(batches):
        group, key = [], None
        for batch in batches:
            out = []
            for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if row[0] != key and group:
                    out += settle(group)
                    group = []
                key = row[0]
                group.append(row)
            if out:
                yield table(out)
        if group:
            yield table(settle(group))

    def table(out):
        digest, lows = zip(*out, strict=True)
        return pa.RecordBatch.from_arrays(
            [pa.array(digest, pa.binary()), pa.array(lows, pa.list_(pa.int64()))], names=["_digest", "lows"]
        )

    dealt = strings.select("key", "digest", "packed", "n", "low").repartition("key").sortWithinPartitions("key")
    return dealt.mapInArrow(count, "_digest binary, lows array<long>")


def _single_minima(strings: DataFrame, window: int) -> DataFrame:
    """The same for buckets of many strings: every window is dealt by its own text."""

    def expand(batches):
        for batch in batches:
            for digest, packed, n, low in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                parts = _windows_of(packed, n, window)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([digest] * n, pa.binary()), pa.array(range(n), pa.int32()),
                     pa.array(parts, pa.string()), pa.array([low] * n, pa.int64())],
                    names=["_digest", "at", "text", "low"],
                )

    single = strings.select("digest", "packed", "n", "low").mapInArrow(
        expand, "_digest binary, at int, text string, low long"
    )
    least = single.groupBy(F.col("text").alias("_t")).agg(F.min("low").alias("least"))
    joined = single.join(least, F.col("text") == F.col("_t")).select("_digest", "at", "least")
    listed = joined.groupBy("_digest").agg(F.array_sort(F.collect_list(F.struct("at", "least"))).alias("_all"))
    return listed.select("_digest", F.col("_all.least").alias("lows"))


def remove_repeats(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    window: int = WINDOW,
    bucket: int = BUCKET,
) -> DataFrame:
    """Id, ``n_words``, ``n_removed``, ``kept_text`` of every row.

    Words are runs without ASCII blanks. Each word goes that is covered by a window of
    ``window`` words whose sequence also starts in a row with a smaller id; the kept words are
    joined by one blank. Ids are integers; a row with a null id neither loses words nor makes
    others lose any. A null text has no words and an empty ``kept_text``. Rows that repeat id
    and text are treated alike; different texts under one id do not remove each other's words.
    """
    located = _located(docs, id_col, text_col)
    runs = materialize(_scan(located, window), "runs")
    shared = runs.groupBy(F.col("key").alias("_key")).agg(F.min("_id").alias("_low"), F.max("_id").alias("_high"))
    shared = shared.where("_low < _high").select("_key")
    alive = runs.join(shared, F.col("key") == F.col("_key")).groupBy("_id", "_hash").agg(
        F.collect_set(F.struct("start", "n", "key")).alias("runs")
    )
    alive = materialize(alive, "alive")
    found = _matching(located, alive).select("_id", "_hash", "_text", "runs")
    packed = _cut(found, window).withColumn("digest", F.unhex(F.md5("packed")))
    packed = materialize(packed, "packed")
    strings = packed.groupBy("key", "packed", "n", "digest").agg(F.min("_id").alias("low"))
    strings = materialize(strings, "strings")
    many = strings.groupBy(F.col("key").alias("_key")).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > bucket)
    on_key = F.col("key") == F.col("_key")
    minima = _bucket_minima(strings.join(many, on_key, "left_anti"), window)
    minima = minima.union(_single_minima(strings.join(many, on_key, "left_semi"), window))
    marks = (
        packed.select("_id", "_hash", "start", "digest")
        .join(minima, F.col("digest") == F.col("_digest"))
        .where(F.array_min("lows") < F.col("_id"))
        .select("_id", "_hash", "start", F.transform("lows", lambda low: low < F.col("_id")).alias("repeated"))
        .groupBy("_id", "_hash")
        .agg(F.collect_set(F.struct("start", "repeated")).alias("marks"))
    )
    marks = materialize(marks, "marks")
    may = sieve(marks, F.xxhash64("_id", "_hash"))
    key = F.xxhash64("_id", "_hash")
    clean = located.where(~may(key)).select("_id", "_text", F.lit(None).cast(marks.schema["marks"].dataType).alias("marks"))
    near = marks.select(F.col("_id").alias("_i"), F.col("_hash").alias("_h"), "marks")
    touched = located.where(may(key)).join(near, _same(), "left").select("_id", "_text", "marks")
    return _strip(clean.union(touched), window, docs.schema[id_col].dataType.simpleString()).withColumnRenamed("_id", id_col)


def _same() -> Column:
    return (F.col("_id") == F.col("_i")) & (F.col("_hash") == F.col("_h"))


def _matching(located: DataFrame, listed: DataFrame) -> DataFrame:
    """Documents joined with their lists; most others do not enter the shuffle."""
    may = sieve(listed, F.xxhash64("_id", "_hash"))
    own = located.where("_id is not null").where(may(F.xxhash64("_id", "_hash"))).dropDuplicates(["_id", "_hash"])
    renamed = listed.withColumnsRenamed({"_id": "_i", "_hash": "_h"})
    return own.join(renamed, _same())


def _strip(marked: DataFrame, window: int, kind: str) -> DataFrame:
    def strip(batches):
        for batch in batches:
            idents, total, gone, kept = batch.column(0), [], [], []
            for text, marks in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                words = (text or "").encode().split()
                cover = np.zeros(len(words) + 1, np.int64)
                for mark in marks or ():
                    at = np.flatnonzero(mark["repeated"]) + mark["start"]
                    np.add.at(cover, at, 1)
                    np.add.at(cover, at + window, -1)
                out = np.cumsum(cover[:-1]) > 0
                if out.any():
                    kept.append(b" ".join(words[k] for k in np.flatnonzero(~out)).decode())
                else:
                    kept.append(b" ".join(words).decode())
                total.append(len(words))
                gone.append(int(out.sum()))
            yield pa.RecordBatch.from_arrays(
                [idents, pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string())],
                names=["_id", "n_words", "n_removed", "kept_text"],
            )

    out = marked.select("_id", "_text", "marks").mapInArrow(
        strip, "_id long, n_words long, n_removed long, kept_text string"
    )
    return out.withColumn("_id", F.col("_id").cast(kind))
