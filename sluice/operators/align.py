"""Alignment tables ``(read_id, mate, contig, pos, len, seq)``: index, place, cover, call."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from sluice.functions import bases
from sluice.operators import packed as codes
from sluice.operators.skew import (
    BROADCAST_BYTES,
    SALT_FROM_BYTES,
    hot_hashes,
    join_reads,
    lookup,
    ordinal,
    restored,
    scan_before,
    shrunk,
)
from sluice.session import bounded_bytes, materialize, plan_bytes, scratch_path

BIN = 16384  # width of an index bin
BROADCAST_BINS = 100_000  # bins of regions that are broadcast at most
LEVELS = 6  # levels of bins of a stored index, below the one for everything else
SHARDS = 8  # folders that the contigs of one bin are dealt to
NAMED_CONTIGS = 1000  # contigs whose names are pushed to the files
TILE = 4096  # positions of one contig that one task sweeps
PIECE = 64  # bases of a contig handled as one string
MINIMISER = 8  # bases of the minimiser of a seed
BUCKETS = 16  # buckets of minimisers for each shuffle partition
NOWHERE = np.iinfo(np.int64).max
SEEDS = 1 << 19  # seeds that are listed or counted at once
INDEX_PIECE = 1 << 20  # places that are indexed at once
STRETCH = 1 << 21  # packed bytes of the index that are looked through at once
LOW = 1 << 32  # a place is one number: order of the contig times this, plus position


def coord_sort(aln: DataFrame) -> DataFrame:
    """Alignments in coordinate order, with their rank in it. Sequences travel in two bits a base."""
    return restored(ordinal(shrunk(aln), ["contig", "pos", "read_id", "mate"], "rank"))


def bin_index(aln: DataFrame, bin: int = BIN) -> DataFrame:
    """First and last position and number of rows per bin of each contig."""
    return aln.groupBy("contig", F.floor(F.col("pos") / bin).alias("bin")).agg(
        F.min("pos").alias("first_pos"),
        F.max("pos").alias("last_pos"),
        F.count(F.lit(1)).alias("n"),
    )


def _levels(bin: int) -> list[int]:
    """Widths of the bins of each level; the last one holds whatever fits no other."""
    return [bin << (3 * level) for level in range(LEVELS)]


def _tile(contig: Column, level: Column, bin: Column) -> Column:
    """One number for a bin of a level and the shard of a contig, so folders are pruned by all three at once."""
    shard = F.pmod(F.xxhash64(contig), F.lit(SHARDS))
    return (bin.cast("long") * (LEVELS + 1) + level) * SHARDS + shard


def write_binned(aln: DataFrame, path: str, bin: int = BIN) -> None:
    """Alignments stored for reads by region: once each, in the smallest bin that holds them whole.

    Bins form levels, each eight times as wide as the one below. A folder is one bin of one
    level for one shard of the contigs, and is sorted by contig and position, so a reader skips
    folders by bin and row groups by contig. Many alignments of one bin may fill several files.
    """
    last = F.col("pos") + F.col("len") - 1
    widths = _levels(bin)
    level, number = F.lit(len(widths)), F.lit(0).cast("long")
    for k, width in reversed(list(enumerate(widths))):
        own = F.floor(F.col("pos") / width)
        fits = own == F.floor(last / width)
        level, number = F.when(fits, k).otherwise(level), F.when(fits, own).otherwise(number)
    placed = aln.withColumn("tile", _tile(F.col("contig"), level, number))
    order = ["tile", "contig", "pos"]
    ranged = restored(shrunk(placed).repartitionByRange(*order)).sortWithinPartitions(*order)
    ranged.write.partitionBy("tile").parquet(path, compression="zstd")


def read_binned(spark: SparkSession, path: str) -> DataFrame:
    """Every stored alignment."""
    return spark.read.parquet(path).drop("tile")


def read_regions(
    spark: SparkSession, path: str, regions: DataFrame, bin: int = BIN, schema: StructType | None = None
) -> DataFrame:
    """Stored alignments that overlap each region ``(region, contig, start, end)``, ends included.

    Each region asks for its bins on every level. Few of them, counted before they are
    expanded, are broadcast, and Spark prunes the folders by them while it runs; of at most
    ``NAMED_CONTIGS`` contigs the names are pushed to the files as well. Otherwise both sides
    are shuffled by contig and bin. With the ``schema`` of the stored table no footer is read for it.
    """
    widths = _levels(bin)
    regions = regions.where(F.col("end") >= F.col("start"))

    def asked(level: int, width: int) -> Column:
        touched = _bins(F.col("start"), F.col("end"), width)
        return F.transform(touched, lambda b: _tile(F.col("contig"), F.lit(level), b))

    spans = [asked(level, width) for level, width in enumerate(widths)]
    rest = F.array(_tile(F.col("contig"), F.lit(len(widths)), F.lit(0)))
    wanted = regions.select("*", F.explode(F.concat(*spans, rest)).alias("tile"))
    reader = spark.read if schema is None else spark.read.schema(schema)
    stored = reader.parquet(path).withColumn("_last", F.col("pos") + F.col("len") - 1)
    counted = [F.floor(F.col("end") / w) - F.floor(F.col("start") / w) + 1 for w in widths]
    size = bounded_bytes(regions)
    keys = ["contig", "tile"]
    few = size is not None and size <= BROADCAST_BYTES
    n_bins, n_regions = regions.agg(F.sum(sum(counted[1:], counted[0])), F.count(F.lit(1))).first() if few else (0, 0)
    if few and (n_bins or 0) + n_regions <= BROADCAST_BINS:
        if n_regions <= NAMED_CONTIGS:
            stored = stored.where(F.col("contig").isin([r[0] for r in regions.select("contig").distinct().collect()]))
        met = stored.join(F.broadcast(wanted), keys)
    else:
        met = lookup(stored, wanted, keys)
    overlap = (F.col("pos") <= F.col("end")) & (F.col("_last") >= F.col("start"))
    return met.where(overlap).drop("tile", "_last")


def faidx(contigs: DataFrame, order: str = "ord", width: int = 60) -> DataFrame:
    """Where each sequence starts in the FASTA file that holds them in order.

    Columns: name, length, offset of the first base, bases and bytes per line.
    """
    narrow = contigs.select("contig", order, F.length("seq").alias("_len"))
    length = F.col("_len")
    header = F.length("contig") + 2
    size = header + length + F.ceil(length / width)
    placed = scan_before(narrow.withColumn("_size", size), [], order, F.col("_size"), "_start")
    on_line = F.least(length, F.lit(width))
    return placed.select(
        F.col("contig").alias("name"),
        length.cast("long").alias("length"),
        (F.col("_start") + header).alias("offset"),
        on_line.cast("int").alias("line_bases"),
        (on_line + 1).cast("int").alias("line_width"),
    )


def _bins(start: Column, end: Column, bin: int) -> Column:
    return F.sequence(F.floor(start / bin), F.floor(end / bin))


def region_query(aln: DataFrame, regions: DataFrame, bin: int = BIN) -> DataFrame:
    """Alignments that overlap each region ``(region, contig, start, end)``, ends included.

    Both sides meet in bins and a pair is reported in the first bin they share. Few regions,
    counted in bins before they are expanded, are broadcast and the alignments stay where they
    are. Otherwise both are shuffled, and bins that hold very many alignments are salted.
    """
    last = F.col("pos") + F.col("len") - 1
    return _overlaps(aln.withColumn("_bin", F.explode(_bins(F.col("pos"), last, bin))), regions, bin)


def _overlaps(left: DataFrame, regions: DataFrame, bin: int) -> DataFrame:
    """Alignments, one row per bin ``_bin`` they touch, with the regions they overlap."""
    left = left.withColumn("_last", F.col("pos") + F.col("len") - 1)
    right = regions.withColumn("_bin", F.explode(_bins(F.col("start"), F.col("end"), bin)))
    n_bins = F.floor(F.col("end") / bin) - F.floor(F.col("start") / bin) + 1
    size = bounded_bytes(regions)
    few = size is not None and size <= BROADCAST_BYTES
    few = few and (regions.agg(F.sum(n_bins)).first()[0] or 0) <= BROADCAST_BINS
    keys = ["contig", "_bin"]
    met = left.join(F.broadcast(right), keys) if few else lookup(left, right, keys)
    return met.where(
        (F.col("pos") <= F.col("end"))
        & (F.col("_last") >= F.col("start"))
        & (F.col("_bin") == F.floor(F.greatest("pos", "start") / bin))
    ).drop("_bin", "_last")


def depth(aln: DataFrame, tile: int = TILE) -> DataFrame:
    """``(contig, pos, depth)`` for every covered position.

    Each read adds +1 at its start and -1 after its end in every tile it touches. The
    deltas combine before the shuffle, so a tile under very many reads still has at most
    ``tile + 1`` rows, and no tile depends on another.
    """
    last = F.col("pos") + F.col("len") - 1
    pieces = aln.select(
        "contig", "pos", last.alias("_last"), F.explode(_bins(F.col("pos"), last, tile)).alias("_tile")
    )
    start = F.greatest(F.col("pos"), F.col("_tile") * tile)
    stop = F.least(F.col("_last"), F.col("_tile") * tile + (tile - 1)) + 1
    deltas = pieces.select(
        "contig",
        "_tile",
        F.inline(
            F.array(
                F.struct(start.alias("at"), F.lit(1).alias("delta")),
                F.struct(stop.alias("at"), F.lit(-1).alias("delta")),
            )
        ),
    )
    steps = deltas.groupBy("contig", "_tile", "at").agg(F.sum("delta").alias("delta"))
    order = Window.partitionBy("contig", "_tile").orderBy("at")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    runs = steps.withColumn("depth", F.sum("delta").over(upto)).withColumn(
        "_next", F.lead("at").over(order)
    )
    return runs.where("depth > 0").select(
        "contig", F.explode(F.sequence("at", F.col("_next") - 1)).alias("pos"), "depth"
    )


# seeds


def _spans(n: int, votes: int) -> list[tuple[int, ...]]:
    """Every set of at least ``votes`` of ``n`` seed numbers."""
    return [s for size in range(n, votes - 1, -1) for s in combinations(range(n), size)]


def seed_index(contigs: DataFrame, k: int = 16) -> DataFrame:
    """``(seed, contig, pos)`` for every position of every contig, in this order."""

    def listed(batches):
        for batch in batches:
            data, offsets = codes.flat(batch.column(1))
            if (data < 128).all():  # a character is a byte
                yield from cut(batch.column(0), data, offsets)
                continue
            for row, text in enumerate(batch.column(1).to_pylist()):
                letters = np.frombuffer((text or "").encode("utf-32-le"), "<u4")
                yield from cut(batch.column(0).slice(row, 1), letters, np.array([0, len(letters)]))

    def cut(names, letters, offsets):
        for begin, own, bounds in codes.pieces(letters, offsets, k, SEEDS):
            at = np.flatnonzero(codes.within(bounds, np.ones(len(own), bool), k))
            if not len(at):
                continue
            owner = np.searchsorted(bounds, at, "right") - 1
            windows = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(own, k)[at])
            if windows.dtype == np.uint8:
                ends = np.arange(0, k * len(at) + 1, k, dtype=np.int32)
                seeds = pa.StringArray.from_buffers(len(at), pa.py_buffer(ends), pa.py_buffer(windows))
            else:
                text = windows.tobytes().decode("utf-32-le")
                seeds = pa.array([text[i : i + k] for i in range(0, len(text), k)], pa.string())
            place = begin + at - offsets[owner] + 1
            yield pa.RecordBatch.from_arrays([seeds, names.take(pa.array(owner)), pa.array(place)], names=["seed", "contig", "pos"])

    kind = contigs.schema["contig"].dataType.simpleString()
    return contigs.select("contig", "seq").mapInArrow(listed, f"seed string, contig {kind}, pos long")


def seed_report(seeds: DataFrame) -> DataFrame:
    """For each contig the number of its ``seeds`` and of different ones, the sum of their positions, the first and the last one.

    Seeds are counted where they lie: those of a contig follow each other in one partition, as
    :func:`seed_index` lists them from contigs dealt and sorted by name. Of a contig with very many of
    them the different seeds of each stretch go on, and only those are shuffled.
    """
    kind = seeds.schema["contig"].dataType.simpleString()
    names = ["contig", "seed", "n_places", "n_seeds", "places", "first_seed", "last_seed"]

    def ranked(column):
        """Numbers that sort like the seeds, and their length, if it is one and all letters are A, C, G, T."""
        data, offsets = codes.flat(column)
        k, coded = int(offsets[1]), codes.code_table()[data]
        if 0 < k <= codes.LONGEST and (np.diff(offsets) == k).all() and (coded != codes.OTHER).all():
            letters, number = coded.reshape(-1, k), np.zeros(len(column), np.uint64)
            for j in range(k):
                number = (number << np.uint64(2)) | letters[:, j]
            return number, k
        return np.unique(np.array([x.encode() for x in column.to_pylist()], object), return_inverse=True)[1].astype(np.uint64), None

    def counted(table, whole):
        name, seed, pos = table.column("contig").combine_chunks(), table.column("seed").combine_chunks(), table.column("pos").to_numpy()
        group = np.r_[0, np.cumsum(np.diff(name.dictionary_encode("encode").indices.to_numpy()) != 0)].astype(np.uint64)
        number, k = ranked(seed)
        bounds = np.r_[np.flatnonzero(np.r_[True, group[1:] != group[:-1]]), len(group)]
        first, last = bounds[:-1], bounds[1:] - 1
        if whole and k and k <= 16:  # contig and seed are one number
            key = np.sort((group << np.uint64(32)) | number)
            new = np.r_[True, key[1:] != key[:-1]]
            ends = [codes.spelled(key[x] & np.uint64((1 << 32) - 1), k) for x in (first, last)]
            total = np.add.reduceat(pos, first)
        else:
            order = np.lexsort((number, group))
            number, sorted_ = number[order], group[order]
            new = np.r_[True, (number[1:] != number[:-1]) | (sorted_[1:] != sorted_[:-1])]
            if not whole:  # a row for each seed
                first = np.flatnonzero(new)
                last = np.r_[first[1:], len(group)] - 1
            ends = [seed.take(pa.array(order[x])) for x in (first, last)]
            total = np.add.reduceat(pos[order], first)
        n_places = np.diff(np.r_[first, len(group)])
        n_seeds = np.add.reduceat(new.astype(np.int64), first) if whole else np.zeros(len(first), np.int64)
        named = pa.nulls(len(first), pa.string()) if whole else ends[0]
        return pa.RecordBatch.from_arrays([name.take(pa.array(first)), named, pa.array(n_places), pa.array(n_seeds), pa.array(total), *ends], names=names)

    def report(batches):
        held, large = None, None  # the seeds of the contig that the rows before ended with; the name of one that is cut
        for batch in _large(batches, SEEDS):
            table = pa.Table.from_batches([batch])
            if held is not None:
                table = pa.concat_tables([held, table])
            contig = table.column("contig").combine_chunks().dictionary_encode("encode").indices.to_numpy()
            bounds = np.r_[0, np.flatnonzero(np.diff(contig)) + 1, len(contig)]
            begin = 0
            if large is not None and table.column("contig")[0].equals(large):
                begin = int(bounds[1])
                yield counted(table.slice(0, begin), False)
            if begin == len(contig):
                held = None
                continue
            end = int(bounds[-2])
            if end > begin:
                yield counted(table.slice(begin, end - begin), True)
            held, large = table.slice(end), None
            if held.num_rows > SEEDS:
                yield counted(held, False)
                held, large = None, table.column("contig")[end]
        if held is not None:
            yield counted(held, True)

    found = seeds.select("seed", "contig", "pos").mapInArrow(
        report, f"contig {kind}, seed string, n_places long, n_seeds long, places long, first_seed string, last_seed string"
    )
    return found.groupBy("contig").agg(
        F.sum("n_places").alias("n_places"),
        (F.sum("n_seeds") + F.count_distinct("seed")).alias("n_seeds"),
        F.sum("places").alias("places"),
        F.min("first_seed").alias("first_seed"),
        F.max("last_seed").alias("last_seed"),
    )


def _place(order: Column, pos: Column) -> Column:
    """One number that sorts like (order, position). Positions fit: no string is longer."""
    too_many = F.raise_error(F.lit("contig order numbers must be below 2^31"))
    checked = F.when(order < (1 << 31), order.cast("long")).otherwise(too_many.cast("long"))
    return checked * LOW + pos


def _shapes(n_seeds: int, min_votes: int) -> list[tuple[int, ...]]:
    """Distances of seeds from the first one, of every set of enough seeds; a shape's reverse is one too."""
    found = {tuple(s - seeds[0] for s in seeds) for seeds in _spans(n_seeds, min_votes)}
    return sorted(found, key=lambda shape: (-len(shape), shape))


def _key_names(n_seeds: int) -> list[str]:
    return ["bucket"]


def _words_at(packed: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """The numbers of the k-mers that begin at bases ``at`` of packed codes, which 8 more bytes follow."""
    if k > 28:  # with the bases before it in its first byte, such a word may not fit 8 bytes
        return (_words_at(packed, at, 16) << np.uint64(2 * k - 32)) | _words_at(packed, at + 16, k - 16)
    eight = np.ndarray(len(packed) - 7, ">u8", packed, strides=(1,))
    shift = (64 - 2 * k - 2 * (at & 3)).astype(np.uint64)
    return (eight[at >> 2].astype(np.uint64) >> shift) & np.uint64((1 << (2 * k)) - 1)


def _bucket_count(spark: SparkSession) -> int:
    return BUCKETS * int(spark.conf.get("spark.sql.shuffle.partitions"))


def placement_index(
    contigs: DataFrame,
    k: int = 16,
    stride: int = 27,
    n_seeds: int = 3,
    min_votes: int = 2,
    order: str = "ord",
) -> DataFrame:
    """Where a combination of seeds may begin: runs of places by the bucket of their first seed's minimiser.

    A place that collects v votes matches some v of a read's seeds at the right distances,
    so the best place of a read is the first place of the largest such combination that
    occurs. Looking for the first place of each combination that reads ask for stands in for
    counting votes: a seed that occurs everywhere makes no pairs.
    Consecutive places whose first seeds share a minimiser travel as one string of two bits a base,
    which reaches as far as the last seed of the last of them, so no combination is listed.
    ``n`` is the number of runs, ``span`` the bases a place asks for, ``places`` has the first place of each (8 bytes: order and position
    in one number), ``lengths`` the number of its places, ``missing`` how many bases it is shorter
    than the last of them asks for, at the end of a contig (4 bytes each; all by weight, as of
    :func:`codes.planes`), ``bases`` the strings. Runs with letters other than A, C, G, T lie in rows of
    their own, where ``wrong`` has a byte for each base; seeds with such letters are no seeds.
    """
    m, span = min(MINIMISER, k), (n_seeds - 1) * stride + k
    buckets = _bucket_count(contigs.sparkSession)
    checked = contigs.select(_place(F.col(order), F.lit(0)).alias("_base"), "seq")
    names = ["bucket", "n", "span", "places", "lengths", "missing", "bases", "wrong"]

    def runs(batches):
        table = codes.code_table()
        for batch in batches:
            base = batch.column(0).to_numpy()
            data, offsets = codes.flat(batch.column(1))
            for begin, own, cut in codes.pieces(data, offsets, span, INDEX_PIECE):
                coded = table[own]
                starts, lengths, least = codes.super_kmers(coded, cut, k, m, False)
                here = starts < INDEX_PIECE  # the next piece has the others
                starts, least = starts[here], least[here]
                count = np.minimum(lengths[here] - (k - 1), INDEX_PIECE - starts)
                if not len(starts):
                    continue
                owner = np.searchsorted(cut, starts, "right") - 1
                place = base[owner] + (begin + starts - offsets[owner]) + 1
                size = np.minimum(starts + count - 1 + span, cut[owner + 1]) - starts
                odd = np.r_[0, np.cumsum(coded == codes.OTHER)]
                odd = odd[starts + size] > odd[starts]
                bucket = (least % np.uint64(buckets)).astype(np.int32)
                group = bucket.astype(np.int64) * 2 + odd
                by = np.argsort(group, kind="stable")
                starts, size, count, place, group = starts[by], size[by], count[by], place[by], group[by]
                packed, sizes = codes.pack(np.where(coded == codes.OTHER, 0, coded), starts, size)
                ends = np.r_[0, np.cumsum(sizes)]
                first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
                bounds = np.r_[first, len(group)]
                wrong = [
                    (coded[np.repeat(starts[x:y], size[x:y]) + codes.spread(size[x:y])] == codes.OTHER).tobytes() if g & 1 else None
                    for x, y, g in zip(bounds[:-1], bounds[1:], group[first], strict=True)
                ] if odd.any() else [None] * len(first)
                each = np.diff(bounds)
                missing = count - 1 + span - size
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array((group[first] >> 1).astype(np.int32)),
                        pa.array(each.astype(np.int32)),
                        pa.array(np.full(len(each), span, np.int32)),
                        codes.cut_up(codes.planes(place.astype(np.int64), each), 8 * bounds),
                        codes.cut_up(codes.planes(count.astype(np.uint32), each), 4 * bounds),
                        codes.cut_up(codes.planes(missing.astype(np.uint32), each), 4 * bounds),
                        codes.cut_up(packed, ends[bounds]),
                        pa.array(wrong, pa.binary()),
                    ],
                    names=names,
                )

    return checked.mapInArrow(runs, "bucket int, n int, span int, places binary, lengths binary, missing binary, bases binary, wrong binary")


def build_index(contigs: DataFrame, stored: bool = True, **setting) -> DataFrame:
    """The placement index as a table in buckets of its key, for as many mappings as needed.

    Each mapping deals its reads to the buckets; the index itself is not shuffled again. An index for
    one mapping need not be ``stored``: its runs go where the reads meet them, and are written once.
    """
    spark = contigs.sparkSession
    if not stored:
        return placement_index(contigs, **setting)
    names = _key_names(setting.get("n_seeds", 3))
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # dealt by the hash of the table: a task writes its own bucket
    index = placement_index(contigs, **setting).repartition(buckets, *names)
    path = scratch_path(spark, "index")
    name = path.rsplit("/", 1)[1].replace("-", "_")
    index.write.bucketBy(buckets, *names).option("path", path).saveAsTable(name)
    return spark.table(name)


def _asked_seeds(
    reads: DataFrame, k: int, stride: int, n_seeds: int, min_votes: int, both_strands: bool = False
) -> DataFrame:
    """Each read's seeds from every one that may be the first of a combination, with its bucket.

    ``seed0`` is the first one, ``seed1`` the one a stride behind it, and so on; -1 stands for none.
    ``_before`` tells how far the read begins before the first one, ``_ahead`` whether it
    is asked for as it is or as its reverse complement.
    """
    m = min(MINIMISER, k)
    buckets = _bucket_count(reads.sparkSession)
    kinds = ", ".join(f"{c} {reads.schema[c].dataType.simpleString()}" for c in ("read_id", "mate"))
    seeds = [f"seed{j}" for j in range(n_seeds)]

    def keys(batches):
        table = codes.code_table()
        for whole in batches:
            for batch in (whole.slice(i, 4096) for i in range(0, whole.num_rows, 4096)):
                data, offsets = codes.flat(batch.column(2))
                if len(data) < k:
                    continue
                lengths = np.diff(offsets)
                coded = table[data]
                good = codes.within(offsets, coded != codes.OTHER, k)
                safe = np.where(coded == codes.OTHER, 0, coded)
                at = offsets[:-1, None] + np.arange(n_seeds) * stride
                there = (np.arange(n_seeds) * stride + k <= lengths[:, None])
                there &= good[np.where(there, at, 0)]
                at = np.where(there, at, 0)
                for ahead in (True, False) if both_strands else (True,):
                    number = codes.words(safe, k) if ahead else codes.reversed_words(safe, k)
                    number = np.where(there, number[at].astype(np.int64), -1)
                    ranked = codes.scattered(codes.words(safe, m) if ahead else codes.reversed_words(safe, m))
                    least = codes.smallest_before(ranked, k - m + 1)[at]
                    for f in range(n_seeds):
                        line = list(range(f, n_seeds)) if ahead else list(range(f, -1, -1))
                        row = np.flatnonzero(there[:, f] & (there[:, line].sum(axis=1) >= min_votes))
                        if not len(row):
                            continue
                        found = np.full((n_seeds, len(row)), -1, np.int64)
                        found[: len(line)] = number[row][:, line].T
                        before = np.full(len(row), f * stride, np.int64) if ahead else lengths[row] - (f * stride + k)
                        picked = pa.array(row)
                        yield pa.RecordBatch.from_arrays(
                            [
                                batch.column(0).take(picked), batch.column(1).take(picked),
                                pa.array((least[row, f] % np.uint64(buckets)).astype(np.int32)),
                                *[pa.array(x) for x in found], pa.array(before), pa.array(np.full(len(row), ahead)),
                            ],
                            names=["read_id", "mate", "bucket", *seeds, "_before", "_ahead"],
                        )

    longs = ", ".join(f"{n} long" for n in seeds)
    return reads.select("read_id", "mate", "seq").mapInArrow(keys, f"{kinds}, bucket int, {longs}, _before long, _ahead boolean")


def _ranks(known: np.ndarray, values: np.ndarray) -> np.ndarray:
    """The place of each value among the sorted ``known`` ones; -1 for another."""
    if not len(known):
        return np.full(len(values), -1, np.int64)
    at = np.minimum(np.searchsorted(known, values), len(known) - 1)
    return np.where(known[at] == values, at, -1)


def _stretches(table: pa.Table):
    """The columns of the index rows of one bucket, put together to about ``STRETCH`` bytes, odd ones apart."""
    sizes = pc.binary_length(table.column("bases")).to_numpy()
    clean = pc.is_null(table.column("wrong")).to_numpy()
    for rows in (np.flatnonzero(clean), np.flatnonzero(~clean)):
        number = np.cumsum(sizes[rows]) // STRETCH
        for part in np.split(rows, np.flatnonzero(np.diff(number)) + 1) if len(rows) else []:
            own = table.take(pa.array(part))
            each = own.column("n").to_numpy()
            place, count, missing = [
                codes.from_planes(b"".join(own.column(c).to_pylist()), each, kind).astype(np.int64)
                for c, kind in (("places", np.int64), ("lengths", np.uint32), ("missing", np.uint32))
            ]
            columns = [own.column(c).to_pylist() for c in ("bases", "wrong")]
            span = np.repeat(own.column("span").to_numpy().astype(np.int64), each)
            yield place, count, count - 1 + span - missing, *[b"".join(c) if c[0] is not None else None for c in columns]


def _first_places(asked: list[np.ndarray], table: pa.Table, k: int, stride: int, min_votes: int) -> dict[int, np.ndarray]:
    """For each number of votes the first place of each asked row's combinations of so many seeds, or ``NOWHERE``."""
    known = [np.unique(a[a >= 0]) for a in asked]
    mine = [_ranks(u, a) for u, a in zip(known, asked, strict=True)]
    shapes = _shapes(len(asked), min_votes)
    # numbers of the asked combinations: of each beginning of a shape, joined with the next seed
    steps, of = {}, {(0,): mine[0]}
    for shape in shapes:
        for n in range(2, len(shape) + 1):
            if shape[:n] not in of:
                head, d = of[shape[: n - 1]], shape[n - 1]
                joined = np.where((head >= 0) & (mine[d] >= 0), head * (len(known[d]) + 1) + mine[d], -1)
                steps[shape[:n]] = np.unique(joined[joined >= 0])
                of[shape[:n]] = _ranks(steps[shape[:n]], joined)
    least = {s: np.full(len(steps[s]) if len(s) > 1 else len(known[0]), NOWHERE) for s in shapes}
    for place, count, size, bases, wrong in _stretches(table):
        begin = 4 * np.r_[0, np.cumsum(-(-size // 4))[:-1]]
        packed = np.frombuffer(bases + bytes(16), np.uint8)
        within = codes.spread(count)
        at = np.repeat(begin, count) + within
        first = _ranks(known[0], _words_at(packed, at, k).astype(np.int64))
        hit = np.flatnonzero(first >= 0)
        if not len(hit):
            continue
        run = np.repeat(np.arange(len(count)), count)[hit]
        at, within, codes_ = at[hit], within[hit], {(0,): first[hit]}
        place = place[run] + within
        if wrong is not None:
            odd = np.r_[0, np.cumsum(np.frombuffer(wrong, np.uint8))]
            flat = np.r_[0, np.cumsum(size)[:-1]][run] + within
        seen = {}
        for shape in shapes:
            for n in range(2, len(shape) + 1):
                if shape[:n] in codes_:
                    continue
                head, d = codes_[shape[: n - 1]], shape[n - 1]
                if d not in seen:
                    shift, rank = d * stride, np.full(len(at), -1, np.int64)
                    ok = within + shift + k <= size[run]
                    if wrong is not None:
                        there = np.where(ok, flat + shift, 0)
                        ok &= odd[there + np.where(ok, k, 0)] == odd[there]
                    rank[ok] = _ranks(known[d], _words_at(packed, at[ok] + shift, k).astype(np.int64))
                    seen[d] = rank
                joined = np.where((head >= 0) & (seen[d] >= 0), head * (len(known[d]) + 1) + seen[d], -1)
                codes_[shape[:n]] = _ranks(steps[shape[:n]], joined)
            of_shape = codes_[shape]
            some = of_shape >= 0
            np.minimum.at(least[shape], of_shape[some], place[some])
    best = {}
    for shape in shapes:
        own = np.full(len(asked[0]), NOWHERE)
        some = of[shape] >= 0
        own[some] = least[shape][of[shape][some]]
        best[len(shape)] = np.minimum(best[len(shape)], own) if len(shape) in best else own
    return best


def _large(batches, rows: int = 1 << 19):
    """Batches put together until they have so many rows."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.num_rows
        if size >= rows:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, size = [], 0
    if size:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _meet_index(
    asked: DataFrame, index: DataFrame, names: list[str], size: int, k: int = 16, stride: int = 27, min_votes: int = 2
) -> DataFrame:
    """``asked`` rows of which a combination occurs, with its first place by votes: ``_place2``, ``_place3``, ...

    Buckets of the index meet the asked seeds of the same bucket, of which many travel in one row. Where
    the reads are large, as in ``lookup``, buckets that very many of them ask for are looked up once for each
    different set of seeds, which then goes back to the reads.
    """
    seeds = [c for c in asked.columns if c.startswith("seed")]
    levels = sorted({len(s) for s in _shapes(len(seeds), min_votes)})
    found = [f"_place{v}" for v in levels]

    def met(rows: DataFrame) -> DataFrame:
        kept = [c for c in rows.columns if c not in (*names, *seeds)] or [*names, *seeds]

        schema = to_arrow_schema(rows.schema)
        bundles = codes.bundles(schema.types)

        def together(batches):
            for batch in _large(batches):
                bucket = batch.column("bucket").to_numpy()
                order = np.argsort(bucket, kind="stable")
                bucket, batch = bucket[order], batch.take(pa.array(order))
                bounds = np.r_[np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]), len(bucket)]
                columns = [x for c in schema.names if c not in names for x in codes.bundle(batch.column(c), bounds)]
                firsts = [pa.array(bucket[bounds[:-1]]), pa.array(np.diff(bounds).astype(np.int32))]
                yield pa.RecordBatch.from_arrays([*firsts, *columns], names=[*names, "n", *halves])

        def apart(table: pa.Table) -> pa.Table:
            each = table.column("n").to_numpy()
            columns = {names[0]: pa.array(np.repeat(table.column(names[0]).to_numpy(), each))}
            for c in schema.names:
                if c not in names:
                    columns[c] = codes.unbundle(table.column(f"{c}_1"), table.column(f"{c}_2"), each, schema.field(c).type)
            return pa.table([columns[c] for c in schema.names], names=schema.names)

        def places(left: pa.Table, right: pa.Table) -> pa.Table:
            left = apart(left) if bundles else left
            if not left.num_rows or not right.num_rows:
                return empty(left)
            best = _first_places([left.column(c).to_numpy() for c in seeds], right, k, stride, min_votes)
            some = np.flatnonzero(np.min([best[v] for v in levels], axis=0) < NOWHERE)
            out = left.select(kept).take(pa.array(some))
            for v, name in zip(levels, found, strict=True):
                own = best[v][some]
                out = out.append_column(name, pa.array(own, mask=own == NOWHERE))
            return out

        def empty(left: pa.Table) -> pa.Table:
            out = left.select(kept).slice(0, 0)
            for name in found:
                out = out.append_column(name, pa.array([], pa.int64()))
            return out

        halves = [f"{c}_{i}" for c in schema.names if c not in names for i in (1, 2)]
        dealt = rows
        if bundles:
            dealt = rows.mapInArrow(together, ", ".join(["bucket int", "n int", *[f"{c} binary" for c in halves]]))
        kinds = ", ".join([f"{c} {rows.schema[c].dataType.simpleString()}" for c in kept] + [f"{c} long" for c in found])
        return dealt.groupBy(*names).cogroup(index.groupBy(*names)).applyInArrow(places, kinds)

    hot = hot_hashes(asked, names) if size > SALT_FROM_BYTES else []
    if not hot:
        return met(asked)
    is_hot = F.xxhash64(*names).isin(hot)
    own = asked.where(is_hot)
    once = met(own.select(*names, *seeds).distinct())
    back = lookup(own, once, [*names, *seeds]).drop(*names, *seeds)
    return back.unionByName(met(asked.where(~is_hot)))


def seed_map(
    reads: DataFrame,
    index: DataFrame,
    contigs: DataFrame,
    k: int = 16,
    stride: int = 27,
    n_seeds: int = 3,
    min_votes: int = 2,
    order: str = "ord",
    both_strands: bool = False,
) -> DataFrame:
    """Place every read where most of its seeds agree, the first such place on a tie.

    Seeds start every ``stride`` bases. Reads whose best place has fewer than
    ``min_votes`` seeds stay out. Placement is gapless and a read may overhang its contig.
    ``both_strands`` also places the reverse complement of a read: ``strand`` tells which was
    better, the forward one on a tie, and ``seq`` is turned round accordingly.
    """
    asked = _asked_seeds(reads, k, stride, n_seeds, min_votes, both_strands)
    hits = _meet_index(asked, index, _key_names(n_seeds), plan_bytes(reads), k, stride, min_votes)
    levels = range(n_seeds, min_votes - 1, -1)
    places = {"+": F.col("_ahead")} | ({"-": ~F.col("_ahead")} if both_strands else {})
    firsts = [
        F.min(F.when(way, F.col(f"_place{v}") - F.col("_before"))).alias(f"{strand}{v}") for v in levels for strand, way in places.items()
    ]
    found = {v: F.least(*[F.col(f"`{s}{v}`") for s in places]) if both_strands else F.col(f"`+{v}`") for v in levels}
    best = F.coalesce(*found.values())
    votes = F.coalesce(*[F.when(place.isNotNull(), v) for v, place in found.items()])
    ahead = F.coalesce(*[F.when(place.isNotNull(), F.coalesce(F.col(f"`+{v}`") == place, F.lit(False))) for v, place in found.items()])
    placed = (
        hits.groupBy("read_id", "mate")
        .agg(*firsts)
        .select("read_id", "mate", best.alias("_best"), votes.alias("votes"), F.when(ahead, "+").otherwise("-").alias("strand"))
        .where("_best is not null")
    )
    exact = F.shiftright(F.col("_best") + LOW // 2, 32)
    placed = placed.select(
        "read_id",
        "mate",
        exact.alias(order),
        (F.col("_best") - exact * LOW).alias("pos"),
        "votes",
        "strand",
    )
    if plan_bytes(placed) > SALT_FROM_BYTES:  # lookup goes through it beforehand, which would map twice
        placed = materialize(placed, "placed")
    named = lookup(placed, contigs.select(order, "contig"), [order])
    met = join_reads(reads.select("read_id", "mate", "seq"), named, ["read_id", "mate"])
    columns = ["read_id", "mate", "contig", "pos", F.length("seq").alias("len"), "seq", "votes"]
    if not both_strands:
        return met.select(*columns)
    turned = F.when(F.col("strand") == "+", F.col("seq")).otherwise(bases.reverse_complement("seq"))
    return met.withColumn("seq", turned).select(*columns, "strand")


# pileup


def _piece_counts(aln: DataFrame) -> DataFrame:
    """``contig``, ``piece``, ``counts``: how often each letter lies on each position of a piece of ``PIECE`` bases.

    ``counts`` is a packed array of ``PIECE`` x 5 numbers: A, C, G, T and other letters, a byte
    each, or eight where one does not do. A task adds up the letters of its reads in such arrays,
    so a read is no row at all, and a piece under very many reads is one row for each batch of
    them. Positions before the first are left out.
    """
    narrow = aln.where("contig is not null and pos is not null and seq is not null")
    size = PIECE * 5

    def count(batches):
        letters = np.where(codes.code_table() == codes.OTHER, 4, codes.code_table()).astype(np.int64)
        for whole in batches:
            for batch in (whole.slice(i, 4096) for i in range(0, whole.num_rows, 4096)):
                names = batch.column(0).dictionary_encode()
                data, offsets = codes.flat(batch.column(2))
                first = (data & 0xC0) != 0x80  # a character counts once, however many bytes it has
                if not first.all():
                    offsets = np.r_[0, np.cumsum(first)][offsets]
                    data = data[first]
                sizes = np.diff(offsets)
                place = np.repeat(batch.column(1).to_numpy() - 1 - offsets[:-1], sizes) + np.arange(len(data))
                owner = np.repeat(names.indices.to_numpy().astype(np.int64), sizes)
                inside = place >= 0
                if not inside.all():
                    data, place, owner = data[inside], place[inside], owner[inside]
                for at in range(0, len(data), 1 << 20):
                    part = slice(at, at + (1 << 20))
                    pieces = place[part] // PIECE
                    low, span = int(pieces.min()), int(pieces.max() - pieces.min()) + 1
                    key = owner[part] * span + (pieces - low)
                    run = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])  # a read is a few runs
                    keys, cell = np.unique(key[run], return_inverse=True)
                    cell = np.repeat(cell * size, np.diff(np.r_[run, len(key)]))
                    slot = cell + (place[part] - pieces * PIECE) * 5 + letters[data[part]]
                    table = np.bincount(slot, minlength=len(keys) * size)
                    packed = table.astype(np.uint8 if table.max() < 256 else np.int64)
                    ends = np.arange(len(keys) + 1, dtype=np.int32) * np.int32(packed.itemsize * size)
                    counts = pa.BinaryArray.from_buffers(pa.binary(), len(keys), [None, pa.py_buffer(ends), pa.py_buffer(packed)])
                    contig = names.dictionary.take(pa.array(keys // span))
                    yield pa.RecordBatch.from_arrays([contig, pa.array(keys % span + low), counts], names=["contig", "piece", "counts"])

    return narrow.select("contig", F.col("pos").cast("long"), "seq").mapInArrow(count, "contig string, piece long, counts binary")


def _pieces(contigs: DataFrame) -> DataFrame:
    """``contig``, ``piece``, ``seq``: the sequences in pieces of ``PIECE`` bases."""

    def cut(batches):
        for batch in batches:
            for contig, text in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                for low in range(0, len(text), PIECE << 14):
                    own = [text[i : i + PIECE] for i in range(low, min(low + (PIECE << 14), len(text)), PIECE)]
                    number = np.arange(len(own)) + low // PIECE
                    yield pa.RecordBatch.from_arrays(
                        [pa.repeat(contig, len(own)), pa.array(number), pa.array(own, pa.string())], names=["contig", "piece", "seq"]
                    )

    named = contigs.select("contig", "seq").where("contig is not null and seq is not null")
    return named.mapInArrow(_joined(cut), "contig string, piece long, seq string")


def _joined(make, rows: int = 1 << 14):
    """``make`` with its small batches put together."""

    def run(batches):
        held, size = [], 0
        for batch in make(batches):
            held.append(batch)
            size += batch.num_rows
            if size >= rows:
                yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                held, size = [], 0
        if held:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()

    return run


def pileup(aln: DataFrame, contigs: DataFrame) -> DataFrame:
    """Reference base, depth and base counts of every covered reference position.

    Letters are counted in :func:`_piece_counts`. Counts and pieces of the reference are
    shuffled once, together, and sorted so that the reference comes after the counts of its
    piece: these are added up as a stream, and positions become rows at the very end.
    """
    tasks = int(aln.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    names = [f"n_{b.lower()}" for b in "ACGT"]
    size = PIECE * 5

    def summed(packed: pa.Array, group: np.ndarray, n: int) -> np.ndarray:
        """Sums of the packed counts by group; groups are in order."""
        total = np.zeros((n, size), np.int64)
        lengths = pc.binary_length(packed).to_numpy()
        for kind in (np.uint8, np.int64):
            own = np.flatnonzero(lengths == np.dtype(kind).itemsize * size)
            if not len(own):
                continue
            data, _ = codes.flat(packed.take(pa.array(own)))
            table, of = data.view(kind).reshape(-1, size), group[own]
            first = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
            alone = np.diff(np.r_[first, len(of)]) == 1
            total[of[first[alone]]] += table[first[alone]]
            if not alone.all():
                several = ~np.isin(of, of[first[alone]])
                of, table = of[several], table[several]
                first = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
                total[of[first]] += np.add.reduceat(table, first, axis=0, dtype=np.int64)
        return total

    def positions(batches):
        last, held = None, None  # the piece that the rows before ended with, and its counts
        for whole in batches:
            for batch in (whole.slice(i, 2048) for i in range(0, whole.num_rows, 2048)):
                contig, piece, counts, seq = batch.columns
                named, number = contig.dictionary_encode().indices.to_numpy(), piece.to_numpy()
                new = np.r_[True, (named[1:] != named[:-1]) | (number[1:] != number[:-1])]
                group = np.cumsum(new) - 1
                n = int(group[-1]) + 1
                some = np.flatnonzero(counts.is_valid().to_numpy(zero_copy_only=False))
                total = summed(counts.take(pa.array(some)), group[some], n)
                if last == (contig[0].as_py(), int(number[0])):
                    total[0] += held
                last, held = (contig[-1].as_py(), int(number[-1])), total[-1].copy()
                there = seq.is_valid().to_numpy(zero_copy_only=False)
                there[there] = total[group[there]].any(axis=1)
                rows = np.flatnonzero(there)
                if not len(rows):
                    continue
                table = total[group[rows]].reshape(-1, 5)
                texts = seq.take(pa.array(rows)).to_pylist()
                lengths = np.array([len(t) for t in texts], np.int64)
                depth = table[:, 0] + table[:, 1] + table[:, 2] + table[:, 3] + table[:, 4]
                inside = np.arange(PIECE) < lengths[:, None]
                covered = (depth.reshape(-1, PIECE) > 0) & inside
                here = np.flatnonzero(covered)
                text = "".join(texts)
                if text.isascii():
                    letters = np.frombuffer(text.encode(), np.uint8)[covered[inside]]
                    spelled = pa.StringArray.from_buffers(len(here), pa.py_buffer(np.arange(len(here) + 1, dtype=np.int32)), pa.py_buffer(letters))
                else:
                    letters = np.frombuffer(text.encode("utf-32-le"), np.uint32)[covered[inside]]
                    known, code = np.unique(letters, return_inverse=True)
                    spelled = pa.DictionaryArray.from_arrays(pa.array(code), pa.array([chr(c) for c in known])).cast(pa.string())
                each = covered.sum(axis=1)
                yield pa.RecordBatch.from_arrays(
                    [
                        contig.take(pa.array(np.repeat(rows, each))),
                        pa.array(np.repeat(number[rows] * PIECE + 1, each) + here % PIECE),
                        spelled,
                        pa.array(depth[here]),
                        *[pa.array(np.ascontiguousarray(x)) for x in table[here, :4].T],
                    ],
                    names=["contig", "pos", "ref", "depth", *names],
                )

    counted = _piece_counts(aln).withColumn("seq", F.lit(None).cast("string"))
    pieces = _pieces(contigs).select("contig", "piece", F.lit(None).cast("binary").alias("counts"), "seq")
    dealt = counted.unionAll(pieces).repartition(tasks, "contig", "piece")
    ordered = dealt.sortWithinPartitions("contig", "piece", F.asc_nulls_first("seq"))
    kinds = ", ".join(f"{n} long" for n in ["depth", *names])
    return ordered.mapInArrow(positions, f"contig string, pos long, ref string, {kinds}")


def call_variants(piled: DataFrame, min_depth: int = 2, min_frac: float = 0.8) -> DataFrame:
    """Positions where a clear majority of reads differs from the reference.

    A majority rule stands in for a genotype model; equal counts go to the first base.
    """
    top = F.greatest("n_a", "n_c", "n_g", "n_t")
    alt = F.lit("T")
    for base in "GCA":
        alt = F.when(F.col(f"n_{base.lower()}") == top, base).otherwise(alt)
    called = piled.select("contig", "pos", "ref", alt.alias("alt"), "depth", top.alias("n_alt"))
    return called.where(
        (F.col("alt") != F.col("ref"))
        & (F.col("depth") >= min_depth)
        & (F.col("n_alt") >= min_frac * F.col("depth"))
    )
