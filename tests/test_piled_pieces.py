"""Pileups of reads and references on odd rows, and packed bases against plain strings."""

from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from sluice.operators import align
from sluice.operators import packed as codes
from sluice.plans import QUERIES
from sluice.sources import tables as t

CONTIGS = [("a", "ACGT" * 60), ("a", "TTTTN" * 20), ("b", ""), ("c", None), (None, "ACGT" * 20), ("é", "éACGT" * 40), ("d", "A" * 64)]


def test_pileup_of_deep_odd_and_repeated_rows(spark):
    rng = np.random.default_rng(3)
    pick = lambda values: values[rng.integers(len(values))]
    rows = [
        (pick(["a", "a", "é", "d", "zz", None]), pick([None, -50, -5, 0, 1, 2, 63, 64, 65, 300]), pick([None, "", "ACGTNé" * 30, "A", "ACGT" * 20]))
        for _ in range(500)
    ] + [("a", 1, "ACGT" * 20)] * 700  # counts beyond a byte
    depth = defaultdict(Counter)
    for contig, pos, seq in rows:
        if contig is not None and pos is not None:
            for i, base in enumerate(seq or ""):
                depth[contig, pos + i][base] += 1
    wanted = Counter()
    for contig, text in CONTIGS:
        for i, ref in enumerate(text or ""):
            seen = depth.get((contig, i + 1))
            if contig is not None and seen:
                wanted[contig, i + 1, ref, sum(seen.values()), *[seen[b] for b in "ACGT"]] += 1
    contigs = spark.createDataFrame(CONTIGS, "contig string, seq string")
    aln = spark.createDataFrame(rows, "contig string, pos int, seq string")
    for parts in (1, 9):
        piled = align.pileup(aln.repartition(parts), contigs)
        assert Counter(map(tuple, piled.collect())) == wanted
    assert align.pileup(aln.limit(0), contigs).count() == 0
    plan = piled._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "hashpartitioning(contig" in plan


def test_counts_travel_in_a_byte_where_it_does(spark):
    rows = [("a", 1 + i % 100, "ACGT" * 20) for i in range(400)]
    aln = spark.createDataFrame(rows, "contig string, pos long, seq string")
    sizes = align._piece_counts(aln.coalesce(1)).select(F.length("counts")).distinct().collect()
    assert [r[0] for r in sizes] == [align.PIECE * 5]


@pytest.mark.parametrize("k", [1, 2, 7, 11, 16, 17, 20, 31])
def test_packed_words_against_strings(k):
    rng = np.random.default_rng(k)
    own = rng.integers(0, 4, 300).astype(np.uint8)
    text = "".join("ACGT"[c] for c in own)
    numbers = codes.words(own, k)
    windows = [text[i : i + k] for i in range(len(text) - k + 1)]
    assert numbers.tolist() == [sum("ACGT".index(c) << 2 * (k - 1 - j) for j, c in enumerate(w)) for w in windows]
    assert codes.spelled(numbers, k).to_pylist() == windows
    starts, lengths = rng.integers(0, 200, 40), rng.integers(1, 101, 40)
    packed, sizes = codes.pack(own, starts, lengths)
    at = np.r_[0, np.cumsum(sizes)]
    for a, b, s, n in zip(at, at[1:], starts, lengths):
        assert codes.unpack(packed[a:b]).tolist() == [*own[s : s + n], *[0] * (4 * int(b - a) - n)]


def test_small_words_take_little_memory():
    import tracemalloc

    own = np.zeros(1 << 20, np.uint8)
    tracemalloc.start()
    codes.words(own, 11)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 20 << 20


def test_reads_are_built_once_to_be_interleaved(spark, tmp_path):
    path = str(tmp_path)
    spark.createDataFrame([(i, "some text " * 20) for i in range(30)], "doc_id long, text string").write.parquet(f"{path}/documents.parquet")
    real = t.plain_reads(spark, path)
    calls = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            calls.add(batch.num_rows)
            yield batch

    try:
        t_plain, t.plain_reads = t.plain_reads, lambda *a: real.mapInArrow(counted, real.schema)
        found = QUERIES["interleave_mates"](spark, path).orderBy("slot").collect()
    finally:
        t.plain_reads = t_plain
    assert [(r.read_id, r.mate) for r in found] == sorted((r.read_id, r.mate) for r in real.collect())
    assert calls.value == len(found)
