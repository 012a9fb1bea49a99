"""Packed k-mers against plain strings: odd letters, long and repeated reads, every bucket size."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sluice.operators import kmers
from sluice.operators import packed as codes

READS = "read_id string, mate int, seq string"


def comp(seq):
    return seq[::-1].translate(str.maketrans("ACGT", "TGCA"))


def plain_counts(reads, k, canonical=True):
    every = Counter()
    for _, _, seq in reads:
        for i in range(len(seq or "") - k + 1):
            word = seq[i : i + k]
            every[min(word, comp(word)) if canonical else word] += 1
    return every


@pytest.fixture(scope="module")
def sample():
    rng = random.Random(17)
    genome = "".join(rng.choices("ACGT", k=3000))
    reads = []
    for i in range(900):
        at = rng.randrange(len(genome) - 90)
        seq = genome[at : at + rng.randrange(5, 90)]
        if i % 11 == 0:
            seq = seq[: len(seq) // 2] + rng.choice("NnéX😀") + seq[len(seq) // 2 :]
        reads.append((f"r{i}", i % 2, comp(seq) if i % 3 == 0 else seq))
    reads += [(f"a{i}", 1, "A" * 60) for i in range(500)]  # a third of all reads are one repeat
    reads += [(f"g{i}", 1, genome[:200] * 2) for i in range(50)]
    reads += [("long", 1, genome * 3), ("none", 1, None), ("empty", 1, ""), ("short", 1, "ACG"), ("n", 1, "N" * 40)]
    return reads


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("ACGTN", max_size=60), max_size=6), st.integers(2, 31))
def test_words_and_super_kmers(rows, k):
    import pyarrow as pa

    data, offsets = codes.flat(pa.array(rows, pa.string()))
    coded = codes.code_table()[data]
    starts, lengths, least = codes.super_kmers(coded, offsets, k, min(5, k), True)
    text = "".join(rows)
    got = Counter()
    for s, n in zip(starts, lengths, strict=True):
        run = text[s : s + n]
        assert set(run) <= set("ACGT")
        got.update(min(run[i : i + k], comp(run[i : i + k])) for i in range(n - k + 1))
    expected = Counter({w: n for w, n in plain_counts([(0, 0, r) for r in rows], k).items() if "N" not in w})
    assert got == expected and len(least) == len(starts)
    if len(starts):
        packed, sizes = codes.pack(coded, starts, lengths)
        unpacked = codes.unpack(packed)
        at = 4 * np.r_[0, np.cumsum(sizes)]
        for s, n, a in zip(starts, lengths, at[:-1], strict=True):
            assert "".join("ACGT"[c] for c in unpacked[a : a + n]) == text[s : s + n]
        numbers = codes.canonical_words(unpacked, k)
        assert codes.spelled(numbers[at[:1]], k).to_pylist()[0] in expected


def test_equal_kmers_share_a_minimiser():
    import pyarrow as pa

    rng = random.Random(1)
    genome = "".join(rng.choices("ACGT", k=400))
    bucket = {}
    for seq in (genome, comp(genome), genome[37:301]):
        data, offsets = codes.flat(pa.array([seq]))
        for s, n, m in zip(*codes.super_kmers(codes.code_table()[data], offsets, 20, 11, True), strict=True):
            for i in range(s, s + n - 19):
                word = min(seq[i : i + 20], comp(seq[i : i + 20]))
                assert bucket.setdefault(word, m) == m


@pytest.mark.parametrize("k, canonical, at_once", [(20, True, 1 << 22), (20, True, 0), (31, True, 64), (5, False, 100), (33, True, 0)])
def test_counts_equal_plain_counts(spark, sample, monkeypatch, k, canonical, at_once):
    monkeypatch.setattr(kmers, "TASK_BYTES", at_once)
    got = kmers.kmer_count(spark.createDataFrame(sample, READS).repartition(5), k, canonical).collect()
    assert {r.kmer: r.n for r in got} == plain_counts(sample, k, canonical) and len(got) == len({r.kmer for r in got})


def test_pieces_cover_long_rows():
    data, offsets = np.zeros(1000, np.uint8), np.array([0, 0, 400, 1000])
    seen = []
    for begin, own, cut in codes.pieces(data, offsets, 20, 64):
        seen += (begin + np.flatnonzero(codes.within(cut, own == 0, 20))).tolist()
    assert seen == [*range(0, 381), *range(400, 981)]


@pytest.mark.parametrize("bits", [28, 16, 8])
def test_rare_kmers_are_found_whatever_the_size_of_the_filter(spark, sample, monkeypatch, bits):
    monkeypatch.setattr(kmers, "BLOOM_BITS", bits)
    k = 20
    counts = plain_counts(sample, k)
    reads = spark.createDataFrame(sample, READS).repartition(4)
    stored = kmers.kmer_count(reads, k).cache()
    rare = {
        (n, m): [i for i in range(len(s or "") - k + 1) if counts[min(s[i : i + k], comp(s[i : i + k]))] <= 3]
        for n, m, s in sample
    }
    kept = kmers.filter_reads_by_kmer(reads, stored, k, cx=3, max_hits=2).collect()
    assert {r.read_id for r in kept} == {n for (n, _), at in rare.items() if len(at) <= 2}
    cut = kmers.trim_low_abundance(reads, stored, k, cutoff=4).collect()
    expected = {n: s[: rare[n, m][0] + k - 1] if rare[n, m] else s for n, m, s in sample}
    assert {r.read_id: r.seq for r in cut} == expected


def test_no_occurrence_is_shuffled_again(spark, sample):
    """Only positions that the filter lets through are rows of the join."""
    k = 20
    reads = spark.createDataFrame(sample, READS)
    stored = kmers.kmer_count(reads, k).cache()
    hits = kmers._rare_hits(reads, stored, k, 3, True).count()
    counts = plain_counts(sample, k)
    assert hits == sum(n for n in counts.values() if n <= 3) < 0.5 * sum(counts.values())


def test_sketches_take_each_kmer_once(spark, sample):
    """Both sketches equal those of Spark over every occurrence, and no occurrence is a row."""
    reads = spark.createDataFrame(sample, READS)
    every = kmers.explode_kmers(reads, 20).select(F.xxhash64("kmer").alias("number"), "kmer")
    plain = every.agg(F.count_min_sketch("number", F.lit(0.01), F.lit(0.9), F.lit(7)).alias("sketch")).first()["sketch"]
    own = kmers.bounded_sketch(reads, 20, 0.01, 0.9)
    assert bytes(own.first()["sketch"]) == bytes(plain)
    slots = Counter()
    for word, n in plain_counts(sample, 20).items():
        digest = hashlib.md5(word.encode()).hexdigest()
        slots.update({(t, int(digest[8 * t : 8 * t + 7], 16) % 512): n for t in range(4)})
    sketch = kmers.kmer_sketch(reads, 20, 512)
    assert {(r.tab, r.slot): r.n for r in sketch.collect()} == slots
    assert not any("Generate explode" in d._jdf.queryExecution().optimizedPlan().toString().split("+- Union")[0] for d in (own, sketch))


@pytest.mark.parametrize("at_once, share", [(1 << 27, 1 << 40), (50, 1 << 40), (1 << 27, 0)])
def test_runs_meet_rare_kmers_in_every_part_of_a_hot_bucket(spark, sample, monkeypatch, at_once, share):
    monkeypatch.setattr(kmers, "BLOOM_SHARE", share)  # without and with a filter at the scan
    monkeypatch.setattr(kmers, "SALT_FROM_BYTES", -1)
    monkeypatch.setattr(kmers, "GROUP_KMERS", at_once)
    reads = spark.createDataFrame(sample, READS).repartition(4)
    counts = plain_counts(sample, 20)
    stored = kmers.kmer_count(reads, 20).cache()
    runs = kmers._rare_runs(reads, stored, 20, 3, True).collect()
    got = sorted((r.read_id, r.mate, at) for r in runs for at in r.ats)
    assert got == sorted(
        (n, m, i) for n, m, s in sample for i in range(len(s or "") - 19) if counts[min(s[i : i + 20], comp(s[i : i + 20]))] <= 3
    )
    plain = {n for n, _, s in sample if not set(s or "") - set("ACGT")}
    own = [r.ats for r in runs if r.read_id in plain]
    assert len(own) < 0.5 * sum(map(len, own))  # a row is a run of k-mers


@pytest.mark.parametrize("at_once", [1 << 22, 0])
def test_windows_of_texts_travel_in_runs(spark, monkeypatch, at_once):
    monkeypatch.setattr(kmers, "TASK_BYTES", at_once)
    rng = random.Random(8)
    words = ["one ", "zwölf ", "три ", "four\n", "😀😀 ", "a" * 30]
    texts = ["".join(rng.choices(words, k=rng.randrange(60))) for _ in range(80)] + ["", None, "short", "x" * 19, "é" * 21]
    expected = Counter(x[i : i + 20] for x in texts for i in range(len(x or "") - 19))
    table = spark.createDataFrame([(x,) for x in texts], "seq string").repartition(3)
    got = kmers.kmer_count(table, 20, canonical=False, packed=False)
    rows = got.collect()
    assert {r.kmer: r.n for r in rows} == expected and len(rows) == len(expected)
    monkeypatch.setattr(kmers, "_hashes", lambda letters, k: letters[: max(len(letters) - k + 1, 0)].astype(np.uint64) % np.uint64(3))
    assert {r.kmer: r.n for r in kmers.kmer_count(table, 20, canonical=False, packed=False).collect()} == expected
    stored = sum(kmers._text_runs(table, 20).select(F.length("runs")).toPandas().iloc[:, 0])
    assert stored < 13 * sum(expected.values())
