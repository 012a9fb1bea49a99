"""What travels between tasks or is written on the way: packed rows, and nothing twice."""

import os
import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from __spark_entry__ import queries
from sluice.operators import align, kmers, skew
from sluice.operators import packed as codes
from sluice.session import shared_dir

TEXTS = st.lists(st.none() | st.text("ACGT", max_size=9) | st.text("ACGTNé😀", max_size=5), max_size=8)


@settings(max_examples=200, deadline=None)
@given(TEXTS)
def test_sequences_in_two_bits_a_base(rows):
    for column in (pa.array(rows, pa.string()), pa.array([*rows, "GATTACA"], pa.string()).slice(len(rows) // 2)):
        assert codes.restored(codes.shrunk(column)).to_pylist() == column.to_pylist()
    assert len(codes.shrunk(pa.array(["ACGT" * 20]))[0].as_py()) == 21


@settings(max_examples=100, deadline=None)
@given(TEXTS, st.lists(st.none() | st.integers(-(1 << 63), (1 << 63) - 1), min_size=8, max_size=8), st.integers(0, 8))
def test_bundled_columns(texts, numbers, cut):
    n, cut = len(texts), min(cut, len(texts))
    bounds = np.unique([0, cut, n])
    for column in (pa.array(texts, pa.string()), pa.array(numbers[:n], pa.int64()), pa.array([x is None for x in texts], pa.bool_())):
        halves = codes.bundle(column, bounds)
        got = codes.unbundle(*[pa.chunked_array([h]) for h in halves], np.diff(bounds), column.type)
        assert got.type == column.type and got.to_pylist() == column.to_pylist()


def written(spark):
    path = shared_dir(spark).removeprefix("file:")
    return sorted(os.listdir(path)) if os.path.isdir(path) else []


def new_tables(spark, query, sf):
    before = written(spark)
    queries()[query](spark, sf).collect()
    return [name.rsplit("-", 1)[0] for name in written(spark) if name not in before]


@pytest.mark.parametrize("query", ["seed_map", "seed_map_strands", "mapper_compare", "mapper_agreement"])
def test_an_index_for_one_mapping_is_not_stored(spark, sf, query):
    assert "index" not in new_tables(spark, query, sf)


def test_mapped_and_filtered_reads_are_made_once(spark, sf):
    """They are sorted, and a sort first samples its input."""
    made = new_tables(spark, "variants_end_to_end", sf)
    assert [made.count(label) for label in ("kmc", "khmer", "mapped")] == [1, 1, 2]


def test_the_view_is_compressed(spark, sf):
    before = written(spark)
    queries()["depth_end_to_end"](spark, sf).collect()
    views = [name for name in written(spark) if name.startswith("view-") and name not in before]
    files = [f for v in views for f in os.listdir(f"{shared_dir(spark).removeprefix('file:')}/{v}") if f.startswith("part-")]
    assert len(views) == 2 and files and all(f.endswith(".gz") for f in files)


def test_alignments_of_any_letters_are_sorted_and_stored(spark, tmp_path):
    rng = random.Random(4)
    rows = [(f"r{i % 40}", 1 + i // 40, f"c{i % 3}", 1 + 70 * i, "".join(rng.choices("ACGTN"[: 4 + i % 2], k=i % 50))) for i in range(80)]
    rows = [(*r, len(r[-1])) for r in rows] + [("none", 1, "c0", 9000, None, 10)]
    aln = spark.createDataFrame(rows, "read_id string, mate int, contig string, pos long, seq string, len int")
    ranked = align.coord_sort(aln)
    assert [tuple(r)[:-1] for r in ranked.orderBy("rank").collect()] == sorted(rows, key=lambda r: (r[2], r[3], r[0], r[1]))
    align.write_binned(ranked, f"{tmp_path}/binned")
    assert sorted(map(tuple, align.read_binned(spark, f"{tmp_path}/binned").select(aln.columns).collect())) == sorted(rows)
    other = aln.select("read_id", "mate").where("mate = 2")
    kept = skew.join_reads(aln, other, ["read_id", "mate"], "left_anti")
    assert sorted(map(tuple, kept.select(aln.columns).collect())) == sorted(r for r in rows if r[1] == 1)


def test_ids_of_other_types_are_mapped(spark):
    """Numbers are bundled, other types travel as rows."""
    rng = random.Random(6)
    text = "".join(rng.choices("ACGT", k=400))
    contigs = spark.createDataFrame([(1, "a", text)], "ord long, contig string, seq string")
    setting = dict(k=16, stride=27, n_seeds=3, min_votes=2)
    for kind in ("int", "string", "double"):
        rows = spark.createDataFrame([(i, 1, text[i : i + 90]) for i in range(0, 300, 7)], "read_id int, mate int, seq string")
        reads = rows.withColumn("read_id", rows.read_id.cast(kind))
        for stored in (True, False):
            index = align.build_index(contigs, stored=stored, **setting)
            got = align.seed_map(reads, index, contigs, **setting).select("read_id", "pos").collect()
            assert {int(float(r.read_id)): r.pos for r in got} == {i: i + 1 for i in range(0, 300, 7)}


@pytest.mark.parametrize("at_once", [7, 1 << 19])
@pytest.mark.parametrize("k", [3, 5, 20, 33])
def test_seeds_of_a_contig_are_counted_in_pieces_too(spark, monkeypatch, at_once, k):
    monkeypatch.setattr(align, "SEEDS", at_once)
    rng = random.Random(8)
    rows = [(i, f"c{i % 9}", "".join(rng.choices("ACGT" if i % 4 else "ACGTNé😀", k=rng.randrange(60)))) for i in range(20)]
    rows += [(20, "c1", "ACGT" * 20), (21, None, "ACGTTGCAAC" * 4), (22, "none", None), (23, "short", "A"), (24, "empty", "")]
    contigs = spark.createDataFrame(rows, "ord long, contig string, seq string")
    seeds = align.seed_index(contigs.repartition(2, "contig").sortWithinPartitions("contig"), k)
    expected = [(s[i : i + k], c, i + 1) for _, c, s in rows for i in range(len(s or "") - k + 1)]
    assert sorted(map(tuple, seeds.collect()), key=str) == sorted(expected, key=str)
    got = {r.contig: tuple(r)[1:] for r in align.seed_report(seeds).collect()}
    for name in {c for _, c, _ in expected}:
        own = [(w, p) for w, c, p in expected if c == name]
        words = [w.encode() for w, _ in own]
        assert got.pop(name) == (len(own), len(set(words)), sum(p for _, p in own), min(words).decode(), max(words).decode())
    assert not got


@pytest.mark.parametrize("letters", ["ACGT", "ACGTN"])
def test_no_runs_are_stored_for_counting(spark, letters):
    rng = random.Random(9)
    genome = "".join(rng.choices(letters, k=2000))
    rows = [(f"r{i}", 1, genome[at : at + 70]) for i, at in enumerate(rng.choices(range(1900), k=400))]
    reads = spark.createDataFrame(rows, "read_id string, mate int, seq string")
    before = written(spark)
    expected = {r.kmer: r.n for r in kmers._string_counts(kmers.explode_kmers(reads, 20)).collect()}
    counts = kmers.kmer_count(reads, 20)
    assert {r.kmer: r.n for r in counts.collect()} == expected and written(spark) == before
    stored = kmers.store_counts(counts)
    assert {r.kmer: r.n for r in stored.collect()} == expected
    assert [name.rsplit("-", 1)[0] for name in written(spark) if name not in before] == ["counts"]


def test_runs_of_a_read_take_few_bytes(spark):
    """Lengths, places and names of runs travel by weight, many in a row."""
    rng = random.Random(10)
    table = pa.table({"seq": ["".join(rng.choices("ACGT", k=80)) for _ in range(4000)]})
    reads = spark.createDataFrame(table.to_pandas())
    rows = kmers._bucketed_runs(reads.coalesce(1), 20, True, 64, np.array([], np.int64), False).collect()
    assert len(rows) <= 64  # 4000 reads are one stretch
    lengths = b"".join(bytes(r.lengths[r.runs :]) for r in rows)
    assert not any(lengths)  # no length needs a second byte


def test_buckets_follow_the_size_of_the_reads(spark, monkeypatch, tmp_path):
    spark.createDataFrame([("r", 1, "ACGT" * 30)], "read_id string, mate int, seq string").write.parquet(f"{tmp_path}/reads")
    reads, tasks = spark.read.parquet(f"{tmp_path}/reads"), kmers._tasks(spark.range(1))
    assert kmers._buckets(reads, 64) == 64 * tasks
    monkeypatch.setattr(kmers, "BUCKET_BYTES", 1)
    assert kmers._buckets(reads, 64) > 64 * tasks
    unknown = spark.createDataFrame([("r", 1, "ACGT")], "read_id string, mate int, seq string")
    assert kmers._buckets(unknown, 64) == 64 * tasks


@pytest.mark.parametrize("limit", [-1, 1 << 800])
def test_large_mappings_are_stored_before_hot_keys_are_looked_for(spark, monkeypatch, limit):
    monkeypatch.setattr(align, "SALT_FROM_BYTES", limit)
    text = "".join(random.Random(7).choices("ACGT", k=300))
    contigs = spark.createDataFrame([(1, "a", text)], "ord long, contig string, seq string")
    reads = spark.createDataFrame([(f"r{i}", 1, text[i : i + 90]) for i in (0, 50, 200)], "read_id string, mate int, seq string")
    before = written(spark)
    got = align.seed_map(reads, align.build_index(contigs, stored=False), contigs).collect()
    assert {r.read_id: r.pos for r in got} == {"r0": 1, "r50": 51, "r200": 201}
    assert [n.rsplit("-", 1)[0] for n in written(spark) if n not in before] == ["placed"] * (limit < 0)
