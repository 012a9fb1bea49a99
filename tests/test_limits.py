"""Inputs beyond earlier limits, and inputs that used to lose rows."""

import hashlib

import pytest
from pyspark.sql import functions as F

from sluice.functions import text
from sluice.operators import align, graph, incremental, kmers
from sluice.operators import reads as rd
from sluice.operators.compose import Summarise, Where, chain, compare, merge, run
from sluice.sources import files


def test_merge_keeps_keys_of_one_member(spark):
    df = spark.range(10).withColumn("k", F.col("id"))
    count = Summarise("count", ["k"], {"n": "count(1)"})
    tree = merge(low=chain(Where("low", "id < 3"), count), high=chain(Where("high", "id > 7"), count))
    got = {r.k: (r.low_n, r.high_n) for r in run(tree.on("k"), df).collect()}
    assert got == {**{k: (1, None) for k in range(3)}, 8: (None, 1), 9: (None, 1)}
    assert run(tree.on("k", how="inner"), df).count() == 0


def test_compare_refuses_two_values_for_a_key(spark):
    rows = [("a", 1, 5), ("a", 1, 6), ("b", 1, 6)]
    df = spark.createDataFrame(rows, "branch string, k long, v long")
    with pytest.raises(Exception, match="several rows"):
        compare(df, ["k"], "v", ["a", "b"]).collect()
    assert compare(df.where("v = 6"), ["k"], "v", ["a", "b"]).first().agree


def test_globs_match_paths_as_written(spark, tmp_path):
    for name in ("a b/x/one.txt", "a+b/x/two.txt", "a%b/x/three.txt"):
        path = tmp_path / name
        path.parent.mkdir(parents=True)
        path.write_text(name)
    found = files.glob_scan(spark, f"file:{tmp_path}/**/x/*.txt")
    assert {r.file.split(str(tmp_path))[1] for r in found.collect()} == {
        "/a b/x/one.txt", "/a+b/x/two.txt", "/a%b/x/three.txt"
    }
    listed = {r.path.rsplit("/", 1)[1]: r.content_hash for r in files.manifest(spark, f"file:{tmp_path}/**/x/*.txt").collect()}
    assert listed["one.txt"] == hashlib.sha256(b"a b/x/one.txt").hexdigest()


def test_numbers_of_any_length(spark):
    lines = ["7" * 60, "-70", "+66x", " 12", "x1", "", None, "-5"]
    got = text.to_letters(spark.createDataFrame([(v,) for v in lines], "line string")).collect()
    expected = {"7" * 60: int("7" * 60) % 65, "-70": -5, "+66x": 1, " 12": 12, "-5": -5}
    assert {r.line: r.code for r in got} == expected
    assert {r.line: r.letter for r in got}["-5"] == chr(0xFFFB)


def test_fasta_header_with_a_bracket(spark, tmp_path):
    (tmp_path / "a.fa").write_text(">s1 len>100\nAC\nGT\n>s2\nTT\n")
    got = {r.contig: r.seq for r in rd.read_fasta(spark, f"file:{tmp_path}/a.fa").collect()}
    assert got == {"s1": "ACGT", "s2": "TT"}


def test_pipe_sends_no_nulls_and_large_blocks(spark):
    df = spark.createDataFrame([("a",), (None,), ("b  ",)], "line string").coalesce(1)
    assert [r.line for r in files.pipe_command(df, "cat").collect()] == ["a", "b  "]
    many = spark.range(200_000).select(F.concat(F.lit("row "), "id").alias("line"))
    assert files.pipe_command(many, ["cat", "sed s/row/x/"]).distinct().count() == 200_000
    assert files.pipe_command(df, "head -n 1").count() == 1
    with pytest.raises(Exception, match="ended with"):
        files.pipe_command(df, ["cat", "false"]).collect()


def test_long_chains_are_walked(spark):
    n = 103
    edges = spark.createDataFrame([(f"v{k}", f"v{k + 1}") for k in range(n)], "src string, dst string")
    ends = spark.createDataFrame([(f"v{n}",)], "uid string")
    with pytest.raises(ValueError, match="longer than"):
        graph.ancestors(edges, ends, max_depth=2)
    diamond = spark.createDataFrame(
        [("a", "b"), ("a", "c"), ("b", "d"), ("c", "d"), ("a", "d")], "src string, dst string"
    )
    up = graph.ancestors(diamond, spark.createDataFrame([("d",)], "uid string")).collect()
    assert {(r.ancestor, r.distance) for r in up} == {("a", 1), ("b", 1), ("c", 1)}


def test_manifest_with_repeated_keys_and_repeated_writes(spark, tmp_path):
    listing = spark.createDataFrame([("p", "new"), ("q", "h")], "path string, content_hash string")
    known = spark.createDataFrame(
        [("p", "old", 1), ("p", "new", 2), ("q", "h", 3), ("q", "x", 1)],
        "path string, content_hash string, mtime long",
    )
    got = incremental.incremental(listing, known).collect()
    assert sorted((r.path, r.action) for r in got) == [("p", "reuse"), ("q", "reuse")]
    at = f"file:{tmp_path}/manifest"
    incremental.write_manifest(known.limit(1), at)
    merged = incremental.upsert_manifest(incremental.read_manifest(spark, at), known.where("path = 'q' and mtime = 3"))
    assert {r.path for r in incremental.write_manifest(merged, at).collect()} == {"p", "q"}
    assert incremental.read_manifest(spark, at).count() == 2


def test_wide_sketch(spark):
    reads = spark.createDataFrame([("r", 1, "ACGTACGTACGTACGTACGTACGT", "")], "read_id string, mate int, seq string, qual string")
    width = 300_000
    sketch = kmers.kmer_sketch(reads, 20, width)
    exact = {r.kmer: r.n for r in kmers.kmer_count(reads, 20).collect()}
    got = kmers.sketch_estimate(kmers.kmer_count(reads, 20), sketch, width).collect()
    assert {r.kmer: r.estimate for r in got} == exact


def _binned(spark, tmp_path, rows, bin):
    aln = spark.createDataFrame(rows, "contig string, pos long, len int, read_id int")
    path = f"file:{tmp_path}/binned"
    align.write_binned(aln, path, bin)
    return path


REGION = "region string, contig string, start long, end long"


@pytest.mark.parametrize("few", [100_000, -1])
def test_regions_of_a_stored_index(spark, tmp_path, monkeypatch, few):
    """Short and long alignments on several contigs, met by bins of every level."""
    monkeypatch.setattr(align, "BROADCAST_BINS", few)
    rows = [(f"c{k % 5}", (k * 37) % 9000, 30 if k % 4 else 10 ** (1 + k % 5), k) for k in range(600)]
    path = _binned(spark, tmp_path, rows, 100)
    stored = spark.read.parquet(path)
    assert stored.count() == align.read_binned(spark, path).count() == 600
    level = F.floor(F.col("tile") / align.SHARDS) % (align.LEVELS + 1)
    assert stored.select(level).distinct().count() > 3
    asked = [(f"r{k}", f"c{k % 6}", 150 * k, 150 * k + (5000 if k % 7 == 0 else 60)) for k in range(60)]
    asked += [("twice", "c1", 10, 20), ("twice", "c1", 10, 20), ("none", "c1", 20, 10)]
    got = align.read_regions(spark, path, spark.createDataFrame(asked, REGION), 100).collect()
    expected = [(n, k) for n, g, a, b in asked if a <= b for c, p, z, k in rows if c == g and p <= b and p + z - 1 >= a]
    assert sorted((r.region, r.read_id) for r in got) == sorted(expected)
    assert align.read_regions(spark, path, spark.createDataFrame([], REGION), 100).count() == 0


def test_regions_read_the_folders_of_their_bins_only(spark, tmp_path):
    """Every file in a folder that no region asks for is overwritten: it is not opened."""
    rows = [(f"c{k % 5}", (k * 37) % 9000, 30, k) for k in range(600)]
    path = _binned(spark, tmp_path, rows, 100)
    asked = [("r", "c1", 1000, 1250), ("s", "c1", 1240, 1240)]
    table = spark.createDataFrame(asked, REGION)
    table.write.parquet(f"file:{tmp_path}/regions")
    schema = spark.read.parquet(path).schema
    shard = spark.range(1).select(F.pmod(F.xxhash64(F.lit("c1")), F.lit(align.SHARDS))).first()[0]
    wanted = {(level, b) for level in range(align.LEVELS) for b in range(1000 // (100 << 3 * level), 1250 // (100 << 3 * level) + 1)}
    spoiled = 0
    for file in (tmp_path / "binned").rglob("*.parquet"):
        rest, own = divmod(int(file.parent.name.removeprefix("tile=")), align.SHARDS)
        number, level = divmod(rest, align.LEVELS + 1)
        if own != shard or level < align.LEVELS and (level, number) not in wanted:
            file.write_bytes(b"spoiled")
            (file.parent / f".{file.name}.crc").unlink(missing_ok=True)
            spoiled += 1
    regions = spark.read.parquet(f"file:{tmp_path}/regions")
    found = align.read_regions(spark, path, regions, 100, schema)
    expected = [(n, k) for n, g, a, b in asked for c, p, z, k in rows if c == g and p <= b and p + z - 1 >= a]
    spark.conf.set("spark.sql.files.ignoreCorruptFiles", "false")
    assert sorted((r.region, r.read_id) for r in found.collect()) == sorted(expected) and spoiled > 100
