"""Sweeps over a table of thresholds, outputs at leaves, sketches built for an error, palindromes."""

import random
from collections import Counter

from pyspark.sql import functions as F

from sluice.operators import graph, kmers
from sluice.operators import reads as rd
from sluice.operators.compose import sweep_above

ROWS = "kind string, x double, w long"
PARAMS = "param_id int, threshold double"


def test_sweep_above_against_all_pairs(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["a", "b", None]), rng.choice([None, *range(40)]), rng.randrange(9)) for _ in range(600)]
    rows = [(k, None if x is None else float(x), w) for k, x, w in rows] + [("hot", 7.0, 1)] * 500
    params = [(i, float(rng.randrange(-3, 45))) for i in range(200)] + [(200, None), (201, 7.0), (202, 7.0)]
    got = sweep_above(spark.createDataFrame(rows, ROWS), spark.createDataFrame(params, PARAMS), "x", {"n": "1", "w": "w"}, ["kind"])
    expected = Counter()
    weight = Counter()
    for i, level in params:
        for k, x, w in rows:
            if level is not None and x is not None and x > level:
                expected[i, level, k] += 1
                weight[i, level, k] += w
    assert {(r.param_id, r.threshold, r.kind): r.n for r in got.collect()} == dict(expected)
    assert {(r.param_id, r.threshold, r.kind): r.w for r in got.collect()} == dict(weight)


def test_sweep_above_without_groups_or_rows(spark):
    params = spark.createDataFrame([(1, 0.0), (2, 5.0), (3, 9.0)], PARAMS)
    rows = spark.createDataFrame([("a", 1.0, 2), ("b", 5.0, 3), ("b", 6.0, 4)], ROWS)
    got = sweep_above(rows, params, "x", {"n": "1", "w": "w"}).collect()
    assert sorted(map(tuple, got)) == [(1, 0.0, 3, 9), (2, 5.0, 1, 4)]
    assert sweep_above(rows.limit(0), params, "x", {"n": "1"}).count() == 0
    assert sweep_above(rows, params.limit(0), "x", {"n": "1"}).count() == 0


def test_the_plan_of_a_sweep_does_not_grow_with_its_values(spark):
    rows = spark.createDataFrame([("a", float(i), 1) for i in range(50)], ROWS)
    sizes = []
    for n in (3, 1000):
        params = spark.range(n).select(F.col("id").cast("int").alias("param_id"), (F.col("id") / 20).alias("threshold"))
        swept = sweep_above(rows, params, "x", {"n": "1"}, ["kind"])
        sizes.append(len(swept._jdf.queryExecution().optimizedPlan().toString().splitlines()))
        assert swept.count() == min(n, 980)  # no row is above 49
    assert sizes[0] == sizes[1]


def test_outputs_at_the_leaves_of_a_fork(spark):
    edges = spark.createDataFrame([("a", "b"), ("a", "c"), ("b", "d"), ("c", "d"), ("c", "e")], "src string, dst string")
    vertices = spark.createDataFrame([(u,) for u in "abcdef"], "uid string")
    outputs = spark.createDataFrame([("d", "d.txt"), ("a", "a.txt")], "uid string, file string")
    got = graph.leaf_outputs(graph.leaf_paths(vertices, edges), outputs).collect()
    assert Counter(("".join(r.path), r.file) for r in got) == Counter(
        {("abd", "d.txt"): 1, ("acd", "d.txt"): 1, ("ace", None): 1, ("f", None): 1}
    )


def test_sketch_keeps_its_bound(spark):
    rng = random.Random(2)
    reads = [(f"r{i}", 1, "".join(rng.choices("ACGT", k=rng.randrange(90))) + "N" * (i % 3)) for i in range(300)]
    reads = spark.createDataFrame(reads + [("hot", 1, "ACGTTGCA" * 40)] * 20, "read_id string, mate int, seq string")
    counts = kmers.kmer_count(reads, 8).cache()
    total = counts.agg(F.sum("n")).first()[0]
    for eps, confidence in ((0.01, 0.9), (0.001, 0.99)):
        sketch = kmers.bounded_sketch(reads, 8, eps, confidence)
        got = kmers.bounded_estimates(counts, sketch).collect()
        assert len(got) == counts.count() and all(r.estimate >= r.n for r in got)
        assert sum(r.estimate > r.n + eps * total for r in got) <= (1 - confidence) * len(got)
        assert len(sketch.first().sketch) <= 20 + 8 * 7 * (2 / eps + 2)
    nothing = kmers.bounded_sketch(reads.limit(0), 8, 0.01, 0.9)
    assert {r.estimate for r in kmers.bounded_estimates(counts, nothing).collect()} == {0}


def test_palindromes_against_plain_python(spark):
    rng = random.Random(3)
    flip = lambda s: s[::-1].translate(str.maketrans("ACGT", "TGCA"))
    dna = lambda n: "".join(rng.choices("ACGT", k=n))
    pairs = [("short", "ACGT", "ACGT"), ("empty", "", dna(30)), ("whole", "ACGT" * 10, "ACGT" * 10)]
    for i in range(120):
        fragment = dna(rng.randrange(8, 60))
        wrong = flip(fragment) if i % 3 else flip(fragment)[:-1] + "N"
        pairs.append((f"p{i}", (fragment + dna(50))[:50], (wrong + dna(50))[:50]))
    rows = [(n, m, s, list(range(len(s)))) for n, *ends in pairs for m, s in enumerate(ends, 1)]
    rows += [("alone", 1, dna(40), list(range(40))), ("null", 1, None, None), ("null", 2, dna(40), list(range(40)))]
    got = rd.palindrome_clip(spark.createDataFrame(rows, "read_id string, mate int, seq string, qual array<int>"), 12).collect()
    found = {n: [k for k in range(12, min(len(a), len(b))) if a[:k] == flip(b[:k])] for n, a, b in pairs}
    assert len(got) == len(rows) and sum(bool(k) for k in found.values()) > 50
    by_key = {(n, m): s for n, m, s, _ in rows}
    for r in got:
        cut = max(found.get(r.read_id) or [0]) or None
        whole = by_key[r.read_id, r.mate]
        assert r.fragment == cut and r.seq == (whole if cut is None or whole is None else whole[:cut])
        assert r.seq is None or r.qual == list(range(len(r.seq)))


def test_ends_that_meet_are_searched_not_tried_length_by_length(spark):
    """Half a million bases: every length compared would be too many letters."""
    rng = random.Random(4)
    text = "".join(rng.choices("ACGT", k=400_000))
    back = text[::-1].translate(str.maketrans("ACGT", "TGCA"))
    rows = [("p", 1, text + "A" * 20), ("p", 2, back + "C" * 30), ("q", 1, "A" * 300), ("q", 2, "T" * 200), ("r", 1, text), ("s", 1, None), ("s", 2, back)]
    got = rd.palindrome_clip(spark.createDataFrame(rows, "read_id string, mate int, seq string")).collect()
    assert {(r.read_id, r.mate): r.fragment for r in got} == {("p", 1): 400_000, ("p", 2): 400_000, ("q", 1): 199, ("q", 2): 199, ("r", 1): None, ("s", 1): None, ("s", 2): None}


def test_mates_are_written_without_a_sort(spark, tmp_path, monkeypatch):
    reads = spark.createDataFrame([(f"r{i}", m, "ACGT") for i in range(50) for m in (1, 2, None)], "read_id string, mate int, seq string")
    seen = []
    monkeypatch.setattr(type(reads.write), "partitionBy", lambda self, *c, old=type(reads.write).partitionBy: (seen.append(spark.conf.get("spark.sql.maxConcurrentOutputFileWriters")), old(self, *c))[1])
    rd.write_mates(reads, f"{tmp_path}/mates")
    assert seen == ["4"] and spark.conf.get("spark.sql.maxConcurrentOutputFileWriters") == "0"
    back = spark.read.parquet(f"{tmp_path}/mates")
    assert sorted(map(str, back.select("read_id", "mate", "seq").collect())) == sorted(map(str, reads.collect()))
