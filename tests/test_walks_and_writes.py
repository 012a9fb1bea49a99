"""Ancestors by doubling, and validation while writing."""

import random
from collections import deque

import pytest
from pyspark.sql import functions as F

from sluice.operators import graph, validate

EDGES = "src string, dst string"


def plain_ancestors(edges, targets):
    up = {}
    for a, b in edges:
        up.setdefault(b, set()).add(a)
    out = set()
    for target in targets:
        seen, todo = {}, deque((a, 1) for a in up.get(target, ()))
        while todo:
            node, distance = todo.popleft()
            if node not in seen:
                seen[node] = distance
                todo += [(a, distance + 1) for a in up.get(node, ())]
        out |= {(target, a, d) for a, d in seen.items()}
    return out


def test_a_chain_of_ten_thousand_takes_few_rounds(spark, monkeypatch):
    stored = []
    materialize = graph.materialize
    monkeypatch.setattr(graph, "materialize", lambda df, label="table": stored.append(label) or materialize(df, label))
    n = 10_000
    edges = spark.range(n).select(F.concat(F.lit("v"), "id").alias("src"), F.concat(F.lit("v"), (F.col("id") + 1)).alias("dst"))
    end = spark.createDataFrame([(f"v{n}",)], "uid string")
    got = graph.ancestors(edges, end)
    assert got.agg(F.count("ancestor"), F.sum("distance"), F.max("distance")).first()[:] == (n, n * (n + 1) // 2, n)
    assert stored.count("found") < 20
    short = graph.ancestors(edges, spark.createDataFrame([("v3",), ("v0",), ("v3",), ("nowhere",)], "uid string"))
    assert {(r.ancestor, r.distance) for r in short.collect()} == {("v2", 1), ("v1", 2), ("v0", 3)}


@pytest.mark.parametrize("cyclic", [False, True])
def test_smallest_distances_in_graphs_with_many_paths(spark, cyclic):
    rng = random.Random(4)
    edges = {(f"n{a}", f"n{b}") for a, b in (sorted(rng.sample(range(60), 2)) for _ in range(110))}
    edges |= {("hub", f"n{k}") for k in range(60)}
    if cyclic:
        edges |= {("n50", "n3"), ("n7", "n7"), ("n20", "hub")}
    targets = ["n59", "n30", "n3", "n7", "hub"]
    got = graph.ancestors(spark.createDataFrame(sorted(edges) * 2, EDGES), spark.createDataFrame([(u,) for u in targets], "uid string"))
    assert sorted(map(tuple, got.collect())) == sorted(plain_ancestors(edges, targets))


def test_validation_in_the_writing_pass_equals_the_report(spark, tmp_path):
    rows = [(f"p{k}", None if k % 13 == 0 else k % 7, None if k % 17 == 0 else f"h{k % 5}", k % 3) for k in range(500)]
    df = spark.createDataFrame(rows, "path string, size long, content_hash string, mtime long").repartition(5)
    known = [(f"p{k}", f"h{k % 4}", k % 3, ) for k in range(0, 500, 2)] + [("p0", "old", -1), ("gone", "h", 1)]
    manifest = spark.createDataFrame(known, "path string, content_hash string, mtime long")
    target = f"file:{tmp_path}/out"
    got = validate.write_validated(df, manifest, target)
    report = validate.all_valid(validate.validate(df, manifest), "check")
    columns = ["check", "valid", "n_checks", "n_failed"]
    assert sorted(map(tuple, got.select(columns).collect())) == sorted(map(tuple, report.select(columns).collect()))
    back = spark.read.parquet(target)
    assert sorted(map(repr, back.collect())) == sorted(map(repr, df.collect()))
    first = got.first()
    assert (first.n_rows, first.n_nulls) == (500, sum(v is None for r in rows for v in r))
    again = validate.write_validated(df.repartition(2), manifest, f"file:{tmp_path}/again", ["hash"]).first()
    assert again.digest == first.digest
    other = validate.write_validated(df.withColumn("size", F.lit(1)), manifest, f"file:{tmp_path}/other", ["hash"]).first()
    assert other.digest != first.digest
    none = validate.write_validated(df.where("1 = 0"), manifest, f"file:{tmp_path}/none").collect()
    assert all(r.valid and r.n_rows == 0 for r in none)


def test_tasks_that_look_for_ends_follow_the_size(spark, monkeypatch):
    """Shuffled rows are not put together into few large sorts."""
    monkeypatch.setattr(graph, "TASK_BYTES", 1 << 10)
    vertices = spark.range(2000).selectExpr("cast(id as string) as uid", "'x' as name")
    edges = spark.range(1, 2000).selectExpr("cast(id div 2 as string) as src", "cast(id as string) as dst")
    top, low = graph.sources(vertices, edges), graph.sinks(vertices, edges)
    assert [r.uid for r in top.collect()] == ["0"] and low.count() == 1000
    assert top.rdd.getNumPartitions() >= 20
