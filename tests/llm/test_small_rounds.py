"""Rounds of few edges are written in few files, however many partitions a shuffle has."""

import random

from sluice.llm import components as module
from sluice.llm.components import components


def by_hand(edges):
    label = {n: n for e in edges for n in e}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            low = min(label[a], label[b])
            changed |= label[a] != low or label[b] != low
            label[a] = label[b] = low
    return label


def test_few_edges_are_few_files(spark, monkeypatch):
    written, store = [], module.materialize
    monkeypatch.setattr(module, "materialize", lambda df, label: (written.append(store(df, label)), written[-1])[1])
    rng = random.Random(3)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(300)] + [(500 + k, 501 + k) for k in range(200)]
    edges = [(a, b) for a, b in edges if a != b]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    coalesce = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    spark.conf.set(coalesce, "false")
    try:
        given = store(spark.createDataFrame(edges, "a long, b long").repartition(9), "given")
        got = {r.node: r.label for r in components(given).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset(coalesce)
    assert got == by_hand(edges)
    assert max(len(df.inputFiles()) for df in written) <= spark.sparkContext.defaultParallelism
