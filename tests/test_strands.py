"""Reads of either strand against plain counting of votes."""

import os
import random
from collections import Counter, defaultdict

import pytest

from sluice.operators import align

K, STRIDE = 5, 6


def comp(seq):
    return seq[::-1].translate(str.maketrans("ACGT", "TGCA"))


@pytest.fixture(scope="module")
def genome():
    rng = random.Random(23)
    rows = []
    for order in range(6):
        seq = "".join(rng.choices("ACGT", k=300))
        if order % 2:
            seq += comp(seq[50:150]) + "ACGT" * 20 + "AAAAATTTTT" * 6  # repeats and palindromes
        rows.append((order, f"c{order}", seq))
    return [*rows, (6, "odd", "ACGTN" * 20), (7, "short", "ACG"), (8, "none", None)]


def best_place(genome, seq, n_seeds, min_votes, strands):
    places = defaultdict(list)
    for order, _, text in genome:
        for i in range(len(text or "") - K + 1):
            places[text[i : i + K]].append((order, i + 1))
    votes = Counter()
    for strand in strands:
        for s in range(n_seeds):
            word = seq[s * STRIDE : s * STRIDE + K]
            if len(word) < K or set(word) - set("ACGT"):
                continue
            shift = s * STRIDE if strand == "+" else len(seq) - s * STRIDE - K
            for order, pos in places[word if strand == "+" else comp(word)]:
                votes[order, pos - shift, strand] += 1
    best = min(((-v, *place) for place, v in votes.items()), default=(0,))
    return (genome[best[1]][1], best[2], -best[0], best[3]) if -best[0] >= min_votes else None


@pytest.mark.parametrize("n_seeds, min_votes, strands", [(3, 2, "+-"), (4, 3, "+-"), (3, 2, "+"), (2, 1, "+-")])
def test_best_place_on_either_strand(spark, genome, monkeypatch, n_seeds, min_votes, strands):
    rng = random.Random(5)
    reads = []
    for i in range(150):
        text = genome[rng.randrange(6)][2]
        at = rng.randrange(len(text) - 40)
        seq = list(text[at : at + rng.randrange(8, 40)])
        if i % 4 == 0:
            seq[rng.randrange(len(seq))] = rng.choice("ACGTN")
        seq = "".join(seq)
        reads.append((f"r{i}", 1 + i % 2, comp(seq) if i % 3 == 0 else seq))
    reads += [("empty", 1, ""), ("none", 1, None), ("palindrome", 1, "AAAAATTTTTAAAAATTTTT")]
    setting = dict(k=K, stride=STRIDE, n_seeds=n_seeds, min_votes=min_votes)
    contigs = spark.createDataFrame(genome, "ord long, contig string, seq string")
    index = align.build_index(contigs, **setting)
    table = spark.createDataFrame(reads, "read_id string, mate int, seq string").repartition(3)
    expected = {}
    for name, _, seq in reads:
        place = best_place(genome, seq or "", n_seeds, min_votes, strands)
        if place:
            expected[name] = (*place, seq if place[3] == "+" else comp(seq))

    for limit in (1 << 40, -1):  # the second time, frequent keys meet a broadcast copy
        monkeypatch.setattr(align, "SALT_FROM_BYTES", limit)
        got = align.seed_map(table, index, contigs, **setting, both_strands="-" in strands)
        rows = {r.read_id: (r.contig, r.pos, r.votes, r.strand if "-" in strands else "+", r.seq) for r in got.collect()}
        assert rows == expected


def test_the_index_is_not_shuffled_again(spark, genome):
    contigs = spark.createDataFrame(genome, "ord long, contig string, seq string")
    index = align.build_index(contigs, k=K, stride=STRIDE)
    asked = align._asked_seeds(spark.createDataFrame([("r", 1, "ACGT" * 10)], "read_id string, mate int, seq string"), K, STRIDE, 3, 2)
    met = align._meet_index(asked, index, align._key_names(3), 0)
    met.collect()
    plan = met._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("Exchange") == 1 and "Bucketed: true" in plan


def test_the_index_stays_near_the_size_of_the_contigs(spark):
    """Places travel in packed runs, not as one row for each combination of seeds."""
    rng = random.Random(3)
    text = "".join(rng.choices("ACGT", k=1_200_000))  # more than two pieces
    contigs = spark.createDataFrame([(1, "a", text), (2, "b", text[700_000:] + "N" + text[:90])], "ord long, contig string, seq string")
    setting = dict(k=16, stride=27, n_seeds=3, min_votes=2)
    index = align.build_index(contigs, **setting)
    at = [0, (1 << 19) - 40, (1 << 19) - 1, 1 << 19, 1_199_910, 900_000]
    reads = spark.createDataFrame([(f"r{i}", 1, text[i : i + 90]) for i in at], "read_id string, mate int, seq string")
    got = {r.read_id: (r.contig, r.pos, r.votes) for r in align.seed_map(reads, index, contigs, **setting).collect()}
    assert got == {f"r{i}": ("a", i + 1, 3) for i in at}
    size = sum(os.path.getsize(f.removeprefix("file://")) for f in index.inputFiles())
    assert size < 12 * (len(text) + 500_000)
