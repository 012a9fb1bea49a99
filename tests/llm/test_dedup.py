import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from sluice.llm import setsketch
from sluice.llm.components import components
from sluice.llm.setsketch import drop_near_copies, likely_jaccard, merged, near_groups, registers
from sluice.llm.substrings import remove_repeats
from tests.llm.odd import ROWS, empty, odd_documents


def words_of(text):
    return (text or "").encode().split()


def strip_by_hand(rows, window):
    least = {}
    for ident, text in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        words = words_of(text)
        for k in range(len(words) - window + 1):
            least.setdefault(tuple(words[k : k + window]), ident)
    out = []
    for ident, text in rows:
        words = words_of(text)
        gone = [False] * len(words)
        if ident is not None:
            for k in range(len(words) - window + 1):
                if least[tuple(words[k : k + window])] < ident:
                    gone[k : k + window] = [True] * window
        kept = b" ".join(w for w, g in zip(words, gone) if not g).decode()
        out.append((ident, len(words), sum(gone), kept))
    return Counter(out)


@pytest.mark.parametrize("bucket", [2000, 1])
def test_substrings_against_all_windows(spark, bucket):
    rng = random.Random(4)
    passages = [[f"p{k}.{n}" for n in range(rng.randrange(8, 40))] for k in range(4)]
    rows = []
    for k in range(60):
        words = [rng.choice("abcdefgh") + str(rng.randrange(30)) for _ in range(rng.randrange(0, 60))]
        if k % 3 == 0:
            words[5:5] = passages[0]
        elif k % 5 == 0:
            words += passages[rng.randrange(4)]
        rows.append((k, " ".join(words)))
    rows += [(90, "same " * 100), (91, "same " * 37), (92, None), (None, rows[3][1]), (3, rows[3][1]), (7, rows[6][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = remove_repeats(df, window=10, bucket=bucket).collect()
    assert Counter(tuple(r) for r in got) == strip_by_hand(rows, 10)


def test_substrings_on_odd_rows(spark):
    got = remove_repeats(odd_documents(spark)).collect()
    assert Counter(tuple(r) for r in got) == strip_by_hand([r[:2] for r in ROWS], 50)
    assert remove_repeats(empty(spark)).count() == 0


def shingles(text):
    words = words_of(text.translate(str.maketrans({c: c.lower() for c in map(chr, range(65, 91))})) if text else text)
    return frozenset([tuple(words[k : k + 5]) for k in range(len(words) - 4)] or ([tuple(words)] if words else []))


def groups_by_hand(rows):
    sets = [(ident, shingles(text)) for ident, text in rows]
    parent = list(range(len(rows)))

    def top(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                parent[top(a)] = top(b)
    least = defaultdict(list)
    for k in range(len(rows)):
        if sets[k][0] is not None:
            least[top(k)].append(sets[k][0])
    out = []
    for k, (ident, own) in enumerate(sets):
        component = min(least[top(k)], default=None) if own else ident
        out.append((ident, len(own), component, ident == component))
    return Counter(out)


@pytest.mark.parametrize("block", [1024, 7])
def test_near_groups_against_all_pairs(spark, block, monkeypatch):
    monkeypatch.setattr(setsketch, "BLOCK", block)
    rng = random.Random(5)
    base = [f"w{rng.randrange(5000)}" for _ in range(150)]
    rows = []
    for k in range(120):
        words = list(base) if k % 2 else [f"u{rng.randrange(9000)}" for _ in range(rng.randrange(1, 80))]
        for _ in range(rng.randrange(6) if k % 2 else 0):
            words[rng.randrange(len(words))] = f"z{rng.randrange(9000)}"
        rows.append((k, " ".join(words)))
    chain = list(base[:100])
    for k in range(200, 230):  # each one close to the next, the ends far apart
        chain = chain[2:] + [f"c{k}.{n}" for n in range(2)]
        rows.append((k, " ".join(chain)))
    rows += [(300, rows[1][1].upper()), (301, "one two"), (302, "One  TWO"), (None, rows[1][1]), (303, ""), (304, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = near_groups(df).drop("text_hash").collect()
    assert Counter(tuple(r) for r in got) == groups_by_hand(rows)


def test_many_copies_just_below_the_threshold_list_no_pairs(spark, monkeypatch):
    """Hundreds of texts are all almost similar, 41,616 pairs: the few links are listed, nothing else."""
    listed = []
    across = setsketch._across

    def counted(*args):
        found = across(*args).cache()
        listed.append(found.count())
        return found

    monkeypatch.setattr(setsketch, "_across", counted)
    monkeypatch.setattr(setsketch, "BLOCK", 128)
    rows = []
    for k in range(17 * 17):  # any two texts share one changed place at most: almost all pairs lie between 0.68 and 0.75
        words = [f"{'z' * (i < 2)}{k if i < 2 else 'w'}.{i}" for i in range(512)]
        for line in range(5):
            start = 2 + 6 * (17 * line + (k // 17 * line + k) % 17)
            words[start : start + 5] = [f"z{k}.{i}" for i in range(start, start + 5)]
        rows.append((k, " ".join(words)))
    got = near_groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).drop("text_hash").collect()
    assert Counter(tuple(r) for r in got) == groups_by_hand(rows)
    assert listed[0] < 20 and len({r.component_id for r in got}) > 270


def test_a_row_without_id_still_links(spark):
    words = [f"w{k}" for k in range(120)]
    middle, end = words[6:] + [f"m{k}" for k in range(6)], words[12:] + [f"m{k}" for k in range(12)]
    rows = [(4, " ".join(words)), (None, " ".join(middle)), (2, " ".join(end))]
    got = near_groups(spark.createDataFrame(rows, "doc_id long, text string")).drop("text_hash").collect()
    assert Counter(tuple(r) for r in got) == groups_by_hand(rows)


def test_near_groups_on_odd_rows(spark):
    docs = odd_documents(spark)
    got = near_groups(docs).drop("text_hash").collect()
    assert Counter(tuple(r) for r in got) == groups_by_hand([r[:2] for r in ROWS])
    left = drop_near_copies(docs)
    assert left.columns == docs.columns
    assert left.count() == sum(r.kept for r in got)
    assert near_groups(empty(spark)).count() == 0 and drop_near_copies(empty(spark)).count() == 0


def test_registers_merge_and_estimate():
    rng = np.random.default_rng(6)
    every = np.unique(rng.integers(0, 1 << 63, 6000, dtype=np.uint64))
    for shared in (0, 1000, 2500, 3500):
        a, b = every[:4000], every[4000 - shared : 6000]
        own = registers(np.r_[a, b], np.array([0, len(a), len(a) + len(b)]))
        union = np.unique(np.r_[a, b])
        assert (merged(own[0], own[1]) == registers(union, np.array([0, len(union)]))[0]).all()
        x, y = own.astype(int)
        value = likely_jaccard([(x > y).sum()], [(x < y).sum()], np.array([len(a)]), np.array([len(b)]))[0]
        assert abs(value - len(np.intersect1d(a, b)) / len(union)) < 0.13


def test_components_of_a_path_and_a_star(spark):
    edges = [(k, k + 1) for k in range(100, 140)] + [(5, k) for k in range(10, 60)] + [(7, 7)]
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{k: 100 for k in range(100, 141)}, **{k: 5 for k in [5, *range(10, 60)]}}
