import random
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from sluice.llm.exact import Trie, exact_groups, exact_owners
from sluice.llm.packing import WordEncoder, fullest, pack, slack_plan, token_pieces
from tests.llm.odd import ROWS, empty, odd_documents

PATH = public_tokenizers.path("word_bpe_49k.json")


def test_trie_keeps_every_string_and_owner():
    rng = random.Random(1)
    keys = [bytes(rng.choices(b"ab", k=rng.randrange(9))) for _ in range(500)]
    trie, counts = Trie(), Counter(keys)
    for k, key in enumerate(keys):
        trie.insert(key, [1, k, ("payload", k)])
    spilled = list(trie.spill_largest())
    rest = list(trie.drain())
    assert trie.bytes == 0 and [k for k, _ in rest] == sorted(k for k, _ in rest)
    found = {k: (n, rank) for k, (n, rank, _) in spilled + rest}
    last = {key: k for k, key in enumerate(keys)}
    assert found == {k: (n, last[k]) for k, n in counts.items()}


@pytest.mark.parametrize("budget", [1 << 20, 1])
@pytest.mark.parametrize("largest", [True, False])
def test_owners_on_odd_rows(spark, budget, largest):
    got = exact_owners(odd_documents(spark), largest=largest, budget=budget).collect()
    groups = {}
    for ident, text, *_ in ROWS:
        groups.setdefault(text or "", []).append(ident)
    assert Counter(r.text or "" for r in got) == Counter(groups.keys())
    for r in got:
        known = [i for i in groups[r.text or ""] if i is not None]
        assert r.group_size == len(groups[r.text or ""])
        assert r.doc_id == ((max if largest else min)(known) if known else None)
        assert r.label is not None and r._id == r.label  # the other columns come along
    assert exact_owners(empty(spark)).count() == 0


def test_groups_report_every_row(spark):
    got = exact_groups(odd_documents(spark)).collect()
    assert len(got) == len(ROWS)
    assert Counter(r.kept for r in got)[False] == 3  # rows 1, 3 and the null id
    assert {r.keep_id for r in got if r.doc_id == 3} == {4}
    assert exact_groups(empty(spark)).count() == 0


def test_one_text_in_a_third_of_all_rows(spark):
    df = spark.range(30_000).selectExpr("id as doc_id", "if(id % 3 = 0, 'hot', concat('t', id % 9000)) as text")
    got = {r.text: (r.doc_id, r.group_size) for r in exact_owners(df.repartition(8)).collect()}
    assert got["hot"] == (29_997, 10_000) and len(got) == 6001


def test_encoder_equals_the_tokenizer():
    tokenizer = Tokenizer.from_file(PATH)
    texts = [t for _, t, *_ in ROWS] + ["'S 'll x'll !'s '!s", "É é x̸ ﬁ İstanbul ΣΑΣ", "a1b22²c", "<|ENDOFTEXT|>", "a b c"]
    encoder = WordEncoder(PATH)
    for _ in range(2):  # the second time from memory
        ids, at = encoder.encode(pa.array(texts, pa.string()))
        for k, text in enumerate(texts):
            assert ids[at[k] : at[k + 1]].tolist() == tokenizer.encode(text or "", add_special_tokens=False).ids


def test_fullest_against_all_subsets():
    rng = random.Random(2)
    for _ in range(200):
        items = [rng.randrange(1, 12) for _ in range(rng.randrange(1, 8))]
        sums = {0}
        for n in items:
            sums |= {s + n for s in sums}
        chosen = fullest(Counter(items), 20)
        assert sum(k * n for k, n in chosen.items()) == max(s for s in sums if s <= 20)
        assert all(n <= Counter(items)[k] for k, n in chosen.items())


def test_plan_places_everything_once_and_tightly():
    rng = random.Random(3)
    counts = Counter(min(int(rng.lognormvariate(5, 1)) + 1, 2048) for _ in range(20_000))
    used = {}
    for length, first, per_bin, bins, first_bin, offset in slack_plan(counts):
        assert first == used.get(length, 0)
        used[length] = first + per_bin * bins
    assert used == counts
    last = slack_plan(counts)[-1]
    total = sum(k * n for k, n in counts.items())
    assert last[3] + last[4] == -(-total // 2048)


def test_pieces_and_places(spark):
    pieces = token_pieces(odd_documents(spark), PATH).cache()
    tokenizer = Tokenizer.from_file(PATH)
    expected = Counter()
    for ident, text, *_ in ROWS:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        for n, start in enumerate(range(0, len(ids), 2048)):
            expected[ident, n, start, np.array(ids[start : start + 2048], "<u4").tobytes()] += 1
    assert expected == Counter((r.doc_id, r.piece, r.start, bytes(r.ids)) for r in pieces.collect())
    placed = pack(pieces.drop("ids"), ["doc_id", "piece"]).collect()
    bins = {}
    for r in placed:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    total = sum(r.length for r in placed)
    assert len(placed) == sum(expected.values()) and len(bins) == -(-total // 2048)
    assert pack(token_pieces(empty(spark), PATH).drop("ids"), ["doc_id"]).count() == 0
