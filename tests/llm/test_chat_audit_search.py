"""Chat formatting, filter interactions and ranked search against plain Python."""

import hashlib
import math
import random
import re
from collections import Counter
from itertools import permutations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sluice.llm import bitsliced
from sluice.llm.bitsliced import Terms, ranked_search, sliced_block, slice_numbers
from sluice.llm.chatlog import Template, event_log, fold_log, read_back, render_turns
from sluice.llm.interactions import audit_filters, edge_counts, path_counts, shapley_values
from tests.llm.odd import empty, odd_documents

TEMPLATE = Template()
CONTROLS = TEMPLATE.controls()
NASTY = st.lists(st.sampled_from([*CONTROLS, "\\", "<", "[", "/s>", " ", "\n", "a", "é", "😀", "INST]", "</"]), max_size=12).map("".join)


# --- chat formatting -------------------------------------------------------------------


@settings(max_examples=300, deadline=None)
@given(NASTY)
def test_escaped_texts_show_no_control_string(text):
    escaped = TEMPLATE.escape(text)
    assert not any(c in escaped for c in CONTROLS)
    assert TEMPLATE.unescape(escaped) == text


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "", "[ROLE]", "tool x"]), NASTY), max_size=5))
def test_a_whole_conversation_is_read_back(turns):
    done = [TEMPLATE.render(r, t) for r, t in turns]
    assert list(TEMPLATE.parse("".join(f for f, _ in done))) == turns
    for (role, text), (formatted, span) in zip(turns, done, strict=True):
        assert (span is not None) == (role == "assistant")
        if span:
            assert TEMPLATE.unescape(formatted[span[0] : span[1]]) == text


def plain_digest(rows):
    """Per conversation: turns, digest, loss digest, from (conv, turn, role, text)."""
    out = {}
    for conv in {r[0] for r in rows}:
        own = [(r[1], r[2] or "", r[3] or "") for r in rows if r[0] == conv]
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, TEMPLATE.render(r[1], r[2])[0]))
        loss = "".join(t for _, r, t in own if r == "assistant")
        out[conv] = (
            len(own),
            hashlib.sha256("".join(f"{r}\n{t}\n" for _, r, t in own).encode()).hexdigest(),
            len(loss),
            hashlib.sha256(loss.encode()).hexdigest(),
            sum(len(TEMPLATE.render(r, t)[0]) for _, r, t in own),
        )
    return out


def turns_table(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, kind long, step string, message long")


def test_odd_and_hot_conversations_are_read_back(spark):
    random.seed(5)
    words = [*CONTROLS, "plain", "😀", "\\", "[", "\n", "x" * 150]
    rows = [(7, t, random.choice(["user", "assistant"]), " ".join(random.choices(words, k=40))) for t in range(400)]
    rows += [(c, t, "user" if t % 2 else "assistant", random.choice(words) * t) for c in range(60) for t in range(5)]
    rows += [(None, 0, None, None), (None, None, "assistant", ""), (1, 2, "user", "tie"), (1, 2, "user", "tie"), (1, 2, None, "tie")]
    rows += [(99, 2**62, "assistant", "long " * 100_000), (98, -1, "tool [TEXT] x", "")]
    table = turns_table(spark, [(*r, 1, "a", 2) for r in rows]).repartition(5)
    got = read_back(render_turns(fold_log(event_log(table)))).collect()
    assert {r.conv_id: tuple(r)[1:] for r in got} == plain_digest(rows)
    assert len(got) == len({r[0] for r in rows})
    assert read_back(render_turns(fold_log(event_log(table.where("1 = 0"))))).count() == 0


@pytest.mark.parametrize("held", [0, 1 << 20])
def test_edits_and_regenerations_anywhere_in_the_log(spark, monkeypatch, held):
    """A plain fold in order of the sequence gives the same texts, however the runs are cut."""
    monkeypatch.setattr("sluice.llm.chatlog.HELD", held)
    random.seed(11)
    log, final = [], {}
    for conv in (1, 2, 2, 2, 3):
        for step in range(120):
            turn = random.randrange(6)
            kind = random.choice(["open", "delta", "delta", "delta", "delta", "edit", "regenerate"])
            text = random.choice([None, "a", "bc", "def"]) if kind in ("delta", "edit") else None
            log.append((conv, len(log), turn, turn, step, kind, "user" if kind == "open" else None, text))
    for conv, _, turn, message, _, kind, _, text in sorted(log, key=lambda e: (e[0], e[1])):
        old = final.get((conv, message), "")
        final[conv, message] = {"delta": old + (text or ""), "edit": text or "", "regenerate": ""}.get(kind, old)
    schema = "conv_id long, phase long, turn long, message long, step int, kind string, role string, text string"
    folded = fold_log(spark.createDataFrame(log, schema).repartition(7)).collect()
    assert {(r.conv_id, r.message): r.text for r in folded} == final
    assert len(folded) == len(final)


def test_the_derived_log_has_drafts_edits_and_deltas(spark):
    table = turns_table(spark, [(c, 0, "assistant", f"text {c} " * 50, 0, "", 0) for c in range(60)])
    kinds = {r.kind: r["count"] for r in event_log(table).groupBy("kind").count().collect()}
    assert kinds["open"] == 60 and kinds["edit"] > 3 and kinds["regenerate"] > 8 and kinds["delta"] > 120
    with pytest.raises(Exception, match="unknown event"):
        fold_log(event_log(table).withColumn("kind", F.lit("other"))).count()


# --- filter interactions ---------------------------------------------------------------


def test_paths_through_the_lattice():
    for k in range(1, 7):
        reach, leave = path_counts(k)
        for state in range(1 << k):
            size = bin(state).count("1")
            assert reach[state] == math.factorial(size) and leave[state] == math.factorial(k - size)


def test_shapley_values_equal_the_average_over_all_orders(spark):
    random.seed(3)
    rows = [(random.choice("xy"), random.randrange(16), random.randrange(1, 9)) for _ in range(60)]
    counts = spark.createDataFrame(rows, "part string, mask int, n long").groupBy("part", "mask").agg(F.sum("n").alias("n"))
    got = {(r.part, r.filter): r.shapley for r in shapley_values(edge_counts(counts, "abcd")).collect()}
    for part in "xy":
        for f in range(4):
            total = 0
            for order in permutations(range(4)):
                before = sum(1 << g for g in order[: order.index(f)])
                total += sum(n for p, m, n in rows if p == part and not m & before and m >> f & 1)
            assert got[part, f] == total


def plain_audit(docs, labels):
    good = {i for i, q, _ in labels if q == 1}
    toxic = {i for i, _, t in labels if t == 1}
    texts = [(i, t or "", s or "") for i, t, s in docs]
    out = {}
    fails = []
    for i, t, s in texts:
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        f = ""
        f += "A" if len(words) < 200 else ""
        f += "B" if 100 * len(set(words)) < 50 * len(words) else ""
        f += "C" if 100 * len(re.findall("[A-Z]", t)) > 2 * len(t) else ""
        f += "D" if re.search(r"[#$%&*|]", t) else ""
        f += "E" if i is not None and any(j is not None and j < i and u == t for j, u, _ in texts) else ""
        fails.append((s, f, i))
    for part in {s for _, _, s in texts}:
        own = [(f, i) for s, f, i in fails if s == part]
        shapley = Counter()
        for order in permutations("ABCDE"):
            left = own
            for step, name in enumerate(order, 1):
                gone = [(f, i) for f, i in left if name in f]
                left = [(f, i) for f, i in left if name not in f]
                failing = sum(name in f for f, _ in own)
                shapley[name] += len(gone)
                out[part, "".join(order), step] = [
                    len(left), len(gone), failing - len(gone), sum(f == name for f, _ in own),
                    sum(i in good for _, i in gone), sum(i in toxic for _, i in gone),
                ]
        for (p, order, step), values in out.items():
            if p == part:
                values.append(shapley[order[step - 1]])
    return out


def test_audit_equals_plain_orders(spark):
    random.seed(9)
    base = ["One two THREE four", "a b " * 300, "", None, "x # y", "w" + " w".join(map(str, range(250)))]
    docs = [(i, random.choice(base), random.choice(["s", "t", None])) for i in [*range(70), 5, 5, None, None]]
    labels = [(i, random.choice([0, 1, None]), random.choice([0, 1])) for i in range(0, 70, 2)] + [(4, 1, 1), (4, 0, 0), (None, 1, 1)]
    table = spark.createDataFrame([(*d, 1, 2) for d in docs], "doc_id long, text string, source string, part long, mask long")
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = audit_filters(table.repartition(4), marks).collect()
    expected = plain_audit(docs, [r for r in labels if r[0] is not None])
    assert {(r[0], r[1], r[2]): list(r)[3:] for r in got} == expected
    assert len(got) == 3 * 600


def test_audit_of_odd_and_empty_tables(spark):
    marks = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    docs = odd_documents(spark)
    rows = [(r.doc_id, r.text, r.source) for r in docs.collect()]
    got = audit_filters(docs, marks).collect()
    assert {(r[0], r[1], r[2]): list(r)[3:] for r in got} == plain_audit(rows, [(1, 1, 0)])
    assert audit_filters(empty(spark), marks).count() == 0
    assert audit_filters(docs, marks.where("1 = 0")).agg(F.sum("good_lost")).first()[0] == 0


# --- ranked search ---------------------------------------------------------------------


def plain_search(docs, items, k=50):
    find = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+").findall
    table = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    counts = [(i, Counter(find((t or "").translate(table)))) for i, t in docs]
    n_docs, n_terms = sum(bool(c) for _, c in counts), sum(sum(c.values()) for _, c in counts)
    df = Counter(w for _, c in counts for w in c)
    asked = {}
    for item, t in items:
        asked.setdefault(item, set()).update(find((t or "").translate(table)))
    out = []
    for item, terms in asked.items():
        scored = []
        for i, c in counts:
            n, score = sum(c.values()), 0
            for t in terms & c.keys():
                m = 50 + 50 * n * n_docs // n_terms
                w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                score += w * (1_000_000_000 * c[t] // (1000 * c[t] + 20 * m))
            if score > 0:
                scored.append((-score, i is None, i or 0))
        for rank, (score, null, i) in enumerate(sorted(scored)[:k], 1):
            out.append((item, rank, None if null else i, -score))
    return sorted(out)


def searched(docs, items, **options):
    return sorted(tuple(r) for r in ranked_search(docs, items, **options).collect())


@pytest.mark.parametrize("at_once, cells", [(1 << 18, 1 << 22), (40, 1 << 11)])
def test_search_equals_scoring_everything(spark, monkeypatch, at_once, cells):
    monkeypatch.setattr(bitsliced, "CELLS", cells)
    random.seed(2)
    words = [f"w{k}" for k in range(120)] + ["Été", "The", "the", "日本"]
    weights = [1 / (k + 1) for k in range(len(words))]
    docs = [(i, " ".join(random.choices(words, weights, k=random.choice([0, 1, 5, 30, 200])))) for i in range(500)]
    docs += [(i, "the w1 w1 w2") for i in range(500, 700)] + [(600, "the w1 w1 w2"), (None, "w3 w4"), (701, None)]
    items = [(k, " ".join(random.choices(words, k=6))) for k in range(20)] + [(20, None), (21, "--"), (3, "w99 w98"), (22, "absent")]
    table = spark.createDataFrame(docs, "doc_id long, text string").repartition(6)
    asked = spark.createDataFrame(items, "item_id long, text string")
    assert searched(table, asked, k=10, terms_at_once=at_once) == plain_search(docs, items, 10)


def test_search_of_odd_and_empty_tables(spark):
    docs = odd_documents(spark)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    items = [(1, "the lazy dog renard W5 x7"), (2, "日本語 naïve")]
    asked = spark.createDataFrame([(*i, "x", 1) for i in items], "item_id long, text string, term string, item int")
    assert searched(docs, asked) == plain_search(rows, items)
    assert searched(empty(spark), asked) == [] and searched(docs, asked.where("1 = 0")) == []


def test_few_documents_are_scored_exactly(spark, monkeypatch):
    """Bounds exclude most documents when an item has rare words."""
    wanted = []
    rescored = bitsliced._rescored

    def count(docs, pairs, *rest):
        wanted.append(pairs.select(F.size("items").alias("n")).agg(F.sum("n")).first()[0])
        return rescored(docs, pairs, *rest)

    monkeypatch.setattr(bitsliced, "_rescored", count)
    random.seed(4)
    docs = [(i, " ".join(f"c{random.randrange(60)}" for _ in range(50)) + f" r{i % 100}") for i in range(3000)]
    items = [(k, f"r{k} c{k} c{k + 1}") for k in range(20)]
    table = spark.createDataFrame(docs, "doc_id long, text string")
    got = searched(table, spark.createDataFrame(items, "item_id long, text string"), k=10)
    assert got == plain_search(docs, items, 10)
    assert wanted[-1] < 0.1 * len(docs) * len(items)


def test_a_slice_holds_a_bit_for_each_document():
    random.seed(6)
    entries = [np.array([random.getrandbits(64) for _ in range(20)], np.uint64) for _ in range(11)]
    table = np.unpackbits(sliced_block(entries, 512), axis=1, count=11)
    for d, keys in enumerate(entries):
        assert table[slice_numbers(keys, 512), d].all()
        assert table[:, d].sum() <= 20 * bitsliced.BITS
    terms = Terms([(5, "b"), (5, "a"), (9, "b")])
    terms.weights[:] = [3, 4]
    rows = np.array([[1, 0, 1], [0, 1, 1]], np.uint8)
    assert terms.sums(rows).tolist()[0] == [3, 4, 7]
