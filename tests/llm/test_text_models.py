import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from sluice.llm import gru, language
from sluice.llm.gru import Vocabulary, score_texts, word_lists
from sluice.llm.language import identify, infer
from sluice.llm.quality import count_statistics, learn_list, learn_rules, quality_verdicts, text_statistics
from sluice.llm.sieve import sieve
from tests.llm.odd import EXTRA, ROWS, empty, odd_documents

SYLLABLES = {"aa": ["ka", "to", "mi", "ra"], "bb": ["ßen", "icht", "ung", "ver"], "cc": ["oux", "ère", "ment", "eau"]}


def sentence(rng, lang, n):
    return " ".join("".join(rng.choices(SYLLABLES[lang], k=rng.randrange(1, 4))) for _ in range(n))


def labelled(spark, rng):
    rows = [(k, sentence(rng, lang, 40), lang) for k, lang in enumerate(["aa", "bb", "cc"] * 20)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def test_mixtures(spark):
    rng = random.Random(1)
    model = language.train(labelled(spark, rng))
    assert sorted(model) == ["aa", "bb", "cc"]
    rows = [
        (1, sentence(rng, "aa", 30)),
        (2, sentence(rng, "bb", 60) + " " + sentence(rng, "cc", 20)),
        (3, sentence(rng, "cc", 2000)),
        (4, None),
        (5, "123 ... !"),
        (6, ""),
        (7, "日本語"),
    ]
    got = {r.doc_id: r for r in identify(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    assert [got[k].lang_pred for k in (1, 2, 3, 4, 5, 6)] == ["aa", "bb", "cc", "und", "und", "und"]
    assert got[7].lang_pred in model
    assert set(got[1].mixture) == {"aa"} and set(got[2].mixture) == {"bb", "cc"}
    assert abs(got[2].mixture["bb"] - 0.75) < 0.1 and abs(sum(got[2].mixture.values()) - 1) < 1e-6
    assert got[4].score == 0.0 and not got[4].mixture


def test_language_held_out_accuracy(spark):
    rng = random.Random(2)
    df = labelled(spark, rng)
    model = language.train(df.where("doc_id % 5 != 1"))
    got = identify(df, model, carry=["doc_id", "lang"]).where("doc_id % 5 = 1").collect()
    assert all(r.lang == r.lang_pred for r in got)


def test_language_on_odd_rows(spark):
    docs = odd_documents(spark)
    model = language.train(docs)
    assert sorted(model) == ["en", "fr"]
    got = identify(docs, model, carry=docs.columns)
    assert set(EXTRA) - {"score"} <= set(got.columns) and got.count() == len(ROWS)
    rejected = Counter(r.doc_id for r in got.where("lang_pred = 'und'").collect())
    assert rejected == Counter([3, 4, 5, 8])
    assert identify(docs, language.train(empty(spark))).where("lang_pred != 'und'").count() == 0
    assert identify(empty(spark), model).count() == 0


def test_inference_does_not_depend_on_chunks(monkeypatch):
    rng = np.random.default_rng(3)
    tables = rng.normal(-5, 1, (3, language.CODES)).astype(np.float32)
    codes, begin = rng.integers(0, language.CODES, 500), np.sort(rng.choice(np.arange(1, 500), 60, False))
    begin = np.r_[0, begin]
    whole = language.word_likelihoods(codes, begin, tables)
    monkeypatch.setattr(language, "CHUNK", 5)
    assert np.allclose(whole, language.word_likelihoods(codes, begin, tables), atol=1e-3)
    shares = infer(whole, np.array([20, 1, 40]))
    assert np.allclose(shares.sum(1), 1) and shares.shape == (3, 3)


def statistics_by_hand(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    triples = Counter(zip(words, words[1:], words[2:]))
    covered = {k + n for k, t in enumerate(zip(words, words[1:], words[2:])) if triples[t] > 1 for n in range(3)}
    seen, again = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            again += line in seen
            seen.add(line)
    symbols = len(re.findall(r"[#*$%&|<>]", text or ""))
    return len(words), sum(map(len, words)), symbols, again, len(covered)


def test_statistics_against_python(spark):
    rng = random.Random(4)
    texts = [t for _, t, *_ in ROWS]
    texts += ["".join(rng.choices(["a ", "b ", "é", "\n", "#", "|", " \t", "a b c ", "\n\n"], k=rng.randrange(80))) for _ in range(200)]
    got = count_statistics(pa.array(texts, pa.string()))
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    for k, text in enumerate(texts):
        assert tuple(int(got[n][k]) for n in names) == statistics_by_hand(text)
    assert text_statistics(odd_documents(spark)).count() == len(ROWS)
    assert text_statistics(empty(spark)).count() == 0


def test_decision_list_finds_the_planted_rules(spark):
    rng = np.random.default_rng(5)
    x = {"a": rng.uniform(0, 1, 3000), "b": rng.uniform(0, 1, 3000), "c": rng.uniform(0, 1, 3000)}
    bad = (x["a"] > 0.9) | ((x["b"] < 0.3) & (x["c"] > 0.8))
    rules = learn_list(x, bad)
    caught = np.zeros(3000, bool)
    for rule in rules:
        own = np.ones(3000, bool)
        for name, op, bound in rule:
            own &= x[name] >= bound if op == ">=" else x[name] <= bound
        caught |= own
    assert (caught & ~bad).sum() <= 15 and (caught & bad).sum() >= 0.95 * bad.sum()
    assert learn_list(x, rng.uniform(0, 1, 3000) > 0.9) == []  # noise gives no rule


def test_quality_rules_end_to_end(spark):
    rng = random.Random(6)
    rows = []
    for k in range(600):
        words = [f"{rng.choice('abcdefg')}{rng.randrange(10_000)}" for _ in range(80)]
        rows.append((k, " ".join(w + ("$$$" if k % 5 == 0 else "") for w in words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k % 5 != 0)) for k in range(0, 600, 2)] + [(None, 0), (3, None)], "doc_id long, quality int")
    counts = text_statistics(docs).cache()
    got = quality_verdicts(counts, learn_rules(counts, labels)).collect()
    assert all(r.kept == (r.doc_id % 5 != 0) for r in got)
    assert learn_rules(counts, labels.where("quality = 1")) == []
    assert all(r.kept for r in quality_verdicts(counts, []).collect())
    odd = quality_verdicts(text_statistics(odd_documents(spark)), [])
    assert odd.where("base_failed").count() == len(ROWS) - 1  # all but the long one are too short


def tokens(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", low)


def test_scores_of_odd_rows(spark):
    learning = [r[:2] for r in ROWS if r[0] != 9]
    counts = Counter(t for _, text in learning for t in tokens(text))
    n, v = sum(counts.values()) + len(learning), len(counts) + 1
    docs = odd_documents(spark)
    got = score_texts(docs, docs.where("doc_id is null or doc_id != 9")).collect()
    assert len(got) == len(ROWS)

    def base(text):
        own = [counts[t] for t in tokens(text)] + [len(learning)]
        return sum(math.log10((c + 0.1) / (n + 0.1 * (v + 1))) for c in own)

    expected = Counter((i, len(tokens(t)) + 1, sum(counts[w] > 0 for w in tokens(t)) + 1, round(base(t), 4)) for i, t, *_ in ROWS)
    assert expected == Counter((r.doc_id, r.n_tokens, r.n_known, round(r.base_score, 4)) for r in got)
    assert all(r.train_tokens == n and r.score < 0 for r in got)
    assert score_texts(empty(spark), docs).count() == 0
    untrained = score_texts(docs, empty(spark)).collect()
    assert all(r.n_known == 0 and r.train_tokens == 0 for r in untrained)


def small_model():
    rng = np.random.default_rng(7)
    words = [f"w{k}" for k in range(1500)]
    counts = np.sort(rng.integers(1, 500, 1500))[::-1].copy()
    v = Vocabulary(words, counts, int(counts.sum()) + 900, 2000, 60)
    w = {k: a + rng.normal(0, 0.2, a.shape) for k, a in gru.start_weights(v).items()}
    bounds = np.array([0, 40, 40, 75])
    numbers = rng.choice([3, 70, 1023, 1400, 1501], 75).astype(np.int64)
    return v, w, numbers, bounds


def test_probabilities_sum_to_one():
    v, w, *_ = small_model()
    h = np.random.default_rng(8).normal(0, 1, (1, gru.HIDDEN))
    logs, _ = gru._outputs(w, np.repeat(h, 1502, 0), np.arange(1502), v)
    assert abs(np.exp(logs).sum() - 1) < 1e-6


def test_gradients_against_differences(monkeypatch):
    monkeypatch.setattr(gru, "WINDOW", 1000)
    v, w, numbers, bounds = small_model()
    total = lambda w: gru.log_likelihoods(w, numbers, bounds, v).sum()
    seen = {}

    class Memory(dict):
        def __setitem__(self, name, value):
            seen[name] = np.sqrt(value)  # of g * g, from a memory of zeros

    before = {k: a.astype(np.float64).copy() for k, a in w.items()}
    gru.train_slice({k: a.copy() for k, a in before.items()}, Memory({k: np.zeros_like(a) for k, a in w.items()}), numbers, bounds, v, 0.0)
    rng = np.random.default_rng(9)
    scale = (len(numbers) + 3) ** 0.5
    for name in before:
        flat = np.argsort(-np.abs(seen[name]).ravel())[:3]
        for at in [*flat, *rng.integers(0, before[name].size, 2)]:
            moved = {k: a.copy() for k, a in before.items()}
            step = 1e-2
            moved[name].ravel()[at] += step
            up = total(moved)
            moved[name].ravel()[at] -= 2 * step
            slope = abs(up - total(moved)) / (2 * step)
            assert abs(slope - seen[name].ravel()[at] * scale) < 0.02 + 0.03 * slope, name


def test_state_is_carried_over_windows(monkeypatch):
    v, w, numbers, bounds = small_model()
    whole = gru.log_likelihoods(w, numbers, bounds, v)
    for window in (1, 7):
        monkeypatch.setattr(gru, "WINDOW", window)
        assert np.allclose(whole, gru.log_likelihoods(w, numbers, bounds, v), rtol=1e-4)
    one = [gru.log_likelihoods(w, numbers[a:b], np.array([0, b - a]), v)[0] for a, b in zip(bounds, bounds[1:])]
    assert np.allclose(whole, one, rtol=1e-4)


def test_training_carries_the_state_to_the_end_of_each_text(monkeypatch):
    v, w, *_ = small_model()
    rng = np.random.default_rng(10)
    bounds = np.r_[0, np.cumsum([3000, 0, 40, 5, *rng.integers(0, 90, 40)])]
    numbers = rng.choice([3, 70, 1023, 1400, 1501], bounds[-1]).astype(np.int64)
    expected = gru.log_likelihoods(w, numbers, bounds, v).sum()
    seen, outputs = [], gru._outputs

    def noted(*args):
        out, back = outputs(*args)
        seen.append((len(out), float(out.sum())))
        return out, back

    monkeypatch.setattr(gru, "_outputs", noted)
    memory = {k: np.zeros_like(a) for k, a in w.items()}
    gru.train_slice(w, memory, numbers, bounds, v, 0.0)
    assert sum(n for n, _ in seen) == len(numbers) + len(bounds) - 1
    assert abs(sum(x for _, x in seen) - expected) < 1e-4 * abs(expected)
    for most, most_tokens in ((4, 1 << 21), (0, 1 << 21), (4, 100), (9, 1 << 21)):
        monkeypatch.setattr(gru, "WAITING", most)
        monkeypatch.setattr(gru, "WAITING_TOKENS", most_tokens)
        monkeypatch.setattr(gru, "LANE_TOKENS", (10, 60))
        seen.clear()
        waiting = []
        for a in range(0, len(bounds) - 1, 9):
            own = bounds[a : a + 10]
            waiting = gru.train_slice(w, memory, numbers[own[0] : own[-1]], own - own[0], v, 0.0, waiting, False)
            assert len(waiting) <= most and sum(len(left) for *_, left in waiting) <= most_tokens
        gru.train_slice(w, memory, np.zeros(0, np.int64), np.zeros(1, np.int64), v, 0.0, waiting)
        assert sum(n for n, _ in seen) == len(numbers) + len(bounds) - 1
        assert abs(sum(x for _, x in seen) - expected) < 1e-4 * abs(expected)


def test_words_of_rank_1000_depend_on_the_state_and_are_their_own_input():
    v, w, *_ = small_model()
    h = np.repeat(np.random.default_rng(11).normal(0, 1, (2, gru.HIDDEN)), 2, 0)
    logs, _ = gru._outputs(w, h, np.array([1000, 1001, 1000, 1001]), v)
    assert abs((logs[0] - logs[1]) - (logs[2] - logs[3])) > 1e-3 and v.entry[1000] != v.entry[1001]


def test_training_learns_an_order(spark):
    rows = [(k, "red green blue " * 30) for k in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    r = score_texts(docs, docs).first()
    assert r.score > r.base_score / 2


def test_scores_do_not_depend_on_the_layout(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(gru, "SHARD_TOKENS", 4000)
    monkeypatch.setattr(gru, "FIRST_ROUND", 4)
    rng = random.Random(12)
    rows = [(k % 390 if k else None, " ".join(rng.choices("a b c d e f g h".split(), k=rng.randrange(120)))) for k in range(400)]
    scores = []
    for parts, own in ((1, rows), (6, rows[::-1])):
        spark.createDataFrame(own, "doc_id long, text string").repartition(parts).write.parquet(f"{tmp_path}/{parts}")
        docs = spark.read.parquet(f"{tmp_path}/{parts}")
        scores.append(sorted((r.doc_id or -1, r.n_tokens, r.base_score, r.score) for r in score_texts(docs, docs).collect()))
    assert len(scores[0]) == 400 and np.allclose(scores[0], scores[1], rtol=1e-6, atol=0)


def test_sums_of_a_tree(spark, tmp_path):
    rows = [(k, k, np.arange(k, k + 3, dtype="<i8").tobytes()) for k in range(40)]
    sums, weight = gru._added(spark.createDataFrame(rows, "node int, weight long, sums binary").repartition(7))
    assert weight == 780 and sums.tolist() == [780, 820, 860]


def test_scores_against_a_plain_forward_pass():
    """Step by step in plain numbers, as the definition of the model says."""
    v, w, numbers, bounds = small_model()
    got = gru.log_likelihoods(w, numbers, bounds, v)
    size, sigmoid = gru.HIDDEN, lambda x: 1 / (1 + np.exp(-x))
    w = {k: a.astype(np.float64) for k, a in w.items()}
    for text, (a, b) in enumerate(zip(bounds, bounds[1:])):
        h, at, total = np.zeros(size), v.start, 0.0
        for target in [*numbers[a:b], len(v.words)]:
            x, s = w["x"][at] + w["b"], h @ w["u"]
            z, r = sigmoid(x[:size] + s[:size]), sigmoid(x[size : 2 * size] + s[size : 2 * size])
            n = np.tanh(x[2 * size :] + r * s[2 * size :])
            h = (1 - z) * n + z * h
            cls = v.cls[target]
            logits = h @ w["wc"] + w["bc"]
            total += logits[cls] - np.logaddexp.reduce(logits)
            if target < gru.SHARP:
                logits = h @ w["ww"][cls] + w["bw"][cls]
                total += logits[target % gru.SHARP_CLASS] - np.logaddexp.reduce(logits)
            elif target < len(v.words):
                total += np.log(v.counts[target] / v.counts[gru.SHARP :][v.cls[gru.SHARP : len(v.words)] == cls].sum())
            at = v.entry[target]
        assert abs(total - got[text]) < 1e-4 * abs(total)


def test_word_lists():
    words, bounds = word_lists(pa.array(["A  bÉ\n", None, "", " ", "x\x0by"], pa.string()))
    assert words.to_pylist() == ["a", "bÉ", "x", "y"] and bounds.tolist() == [0, 2, 2, 2, 2, 4]


def test_sieve_lets_all_partners_through(spark):
    from pyspark.sql import functions as F

    keys = spark.range(0, 5000, 7)
    may = sieve(keys, F.xxhash64("id"))
    passed = {r.id for r in spark.range(20_000).where(may(F.xxhash64("id"))).collect()}
    assert set(range(0, 5000, 7)) <= passed and len(passed) < 800


def test_rules_are_learned_on_the_given_labels(spark):
    """At the smallest scale the list takes bad rows that pass the base, and leaves good ones."""
    folder = "/root/testdata/sf0.01"
    counts = text_statistics(spark.read.parquet(f"{folder}/documents.parquet")).cache()
    labels = spark.read.parquet(f"{folder}/labels.parquet").withColumn("half", F.pmod(F.xxhash64("doc_id"), F.lit(2)))
    rules = learn_rules(counts, labels.where("half = 0"))
    judged = quality_verdicts(counts, rules).join(labels.where("half = 1"), "doc_id").where("not base_failed")
    bad, good = judged.where("quality = 0"), judged.where("quality = 1")
    assert rules and bad.where("kept").count() < 0.2 * bad.count() and good.where("kept").count() > 0.97 * good.count()


def test_a_weak_conjunction_does_not_end_the_search():
    rng = np.random.default_rng(1)
    n = 900
    noise, clear, bad = rng.uniform(size=n), rng.uniform(size=n), np.zeros(n, bool)
    bad[clear > 0.9] = True
    bad[(noise > 0.8) & (rng.uniform(size=n) < 0.8)] = True
    rules = learn_list({"noise": noise, "clear": clear}, bad)
    assert any(term[0] == "clear" for rule in rules for term in rule)


def test_vocabulary_and_shards_stay_small_in_workers():
    words = [f"word{i}" for i in range(1000)]
    v = Vocabulary(words, np.full(1000, 3), 4000, 1001, 1000)
    assert isinstance(v.words, pa.Array) and v.words.to_pylist() == words
    again = Vocabulary(*v.state)
    assert again.words.equals(v.words) and (again.cls == v.cls).all()
    codes = [np.arange(n, dtype="<i4").tobytes() for n in (3, 0, 5)]
    rows = pa.RecordBatch.from_arrays([pa.array([0, 0, 1], pa.int32()), pa.array(codes, pa.binary())], names=["shard", "codes"])
    found = [(own, numbers.dtype.itemsize, numbers.tolist(), bounds.tolist()) for own, numbers, bounds in gru._of_shards([rows])]
    assert found == [(0, 4, [0, 1, 2], [0, 3, 3]), (1, 4, [0, 1, 2, 3, 4], [0, 5])]
