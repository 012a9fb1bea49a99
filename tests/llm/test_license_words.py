"""The words that open a rule's keyword are in every match of the rule."""

import random
import re
from re import _parser

from sluice.llm.licences import _needed, license_scan, license_spans, signature_rules
from tests.llm.odd import odd_documents
from tests.llm.test_rules_layout_mixing import words_of


def made(tree, rng):
    """A string that the parsed regex matches."""
    out = ""
    for kind, value in tree:
        match str(kind):
            case "LITERAL":
                out += chr(value)
            case "NOT_LITERAL":
                out += rng.choice("abz9é")
            case "IN":
                how, what = rng.choice(value)
                out += chr(what) if str(how) == "LITERAL" else chr(rng.randint(*what))
            case "MAX_REPEAT":
                least, most, inner = value
                out += "".join(made(inner, rng) for _ in range(rng.randint(least, min(most, least + 3))))
            case "SUBPATTERN":
                out += made(value[3], rng)
            case "BRANCH":
                out += made(rng.choice(value[1]), rng)
            case "ASSERT" | "ASSERT_NOT":
                pass
            case other:
                raise ValueError(other)
    return out


def matches(each):
    rng = random.Random(7)
    for number, keyword, regex, _, _ in signature_rules():
        tree = _parser.parse(regex)
        for _ in range(each):
            text = made(tree, rng)
            if re.search(regex, text):
                yield number, keyword, text


def test_every_match_has_the_words_of_its_keyword():
    seen = set()
    for number, keyword, text in matches(60):
        if f" {keyword}" in text:  # else the keyword itself keeps the rule from running
            seen.add(number)
            for choice in _needed(keyword):
                assert set(choice) & set(text.split()), (keyword, text)
    assert [k for n, k, *_ in signature_rules() if n not in seen] == ["version 2 of"]


def test_made_matches_are_found(spark):
    rng, texts, wanted = random.Random(8), [], set()
    for number, keyword, text in matches(3):
        if f" {keyword}" in text and not text.endswith(" "):  # words have no blank behind the last
            wanted.add((len(texts), number))
            low = "".join(rng.choice([" ", "-", ", ", "\n", "\x00"]) if c == " " else c for c in text.strip())
            texts.append("".join(c.upper() if rng.random() < 0.3 and c.isascii() else c for c in low))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {(r.doc_id, r.rule) for r in license_spans(docs).collect()}
    assert wanted <= got


def test_a_keyword_that_stands_apart_from_the_match(spark):
    text = "General Public License version 2 as published by the Free Software Foundation. Version 2 offers more."
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert "gpl-2-only" in license_scan(docs).first().labels.split(",")


def test_words_are_counted_as_by_hand(spark):
    texts = [r.text for r in odd_documents(spark).select("text").collect()]
    texts += [None, "", " ", "\x00", "a", " a ", "-a-b", "Σ ς", "\U0001f600 x", " . ", "\x7fa\x80b", "İ K ſ"]
    rows = list(enumerate(texts))
    got = license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.n_words for r in got} == {k: len(words_of(t)) for k, t in rows}


def test_a_text_is_not_searched_once_for_each_keyword(spark):
    docs = spark.createDataFrame([(1, "under the MIT license")], "doc_id long, text string")
    plan = license_scan(docs)._jdf.queryExecution().optimizedPlan().toString().lower()
    assert plan.count("contains(") - plan.count("_contains(") <= 2  # one for each row of the gated words
    assert not re.search(r"extract_?all\((coalesce\()?text", plan)
