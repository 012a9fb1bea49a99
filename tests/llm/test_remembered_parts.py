"""The encoder of words learns a part once as long as what it remembers has room."""

import pyarrow as pa
import public_tokenizers

from sluice.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")


def words(first, last):
    return [f"word{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(first, last)]


def test_parts_that_are_known_are_not_learned_again(monkeypatch):
    monkeypatch.setattr(packing, "REMEMBERED", 100)
    encoder, learned = packing.WordEncoder(PATH), []
    learn = encoder._learn
    monkeypatch.setattr(encoder, "_learn", lambda parts: (learned.extend(parts), learn(parts)))
    for first, last in ((0, 70), (5, 75), (0, 75)):
        encoder.encode(pa.array([" ".join(words(first, last))]))
    assert sorted(learned) == words(0, 75)


def test_ids_are_the_tokenizers_before_and_after_forgetting(monkeypatch):
    monkeypatch.setattr(packing, "REMEMBERED", 60)
    encoder = packing.WordEncoder(PATH)
    odd = ["", None, " ", "naïve café, Straße!", "x" * 300, "a b", "don't 2024", "日本語 é", "(a) [b]"]
    for first in (0, 20, 40, 10):
        texts = [" ".join(words(first, first + 50)), *odd]
        ids, offsets = encoder.encode(pa.array(texts, pa.string()))
        for k, text in enumerate(texts):
            assert ids[offsets[k] : offsets[k + 1]].tolist() == encoder.raw(text or "")
        assert len(encoder.parts) <= 150
