"""Language mixtures of documents by expectation-maximisation over n-gram likelihoods.

A word's likelihood under a language is the product of its letter trigrams' probabilities. A
document is a mixture: its language proportions are estimated by expectation-maximisation over
its words. Languages enter the set one by one, in the order of their share in the full
mixture, while the likelihood less half a logarithm of the word count per language rises.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluice.llm.bytewords import flat, slices, word_spans

#: Trigram codes; a model is this many probabilities for each language.
CODES = 1 << 16
#: Letters whose likelihoods are held at once.
CHUNK = 1 << 19
NONE = "und"


def _classes() -> np.ndarray:
    """Byte classes: a-z and all bytes beyond ASCII are letters, the rest separates words."""
    table = np.zeros(256, np.uint32)
    table[97:123] = np.arange(1, 27)
    table[65:91] = np.arange(1, 27)
    table[128:] = np.arange(27, 155)
    return table


def trigram_codes(data: np.ndarray, offsets: np.ndarray):
    """Codes of the trigrams around every letter, and where the words of each row begin.

    Returns codes of all letters in order, the first letter of each word, and the first word
    of each row.
    """
    classes = _classes()
    starts, ends, word_at = word_spans(data, offsets, classes > 0)
    codes = classes[data]
    before, after = np.zeros_like(codes), np.zeros_like(codes)
    before[1:], after[:-1] = codes[:-1], codes[1:]
    before[starts] = 0
    after[ends - 1] = 0
    mixed = (before * np.uint32(155) + codes) * np.uint32(155) + after
    mixed = (mixed * np.uint32(2654435761)) >> np.uint32(16)
    letters = codes > 0
    lengths = ends - starts
    return mixed[letters].astype(np.int32), np.cumsum(lengths) - lengths, word_at


def train(docs: DataFrame, lang_col: str = "lang", text_col: str = "text") -> dict[str, np.ndarray]:
    """Log-probabilities of the trigram codes for every language, from all rows given.

    Rows without language or text teach nothing. What reaches the driver is one count for each
    language and code, however large the input.
    """

    def count(batches):
        seen: dict[str, np.ndarray] = {}

        def given():
            for lang, counts in sorted(seen.items()):
                code = np.flatnonzero(counts)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(code), pa.string()), pa.array(code), pa.array(counts[code])],
                    names=["lang", "code", "n"],
                )
            seen.clear()

        for batch in batches:
            langs = np.array(batch.column(0).to_pylist(), object)
            data, offsets = flat(pc.utf8_lower(batch.column(1)))
            for first, last in slices(offsets):
                part = data[offsets[first] : offsets[last]]
                codes, begin, word_at = trigram_codes(part, offsets[first : last + 1] - offsets[first])
                letter_at = np.r_[begin, len(codes)][word_at]
                for lang in set(langs[first:last]):
                    if lang not in seen and len(seen) == 64:
                        yield from given()
                    own = np.repeat(langs[first:last] == lang, np.diff(letter_at))
                    counts = seen.setdefault(lang, np.zeros(CODES, np.int64))
                    counts += np.bincount(codes[own], minlength=CODES)
        yield from given()

    narrow = docs.select(F.col(f"`{lang_col}`").alias("_lang"), F.col(f"`{text_col}`").alias("_text"))
    narrow = narrow.where("_lang is not null and _text is not null")
    counted = narrow.mapInArrow(count, "lang string, code long, n long")
    table = counted.groupBy("lang", "code").agg(F.sum("n").alias("n")).toPandas()
    model = {}
    for lang, rows in sorted(table.groupby("lang")):
        counts = np.full(CODES, 0.05)
        counts[rows["code"].to_numpy()] += rows["n"].to_numpy()
        model[lang] = np.log(counts / counts.sum()).astype(np.float32)
    return model


def word_likelihoods(codes: np.ndarray, begin: np.ndarray, tables: np.ndarray) -> np.ndarray:
    """Log-likelihood of each word (rows) under each language (columns)."""
    out = np.zeros((len(begin), len(tables)))
    edges = np.r_[begin, len(codes)]
    first = 0
    while first < len(begin):
        last = max(int(np.searchsorted(edges, edges[first] + CHUNK, "right")) - 1, first + 1)
        part = codes[edges[first] : edges[last]]
        where = begin[first:last] - edges[first]
        for k, table in enumerate(tables):
            out[first:last, k] = np.add.reduceat(table[part], where)
        first = last
    return out


def _mixture(likely: np.ndarray, begin: np.ndarray, sizes: np.ndarray, allowed: np.ndarray, rounds: int):
    """Proportions (documents by languages) and log-likelihoods of the allowed mixtures."""
    share = allowed / allowed.sum(1, keepdims=True)
    for _ in range(rounds):
        weight = likely * np.repeat(share, sizes, axis=0)
        weight /= weight.sum(1, keepdims=True)
        share = np.add.reduceat(weight, begin, axis=0) / sizes[:, None]
    total = (likely * np.repeat(share, sizes, axis=0)).sum(1)
    return share, np.add.reduceat(np.log(np.maximum(total, 1e-300)), begin)


def infer(likelihoods: np.ndarray, sizes: np.ndarray, rounds: int = 12) -> np.ndarray:
    """Language proportions of documents of ``sizes`` words each, none of them 0.

    Only the selected languages have a share; rows sum to 1.
    """
    languages = likelihoods.shape[1]
    begin = np.cumsum(sizes) - sizes
    peak = likelihoods.max(1, keepdims=True)
    # no word weighs more than a factor of e^30 between languages, so no share is exactly 0
    likely = np.exp(np.maximum(likelihoods - peak, -30.0))
    full, _ = _mixture(likely, begin, sizes, np.ones((len(sizes), languages), bool), rounds)
    order = np.argsort(-full, axis=1, kind="stable")
    best = np.zeros((len(sizes), languages))
    best[np.arange(len(sizes)), order[:, 0]] = 1.0
    top = np.repeat(order[:, 0], sizes)
    single = np.log(likely[np.arange(len(top)), top])
    score = np.add.reduceat(single, begin)
    open_rows = np.arange(len(sizes))
    for k in range(2, languages + 1):
        # a language that is to hold less than half a word cannot pay for itself
        open_rows = open_rows[
            full[open_rows, order[open_rows, k - 1]] * sizes[open_rows] >= 0.5
        ]
        if not len(open_rows):
            break
        chosen = np.zeros(len(sizes), bool)
        chosen[open_rows] = True
        words = np.repeat(chosen, sizes)
        allowed = np.zeros((len(open_rows), languages), bool)
        np.put_along_axis(allowed, order[open_rows, :k], True, axis=1)
        own = sizes[open_rows]
        share, likelihood = _mixture(likely[words], np.cumsum(own) - own, own, allowed, rounds)
        value = likelihood - 0.5 * (k - 1) * np.log(own)
        better = value > score[open_rows]
        open_rows, share, value = open_rows[better], share[better], value[better]
        best[open_rows], score[open_rows] = share, value
    return best


def identify(
    docs: DataFrame,
    model: dict[str, np.ndarray],
    id_col: str = "doc_id",
    text_col: str = "text",
    floor: float = 0.01,
    carry: list[str] | None = None,
    new: tuple[str, str, str] = ("lang_pred", "score", "mixture"),
) -> DataFrame:
    """Adds ``lang_pred``, ``score`` (its share) and ``mixture`` (language to share) to every row.

    The columns ``carry`` (the id alone if none are given) come along unchanged, but for any
    that have one of the ``new`` names.

    A text that is null or has no letter is ``und`` with score 0 and an empty mixture; so is
    every text if the model knows no language. Shares below ``floor`` are not listed.
    """
    carried = [c for c in carry or [id_col] if c not in new]
    width, names = len(carried), sorted(model)
    tables = np.array([model[n] for n in names], np.float32).reshape(len(names), CODES)
    shared = docs.sparkSession.sparkContext.broadcast(tables)  # CODES numbers for each language

    def judge(batches):
        for batch in batches:
            tables = shared.value
            rows = batch.num_rows
            share = np.zeros((rows, max(len(names), 1)))
            data, offsets = flat(pc.utf8_lower(batch.column(width)))
            known = np.array(batch.column(width + 1).to_pylist(), bool)
            for first, last in slices(offsets) if len(names) else ():
                part = data[offsets[first] : offsets[last]]
                codes, begin, word_at = trigram_codes(part, offsets[first : last + 1] - offsets[first])
                sizes = np.diff(word_at)
                full = np.flatnonzero(sizes)
                if len(full):
                    likely = word_likelihoods(codes, begin, tables)
                    share[first + full] = infer(likely, sizes[full])
            top = share.argmax(1)
            value = share.max(1)
            known &= value > 0
            mixtures = [
                [(names[k], float(row[k])) for k in np.flatnonzero(row >= floor)] if ok else []
                for row, ok in zip(share, known, strict=True)
            ]
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns[:width],
                    pa.array([names[k] if ok else NONE for k, ok in zip(top, known, strict=True)]),
                    pa.array(np.where(known, np.minimum(value, 1.0), 0.0)),
                    pa.array(mixtures, pa.map_(pa.string(), pa.float64())),
                ],
                names=[*(f"_c{k}" for k in range(width)), *new],
            )

    text = F.col(f"`{text_col}`")
    kinds = ("string", "double", "map<string,double>")
    fields = [T.StructField(f"_c{k}", docs.schema[c].dataType) for k, c in enumerate(carried)]
    out = docs.select(
        *[F.col(f"`{c}`").alias(f"_c{k}") for k, c in enumerate(carried)],
        text.alias("_text"),
        F.coalesce(text.rlike(r"\p{L}"), F.lit(False)).alias("_letter"),
    ).mapInArrow(judge, T.StructType([*fields, *(T.StructField(n, T.DataType.fromDDL(k)) for n, k in zip(new, kinds, strict=True))]))
    return out.withColumnsRenamed({f"_c{k}": c for k, c in enumerate(carried)})
