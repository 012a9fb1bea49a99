"""Packing of token pieces into sequences by minimum bin slack.

Only the number of pieces of each length matters for a packing, and there are at most as many
lengths as a sequence has tokens. So the plan is made from that histogram: for the next bin, a
bitset of reachable sums finds the fullest combination of available lengths, longest first;
the combination is taken as often as the pieces last, then the next one is sought. Spark
counts the pieces, ranks them within their length (hot lengths are cut into salts) and looks
up the place of each rank in the plan.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluice.llm.bytewords import flat, slices, spread

CAPACITY = 2048
#: Parts of words whose ids a task remembers, and bytes of text that are encoded at once.
REMEMBERED = 400_000
BATCH_BYTES = 6 << 20

_LETTERS = "a-zÀ-ÖØ-öø-ÿ"


def _joined(words: pa.Array) -> str:
    """The words with a blank between them."""
    offsets = pa.array([0, len(words)], pa.int32())
    return pc.binary_join(pa.ListArray.from_arrays(offsets, words.cast(pa.string())), " ")[0].as_py()


def _runs(values: np.ndarray, begin: np.ndarray, sizes: np.ndarray, places: np.ndarray) -> np.ndarray:
    """The runs of ``values`` that the places name by number, one after the other."""
    count = sizes[places]
    ends = np.cumsum(count)
    total = int(ends[-1]) if len(ends) else 0
    return values[np.repeat(begin[places] - (ends - count), count) + np.arange(total)]


class WordEncoder:
    """Ids of texts from the ids of their distinct words.

    White space is dropped by the tokenizer and no token crosses it, so a text's ids are those
    of its words in order. Words of plain letters, digits and marks are cut where the
    tokenizer cuts in any case, and many are encoded in one call; the rest go one by one.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.closes = np.zeros(max(vocabulary.values()) + 1, bool)
        for token, number in vocabulary.items():
            self.closes[number] = token.endswith("</w>")
        self.simple = f"^[{_LETTERS}0-9!-&(-/:-@\\[-`{{-~]+$"
        self.cut = re.compile(f"[{_LETTERS}]+|[0-9]|[^{_LETTERS}0-9 ]+| ").findall
        self.special = "(?i)" + "|".join(
            re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()
        )
        self.forget()

    def forget(self) -> None:
        #: The blank between two words is a part without ids.
        self.parts: dict[str, int] = {" ": 0}
        self.ids, self.sizes = np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def raw(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _learn(self, parts: list[str]) -> None:
        """Remember the ids of parts that are one word to the tokenizer."""
        ids, sizes = [self.ids], [self.sizes]

        def keep(some: list[str], own: list[int], lengths: list[int]) -> None:
            self.parts.update(zip(some, range(len(self.parts), len(self.parts) + len(some)), strict=True))
            ids.append(np.array(own, np.uint32))
            sizes.append(np.array(lengths, np.int64))

        # Lowered ASCII is what it is to the normaliser: straight to the merges.
        merges = self.tokenizer.model.tokenize
        plain = [p for p in parts if p.isascii()]
        for at in range(0, len(plain), 4096):
            some = plain[at : at + 4096]
            single = list(map(merges, some))
            keep(some, [t.id for one in single for t in one], list(map(len, single)))
        other = [p for p in parts if not p.isascii()]
        for at in range(0, len(other), 4096):
            some = other[at : at + 4096]
            own = np.array(self.raw(" ".join(some)), np.uint32)
            ends = np.flatnonzero(self.closes[own]) + 1
            if len(ends) == len(some) and ends[-1] == len(own):
                keep(some, own, np.diff(ends, prepend=0))
            else:
                single = [self.raw(part) for part in some]
                keep(some, [i for one in single for i in one], [len(one) for one in single])
        self.ids, self.sizes = np.concatenate(ids), np.concatenate(sizes)

    def _words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct words, one after the other, and their numbers."""
        plain = pc.match_substring_regex(words, self.simple).to_numpy(zero_copy_only=False)
        told = words.filter(pa.array(plain))
        cut = self.cut(_joined(told)) if len(told) else []
        numbers = list(map(self.parts.get, cut))
        if None in numbers:
            new = list(dict.fromkeys(p for p, n in zip(cut, numbers, strict=True) if n is None))
            if len(self.parts) + len(new) > REMEMBERED:
                self.forget()
                new = [p for p in dict.fromkeys(cut) if p != " "]
            self._learn(new)
            numbers = list(map(self.parts.get, cut))
        sequence = np.array(numbers, np.int64)
        seams = np.flatnonzero(sequence == 0)
        per_word = np.diff(np.r_[-1, seams, len(sequence)]) - 1 if len(sequence) else np.zeros(0, np.int64)
        sequence = sequence[sequence != 0]
        count = self.sizes[sequence]
        ids = _runs(self.ids, np.cumsum(self.sizes) - self.sizes, self.sizes, sequence)
        sums = np.r_[0, np.cumsum(count)]
        ends = np.cumsum(per_word)
        sizes = np.zeros(len(words), np.int64)
        sizes[plain] = sums[ends] - sums[ends - per_word]
        if not plain.all():
            odd = [self.raw(w) for w in words.filter(pa.array(~plain)).to_pylist()]
            sizes[~plain] = [len(one) for one in odd]
            own = np.repeat(plain, sizes)
            merged = np.zeros(len(own), np.uint32)
            merged[own], merged[~own] = ids, [i for one in odd for i in one]
            ids = merged
        return ids, sizes

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, and where each text's ids begin; a null text has none."""
        column = pc.fill_null(column, "")
        rows = len(column)
        special = pc.match_substring_regex(column, self.special).to_numpy(zero_copy_only=False)
        listed = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(pc.ascii_lower(column)))
        bounds = listed.offsets.to_numpy().astype(np.int64)
        values = listed.values.slice(bounds[0], bounds[-1] - bounds[0])
        bounds = bounds - bounds[0]
        coded = values.dictionary_encode()
        ids, sizes = self._words(coded.dictionary)
        place = coded.indices.to_numpy()
        out = _runs(ids, np.cumsum(sizes) - sizes, sizes, place)
        offsets = np.r_[0, np.cumsum(sizes[place])][bounds]
        if special.any():  # the tokenizer looks for these strings before it lowers anything
            texts = [out[offsets[k] : offsets[k + 1]] for k in range(rows)]
            for k in np.flatnonzero(special).tolist():
                texts[k] = np.array(self.raw(column[k].as_py()), np.uint32)
            offsets = np.r_[0, np.cumsum([len(t) for t in texts])]
            out = np.concatenate(texts)
        return out, offsets


def token_pieces(
    docs: DataFrame,
    tokenizer: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = CAPACITY,
    end_id: int = 0,
) -> DataFrame:
    """Pieces of at most ``capacity`` ids: id, ``piece``, ``start``, ``length``, ``ids``.

    A document is the ids of its whole text (a null text counts as empty) and ``end_id``; only
    longer ones are cut. ``ids`` are little-endian unsigned 32-bit numbers.
    """

    def cut(batches):
        encoder = WordEncoder(tokenizer)
        for whole in batches:
            for first, last in slices(flat(whole.column(1))[1], BATCH_BYTES):
                batch = whole.slice(first, last - first)
                ids, offsets = encoder.encode(batch.column(1))
                sizes = np.diff(offsets) + 1
                full = np.empty(len(ids) + len(sizes), np.dtype("<u4"))
                ends = np.cumsum(sizes)
                keep = np.ones(len(full), bool)
                keep[ends - 1] = False
                full[keep], full[~keep] = ids, end_id
                pieces = -(-sizes // capacity)
                row, piece = np.repeat(np.arange(len(sizes)), pieces), spread(pieces)
                start = piece * capacity
                length = np.minimum(sizes[row] - start, capacity)
                edge = np.r_[0, np.cumsum(length)] * 4
                binary = pa.LargeBinaryArray.from_buffers(
                    pa.large_binary(), len(row), [None, pa.py_buffer(edge.astype(np.int64)), pa.py_buffer(full)]
                )
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(row)),
                        pa.array(piece.astype(np.int32)),
                        pa.array(start),
                        pa.array(length),
                        binary.cast(pa.binary()),
                    ],
                    names=["_id", "piece", "start", "length", "ids"],
                )

    narrow = docs.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`").alias("_text"))
    kind = docs.schema[id_col].dataType.simpleString()
    pieces = narrow.mapInArrow(cut, f"_id {kind}, piece int, start long, length long, ids binary")
    return pieces.withColumnRenamed("_id", id_col)


def fullest(counts: dict[int, int], capacity: int) -> dict[int, int]:
    """The combination of available lengths with the largest sum up to ``capacity``.

    Lengths join a bitset of reachable sums from the longest down, so among equally full
    combinations one of long pieces is found, and short ones are left for later gaps.
    """
    mask = (1 << (capacity + 1)) - 1
    reach, before = 1, []
    for length in sorted(counts, reverse=True):
        before.append((length, reach))
        left, step = min(counts[length], capacity // length), 1
        while left:
            step = min(step, left)
            reach |= (reach << (step * length)) & mask
            left -= step
            step *= 2
        if reach >> capacity & 1:
            break
    total = reach.bit_length() - 1
    taken = {}
    for length, earlier in reversed(before):
        while not earlier >> total & 1:
            taken[length] = taken.get(length, 0) + 1
            total -= length
    return taken


def slack_plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Rows ``(length, first_rank, per_bin, bins, first_bin, offset)`` that place every piece."""
    left = {k: n for k, n in counts.items() if n}
    used, plan, next_bin = dict.fromkeys(left, 0), [], 0
    while left:
        chosen = fullest(left, capacity)
        bins = min(left[k] // m for k, m in chosen.items())
        offset = 0
        for length, per_bin in sorted(chosen.items(), reverse=True):
            plan.append((length, used[length], per_bin, bins, next_bin, offset))
            offset += length * per_bin
            used[length] += per_bin * bins
            left[length] -= per_bin * bins
            if not left[length]:
                del left[length]
        next_bin += bins
    return plan


_PLAN = T.StructType(
    [
        T.StructField(n, T.LongType())
        for n in ("_length", "_first", "_per_bin", "_bins", "_first_bin", "_offset")
    ]
)


def pack(pieces: DataFrame, order_by: list[str], length_col: str = "length", capacity: int = CAPACITY) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to pieces whose lengths are 1 to ``capacity``.

    ``pieces`` is read several times, so give a stored table. ``order_by`` should tell pieces
    apart; pieces that repeat in all of it are interchangeable. An empty table stays empty.
    """
    spark = pieces.sparkSession
    names = [c for c in pieces.columns if c not in ("sequence_id", "offset")]
    keys = [F.col(f"`{c}`") for c in order_by]
    salts = max(64, 2 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = (
        pieces.select(*[F.col(f"`{c}`") for c in names])
        .withColumn("_length", F.col(f"`{length_col}`").cast("long"))
        .withColumn("_salt", F.pmod(F.xxhash64(*keys), F.lit(salts)))
    )
    counted = dealt.groupBy("_length", "_salt").agg(F.count(F.lit(1)).alias("_n"))
    # one row for each possible length at most
    histogram = {r["_length"]: r["n"] for r in counted.groupBy("_length").agg(F.sum("_n").alias("n")).collect()}
    if any(k is None or not 0 < k <= capacity for k in histogram):
        raise ValueError(f"piece lengths must lie between 1 and {capacity}")
    earlier = W.partitionBy("_length").orderBy("_salt").rowsBetween(W.unboundedPreceding, -1)
    bases = counted.select(
        "_length", "_salt", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_base")
    )
    within = W.partitionBy("_length", "_salt").orderBy(*keys)
    ranked = dealt.withColumn("_rank", F.row_number().over(within) - 1).join(bases, ["_length", "_salt"])
    ranked = ranked.withColumn("_rank", F.col("_rank") + F.col("_base"))
    plan = F.broadcast(spark.createDataFrame(slack_plan(histogram, capacity), _PLAN))
    inside = (F.col("_rank") >= F.col("_first")) & (
        F.col("_rank") < F.col("_first") + F.col("_per_bin") * F.col("_bins")
    )
    placed = ranked.join(plan.withColumnRenamed("_length", "_planned"), (F.col("_length") == F.col("_planned")) & inside)
    at = F.col("_rank") - F.col("_first")
    return placed.select(
        *[F.col(f"`{c}`") for c in names],
        (F.col("_first_bin") + F.floor(at / F.col("_per_bin"))).cast("long").alias("sequence_id"),
        (F.col("_offset") + at % F.col("_per_bin") * F.col("_length")).cast("long").alias("offset"),
    )
