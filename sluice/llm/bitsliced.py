"""Ranked lexical search over bit-sliced Bloom signatures.

The index holds documents in blocks of similar fullness. A block is a bit matrix: one slice
(row) for each hash value, one column for each document. A document sets the bits of its
terms, and of (term, level) for every doubling of how often the term occurs. The slices of a
term, combined by AND, are a bitmap of documents that overestimates its presence. Sums of these
bitmaps, weighted by the terms of an item and by what each level can add at most in each document,
are upper bounds of the scores.

An item's documents of the highest bounds are scored exactly; the k-th of these scores is a
floor that every answer reaches. A document whose bound is below the floor is provably
excluded, all others are scored exactly on their texts. Nothing is joined by term, so a
frequent word is no hot key, and no document is cut.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sluice.llm.bytewords import Hasher, ascii_lower, flat, mixed, slices, spread, word_spans
from sluice.llm.sieve import sieve
from sluice.session import materialize

#: Bits of one block, and the most slices it may have; fuller documents have looser bounds.
CELLS, MOST_SLICES, FEWEST_SLICES = 1 << 22, 1 << 19, 1 << 8
#: Documents of one block at most.
DOCUMENTS = 1 << 10
#: Slices for each entry of the fullest document of a block, and bits set for each entry.
ROOM, BITS = 12, 3
#: Terms and items that are searched together; what is broadcast is bounded by them.
TERMS_AT_ONCE, ITEMS_AT_ONCE = 1 << 18, 1 << 13
#: Cells of a weighted sum that are worked on at once.
WORK = 1 << 20
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_ODD = [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93]


def term_bytes() -> np.ndarray:
    """Byte table of terms: ASCII digits and letters, and every byte beyond ASCII."""
    table = np.zeros(256, bool)
    table[0x30:0x3A] = table[0x41:0x5B] = table[0x61:0x7B] = table[0x80:] = True
    return table


def hashed_terms(data: np.ndarray, offsets: np.ndarray, hasher: Hasher):
    """Hash and byte length of every term of the rows, and the number of each row's first."""
    data = ascii_lower()[data]
    starts, ends, first = word_spans(data, offsets, term_bytes())
    return hasher.words(data, starts, ends), ends - starts, first


def level_keys(hashes: np.ndarray, level: int) -> np.ndarray:
    """What a term that occurs ``2 ** level`` times or more is entered as."""
    return mixed(hashes + np.uint64(level * _ODD[0] % 2**64)) if level else hashes


def slice_numbers(keys: np.ndarray, n_slices: int) -> np.ndarray:
    """The ``BITS`` slices of every key (rows of numbers); ``n_slices`` is a power of two."""
    shift = np.uint64(64 - n_slices.bit_length() + 1)
    columns = [(mixed(keys * np.uint64(_ODD[j]) + np.uint64(j)) >> shift).astype(np.int64) for j in range(BITS)]
    return np.stack(columns, axis=1)


def sliced_block(entries: list[np.ndarray], n_slices: int) -> np.ndarray:
    """The bit matrix of a block: ``n_slices`` rows of one bit for each document."""
    width = -(-len(entries) // 8) * 8
    cells = np.zeros(n_slices * width, np.uint8)
    for d, keys in enumerate(entries):
        cells[slice_numbers(keys, n_slices).ravel() * width + d] = 1
    return np.packbits(cells.reshape(n_slices, width), axis=1)


def length_weights(lengths: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """``m`` of documents with so many terms, in whole numbers of any size."""
    return np.array([50 + 50 * int(n) * n_docs // n_terms for n in lengths], np.int64)


def saturated(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """What ``tf`` occurrences are worth in a document of length weight ``m``."""
    return 1_000_000_000 * tf // (1000 * tf + 20 * m)


class Terms:
    """The items of one search: distinct terms by hash, weights, and the terms of each item."""

    def __init__(self, pairs: list[tuple[int, str]]) -> None:
        words = sorted({w for _, w in pairs})
        raw = [w.encode() for w in words]
        data = np.frombuffer(b" ".join(raw), np.uint8)
        sizes = np.array([len(b) for b in raw], np.int64)
        starts = np.r_[0, np.cumsum(sizes + 1)[:-1]] if raw else sizes
        hashes = Hasher().words(data, starts, starts + sizes)
        order = np.argsort(hashes, kind="stable")
        self.hashes, self.sizes = hashes[order], sizes[order]
        if len(np.unique(self.hashes)) < len(words):
            raise ValueError("two terms share a hash")
        rank = np.empty(len(words), np.int64)
        rank[order] = np.arange(len(words))
        number = {w: rank[k] for k, w in enumerate(words)}
        by_item: dict[int, set[int]] = {}
        for item, word in pairs:
            by_item.setdefault(item, set()).add(int(number[word]))
        self.items = list(by_item)
        self.terms = np.array([t for ts in by_item.values() for t in sorted(ts)], np.int64)
        self.begin = np.cumsum([0, *[len(ts) for ts in by_item.values()]])
        self.item_of = np.repeat(np.arange(len(self.items)), np.diff(self.begin))
        self.weights = np.zeros(len(words), np.int64)

    def weigh(self, df: np.ndarray, n_docs: int) -> None:
        for t, count in enumerate(df.tolist()):
            self.weights[t] = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * count + 1)))

    def find(self, hashes: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the given terms are searched for, and their numbers."""
        if not len(self.hashes):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        hit = np.flatnonzero((self.hashes[at] == hashes) & (self.sizes[at] == sizes))
        return hit, at[hit]

    def sums(self, rows: np.ndarray) -> np.ndarray:
        """For each item the sum of its terms' weights where ``rows`` (terms x documents) has a 1."""
        out = np.zeros((len(self.items), rows.shape[1]), np.int64)
        some = np.flatnonzero(rows.any(axis=1)[self.terms])
        step = max(1, WORK // max(rows.shape[1], 1))
        for a in range(0, len(some), step):
            part = some[a : a + step]
            owner = self.item_of[part]
            cut = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            terms = self.terms[part]
            weighted = rows[terms] * self.weights[terms][:, None]
            out[owner[cut]] += np.add.reduceat(weighted, cut, axis=0)
        return out


def index_documents(docs: DataFrame, terms: Terms | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Blocks of the index and, in rows of ``slices`` 0, counts for the statistics.

    A block has ``slices``, ``ids``, ``hashes`` (of whole texts), ``lengths`` (terms),
    ``peaks`` (occurrences of the most frequent term) and ``bits``. Documents without terms are
    not in it. A row of counts has documents with terms and all their terms in ``lengths``,
    numbers of searched terms in ``ids`` and how many documents hold each in ``peaks``; there
    is one for each task.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(terms)

    def build(batches):
        hasher, searched = Hasher(), shared.value
        counts, held = np.zeros(2, np.int64), np.zeros(len(searched.hashes) if searched else 0, np.int64)
        waiting: dict[int, list] = {}

        def row(n_slices, ids, hashes, lengths, peaks, bits):
            lists = [pa.array([v], pa.list_(pa.int64())) for v in (ids, hashes, lengths, peaks)]
            columns = [pa.array([n_slices], pa.int32()), *lists, pa.array([bits], pa.binary())]
            return pa.RecordBatch.from_arrays(columns, names=["slices", "ids", "hashes", "lengths", "peaks", "bits"])

        def block(n_slices):
            docs_ = waiting.pop(n_slices)
            bits = sliced_block([d[4] for d in docs_], n_slices).tobytes()
            return row(n_slices, *[[d[k] for d in docs_] for k in range(4)], bits)

        for batch in batches:
            ids, text_hashes = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            data, offsets = flat(batch.column(2))
            for a, b in slices(offsets):
                part = data[offsets[a] : offsets[b]]
                words, sizes, first = hashed_terms(part, offsets[a : b + 1] - offsets[a], hasher)
                if not len(words):
                    continue
                rows = np.repeat(np.arange(b - a), np.diff(first))
                order = np.lexsort((words, rows))
                words, sizes, rows = words[order], sizes[order], rows[order]
                new = np.r_[True, (words[1:] != words[:-1]) | (rows[1:] != rows[:-1])]
                at = np.flatnonzero(new)
                tf = np.diff(np.r_[at, len(words)])
                words, sizes, rows = words[at], sizes[at], rows[at]
                if searched:
                    _, numbers = searched.find(words, sizes)
                    np.add.at(held, numbers, 1)
                begin = np.searchsorted(rows, np.arange(b - a + 1))
                lengths = np.diff(first)
                counts += (np.count_nonzero(lengths), int(lengths.sum()))
                for d in np.flatnonzero(lengths):
                    own, often = words[begin[d] : begin[d + 1]], tf[begin[d] : begin[d + 1]]
                    entries, level = [own], 1
                    while (more := often >= 1 << level).any():
                        entries.append(level_keys(own[more], level))
                        level += 1
                    keys = np.concatenate(entries)
                    wanted = 1 << (ROOM * len(keys) - 1).bit_length()
                    n_slices = min(max(wanted, FEWEST_SLICES), MOST_SLICES)
                    block_docs = waiting.setdefault(n_slices, [])
                    block_docs.append((ids[a + d], text_hashes[a + d], int(lengths[d]), int(often.max()), keys))
                    if len(block_docs) >= min(CELLS // n_slices, DOCUMENTS):
                        yield block(n_slices)
        for n_slices in list(waiting):
            yield block(n_slices)
        if counts[0]:
            some = np.flatnonzero(held)
            yield row(0, some, None, counts, held[some], None)

    text = F.col(f"`{text_col}`")
    narrow = docs.select(F.col(f"`{id_col}`").cast("long").alias("_id"), F.xxhash64(text).alias("_hash"), text.alias("_text"))
    return narrow.mapInArrow(
        build,
        "slices int, ids array<long>, hashes array<long>, lengths array<long>, peaks array<long>, bits binary",
    )


def _bounds(batches, terms: Terms, n_docs: int, n_terms: int):
    """For every block of ``batches``: ids, text hashes, and bounds (items x documents)."""
    for batch in batches:
        for n_slices, ids, hashes, lengths, peaks, bits in zip(
            *[batch.column(k).to_pylist() for k in range(6)], strict=True
        ):
            width = len(bits) // n_slices
            table = np.frombuffer(bits, np.uint8).reshape(n_slices, width)
            m, peaks = length_weights(lengths, n_docs, n_terms), np.array(peaks, np.int64)
            total = np.zeros((len(terms.items), len(ids)), np.int64)
            worth, level = np.zeros(len(ids), np.int64), 0
            while (peaks >> level).any():
                places = slice_numbers(level_keys(terms.hashes, level), n_slices)
                bitmap = table[places[:, 0]]
                for j in range(1, BITS):
                    bitmap &= table[places[:, j]]
                present = np.unpackbits(bitmap, axis=1, count=len(ids))
                most = saturated(np.minimum(peaks, (2 << level) - 1), m)
                total += terms.sums(present) * (most - worth)
                worth, level = most, level + 1
            yield ids, hashes, total


def _best_bounds(blocks: DataFrame, shared, n_docs: int, n_terms: int, k: int) -> DataFrame:
    """For each item and task the ``k`` documents of the highest bounds above 0."""

    def choose(batches):
        terms = shared.value
        found = np.zeros((len(terms.items), 0), np.int64)
        ids, hashes = np.zeros((2, len(terms.items), 0), np.int64)
        known = np.zeros((len(terms.items), 0), bool)
        for own_ids, own_hashes, total in _bounds(batches, terms, n_docs, n_terms):
            rows = (len(terms.items), len(own_ids))
            valid = np.array([i is not None for i in own_ids])
            values = np.array([i or 0 for i in own_ids], np.int64)
            found = np.hstack([found, total])
            ids = np.hstack([ids, np.broadcast_to(values, rows)])
            hashes = np.hstack([hashes, np.broadcast_to(np.array(own_hashes, np.int64), rows)])
            known = np.hstack([known, np.broadcast_to(valid, rows)])
            if found.shape[1] > k:
                top = np.argpartition(-found, k - 1, axis=1)[:, :k]
                found, ids, hashes, known = (np.take_along_axis(x, top, axis=1) for x in (found, ids, hashes, known))
        item, at = np.nonzero(found)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(item, pa.int32()),
                pa.array(ids[item, at], pa.int64(), mask=~known[item, at]),
                pa.array(hashes[item, at], pa.int64()),
                pa.array(found[item, at], pa.int64()),
            ],
            names=["item", "_id", "_hash", "bound"],
        )

    return blocks.mapInArrow(choose, "item int, _id long, _hash long, bound long")


def _not_excluded(blocks: DataFrame, shared, floors, n_docs: int, n_terms: int) -> DataFrame:
    """Documents whose bound reaches the floor of an item, with these items."""

    def choose(batches):
        terms, floor = shared.value, floors.value
        for ids, hashes, total in _bounds(batches, terms, n_docs, n_terms):
            doc, item = np.nonzero(((total >= floor[:, None]) & (total > 0)).T)
            if not len(doc):
                continue
            some, begin = np.unique(doc, return_index=True)
            offsets = pa.array(np.r_[begin, len(doc)], pa.int32())
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([ids[d] for d in some], pa.int64()),
                    pa.array([hashes[d] for d in some], pa.int64()),
                    pa.ListArray.from_arrays(offsets, pa.array(item, pa.int32())),
                ],
                names=["_id", "_hash", "items"],
            )

    return blocks.mapInArrow(choose, "_id long, _hash long, items array<int>")


def _rescored(docs: DataFrame, wanted: DataFrame, shared, n_docs: int, n_terms: int) -> DataFrame:
    """``item``, ``doc_id``, ``score`` above 0 of the wanted pairs, from whole texts.

    ``wanted`` has ``_id``, ``_hash`` (of the text) and ``items``, one row for each such key.
    """
    wanted = wanted.select(F.col("_id").alias("_of"), F.col("_hash").alias("_like"), "items")
    may = sieve(wanted, F.xxhash64("_of", "_like"))
    own = docs.where(may(F.xxhash64("_id", "_hash")))
    joined = own.join(wanted, (F.col("_hash") == F.col("_like")) & F.col("_id").eqNullSafe(F.col("_of")))

    def score(batches):
        terms, hasher = shared.value, Hasher()
        for batch in batches:
            ids, asked = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            data, offsets = flat(batch.column(1))
            out_item, out_id, out_score = [], [], []
            for a, b in slices(offsets):
                part = data[offsets[a] : offsets[b]]
                words, sizes, first = hashed_terms(part, offsets[a : b + 1] - offsets[a], hasher)
                m = length_weights(np.diff(first), n_docs, n_terms)
                hit, numbers = terms.find(words, sizes)
                begin = np.searchsorted(hit, first)
                tf = np.zeros(len(terms.hashes), np.int64)
                for d in range(b - a):
                    mine = numbers[begin[d] : begin[d + 1]]
                    np.add.at(tf, mine, 1)
                    items = np.array(asked[a + d], np.int64)
                    sizes_of = terms.begin[items + 1] - terms.begin[items]
                    places = np.repeat(terms.begin[items], sizes_of) + spread(sizes_of)
                    their = terms.terms[places]
                    worth = terms.weights[their] * saturated(tf[their], m[d])
                    total = np.add.reduceat(worth, np.r_[0, np.cumsum(sizes_of)[:-1]])
                    tf[mine] = 0
                    good = np.flatnonzero(total > 0)
                    out_item.append(items[good])
                    out_score.append(total[good])
                    out_id += [ids[a + d]] * len(good)
            if out_id:
                columns = [pa.array(np.concatenate(out_item), pa.int32()), pa.array(out_id, pa.int64())]
                columns.append(pa.array(np.concatenate(out_score), pa.int64()))
                yield pa.RecordBatch.from_arrays(columns, names=["item", "doc_id", "score"])

    return joined.select("_id", "_text", "items").mapInArrow(score, "item int, doc_id long, score long")


def _top(scored: DataFrame, order: list, k: int) -> DataFrame:
    """The first ``k`` rows of each item; Spark applies the limit ahead of the shuffle as well."""
    ranked = scored.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order)))
    return ranked.where(F.col("rank") <= k)


def ranked_search(
    docs: DataFrame,
    items: DataFrame,
    k: int = 50,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text: str = "text",
    terms_at_once: int = TERMS_AT_ONCE,
) -> DataFrame:
    """``item_id``, ``rank``, ``doc_id``, ``score``: the ``k`` highest-scoring documents of every item.

    Equal scores are ranked by ascending id, null ids last; a row that repeats id and text is
    ranked like any other. Null and empty texts have no terms: such documents are not counted,
    such items have no rows. Item rows with one id are one item with the terms of all of them.
    Empty tables give an empty result; other columns are not read. Items are searched in blocks
    of at most ``terms_at_once`` pairs of item and term on average; a block's terms and one
    number for each of its items pass through the driver, nothing that grows with ``docs``.
    """
    spark = docs.sparkSession
    lower = F.translate(F.col(f"`{item_text}`"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    found = F.explode(F.regexp_extract_all(lower, F.lit(TERM), F.lit(0)))
    pairs = items.select(F.col(f"`{item_col}`").cast("long").alias("item_id"), found.alias("term")).distinct()
    pairs = materialize(pairs, "terms")
    sizes = pairs.agg(F.count(F.lit(1)), F.count_distinct("item_id")).first()
    if not sizes[0]:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    blocks_of_items = max(1, -(-sizes[0] // terms_at_once), -(-sizes[1] // ITEMS_AT_ONCE))
    block_of = F.pmod(F.xxhash64("item_id"), F.lit(blocks_of_items))

    text = F.col(f"`{text_col}`")
    narrow = docs.select(
        F.col(f"`{id_col}`").cast("long").alias("_id"), F.xxhash64(text).alias("_hash"), text.alias("_text")
    )
    index, answers = None, []
    for number in range(blocks_of_items):
        rows = pairs.where(block_of == number).select("item_id", "term").collect()  # bounded by the block
        if not rows:
            continue
        terms = Terms([tuple(r) for r in rows])
        built = index_documents(docs, terms, id_col, text_col)
        if index is None:
            index = built = materialize(built, "signatures")
        counts = built.where("slices = 0")
        totals = counts.agg(F.sum(F.col("lengths")[0]), F.sum(F.col("lengths")[1])).first()
        n_docs, n_terms = int(totals[0] or 0), int(totals[1] or 0)
        held = counts.select(F.explode(F.arrays_zip("ids", "peaks")).alias("_c")).groupBy("_c.ids")
        df = np.zeros(len(terms.hashes), np.int64)
        for term, count in held.agg(F.sum("_c.peaks")).collect():  # one row per searched term
            df[term] = count
        if n_docs:
            terms.weigh(df, n_docs)
        shared = spark.sparkContext.broadcast(terms)
        blocks = index.where("slices > 0")

        likely = _top(_best_bounds(blocks, shared, n_docs, n_terms, k), [F.desc("bound")], k)
        likely = likely.groupBy("_id", "_hash").agg(F.collect_set("item").alias("items"))
        first = _rescored(narrow, materialize(likely, "likely"), shared, n_docs, n_terms)
        floor = np.zeros(len(terms.items), np.int64)
        for item, score in _top(first, [F.desc("score")], k).where(F.col("rank") == k).select("item", "score").collect():
            floor[item] = score
        candidates = _not_excluded(blocks, shared, spark.sparkContext.broadcast(floor), n_docs, n_terms)
        candidates = materialize(candidates.dropDuplicates(["_id", "_hash"]), "candidates")
        scored = _rescored(narrow, candidates, shared, n_docs, n_terms)
        best = _top(scored, [F.desc("score"), F.asc_nulls_last("doc_id")], k)
        names = spark.createDataFrame(list(enumerate(terms.items)), "item int, item_id long")
        answers.append(best.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score"))
    out = answers[0]
    for more in answers[1:]:
        out = out.union(more)
    return out
