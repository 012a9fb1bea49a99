"""Near-duplicates by SetSketch registers: band, estimate jointly, verify on full sets.

A register is the exponentially spaced, truncated minimum of one hash over the shingles of a
document; registers of a union are the maxima of the registers, so sketches merge. Bands of
equal registers propose pairs. For a pair, the counts of larger, smaller and equal registers
and both cardinalities give the likelihood of the Jaccard similarity; pairs whose most likely
value lies far below the threshold are set aside, all others are verified on their full sets.

No bucket is expanded into all its pairs. First every member meets the pivot of its bucket.
Links make components; then only members outside the component of the pivot are compared
with the members of other components, in blocks that hold sketches and texts. A block gives
out links only, and of these no more than join its components: pairs that turn out not to be
similar are never listed. That covers every pair of a bucket whose two documents are not
already known to belong together.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.llm.bytewords import (
    Hasher,
    ascii_lower,
    flat,
    mixed,
    not_blank,
    slices,
    spread,
    windows,
    word_spans,
)
from sluice.llm.components import components
from sluice.llm.sieve import sieve
from sluice.session import materialize

SHINGLE = 5
REGISTERS = 384
#: Bands of so many registers each; the registers beyond them serve the estimate alone.
BAND, BANDS = 4, 32
#: Base and range of the registers: two bytes each, values almost as fine as the minima.
STEP = 1.001
TOP = 65_534
RATE = 20.0
#: A pair is set aside if its estimate is this far below the threshold (4 standard errors).
SLACK = 0.09
#: Members of a bucket, and shingles of their texts, that are compared at once.
BLOCK, BLOCK_SHINGLES = 1024, 1 << 21
#: Shingles that are hashed at once.
CHUNK = 1 << 15


def _multipliers() -> np.ndarray:
    rule = np.arange(1, REGISTERS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return mixed(rule) | np.uint64(1)


def shingle_sets(
    data: np.ndarray, offsets: np.ndarray, hasher: Hasher, size: int = SHINGLE
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all rows, where each row's begin, and row digests.

    A row with fewer words than ``size`` has its whole word sequence as one shingle. Digests
    (two 64-bit numbers for each row) tell word sequences apart.
    """
    data = ascii_lower()[data]
    rows = len(offsets) - 1
    starts, ends, word_at = word_spans(data, offsets, not_blank())
    words = hasher.words(data, starts, ends)
    counts = np.diff(word_at)
    row_of = np.repeat(np.arange(rows), counts)
    place = (np.arange(len(words)) - word_at[row_of]).astype(np.uint64)
    digests = np.zeros((rows, 2), np.uint64)
    full = np.flatnonzero(counts)
    if len(full):
        for k, factor in enumerate((0xA24BAED4963EE407, 0x9FB21C651E98DF25)):
            placed = mixed(words + place * np.uint64(factor))
            digests[full, k] = np.add.reduceat(placed, word_at[full])
    shingles = windows(words, size)
    inside = row_of[size - 1 :] == row_of[: len(shingles)]
    shingles, owner = shingles[inside], row_of[: len(inside)][inside]
    few = np.flatnonzero((counts > 0) & (counts < size))
    owner, shingles = np.r_[owner, few], np.r_[shingles, digests[few, 0]]
    order = np.argsort(owner, kind="stable")
    owner, shingles = owner[order], shingles[order]
    bounds = np.searchsorted(owner, np.arange(rows + 1))
    sets = [np.unique(shingles[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    begin = np.r_[0, np.cumsum([len(s) for s in sets])]
    return (np.concatenate(sets) if sets else shingles), begin, digests


def registers(sets: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Register values of each set (rows of 16-bit numbers); an empty set has zeros."""
    rows = len(begin) - 1
    lowest = np.full((rows, REGISTERS), np.iinfo(np.uint64).max, np.uint64)
    multipliers = _multipliers()
    first = 0
    while first < rows:
        last = max(int(np.searchsorted(begin, begin[first] + CHUNK, "right")) - 1, first + 1)
        part = sets[begin[first] : begin[last]]
        where = begin[first:last] - begin[first]
        full = np.flatnonzero(np.diff(begin[first : last + 1]))
        if len(full):
            where, scratch = where[full], np.empty_like(part)
            for k in range(REGISTERS):
                np.multiply(part, multipliers[k], out=scratch)
                lowest[first + full, k] = np.minimum.reduceat(scratch, where)
        first = last
    least = -np.log1p(-np.minimum(lowest / 2.0**64, 1 - 2.0**-53))
    least = np.maximum(least, 2.0**-80) / RATE
    values = np.floor(1 - np.log(least) / np.log(STEP))
    values[np.diff(begin) == 0] = 0
    return np.clip(values, 0, TOP + 1).astype(np.uint16)


def merged(one: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Registers of the union of two sets."""
    return np.maximum(one, other)


def likely_jaccard(larger, smaller, sizes_a, sizes_b) -> np.ndarray:
    """Most likely Jaccard similarity of pairs from counts of larger and smaller registers.

    ``larger`` counts registers of a above those of b, ``smaller`` the reverse; the rest agree.
    """
    larger, smaller = np.asarray(larger, float), np.asarray(smaller, float)
    total = np.asarray(sizes_a, float) + sizes_b
    u, v = sizes_a / total, sizes_b / total
    equal = REGISTERS - larger - smaller
    scale = np.log(STEP)

    def exceeds(x):
        return -np.log1p(-np.clip(x, 0, 1) * (STEP - 1) / STEP) / scale

    def value(j):
        up, down = exceeds(u - v * j), exceeds(v - u * j)
        rest = np.maximum(1 - up - down, 1e-12)
        up, down = np.maximum(up, 1e-12), np.maximum(down, 1e-12)
        return larger * np.log(up) + smaller * np.log(down) + equal * np.log(rest)

    low, high = np.zeros_like(u), np.minimum(u / v, v / u)
    for _ in range(30):  # the likelihood has one peak
        a, b = low + (high - low) / 3, high - (high - low) / 3
        left = value(a) < value(b)
        low, high = np.where(left, a, low), np.where(left, high, b)
    return (low + high) / 2


def sketch(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``_id``, ``_text_hash``, ``digest``, ``n_shingles``, ``registers`` of every row.

    Registers are null for rows without words and for repeats within a task.
    """

    def measure(batches):
        hasher, seen = Hasher(), set()
        for batch in batches:
            data, offsets = flat(batch.column(2))
            counts, digests, values = [], [], []
            for first, last in slices(offsets):
                sets, begin, both = shingle_sets(
                    data[offsets[first] : offsets[last]],
                    offsets[first : last + 1] - offsets[first],
                    hasher,
                )
                sizes = np.diff(begin)
                keys = [row.tobytes() for row in both]
                fresh = np.zeros(len(keys), bool)
                for k, key in enumerate(keys):
                    if sizes[k] and key not in seen:
                        fresh[k] = True
                        seen.add(key)
                if len(seen) > 1_000_000:
                    seen.clear()
                kept = np.repeat(fresh, sizes)
                own = registers(sets[kept], np.r_[0, np.cumsum(sizes[fresh])])
                rows = iter(own)
                counts += sizes.tolist()
                digests += keys
                values += [next(rows).tobytes() if f else None for f in fresh]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    pa.array(digests, pa.binary()),
                    pa.array(counts, pa.int64()),
                    pa.array(values, pa.binary()),
                ],
                names=["_id", "_text_hash", "digest", "n_shingles", "registers"],
            )

    text = F.col(f"`{text_col}`")
    narrow = docs.select(F.col(f"`{id_col}`").alias("_id"), F.xxhash64(text).alias("_text_hash"), text.alias("_text"))
    kind = docs.schema[id_col].dataType.simpleString()
    return narrow.mapInArrow(
        measure, f"_id {kind}, _text_hash long, digest binary, n_shingles long, registers binary"
    )


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, REGISTERS)


def _estimated(pairs: DataFrame, reps: DataFrame, threshold: float) -> DataFrame:
    """The pairs whose likely similarity is not far below the threshold."""
    own = reps.select("node", "n_shingles", "registers")
    joined = pairs
    for side in ("a", "b"):
        renamed = own.select(*[F.col(c).alias(f"{c}_{side}") for c in own.columns])
        joined = joined.join(renamed, F.col(side) == F.col(f"node_{side}"))
    joined = joined.select("a", "b", "n_shingles_a", "n_shingles_b", "registers_a", "registers_b")

    def judge(batches):
        for batch in batches:
            a, b = _matrix(batch.column(4)), _matrix(batch.column(5))
            sizes = [batch.column(k).to_numpy() for k in (2, 3)]
            value = likely_jaccard((a > b).sum(1), (a < b).sum(1), *sizes)
            ok = pa.array(value >= threshold - SLACK)
            yield pa.RecordBatch.from_arrays([batch.column(k).filter(ok) for k in (0, 1)], names=["a", "b"])

    return joined.mapInArrow(judge, "a long, b long")


class Sets:
    """Shingle sets of the texts of a few nodes, as numbers of one common list."""

    def __init__(self, hasher: Hasher, texts: list[str]) -> None:
        data, offsets = flat(pa.array(texts, pa.large_string()))
        parts, sizes = [], []
        for first, last in slices(offsets):
            own = data[offsets[first] : offsets[last]]
            sets, begin, _ = shingle_sets(own, offsets[first : last + 1] - offsets[first], hasher)
            parts.append(sets)
            sizes.append(np.diff(begin))
        self.sizes = np.concatenate(sizes) if sizes else np.zeros(0, np.int64)
        self.begin = np.r_[0, np.cumsum(self.sizes)]
        known, self.numbers = np.unique(np.concatenate(parts), return_inverse=True)
        self.mark = np.zeros(len(known), bool)

    def linked(self, one: int, others: np.ndarray, percent: int) -> np.ndarray:
        """Whether 100 * shared >= percent * union holds between ``one`` and each of ``others``."""
        mine = self.numbers[self.begin[one] : self.begin[one + 1]]
        self.mark[mine] = True
        sizes = self.sizes[others]
        places = np.repeat(self.begin[others], sizes) + spread(sizes)
        shared = np.add.reduceat(self.mark[self.numbers[places]].astype(np.int64), np.r_[0, np.cumsum(sizes)[:-1]])
        self.mark[mine] = False
        return 100 * shared >= percent * (len(mine) + sizes - shared)


def _grouped(batches, key: int):
    """Rows with equal values in their first ``key`` columns, which come one after another."""
    group, last = [], None
    for batch in batches:
        for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if row[:key] != last:
                if group:
                    yield group
                group, last = [], row[:key]
            group.append(row)
    if group:
        yield group


def _links(found) -> Iterator[pa.RecordBatch]:
    """Pairs of nodes, from lists of pairs, in batches."""
    held = []
    for pairs in found:
        held += pairs
        if len(held) > 10_000:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*held, strict=True)], names=["a", "b"])
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*held, strict=True)], names=["a", "b"])


def _star_links(pairs: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """The pairs (``hub``, ``node``) whose full shingle sets are similar.

    The nodes of a hub are dealt into groups of at most about ``BLOCK`` nodes and
    ``BLOCK_SHINGLES`` shingles; each group gets the text of the hub once, so a long hub with
    very many nodes is copied once for each group and not for each node.
    """
    percent = round(100 * threshold)
    spark = pairs.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sizes = pairs.groupBy(F.col("hub").alias("_hub")).agg(_blocks(F.count(F.lit(1)), F.sum("n_shingles")).alias("_groups"))
    dealt = pairs.join(sizes, F.col("hub") == F.col("_hub"))
    dealt = dealt.select("hub", "node", F.pmod(F.xxhash64("node"), F.col("_groups")).cast("int").alias("group"))
    own = texts.select(F.col("node").alias("_node"), "text")
    spokes = dealt.join(own, F.col("node") == F.col("_node")).select("hub", "group", F.lit(1).alias("part"), "node", "text")
    hubs = dealt.select("hub", "group").distinct().join(own, F.col("hub") == F.col("_node"))
    hubs = hubs.select("hub", "group", F.lit(0).alias("part"), F.col("hub").alias("node"), "text")
    rows = hubs.union(spokes).repartition(tasks, "hub", "group").sortWithinPartitions("hub", "group", "part")

    def judge(batches):
        hasher = Hasher()

        def found():
            for group in _grouped(batches, 2):
                if group[0][2]:
                    continue
                sets = Sets(hasher, [g[4] for g in group])
                ok = sets.linked(0, np.arange(1, len(group)), percent) if len(group) > 1 else []
                yield [(g[0], g[3]) for g, k in zip(group[1:], ok, strict=True) if k]

        yield from _links(found())

    return rows.mapInArrow(judge, "a long, b long")


def _blocks(n: Column, shingles: Column) -> Column:
    return F.ceil(F.greatest(n / BLOCK, shingles / BLOCK_SHINGLES)).cast("int")


def _across(active: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """Links between members with different labels, compared and verified in blocks.

    ``active`` has bucket, band, n and shingles (of the bucket), pivot, main (the pivot's label),
    n_outside (members of other labels), node, label, n_shingles and registers. One side of each
    pair lies outside the pivot's component; pairs with the pivot itself have been compared
    before. A pair is looked at once: in the first band that both share, and from the smaller
    node if both lie outside. Sketches say which pairs may be similar, the full sets of the block
    decide, and a union-find keeps a block from giving out more links than join its labels:
    however many pairs are almost similar, nothing is listed for them.
    """
    percent = round(100 * threshold)
    tasks = int(active.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    own = texts.select(F.col("node").alias("_node"), "text")
    base = active.where("node != pivot").withColumns(
        {"_columns": _blocks(F.col("n"), F.col("shingles")), "_outside": F.col("label") != F.col("main")}
    )
    # members outside are few where the bucket is large: as many blocks of rows as they need
    base = base.withColumn("_rows", F.least("_columns", F.greatest(F.lit(1), _blocks(F.col("n_outside"), F.col("shingles_outside")))))
    single = (F.col("_columns") == 1) & (F.col("_rows") == 1)
    where = [F.pmod(F.xxhash64("node"), F.col(c)).cast("int") for c in ("_rows", "_columns")]
    none = F.array().cast("array<struct<row:int,column:int,asks:boolean,asked:boolean>>")

    def place(row, column, asks, asked):
        return F.struct(row.alias("row"), column.alias("column"), asks.alias("asks"), asked.alias("asked"))

    def upto(n):
        return F.sequence(F.lit(0), F.col(n) - 1)

    yes, no = F.lit(True), F.lit(False)
    asking = F.transform(upto("_columns"), lambda c: place(where[0], c, yes, no))
    asked = F.transform(upto("_rows"), lambda r: place(r, where[1], no, yes))
    places = F.when(single, F.array(place(F.lit(0), F.lit(0), F.col("_outside"), yes))).otherwise(
        F.concat(F.when(F.col("_outside"), asking).otherwise(none), asked)
    )
    fields = ["bucket", "band", "main", "node", "label", "n_shingles", "registers"]
    dealt = base.select(*fields, F.explode(places).alias("_p")).join(own, F.col("node") == F.col("_node"))
    dealt = dealt.select("bucket", "_p.row", "_p.column", *fields[1:], "_p.asks", "_p.asked", "text")
    dealt = dealt.repartition(tasks, "bucket", "row", "column").sortWithinPartitions("bucket", "row", "column")

    def compare(group: list[tuple], hasher: Hasher) -> list[tuple[int, int]]:
        rows = np.flatnonzero([g[9] for g in group])
        columns = np.flatnonzero([g[10] for g in group])
        if not len(rows) or not len(columns):
            return []
        nodes, sizes = (np.array([g[k] for g in group]) for k in (5, 7))
        names, labels = np.unique([g[6] for g in group], return_inverse=True)
        table = np.frombuffer(b"".join(g[8] for g in group), np.uint16).reshape(-1, REGISTERS)
        band, main = group[0][3], group[0][4]
        outside = names[labels[columns]] != main
        partners, sets, out = table[columns], None, []
        for r in rows:
            same = partners == table[r]
            # bytes of 0 and 1: sums of eight columns at a time, then of the eight
            equal = same.view(np.uint64).sum(1).view(np.uint8).reshape(-1, 8).sum(1)
            near = (equal >= REGISTERS * (threshold - SLACK - 0.08)) & (labels[columns] != labels[r])
            near &= ~outside | (nodes[columns] > nodes[r])
            near = np.flatnonzero(near)
            shared = same[near, : BAND * BANDS].reshape(len(near), BANDS, BAND).all(2)
            near = near[shared.argmax(1) == band]
            if not len(near):
                continue
            theirs = partners[near]
            value = likely_jaccard(
                (table[r] > theirs).sum(1), (table[r] < theirs).sum(1), np.full(len(near), sizes[r]), sizes[columns[near]]
            )
            near = columns[near[value >= threshold - SLACK]]
            if not len(near):
                continue
            sets = sets or Sets(hasher, [g[11] for g in group])
            for c in near[sets.linked(r, near, percent)]:
                if labels[c] != labels[r]:
                    labels[labels == labels[c]] = labels[r]
                    out.append((int(nodes[r]), int(nodes[c])))
        return out

    def judge(batches):
        hasher = Hasher()
        yield from _links(compare(group, hasher) for group in _grouped(batches, 3))

    return dealt.mapInArrow(judge, "a long, b long")


def near_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.75
) -> DataFrame:
    """One row per row of ``docs``: id, ``text_hash``, ``n_shingles``, ``component_id``, ``kept``.

    ``component_id`` is the smallest id reachable over links. Rows without words (null, empty
    or blank texts) are linked with nothing. A null id never leads a component; a row without
    id and without relatives has a null ``component_id`` and is kept. Rows that repeat id and
    text are reported alike.
    """
    sketches = materialize(sketch(docs, id_col, text_col), "sketches")
    chosen = sketches.where("registers is not null").select("digest", "n_shingles", "registers")
    reps = materialize(
        chosen.dropDuplicates(["digest"]).withColumn("node", F.monotonically_increasing_id()), "sets"
    )
    bands = [
        F.xxhash64(F.lit(k), F.substring("registers", 2 * BAND * k + 1, 2 * BAND))
        for k in range(BANDS)
    ]
    members = reps.select("node", "n_shingles", F.posexplode(F.array(*bands)).alias("band", "bucket"))
    shared = members.groupBy("bucket").agg(
        F.count(F.lit(1)).alias("n"), F.min("node").alias("pivot"), F.sum("n_shingles").alias("shingles")
    )
    shared = shared.where("n > 1").withColumnRenamed("bucket", "_bucket")
    members = materialize(
        members.join(shared, F.col("bucket") == F.col("_bucket")).drop("_bucket"), "members"
    )

    lead = sketches.where("n_shingles > 0").groupBy("digest").agg(
        F.min("_id").alias("lead"), F.coalesce(F.min_by("_text_hash", "_id"), F.min("_text_hash")).alias("_hash"),
    )
    wanted = (
        members.select("node").distinct().join(reps.select("node", "digest"), "node")
        .join(lead, "digest")
        .select("node", F.col("lead").alias("_lead"), F.col("_hash"))
    )
    own = docs.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`").alias("text"))
    own = own.withColumn("_own", F.xxhash64("text"))
    texts = wanted.join(own, F.col("_lead").eqNullSafe(F.col("_id")) & (F.col("_hash") == F.col("_own")))
    texts = materialize(texts.select("node", "text").dropDuplicates(["node"]), "texts")

    stars = members.where("node != pivot").select(
        F.least("node", "pivot").alias("a"), F.greatest("node", "pivot").alias("b")
    ).distinct()
    stars = _estimated(stars, reps, threshold).select(F.col("a").alias("hub"), F.col("b").alias("node"))
    counts = reps.select(F.col("node").alias("_n"), "n_shingles")
    stars = materialize(stars.join(counts, F.col("node") == F.col("_n")).drop("_n"), "stars")
    links = materialize(_star_links(stars, texts, threshold), "links")
    labels = components(links)

    far = labels.select(F.col("node").alias("_n"), F.col("label").alias("_l"))
    labelled = members.where("n > 2").join(far, F.col("node") == F.col("_n"), "left")
    labelled = labelled.withColumn("label", F.coalesce("_l", "node")).drop("_n", "_l")
    heads = labelled.where("node = pivot").select(F.col("bucket").alias("_bucket"), F.col("label").alias("main"))
    labelled = labelled.join(heads, F.col("bucket") == F.col("_bucket")).drop("_bucket")
    outside = labelled.where("label != main").groupBy(F.col("bucket").alias("_bucket")).agg(
        F.count(F.lit(1)).alias("n_outside"), F.sum("n_shingles").alias("shingles_outside")
    )
    active = labelled.join(outside, F.col("bucket") == F.col("_bucket")).drop("_bucket")
    sketched = reps.select(F.col("node").alias("_n"), "registers")
    active = active.join(sketched, F.col("node") == F.col("_n")).drop("_n")
    links = links.union(materialize(_across(active, texts, threshold), "links"))
    labels = components(links)

    placed = labels.join(reps.select("node", "digest"), "node").join(lead.select("digest", "lead"), "digest")
    smallest = placed.groupBy(F.col("label").alias("_label")).agg(F.min("lead").alias("component"))
    placed = placed.join(smallest, F.col("label") == F.col("_label")).select("digest", "component")
    leads = lead.select(F.col("digest").alias("_d"), "lead")
    leads = leads.join(placed.select(F.col("digest").alias("_p"), "component"), F.col("_d") == F.col("_p"), "left")
    leads = leads.select("_d", F.coalesce("component", "lead").alias("_component"))
    out = sketches.select("_id", "_text_hash", "digest", "n_shingles").join(
        leads, (F.col("digest") == F.col("_d")) & (F.col("n_shingles") > 0), "left"
    )
    component = F.when(F.col("n_shingles") > 0, F.col("_component")).otherwise(F.col("_id"))
    return out.select(
        F.col("_id").alias(id_col),
        F.col("_text_hash").alias("text_hash"),
        "n_shingles",
        component.alias("component_id"),
        F.col("_id").eqNullSafe(component).alias("kept"),
    )


def drop_near_copies(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.75
) -> DataFrame:
    """The rows of ``docs`` that :func:`near_groups` keeps, with all their columns."""
    key = F.xxhash64(F.col(f"`{id_col}`"), F.xxhash64(F.col(f"`{text_col}`")))
    gone = near_groups(docs, id_col, text_col, threshold).where("not kept")
    gone = gone.select(F.col(f"`{id_col}`").alias("_gone"), F.col("text_hash").alias("_gone_hash")).distinct()
    gone = materialize(gone, "gone")
    may = sieve(gone, F.xxhash64("_gone", "_gone_hash"))
    unsure = docs.where(may(key))
    left = unsure.join(
        gone,
        F.col(f"`{id_col}`").eqNullSafe(F.col("_gone"))
        & (F.xxhash64(F.col(f"`{text_col}`")) == F.col("_gone_hash")),
        "left_anti",
    )
    return docs.where(~may(key)).union(left)
