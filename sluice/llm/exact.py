"""Exact dedup by owners in Patricia tries.

A task inserts its texts, byte for byte, into a compressed radix trie. The terminal node of a
text holds its owner (the row that stays) and how many rows ended there, so copies meet
before anything is shuffled and a text that fills a third of the table leaves each task once.
The owners are then dealt by length and content hash, sorted by text inside each partition,
and inserted into a second trie. Sorted input closes a subtree once the insertion has moved
past it; beyond ``budget`` bytes the closed subtrees are given out and freed. The first trie
spills whole subtrees as partial owners instead, which the second one merges. Nothing is
dropped, and no task holds more than its budget and one text.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of labels that a trie may hold before it spills subtrees.
TRIE_BYTES = 48 << 20
#: What a node costs besides its label.
NODE_BYTES = 300


class Node:
    __slots__ = ("label", "kids", "entry")

    def __init__(self, label: bytes, entry: list | None = None) -> None:
        self.label = label
        self.kids: dict[int, Node] = {}
        self.entry = entry


def shared_prefix(a: bytes, b: bytes) -> int:
    """Number of leading bytes that both have, by halving."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        middle = (low + high + 1) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle - 1
    return low


class Trie:
    """A compressed radix trie from byte strings to entries ``[rows, rank, payload]``.

    The entry of the largest rank owns a string; row counts add up.
    """

    def __init__(self) -> None:
        self.root = Node(b"")
        self.bytes = 0

    def insert(self, key: bytes, entry: list) -> None:
        node, at = self.root, 0
        while at < len(key):
            child = node.kids.get(key[at])
            if child is None:
                node.kids[key[at]] = Node(key[at:], entry)
                self.bytes += len(key) - at + NODE_BYTES
                return
            if not key.startswith(child.label, at):
                keep = shared_prefix(child.label, key[at : at + len(child.label)])
                upper = Node(child.label[:keep])
                child.label = child.label[keep:]
                upper.kids[child.label[0]] = child
                node.kids[key[at]] = upper
                self.bytes += NODE_BYTES
                child = upper
            node, at = child, at + len(child.label)
        if node.entry is None:
            node.entry = entry
        else:
            held = node.entry
            rows = held[0] + entry[0]
            node.entry = [rows, *(held[1:] if held[1] >= entry[1] else entry[1:])]

    def drain(self, top: Node | None = None) -> Iterator[tuple[bytes, list]]:
        """Every string and entry, in the order of the strings; the trie or subtree is emptied."""
        open_nodes = [(b"", top or self.root)]
        while open_nodes:
            prefix, node = open_nodes.pop()
            text = prefix + node.label
            self.bytes -= len(node.label) + NODE_BYTES
            if node.entry is not None:
                yield text, node.entry
            for first in sorted(node.kids, reverse=True):
                open_nodes.append((text, node.kids[first]))
        if top is None:
            self.root, self.bytes = Node(b""), 0

    def spill_largest(self) -> Iterator[tuple[bytes, list]]:
        """Empty the subtree below the root that holds most."""

        def weight(node: Node) -> int:
            total, todo = 0, [node]
            while todo:
                one = todo.pop()
                total += len(one.label) + NODE_BYTES
                todo += one.kids.values()
            return total

        first = max(self.root.kids, key=lambda k: weight(self.root.kids[k]))
        yield from self.drain(self.root.kids.pop(first))


def _writer(schema: pa.Schema, names: list[str], text: str, with_text: bool):
    """Turns drained entries into record batches of at most about 8 MB of text."""

    def batches(drained: Iterator[tuple[bytes, list]]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0

        def batch() -> pa.RecordBatch:
            columns = []
            for k, field in enumerate(schema):
                columns.append(pa.array([r[k] for r in rows], field.type))
            return pa.RecordBatch.from_arrays(columns, schema=schema)

        for key, (count, _, payload) in drained:
            values = list(payload)
            if with_text and values[names.index(text)] is not None:
                values[names.index(text)] = key.decode("utf-8")
            rows.append([*values, count])
            held += len(key) + 100
            if held > 8 << 20:
                yield batch()
                rows, held = [], 0
        if rows:
            yield batch()

    return batches


def exact_owners(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    largest: bool = True,
    budget: int = TRIE_BYTES,
    with_text: bool = True,
    size_col: str = "group_size",
) -> DataFrame:
    """One row per distinct text: the row that stays, with all its columns, and ``size_col``.

    Texts are equal when their bytes are; a null text counts as an empty one. The row with the
    largest (else smallest) id stays; a null id loses against any other, and of rows that agree
    in text and id one stays. An empty table gives an empty result. A column that is already
    called ``size_col`` is replaced. ``with_text=False`` leaves the text empty.
    """
    names = [c for c in docs.columns if c != size_col]
    docs = docs.select(*[F.col(f"`{c}`") for c in names])
    fields = [T.StructField(f.name, f.dataType, True) for f in docs.schema]
    out = T.StructType([*fields, T.StructField(size_col, T.LongType())])
    sign = 1 if largest else -1

    def rank(identifier):
        return (identifier is not None, 0 if identifier is None else sign * identifier)

    def entries(batch: pa.RecordBatch) -> Iterator[tuple[bytes, list]]:
        columns = [c.to_pylist() for c in batch.columns]
        where = [batch.schema.names.index(n) for n in names]
        text, ident = columns[where[names.index(text_col)]], columns[where[names.index(id_col)]]
        others = [columns[w] for w in where]
        at = names.index(text_col)
        others[at] = [None if t is None else "" for t in text]
        counts = columns[batch.schema.names.index(size_col)]
        for t, i, n, *payload in zip(text, ident, counts, *others, strict=True):
            yield (t or "").encode(), [n, rank(i), payload]

    def arrow_schema(batch: pa.RecordBatch) -> pa.Schema:
        kinds = {f.name: f.type for f in batch.schema}
        return pa.schema([(f.name, kinds.get(f.name, pa.int64())) for f in out])

    def gather(batches):
        trie, write = Trie(), None
        for batch in batches:
            write = write or _writer(arrow_schema(batch), names, text_col, True)
            for key, entry in entries(batch):
                trie.insert(key, entry)
                if trie.bytes > budget and trie.root.kids:
                    yield from write(trie.spill_largest())
        if write:
            yield from write(trie.drain())

    def settle(batches):
        trie, write, last = Trie(), None, None
        for batch in batches:
            write = write or _writer(arrow_schema(batch), names, text_col, with_text)
            for key, entry in entries(batch):
                if trie.bytes > budget and key != last:
                    yield from write(trie.drain())  # sorted input: every subtree is closed
                trie.insert(key, entry)
                last = key
        if write:
            yield from write(trie.drain())

    partial = docs.withColumn(size_col, F.lit(1).cast("long")).mapInArrow(gather, out)
    key = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    dealt = (
        partial.repartition(F.octet_length(key), F.xxhash64(key)).sortWithinPartitions(key)
    )
    return dealt.mapInArrow(settle, out)


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``.

    The tries of :func:`exact_owners` decide; rows find the terminal node of their text by its
    digest, which travels with the owner. Rows that agree in text and id are reported alike.
    """
    narrow = docs.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`").alias("_text"))
    narrow = narrow.withColumn("_digest", F.unhex(F.sha2(F.coalesce("_text", F.lit("")), 256)))
    owners = exact_owners(narrow, "_id", "_text", with_text=False).select(
        "_digest", F.col("_id").alias("keep_id"), "group_size"
    )
    return (
        narrow.select("_id", "_digest")
        .join(owners, "_digest")
        .select(
            F.col("_id").alias(id_col),
            "keep_id",
            "group_size",
            F.col("_id").eqNullSafe(F.col("keep_id")).alias("kept"),
            F.lower(F.hex("_digest")).alias("text_sha256"),
        )
    )
