"""Chat logs to training text: event-sourced reconstruction, then a reversible template.

A log holds events: ``open`` begins a message and names its role, ``delta`` appends text,
``edit`` replaces the text, ``regenerate`` forgets it. What a run of events does to a message
is a pair (forget what was before?, text to append), and such pairs compose associatively.
So the log is range-partitioned by conversation and sequence, a hot conversation lies in many
partitions, each task folds its runs, and the few pairs of each message are composed in order
afterwards. No task holds a conversation.

Turns are rendered one by one; a conversation is its turns put together in order. Control
strings inside texts are broken by a backslash after their first character, backslashes are
doubled, and every marker is set off by a blank, so markers stand only where turns begin and
end and the text is read back exactly.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters of text that a task holds before it gives out the runs folded so far.
HELD = 8 << 20
#: Order of events within a log.
SEQUENCE = ("phase", "turn", "message", "step")


@dataclass(frozen=True)
class Template:
    """Markers around the turns of each role, and further strings that texts must not show."""

    roles: dict[str, tuple[str, str]] = field(
        default_factory=lambda: {
            "system": ("<<SYS>>", "<</SYS>>"),
            "user": ("[INST]", "[/INST]"),
            "assistant": ("<s>", "</s>"),
        }
    )
    #: Opening, middle and closing marker of a turn of any other role.
    other: tuple[str, str, str] = ("[ROLE]", "[TEXT]", "[/ROLE]")
    #: Strings that tokenizers take for control tokens.
    reserved: tuple[str, ...] = ("<|im_start|>", "<|im_end|>", "<|endoftext|>", "<unk>", "<pad>")
    #: The role whose texts are trained on.
    learned: str = "assistant"

    def controls(self) -> list[str]:
        marks = [m for pair in self.roles.values() for m in pair]
        return [*marks, *self.other, *self.reserved]

    def escape(self, text: str) -> str:
        """``text`` without control strings; :meth:`unescape` gives it back."""
        if "\\" not in text and "<" not in text and "[" not in text:
            return text
        first = "|".join(f"{re.escape(c[0])}(?={re.escape(c[1:])})" for c in self.controls())
        return re.sub(rf"\\|{first}", lambda m: m[0] + "\\", text)

    def unescape(self, text: str) -> str:
        return re.sub(r"(?s)\\(.)", r"\1", text) if "\\" in text else text

    def render(self, role: str, text: str) -> tuple[str, tuple[int, int] | None]:
        """The turn as text, and the span of what is trained on (code points), if anything is."""
        if role in self.roles:
            start, end = self.roles[role]
            head = f"{start} "
        else:
            start, middle, end = self.other
            head = f"{start} {self.escape(role)} {middle} "
        body = self.escape(text)
        span = (len(head), len(head) + len(body)) if role == self.learned else None
        return f"{head}{body} {end}", span

    def parse(self, formatted: str) -> Iterator[tuple[str, str]]:
        """Roles and texts of the turns in ``formatted``; anything else is an error."""
        openers = {pair[0]: (role, pair[1]) for role, pair in self.roles.items()}
        openers[self.other[0]] = (None, self.other[2])
        at = 0
        while at < len(formatted):
            start = next((o for o in openers if formatted.startswith(f"{o} ", at)), None)
            if start is None:
                raise ValueError(f"no turn begins at {at}")
            role, end = openers[start]
            at += len(start) + 1
            if role is None:
                stop = formatted.index(f" {self.other[1]} ", at)
                role = self.unescape(formatted[at:stop])
                at = stop + len(self.other[1]) + 2
            stop = formatted.index(f" {end}", at)
            yield role, self.unescape(formatted[at:stop])
            at = stop + len(end) + 1


def event_log(turns: DataFrame, conv_col: str = "conv_id", chunk: int = 200) -> DataFrame:
    """The events by which a stored table of ``turn``, ``role``, ``text`` may have come about.

    Texts arrive in deltas of ``chunk`` characters. A third of the messages begin with a draft
    that is regenerated; a fifth end with a slip and are edited once the conversation is over.
    A hash of the row decides, so the same table gives the same log. A null text is empty.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    own = turns.select(
        F.col(f"`{conv_col}`").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.col("role").cast("string").alias("role"),
        text.alias("text"),
        F.monotonically_increasing_id().alias("message"),
        F.pmod(F.xxhash64(F.lit("draft"), conv_col, "turn", text), F.lit(15)).alias("_kind"),
    )
    drafted, edited = F.col("_kind") % 3 == 0, F.col("_kind") % 5 == 0

    def event(phase: int, kind: str, value=None, role=None):
        return F.struct(
            F.lit(phase).alias("phase"), F.lit(kind).alias("kind"),
            (F.lit(None) if role is None else role).cast("string").alias("role"),
            (F.lit(None) if value is None else value).cast("string").alias("text"),
        )

    deltas = F.transform(
        F.regexp_extract_all("text", F.lit(f"(?s).{{1,{chunk}}}"), F.lit(0)), lambda piece: event(0, "delta", piece)
    )
    draft = F.array(event(0, "delta", F.reverse(F.substring("text", 1, 40))), event(0, "regenerate"))
    slip = F.array(event(0, "delta", F.lit(" (wrong)")), event(1, "edit", F.col("text")))
    none = F.filter(draft, lambda e: F.lit(False))
    events = F.concat(
        F.array(event(0, "open", role=F.col("role"))),
        F.when(drafted, draft).otherwise(none), deltas, F.when(edited, slip).otherwise(none),
    )
    return own.select("conv_id", "turn", "message", F.posexplode(events).alias("step", "_event")).select(
        "conv_id", "turn", "message", "step", "_event.*"
    )


def fold_log(log: DataFrame) -> DataFrame:
    """The final messages: ``conv_id``, ``turn``, ``message``, ``role``, ``text``.

    ``log`` has ``conv_id``, ``turn``, ``message`` (unique within a conversation), ``kind``,
    ``role``, ``text`` and the columns of the sequence (phase, turn, message, step), which
    orders the events of a conversation. A message whose ``open`` is missing has no role. Null
    texts append nothing; an unknown kind is an error; other columns are not looked at.
    """
    order = [F.col("conv_id"), *[F.col(c) for c in SEQUENCE]]
    narrow = log.select("conv_id", *SEQUENCE, "kind", "role", "text")
    ranged = narrow.repartitionByRange(*order).sortWithinPartitions(*order)
    ident = log.schema["conv_id"].dataType.simpleString()
    sequence = ", ".join(f"{c}: {log.schema[c].dataType.simpleString()}" for c in SEQUENCE)

    def runs(batches):
        """One row per message and stretch of the log: where it starts, and what it does."""
        held, size, conv, schema = {}, 0, None, None

        def give():
            nonlocal size
            keys, values = list(held), list(held.values())
            held.clear()
            size = 0
            columns = [
                pa.array([v[4] for v in values], schema.field("conv_id").type),
                pa.array([k[0] for k in keys], pa.int64()),
                pa.array([k[1] for k in keys], pa.int64()),
                pa.array([v[3] for v in values], pa.struct([schema.field(c) for c in SEQUENCE])),
                pa.array([v[0] for v in values], pa.bool_()),
                pa.array([v[1] for v in values], pa.string()),
                pa.array(["".join(v[2]) for v in values], pa.string()),
            ]
            names = ["conv_id", "turn", "message", "first", "forgets", "role", "text"]
            return pa.RecordBatch.from_arrays(columns, names=names)

        for batch in batches:
            schema = batch.schema
            table = [batch.column(schema.get_field_index(c)).to_pylist() for c in ["conv_id", *SEQUENCE, "kind", "role", "text"]]
            for c, phase, turn, message, step, kind, role, text in zip(*table, strict=True):
                if held and (c != conv or size > HELD):
                    yield give()
                conv = c
                first = dict(zip(SEQUENCE, (phase, turn, message, step), strict=True))
                one = held.setdefault((turn, message), [False, None, [], first, c])
                if kind == "open":
                    one[1] = role or ""
                elif kind == "delta":
                    one[2].append(text or "")
                elif kind == "edit":
                    one[0], one[2] = True, [text or ""]
                elif kind == "regenerate":
                    one[0], one[2] = True, []
                else:
                    raise ValueError(f"unknown event {kind!r}")
                size += len(text or "") + 100
        if held:
            yield give()

    partial = ranged.mapInArrow(
        runs,
        f"conv_id {ident}, turn long, message long, first struct<{sequence}>, forgets boolean, role string, text string",
    )
    # a message has one row for each stretch of the log it lies in
    steps = F.array_sort(F.collect_list(F.struct("first", "forgets", "role", "text")))
    whole = partial.groupBy("conv_id", "turn", "message").agg(steps.alias("_steps"))
    empty = F.struct(F.lit(None).cast("string").alias("role"), F.array().cast("array<string>").alias("texts"))

    def compose(before, step):
        kept = F.when(step["forgets"], F.array().cast("array<string>")).otherwise(before["texts"])
        return F.struct(
            F.coalesce(step["role"], before["role"]).alias("role"),
            F.concat(kept, F.array(step["text"])).alias("texts"),
        )

    folded = whole.withColumn("_final", F.aggregate("_steps", empty, compose))
    return folded.select(
        "conv_id", "turn", "message",
        F.coalesce("_final.role", F.lit("")).alias("role"),
        F.array_join("_final.texts", "").alias("text"),
    )


def render_turns(messages: DataFrame, template: Template | None = None) -> DataFrame:
    """``conv_id``, ``turn``, ``message``, ``formatted``, ``loss_start``, ``loss_end`` of every message.

    The formatted conversation is its turns in the order of ``turn``, then ``formatted``; spans
    count code points from the start of the turn and are null where nothing is learned.
    """
    template = template or Template()
    names = ["conv_id", "turn", "message"]
    kinds = ", ".join(f"{c} {messages.schema[c].dataType.simpleString()}" for c in names)

    def render(batches):
        for batch in batches:
            role, text = batch.column(3).to_pylist(), batch.column(4).to_pylist()
            done = [template.render(r or "", t or "") for r, t in zip(role, text, strict=True)]
            columns = [batch.column(k) for k in range(3)]
            columns.append(pa.array([d[0] for d in done], pa.string()))
            for end in (0, 1):
                columns.append(pa.array([d[1] and d[1][end] for d in done], pa.int64()))
            yield pa.RecordBatch.from_arrays(columns, names=[*names, "formatted", "loss_start", "loss_end"])

    return messages.select(*names, "role", "text").mapInArrow(
        render, f"{kinds}, formatted string, loss_start long, loss_end long"
    )


def read_back(rendered: DataFrame, template: Template | None = None) -> DataFrame:
    """One row per conversation, from its formatted turns alone.

    ``n_turns``; ``turns_sha256`` of role, line feed, text, line feed of every turn;
    ``loss_chars`` and ``loss_sha256`` of the unescaped text under the loss spans;
    ``formatted_chars``. A digest over a sequence cannot be split, so the turns of one
    conversation pass through one task, but as a stream: it holds one turn at a time.
    """
    template = template or Template()
    ident = rendered.schema["conv_id"].dataType.simpleString()
    order = ["conv_id", "turn", "formatted"]
    ranged = rendered.select(*order, "loss_start", "loss_end").repartition("conv_id").sortWithinPartitions(*order)
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def digest(batches):
        state, conv, kind = None, None, None

        def result():
            turns, hash_, loss_chars, loss_hash, chars = state
            row = [conv, turns, hash_.hexdigest(), loss_chars, loss_hash.hexdigest(), chars]
            kinds = [kind, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            columns = [pa.array([v], k) for v, k in zip(row, kinds, strict=True)]
            return pa.RecordBatch.from_arrays(columns, names=names)

        def results(rows):
            return pa.Table.from_batches(rows).combine_chunks().to_batches() if rows else []

        for batch in batches:
            kind, done = batch.column(0).type, []
            for c, formatted, start, end in zip(*[batch.column(k).to_pylist() for k in (0, 2, 3, 4)], strict=True):
                if state is not None and c != conv:
                    done.append(result())
                    state = None
                if state is None:
                    conv, state = c, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, text in template.parse(formatted):
                    state[0] += 1
                    state[1].update(f"{role}\n{text}\n".encode())
                if start is not None:
                    learned = template.unescape(formatted[start:end])
                    state[2] += len(learned)
                    state[3].update(learned.encode())
                state[4] += len(formatted)
            yield from results(done)
        if state is not None:
            yield result()

    return ranged.mapInArrow(
        digest,
        f"conv_id {ident}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long",
    )
