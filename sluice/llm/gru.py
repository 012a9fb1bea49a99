"""A gated recurrent language model in numpy, trained and applied inside Spark tasks.

Words of the training documents are counted over the whole corpus. The most frequent ones are
numbered by frequency; a class-factored softmax first predicts a word's class from the state,
then, for the classes of the most frequent words, the word from the state and the class. In
all other classes a word has its share of the corpus counts. Words beyond the numbered ones
form a class whose shares come from the counts by a join, so no task needs the whole
vocabulary.

Training deals the documents to shards by a hash of id and text, as many as the corpus has
tokens for. Truncated backpropagation through time runs in every shard, starting from common
weights, and the results are averaged by tokens, as whole numbers, whose sum has no order; the
first round takes a fixed share of the shards, the last one all of them. So the weights depend
on the rows only, and not on the files or partitions they lie in. Documents run in parallel
lanes; the state is carried from window to window to the end of each document. In training, the
documents that are left when few lanes still run wait with their state and go on beside the next
documents of the shard.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.llm.bytewords import flat, slices
from sluice.session import materialize

HIDDEN = 16
#: Words whose probability depends on the state, in classes of this many.
SHARP, SHARP_CLASS = 1024, 32
#: Further classes of numbered words, by equal shares of the tokens.
FLAT_CLASSES = 31
#: Numbered words at most, and bytes of the longest word that is numbered.
NUMBERED, LONGEST = 1 << 18, 64
#: Steps of backpropagation, bytes of text that run at once, lanes at most.
WINDOW, SLICE, LANES = 16, 16 << 20, 1024
#: Mean tokens of a lane in training, at least and (unless LANES are full) at most.
LANE_TOKENS = 256, 1024
#: Unfinished documents that training may put off, and their tokens, at most.
WAITING, WAITING_TOKENS = 256, 1 << 21
#: Tokens of a shard on average, and tokens of a shard that are trained on at once.
SHARD_TOKENS, TRAIN_TOKENS = 1 << 22, 1 << 23
#: One shard of so many is in the first round.
FIRST_ROUND = 16
#: Shards whose weights are added up at once; units of a weight, and of its tokens.
FAN_IN, UNIT, TOKEN_UNIT = 16, 1 << 20, 1 << 12
#: Logits below this need no shift before their exponentials are taken; rows at once.
SAFE_LOGIT, OUTPUT_ROWS = 60.0, 4096


def word_lists(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of the texts, A-Z lowered, and where each text's words begin."""
    lowered = pc.ascii_trim_whitespace(pc.ascii_lower(pc.fill_null(column, "")))
    listed = pc.ascii_split_whitespace(lowered)
    bounds = listed.offsets.to_numpy().astype(np.int64)
    words = listed.values.slice(bounds[0], bounds[-1] - bounds[0])
    bounds = bounds - bounds[0]
    empty = pc.equal(lowered, "").to_numpy(zero_copy_only=False)
    if empty.any():  # an empty text is split into one empty word
        full = pc.not_equal(words, "")
        words = words.filter(full)
        sizes = np.diff(bounds)
        sizes[empty] = 0
        bounds = np.r_[0, np.cumsum(sizes)]
    return words, bounds


def word_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``word`` and ``c`` over all rows."""

    def count(batches):
        for batch in batches:
            _, offsets = flat(batch.column(0))
            for first, last in slices(offsets, SLICE):
                words, _ = word_lists(batch.column(0).slice(first, last - first))
                found = words.value_counts()
                yield pa.RecordBatch.from_arrays([found.field("values"), found.field("counts")], names=["word", "n"])

    counted = docs.select(F.col(f"`{text_col}`").alias("_text")).mapInArrow(count, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("c"))


@dataclass
class Vocabulary:
    """Numbered words with their counts, in order of frequency, and the corpus totals.

    The words stay an Arrow column, which takes a tenth of the memory of Python strings in every
    worker.
    """

    words: pa.Array | list[str]
    counts: np.ndarray
    tokens: int
    distinct: int
    ends: int

    def __post_init__(self) -> None:
        if not isinstance(self.words, pa.Array):
            self.words = pa.array(self.words, pa.string())
        n = len(self.words)
        sharp = min(n, SHARP)
        self.first_flat = -(-SHARP // SHARP_CLASS)
        self.end_class = self.first_flat + FLAT_CLASSES
        self.rest_class = self.end_class + 1
        self.classes = self.rest_class + 1
        self.start = SHARP + self.classes
        self.inputs = self.start + 1
        number = np.arange(n)
        cls = number // SHARP_CLASS
        mass = np.cumsum(self.counts[sharp:].astype(float))
        if len(mass):
            share = (mass - self.counts[sharp:] / 2) / mass[-1]
            cls[sharp:] = self.first_flat + np.minimum((share * FLAT_CLASSES).astype(int), FLAT_CLASSES - 1)
        # numbers n and n + 1 stand for the end and for all words without a number
        self.cls = np.r_[cls, self.end_class, self.rest_class].astype(np.int32)
        within = np.zeros(n + 2)
        total = np.bincount(self.cls[:n], weights=self.counts, minlength=self.classes)
        within[sharp:n] = np.log(self.counts[sharp:] / total[self.cls[sharp:n]])
        self.within = within
        entry = np.where(number < SHARP, number, SHARP + cls)
        self.entry = np.r_[entry, SHARP + self.end_class, SHARP + self.rest_class].astype(np.int32)
        rest = max(self.tokens - self.ends - int(self.counts.sum()), 0)
        total[self.end_class], total[self.rest_class] = self.ends, rest
        self.class_total = total
        self.rest_tokens, self.rest_distinct = rest, max(self.distinct - n - (self.ends > 0), 0)

    @property
    def state(self) -> tuple:
        """What makes it again elsewhere, as plain values."""
        return self.words, self.counts, self.tokens, self.distinct, self.ends

    @property
    def base_log(self) -> np.ndarray:
        """log10 of the smoothed corpus share of each numbered word, and of the end."""
        whole = self.tokens + 0.1 * (self.distinct + 1)
        return np.log10((np.r_[self.counts, self.ends] + 0.1) / whole)


def start_weights(v: Vocabulary, seed: int = 0) -> dict[str, np.ndarray]:
    """Small random weights; the biases of the softmaxes are the corpus shares."""
    rng = np.random.default_rng(seed)
    small = lambda *shape: rng.normal(0, 0.1, shape).astype(np.float32)
    sharp = np.zeros(SHARP, np.float32)
    sharp[: min(len(v.counts), SHARP)] = np.log(v.counts[:SHARP])
    sharp[len(v.counts) :] = -20.0
    return {
        "x": small(v.inputs, 3 * HIDDEN),
        "u": small(HIDDEN, 3 * HIDDEN),
        "b": np.zeros(3 * HIDDEN, np.float32),
        "wc": small(HIDDEN, v.classes),
        "bc": np.log(v.class_total + 0.5).astype(np.float32),
        "ww": small(v.first_flat, HIDDEN, SHARP_CLASS),
        "bw": sharp.reshape(v.first_flat, SHARP_CLASS),
    }


def lanes(sizes: np.ndarray, count: int | None = None, first: int = 0) -> list[list[int]]:
    """Rows dealt to lanes of even length, longest lane first.

    The ``first`` rows begin a lane each; the others go longest first to the shortest lane.
    """
    count = count or int(np.clip(sizes.sum() // max(int(sizes.max()), 256), 1, LANES))
    dealt: list[list[int]] = [[k] if k < first else [] for k in range(count)]
    length = np.zeros(count, np.int64)
    length[:first] = sizes[:first]
    heap = [(int(n), k) for k, n in enumerate(length)]
    heapq.heapify(heap)
    for row in (first + np.argsort(-sizes[first:], kind="stable")).tolist():
        total, k = heapq.heappop(heap)
        dealt[k].append(row)
        length[k] = total + int(sizes[row])
        heapq.heappush(heap, (int(length[k]), k))
    return [dealt[k] for k in np.argsort(-length, kind="stable") if dealt[k]]


def _with_ends(numbers: np.ndarray, bounds: np.ndarray, v: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """The texts' numbers with the end after each text, and where the texts begin in them."""
    edge = np.r_[0, np.cumsum(np.diff(bounds) + 1)]
    whole = np.full(int(edge[-1]), len(v.words), np.int32)
    mask = np.ones(len(whole), bool)
    mask[edge[1:] - 1] = False
    whole[mask] = numbers
    return whole, edge


def streams(numbers: np.ndarray, bounds: np.ndarray, v: Vocabulary):
    """Inputs, targets (-1: none), rows and active lanes as matrices of steps by lanes.

    Each text is one run of tokens, its end included.
    """
    whole, edge = _with_ends(numbers, bounds, v)
    sizes = np.diff(edge)
    dealt = lanes(sizes)
    steps = int(sizes[dealt[0]].sum())
    target = np.full((steps, len(dealt)), -1, np.int32)
    entry = np.full((steps, len(dealt)), v.start, np.int32)
    row = np.zeros((steps, len(dealt)), np.int32)
    active = np.zeros(steps, np.int64)
    for k, rows in enumerate(dealt):
        at = 0
        for r in rows:
            n = int(sizes[r])
            own = whole[edge[r] : edge[r + 1]]
            target[at : at + n, k] = own
            entry[at + 1 : at + n, k] = v.entry[own[:-1]]
            row[at : at + n, k] = r
            at += n
        active[:at] += 1
    return entry, target, row, active


def _sigmoid(x: np.ndarray) -> np.ndarray:
    out = np.negative(x)
    np.exp(out, out=out)
    out += 1
    return np.reciprocal(out, out=out)


def _softmax(h: np.ndarray, weights: np.ndarray, bias: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Probabilities of all outputs, and the log-probability of the output ``at`` of each row."""
    logits = h @ weights
    logits += bias - bias.max()
    if np.abs(weights).sum(0).max() > SAFE_LOGIT:  # a state lies between -1 and 1
        logits -= logits.max(1, keepdims=True)
    rows = np.arange(len(h))
    own = logits[rows, at]
    np.exp(logits, out=logits)
    total = logits @ np.ones(logits.shape[1], logits.dtype)
    logits /= total[:, None]
    return logits, own - np.log(total)


def _outputs(w: dict, h: np.ndarray, target: np.ndarray, v: Vocabulary, grad: dict | None = None):
    """log-probability of each target from its state; with ``grad``, also the states' gradient."""
    cls = v.cls[target]
    out = v.within[target].astype(np.float32)
    back = None if grad is None else np.empty_like(h)
    for first in range(0, len(target), OUTPUT_ROWS):
        own = slice(first, first + OUTPUT_ROWS)
        d, logs = _softmax(h[own], w["wc"], w["bc"], cls[own])
        out[own] += logs
        if grad is not None:
            d[np.arange(len(d)), cls[own]] -= 1
            grad["wc"] += h[own].T @ d
            grad["bc"] += np.ones(len(d), d.dtype) @ d
            back[own] = d @ w["wc"].T
    sharp = np.flatnonzero(cls < v.first_flat)
    order = sharp[np.argsort(cls[sharp], kind="stable")]
    edges = np.searchsorted(cls[order], np.arange(v.first_flat + 1))
    for c in range(v.first_flat):
        own = order[edges[c] : edges[c + 1]]
        if not len(own):
            continue
        place, state = target[own] - c * SHARP_CLASS, h[own]
        d, logs = _softmax(state, w["ww"][c], w["bw"][c], place)
        out[own] += logs
        if grad is not None:
            d[np.arange(len(own)), place] -= 1
            grad["ww"][c] += state.T @ d
            grad["bw"][c] += np.ones(len(d), d.dtype) @ d
            back[own] += d @ w["ww"][c].T
    return out, back


def _step(w: dict, x: np.ndarray, h: np.ndarray):
    """New state and what the way back needs."""
    s = h @ w["u"]
    z = _sigmoid(x[:, :HIDDEN] + s[:, :HIDDEN])
    r = _sigmoid(x[:, HIDDEN : 2 * HIDDEN] + s[:, HIDDEN : 2 * HIDDEN])
    inner = np.ascontiguousarray(s[:, 2 * HIDDEN :])
    n = np.tanh(x[:, 2 * HIDDEN :] + r * inner)
    return n + z * (h - n), (h, z, r, inner, n)


def log_likelihoods(w: dict, numbers: np.ndarray, bounds: np.ndarray, v: Vocabulary) -> np.ndarray:
    """Natural log-likelihood of each text, the end included; unnumbered words by class only."""
    entry, target, row, active = streams(numbers, bounds, v)
    total = np.zeros(len(bounds) - 1)
    table = w["x"] + w["b"]
    h = np.zeros((target.shape[1], HIDDEN), np.float32)
    for first in range(0, len(target), WINDOW):
        states, wanted, owner = [], [], []
        for t in range(first, min(first + WINDOW, len(target))):
            n = int(active[t])
            inputs = entry[t, :n]
            h = h[:n] * (inputs != v.start)[:, None]
            h, _ = _step(w, table.take(inputs, 0), h.astype(np.float32))
            states.append(h)
            wanted.append(target[t, :n])
            owner.append(row[t, :n])
        logs, _ = _outputs(w, np.concatenate(states), np.concatenate(wanted), v)
        total += np.bincount(np.concatenate(owner), weights=logs, minlength=len(total))
    return total


def _put_off(length: np.ndarray) -> int:
    """Steps after which few enough lanes and tokens are left to wait; lengths are descending."""
    low, high = int(length[min(WAITING, len(length) // 4)]), int(length[0])
    while low < high:
        middle = (low + high) // 2
        if np.maximum(length - middle, 0).sum() <= WAITING_TOKENS:
            high = middle
        else:
            low = middle + 1
    return low


def train_slice(
    w: dict, memory: dict, numbers, bounds, v: Vocabulary, rate: float, waiting: tuple = (), finish: bool = True
) -> list:
    """Truncated backpropagation over the texts, updating the weights after every window.

    ``waiting`` holds what earlier calls put off: of each text the last input, the state and
    the tokens left. Unless told to ``finish``, the call puts texts off in its turn.
    """
    whole, edge = _with_ends(numbers, bounds, v)
    parts = [left for _, _, left in waiting] + [whole[a:b] for a, b in zip(edge, edge[1:])]
    if not parts:
        return []
    sizes = np.array([len(part) for part in parts])
    count = int(sizes.sum()) // int(np.clip(sizes.max(), *LANE_TOKENS))
    dealt = lanes(sizes, int(np.clip(count, max(len(waiting), 1), LANES)), len(waiting))
    length = np.array([int(sizes[rows].sum()) for rows in dealt])
    begin = np.r_[0, np.cumsum(length)]
    target = np.concatenate([parts[r] for rows in dealt for r in rows])
    entry = np.r_[v.start, v.entry[target[:-1]]].astype(np.int32)
    entry[np.r_[0, np.cumsum(sizes[[r for rows in dealt for r in rows]])[:-1]]] = v.start
    h = np.zeros((len(dealt), HIDDEN), np.float32)
    for k, rows in enumerate(dealt):
        if rows[0] < len(waiting):
            entry[begin[k]], h[k] = waiting[rows[0]][:2]
    begin = begin[:-1]
    steps = int(length[0]) if finish else _put_off(length)
    active = np.searchsorted(-length, -np.arange(steps), "left")
    for first in range(0, steps, WINDOW):
        grad = {k: np.zeros_like(a) for k, a in w.items()}
        table = w["x"] + w["b"]
        kept, states, wanted = [], [], []
        for t in range(first, min(first + WINDOW, steps)):
            at = begin[: active[t]] + t
            inputs = entry[at]
            alive = (inputs != v.start).astype(np.float32)[:, None]
            h, way = _step(w, table.take(inputs, 0), h[: len(at)] * alive)
            kept.append((inputs, alive, way))
            states.append(h)
            wanted.append(target[at])
        _, back = _outputs(w, np.concatenate(states), np.concatenate(wanted), v, grad)
        edges = np.r_[0, np.cumsum([len(s) for s in states])]
        later = np.zeros((0, HIDDEN), np.float32)
        dxs, dss, ins, befores = [], [], [], []
        for t in range(len(kept) - 1, -1, -1):
            inputs, alive, (before, z, r, inner, n) = kept[t]
            d = back[edges[t] : edges[t + 1]].copy()
            d[: len(later)] += later
            dn = d * (1 - z) * (1 - n * n)
            dz = d * (before - n) * z * (1 - z)
            dr = dn * inner * r * (1 - r)
            dx = np.concatenate([dz, dr, dn], 1)
            ds = np.concatenate([dz, dr, dn * r], 1)
            dss.append(ds)
            befores.append(before)
            later = (d * z + ds @ w["u"].T) * alive
            dxs.append(dx)
            ins.append(inputs)
        dx, inputs = np.concatenate(dxs), np.concatenate(ins)
        grad["u"] += np.concatenate(befores).T @ np.concatenate(dss)
        grad["b"] += dx.sum(0)
        order = np.argsort(inputs.astype(np.int16), kind="stable")  # a radix sort
        runs = np.flatnonzero(np.r_[True, np.diff(inputs[order]) > 0])
        grad["x"][inputs[order[runs]]] = np.add.reduceat(dx.take(order, 0), runs)
        for name, g in grad.items():
            g /= edges[-1] ** 0.5
            memory[name] += g * g
            w[name] -= (rate * g / np.sqrt(memory[name] + 1e-6)).astype(np.float32)
    left = []
    for k in range(int(np.searchsorted(-length, -steps, "left"))):
        at = steps
        for r in dealt[k]:  # the text that runs at this step goes on, those behind it begin later
            n = int(sizes[r])
            if at < n:
                goes_on = at > 0 or r < len(waiting)
                left.append((entry[begin[k] + steps] if goes_on else v.start, h[k], parts[r][max(at, 0) :].copy()))
            at -= n
    return left


def _numbered(words: pa.Array, known: pa.Array) -> np.ndarray:
    """Numbers of words; words without a number get the last one."""
    found = pc.index_in(words, value_set=known)
    return pc.fill_null(found, len(known) + 1).to_numpy()


def _encoded(docs: DataFrame, v: Vocabulary, shards: int, id_col: str, text_col: str) -> DataFrame:
    """``shard``, ``key`` and the words' numbers (``codes``, 32 bits each) of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(v.words)

    def encode(batches):
        known = shared.value
        for batch in batches:
            _, offsets = flat(batch.column(1))
            for a, b in slices(offsets, SLICE):
                words, bounds = word_lists(batch.column(1).slice(a, b - a))
                numbers = _numbered(words, known).astype("<i4")
                codes = pa.Array.from_buffers(
                    pa.large_binary(), b - a, [None, pa.py_buffer(bounds * 4), pa.py_buffer(numbers)]
                )
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), codes.cast(pa.binary())], names=["key", "codes"]
                )

    key = F.xxhash64(F.col(f"`{id_col}`"), F.col(f"`{text_col}`"))
    keyed = docs.select(key.alias("key"), F.col(f"`{text_col}`").alias("_text"))
    coded = keyed.mapInArrow(encode, "key long, codes binary")
    return coded.select(F.pmod("key", F.lit(shards)).cast("int").alias("shard"), "key", "codes")


def _of_shards(batches):
    """``shard``, numbers and bounds of runs of documents; where batches end makes no difference."""
    own, held, size = None, [], 0
    for batch in batches:
        for shard, codes in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            if held and (shard != own or size >= TRAIN_TOKENS):
                bounds, numbers, held, size = np.r_[0, np.cumsum([len(n) for n in held])], np.concatenate(held), [], 0
                yield own, numbers, bounds
            own = shard
            held.append(np.frombuffer(codes.as_buffer(), "<i4"))
            size += len(held[-1]) + 1
    if held:
        bounds, numbers, held = np.r_[0, np.cumsum([len(n) for n in held])], np.concatenate(held), []
        yield own, numbers, bounds


def _added(rows: DataFrame) -> tuple[np.ndarray, int] | None:
    """Sums of ``sums`` (64-bit whole numbers as bytes) and ``weight`` over all rows, by a tree.

    Whole numbers add up to the same in any order.
    """

    def add(table: pa.Table) -> pa.Table:
        total = np.zeros(1, np.int64)
        for one in table["sums"]:
            total = total + np.frombuffer(one.as_buffer(), "<i8")
        weight = pc.sum(table["weight"])
        node = [table["node"][0].as_py() // FAN_IN]
        return pa.table({"node": pa.array(node, pa.int32()), "weight": [weight.as_py()], "sums": [total.tobytes()]})

    rows = materialize(rows, "weights")
    left = rows.count()
    while left > 1:
        above = rows.groupBy(F.expr(f"node div {FAN_IN}")).applyInArrow(add, rows.schema)
        rows = materialize(above, "weights")
        left = rows.count()
    one = rows.first()
    return one and (np.frombuffer(bytes(one["sums"]), "<i8"), one["weight"])


def train(
    docs: DataFrame, v: Vocabulary, text_col: str = "text", rates: tuple = (0.1, 0.03), id_col: str = "doc_id"
) -> dict:
    """Weights after one round on a share of the shards and one on all of them.

    What reaches the driver is one number for each weight, added up by Spark. A shard is one
    task's work, a stream of bounded slices; there is one for every ``SHARD_TOKENS`` tokens.
    """
    spark = docs.sparkSession
    weights = start_weights(v)
    if not v.tokens:
        return weights
    shapes = {k: a.shape for k, a in weights.items()}
    shards = -(-v.tokens // SHARD_TOKENS)
    coded = materialize(_encoded(docs, v, shards, id_col, text_col), "coded")
    for share, rate in zip((-(-shards // FIRST_ROUND), shards), rates, strict=True):
        shared = spark.sparkContext.broadcast((weights, v))

        def learn(batches, shared=shared, rate=rate):
            start, v = shared.value
            own, w, memory, seen, waiting = None, {}, {}, 0, []

            def done():
                train_slice(w, memory, np.zeros(0, np.int64), np.zeros(1, np.int64), v, rate, waiting)
                tokens = -(-seen // TOKEN_UNIT)
                units = np.rint(np.concatenate([w[k].ravel() for k in w]).astype(float) * UNIT).astype("<i8")
                return pa.RecordBatch.from_arrays(
                    [pa.array([own], pa.int32()), pa.array([tokens]), pa.array([(units * tokens).tobytes()])],
                    names=["node", "weight", "sums"],
                )

            for shard, numbers, bounds in _of_shards(batches):
                if shard != own:
                    if own is not None:
                        yield done()
                    own, seen, waiting = shard, 0, []
                    w = {k: a.copy() for k, a in start.items()}
                    memory = {k: np.zeros_like(a) for k, a in w.items()}
                waiting = train_slice(w, memory, numbers, bounds, v, rate, waiting, False)
                seen += len(numbers) + len(bounds) - 1
            if own is not None:
                yield done()

        dealt = coded.where(F.col("shard") < share).repartitionById(share, "shard")
        ordered = dealt.sortWithinPartitions("shard", "key", "codes").select("shard", "codes")
        added = _added(ordered.mapInArrow(learn, "node int, weight long, sums binary"))
        if added is None:
            continue
        joined = (added[0] / (added[1] * UNIT)).astype(np.float32)
        at = 0
        for k, shape in shapes.items():
            size = int(np.prod(shape))
            weights[k] = joined[at : at + size].reshape(shape)
            at += size
    return weights


def learn_vocabulary(counts: DataFrame, documents: int) -> Vocabulary:
    """Totals of the corpus and its most frequent words, in order of frequency, then of the word."""
    total = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v")).first()
    # Counts fall into fixed ranges; the ranges from the top that hold NUMBERED words at most
    # are numbered, so that many words and no more reach the driver.
    short = counts.where(F.octet_length("word") <= LONGEST)
    short = short.withColumn("_range", F.floor(F.log2("c") * 64).cast("int"))
    held = 0
    lowest = 1 << 30
    for r in short.groupBy("_range").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("_range")).collect():
        held += r["n"]
        if held > NUMBERED:
            break
        lowest = r["_range"]
    table = short.where(F.col("_range") >= lowest).select("word", "c").toArrow()
    top = table.sort_by([("c", "descending"), ("word", "ascending")])
    return Vocabulary(
        top["word"].combine_chunks().cast(pa.string()), top["c"].to_numpy().astype(np.int64), int(total["n"]) + documents,
        int(total["v"]) + (documents > 0), documents,
    )


def score_texts(
    docs: DataFrame, learning: DataFrame, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Id, token counts, ``base_score`` and ``score`` of every row of ``docs``.

    ``learning`` gives the training texts. Tokens are words between ASCII blanks, A-Z lowered,
    and one end for each text; a null text counts as empty. ``score`` is the model's log10
    probability of the whole text. Without training texts all words are unknown.
    """
    spark = docs.sparkSession
    counts = materialize(word_counts(learning, text_col), "counts")
    v = learn_vocabulary(counts, learning.count())
    weights = train(learning, v, text_col, id_col=id_col)
    shared = spark.sparkContext.broadcast((weights, v.state))

    def score(batches):
        w, state = shared.value
        v = Vocabulary(*state)
        known, n_known = v.words, len(v.words)
        base = np.r_[v.base_log, 0.0]  # words without a number are added up by the join
        for whole in batches:
            _, offsets = flat(whole.column(1))
            for a, b in slices(offsets, SLICE):
                batch = whole.slice(a, b - a)
                words, bounds = word_lists(batch.column(1))
                numbers = _numbered(words, known)
                row = np.repeat(np.arange(b - a, dtype=np.int32), np.diff(bounds))
                rest = numbers > n_known
                head = np.bincount(row, weights=base[numbers], minlength=b - a) + base[n_known]
                rests = np.bincount(row[rest], minlength=b - a)
                left = words.filter(pa.array(rest))
                del words, row, rest
                pa.default_memory_pool().release_unused()
                likely = log_likelihoods(w, numbers, bounds, v) / np.log(10)
                unknown = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(rests)].astype(np.int32)), left)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(np.diff(bounds) + 1), pa.array(np.diff(bounds) - rests),
                     pa.array(head), pa.array(likely), unknown],
                    names=["_id", "n_tokens", "n_head", "head", "likely", "rest"],
                )

    kind = docs.schema[id_col].dataType.simpleString()
    narrow = docs.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`").alias("_text"))
    scored = narrow.mapInArrow(
        score, f"_id {kind}, n_tokens long, n_head long, head double, likely double, rest array<string>"
    )
    scored = materialize(scored.withColumn("_row", F.monotonically_increasing_id()), "scored")
    single = scored.select("_row", F.explode("rest").alias("_word"))
    summed = (
        single.join(counts, F.col("_word") == F.col("word"), "left")
        .groupBy(F.col("_row").alias("_r"))
        .agg(
            F.count(F.lit(1)).alias("n_rest"),
            F.count("c").alias("n_rest_known"),
            F.sum(F.log10(F.coalesce("c", F.lit(0)) + F.lit(0.1))).alias("logs"),
        )
    )
    none = F.lit(0.0)
    whole = float(np.log10(v.tokens + 0.1 * (v.distinct + 1)))
    share = float(np.log10(v.rest_tokens + 0.1 * (v.rest_distinct + 1)))
    logs, n_rest = F.coalesce("logs", none), F.coalesce("n_rest", F.lit(0))
    end_known = 1 if v.ends else 0
    return scored.drop("rest").join(summed, F.col("_row") == F.col("_r"), "left").select(
        F.col("_id").alias(id_col),
        "n_tokens",
        (F.col("n_head") + F.coalesce("n_rest_known", F.lit(0)) + end_known).cast("long").alias("n_known"),
        F.lit(v.tokens).cast("long").alias("train_tokens"),
        (F.col("head") + logs - n_rest * whole).alias("base_score"),
        (F.col("likely") + logs - n_rest * share).alias("score"),
    )
