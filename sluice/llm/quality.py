"""Quality rules: a decision list learned from labelled text statistics.

Statistics of whole texts are counted in numpy. Sequential covering grows one conjunction of
thresholds at a time on two thirds of a bounded labelled sample, prunes it on the rest, keeps
it if it is precise there, removes what it covers, and goes on. The list comes out as an
ordered Spark conditional expression, so scoring is plain Spark SQL.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.llm.bytewords import Hasher, flat, mixed, not_blank, slices, windows, word_spans

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
EXTRA = ["n_lines", "n_upper", "n_digits", "n_marks", "n_letters"]
#: Ratios that the list may test, as Spark expressions over the counts.
FEATURES = {
    "n_words": "cast(n_words as double)",
    "chars_per_word": "word_chars / greatest(n_words, 1)",
    "symbols_per_word": "n_symbols / greatest(n_words, 1)",
    "dup_line_share": "n_dup_lines / greatest(n_lines, 1)",
    "repeat_share": "n_repeat_words / greatest(n_words, 1)",
    "words_per_line": "n_words / greatest(n_lines, 1)",
    "upper_share": "n_upper / greatest(word_chars, 1)",
    "digit_share": "n_digits / greatest(word_chars, 1)",
    "mark_share": "n_marks / greatest(word_chars, 1)",
    "letter_share": "n_letters / greatest(word_chars, 1)",
}
#: A text is too short, or too repetitive.
BASE = "n_words < 50 or 100 * n_repeat_words > 50 * n_words"
#: Most labelled rows that a list is fitted on.
SAMPLE_ROWS = 20_000
_SCHEMA = ", ".join(f"{c} long" for c in COUNTS + EXTRA)


def _byte_set(text: str) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(text.encode())] = True
    return table


def _repeats(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each key: does it occur twice or more; is it not the first of its kind."""
    order = np.argsort(keys, kind="stable")
    same = keys[order[1:]] == keys[order[:-1]]
    twice, later = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    later[order[1:][same]] = True
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    return twice, later


def count_statistics(column: pa.Array) -> dict[str, np.ndarray]:
    """The counts of every text of an Arrow string column; a null text counts as empty."""
    hasher, blank_free = Hasher(), not_blank()
    not_newline = np.ones(256, bool)
    not_newline[10] = False
    lead = np.ones(256, bool)
    lead[0x80:0xC0] = False
    tables = {
        "word_chars": blank_free & lead,
        "n_symbols": _byte_set("#*$%&|<>"),
        "n_upper": _byte_set("ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
        "n_digits": _byte_set("0123456789"),
        "n_marks": _byte_set("!?.,;:'\"()-"),
    }
    letters = _byte_set("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")
    letters[0xC0:] = True
    tables["n_letters"] = letters
    data, offsets = flat(column)
    out = {c: np.zeros(len(offsets) - 1, np.int64) for c in COUNTS + EXTRA}
    for first, last in slices(offsets):
        part = data[offsets[first] : offsets[last]]
        off = offsets[first : last + 1] - offsets[first]
        rows = slice(first, last)
        for name, table in tables.items():
            sums = np.zeros(len(part) + 1, np.int64)
            np.cumsum(table[part], out=sums[1:])
            out[name][rows] = sums[off[1:]] - sums[off[:-1]]
        starts, ends, word_at = word_spans(part, off, blank_free)
        out["n_words"][rows] = np.diff(word_at)
        row_of_word = np.repeat(np.arange(last - first), np.diff(word_at))
        salt = mixed(np.arange(last - first, dtype=np.uint64) + np.uint64(1))
        if len(starts) >= 3:
            triples = windows(hasher.words(part, starts, ends), 3)
            inside = np.flatnonzero(row_of_word[2:] == row_of_word[:-2])
            twice, _ = _repeats(triples[inside] ^ salt[row_of_word[inside]])
            covered = np.zeros(len(starts), bool)
            for k in range(3):
                covered[inside[twice] + k] = True
            out["n_repeat_words"][rows] = np.bincount(row_of_word[covered], minlength=last - first)
        line_start, line_end, _ = word_spans(part, off, not_newline)
        full = np.searchsorted(starts, line_end) > np.searchsorted(starts, line_start)
        line_start, line_end = line_start[full], line_end[full]
        row_of_line = np.searchsorted(off, line_start, "right") - 1
        lines = hasher.words(part, line_start, line_end) ^ salt[row_of_line]
        _, later = _repeats(lines)
        out["n_lines"][rows] = np.bincount(row_of_line, minlength=last - first)
        out["n_dup_lines"][rows] = np.bincount(row_of_line[later], minlength=last - first)
    return out


def text_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Id and counts of every row. Null and empty texts have counts of 0; rows stay apart."""

    def measure(batches):
        for batch in batches:
            counts = count_statistics(batch.column(1))
            arrays = [batch.column(0), *(pa.array(counts[c]) for c in COUNTS + EXTRA)]
            yield pa.RecordBatch.from_arrays(arrays, names=["_id", *COUNTS, *EXTRA])

    kind = docs.schema[id_col].dataType.simpleString()
    narrow = docs.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`").alias("_text"))
    measured = narrow.mapInArrow(measure, f"_id {kind}, {_SCHEMA}")
    return measured.withColumnRenamed("_id", id_col)


Term = tuple[str, str, float]


def _holds(values: np.ndarray, op: str, bound: float) -> np.ndarray:
    return values >= bound if op == ">=" else values <= bound


def _best_term(x: dict[str, np.ndarray], cover: np.ndarray, bad: np.ndarray) -> Term | None:
    """The threshold with the largest information gain among the rows covered so far."""
    p0, n0 = np.sum(cover & bad), np.sum(cover & ~bad)
    prior, best, found = np.log2(p0 / (p0 + n0)), 1e-9, None
    for name, values in x.items():
        hit, miss = np.sort(values[cover & bad]), np.sort(values[cover & ~bad])
        bounds = np.unique(np.quantile(hit, np.linspace(0, 1, 65), method="nearest"))
        for op in (">=", "<="):
            side = "left" if op == ">=" else "right"
            p, n = np.searchsorted(hit, bounds, side), np.searchsorted(miss, bounds, side)
            if op == ">=":
                p, n = len(hit) - p, len(miss) - n
            gain = p * (np.log2(np.maximum(p, 1e-9) / (p + n)) - prior)
            k = int(np.argmax(gain))
            if gain[k] > best:
                # half way to the nearest row on the other side of the bound
                beyond = values[cover & ~_holds(values, op, bounds[k])]
                near = bounds[k] if not len(beyond) else beyond.max() if op == ">=" else beyond.min()
                best, found = gain[k], (name, op, float((bounds[k] + near) / 2))
    return found


def _covers(x: dict[str, np.ndarray], rule: list[Term], within: np.ndarray) -> np.ndarray:
    cover = within.copy()
    for name, op, bound in rule:
        cover &= _holds(x[name], op, bound)
    return cover


def learn_list(
    x: dict[str, np.ndarray],
    bad: np.ndarray,
    max_rules: int = 16,
    max_terms: int = 4,
    min_precision: float = 0.97,
    min_cover: int = 4,
) -> list[list[Term]]:
    """Ordered conjunctions that single out bad rows; empty if none is precise enough.

    A conjunction that is not precise on all rows and on those held back is given up, and so are
    the bad rows that it was grown for; the search goes on with the others.
    """
    grow = np.arange(len(bad)) % 3 != 0
    left, rules, given_up = np.ones(len(bad), bool), [], np.zeros(len(bad), bool)
    while len(rules) < max_rules:
        rule, cover = [], left & grow & ~given_up
        if np.sum(cover & bad) < min_cover:
            break
        while len(rule) < max_terms and (cover & ~bad).any():
            term = _best_term(x, cover, bad)
            if term is None:
                break
            rule.append(term)
            cover = _covers(x, rule, left & grow & ~given_up)

        def worth(terms: list[Term]) -> float:
            cover = _covers(x, terms, left & ~grow)
            p, n = np.sum(cover & bad), np.sum(cover & ~bad)
            return (p - n) / (p + n) if p + n else -1.0

        while len(rule) > 1 and worth(rule[:-1]) >= worth(rule):
            rule = rule[:-1]
        if not rule:
            break
        cover = _covers(x, rule, left)
        p, n = np.sum(cover & bad), np.sum(cover & ~bad)
        held = _covers(x, rule, left & ~grow)
        hp, hn = np.sum(held & bad), np.sum(held & ~bad)
        if p < min_cover or p < min_precision * (p + n) or hp < min_precision * (hp + hn):
            grown_for = _covers(x, rule, left & grow & ~given_up) & bad
            if not grown_for.any():
                break
            given_up |= grown_for
            continue
        rules.append(rule)
        left &= ~cover
    return rules


def rule_expression(rules: list[list[Term]]) -> Column:
    """Number of the first rule that holds, from 1, or 0: an ordered CASE expression."""
    case = None
    for number, rule in enumerate(rules, 1):
        test = " AND ".join(f"{FEATURES[n]} {op} {bound!r}D" for n, op, bound in rule)
        case = (F if case is None else case).when(F.expr(test), number)
    return F.lit(0) if case is None else case.otherwise(0)


def learn_rules(
    statistics: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    label_col: str = "quality",
    sample_rows: int = SAMPLE_ROWS,
    passing: str = f"not ({BASE})",
    **options,
) -> list[list[Term]]:
    """A decision list for label 0 against label 1, from at most ``sample_rows`` labelled rows.

    The sample is the labelled rows with the smallest hashes of the id; of these the list learns
    from the ones that are ``passing`` the base conditions, the only ones it decides on. Rows
    without id or label are left out; without labels of both kinds the list is empty, and
    then every row that passes the base is kept.
    """
    known = labels.select(
        F.col(f"`{id_col}`").alias("_id"), F.col(f"`{label_col}`").cast("int").alias("_label")
    ).where("_id is not null and _label is not null")
    known = known.orderBy(F.xxhash64("_id"), "_id", "_label").limit(sample_rows)
    joined = statistics.withColumnRenamed(id_col, "_id").where(passing).join(known, "_id")
    table = joined.select("_id", "_label", *[F.expr(e).alias(n) for n, e in FEATURES.items()])
    table = table.toPandas().sort_values(["_id", "_label"], ignore_index=True)
    bad = (table["_label"] == 0).to_numpy()
    if not bad.any() or bad.all():
        return []
    return learn_list({n: table[n].to_numpy(float) for n in FEATURES}, bad, **options)


def quality_verdicts(statistics: DataFrame, rules: list[list[Term]], base: str = BASE) -> DataFrame:
    """Adds ``base_failed`` (too short or too repetitive), ``rule`` and ``kept``."""
    judged = statistics.withColumn("base_failed", F.expr(base))
    judged = judged.withColumn("rule", rule_expression(rules))
    return judged.withColumn("kept", ~F.col("base_failed") & (F.col("rule") == 0))
