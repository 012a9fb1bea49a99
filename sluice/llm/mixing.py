"""Mixing to target weights: iterative proportional fitting, then calibrated sampling.

Tokens are summed over the cells of source, language and topic that occur. Raking scales the
cells until the marginals meet their targets; a row's calibrated weight is the product of the
factors of its three classes. A row's expected copies are in proportion to the weight, so that
the expected tokens meet the total and the targets alike: the whole part is given to every
row, the rest is drawn by a hash of the id.

Every class has its target and its factor, however many there are. Up to ``CELLS`` cells are
raked as arrays, more of them as Spark tables with one sum for each step; both take the same
steps. If the targets contradict each other, no factors can meet them all: then ``mix`` says
so, in a column or by an error.
"""

from __future__ import annotations

from collections.abc import Mapping

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.operators.skew import lookup
from sluice.session import materialize

OTHER = "(other)"
#: Cells that are raked as arrays; factors of as many classes are broadcast.
CELLS = 1 << 20
#: Raking steps, the misfit at which it ends, and the largest misfit that is taken.
ROUNDS, CLOSE, MISFIT = 500, 1e-9, 1e-3
#: Steps without a smaller misfit after which the targets are taken to contradict each other.
PATIENCE = 20

#: Topics by what a text contains, tried in this order.
TOPICS = {
    "legal": ("License", "license", "Copyright", "copyright", "rights reserved"),
    "contact": ("@", "http://", "https://"),
    "symbols": ("###", "$$$", "%%%", "***", "&&&"),
    "tables": (" | ",),
    "shouting": ("!!",),
}

#: Scripts written without blanks between words; their letters count one by one, with their marks.
_UNSPACED = "".join(rf"\p{{Is{s}}}" for s in "Han Hiragana Katakana Thai Lao Khmer Myanmar Tibetan".split())
_TOKEN = rf"[{_UNSPACED}&&\p{{L}}]\p{{M}}*+|[^\s\x85\p{{Z}}{_UNSPACED}]++|[{_UNSPACED}&&[^\p{{L}}]]++"
#: Where the letters of these scripts begin; texts below are counted by a cheaper pattern.
_BEYOND = r"\u0E00-\u1FFF\u2E80-\x{10FFFF}"


def topic_of(text: Column) -> Column:
    """A coarse topic from the form of the text: the first that matches, else ``prose``."""
    topic = None
    for name, marks in TOPICS.items():
        test = F.lit(False)
        for mark in marks:
            test = test | F.contains(text, F.lit(mark))
        topic = (F if topic is None else topic).when(test, name)
    return topic.otherwise("prose")


def tokens_of(text: Column) -> Column:
    """Token weight of a text: its words between blanks of any kind, and each letter of an unspaced script."""
    mixed = F.regexp_count(text, F.lit(_TOKEN))
    # without such letters, each word is replaced by its first character, and blanks by nothing
    spaced = F.length(F.regexp_replace(text, r"[\s\x85\p{Z}]*+([^\s\x85\p{Z}])[^\s\x85\p{Z}]*+|[\s\x85\p{Z}]++", "$1"))
    counted = F.when(text.rlike(f"[{_BEYOND}]"), mixed).otherwise(spaced)
    return F.coalesce(counted, F.lit(0)).cast("long")


def _class(column: str) -> Column:
    return F.coalesce(F.col(f"`{column}`").cast("string"), F.lit(OTHER))


def tempered_targets(docs: DataFrame, dimensions: list[str], tokens: str, power: float = 0.7) -> DataFrame:
    """``dimension``, ``class``, ``target``: shares in proportion to a power of the token shares.

    Every class with tokens has a row; null classes have none. Each dimension sums to 1.
    """
    out = None
    for dimension in dimensions:
        sums = docs.groupBy(_class(dimension).alias("class")).agg(F.sum(tokens).alias("n"))
        sums = sums.where((F.col("n") > 0) & (F.col("class") != OTHER))
        weight = F.pow(F.col("n").cast("double"), F.lit(power))
        rows = sums.select(F.lit(dimension).alias("dimension"), "class", weight.alias("weight"))
        out = rows if out is None else out.union(rows)
    out = materialize(out, "weights")
    totals = out.groupBy(F.col("dimension").alias("_d")).agg(F.sum("weight").alias("_total"))
    joined = out.join(F.broadcast(totals), F.col("dimension") == F.col("_d"))  # one row per dimension
    return joined.select("dimension", "class", (F.col("weight") / F.col("_total")).alias("target"))


class Misfit(ValueError):
    """The targets of the dimensions contradict each other, and the caller wants to know."""


def _stuck(gaps: list[float]) -> bool:
    """Whether the last ``PATIENCE`` steps have not made the misfit smaller by a hundredth."""
    return len(gaps) > PATIENCE and gaps[-1] > 0.99 * min(gaps[:-PATIENCE])


def wanted_shares(own: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Shares to rake to: free classes (negative target) keep theirs, the others fill the rest.

    Classes without tokens take no part; their target goes to the others in proportion.
    """
    free = target < 0
    share = np.where(free, own, np.where(own > 0, target, 0.0))
    fixed = share[~free].sum()
    if fixed > 0:
        share[~free] *= (1 - share[free].sum()) / fixed
    return share / share.sum()


def rake(
    tokens: np.ndarray, places: list[np.ndarray], targets: list[np.ndarray], rounds: int = ROUNDS, close: float = CLOSE
) -> tuple[list[np.ndarray], float]:
    """Factors of each dimension's classes so that the scaled cells have the target shares, and the misfit.

    ``tokens`` has a value for each occurring cell, ``places`` its class in each dimension; a
    negative target keeps the share that the data give. The misfit is the largest difference
    of an achieved share to its target.
    """
    factors = [np.ones(len(t)) for t in targets]
    total = float(tokens.sum())
    if total <= 0:
        return factors, 0.0

    def shares(values, k):
        return np.bincount(places[k], values, len(targets[k]))

    scaled = tokens / total
    wanted = [wanted_shares(shares(scaled, k), t) for k, t in enumerate(targets)]
    gap, gaps = 0.0, []
    for _ in range(rounds):
        gap = max((float(np.abs(shares(scaled, k) - share).max()) for k, share in enumerate(wanted)), default=0.0)
        gaps.append(gap)
        if gap < close or _stuck(gaps):
            break
        for k, share in enumerate(wanted):
            own = shares(scaled, k)
            step = np.divide(share, own, out=np.ones_like(own), where=own > 0)
            factors[k] = factors[k] * step
            scaled = scaled * step[places[k]]
    return factors, gap


def _array_factors(cells: DataFrame, classes: list[DataFrame]) -> tuple[list[DataFrame], float, float, float]:
    """Factor tables by :func:`rake`; the cells, ``CELLS`` at most, pass through the driver."""
    spark = cells.sparkSession
    table = cells.toArrow()
    tokens = table["n"].to_numpy().astype(float)
    names, places, targets = [], [], []
    for k, known in enumerate(classes):
        own, place = np.unique(np.array(table[f"_c{k}"].to_pylist(), object), return_inverse=True)
        wanted = {r["class"]: r["target"] for r in known.toArrow().to_pylist()}
        names.append(own)
        places.append(place)
        targets.append(np.array([wanted[c] if wanted[c] is not None else -1.0 for c in own]))
    factors, gap = rake(tokens, places, targets)
    weight = np.ones(len(tokens))
    tables = []
    for own, place, factor in zip(names, places, factors, strict=True):
        weight = weight * factor[place]
        rows = [(str(c), float(f)) for c, f in zip(own, factor, strict=True)]
        tables.append(spark.createDataFrame(rows, "class string, factor double"))
    return tables, gap, float((tokens * weight).sum()), float(tokens.sum())


def _table_factors(cells: DataFrame, classes: list[DataFrame]) -> tuple[list[DataFrame], float, float, float]:
    """The same steps on tables: each is a sum by class and a join of the cells with its result."""
    total = float(cells.agg(F.sum("n")).first()[0] or 0)
    scaled = materialize(cells.withColumn("_s", F.col("n") / F.lit(total or 1.0)), "cells")
    wanted = []
    for k, known in enumerate(classes):
        own = scaled.groupBy(F.col(f"_c{k}").alias("class")).agg(F.sum("_s").alias("_own"))
        rows = materialize(own.join(known, "class"), "shares")
        free = F.col("target").isNull()
        sums = rows.agg(
            F.sum(F.when(free, F.col("_own"))), F.sum(F.when(~free & (F.col("_own") > 0), F.col("target")))
        ).first()
        rest, fixed = 1 - float(sums[0] or 0), float(sums[1] or 0)
        share = F.when(free, F.col("_own")).when(F.col("_own") > 0, F.col("target") * (rest / fixed if fixed else 0.0))
        wanted.append(materialize(rows.select("class", F.coalesce(share, F.lit(0.0)).alias("_share"), F.lit(1.0).alias("factor")), "wanted"))
    gap, gaps = 0.0, []
    for number in range(ROUNDS + 1):
        gap = 0.0
        for k, share in enumerate(wanted):
            own = scaled.groupBy(F.col(f"_c{k}").alias("_of")).agg(F.sum("_s").alias("_own"))
            apart = share.join(own, F.col("class") == F.col("_of")).agg(F.max(F.abs(F.col("_own") - F.col("_share")))).first()[0]
            gap = max(gap, float(apart or 0))
        gaps.append(gap)
        if gap < CLOSE or number == ROUNDS or not total or _stuck(gaps):
            break
        for k, share in enumerate(wanted):
            own = scaled.groupBy(F.col(f"_c{k}").alias("_of")).agg(F.sum("_s").alias("_own"))
            step = F.when(F.col("_own") > 0, F.col("_share") / F.col("_own")).otherwise(1.0)
            moved = materialize(share.join(own, F.col("class") == F.col("_of")).withColumn("_step", step), "steps")
            wanted[k] = moved.select("class", "_share", (F.col("factor") * F.col("_step")).alias("factor"))
            steps = moved.select(F.col("class").alias(f"_c{k}"), "_step")
            scaled = lookup(scaled, steps, [f"_c{k}"]).withColumn("_s", F.col("_s") * F.col("_step")).drop("_step")
            scaled = materialize(scaled, "cells")
    mass = float(scaled.agg(F.sum("_s")).first()[0] or 0) * total
    return [w.select("class", "factor") for w in wanted], gap, mass, total


def mix(
    docs: DataFrame,
    targets: DataFrame | Mapping[str, Mapping[str, float]],
    tokens: str,
    keep: float = 0.7,
    id_col: str = "doc_id",
    seed: int = 0,
    cells: DataFrame | None = None,
    new: tuple[str, str, str, str, str] = ("mix_weight", "probability", "sampled", "copies", "misfit"),
    dimensions: list[str] | None = None,
    strict: bool = False,
) -> DataFrame:
    """Adds ``mix_weight``, ``probability``, ``sampled``, ``copies`` and ``misfit`` to every row (or what ``new`` calls them).

    ``targets`` gives the wanted token shares of the classes of each dimension (a column), as
    rows ``dimension``, ``class``, ``target`` or as nested dicts; nulls and classes that are not
    named belong to ``other``, which keeps its share. ``dimensions`` may name columns for which
    there is no target yet. ``keep`` is the expected tokens of all copies as a share of all
    tokens. A row whose expected copies exceed 1 is sampled with probability 1 and repeated:
    capped there, its classes would miss their targets. Rows without tokens have the weight of
    their classes. The draw depends on the id and ``seed`` only, so rows that repeat an id
    are drawn alike; a null id is drawn like any other value. An empty table stays empty.
    Targets that cannot be met together are met as far as the last raking step went: the last
    dimension's exactly, the others not. ``misfit`` is the largest difference of an expected share
    to its target, the same on every row; above ``MISFIT``, ``strict`` raises :class:`Misfit`.
    ``cells`` may be a stored copy of the class and token columns, to be summed instead.
    """
    spark = docs.sparkSession
    if not isinstance(targets, DataFrame):
        dimensions = dimensions or list(targets)
        rows = [(d, c, float(t)) for d, named in targets.items() for c, t in named.items() if c != OTHER]
        targets = spark.createDataFrame(rows, "dimension string, class string, target double")
    elif dimensions is None:
        dimensions = sorted(r[0] for r in targets.select("dimension").distinct().collect())  # one row per dimension
    sums = (docs if cells is None else cells).groupBy(*[_class(d).alias(f"_c{k}") for k, d in enumerate(dimensions)])
    sums = materialize(sums.agg(F.sum(F.coalesce(F.col(tokens), F.lit(0))).cast("double").alias("n")), "cells")
    for k, d in enumerate(dimensions):  # what has no target belongs to the other class
        named = targets.where(F.col("dimension") == d).select(F.col("class").alias(f"_c{k}"), F.lit(True).alias("_named"))
        sums = sums.join(named, [f"_c{k}"], "left")
        sums = sums.withColumn(f"_c{k}", F.when(F.col("_named"), F.col(f"_c{k}")).otherwise(OTHER)).drop("_named")
    sums = materialize(sums.groupBy(*[f"_c{k}" for k in range(len(dimensions))]).agg(F.sum("n").alias("n")), "cells")
    classes = []
    for k, d in enumerate(dimensions):
        own = sums.select(F.col(f"_c{k}").alias("class")).distinct()
        named = targets.where(F.col("dimension") == d).select("class", "target")
        classes.append(own.join(named, ["class"], "left"))
    few = sums.count() <= CELLS
    factors, gap, mass, total = (_array_factors if few else _table_factors)(sums, classes)
    if strict and gap > MISFIT:
        raise Misfit(f"the targets cannot be met together: a share is off by {gap:.3g} after {ROUNDS} rounds")
    scale = keep * total / mass if mass > 0 else 0.0
    kept = [c for c in docs.columns if c not in new]
    rows, weight = docs.select(*[F.col(f"`{c}`") for c in kept]), F.lit(1.0)
    if few and dimensions:  # as many factors as cells at most
        rows = rows.select("*", F.struct(*[_class(d).alias(f"c{k}") for k, d in enumerate(dimensions)]).alias("__mix"))
        for k, table in enumerate(factors):
            table = table.select(F.col("class").alias(f"__mix_c{k}"), F.col("factor").alias(f"__mix_f{k}"))
            rows = rows.join(F.broadcast(table), F.col(f"__mix.c{k}") == F.col(f"__mix_c{k}"), "left")
    elif dimensions:
        for k, (d, table) in enumerate(zip(dimensions, factors, strict=True)):
            table = table.select(F.col("class").alias(f"__mix_c{k}"), F.col("factor").alias(f"__mix_f{k}"))
            rows = lookup(rows.withColumn(f"__mix_c{k}", _class(d)), table, [f"__mix_c{k}"], "left")
    for k, table in enumerate(factors):
        rest = table.where(F.col("class") == OTHER).first()
        weight = weight * F.coalesce(F.col(f"__mix_f{k}"), F.lit(float(rest["factor"]) if rest else 1.0))
    draw = F.pmod(F.xxhash64(F.col(f"`{id_col}`"), F.lit(seed)), F.lit(1 << 52)) / float(1 << 52)
    return (
        rows.withColumn(new[0], weight)
        .select(*[F.col(f"`{c}`") for c in kept], new[0])
        .withColumn(new[3], F.lit(float(scale)) * F.col(new[0]))
        .withColumn(new[1], F.least(F.lit(1.0), F.col(new[3])))
        .withColumn(new[2], draw < F.col(new[1]))
        .withColumn(new[3], F.floor(F.col(new[3])) + (draw < F.col(new[3]) - F.floor(F.col(new[3]))).cast("long"))
        .withColumn(new[4], F.lit(float(gap)))
    )
