"""Composition of dataset steps: chain, merge and branch.

``chain``   run steps in order
``merge``   give every member the same input; the next step sees all results
``branch``  run everything after it once per branch

A tree of steps is expanded on the driver into one lazy DataFrame. Steps written as SQL
expressions (``Where``, ``Derive``, ``Summarise``) are transparent: a tree made only of
them reads its input once, however many branches it has. Opaque ``Task`` bodies get one
plan per branch; ``run(..., share="table")`` then stores the prefix shared by branches.
"""

from __future__ import annotations

import copy
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass, field, replace
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sluice.functions import fingerprint as fp
from sluice.operators.skew import ordinal, scan_before
from sluice.session import materialize

SEP = "/"


@dataclass(frozen=True)
class Task:
    """A named dataset-to-dataset function with parameters."""

    name: str
    fn: Callable[..., DataFrame]
    params: Mapping[str, Any] = field(default_factory=dict)
    input: Any = None
    output: Any = None

    def __post_init__(self):
        if not isinstance(self.params, Mapping):
            raise TypeError("params must be a mapping")
        if not callable(self.fn):
            raise TypeError("a task needs a function from DataFrame to DataFrame")

    @property
    def uid(self) -> str:
        return fp.definition_uid(self.input, self.output, dict(self.params) or None, self.name)

    def __call__(self, df: DataFrame) -> DataFrame:
        return self.fn(df, **copy.deepcopy(dict(self.params)))


@dataclass(frozen=True)
class Where:
    """Keep the rows for which a SQL condition holds."""

    name: str
    condition: str
    params: Mapping[str, Any] = field(default_factory=dict)

    @property
    def uid(self) -> str:
        return fp.definition_uid(self.condition, None, dict(self.params) or None, self.name)

    def __call__(self, df: DataFrame) -> DataFrame:
        return df.where(self.condition)


@dataclass(frozen=True)
class Derive:
    """Add columns given as SQL expressions."""

    name: str
    columns: Mapping[str, str]
    params: Mapping[str, Any] = field(default_factory=dict)

    @property
    def uid(self) -> str:
        return fp.definition_uid(None, dict(self.columns), dict(self.params) or None, self.name)

    def __call__(self, df: DataFrame) -> DataFrame:
        return df.withColumns({name: F.expr(sql) for name, sql in self.columns.items()})


@dataclass(frozen=True)
class Summarise:
    """Group by columns and aggregate with SQL expressions."""

    name: str
    by: Sequence[str]
    columns: Mapping[str, str]
    params: Mapping[str, Any] = field(default_factory=dict)

    @property
    def uid(self) -> str:
        return fp.definition_uid(list(self.by), dict(self.columns), dict(self.params) or None, self.name)

    def __call__(self, df: DataFrame, also: Sequence[str] = ()) -> DataFrame:
        aggregates = [F.expr(sql).alias(name) for name, sql in self.columns.items()]
        return df.groupBy(*also, *self.by).agg(*aggregates)


@dataclass(frozen=True)
class Chain:
    steps: tuple

    @property
    def uid(self) -> str:
        return fp.members_uid(s.uid for s in self.steps)

    def then(self, *steps) -> Chain:
        return chain(self, *steps)


@dataclass(frozen=True)
class Merge:
    members: Mapping[str, Any]
    key: tuple[str, ...] = ()
    how: str = "outer"

    @property
    def uid(self) -> str:
        return fp.members_uid(m.uid for m in self.members.values())

    def on(self, *key: str, how: str = "outer") -> Merge:
        """Join the members on ``key``; each member's other columns get its name as prefix.

        A key that one member lacks has nulls there; ``how`` may name another kind of join.
        """
        return replace(self, key=key, how=how)


@dataclass(frozen=True)
class Branch:
    branches: Mapping[str, Any]

    @property
    def uid(self) -> str:
        return fp.members_uid(b.uid for b in self.branches.values())


ROW_STEPS = (Where, Derive)
STEPS = (Task, Where, Derive, Summarise)


def _named(given: Sequence, named: Mapping[str, Any]) -> dict[str, Any]:
    out = {getattr(node, "name", f"b{i}"): node for i, node in enumerate(given)}
    if len(out) != len(given) or set(out) & set(named):
        raise ValueError("members need distinct names")
    return {**out, **named}


def chain(*steps) -> Chain:
    """Run ``steps`` in order; nested chains flatten to the same order."""
    flat: list = []
    for step in steps:
        flat.extend(step.steps if isinstance(step, Chain) else [step])
    return Chain(tuple(flat))


def merge(*members, **named) -> Merge:
    """Give all members the same input and pass all their results on."""
    return Merge(_named(members, named))


def branch(*branches, **named) -> Branch:
    """Run each branch, and whatever follows, separately."""
    return Branch(_named(branches, named))


# shape of a tree


def leaves(node) -> list[list[str]]:
    """Step names along every leaf of the tree, in declaration order."""
    if isinstance(node, STEPS):
        return [[node.name]]
    if isinstance(node, Merge):
        inside = ["-".join(path) for m in node.members.values() for path in leaves(m)]
        return [["(" + "+".join(inside) + ")"]]
    if isinstance(node, Branch):
        return [path for b in node.branches.values() for path in leaves(b)]
    paths: list[list[str]] = [[]]
    for step in node.steps:
        paths = [path + more for path in paths for more in leaves(step)]
    return paths


# one pass over transparent trees


@dataclass(frozen=True)
class _RowLeaf:
    path: tuple[str, ...]
    conditions: tuple[str, ...] = ()
    columns: Mapping[str, str] = field(default_factory=dict)


def _row_leaves(node) -> list[_RowLeaf] | None:
    """Leaves of a branch as (path, condition, columns), or None if it is not row-level.

    Conditions and columns must read the input of the branch only, so nothing may follow
    a ``Derive`` inside a branch.
    """
    if isinstance(node, Where):
        return [_RowLeaf((), (node.condition,))]
    if isinstance(node, Derive):
        return [_RowLeaf((), (), dict(node.columns))]
    if isinstance(node, Branch):
        out = []
        for name, sub in node.branches.items():
            inner = _row_leaves(sub)
            if inner is None:
                return None
            out += [replace(leaf, path=(name, *leaf.path)) for leaf in inner]
        return out
    if isinstance(node, Chain):
        acc = [_RowLeaf(())]
        for step in node.steps:
            inner = _row_leaves(step)
            if inner is None or any(leaf.columns for leaf in acc):
                return None
            acc = [
                _RowLeaf(a.path + b.path, a.conditions + b.conditions, b.columns)
                for a in acc
                for b in inner
            ]
        return acc
    return None


def _single_pass(node) -> list | None:
    """The steps of a transparent tree, branches as lists of row leaves; else None."""
    plan: list = []
    for step in node.steps if isinstance(node, Chain) else [node]:
        if isinstance(step, Branch):
            rows = _row_leaves(step)
            if rows is None or len({frozenset(r.columns) for r in rows}) != 1:
                return None
            plan.append(rows)
        elif isinstance(step, (Where, Derive, Summarise)):
            plan.append(step)
        else:
            return None
    return plan


def _split_rows(df: DataFrame, rows: list[_RowLeaf], tag: str | None, out: str) -> DataFrame:
    """Send each row to every branch whose condition it meets, reading ``df`` once.

    If every branch has a condition, a row that meets none of them is filtered out first, which
    may reach the scan.
    """
    if all(leaf.conditions for leaf in rows):
        each = [" and ".join(f"({c})" for c in leaf.conditions) for leaf in rows]
        df = df.where(" or ".join(f"({c})" for c in dict.fromkeys(each)))

    def taken(leaf: _RowLeaf) -> Column:
        name = F.lit(SEP.join(leaf.path))
        columns = [F.expr(sql).alias(c) for c, sql in leaf.columns.items()]
        packed = F.struct(name.alias("_name"), *columns)
        if not leaf.conditions:
            return packed
        return F.when(F.expr(" and ".join(f"({c})" for c in leaf.conditions)), packed)

    names = list(rows[0].columns)
    kept = [c for c in df.columns if c not in names and c != tag]
    went = F.inline(F.array(*map(taken, rows)))
    wide = df.select(*kept, *([F.col(tag).alias("_tag")] if tag else []), went)
    wide = wide.where("_name is not null")
    label = F.concat_ws(SEP, "_tag", "_name") if tag else F.col("_name")
    return wide.select(label.alias(out), *kept, *names)


def _run_single_pass(plan: list, df: DataFrame, out: str, key: Sequence[str] = ()) -> DataFrame:
    """``key`` columns stay apart in every summary."""
    tag = None
    for step in plan:
        if isinstance(step, list):
            df, tag = _split_rows(df, step, tag, out), out
        elif isinstance(step, Summarise):
            df = step(df, also=[*key, *([tag] if tag else [])])
        else:
            df = step(df)
    return df


def run_per_file(node, df: DataFrame, key: str, out: str = "branch") -> DataFrame:
    """Run a tree once per value of ``key`` (such as a file), results kept apart, in one pass.

    The tree consists of transparent steps; ``key`` is a column of the result.
    """
    plan = _single_pass(node)
    if plan is None:
        raise TypeError("only steps written as expressions can run per file")
    return _run_single_pass(plan, df, out, [key])


# one plan per leaf


@dataclass(frozen=True)
class Leaf:
    """A dataset, the branches taken to reach it and the runs it went through."""

    df: DataFrame
    path: tuple[str, ...] = ()
    lineage: tuple[str, ...] = ()


def _after(lineage: tuple[str, ...], step) -> tuple[str, ...]:
    run = fp.run_uid(step.uid, lineage)
    params = (fp.canonical(dict(step.params)),) if step.params else ()
    return (*lineage, *params, run)


def _lineages(node, path: tuple[str, ...] = (), lineage: tuple[str, ...] = ()) -> list[tuple]:
    """Path and lineage of every leaf of a tree without merges."""
    if isinstance(node, STEPS):
        return [(path, _after(lineage, node))]
    if isinstance(node, Branch):
        return [
            found for name, sub in node.branches.items() for found in _lineages(sub, (*path, name), lineage)
        ]
    reached = [(path, lineage)]
    for step in node.steps:
        reached = [new for old in reached for new in _lineages(step, *old)]
    return reached


def _expand(node, leaf: Leaf, share: str) -> Iterator[Leaf]:
    if isinstance(node, STEPS):
        yield replace(leaf, df=node(leaf.df), lineage=_after(leaf.lineage, node))
    elif isinstance(node, Chain):
        reached = [leaf]
        for step in node.steps:
            reached = [new for old in reached for new in _expand(step, old, share)]
        yield from reached
    elif isinstance(node, Branch):
        if share == "table":
            leaf = replace(leaf, df=materialize(leaf.df, "prefix"))
        for name, sub in node.branches.items():
            yield from _expand(sub, replace(leaf, path=(*leaf.path, name)), share)
    elif isinstance(node, Merge):
        results = {
            name: list(_expand(m, replace(leaf, path=()), share))
            for name, m in node.members.items()
        }
        uid = fp.members_uid(r.lineage[-1] for rs in results.values() for r in rs)
        joined = _joined(results, node.key, node.how) if node.key else _stacked(results)
        yield replace(leaf, df=joined, lineage=(*leaf.lineage, uid))
    else:
        raise TypeError(f"not a step: {node!r}")


def _stacked(results: Mapping[str, list[Leaf]]) -> DataFrame:
    parts = [
        r.df.withColumn("member", F.lit(SEP.join((name, *r.path))))
        for name, rs in results.items()
        for r in rs
    ]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def _joined(results: Mapping[str, list[Leaf]], key: Sequence[str], how: str) -> DataFrame:
    parts = []
    for name, rs in results.items():
        for r in rs:
            label = "_".join((name, *r.path))
            others = [F.col(c).alias(f"{label}_{c}") for c in r.df.columns if c not in key]
            parts.append(r.df.select(*key, *others))
    return reduce(lambda a, b: a.join(b, list(key), how), parts)


def expand(node, df: DataFrame, share: str = "plan") -> list[Leaf]:
    """The results of a tree, one ``Leaf`` per leaf, kept apart."""
    return list(_expand(node, Leaf(df), share))


def run(
    node,
    df: DataFrame,
    out: str = "branch",
    share: str = "plan",
    lineage: bool = False,
) -> DataFrame:
    """Run a tree over ``df`` as one DataFrame.

    With branches the result has a column ``out`` naming the leaf, ``lineage`` adds the
    uids of the runs behind each row. ``share="table"`` stores the data in front of every
    branch of opaque tasks, so that it is computed once.
    """
    if share not in ("plan", "table"):
        raise ValueError("share is 'plan' or 'table'")
    plan = _single_pass(node)
    if plan is not None:
        done = _run_single_pass(plan, df, out)
        if not lineage:
            return done
        runs = [(SEP.join(path), F.array(*map(F.lit, uids))) for path, uids in _lineages(node)]
        if runs[0][0] == "":
            return done.withColumn("lineage", runs[0][1])
        which = None
        for label, uids in runs:
            which = (F if which is None else which).when(F.col(out) == label, uids)
        return done.withColumn("lineage", which)
    parts = []
    for leaf in expand(node, df, share):
        part = leaf.df
        if leaf.path:
            part = part.withColumn(out, F.lit(SEP.join(leaf.path)))
        if lineage:
            part = part.withColumn("lineage", F.array(*map(F.lit, leaf.lineage)))
        parts.append(part)
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


# parameter sweeps and comparison


def sweep(df: DataFrame, step: Callable[..., DataFrame], params: Sequence[Mapping], **kw):
    """Run one opaque step for several parameter values, one branch per value."""
    tasks = {f"p{i}": Task(f"p{i}", step, p) for i, p in enumerate(params)}
    return run(branch(**tasks), df, out="param_id", **kw)


def sweep_where(
    df: DataFrame, condition: str, params: Sequence[Mapping[str, Any]], out: str = "param_id"
) -> DataFrame:
    """Rows of ``df`` per parameter value for which ``condition`` holds, in one pass.

    ``condition`` names the parameters as ``{name}``.
    """
    values = {f"p{i}": Where(f"p{i}", condition.format(**p)) for i, p in enumerate(params)}
    return run(branch(**values), df, out=out)


def sweep_above(
    df: DataFrame,
    params: DataFrame,
    column: str,
    measures: Mapping[str, str],
    group: Sequence[str] = (),
    param: str = "param_id",
    threshold: str = "threshold",
) -> DataFrame:
    """Sums over the rows of ``df`` whose ``column`` is above each threshold of a table.

    ``params`` has one row per parameter value, as many as one likes: the plan stays the same
    and no row meets a parameter. Rows are summed by group and value first; sorted together
    with the thresholds, every value learns the highest one below it; sums of these intervals
    are added up downwards. ``measures`` are expressions that are summed. Parameters without a
    row above, null thresholds and null values give nothing. A window runs over the different
    thresholds of a group, never over rows of ``df``.
    """
    group = list(group)
    sums = [F.sum(F.expr(value)).alias(name) for name, value in measures.items()]
    points = df.where(F.col(column).isNotNull()).groupBy(*group, F.col(column).alias("_at")).agg(*sums)
    wanted = params.where(F.col(threshold).isNotNull())
    levels = materialize(ordinal(wanted.select(F.col(threshold).alias("_level")).distinct(), ["_level"], "_rank"), "levels")
    marks = levels.select(F.col("_level").alias("_at"), "_rank", F.lit(1).alias("_mark"))
    # at the same value a point comes before the mark, so it is not above it
    both = points.withColumn("_mark", F.lit(0)).unionByName(marks, allowMissingColumns=True)
    ordered = both.withColumn("_order", F.struct("_at", "_mark", *group))
    seen = scan_before(ordered, [], "_order", F.col("_rank"), "_top", how="last")
    inside = seen.where("_mark = 0 and _top is not null").groupBy(*group, "_top").agg(*[F.sum(m).alias(m) for m in measures])
    rising = Window.partitionBy(*group, F.lit(0)).orderBy("_top")
    upwards = rising.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    first = F.coalesce(F.lag("_top").over(rising) + 1, F.lit(0))
    above = inside.select(
        *group, "_top", first.alias("_first"), *[F.sum(m).over(upwards).alias(m) for m in measures]
    ).select(*group, *measures, F.explode(F.sequence("_first", "_top")).alias("_rank"))
    named = wanted.join(levels, F.col(threshold) == F.col("_level")).select(F.col(param), F.col(threshold), "_rank")
    return above.join(named, "_rank").select(param, threshold, *group, *measures)


def compare(
    branched: DataFrame, key: Sequence[str], value: str, names: Sequence[str], out: str = "branch"
) -> DataFrame:
    """Values of each branch side by side per key, and whether all of them agree.

    A key missing from a branch has null there; null agrees with null only. Two rows of one
    branch for the same key cannot be compared and are an error.
    """

    def side(name: str) -> Column:
        own = F.col(out) == name
        twice = F.raise_error(F.lit(f"branch {name} has several rows for one key"))
        only = F.max(F.when(own, F.col(value)))
        return F.when(F.count_if(own) > 1, twice).otherwise(only).alias(f"{value}_{name}")

    sides = [side(name) for name in names]
    wide = branched.groupBy(*key).agg(*sides)
    first, *rest = [F.col(f"{value}_{name}") for name in names]
    return wide.withColumn("agree", reduce(lambda a, c: a & c.eqNullSafe(first), rest, F.lit(True)))


def agreement(compared: DataFrame) -> DataFrame:
    """Number of keys, of agreeing keys and their share."""
    return compared.agg(
        F.count(F.lit(1)).alias("n_keys"),
        F.count_if("agree").alias("n_agree"),
        F.avg(F.col("agree").cast("int")).alias("agreement"),
    )
