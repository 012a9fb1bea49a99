"""Fingerprints of groups and runs, and tables keyed by fingerprint.

A hash over a sequence cannot be split, so the members of a group are brought together once,
sorted by Spark, and hashed as they stream by: a task holds one hash state and one batch of
rows, however long the group is.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _gathered(df: DataFrame, key: Sequence[str], order: str, uid: str) -> DataFrame:
    return df.repartition(*key).sortWithinPartitions(*key, order, uid)


def _one_per_group(
    df: DataFrame, key: Sequence[str], order: str, uid: str, out: str, start: Callable, step: Callable, end: Callable
) -> DataFrame:
    """One value per group: ``start()``, then ``step(state, uid)`` in order, then ``end(state)``.

    Rows of equal order are taken by uid; a null uid is passed over. An empty table gives an
    empty result, and a group whose uids are all null the value of no members.
    """
    key = list(key)
    rows = _gathered(df.select(*key, F.col(order).alias("_at"), F.col(uid).alias("_uid")), key, "_at", "_uid")
    width = len(key)

    def fold(batches):
        group, state, types = None, None, []

        def row(values, digest):
            arrays = [pa.array([v], kind) for v, kind in zip(values, types, strict=True)]
            return pa.RecordBatch.from_arrays([*arrays, pa.array([digest])], names=[*key, out])

        for batch in batches:
            types = [c.type for c in batch.columns[:width]]
            columns = [c.to_pylist() for c in batch.columns]
            for *values, _, member in zip(*columns, strict=True):
                if values != group:
                    if group is not None:
                        yield row(group, end(state))
                    group, state = values, start()
                if member is not None:
                    state = step(state, member)
        if group is not None:
            yield row(group, end(state))

    schema = T.StructType([*(df.schema[k] for k in key), T.StructField(out, T.StringType())])
    return rows.mapInArrow(fold, schema)


def group_uid(df: DataFrame, key: Sequence[str], order: str, uid: str = "uid") -> DataFrame:
    """``H`` of the members' uids in order, put together, one row per group."""

    def step(state, member):
        state.update(member.encode("utf-8"))
        return state

    return _one_per_group(df, key, order, uid, "group_uid", hashlib.sha256, step, lambda s: s.hexdigest())


def fold_uid(df: DataFrame, key: Sequence[str], order: str, uid: str = "uid") -> DataFrame:
    """Left fold ``H(acc + uid)`` from ``'0'`` over the members in order, one row per group."""

    def step(state, member):
        return hashlib.sha256((state + member).encode("utf-8")).hexdigest()

    return _one_per_group(df, key, order, uid, "fold_uid", lambda: "0", step, lambda s: s)


def lineage_uid(df: DataFrame, run: str, pos: str, uid: str = "uid") -> DataFrame:
    """Add ``lineage_hash`` and ``run_uid`` to every step.

    ``lineage_hash`` is ``H`` of the JSON list of the earlier uids of the run, ``run_uid`` is
    ``H(lineage_hash + uid)``. The list is fed to the hash piece by piece and finished on a
    copy at each step, so neither time nor memory grows with what came before.
    """
    columns = [c for c in df.columns if c not in ("lineage_hash", "run_uid")]
    kept = df.select(*columns)
    at = columns.index(uid)
    group_at = columns.index(run)

    def walk(batches):
        group, state, first, begun = None, None, True, False
        for batch in batches:
            hashes, runs = [], []
            for name, member in zip(batch.column(group_at).to_pylist(), batch.column(at).to_pylist(), strict=True):
                if not begun or name != group:
                    group, state, first, begun = name, hashlib.sha256(b"["), True, True
                done = state.copy()
                done.update(b"]")
                hashes.append(done.hexdigest())
                whole = None if member is None else hashlib.sha256((hashes[-1] + member).encode("utf-8")).hexdigest()
                runs.append(whole)
                state.update(("" if first else ",").encode() + json.dumps(member, ensure_ascii=False).encode("utf-8"))
                first = False
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(hashes, pa.string()), pa.array(runs, pa.string())],
                names=[*columns, "lineage_hash", "run_uid"],
            )

    new = [T.StructField(c, T.StringType()) for c in ("lineage_hash", "run_uid")]
    return _gathered(kept, [run], pos, uid).mapInArrow(walk, T.StructType([*kept.schema.fields, *new]))


def short_id_collisions(df: DataFrame, uid: str = "uid", n: int = 7) -> DataFrame:
    """Short ids shared by different uids."""
    return (
        df.groupBy(F.substring(uid, 1, n).alias("short_id"))
        .agg(
            F.count_distinct(uid).alias("n_uids"),
            F.min(uid).alias("first_uid"),
            F.max(uid).alias("last_uid"),
        )
        .where("n_uids > 1")
    )


def latest_by_uid(df: DataFrame, uid: str, created: str, *tie: str) -> DataFrame:
    """The newest row per uid: later writes replace earlier ones."""
    rest = [c for c in df.columns if c not in (uid, created, *tie)]
    newest = F.max_by(F.struct(created, *tie, *rest), F.struct(created, *tie))
    return df.groupBy(uid).agg(newest.alias("_row")).select(uid, "_row.*").select(*df.columns)
