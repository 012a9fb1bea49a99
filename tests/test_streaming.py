"""Streams over several files and restarts end where the batch folds do."""

import pytest
from pyspark.sql import functions as F

from sluice.operators import events
from sluice.sources import tables as t
from sluice.streaming import events as streams


@pytest.fixture(scope="module")
def parts(spark, sf, tmp_path_factory):
    """The events in five files, one task holding about a third of them."""
    path = str(tmp_path_factory.mktemp("events") / "parts")
    raw = t.table(spark, sf, "events")
    busy = F.when(F.col("event_id") % 3 == 0, 0).otherwise(F.col("user_id"))
    raw.withColumn("user_id", busy).repartition(5, "event_id").write.parquet(path)
    return path


def rows(df):
    return sorted(map(repr, map(tuple, df.select(sorted(df.columns)).collect())))


def stream(spark, path):
    schema = spark.read.parquet(path).schema
    return t.as_task_events(streams.read_events(spark, path, schema, files_per_batch=1))


def test_status(spark, parts):
    got = streams.stream_status(stream(spark, parts))
    assert rows(got) == rows(events.fold_status(t.as_task_events(spark.read.parquet(parts))))


def test_updates_are_folded_and_deleted(spark, parts, tmp_path):
    path = tmp_path / "status"
    got = streams.stream_status(stream(spark, parts), path=f"file:{path}", every=2)
    assert rows(got) == rows(events.fold_status(t.as_task_events(spark.read.parquet(parts))))
    assert {p.name for p in (path / "updates").glob("batch=*")} == {"batch=2", "batch=3", "batch=4"}
    assert {p.name for p in (path / "folded").glob("upto=*")} == {"upto=1", "upto=3"}


def test_last_n(spark, parts):
    got = streams.stream_last_n(stream(spark, parts), 5)
    assert rows(got) == rows(events.last_n(t.as_task_events(spark.read.parquet(parts)), 5))


def test_last_n_is_kept_as_state(spark, parts, tmp_path):
    """The state has n rows a key at most, and a batch writes the keys it changed only."""
    path, checkpoint = tmp_path / "out", f"file:{tmp_path}/checkpoint"
    got = streams.stream_last_n(stream(spark, parts), 5, path=f"file:{path}", checkpoint=checkpoint, every=2)
    expected = events.last_n(t.as_task_events(spark.read.parquet(parts)), 5)
    assert rows(got) == rows(expected)
    assert {p.name for p in (path / "updates").glob("batch=*")} == {"batch=2", "batch=3", "batch=4"}
    assert {p.name for p in (path / "folded").glob("upto=*")} == {"upto=1", "upto=3"}
    state = spark.read.format("statestore").option("stateVarName", "newest").load(checkpoint)
    held = state.groupBy("key.uid").count()
    assert held.agg(F.max("count")).first()[0] == 5 and state.count() == expected.count()


def test_unchanged_keys_are_not_written_again(spark, parts, tmp_path):
    first, path = str(tmp_path / "in"), tmp_path / "out"
    every = spark.read.parquet(parts)
    every.coalesce(1).write.parquet(first)
    where = dict(path=f"file:{path}", checkpoint=f"file:{tmp_path}/checkpoint")
    streams.stream_last_n(stream(spark, first), 5, **where)
    late = every.where("user_id = 0").limit(1).withColumn("event_id", F.lit(10**9).cast("long"))
    late.coalesce(1).write.mode("append").parquet(first)
    got = streams.stream_last_n(stream(spark, first), 5, **where)
    assert got.where("uid = 0 and seq = 1000000000").count() == 1
    assert spark.read.parquet(f"file:{path}/updates/batch=1").select("uid").distinct().count() == 1


def test_restart_goes_on_where_it_stopped(spark, parts, tmp_path):
    first, second = str(tmp_path / "in"), spark.read.parquet(parts)
    early = second.where("event_id < 500").coalesce(1)
    early.write.parquet(first)
    where = dict(path=str(tmp_path / "out"), checkpoint=str(tmp_path / "checkpoint"))
    streams.stream_last_n(stream(spark, first), 5, **where)
    second.where("event_id >= 500").coalesce(1).write.mode("append").parquet(first)
    got = streams.stream_last_n(stream(spark, first), 5, **where)
    assert rows(got) == rows(events.last_n(t.as_task_events(second), 5))
    again = streams.stream_last_n(stream(spark, first), 5, **where)
    assert rows(again) == rows(got)
