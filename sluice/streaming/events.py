"""The event folds as Structured Streaming queries."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from sluice.operators.events import status_aggregates
from sluice.session import scratch_path


#: Micro-batches whose updates are folded into one table.
EVERY = 32


def read_events(
    spark: SparkSession, path: str, schema: StructType, files_per_batch: int = 100
) -> DataFrame:
    """Stream the parquet files of a folder, or the one file ``path`` names."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
    if at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).isFile():
        stream = stream.option("pathGlobFilter", at.getName())
        return stream.parquet(at.getParent().toString())
    return stream.parquet(path)


def _drain(writer, checkpoint: str, timeout: int | None) -> None:
    """Process what is there and stop; failures of the query reach the caller.

    A backlog may take as long as it takes, unless the caller sets a limit in seconds.
    """
    query = writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    if timeout is None:
        query.awaitTermination()
    elif not query.awaitTermination(timeout):
        query.stop()
        raise TimeoutError(f"stream still running after {timeout} s")


def stream_status(
    events: DataFrame,
    path: str | None = None,
    checkpoint: str | None = None,
    timeout: int | None = None,
    every: int = EVERY,
) -> DataFrame:
    """Status per task, kept current as events arrive; equals ``fold_status`` in the end.

    Each micro-batch writes the tasks it changed under its own number, so a batch that is
    run again replaces itself. The newest entry per task is the answer. After every ``every``
    batches the updates are folded into one table; what an earlier fold holds is deleted, so
    what is stored stays below two folds and twice ``every`` updates. A batch that is run
    again still finds all it needs.
    """
    spark = events.sparkSession
    path = path or scratch_path(spark, "status")
    checkpoint = checkpoint or scratch_path(spark, "checkpoint")
    folded = events.groupBy("uid").agg(*status_aggregates())
    schema = folded.schema

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/updates/batch={number}")
        _fold_updates(spark, path, number, every, lambda fold, last: _newest(spark, path, schema, fold, last))

    _drain(folded.writeStream.outputMode("update").foreachBatch(write), checkpoint, timeout)
    return read_status(spark, path, schema)


def _fold_updates(spark: SparkSession, path: str, number: int, every: int, merged) -> None:
    """After every ``every`` batches: one table of all updates so far; what it replaces goes.

    The fold before is kept, so that a batch that is run again finds all it needs.
    """
    if number % every != every - 1:
        return
    before = [n for n in _numbers(spark, f"{path}/folded", "upto") if n < number]
    merged(max(before, default=-1), number).write.mode("overwrite").parquet(f"{path}/folded/upto={number}")
    for n in _numbers(spark, f"{path}/updates", "batch"):
        if n <= max(before, default=-1):
            _delete(spark, f"{path}/updates/batch={n}")
    for n in before:
        if n < max(before):
            _delete(spark, f"{path}/folded/upto={n}")


def _since(spark: SparkSession, path: str, schema: StructType, fold: int, last: int) -> DataFrame | None:
    """The fold up to ``fold`` and all updates after it up to ``last``, with their ``_batch``."""
    known = [
        spark.read.schema(schema).parquet(f"{path}/updates/batch={n}").withColumn("_batch", F.lit(n))
        for n in _numbers(spark, f"{path}/updates", "batch")
        if fold < n <= last
    ]
    if fold >= 0:
        stored = spark.read.schema(schema).parquet(f"{path}/folded/upto={fold}")
        known.append(stored.withColumn("_batch", F.lit(fold)))
    return reduce(DataFrame.unionByName, known) if known else None


def _newest(spark: SparkSession, path: str, schema: StructType, fold: int, last: int) -> DataFrame:
    """The newest entry per task of the fold up to ``fold`` and the updates up to ``last``."""
    columns = [c for c in schema.names if c != "uid"]
    known = _since(spark, path, schema, fold, last)
    if known is None:
        return spark.createDataFrame([], schema)
    newest = F.max_by(F.struct(*columns), "_batch")
    return known.groupBy("uid").agg(newest.alias("_s")).select("uid", "_s.*")


def read_status(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The status that a stream has left at ``path``."""
    folds = _numbers(spark, f"{path}/folded", "upto")
    last = max(_numbers(spark, f"{path}/updates", "batch"), default=-1)
    return _newest(spark, path, schema, max(folds, default=-1), last)


class Newest(StatefulProcessor):
    """Keeps the ``n`` newest rows of a key in a list state, and gives them out when they change.

    The state holds ``n`` rows a key at most. New rows come in pieces and are cut to ``n`` as
    they arrive, so a busy key costs no more memory than any other.
    """

    def __init__(self, schema: StructType, n: int, by: str, order: str) -> None:
        self.schema, self.n, self.by, self.order = schema, n, by, order

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getListState("newest", self.schema)

    def handleInputRows(self, key, rows, timerValues) -> Iterator:
        import pandas as pd

        names = self.schema.names
        at = names.index(self.order)
        before = [tuple(r) for r in self.state.get()]
        newest = before
        for piece in rows:
            plain = piece[names].astype(object).where(piece[names].notna(), None)
            newest = newest + list(plain.itertuples(index=False, name=None))
            newest = sorted(newest, key=lambda r: (r[at] is not None, r[at]), reverse=True)[: self.n]
        newest = [tuple(v.to_pydatetime() if isinstance(v, pd.Timestamp) else v for v in r) for r in newest]
        if newest != before:
            self.state.put(newest)
            yield pd.DataFrame(newest, columns=names)

    def close(self) -> None:
        pass


def stream_last_n(
    events: DataFrame,
    n: int = 100,
    path: str | None = None,
    checkpoint: str | None = None,
    timeout: int | None = None,
    every: int = EVERY,
    by: str = "uid",
    order: str = "seq",
) -> DataFrame:
    """The newest ``n`` events per task, as keyed state; equals ``last_n`` in the end.

    The state store holds the rows, on disk and in the checkpoint, so a restart goes on from
    them. A micro-batch writes the rows of the tasks it changed and nothing else; the newest
    batch of each task is the answer, and every ``every`` batches the updates are folded into
    one table. Within each piece of a partition only the newest ``n`` rows of a task are
    shuffled.
    """
    spark = events.sparkSession
    path = path or scratch_path(spark, "last")
    checkpoint = checkpoint or scratch_path(spark, "checkpoint")
    schema = events.schema

    def cut(pieces):
        for piece in pieces:
            newest = piece.sort_values(order, ascending=False, kind="stable").groupby(by, dropna=False, sort=False)
            yield newest.head(n)

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/updates/batch={number}")
        _fold_updates(spark, path, number, every, lambda fold, last: _latest(spark, path, schema, by, fold, last))

    newest = (
        events.mapInPandas(cut, schema)
        .groupBy(by)
        .transformWithStateInPandas(Newest(schema, n, by, order), schema, "Update", "None")
    )
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider, None)
    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        _drain(newest.writeStream.outputMode("update").foreachBatch(write), checkpoint, timeout)
    finally:
        spark.conf.unset(provider) if before is None else spark.conf.set(provider, before)
    folds = _numbers(spark, f"{path}/folded", "upto")
    last = max(_numbers(spark, f"{path}/updates", "batch"), default=-1)
    return _latest(spark, path, schema, by, max(folds, default=-1), last)


def _latest(spark: SparkSession, path: str, schema: StructType, by: str, fold: int, last: int) -> DataFrame:
    """The rows of each key's newest batch, of the fold up to ``fold`` and the updates up to ``last``."""
    known = _since(spark, path, schema, fold, last)
    if known is None:
        return spark.createDataFrame([], schema)
    newest = F.rank().over(Window.partitionBy(by).orderBy(F.desc("_batch")))
    return known.withColumn("_rank", newest).where("_rank = 1").drop("_rank", "_batch")


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def _numbers(spark: SparkSession, path: str, name: str) -> list[int]:
    """Numbers of the finished folders ``name=...`` below ``path``."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    at = hadoop.Path(path)
    files = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(at):
        return []
    folders = [status.getPath() for status in files.listStatus(at)]
    done = [f for f in folders if files.exists(hadoop.Path(f, "_SUCCESS"))]
    names = [f.getName() for f in done]
    return sorted(int(n.removeprefix(f"{name}=")) for n in names if n.startswith(f"{name}="))
