"""Starting streams over file sources with one checkpoint per sink."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ticklattice.session import scratch_path

BATCH_ROWS = 250_000  # rows of one micro-batch, about; a stateful task holds a key's rows of one
STATE_TASKS = 8  # a stream's stateful tasks, or as many as there are cores
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    """Stateful processors keep their state in RocksDB, which spills to disk and checkpoints changes."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def read_files(spark: SparkSession, path: str, schema, *, max_files: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(path)


def append_to(stream: DataFrame, path: str, checkpoint: str, *, interval: str | None = None) -> StreamingQuery:
    """Append a stream to a parquet table; the file sink writes each micro-batch exactly once.

    Without an interval the query takes all that is there and stops; started again on the same checkpoint with one, it
    goes on from there as a live query.
    """
    writer = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    writer = writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)
    with state_tasks(stream.sparkSession):
        return writer.start()


@contextmanager
def state_tasks(spark: SparkSession) -> Iterator[None]:
    """A stream started inside has no more stateful tasks than cores (``STATE_TASKS`` at least).

    Each of them opens and commits a state store in every micro-batch, even without rows, which takes longer than the rows of a bounded
    micro-batch. The number of a checkpoint's first run holds for all later ones.
    """
    name = "spark.sql.shuffle.partitions"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(int(before), max(STATE_TASKS, spark.sparkContext.defaultParallelism))))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def each_batch(stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, *, interval: str | None = None) -> StreamingQuery:
    """Hand each micro-batch to ``write(batch, batch_id)``; a batch may come twice after a failure, with the same id."""
    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    writer = writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)
    return writer.start()


def replace_batch(path: str) -> Callable[[DataFrame, int], None]:
    """A ``write`` that keeps each batch in a directory of its own and so overwrites a repeated one."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return write


def add_files(part: DataFrame, path: str, order: str, rows: int = BATCH_ROWS) -> int:
    """Add the rows to a source folder as files of about ``rows`` rows, one after the other in ``order``; returns how many files.

    ``part`` is read three times (counted, cut into ranges, dealt out), so hand in a stored table or a filter over one. A file source takes files by their time of writing, so with ``max_files=1`` the micro-batches are in ``order`` and bounded.
    """
    spark = part.sparkSession
    n = max(1, -(-part.count() // rows))
    cut = scratch_path(spark, "batches")
    part.repartitionByRange(n, order).withColumn("_batch", F.spark_partition_id()).write.partitionBy("_batch").parquet(cut)
    batches = sorted(r[0] for r in spark.read.parquet(cut).select("_batch").distinct().toLocalIterator())
    for b in batches:
        spark.read.schema(part.schema).parquet(f"{cut}/_batch={b}").coalesce(1).write.mode("append").parquet(path)
    return len(batches)


def run_in_parts(parts: Sequence[DataFrame], build: Callable[[DataFrame], DataFrame], label: str,
                 watch: Callable[[StreamingQuery], None] | None = None, *, order: str | None = None, rows: int = BATCH_ROWS) -> DataFrame:
    """Let a stream see the parts arrive one after the other and return what it put out.

    Each part is added to a source folder and the query, always on the same checkpoint, runs until it has taken it in: in one
    micro-batch, or with ``order`` in as many as it has times ``rows`` rows, see ``add_files``.
    """
    spark = parts[0].sparkSession
    root = scratch_path(spark, label)
    schema, max_files = None, 1 if order else None
    for part in parts:
        if order:
            add_files(part, f"{root}/in", order, rows)
        else:
            part.write.mode("append").parquet(f"{root}/in")
        query = append_to(build(read_files(spark, f"{root}/in", part.schema, max_files=max_files)), f"{root}/out", f"{root}/checkpoint")
        query.awaitTermination()
        if query.exception():
            raise query.exception()
        if watch:
            watch(query)
        schema = schema or build(read_files(spark, f"{root}/in", part.schema)).schema
    return spark.read.schema(schema).parquet(f"{root}/out")


def run_until_idle(parts: Sequence[DataFrame], build: Callable[[DataFrame], DataFrame], label: str, idle_ms: int, *,
                   order: str | None = None, rows: int = BATCH_ROWS, watch: Callable[[StreamingQuery], None] | None = None, limit_s: float = 900.0) -> DataFrame:
    """A live query over the parts, that is stopped once the timers of all idle keys have run out.

    Timers in processing time run out in micro-batches without rows, which a live query goes on making. The first of these that
    begins ``idle_ms`` and a second after the last one with rows has run every timer. A part is one file, with ``order`` as many as it has times
    ``rows`` rows, and each file is one micro-batch, so those with rows come first. ``limit_s`` bounds the wait after one of these.
    """
    spark = parts[0].sparkSession
    root = scratch_path(spark, label)
    files = len(parts)
    if order:
        files = sum(add_files(part, f"{root}/in", order, rows) for part in parts)
    else:
        for part in parts:
            part.coalesce(1).write.mode("append").parquet(f"{root}/in")
    stream = build(read_files(spark, f"{root}/in", parts[0].schema, max_files=1))
    query = append_to(stream, f"{root}/out", f"{root}/checkpoint", interval="1 second")
    end, begun, taken = time.monotonic() + limit_s, {}, -1
    try:
        while True:
            begun.update({p["batchId"]: datetime.fromisoformat(p["timestamp"]).timestamp() for p in query.recentProgress})
            if files - 1 in begun and max(begun.values()) >= begun[files - 1] + idle_ms / 1000 + 1:
                break
            newest = min(files - 1, max(begun, default=-1))
            if newest > taken:
                taken, end = newest, time.monotonic() + limit_s
            if query.exception():
                raise query.exception()
            if time.monotonic() > end:
                raise TimeoutError(f"timers of {label} have not run out in {limit_s} seconds")
            time.sleep(0.2)
        if watch:
            watch(query)
    finally:
        query.stop()
    return spark.read.schema(stream.schema).parquet(f"{root}/out")
