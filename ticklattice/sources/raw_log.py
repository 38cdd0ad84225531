"""Raw message logs: tables of ``platform, source, symbol, id, timestamp, payload`` and the operations on them.

Stored logs are parquet, partitioned by the first three columns, so a scan of one symbol reads that symbol's files and
the id filter reaches the row groups. The log's order within a key is its ``id``.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ticklattice.functions.scale import dense_index, lag_one, running
from ticklattice.sources.schemas import RAW_LOG

LOG_KEYS = ["platform", "source", "symbol"]


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """The whole log."""
    return spark.read.schema(RAW_LOG).parquet(path)


def scan_from(log: DataFrame, from_id: int, *, reverse: bool = False, **key: str) -> DataFrame:
    """Rows with ``id >= from_id`` of the key given by name, in id order."""
    for column, value in key.items():
        log = log.where(F.col(column) == value)
    return log.where(F.col("id") >= from_id).orderBy(F.desc("id") if reverse else "id")


def scan_from_each(log: DataFrame, starts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows at or beyond each key's own ``from_id``; keys without one are left out."""
    return log.join(starts.select(*keys, "from_id"), list(keys)).where(F.col("id") >= F.col("from_id")).drop("from_id")


def first_n(log: DataFrame, keys: Sequence[str], n: int, from_id: int = 0) -> DataFrame:
    """The first ``n`` rows per key at or beyond ``from_id``. Spark cuts each task's rows to ``n`` before shuffling."""
    rank = F.row_number().over(W.partitionBy(*keys).orderBy("id"))
    return log.where(F.col("id") >= from_id).withColumn("_n", rank).where(F.col("_n") <= n).drop("_n")


def last_n(log: DataFrame, keys: Sequence[str], n: int) -> DataFrame:
    """The last ``n`` rows per key."""
    if n == 1:
        return last_record(log, keys)
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(F.desc("id")))
    return log.withColumn("_n", rank).where(F.col("_n") <= n).drop("_n")


def last_record(log: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The row with the largest id per key, by a partial aggregate."""
    rest = [c for c in log.columns if c not in keys]
    return log.groupBy(*keys).agg(F.max_by(F.struct(*rest), "id").alias("_r")).select(*keys, *[F.col(f"_r.{c}") for c in rest]).select(*log.columns)


def assign_ids(arrivals: DataFrame, stored: DataFrame, keys: Sequence[str], order: Sequence[str], slice_col: Column) -> DataFrame:
    """Number new rows densely per key, going on from each key's last stored id (from 0 for a new key).

    ``slice_col`` cuts a key's arrivals into ranges of the order, see ``functions.scale``.
    """
    last = stored.groupBy(*keys).agg(F.max("id").alias("_last"))
    numbered = dense_index(arrivals.withColumn("_slice", slice_col), keys, order, out="_new").drop("_slice")
    return numbered.join(last, list(keys), "left").withColumn("id", F.col("_new") + F.coalesce(F.col("_last") + 1, F.lit(0))).drop("_new", "_last")


def appender(path: str, keys: Sequence[str], order: Sequence[str], slice_col: Callable[[], Column]) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that appends a micro-batch with dense ids to the table at ``path``.

    Each batch writes the last id of every key beside the table (``path_last``), and the next one reads only that, not the
    log. A batch replayed after a failure replaces its own rows and last ids.
    """
    keys = list(keys)

    def append(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        if batch_id:
            last = spark.read.parquet(f"{path}_last/batch_id={batch_id - 1}")
        else:
            last = batch.select(*keys, F.lit(0).cast("long").alias("id")).where(F.lit(False))
        assign_ids(batch, last, keys, order, slice_col()).write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")
        added = spark.read.parquet(f"{path}/batch_id={batch_id}").select(*keys, "id")
        merged = last.unionByName(added).groupBy(*keys).agg(F.max("id").alias("id"))
        merged.write.mode("overwrite").parquet(f"{path}_last/batch_id={batch_id}")

    return append


def upsert_last(current: DataFrame, changes: DataFrame, keys: Sequence[str], version: Sequence[str]) -> DataFrame:
    """One current row per key: the newest of the stored row and the changes by ``version``."""
    both = current.unionByName(changes)
    rest = [c for c in both.columns if c not in keys]
    newest = both.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*version)).alias("_r"))
    return newest.select(*[F.col(k) for k in keys], *[F.col(f"_r.{c}") for c in rest]).select(*current.columns)


def replace_by_id(log: DataFrame, replacements: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The log with rows of the same key and id exchanged; rows new to the log are added."""
    on = [*keys, "id"]
    return log.join(replacements.select(*on), on, "left_anti").unionByName(replacements)


def truncate_before(log: DataFrame, limits: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Retention: each key keeps rows with ``id >= keep_from``; a key without a limit keeps all."""
    joined = log.join(limits.select(*keys, "keep_from"), list(keys), "left")
    return joined.where(F.col("keep_from").isNull() | (F.col("id") >= F.col("keep_from"))).drop("keep_from")


def append_if_changed(log: DataFrame, keys: Sequence[str], slice_col: Column) -> DataFrame:
    """What remains when a record equal to the one stored before it only refreshes that record's time.

    One row per run of equal payloads: ``version`` counts the runs from 0, ``timestamp`` is the run's last, ``id`` its
    first.
    """
    marked = lag_one(log.withColumn("_slice", slice_col), keys, ["id"], {"_before": F.col("payload"), "_had": F.lit(True)})
    starts = (F.col("_had").isNull() | ~F.col("payload").eqNullSafe(F.col("_before"))).cast("long")
    runs = running(marked, keys, ["id"], {"_run": ("sum", starts)})
    return runs.groupBy(*keys, (F.col("_run") - 1).alias("version")).agg(
        F.min("id").alias("id"), F.max("timestamp").alias("timestamp"), F.min_by("payload", "id").alias("payload"))


def reject_stale(batches: DataFrame, keys: Sequence[str], slice_col: Column) -> DataFrame:
    """Leave out responses whose ``last_id`` is missing, 0 or below that of an earlier response; equal passes."""
    usable = batches.where(F.coalesce("last_id", F.lit(0)) != 0).withColumn("_slice", slice_col)
    seen = running(usable, keys, ["id"], {"_seen": ("max", F.col("last_id"))}, exclusive=True)
    return seen.where(F.col("_seen").isNull() | (F.col("last_id") >= F.col("_seen"))).drop("_seen", "_slice")


def has_data(result: Column) -> Column:
    """Whether any entry of a result map besides ``last`` is a non-empty JSON array."""
    bodies = F.map_values(F.map_filter(result, lambda k, _: k != "last"))
    return F.exists(bodies, lambda v: F.coalesce(F.json_array_length(v), F.lit(0)) > 0)


def lenient_jsonl(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Lines of JSON objects as ``data, timestamp, message_data``, and the lines that do not parse; blanks are skipped."""
    full = lines.select(F.trim("value").alias("data")).where(F.col("data") != "")
    parsed = full.withColumn("ok", F.try_parse_json("data").isNotNull())
    good = parsed.where("ok").select(
        "data", F.get_json_object("data", "$.timestamp").try_cast("long").alias("timestamp"),
        F.get_json_object("data", "$.message").alias("message_data"))
    return good, parsed.where("NOT ok").select("data")


def to_jsonl(df: DataFrame) -> DataFrame:
    """Rows as JSON lines in one text column, for ``write.text``."""
    return df.select(F.to_json(F.struct(*df.columns)).alias("value"))


def directory_stats(spark: SparkSession, root: str, patterns: Sequence[str]) -> DataFrame:
    """Files, bytes and last change per directory under ``root``.

    A pattern ``a/b/**`` counts each first level below ``a/b`` apart, any other pattern counts all that starts with it;
    the first match wins and the rest is counted under the empty name. File contents are not read.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "length", "modificationTime")
    base = root.rstrip("/") + "/"
    rel = F.substring_index("path", base, -1)
    name = F.lit(None).cast("string")
    for p in reversed(patterns):
        if p.endswith("/**"):
            head = p[:-3]
            level = F.get(F.split(F.substring(rel, len(head) + 2, 1_000_000), "/"), 0)
            name = F.when(rel.startswith(head + "/") & (level != ""), F.concat(F.lit(head + "/"), level)).otherwise(name)
        else:
            name = F.when(rel.startswith(p), F.lit(p)).otherwise(name)
    return files.groupBy(F.coalesce(name, F.lit("")).alias("directory")).agg(
        F.count("*").alias("file_count"), F.sum("length").alias("size_bytes"),
        F.unix_millis(F.max("modificationTime")).alias("last_updated"))
