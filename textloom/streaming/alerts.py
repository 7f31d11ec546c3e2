"""Change streams: debounced batches, alerts that announce a document once, incremental upserts."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..session import delete_path

#: Quiet time of a change source, retries, and the file number beyond which a whole site is searched.
QUIET, RETRY_SECONDS, ATTEMPTS, FILE_THRESHOLD = "2 seconds", 3, 3, 10_000


def debounce(events: DataFrame, key: str, time: str, quiet: str = QUIET) -> DataFrame:
    """(key, first, last, n): runs of events without a pause of ``quiet``; works on streams with a watermark."""
    session = F.session_window(time, quiet)
    return events.groupBy(key, session).agg(F.min(time).alias("first"), F.max(time).alias("last"), F.count("*").alias("n")).drop("session_window")


def announce_once(found: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The first row of each key over a whole batch."""
    return found.groupBy(*keys).agg(F.min(order).alias(order))


def retried(run: Callable[[], object], attempts: int = ATTEMPTS, pause: float = RETRY_SECONDS) -> object:
    """The result of ``run``, tried again after a pause; the last failure is raised."""
    for left in range(attempts - 1, -1, -1):
        try:
            return run()
        except Exception:
            if not left:
                raise
            time.sleep(pause)


def alert_scope(docs: DataFrame, changed: DataFrame, key: str = "path", most: int = FILE_THRESHOLD) -> DataFrame:
    """The documents that an alert has to judge after a batch: the changed ones, or all if very many changed."""
    return docs if changed.count() > most else docs.join(F.broadcast(changed.select(key).distinct()), key, "left_semi")


def fresh_alerts(found: DataFrame, seen: DataFrame, keys: list[str]) -> DataFrame:
    """Documents that an alert has not announced yet."""
    return found.dropDuplicates(keys).join(seen.select(*keys), keys, "left_anti")


def forget_removed(seen: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    """Seen documents without the removed ones, which are announced again if they return."""
    return seen.join(gone.select(*keys), keys, "left_anti")


def watch(spark: SparkSession, path: str, schema, glob: str = "*.parquet", files_per_trigger: int = 1000) -> DataFrame:
    """A stream of change batches from files that appear in a folder."""
    return spark.readStream.schema(schema).option("pathGlobFilter", glob).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def upsert_stream(changes: DataFrame, table: str, checkpoint: str, keys: tuple[str, ...] = ("path",), order: str = "modified") -> StreamingQuery:
    """Keep ``table`` (a Parquet folder) at the newest row of each key.

    Each micro-batch writes a new version beside the current one and drops those before it; a version counts
    when it is complete, so a batch that is repeated after a failure writes the same version again.  Of rows
    with equal ``order`` that of the greatest hash over all columns is the newest.
    """

    def apply(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        ranked = Window.partitionBy(*keys).orderBy(F.desc(order), F.desc(F.xxhash64(*batch.columns)))
        newest = batch.withColumn("_rank", F.row_number().over(ranked)).where("_rank = 1").drop("_rank")
        before = current_version(spark, table, below=number)
        rows = newest if before is None else spark.read.parquet(f"{table}/v{before:012d}").join(newest.select(*keys), list(keys), "left_anti").unionByName(newest)
        retried(lambda: rows.write.mode("overwrite").parquet(f"{table}/v{number:012d}"))
        while before is not None and (older := current_version(spark, table, below=before)) is not None:
            delete_path(spark, f"{table}/v{older:012d}")

    return changes.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current_version(spark: SparkSession, table: str, below: int | None = None) -> int | None:
    """The latest complete version of a table of :func:`upsert_stream`."""
    root = spark._jvm.org.apache.hadoop.fs.Path(table)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(root):
        return None
    found = [int(s.getPath().getName()[1:]) for s in fs.listStatus(root) if s.getPath().getName().startswith("v") and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))]
    return max((v for v in found if below is None or v < below), default=None)


def read_current(spark: SparkSession, table: str) -> DataFrame:
    version = current_version(spark, table)
    if version is None:
        raise FileNotFoundError(table)
    return spark.read.parquet(f"{table}/v{version:012d}")
