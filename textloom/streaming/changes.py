"""A stream of changes with state: what became of reported paths, and which documents alerts have announced.

Reports name files or folders, written or gone.  :func:`settled` merges the reports of a path until it is quiet;
:func:`resolve_reports` turns them into changed and removed files by joins of reported folders with the folders above
each known file, so that a folder that went takes its files along.  :func:`alert_rows` lets the alerts' predicates judge
changed documents, and :func:`announcements` keeps, for each alert and document, whether it has been announced: once,
and again only after it was removed.  The same rows come out of :func:`log_announcements`, for large batches, and of
:func:`announced_so_far`, a window over a whole log.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..functions.text import file_of
from ..session import delete_path
from .alerts import current_version

#: What a row of a change stream says of a document, and what comes out of the state.
MATCHES, KNOWN, GONE = "matches", "known", "gone"
ANNOUNCED, FORGOTTEN = "announced", "forgotten"
LOG = "alert string, document string, at timestamp, seq long, news string"
SEEN = "alert string, document string"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def folders_above(path: Column) -> Column:
    """Every folder above a file, the top (the empty path) first; a document inside an archive also has the archive's file."""
    file = file_of(path)
    parts = F.split(file, "/", -1)
    folders = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    return F.array_distinct(F.when(file != path, F.array_append(folders, file)).otherwise(folders))


def settled(reports: DataFrame, quiet: str = "2 seconds", late: str = "10 seconds") -> DataFrame:
    """(site_id, path, at, rescan, n): the reports of a path without a pause of ``quiet``, as one.

    On a stream a run comes out once the watermark, ``late`` behind the latest report, has passed its end; later
    reports of it are dropped.  ``rescan`` is true if any report says that others were lost.
    """
    runs = reports.withWatermark("at", late).groupBy("site_id", "path", F.session_window("at", quiet))
    return runs.agg(F.max("at").alias("last"), F.max("rescan").alias("rescan"), F.count("*").alias("n")).select("site_id", "path", F.col("last").alias("at"), "rescan", "n")


def merged_reports(reports: DataFrame) -> DataFrame:
    """(site_id, path) of a batch, each once; lost reports of a site stand for its top folder, which holds all others."""
    top = F.when(F.col("rescan"), F.lit("")).otherwise(F.col("path"))
    rows = reports.select("site_id", top.alias("path")).distinct()
    whole = rows.where("path = ''").select("site_id", F.lit(True).alias("_whole"))
    return rows.join(whole, "site_id", "left").where(F.col("_whole").isNull() | (F.col("path") == "")).select("site_id", "path")


def _under(files: DataFrame, folders: DataFrame) -> DataFrame:
    """Rows of ``files`` that are one of ``folders(site_id, path)`` or lie under one, each once.

    The paths above a file are compared by equality, so folders of any number are one equi-join; a file under several
    of them would come several times, hence the grouping by its place.
    """
    keys = files.select("site_id", F.col("path").alias("_path"), F.explode(F.array_append(folders_above(F.col("path")), F.col("path"))).alias("path"))
    hit = keys.join(folders, ["site_id", "path"], "left_semi").select("site_id", F.col("_path").alias("path")).distinct()
    return files.join(hit, ["site_id", "path"], "left_semi")


def resolve_reports(reports: DataFrame, listing: DataFrame, manifest: DataFrame) -> DataFrame:
    """(site_id, path, action): the files of a batch of reports that have ``changed`` or are ``removed``.

    ``reports(site_id, path, rescan)`` name files or folders.  ``listing(site_id, path, size, modified, excluded)`` has
    the files that are there now, ``manifest(site_id, path, size, modified)`` those that are indexed.  A reported file
    that is there is read again whatever its stamp.  A reported folder is compared as a whole: files of another stamp
    have changed.  Whatever is indexed at or under a reported path, and is not there or is excluded, is removed.
    """
    asked = merged_reports(reports)
    there = listing.where(~F.coalesce("excluded", F.lit(False))).select("site_id", "path", "size", "modified")
    itself = there.join(asked, ["site_id", "path"], "left_semi").select("site_id", "path")
    now = _under(there, asked)
    known = _under(manifest.select("site_id", "path", F.col("size").alias("_size"), F.col("modified").alias("_modified")), asked)
    other = ~(F.col("size").eqNullSafe(F.col("_size")) & F.col("modified").eqNullSafe(F.col("_modified")))
    both = now.withColumn("_there", F.lit(True)).join(known.withColumn("_known", F.lit(True)), ["site_id", "path"], "full")
    removed = both.where(F.col("_there").isNull()).select("site_id", "path", F.lit("removed").alias("action"))
    changed = both.where(F.col("_there") & (F.col("_known").isNull() | other)).select("site_id", "path").unionByName(itself).distinct()
    return changed.withColumn("action", F.lit("changed")).unionByName(removed)


def gone_documents(gone: DataFrame, documents: DataFrame) -> DataFrame:
    """(site_id, path, at, seq) of every document at or under a path of ``gone(site_id, path, at, seq)``.

    ``gone`` can be a stream; ``documents(site_id, path)`` is a table.  A path that holds nothing gives no row.
    """
    keys = documents.select("site_id", F.col("path").alias("document"), F.explode(F.array_append(folders_above(F.col("path")), F.col("path"))).alias("path"))
    return gone.join(keys, ["site_id", "path"]).select("site_id", F.col("document").alias("path"), "at", "seq")


def alert_rows(changes: DataFrame, alerts: dict[str, Column], gone: Column, known: Column | None = None) -> DataFrame:
    """(alert, document, at, seq, kind) of ``changes(path, at, seq, ...)``, a table or a stream.

    A document that is ``gone`` is so for all alerts; others match the alerts whose predicate holds, and are only
    ``known`` to them where an alert has just been set.  Rows that no alert has to know of go before any shuffle.
    """
    known = F.lit(False) if known is None else known
    kinds = [F.struct(F.lit(name).alias("alert"), F.when(gone, F.lit(GONE)).when(test, F.when(known, F.lit(KNOWN)).otherwise(F.lit(MATCHES))).alias("kind")) for name, test in sorted(alerts.items())]
    rows = changes.select(F.col("path").alias("document"), "at", "seq", F.explode(F.array(*kinds)).alias("a"))
    return rows.select("a.alert", "document", "at", "seq", "a.kind").where("kind is not null and document is not null")


class Announcer(StatefulProcessor):
    """The state of one alert and document: present once it was announced or known, dropped when the document goes."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._seen = handle.getValueState("seen", "seen boolean")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        seen = before = self._seen.exists()
        for row in sorted(rows, key=lambda r: (r["at"], r["seq"])):
            if seen != (row["kind"] == GONE):
                continue
            seen = not seen
            yield Row(alert=key[0], document=key[1], at=row["at"], seq=row["seq"], news=FORGOTTEN if row["kind"] == GONE else KNOWN if row["kind"] == KNOWN else ANNOUNCED)
        if seen and not before:
            self._seen.update((True,))
        elif before and not seen:
            self._seen.clear()

    def close(self) -> None:
        pass


def announcements(rows: DataFrame) -> DataFrame:
    """(alert, document, at, seq, news) of a stream of :func:`alert_rows`: what changes in what alerts have seen.

    Within a micro-batch rows of a document count by (at, seq); a batch is later than those before it.
    """
    return rows.groupBy("alert", "document").transformWithState(Announcer(), LOG, "append", "none")


def announced_so_far(rows: DataFrame) -> DataFrame:
    """The same of a whole table of :func:`alert_rows`: a row counts where the one before it, if any, says otherwise."""
    order = Window.partitionBy("alert", "document").orderBy("at", "seq")
    gone = F.col("kind") == GONE
    before = F.coalesce(F.lag(gone).over(order), F.lit(True))
    news = F.when(gone, F.lit(FORGOTTEN)).when(F.col("kind") == KNOWN, F.lit(KNOWN)).otherwise(F.lit(ANNOUNCED))
    return rows.withColumns({"_before": before, "news": news}).where(F.col("_before") != gone).select("alert", "document", "at", "seq", "news")


def seen_documents(log: DataFrame, reads: DataFrame | None = None) -> DataFrame:
    """(alert, document, at, fresh) of what alerts have seen and not forgotten, from a log of announcements.

    ``reads(alert, at)`` are the times at which a user looked; what was announced later is fresh.
    """
    latest = log.groupBy("alert", "document").agg(F.max_by(F.struct("at", "news"), F.struct("at", "seq")).alias("m")).where(F.col("m.news") != FORGOTTEN)
    rows = latest.select("alert", "document", "m.at", "m.news")
    if reads is None:
        return rows.select("alert", "document", "at", (F.col("news") == ANNOUNCED).alias("fresh"))
    looked = reads.groupBy("alert").agg(F.max("at").alias("_read"))
    fresh = (F.col("news") == ANNOUNCED) & (F.col("_read").isNull() | (F.col("at") > F.col("_read")))
    return rows.join(looked, "alert", "left").select("alert", "document", "at", fresh.alias("fresh"))


def state_session(spark: SparkSession) -> SparkSession:
    """A session beside the caller's whose streams keep their state in RocksDB, beyond the memory of executors."""
    own = spark.newSession()
    own.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    return own


def write_log(news: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Append a stream of announcements to ``folder``, each once: the file sink lists the files of complete batches only.

    It takes what is there and stops; the next start goes on from the checkpoint.
    """
    return news.writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def log_announcements(rows: DataFrame, log: str, state: str, checkpoint: str) -> StreamingQuery:
    """Append the news of a stream of :func:`alert_rows` to ``log``, as :func:`announcements` has them, without Python.

    Within a micro-batch a row counts by the one before it, in a window; only the first row of a document asks the
    state, a table of what has been announced, of which each batch writes a new version.  So a batch costs as much as
    its rows and the state: this is for batches that are not small beside it.  Batch N writes its part of the log and
    then version N, and both again if it is repeated; :func:`read_news` takes parts whose version is complete.
    """
    order = Window.partitionBy("alert", "document").orderBy(F.asc_nulls_last("at"), F.asc_nulls_last("seq"))
    last = F.struct(F.col("at").isNull(), "at", F.col("seq").isNull(), "seq")
    gone, keys = F.col("kind") == GONE, ["alert", "document"]

    def apply(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        before = current_version(spark, state, below=number)
        seen = spark.createDataFrame([], SEEN) if before is None else spark.read.schema(SEEN).parquet(f"{state}/v{before:012d}")
        judged = batch.withColumns({"_gone": gone, "_before": F.lag(gone).over(order)}).join(seen.withColumn("_seen", F.lit(True)), keys, "left")
        news = F.when(gone, F.lit(FORGOTTEN)).when(F.col("kind") == KNOWN, F.lit(KNOWN)).otherwise(F.lit(ANNOUNCED))
        changed = judged.where(F.col("_gone") != F.coalesce("_before", F.col("_seen").isNull()))
        changed.select(*keys, "at", "seq", news.alias("news")).write.mode("overwrite").parquet(f"{log}/batch={number}")
        latest = batch.groupBy(*keys).agg(F.max_by(gone, last).alias("_gone"))
        kept = seen.join(latest, keys, "left_anti").unionByName(latest.where(~F.col("_gone")).select(*keys))
        kept.write.mode("overwrite").parquet(f"{state}/v{number:012d}")
        while before is not None and (older := current_version(spark, state, below=before)) is not None:
            delete_path(spark, f"{state}/v{older:012d}")

    return rows.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_news(spark: SparkSession, log: str, state: str) -> DataFrame:
    """The log of :func:`log_announcements` as far as its batches are complete."""
    version = current_version(spark, state)
    if version is None:
        return spark.createDataFrame([], LOG)
    return spark.read.schema(f"{LOG}, batch long").parquet(log).where(F.col("batch") <= version).drop("batch")
