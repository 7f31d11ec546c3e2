"""Keeping the index of a folder: what changed since the last time is read, and becomes a generation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.langid import language
from ..functions.text import file_of
from ..session import delete_path
from ..sources import incremental
from ..sources.extract import SEPARATOR, crawl, extract_files
from .index import SearchIndex, _generations, _has, build_index, update_index

KEY = "path"


def documents_of_files(extracted: DataFrame, site_id: str = "") -> DataFrame:
    """The documents table of extracted files; those that were skipped have none."""
    rows = extracted.where("skipped is null")
    path = F.when(F.col("inner").isNotNull(), F.concat("path", F.lit(SEPARATOR), "inner")).otherwise(F.col("path"))
    name = F.regexp_extract(path, r"([^/›]*)$", 1)
    return rows.select(
        F.lit(site_id).alias("site_id"), path.alias("path"), F.col("path").alias("file"), "inner", F.trim(name).alias("name"), F.array_distinct(F.array(F.trim(name), F.regexp_extract("path", "([^/]*)$", 1))).alias("name_raw"),
        "kind", language(F.col("text")).alias("lang"), F.coalesce("size", F.lit(0)).alias("size"), F.coalesce("modified", F.lit(0)).alias("modified"), F.lit(0).cast("long").alias("created"), F.coalesce("text", F.lit("")).alias("body"),
    )


def manifest_path(folder: str, number: int) -> str:
    return f"{folder}/manifest-{number:06d}"


def _manifest(spark: SparkSession, folder: str, upto: int) -> DataFrame | None:
    """The listing that belongs to the latest complete generation; merged generations keep that of their batch."""
    root = spark._jvm.org.apache.hadoop.fs.Path(folder)
    names = [s.getPath().getName() for s in root.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(root)]
    numbers = [int(n[9:]) for n in names if n.startswith("manifest-") and _has(spark, f"{folder}/{n}/_SUCCESS")]
    found = max((n for n in numbers if n <= upto), default=None)
    for n in numbers:
        if found is not None and n < found:
            delete_path(spark, manifest_path(folder, n))
    return None if found is None else spark.read.schema("site_id string, path string, size long, modified long").parquet(manifest_path(folder, found))


def sync_folder(spark: SparkSession, root: str, folder: str, site_id: str = "", exclusions: list[str] | None = None) -> SearchIndex:
    """The index of a folder's files in ``folder``, brought up to date.

    The files that are there are compared with those of the last time by size and time.  New and changed files are read,
    and only these; their documents and those of files that went are a batch of :func:`update_index`.  The listing is
    written before the batch counts, under its number, so a batch that was interrupted is done again.  Without a change
    nothing is written.
    """
    listing = crawl(spark, root, exclusions).select(F.lit(site_id).alias("site_id"), "path", "size", "modified")
    numbers = list(_generations(spark, folder)) if _has(spark, folder) else []
    manifest = _manifest(spark, folder, numbers[-1]) if numbers else None
    if manifest is None:
        listing.write.mode("overwrite").parquet(manifest_path(folder, 0))
        return build_index(documents_of_files(extract_files(spark, root, exclusions), site_id), folder, key=KEY, bodies=True)
    index, number = SearchIndex(spark, folder), numbers[-1] + 1
    listing.write.mode("overwrite").parquet(manifest_path(folder, number))
    now = spark.read.schema(listing.schema).parquet(manifest_path(folder, number))
    changed, removed = incremental.changed(now, manifest).select("path"), incremental.removed(now, manifest).select("path")
    if changed.isEmpty() and removed.isEmpty():
        delete_path(spark, manifest_path(folder, number))
        return index
    lost = changed.unionByName(removed)
    gone = index.documents.select("doc_id", file_of(F.col("doc_id")).alias("path")).join(lost, "path", "left_semi").select(F.col("doc_id").alias(KEY))
    return update_index(index, documents_of_files(extract_files(spark, root, exclusions, changed), site_id), gone, key=KEY)
