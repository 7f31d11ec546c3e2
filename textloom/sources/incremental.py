"""What changed between a crawl and the manifest of what is indexed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of an older version are read again; the version of rows that are written now.
VERSION = 10
KEYS = ["site_id", "path"]


def changed(crawl: DataFrame, manifest: DataFrame) -> DataFrame:
    """Files that are new, or of another size or time, or of an older manifest version."""
    known = manifest.select("site_id", "path", F.col("size").alias("_size"), F.col("modified").alias("_modified"), (F.col("version") if "version" in manifest.columns else F.lit(VERSION)).alias("_version"))
    same = (F.col("_size") == F.col("size")) & (F.col("_modified") == F.col("modified")) & (F.col("_version") >= VERSION)
    return crawl.join(known, KEYS, "left").where(~F.coalesce(same, F.lit(False))).select(*crawl.columns)


def removed(crawl: DataFrame, manifest: DataFrame, missing_sites: list[str] | None = None) -> DataFrame:
    """Files of the manifest that a crawl no longer sees; those of a missing root are kept."""
    rows = manifest.where(~F.col("site_id").isin(missing_sites)) if missing_sites else manifest
    return rows.join(crawl, KEYS, "left_anti")


def rollup(manifest: DataFrame) -> DataFrame:
    """(site_id, files, docs, bytes, skipped): skipped counts files by reason."""
    reasons = manifest.groupBy("site_id", "skipped").agg(F.count("*").alias("n"), F.sum("docs").alias("docs"), F.sum("size").alias("bytes"))
    reason = F.when(F.col("skipped").isNotNull(), F.struct("skipped", "n"))
    return reasons.groupBy("site_id").agg(
        F.sum("n").alias("files"), F.sum("docs").alias("docs"), F.sum(F.when(F.col("skipped").isNull(), F.col("bytes"))).cast("long").alias("bytes"), F.map_from_entries(F.collect_list(reason)).alias("skipped")
    )


def upsert(documents: DataFrame, fresh: DataFrame, gone: DataFrame, keys: tuple[str, ...] = ("site_id", "file")) -> DataFrame:
    """Documents after a batch: those of changed and removed files go, the fresh ones come."""
    touched = fresh.select(*keys).unionByName(gone.select(*keys)).distinct()
    return documents.join(touched, list(keys), "left_anti").unionByName(fresh.select(*documents.columns))


def remap_paths(rows: DataFrame, old: str, new: str, column: str = "path") -> DataFrame:
    """Paths under a drive or root moved to another, whatever the case of the old one."""
    import re

    pattern = "(?i)^((?:\\\\\\\\\\?\\\\)?)" + re.escape(old.rstrip("\\/")) + "(?=[\\\\/]|$)"
    return rows.withColumn(column, F.regexp_replace(column, pattern, "$1" + new.rstrip("\\/").replace("\\", "\\\\").replace("$", "\\$")))
