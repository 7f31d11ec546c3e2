"""A table of folders in pre-order, so that "within a folder" is a range of numbers and a moved root rewrites folders only.

Folders are numbered in the order of their paths with the separator before all other characters, so those within a folder
follow it at once: it holds exactly the numbers from its own to the last of its descendants.  Documents carry the number of
their folder and are stored in its order; a folder's documents are then a range that Parquet's statistics prune.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import file_of
from ..session import materialize
from .incremental import remap_paths

NONE = -1


def _slashes(path: Column) -> Column:
    return F.translate(path, "\\", "/")


def _holding(path: Column) -> Column:
    """The folder of a document: what stands before the last separator of its file; empty at the top."""
    file = _slashes(file_of(path))
    return F.when(F.contains(file, F.lit("/")), F.regexp_replace(file, "/[^/]*$", "")).when(file.isNotNull(), F.lit(""))


def _upwards(folder: Column) -> Column:
    """A folder and all above it, the top (empty) first."""
    parts = F.split(folder, "/", -1)
    return F.array_distinct(F.array_append(F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), "/")), folder))


def folder_tree(docs: DataFrame, path: str = "path") -> DataFrame:
    """(folder, number, key, low, high, documents): every folder of a document and those above.

    ``low`` to ``high`` are the numbers of the folders at or under it.  ``key`` is the lower-cased folder by which it is
    asked for; folders that differ in case alone have numbers of their own side by side, and one range.  ``documents``
    counts those directly in it.  Numbers need not be dense, so sorted ranges of the folders are numbered where they
    lie, and nothing passes through one task.  A null path has no folder; no documents give an empty tree.
    """
    direct = docs.where(F.col(path).isNotNull()).groupBy(_holding(F.col(path)).alias("folder")).agg(F.count("*").alias("documents"))
    every = direct.select(F.explode(_upwards(F.col("folder"))).alias("folder")).distinct().join(direct, "folder", "left")
    keyed = every.select("folder", F.lower("folder").alias("key"), F.coalesce("documents", F.lit(0)).alias("documents"))
    ordered = keyed.withColumn("order", F.translate("key", "/", "\x01"))
    ranged = ordered.repartitionByRange("order", "folder").sortWithinPartitions("order", "folder").drop("order")
    numbered = materialize(ranged.withColumn("number", F.monotonically_increasing_id()), "folder-numbers")
    first = numbered.groupBy("key").agg(F.min("number").alias("low"))
    last = numbered.select("number", F.explode(_upwards(F.col("key"))).alias("key")).groupBy("key").agg(F.max("number").alias("high"))
    return numbered.join(first, "key").join(last, "key").select("folder", "number", "key", "low", "high", "documents")


def place_documents(docs: DataFrame, tree: DataFrame, path: str = "path") -> DataFrame:
    """Documents without their folders' paths: ``folder`` is its number, ``rest`` the path within it, in the order of the numbers.

    A null path has the number ``NONE`` and is within no folder.  A folder of very many documents is several ranges.
    """
    own = _holding(F.col(path))
    length = F.when(own == "", F.lit(0)).otherwise(F.length(own) + 1)
    cut = docs.withColumns({"_folder": own, "rest": F.substring(F.col(path), length + 1, F.length(path))}).drop(path)
    joined = cut.join(tree.select(F.col("folder").alias("_folder"), F.col("number").alias("folder")), "_folder", "left")
    rows = joined.withColumn("folder", F.coalesce("folder", F.lit(NONE).cast("long"))).drop("_folder")
    return rows.repartitionByRange("folder", "rest").sortWithinPartitions("folder")


def within(tree: DataFrame, folder: str, column: str = "folder") -> Column:
    """The range of numbers of a folder, whatever its case; of an unknown one, nothing.  One row reaches the driver."""
    row = tree.where(F.col("key") == folder.replace("\\", "/").rstrip("/").lower()).select("low", "high").limit(1).collect()
    return F.col(column).between(row[0]["low"], row[0]["high"]) if row else F.lit(False)


def full_paths(placed: DataFrame, tree: DataFrame, path: str = "path") -> DataFrame:
    """Documents with their paths again, of the folders as they are called now; separators are slashes."""
    joined = placed.join(tree.select(F.col("number").alias("folder"), F.col("folder").alias("_name")), "folder", "left")
    whole = F.when(F.col("folder") == NONE, F.lit(None)).when(F.col("_name") == "", F.col("rest")).otherwise(F.concat("_name", F.lit("/"), "rest"))
    return joined.withColumn(path, whole).drop("_name", "folder", "rest")


def moved(tree: DataFrame, old: str, new: str) -> DataFrame:
    """The tree after a root moved: folders are renamed, their numbers and all documents stay as they are.

    Ranges of the root and of all folders under it stay right.  A folder that already was above the new place does not
    hold the moved numbers until the tree is built anew.
    """
    renamed = remap_paths(tree, old, new, "folder")
    return renamed.withColumn("key", F.lower("folder"))
