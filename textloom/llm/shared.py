"""What the operators of this subpackage have in common: the shared folder and row keys."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.session import delete_path, discard, materialize, new_path, return_memory, shared_root

__all__ = ["delete_path", "discard", "materialize", "new_path", "one_task_each", "open_fs", "read_table", "return_memory", "row_tag", "shared_root", "text_slices", "write_atomically"]


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def row_tag(id_col: str, text_col: str) -> Column:
    """A key beside the id for rows that share an id: rows equal in id and text get one key."""
    return F.xxhash64(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")))


def one_task_each(files: DataFrame) -> DataFrame:
    """A small table with each row, which names a file, in a partition of its own."""
    spark, rows = files.sparkSession, files.collect()
    return spark.createDataFrame(spark.sparkContext.parallelize(rows, max(1, len(rows))), files.schema)


def text_slices(batch, most: int):
    """Slices of a batch whose texts, the second column, have about ``most`` bytes; one text can have more."""
    at, size = 0, 0
    for i, text in enumerate(batch.column(1)):
        size += len(text.as_buffer()) if text.is_valid else 0
        if size >= most:
            yield batch.slice(at, i + 1 - at)
            at, size = i + 1, 0
    if at < batch.num_rows:
        yield batch.slice(at)


def open_fs(uri: str):
    """(filesystem, path) of pyarrow for a URI or a plain path, to be used inside tasks."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def write_atomically(uri: str, write) -> None:
    """Let ``write(stream)`` fill a temporary sibling of ``uri``, then rename it.

    A task that is repeated after a lost executor replaces the file with equal bytes.
    """
    from pyarrow import fs

    filesystem, path = open_fs(uri)
    folder = path.rpartition("/")[0]
    filesystem.create_dir(folder, recursive=True)
    own = f"{path}.{uuid.uuid4().hex[:8]}.tmp"
    with filesystem.open_output_stream(own, compression=None) as stream:
        write(stream)
    if filesystem.get_file_info(path).type != fs.FileType.NotFound:
        filesystem.delete_file(path)  # some file systems do not rename onto a file
    filesystem.move(own, path)
