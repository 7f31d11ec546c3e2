"""What operators need of a session: the shared folder, written tables, and the package on its workers."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import from_arrow_type

_SHIPPED: set[str] = set()
_OWN_DIR: dict[str, str] = {}


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where the session names none and has one machine (tests), a temporary folder stands in.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        app = spark.sparkContext.applicationId
        if app not in _OWN_DIR:
            _OWN_DIR[app] = tempfile.mkdtemp(prefix="textloom-")
        root = _OWN_DIR[app]
    return root.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_root(spark)}/textloom/{label}-{uuid.uuid4().hex[:12]}"


def materialize(df: DataFrame, label: str, **options: str) -> DataFrame:
    """Write ``df`` to a table in the shared folder and read it again.

    This cuts the lineage with replicated files, gives the planner true sizes, and puts a plain
    scan below a join, so that adaptive execution can split a skewed side of it.
    """
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.options(**options).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._textloom_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables of :func:`materialize` that no returned plan reads any more."""
    for table in tables:
        path = getattr(table, "_textloom_path", None)
        if path:
            delete_path(table.sparkSession, path)


def delete_path(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def ship_package(spark: SparkSession) -> None:
    """Send this package to the workers once per application, unless their path has it already."""
    root = Path(__file__).resolve().parent.parent
    app = spark.sparkContext.applicationId
    paths = {str(Path(p).resolve()) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p}
    local = spark.sparkContext.master.startswith("local[") and Path.cwd() == root
    if app in _SHIPPED or str(root) in paths or local:
        return
    target = Path(tempfile.mkdtemp(prefix="textloom-")) / "textloom.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as out:
        for path in sorted((root / "textloom").rglob("*.py")):
            out.write(path, path.relative_to(root))
    spark.sparkContext.addPyFile(str(target))
    _SHIPPED.add(app)


#: Items and characters of input after which a task passes on what it has made.
ITEMS_AT_ONCE, CHARACTERS_AT_ONCE = 5_000, 1 << 20


def exploded(rows: DataFrame, keep: list[str], make: Callable[[], Callable[..., list[tuple]]], items: dict[str, pa.DataType]) -> DataFrame:
    """The ``keep`` columns of ``rows`` beside each item, of the columns ``items``, that a function gives for the others.

    ``make`` gives the function of a task.
    """
    others = [c for c in rows.columns if c not in keep]
    schema = ", ".join([*(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep), *(f"`{c}` {from_arrow_type(t).simpleString()}" for c, t in items.items())])

    def run(batches):
        yield from exploded_batches(batches, len(keep), make(), items)
        return_memory()

    return rows.select(*keep, *others).mapInArrow(run, schema)


def exploded_batches(batches: Iterable[pa.RecordBatch], keep: int, function: Callable[..., list[tuple]], items: dict[str, pa.DataType]) -> Iterator[pa.RecordBatch]:
    """The first ``keep`` columns beside the items of each row; rows are read one by one, however large their batch is."""
    for batch in batches:
        names, others = [*batch.schema.names[:keep], *items], batch.columns[keep:]
        of, held, size = [], [], 0
        for i in range(batch.num_rows):
            values = [c[i].as_py() for c in others]
            size += sum(len(v) for v in values if isinstance(v, str))
            made = function(*values)
            of += [i] * len(made)
            held += made
            if len(held) >= ITEMS_AT_ONCE or size >= CHARACTERS_AT_ONCE or i == batch.num_rows - 1:
                kept = [batch.column(c).take(pa.array(of, pa.int64())) for c in range(keep)]
                yield pa.RecordBatch.from_arrays(kept + [pa.array([x[k] for x in held], t) for k, t in enumerate(items.values())], names)
                of, held, size = [], [], 0


def return_memory() -> None:
    """Give freed memory of a Python worker, which outlives its task, back to the machine."""
    import ctypes
    import gc

    import pyarrow

    gc.collect()
    pyarrow.default_memory_pool().release_unused()
    libc = ctypes.CDLL(None)
    if hasattr(libc, "malloc_trim"):
        libc.malloc_trim(0)
