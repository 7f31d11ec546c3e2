"""Token-ID files: frequency-ranked ids in byte-aligned variable-length coding.

An id is replaced by its rank in the corpus, the most frequent first, so that common ids need one
byte.  Four ranks share a control byte that holds their lengths less one in two bits each; control
bytes and data bytes are separate runs.  A reader looks the lengths of a control byte up in a table
of 256 rows and expands a whole block with numpy, without a loop over ids.

File: magic ``TLTOKEN1``; n_vocab as u32; the id of each rank as u32; blocks; a footer; the footer's
place as u64.  A block is its control bytes, then its data bytes.  The footer is
``n_docs, n_blocks`` as u64, then per document its id (i64), whether the id is null (u8), its number
of ids (u64), and per block its place, first document, number of ids and control bytes (u64 each).
All numbers are little-endian.
"""

from __future__ import annotations

import struct
import zlib
from functools import partial

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .piece_cache import PieceEncoder
from .shared import discard, materialize, new_path, one_task_each, open_fs, text_slices, write_atomically

MAGIC = b"TLTOKEN1"
#: Ids of a block; a document is never cut, so a block can hold one longer document.
BLOCK_IDS = 1 << 18
#: About so many ids go into one file; it sets the number of files.
FILE_IDS = 1 << 24
#: Bytes of text that are encoded together.
BATCH_BYTES = 4 << 20

_LENGTHS = (np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3).astype(np.uint8) + 1
_FILLED = np.arange(4) < np.arange(5)[:, None]


def pack(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """(control bytes, data bytes) of unsigned 32-bit values."""
    ranks = np.ascontiguousarray(ranks, "<u4")
    extra = (ranks > 0xFF).astype(np.uint8) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    data = ranks.view(np.uint8).reshape(-1, 4)[_FILLED[extra + 1]]
    four = np.zeros(-(-len(ranks) // 4) * 4, np.uint8)
    four[: len(ranks)] = extra
    four = four.reshape(-1, 4)
    return (four[:, 0] | four[:, 1] << 2 | four[:, 2] << 4 | four[:, 3] << 6).astype(np.uint8).tobytes(), data.tobytes()


def unpack(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The ``n`` values of :func:`pack`, by table lookup."""
    lengths = _LENGTHS[np.frombuffer(control, np.uint8)].reshape(-1)[:n]
    out = np.zeros((n, 4), np.uint8)
    out[_FILLED[lengths]] = np.frombuffer(data, np.uint8, int(lengths.sum(dtype=np.int64)))
    return out.view("<u4").reshape(-1)


def _encode_batches(batches, path: str, end_id: int):
    """Ids of each text with the end id, as zstd-compressed 16- or 32-bit integers."""
    encoder, squeeze = PieceEncoder.of(path), zstandard.ZstdCompressor(level=3)
    kind = "<u2" if max(encoder.tokenizer.get_vocab_size(), end_id + 1) <= 1 << 16 else "<u4"
    for batch in batches:
        for part in text_slices(batch, BATCH_BYTES):
            blobs = [squeeze.compress(np.append(ids, np.uint32(end_id)).astype(kind).tobytes()) for ids in encoder.encode_many(part.column(1))]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([np.dtype(kind).itemsize] * len(blobs), pa.int32()), pa.array(blobs, pa.binary())], ["id", "width", "ids"])


def _ids(blob: bytes, width: int, open_up=zstandard.ZstdDecompressor()) -> np.ndarray:
    return np.frombuffer(open_up.decompress(blob), f"<u{width}")


def _count_batches(batches):
    total = np.zeros(0, np.int64)
    for batch in batches:
        for at in range(0, batch.num_rows, 256):  # ids of many texts are counted at once
            part = batch.slice(at, 256)
            counts = np.bincount(np.concatenate([_ids(blob.as_py(), width.as_py()) for blob, width in zip(*part.columns)]))
            if len(counts) > len(total):
                total, counts = counts.astype(np.int64), total
            total[: len(counts)] += counts
    used = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used], pa.int64())], ["token", "n"])


def _write_file(stream, rows, rank_of: np.ndarray, id_of: np.ndarray) -> dict:
    """Write rows of (doc id or None, ids) and return what the file holds."""
    stream.write(MAGIC + struct.pack("<I", len(id_of)) + id_of.astype("<u4").tobytes())
    place, docs, blocks, held, count = 12 + 4 * len(id_of), [], [], [], 0

    def flush():
        nonlocal place, held, count
        if held:
            control, data = pack(np.concatenate(held))
            stream.write(control + data)
            blocks.append((place, len(docs) - len(held), count, len(control)))
            place += len(control) + len(data)
            held, count = [], 0

    for doc_id, ids in rows:
        if count and count + len(ids) > BLOCK_IDS:
            flush()
        docs.append((doc_id or 0, doc_id is None, len(ids)))
        held.append(rank_of[ids])
        count += len(ids)
    flush()
    ids, null, n = zip(*docs) if docs else ((), (), ())
    stream.write(struct.pack("<QQ", len(docs), len(blocks)) + np.array(ids, "<i8").tobytes() + np.array(null, np.uint8).tobytes() + np.array(n, "<u8").tobytes() + np.array(blocks, "<u8").tobytes() + struct.pack("<Q", place))
    return {"n_docs": len(docs), "n_ids": int(sum(n))}


def read_file(stream):
    """Yield (doc id or None, ids) from an open file, block by block."""
    stream.seek(0)
    if stream.read(8) != MAGIC:
        raise ValueError("not a token file")
    id_of = np.frombuffer(stream.read(4 * struct.unpack("<I", stream.read(4))[0]), "<u4")
    size = stream.size()
    stream.seek(size - 8)
    foot = struct.unpack("<Q", stream.read(8))[0]
    stream.seek(foot)
    n_docs, n_blocks = struct.unpack("<QQ", stream.read(16))
    ids, null, n = np.frombuffer(stream.read(8 * n_docs), "<i8"), np.frombuffer(stream.read(n_docs), np.uint8), np.frombuffer(stream.read(8 * n_docs), "<u8").astype(np.int64)
    blocks = np.frombuffer(stream.read(32 * n_blocks), "<u8").reshape(-1, 4).astype(np.int64)
    for k, (place, first, count, n_control) in enumerate(blocks):
        stream.seek(int(place))
        until = blocks[k + 1][0] if k + 1 < n_blocks else foot
        body = stream.read(int(until - place))
        values = id_of[unpack(body[:n_control], body[n_control:], int(count))]
        last = int(blocks[k + 1][1]) if k + 1 < n_blocks else n_docs
        for d, part in zip(range(int(first), last), np.split(values, np.cumsum(n[first:last])[:-1])):
            yield (None if null[d] else int(ids[d])), part


def _write_batches(batches, folder: str, id_of: np.ndarray):
    from pyspark import TaskContext

    rank_of = np.zeros(int(id_of.max(initial=0)) + 1, np.uint32)
    rank_of[id_of] = np.arange(len(id_of), dtype=np.uint32)
    context = TaskContext.get()
    number = context.partitionId()
    # each attempt writes a file of its own; the index names that of the attempt that counts
    path, held = f"{folder}/tokens-{number:06d}-{context.taskAttemptId()}.tlt", {}

    def rows():
        for batch in batches:
            for doc_id, width, blob in zip(*batch.columns):
                yield doc_id.as_py(), _ids(blob.as_py(), width.as_py())

    write_atomically(path, lambda stream: held.update(_write_file(stream, rows(), rank_of, id_of)))
    if held["n_docs"]:
        yield pa.RecordBatch.from_pylist([{"file": number, "path": path, **held}], pa.schema([("file", pa.int64()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())]))


def write_token_files(docs: DataFrame, tokenizer_path: str, folder: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode ``docs`` and write token files; return their index (path, start, n_docs, n_ids).

    Whole texts are encoded, null as empty, and ``end_id`` ends each document.  Files hold ascending
    ids, null ids first, rows of equal ids ordered by their compressed ids, and ranges of files do not
    overlap; ``start`` is the number of ids before a file.  Document ids are longs.  An empty table writes
    no rows.  Only the counts by token, of which there are as many as the vocabulary has, and one row per
    file come to the driver.  A repeated task writes a file of its own, of which the index takes one.
    Strings of added tokens in a text are read as the library reads them by default.  Other columns are
    ignored.
    """
    spark = docs.sparkSession
    wide = T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("width", T.IntegerType()), T.StructField("ids", T.BinaryType())])
    encoded = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(partial(_encode_batches, path=tokenizer_path, end_id=end_id), wide)
    encoded = materialize(encoded, "ids", compression="none")
    counts = encoded.select("ids", "width").mapInArrow(_count_batches, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).collect()
    counts.sort(key=lambda r: (-r["n"], r["token"]))
    id_of = np.array([r["token"] for r in counts], np.int64)
    parts = max(1, -(-sum(r["n"] for r in counts) // FILE_IDS), spark.sparkContext.defaultParallelism)
    ranged = encoded.repartitionByRange(parts, F.col("id").asc_nulls_first()).sortWithinPartitions(F.col("id").asc_nulls_first(), "ids")
    index = materialize(ranged.mapInArrow(partial(_write_batches, folder=folder, id_of=id_of), "file long, path string, n_docs long, n_ids long"), "index")
    discard(encoded)
    start, rows = 0, []
    for r in index.orderBy("file").collect():
        rows.append((r["path"], start, r["n_docs"], r["n_ids"]))
        start += r["n_ids"]
    return spark.createDataFrame(rows, "path string, start long, n_docs long, n_ids long")


def _read_batches(batches):
    for batch in batches:
        for path, start in zip(batch.column(0), batch.column(1)):
            filesystem, name = open_fs(path.as_py())
            at, rows, held = start.as_py(), [], 0
            with filesystem.open_input_file(name) as stream:
                for doc_id, ids in read_file(stream):
                    rows.append((doc_id, at, ids))
                    at += len(ids)
                    held += len(ids)
                    if held > BLOCK_IDS or len(rows) >= 1024:
                        yield rows
                        rows, held = [], 0
            yield rows


def _digest_batches(batches):
    kind = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])
    for rows in _read_batches(batches):
        cols = [[r[0] for r in rows], [r[1] for r in rows], [len(r[2]) for r in rows], [zlib.crc32(r[2].astype("<u4").tobytes()) for r in rows]]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], schema=kind)


def _id_batches(batches):
    kind = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("ids", pa.list_(pa.int64()))])
    for rows in _read_batches(batches):
        yield pa.RecordBatch.from_pylist([{"doc_id": a, "start": b, "ids": c.astype(np.int64)} for a, b, c in rows], kind)


def read_token_files(index: DataFrame) -> DataFrame:
    """(doc_id, start, ids) of every document of the files in ``index``, one task for each file."""
    return _one_task_each(index).mapInArrow(_id_batches, "doc_id long, start long, ids array<long>")


def digest_token_files(index: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) read from the files in ``index``."""
    return _one_task_each(index).mapInArrow(_digest_batches, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _one_task_each(index: DataFrame) -> DataFrame:
    return one_task_each(index.select("path", "start"))


def token_file_digests(spark: SparkSession, docs: DataFrame, tokenizer_path: str, end_id: int = 2) -> DataFrame:
    """Write ``docs`` as token files into the shared folder and digest what the files hold."""
    return digest_token_files(write_token_files(docs, tokenizer_path, new_path(spark, "token-files"), end_id))
