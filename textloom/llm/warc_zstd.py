"""WARC archives with dictionary compression.

A file begins with a Zstandard dictionary in a skippable frame (magic 0x184D2A5D), built from the
first records of the file; each record follows as a frame of its own that uses the dictionary, so a
reader can start at any record.  Records of equal payloads are written once: one is the response, the
others are revisits that refer to it.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from functools import partial
from itertools import chain

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import materialize, new_path, one_task_each, open_fs, write_atomically

DICTIONARY_FRAME = 0x184D2A5D
#: Payloads of fewer bytes are always written in full.
REVISIT_BYTES = 1000
#: The dictionary's size, and the records and bytes at a file's start that it is built from.
DICTIONARY_BYTES, SAMPLE_RECORDS, SAMPLE_BYTES = 1 << 16, 400, 4 << 20
#: A file is closed once it holds so many bytes.
FILE_BYTES = 512 << 20

_CONTROL = re.compile(r"[\x00-\x20\x7f]")


def _record(page_id, url, payload: bytes, digest: str, response) -> bytes:
    """One WARC/1.1 record; ``response`` is the id that a revisit refers to, or None."""
    sha1 = base64.b32encode(bytes.fromhex(digest)).decode()
    kind = "response" if response is None else "revisit"
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n" + f"Content-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if response is None else b"")
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", "WARC-Date: 1970-01-01T00:00:00Z"]
    if url is not None:
        head.append("WARC-Target-URI: " + _CONTROL.sub(lambda m: f"%{ord(m[0]):02X}", url))
    head += [f"WARC-Payload-Digest: sha1:{sha1}", f"WARC-Payload-Length: {len(payload)}"]
    if response is not None:
        head += [f"WARC-Refers-To: <urn:page:{response}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return ("\r\n".join(head) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> dict:
    """Fields of one record; the payload's length and digest come from the payload where there is one."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    payload = block.partition(b"\r\n\r\n")[2]
    whole = fields["WARC-Type"] == "response"
    digest = hashlib.sha1(payload).hexdigest() if whole else base64.b32decode(fields["WARC-Payload-Digest"][5:]).hex()
    if whole and base64.b32encode(bytes.fromhex(digest)).decode() != fields["WARC-Payload-Digest"][5:]:
        raise ValueError("a payload does not fit its digest")
    number = lambda key: int(fields[key][10:-1]) if fields.get(key, "<urn:page:>") != "<urn:page:>" else None
    return {
        "page_id": number("WARC-Record-ID"), "url": fields.get("WARC-Target-URI"), "record_type": fields["WARC-Type"], "refers_to": number("WARC-Refers-To"),
        "payload": payload if whole else None, "payload_bytes": len(payload) if whole else int(fields["WARC-Payload-Length"]), "payload_digest": digest,
    }


def build_dictionary(records: list[bytes]) -> bytes:
    """A Zstandard dictionary of sample records; raw content where they are too few to train on."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, records, k=512, d=8, level=3).as_bytes()
    except zstandard.ZstdError:
        return b"".join(records)[-DICTIONARY_BYTES:].ljust(8, b" ")


def write_archive(stream, records) -> int:
    """Write an iterator of records until FILE_BYTES; return how many were written."""
    sample, size, n, place = [], 0, 0, 0
    for record in records:
        sample.append(record)
        size += len(record)
        if len(sample) >= SAMPLE_RECORDS or size >= SAMPLE_BYTES:
            break
    if not sample:
        return 0
    content = build_dictionary(sample)
    stream.write(struct.pack("<II", DICTIONARY_FRAME, len(content)) + content)
    squeeze = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(content), write_content_size=True)

    def put(record):
        nonlocal n, place
        place += stream.write(squeeze.compress(record))
        n += 1

    for record in sample:
        put(record)
    del sample
    while place < FILE_BYTES and (record := next(records, None)) is not None:
        put(record)
    return n


#: Bytes that are read, and given to the decompressor, at a time; what a frame leaves of the latter is copied.
READ_BYTES, FEED_BYTES = 1 << 20, 1 << 14


def read_archive(stream):
    """Yield the records of an open archive, one frame at a time.

    An archive that ends within its head, its dictionary or a record is an error, not a shorter archive.
    """
    head = stream.read(8)
    magic, size = struct.unpack("<II", head) if len(head) == 8 else (None, 0)
    if magic != DICTIONARY_FRAME:
        raise ValueError("the archive does not begin with a dictionary")
    content = stream.read(size)
    if len(content) < size:
        raise ValueError("the archive ends within its dictionary")
    open_up = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(content))
    frame, out, begun = open_up.decompressobj(), [], False
    while whole := stream.read(READ_BYTES):
        view = memoryview(whole)
        for at in range(0, len(view), FEED_BYTES):
            held = view[at : at + FEED_BYTES]
            while held:
                out.append(frame.decompress(held))
                begun, held = not frame.eof, frame.unused_data if frame.eof else b""
                if frame.eof:
                    yield b"".join(out)
                    out, frame = [], open_up.decompressobj()
    if begun:
        raise ValueError("the archive ends within a record")


def _write_batches(batches, folder: str):
    from pyspark import TaskContext

    # each attempt writes files of its own; the index names those of the attempt that counts
    task, attempt = TaskContext.get().partitionId(), TaskContext.get().taskAttemptId()

    def records():
        for batch in batches:
            for page_id, url, html, digest, response in zip(*batch.columns):
                yield _record(page_id.as_py(), url.as_py(), (html.as_py() or "").encode("utf-8"), digest.as_py(), response.as_py())

    source, number, wrote = records(), 0, [1]
    while wrote[0]:
        path = f"{folder}/pages-{task:06d}-{attempt}-{number:04d}.warc.zst"
        first = next(source, None)
        if first is None:
            break
        # chain does not close the source when it is freed; a generator that delegates would, and end the task's records
        write_atomically(path, lambda stream, rows=chain([first], source): wrote.__setitem__(0, write_archive(stream, rows)))
        yield pa.RecordBatch.from_pydict({"path": [path], "n_records": [wrote[0]]}, pa.schema([("path", pa.string()), ("n_records", pa.int64())]))
        number += 1


def plan_records(pages: DataFrame, revisit_bytes: int = REVISIT_BYTES) -> DataFrame:
    """(page_id, url, html, digest, response): response is null where the record is written in full.

    Of pages with equal payloads of at least ``revisit_bytes`` bytes that of the largest id is written
    in full.  Digests of repeated payloads are found by a map-side combined aggregate and joined from
    a written table, so a payload of very many pages can be split.
    """
    digest = F.sha1(F.coalesce("html", F.lit("")))
    long = F.octet_length(F.coalesce("html", F.lit(""))) >= revisit_bytes
    repeated = pages.where(long).groupBy(digest.alias("same")).agg(F.max("page_id").alias("response"), F.count("*").alias("n")).where("n > 1").select("same", "response")
    repeated = materialize(repeated, "repeated-payloads")
    rows = pages.select("page_id", "url", "html", digest.alias("digest"))
    joined = rows.join(repeated, (F.col("digest") == F.col("same")), "left")
    return joined.select("page_id", "url", "html", "digest", F.when(~F.col("page_id").eqNullSafe(F.col("response")), F.col("response")).alias("response"))


def write_warc(pages: DataFrame, folder: str) -> DataFrame:
    """Write ``pages(page_id, url, html)`` as archives into ``folder``; return (path, n_records).

    A null html is an empty payload and a null url has no target; rows with a null id in a group of
    equal payloads revisit the largest id, rows of the largest id are all responses.  Each task fills
    its own files and renames them into place; a repeated task's files stand beside those that the index names.  An empty table writes no file.  Other columns are
    ignored.
    """
    return materialize(plan_records(pages).mapInArrow(partial(_write_batches, folder=folder), "path string, n_records long"), "warc-index")


def _read_batches(batches, keep_payload: bool):
    fields = [("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string())]
    kind = pa.schema([*fields, *([("payload", pa.binary())] if keep_payload else [])])
    for batch in batches:
        for path, wanted in zip(*(c.to_pylist() for c in batch.columns)):
            filesystem, name = open_fs(path)
            rows, size, n = [], 0, 0
            with filesystem.open_input_stream(name, compression=None) as stream:
                for raw in read_archive(stream):
                    rows.append(parse_record(raw))
                    size, n = size + len(raw), n + 1
                    if size > 8 << 20 or len(rows) >= 4096:
                        yield pa.RecordBatch.from_pylist(rows, kind)
                        rows, size = [], 0
            if n != wanted:
                raise ValueError(f"{path} has {n} records, not {wanted}")
            yield pa.RecordBatch.from_pylist(rows, kind)


def read_warc(index: DataFrame, keep_payload: bool = True) -> DataFrame:
    """The records of the archives in ``index(path, n_records)``, one task for each file; a revisit has no payload.

    An archive that is missing, cut, or holds another number of records than the index says is an error; so is a
    payload that does not fit its digest.  An empty index gives no rows.
    """
    schema = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string" + ", payload binary" * keep_payload
    return one_task_each(index.select("path", "n_records")).mapInArrow(partial(_read_batches, keep_payload=keep_payload), schema)


def archive_report(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Write all pages into the shared folder and report what the archives hold."""
    index = write_warc(pages.select("page_id", "url", "html"), new_path(spark, "warc"))
    return read_warc(index, keep_payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = """
WITH p AS (SELECT page_id, sha1(coalesce(html, '')) AS d, strlen(coalesce(html, '')) AS n FROM pages),
m AS (SELECT d, max(page_id) AS r FROM p WHERE n >= 1000 GROUP BY d HAVING count(*) > 1)
SELECT page_id, n AS payload_bytes, p.d AS payload_digest,
       CASE WHEN r IS NULL OR r = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN r <> page_id THEN r END AS refers_to
FROM p LEFT JOIN m ON p.d = m.d
"""
