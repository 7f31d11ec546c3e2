"""SimHash near-duplicates by multi-index hashing.

Fingerprints that differ in at most three of 64 bits agree, in one of their two 32-bit segments, up
to one bit.  Every distinct fingerprint is stored in a table under both segments.  A search
enumerates the Hamming ball of radius one around each segment, fetches the table's matches by an
equi-join, and verifies complete distances.  A ball is halved: of two segments that differ in one
bit, only the one whose bit is clear enumerates, which finds the same pairs once.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .graph import connected_components
from .shared import discard, materialize, row_tag

SEED = 42
SHINGLE = 3
#: Links join fingerprints that differ in at most so many bits; the two segments need 3 or fewer.
MAX_BITS = 3
#: A segment value with more distinct fingerprints is searched by a further byte of the other half.
HOT_SEGMENT = 64

_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)
_WEIGHT = np.left_shift(np.uint64(1), np.arange(63, -1, -1, dtype=np.uint64))


def fingerprint(text: str | None, width: int = SHINGLE) -> int:
    """The unsigned fingerprint of one text; zero for a text without words (null and empty too)."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(words) - width + 1)
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts[:n].tolist(), ends[-n:].tolist())], dtype=">u8").view(np.uint8).reshape(n, 8)
    if n < 64:
        ones = np.unpackbits(hashes, axis=1).sum(axis=0, dtype=np.int64)
    else:
        ones = np.concatenate([np.bincount(hashes[:, j], minlength=256) @ _BITS for j in range(8)])
    return int(_WEIGHT[2 * ones > n].sum(dtype=np.uint64))


def _fingerprint_batches(batches, width: int):
    for batch in batches:
        values = np.array([fingerprint(t.as_py(), width) for t in batch.column(1)], dtype=np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values, pa.int64())], ["id", "fp"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = SHINGLE) -> DataFrame:
    """(id, fp): the fingerprint of each row as a signed long, whole texts, in Arrow batches."""
    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("fp", T.LongType())])
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(partial(_fingerprint_batches, width=width), schema)


def _segments(fps: DataFrame) -> DataFrame:
    """(fp, seg, key, other): both 32-bit halves of each fingerprint."""
    high, low = F.shiftrightunsigned("fp", 32), F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF))
    return fps.select("fp", F.posexplode(F.array(F.struct(high.alias("key"), low.alias("other")), F.struct(low.alias("key"), high.alias("other")))).alias("seg", "half")).select("fp", "seg", "half.key", "half.other")


def _refine(rows: DataFrame, hot: DataFrame) -> DataFrame:
    """Under a hot segment value, one row for each byte of the other half; else one row.

    The other halves of a link differ in at most three bits, so one of their four bytes is equal.
    """
    parts = F.array(*[F.shiftright("other", 8 * j).bitwiseAND(F.lit(255)) + F.lit(256 * j) for j in range(4)])
    joined = rows.join(hot, ["seg", "key"], "left")
    return joined.select("fp", "seg", "key", F.explode(F.when(F.col("hot"), parts).otherwise(F.array(F.lit(-1).cast("long")))).alias("part"))


def linked_fingerprints(fps: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """(a, b): all pairs of distinct values of ``fps(fp long)`` within ``max_bits`` (3 or fewer)."""
    if not 0 <= max_bits <= 3:
        raise ValueError("two segments with balls of radius one find up to three differing bits")
    table = _segments(fps)
    hot = materialize(table.groupBy("seg", "key").count().where(F.col("count") > HOT_SEGMENT).select("seg", "key", F.lit(True).alias("hot")), "hot")
    flips = F.filter(F.transform(F.sequence(F.lit(0), F.lit(31)), lambda i: F.col("key").bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), i))), lambda k: k != F.col("key"))
    probes = table.select("fp", "seg", "other", F.col("key").alias("own"), F.explode(F.concat(F.array("key"), flips)).alias("key"))
    left = _refine(probes.select("seg", "key", "other", F.struct("fp", (F.col("own") == F.col("key")).alias("same")).alias("fp")), hot)
    right = _refine(table, hot).select("seg", "key", "part", F.col("fp").alias("b"))
    # the planner's size of a side leaves out the explosions, so it would broadcast many times its limit
    found = left.select("seg", "key", "part", F.col("fp.fp").alias("a"), "fp.same").hint("merge").join(right.hint("merge"), ["seg", "key", "part"])
    # equal segments meet from both sides, so one order is enough; a flipped bit meets from one side only
    found = found.where((F.col("a") != F.col("b")) & (~F.col("same") | (F.col("a") < F.col("b"))) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits))
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bits: int = MAX_BITS) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of ``docs``.

    Texts are lower-cased (A-Z), split at ASCII white space, and hashed in shingles of three words
    with repeats.  component_id is the least id that links reach, the row's own included.  Rows of
    equal fingerprints are one class, so copies are never expanded into pairs; only distinct
    fingerprints are searched.  Null and empty texts have fingerprint zero and link like any other.
    A null id keeps its row but is never a component_id unless the component has no other id.
    Repeated rows are returned as often as they come; an empty table gives an empty result; other
    columns are ignored.
    """
    own = materialize(fingerprints(docs, id_col, text_col), "fingerprints")
    classes = materialize(own.groupBy("fp").agg(F.min("id").alias("least")), "classes")
    roots = materialize(connected_components(linked_fingerprints(classes.select("fp"), max_bits)), "roots")
    rooted = classes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    rooted = materialize(rooted, "rooted")
    component = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    of_class = materialize(rooted.join(component, "root").select("fp", "component_id"), "components")
    discard(classes, roots, rooted)
    out = own.join(of_class, "fp", "left")
    return out.select(F.col("id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bits: int = MAX_BITS) -> DataFrame:
    """One row of ``docs`` for each component of linked fingerprints; all columns stay.

    It is the row of the least id, null last, and of the least text key where texts share an id; of rows
    equal in id and text, one stays.  Null and empty texts are one component.  An empty table stays empty.
    """
    keyed = docs.select(F.col(id_col).alias("id"), row_tag(id_col, text_col).alias("tag"), F.col(text_col).alias("text"))
    key = T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("tag", T.LongType())])
    own = materialize(fingerprints(keyed.select(F.struct("id", "tag").cast(key).alias("key"), "text"), "key", "text").select("id.id", "id.tag", "fp"), "fingerprints")
    roots = materialize(connected_components(linked_fingerprints(own.select("fp").distinct(), max_bits)), "roots")
    rows = own.groupBy("fp", "id", "tag").agg(F.count("*").alias("n"))
    rooted = rows.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    first = rooted.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "tag", "n")).alias("m"))
    kept = materialize(first.select(F.col("m.id").alias("_kept_id"), F.col("m.tag").alias("_kept_tag"), F.col("m.n").alias("_kept_n")), "kept")
    discard(own, roots)
    return one_row_each(docs, kept, id_col, row_tag(id_col, text_col), "_kept_tag")


def one_row_each(docs: DataFrame, kept: DataFrame, id_col: str, tag: Column, tag_name: str) -> DataFrame:
    """The rows of ``docs`` that ``kept(_kept_id, tag_name, _kept_n)`` names; of ``_kept_n`` equal ones, one.

    Only rows that repeat are grouped again, the others are not shuffled for it.  ``kept`` has a row for each
    group and grows with the table, so it is never broadcast.
    """
    at = docs[id_col].eqNullSafe(kept["_kept_id"]) & (tag == kept[tag_name])
    single = docs.join(kept.where("_kept_n = 1").hint("merge"), at, "left_semi")
    several = docs.join(kept.where("_kept_n > 1").hint("merge"), at).drop("_kept_n").dropDuplicates(["_kept_id", tag_name])
    return single.unionByName(several.select(*docs.columns))
