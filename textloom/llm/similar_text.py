"""One document of each group of near copies: SimHash candidates, completed to the exact similarity.

Fingerprints of five-word shingles are searched by multi-index hashing; what they link is verified by the
Jaccard similarity of the complete shingle sets.  That finds copies and slightly altered texts cheaply, but
texts of a similarity of 0.8 differ in about ten of 64 bits, beyond any radius that the index can search.
So a prefix-filtered join of the shingle sets adds the links that the fingerprints miss; it compares only
texts that are not connected yet.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.setjoin import SHINGLE, connecting_pairs, texts_by_key
from .graph import connected_components
from .shared import discard, materialize
from .simhash_mih import fingerprints, linked_fingerprints, one_row_each

#: Texts are linked that have this share of their distinct five-word shingles in common.
SIMILARITY = 0.8


def simhash_candidates(texts: DataFrame, width: int = SHINGLE) -> DataFrame:
    """(a, b): pairs of ``texts(k, text)`` whose fingerprints are equal or linked, each class by its least key."""
    own = materialize(fingerprints(texts, "k", "text", width), "fingerprints")
    least = materialize(own.groupBy("fp").agg(F.min("id").alias("first")), "classes")
    equal = own.join(least, "fp").where("id <> first").select(F.col("first").alias("a"), F.col("id").alias("b"))
    links = linked_fingerprints(least.select("fp"))
    x, y = (least.select(F.col("fp").alias(c), F.col("first").alias(f"first_{c}")) for c in "ab")
    linked = links.join(x, "a").join(y, "b").select(F.col("first_a").alias("a"), F.col("first_b").alias("b"))
    return materialize(equal.unionByName(linked), "simhash-candidates")


def keep_one_of_similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = SIMILARITY) -> DataFrame:
    """One document of each component of texts whose similarity reaches the threshold; all columns stay.

    It is the one of the least id, null last, and of the least text key where texts share an id; of rows
    equal in id and text, one stays.  Null, empty and blank texts are one component.  Texts are taken whole
    at any length.  An empty table stays empty.
    """
    key = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    own = docs.select(key.alias("k"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    texts = texts_by_key(own)
    candidates = simhash_candidates(texts)
    links = connecting_pairs(texts, connected_components, threshold, first=candidates)
    roots = materialize(connected_components(links), "roots")
    rows = docs.select(key.alias("k"), F.col(id_col).alias("id")).groupBy("k", "id").agg(F.count("*").alias("n"))
    least = rows.groupBy("k").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "n")).alias("least"))
    rooted = least.join(roots.withColumnRenamed("node", "k"), "k", "left").select("k", "least", F.coalesce("root", "k").alias("root"))
    kept = rooted.groupBy("root").agg(F.min(F.struct("least", "k")).alias("m")).select(F.col("m.least.id").alias("_kept_id"), F.col("m.k").alias("_kept_key"), F.col("m.least.n").alias("_kept_n"))
    kept = materialize(kept, "kept")
    discard(texts, candidates, links, roots)
    return one_row_each(docs, kept, id_col, key, "_kept_key")
