"""Exact duplicates by size and digest, near duplicates by the exact similarity of five-word shingles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .setjoin import all_pairs, texts_by_key

SIMILARITY, LEAST_SIMILARITY = 0.8, 0.5


def exact_duplicates(docs: DataFrame, size: str = "size", content: str = "body") -> DataFrame:
    """(digest, size, copies, wasted, paths) of equal contents; empty ones are ignored.

    Sizes that occur once are dropped before anything is hashed; a table of repeated sizes is joined, so
    contents are not shuffled to count them.
    """
    rows = docs.where(F.col(size) > 0)
    repeated = rows.groupBy(size).count().where("count > 1").select(size)
    hashed = rows.join(repeated, size, "left_semi").select(size, "path", F.sha2(F.col(content), 256).alias("digest"))
    groups = hashed.groupBy("digest", size).agg(F.count("*").alias("copies"), F.sort_array(F.collect_list("path")).alias("paths")).where("copies > 1")
    return groups.withColumn("wasted", F.col(size) * (F.col("copies") - 1))


def report_order(groups: DataFrame) -> DataFrame:
    return groups.orderBy(F.desc("wasted"), F.desc("size"), F.get("paths", F.lit(0)))


def signatures(docs: DataFrame, text: str = "body") -> DataFrame:
    """(path, k, text): whole lower-cased texts that have words, with a key that equal ones share."""
    lower = F.lower(text)
    return docs.where(F.rlike(F.col(text), F.lit(r"\S"))).select("path", F.xxhash64(lower).alias("k"), lower.alias("text"))


def similar_pairs(signed: DataFrame, threshold: float = SIMILARITY) -> DataFrame:
    """(a, b, similarity): all pairs of texts whose sets of five-word shingles reach the threshold, exactly.

    Equal texts are one class of which the least path stands for all, so copies are not paired with
    each other.
    """
    threshold = min(1.0, max(LEAST_SIMILARITY, threshold))
    classes = materialize(signed.groupBy("k").agg(F.min("path").alias("path")), "classes")
    found = all_pairs(texts_by_key(signed.select("k", "text")), threshold)
    x, y = classes.select(F.col("k").alias("a"), F.col("path").alias("p")), classes.select(F.col("k").alias("b"), F.col("path").alias("q"))
    found = found.join(x, "a").join(y, "b").select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b"), "similarity")
    copies = signed.select("k", F.col("path").alias("b")).join(classes.withColumnRenamed("path", "a"), "k").where("b <> a").select("a", "b", F.lit(1.0).alias("similarity"))
    return found.unionByName(copies)


def components(links: DataFrame) -> DataFrame:
    """(node, root) by least labels and pointer jumping; a written table cuts the lineage of each round."""
    both = materialize(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    labels = both.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("root"))
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("best"))
        moved = labels.join(near, "node").select("node", F.least("root", "best").alias("next"), "root")
        jump = moved.select(F.col("node").alias("next"), F.col("next").alias("far"))
        step = materialize(moved.join(jump, "next", "left").select("node", F.least("next", F.coalesce("far", "next")).alias("root"), F.col("root").alias("old")), "labels")
        if step.where("root <> old").isEmpty():
            return step.select("node", "root")
        labels = step.select("node", "root")


def similar_groups(pairs: DataFrame) -> DataFrame:
    """(root, paths, similarity): connected texts and the least similarity of their links."""
    nodes = components(pairs)
    least = pairs.join(nodes.withColumnRenamed("node", "a"), "a").groupBy("root").agg(F.min("similarity").alias("similarity"))
    return nodes.groupBy("root").agg(F.sort_array(F.collect_list("node")).alias("paths")).join(least, "root")


def all_duplicates(docs: DataFrame, threshold: float = SIMILARITY) -> DataFrame:
    """(kind, paths, similarity): exact groups and similar ones that are not exact."""
    exact = exact_duplicates(docs)
    similar = similar_groups(similar_pairs(signatures(docs), threshold))
    known = exact.select(F.col("paths").alias("known"))
    fresh = similar.join(known, F.col("paths") == F.col("known"), "left_anti")
    return exact.select(F.lit("exact").alias("kind"), "paths", F.lit(1.0).alias("similarity")).unionByName(fresh.select(F.lit("similar").alias("kind"), "paths", "similarity"))


def copies_of(docs: DataFrame, path: str) -> DataFrame:
    """Paths with the size and digest of one document."""
    one = docs.where(F.col("path") == path).select(F.col("size").alias("s"), F.sha2("body", 256).alias("d")).limit(1)
    return docs.join(F.broadcast(one), (F.col("size") == F.col("s")) & (F.sha2("body", 256) == F.col("d"))).select("path")
