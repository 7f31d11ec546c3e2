"""Joins of intervals that overlap or lie near each other, by buckets of their places."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Places of one bucket, if the reach is not longer.
BUCKET = 256


def gap(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    """Places between two intervals, ends excluded; 0 if they touch or overlap."""
    return F.greatest(F.lit(0), b_start - a_end, a_start - b_end)


def _bucketed(rows: DataFrame, prefix: str, on: list[str], reach: int, width: int) -> DataFrame:
    first, last = F.floor((F.col("start") - reach) / width), F.floor((F.col("end") + reach) / width)
    named = [F.col(c) if c in on else F.col(c).alias(f"{prefix}{c}") for c in rows.columns]
    return rows.select(*named, first.alias(f"{prefix}first"), F.explode(F.sequence(first, last)).alias("_bucket"))


def near_pairs(left: DataFrame, right: DataFrame, on: list[str], reach: int = 0, overlap: bool = False) -> DataFrame:
    """Pairs of ``left`` and ``right`` (start, end, ...), equal in ``on``, with at most ``reach`` places between them.

    Columns beside ``on`` begin with ``l_`` and ``r_``.  With ``overlap`` they have to share a place, and touching is not
    enough.  Every interval is in each bucket that it reaches, so a key with very many intervals is dealt over its
    buckets and only neighbours meet; a pair counts in the first bucket that both are in, hence once.  An interval
    with a null end or key has no pair, and an empty one shares no place.
    """
    width = max(BUCKET, reach)
    x, y = _bucketed(left, "l_", on, reach, width), _bucketed(right, "r_", on, 0, width)
    l_start, l_end, r_start, r_end = (F.col(c) for c in ("l_start", "l_end", "r_start", "r_end"))
    close = (l_start < r_end) & (r_start < l_end) if overlap else gap(l_start, l_end, r_start, r_end) <= reach
    both = x.join(y, [*on, "_bucket"]).where((F.col("_bucket") == F.greatest("l_first", "r_first")) & close)
    return both.drop("_bucket", "l_first", "r_first")


def mutual_counts(occurrences: DataFrame, terms: int, reach: int, key: str = "doc_id") -> DataFrame:
    """(key, matches) from ``occurrences(key, term, start, end)``: those that have each other term within ``reach``.

    Of occurrences that overlap, such as those of a phrase and of a word in it, the first counts and the longer of two
    that begin together; a document without one has no row.
    """
    others = occurrences.select(key, "term", "start", "end")
    met = near_pairs(occurrences.select(key, "term", "start", "end"), others, [key], reach).where("l_term <> r_term")
    full = met.groupBy(key, "l_term", "l_start", "l_end").agg(F.count_distinct("r_term").alias("n")).where(F.col("n") == terms - 1)
    spans = full.groupBy(key).agg(F.sort_array(F.collect_set(F.struct(F.col("l_start").alias("start"), (-F.col("l_end")).alias("back")))).alias("spans"))
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-1).cast("long").alias("end"))
    fold = lambda acc, s: F.when(s["start"] >= acc["end"], F.struct((acc["n"] + 1).alias("n"), (-s["back"]).cast("long").alias("end"))).otherwise(acc)
    return spans.select(key, F.aggregate("spans", start, fold, lambda acc: acc["n"]).alias("matches"))
