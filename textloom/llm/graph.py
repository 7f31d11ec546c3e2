"""Connected components of a link table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import discard, materialize


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One step over (a, b) links.  ``large`` links each greater neighbour to the least of its group,
    otherwise each smaller neighbour.  The least neighbour comes from a map-side combined ``min``;
    the join that follows reads two written tables, so a node with very many links can be split.
    """
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    sides = both if large else both.where("b < a")
    least = materialize(sides.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "star")
    joined = sides.join(least, "a")
    if large:
        out = joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    done = materialize(out.where("a <> b").distinct(), "links")
    discard(least)
    return done


def connected_components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links(a long, b long)``; root is the component's least node.

    Links with a null end or equal ends are ignored; repeated links do no harm; no links give an
    empty result.  Steps double the reach, so their number is logarithmic in practice.  Nothing but
    two sums of the link table reaches the driver.
    """
    edges = materialize(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "links")
    before = None
    while True:
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(state) == before or not state[0]:
            break
        before = tuple(state)
        wide = _star(edges, True)
        narrow = _star(wide, False)
        discard(edges, wide)
        edges = narrow
    return edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
