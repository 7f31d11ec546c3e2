"""Exact self-join of texts by the Jaccard similarity of their word shingles.

Two sets of n and m shingles that reach a similarity t share one of the first n - ceil(tn) + 1 (and
m - ceil(tm) + 1) in any one order of all shingles.  The order taken here is by frequency, so most
prefixes hold nothing but shingles of a single text, which meet no other.  Frequencies are counted
for three eighths of all shingles, which come first; only a text with too few of these goes on with
the least hashes of the others.  Whatever meets in a prefix is verified on the complete sets.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import discard, materialize, return_memory

SHINGLE, SEED = 5, 42
#: Shingles whose hash ends in less than COUNTED of eight are counted and come first in the order.
COUNTED = 3


def shingle_set(text: str | None, width: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of ``width`` words; fewer words are one shingle.

    Words are lower-cased (A-Z) and end at ASCII white space.  A text without words has one shingle, the empty one.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if len(words) <= width:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)], np.uint64).view(np.int64)
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = len(words) - width + 1
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(joined[a:b], SEED) for a, b in zip(starts[:n].tolist(), ends[-n:].tolist())], np.uint64).view(np.int64))


def prefix_length(n: int, threshold: float) -> int:
    return n - math.ceil(threshold * n - 1e-9) + 1


def texts_by_key(texts: DataFrame) -> DataFrame:
    """(k, text), one row for each distinct text of ``texts(k, text)``."""
    return materialize(texts.groupBy("k").agg(F.first("text").alias("text")), "texts")


def _counted_shingles(texts: DataFrame, threshold: float, width: int) -> DataFrame:
    """(h, k, late, spare, early): the shingles of each text that may be in its prefix.

    ``late`` marks those behind the counted ones, of which the text has ``early``; ``spare`` is the prefix's length
    less the text's rows.
    """
    kind = pa.schema([("h", pa.int64()), ("k", pa.int64()), ("late", pa.bool_()), ("spare", pa.int32()), ("early", pa.int32())])

    def run(batches):
        for batch in batches:
            held, size = [], 0
            for k, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                hashes = shingle_set(text.as_py(), width)
                first = (hashes & 7) < COUNTED
                length = prefix_length(len(hashes), threshold)
                early = hashes[first]
                late = hashes[~first][: max(0, length - len(early))]
                n = len(early) + len(late)
                held.append((np.concatenate([early, late]), np.full(n, k), np.arange(n) >= len(early), np.full(n, length - n, np.int32), np.full(n, len(early), np.int32)))
                size += n
                if size > 100_000:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*held)], schema=kind)
                    held, size = [], 0
            if held:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*held)], schema=kind)
        held = None
        return_memory()

    return texts.select("k", "text").mapInArrow(run, "h long, k long, late boolean, spare int, early int")


def _sets(texts: DataFrame, width: int) -> DataFrame:
    """(k, n, shingles) of whole texts."""

    def run(batches):
        for batch in batches:
            for part in (batch.slice(i, 200) for i in range(0, batch.num_rows, 200)):
                found = [shingle_set(t.as_py(), width) for t in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(x) for x in found], pa.int32()), pa.array(found, pa.list_(pa.int64()))], ["k", "n", "shingles"])
        return_memory()

    return texts.select("k", "text").mapInArrow(run, "k long, n int, shingles array<long>")


def prefixes(texts: DataFrame, threshold: float, width: int = SHINGLE) -> tuple[DataFrame, DataFrame]:
    """((h, k, n, pos), (k, n, shingles)): prefix shingles that several texts have, and the sets of these texts.

    At least ``pos`` shingles of the text come before h in the order.
    """
    rows = _counted_shingles(texts, threshold, width)
    counted = rows.withColumn("df", F.count("*").over(Window.partitionBy("h"))).where("df > 1")
    # what is left out belongs to one text, comes first in the order, and takes up its part of the prefix
    each = counted.groupBy("k", "spare", "early").agg(F.count("*").cast("int").alias("common"), F.count_if(~F.col("late")).cast("int").alias("known"), F.collect_list(F.struct("late", F.when(~F.col("late"), F.col("df")).alias("df"), "h")).alias("s"))
    first = each.where("spare + common > 0").select("k", (F.col("early") - F.col("known")).alias("before"), F.posexplode(F.slice(F.sort_array("s"), F.lit(1), F.col("spare") + F.col("common"))).alias("at", "s"))
    own = materialize(first.select("k", "s.h", (F.col("before") + F.col("at")).alias("pos")), "prefixes")
    shared = own.groupBy("h").count().where("count > 1").select("h")
    met = materialize(own.join(shared, "h", "left_semi"), "met")
    sets = materialize(_sets(texts.join(met.select("k").distinct(), "k", "left_semi"), width), "sets")
    out = materialize(met.join(sets.select("k", "n"), "k").select("h", "k", "n", "pos"), "buckets")
    discard(own, met)
    return out, sets


def _fitting(threshold: float):
    """Whether two texts with n shingles, that meet in one with pos others before it, can reach the similarity.

    The first shingle that they share in the order leaves no more for them to share than what lies behind it, so a
    pair that reaches the similarity passes with that one.
    """
    most = F.least(F.col("xn") - F.col("xpos"), F.col("yn") - F.col("ypos"))
    return most * (1 + threshold) >= (F.col("xn") + F.col("yn")) * threshold - 1e-9


def verified(candidates: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """(a, b, similarity) of the ``candidates(a, b)`` that reach the threshold on their complete sets."""
    both = candidates.join(sets.select(F.col("k").alias("a"), F.col("shingles").alias("x")), "a").join(sets.select(F.col("k").alias("b"), F.col("shingles").alias("y")), "b")
    common = F.size(F.array_intersect("x", "y"))
    measured = both.select("a", "b", (common / (F.size("x") + F.size("y") - common)).alias("similarity"))
    return measured.where(F.col("similarity") >= threshold - 1e-9)


def _side(met: DataFrame, key: str, x: str, *more) -> DataFrame:
    return met.select("h", F.col("k").alias(key), F.col("n").alias(f"{x}n"), F.col("pos").alias(f"{x}pos"), *more)


def all_pairs(texts: DataFrame, threshold: float, width: int = SHINGLE) -> DataFrame:
    """(a, b, similarity): every pair of different keys in ``texts(k, text)`` that reaches the threshold."""
    met, sets = prefixes(texts, threshold, width)
    both = _side(met, "a", "x").join(_side(met, "b", "y"), "h").where((F.col("a") < F.col("b")) & _fitting(threshold))
    candidates = materialize(both.select("a", "b").distinct(), "candidates")
    return verified(_alike_candidates(candidates, sets, threshold), sets, threshold)


def _alike_candidates(candidates: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """The candidates that can reach the similarity by their parity maps, so that sets are not sent to the others."""
    bits = materialize(_parities(sets.select("k", F.explode("shingles").alias("h"))).join(sets.select("k", "n"), "k"), "parities")
    side = lambda key, x: bits.select(F.col("k").alias(key), F.col("n").alias(f"{x}n"), F.col("bits").alias(f"{x}bits"))
    met = candidates.join(side("a", "x"), "a").join(side("b", "y"), "b").where(_alike(threshold))
    return materialize(met.select("a", "b"), "alike")


def _labelled(buckets: DataFrame, links: list[DataFrame]) -> DataFrame:
    """Rows of texts by shingle with a ``root``: the least neighbour in the links, or the text; equal roots are connected."""
    if not links:
        return buckets.withColumn("root", F.col("k"))
    nearest = reduce(DataFrame.unionByName, links).groupBy(F.col("b").alias("k")).agg(F.min("a").alias("root"))
    return materialize(buckets.join(nearest, "k", "left").withColumn("root", F.coalesce("root", "k")), "labelled")


def _apart(rooted: DataFrame) -> DataFrame:
    """(h, main): shingles whose texts have several roots, and the most frequent one."""
    sizes = rooted.groupBy("h", "root").count().groupBy("h")
    return sizes.agg(F.max(F.struct("count", "root"))["root"].alias("main"), F.count("*").alias("roots")).where("roots > 1").select("h", "main")


def _star(rooted: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """(a, b): links of each shingle's texts to its hub, of those outside the main root the one most like the others.

    That is the text in which the least share of rarer shingles comes before: it has few of its own.
    """
    mixed = rooted.join(_apart(rooted), "h")
    best = mixed.where("root <> main").groupBy("h").agg(F.min(F.struct((F.col("pos") / F.col("n")).alias("share"), "k", "n", "pos", "root")).alias("m"))
    hubs = best.select("h", F.col("m.k").alias("a"), F.col("m.n").alias("xn"), F.col("m.pos").alias("xpos"), F.col("m.root").alias("p"))
    met = rooted.select("h", F.col("k").alias("b"), F.col("n").alias("yn"), F.col("pos").alias("ypos"), F.col("root").alias("q"))
    pairs = met.join(hubs, "h").where((F.col("p") != F.col("q")) & (F.col("a") != F.col("b")) & _fitting(threshold))
    return materialize(verified(pairs.select("a", "b").distinct(), sets, threshold).select("a", "b"), "near")


#: Rounds of hubs before the texts that are still apart are compared in pairs.
HUBS = 2


def connecting_pairs(texts: DataFrame, components, threshold: float, width: int = SHINGLE, first: DataFrame | None = None) -> DataFrame:
    """(a, b): verified pairs that connect what all pairs would connect.

    In a few rounds, each shared shingle links its texts to a hub.  ``components`` finds what the links connect.  Only
    texts that share a shingle and are still apart go on: their prefixes are made anew, in the order of all their
    shingles, and those outside a shingle's largest component are compared with all others.  That is exact, since such
    texts are all there and any one order serves.  Neither a large group of near copies nor a passage that many
    otherwise different texts share gives more pairs than are alike.  Of ``first``, candidates (a, b) that are known otherwise, those that
    reach the threshold are links from the start.
    """
    buckets, sets = prefixes(texts, threshold, width)
    links = [] if first is None else [materialize(verified(first.select("a", "b").distinct(), sets, threshold).select("a", "b"), "near")]
    for _ in range(HUBS):
        labelled = _labelled(buckets, links)
        links.append(_star(labelled, sets, threshold))
        discard(labelled)
    near = materialize(reduce(DataFrame.unionByName, links), "near")
    roots = materialize(components(near).select(F.col("node").alias("k"), "root"), "roots")
    mixed = _mixed(buckets, roots)
    apart = _complete_prefixes(mixed.select("k").distinct(), sets, threshold)
    anew = _mixed(apart, roots)
    far = materialize(verified(_still_apart(anew, threshold), sets, threshold).select("a", "b"), "far")
    out = materialize(near.unionByName(far), "links")
    discard(buckets, sets, *links, near, roots, mixed, apart, anew, far)
    return out


def _mixed(buckets: DataFrame, roots: DataFrame) -> DataFrame:
    """Rows of texts by shingle with their ``root`` and the shingle's ``main`` one, of shingles whose texts have several."""
    rooted = materialize(buckets.join(roots, "k", "left").withColumn("root", F.coalesce("root", "k")), "rooted")
    mixed = materialize(rooted.join(_apart(rooted), "h"), "mixed")
    discard(rooted)
    return mixed


#: Words of 64 bits of a text's parity map.
PARITY = 16


def _parities(shingles: DataFrame) -> DataFrame:
    """(k, bits) of ``shingles(k, h)``: for each of 1024 classes of shingles whether the text has an odd number of them."""
    bit = "shiftleft(1L, cast(shiftright(h, 4) & 63 as int))"
    words = [F.expr(f"coalesce(bit_xor(case when h & {PARITY - 1} = {w} then {bit} end), 0L)").alias(f"w{w}") for w in range(PARITY)]
    return shingles.groupBy("k").agg(*words).select("k", F.array(*[f"w{w}" for w in range(PARITY)]).alias("bits"))


def _alike(threshold: float):
    """Whether two texts can reach the similarity by their parity maps, which differ in no more bits than the sets do in shingles."""
    apart = reduce(lambda a, b: a + b, [F.bit_count(F.col("xbits")[w].bitwiseXOR(F.col("ybits")[w])) for w in range(PARITY)])
    return apart <= (F.col("xn") + F.col("yn")) * ((1 - threshold) / (1 + threshold)) + 1e-9


def _complete_prefixes(keys: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """(h, k, n, bits, pos): prefix shingles of the texts of ``keys(k)``, in the order of their frequency among these texts.

    All shingles of these texts are counted, so those that a text has alone come before any that it shares, and a
    passage that many texts share is in the prefix of a text that has little else.
    """
    own = materialize(sets.join(keys, "k", "left_semi").select("k", "n", F.explode("shingles").alias("h")), "shingles")
    shared = materialize(own.groupBy("h").agg(F.count("*").alias("df")).where("df > 1"), "frequencies")
    met, each = own.join(shared, "h"), Window.partitionBy("k")
    pos = F.col("n") - F.count("*").over(each) + F.row_number().over(each.orderBy("df", "h")) - 1
    placed = met.withColumn("pos", pos.cast("int")).where(F.col("pos") <= F.col("n") - F.ceil(F.col("n") * threshold - 1e-9))
    bits = materialize(_parities(own), "parities")
    out = materialize(placed.join(bits, "k").select("h", "k", "n", "bits", "pos"), "prefixes")
    discard(own, shared, bits)
    return out


def _still_apart(mixed: DataFrame, threshold: float) -> DataFrame:
    """(a, b): pairs of texts with different roots that can reach the similarity.

    Of two texts the one with fewer shingles has the more in common with the other: at least 2t / (1 + t) of its own.
    So it needs no more than the shingles that leave as many behind them, about half of its prefix.  Copies that were
    altered in different places share most of their prefixes; what they lack is seen by their parity maps.
    """
    part = 2 * threshold / (1 + threshold)
    short = mixed.where(F.col("pos") <= F.col("n") - F.ceil(F.col("n") * part - 1e-9))
    pairs = []
    for outside in (True, False):  # pairs within the main root are not even met
        x = _side(short.where(F.col("root") != F.col("main") if outside else F.col("root") == F.col("main")), "a", "x", F.col("root").alias("p"), F.col("bits").alias("xbits"))
        y = _side(mixed if outside else mixed.where("root <> main"), "b", "y", F.col("root").alias("q"), F.col("bits").alias("ybits"))
        order = (F.col("xn") < F.col("yn")) | (F.col("xn") == F.col("yn")) & (F.col("a") < F.col("b"))
        pairs.append(x.join(y, "h").where(order & (F.col("p") != F.col("q")) & _fitting(threshold) & _alike(threshold)).select("a", "b"))
    return pairs[0].unionByName(pairs[1]).distinct()
