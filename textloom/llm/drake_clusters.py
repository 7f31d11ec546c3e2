"""Centroid clustering by Lloyd's rounds with Drake's adaptive bounds.

Each vector carries the numbers of its nearest centroids, a lower bound of its distance to each of them, and one
bound for all others.  When centroids have moved, bounds fall by what they moved; while the distance to a vector's
own centroid lies under all bounds, nothing else is measured, and where it lies under the bounds from some place on,
only the centroids before that place are.  What the bounds cannot order is measured against all centroids.
Components are integers and every decision is made on exact distances, so the result is that of plain rounds.

A round is one pass over a written table of vectors with their bounds.  Each task adds its vectors' sums for each
centroid as rows of the same table, so new centroids come from a few rows a task, not from a second pass.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import discard, materialize

CENTROIDS, ROUNDS, DIMENSIONS, SCALE = 40, 5, 64, 256
#: A distance of vectors within this range of components fits 62 bits.
LARGEST = 1 << 27
#: What rounding may add to a distance or take from a bound.
SLACK = 1e-9
#: Vectors that are measured at a time.
BLOCK = 4096


def integer_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", dimensions: int = DIMENSIONS, scale: int = SCALE) -> DataFrame:
    """(vec_id, x): vectors of exactly ``dimensions`` finite components, each made floor(scale * component).

    Null vectors, other lengths, and null or non-finite components are left out.  A component beyond
    ``LARGEST`` is an error, since distances would leave 64 bits.
    """
    v = F.col(vector_col).cast("array<double>")
    whole = (F.size(v) == dimensions) & F.forall(v, lambda c: c.isNotNull() & (F.abs(c) < float("inf")))
    value = lambda c: F.when(F.abs(c * scale) < LARGEST, F.floor(c * scale)).otherwise(F.raise_error(F.lit("a vector's component is too large to be clustered")))
    return vectors.where(F.coalesce(whole, F.lit(False))).select(F.col(id_col).cast("long").alias("vec_id"), F.transform(v, value).cast("array<int>").alias("x"))


def first_centroids(points: DataFrame, k: int = CENTROIDS, prefix: str = "2:") -> np.ndarray:
    """The ``k`` vectors with the least sha256 of prefix and id, in that order; a null id counts as ``null``.  Equal ids go by their components."""
    key = F.sha2(F.concat(F.lit(prefix), F.coalesce(F.col("vec_id").cast("string"), F.lit("null"))), 256)
    rows = points.select(key.alias("key"), "x").orderBy("key", "x").limit(k).collect()
    return np.array([r["x"] for r in rows], np.int64)


@dataclass(frozen=True)
class Moved:
    """What a round needs: the centroids, how far each has moved, and how many bounds a vector keeps."""

    centroids: np.ndarray
    drift: np.ndarray
    kept: int


def _distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of all pairs; by one product where doubles hold all its sums."""
    if max(np.abs(x).max(initial=0), np.abs(c).max(initial=0)) < 1 << 22 and x.shape[1] <= 256:
        product = (x.astype(np.float64) @ c.T.astype(np.float64)).astype(np.int64)
    else:
        product = x @ c.T
    return (x * x).sum(1)[:, None] - 2 * product + (c * c).sum(1)[None, :]


def _scan(x: np.ndarray, c: np.ndarray, kept: int):
    """(near, exact distance to the first of them, bounds): from the distances to all centroids.

    ``near`` are the nearest centroid and the ``kept`` next ones; the last bound is that of all others.
    """
    squares = _distances(x, c)
    order = np.argsort(squares, axis=1, kind="stable")
    sorted_squares = np.take_along_axis(squares, order, 1)
    low = np.full((len(x), kept + 1), np.inf)
    have = sorted_squares[:, 1 : kept + 2]
    low[:, : have.shape[1]] = np.sqrt(have) * (1 - SLACK)
    return order[:, : kept + 1].astype(np.int32), sorted_squares[:, 0], low


def assign_block(x: np.ndarray, moved: Moved, state: tuple[np.ndarray, np.ndarray] | None):
    """(near, distance, bounds, used) of vectors; ``state`` is (near, bounds) of the round before.

    ``used`` is how many of a vector's stored neighbours had to be measured, -1 for all centroids.
    """
    c, n = moved.centroids, len(x)
    if state is None:
        return *_scan(x, c, moved.kept), np.full(n, -1, np.int32)
    near, low = state[0][:, : moved.kept + 1].copy(), state[1]
    b = near.shape[1] - 1
    # bounds that are no longer kept go into the one for all others
    low = np.concatenate([low[:, :b], low[:, b:].min(1, keepdims=True)], axis=1)
    fall = np.concatenate([moved.drift[near[:, 1:]], np.full((n, 1), moved.drift.max(initial=0.0))], axis=1)
    low = np.where(np.isinf(low), low, low - fall - SLACK * (np.where(np.isinf(low), 0, np.abs(low)) + fall))  # without other centroids a bound has no end
    distance = ((x - c[near[:, 0]]) ** 2).sum(1)
    upper = np.sqrt(distance) * (1 + SLACK)
    ahead = np.minimum.accumulate(low[:, ::-1], axis=1)[:, ::-1]  # the least bound from each place on
    certain = upper[:, None] < ahead
    used = np.where(certain.any(1), certain.argmax(1), -1).astype(np.int32)
    for z in np.unique(used[used > 0]):
        rows = np.flatnonzero(used == z)
        some = near[rows, : z + 1]
        squares = ((x[rows, None, :] - c[some]) ** 2).sum(2)
        order = np.lexsort((some, squares), axis=1)
        near[rows, : z + 1] = np.take_along_axis(some, order, 1)
        squares = np.take_along_axis(squares, order, 1)
        distance[rows] = squares[:, 0]
        low[rows, :z] = np.sqrt(squares[:, 1:]) * (1 - SLACK)
    rows = np.flatnonzero(used < 0)
    if len(rows):
        near[rows], distance[rows], low[rows] = _scan(x[rows], c, b)
    return near, distance, low, used


def _matrix(column: pa.Array, kind) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(len(column), -1)


STATE = "vec_id long, x array<int>, near array<int>, low array<double>, distance long, used int, cluster int, n long, inertia decimal(38,0), sums array<decimal(38,0)>"
_KIND = pa.schema([
    ("vec_id", pa.int64()), ("x", pa.list_(pa.int32())), ("near", pa.list_(pa.int32())), ("low", pa.list_(pa.float64())), ("distance", pa.int64()), ("used", pa.int32()),
    ("cluster", pa.int32()), ("n", pa.int64()), ("inertia", pa.decimal128(38, 0)), ("sums", pa.list_(pa.decimal128(38, 0))),
])


def _round_batches(batches, moved: Moved):
    """Vectors with their new bounds, and at the end of the task a row of sums for each centroid (those have ``n``)."""
    k, d = moved.centroids.shape
    sums, counts, inertia = [[0] * d for _ in range(k)], [0] * k, [0] * k
    lists = lambda m, kind: pa.ListArray.from_arrays(pa.array(np.arange(len(m) + 1, dtype=np.int32) * m.shape[1]), pa.array(m.ravel(), kind))
    for whole in batches:
        for batch in (whole.slice(i, BLOCK) for i in range(0, whole.num_rows, BLOCK)):
            m, x = batch.num_rows, _matrix(batch.column(1), np.int64)
            state = (_matrix(batch.column(2), np.int32), _matrix(batch.column(3), np.float64)) if batch.num_columns > 2 else None
            near, distance, low, used = assign_block(x, moved, state)
            for j in np.unique(near[:, 0]):
                own = near[:, 0] == j
                sums[j] = [a + int(b) for a, b in zip(sums[j], x[own].sum(0))]
                counts[j] += int(own.sum())
                inertia[j] += sum(distance[own].tolist())
            nothing = [pa.nulls(m, f.type) for f in list(_KIND)[7:]]
            yield pa.RecordBatch.from_arrays([batch.column(0), lists(x, pa.int32()), lists(near, pa.int32()), lists(low, pa.float64()), pa.array(distance), pa.array(used), pa.array(near[:, 0]), *nothing], schema=_KIND)
    seen = [j for j in range(k) if counts[j]]
    if seen:
        missing = [pa.nulls(len(seen), f.type) for f in list(_KIND)[:6]]
        own = [pa.array([v[j] for j in seen], f.type) for v, f in zip((range(k), counts, inertia, sums), list(_KIND)[6:])]
        yield pa.RecordBatch.from_arrays([*missing, *own], schema=_KIND)


def _totals(state: DataFrame, d: int) -> dict[int, tuple[int, int, list[int]]]:
    """{cluster: (n, inertia, sums)} from the tasks' sums; at most one row for each centroid comes to the driver."""
    whole = [F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(d)]
    rows = state.where("n is not null").groupBy("cluster").agg(F.sum("n").alias("n"), F.sum("inertia").alias("inertia"), *whole).collect()
    return {r["cluster"]: (int(r["n"]), int(r["inertia"]), [int(r[f"s{i}"]) for i in range(d)]) for r in rows}


def cluster_rounds(points: DataFrame, centroids: np.ndarray, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray, dict[int, tuple[int, int, list[int]]]]:
    """(table, centroids, totals) after ``rounds`` rounds and a last assignment of ``points(vec_id, x)``.

    The table is in the shared folder and has (vec_id, x, cluster, distance, ...), and rows of sums where ``n`` is
    not null.  A round reads the table of the one before and then deletes it, so at most two are on disk.
    """
    k, d = centroids.shape
    least, moved = -(-k // 8), Moved(centroids, np.zeros(k), min(k - 1, -(-k // 4)))
    state = materialize(points.select("vec_id", "x").mapInArrow(partial(_round_batches, moved=moved), STATE), "clusters")
    totals = _totals(state, d)
    for _ in range(rounds):
        c = moved.centroids.copy()
        for j, (n, _, sums) in totals.items():
            c[j] = [s // n for s in sums]
        drift = np.sqrt(((c - moved.centroids) ** 2).sum(1).astype(np.float64)) * (1 + SLACK)
        # as many bounds as any vector needed, an eighth of the centroids at least
        needed = state.where("n is null").agg(F.max("used")).first()[0]
        kept = moved.kept if needed < 0 else min(moved.kept, max(needed, least))
        moved = Moved(c, drift, kept)
        rows = state.where("n is null").select("vec_id", "x", "near", "low")
        after = materialize(rows.mapInArrow(partial(_round_batches, moved=moved), STATE), "clusters")
        discard(state)
        state, totals = after, _totals(after, d)
    return state, moved.centroids, totals


def cluster_report(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = CENTROIDS, rounds: int = ROUNDS) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256), one row for each vector that is kept.

    Null vectors, those of other than 64 components, and those with a null or non-finite component are left out.
    Repeated rows and null ids are rows of their own; of equal distances the smaller number wins; an empty centroid
    stays where it is.  Fewer than ``k`` vectors make as many centroids; an empty table stays empty.  Other columns
    are ignored.  Nothing but one row of sums for each centroid reaches the driver.
    """
    spark, points = vectors.sparkSession, integer_vectors(vectors, id_col, vector_col)
    start = first_centroids(points, k)
    if not len(start):
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    state, centroids, totals = cluster_rounds(points, start, rounds)
    inertia = sum(t[1] for t in totals.values())
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    each = spark.createDataFrame([(j, t[1], digest[j]) for j, t in sorted(totals.items())], "cluster int, cluster_inertia long, centroid_sha256 string")
    rows = state.where("n is null").select("vec_id", "cluster", "distance").join(F.broadcast(each), "cluster")  # one row for each centroid
    return rows.select("vec_id", "cluster", "distance", "cluster_inertia", F.lit(inertia).cast("long").alias("inertia"), "centroid_sha256")


def oracle(k: int = CENTROIDS, rounds: int = ROUNDS) -> str:
    """The same by plain rounds: every vector against every centroid."""
    steps = [
        f"""WITH p AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda c: floor({SCALE} * c::DOUBLE)) AS x FROM embeddings
WHERE len(embedding) = {DIMENSIONS} AND len(list_filter(embedding, lambda c: c IS NULL OR isnan(c) OR isinf(c))) = 0),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, x) - 1 AS j, x AS c FROM (SELECT sha256('2:' || vec_id) AS h, x FROM p ORDER BY h, x LIMIT {k}))"""
    ]
    for r in range(rounds + 1):
        steps.append(
            f"""a{r} AS MATERIALIZED (SELECT vec_id, x, b.d, b.j FROM (SELECT vec_id, x, min(struct_pack(d := (list_inner_product(x, x) - 2 * list_inner_product(x, c) + list_inner_product(c, c))::BIGINT, j := j)) AS b
FROM p, c{r} GROUP BY vec_id, x))"""
        )
        if r < rounds:
            steps.append(
                f"""s{r} AS (SELECT j, i, sum(v::BIGINT)::BIGINT AS s, count(*) AS n FROM (SELECT j, unnest(x) AS v, generate_subscripts(x, 1) AS i FROM a{r}) GROUP BY j, i),
m{r} AS (SELECT j, list(((s - ((s % n) + n) % n) // n)::DOUBLE ORDER BY i) AS x FROM s{r} GROUP BY j),
c{r + 1} AS MATERIALIZED (SELECT c.j, coalesce(m.x, c.c) AS c FROM c{r} c LEFT JOIN m{r} m USING (j))"""
            )
    return ",\n".join(steps) + (
        f"\nSELECT vec_id, j::INTEGER AS cluster, d AS distance, (sum(d) OVER (PARTITION BY j))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia, "
        f"sha256(array_to_string(list_transform(c, lambda v: v::BIGINT), ',')) AS centroid_sha256 FROM a{rounds} JOIN c{rounds} USING (j)"
    )
