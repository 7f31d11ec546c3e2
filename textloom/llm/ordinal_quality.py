"""Quality classifier: cumulative-link (proportional odds) regression on graded ratings.

P(grade > j) = sigmoid(w . x - theta_j), with one weight vector over hashed text features and ordered
thresholds.  The model gives each text an expected grade and the probability of its tail, by which
texts are selected.  It is fitted on the driver, on a bounded sample of labelled rows; scoring reads
whole texts in Arrow batches.
"""

from __future__ import annotations

import math
import zlib
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import discard, materialize, return_memory

#: The fit uses at most so many labelled rows: those whose ids have the least hashes.
LABELLED_ROWS = 20_000
#: And so many features of these together (four bytes each reach the driver), in the same order.
LABELLED_FEATURES = 40_000_000
BUCKETS = 1 << 18
#: The fit goes through so many features at a time.
BLOCK = 1 << 18
#: Features of fewer labelled texts get no weight: in a few texts a word says nothing of others.
LEAST_TEXTS = 8
GRADES = 3
#: A text is kept if the probability of the highest grade is at least this.
KEEP_AT = 0.5

_LETTERS = bytes(c for c in range(256) if 65 <= c <= 90 or 97 <= c <= 122 or c >= 128)
_WORDS_ONLY = bytes(c + 32 if 65 <= c <= 90 else c if c in _LETTERS else 32 for c in range(256))
_MARKS_ONLY = bytes(32 if c in _LETTERS or c <= 32 or 48 <= c <= 57 else c for c in range(256))
_UPPER, _DIGIT = bytes(range(65, 91)), bytes(range(48, 58))


def _share(part: int, whole: int, steps: int) -> int:
    return steps * part // whole if whole else 0


def features(text: str | None) -> set[bytes]:
    """Names of a text's features: its distinct words and marks, and classes of its shape."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words, marks, lines = raw.translate(_WORDS_ONLY).split(), raw.translate(_MARKS_ONLY).split(), raw.split(b"\n")
    found = {b"w" + w for w in set(words)} | {b"m" + m for m in set(marks)}
    letters = len(raw) - len(raw.translate(None, _LETTERS))
    shape = (
        len(words).bit_length(), _share(len(raw) - len(raw.translate(None, _UPPER)), letters, 10), _share(len(raw) - len(raw.translate(None, _DIGIT)), len(raw), 10),
        _share(sum(map(len, marks)), len(raw), 20), _share(len(set(words)), len(words), 10), _share(len(set(lines)), len(lines), 10), min(20, letters // len(words)) if words else 0,
    )
    return found | {b"s%d=%d" % pair for pair in enumerate(shape)}


def bucket(name: bytes) -> int:
    return zlib.crc32(name) % BUCKETS


@dataclass
class Model:
    weights: np.ndarray
    thresholds: np.ndarray

    def tails(self, score: float) -> list[float]:
        """P(grade > j) for each threshold."""
        return [1 / (1 + math.exp(min(700.0, max(-700.0, t - score)))) for t in self.thresholds]


def fit(rows: list[np.ndarray], grades: np.ndarray, grades_n: int = GRADES, steps: int = 200, rate: float = 0.1, ridge: float = 1.0, least: int = LEAST_TEXTS) -> Model:
    """Maximum likelihood with a ridge, by full-batch Adam; the same rows give the same model.

    ``rows`` are buckets of each text; those of fewer than ``least`` texts get no weight.  Without rows, the model gives every text even odds.
    """
    flat = np.concatenate([np.zeros(0, np.int32), *rows]).astype(np.int32, copy=False)
    return fit_joined(flat, np.array([len(r) for r in rows], np.int64), grades, grades_n, steps, rate, ridge, least)


def _blocks(sizes: np.ndarray) -> list[tuple[slice, slice]]:
    """Consecutive rows of ``BLOCK`` features or, with the last row, less than a row more: their numbers and their features."""
    ends, found, row, start = np.cumsum(sizes), [], 0, 0
    while row < len(sizes):
        last = min(int(np.searchsorted(ends, start + BLOCK)), len(sizes) - 1)
        found.append((slice(row, last + 1), slice(start, int(ends[last]))))
        row, start = last + 1, int(ends[last])
    return found


def fit_joined(flat: np.ndarray, sizes: np.ndarray, grades: np.ndarray, grades_n: int = GRADES, steps: int = 200, rate: float = 0.1, ridge: float = 1.0, least: int = LEAST_TEXTS) -> Model:
    """:func:`fit` on the joined buckets of all texts, int32, which it overwrites, and their number in each text.

    Beside ``flat`` it needs memory for one block of features and for a few numbers of each text and bucket.
    """
    n = len(sizes)
    if not n:
        return Model(np.zeros(BUCKETS), np.zeros(grades_n - 1))
    blocks, counts = _blocks(sizes), np.zeros(BUCKETS, np.int64)
    for _, part in blocks:
        counts += np.bincount(flat[part], minlength=BUCKETS)
    used = np.flatnonzero(counts >= least)
    number = np.full(BUCKETS, -1, np.int32)
    number[used] = np.arange(len(used))
    sizes, end = sizes.copy(), 0
    for own, part in blocks:  # what stays moves forward only
        renumbered = number[flat[part]]
        known = renumbered >= 0
        sizes[own] = np.bincount(np.repeat(np.arange(own.stop - own.start), sizes[own])[known], minlength=own.stop - own.start)
        left = renumbered[known]
        flat[end : end + len(left)] = left
        end += len(left)
    blocks = _blocks(sizes)
    above = np.array([(grades > j).mean() for j in range(grades_n - 1)]).clip(0.01, 0.99)
    first, gaps = -math.log(above[0] / (1 - above[0])), np.diff(np.log((1 - above) / above)).clip(0.1)
    params = np.concatenate([np.zeros(len(used)), [first], np.log(gaps)])
    m, v = np.zeros_like(params), np.zeros_like(params)
    each, k, score = np.arange(n), len(used), np.zeros(n)
    for step in range(1, steps + 1):
        gap = np.exp(params[k + 1 :])
        theta = params[k] + np.concatenate([[0], np.cumsum(gap)])
        for own, part in blocks:
            owner = np.repeat(np.arange(own.stop - own.start), sizes[own])
            score[own] = np.bincount(owner, params[flat[part]], minlength=own.stop - own.start)
        tail = np.concatenate([np.ones((n, 1)), 1 / (1 + np.exp(np.clip(theta - score[:, None], -30, 30))), np.zeros((n, 1))], axis=1)
        slope = tail * (1 - tail)
        chance = np.maximum(tail[each, grades] - tail[each, grades + 1], 1e-9)
        by_score = -(slope[each, grades] - slope[each, grades + 1]) / chance
        # d/d theta_j: the tail of grade j + 1 falls with its threshold
        by_theta = np.array([((grades == j + 1) * slope[:, j + 1] / chance).sum() - ((grades == j) * slope[:, j + 1] / chance).sum() for j in range(grades_n - 1)])
        by_weight = np.zeros(k)
        for own, part in blocks:  # adds in the order of the rows, whatever the blocks are
            np.add.at(by_weight, flat[part].astype(np.intp), np.repeat(by_score[own], sizes[own]))
        gradient = np.concatenate([by_weight + ridge * params[:k], [by_theta.sum()], gap * np.cumsum(by_theta[::-1])[::-1][1:]]) / n
        m, v = 0.9 * m + 0.1 * gradient, 0.999 * v + 0.001 * gradient**2
        params -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    weights = np.zeros(BUCKETS)
    weights[used] = params[:k]
    return Model(weights, params[k] + np.concatenate([[0], np.cumsum(np.exp(params[k + 1 :]))]))


def grade(quality: Column, toxic: Column) -> Column:
    """0 for toxic, 1 for low quality, 2 for good texts."""
    return F.when(toxic == 1, 0).when(quality == 0, 1).otherwise(2)


def graded(labels: DataFrame) -> DataFrame:
    """(id, grade) of ``labels(doc_id, quality, toxic)``; rows with a null are left out, the least of repeated ones counts."""
    known = labels.where("doc_id is not null and quality is not null and toxic is not null")
    return known.groupBy(F.col("doc_id").alias("id")).agg(F.min(grade(F.col("quality"), F.col("toxic"))).alias("grade"))


def _bucket_batches(batches):
    for batch in batches:
        rows = [np.unique(np.array([bucket(f) for f in features(t.as_py())], np.int32)) for t in batch.column(0)]
        yield pa.RecordBatch.from_arrays([pa.array([len(r) for r in rows], pa.int64()), pa.array([r.tobytes() for r in rows], pa.binary()), batch.column(1), batch.column(2)], ["n", "buckets", "grade", "place"])


def train(docs: DataFrame, grades: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows: int = LABELLED_ROWS, most: int = LABELLED_FEATURES, least: int = LEAST_TEXTS) -> Model:
    """Fit a model on at most ``rows`` rows of ``grades(id, grade)`` that have a text, and ``most`` features.

    Rows are taken by the hash of their id, the first whatever its size.  Features of fewer than ``least`` of these
    texts get no weight.  A null text counts as an empty one; ids that several documents
    share give a row for each.  Without a labelled document the model gives even odds.
    """
    chosen = materialize(grades.orderBy(F.xxhash64("id"), "id").limit(rows), "labelled")
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    labelled = texts.join(F.broadcast(chosen), "id").select("text", F.col("grade").cast("int").alias("grade"), F.xxhash64("id").alias("place"))  # at most ``rows`` rows of two numbers
    got = materialize(labelled.mapInArrow(_bucket_batches, "n long, buckets binary, grade int, place long"), "labelled-features")
    sizes = got.groupBy("place").agg(F.sum("n").alias("n")).orderBy("place").collect()
    through = np.cumsum([r["n"] for r in sizes])
    fits = [r["place"] for k, (r, t) in enumerate(zip(sizes, through)) if t <= most or k == 0]
    flat, lengths, found, end = np.empty(int(through[len(fits) - 1]) if fits else 0, np.int32), [], [], 0
    if fits:
        # in the order of buckets and grades, whatever the partitions: the fit's rounding follows the order.  Short keys make the ranges, since a sample of them reaches the driver
        ranges = got.where(F.col("place") <= fits[-1]).select("buckets", "grade").repartitionByRange(F.substring("buckets", 1, 64))
        for r in ranges.sortWithinPartitions("buckets", "grade").toLocalIterator():
            own = np.frombuffer(r["buckets"], np.int32)
            flat[end : end + len(own)] = own
            lengths.append(len(own))
            found.append(r["grade"])
            end += len(own)
    discard(chosen, got)
    model = fit_joined(flat, np.array(lengths, np.int64), np.array(found, np.int64), least=least)
    del flat
    return_memory()
    return model


class _Weights(dict):
    def __init__(self, weights: np.ndarray):
        super().__init__()
        self.weights = weights

    def __missing__(self, name: bytes) -> float:
        if len(self) >= 200_000:
            self.clear()
        value = self[name] = float(self.weights[bucket(name)])
        return value


def _score_batches(batches, model: Model):
    known = _Weights(model.weights)
    for batch in batches:
        tails = [model.tails(math.fsum([known[f] for f in features(t.as_py())])) for t in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([round(sum(t), 6) for t in tails]), pa.array([round(t[-1], 6) for t in tails])], ["id", "expected_grade", "tail"])
    known.clear()
    return_memory()


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep_at: float = KEEP_AT) -> DataFrame:
    """(doc_id, expected_grade, tail, keep) of every row of ``docs``; a null text is an empty one.

    ``tail`` is the probability of the highest grade.  Equal texts get equal scores; repeated rows and
    null ids stay; an empty table stays empty; other columns are ignored.
    """
    kind = dict(docs.dtypes)[id_col]
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    scored = rows.mapInArrow(partial(_score_batches, model=model), f"id {kind}, expected_grade double, tail double")
    return scored.select(F.col("id").alias(id_col), "expected_grade", "tail", (F.col("tail") >= keep_at).alias("keep"))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Fit on the labelled rows of ``docs`` and score all of it.

    Null texts are empty ones, repeated rows and null ids stay, an empty table stays empty, and without labels every
    text has even odds; see :func:`train` and :func:`score`.
    """
    return score(docs, train(docs, graded(labels)))


def _keep_batches(batches, model: Model, column: int, keep_at: float):
    known = _Weights(model.weights)
    for batch in batches:
        keep = [round(model.tails(math.fsum([known[f] for f in features(t.as_py())]))[-1], 6) >= keep_at for t in batch.column(column)]
        yield batch.filter(pa.array(keep, pa.bool_()))
    known.clear()
    return_memory()


def keep_good(docs: DataFrame, labels: DataFrame, text_col: str = "text", keep_at: float = KEEP_AT) -> DataFrame:
    """The rows of ``docs`` that the classifier keeps, with all columns as they are.

    A row stays if the probability of the highest grade is at least ``keep_at``.  A null text is judged as an
    empty one; whole texts are judged at any length; equal texts are judged alike, repeated rows and null ids
    included.  Without labels everything has the probability one half and stays; an empty table stays empty.
    """
    model = train(docs, graded(labels), text_col=text_col)
    return docs.mapInArrow(partial(_keep_batches, model=model, column=docs.columns.index(text_col), keep_at=keep_at), docs.schema)
