"""Toxicity by non-negative positive-unlabelled learning.

Training sees confirmed toxic texts and unlabelled ones, a share of which (the class prior) is toxic too.  With the
logistic loss l, the risk over all texts is prior * E_toxic[l(+)] + max(0, E_unlabelled[l(-)] - prior * E_toxic[l(-)]):
the second term is the risk on texts that are not toxic, corrected for the toxic ones among the unlabelled.  It cannot
be negative, so where the estimate is, a step goes against it instead of after it.

Features are a text's distinct words and the beginnings of words.  Only those count that toxic texts have too often for
chance: the Poisson tail of their number there, at the rate of the unlabelled texts, is bounded in Spark.  The fit runs
on the driver over a bounded sample; scoring reads whole texts in Arrow batches.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import discard, materialize, return_memory

#: The fit uses at most so many confirmed toxic and so many unlabelled texts: those of the least hashes.
POSITIVE_ROWS, UNLABELLED_ROWS = 5000, 15_000
#: And at most so many features, those that chance explains least.
FEATURES = 4000
#: A feature counts if at least so many toxic texts have it, and chance gives it no more than this probability.
LEAST_TEXTS, CHANCE = 3, 1e-6
#: Lengths in bytes of the beginnings of words that are features.
BEGINNINGS = (4, 5, 6)
#: From this score on a text is taken for toxic.
PREDICT_AT = 0.3
#: Bytes of a text that are split at a time.
PIECE = 1 << 20

_WORDS_ONLY = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(text: str | None) -> set[bytes]:
    """The distinct words of a whole text: runs of letters (A-Z lower-cased) and characters beyond ASCII."""
    raw = (text or "").encode("utf-8", "surrogatepass").translate(_WORDS_ONLY)
    if len(raw) <= PIECE:
        return set(raw.split())
    found, start = set(), 0
    while start < len(raw):
        end = raw.find(b" ", start + PIECE)
        end = len(raw) if end < 0 else end
        found.update(raw[start:end].split())
        start = end
    return found


def kinds_of(words: set[bytes]) -> Iterator[tuple[int, set[bytes]]]:
    """(kind, names): whole words are kind 0, longer words' beginnings have their length as kind."""
    yield 0, words
    for k in BEGINNINGS:
        yield k, {w[:k] for w in words if len(w) > k}


def held_out(id_col: str) -> Column:
    """Rows whose labels are never learned: crc32 of the id in decimal leaves 2 by 4; a null id is not one of them."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def confirmed(labels: DataFrame, id_col: str = "doc_id") -> tuple[DataFrame, float]:
    """(ids of confirmed toxic rows, share of them among all labelled rows), without the held-out rows.

    Null ids and labels are ignored; an id that is labelled in both ways is toxic.  Without labels the share is 0.
    """
    known = labels.where(F.col(id_col).isNotNull() & F.col("toxic").isNotNull() & ~held_out(id_col))
    each = known.groupBy(F.col(id_col).alias("id")).agg(F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    share = each.agg(F.avg("toxic")).first()[0]
    return each.where("toxic = 1").select("id"), float(share or 0.0)


def _distinct_sample(rows: DataFrame, most: int) -> DataFrame:
    """(h, text): at most ``most`` distinct rows of ``rows(h, text)`` by the least hashes; keys are chosen before texts move."""
    keys = rows.select("h").distinct().orderBy("h").limit(most)
    keys = materialize(keys, "sampled")
    return rows.join(F.broadcast(keys), "h", "left_semi").groupBy("h").agg(F.first("text").alias("text"))  # at most ``most`` numbers


def sample(docs: DataFrame, toxic: DataFrame, id_col: str, text_col: str, positives: int, unlabelled: int) -> DataFrame:
    """(h, positive, text): the texts that the fit sees, a bounded number of distinct ones.

    Toxic texts are distinct by text.  Unlabelled ones are rows of all that are not held out, whatever their labels.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.where(~held_out(id_col)).select(F.col(id_col).alias("id"), text.alias("text"))
    some = toxic.orderBy(F.xxhash64("id"), "id").limit(positives)
    own = rows.join(F.broadcast(materialize(some, "toxic-ids")), "id", "left_semi").select(F.xxhash64("text").alias("h"), "text")
    # some more than are wanted pass by their hashes, without a shuffle
    share = min(1.0, 3 * unlabelled / max(1, docs.count()))
    row_hash = F.xxhash64("id", "text")
    others = rows.select(row_hash.alias("h"), "text").where(F.col("h") <= min((1 << 63) - 1, int(share * (1 << 64)) - (1 << 63)))
    chosen = [_distinct_sample(own, positives).withColumn("positive", F.lit(True)), _distinct_sample(others, unlabelled).withColumn("positive", F.lit(False))]
    return chosen[0].unionByName(chosen[1]).select("h", "positive", "text")


def _named_batches(batches):
    kind = pa.schema([("h", pa.int64()), ("positive", pa.bool_()), ("kind", pa.int32()), ("names", pa.list_(pa.binary()))])
    for batch in batches:
        for h, positive, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
            rows = [(k, sorted(names)) for k, names in kinds_of(words_of(text.as_py()))]
            yield pa.RecordBatch.from_arrays([pa.array([h] * len(rows)), pa.array([positive] * len(rows)), pa.array([k for k, _ in rows], pa.int32()), pa.array([n for _, n in rows], kind.field(3).type)], schema=kind)
    return_memory()


def telling_features(named: DataFrame, n_positive: int, n_unlabelled: int, most: int = FEATURES) -> DataFrame:
    """(kind, name) that toxic texts have too often for chance, of ``named(positive, kind, names)``; at most ``most``.

    With u of the unlabelled texts, chance gives them lam = n_positive (u + 1 + sqrt(u + 1)) / n_unlabelled toxic texts on
    average; that it gives k or more has at most the probability exp(k - lam - k ln(k / lam)).
    """
    each = named.select("kind", F.explode("names").alias("name"), "positive").groupBy("kind", "name")
    counted = each.agg(F.count_if("positive").alias("k"), (F.count_if(~F.col("positive")) + 1).alias("u"))
    lam = F.lit(n_positive) * (F.col("u") + F.sqrt("u")) / F.lit(max(1, n_unlabelled))
    tested = counted.where(F.col("k") >= LEAST_TEXTS).withColumn("lam", lam).where("k > lam")
    bounded = tested.withColumn("bound", F.col("k") - F.col("lam") - F.col("k") * F.log(F.col("k") / F.col("lam"))).where(F.col("bound") < math.log(CHANCE))
    return bounded.orderBy("bound", "kind", "name").limit(most).select("kind", "name")


@dataclass
class Model:
    """Weights of words and of beginnings of words, by kind, and a bias."""

    weights: dict[int, dict[bytes, float]]
    bias: float

    def score(self, text: str | None) -> float:
        found = [self.bias]
        for k, names in kinds_of(words_of(text)):
            own = self.weights.get(k, {})
            found += [own[n] for n in names & own.keys()] if len(names) < len(own) else [own[n] for n in own.keys() & names]
        return 1 / (1 + math.exp(min(700.0, max(-700.0, -math.fsum(found)))))


def nn_pu_fit(index: np.ndarray, sizes: np.ndarray, positive: np.ndarray, features: int, prior: float, steps: int = 600, rate: float = 0.05, ridge: float = 2e-4) -> tuple[np.ndarray, float]:
    """(weights, bias) of the least non-negative risk, by full-batch Adam.

    ``index`` has the features of all texts joined, ``sizes`` their number in each, ``positive`` the toxic ones.  The same
    rows in the same order give the same model.
    """
    n, owner = len(sizes), np.repeat(np.arange(len(sizes)), sizes)
    toxic = np.where(positive, prior / max(1, positive.sum()), 0.0)
    rest = np.where(positive, 0.0, 1 / max(1, (~positive).sum())) - toxic  # weights of the corrected negative risk
    w, bias = np.zeros(features), math.log(prior / (1 - prior))
    m, v = np.zeros(features + 1), np.zeros(features + 1)
    for step in range(1, steps + 1):
        g = np.bincount(owner, w[index], minlength=n) + bias
        p = 1 / (1 + np.exp(-np.clip(g, -30, 30)))
        negative = (rest * np.logaddexp(0, g)).sum()
        slope = toxic * (p - 1) + rest * p if negative >= 0 else -rest * p
        gradient = np.concatenate([np.bincount(index, slope[owner], minlength=features) + ridge * w, [slope.sum()]])
        m, v = 0.9 * m + 0.1 * gradient, 0.999 * v + 0.001 * gradient**2
        move = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w, bias = w - move[:-1], bias - move[-1]
    return w, float(bias)


def _index_batches(batches, places: dict[int, dict[bytes, int]]):
    for batch in batches:
        rows = [np.array([own[n] for n in names if n in own], np.int32).tobytes() for own, names in zip((places.get(k, {}) for k in batch.column(2).to_pylist()), batch.column(3).to_pylist())]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(rows, pa.binary())], ["h", "positive", "kind", "index"])


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", positives: int = POSITIVE_ROWS, unlabelled: int = UNLABELLED_ROWS) -> Model:
    """Fit on bounded samples of confirmed toxic rows and of unlabelled ones, none of them held out.

    A null text is an empty one.  The class prior is the share of toxic rows among those whose labels may be learned.
    Without a confirmed toxic text, or a feature that tells, the model gives every text the prior.
    """
    toxic, share = confirmed(labels)
    prior = min(0.999, max(1e-3, share))
    texts = sample(docs, toxic, id_col, text_col, positives, unlabelled)
    named = materialize(texts.mapInArrow(_named_batches, "h long, positive boolean, kind int, names array<binary>"), "toxic-features")
    numbers = {r["positive"]: r["n"] for r in named.where("kind = 0").groupBy("positive").agg(F.count("*").alias("n")).collect()}
    chosen = sorted((r["kind"], bytes(r["name"])) for r in telling_features(named, numbers.get(True, 0), numbers.get(False, 0)).collect())
    if not chosen:
        discard(named)
        return Model({}, math.log(prior / (1 - prior)))
    places: dict[int, dict[bytes, int]] = {}
    for i, (kind, name) in enumerate(chosen):
        places.setdefault(kind, {})[name] = i
    indexed = named.mapInArrow(partial(_index_batches, places=places), "h long, positive boolean, kind int, index binary")
    rows = indexed.where("kind = 0 or length(index) > 0").orderBy("positive", "h", "kind").collect()  # at most four of each sampled text, of FEATURES numbers together
    index, sizes, positive, before = [], [], [], None
    for r in rows:
        own = np.frombuffer(r["index"], np.int32)
        if (r["positive"], r["h"]) != before:
            before = (r["positive"], r["h"])
            sizes.append(0)
            positive.append(r["positive"])
        sizes[-1] += len(own)
        index.append(own)
    discard(named)
    w, bias = nn_pu_fit(np.concatenate(index), np.array(sizes), np.array(positive, bool), len(chosen), prior)
    return Model({k: {name: float(w[i]) for name, i in own.items()} for k, own in places.items()}, bias)


def _score_batches(batches, model: Model):
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([round(model.score(t.as_py()), 9) for t in batch.column(2)], pa.float64())], ["id", "held_out", "score"])
    return_memory()


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", predict_at: float = PREDICT_AT) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row: the probability that its whole text is toxic.

    A null text is an empty one; equal texts get equal scores; repeated rows and null ids stay; an empty table stays
    empty; other columns are ignored.
    """
    kind = dict(docs.dtypes)[id_col]
    rows = docs.select(F.col(id_col).alias("id"), held_out(id_col).alias("held_out"), F.col(text_col).alias("text"))
    scored = rows.mapInArrow(partial(_score_batches, model=model), f"id {kind}, held_out boolean, score double")
    return scored.select(F.col("id").alias(id_col), "held_out", "score", (F.col("score") >= predict_at).cast("int").alias("predicted"))


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Learn from the labels that are not held out, and score all of ``docs``; see :func:`train` and :func:`score`."""
    return score(docs, train(docs, labels))
