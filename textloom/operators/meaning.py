"""Passages and vector search fused with word search by reciprocal ranks."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import exploded

PASSAGES, DOCUMENTS, MARGIN, FLOOR, RRF_K = 400, 60, 0.05, 0.78, 60
TARGET_WORDS, MOST_WORDS, MOST_PASSAGES = 120, 160, 12
SENTENCE_ENDS = ".!?؟\n。"


def split_passages(name: str, text: str, most: int | None = MOST_PASSAGES) -> list[tuple[int, int, str]]:
    """(start, end, text) of passages: cut at a sentence's end after 120 words, anywhere after 160.

    ``most`` ends a text after so many passages; None splits it whole.
    """
    out: list[tuple[int, int, str]] = []
    start, words = None, 0

    def close(a: int, b: int) -> None:
        body = text[a:b].strip()
        if body and (most is None or len(out) < most):
            out.append((a, b, f"{name}\n{body}" if not out and name else body))

    for m in re.finditer(r"\S+|\s+", text):
        if most is not None and len(out) >= most:
            break
        if m[0].isspace():
            stop = m.start() if words >= MOST_WORDS else m.start() + m[0].index("\n") if words >= TARGET_WORDS and "\n" in m[0] else None
        else:
            words += 1
            start = m.start() if start is None else start
            stop = next((m.start() + k for k, c in enumerate(m[0]) if c in SENTENCE_ENDS), None) if words >= TARGET_WORDS else None
        if stop is not None:  # what follows in the same word belongs to no passage
            if start is not None:
                close(start, stop + 1)
            start, words = None, 0
    if start is not None:
        close(start, len(text))
    return out or ([(0, 0, name)] if name else [])


def passages(docs: DataFrame, name: str = "name", body: str = "body", most: int | None = None) -> DataFrame:
    """(site_id, path, file, passage, start, end, text) of whole texts, or of the first ``most`` passages of each."""

    def cut(title, text):
        return [(n, *p) for n, p in enumerate(split_passages(title or "", text or "", most))]

    rows = docs.select("site_id", "path", "file", F.col(name).alias("_name"), F.col(body).alias("_body"))
    return exploded(rows, ["site_id", "path", "file"], lambda: cut, {"passage": pa.int32(), "start": pa.int32(), "end": pa.int32(), "text": pa.string()})


def clean_question(text: str) -> str:
    """A question without the operators of the query language."""
    text = re.sub(r"/(?:\\.|[^/\\])+/", " ", text)
    words = [w for w in re.split(r'[\s"«»“”|()]+', text) if w and not w.startswith("-")]
    return " ".join(w for w in words if not re.fullmatch(r"OR|AND|NOT|LIKE|NEAR(:\d+)?|LINES:\d+(\+|-\d+)?", w))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def normalize(v: Column) -> Column:
    return F.transform(v, lambda x: (x / norm(v)).cast("float"))


def quantize(v: Column) -> Column:
    """struct(vec ARRAY<TINYINT>, scale DOUBLE)."""
    scale = F.array_max(F.transform(v, F.abs)).cast("double") / 127
    return F.struct(F.transform(v, lambda x: F.when(scale > 0, F.round(x / scale)).otherwise(0).cast("tinyint")).alias("vec"), scale.alias("scale"))


def nearest(vectors: DataFrame, question: list[float], k: int = PASSAGES, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """The ``k`` rows of the greatest cosine, exactly; ties by key.  One pass and a bounded top-k."""
    asked = F.array(*[F.lit(float(x)) for x in question])
    length = sum(x * x for x in question) ** 0.5 or 1.0
    score = dot(F.col(column), asked) / (norm(F.col(column)) * F.lit(length))
    return vectors.withColumn("score", score).orderBy(F.desc("score"), key).limit(k)


#: Questions and vectors that are compared at once.
QUESTION_BLOCK, VECTOR_BLOCK = 256, 2048


def nearest_to_all(vectors: DataFrame, questions: DataFrame, k: int = 10, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """(question, key, score, place): the ``k`` nearest vectors of every question, exactly, the question itself included.

    Questions and vectors are dealt into blocks of bounded size; each pair of blocks is one matrix product that
    gives a block's best ``k``, of which the best over all blocks are kept.  Scores count to six places, ties by
    key.  Rows of a null key or vector, and vectors of length zero, are left out.
    """
    kind = dict(vectors.dtypes)[key]

    def dealt(rows: DataFrame, size: int, name: str) -> DataFrame:
        known = rows.where(F.col(key).isNotNull() & F.col(column).isNotNull()).select(F.col(key).alias("id"), F.col(column).cast("array<double>").alias("v"))
        blocks = max(1, -(-known.count() // size))
        return known.groupBy(F.pmod(F.xxhash64("id"), F.lit(blocks)).alias("block")).agg(F.collect_list(F.struct("id", "v")).alias(name)).drop("block")

    def compare(batches):
        for pdf in batches:
            for asked, own in zip(pdf["asked"], pdf["own"]):
                ids, sides = [], []
                for rows in (asked, own):
                    matrix = np.array([r["v"] for r in rows])
                    length = np.sqrt((matrix * matrix).sum(axis=1))
                    ids.append(np.array([r["id"] for r in rows])[length > 0])
                    sides.append(matrix[length > 0] / length[length > 0, None])
                scores = np.round(sides[0] @ sides[1].T, 6)
                for question, line in zip(ids[0], scores):
                    best = np.lexsort((ids[1], -line))[:k]
                    yield pd.DataFrame({"question": question, key: ids[1][best], "score": line[best]})

    pairs = dealt(questions, QUESTION_BLOCK, "asked").crossJoin(dealt(vectors, VECTOR_BLOCK, "own"))
    found = pairs.mapInPandas(compare, f"question {kind}, {key} {kind}, score double")
    place = F.row_number().over(Window.partitionBy("question").orderBy(F.desc("score"), key))
    return found.withColumn("place", place.cast("long")).where(F.col("place") <= k)


def best_passage(found: DataFrame, doc: str | list[str], passage: str) -> DataFrame:
    """The best passage of each document, or of each question and document; of equal scores the first."""
    first = F.row_number().over(Window.partitionBy(*([doc] if isinstance(doc, str) else doc)).orderBy(F.desc("score"), passage))
    return found.withColumn("_rank", first).where("_rank = 1").drop("_rank")


def relative_cut(found: DataFrame, margin: float = MARGIN, floor: float = FLOOR, by: str | None = None) -> DataFrame:
    """Rows within a margin of the best score, of all or of each question ``by``, and above a floor."""
    if by:
        top = F.max("score").over(Window.partitionBy(by))
        return found.withColumn("_top", top).where(F.col("score") >= F.greatest(F.col("_top") - margin, F.lit(floor))).drop("_top")
    top = found.agg(F.max("score").alias("_top"))
    return found.join(F.broadcast(top), F.col("score") >= F.greatest(F.col("_top") - margin, F.lit(floor))).drop("_top")


def fuse(words: DataFrame, meaning: DataFrame, key: str, k: int = RRF_K, by: str | None = None) -> DataFrame:
    """(key, score, only_meaning): sum of 1 / (k + rank) over two lists of at most a few hundred rows each.

    With ``by``, ``meaning`` has a list for each question, each of which is fused with the one list of words.
    """
    if by:
        place = F.row_number().over(Window.partitionBy(by).orderBy(F.desc("score"), key))
        near = meaning.select(by, key, place.alias("m"))
        listed = words.select(F.struct(key, F.row_number().over(Window.orderBy(F.desc("score"), key)).alias("w")).alias("x")).agg(F.collect_list("x").alias("x"))
        # the list of words, a few hundred ids, goes to every question as one value
        asked = near.select(by).distinct().join(F.broadcast(listed)).select(by, F.explode("x").alias("x")).select(by, f"x.{key}", "x.w")
        both, keys = asked.join(near, [by, key], "full"), [by, key]
    else:
        ranked = lambda df, name: df.select(key, F.row_number().over(Window.orderBy(F.desc("score"), key)).alias(name))
        both, keys = ranked(words, "w").join(ranked(meaning, "m"), key, "full"), [key]
    part = lambda c: F.when(F.col(c).isNotNull(), 1.0 / (k + F.col(c))).otherwise(0.0)
    return both.select(*keys, (part("w") + part("m")).alias("score"), F.col("w").isNull().alias("only_meaning"))


def composed_search(words: DataFrame, vectors: DataFrame, questions: DataFrame, kept: DataFrame, key: str, most: int = DOCUMENTS, column: str = "embedding") -> DataFrame:
    """(question, key, score, only_meaning): each question's nearest vectors fused with the hits of a word search, of the same rows.

    ``kept(key)`` are the rows that pass the request's filters.  It narrows the vectors before the nearest are taken, so
    a filter never leaves a question with fewer neighbours than pass it, and it narrows ``words(key, score)``.
    """
    passed = kept.select(key).distinct()
    near = nearest_to_all(vectors.join(passed, key, "left_semi"), questions, most, key, column)
    return fuse(words.join(passed, key, "left_semi"), near.select("question", key, "score"), key, by="question")


def build_index(docs: DataFrame, embed, batch: int = 32, most: int | None = None) -> DataFrame:
    """(site_id, path, file, passage, start, end, vec): ``embed`` turns a list of texts into vectors.

    An interactive index may stop each text after ``most`` = MOST_PASSAGES passages.
    """
    schema = "site_id string, path string, file string, passage int, start int, end int, vec array<float>"

    def run(batches):
        for pdf in batches:
            for at in range(0, len(pdf), batch):
                part = pdf.iloc[at : at + batch]
                yield part.drop(columns="text").assign(vec=[[float(x) for x in v] for v in embed(part["text"].tolist())])

    return passages(docs, most=most).mapInPandas(run, schema)
