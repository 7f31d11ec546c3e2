"""Dictionary expansion: a searched word against the distinct tokens of a corpus."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.stem import stem
from ..functions.text import core_length, fold, fold_text, stem_input, tokens


def dictionary(docs: DataFrame, body: str = "body") -> DataFrame:
    """(lang, raw, token, df): distinct spellings with the number of texts that hold them."""
    raw = F.array_distinct(tokens(stem_input(F.coalesce(F.col(body), F.lit("")))))
    rows = docs.select("lang", F.explode(raw).alias("raw"))
    return rows.groupBy("lang", "raw").agg(F.count("*").alias("df")).withColumn("token", fold(F.col("raw")))


def containing(docs: DataFrame, part: str) -> DataFrame:
    """Tokens that contain a folded part, with their document frequency."""
    return dictionary(docs).where(F.contains(F.col("token"), F.lit(fold_text(part))))


def inflected_forms(docs: DataFrame, word: str, lang: str) -> DataFrame:
    """Tokens of a language with the word's stem whose length differs by at most one letter."""
    wanted, length = stem(word, lang), core_length(fold_text(word))

    @F.pandas_udf(T.BooleanType())
    def same(raw: pd.Series) -> pd.Series:
        return raw.map(lambda w: abs(core_length(fold_text(w)) - length) <= 1 and stem(w, lang) == wanted)

    near = F.length("token").between(max(1, length - 1), length + 1 + 3)  # an Arabic article adds up to three
    return dictionary(docs.where(F.col("lang") == lang)).where(near).where(same(F.col("raw"))).select("lang", "raw", "token", "df")


def similar(docs: DataFrame, word: str, distance: int) -> DataFrame:
    """Tokens within an edit distance, lengths tested first."""
    word = fold_text(word)
    rows = dictionary(docs).where(F.length("token").between(len(word) - distance, len(word) + distance))
    return rows.where(F.levenshtein("token", F.lit(word), distance) >= 0)
