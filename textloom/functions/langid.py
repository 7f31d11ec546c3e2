"""Language of a text as a column."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .stem import detect_language


def language(text: Column) -> Column:
    """The language of whole texts."""

    @F.pandas_udf(T.StringType())
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: detect_language(t, None))

    return run(text)
