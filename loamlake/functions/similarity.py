"""Similarity of two texts by matching blocks."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def ratio(a: str | None, b: str | None) -> float:
    return SequenceMatcher(None, a or "", b or "", autojunk=False).ratio()


@F.pandas_udf(DoubleType())
def _ratios(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([ratio(x, y) for x, y in zip(a, b, strict=True)])


def similarity(a: Column, b: Column) -> Column:
    """2 * matched / total characters; quadratic in the worst case, so give it matched pairs only. Equal texts skip it."""
    return F.when(a == b, F.lit(1.0)).otherwise(_ratios(F.when(a != b, a), F.when(a != b, b)))
