"""Likeness of written units by matching blocks, for pairs that built-in functions can't compare; Arrow batches, never single rows."""

from __future__ import annotations

import difflib
import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


@F.pandas_udf(T.DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Share of characters in matching blocks of two texts, case and signs aside; 1 for two empty ones."""
    bare = lambda s: re.sub(r"\W+", "", s.lower())
    return pd.Series([None if x is None or y is None else difflib.SequenceMatcher(None, bare(x), bare(y)).ratio() for x, y in zip(a, b, strict=True)], dtype="float64")
