"""Similarities without a built-in: Arrow-batched functions over public standard-library algorithms."""

from __future__ import annotations

import unicodedata
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType, LongType, StringType


def compatibility_signature(text: str) -> str:
    """NFKC, case folding, letters and digits only."""
    return "".join(c for c in unicodedata.normalize("NFKC", text or "").casefold() if c.isalnum())


@pandas_udf(DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Matcher ratio of two signatures; both empty gives 1."""
    out = []
    for x, y in zip(a, b, strict=True):
        s, t = compatibility_signature(x), compatibility_signature(y)
        out.append(1.0 if s == t else SequenceMatcher(None, s, t, autojunk=False).ratio() if min(len(s), len(t)) else 0.0)
    return pd.Series(out)


@pandas_udf(StringType())
def signature_nfkc(text: pd.Series) -> pd.Series:
    return text.map(compatibility_signature)


@pandas_udf(LongType())
def word_distance(a: pd.Series, b: pd.Series) -> pd.Series:
    """Levenshtein distance over words."""
    out = []
    for x, y in zip(a, b, strict=True):
        s, t = (x or "").split(), (y or "").split()
        row = list(range(len(t) + 1))
        for i, w in enumerate(s, 1):
            before, row[0] = row[0], i
            for j, v in enumerate(t, 1):
                before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (w != v))
        out.append(row[-1])
    return pd.Series(out)
