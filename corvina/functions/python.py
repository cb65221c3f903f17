"""The few functions that Spark has no expression for, as Arrow-batched UDFs."""

from __future__ import annotations

import html
import unicodedata
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


@F.pandas_udf(T.StringType())
def nfc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: unicodedata.normalize("NFC", x), na_action="ignore")


@F.pandas_udf(T.StringType())
def nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: unicodedata.normalize("NFKC", x), na_action="ignore")


@F.pandas_udf(T.StringType())
def unescape(s: pd.Series) -> pd.Series:
    return s.map(html.unescape, na_action="ignore")


@F.pandas_udf(T.DoubleType())
def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Twice the matching characters over all characters, by the matcher of the standard library; null if one is null."""
    return pd.Series([None if x is None or y is None else SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)], dtype="float64")


@F.pandas_udf(T.StringType())
def legacy_name(s: pd.Series) -> pd.Series:
    """Zip entry names without the UTF-8 flag: read as code page 437, meant as UTF-8."""

    def one(x: str) -> str:
        try:
            return x.encode("cp437").decode("utf-8")
        except UnicodeError:
            return x

    return s.map(one, na_action="ignore")
