"""Embeddings on the wire: base64 of little-endian 32-bit floats (MAP2, MAP3)."""

from __future__ import annotations

import base64

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf


@pandas_udf(T.ArrayType(T.DoubleType()))
def _floats(raw: pd.Series) -> pd.Series:
    return raw.map(lambda b: None if b is None else np.frombuffer(b, "<f4").astype("f8"))


def _text(numbers) -> str | None:
    return None if numbers is None else base64.b64encode(np.asarray(numbers, "<f4").tobytes()).decode()


@pandas_udf(T.StringType())
def encode_floats(v: pd.Series) -> pd.Series:
    """Base64 text of an array of numbers in single precision."""
    return v.map(_text)


@pandas_udf(T.ArrayType(T.StringType()))
def encode_each(v: pd.Series) -> pd.Series:
    """Base64 texts of several arrays of numbers."""
    return v.map(lambda arrays: None if arrays is None else [_text(x) for x in arrays])


def float_bytes(text: Column) -> Column:
    """Bytes of a base64 text; null if it is no base64 or holds no whole number of floats."""
    raw = F.try_to_binary(text, F.lit("base64"))
    return F.when(F.length(raw) % 4 == 0, raw)


def decode_floats(text: Column) -> Column:
    """Array of double of a base64 text, or null. Spark cannot read bytes as floats: an Arrow function does."""
    return _floats(float_bytes(text))
