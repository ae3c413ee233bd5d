"""Text functions that need Unicode normal forms or JavaScript-like title case, as Arrow batches."""

from __future__ import annotations

import math
import re
import unicodedata

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

_TITLE = re.compile(r"(^|[\s'’.-])([^\W\d_])")


@F.pandas_udf(T.StringType())
def normalize_term(terms: pd.Series) -> pd.Series:
    """A glossary key: NFC, lower case, single spaces."""
    return terms.map(lambda t: None if t is None else " ".join(unicodedata.normalize("NFC", t).lower().split()))


@F.pandas_udf(T.StringType())
def composed(texts: pd.Series) -> pd.Series:
    """The text in NFC."""
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))


def slug_of(text: str, most: int | None = 40, default: str = "book") -> str:
    plain = "".join(ch for ch in unicodedata.normalize("NFKD", text) if not unicodedata.combining(ch)).lower()
    out = re.sub(r"[^a-z0-9]+", "-", plain).strip("-")
    return (out[:most] if most else out) or default


@F.pandas_udf(T.StringType())
def slug(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else slug_of(t))


@F.pandas_udf(T.StringType())
def title_case(texts: pd.Series) -> pd.Series:
    """Capitals after space, apostrophe, point and dash."""
    return texts.map(lambda t: None if t is None else _TITLE.sub(lambda m: m[1] + m[2].upper(), t.lower()))


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def hash_embedding(texts: pd.Series) -> pd.Series:
    """A 64-dimensional bag of hashed words (FNV-1a, a whole count and a half), of length one."""

    def one(text):
        v = [0.0] * 64
        for w in re.findall(r"[a-z0-9']+", (text or "").lower()):
            h = 2166136261
            for ch in w:
                h = (h ^ ord(ch)) * 16777619 & 0xFFFFFFFF
            v[h % 64] += 1
            v[(h >> 8) % 64] += 0.5
        norm = math.sqrt(sum(x * x for x in v)) or 1.0
        return [x / norm for x in v]

    return texts.map(one)
