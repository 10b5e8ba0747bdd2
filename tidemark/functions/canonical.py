"""Canonical JSON (sorted keys, no spaces) and hashes of it.

Spark's own ``to_json`` drops nulls and prints floats differently, so the exact bytes need Python;
the function works on Arrow batches.
"""

from __future__ import annotations

import hashlib
import json

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

GENESIS = "0" * 64


def canonical_text(value) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"))


def _one(text: str | None) -> str | None:
    try:
        return None if text is None else canonical_text(json.loads(text))
    except ValueError:
        return None


@F.pandas_udf(T.StringType())
def canonical_json(texts: pd.Series) -> pd.Series:
    """The canonical form of JSON texts; null where a text is null or no JSON."""
    return texts.map(_one)


def link_hash(prev: str, body: str) -> str:
    return hashlib.sha256(f"{prev}:{body}".encode()).hexdigest()
