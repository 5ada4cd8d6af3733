"""Unions, pivots and schema contracts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def union_relaxed(frames: list[DataFrame]) -> DataFrame:
    """By name; missing columns become null, numeric types widen."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def pivot_values(df: DataFrame, keys: list[str], key: str, value: str, names: list[str]) -> DataFrame:
    """One column per listed key (listing them spares the pass that would look for them)."""
    return df.groupBy(*keys).pivot(key, names).agg(F.first(value, ignorenulls=True))


FAMILIES = {"int": (T.ByteType, T.ShortType, T.IntegerType, T.LongType), "float": (T.FloatType, T.DoubleType, T.DecimalType), "text": (T.StringType,), "bool": (T.BooleanType,)}


def contract_violations(df: DataFrame, required: dict[str, str]) -> list[str]:
    """Missing columns, and columns of another family of types, of a published table."""
    have = {f.name: f.dataType for f in df.schema.fields}
    out = [f"missing {c}" for c in required if c not in have]
    return out + [f"{c}: {have[c].simpleString()} is no {kind}" for c, kind in required.items() if c in have and not isinstance(have[c], FAMILIES[kind])]
