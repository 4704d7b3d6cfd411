"""Schemas from a short text, without a session (workers import modules before there is one)."""

from __future__ import annotations

from pyspark.sql import types as T

_TYPES = {"string": T.StringType(), "int": T.IntegerType(), "long": T.LongType(), "double": T.DoubleType(), "boolean": T.BooleanType(), "timestamp": T.TimestampType()}


def struct(text: str, **nested: T.DataType) -> T.StructType:
    """"name type, .." with simple types, then nested fields by name."""
    fields = [T.StructField(name, _TYPES[kind]) for name, kind in (f.split() for f in text.split(","))]
    return T.StructType(fields + [T.StructField(n, t) for n, t in nested.items()])
