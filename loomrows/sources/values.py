"""Inline relations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..plans.types import _literal, shown, wider


def values_frame(spark: SparkSession, rows: list[list[object]], columns: list[str]) -> DataFrame:
    """A frame of literal rows; each column has the widest type of its values."""
    schema = T.StructType()
    for k, name in enumerate(columns):
        kind: T.DataType = T.NullType()
        for r in rows:
            kind = wider(kind, _literal(r[k]))
        schema.add(name, shown(kind))
    fixed = [tuple(float(v) if isinstance(f.dataType, T.DoubleType) and v is not None else v for v, f in zip(r, schema, strict=True)) for r in rows]
    return spark.createDataFrame(fixed, schema).coalesce(1)
