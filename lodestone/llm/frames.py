"""Rows with all their columns, whatever these are called."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def columns_of(df: DataFrame) -> list[Column]:
    """All columns of ``df`` by name; names with dots or quotes too."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]


def map_rows(df: DataFrame, run: Callable) -> DataFrame:
    """``df.mapInArrow(run)`` with the columns of ``df`` in and out; batches carry them by place, not by name."""
    names = [f"c{k}" for k in range(len(df.columns))]
    schema = T.StructType([T.StructField(n, f.dataType, True) for n, f in zip(names, df.schema.fields)])
    return df.toDF(*names).mapInArrow(run, schema).toDF(*df.columns)
