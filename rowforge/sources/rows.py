"""Input rows: from DataFrames, pandas and lists of dicts, each with a row number that stays the same."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import no_nan
from .workspace import Workspace, fresh

ROW = "_row_id"


def from_list(spark: SparkSession, rows: Sequence[dict[str, Any]], schema: str | T.StructType | None = None) -> DataFrame:
    """Dicts as rows; a key that a row lacks is null there. Columns are in the order in which they are first seen."""
    names = list(dict.fromkeys(k for r in rows for k in r))
    if schema is None:
        schema = T.StructType([T.StructField(n, _type_of([r.get(n) for r in rows])) for n in names])
    elif isinstance(schema, str):
        schema = T.StructType.fromDDL(schema)
    clean = [tuple(_clean(r.get(f.name), f.dataType) for f in schema) for r in rows]
    return spark.createDataFrame(clean, schema)


def _type_of(values: list[Any]) -> T.DataType:
    kinds = {type(v) for v in values if v is not None and not (isinstance(v, float) and v != v)}
    if not kinds:
        return T.StringType()
    if kinds == {bool}:
        return T.BooleanType()
    if kinds == {int}:
        return T.LongType()
    if kinds <= {int, float}:
        return T.DoubleType()
    if kinds <= {str}:
        return T.StringType()
    import datetime
    import decimal

    if kinds <= {datetime.datetime}:
        return T.TimestampNTZType()
    if kinds <= {datetime.date}:
        return T.DateType()
    if kinds <= {decimal.Decimal}:
        return T.DecimalType(38, 18)
    if kinds <= {list, tuple} and all(isinstance(x, str) for v in values if v for x in v):
        return T.ArrayType(T.StringType())
    return T.StringType()  # dicts and mixtures as JSON


def _clean(v: Any, t: T.DataType) -> Any:
    from ..functions.validate import canonical

    if v is None or isinstance(v, float) and v != v:
        return None
    if isinstance(t, T.StringType) and not isinstance(v, str):
        return canonical(v)
    return float(v) if isinstance(t, T.DoubleType) else v


def to_frame(spark: SparkSession, data: DataFrame | pd.DataFrame | Sequence[dict[str, Any]]) -> DataFrame:
    if isinstance(data, DataFrame):
        return data
    if isinstance(data, pd.DataFrame):
        if not data.columns.is_unique:
            raise ValueError("column names must differ")
        rows = data.astype(object).where(data.notna(), None).to_dict("records")
        return from_list(spark, rows, None) if rows else spark.createDataFrame([], T.StructType([T.StructField(str(c), T.StringType()) for c in data.columns]))
    return from_list(spark, data)


def numbered(df: DataFrame, work: Workspace, row_key: str | None = None, order_by: Sequence[str] = ()) -> DataFrame:
    """df, NaN as null, with ``_row_id`` in front.

    The number is the ``row_key`` column where one is named, which must be unique and integer; else the place in
    ``order_by`` order, or in the order in which the input is read: rows are written once with their place in their
    partition, and the partitions' sizes, which are few, give each its first number. No task ever sees all rows.
    """
    if dup := sorted({c for c in df.columns if [x.lower() for x in df.columns].count(c.lower()) > 1}):
        raise ValueError(f"column names must differ: {', '.join(dup)}")
    df = no_nan(df)
    if row_key is not None:
        return df.select(F.col(f"`{row_key}`").cast("long").alias(ROW), *[F.col(f"`{c}`") for c in df.columns if c != ROW])
    if ROW in df.columns:
        return df
    place, part, first = fresh(df.columns, "__rf_place", "__rf_part", "__rf_first")
    ordered = df.orderBy(*order_by) if order_by else df
    kept = work.write(ordered.withColumn(place, F.monotonically_increasing_id()), "rows")
    sizes = sorted(kept.groupBy(F.shiftright(place, 33).alias(part)).count().collect())
    starts, at = [], 0
    for r in sizes:
        starts.append((r[0], at))
        at += r["count"]
    offsets = kept.sparkSession.createDataFrame(starts, f"{part} long, {first} long")
    back = [F.col(f"`{c}`") for c in df.columns]
    within = F.col(place).bitwiseAND(F.lit((1 << 33) - 1))
    return kept.withColumn(part, F.shiftright(place, 33)).join(F.broadcast(offsets), part).select((F.col(first) + within).alias(ROW), *back)


def beside(left: DataFrame, right: DataFrame, on: str = ROW, how: str = "inner") -> DataFrame:
    """A join by a shuffle of both sides, never by a broadcast.

    Spark takes a written table for as large as its files. Steps' columns are nearly the same in all rows, so they are compressed to
    a hundredth of what a broadcast takes on the driver.
    """
    return left.join(right.hint("merge"), on, how)
