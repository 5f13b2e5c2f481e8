"""Scaling, encoding and binning as projections over one-row statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordered import column_quantiles


def standard(df: DataFrame, columns: list[str]) -> DataFrame:
    """(x - mean) / population deviation; a constant column becomes 0."""
    row = df.agg(*[x for c in columns for x in (F.avg(c).alias(f"m_{c}"), F.stddev_pop(c).alias(f"s_{c}"))]).first()
    return df.withColumns({c: (F.col(c) - F.lit(row[f"m_{c}"])) / F.lit(row[f"s_{c}"] or 1.0) for c in columns})


def robust(df: DataFrame, columns: list[str]) -> DataFrame:
    """(x - median) / interquartile range, by exact percentiles."""
    row = column_quantiles(df, columns, [0.25, 0.5, 0.75])
    return df.withColumns({c: (F.col(c) - F.lit(row[c][1])) / F.lit((row[c][2] - row[c][0]) or 1.0) for c in columns})


def unit_rows(columns: list[Column]) -> list[Column]:
    """The columns over the row's Euclidean norm."""
    norm = F.sqrt(sum((c * c for c in columns[1:]), columns[0] * columns[0])) + F.lit(1e-12)
    return [c / norm for c in columns]


def one_hot(df: DataFrame, column: str, levels: list[str]) -> DataFrame:
    return df.withColumns({f"{column}={v}": (F.col(column) == v).cast("int") for v in levels})


def equal_width(x: Column, lo: float, hi: float, bins: int = 10) -> Column:
    """Right-closed bins of equal width from 0; the least value is in the first; a constant has one bin."""
    if hi <= lo:
        return F.lit(0)
    return F.least(F.lit(bins - 1), F.greatest(F.lit(0), F.ceil((x - F.lit(lo)) / F.lit(hi - lo) * F.lit(float(bins))) - 1)).cast("int")


def quantile_bins(df: DataFrame, column: str, bins: int = 10) -> DataFrame:
    """Right-closed quantile bins; equal edges are one."""
    edges = sorted({e for e in column_quantiles(df, [column], [k / bins for k in range(bins + 1)])[column] if e is not None})
    code = F.lit(0)
    for k in range(1, len(edges) - 1):
        code = code + (F.col(column) > F.lit(edges[k])).cast("int")
    return df.withColumn(f"{column}_bin", code)


def signature(columns: list[str]) -> Column:
    return F.concat_ws("-", *[F.col(c).cast("string") for c in columns])
