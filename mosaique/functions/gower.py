"""Gower distance as a Column, and as a dense kernel over blocks of rows."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def gower(left: str, right: str, num: list[str], cat: list[str], stats: dict) -> Column:
    """Mean over the columns of scaled differences and mismatches; 1 without columns."""
    if not num and not cat:
        return F.lit(1.0)
    parts = [F.abs(F.col(f"{left}.{c}") - F.col(f"{right}.{c}")) * F.lit(stats[c][2]) for c in num]
    parts += [F.when(F.col(f"{left}.{c}") == F.col(f"{right}.{c}"), 0.0).otherwise(1.0) for c in cat]
    total = parts[0]
    for p in parts[1:]:
        total = total + p
    return total / F.lit(float(len(parts)))


def cosine_distance(u: Column, v: Column) -> Column:
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    return 1 - dot(u, v) / F.sqrt(dot(u, u) * dot(v, v))


def gower_block(rows: pd.DataFrame, other: pd.DataFrame, num: list[str], cat: list[str], stats: dict) -> np.ndarray:
    """(rows, other) distances, built up column by column, so that memory is one block."""
    out = np.zeros((len(rows), len(other)))
    for c in num:
        out += np.abs(rows[c].to_numpy()[:, None] - other[c].to_numpy()[None, :]) * stats[c][2]
    for c in cat:
        codes = {v: k for k, v in enumerate(pd.unique(other[c]))}
        out += rows[c].map(codes).fillna(-1).to_numpy()[:, None] != other[c].map(codes).to_numpy()[None, :]
    return out / max(1, len(num) + len(cat)) if num or cat else out + 1.0
