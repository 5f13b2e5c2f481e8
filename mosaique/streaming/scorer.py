"""Scores a stream of rows against frozen prototypes, and counts clusters per window."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..frame import MixedFrame
from ..operators.cluster import assign


def score(f: MixedFrame, rows: DataFrame, prototypes: list[dict], gamma: float = 1.0) -> DataFrame:
    """Nearest prototype per row: literals only, so that the query holds no state."""
    return assign(f, rows, prototypes, gamma)


def drift(scored: DataFrame, ts: str, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Rows per window and cluster; state is dropped once the watermark has passed a window."""
    return scored.withWatermark(ts, late).groupBy(F.window(ts, width), "cluster").agg(F.count(F.lit(1)).alias("n"), F.avg("cost").alias("mean_cost"))
