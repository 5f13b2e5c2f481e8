"""Unit space of a mixed-type table: standardised numbers and one-hot categories, rows of norm 1; one-hots stay implicit.

A row's squared norm is its numbers' plus 1 per category, and two one-hots multiply to 1 where the values are equal, so a
category of many levels costs no more than one of few.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..frame import MixedFrame, hash_order
from .features import standard

#: Rows that a task holds at a time beside the points it has chosen.
BLOCK = 4096


def scaled(f: MixedFrame) -> DataFrame:
    """Key, label, standardised numbers, categories, and the row's norm as ``_norm``."""
    df = standard(f.clean, f.num) if f.num else f.clean
    square = sum((F.col(c) * F.col(c) for c in f.num), F.lit(float(len(f.cat))))
    return df.withColumn("_norm", F.sqrt(square) + F.lit(1e-12))


def unit_columns(f: MixedFrame, levels: dict[str, list[str]]) -> DataFrame:
    """The space written out: one column per number and per listed level, rows of norm 1."""
    df = scaled(f)
    num = [(F.col(c) / F.col("_norm")).alias(c) for c in f.num]
    cat = [(F.when(F.col(c) == v, 1.0).otherwise(0.0) / F.col("_norm")).alias(f"{c}={v}") for c in f.cat for v in levels[c]]
    return df.select(f.key, *num, *cat)


def cosine_block(rows: pd.DataFrame, other: pd.DataFrame, num: list[str], cat: list[str]) -> np.ndarray:
    """(rows, other) cosine distances of scaled rows."""
    out = rows[num].to_numpy(float) @ other[num].to_numpy(float).T if num else np.zeros((len(rows), len(other)))
    for c in cat:
        out = out + (rows[c].to_numpy(object)[:, None] == other[c].to_numpy(object)[None, :])
    return 1 - out / (rows["_norm"].to_numpy()[:, None] * other["_norm"].to_numpy()[None, :])


def farthest_first(pool: pd.DataFrame, m: int, num: list[str], cat: list[str]) -> pd.DataFrame:
    """The first row, then again and again the row farthest from those taken; at most ``m``, and no row twice."""
    if len(pool) <= m:
        return pool
    taken, gap = [0], cosine_block(pool, pool.iloc[:1], num, cat)[:, 0]
    gap[0] = -np.inf
    while len(taken) < m:
        at = int(gap.argmax())
        taken.append(at)
        gap = np.minimum(gap, cosine_block(pool, pool.iloc[at : at + 1], num, cat)[:, 0])
        gap[taken] = -np.inf
    return pool.iloc[taken]


def k_center(f: MixedFrame, m: int, seed: int = 42, fan: int = 8) -> DataFrame:
    """``m`` rows that cover the table: farthest-first in every task, then over the tasks' choices, ``fan`` tasks at a time.

    A choice of choices covers all rows within a constant factor of the best radius. A task holds its m rows and one block,
    never its partition. Which rows are chosen depends on the partitioning; that they cover the table does not.
    """
    num, cat = f.num, f.cat
    df = scaled(f).withColumn("_h", hash_order(seed, f.key))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept = None
        for batch in batches:
            for at in range(0, len(batch), BLOCK):
                block = batch.iloc[at : at + BLOCK]
                both = block if kept is None else pd.concat([kept, block])
                kept = farthest_first(both.sort_values("_h", kind="stable"), m, num, cat)
        if kept is not None:
            yield kept

    parts = df.rdd.getNumPartitions()
    out = df.mapInPandas(run, df.schema)
    while parts > 1:
        parts = max(1, parts // fan)
        # An exchange, not a coalesce: that would drag the first pass over all rows into these few tasks.
        out = out.repartition(parts).mapInPandas(run, df.schema)
    return out.drop("_h", "_norm")


def centroid_similarity(f: MixedFrame) -> DataFrame:
    """Scaled rows with ``sim``, the product with their label's mean direction; centroids have one row per label."""
    df = scaled(f)
    centre = df.groupBy("label").agg(*[F.avg(F.col(c) / F.col("_norm")).alias(f"_m_{c}") for c in f.num], F.count(F.lit(1)).alias("_size"))
    for c in f.cat:
        per = df.groupBy("label", c).agg(F.sum(1 / F.col("_norm")).alias("w"))
        per = per.groupBy("label").agg(F.map_from_entries(F.collect_list(F.struct(c, "w"))).alias(f"_w_{c}"))
        centre = centre.join(per, "label")
    num = sum((F.col(c) * F.col(f"_m_{c}") for c in f.num), F.lit(0.0))
    cat = sum((F.coalesce(F.col(f"_w_{c}")[F.col(c)], F.lit(0.0)) / F.col("_size") for c in f.cat), F.lit(0.0))
    met = df.join(centre, "label").withColumn("sim", F.round((num + cat) / F.col("_norm"), 9))
    return met.drop(*[f"_m_{c}" for c in f.num], *[f"_w_{c}" for c in f.cat])


def edge_rows(df: DataFrame, label: str, by: Column, size: Column, key: str) -> DataFrame:
    """Per label the ``size`` rows least by ``by``; rows beyond an approximate quantile, taken wide, are not ranked at all."""
    ranked = df.withColumn("_by", by).withColumn("_take", size)
    share = ranked.groupBy(label).agg(F.max("_take").alias("t"), F.count(F.lit(1)).alias("n"), F.percentile_approx("_by", F.array(*[F.lit(q / 100) for q in range(1, 101)]), 10000).alias("q"))
    # One hundredth more than asked for: more than the quantile's error.
    at = F.least(F.lit(100), F.ceil(100.0 * F.col("t") / F.col("n")).cast("int") + 1)
    bound = share.select(label, F.when(at >= 100, F.lit(float("inf"))).otherwise(F.element_at("q", at)).alias("_bound"))
    near = ranked.join(bound, label).where(F.col("_by") <= F.col("_bound"))
    rank = F.row_number().over(Window.partitionBy(label).orderBy("_by", key))
    return near.withColumn("_r", rank).where(F.col("_r") <= F.col("_take")).drop("_r", "_by", "_take", "_bound")


def cluster_aware(f: MixedFrame, m: int, central: float = 0.8, least: int = 3) -> DataFrame:
    """About ``m`` landmarks in proportion to the labels: most from the label's core, the rest from its rim, each spread out
    by farthest-first in a pool of five times the size. Pools (not labels) are what a task holds."""
    num, cat, key = f.num, f.cat, f.key
    rows = centroid_similarity(f)
    quota = F.greatest(F.lit(least), F.round(F.lit(float(m)) * F.col("_size") / F.lit(float(f.n)))).cast("int")
    rows = rows.withColumn("_core", F.round(quota * F.lit(central)).cast("int")).withColumn("_rim", quota - F.col("_core")).persist()
    pool = lambda take, by: edge_rows(rows, "label", by, F.greatest(5 * take, take + 5), key)
    both = pool(F.col("_core"), -F.col("sim")).withColumn("_t", F.col("_core")).withColumn("_side", F.lit(0)).unionByName(pool(F.col("_rim"), F.col("sim")).withColumn("_t", F.col("_rim")).withColumn("_side", F.lit(1)))

    def pick(group: pd.DataFrame) -> pd.DataFrame:
        side = 1 if group["_side"].iloc[0] else -1
        return farthest_first(group.sort_values(["sim", key], ascending=[side == 1, True]), int(group["_t"].iloc[0]), num, cat)

    chosen = both.groupBy("label", "_side").applyInPandas(pick, both.schema).select(key).distinct()
    return f.clean.join(chosen, key, "left_semi")


def candidate_pool(f: MixedFrame, marks: DataFrame, score: Column, per_label: int = 50, edge: float = 0.5, seed: int = 42) -> DataFrame:
    """Per label candidates that may replace landmarks: half of highest ``score``, half of smallest hash, none a landmark."""
    rows = f.clean.join(marks.select(f.key), f.key, "left_anti").withColumn("_score", score)
    k = round(per_label * edge)
    top = edge_rows(rows, "label", -F.col("_score"), F.lit(k), f.key)
    rest = rows.join(top.select(f.key), f.key, "left_anti").withColumn("_h", hash_order(seed, f.key))
    by = F.conv(F.substring("_h", 1, 12), 16, 10).cast("double")
    return top.drop("_score").unionByName(edge_rows(rest, "label", by, F.lit(per_label - k), f.key).drop("_score", "_h"))
