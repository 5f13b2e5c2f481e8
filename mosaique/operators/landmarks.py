"""Landmarks, samples and prototypes."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..frame import MixedFrame, hash_order
from ..functions.gower import gower, gower_block

#: Of landmarks and the like at most about so many bytes lie in a task at once.
MOST_BROADCAST = 64 << 20


def landmark_count(n: int, k: int, c: float = 3.0, per_cluster: int = 3, cap: float = 0.2) -> int:
    k = max(2, k)
    return max(k * per_cluster, min(int(c * math.sqrt(n)), int(cap * n), n))


def sample(df: DataFrame, key: str, m: int, seed: int = 42) -> DataFrame:
    """Exactly ``m`` rows, those of the smallest hash: a top-k per task, not a sort of the table."""
    return df.orderBy(hash_order(seed, key), key).limit(m)


def label_sizes(df: DataFrame, label: str) -> dict:
    """Label -> its rows; labels are few (clusters, classes of a column)."""
    return {r[0]: r[1] for r in df.groupBy(label).agg(F.count(F.lit(1))).collect() if r[0] is not None}


def stratified(df: DataFrame, key: str, label: str, m: int, least: int = 3, seed: int = 42, known: dict | None = None) -> DataFrame:
    """Per label max(least, round(m * share)) rows of the smallest hash. ``known`` has the labels' sizes, if they are.

    Rows that cannot be among the first (by a bound on the hash that leaves twice the quota, and all rows of small labels)
    are filtered before the ranking, so that the window sorts about as many rows as it keeps.
    """
    known = label_sizes(df, label) if known is None else known
    total = sum(known.values())
    quota = {v: max(least, math.floor(m * n / total + 0.5)) for v, n in known.items()}
    if not quota:
        return df.limit(0)
    of = lambda values: F.element_at(F.create_map(*[F.lit(x) for pair in values.items() for x in pair]), F.col(label))
    ranked = df.where(F.col(label).isNotNull()).withColumn("_h", hash_order(seed, key))
    share = F.conv(F.substring("_h", 1, 12), 16, 10).cast("double") / F.lit(float(1 << 48))
    near = ranked.where(share <= of({v: (2.0 * quota[v] + 50.0) / n for v, n in known.items()}))
    w = Window.partitionBy(label).orderBy("_h", key)
    return near.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= of(quota)).drop("_r", "_h")


def dealt(rows: DataFrame, key: str) -> Iterator[pd.DataFrame]:
    """The rows on the driver, in parts of about ``MOST_BROADCAST`` bytes at most, one after the other; one part at least.

    Rows of a part are those of one residue of a hash, so that parts are the same for any partitioning. What is done with
    the parts is for the caller to put together: no set of landmarks is too large, it only takes more passes.
    """
    text = [F.coalesce(F.octet_length(c), F.lit(0)) for c, t in rows.dtypes if t == "string"]
    width = sum(text, F.lit(16.0 * len(rows.columns) + 60.0 * len(text))) + sum((8.0 * F.coalesce(F.size(c), F.lit(0)) for c, t in rows.dtypes if t.startswith("array")), F.lit(0.0))
    some = rows.persist()
    size = some.agg(F.sum(width)).first()[0] or 0
    parts = max(1, math.ceil(size / MOST_BROADCAST))
    for part in range(parts):
        yield (some if parts == 1 else some.where(F.pmod(F.xxhash64(key), F.lit(parts)) == part)).toPandas()
    some.unpersist()


def medoids(f: MixedFrame, cap: int = 64, seed: int = 42) -> DataFrame:
    """Per label the sampled row with the least sum of distances to the label's other sampled rows."""
    d = gower("a", "b", f.num, f.cat, f.stats)
    some = stratified(f.clean, f.key, "label", 0, cap, seed)
    pairs = some.alias("a").join(some.alias("b"), F.col("a.label") == F.col("b.label"))
    sums = pairs.groupBy(F.col("a.label").alias("label"), F.col(f"a.{f.key}").alias("key")).agg(F.round(F.sum(d), 9).alias("s"))
    return sums.groupBy("label").agg(F.min(F.struct("s", "key")).alias("m")).select("label", F.col("m.key").alias("medoid"), F.round("m.s", 6).alias("total"))


def prototypes(f: MixedFrame, per_label: int = 2, cap: int = 64, seed: int = 42) -> DataFrame:
    """(label, place, key): per label its medoid among ``cap`` sampled rows, then rows that lie farthest from those chosen.

    The first has the least sum of distances; each next one the greatest sum of distances to those before it; of equals
    the smallest key. A label's sample is bounded by ``cap``.
    """
    num, cat, stats, key = f.num, f.cat, f.stats, f.key

    def pick(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(key)
        d = np.round(gower_block(rows, rows, num, cat, stats), 9)
        chosen = [int(np.round(d.sum(axis=1), 9).argmin())]
        while len(chosen) < min(per_label, len(rows)):
            far = np.round(d[:, chosen].sum(axis=1), 9)
            far[chosen] = -1
            chosen.append(int(far.argmax()))
        return pd.DataFrame({"label": rows["label"].astype(str).iloc[0], "place": np.arange(1, len(chosen) + 1), "key": rows[key].to_numpy()[chosen]})

    some = stratified(f.clean, key, "label", 0, cap, seed)
    return some.groupBy("label").applyInPandas(pick, "label string, place int, key long")
