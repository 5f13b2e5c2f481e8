"""Feature redundancy: shared first rows of values, weighted by entropy."""

from __future__ import annotations

import hashlib

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..frame import MixedFrame
from .features import equal_width


def matrix(f: MixedFrame, k: int = 5) -> DataFrame:
    """(f1, f2, kmsnc) for f1 < f2. One job for all pairs.

    Doubles are binned. Per value the k rows of smallest key are kept, by a ranking over partial results; pairs of columns
    meet on the rows kept, weighted by how many rows have both values. Columns are few; rows are reduced before the join.
    """
    binned = [equal_width(F.col(c).cast("double"), f.stats[c][0], f.stats[c][1]).cast("string").alias(c) if dict(f.df.dtypes)[c] in ("double", "float") else F.col(c).cast("string").alias(c) for c in f.num]
    base = f.df.select(F.col(f.key).alias("key"), *binned, *[F.coalesce(F.col(c).cast("string"), F.lit("nan")).alias(c) for c in f.cat])
    columns = f.num + f.cat
    long = base.select("key", F.explode(F.array(*[F.struct(F.lit(c).alias("f"), F.col(c).alias("v")) for c in columns])).alias("e")).select("key", "e.*")
    first = long.withColumn("r", F.row_number().over(Window.partitionBy("f", "v").orderBy("key"))).where(F.col("r") <= k).select("f", "v", "key")
    a, b = first.alias("a"), first.alias("b")
    met = a.join(b, (F.col("a.key") == F.col("b.key")) & (F.col("a.f") < F.col("b.f")))
    met = met.groupBy(F.col("a.f").alias("f1"), F.col("a.v").alias("v1"), F.col("b.f").alias("f2"), F.col("b.v").alias("v2")).agg(F.count(F.lit(1)).alias("inter"))
    pairs = F.array(*[F.struct(F.lit(x).alias("f1"), F.col(x).alias("v1"), F.lit(y).alias("f2"), F.col(y).alias("v2")) for x in sorted(columns) for y in sorted(columns) if x < y])
    both = base.select(F.explode(pairs).alias("e")).select("e.*").groupBy("f1", "v1", "f2", "v2").agg(F.count(F.lit(1)).alias("c"))
    overlap = both.join(met, ["f1", "v1", "f2", "v2"], "left").groupBy("f1", "f2").agg((F.sum(F.col("c") * F.coalesce("inter", F.lit(0))) / F.lit(float(f.n * k))).alias("o"))
    h = long.groupBy("f", "v").agg(F.count(F.lit(1)).alias("c")).groupBy("f").agg((-F.sum(F.col("c") / F.lit(float(f.n)) * F.ln(F.col("c") / F.lit(float(f.n))))).alias("h"))
    out = overlap.join(h.withColumnsRenamed({"f": "f1", "h": "h1"}), "f1").join(h.withColumnsRenamed({"f": "f2", "h": "h2"}), "f2")
    return out.select("f1", "f2", F.round(F.col("o") * (F.col("h1") + F.col("h2")) / 2, 6).alias("kmsnc"))


def mean_redundancy(pairs: DataFrame) -> DataFrame:
    """(feature, mean_red) over the other features, least first when ordered."""
    both = pairs.select(F.col("f1").alias("feature"), "kmsnc").union(pairs.select("f2", "kmsnc"))
    return both.groupBy("feature").agg(F.round(F.avg("kmsnc"), 6).alias("mean_red"))


def least_redundant(pairs: DataFrame, k: int) -> list[str]:
    """The ``k`` columns of least mean redundancy, of equals the first by name."""
    return [r["feature"] for r in mean_redundancy(pairs).orderBy("mean_red", "feature").limit(k).collect()]


def as_dict(pairs: DataFrame) -> dict[tuple[str, str], float]:
    """The matrix on the driver: as many entries as there are pairs of columns."""
    return {(r["f1"], r["f2"]): r["kmsnc"] for r in pairs.collect()}


def penalty(columns: list[str], red: dict[tuple[str, str], float]) -> float:
    """1 - mean pair redundancy, clipped to 0..1; 1 for a single column, 0 for none."""
    if len(columns) < 2:
        return float(len(columns))
    pairs = [red.get((min(a, b), max(a, b)), 0.0) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    return 1 - min(1.0, max(0.0, sum(pairs) / len(pairs)))


def prune(columns: list[str], red: dict[tuple[str, str], float], most: float = 0.9) -> list[str]:
    """While a pair is above ``most``, the member that is more redundant to the set goes (of equals the first)."""
    left = list(columns)
    value = lambda a, b: red.get((min(a, b), max(a, b)), 0.0)
    while True:
        worst = max(((value(a, b), a, b) for i, a in enumerate(left) for b in left[i + 1 :]), default=(0.0, "", ""))
        if worst[0] <= most:
            return left
        mean = lambda c: sum(value(c, x) for x in left if x != c) / (len(left) - 1)
        left.remove(worst[1] if mean(worst[1]) >= mean(worst[2]) else worst[2])


def fingerprint(df: DataFrame, columns: list[str], k: int) -> str:
    """Names, size, k and content, so that a cached matrix of other data is never taken."""
    row = df.agg(F.count(F.lit(1)), F.sum(F.xxhash64(*columns).cast("decimal(38,0)"))).first()
    return hashlib.md5(f"{sorted(columns)}|{row[0]}|{row[1]}|{k}".encode()).hexdigest()[:12]


def cached(f: MixedFrame, k: int, folder: str) -> DataFrame:
    """The matrix from ``folder`` if it was written there for the same columns and content, else computed and written."""
    spark = f.df.sparkSession
    path = f"{folder.rstrip('/')}/{fingerprint(f.df, f.num + f.cat, k)}"
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
    matrix(f, k).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
