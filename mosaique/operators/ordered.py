"""Running sums and exact quantiles of ordered values. Values are dealt to tasks by range, so that no column is sorted in one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ranges(long: DataFrame, name: str, x: str) -> Column:
    """The number of the range of column ``x`` in which a value lies, by bounds of its own for each ``name`` (a column of few values).

    The bounds are approximate quantiles of the rows, from one pass of mergeable sketches, as many as there are shuffle
    partitions (64 at most); they deal the work, and no result depends on them. A value that many rows share is one bound.
    """
    parts = min(64, int(long.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    cuts = F.array(*[F.lit(k / parts) for k in range(1, parts)]) if parts > 1 else F.array(F.lit(0.5))
    found = long.groupBy(name).agg(F.percentile_approx(x, cuts, 20 * parts).alias("b")).collect()
    bounds = F.create_map(*[c for r in found if r["b"] for c in (F.lit(r[name]), F.array(*[F.lit(float(v)) for v in sorted(set(r["b"]))]))]) if any(r["b"] for r in found) else None
    return F.lit(0) if bounds is None else F.size(F.filter(F.element_at(bounds, F.col(name)), lambda b: b < F.col(x)))


def running(values: DataFrame, by: list[str], x: str, sums: list[str], bucket: Column) -> DataFrame:
    """``values`` (one row per ``by`` and ``x``) with ``run_<c>`` for each of ``sums``: the sum up to and with this value.

    Sums of whole ranges are small, and added up first; within a range the rows of each group are in one task.
    """
    dealt = values.withColumn("_range", bucket)
    before = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    per = dealt.groupBy(*by, "_range").agg(*[F.sum(c).alias(f"_t_{c}") for c in sums])
    offsets = per.select(*by, "_range", *[F.coalesce(F.sum(f"_t_{c}").over(before), F.lit(0)).alias(f"_o_{c}") for c in sums])
    up = Window.partitionBy(*by, "_range").orderBy(x).rowsBetween(Window.unboundedPreceding, 0)
    met = dealt.join(offsets, [*by, "_range"])
    return met.select(*values.columns, *[(F.col(f"_o_{c}") + F.sum(c).over(up)).alias(f"run_{c}") for c in sums])


def quantiles(long: DataFrame, by: list[str], x: str, probabilities: list[float]) -> DataFrame:
    """(by..., q): exact quantiles of ``x`` with linear interpolation; nulls do not count. ``by`` begins with a column of few values.

    Values are counted before they are ordered; no task holds the values of a group.
    """
    bucket = ranges(long, by[0], x)
    cell = long.where(F.col(x).isNotNull()).groupBy(*by, x).agg(F.count(F.lit(1)).alias("_c"))
    run = running(cell, by, x, ["_c"], bucket)
    total = cell.groupBy(*by).agg(F.sum("_c").alias("_n"))
    place = lambda p: F.lit(float(p)) * (F.col("_n") - 1)
    at = lambda i: F.max(F.when((F.col("run__c") - F.col("_c") <= i) & (i < F.col("run__c")), F.col(x)))
    ends = run.join(total, by).groupBy(*by).agg(F.first("_n").alias("_n"), *[a for k, p in enumerate(probabilities) for a in (at(F.floor(place(p))).alias(f"_lo{k}"), at(F.ceil(place(p))).alias(f"_hi{k}"))])
    between = lambda k, p: F.col(f"_lo{k}") + (F.col(f"_hi{k}") - F.col(f"_lo{k}")) * (place(p) - F.floor(place(p)))
    return ends.select(*by, F.array(*[between(k, p) for k, p in enumerate(probabilities)]).alias("q"))


def column_quantiles(df: DataFrame, columns: list[str], probabilities: list[float]) -> dict[str, list[float | None]]:
    """Column -> its exact quantiles (nulls if it holds no value), for all columns at once."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("f"), F.col(c).cast("double").alias("x")) for c in columns])).alias("e")).select("e.*")
    got = {r["f"]: r["q"] for r in quantiles(long, ["f"], "x", probabilities).collect()}
    return {c: got.get(c) or [None] * len(probabilities) for c in columns}
