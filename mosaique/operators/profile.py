"""Statistics that describe clusters. Columns are unpivoted, so that a statistic is one job for all of them."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import tails
from .ordered import quantiles, ranges, running


def _tail(name: str, *of: Column) -> Column:
    """Upper tail of a distribution, rounded; one value per feature, so that the function need not be fast."""
    f = getattr(tails, name)
    told = F.pandas_udf(lambda *x: pd.Series([None if any(pd.isna(v) for v in r) or min(r[1:]) <= 0 else f(*map(float, r)) for r in zip(*x, strict=True)], dtype="float64"), "double")
    return F.round(told(*[c.cast("double") for c in of]), 6)


def sizes(df: DataFrame, label: str) -> DataFrame:
    g = df.groupBy(F.col(label).alias("cluster")).agg(F.count(F.lit(1)).alias("n"))
    return g.select("cluster", "n", F.round(F.col("n") / F.sum("n").over(Window.partitionBy()), 6).alias("fraction"))


def _num(df: DataFrame, label: str, num: list[str]) -> DataFrame:
    return df.select(F.col(label).alias("cluster"), F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("x")) for c in num])).alias("e")).select("cluster", "e.*").where("x is not null")


def _cat(df: DataFrame, label: str, cat: list[str]) -> DataFrame:
    return df.select(F.col(label).alias("cluster"), F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.coalesce(F.col(c).cast("string"), F.lit("nan")).alias("v")) for c in cat])).alias("e")).select("cluster", "e.*")


def numeric(df: DataFrame, label: str, num: list[str]) -> DataFrame:
    """Per feature and cluster: mean, median, interquartile range and difference to the overall mean."""
    long = _num(df, label, num)
    every = long.groupBy("feature").agg(F.avg("x").alias("g"))
    per = long.groupBy("feature", "cluster").agg(F.avg("x").alias("m")).join(quantiles(long, ["feature", "cluster"], "x", [0.25, 0.5, 0.75]), ["feature", "cluster"])
    return per.join(F.broadcast(every), "feature").select("feature", "cluster", F.round("m", 5).alias("mean"), F.round(F.col("q")[1], 5).alias("median"), F.round(F.col("q")[2] - F.col("q")[0], 5).alias("iqr"), F.round(F.col("m") - F.col("g"), 5).alias("diff_vs_global"))


def lifts(df: DataFrame, label: str, cat: list[str], k: int = 10) -> DataFrame:
    """Per feature and cluster the ``k`` categories of highest lift (share in the cluster over share overall)."""
    c = _cat(df, label, cat).groupBy("feature", "cluster", "v").agg(F.count(F.lit(1)).alias("c"))
    values = c.groupBy("feature", "v").agg(F.sum("c").alias("vc"))
    per = c.groupBy("feature", "cluster").agg(F.sum("c").alias("cc"))
    grid = values.join(per, "feature").join(c, ["feature", "cluster", "v"], "left")
    n = F.sum("vc").over(Window.partitionBy("feature", "cluster"))
    out = grid.withColumn("lift", F.round((F.coalesce("c", F.lit(0)) / F.col("cc")) / (F.col("vc") / n + 1e-12), 6))
    w = Window.partitionBy("feature", "cluster").orderBy(F.desc("lift"), "v")
    return out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("feature", "cluster", F.col("v").alias("value"), "lift", "rank")


def anova(df: DataFrame, label: str, num: list[str]) -> DataFrame:
    """F of a one-way analysis of variance per feature, with its degrees of freedom and its p."""
    per = _num(df, label, num).groupBy("feature", "cluster").agg(F.count("x").alias("n"), F.avg("x").alias("m"), F.var_pop("x").alias("v"))
    grand = per.groupBy("feature").agg((F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("g"))
    one = per.join(F.broadcast(grand), "feature").groupBy("feature").agg(F.sum(F.col("n") * F.pow(F.col("m") - F.col("g"), F.lit(2.0))).alias("b"), F.sum(F.col("n") * F.col("v")).alias("w"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("k"))
    f, dof1, dof2 = (F.col("b") / (F.col("k") - 1)) / (F.col("w") / (F.col("n") - F.col("k"))), F.col("k") - 1, F.col("n") - F.col("k")
    return one.select("feature", F.round(f, 5).alias("f_stat"), dof1.alias("dof1"), dof2.alias("dof2"), _tail("f_sf", f, dof1, dof2).alias("p"))


def kruskal(df: DataFrame, label: str, num: list[str]) -> DataFrame:
    """Kruskal-Wallis H per feature with tie correction, and its p. Ranks come from running counts of distinct values, by ranges."""
    long = _num(df, label, num)
    cell = long.groupBy("feature", "x", "cluster").agg(F.count(F.lit(1)).alias("c"))
    value = cell.groupBy("feature", "x").agg(F.sum("c").alias("t"))
    rank = running(value, ["feature"], "x", ["t"], ranges(long, "feature", "x")).withColumn("r", F.col("run_t") - (F.col("t") - 1) / 2)
    total = rank.groupBy("feature").agg(F.sum("t").cast("double").alias("n"), F.sum(F.pow(F.col("t").cast("double"), F.lit(3.0)) - F.col("t")).alias("ties"))
    sums = cell.join(rank, ["feature", "x"]).groupBy("feature", "cluster").agg(F.sum(F.col("c") * F.col("r")).alias("s"), F.sum("c").alias("m"))
    one = sums.groupBy("feature").agg(F.sum(F.col("s") * F.col("s") / F.col("m")).alias("q"), F.count(F.lit(1)).alias("k")).join(total, "feature")
    h = 12 / (F.col("n") * (F.col("n") + 1)) * F.col("q") - 3 * (F.col("n") + 1)
    h = h / (1 - F.col("ties") / (F.pow("n", F.lit(3.0)) - F.col("n")))
    return one.select("feature", F.round(h, 4).alias("h_stat"), (F.col("k") - 1).alias("dof"), _tail("chi2_sf", h, F.col("k") - 1).alias("p"))


def chi_square(df: DataFrame, label: str, cat: list[str]) -> DataFrame:
    """Chi-square with its p, and Cramer's V per feature; with one degree of freedom differences are corrected by up to one half."""
    c = _cat(df, label, cat).groupBy("feature", "cluster", "v").agg(F.count(F.lit(1)).alias("c"))
    rows = c.groupBy("feature", "cluster").agg(F.sum("c").alias("rs"))
    cols = c.groupBy("feature", "v").agg(F.sum("c").alias("cs"))
    dims = c.groupBy("feature").agg(F.countDistinct("cluster").alias("r"), F.countDistinct("v").alias("k"), F.sum("c").cast("double").alias("n"))
    full = rows.join(cols, "feature").join(c, ["feature", "cluster", "v"], "left").join(F.broadcast(dims), "feature")
    e = F.col("rs") * F.col("cs") / F.col("n")
    gap = F.abs(F.coalesce("c", F.lit(0)) - e)
    gap = F.when((F.col("r") == 2) & (F.col("k") == 2), gap - F.least(F.lit(0.5), gap)).otherwise(gap)
    one = full.groupBy("feature", "r", "k", "n").agg(F.sum(gap * gap / e).alias("x"))
    low = F.least(F.col("r") - 1, F.col("k") - 1)
    return one.select("feature", F.round("x", 5).alias("chi2"), ((F.col("r") - 1) * (F.col("k") - 1)).alias("dof"), _tail("chi2_sf", F.col("x"), (F.col("r") - 1) * (F.col("k") - 1)).alias("p"), F.round(F.when(low > 0, F.sqrt(F.col("x") / F.col("n") / low)).otherwise(0.0), 6).alias("cramers_v"))


def cluster_vs_rest(df: DataFrame, label: str, num: list[str]) -> DataFrame:
    """Cohen's d of each cluster against all other rows, from totals less the cluster's own sums."""
    per = _num(df, label, num).groupBy("feature", "cluster").agg(F.count("x").alias("n"), F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("q"))
    w = Window.partitionBy("feature")
    t = per.select("*", *[(F.sum(c).over(w) - F.col(c)).alias(f"{c}2") for c in ("n", "s", "q")])
    var = lambda n, s, q: (F.col(q) - F.col(s) * F.col(s) / F.col(n)) / (F.col(n) - 1)
    pooled = F.sqrt(((F.col("n") - 1) * var("n", "s", "q") + (F.col("n2") - 1) * var("n2", "s2", "q2")) / (F.col("n") + F.col("n2") - 2))
    d = F.when((F.col("n") < 2) | (F.col("n2") < 2) | (pooled <= 0), 0.0).otherwise((F.col("s") / F.col("n") - F.col("s2") / F.col("n2")) / pooled)
    return t.select("feature", "cluster", F.round(d, 5).alias("cohens_d"))


def effect(df: DataFrame, label: str, num: list[str]) -> DataFrame:
    return cluster_vs_rest(df, label, num).groupBy("feature").agg(F.round(F.avg(F.abs("cohens_d")), 4).alias("cis_mean"), F.round(F.max(F.abs("cohens_d")), 4).alias("cis_max"))


def mutual_information(df: DataFrame, label: str, cat: list[str]) -> DataFrame:
    """Mutual information with the cluster over the cluster's entropy, in nats."""
    c = _cat(df, label, cat).groupBy("feature", "cluster", "v").agg(F.count(F.lit(1)).alias("c"))
    s = lambda *k: F.sum("c").over(Window.partitionBy(*k))
    t = c.select("*", s("feature").alias("n"), s("feature", "cluster").alias("a"), s("feature", "v").alias("b"))
    mi = t.groupBy("feature").agg(F.sum(F.col("c") / F.col("n") * F.ln(F.col("c") * F.col("n") / (F.col("a") * F.col("b")))).alias("mi"))
    h = t.select("feature", "cluster", "a", "n").distinct().groupBy("feature").agg((-F.sum(F.col("a") / F.col("n") * F.ln(F.col("a") / F.col("n")))).alias("h"))
    return mi.join(h, "feature").select("feature", F.round(F.when(F.col("h") > 0, F.col("mi") / F.col("h")).otherwise(0.0), 6).alias("nmi"))


def table(df: DataFrame, label: str, cat: list[str], k: int = 5) -> DataFrame:
    """Per feature and cluster one text of the top categories with their lift."""
    t = lifts(df, label, cat, k)
    item = F.concat(F.col("value"), F.lit(":"), F.format_string("%.3f", F.col("lift")))
    return t.groupBy("feature", "cluster").agg(F.concat_ws(";", F.transform(F.array_sort(F.collect_list(F.struct("rank", item.alias("t")))), lambda x: x["t"])).alias("top_lifts"))


def wide(df: DataFrame, label: str, num: list[str], cat: list[str], k: int = 5) -> DataFrame:
    """One row per cluster: size, fraction, and per number its mean, median, iqr, difference to the overall mean and effect
    size, per category its top values by lift as one text. Clusters are few; columns become columns, as they are few too."""
    out = sizes(df, label).withColumnRenamed("n", "size")
    if num:
        per = numeric(df, label, num).join(effect(df, label, num).select("feature", F.col("cis_mean").alias("cis")), "feature")
        told = [F.max(F.when(F.col("feature") == c, F.col(v))).alias(f"{c}_{v}") for c in num for v in ("mean", "median", "iqr", "diff_vs_global", "cis")]
        out = out.join(per.groupBy("cluster").agg(*told), "cluster", "left")
    if cat:
        top = table(df, label, cat, k).groupBy("cluster").agg(*[F.max(F.when(F.col("feature") == c, F.col("top_lifts"))).alias(f"{c}_top_lifts") for c in cat])
        out = out.join(top, "cluster", "left")
    return out
