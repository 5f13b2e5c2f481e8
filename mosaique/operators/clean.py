"""Data-quality checks, imputation and data signals: one pass over all columns, never one job per column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..frame import split_types
from .ordered import column_quantiles


def long_form(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, value) with values as strings; nulls stay."""
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns])
    return df.select(F.explode(pairs).alias("e")).select("e.*")


def impute(df: DataFrame, num: list[str], cat: list[str]) -> DataFrame:
    """Nulls become the median, or the most frequent value (of ties the smallest); counts of distinct values, then a projection."""
    row = {c: q[0] for c, q in column_quantiles(df, num, [0.5]).items()} if num else {}
    if cat:
        seen = df.select(F.posexplode(F.array(*[F.col(c).cast("string") for c in cat])).alias("i", "v")).where("v is not null")
        top = seen.groupBy("i", "v").agg(F.count(F.lit(1)).alias("n")).groupBy("i").agg(F.min(F.struct((-F.col("n")).alias("n"), "v")).alias("t")).collect()
        kinds = dict(df.dtypes)
        row |= {cat[r["i"]]: F.lit(r["t"]["v"]).cast(kinds[cat[r["i"]]]) for r in top}
    row = {c: row.get(c) for c in (*num, *cat)}
    return df.select(*[F.coalesce(F.col(c), row[c] if isinstance(row[c], Column) else F.lit(row[c])).alias(c) if c in num or c in cat else F.col(c) for c in df.columns])


def dqc_report(df: DataFrame, near_zero: float = 0.998, missing: float = 0.5, few: tuple[int, int] = (3, 20), on_disguised: str = "warn", categorical: tuple[str, ...] = (), numeric_columns: tuple[str, ...] = ()) -> DataFrame:
    """One row per column: distinct values, top value and its share of what is not null, nulls, deviation, issue and action.

    Issues in order: zero_variance and near_zero_variance drop the column; disguised_categorical (a numeric column of few
    values) warns or casts; high_missing warns, and is added to an earlier issue. Columns named ``categorical`` are taken
    as such, whatever their type; those named ``numeric_columns`` are never taken for disguised ones.
    """
    num, cat = split_types(df, categorical=tuple(c for c in categorical if c in df.columns))
    columns = num + cat
    counts = long_form(df, columns).groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    per = counts.groupBy("column").agg(
        F.sum("n").alias("rows"),
        F.sum(F.when(F.col("value").isNotNull(), F.col("n"))).alias("known"),
        F.count("value").alias("n_unique"),
        F.max(F.when(F.col("value").isNotNull(), F.col("n"))).alias("top"),
        F.substring(F.min(F.when(F.col("value").isNotNull(), F.struct((-F.col("n")).alias("m"), "value")))["value"], 1, 40).alias("top_value"),
    )
    spread = df.agg(*[F.stddev_samp(F.col(c).cast("double")).alias(c) for c in num])
    spread = spread.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("std")) for c in num])).alias("e")).select("e.*") if num else None
    out = per.join(spread, "column", "left") if spread is not None else per.withColumn("std", F.lit(None).cast("double"))
    out = out.withColumn("top_frac", F.coalesce(F.col("top") / F.col("known"), F.lit(0.0))).withColumn("missing_frac", 1 - F.coalesce("known", F.lit(0)) / F.col("rows"))
    first = F.when((F.col("n_unique") <= 1) | (F.col("std") < 1e-6), "zero_variance").when(F.col("top_frac") >= near_zero, "near_zero_variance")
    high = F.col("missing_frac") >= missing
    numeric = F.col("column").isin(num)
    issue = F.when(first.isNotNull() & high, F.concat(first, F.lit("+high_missing"))).when(first.isNotNull(), first).when(high, "high_missing")
    issue = F.coalesce(issue, F.when(numeric & ~F.col("column").isin(*numeric_columns, "") & F.col("n_unique").between(*few), "disguised_categorical"), F.lit("ok"))
    return out.select(
        "column", F.when(numeric, "numeric").otherwise("categorical").alias("kind"), F.col("n_unique").cast("long"), "top_value",
        F.round("top_frac", 4).alias("top_frac"), F.round("missing_frac", 4).alias("missing_frac"), F.round("std", 6).alias("std"), issue.alias("issue"),
    ).withColumn("action", F.when(F.col("issue").contains("zero_variance"), "drop").when(F.col("issue") == "disguised_categorical", on_disguised).when(F.col("issue") == "high_missing", "warn").otherwise("keep"))


def drop_flagged(df: DataFrame, report: DataFrame) -> tuple[DataFrame, list[str]]:
    """The table without the columns that the report drops; a report has as many rows as the table has columns."""
    gone = sorted(r["column"] for r in report.where("action = 'drop'").select("column").collect())
    return df.drop(*gone), gone


def apply_dqc(df: DataFrame, report: DataFrame, categorical: tuple[str, ...] = ()) -> tuple[DataFrame, list[str], list[str]]:
    """The table without the columns that the report drops, and with those cast to text that it casts or that are named; the
    dropped and the cast columns."""
    actions = {r["column"]: r["action"] for r in report.select("column", "action").collect()}
    gone = sorted(c for c, a in actions.items() if a == "drop")
    cast = sorted(c for c in df.columns if c not in gone and (actions.get(c) == "cast" or c in categorical))
    return df.drop(*gone).withColumns({c: F.col(c).cast("string") for c in cast}), gone, cast


def prefilter(df: DataFrame, zeros: float = 0.8, nulls: float = 0.3) -> tuple[DataFrame, list[str]]:
    """The table without columns of over ``nulls`` nulls, or numeric ones of over ``zeros`` zeros; one pass, one row."""
    num, cat = split_types(df)
    share = lambda test: F.avg(test.cast("int"))
    row = df.agg(*[share(F.col(c).isNull()).alias(f"n{i}") for i, c in enumerate(num + cat)], *[share(F.coalesce(F.col(c) == 0, F.lit(False))).alias(f"z{i}") for i, c in enumerate(num)]).first()
    gone = [c for i, c in enumerate(num + cat) if (row[f"n{i}"] or 0) > nulls or i < len(num) and (row[f"z{i}"] or 0) > zeros]
    return df.drop(*gone), gone


def data_profile(df: DataFrame) -> DataFrame:
    """One row of signals: n, p, shares of categorical, binary and spiked columns, of nulls, and what is derived from them."""
    num, cat = split_types(df)
    counts = long_form(df, num + cat).groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    per = counts.groupBy("column").agg(F.count("value").alias("u"), F.sum("n").alias("rows"), F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("n"))), F.lit(0)).alias("gone"), F.max(F.when(F.col("value").isNotNull(), F.col("n"))).alias("top"))
    one = per.agg(F.max("rows").alias("n"), F.count(F.lit(1)).alias("p"), F.avg(F.col("column").isin(cat).cast("int")).alias("cat_ratio"), F.avg((F.col("u") == 2).cast("int")).alias("binary_ratio"), F.avg((F.col("top") / F.col("rows") > 0.5).cast("int")).alias("spike_ratio"), (F.sum("gone") / F.sum("rows")).alias("missing_ratio"))
    return one.select(F.col("n").cast("long"), F.col("p").cast("long"), *[F.round(c, 6).alias(c) for c in ("cat_ratio", "binary_ratio", "spike_ratio", "missing_ratio")], F.round(1 - F.col("spike_ratio"), 6).alias("entropy_ratio"), F.round(F.col("n") / 10000, 6).alias("n_ratio"))


def balance(labels: DataFrame) -> DataFrame:
    """Whether the smallest cluster has max(3, 2 % of the rows) or more."""
    sizes = labels.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    return sizes.agg(F.min("n").alias("least"), F.greatest(F.lit(3), F.floor(0.02 * F.sum("n"))).cast("long").alias("need")).withColumn("balanced", F.col("least") >= F.col("need"))
