"""Calibration of one score against another by least squares, and its leave-one-out check."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def pairs_of(df: DataFrame, x: str, y: str) -> DataFrame:
    """Rows where both values are finite: they are dropped together."""
    ok = lambda c: F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) & (F.abs(c) < float("inf"))
    return df.where(ok(x) & ok(y))


def fit(df: DataFrame, x: str, y: str) -> DataFrame:
    """(n, a, b) of y = a x + b; 1 and 0 where there is no line."""
    return pairs_of(df, x, y).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.regr_slope(y, x), F.lit(1.0)).alias("a"), F.coalesce(F.regr_intercept(y, x), F.lit(0.0)).alias("b"))


def predict(x, a, b):
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), a * x + b))


def stats(df: DataFrame, x: str, y: str) -> DataFrame:
    """a, b, correlation, R2, MAE and RMSE of clipped predictions; the line is one row."""
    good = pairs_of(df, x, y)
    p = good.crossJoin(F.broadcast(fit(df, x, y))).withColumn("p", predict(F.col(x), F.col("a"), F.col("b")))
    e = F.col("p") - F.col(y)
    return p.agg(F.count(F.lit(1)).alias("n"), F.round(F.first("a"), 6).alias("a"), F.round(F.first("b"), 6).alias("b"), F.round(F.corr(x, y), 6).alias("r"), F.round(1 - F.sum(e * e) / (F.var_pop(y) * F.count(F.lit(1))), 6).alias("r2"), F.round(F.avg(F.abs(e)), 6).alias("mae"), F.round(F.sqrt(F.avg(e * e)), 6).alias("rmse"))


def leave_one_out(df: DataFrame, key: str, x: str, y: str) -> DataFrame:
    """Per row the prediction of a line through all others: sums of all minus the row's own, so no self-join."""
    good = pairs_of(df, x, y)
    total = good.agg(F.count(F.lit(1)).alias("n"), F.sum(x).alias("sx"), F.sum(y).alias("sy"), F.sum(F.col(x) * F.col(x)).alias("sxx"), F.sum(F.col(x) * F.col(y)).alias("sxy"))
    one = good.crossJoin(F.broadcast(total))
    n, sx, sy = F.col("n") - 1, F.col("sx") - F.col(x), F.col("sy") - F.col(y)
    sxx, sxy = F.col("sxx") - F.col(x) * F.col(x), F.col("sxy") - F.col(x) * F.col(y)
    a = (n * sxy - sx * sy) / (n * sxx - sx * sx)
    return one.select(key, F.round(predict(F.col(x), a, (sy - a * sx) / n), 5).alias("pred"), F.round(F.abs(predict(F.col(x), a, (sy - a * sx) / n) - F.col(y)), 5).alias("abs_err"))


def huber(df: DataFrame, x: str, y: str, epsilon: float = 1.35) -> tuple[float, float]:
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression

    model = LinearRegression(featuresCol="_x", labelCol=y, loss="huber", epsilon=epsilon).fit(VectorAssembler(inputCols=[x], outputCol="_x").transform(pairs_of(df, x, y)))
    return float(model.coefficients[0]), float(model.intercept)


def summary(predicted: DataFrame, y: str) -> DataFrame:
    """Of leave-one-out predictions: their number, mean and root mean square error, and correlation with the truth."""
    e = F.col("pred") - F.col(y)
    return predicted.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.abs(e)), 5).alias("mae"), F.round(F.sqrt(F.avg(e * e)), 5).alias("rmse"), F.round(F.corr("pred", y), 5).alias("r"))
