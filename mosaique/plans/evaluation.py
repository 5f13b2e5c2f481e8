"""Evaluation of a labelled table: landmark silhouette and consistency against the exact silhouette, one row a table."""

from __future__ import annotations

import math
import time
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..frame import MixedFrame, infer_id, split_types
from ..operators import clean, cluster, landmarks, metrics
from ..sources.artifacts import read_csv
from .anchored import consistency

SCHEMA = "dataset string, n long, clusters long, m long, lsil double, lnc double, ss_gower double, ss_mode string, ss_n long, diff double, mae double, runtime_s double, status string"


def candidate_count(n: int, inner: int, outer: int) -> int:
    return max(200, 3 * (inner + outer), int(0.01 * n))


def with_labels(f: MixedFrame, cluster_fn: Callable[[MixedFrame], DataFrame] | None = None, k: int = 3) -> MixedFrame:
    """The frame's own label, else that of ``cluster_fn`` (key, cluster), else of k-prototypes."""
    if f.label:
        return f
    labels = (cluster_fn(f) if cluster_fn else cluster.k_prototypes(f, k, starts=1)[0]).withColumnRenamed("cluster", "_cluster")
    return replace(f, df=f.df.join(labels, f.key), label="_cluster")


def evaluate(f: MixedFrame, name: str = "table", cluster_fn=None, parts: tuple[str, ...] = ("lsil", "lnc", "ss"), c: float = 3.0, ss_rows: int | None = None, seed: int = 42) -> DataFrame:
    """One row of scores; ``parts`` names those wanted. The exact silhouette takes all rows unless ``ss_rows`` says less."""
    began, spark = time.time(), f.df.sparkSession
    f = with_labels(f, cluster_fn)
    f = replace(f, df=f.df.select(f.key, f.label, *f.num, *f.cat).persist())
    classes = f.clean.select("label").distinct().count()
    if classes < 2:
        return spark.createDataFrame([(name, f.n, classes, None, None, None, None, None, None, None, None, None, "one label")], SCHEMA)
    marks = metrics.landmarks_of(f, c, seed).persist()
    lsil = metrics.landmark_scores(f, marks).agg(F.avg("s")).first()[0] if "lsil" in parts else None
    lnc = consistency(f, f.num + f.cat, c, metrics.default_k(f.n), seed) if "lnc" in parts else None
    ss = mode = used = None
    if "ss" in parts:
        some = f if ss_rows is None or f.n <= ss_rows else replace(f, df=landmarks.sample(f.df, f.key, ss_rows, seed))
        ss, used = metrics.silhouette(some).agg(F.avg("s")).first()[0], f.n if some is f else ss_rows
        mode = "full" if some is f else f"sub({ss_rows})"
    gap = lsil - ss if lsil is not None and ss is not None else None
    r6 = lambda x: None if x is None or math.isnan(x) else round(float(x), 6)
    return spark.createDataFrame([(name, f.n, classes, marks.count(), r6(lsil), r6(lnc), r6(ss), mode, used, r6(gap), r6(abs(gap) if gap is not None else None), round(time.time() - began, 2), "OK")], SCHEMA)


def evaluate_csv(spark: SparkSession, path: str, label: str, key: str | None = None, sep: str = ";", **how) -> DataFrame:
    """Evaluation of a CSV file without its incomplete rows. A file without a key has its rows numbered by their content, in
    one task: give large files a key."""
    from pyspark.sql import Window

    df = read_csv(spark, path, sep, drop_null=True)
    key = key or infer_id(df)
    if key is None:
        key = "row_id"
        df = df.withColumn(key, F.row_number().over(Window.orderBy(*df.columns)).cast("long"))
    num, cat = split_types(df, (key, label))
    ready = clean.impute(df.select(F.col(key).cast("long").alias(key), label, *num, *cat), num, cat)
    return evaluate(MixedFrame(ready, key, num, cat, label), path.rstrip("/").rsplit("/", 1)[-1], **how)
