"""Shared plumbing: tables in the cluster's shared folder, and connected components over an edge table."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; where that is unset a folder of our own is set, on a single machine only."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        context = spark.sparkContext
        if context.getCheckpointDir() is None:
            if not re.match(r"local(\[|$)", context.master):
                raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
            context.setCheckpointDir(tempfile.mkdtemp(prefix="mosaique-"))
        found = context.getCheckpointDir()
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str = "t") -> str:
    return f"{shared_dir(spark)}/mosaique/{name}-{uuid.uuid4().hex}"


def fresh(name: str, columns: list[str]) -> str:
    """``name``, with underscores after it while a column has that name."""
    while name.lower() in {c.lower() for c in columns}:
        name += "_"
    return name


def cut(df: DataFrame, name: str = "t") -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: cuts lineage, and survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._mosaique_path = path
    return out


def drop(df: DataFrame) -> None:
    """Delete a table that :func:`cut` wrote and that no later plan reads."""
    path = getattr(df, "_mosaique_path", None)
    if path:
        jvm = df.sparkSession._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(where, True)


def _signature(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (two columns, undirected); component is the smallest node reachable.

    Alternating large-star and small-star steps: after a few rounds each node points at its component's smallest node.
    Per round the minima are partial-aggregated, and written before they are joined, so that the join has an exchange
    of its own on either side and a node with very many links can be split over tasks.
    Null ends and self-links are ignored; an empty table gives an empty result.
    """
    a, b = edges.columns[:2]
    e = cut(
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("u") != F.col("v")))
        .distinct(),
        "edges",
    )
    seen = _signature(e)
    while seen[0]:
        both = e.select(F.col("u").alias("n"), F.col("v").alias("m")).union(e.select(F.col("v").alias("n"), F.col("u").alias("m")))
        low = cut(both.groupBy("n").agg(F.min("m").alias("lo")), "low")
        large = cut(both.where("m > n").join(low, "n").select(F.col("m").alias("u"), F.least("lo", "n").alias("v")), "large")
        small = cut(large.groupBy("u").agg(F.min("v").alias("lo")), "small")
        star = small.select("u", F.col("lo").alias("v")).union(large.join(small, "u").select(F.col("v").alias("u"), F.col("lo").alias("v")))
        new = cut(star.where("u != v").distinct(), "edges")
        for t in (low, large, small):
            drop(t)
        now = _signature(new)
        drop(e)
        e = new
        if now == seen:
            break
        seen = now
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
