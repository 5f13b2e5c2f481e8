"""Quality of a clustering: landmark and exact silhouettes, neighbour consistency, dispersion indices, composite score."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..frame import MixedFrame, spread
from ..functions import nearest
from ..functions.gower import gower_block
from .landmarks import dealt, label_sizes, landmark_count, stratified
from .ordered import ranges, running

EPS = 1e-12


def group_distance(d: np.ndarray, mode: str, k: int) -> np.ndarray:
    """Per row: least, mean, or mean of the k least of the finite distances; inf where there are none."""
    finite = np.isfinite(d)
    n = finite.sum(axis=1)
    if mode == "min":
        return d.min(axis=1, initial=np.inf)
    if mode == "topk" and d.shape[1] > k:
        d = np.partition(d, k - 1, axis=1)[:, :k]
        finite = np.isfinite(d)
        n = finite.sum(axis=1)
    return np.where(n > 0, np.where(finite, d, 0).sum(axis=1) / np.maximum(n, 1), np.inf)


def group_parts(d: np.ndarray, mode: str, k: int) -> np.ndarray:
    """Per row what :func:`group_distance` needs of a part of a group: its ``k`` least distances, or the sum and number of the finite ones."""
    if mode == "mean":
        finite = np.isfinite(d)
        return np.stack([np.where(finite, d, 0).sum(axis=1), finite.sum(axis=1)], axis=1)
    k = 1 if mode == "min" else k
    if d.shape[1] > k:
        return np.partition(d, k - 1, axis=1)[:, :k]
    return np.pad(d, ((0, 0), (0, k - d.shape[1])), constant_values=np.inf)


def group_whole(parts: np.ndarray, mode: str, k: int) -> np.ndarray:
    """(rows, parts, width) of a group's parts -> its distances."""
    if mode == "mean":
        n = parts[:, :, 1].sum(axis=1)
        return np.where(n > 0, parts[:, :, 0].sum(axis=1) / np.maximum(n, 1), np.inf)
    return group_distance(parts.reshape(len(parts), -1), mode, k)


def _landmark_silhouette(g: np.ndarray, label: np.ndarray, order: list) -> np.ndarray:
    """(rows, labels) distances -> the rows' silhouettes; 0 where a side is missing."""
    mine = label[:, None] == np.array(order, dtype=label.dtype)[None, :]
    a, b = np.where(mine, g, np.inf).min(axis=1), np.where(mine, np.inf, g).min(axis=1)
    top = np.maximum(a, b)
    with np.errstate(invalid="ignore"):
        return np.clip(np.where(np.isfinite(top) & (top > EPS), (b - a) / np.where(top > EPS, top, 1), 0.0), -1, 1)


def _nearest_scores(f: MixedFrame, marks: pd.DataFrame, order: list, k: int) -> DataFrame:
    """Scores by the ``k`` nearest landmarks of each label: rows are put in boxes, which leave out the landmarks that are too far."""
    num, cat, key, scale = f.num, f.cat, f.key, [f.stats[c][2] for c in f.num]
    values, names = nearest.values_of(marks, cat), [str(v) for v in order]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        to = nearest.points(pa.table({c: pa.array(marks[c]) for c in (*num, *cat)}), num, cat, values)
        at = [np.flatnonzero((marks["label"] == v).to_numpy()) for v in order]
        known = pa.array(order)
        for table in nearest.chunks(batches):
            label = table.column("label")
            mine = pc.fill_null(pc.index_in(label, value_set=known.cast(label.type)), -1).to_numpy()
            g = np.empty((table.num_rows, len(order)))
            for rows, here, some in nearest.near(nearest.points(table, num, cat, values), to, scale, at, k, EPS):
                for i, near in enumerate(some):
                    d = nearest.block(here, to.take(near), scale)
                    d[(mine[rows] == i)[:, None] & (d <= EPS)] = np.inf
                    g[rows, i] = group_distance(nearest.least_of(d, k), "topk", k)
            s = _landmark_silhouette(g, mine, list(range(len(order))))
            text = pa.array(names, pa.string()).take(pa.array(np.maximum(mine, 0))) if order else pa.nulls(table.num_rows, pa.string())
            if (mine < 0).any():
                text = pa.array(np.where(mine < 0, label.to_pandas().astype(str), text.to_numpy(False)), pa.string())
            yield from pa.table({"key": table.column(key).cast(pa.int64()), "label": text, "s": pa.array(s)}).to_batches(10_000)

    return spread(f.clean, f.key, f.n).mapInArrow(run, "key long, label string, s double")


def landmark_scores(f: MixedFrame, landmarks: DataFrame, mode: str = "topk", k: int = 3) -> DataFrame:
    """(key, label, s) for every row: (b - a) / max(a, b) of own and best other label's distance to the landmarks.

    The landmarks (some c * sqrt(n) rows) lie in every task; rows stream past them in blocks. Of a set beyond
    ``MOST_BROADCAST`` rows pass part by part, and the parts' least distances (or sums) per row and label meet in one shuffle.
    """
    parts = dealt(landmarks.select(f.key, "label", *f.num, *f.cat), f.key)
    first, second = next(parts), next(parts, None)
    order = sorted(first["label"].unique() if second is None else (r[0] for r in landmarks.select("label").distinct().collect()), key=str)
    num, cat, stats, key, clean = f.num, f.cat, f.stats, f.key, f.clean

    def near(rows: pd.DataFrame, marks: pd.DataFrame) -> np.ndarray:
        d = gower_block(rows, marks, num, cat, stats)
        own = (rows["label"].to_numpy()[:, None] == marks["label"].to_numpy()[None, :]) & (d <= EPS)
        return np.where(own, np.inf, d)

    if second is None and mode != "mean" and (num or cat):
        return _nearest_scores(f, first, order, 1 if mode == "min" else k)

    if second is None:
        at = [np.nonzero((first["label"] == v).to_numpy())[0] for v in order]

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for start in range(0, len(batch), 2048):
                    rows = batch.iloc[start : start + 2048]
                    d = near(rows, first)
                    g = np.stack([group_distance(d[:, a], mode, k) for a in at], axis=1)
                    yield pd.DataFrame({"key": rows[key], "label": rows["label"].astype(str), "s": _landmark_silhouette(g, rows["label"].to_numpy(object), order)})

        return clean.mapInPandas(run, "key long, label string, s double")

    def passed(marks: pd.DataFrame) -> DataFrame:
        at = [np.nonzero((marks["label"] == v).to_numpy())[0] for v in order]

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for start in range(0, len(batch), 2048):
                    rows = batch.iloc[start : start + 2048]
                    d = near(rows, marks)
                    flat = np.concatenate([group_parts(d[:, a], mode, k) for a in at], axis=1)
                    yield pd.DataFrame({"key": rows[key], "label": rows["label"].astype(str), "d": list(flat)})

        return clean.mapInPandas(run, "key long, label string, d array<double>")

    every = passed(first).union(passed(second))
    for marks in parts:
        every = every.union(passed(marks))
    names = [str(v) for v in order]

    def merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x = np.array([np.stack(p) for p in batch["d"]]).reshape(len(batch), -1, len(names), 2 if mode == "mean" else 1 if mode == "min" else k)
            g = np.stack([group_whole(x[:, :, i], mode, k) for i in range(len(names))], axis=1)
            yield pd.DataFrame({"key": batch["key"], "label": batch["label"], "s": _landmark_silhouette(g, batch["label"].to_numpy(object), names)})

    return every.groupBy("key", "label").agg(F.collect_list("d").alias("d")).mapInPandas(merge, "key long, label string, s double")


def landmarks_of(f: MixedFrame, c: float = 3.0, seed: int = 42, known: dict | None = None) -> DataFrame:
    known = label_sizes(f.clean, "label") if known is None else known
    return stratified(f.clean, f.key, "label", landmark_count(sum(known.values()), len(known), c), 3, seed, known)


def lsil(f: MixedFrame, landmarks: DataFrame, mode: str = "topk", k: int = 3) -> DataFrame:
    """Landmark silhouette per label, with the label's rows."""
    return landmark_scores(f, landmarks, mode, k).groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("s"), 6).alias("lsil"))


def lsil_score(f: MixedFrame, landmarks: DataFrame, mode: str = "topk", k: int = 3, weighted: bool = False) -> DataFrame:
    """One row: the mean over all rows, or with ``weighted`` over rows that count as often as their label has rows."""
    per = landmark_scores(f, landmarks, mode, k).groupBy("label").agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum("s").alias("t"))
    w = F.col("n") if weighted else F.lit(1.0)
    return per.agg(F.round(F.sum(w * F.col("t")) / F.greatest(F.sum(w * F.col("n")), F.lit(EPS)), 6).alias("lsil"))


def score_internal(f: MixedFrame, metric: str = "auto", exact_below: int = 1000, most: int = 150, seed: int = 42) -> float:
    """One score of a labelled frame: the exact silhouette of small tables (or if asked for: ``ss_gower``), else a landmark
    silhouette by the nearest of at most ``most`` landmarks that cover the rows."""
    if metric == "ss_gower" or metric == "auto" and f.n < exact_below:
        return silhouette(f).agg(F.avg("s")).first()[0]
    from .unit import k_center

    keys = k_center(f, min(most, max(20, f.n // 10)), seed=seed).select(f.key)
    return lsil_score(f, f.clean.join(keys, f.key, "left_semi"), "topk", 1).first()[0]


def default_k(n: int) -> int:
    return max(5, n // 3) if n <= 50 else 20 if n <= 200 else min(50, int(math.sqrt(n)))


def neighbours(f: MixedFrame, landmarks: DataFrame, k: int, ranked: bool = False) -> DataFrame:
    """(landmark, lm_label, label, d) of the k nearest rows of each landmark; each task passes on its own k nearest only. Rows
    pass once for each part of landmarks that fits a task."""
    near = None
    for marks in dealt(landmarks.select(f.key, "label", *f.num, *f.cat), f.key):
        part = _nearest_rows(f, marks, k)
        near = part if near is None else near.union(part)
    first = near.withColumn("r", F.row_number().over(Window.partitionBy("landmark").orderBy("d", "key"))).where(F.col("r") <= k)
    return first if ranked else first.drop("r")


def _nearest_rows(f: MixedFrame, marks: pd.DataFrame, k: int) -> DataFrame:
    """Each task's ``k`` nearest rows of every landmark; of equals the smallest keys. Landmarks are put in boxes, which leave out
    the rows that are too far; of rows with equal values only the k + 1 of smallest key come into question."""
    num, cat, key, scale = f.num, f.cat, f.key, [f.stats[c][2] for c in f.num]
    kind = pa.schema([("landmark", pa.int64()), ("lm_label", pa.string()), ("key", pa.int64()), ("label", pa.string()), ("d", pa.float64())])
    names, lm_label = marks[key].to_numpy(), marks["label"].astype(str).to_numpy()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = None
        to = nearest.points(pa.table({c: pa.array(marks[c]) for c in (*num, *cat)}), num, cat, values)
        if not num and not cat:
            to = nearest.Points([], [np.zeros(len(marks), int)])
        for table in nearest.chunks(batches):
            table = table.take(pc.sort_indices(table, [(key, "ascending")]))
            # Without columns all rows are equally far.
            every = nearest.points(table, num, cat, values) if num or cat else nearest.Points([], [np.full(table.num_rows, -1)])
            first = nearest.first_of_equals(every, k + 1)
            rows, keys, labels = every.take(first), table.column(key).to_numpy()[first], table.column("label").take(pa.array(first)).to_pandas().astype(str).to_numpy()
            part = []
            for at, here, (near,) in nearest.near(to, rows, scale, [np.arange(rows.n)], k + 1, leaf=16):
                d = np.round(nearest.block(here, rows.take(near), scale), 9)
                d[names[at][:, None] == keys[near][None, :]] = np.inf
                by = nearest.first_of(d, k)
                d = np.take_along_axis(d, by, axis=1)
                i, j = np.nonzero(np.isfinite(d))
                part.append((at[i], near[by[i, j]], d[i, j]))
            i, j, d = (np.concatenate(x) for x in zip(*part, strict=True)) if part else (np.zeros(0, int),) * 3
            found = pd.DataFrame({"landmark": names[i], "lm_label": lm_label[i], "key": keys[j], "label": labels[j], "d": d})
            best = found if best is None else pd.concat([best, found]).sort_values(["landmark", "d", "key"]).groupby("landmark", sort=False).head(k)
        if best is not None:
            yield from pa.Table.from_pandas(best, kind, preserve_index=False).to_batches(10_000)

    values = nearest.values_of(marks, cat)
    return spread(f.clean, f.key, f.n, 1 << 19).mapInArrow(run, "landmark long, lm_label string, key long, label string, d double")


def vector_neighbours(df: DataFrame, key: str, vector: str, queries: DataFrame, k: int) -> DataFrame:
    """(query, neighbour, d, rank) of the ``k`` nearest rows by cosine distance, itself left out; of equals the smallest key.

    Each task passes on its own k nearest of every query only; rows pass once for each part of the queries that fits a task.
    """
    near = None
    for asked in dealt(queries.select(key, vector), key):
        part = _nearest_vectors(df, key, vector, asked, k)
        near = part if near is None else near.union(part)
    return near.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy("d", "neighbour"))).where(F.col("rank") <= k)


def _nearest_vectors(df: DataFrame, key: str, vector: str, asked: pd.DataFrame, k: int) -> DataFrame:
    names = asked[key].to_numpy()
    unit = lambda v: v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), EPS)
    to = unit(np.stack(asked[vector].to_numpy()).astype(float)) if len(asked) else np.zeros((0, 1))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best = None
        for batch in batches:
            for at in range(0, len(batch) if len(names) else 0, 2048):
                rows = batch.iloc[at : at + 2048]
                d = np.round(1 - to @ unit(np.stack(rows[vector].to_numpy()).astype(float)).T, 6)
                d[names[:, None] == rows[key].to_numpy()[None, :]] = np.inf
                # All ties at the k-th distance are kept, so that the order by key decides among them.
                edge = np.partition(d, min(k, d.shape[1]) - 1, axis=1)[:, min(k, d.shape[1]) - 1 : min(k, d.shape[1])]
                i, j = np.nonzero((d <= edge) & np.isfinite(d))
                part = pd.DataFrame({"query": names[i], "neighbour": rows[key].to_numpy()[j], "d": d[i, j]})
                best = part if best is None else pd.concat([best, part])
                best = best.sort_values(["query", "d", "neighbour"]).groupby("query", sort=False).head(k)
        if best is not None:
            yield best

    return df.where(F.col(vector).isNotNull()).select(key, vector).mapInPandas(run, "query long, neighbour long, d double")


def lnc_star(f: MixedFrame, landmarks: DataFrame, k: int, classes: int, alpha: float = 0.7) -> DataFrame:
    """(landmark, lnc): label entropy of its k neighbours (Miller-Madow) and the gap of other to own labels' distances."""
    near = neighbours(f, landmarks, k)
    # A landmark's neighbours are in one task, for the labels' shares and for the distances alike: they are sought once.
    one, every = Window.partitionBy("landmark", "label"), Window.partitionBy("landmark")
    near = near.withColumn("c", F.count(F.lit(1)).over(one)).withColumn("t", F.count(F.lit(1)).over(every)).withColumn("i", F.row_number().over(one.orderBy("d", "key")))
    p, same = F.col("c") / F.col("t"), F.col("label") == F.col("lm_label")
    gaps = near.groupBy("landmark").agg(
        (-F.sum(F.when(F.col("i") == 1, p * F.ln(p + 1e-12)))).alias("h"), F.count(F.when(F.col("i") == 1, 1)).alias("m"), F.first("t").alias("t"),
        F.avg(F.when(same, F.col("d"))).alias("intra"), F.avg(F.when(~same, F.col("d"))).alias("inter"), F.avg("d").alias("every"), F.percentile("d", F.array(F.lit(0.05), F.lit(0.95))).alias("q"),
    )
    nc = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - (F.col("h") + (F.col("m") - 1) / (2 * F.col("t"))) / math.log(classes)))
    gaps = gaps.withColumn("intra", F.coalesce("intra", "every")).withColumn("inter", F.coalesce("inter", "intra"))
    delta = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("inter") - F.col("intra")) / F.greatest(F.lit(1e-9), F.col("q")[1] - F.col("q")[0])))
    return gaps.select("landmark", F.round(alpha * nc + (1 - alpha) * delta, 6).alias("lnc"))


def _distances(f: MixedFrame) -> tuple[DataFrame, list, list[int]]:
    """The frame's rows with a column ``_d<i>`` for each of its columns: sums of distances to each cluster's rows; the
    clusters in order, and their sizes.

    The distance to a cluster is a sum over columns: of a category by its counts, of a number by running sums over its
    distinct values, ordered by ranges. A value's distances to all clusters are one array. Rows stay where they are while a
    column's table of distinct values is small enough to broadcast.
    """
    base = f.clean
    sizes = {r["label"]: r["n"] for r in base.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    order = sorted(sizes, key=str)
    counts = [F.sum((F.col("label").eqNullSafe(F.lit(v))).cast("long")).alias(f"c{k}") for k, v in enumerate(order)]
    tables = {}
    if f.num:
        long = base.select("label", F.explode(F.array(*[F.struct(F.lit(c).alias("f"), F.col(c).alias("x")) for c in f.num])).alias("e")).select("label", "e.*")
        cell = long.groupBy("f", "x").agg(*counts)
        cell = cell.select("*", *[(F.col(f"c{k}") * F.col("x")).alias(f"s{k}") for k in range(len(order))])
        run = running(cell, ["f"], "x", [f"{t}{k}" for k in range(len(order)) for t in ("c", "s")], ranges(long, "f", "x"))
        whole = long.groupBy("f").agg(*[F.sum(F.when(F.col("label").eqNullSafe(F.lit(v)), F.col("x"))).alias(f"all{k}") for k, v in enumerate(order)])
        scale = F.create_map(*[x for c in f.num for x in (F.lit(c), F.lit(f.stats[c][2]))])[F.col("f")]
        x = F.col("x")
        far = [(x * F.col(f"run_c{k}") - F.col(f"run_s{k}") + F.col(f"all{k}") - F.col(f"run_s{k}") - x * (F.lit(sizes[v]) - F.col(f"run_c{k}"))) * scale for k, v in enumerate(order)]
        met = run.join(F.broadcast(whole), "f").select("f", "x", F.array(*far).alias("d"))
        tables |= {c: met.where(F.col("f") == c).select("x", "d") for c in f.num}
    for c in f.cat:
        tables[c] = base.groupBy(F.col(c).alias("x")).agg(*counts).select("x", F.array(*[(F.lit(sizes[v]) - F.col(f"c{k}")).cast("double") for k, v in enumerate(order)]).alias("d"))
    rows = base
    for i, c in enumerate(f.num + f.cat):
        rows = rows.join(tables[c].select(F.col("x").alias(f"_v{i}"), F.col("d").alias(f"_d{i}")), F.col(c) == F.col(f"_v{i}")).drop(f"_v{i}")
    return rows, order, [sizes[v] for v in order]


def _score(a: Column, b: Column) -> Column:
    """(b - a) / max(a, b); 0 where one is missing, or both are 0."""
    return F.when(a.isNull() | b.isNull() | (F.greatest(a, b) <= 0), 0.0).otherwise((b - a) / F.greatest(a, b))


def silhouette(f: MixedFrame) -> DataFrame:
    """Exact Gower silhouette (key, label, s) of every row in O(n log n) per column. Clusters are literals of the plan."""
    rows, order, sizes = _distances(f)
    p = len(f.num) + len(f.cat)
    total = [sum((F.col(f"_d{i}")[k] for i in range(1, p)), F.col("_d0")[k]) / p for k in range(len(order))]
    own = [F.col("label").eqNullSafe(F.lit(v)) for v in order]
    a = F.coalesce(*[F.when(mine, t / (n - 1)) for mine, t, n in zip(own, total, sizes, strict=True) if n > 1], F.lit(None).cast("double"))
    b = F.array_min(F.array(*[F.when(~mine, t / n) for mine, t, n in zip(own, total, sizes, strict=True)]))
    return rows.select(F.col(f.key).alias("key"), "label", a.alias("a"), b.alias("b")).select("key", "label", _score(F.col("a"), F.col("b")).alias("s"))


def silhouette_parts(f: MixedFrame) -> DataFrame:
    """Per row the mean distance in each column to its own cluster (a_0, a_1, ...) and to each other one (others).

    The silhouette over any subset of the columns is then a sum of some of these.
    """
    rows, order, sizes = _distances(f)
    p = len(f.num) + len(f.cat)
    own = [F.col("label").eqNullSafe(F.lit(v)) for v in order]
    mine = [F.coalesce(*[F.when(m, F.col(f"_d{i}")[k] / max(1, n - 1)) for k, (m, n) in enumerate(zip(own, sizes, strict=True))]).alias(f"a_{i}") for i in range(p)]
    others = F.filter(F.array(*[F.when(~m, F.array(*[F.col(f"_d{i}")[k] / n for i in range(p)])) for k, (m, n) in enumerate(zip(own, sizes, strict=True))]), lambda o: o.isNotNull())
    return rows.select(F.col(f.key).alias("key"), *mine, others.alias("others"))


def davies_bouldin(df: DataFrame, label: str, num: list[str]) -> DataFrame:
    """Mean over clusters of the worst (scatter + scatter) / centroid distance; two passes over the rows, clusters are few."""
    centre = df.groupBy(label).agg(*[F.avg(c).alias(f"m_{c}") for c in num])
    dist = lambda a, b: F.sqrt(sum(((x - y) * (x - y) for x, y in zip(a[1:], b[1:], strict=True)), (a[0] - b[0]) * (a[0] - b[0])))
    scatter = df.join(F.broadcast(centre) if centre.count() <= 10_000 else centre, label).groupBy(label).agg(F.avg(dist([F.col(c) for c in num], [F.col(f"m_{c}") for c in num])).alias("s"))
    both = centre.join(scatter, label)
    a, b = both.alias("a"), both.alias("b")
    r = a.join(b, F.col(f"a.{label}") != F.col(f"b.{label}")).groupBy(F.col(f"a.{label}")).agg(F.max((F.col("a.s") + F.col("b.s")) / dist([F.col(f"a.m_{c}") for c in num], [F.col(f"b.m_{c}") for c in num])).alias("r"))
    return r.agg(F.round(F.avg("r"), 6).alias("davies_bouldin"))


def calinski_harabasz(df: DataFrame, label: str, num: list[str]) -> DataFrame:
    """Between over within sums of squares, each by its degrees of freedom; one aggregate over the rows."""
    per = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"), *[x for c in num for x in (F.avg(c).alias(f"m_{c}"), F.var_pop(c).alias(f"v_{c}"))])
    within = sum((F.sum(F.col("n") * F.col(f"v_{c}")) for c in num[1:]), F.sum(F.col("n") * F.col(f"v_{num[0]}")))
    parts = [F.sum(F.col("n") * F.col(f"m_{c}") * F.col(f"m_{c}")) - F.pow(F.sum(F.col("n") * F.col(f"m_{c}")), F.lit(2.0)) / F.sum("n") for c in num]
    one = per.agg(within.alias("w"), sum(parts[1:], parts[0]).alias("b"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("k"))
    return one.select(F.round((F.col("b") / (F.col("k") - 1)) / (F.col("w") / (F.col("n") - F.col("k"))), 4).alias("calinski_harabasz"))


def composite(sizes: list[int], lsil_score: float, lnc: float, weight: float = 0.6) -> float:
    """Weighted silhouette and consistency (the one that is there, if one is NaN), less penalties for tiny and uneven clusters and for many."""
    base = lnc if math.isnan(lsil_score) else lsil_score if math.isnan(lnc) else weight * lsil_score + (1 - weight) * lnc
    n, k = sum(sizes), len(sizes)
    tiny = sum(s < max(3, int(0.02 * n)) for s in sizes)
    mean = n / k
    cv = math.sqrt(sum((s - mean) ** 2 for s in sizes) / k) / mean
    return base - 0.5 * tiny - 0.1 * max(0.0, cv - 1) - 0.02 * math.log(max(2, k))


def cosine_silhouette(df: DataFrame, key: str, label: str, vector: str) -> DataFrame:
    """Exact silhouette (key, label, s) by cosine distance, from the sums of the labels' unit vectors: no pairs.

    The mean distance to a label is 1 less the product with its mean unit vector; labels are few rows.
    """
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    v = F.col(vector)
    unit = df.select(F.col(key).alias("key"), F.col(label).alias("label"), F.transform(v, lambda x: x.cast("double") / F.sqrt(dot(v, v))).alias("u"))
    place = unit.select("label", F.posexplode("u").alias("i", "x")).groupBy("label", "i").agg(F.sum("x").alias("x"), F.count(F.lit(1)).alias("n"))
    sums = place.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda e: e["x"]).alias("t"), F.max("n").alias("m"))
    every = sums.agg(F.collect_list(F.struct(F.col("label").alias("l"), "t", "m")).alias("every"))
    met = unit.crossJoin(F.broadcast(every) if sums.count() <= 10_000 else every)
    far = lambda e: F.struct(e["l"].alias("l"), e["m"].alias("m"), (e["m"] - dot(F.col("u"), e["t"])).alias("d"))
    met = met.select("key", "label", F.transform("every", far).alias("e"))
    own = F.filter("e", lambda e: e["l"] == F.col("label"))[0]
    b = F.array_min(F.transform(F.filter("e", lambda e: e["l"] != F.col("label")), lambda e: e["d"] / e["m"]))
    ab = met.select("key", "label", F.when(own["m"] > 1, own["d"] / (own["m"] - 1)).alias("a"), b.alias("b"))
    return ab.select("key", "label", F.when(F.col("a").isNull() | F.col("b").isNull() | (F.greatest("a", "b") <= 0), 0.0).otherwise((F.col("b") - F.col("a")) / F.greatest("a", "b")).alias("s"))


def cost_to_set(f: MixedFrame, to: DataFrame, k: int = 3) -> DataFrame:
    """(key, mean_d, min_d, topk_d): mean, least, and mean of the ``k`` least distances to a set, itself left out.

    Rows pass once for each part of the set that fits a task; what the parts give for a row meets in one shuffle.
    """
    num, cat, stats, key, clean = f.num, f.cat, f.stats, f.key, f.clean
    modes = (("mean_d", "mean"), ("min_d", "min"), ("topk_d", "topk"))

    def passed(some: pd.DataFrame) -> DataFrame:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for at in range(0, len(batch), 2048):
                    rows = batch.iloc[at : at + 2048]
                    d = gower_block(rows, some, num, cat, stats)
                    d[rows[key].to_numpy()[:, None] == some[key].to_numpy()[None, :]] = np.inf
                    yield rows[[key]].assign(d=list(np.concatenate([group_parts(d, mode, k) for _, mode in modes], axis=1)))

        return clean.mapInPandas(run, f"{key} long, d array<double>")

    every = None
    for n, some in enumerate(dealt(to.select(f.key, *f.num, *f.cat), f.key)):  # noqa: B007
        every = passed(some) if every is None else every.union(passed(some))
    met = every.groupBy(key).agg(F.collect_list("d").alias("d")) if n else every.select(key, F.array("d").alias("d"))

    def merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x = np.array([np.stack(p) for p in batch["d"]]).reshape(len(batch), -1, 3 + k)
            got = {name: group_whole(part, mode, k) for (name, mode), part in zip(modes, np.split(x, [2, 3], axis=2), strict=True)}
            yield batch[[key]].assign(**{c: np.round(np.where(np.isfinite(v), v, 0.0), 6) for c, v in got.items()})

    return met.mapInPandas(merge, f"{key} long, mean_d double, min_d double, topk_d double")
