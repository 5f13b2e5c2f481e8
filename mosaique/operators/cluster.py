"""Clusterers: assignment is an expression over a few prototypes, updates are one grouped aggregate per round."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..frame import MixedFrame, hash_order, spread
from .features import standard
from .ordered import column_quantiles


def _cost(f: MixedFrame, p: dict, gamma: float) -> Column:
    num = sum(((F.col(c) - F.lit(float(p[c]))) * (F.col(c) - F.lit(float(p[c]))) for c in f.num), F.lit(0.0))
    return num + F.lit(gamma) * sum((F.when(F.col(c) == p[c], 0).otherwise(1) for c in f.cat), F.lit(0))


def assign(f: MixedFrame, rows: DataFrame, prototypes: list[dict], gamma: float = 1.0) -> DataFrame:
    """Nearest prototype (of equals the first) and its cost; prototypes are k literals, nothing is joined or shuffled."""
    costs = F.array(*[F.struct(_cost(f, p, gamma).alias("cost"), F.lit(k).alias("cluster")) for k, p in enumerate(prototypes)])
    return rows.withColumn("_b", F.array_min(costs)).select(*rows.columns, F.col("_b.cluster").alias("cluster"), F.col("_b.cost").alias("cost"))


def update(f: MixedFrame, assigned: DataFrame) -> DataFrame:
    """Means and modes (of ties the smallest) per cluster, its size and its cost."""
    return assigned.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.sum("cost").alias("cost"), *[F.avg(c).alias(c) for c in f.num], *[F.mode(c, True).alias(c) for c in f.cat])


def k_prototypes(f: MixedFrame, k: int, gamma: float | None = None, seed: int = 42, rounds: int = 20, starts: int = 3, scale: bool = True) -> tuple[DataFrame, list[dict], float]:
    """Labels (key, cluster), prototypes and cost. Without numbers this is k-modes, without categories k-means.

    Numbers are standardised; gamma defaults to half their mean deviation (then 0.5). Starts are rows of smallest hash,
    spread by distance; the start of least cost stays. The scaled rows are cached while it runs; a round is one job with k
    rows back. ``scale`` says whether the numbers are yet to be standardised.
    """
    check_k(k, f.n)
    plain, rows, gamma = _scaled(f, gamma, scale)
    step = lambda fits: [{r["cluster"]: r.asDict() for r in update(f, assign(f, rows, p, gamma)).collect()} for p in fits]
    best = min((_descend(step, [_first(f, _pool(f, rows, k, seed + start), k, gamma)], rounds)[0] for start in range(starts)), key=lambda b: b[0])
    rows.unpersist()
    return assign(f, plain, best[1], gamma).select(f.key, "cluster"), best[1], best[0]


def k_prototypes_of(f: MixedFrame, ks: Iterable[int], seed: int = 42, rounds: int = 20) -> dict[int, DataFrame]:
    """Labels (key, cluster) for each of ``ks``, of one start on all rows as :func:`k_prototypes` makes them; the fits go on
    together, so that a round of all is one job. The frame keeps what was fitted, and is not fitted to it again."""
    done = f.fits
    new = sorted({check_k(k, f.n) for k in ks if (k, seed, rounds) not in done})
    if new:
        plain, rows, gamma = _scaled(f)
        pool = _pool(f, rows, new[-1], seed)
        best = _descend(lambda fits: _updates(f, rows, fits, gamma), [_first(f, pool[: _pool_size(k)], k, gamma) for k in new], rounds)
        rows.unpersist()
        done |= {(k, seed, rounds): assign(f, plain, p, gamma).select(f.key, "cluster") for k, (_, p) in zip(new, best, strict=True)}
    return {k: done[k, seed, rounds] for k in ks}


def _scaled(f: MixedFrame, gamma: float | None = None, scale: bool = True) -> tuple[DataFrame, DataFrame, float]:
    """Standardised rows, the same spread and cached, and gamma."""
    plain = standard(f.clean, f.num) if f.num and scale else f.clean
    return plain, spread(plain, f.key, f.n).persist(), gamma if gamma is not None else (0.5 if f.num else 1.0)


def _pool_size(k: int) -> int:
    return max(50, 10 * k)


def _pool(f: MixedFrame, rows: DataFrame, k: int, seed: int) -> list[dict]:
    """The rows of smallest hash that a start is picked from."""
    return [r.asDict() for r in rows.orderBy(hash_order(seed, f.key)).limit(_pool_size(k)).collect()]


def _first(f: MixedFrame, pool: list[dict], k: int, gamma: float) -> list[dict]:
    """A start: rows of the pool, each the farthest from those before it."""
    cost = lambda a, b: sum((a[c] - b[c]) ** 2 for c in f.num) + gamma * sum(a[c] != b[c] for c in f.cat)
    chosen = [pool[0]]
    while len(chosen) < k:
        chosen.append(max(pool, key=lambda r: min(cost(r, p) for p in chosen)))
    return chosen


def _descend(step: Callable[[list[list[dict]]], list[dict[int, dict]]], fits: list[list[dict]], rounds: int) -> list[tuple[float, list[dict]]]:
    """Cost and prototypes of each fit's best round. ``step`` gives each fit's new prototypes by cluster, with their costs; a fit
    that gains no more leaves the rounds."""
    best, total, left = [(math.inf, [])] * len(fits), [math.inf] * len(fits), list(range(len(fits)))
    for _ in range(rounds):
        still = []
        for i, got in zip(left, step([fits[i] for i in left]), strict=True):
            now = sum(r["cost"] for r in got.values())
            if now < best[i][0]:
                best[i] = (now, fits[i])
            fits[i] = [got.get(j, p) for j, p in enumerate(fits[i])]
            if not total[i] - now <= 1e-9 * max(1.0, abs(now)):
                still.append(i)
            total[i] = now
        left = still
        if not left:
            break
    return best


def _updates(f: MixedFrame, rows: DataFrame, fits: list[list[dict]], gamma: float, block: int = 1 << 16) -> list[dict[int, dict]]:
    """What :func:`assign` and :func:`update` give for several lists of prototypes, by one pass over the rows: tasks pass on sums
    of numbers and counts of values for each block of rows, of which the sums and modes are made by two aggregates."""
    import numpy as np
    import pyarrow as pa

    num, cat = f.num, f.cat
    kind = "fit int, cluster int, col int, value string, n long, s double"

    def part(rows: pa.Table) -> Iterator[tuple]:
        x = [rows.column(c).to_numpy() for c in num]
        coded = [rows.column(c).combine_chunks().dictionary_encode() for c in cat]
        codes, values = [c.indices.to_numpy() for c in coded], [c.dictionary for c in coded]
        place = [{v: i for i, v in enumerate(v.to_pylist())} for v in values]
        for fit, prototypes in enumerate(fits):
            least, nearest = np.full(rows.num_rows, np.nan), np.zeros(rows.num_rows, np.int64)
            for j, p in enumerate(prototypes):
                cost, differ = np.zeros(rows.num_rows), np.zeros(rows.num_rows, np.int64)
                for c, v in zip(num, x, strict=True):
                    cost += (v - p[c]) ** 2
                for c, v, at in zip(cat, codes, place, strict=True):
                    differ += v != at.get(p[c], -1)
                cost += gamma * differ
                # NaN is the greatest, as in Spark.
                better = (cost < least) | (np.isnan(least) & ~np.isnan(cost))
                least[better], nearest[better] = cost[better], j
            k = len(prototypes)
            n = np.bincount(nearest, minlength=k)
            here = np.nonzero(n)[0]
            for col, w in enumerate([least, *x]):
                yield fit, here, col, None, n[here], np.bincount(nearest, w, k)[here]
            for col, (v, names) in enumerate(zip(codes, values, strict=True), 1 + len(num)):
                counts = np.bincount(nearest * len(names) + v, minlength=k * len(names))
                some = np.nonzero(counts)[0]
                yield fit, some // len(names), col, names.take(pa.array(some % len(names))), counts[some], np.zeros(len(some))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in _blocks(batches, block):
            for fit, cluster, col, value, n, s in part(some):
                size, i32 = len(cluster), pa.int32()
                value = pa.nulls(size, pa.string()) if value is None else value.cast(pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(np.full(size, fit), i32), pa.array(cluster, i32), pa.array(np.full(size, col), i32), value, pa.array(n, pa.int64()), pa.array(s, pa.float64())], ["fit", "cluster", "col", "value", "n", "s"])

    sums = rows.select(*num, *cat).mapInArrow(run, kind).groupBy("fit", "cluster", "col", "value").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    got = sums.groupBy("fit", "cluster", "col").agg(F.min(F.struct((-F.col("n")).alias("n"), "value")).alias("top"), F.sum("n").alias("n"), F.sum("s").alias("s")).collect()
    out: list[dict[int, dict]] = [{} for _ in fits]
    for r in got:
        to = out[r["fit"]].setdefault(r["cluster"], {"cluster": r["cluster"], "n": r["n"]})
        if r["col"] == 0:
            to["cost"] = r["s"]
        elif r["col"] <= len(num):
            to[num[r["col"] - 1]] = r["s"] / r["n"]
        else:
            to[cat[r["col"] - 1 - len(num)]] = r["top"]["value"]
    return out


def _blocks(batches: Iterator, rows: int) -> Iterator:
    """Arrow batches as tables of about ``rows`` rows."""
    import pyarrow as pa

    held = []
    for b in batches:
        held.append(b)
        if sum(h.num_rows for h in held) >= rows:
            yield pa.Table.from_batches(held)
            held = []
    if any(h.num_rows for h in held):
        yield pa.Table.from_batches(held)


def estimate_gamma(f: MixedFrame, scale: float = 1.0) -> float:
    """The weight of a mismatch against numbers as they are: their mean deviation, times ``scale``; 1 without numbers."""
    if not f.num:
        return 1.0
    row = f.clean.agg(*[F.stddev_pop(c).alias(c) for c in f.num]).first()
    return scale * sum(row[c] or 1e-9 for c in f.num) / len(f.num)


def check_k(k: int, n: int) -> int:
    """The number of clusters, if 2 <= k <= n."""
    if not 2 <= k <= n:
        raise ValueError(f"{k} clusters of {n} rows")
    return k


def k_prototypes_on_sample(f: MixedFrame, k: int, rows: int = 6000, seed: int = 42) -> DataFrame:
    """Labels (key, cluster) of all rows by prototypes fitted on a sample: ``rows`` of smallest hash."""
    if f.n <= rows:
        return k_prototypes(f, k, seed=seed, starts=1)[0]
    scaled = standard(f.clean, f.num) if f.num else f.clean
    some = MixedFrame(scaled.orderBy(hash_order(seed, f.key), f.key).limit(rows).persist(), f.key, f.num, f.cat)
    gamma = 0.5 if f.num else 1.0
    _, prototypes, _ = k_prototypes(some, k, gamma, seed, starts=1, scale=False)
    some.df.unpersist()
    return assign(f, scaled, prototypes, gamma).select(f.key, "cluster")


def derived(f: MixedFrame, labels: DataFrame, k: int, seed: int = 42, steps: dict[int, DataFrame] | None = None) -> DataFrame:
    """Labels of ``k`` clusters from others: as they are, or the smallest merged, or the largest split. ``steps`` holds what the
    splits of the same labels gave so far, by number of clusters, and is added to."""
    sizes = {r["cluster"]: r["count"] for r in labels.groupBy("cluster").count().collect()}
    if len(sizes) < k:
        return split_to(f, labels, k, seed, steps)
    if len(sizes) == k:
        return labels
    to = F.create_map(*[F.lit(x) for pair in merge_to(sizes, k).items() for x in pair])
    return labels.select(f.key, F.element_at(to, F.col("cluster")).alias("cluster"))


def dense_labels(df: DataFrame, label: str) -> DataFrame:
    """Labels as 0..k-1 by order of the old ones; the labels, not the rows, are ranked."""
    from pyspark.sql import Window

    names = df.select(label).distinct().withColumn("dense", (F.dense_rank().over(Window.orderBy(label)) - 1).cast("int"))
    return df.join(F.broadcast(names) if names.count() <= 100_000 else names, label)


def merge_to(sizes: dict, k: int) -> dict:
    """Label -> merged label: the smallest joins the second smallest until k are left; then renumbered."""
    members = {c: [c] for c in sizes}
    left = dict(sizes)
    while len(left) > k:
        a, b = sorted(left, key=lambda c: (left[c], str(c)))[:2]
        left[b] += left.pop(a)
        members[b] += members.pop(a)
    order = {c: i for i, c in enumerate(sorted(left, key=str))}
    return {m: order[c] for c, ms in members.items() for m in ms}


def average_linkage(d: list[list[float]], k: int) -> list[int]:
    """Average-linkage merging of a small distance matrix down to k clusters; ties go to the first pair."""
    import numpy as np

    m = np.array(d, float)
    n = len(m)
    np.fill_diagonal(m, np.inf)
    size, label = np.ones(n), list(range(n))
    for _ in range(n - k):
        i, j = np.unravel_index(np.argmin(m), m.shape)
        i, j = min(i, j), max(i, j)
        row = (size[i] * m[i] + size[j] * m[j]) / (size[i] + size[j])
        m[i], m[:, i] = row, row
        m[i, i] = np.inf
        m[j], m[:, j] = np.inf, np.inf
        size[i] += size[j]
        label = [i if x == j else x for x in label]
    order = {c: r for r, c in enumerate(dict.fromkeys(label))}
    return [order[c] for c in label]


def hac(f: MixedFrame, k: int, landmarks: int = 300, seed: int = 42) -> DataFrame:
    """Average linkage on at most ``landmarks`` rows of smallest hash, then each row takes its nearest landmark's cluster.

    The driver holds the distances of all pairs of landmarks: a number that does not grow with the rows is wanted.
    """
    from ..functions.gower import gower_block

    marks = f.clean.orderBy(hash_order(seed, f.key), f.key).limit(landmarks).toPandas()
    num, cat, stats, key = f.num, f.cat, f.stats, f.key
    marks["cluster"] = average_linkage(gower_block(marks, marks, num, cat, stats).tolist(), k)

    def run(batches):
        for batch in batches:
            for at in range(0, len(batch), 4096):
                rows = batch.iloc[at : at + 4096]
                yield rows[[key]].assign(cluster=marks["cluster"].to_numpy()[gower_block(rows, marks, num, cat, stats).argmin(axis=1)])

    return f.clean.mapInPandas(run, f"{key} long, cluster int")


def prediction_strength(df: DataFrame, test: str, train: str) -> DataFrame:
    """Least share, over test clusters, of pairs that the training clusters keep together; from counts, never from pairs."""
    c = df.groupBy(test, train).agg(F.count(F.lit(1)).alias("c"))
    per = c.groupBy(test).agg(F.sum(F.col("c") * (F.col("c") - 1)).alias("kept"), F.sum("c").alias("n"))
    return per.agg(F.round(F.min(F.when(F.col("n") > 1, F.col("kept") / (F.col("n") * (F.col("n") - 1))).otherwise(1.0)), 6).alias("strength"))


def nrd0(df: DataFrame, column: str) -> DataFrame:
    """Rule-of-thumb bandwidth of a Gaussian density."""
    low, high = column_quantiles(df, [column], [0.25, 0.75])[column]
    s = df.agg(F.stddev_samp(column).alias("s"), F.count(column).alias("n"))
    iqr = F.lit(None if low is None else (high - low) / 1.34).cast("double")
    low = F.when((iqr > 0) & (iqr < F.col("s")), iqr).otherwise(F.col("s"))
    return s.select(F.round(0.9 * F.when(low > 0, low).otherwise(1.0) * F.pow(F.col("n").cast("double"), F.lit(-0.2)), 6).alias("bandwidth"))


def balanced(f: MixedFrame, k: int, least: float = 0.02, retries: int = 3, seed: int = 42) -> DataFrame:
    """k-prototypes (k-means or k-modes by the columns there are), retried with other seeds while a cluster is tiny; of
    unbalanced results that with the greatest smallest cluster stays."""
    best: tuple[int, DataFrame | None] = (-1, None)
    for turn in range(retries + 1):
        labels = k_prototypes(f, k, seed=seed + turn)[0]
        sizes = [r["count"] for r in labels.groupBy("cluster").count().collect()]
        small = min(sizes) if len(sizes) == k else 0
        best = max(best, (small, labels), key=lambda x: x[0])
        if small >= max(3, int(least * f.n)):
            break
    return best[1]


def split_to(f: MixedFrame, labels: DataFrame, k: int, seed: int = 42, steps: dict[int, DataFrame] | None = None) -> DataFrame:
    """Splits the largest cluster (of equals the first) in two, again and again, until there are k; clusters below 4 rows,
    and those whose rows are all alike, stay whole. A split only depends on the labels before it, so that more clusters go on
    from the ``steps`` of fewer."""
    steps = {} if steps is None else steps
    done = [n for n in steps if n <= k]
    labels = steps[max(done)] if done else labels
    while True:
        sizes = {r["cluster"]: r["count"] for r in labels.groupBy("cluster").count().collect()}
        if len(sizes) >= k:
            return labels
        big = min(sizes, key=lambda c: (-sizes[c], c))
        if sizes[big] < 4:
            return labels
        part = MixedFrame(f.df.join(labels.where(F.col("cluster") == big), f.key, "left_semi"), f.key, f.num, f.cat)
        halves, prototypes, _ = k_prototypes(part, 2, seed=seed, starts=1)
        halves = halves.withColumnRenamed("cluster", "_half")
        if halves.select("_half").distinct().count() < 2:
            return labels
        new = max(sizes) + 1
        labels = labels.join(halves, f.key, "left").select(f.key, F.when(F.col("_half") == 1, F.lit(new)).otherwise(F.col("cluster")).alias("cluster")).persist()
        steps[len(sizes) + 1] = labels


def propagate(f: MixedFrame, known: DataFrame, label: str) -> DataFrame:
    """(key, label) of the nearest labelled row by Euclidean distance of the numbers (of equals the smallest key).

    Rows stream in blocks past each part of ``known`` that fits a task; of the parts' nearest the nearest stays.
    """
    import numpy as np

    from .landmarks import dealt

    num, key, kind = f.num, f.key, dict(known.dtypes)[label]

    def passed(some):
        some = some.sort_values(key)
        to, names, keys = some[num].to_numpy(float), some[label].to_numpy(), some[key].to_numpy()

        def run(batches):
            for batch in batches:
                for at in range(0, len(batch) if len(to) else 0, 2048):
                    rows = batch.iloc[at : at + 2048]
                    d = np.zeros((len(rows), len(to)))
                    for i, c in enumerate(num):
                        d += (rows[c].to_numpy()[:, None] - to[None, :, i]) ** 2
                    best = d.argmin(axis=1)
                    yield rows[[key]].assign(_d=d[np.arange(len(d)), best], _k=keys[best], **{label: names[best]})

        return f.clean.select(key, *num).mapInPandas(run, f"{key} long, _d double, _k long, {label} {kind}")

    every = None
    for n, some in enumerate(dealt(known.select(key, label, *[F.col(c).cast("double").alias(c) for c in num]), key)):  # noqa: B007
        every = passed(some) if every is None else every.union(passed(some))
    if n:
        every = every.groupBy(key).agg(F.min(F.struct("_d", "_k", label)).alias("_b")).select(key, f"_b.{label}")
    return every.select(key, label)


def smooth_counts(counts: DataFrame, label: str, level: str, b: float = 0.025) -> DataFrame:
    """(label, level, share) of counts ``c`` over the whole grid, lent first to other labels, then to other levels."""
    from pyspark.sql import Window

    grid = counts.select(label).distinct().crossJoin(counts.select(level).distinct()).join(counts, [label, level], "left").fillna(0, ["c"])
    per_level, per_label = Window.partitionBy(level), Window.partitionBy(label)
    sized = grid.withColumn("k", F.count(F.lit(1)).over(per_level)).withColumn("m", F.count(F.lit(1)).over(per_label))
    lend = lambda x, total, n: (1 - b) * x + b / F.greatest(n - 1, F.lit(1)) * (total - x)
    across = sized.withColumn("x", lend(F.col("c").cast("double"), F.sum("c").over(per_level), F.col("k")))
    along = across.withColumn("y", lend(F.col("x"), F.sum("x").over(per_label), F.col("m")))
    return along.select(label, level, F.round(F.col("y") / F.sum("y").over(per_label), 6).alias("share"))
