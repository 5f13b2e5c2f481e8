"""Semiparametric mixture of mixed-type rows: a radial density of distances for numbers, smoothed level shares for categories.

Rows stay cached and scaled; a round is three aggregates over them (radii, means, level counts), whose results are small:
a histogram, k means and k rows per level. What goes back to the rows are literals.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..frame import MixedFrame, hash_order
from .cluster import prediction_strength
from .features import standard

GRID, FINE = 401, 4096
FLOOR = 1e-300
#: Levels of a category become literals of the plan; a column of more is a key, not a category.
MOST_LEVELS = 2000


def bandwidth(x: np.ndarray, w: np.ndarray) -> float:
    """Rule of thumb from values and their counts: 0.9 min(deviation, iqr / 1.34) n^-0.2."""
    n = w.sum()
    mean = (x * w).sum() / n
    spread = math.sqrt((w * (x - mean) ** 2).sum() / max(1.0, n - 1))
    q = np.interp([0.25 * (n - 1), 0.75 * (n - 1)], np.cumsum(w) - 1, x)
    low = min(spread, (q[1] - q[0]) / 1.34)
    return 0.9 * (low or spread or abs(mean) or 1.0) * n**-0.2


def density(df: DataFrame, column: str, lo: float, hi: float, width: float, points: int = GRID) -> DataFrame:
    """(x, density): Gaussian density on a grid. A task passes on one sum per grid point, however many rows it has."""
    grid = np.linspace(lo, hi, points)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, n = np.zeros(points), 0
        for batch in batches:
            x = batch["x"].dropna().to_numpy()
            n += len(x)
            for at in range(0, len(x), 8192):
                total += np.exp(-0.5 * ((grid[:, None] - x[None, at : at + 8192]) / width) ** 2).sum(axis=1)
        yield pd.DataFrame({"i": np.arange(points), "s": total, "n": n})

    sums = df.select(F.col(column).cast("double").alias("x")).mapInPandas(run, "i long, s double, n long").groupBy("i").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
    return sums.select(F.col("i"), (F.lit(lo) + F.col("i") * F.lit((hi - lo) / (points - 1))).alias("x"), (F.col("s") / (F.col("n") * F.lit(width * math.sqrt(2 * math.pi)))).alias("density"))


def radial(centres: np.ndarray, counts: np.ndarray, top: float, dims: int) -> np.ndarray:
    """Density over space at ``GRID`` radii up to ``top``, from a histogram of radii: the radii's own density over r^(dims-1).

    Near 0 the density of radii is a line through the origin; the result is capped at 1 and sums to 1.
    """
    grid = np.linspace(0, top or 1.0, GRID)
    if len(centres) < 2:
        return np.full(GRID, 0.01)
    h = bandwidth(centres, counts)
    y = np.exp(-0.5 * ((grid[:, None] - centres[None, :]) / h) ** 2) @ counts
    y /= counts.sum() * h * math.sqrt(2 * math.pi)
    y[y <= 0] = (y[y > 0].min() if (y > 0).any() else 1e-10) / 100
    edge = GRID // 20 - 1
    y[: edge + 1] = grid[: edge + 1] * y[edge] / grid[edge]
    out = np.zeros(GRID)
    out[1:] = np.minimum(1.0, y[1:] / grid[1:] ** (dims - 1))
    total = out.sum() * (grid[1] - grid[0])
    return out / total if total > 0 else np.full(GRID, 1 / GRID)


def smooth(table: np.ndarray, b: float) -> np.ndarray:
    """Counts (clusters, levels) that lend the share ``b`` to the other clusters evenly, then to the other levels."""
    k, m = table.shape
    across = (1 - b) * table + b / max(k - 1, 1) * (table.sum(axis=0, keepdims=True) - table)
    return (1 - b) * across + b / max(m - 1, 1) * (across.sum(axis=1, keepdims=True) - across)


@dataclass
class Model:
    num: list[str]
    cat: list[str]
    means: np.ndarray
    logs: dict[str, dict[str, list[float]]]
    heights: np.ndarray
    top: float

    def distance(self, k: int) -> Column:
        square = sum(((F.col(c) - F.lit(float(self.means[k][i]))) * (F.col(c) - F.lit(float(self.means[k][i]))) for i, c in enumerate(self.num)), F.lit(0.0))
        return F.sqrt(square)

    def category(self, k: int) -> Column:
        """Sum of log shares; a level that the fit did not see has the least."""
        parts = [F.coalesce(F.create_map(*[x for v, p in levels.items() for x in (F.lit(v), F.lit(p[k]))])[F.col(c)], F.lit(math.log(FLOOR))) for c, levels in self.logs.items()]
        return sum(parts, F.lit(0.0))

    def log_density(self, r: Column) -> Column:
        heights = F.expr("array(" + ",".join(f"{float(x)!r}D" for x in [*self.heights, self.heights[-1]]) + ")")
        at = F.least(r / F.lit((self.top or 1.0) / (GRID - 1)), F.lit(float(GRID - 1)))
        low = F.floor(at).cast("int")
        return F.ln(F.greatest(F.lit(FLOOR), heights[low] + (at - low) * (heights[low + 1] - heights[low])))

    def assign(self, rows: DataFrame) -> DataFrame:
        """``cluster`` (of equals the first), its distance, and the best category likelihood."""
        k = len(self.means)
        rows = rows.withColumn("_d", F.array(*[self.distance(j) for j in range(k)])).withColumn("_c", F.array(*[self.category(j) for j in range(k)]))
        scores = F.array(*[F.struct((self.log_density(F.col("_d")[j]) + F.col("_c")[j]).alias("s"), F.lit(-j).alias("j")) for j in range(k)])
        rows = rows.withColumn("cluster", -F.array_max(scores)["j"])
        return rows.withColumn("distance", F.col("_d")[F.col("cluster")]).withColumn("cat_ll", F.array_max("_c")).drop("_d", "_c")


def _radii(rows: DataFrame, m: Model, bound: float) -> tuple[np.ndarray, np.ndarray, float]:
    """Histogram of distances to the nearest mean, and the greatest distance to any; one aggregate of at most FINE rows."""
    d = [m.distance(j) for j in range(len(m.means))]
    width = (bound or 1.0) / FINE
    near, far = F.least(*d) if len(d) > 1 else d[0], F.greatest(*d) if len(d) > 1 else d[0]
    got = rows.groupBy(F.least(F.lit(FINE - 1), F.floor(near / F.lit(width))).alias("b")).agg(F.count(F.lit(1)).alias("c"), F.avg(near).alias("x"), F.max(far).alias("far")).orderBy("b").collect()
    return np.array([r["x"] for r in got]), np.array([float(r["c"]) for r in got]), max((r["far"] for r in got), default=0.0)


def kamila(f: MixedFrame, k: int, starts: int = 3, rounds: int = 25, smoothing: float = 0.025, seed: int = 42) -> tuple[DataFrame, Model, float]:
    """Labels (key, cluster), the model and its objective; needs numbers and categories.

    Starts draw means uniformly from the columns' ranges and level shares from a flat Dirichlet. A start that loses a
    cluster is given up; of the others that with the greatest within / between ratio times category likelihood stays.
    """
    if not f.num or not f.cat:
        raise ValueError("needs both numeric and categorical columns")
    rows = standard(f.clean, f.num).select(f.key, *f.num, *f.cat).persist()
    box = rows.agg(F.count(F.lit(1)).alias("n"), *[x for c in f.num for x in (F.min(c).alias(f"lo_{c}"), F.max(c).alias(f"hi_{c}"))]).first()
    lo, hi = np.array([box[f"lo_{c}"] for c in f.num]), np.array([box[f"hi_{c}"] for c in f.num])
    bound = float(np.sqrt(((hi - lo) ** 2).sum()))
    long = F.explode(F.array(*[F.struct(F.lit(c).alias("f"), F.col(c).alias("v")) for c in f.cat])).alias("e")
    levels: dict[str, list[str]] = {c: [] for c in f.cat}
    for r in rows.select(long).select("e.*").distinct().limit(MOST_LEVELS * len(f.cat) + 1).collect():
        levels[r["f"]].append(r["v"])
    if sum(map(len, levels.values())) > MOST_LEVELS * len(f.cat):
        raise ValueError("a category has too many levels")
    levels = {c: sorted(v) for c, v in levels.items()}
    total = rows.agg(F.sum(F.sqrt(sum((F.col(c) * F.col(c) for c in f.num), F.lit(0.0))))).first()[0]
    best: tuple[float, Model | None] = (-math.inf, None)
    for start in range(starts):
        rng = np.random.default_rng([seed, start])
        means = rng.uniform(lo, hi, (k, len(f.num)))
        logs = {c: dict(zip(v, np.log(np.maximum(FLOOR, rng.dirichlet(np.ones(len(v)), k))).T.tolist(), strict=True)) for c, v in levels.items()}
        last = None
        for turn in range(1, rounds + 1):
            m = Model(f.num, f.cat, means, logs, np.zeros(GRID), 0.0)
            x, c, m.top = _radii(rows, m, bound)
            m.heights = radial(x, c, m.top, len(f.num))
            done = m.assign(rows)
            per = {r["cluster"]: r for r in done.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.sum("distance").alias("d"), F.sum("cat_ll").alias("ll"), *[F.avg(c).alias(c) for c in f.num]).collect()}
            if len(per) < k:
                last = None
                break
            now = [(per[j]["n"], *[round(per[j][c], 9) for c in f.num]) for j in range(k)]
            within, ll = sum(r["d"] for r in per.values()), sum(r["ll"] for r in per.values())
            stable, last = turn >= 3 and now == last, now
            objective = (within / (total - within) if total > within else 100.0) * ll
            if stable or turn == rounds:
                break
            means = np.array([[per[j][c] for c in f.num] for j in range(k)])
            counts = {c: np.zeros((k, len(v))) for c, v in levels.items()}
            for r in done.select("cluster", long).select("cluster", "e.*").groupBy("cluster", "f", "v").agg(F.count(F.lit(1)).alias("c")).collect():
                counts[r["f"]][r["cluster"], levels[r["f"]].index(r["v"])] = r["c"]
            logs = {}
            for c, v in levels.items():
                s = smooth(counts[c], smoothing)
                logs[c] = dict(zip(v, np.log(np.maximum(FLOOR, s / np.maximum(FLOOR, s.sum(axis=1, keepdims=True)))).T.tolist(), strict=True))
        if last is not None and objective > best[0]:
            best = (objective, m)
    if best[1] is None:
        raise ValueError("every start lost a cluster")
    return best[1].assign(rows).select(f.key, "cluster"), best[1], best[0]


def auto_k(f: MixedFrame, ks: range, runs: int = 3, threshold: float = 0.8, starts: int = 2, seed: int = 42) -> tuple[int, dict[int, float]]:
    """The greatest k whose prediction strength plus its error passes the threshold, else that of the greatest strength.

    Halves by hash are clustered apart; the test half goes to the training half's nearest means too. Pairs kept together
    are counted from the cross table, never listed.
    """
    found: dict[int, float] = {}
    for k in ks:
        got = []
        for run in range(runs):
            half = f.df.withColumn("_half", F.conv(F.substring(hash_order(seed + run, f.key), 1, 2), 16, 10).cast("int") < 128)
            test, train = (MixedFrame(half.where(F.col("_half") == side), f.key, f.num, f.cat) for side in (True, False))
            try:
                labels = kamila(test, k, starts, seed=seed + run)[0]
                model = kamila(train, k, starts, seed=seed + 100 + run)[1]
            except ValueError:
                continue
            near = standard(test.clean, f.num).withColumn("_b", F.array_min(F.array(*[F.struct(model.distance(j).alias("d"), F.lit(j).alias("j")) for j in range(k)])))
            both = near.select(f.key, F.col("_b.j").alias("train")).join(labels, f.key)
            got.append(prediction_strength(both, "cluster", "train").first()["strength"])
        found[k] = float(np.mean(got) + np.std(got) / math.sqrt(len(got))) if got else 0.0
    good = [k for k in found if found[k] > threshold]
    return (max(good) if good else max(found, key=lambda k: (found[k], -k))), found
