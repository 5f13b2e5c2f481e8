"""Scores of column subsets by landmarks, with labels fixed; optionally put on the exact silhouette's scale."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..frame import MixedFrame
from . import cluster, landmarks, metrics, redundancy
from .search import Score, Subset


def landmark_reward(f: MixedFrame, marks: DataFrame, mode: str = "topk", k: int = 3) -> Score:
    """Mean landmark silhouette of each subset of a batch; one pass over the rows, and one sum per subset and task back."""
    parts = landmarks.dealt(marks.select(f.key, "label", *f.num, *f.cat), f.key)
    some = next(parts)
    if next(parts, None) is not None:
        # Beyond what a task holds, subset by subset by the scores that take landmarks in parts.
        return lambda subsets: [metrics.landmark_scores(f.select(list(s)), marks, mode, k).agg(F.avg("s")).first()[0] for s in subsets]
    order = sorted(some["label"].unique(), key=str)
    parts = [np.nonzero((some["label"] == v).to_numpy())[0] for v in order]
    num, stats, clean = set(f.num), f.stats, f.clean

    def score(subsets: list[Subset]) -> list[float]:
        columns = sorted({c for s in subsets for c in s})

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total, n = np.zeros(len(subsets)), 0
            for batch in batches:
                n += len(batch)
                for at in range(0, len(batch), 512):
                    rows = batch.iloc[at : at + 512]
                    one = {c: np.abs(rows[c].to_numpy()[:, None] - some[c].to_numpy()[None, :]) * stats[c][2] if c in num else (rows[c].to_numpy(object)[:, None] != some[c].to_numpy(object)[None, :]).astype(float) for c in columns}
                    mine = rows["label"].to_numpy(object)[:, None] == np.array(order, dtype=object)[None, :]
                    same = rows["label"].to_numpy(object)[:, None] == some["label"].to_numpy(object)[None, :]
                    for i, s in enumerate(subsets):
                        d = sum(one[c] for c in s) / len(s)
                        g = np.stack([metrics.group_distance(np.where(same & (d <= metrics.EPS), np.inf, d)[:, p], mode, k) for p in parts], axis=1)
                        a, b = np.where(mine, g, np.inf).min(axis=1), np.where(mine, np.inf, g).min(axis=1)
                        top = np.maximum(a, b)
                        ok = np.isfinite(top) & (top > metrics.EPS)
                        total[i] += float(((b[ok] - a[ok]) / top[ok]).sum())
            yield pd.DataFrame({"i": np.arange(len(subsets)), "s": total, "n": n})

        got = clean.mapInPandas(run, "i long, s double, n long").groupBy("i").agg((F.sum("s") / F.greatest(F.sum("n"), F.lit(1))).alias("m")).collect()
        means = {r["i"]: r["m"] for r in got}
        return [means.get(i, 0.0) for i in range(len(subsets))]

    return score


class Calibrated:
    """A cheap score put on the scale of a dear one: every ``every``-th batch has its best subset scored by both, and from
    ``least`` pairs on the line through them maps the cheap score; predictions lie in -1..1. Lines are kept per subset."""

    def __init__(self, cheap: Score, dear: Score, every: int = 3, least: int = 5):
        self.cheap, self.dear, self.every, self.least = cheap, dear, every, least
        self.batches, self.pairs = 0, {}

    @property
    def line(self) -> tuple[float, float]:
        if len(self.pairs) < self.least:
            return 1.0, 0.0
        x, y = np.array(list(self.pairs.values())).T
        spread = ((x - x.mean()) ** 2).sum()
        a = float(((x - x.mean()) * (y - y.mean())).sum() / spread) if spread > 1e-12 else 0.0
        return a, float(y.mean() - a * x.mean())

    def __call__(self, subsets: list[Subset]) -> list[float]:
        got = self.cheap(subsets)
        if subsets and self.batches % self.every == 0:
            at = max(range(len(got)), key=lambda i: got[i])
            if subsets[at] not in self.pairs:
                self.pairs[subsets[at]] = (got[at], self.dear([subsets[at]])[0])
        self.batches += 1
        a, b = self.line
        return [min(1.0, max(-1.0, a * x + b)) for x in got]


def with_penalty(score: Score, red: dict, alpha: float = 0.3) -> Score:
    """(1 - alpha) of the score and alpha of the lack of redundancy."""
    return lambda subsets: [(1 - alpha) * q + alpha * redundancy.penalty(list(s), red) for s, q in zip(subsets, score(subsets), strict=True)]


def reclustered(f: MixedFrame, k: int, rows: int = 6000, seed: int = 42) -> Score:
    """Exact silhouette of a clustering made anew on each subset's own columns, on a sample of ``rows`` rows of smallest hash."""
    some = landmarks.sample(f.clean.drop("label") if f.label else f.clean, f.key, rows, seed).persist()

    def score(subsets: list[Subset]) -> list[float]:
        out = []
        for s in subsets:
            g = MixedFrame(some.select(f.key, *s), f.key, [c for c in f.num if c in s], [c for c in f.cat if c in s])
            labels = cluster.k_prototypes(g, min(k, g.n), seed=seed, starts=1)[0].withColumnRenamed("cluster", "_cluster")
            t = MixedFrame(g.df.join(labels, f.key), f.key, g.num, g.cat, "_cluster")
            out.append(metrics.silhouette(t).agg(F.avg("s")).first()[0] or 0.0)
        return out

    return score


def resolve(engine: str, n: int, exact_up_to: int = 2000) -> str:
    """Engine A scores exactly, AB by fixed landmarks, C exactly on small tables and by calibrated landmarks beyond."""
    return {"A": "exact", "AB": "fixed"}.get(engine, "exact" if n <= exact_up_to else "calibrated")
