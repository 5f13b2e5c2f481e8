"""Choice of algorithm and number of clusters: by composite score, or by consistency in the space of anchor columns."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..frame import MixedFrame
from ..operators import cluster, kamila, landmarks, metrics

CLUSTERERS: dict[str, Callable[[MixedFrame, int, int], DataFrame]] = {
    "kprototypes": lambda f, k, seed: cluster.k_prototypes_of(f, [k], seed)[k],
    "auto": lambda f, k, seed: cluster.balanced(f, k, seed=seed),
    "hac_landmark": lambda f, k, seed: cluster.hac(f, k, seed=seed),
    "kamila": lambda f, k, seed: kamila.kamila(f, k, 2, seed=seed)[0] if f.num and f.cat else cluster.k_prototypes(f, k, seed=seed, starts=1)[0],
}


@dataclass
class Trial:
    algorithm: str
    k: int
    labels: DataFrame = field(repr=False)
    anchored: float = math.nan
    overall: float = math.nan
    score: float = math.nan
    by_anchor: bool = False
    dbi: float = math.nan
    chi: float = math.nan


def labelled(f: MixedFrame, labels: DataFrame, rows: DataFrame | None = None) -> MixedFrame:
    """The frame (or a sample of it) with a clustering as its label."""
    base = f.clean.drop("label") if rows is None else rows
    return MixedFrame(base.join(labels.withColumnRenamed("cluster", "_cluster"), f.key).persist(), f.key, f.num, f.cat, "_cluster")


def consistency(f: MixedFrame, columns: list[str], c: float = 3.0, k: int = 50, seed: int = 42, known: dict | None = None) -> float:
    """Mean neighbour consistency of a labelled frame in the space of ``columns``; NaN for a single label or no column. ``known``
    has the labels' sizes, if they are; no label is null then."""
    g = f.select(columns)
    classes = g.clean.select("label").distinct().count() if known is None else len(known)
    if classes < 2 or not (g.num or g.cat):
        return math.nan
    m = max(30, min(int(c * math.sqrt(g.n)), 3000, g.n - 1))
    marks = landmarks.stratified(g.clean, g.key, "label", m, 3, seed, known)
    k = min(max(k, 5), max(5, g.n - 1))
    got = metrics.lnc_star(g, marks, k, classes).agg(F.avg("lnc")).first()[0]
    return math.nan if got is None else got


def composite_score(f: MixedFrame, c: float = 3.0, weight: float = 0.6, topk: int = 3, seed: int = 42, skip_lnc: bool = False) -> float:
    """Landmark silhouette and neighbour consistency of a labelled frame as one score; ``skip_lnc`` leaves the latter out."""
    sizes = {r[0]: r["count"] for r in f.df.groupBy(f.label).count().collect()}
    known = None if None in sizes else sizes
    ss = metrics.landmark_scores(f, metrics.landmarks_of(f, c, seed, known), k=topk).agg(F.avg("s")).first()[0]
    lnc = math.nan if skip_lnc else consistency(f, f.num + f.cat, c, metrics.default_k(f.n), seed, known)
    return metrics.composite(list(sizes.values()), ss, lnc, weight)


def rank_trials(trials: DataFrame) -> DataFrame:
    """(trial, place): by score ``j``; scores within 1e-9 are equal, and go by the lesser ``dbi``, then the greater ``chi``."""
    return trials.select("trial", F.row_number().over(Window.orderBy(F.desc(F.round("j", 9)), F.asc_nulls_last("dbi"), F.desc_nulls_last("chi"), "trial")).alias("place"))


def best_of(f: MixedFrame, trials: list[Trial]) -> Trial:
    """The trial of the best score; only among equals (within 1e-9) are the dispersion indices computed, then fewer clusters win."""
    top = max(t.score for t in trials)
    equal = [t for t in trials if t.score >= top - 1e-9]
    if len(equal) > 1 and f.num:
        for t in equal:
            df = labelled(f, t.labels).df.select(F.col("_cluster").alias("label"), *f.num)
            t.dbi, t.chi = metrics.davies_bouldin(df, "label", f.num).first()[0] or math.inf, metrics.calinski_harabasz(df, "label", f.num).first()[0] or -math.inf
    low = lambda x: math.inf if math.isnan(x) else x
    return min(equal, key=lambda t: (low(t.dbi), -t.chi if not math.isnan(t.chi) else math.inf, t.k))


def trials_of(f: MixedFrame, algorithms: tuple[str, ...], ks: range, seed: int = 42, known: DataFrame | None = None, full_rows: int | None = None, steps: dict[int, DataFrame] | None = None) -> list[Trial]:
    """A clustering for each algorithm and k; those that fail for the data's sake, or have one cluster, are left out.

    k-prototypes is fitted to all rows, whatever their number. Only for a caller who gives ``known`` labels and ``full_rows`` are
    those of more rows derived from the known ones instead, by merging and splitting (from ``steps`` that are done already).
    """
    out, steps = [], {} if steps is None else steps
    derive = known is not None and full_rows is not None and f.n > full_rows
    if "kprototypes" in algorithms and not derive:
        cluster.k_prototypes_of(f, [k for k in ks if 2 <= k <= f.n], seed)
    for name in algorithms:
        for k in ks:
            try:
                labels = (cluster.derived(f, known, k, seed, steps) if derive and name == "kprototypes" else CLUSTERERS[name](f, k, seed)).persist()
            except ValueError:
                continue
            if labels.select("cluster").distinct().count() > 1:
                out.append(Trial(name, k, labels))
    return out


def search(f: MixedFrame, algorithms: tuple[str, ...] = ("kprototypes",), ks: range = range(2, 6), screen: float = 0.15, c: float = 3.0, weight: float = 0.6, topk: int = 3, seed: int = 42, known: DataFrame | None = None, full_rows: int | None = None, skip_lnc: bool = False, made: list[Trial] | None = None) -> tuple[Trial, list[Trial]]:
    """Best composite score, and all trials; those already ``made`` with the same parameters are only scored. Algorithms whose mean over the first and last k is worse than the best one's by
    ``screen`` are not tried on the other numbers of clusters. Equal scores go by :func:`best_of`."""

    steps: dict[int, DataFrame] = {}

    def scored(names: tuple[str, ...], some: list[int]) -> list[Trial]:
        # What is made is all that could be made.
        found = trials_of(f, names, some, seed, known, full_rows, steps) if made is None else [t for t in made if t.algorithm in names and t.k in some]
        for t in found:
            g = labelled(f, t.labels)
            g.__dict__["stats"] = f.stats  # of the same rows
            t.score = composite_score(g, c, weight, topk, seed, skip_lnc)
            g.df.unpersist()
        return found

    few = sorted({ks[0], ks[-1]})
    first = scored(algorithms, few)
    mean = {a: sum(t.score for t in first if t.algorithm == a) / n for a in algorithms if (n := sum(t.algorithm == a for t in first))}
    if not mean:
        raise ValueError("no clustering with two clusters or more was found")
    every = first + scored(tuple(a for a in mean if mean[a] >= max(mean.values()) - screen), [k for k in ks if k not in few])
    return best_of(f, every), every


def anchored_search(f: MixedFrame, anchors: list[str], algorithms: tuple[str, ...] = ("kprototypes",), ks: range = range(2, 6), anchor_least: float = 0.5, overall_least: float = 0.5, rows: int | None = None, seed: int = 42, known: DataFrame | None = None, full_rows: int | None = None, **how) -> tuple[Trial, list[Trial]]:
    """Greatest consistency in the anchors' space among clusterings that are consistent enough there and over all columns;
    where none is, the choice by composite score. Consistency is measured on all rows, or on ``rows`` of smallest hash."""
    some = None if rows is None else landmarks.sample(f.clean.drop("label"), f.key, rows, seed).persist()
    found = trials_of(f, algorithms, ks, seed, known, full_rows)
    for t in found:
        g = labelled(f, t.labels, some)
        g.n  # noqa: B018  the statistics of all columns, counted once
        t.anchored, t.overall = consistency(g, [c for c in anchors if c in f.num + f.cat], seed=seed), consistency(g, f.num + f.cat, seed=seed)
        g.df.unpersist()
    good = [t for t in found if t.anchored >= anchor_least and not t.overall < overall_least]
    if good:
        best = max(good, key=lambda t: (t.anchored, -t.k))
        best.by_anchor, best.score = True, best.anchored
        return best, found
    return search(f, algorithms, ks, seed=seed, known=known, full_rows=full_rows, made=found, **how)[0], found


def choose(f: MixedFrame, anchors: list[str], algorithms: tuple[str, ...], ks: range, anchor_least: float, overall_least: float, c: float, weight: float, topk: int, seed: int, known: DataFrame | None = None, full_rows: int | None = None, skip_lnc: bool = False) -> tuple[Trial, list[Trial]]:
    """By anchors where there are any among the columns, else by composite score."""
    how = {"c": c, "weight": weight, "topk": topk, "seed": seed, "known": known, "full_rows": full_rows, "skip_lnc": skip_lnc}
    here = [a for a in anchors if a in f.num + f.cat]
    if here:
        return anchored_search(f, here, algorithms, ks, anchor_least, overall_least, **how)
    return search(f, algorithms, ks, **how)


def over_subsets(f: MixedFrame, subsets: list[tuple[str, ...]], anchors: list[str], algorithms: tuple[str, ...], ks: range, **how) -> list[tuple[tuple[str, ...], Trial, list[Trial]]]:
    """The best trial of each column subset, and all its trials, best subset first: a choice by anchors precedes one by
    composite score, then the score decides, then the order given. A subset without a clustering is left out."""
    out = []
    for s in subsets:
        try:
            out.append((s, *choose(f.select(list(s)), anchors, algorithms, ks, **how)))
        except ValueError:
            continue
    if not out:
        raise ValueError("no clustering with two clusters or more was found")
    return sorted(out, key=lambda x: (not x[1].by_anchor, -x[1].score))


def with_control(f: MixedFrame, ranked: list[tuple[tuple[str, ...], Trial]], least: float = 0.5, retries: int = 3, seed: int = 42) -> tuple[tuple[str, ...], Trial, str, float]:
    """The first of the ranked results, and of at most ``retries`` after it, that is consistent enough; else the first."""
    seen = []
    for i, (s, t) in enumerate(ranked[: retries + 1]):
        value = consistency(labelled(f.select(list(s)), t.labels), list(s), seed=seed)
        if not value < least:
            return s, t, "accept" if i == 0 else "retried", value
        seen.append(value)
    return *ranked[0], "rejected_all", seen[0]


def precedence(trials: DataFrame) -> DataFrame:
    """(trial, place): choices by anchors first, by consistency; then the others, by composite score."""
    score = F.when(F.col("dav"), F.col("lnc")).otherwise(F.col("j"))
    return trials.select("trial", F.row_number().over(Window.orderBy(F.desc("dav"), F.desc(score), "trial")).alias("place"))
