"""Landmarks that represent their labels better: swaps with candidates, gains summed over all rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..frame import MixedFrame
from ..functions.gower import gower_block


def coverage(f: MixedFrame, marks: DataFrame) -> DataFrame:
    """(label, n, cost): mean distance of a label's rows to their nearest landmark of the same label."""
    some, num, cat, stats = marks.select(f.key, "label", *f.num, *f.cat).toPandas(), f.num, f.cat, f.stats

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for label, rows in batch.groupby("label"):
                own = some[some["label"] == label]
                if len(own):
                    near = [gower_block(rows.iloc[at : at + 2048], own, num, cat, stats).min(axis=1) for at in range(0, len(rows), 2048)]
                    yield pd.DataFrame({"label": [label], "n": [len(rows)], "s": [float(np.concatenate(near).sum())]})

    part = f.clean.mapInPandas(run, "label string, n long, s double")
    return part.groupBy("label").agg(F.sum("n").alias("n"), F.round(F.sum("s") / F.sum("n"), 6).alias("cost"))


def _gains(f: MixedFrame, marks: pd.DataFrame, pool: pd.DataFrame) -> DataFrame:
    """(label, out, into, change, cost): what the sum of nearest distances changes by if ``into`` replaces ``out``.

    A row whose nearest landmark stays can only gain; a row whose nearest one goes falls back to the second or the new one.
    A task passes on sums per pair of places, so that the shuffle does not grow with the rows.
    """
    num, cat, stats, key = f.num, f.cat, f.stats, f.key

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[str, tuple[np.ndarray, float]] = {}
        for batch in batches:
            for label, group in batch.groupby("label"):
                own, new = marks[marks["label"] == label], pool[pool["label"] == label]
                if not len(own) or not len(new):
                    continue
                table, cost = total.get(label, (np.zeros((len(own), len(new))), 0.0))
                for at in range(0, len(group), 2048):
                    rows = group.iloc[at : at + 2048]
                    d, c = gower_block(rows, own, num, cat, stats), gower_block(rows, new, num, cat, stats)
                    nearest = d.argmin(axis=1)
                    first = d[np.arange(len(d)), nearest]
                    d[np.arange(len(d)), nearest] = np.inf
                    second = d.min(axis=1)
                    stays = np.minimum(c - first[:, None], 0)
                    goes = np.where(np.isfinite(second)[:, None], np.minimum(c, second[:, None]), c) - first[:, None]
                    table = table + stays.sum(axis=0)
                    np.add.at(table, nearest, goes - stays)
                    cost += float(first.sum())
                total[label] = (table, cost)
        for label, (table, cost) in total.items():
            own, new = marks[marks["label"] == label][key].to_numpy(), pool[pool["label"] == label][key].to_numpy()
            yield pd.DataFrame({"label": label, "out": np.repeat(own, len(new)), "into": np.tile(new, len(own)), "change": table.ravel(), "cost": cost})

    part = f.clean.mapInPandas(run, "label string, out long, into long, change double, cost double")
    return part.groupBy("label", "out", "into").agg(F.round(F.sum("change"), 9).alias("change"), F.sum("cost").alias("cost"))


def swap(f: MixedFrame, marks: DataFrame, pool: DataFrame, rounds: int = 10, least_gain: float = 1e-4) -> DataFrame:
    """Landmarks after at most ``rounds`` rounds; in each the best swap of every label is made, while it gains enough.

    Landmarks and candidates (both bounded by parameters) are on the driver; rows are only streamed past them.
    """
    cols = [f.key, "label", *f.num, *f.cat]
    now, free = marks.select(cols).toPandas(), pool.select(cols).toPandas()
    open_labels = set(now["label"])
    for _ in range(rounds):
        gains = _gains(f, now[now["label"].isin(open_labels)], free)
        best = gains.groupBy("label").agg(F.min(F.struct("change", "out", "into")).alias("b"), F.first("cost").alias("cost")).collect()
        good = [(r["label"], r["b"]) for r in best if -r["b"]["change"] > least_gain * max(r["cost"], 1e-12)]
        open_labels = {label for label, _ in good}
        if not good:
            break
        out, into = {b["out"] for _, b in good}, {b["into"] for _, b in good}
        now, free = pd.concat([now[~now[f.key].isin(out)], free[free[f.key].isin(into)]]), pd.concat([free[~free[f.key].isin(into)], now[now[f.key].isin(out)]])
    return f.clean.sparkSession.createDataFrame(now, f.clean.select(cols).schema)
