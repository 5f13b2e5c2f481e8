import math

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from mosaique.frame import MixedFrame
from mosaique.functions import nearest
from mosaique.functions.gower import gower_block
from mosaique.operators import landmarks, metrics

NUM, CAT = ["x", "y", "z"], ["c"]


def rows(n: int, seed: int) -> pd.DataFrame:
    """Numbers of many and of few values, a category that a tenth of the rows lack in the other table, and repeated rows."""
    r = np.random.default_rng(seed)
    out = pd.DataFrame({"k": np.arange(n) + 10_000 * seed, "x": r.random(n) * 9, "y": r.integers(0, 4, n) / 3, "z": r.normal(size=n), "c": r.choice(["a", "b", f"only{seed}"], n, p=[0.6, 0.3, 0.1]), "label": r.choice(["g", "h", "i"], n, p=[0.5, 0.49, 0.01])})
    out.iloc[n // 2 : n // 2 + n // 10, 1:5] = out.iloc[: n // 10, 1:5].to_numpy()
    return out


def scales(df: pd.DataFrame) -> dict:
    return {c: (df[c].min(), df[c].max(), 1.0 / max(df[c].max() - df[c].min(), 1e-9)) for c in NUM}


def test_boxes_hold_all_near_rows_and_few_others():
    a, b = rows(6000, 1), rows(2000, 2)
    stats, values = scales(a), nearest.values_of(b, CAT)
    pa_, pb = (nearest.points(pa.Table.from_pandas(x), NUM, CAT, values) for x in (a, b))
    groups = [np.flatnonzero(b["label"] == v) for v in ("g", "h", "i")]
    whole, seen, pairs = gower_block(a, b, NUM, CAT, stats), np.zeros(len(a), int), 0
    for at, here, some in nearest.near(pa_, pb, [stats[c][2] for c in NUM], groups, 3, -1.0, 16):
        seen[at] += 1
        for g, near in zip(groups, some, strict=True):
            d = nearest.block(here, pb.take(near), [stats[c][2] for c in NUM])
            assert np.array_equal(d, whole[np.ix_(at, near)])
            assert np.allclose(nearest.least_of(d, 3), np.sort(whole[np.ix_(at, g)], axis=1)[:, :3], atol=1e-12)
            pairs += len(at) * len(near)
    assert (seen == 1).all() and pairs < 0.25 * whole.size


def silhouettes(df: pd.DataFrame, marks: pd.DataFrame, stats: dict, k: int) -> np.ndarray:
    d = gower_block(df, marks, NUM, CAT, stats)
    mine = df["label"].to_numpy()[:, None] == marks["label"].to_numpy()[None, :]
    d[mine & (d <= 1e-12)] = np.inf
    order = sorted(marks["label"].unique())
    g = np.stack([metrics.group_distance(d[:, marks["label"].to_numpy() == v], "topk", k) for v in order], axis=1)
    own = df["label"].to_numpy()[:, None] == np.array(order)[None, :]
    lo, hi = np.where(own, g, np.inf).min(axis=1), np.where(own, np.inf, g).min(axis=1)
    top = np.maximum(lo, hi)
    return np.where(np.isfinite(top) & (top > 1e-12), (hi - lo) / np.where(top > 1e-12, top, 1), 0)


@pytest.mark.parametrize("k", [1, 3])
def test_landmark_scores_are_those_of_all_pairs(spark, k):
    df = rows(3000, 1)
    f = MixedFrame(spark.createDataFrame(df), "k", NUM, CAT, "label")
    marks = landmarks.stratified(f.clean, "k", "label", 600, 3)
    got = metrics.landmark_scores(f, marks, "topk", k).toPandas().set_index("key")["s"]
    want = silhouettes(df, marks.toPandas(), f.stats, k)
    assert np.allclose(got.loc[df["k"]].to_numpy(), want, atol=1e-12)
    assert "MapInArrow" in metrics.landmark_scores(f, marks, "topk", k)._jdf.queryExecution().toString()


def test_landmark_scores_of_odd_rows(spark):
    """Null labels, labels without landmarks, categories of no landmark, and an infinite number: as the other kernel has them."""
    df = rows(400, 1).astype({"label": object})
    df.loc[3, "label"], df.loc[4, "label"], df.loc[5, "x"] = None, "new", math.inf
    f = MixedFrame(spark.createDataFrame(df), "k", NUM, CAT, "label")
    marks = landmarks.stratified(f.clean.where("label in ('g', 'h')"), "k", "label", 60, 3)
    got = metrics.landmark_scores(f, marks).orderBy("key").toPandas()
    want = silhouettes(df, marks.toPandas(), f.stats, 3)
    assert got["label"][3] == "None" and got["label"][4] == "new" and got["s"][3] == 0
    fine = ~df.index.isin([3, 4])
    assert np.allclose(got["s"][fine], want[fine], atol=1e-12)
    assert f.clean.agg(F.count(F.lit(1))).first()[0] == len(got)


def brute(df: pd.DataFrame, marks: pd.DataFrame, num: list[str], cat: list[str], stats: dict, k: int) -> list[tuple]:
    d = np.round(gower_block(marks, df, num, cat, stats), 9)
    out = []
    for i, m in enumerate(marks["k"]):
        near = pd.DataFrame({"key": df["k"], "label": df["label"], "d": d[i]})[(df["k"] != m).to_numpy()].sort_values(["d", "key"]).head(k)
        out += [(m, *r) for r in near.itertuples(index=False)]
    return sorted(out)


@pytest.mark.parametrize(("num", "cat"), [(NUM, CAT), (["y"], []), ([], CAT), ([], [])])
def test_neighbours_are_those_of_all_pairs_and_of_equals_the_smallest_keys(spark, num, cat):
    df = rows(3000, 1).sample(frac=1, random_state=1)
    f = MixedFrame(spark.createDataFrame(df), "k", NUM, CAT, "label").select([*num, *cat])
    marks = landmarks.stratified(f.clean, "k", "label", 100, 3)
    got = metrics.neighbours(f, marks, 20).select("landmark", "key", "label", "d").collect()
    assert sorted(map(tuple, got)) == brute(df, marks.toPandas(), num, cat, f.stats, 20)


def test_rows_of_equal_values_are_few_in_each_task():
    x = np.tile(np.arange(50.0), 2000)
    first = nearest.first_of_equals(nearest.Points([x], []), 51)
    assert len(first) == 50 * 51 and first.max() < 50 * 51


def test_neighbours_are_sought_once_for_a_consistency(spark, monkeypatch):
    f = MixedFrame(spark.createDataFrame(rows(500, 1)), "k", NUM, CAT, "label")
    got = metrics.lnc_star(f, landmarks.stratified(f.clean, "k", "label", 40, 3), 10, 3)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "Join" not in plan


def test_fallback_of_the_anchored_search_makes_no_clustering_twice(spark, monkeypatch):
    from mosaique.plans import anchored

    f, made = MixedFrame(spark.createDataFrame(rows(300, 1).drop(columns="label")), "k", NUM, CAT), []
    plain = anchored.CLUSTERERS["kprototypes"]
    monkeypatch.setitem(anchored.CLUSTERERS, "kprototypes", lambda f, k, seed: made.append(k) or plain(f, k, seed))
    best, tried = anchored.anchored_search(f, ["x"], ks=range(2, 4), anchor_least=2.0)
    assert not best.by_anchor and made == [2, 3] and len(tried) == 2 and any(t is best for t in tried)
    again = anchored.search(f, ks=range(2, 4))[0]
    assert (again.k, again.score) == (best.k, pytest.approx(best.score, abs=1e-9))


def test_splits_go_on_from_those_of_fewer_clusters(spark, monkeypatch):
    from mosaique.operators import cluster
    from mosaique.plans import anchored

    df = rows(400, 1).drop(columns="label")
    f = MixedFrame(spark.createDataFrame(df), "k", NUM, CAT)
    two, calls = cluster.k_prototypes(f, 2, starts=1)[0].persist(), []
    want = {k: {tuple(r) for r in cluster.derived(f, two, k).collect()} for k in (3, 4, 5)}
    plain = cluster.k_prototypes
    monkeypatch.setattr(cluster, "k_prototypes", lambda *a, **b: calls.append(1) or plain(*a, **b))
    steps = {}
    got = {k: {tuple(r) for r in cluster.derived(f, two, k, 42, steps).collect()} for k in (5, 3, 4)}
    assert got == want and len(calls) == 3
    calls.clear()
    anchored.search(f, ks=range(2, 6), known=two, full_rows=100, screen=9.0)
    assert len(calls) == 3


def test_rows_of_one_split_go_to_all_tasks(spark):
    from mosaique.frame import spread

    df = spark.range(0, 30_000, 1, 1)
    assert spread(df, "id", 30_000).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    assert spread(df, "id", 30_000, 1000).rdd.getNumPartitions() == 30 and spread(df, "id", 20_000) is df
