import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from mosaique.frame import MixedFrame
from mosaique.operators import cluster, kamila, landmarks, metrics, refine, reward, unit
from mosaique.plans import anchored, evaluation
from mosaique.streaming import scorer


@pytest.fixture(scope="module")
def planted(spark):
    """Three groups far apart in x and y, of one colour each in nine rows of ten."""
    rows = [(i, 10.0 * (i % 3) + (i * 37 % 101) / 50, -8.0 * (i % 3) + (i * 61 % 97) / 50, "abc"[(i + (i % 10 == 0)) % 3], f"g{i % 3}") for i in range(300)]
    return MixedFrame(spark.createDataFrame(rows, "k long, x double, y double, c string, g string").repartition(3).persist(), "k", ["x", "y"], ["c"], "g")


def pure(labels: pd.DataFrame) -> bool:
    return labels.assign(t=labels["k"] % 3).groupby("t")["cluster"].nunique().eq(1).all() and labels["cluster"].nunique() == 3


def dense(f):
    rows = unit.scaled(f).orderBy(f.key).toPandas()
    return rows, unit.cosine_block(rows, rows, f.num, f.cat)


def test_unit_space_written_out_and_implicit_agree(planted):
    wide = unit.unit_columns(planted, {"c": ["a", "b", "c"]}).orderBy("k").toPandas().drop(columns="k").to_numpy()
    assert np.allclose((wide**2).sum(axis=1), 1)
    assert np.allclose(1 - wide @ wide.T, dense(planted)[1], atol=1e-9)


def test_k_center_covers_like_the_greedy_choice(planted):
    rows, d = dense(planted)
    chosen = [r["k"] for r in unit.k_center(planted, 6).select("k").collect()]
    assert len(set(chosen)) == 6
    greedy = [0]
    while len(greedy) < 6:
        greedy.append(int(d[:, greedy].min(axis=1).argmax()))
    at = [rows.index[rows["k"] == k][0] for k in chosen]
    # Cosine distance is half a squared distance; the coreset's radius is within a constant factor.
    assert math.sqrt(d[:, at].min(axis=1).max()) <= 3 * math.sqrt(d[:, greedy].min(axis=1).max()) + 1e-9


def test_k_center_of_few_rows_takes_all(planted):
    few = MixedFrame(planted.df.where("k < 4"), "k", ["x", "y"], ["c"])
    assert unit.k_center(few, 9).count() == 4


def test_cluster_aware_keeps_the_quota(planted):
    got = unit.cluster_aware(planted, 30).groupBy("label").count().collect()
    assert {r["label"]: r["count"] for r in got} == {"g0": 10, "g1": 10, "g2": 10}


def test_centroid_similarity_by_hand(planted):
    rows = unit.centroid_similarity(planted).orderBy("k").toPandas()
    wide = unit.unit_columns(planted, {"c": ["a", "b", "c"]}).orderBy("k").toPandas().drop(columns="k").to_numpy()
    for g in ("g0", "g1", "g2"):
        own = (rows["label"] == g).to_numpy()
        assert np.allclose(wide[own] @ wide[own].mean(axis=0), rows.loc[own, "sim"], atol=1e-8)


def test_candidates_are_no_landmarks(planted):
    marks = landmarks.stratified(planted.clean, "k", "label", 9, 3)
    pool = unit.candidate_pool(planted, marks, F.col("x"), 10)
    assert pool.join(marks, "k").count() == 0
    assert {r["count"] for r in pool.groupBy("label").count().collect()} == {10}


def test_swaps_gain_what_they_say(planted):
    marks = landmarks.stratified(planted.clean, "k", "label", 6, 2)
    pool = unit.candidate_pool(planted, marks, F.col("x"), 12)
    cost = lambda m: sum(r["n"] * r["cost"] for r in refine.coverage(planted, m).collect())
    gains = refine._gains(planted, marks.toPandas(), pool.toPandas())
    best = gains.orderBy("change", "out", "into").first()
    swapped = marks.where(F.col("k") != best["out"]).unionByName(pool.where(F.col("k") == best["into"]))
    assert cost(swapped) - cost(marks) == pytest.approx(best["change"], abs=1e-3)
    after = refine.swap(planted, marks, pool, rounds=4)
    assert cost(after) <= cost(swapped) + 1e-3 and after.count() == marks.count()


def test_a_single_landmark_is_swapped_too(planted):
    marks = planted.clean.where("k in (0, 1, 2)")
    after = refine.swap(planted, marks, unit.candidate_pool(planted, marks, F.col("x"), 20))
    assert after.groupBy("label").count().count() == 3


def test_cosine_silhouette_against_pairs(spark):
    rng = np.random.default_rng(3)
    v, labels = rng.normal(size=(30, 4)), [i % 3 if i < 29 else 9 for i in range(30)]
    df = spark.createDataFrame([(i, labels[i], v[i].tolist()) for i in range(30)], "k long, l int, v array<double>")
    got = {r["key"]: r["s"] for r in metrics.cosine_silhouette(df, "k", "l", "v").collect()}
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    d, lab = 1 - u @ u.T, np.array(labels)
    for i in range(30):
        per = {g: d[i, (lab == g) & (np.arange(30) != i)] for g in set(labels)}
        want = 0.0 if not len(per[lab[i]]) else (lambda a, b: (b - a) / max(a, b))(per[lab[i]].mean(), min(x.mean() for g, x in per.items() if g != lab[i]))
        assert got[i] == pytest.approx(want, abs=1e-9)


def test_kamila_finds_planted_groups(planted):
    labels, model, objective = kamila.kamila(planted, 3, starts=6, rounds=12)
    assert pure(labels.toPandas()) and math.isfinite(objective)
    assert model.means.shape == (3, 2)


def test_kamila_needs_both_kinds(planted):
    with pytest.raises(ValueError):
        kamila.kamila(planted.select(["x"]), 2)


def test_radial_density_sums_to_one_and_smoothing_keeps_counts():
    x = np.linspace(0.1, 3, 200)
    y = kamila.radial(x, np.ones(200), 4.0, 2)
    assert y.sum() * 4.0 / 400 == pytest.approx(1.0) and (y >= 0).all()
    t = np.array([[5.0, 0.0, 1.0], [2.0, 2.0, 2.0]])
    s = kamila.smooth(t, 0.1)
    assert s.sum() == pytest.approx(t.sum()) and (s > 0).all() and np.array_equal(kamila.smooth(t, 0.0), t)


def test_bandwidth_of_counts_is_that_of_values():
    x, w = np.array([1.0, 2.0, 4.0, 7.0]), np.array([3.0, 1.0, 4.0, 2.0])
    every = np.repeat(x, w.astype(int))
    iqr = np.subtract(*np.percentile(every, [75, 25]))
    assert kamila.bandwidth(x, w) == pytest.approx(0.9 * min(every.std(ddof=1), iqr / 1.34) * len(every) ** -0.2, rel=0.05)


def test_splits_and_balance(planted):
    one = planted.df.select("k", F.lit(0).alias("cluster"))
    assert pure(cluster.split_to(planted, one, 3).toPandas())
    assert pure(cluster.balanced(planted, 3).toPandas())
    same = MixedFrame(planted.df.select("k", F.lit(1.0).alias("x"), F.lit(1.0).alias("y"), F.lit("a").alias("c")), "k", ["x", "y"], ["c"])
    assert cluster.split_to(same, one, 3).select("cluster").distinct().count() == 1


def test_landmark_reward_is_the_landmark_silhouette(planted):
    marks = metrics.landmarks_of(planted)
    subsets = [("x",), ("c", "x", "y")]
    got = reward.landmark_reward(planted, marks)(subsets)
    for s, value in zip(subsets, got, strict=True):
        want = metrics.landmark_scores(planted.select(list(s)), marks).agg(F.avg("s")).first()[0]
        assert value == pytest.approx(want, abs=1e-9)


def test_calibration_puts_scores_on_the_dear_scale():
    cheap, dear = (lambda ss: [len(s) / 10 for s in ss]), (lambda ss: [0.5 * len(s) / 10 + 0.1 for s in ss])
    c = reward.Calibrated(cheap, dear, every=1, least=3)
    assert c([("a",)]) == [0.1]
    c([("a", "b")])
    assert c([("a", "b", "c")]) == [pytest.approx(0.25)]
    assert reward.resolve("C", 100) == "exact" and reward.resolve("C", 10**6) == "calibrated" and reward.resolve("AB", 5) == "fixed"


def test_anchored_search_finds_the_groups_and_falls_back(planted):
    f = MixedFrame(planted.df, "k", ["x", "y"], ["c"])
    best, tried = anchored.anchored_search(f, ["x"], ks=range(2, 5))
    assert best.by_anchor and len(tried) == 3 and best.anchored >= max(t.anchored for t in tried if not t.overall < 0.5)
    fallback, _ = anchored.anchored_search(f, ["x"], ks=range(2, 4), anchor_least=2.0)
    assert not fallback.by_anchor


def test_structural_control_takes_the_first_that_passes(planted):
    f = MixedFrame(planted.df, "k", ["x", "y"], ["c"])
    bad = anchored.Trial("none", 2, planted.df.select("k", (F.col("k") % 2).cast("int").alias("cluster")))
    good = anchored.Trial("kprototypes", 3, cluster.k_prototypes(f, 3)[0])
    s, t, action, value = anchored.with_control(f, [(("x", "y"), bad), (("c", "x", "y"), good)])
    assert t is good and action == "retried" and value >= 0.5
    assert anchored.with_control(f, [(("x", "y"), bad)])[2] == "rejected_all"


def test_evaluation_of_a_csv(spark, planted, tmp_path):
    planted.df.withColumn("gap", F.when(F.col("k") > 1, 1.0)).withColumnRenamed("k", "id").write.option("sep", ";").option("header", True).csv(str(tmp_path / "in"))
    r = evaluation.evaluate_csv(spark, str(tmp_path / "in"), "g").first()
    assert (r["n"], r["clusters"], r["ss_mode"], r["status"]) == (298, 3, "full", "OK")
    assert r["ss_gower"] > 0.5 and r["lsil"] > 0.5 and r["lnc"] > 0.5
    one = evaluation.evaluate(MixedFrame(planted.df.where("g = 'g0'"), "k", ["x"], [], "g")).first()
    assert one["status"] == "one label" and one["lsil"] is None


def test_stream_is_scored_and_counted(spark, planted, tmp_path):
    prototypes = [{"x": 1.0, "y": 1.0, "c": "a"}, {"x": 11.0, "y": -7.0, "c": "b"}, {"x": 21.0, "y": -15.0, "c": "c"}]
    planted.df.withColumn("ts", F.timestamp_seconds(F.col("k") * 60)).write.parquet(str(tmp_path / "in"))
    rows = spark.readStream.schema("k long, x double, y double, c string, g string, ts timestamp").parquet(str(tmp_path / "in"))
    scored = scorer.drift(scorer.score(planted, rows, prototypes), "ts")
    job = scored.writeStream.format("memory").queryName("drift").outputMode("complete").trigger(availableNow=True).start()
    job.awaitTermination(120)
    got = spark.table("drift")
    assert got.agg(F.sum("n")).first()[0] == 300
    assert {r["cluster"]: r["n"] for r in got.groupBy("cluster").agg(F.sum("n").alias("n")).collect()} == {0: 100, 1: 100, 2: 100}


def test_pipeline_by_anchors_and_by_landmark_rewards(planted):
    from mosaique.plans.pipeline import Params, run_pipeline

    base = {"c_max": 4, "sa_iters": 4, "mab_T": 4, "subset_min_frac": 0.9, "subset_max_frac": 1.0, "mab_k": 3}
    df = planted.df.drop("g")
    out = run_pipeline(df, "k", params=Params(**base, anchors=("x",), engine="AB"))
    # Merged groups are as consistent as groups apart, so the fewest clusters win; no group may be cut.
    got = out["assignments"].toPandas()
    assert out["dav_applied"] and got["cluster"].nunique() == out["best_K"] and got.assign(t=got["k"] % 3).groupby("t")["cluster"].nunique().eq(1).all()
    out = run_pipeline(df, "k", params=Params(**base, algorithms=("kprototypes", "hac_landmark"), engine="C"))
    assert not out["dav_applied"] and len(out["trials"]) >= 4


def test_redundancy_is_read_from_the_cache_of_the_same_rows_only(planted, tmp_path):
    from mosaique.operators import redundancy

    folder = str(tmp_path / "red")
    f = MixedFrame(planted.df, "k", ["x", "y"], ["c"])
    first, again = (redundancy.as_dict(redundancy.cached(f, 5, folder)) for _ in range(2))
    assert first == again == redundancy.as_dict(redundancy.matrix(f, 5))
    redundancy.cached(MixedFrame(planted.df.where("k < 250"), "k", ["x", "y"], ["c"]), 5, folder)
    assert len([p for p in (tmp_path / "red").iterdir() if p.is_dir()]) == 2


def test_rerank_prefers_the_planted_columns(spark, planted):
    from mosaique.plans.pipeline import reranked

    df = planted.df.withColumn("noise", (F.col("k") * 7919 % 311).cast("double"))
    got = reranked(MixedFrame(df, "k", ["x", "y", "noise"], ["c"]), [("noise",), ("x", "y")], 3)
    assert got[0][0] == ("x", "y") and got[0][1] > got[1][1]


def table(spark, n):
    rows = [(i, float(i * 37 % 1009), float(i * 61 % 97) if i % 11 else None, f"c{i * 7 % 5}" if i % 13 else None, f"d{i * 11 % 23}") for i in range(n)]
    return MixedFrame(spark.createDataFrame(rows, "k long, x double, y double, c string, d string"), "k", ["x", "y"], ["c", "d"])


def rows_of(labels):
    return sorted(tuple(r) for r in labels.collect())


def test_trials_of_a_large_table_are_fitted_to_all_rows(spark):
    f = table(spark, 10_500)
    got = anchored.trials_of(f, ("kprototypes",), range(3, 5))
    assert [t.k for t in got] == [3, 4]
    for t in got:
        assert rows_of(t.labels) == rows_of(cluster.k_prototypes(f, t.k, starts=1)[0])


def test_fits_that_go_on_together_are_those_made_alone(spark, monkeypatch):
    base = table(spark, 400)
    for num, cat in ((["x", "y"], ["c", "d"]), (["x"], []), ([], ["c", "d"])):
        f = MixedFrame(base.df, "k", num, cat)
        got = cluster.k_prototypes_of(f, (2, 4), seed=7)
        for k in got:
            assert rows_of(got[k]) == rows_of(cluster.k_prototypes(f, k, seed=7, starts=1)[0])
        with pytest.raises(ValueError):
            cluster.k_prototypes_of(f, [401])
    plain, rows, gamma = cluster._scaled(base)
    odd = MixedFrame(rows.withColumn("x", F.when(F.col("k") % 50 == 0, float("nan")).otherwise(F.col("x"))), "k", base.num, base.cat)
    first = [r.asDict() for r in rows.where("k % 50 = 1").orderBy("k").limit(3).collect()]
    first[1]["x"] = float("nan")
    want = {r["cluster"]: r.asDict() for r in cluster.update(odd, cluster.assign(odd, odd.df, first, gamma)).collect()}
    one, = cluster._updates(odd, odd.df, [first], gamma, block=64)
    assert one.keys() == want.keys()
    for c in want:
        assert {x: one[c][x] for x in (*odd.cat, "n")} == {x: want[c][x] for x in (*odd.cat, "n")}
        assert all(one[c][x] == pytest.approx(want[c][x], nan_ok=True) for x in (*odd.num, "cost"))
    rows.unpersist()
    monkeypatch.setattr(cluster, "_updates", None)
    assert set(cluster.k_prototypes_of(f, [4, 2], seed=7)) == {2, 4}


def test_pipeline_fits_all_numbers_of_clusters_whatever_the_rows(spark):
    from mosaique.plans.pipeline import Params, run_pipeline

    f = table(spark, 10_500)
    f.df = f.df.fillna({"y": 5.0, "c": "c9"}).persist()
    out = run_pipeline(f.df, "k", params=Params(c_min=3, c_max=4, n_clusters=2, sa_iters=1, mab_T=2, sc_retries=0))
    assert [t["k"] for t in out["trials"]] == [3, 4]
    assert rows_of(out["assignments"]) == rows_of(cluster.k_prototypes(f.select(out["best_columns"]), out["best_K"], starts=1)[0])
    f.df.unpersist()
