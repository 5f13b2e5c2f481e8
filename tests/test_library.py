import math

import pandas as pd
import pytest
from pyspark.sql import functions as F

from mosaique.frame import MixedFrame
from mosaique.functions.tails import chi2_sf, f_sf
from mosaique.operators import clean, cluster, features, metrics, ordered, profile, redundancy, search


@pytest.fixture(scope="module")
def six(spark):
    rows = [(0, 0.0, 0.0, "a", "p"), (1, 1.0, 0.0, "a", "p"), (2, 0.0, 1.0, "b", "p"), (3, 10.0, 10.0, "c", "q"), (4, 9.0, 10.0, "c", "q"), (5, 10.0, 9.0, "d", "q")]
    return MixedFrame(spark.createDataFrame(rows, "k long, x double, y double, c string, label string"), "k", ["x", "y"], ["c"], "label")


def test_gower_by_hand(six):
    got = {(r["landmark"], r["key"]): r["d"] for r in metrics.neighbours(six, six.clean, 5).collect()}
    assert got[0, 1] == pytest.approx(0.1 / 3)
    assert got[0, 3] == pytest.approx(1.0)
    assert all(got[a, b] == got[b, a] for a, b in got)


def brute_silhouette(six):
    rows = six.clean.toPandas()
    s = six.stats
    d = lambda a, b: (abs(a.x - b.x) * s["x"][2] + abs(a.y - b.y) * s["y"][2] + (a.c != b.c)) / 3
    out = {}
    for a in rows.itertuples():
        per = {lab: [d(a, b) for b in g.itertuples() if b.k != a.k] for lab, g in rows.groupby("label")}
        own, other = sum(per[a.label]) / len(per[a.label]), min(sum(v) / len(v) for lab, v in per.items() if lab != a.label)
        out[a.k] = (other - own) / max(own, other)
    return out


def test_silhouette_is_exact(six):
    got = {r["key"]: r["s"] for r in metrics.silhouette(six).collect()}
    want = brute_silhouette(six)
    assert got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)


def test_landmark_silhouette_with_all_rows_and_means_is_near_exact(six):
    got = {r["key"]: r["s"] for r in metrics.landmark_scores(six, six.clean, mode="mean").collect()}
    want = brute_silhouette(six)
    assert all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)


def test_dqc(spark):
    rows = [(k, 1.0, 5.0 if k else 6.0, k % 7, None if k % 5 else float(k), str(k % 3)) for k in range(1000)]
    df = spark.createDataFrame(rows, "k long, const double, near double, code int, gaps double, cat string")
    got = {r["column"]: r["issue"] for r in clean.dqc_report(df).collect()}
    assert got == {"k": "ok", "const": "zero_variance", "near": "near_zero_variance", "code": "disguised_categorical", "gaps": "high_missing", "cat": "ok"}
    assert clean.drop_flagged(df, clean.dqc_report(df))[1] == ["const", "near"]


def test_impute_takes_median_and_smallest_mode(spark):
    df = spark.createDataFrame([(1.0, "b"), (3.0, "a"), (None, None)], "x double, c string")
    assert [tuple(r) for r in clean.impute(df, ["x"], ["c"]).collect()][-1] == (2.0, "a")


def test_constant_columns_scale_to_zero(spark):
    df = spark.createDataFrame([(2.0,), (2.0,)], "x double")
    assert [r["x"] for r in features.standard(df, ["x"]).collect()] == [0.0, 0.0]


def test_planted_clusters_are_found(spark):
    rows = [(i, 10.0 * (i % 3) + (i * 37 % 100) / 100, ["a", "b", "c"][i % 3]) for i in range(300)]
    f = MixedFrame(spark.createDataFrame(rows, "k long, x double, c string"), "k", ["x"], ["c"])
    labels = cluster.k_prototypes(f, 3)[0].toPandas()
    assert labels.assign(t=labels["k"] % 3).groupby("t")["cluster"].nunique().eq(1).all()
    assert labels["cluster"].nunique() == 3
    hac = cluster.hac(f, 3, landmarks=60).toPandas()
    assert hac.assign(t=hac["k"] % 3).groupby("t")["cluster"].nunique().eq(1).all()


def test_merge():
    assert cluster.merge_to({"a": 5, "b": 1, "c": 2}, 2) == {"a": 0, "b": 1, "c": 1}


def test_tails_against_tables():
    assert chi2_sf(3.841459, 1) == pytest.approx(0.05, abs=1e-6)
    assert chi2_sf(18.307038, 10) == pytest.approx(0.05, abs=1e-6)
    assert f_sf(4.964603, 1, 10) == pytest.approx(0.05, abs=1e-6)
    assert f_sf(3.325835, 5, 10) == pytest.approx(0.05, abs=1e-6)


def test_yates_on_two_by_two(spark):
    rows = [("x", "a")] * 10 + [("x", "b")] * 20 + [("y", "a")] * 30 + [("y", "b")] * 5
    r = profile.chi_square(spark.createDataFrame(rows, "l string, c string"), "l", ["c"]).first()
    n, e = 65, [30 * 40 / 65, 30 * 25 / 65, 35 * 40 / 65, 35 * 25 / 65]
    want = sum((abs(o - x) - 0.5) ** 2 / x for o, x in zip([10, 20, 30, 5], e, strict=True))
    assert r["chi2"] == pytest.approx(want, abs=1e-4)
    assert r["cramers_v"] == pytest.approx(math.sqrt(want / n), abs=1e-5)


def test_redundancy_control():
    red = {("a", "b"): 0.95, ("a", "c"): 0.1, ("b", "c"): 0.3}
    assert redundancy.prune(["a", "b", "c"], red) == ["a", "c"]
    assert redundancy.penalty([], red) == 0 and redundancy.penalty(["a"], red) == 1
    assert redundancy.penalty(["a", "c"], red) == pytest.approx(0.9)


def test_search_finds_the_planted_subset():
    columns = list("abcdefgh")
    score = lambda subsets: [len({"a", "c", "e"} & set(s)) - 0.2 * len(s) for s in subsets]
    archive = search.Archive(5)
    best, value, stats = search.anneal(("b", "d", "f"), columns, score, iters=120, mode="full", least=1, most=5, rate=0.5, archive=archive)
    assert best == ("a", "c", "e") and value == pytest.approx(2.4)
    assert archive.top(1)[0][0] == best and len(archive.best) <= 5
    again = search.anneal(("b", "d", "f"), columns, score, iters=120, mode="full", least=1, most=5, rate=0.5)
    assert again[0] == best
    drawn, seen = search.bandit(columns, score, 30, 3, {("a", "b"): 0.99})
    assert not {"a", "b"} <= set(drawn) and set(seen) == set(columns)


def test_composite_penalises_tiny_clusters():
    assert metrics.composite([500, 500], 0.5, 0.5) > metrics.composite([990, 10], 0.5, 0.5)
    assert metrics.composite([5, 5], float("nan"), 0.4) == pytest.approx(0.4 - 0.02 * math.log(2))


def test_empty_frame(spark):
    df = spark.createDataFrame(pd.DataFrame({"label": pd.Series([], dtype="str")}), "label string")
    assert profile.sizes(df, "label").count() == 0


def test_pipeline_writes_its_artifacts(spark, tmp_path):
    from mosaique.plans.pipeline import Params, run_pipeline

    rows = [(i, 10.0 * (i % 2) + (i * 37 % 100) / 100, float(i * 61 % 97), ["a", "b"][i % 2], 1.0) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, x double, noise double, c string, const double")
    out = run_pipeline(df, outdir=str(tmp_path / "out"), params=Params(c_max=3, sa_iters=6, mab_T=5))
    assert out["dropped"] == ["const"] and out["assignments"].count() == 200
    names = {p.name for p in (tmp_path / "out").iterdir()}
    assert names >= {"cluster_assignments", "dqc_report", "features", "profiles_table", "config.json", "features.json", "metrics_internal.json", "profiles.json", "profiles.md", "summary.xlsx"}
    table = spark.read.option("header", True).csv(str(tmp_path / "out" / "profiles_table"))
    assert table.count() == out["best_K"] and {"cluster", "size", "fraction"} <= set(table.columns)
    assert out["k_hint_source"] == "midpoint" and out["k_hint"] == 2 and out["structural_control"]["action"] in ("accept", "retried", "rejected_all")
    assert all(not math.isnan(t["J"]) for t in out["trials"])


def test_running_sums_and_quantiles_by_ranges(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    rows = [("a", "p", float(x)) for x in rng.normal(size=500)] + [("a", "q", float(x)) for x in rng.integers(0, 5, 300)] + [("b", "p", 7.0)] * 40 + [("b", "q", None), ("c", "q", None)]
    df = spark.createDataFrame(rows, "f string, g string, x double")
    data = df.toPandas().dropna()
    probabilities = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
    got = {(r["f"], r["g"]): r["q"] for r in ordered.quantiles(df, ["f", "g"], "x", probabilities).collect()}
    assert got.keys() == set(data.groupby(["f", "g"]).groups)
    for k, part in data.groupby(["f", "g"]):
        assert got[k] == pytest.approx(list(np.quantile(part.x, probabilities)))
    values = df.where("x is not null").groupBy("f", "x").agg(F.count(F.lit(1)).alias("n"))
    run = ordered.running(values, ["f"], "x", ["n"], ordered.ranges(df, "f", "x")).toPandas()
    for f, part in run.sort_values("x").groupby("f"):
        assert list(part.run_n) == list(part.n.cumsum())
    none = df.where("x > 100")
    assert ordered.quantiles(none, ["f"], "x", [0.5]).count() == 0 and ordered.column_quantiles(none, ["x"], [0.5]) == {"x": [None]}


def test_no_window_over_a_whole_column(six):
    for df in (profile.kruskal(six.clean, "label", ["x", "y"]), metrics.silhouette(six), ordered.quantiles(six.clean, ["label"], "x", [0.5])):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        ordered_windows = [line for line in plan.split("\n") if "windowspecdefinition" in line and ("x#" in line.split("windowspecdefinition")[1].split("ASC")[0])]
        assert ordered_windows and all("_range" in line for line in ordered_windows)


def test_p_values(spark):
    df = spark.createDataFrame([("a", 1.0, "u"), ("a", 2.0, "u"), ("a", 4.0, "v"), ("b", 3.0, "v"), ("b", 6.0, "v"), ("b", 7.0, "u"), ("c", 9.0, "w"), ("c", 8.0, "w"), ("c", 5.0, "u")], "g string, x double, c string")
    r = profile.anova(df, "g", ["x"]).first()
    assert r["p"] == pytest.approx(f_sf(r["f_stat"], r["dof1"], r["dof2"]), abs=1e-5) and 0 < r["p"] < 1
    r = profile.kruskal(df, "g", ["x"]).first()
    assert r["p"] == pytest.approx(math.exp(-r["h_stat"] / 2), abs=1e-4)
    r = profile.chi_square(df, "g", ["c"]).first()
    assert r["p"] == pytest.approx(chi2_sf(r["chi2"], r["dof"]), abs=1e-5)
    assert profile.chi_square(df.withColumn("c", F.lit("one")), "g", ["c"]).first()["p"] is None


def test_wide_profile(six):
    got = {r["cluster"]: r.asDict() for r in profile.wide(six.df, "label", ["x", "y"], ["c"]).collect()}
    assert got["p"]["size"] == 3 and got["p"]["x_mean"] == pytest.approx(1 / 3, abs=1e-5) and got["q"]["x_median"] == 10
    assert got["p"]["c_top_lifts"].startswith("a:2.000;b:2.000") and got["p"]["x_cis"] == got["q"]["x_cis"] > 1


def test_null_numbers_count_as_zero_in_both_silhouettes(spark):
    rows = [(0, None, "a", "p"), (1, 1.0, "a", "p"), (2, 9.0, None, "q"), (3, 10.0, "b", "q"), (4, None, None, "q")]
    nulls = spark.createDataFrame(rows, "k long, x double, c string, label string")
    filled = nulls.fillna({"x": 0.0, "c": "nan"})
    score = lambda df: {r["key"]: r["s"] for r in metrics.silhouette(MixedFrame(df, "k", ["x"], ["c"], "label")).collect()}
    cheap = lambda df: {r["key"]: r["s"] for r in metrics.landmark_scores(MixedFrame(df, "k", ["x"], ["c"], "label"), MixedFrame(df, "k", ["x"], ["c"], "label").clean, mode="mean").collect()}
    assert score(nulls) == pytest.approx(score(filled)) and cheap(nulls) == pytest.approx(cheap(filled))


def test_explicit_types_casts_and_prefilter(spark):
    rows = [(k, k % 7, k % 5, 0 if k % 10 else 1, None if k % 2 else f"x{k % 3}", f"s{k}") for k in range(200)]
    df = spark.createDataFrame(rows, "k long, code int, count int, rare int, half string, name string")
    report = clean.dqc_report(df, on_disguised="cast", categorical=("k",), numeric_columns=("count",))
    got = {r["column"]: (r["kind"], r["issue"], r["action"]) for r in report.collect()}
    assert got["code"] == ("numeric", "disguised_categorical", "cast") and got["count"][1] == "ok" and got["k"][0] == "categorical"
    out, gone, cast = clean.apply_dqc(df, report, ("k",))
    assert cast == ["code", "k"] and not gone and dict(out.dtypes)["code"] == dict(out.dtypes)["k"] == "string"
    assert clean.prefilter(df)[1] == ["half", "rare"] or sorted(clean.prefilter(df)[1]) == ["half", "rare"]
    assert clean.prefilter(df.limit(0))[1] == []


def test_labels_are_derived_and_fitted_on_a_sample(spark):
    rows = [(i, 10.0 * (i % 3) + (i * 37 % 100) / 100, ["a", "b", "c"][i % 3]) for i in range(300)]
    f = MixedFrame(spark.createDataFrame(rows, "k long, x double, c string"), "k", ["x"], ["c"])
    got = cluster.k_prototypes_on_sample(f, 3, rows=90).toPandas()
    assert len(got) == 300 and got.assign(t=got["k"] % 3).groupby("t")["cluster"].nunique().eq(1).all() and got.cluster.nunique() == 3
    three = cluster.k_prototypes(f, 3)[0]
    assert cluster.derived(f, three, 2).select("cluster").distinct().count() == 2
    assert cluster.derived(f, three, 4).select("cluster").distinct().count() == 4
    assert cluster.derived(f, three, 3) is three
    for k in (1, 301):
        with pytest.raises(ValueError):
            cluster.k_prototypes(f, k)


def test_trials_rank_by_score_then_dispersion(spark):
    from mosaique.plans.anchored import rank_trials

    rows = [(1, 0.5, 2.0, 1.0), (2, 0.5 + 1e-11, 1.0, 1.0), (3, 0.7, 9.0, 0.0), (4, 0.5, 2.0, 5.0), (5, 0.4, 0.0, 9.0)]
    got = {r["trial"]: r["place"] for r in rank_trials(spark.createDataFrame(rows, "trial int, j double, dbi double, chi double")).collect()}
    assert got == {3: 1, 2: 2, 4: 3, 1: 4, 5: 5}


def test_hints_of_the_number_of_clusters(spark):
    from mosaique.plans.pipeline import Params, hint

    labels = spark.createDataFrame([(k % 9,) for k in range(50)], "label int")
    assert hint(Params(n_clusters=7), 3, labels) == (7, "parameters") and hint(Params(), 3, labels) == (3, "explicit")
    assert hint(Params(c_max=6), None, labels) == (6, "label") and hint(Params(c_max=6), None, None) == (4, "midpoint")


def test_weighted_landmark_silhouette(six):
    per = {r["label"]: (r["n"], r["lsil"]) for r in metrics.lsil(six, six.clean).collect()}
    plain = metrics.lsil_score(six, six.clean).first()[0]
    assert plain == pytest.approx(sum(n * s for n, s in per.values()) / 6, abs=1e-5)
    five = MixedFrame(six.df.where("k < 5"), "k", ["x", "y"], ["c"], "label")
    per = {r["label"]: (r["n"], r["lsil"]) for r in metrics.lsil(five, five.clean).collect()}
    assert metrics.lsil_score(five, five.clean, weighted=True).first()[0] == pytest.approx(sum(n * n * s for n, s in per.values()) / 13, abs=1e-5)


def test_landmarks_beyond_a_task_are_dealt_in_parts(spark, monkeypatch):
    from mosaique.operators import landmarks, reward

    rows = [(i, float(i * 37 % 101), float(i % 7), "abc"[i * 5 % 3], "pq"[i % 2]) for i in range(120)]
    f = MixedFrame(spark.createDataFrame(rows, "k long, x double, y double, c string, label string"), "k", ["x", "y"], ["c"], "label")
    marks = f.clean.where("k % 3 = 0")
    vectors = f.clean.select("k", F.array("x", "y").alias("v")).where("x > 0")

    def every():
        out = [sorted(map(tuple, metrics.landmark_scores(f, marks, mode).collect())) for mode in ("topk", "mean", "min")]
        out.append(sorted(map(tuple, metrics.neighbours(f, marks, 4).collect())))
        out.append(sorted(map(tuple, metrics.cost_to_set(f, marks).collect())))
        out.append(sorted(map(tuple, metrics.vector_neighbours(vectors, "k", "v", vectors.where("k % 5 = 0"), 3).collect())))
        out.append(sorted(map(tuple, cluster.propagate(f, marks, "label").collect())))
        out.append([(None, x) for x in reward.landmark_reward(f, marks)([("x",), ("c", "x")])])
        return out

    whole = every()
    monkeypatch.setattr(landmarks, "MOST_BROADCAST", 2000)
    assert len(list(landmarks.dealt(marks, "k"))) > 2
    for a, b in zip(whole, every(), strict=True):
        assert len(a) == len(b) > 0
        assert all(x[:-1] == y[:-1] and (x[-1] == y[-1] or x[-1] == pytest.approx(y[-1], abs=1e-9)) for x, y in zip(a, b, strict=True))


def test_internal_score_gamma_and_prototypes(six, spark):
    from mosaique.operators import landmarks

    want = metrics.silhouette(six).agg(F.avg("s")).first()[0]
    assert metrics.score_internal(six) == pytest.approx(want)
    assert 0 < metrics.score_internal(six, metric="lsil") <= 1
    assert cluster.estimate_gamma(six, 2.0) == pytest.approx(six.df.select(F.stddev_pop("x") + F.stddev_pop("y")).first()[0])
    got = [(r["label"], r["place"], r["key"]) for r in landmarks.prototypes(six, 3).orderBy("label", "place").collect()]
    assert [g[:2] for g in got] == [(v, k) for v in "pq" for k in (1, 2, 3)] and {g[2] for g in got} == set(range(6))


def test_pipeline_with_a_clustering_of_the_callers_own(spark):
    from mosaique.plans.pipeline import Params, find_subsets, run_pipeline

    rows = [(i, 10.0 * (i % 2) + (i * 37 % 100) / 100, float(i * 61 % 97), ["a", "b"][i % 2], i % 2) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, x double, noise double, c string, truth int")
    out = run_pipeline(df, label="truth", params=Params(c_max=3, sa_iters=1, mab_T=2, rerank_shadow=True, rerank_topk=1), cluster_fn=lambda f: f.df.select(f.key, (F.col(f.key) % 2).cast("int").alias("cluster")))
    assert out["final_algo"] == "given" and out["best_K"] == 2 and out["k_hint_source"] == "label" and out["reranked"]
    found = find_subsets(df, label="truth", params=Params(c_max=3, sa_iters=1, mab_T=2, recluster=True))
    assert set(found["subsets"][0]) <= {"x", "noise", "c"} and found["reward"] > 0
