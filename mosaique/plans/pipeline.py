"""From a table to profiled clusters: checks, imputation, column search, choice of the number of clusters, artifacts."""

from __future__ import annotations

import logging
import math
import time
from collections.abc import Callable
from dataclasses import asdict, dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..frame import MixedFrame, infer_id, split_types, spread
from ..operators import clean, cluster, metrics, profile, redundancy, reward, search
from ..sources import artifacts
from . import anchored


log = logging.getLogger("mosaique")


@dataclass(frozen=True)
class Params:
    mab_T: int = 12
    mab_k: int = 4
    mab_penalty_beta: float = 1.5
    mab_warmup_frac: float = 0.2
    mab_redundancy_threshold: float = 0.9
    sa_iters: int = 30
    sa_neighbor_mode: str = "full"
    subset_min_frac: float = 0.2
    subset_max_frac: float = 0.75
    reward_alpha_penalty: float = 0.3
    kmsnc_k: int = 5
    c_min: int = 2
    c_max: int = 6
    lsil_c: float = 3.0
    lsil_topk: int = 3
    weight: float = 0.6
    sc_lnc_threshold: float = 0.5
    rerank: bool = False
    rerank_shadow: bool = False
    rerank_topk: int = 3
    redundancy_cache: str | None = None
    n_clusters: int | None = None
    recluster: bool = False
    phase_b_subsets: int = 1
    phase_b_skip_lnc: bool = False
    full_rows: int | None = None
    sc_retries: int = 3
    disguised: str = "warn"
    categorical: tuple[str, ...] = ()
    numeric: tuple[str, ...] = ()
    algorithms: tuple[str, ...] = ("kprototypes",)
    engine: str = "A"
    anchors: tuple[str, ...] = ()
    anchor_threshold: float = 0.5
    random_state: int = 42


def auto_params(df: DataFrame, **overrides) -> Params:
    """Parameters from the table's signals; K ranges never become empty."""
    s = clean.data_profile(df).first()
    n, p, ent = s["n"], s["p"], s["entropy_ratio"]
    clamp = lambda x, lo, hi: max(lo, min(hi, x))
    c_max = max(2, min(int(math.log2(max(2, n))), int(math.sqrt(n / 2)), 6 if n < 2e5 else 8 if n < 5e5 else 10))
    return replace(
        Params(
            mab_T=clamp(int(12 * (1 + 0.3 * ent)), 8, 20), mab_k=clamp(p // 4, 3, 10), sa_iters=clamp(int(50 * (1 + 0.3 * ent)), 30, 100), c_max=c_max,
            lsil_c=3.0 if n <= 1e5 else round(max(3.0, 3 * math.log10(n) / 3), 1), lsil_topk=clamp(c_max - 2, 2, 3),
            weight=0.4 if s["cat_ratio"] > 0.6 else 0.7 if s["cat_ratio"] < 0.3 else 0.6, sc_lnc_threshold=0.5 if n < 5e4 else round(max(0.4, 0.5 - 0.1 * math.log10(n / 5e4)), 2),
        ),
        **overrides,
    )


def exact_score(f: MixedFrame) -> search.Score:
    """Exact silhouette of column subsets with labels fixed: distances to clusters per row and column are computed once, by
    the exact silhouette's sums; a batch of subsets is one pass with one aggregate row back."""
    per = metrics.silhouette_parts(f).persist()
    columns = f.num + f.cat

    def added(s: tuple[str, ...]):
        return lambda o: sum((o[columns.index(c)] for c in s), F.lit(0.0))

    def score(subsets: list[tuple[str, ...]]) -> list[float]:
        aggs = []
        for i, s in enumerate(subsets):
            a = sum((F.col(f"a_{columns.index(c)}") for c in s), F.lit(0.0))
            b = F.array_min(F.transform("others", added(s)))
            top = F.greatest(a, b)
            aggs.append(F.avg(F.when(top > 0, (b - a) / top).otherwise(0.0)).alias(f"s{i}"))
        row = per.agg(*aggs).first()
        return [row[i] or 0.0 for i in range(len(subsets))]

    return score


def subset_reward(f: MixedFrame, red: dict, alpha: float, engine: str = "A", c: float = 3.0, seed: int = 42, recluster: int | None = None) -> search.Score:
    """Scorer of column subsets by engine: the exact silhouette, fixed landmarks, or landmarks calibrated by it. Labels are
    fixed, unless ``recluster`` gives a number of clusters that are made anew on each subset's columns."""
    if recluster:
        return reward.with_penalty(reward.reclustered(f, recluster, seed=seed), red, alpha)
    kind = reward.resolve(engine, f.n)
    if kind == "exact":
        return reward.with_penalty(exact_score(f), red, alpha)
    cheap = reward.landmark_reward(f, metrics.landmarks_of(f, c, seed))
    return reward.with_penalty(cheap if kind == "fixed" else reward.Calibrated(cheap, exact_score(f)), red, alpha)


def reranked(f: MixedFrame, subsets: list[tuple[str, ...]], k: int, seed: int = 42) -> list[tuple[tuple[str, ...], float]]:
    """Subsets by the exact silhouette of a clustering made on their own columns, best first."""
    out = []
    for s in subsets:
        sub = f.select(list(s))
        t = anchored.labelled(sub, cluster.k_prototypes(sub, k, seed=seed, starts=1)[0])
        out.append((s, metrics.silhouette(t).agg(F.avg("s")).first()[0]))
    return sorted(out, key=lambda x: (-x[1], x[0]))


def hint(p: Params, explicit: int | None, labels: DataFrame | None) -> tuple[int, str]:
    """The number of clusters that the column search starts from, and where it is from: the parameters, the call, the number
    of labels (within the range that is searched), or the middle of the range."""
    if p.n_clusters is not None:
        return p.n_clusters, "parameters"
    if explicit is not None:
        return explicit, "explicit"
    if labels is not None:
        return max(p.c_min, min(labels.distinct().count(), p.c_max)), "label"
    return p.c_min + (p.c_max - p.c_min) // 2, "midpoint"


@dataclass
class Prepared:
    """What the column search needs, and what the checks did."""

    frame: MixedFrame
    params: Params
    report: DataFrame
    dropped: list[str]
    cast: list[str]
    hint: tuple[int, str]


def prepare(df: DataFrame, key: str | None = None, label: str | None = None, params: Params | None = None, k: int | None = None) -> Prepared:
    key = key or infer_id(df)
    if key is None:
        raise ValueError("a unique key column is needed")
    p = params or Params()
    features = df.drop(key, *([label] if label else []))
    report = clean.dqc_report(features, on_disguised=p.disguised, categorical=p.categorical, numeric_columns=p.numeric)
    kept, gone, cast = clean.apply_dqc(features, report, p.categorical)
    num, cat = split_types(kept)
    whole, _, _ = clean.apply_dqc(df.select(F.col(key).cast("long").alias(key), *kept.columns), report, p.categorical)
    ready = spread(clean.impute(whole.select(key, *num, *cat), num, cat), key, whole.count()).persist()
    p = params or auto_params(ready.drop(key))
    found = hint(p, k, df.select(label) if label else None)
    return Prepared(MixedFrame(ready, key, num, cat), p, report, gone, cast, found)


def phase_a(ready: Prepared) -> dict:
    """Search over column subsets only: the archive's best, each without redundant columns, their scores, and its trace."""
    f, p = ready.frame, ready.params
    red = redundancy.as_dict(redundancy.cached(f, p.kmsnc_k, p.redundancy_cache) if p.redundancy_cache else redundancy.matrix(f, p.kmsnc_k))
    columns = f.num + f.cat
    least, most = max(1, math.ceil(p.subset_min_frac * len(columns))), max(1, int(p.subset_max_frac * len(columns)))
    start, bandit = search.bandit(columns, lambda ss: [redundancy.penalty(list(s), red) for s in ss], p.mab_T, min(p.mab_k, most), red, p.mab_redundancy_threshold, p.mab_penalty_beta, p.mab_warmup_frac, p.random_state)
    labels = cluster.k_prototypes(f, ready.hint[0], seed=p.random_state, starts=1)[0].persist()
    labelled = MixedFrame(f.df.join(labels.withColumnRenamed("cluster", "_c"), f.key).persist(), f.key, f.num, f.cat, "_c")
    archive = search.Archive()
    score = subset_reward(labelled, red, p.reward_alpha_penalty, p.engine, p.lsil_c, p.random_state, ready.hint[0] if p.recluster else None)
    best, value, annealed = search.anneal(start, columns, score, p.sa_iters, mode=p.sa_neighbor_mode, least=least, most=most, rate=0.15, archive=archive, seed=p.random_state)
    labelled.df.unpersist()
    top = archive.top(max(p.rerank_topk, p.phase_b_subsets, 1 + p.sc_retries))
    subsets = [s for s, _ in top if s != best]
    subsets, again = [best, *subsets], []
    if p.rerank or p.rerank_shadow:
        # In the shadow the new order is only reported.
        again = reranked(f, subsets[: p.rerank_topk], ready.hint[0], p.random_state)
        subsets = [s for s, _ in again] + subsets[p.rerank_topk :] if p.rerank else subsets
    pruned = list(dict.fromkeys(tuple(redundancy.prune(list(s), red, p.mab_redundancy_threshold)) for s in subsets))
    return {"subsets": pruned, "scores": dict(top), "reward": value, "labels": labels, "reranked": again, "mab_stats": bandit, "sa_stats": annealed}


def find_subsets(df: DataFrame, key: str | None = None, label: str | None = None, params: Params | None = None, k: int | None = None) -> dict:
    """Phase A alone: the best column subsets of a table, after its checks."""
    return phase_a(prepare(df, key, label, params, k))


def run_pipeline(df: DataFrame, key: str | None = None, label: str | None = None, outdir: str | None = None, params: Params | None = None, k: int | None = None, cluster_fn: Callable[[MixedFrame], DataFrame] | None = None) -> dict:
    """Checks and imputes ``df``, searches columns, picks subset, algorithm and number of clusters by the composite score (or by
    anchors), holds the choice against structural control, where it fails tries the next best subsets, and profiles the clusters.

    ``cluster_fn`` (frame of the best columns -> key, cluster) takes the place of the search over algorithms and K.
    ``key`` is a unique long column; ``label`` is left out of the search and only hints at the number of clusters, as does
    ``k``. Returns columns, K, scores, assignments and profiles, and writes them to ``outdir``.
    """
    began = time.time()
    ready = prepare(df, key, label, params, k)
    f, p, key = ready.frame, ready.params, ready.frame.key
    found = phase_a(ready)
    log.info("columns %s dropped, %s cast; %d clusters by %s; best columns %s", ready.dropped, ready.cast, *ready.hint, found["subsets"][0])
    ks = range(p.c_min, max(p.c_min, p.c_max) + 1)
    how = {"anchor_least": p.anchor_threshold, "overall_least": p.sc_lnc_threshold, "c": p.lsil_c, "weight": p.weight, "topk": p.lsil_topk, "seed": p.random_state, "known": found["labels"], "full_rows": p.full_rows, "skip_lnc": p.phase_b_skip_lnc}
    if cluster_fn:
        first = found["subsets"][0]
        given = anchored.Trial("given", 0, cluster_fn(f.select(list(first))).persist())
        given.k, given.score = given.labels.select("cluster").distinct().count(), anchored.composite_score(anchored.labelled(f.select(list(first)), given.labels), p.lsil_c, p.weight, p.lsil_topk, p.random_state, p.phase_b_skip_lnc)
        tried = [(first, given, [given])]
    else:
        tried = anchored.over_subsets(f, found["subsets"][: p.phase_b_subsets], list(p.anchors), p.algorithms, ks, **how)
    chosen, top, action, lnc = anchored.with_control(f, [(s, t) for s, t, _ in tried], p.sc_lnc_threshold, p.sc_retries, p.random_state)
    rest = [] if cluster_fn else [s for s in found["subsets"][p.phase_b_subsets :] if s not in [x[0] for x in tried]][: p.sc_retries]
    if action == "rejected_all" and rest:
        tried += anchored.over_subsets(f, rest, list(p.anchors), p.algorithms, ks, **how)
        again = anchored.with_control(f, [(s, t) for s, t, _ in tried[-len(rest) :]], p.sc_lnc_threshold, p.sc_retries, p.random_state)
        if again[2] != "rejected_all":
            chosen, top, action, lnc = again[0], again[1], "retried", again[3]
    log.info("%s with %d clusters, J %.4f, control %s (%.3f)", top.algorithm, top.k, top.score, action, lnc)
    sub = f.select(list(chosen))
    t = replace_frame(sub, f.df.join(top.labels, key).persist())
    classes = t.clean.select("label").distinct().count()
    final = metrics.silhouette(t).agg(F.avg("s")).first()[0]
    profiles = {"sizes": profile.sizes(t.df, "cluster"), "numeric": profile.numeric(t.df, "cluster", t.num) if t.num else None, "categorical": profile.table(t.df, "cluster", t.cat) if t.cat else None, "table": profile.wide(t.df, "cluster", t.num[:10], t.cat[:6])}
    trials = [{"columns": list(s), "algorithm": x.algorithm, "k": x.k, "J": x.score, "dbi": x.dbi, "chi": x.chi, "lnc_anchor": x.anchored, "lnc": x.overall} for s, _, every in tried for x in every]
    info = {"best_columns": list(chosen), "best_K": classes, "best_reward": found["reward"], "final_algo": top.algorithm, "dav_applied": top.by_anchor, "anchor_cols": list(p.anchors), "final_ss_gower": final, "k_hint": ready.hint[0], "k_hint_source": ready.hint[1], "structural_control": {"lnc_score": lnc, "threshold": p.sc_lnc_threshold, "passed": action != "rejected_all", "action": action}, "trials": trials, "mab_stats": found["mab_stats"], "sa_stats": found["sa_stats"], "reranked": [[list(s), x] for s, x in found["reranked"]], "dropped": ready.dropped, "cast": ready.cast, "timing_s": time.time() - began}
    if outdir:
        write_artifacts(outdir, t, info, ready, profiles)
    return info | {"assignments": t.df.select(key, "cluster"), "profiles": profiles}


def write_artifacts(outdir: str, t: MixedFrame, info: dict, ready: Prepared, profiles: dict) -> None:
    """Tables as folders by the executors, documents as single files, all through Spark's file systems."""
    spark = t.df.sparkSession
    artifacts.save_table(t.df.select(t.key, "cluster"), f"{outdir}/cluster_assignments")
    artifacts.save_table(ready.report, f"{outdir}/dqc_report")
    artifacts.save_table(spark.createDataFrame([(c,) for c in info["best_columns"]], "feature string"), f"{outdir}/features")
    artifacts.save_table(profiles["table"], f"{outdir}/profiles_table")
    artifacts.save_json(f"{outdir}/config.json", asdict(ready.params), spark)
    artifacts.save_json(f"{outdir}/features.json", info["best_columns"], spark)
    artifacts.save_json(f"{outdir}/metrics_internal.json", info, spark)
    told = {k: [r.asDict() for r in v.collect()] for k, v in profiles.items() if v is not None}
    artifacts.save_json(f"{outdir}/profiles.json", told, spark)
    lines = [f"## Cluster {r['cluster']}: {100 * r['fraction']:.1f} % (n = {r['n']})\n" + "".join(f"- {x['feature']}: {x['mean']:.3g} ({x['diff_vs_global']:+.3g})\n" for x in told.get("numeric", []) if x["cluster"] == r["cluster"]) + "".join(f"- {x['feature']}: {x['top_lifts']}\n" for x in told.get("categorical", []) if x["cluster"] == r["cluster"]) for r in sorted(told["sizes"], key=lambda r: r["cluster"])]
    artifacts.save_bytes(f"{outdir}/profiles.md", "\n".join(lines).encode(), spark)
    row = {"dataset": outdir.rstrip("/").rsplit("/", 1)[-1], **{k: info[k] for k in ("best_K", "final_algo", "best_reward", "final_ss_gower")}, "lnc_anchor": max((x["lnc_anchor"] for x in info["trials"] if not math.isnan(x["lnc_anchor"])), default=""), "lnc_global": info["structural_control"]["lnc_score"], "dav_applied": info["dav_applied"], "anchor_cols": ",".join(info["anchor_cols"]), "runtime_s": info["timing_s"]}
    artifacts.save_workbook(f"{outdir}/summary.xlsx", [row], spark)


def replace_frame(f: MixedFrame, df: DataFrame) -> MixedFrame:
    return MixedFrame(df, f.key, f.num, f.cat, "cluster")
