"""Registered queries of unit space, landmarks, semiparametric clustering, searches and evaluation."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..frame import MixedFrame
from ..operators import calibrate, cluster, features, kamila, landmarks, metrics, refine, reward, unit
from . import anchored, evaluation
from .catalogue import _GOWER, _LANDMARKS, _NATION, _RANGES, _nation, orders, part, query, read


@query("select c_mktsegment as level, count(*) as n from customer group by 1")
def one_hot_counts(spark, d):
    df = read(spark, d, "customer").select("c_mktsegment")
    levels = sorted(r[0] for r in df.distinct().collect())
    wide = features.one_hot(df, "c_mktsegment", levels).agg(*[F.sum(f"c_mktsegment={v}").alias(v) for v in levels])
    return wide.unpivot([], levels, "level", "n").select("level", F.col("n").cast("long").alias("n"))


@query("""with s as (select avg(c_acctbal) as m, stddev_pop(c_acctbal) as sd from customer), z as (select c_custkey, c_mktsegment, (c_acctbal - m) / sd as z from customer, s)
select c_custkey, round(z / (sqrt(z * z + 1.0) + 1e-12), 6) as u_num, round(1.0 / (sqrt(z * z + 1.0) + 1e-12), 6) as u_cat from z""")
def unit_features(spark, d):
    f = MixedFrame(read(spark, d, "customer"), "c_custkey", ["c_acctbal"], ["c_mktsegment"])
    return unit.scaled(f).select("c_custkey", F.round(F.col("c_acctbal") / F.col("_norm"), 6).alias("u_num"), F.round(1 / F.col("_norm"), 6).alias("u_cat"))


@query("""with s as (select p_partkey, p_brand || '-' || p_type as s, p_size from part), some_rows as (select * from s order by md5('42|' || p_partkey::varchar), p_partkey limit 6000), known as (select s, min(p_size) as v from some_rows group by s)
select p_partkey, coalesce(v, -1)::int as label from s left join known using (s)""")
def signature_join(spark, d):
    df = read(spark, d, "part").select("p_partkey", features.signature(["p_brand", "p_type"]).alias("s"), "p_size")
    known = landmarks.sample(df, "p_partkey", 6000).groupBy("s").agg(F.min("p_size").alias("v"))
    return df.join(known, "s", "left").select("p_partkey", F.coalesce("v", F.lit(-1)).alias("label"))


@query(f"""with {_LANDMARKS}, {_RANGES}, p as (select a.p_partkey, round({_GOWER}, 12) as d, row_number() over (partition by a.p_partkey order by {_GOWER}) as r from part a join lm b on a.p_partkey <> b.p_partkey, ranges)
select p_partkey, round(avg(d), 6) as mean_d, round(min(d), 6) as min_d, round(avg(d) filter (r <= 3), 6) as topk_d from p group by 1""")
def gower_topk_to_set(spark, d):
    f = part(spark, d)
    return metrics.cost_to_set(f, metrics.landmarks_of(f))


@query("""with k as (select o_orderkey, o_totalprice, o_orderstatus from orders order by md5('42|' || o_orderkey::varchar), o_orderkey limit 6000)
select a.o_orderkey, arg_min(k.o_orderstatus, ((a.o_totalprice - k.o_totalprice) * (a.o_totalprice - k.o_totalprice), k.o_orderkey)) as o_orderstatus from orders a cross join k group by 1""")
def nearest_label_propagation(spark, d):
    f = orders(spark, d)
    return cluster.propagate(f, landmarks.sample(f.df, "o_orderkey", 6000), "o_orderstatus")


# --- landmarks ----------------------------------------------------------------------------------------------------------


@query(f"""with {_LANDMARKS}, rest as (select p_partkey, p_type, abs(p_size - 25) as score from part where p_partkey not in (select p_partkey from lm)),
top as (select p_partkey, p_type from rest qualify row_number() over (partition by p_type order by score desc, p_partkey) <= 10),
other as (select p_partkey, p_type from rest where p_partkey not in (select p_partkey from top) qualify row_number() over (partition by p_type order by ('0x' || md5('42|' || p_partkey::varchar)[1:12])::ubigint, p_partkey) <= 10)
select * from top union all select * from other""")
def candidate_pool(spark, d):
    f = part(spark, d)
    return unit.candidate_pool(f, metrics.landmarks_of(f), F.abs(F.col("p_size") - 25), 20).select("p_partkey", F.col("label").alias("p_type"))


@query(f"""with {_LANDMARKS}, {_RANGES}, near as (select a.p_partkey, a.p_type, min({_GOWER}) as d from part a join lm b on a.p_type = b.p_type, ranges group by 1, 2)
select p_type as label, count(*) as n, round(sum(d) / count(*), 6) as cost from near group by 1""")
def landmark_coverage(spark, d):
    f = part(spark, d)
    return refine.coverage(f, metrics.landmarks_of(f))


@query()
def mini_pam(spark, d):
    f = part(spark, d)
    marks = landmarks.stratified(f.clean, f.key, "label", 30, 3)
    better = refine.swap(f, marks, unit.candidate_pool(f, marks, F.abs(F.col("p_size") - 25), 20))
    return refine.coverage(f, better)


@query()
def landmarks_k_center(spark, d):
    return unit.k_center(part(spark, d), 40).select("p_partkey")


@query()
def landmarks_cluster_aware(spark, d):
    return unit.cluster_aware(part(spark, d), 100).select("p_partkey", "label")


# --- quality ------------------------------------------------------------------------------------------------------------


@query("""with u as (select vec_id, label, embedding::double[] as e from embeddings), sized as (select label, count(*) as m from u group by 1),
s as (select a.vec_id, a.label as own, b.label as lab, sum(1 - list_cosine_similarity(a.e, b.e)) filter (a.vec_id <> b.vec_id) as d from u a cross join u b group by 1, 2, 3),
ab as (select vec_id, own, max(d / (m - 1)) filter (own = lab and m > 1) as a, min(d / m) filter (own <> lab) as b from s join sized on lab = sized.label group by 1, 2)
select own as label, count(*) as n, round(avg(case when a is null or b is null or greatest(a, b) <= 0 then 0 else (b - a) / greatest(a, b) end), 6) as silhouette from ab group by own""")
def cosine_silhouette(spark, d):
    s = metrics.cosine_silhouette(read(spark, d, "embeddings"), "vec_id", "label", "embedding")
    return s.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("s"), 6).alias("silhouette"))


@query(f"""with picked as (select * from part order by md5('42|' || p_partkey::varchar), p_partkey limit 500), {_RANGES.replace("from part", "from picked")}, sized as (select p_type, count(*) as size from picked group by p_type), sums as (
  select a.p_partkey as k, a.p_type as own, b.p_type as lab, sum({_GOWER}) as d from picked a cross join picked b, ranges group by 1, 2, 3
), ab as (select k, own, max(d / (size - 1)) filter (own = lab and size > 1) as a, min(d / size) filter (own <> lab) as b from sums join sized on lab = sized.p_type group by 1, 2)
select round(avg(case when a is null or b is null or greatest(a, b) <= 0 then 0 else (b - a) / greatest(a, b) end), 6) as silhouette, count(*) as n from ab""")
def silhouette_subsample(spark, d):
    f = part(spark, d)
    some = MixedFrame(landmarks.sample(f.df, f.key, 500).persist(), f.key, f.num, f.cat, f.label)
    return metrics.silhouette(some).agg(F.round(F.avg("s"), 6).alias("silhouette"), F.count(F.lit(1)).alias("n"))


_ANCHORED = """with sized as (select o_orderstatus, count(*) as size from orders group by 1), lm as (
  select * from (select orders.*, quota, row_number() over (partition by o_orderstatus order by md5('42|' || o_orderkey::varchar), o_orderkey) as r from orders
  join (select o_orderstatus, greatest(3, round(60 * size / sum(size) over ()))::bigint as quota from sized) using (o_orderstatus)) where r <= quota
), rng as (select 1.0 / greatest(max(o_totalprice) - min(o_totalprice), 1e-9) as i from orders), near as (
  select a.o_orderkey as landmark, a.o_orderstatus as own, b.o_orderstatus as lab, round(abs(a.o_totalprice - b.o_totalprice) * i, 9) as d
  from lm a join orders b on a.o_orderkey <> b.o_orderkey, rng qualify row_number() over (partition by a.o_orderkey order by round(abs(a.o_totalprice - b.o_totalprice) * i, 9), b.o_orderkey) <= 50
), counts as (select landmark, lab, count(*) as c from near group by 1, 2), shares as (select *, c / sum(c) over (partition by landmark) as p, sum(c) over (partition by landmark) as t from counts),
h as (select landmark, -sum(p * ln(p + 1e-12)) as h, count(*) as m, any_value(t) as t from shares group by landmark),
gaps as (select landmark, coalesce(avg(d) filter (own = lab), avg(d)) as intra, avg(d) filter (own <> lab) as inter, quantile_cont(d, 0.05) as lo, quantile_cont(d, 0.95) as hi from near group by landmark)
select landmark, round(0.7 * greatest(0.0, least(1.0, 1 - (h + (m - 1) / (2 * t)) / ln((select count(*) from sized)))) + 0.3 * greatest(0.0, least(1.0, (coalesce(inter, intra) - intra) / greatest(1e-9, hi - lo))), 6) as lnc
from h join gaps using (landmark)"""


@query(_ANCHORED)
def lnc_star_anchored(spark, d):
    f = orders(spark, d).select(["o_totalprice"])
    return metrics.lnc_star(f, landmarks.stratified(f.clean, f.key, "label", 60, 3), 50, f.clean.select("label").distinct().count())


@query(f"""{_NATION}, f as (select a.k, any_value(a.l) as l, any_value(a.s) as s, regr_slope(b.s, b.l) as m, regr_intercept(b.s, b.l) as c from x a join x b on a.k <> b.k group by a.k),
p as (select s, round(greatest(-1.0, least(1.0, m * l + c)), 5) as pred from f)
select count(*) as n, round(avg(abs(pred - s)), 5) as mae, round(sqrt(avg((pred - s) * (pred - s))), 5) as rmse, round(corr(pred, s), 5) as r from p""")
def lodo_summary(spark, d):
    x = _nation(spark, d).persist()
    return calibrate.summary(calibrate.leave_one_out(x, "k", "l", "s").join(x, "k"), "s")


# --- semiparametric clustering ------------------------------------------------------------------------------------------

LOGS = {"o_orderpriority": {"1-URGENT": [-0.5, -3.0], "2-HIGH": [-1.0, -2.0], "3-MEDIUM": [-2.5, -1.5], "5-LOW": [-3.0, -0.75]}}
_LL = [" ".join(["case", *[f"when o_orderpriority = '{v}' then {p[k]}" for v, p in LOGS["o_orderpriority"].items()], f"else ln({kamila.FLOOR!r}) end"]) for k in (0, 1)]


@query(f"select o_orderkey, round({_LL[0]}, 6) as ll_0, round({_LL[1]}, 6) as ll_1 from orders")
def kamila_cat_loglik(spark, d):
    m = kamila.Model([], ["o_orderpriority"], [[], []], LOGS, [], 0.0)
    return read(spark, d, "orders").select("o_orderkey", F.round(m.category(0), 6).alias("ll_0"), F.round(m.category(1), 6).alias("ll_1"))


@query("""with c as (select o_orderstatus, o_orderpriority, count(*) as c from orders group by 1, 2), g as (select s.o_orderstatus, p.o_orderpriority, coalesce(c, 0)::double as c, k, m
  from (select distinct o_orderstatus from c) s cross join (select distinct o_orderpriority from c) p left join c using (o_orderstatus, o_orderpriority), (select count(distinct o_orderstatus) as k, count(distinct o_orderpriority) as m from c)),
a as (select *, 0.975 * c + 0.025 / greatest(k - 1, 1) * (sum(c) over (partition by o_orderpriority) - c) as x from g),
b as (select *, 0.975 * x + 0.025 / greatest(m - 1, 1) * (sum(x) over (partition by o_orderstatus) - x) as y from a)
select o_orderstatus, o_orderpriority, round(y / sum(y) over (partition by o_orderstatus), 6) as share from b""")
def smooth_table(spark, d):
    counts = read(spark, d, "orders").groupBy("o_orderstatus", "o_orderpriority").agg(F.count(F.lit(1)).alias("c"))
    return cluster.smooth_counts(counts, "o_orderstatus", "o_orderpriority")


@query(f"with g as (select i, 100.0 * i / 100 as x from range(101) t(i)), v as (select value, count(*) as c from events group by 1) select i, round(x, 6) as x, round(sum(c * exp(-0.5 * pow((x - value) / 5.0, 2))) / (sum(c) * 5.0 * {math.sqrt(2 * math.pi)!r}), 6) as density from g cross join v group by i, x")
def kde_grid(spark, d):
    return kamila.density(read(spark, d, "events"), "value", 0.0, 100.0, 5.0, 101).select("i", F.round("x", 6).alias("x"), F.round("density", 6).alias("density"))


@query()
def kamila_clusters(spark, d):
    return kamila.kamila(part(spark, d), 3)[0].groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))


# --- searches and evaluation ----------------------------------------------------------------------------------------------

_CHOICES = "select n_nationkey as trial, n_nationkey % 3 = 0 as dav, round((n_nationkey * 7 % 5) / 5.0, 6)::double as j, round((n_nationkey * 5 % 7) / 7.0, 6)::double as lnc from nation"


@query(f"select trial, row_number() over (order by dav desc, case when dav then lnc else j end desc, trial)::int as place from ({_CHOICES})")
def anchored_precedence(spark, d):
    k = F.col("n_nationkey")
    return anchored.precedence(read(spark, d, "nation").select(k.alias("trial"), (k % 3 == 0).alias("dav"), F.round((k * 7 % 5) / 5.0, 6).alias("j"), F.round((k * 5 % 7) / 7.0, 6).alias("lnc")))


@query()
def anchored_search(spark, d):
    best, tried = anchored.anchored_search(part(spark, d), ["p_size"])
    return spark.createDataFrame([(t.algorithm, t.k, float(t.anchored), float(t.overall), t is best) for t in tried], "algorithm string, k int, lnc_anchor double, lnc double, chosen boolean")


@query()
def landmark_rewards(spark, d):
    f = part(spark, d)
    subsets = [("p_size",), ("p_retailprice",), ("p_brand",), ("p_brand", "p_size"), ("p_brand", "p_retailprice", "p_size")]
    got = reward.landmark_reward(f, metrics.landmarks_of(f))(subsets)
    return spark.createDataFrame([("+".join(s), float(x)) for s, x in zip(subsets, got, strict=True)], "subset string, lsil double")


@query()
def evaluation_row(spark, d):
    return evaluation.evaluate(part(spark, d), "part").drop("runtime_s")
