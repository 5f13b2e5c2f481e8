"""Registered queries, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..frame import MixedFrame
from ..operators import calibrate, clean, cluster, features, landmarks, metrics, profile, redundancy

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def part(spark: SparkSession, d: str) -> MixedFrame:
    return MixedFrame(read(spark, d, "part"), "p_partkey", ["p_retailprice", "p_size"], ["p_brand"], "p_type")


def orders(spark: SparkSession, d: str) -> MixedFrame:
    return MixedFrame(read(spark, d, "orders"), "o_orderkey", ["o_totalprice"], ["o_orderpriority"], "o_orderstatus")


# --- cleaning -------------------------------------------------------------------------------------------------------

PART_COLUMNS = ["p_partkey", "p_size", "p_retailprice", "p_name", "p_brand", "p_type"]
_COUNTS = "with counts as (" + " union all ".join(f"select '{c}' as col, cast({c} as varchar) as v, count(*) as n from part group by {c}" for c in PART_COLUMNS) + ")"


#: Part with holes and dull columns planted, so that every issue occurs.
_HOLES = """select p_partkey, p_size, p_name, p_brand, case when p_partkey % 5 = 0 then p_type end as rare_type, 'one' as constant, case when p_partkey % 1000 = 7 then 1 else 0 end as nearly,
  cast(null as int) as nothing, cast(p_size % 7 as int) as code, case when p_partkey % 9 = 0 then cast(p_size as int) end as rare_size from part"""
_HOLE_COLUMNS = ["p_partkey", "p_size", "p_name", "p_brand", "rare_type", "constant", "nearly", "nothing", "code", "rare_size"]
_HOLE_COUNTS = f"with holes as ({_HOLES}), counts as (" + " union all ".join(f"select '{c}' as col, cast({c} as varchar) as v, count(*) as n from holes group by {c}" for c in _HOLE_COLUMNS) + ")"


@query(f"""{_HOLE_COUNTS}, per as (
  select col, sum(n) as row_n, coalesce(sum(n) filter (v is not null), 0) as known, count(v) as n_unique, max(n) filter (v is not null) as top, arg_min(v, (-n, v)) filter (v is not null) as top_value from counts group by col
), spread as (
  select unnest(['p_partkey', 'p_size', 'nearly', 'nothing', 'code', 'rare_size']) as col, unnest([stddev_samp(p_partkey::double), stddev_samp(p_size::double), stddev_samp(nearly::double), stddev_samp(nothing::double), stddev_samp(code::double), stddev_samp(rare_size::double)]) as std from holes
), rated as (
  select per.col, n_unique, top_value, coalesce(top / known, 0.0) as tf, 1 - known / row_n as mf, std, spread.col is not null as is_num from per left join spread on per.col = spread.col
), first_issue as (
  select *, case when n_unique <= 1 or std < 1e-6 then 'zero_variance' when tf >= 0.998 then 'near_zero_variance' end as dull from rated
), told as (
  select *, case when dull is not null and mf >= 0.5 then dull || '+high_missing' when dull is not null then dull when mf >= 0.5 then 'high_missing'
    when is_num and n_unique between 3 and 20 then 'disguised_categorical' else 'ok' end as issue from first_issue
)
select col as "column", case when is_num then 'numeric' else 'categorical' end as kind, n_unique::bigint as n_unique, top_value[:40] as top_value, round(tf, 4) as top_frac, round(mf, 4) as missing_frac, round(std, 6) as std, issue,
  case when issue like '%zero_variance%' then 'drop' when issue in ('disguised_categorical', 'high_missing') then 'warn' else 'keep' end as action
from told""")
def dqc_report(spark, d):
    k = F.col("p_partkey")
    holes = read(spark, d, "part").select(
        "p_partkey", "p_size", "p_name", "p_brand", F.when(k % 5 == 0, F.col("p_type")).alias("rare_type"), F.lit("one").alias("constant"), F.when(k % 1000 == 7, 1).otherwise(0).alias("nearly"),
        F.lit(None).cast("int").alias("nothing"), (F.col("p_size") % 7).cast("int").alias("code"), F.when(k % 9 == 0, F.col("p_size").cast("int")).alias("rare_size"),
    )
    return clean.dqc_report(holes)


@query(f"""{_COUNTS}, per as (
  select col, count(v) as u, sum(n) as row_n, coalesce(sum(n) filter (v is null), 0) as gone, max(n) filter (v is not null) as top from counts group by col
), one as (
  select max(row_n) as n, count(*) as p, avg(case when col in ('p_name', 'p_brand', 'p_type') then 1 else 0 end) as cat_ratio, avg(case when u = 2 then 1 else 0 end) as binary_ratio,
    avg(case when top / row_n > 0.5 then 1 else 0 end) as spike_ratio, sum(gone) / sum(row_n) as missing_ratio from per
)
select n::bigint as n, p::bigint as p, round(cat_ratio, 6) as cat_ratio, round(binary_ratio, 6) as binary_ratio, round(spike_ratio, 6) as spike_ratio, round(missing_ratio, 6) as missing_ratio, round(1 - spike_ratio, 6) as entropy_ratio, round(n / 10000, 6) as n_ratio from one""")
def data_profile(spark, d):
    return clean.data_profile(read(spark, d, "part").select(*PART_COLUMNS))


@query("""with holes as (
  select p_partkey, case when p_partkey % 17 = 0 then null else p_retailprice end as p_retailprice, case when p_partkey % 13 = 0 then null else p_brand end as p_brand from part
), m as (select median(p_retailprice) as med from holes), b as (select p_brand as mode from holes where p_brand is not null group by p_brand order by count(*) desc, p_brand limit 1)
select p_partkey, coalesce(p_retailprice, med) as p_retailprice, coalesce(p_brand, mode) as p_brand from holes, m, b""")
def impute_median_mode(spark, d):
    df = read(spark, d, "part").select("p_partkey", F.when(F.col("p_partkey") % 17 != 0, F.col("p_retailprice")).alias("p_retailprice"), F.when(F.col("p_partkey") % 13 != 0, F.col("p_brand")).alias("p_brand"))
    return clean.impute(df, ["p_retailprice"], ["p_brand"])


@query("with s as (select count(*) as n from events group by event_type) select min(n) as least, greatest(3, floor(0.02 * sum(n)))::bigint as need, min(n) >= greatest(3, floor(0.02 * sum(n))) as balanced from s")
def cluster_balance(spark, d):
    return clean.balance(read(spark, d, "events").select(F.col("event_type").alias("label")))


# --- features -------------------------------------------------------------------------------------------------------

LINE_KEY = "l_orderkey, l_linenumber, l_partkey, l_suppkey"
LINE_KEYS = LINE_KEY.split(", ")


@query(f"select {LINE_KEY}, round((l_quantity - avg(l_quantity) over ()) / stddev_pop(l_quantity) over (), 6) as l_quantity, round((l_tax - avg(l_tax) over ()) / stddev_pop(l_tax) over (), 6) as l_tax from lineitem")
def standard_scale(spark, d):
    cols = ["l_quantity", "l_tax"]
    return features.standard(read(spark, d, "lineitem").select(*LINE_KEYS, *cols), cols).withColumns({c: F.round(c, 6) for c in cols})


@query(f"with q as (select quantile_cont(l_extendedprice, [0.25, 0.5, 0.75]) as q from lineitem) select {LINE_KEY}, round((l_extendedprice - q[2]) / (q[3] - q[1]), 6) as l_extendedprice from lineitem, q")
def robust_scale(spark, d):
    return features.robust(read(spark, d, "lineitem").select(*LINE_KEYS, "l_extendedprice"), ["l_extendedprice"]).withColumn("l_extendedprice", F.round("l_extendedprice", 6))


@query("select p_partkey, round(p_size / (sqrt(p_size * p_size + p_retailprice * p_retailprice) + 1e-12), 6) as u_size, round(p_retailprice / (sqrt(p_size * p_size + p_retailprice * p_retailprice) + 1e-12), 6) as u_price from part")
def l2_normalize(spark, d):
    u = features.unit_rows([F.col("p_size").cast("double"), F.col("p_retailprice")])
    return read(spark, d, "part").select("p_partkey", F.round(u[0], 6).alias("u_size"), F.round(u[1], 6).alias("u_price"))


@query("select least(9, greatest(0, ceil((p_retailprice - lo) / (hi - lo) * 10.0) - 1))::int as bin, count(*) as n from part, (select min(p_retailprice) as lo, max(p_retailprice) as hi from part) group by 1")
def equal_width_bins(spark, d):
    f = part(spark, d)
    lo, hi, _ = f.stats["p_retailprice"]
    return f.df.groupBy(features.equal_width(F.col("p_retailprice"), lo, hi).alias("bin")).agg(F.count(F.lit(1)).alias("n"))


@query("with e as (select list_sort(list_distinct(quantile_cont(p_size, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]))) as e from part) select len(list_filter(e[2:-2], lambda x: p_size > x))::int as bin, count(*) as n from part, e group by 1")
def quantile_bins(spark, d):
    return features.quantile_bins(read(spark, d, "part"), "p_size").groupBy(F.col("p_size_bin").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


# --- distances ------------------------------------------------------------------------------------------------------

_RANGES = "ranges as (select 1.0 / greatest(max(p_retailprice) - min(p_retailprice), 1e-9) as ip, 1.0 / greatest((max(p_size) - min(p_size))::double, 1e-9) as isz from part)"
_GOWER = "(abs(a.p_retailprice - b.p_retailprice) * ip + abs(a.p_size - b.p_size) * isz + case when a.p_brand = b.p_brand then 0.0 else 1.0 end) / 3.0"
_LM = """sized as (select p_type, count(*) as size from part group by p_type), quotas as (
  select p_type, greatest(3, round({m} * size / sum(size) over ()))::bigint as quota from sized
), lm as (
  select * from (select part.*, quota, row_number() over (partition by p_type order by md5('42|' || p_partkey::varchar), p_partkey) as r from part join quotas using (p_type)) where r <= quota
)"""
_COUNT = "(select greatest(greatest(2, count(distinct p_type)) * 3, least(floor(3.0 * sqrt(count(*))), floor(0.2 * count(*)), count(*))) from part)"
_LANDMARKS = _LM.replace("{m}", _COUNT)


# --- landmarks and samples --------------------------------------------------------------------------------------------


@query(f"with {_LANDMARKS} select p_partkey, p_type from lm")
def stratified_landmarks(spark, d):
    return metrics.landmarks_of(part(spark, d)).select("p_partkey", F.col("label").alias("p_type"))


@query("select o_orderkey from orders order by md5('42|' || o_orderkey::varchar), o_orderkey limit 500")
def uniform_subsample(spark, d):
    return landmarks.sample(read(spark, d, "orders").select("o_orderkey"), "o_orderkey", 500)


@query(f"with {_LM.replace('{m}', '64')}, {_RANGES}, sums as (select a.p_type, a.p_partkey, round(sum({_GOWER}), 9) as s from lm a join lm b on a.p_type = b.p_type, ranges group by 1, 2) select p_type as label, arg_min(p_partkey, (s, p_partkey)) as medoid, round(min(s), 6) as total from sums group by p_type".replace("greatest(3, round(64", "greatest(64, round(0"))
def medoid_prototypes(spark, d):
    return landmarks.medoids(part(spark, d))


_CAPPED = _LM.replace("greatest(3, round({m}", "greatest(64, round(0")


@query(f"""with {_CAPPED}, {_RANGES}, d as (select a.p_type, a.p_partkey as x, b.p_partkey as y, round({_GOWER}, 9) as d from lm a join lm b on a.p_type = b.p_type, ranges),
first as (select p_type, arg_min(x, (s, x)) as m from (select p_type, x, round(sum(d), 9) as s from d group by 1, 2) group by 1),
second as (select p_type, arg_min(y, (-d, y)) as m from d join first using (p_type) where x = m and y <> m group by 1)
select p_type as label, 1 as place, m as key from first union all select p_type, 2, m from second""")
def medoid_pairs(spark, d):
    return landmarks.prototypes(part(spark, d), 2)


@query(f"with {_LANDMARKS}, {_RANGES} select a.p_partkey as query, b.p_partkey as neighbour, round({_GOWER}, 9) as d, row_number() over (partition by a.p_partkey order by round({_GOWER}, 9), b.p_partkey)::int as rank from lm a join part b on a.p_partkey <> b.p_partkey, ranges qualify rank <= 5")
def gower_topk(spark, d):
    f = part(spark, d)
    return metrics.neighbours(f, metrics.landmarks_of(f), 5, ranked=True).select(F.col("landmark").alias("query"), F.col("key").alias("neighbour"), "d", F.col("r").alias("rank"))


@query(f"""with {_LANDMARKS}, {_RANGES}, pairs as (select a.p_type as label, a.p_partkey as k, {_GOWER} as d from part a join lm b on a.p_partkey <> b.p_partkey, ranges), per as (select label, k, avg(d) as mean_d, min(d) as min_d from pairs group by 1, 2)
select label, round(avg(mean_d), 5) as mean_d, round(min(min_d), 5) as min_d, count(*) as n from per group by label""")
def gower_mean_min_to_set(spark, d):
    f = part(spark, d)
    per = metrics.cost_to_set(f, metrics.landmarks_of(f)).join(f.clean.select(f.key, "label"), f.key)
    return per.groupBy("label").agg(F.round(F.avg("mean_d"), 5).alias("mean_d"), F.round(F.min("min_d"), 5).alias("min_d"), F.count(F.lit(1)).alias("n"))


@query("""with q as (select vec_id, embedding from embeddings where vec_id % 20 = 0),
p as (select a.vec_id as query, b.vec_id as neighbour, round(1 - list_cosine_similarity(a.embedding::double[], b.embedding::double[]), 6) as d from q a join embeddings b on a.vec_id <> b.vec_id)
select *, row_number() over (partition by query order by d, neighbour)::int as rank from p qualify rank <= 3""")
def cosine_topk(spark, d):
    e = read(spark, d, "embeddings").select("vec_id", "embedding")
    return metrics.vector_neighbours(e, "vec_id", "embedding", e.where("vec_id % 20 = 0"), 3)


# --- quality of a clustering --------------------------------------------------------------------------------------------

_LSIL = """with {lm}, {ranges}, pairs as (
  select a.p_partkey as k, a.p_type as own, b.p_type as lab, {g} as d from part a cross join lm b, ranges
), kept as (select *, row_number() over (partition by k, lab order by d) as r from pairs where not (own = lab and d <= 1e-12)),
agg as (select k, own, lab, {reduce} as g from kept {top} group by 1, 2, 3),
ab as (select k, own, min(g) filter (lab = own) as a, min(g) filter (lab <> own) as b from agg group by 1, 2)
select own as label, count(*) as n, round(avg(case when a is null or b is null or greatest(a, b) <= 1e-12 then 0 else (b - a) / greatest(a, b) end), 6) as lsil from ab group by own"""


@query(_LSIL.format(lm=_LANDMARKS, ranges=_RANGES, g=_GOWER, reduce="avg(d)", top="where r <= 3"))
def lsil_topk(spark, d):
    f = part(spark, d)
    return metrics.lsil(f, metrics.landmarks_of(f))


_SCORES = _LSIL.format(lm=_LANDMARKS, ranges=_RANGES, g=_GOWER, reduce="avg(d)", top="where r <= 3").rpartition("select own as label")[0]


@query(f"""{_SCORES}, s as (select own, case when a is null or b is null or greatest(a, b) <= 1e-12 then 0 else (b - a) / greatest(a, b) end as s, count(*) over (partition by own) as n from ab)
select round(sum(n * s) / sum(n), 6) as weighted, round(avg(s), 6) as plain from s""")
def lsil_weighted(spark, d):
    f = part(spark, d)
    marks = metrics.landmarks_of(f)
    one = metrics.lsil_score(f, marks, weighted=True).withColumnRenamed("lsil", "weighted")
    return one.crossJoin(metrics.lsil_score(f, marks).withColumnRenamed("lsil", "plain"))


@query(_LSIL.format(lm=_LANDMARKS, ranges=_RANGES, g=_GOWER, reduce="avg(d)", top=""))
def lsil_mean(spark, d):
    f = part(spark, d)
    return metrics.lsil(f, metrics.landmarks_of(f), mode="mean")


@query(_LSIL.format(lm=_LANDMARKS, ranges=_RANGES, g=_GOWER, reduce="min(d)", top=""))
def lsil_min(spark, d):
    f = part(spark, d)
    return metrics.lsil(f, metrics.landmarks_of(f), mode="min")


@query(f"""with {_LANDMARKS}, {_RANGES}, near as (
  select a.p_partkey as landmark, a.p_type as own, b.p_type as lab, round({_GOWER}, 9) as d, b.p_partkey as k, row_number() over (partition by a.p_partkey order by round({_GOWER}, 9), b.p_partkey) as place
  from lm a join part b on a.p_partkey <> b.p_partkey, ranges qualify place <= 30
), counts as (select landmark, lab, count(*) as c from near group by 1, 2),
shares as (select *, c / sum(c) over (partition by landmark) as p, sum(c) over (partition by landmark) as t from counts),
h as (select landmark, -sum(p * ln(p + 1e-12)) as h, count(*) as m, any_value(t) as t from shares group by landmark),
gaps as (select landmark, coalesce(avg(d) filter (own = lab), avg(d)) as intra, avg(d) filter (own <> lab) as inter, quantile_cont(d, 0.05) as lo, quantile_cont(d, 0.95) as hi from near group by landmark)
select landmark, round(0.7 * greatest(0.0, least(1.0, 1 - (h + (m - 1) / (2 * t)) / ln((select count(distinct p_type) from part)))) + 0.3 * greatest(0.0, least(1.0, (coalesce(inter, intra) - intra) / greatest(1e-9, hi - lo))), 6) as lnc
from h join gaps using (landmark)""")
def lnc_star(spark, d):
    f = part(spark, d)
    return metrics.lnc_star(f, metrics.landmarks_of(f), 30, f.clean.select("label").distinct().count())


@query(f"""with {_RANGES}, sized as (select p_type, count(*) as size from part group by p_type), sums as (
  select a.p_partkey as k, a.p_type as own, b.p_type as lab, sum({_GOWER}) as d from part a cross join part b, ranges group by 1, 2, 3
), ab as (select k, own, max(d / (size - 1)) filter (own = lab and size > 1) as a, min(d / size) filter (own <> lab) as b from sums join sized on lab = sized.p_type group by 1, 2)
select own as label, count(*) as n, round(avg(case when a is null or b is null or greatest(a, b) <= 0 then 0 else (b - a) / greatest(a, b) end), 6) as silhouette from ab group by own""")
def silhouette_gower(spark, d):
    return metrics.silhouette(part(spark, d)).groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("s"), 6).alias("silhouette"))


@query("""with c as (select p_type, avg(p_size) as ms, avg(p_retailprice) as mp from part group by p_type),
s as (select p_type, avg(sqrt((p_size - ms) * (p_size - ms) + (p_retailprice - mp) * (p_retailprice - mp))) as s from part join c using (p_type) group by p_type),
b as (select * from c join s using (p_type))
select round(avg(r), 6) as davies_bouldin from (select a.p_type, max((a.s + o.s) / sqrt((a.ms - o.ms) * (a.ms - o.ms) + (a.mp - o.mp) * (a.mp - o.mp))) as r from b a join b o on a.p_type <> o.p_type group by 1)""")
def davies_bouldin(spark, d):
    return metrics.davies_bouldin(read(spark, d, "part"), "p_type", ["p_size", "p_retailprice"])


@query("""with g as (select event_type, count(*) as n, avg(value) as m, var_pop(value) as v from events group by event_type), t as (select avg(value) as m from events)
select round((sum(n * (g.m - t.m) * (g.m - t.m)) / (count(*) - 1)) / (sum(n * v) / (sum(n) - count(*))), 4) as calinski_harabasz from g, t""")
def calinski_harabasz(spark, d):
    return metrics.calinski_harabasz(read(spark, d, "events"), "event_type", ["value"])


# --- calibration --------------------------------------------------------------------------------------------------------

_NATION = "with x as (select c_nationkey as k, avg(c_acctbal) / 10000 as l, median(c_acctbal) / 10000 as s from customer group by c_nationkey)"


def _nation(spark, d):
    return read(spark, d, "customer").groupBy(F.col("c_nationkey").alias("k")).agg((F.avg("c_acctbal") / 10000).alias("l"), (F.median("c_acctbal") / 10000).alias("s"))


@query(f"""{_NATION}, f as (select count(*) as n, regr_slope(s, l) as a, regr_intercept(s, l) as b from x), p as (select *, greatest(-1.0, least(1.0, a * l + b)) as p from x, f)
select count(*) as n, round(any_value(a), 6) as a, round(any_value(b), 6) as b, round(corr(l, s), 6) as r, round(1 - sum((p - s) * (p - s)) / (var_pop(s) * count(*)), 6) as r2, round(avg(abs(p - s)), 6) as mae, round(sqrt(avg((p - s) * (p - s))), 6) as rmse from p""")
def calibration_stats(spark, d):
    return calibrate.stats(_nation(spark, d), "l", "s")


@query(f"""{_NATION}, f as (select a.k, any_value(a.l) as l, any_value(a.s) as s, regr_slope(b.s, b.l) as m, regr_intercept(b.s, b.l) as c from x a join x b on a.k <> b.k group by a.k)
select k, round(greatest(-1.0, least(1.0, m * l + c)), 5) as pred, round(abs(greatest(-1.0, least(1.0, m * l + c)) - s), 5) as abs_err from f""")
def lodo_cv(spark, d):
    return calibrate.leave_one_out(_nation(spark, d), "k", "l", "s")


# --- redundancy ---------------------------------------------------------------------------------------------------------

_KMSNC = """with base as (
  select p_partkey as k, p_brand, p_type, p_size::varchar as p_size, least(9, greatest(0, ceil((p_retailprice - lo) / (hi - lo) * 10.0) - 1))::int::varchar as p_retailprice from part, (select min(p_retailprice) as lo, max(p_retailprice) as hi from part)
), long as (unpivot base on p_brand, p_type, p_size, p_retailprice into name f value v),
firsts as (select f, v, k from long qualify row_number() over (partition by f, v order by k) <= 5),
inter as (select a.f as f1, a.v as v1, b.f as f2, b.v as v2, count(*) as i from firsts a join firsts b on a.k = b.k and a.f < b.f group by 1, 2, 3, 4),
both_v as (select a.f as f1, a.v as v1, b.f as f2, b.v as v2, count(*) as c from long a join long b on a.k = b.k and a.f < b.f group by 1, 2, 3, 4),
o as (select f1, f2, sum(c * coalesce(i, 0)) / ((select count(*) from part) * 5.0) as o from both_v left join inter using (f1, v1, f2, v2) group by 1, 2),
h as (select f, -sum(p * ln(p)) as h from (select f, count(*) / (select count(*) from part) as p from long group by f, v) group by f),
m as (select f1, f2, round(o * (x.h + y.h) / 2, 6) as kmsnc from o join h x on x.f = f1 join h y on y.f = f2)"""


def _kmsnc(spark, d):
    return redundancy.matrix(MixedFrame(read(spark, d, "part"), "p_partkey", ["p_size", "p_retailprice"], ["p_brand", "p_type"]))


@query(f"{_KMSNC} select * from m")
def kmsnc_matrix(spark, d):
    return _kmsnc(spark, d)


@query(f"{_KMSNC} select feature, round(avg(kmsnc), 6) as mean_red from (select f1 as feature, kmsnc from m union all select f2, kmsnc from m) group by feature")
def least_redundant(spark, d):
    return redundancy.mean_redundancy(_kmsnc(spark, d))


# --- clusterers ---------------------------------------------------------------------------------------------------------

PROTOTYPES = [{"p_size": 10.0, "p_retailprice": 950.0, "p_brand": "Brand#11"}, {"p_size": 25.0, "p_retailprice": 1200.0, "p_brand": "Brand#23"}, {"p_size": 40.0, "p_retailprice": 1500.0, "p_brand": "Brand#45"}]
_COSTS = ", ".join(f"(p_size - {p['p_size']}) * (p_size - {p['p_size']}) + (p_retailprice - {p['p_retailprice']}) * (p_retailprice - {p['p_retailprice']}) + 100.0 * case when p_brand = '{p['p_brand']}' then 0 else 1 end" for p in PROTOTYPES)


@query(f"""with c as (select *, [{_COSTS}] as cs from part), a as (select *, list_position(cs, list_min(cs)) - 1 as cluster, list_min(cs) as cost from c),
modes as (select cluster, p_brand, row_number() over (partition by cluster order by count(*) desc, p_brand) as r from a group by 1, 2)
select cluster::int as cluster, count(*) as n, round(sum(cost), 3) as cost, round(avg(p_retailprice), 6) as p_retailprice, round(avg(p_size), 6) as p_size, any_value(modes.p_brand) as p_brand from a join modes using (cluster) where r = 1 group by cluster""")
def kprototypes_step(spark, d):
    f = part(spark, d)
    return cluster.update(f, cluster.assign(f, f.clean, PROTOTYPES, 100.0)).withColumns({"cost": F.round("cost", 3), "p_retailprice": F.round("p_retailprice", 6), "p_size": F.round("p_size", 6)})


@query()
def k_prototypes(spark, d):
    labels, _, _ = cluster.k_prototypes(part(spark, d), 4)
    return labels.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))


@query()
def hac_landmarks(spark, d):
    return cluster.hac(part(spark, d), 4).groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))


@query("with c as (select event_type as t, user_id % 3 as r, count(*) as c from events group by 1, 2), p as (select t, sum(c * (c - 1)) as kept, sum(c) as n from c group by t) select round(min(case when n > 1 then kept / (n * (n - 1)) else 1.0 end), 6) as strength from p")
def prediction_strength(spark, d):
    return cluster.prediction_strength(read(spark, d, "events").withColumn("r", F.col("user_id") % 3), "event_type", "r")


@query("with s as (select stddev_samp(value) as s, (quantile_cont(value, 0.75) - quantile_cont(value, 0.25)) / 1.34 as i, count(value) as n from events) select round(0.9 * case when i > 0 and i < s then i when s > 0 then s else 1.0 end * pow(n, -0.2), 6) as bandwidth from s")
def nrd0_bandwidth(spark, d):
    return cluster.nrd0(read(spark, d, "events"), "value")


@query("select event_id, (dense_rank() over (order by event_type) - 1)::int as dense from events")
def dense_labels(spark, d):
    return cluster.dense_labels(read(spark, d, "events").select("event_id", "event_type"), "event_type").select("event_id", "dense")


# --- profiles -----------------------------------------------------------------------------------------------------------


def _line(spark, d):
    return read(spark, d, "lineitem")


LINE_NUM = ["l_discount", "l_extendedprice", "l_quantity"]
_LONG = "with long as (unpivot (select l_returnflag as cluster, l_discount, l_extendedprice, l_quantity from lineitem) on l_discount, l_extendedprice, l_quantity into name feature value x)"
_CATS = "with long as (unpivot (select o_orderstatus as cluster, o_orderpriority, cast(o_custkey % 7 as varchar) as grp from orders) on o_orderpriority, grp into name feature value v), c as (select feature, cluster, v, count(*) as c from long group by 1, 2, 3)"


def _status(spark, d):
    return read(spark, d, "orders").select("o_orderstatus", "o_orderpriority", (F.col("o_custkey") % 7).cast("string").alias("grp"))


@query("select o_orderstatus as cluster, count(*) as n, round(count(*) / sum(count(*)) over (), 6) as fraction from orders group by 1")
def cluster_size_fraction(spark, d):
    return profile.sizes(read(spark, d, "orders"), "o_orderstatus")


@query(f"{_LONG}, g as (select feature, avg(x) as g from long group by feature) select feature, cluster, round(avg(x), 5) as mean, round(median(x), 5) as median, round(quantile_cont(x, 0.75) - quantile_cont(x, 0.25), 5) as iqr, round(avg(x) - any_value(g), 5) as diff_vs_global from long join g using (feature) group by 1, 2")
def numeric_profile(spark, d):
    return profile.numeric(_line(spark, d), "l_returnflag", LINE_NUM)


_LIFT = f"""{_CATS}, vs as (select feature, v, sum(c) as vc from c group by 1, 2), cl as (select feature, cluster, sum(c) as cc from c group by 1, 2),
lift as (select feature, cluster, v, round((coalesce(c, 0) / cc) / (vc / sum(vc) over (partition by feature, cluster) + 1e-12), 6) as lift from vs join cl using (feature) left join c using (feature, cluster, v)),
ranked as (select feature, cluster, v as value, lift, row_number() over (partition by feature, cluster order by lift desc, v)::int as rank from lift)"""


@query(f"{_LIFT} select * from ranked where rank <= 3")
def category_lift_topk(spark, d):
    return profile.lifts(_status(spark, d), "o_orderstatus", ["o_orderpriority", "grp"], 3)


@query(f"{_LIFT} select feature, cluster, string_agg(value || ':' || printf('%.3f', lift), ';' order by rank) as top_lifts from ranked where rank <= 5 group by 1, 2")
def profile_table(spark, d):
    return profile.table(_status(spark, d), "o_orderstatus", ["o_orderpriority", "grp"], 5)


_WIDE = ", ".join(f"max({v}) filter (feature = '{c}') as {c}_{v}" for c in LINE_NUM for v in ("mean", "median", "iqr", "diff_vs_global", "cis"))


@query(f"""{_LONG}, g as (select feature, avg(x) as g from long group by feature), per as (
  select feature, cluster, round(avg(x), 5) as mean, round(median(x), 5) as median, round(quantile_cont(x, 0.75) - quantile_cont(x, 0.25), 5) as iqr, round(avg(x) - any_value(g), 5) as diff_vs_global from long join g using (feature) group by 1, 2
), names as (select distinct cluster as c from long), two as (select feature, c, count(*) filter (cluster = c) as n1, count(*) filter (cluster <> c) as n2, avg(x) filter (cluster = c) as m1, avg(x) filter (cluster <> c) as m2, var_samp(x) filter (cluster = c) as v1, var_samp(x) filter (cluster <> c) as v2 from long, names group by 1, 2),
effects as (select feature, round(avg(abs(round((m1 - m2) / sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2)), 5))), 4) as cis from two group by feature),
flat as (select cluster, {_WIDE} from per join effects using (feature) group by cluster),
sized as (select l_returnflag as cluster, count(*) as size, round(count(*) / sum(count(*)) over (), 6) as fraction from lineitem group by 1),
c as (select l_returnflag as cluster, l_linestatus as v, count(*) as c from lineitem group by 1, 2), vs as (select v, sum(c) as vc from c group by 1), cl as (select cluster, sum(c) as cc from c group by 1),
lift as (select cluster, v, round((coalesce(c, 0) / cc) / (vc / sum(vc) over (partition by cluster) + 1e-12), 6) as lift from vs cross join cl left join c using (cluster, v)),
ranked as (select cluster, v, lift, row_number() over (partition by cluster order by lift desc, v) as r from lift)
select sized.*, flat.* exclude (cluster), (select string_agg(v || ':' || printf('%.3f', lift), ';' order by r) from ranked where r <= 5 and ranked.cluster = sized.cluster) as l_linestatus_top_lifts from sized join flat using (cluster)""")
def profile_wide(spark, d):
    return profile.wide(_line(spark, d), "l_returnflag", LINE_NUM, ["l_linestatus"])


# There are three clusters, so that the tails of F and of chi-square have closed forms.
@query(f"""{_LONG}, p as (select feature, cluster, count(*) as n, avg(x) as m, var_pop(x) as v from long group by 1, 2), g as (select feature, avg(x) as g from long group by feature),
f as (select feature, (sum(n * (m - g) * (m - g)) / (count(*) - 1)) / (sum(n * v) / (sum(n) - count(*))) as f, count(*) - 1 as dof1, (sum(n) - count(*))::bigint as dof2 from p join g using (feature) group by feature)
select feature, round(f, 5) as f_stat, dof1, dof2, round(pow(1 + 2 * f / dof2, -dof2 / 2.0), 6) as p from f""")
def anova_f(spark, d):
    return profile.anova(_line(spark, d), "l_returnflag", LINE_NUM)


@query(f"""{_LONG}, v as (select feature, x, count(*) as t from long group by 1, 2), r as (select *, sum(t) over (partition by feature order by x rows unbounded preceding) - (t - 1) / 2 as r from v),
tot as (select feature, sum(t)::double as n, sum(pow(t, 3) - t) as ties from r group by feature),
s as (select feature, cluster, sum(r) as s, count(*) as m from long join r using (feature, x) group by 1, 2), q as (select feature, sum(s * s / m) as q, count(*) as k from s group by feature),
h as (select feature, (12 / (n * (n + 1)) * q - 3 * (n + 1)) / (1 - ties / (pow(n, 3) - n)) as h, k - 1 as dof from q join tot using (feature))
select feature, round(h, 4) as h_stat, dof, round(exp(-h / 2), 6) as p from h""")
def kruskal_h(spark, d):
    return profile.kruskal(_line(spark, d), "l_returnflag", LINE_NUM)


@query(f"""{_CATS}, rs as (select feature, cluster, sum(c) as rs from c group by 1, 2), cs as (select feature, v, sum(c) as cs from c group by 1, 2),
dims as (select feature, count(distinct cluster) as r, count(distinct v) as k, sum(c)::double as n from c group by feature),
x as (select feature, r, k, n, sum(pow(coalesce(c, 0) - rs * cs / n, 2) / (rs * cs / n)) as x from rs join cs using (feature) join dims using (feature) left join c using (feature, cluster, v) group by 1, 2, 3, 4)
select feature, round(x, 5) as chi2, (r - 1) * (k - 1) as dof, round(exp(-x / 2) * list_sum(list_transform(range((r - 1) * (k - 1) // 2), lambda i: pow(x / 2, i) / gamma(i + 1))), 6) as p, round(sqrt(x / n / least(r - 1, k - 1)), 6) as cramers_v from x""")
def chi2_cramers_v(spark, d):
    return profile.chi_square(_status(spark, d), "o_orderstatus", ["o_orderpriority", "grp"])


_D = f"""{_LONG}, names as (select distinct cluster as c from long), two as (select feature, c as cluster, count(*) filter (cluster = c) as n1, count(*) filter (cluster <> c) as n2, avg(x) filter (cluster = c) as m1, avg(x) filter (cluster <> c) as m2, var_samp(x) filter (cluster = c) as v1, var_samp(x) filter (cluster <> c) as v2 from long, names group by 1, 2),
d as (select feature, cluster, round((m1 - m2) / sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2)), 5) as cohens_d from two)"""


@query(f"{_D} select * from d")
def cohens_d(spark, d):
    return profile.cluster_vs_rest(_line(spark, d), "l_returnflag", LINE_NUM)


@query(f"{_D} select feature, round(avg(abs(cohens_d)), 4) as cis_mean, round(max(abs(cohens_d)), 4) as cis_max from d group by feature")
def cis_b(spark, d):
    return profile.effect(_line(spark, d), "l_returnflag", LINE_NUM)


@query(f"""{_CATS}, t as (select *, sum(c) over (partition by feature) as n, sum(c) over (partition by feature, cluster) as a, sum(c) over (partition by feature, v) as b from c),
mi as (select feature, sum(c / n * ln(c * n / (a * b))) as mi from t group by feature), h as (select feature, -sum(a / n * ln(a / n)) as h from (select distinct feature, cluster, a, n from t) group by feature)
select feature, round(mi / h, 6) as nmi from mi join h using (feature)""")
def mutual_info(spark, d):
    return profile.mutual_information(_status(spark, d), "o_orderstatus", ["o_orderpriority", "grp"])


# --- ranking of trials --------------------------------------------------------------------------------------------------

# Three labellings of one table stand for three trials; their scores are real ones.
_LABELS = {0: "p_type", 1: "p_brand", 2: "cast(p_size // 13 as varchar)"}
_TRIAL = """select {n} as trial, (select round(avg(case when a is null or b is null or greatest(a, b) <= 0 then 0 else (b - a) / greatest(a, b) end), 6) from (
  select k, max(d / (size - 1)) filter (own = lab and size > 1) as a, min(d / size) filter (own <> lab) as b from (
    select a.p_partkey as k, a.l as own, b.l as lab, sum((abs(a.p_retailprice - b.p_retailprice) * ip + abs(a.p_size - b.p_size) * isz) / 2.0) as d
    from (select *, {l} as l from part) a cross join (select *, {l} as l from part) b, ranges group by 1, 2, 3
  ) join (select {l} as lab, count(*) as size from part group by 1) using (lab) group by k, own)) as j,
  (with r as (select *, {l} as l from part), c as (select l, avg(p_size) as ms, avg(p_retailprice) as mp from r group by l),
    s as (select l, avg(sqrt((p_size - ms) * (p_size - ms) + (p_retailprice - mp) * (p_retailprice - mp))) as s from r join c using (l) group by l), b as (select * from c join s using (l))
    select round(avg(r), 6) from (select a.l, max((a.s + o.s) / sqrt((a.ms - o.ms) * (a.ms - o.ms) + (a.mp - o.mp) * (a.mp - o.mp))) as r from b a join b o on a.l <> o.l group by 1)) as dbi"""
_TRIALS = " union all ".join(_TRIAL.format(n=n, l=expr) for n, expr in _LABELS.items())


@query(f"with {_RANGES}, t as ({_TRIALS}) select *, row_number() over (order by round(j, 9) desc, dbi, trial)::int as place from t")
def trial_ranking(spark, d):
    from functools import reduce

    from . import anchored

    f = part(spark, d)
    labels = {0: F.col("p_type"), 1: F.col("p_brand"), 2: F.floor(F.col("p_size") / 13).cast("string")}
    rows = []
    for n, label in labels.items():
        g = MixedFrame(f.df.withColumn("l", label), f.key, f.num, [], "l")
        j = metrics.silhouette(g).agg(F.round(F.avg("s"), 6).alias("j"))
        rows.append(j.crossJoin(metrics.davies_bouldin(g.df, "l", ["p_size", "p_retailprice"])).select(F.lit(n).alias("trial"), "j", F.col("davies_bouldin").alias("dbi"), F.lit(None).cast("double").alias("chi")))
    trials = reduce(DataFrame.union, rows)
    return trials.drop("chi").join(anchored.rank_trials(trials), "trial")


# --- at scale -----------------------------------------------------------------------------------------------------------


@query("""with base as (select *, l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey as k from lineitem), sized as (select l_returnflag as lab, count(*) as size from lineitem group by 1),
nums as (unpivot (select k, l_returnflag as own, l_quantity, l_discount, l_tax from base) on l_quantity, l_discount, l_tax into name f value x),
rng as (select f, 1.0 / greatest(max(x) - min(x), 1e-9) as i from nums group by f), cell as (select f, x, own as lab, count(*) as c from nums group by 1, 2, 3),
grid as (select f, x, lab, size, coalesce(c, 0) as c from (select distinct f, x from cell) cross join sized left join cell using (f, x, lab)),
pre as (select *, sum(c) over w as n, sum(c * x) over w as s, sum(c * x) over (partition by f, lab) as t from grid window w as (partition by f, lab order by x rows unbounded preceding)),
d as (select f, x, lab, (x * n - s + t - s - x * (size - n)) * i as d from pre join rng using (f)),
flag as (select l_linestatus as v, l_returnflag as lab, count(*) as c from lineitem group by 1, 2), flags as (select v, lab, size - coalesce(c, 0) as d from (select distinct v from flag) cross join sized left join flag using (v, lab)),
tot as (select k, own, lab, sum(d) as d from (select k, own, lab, d from nums join d using (f, x) union all select k, l_returnflag, lab, d from base join flags on v = l_linestatus) group by 1, 2, 3),
ab as (select k, own, max(d / 4 / (size - 1)) filter (own = lab) as a, min(d / 4 / size) filter (own <> lab) as b from tot join sized using (lab) group by 1, 2)
select own as label, count(*) as n, round(avg(case when greatest(a, b) <= 0 then 0 else (b - a) / greatest(a, b) end), 6) as silhouette from ab group by own""")
def silhouette_lineitem(spark, d):
    key = F.concat_ws("-", *[F.col(c).cast("string") for c in LINE_KEYS])
    f = MixedFrame(_line(spark, d).withColumn("k", key), "k", ["l_quantity", "l_discount", "l_tax"], ["l_linestatus"], "l_returnflag")
    return metrics.silhouette(f).groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("s"), 6).alias("silhouette"))


@query()
def lsil_lineitem(spark, d):
    """Landmark silhouette of the largest table; the pairs are too many for SQL (tests hold the operator, lsil_topk its SQL)."""
    f = MixedFrame(_line(spark, d).withColumn("k", F.xxhash64(*LINE_KEYS)), "k", ["l_quantity", "l_discount", "l_tax", "l_extendedprice"], ["l_linestatus"], "l_returnflag")
    return metrics.lsil(f, metrics.landmarks_of(f))


@query()
def kmsnc_lineitem(spark, d):
    f = MixedFrame(_line(spark, d).withColumn("k", F.xxhash64(*LINE_KEYS)), "k", ["l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"], ["l_returnflag", "l_linestatus"])
    return redundancy.matrix(f)


@query()
def end_to_end(spark, d):
    from .pipeline import run_pipeline

    return run_pipeline(read(spark, d, "part"), "p_partkey", "p_type", params=None).get("assignments")


from . import selection  # noqa: E402, F401  (registers further queries with the decorator above)
