"""Queries: reference distributions, bias-corrected estimates and the estimate timeline."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from winnow.functions.exprs import r6, ratio
from winnow.operators import aggregates as A
from winnow.operators import estimate as E
from winnow.operators import joins as J
from winnow.operators import primitives as N
from winnow.operators import windows as V
from winnow.plans import fixtures as X
from winnow.plans.fixtures import u_duck
from winnow.plans.measures import BS, TRUTH_SQL, _rounded, truth_timeline
from winnow.plans.registry import cte, query
from winnow.plans.series import WMEM_SQL, win_steps
from winnow.plans.sqlparts import interp, phi, weighted_points
from winnow.settings import DEFAULTS as S



def tie():
    """Full order among equal readings."""
    return F.struct("rid", "h")

FIELDS = ("mean", "d10", "d50", "d90", "cv")

# -- SQL twins of the estimation chain --------------------------------------------------------------
cte("enough", """SELECT batch_id, step FROM (SELECT batch_id, step, sum(n_acc) OVER (
 PARTITION BY batch_id ORDER BY step ROWS 4 PRECEDING) AS n FROM wstep) WHERE n>=100""")
cte("er", f"""SELECT m.batch_id, m.window_step AS step, rid, ln(size_um) AS x,
 thickness_um*(1e0+growth*(60e0*(m.window_step+1)-t_s)) AS h FROM ({WMEM_SQL}) m
 JOIN wgrowth g ON g.batch_id=m.batch_id AND g.step=m.window_step
 JOIN enough e ON e.batch_id=m.batch_id AND e.step=m.window_step WHERE accepted""")
_W = "((ln(1010e0)-ln(500e0))/200)"
cte("eref", f"""SELECT batch_id, step, ln(500e0)+(bin+0.5e0)*{_W} AS log_size,
 n/sum(n) OVER (PARTITION BY batch_id, step) AS weight FROM (SELECT batch_id, step,
 floor((ln(size_um)-ln(500e0))/{_W}) AS bin, count(*) AS n FROM bed WHERE true_class=0
 GROUP BY 1,2,3)""")


def chain(ref: str = "eref", rows: str = "er", p: str = "", sigma: float = 0.65) -> dict[str, str]:
    """CTEs from window rows to fitted, weighed rows; ``p`` prefixes their names."""
    cls = "least(greatest(floor(({x}-lo)/width),0),29)::BIGINT"
    ctr = "(lo+(class+0.5e0)*width)"
    return {
        f"{p}espan": f"""SELECT batch_id, step, least(la,lb) AS lo,
 greatest((greatest(ha,hb)-least(la,lb))/30,2.220446049250313e-16) AS width, wt FROM
 (SELECT batch_id, step, min(x) AS la, max(x) AS ha FROM {rows} GROUP BY 1,2) JOIN
 (SELECT batch_id, step, min(log_size) AS lb, max(log_size) AS hb, sum(weight) AS wt FROM {ref}
  GROUP BY 1,2) USING (batch_id, step)""",
        f"{p}erow": f"""SELECT r.*, {cls.format(x='x')} AS class FROM {rows} r
 JOIN {p}espan USING (batch_id, step)""",
        f"{p}ecls": f"""SELECT batch_id, step, lo, width, class, coalesce(n,0e0) AS n,
 coalesce(s1,0e0) AS s1, coalesce(s2,0e0) AS s2, coalesce(f,0e0) AS f_true,
 coalesce(xr,{ctr}) AS x_ref, coalesce(xo,{ctr}) AS x_obs FROM
 (SELECT batch_id, step, class, count(*)::DOUBLE AS n, sum(h) AS s1, sum(h*h) AS s2,
  sum(x)/count(*) AS xo FROM {p}erow GROUP BY 1,2,3) FULL JOIN
 (SELECT batch_id, step, {cls.format(x='log_size')} AS class, sum(weight)/any_value(wt) AS f,
  sum(weight*log_size)/sum(weight) AS xr FROM {ref} JOIN {p}espan USING (batch_id, step)
  GROUP BY 1,2,3) USING (batch_id, step, class) JOIN {p}espan USING (batch_id, step)""",
        f"{p}efit": f"""SELECT batch_id, step, lo, width, alpha, beta, nw,
 greatest(cv2u,0e0) AS cv2, cv2u FROM (SELECT batch_id, step, lo, width, alpha, beta,
  sum(n) AS nw, (sum(s2-2e0*t*s1+n*t*t)-sum(n)*{sigma}e0*{sigma}e0)/sum(n*t*t)
  -beta*beta*width*width/12e0 AS cv2u FROM (
   SELECT c.*, alpha, beta, exp(alpha+beta*x_obs) AS t FROM {p}ecls c JOIN (
    SELECT batch_id, step, beta, my-beta*mx AS alpha FROM (
     SELECT batch_id, step, mx, my, CASE WHEN sum(n*(x_obs-mx)*(x_obs-mx))>0 THEN
      sum(n*(x_obs-mx)*(ln(s1/n)-my))/sum(n*(x_obs-mx)*(x_obs-mx)) ELSE 0e0 END AS beta FROM (
      SELECT *, sum(n*x_obs) OVER g/sum(n) OVER g AS mx, sum(n*ln(s1/n)) OVER g/sum(n) OVER g
       AS my FROM {p}ecls WHERE n>0 AND s1>0 WINDOW g AS (PARTITION BY batch_id, step))
     GROUP BY 1,2,3,4)) USING (batch_id, step) WHERE n>0) GROUP BY 1,2,3,4,5,6)""",
        f"{p}ewt": f"""SELECT c.batch_id, c.step, c.class, n, s1, s2, f_true,
 least(ratio, cap) AS w_ipw, CASE WHEN n>0 THEN f_true*(n/(n+20e0))/n ELSE 0e0 END AS w
 FROM (SELECT *, CASE WHEN n>0 THEN f_true/(n/sum(n) OVER (PARTITION BY batch_id, step)) ELSE 0e0
  END AS ratio FROM {p}ecls) c JOIN (SELECT batch_id, step, quantile_cont(ratio,0.99) AS cap FROM (
  SELECT r.batch_id, r.step, f_true/(n/sum(1) OVER (PARTITION BY r.batch_id, r.step)) AS ratio
  FROM {p}erow r JOIN {p}ecls USING (batch_id, step, class)) GROUP BY 1,2) USING (batch_id, step)""",
        f"{p}erows": f"""SELECT r.*, w, w_ipw, t+sqrt(cv2*t*t/(cv2*t*t+{sigma}e0*{sigma}e0))*(h-t)
 AS v FROM (SELECT r.*, cv2, exp(alpha+beta*x) AS t FROM {p}erow r
 JOIN {p}efit USING (batch_id, step)) r JOIN {p}ewt USING (batch_id, step, class)""",
        f"{p}ecomps": f"""SELECT batch_id, step, list({{'mu':mu,'sd':mu*sqrt(cv2+beta*beta*width*width
 /12e0),'w':wm}}) AS comps FROM (SELECT c.batch_id, c.step, cv2, beta, f.width,
 exp(alpha+beta*x_ref) AS mu, f_true*(1e0-CASE WHEN n>0 THEN n/(n+20e0) ELSE 0e0 END) AS wm
 FROM {p}ecls c JOIN {p}efit f USING (batch_id, step)) GROUP BY 1,2""",
        f"{p}emodel": f"""SELECT batch_id, step, list({{'mu':mu,'sd':mu*sqrt(cv2+beta*beta*width*width
 /12e0),'w':f_true}}) AS comps FROM (SELECT c.batch_id, c.step, cv2, beta, f.width,
 exp(alpha+beta*x_ref) AS mu, f_true FROM {p}ecls c JOIN {p}efit f USING (batch_id, step))
 GROUP BY 1,2""",
    }


def smooth(x: str) -> str:
    z = f"(({x}-c.mu)/greatest(c.sd,1e-12))"
    return f"list_sum(list_transform(comps, lambda c: c.w*{phi(z)}))"


def mixture(p: str, rows: str, comps: str, qs: str = "[0.1e0,0.5e0,0.9e0]",
            keys: str = "batch_id, step") -> dict[str, str]:
    """CTEs ending in {p}mix(keys, p, root): roots of the mixture CDF."""
    low = "list_min(list_transform(comps, lambda c: c.mu-8e0*c.sd))"
    high = "list_max(list_transform(comps, lambda c: c.mu+8e0*c.sd))"
    return {
        f"{p}mr": f"""SELECT {keys}, v, w, cum, comps, {smooth('v')} AS s FROM (SELECT {keys}, v, w,
 sum(w) OVER (PARTITION BY {keys} ORDER BY v) AS cum FROM (SELECT {keys}, v, sum(w) AS w
 FROM {rows} GROUP BY ALL)) JOIN {comps} USING ({keys})""",
        f"{p}mh": f"""SELECT {keys}, p, min({{'v':v,'base':cum-w,'s':s}}) FILTER (cum+s>=p) AS hit,
 max(v) FILTER (cum+s<p) AS below, max(v) AS vmax, max(cum) AS wall
 FROM {p}mr, (SELECT unnest({qs}) AS p) GROUP BY ALL""",
        f"{p}ms": f"""SELECT {keys}, p, comps, hit.v AS v,
 coalesce(hit.base+hit.s<p,false) AS jump, coalesce(hit.base,wall,0e0) AS base,
 CASE WHEN hit IS NULL THEN coalesce(vmax,{low}) ELSE coalesce(below,least({low},hit.v)) END AS lo,
 CASE WHEN hit IS NULL THEN greatest({high},vmax) ELSE hit.v END AS hi
 FROM (SELECT {keys}, comps, p FROM {comps}, (SELECT unnest({qs}) AS p))
 LEFT JOIN {p}mh USING ({keys}, p)""",
        f"{p}mb": f"""SELECT {keys}, p, comps, base, lo, hi, 0 AS i FROM {p}ms WHERE NOT jump
 UNION ALL SELECT {keys}, p, comps, base,
 CASE WHEN base+{smooth('(lo+hi)/2e0')}>=p THEN lo ELSE (lo+hi)/2e0 END,
 CASE WHEN base+{smooth('(lo+hi)/2e0')}>=p THEN (lo+hi)/2e0 ELSE hi END, i+1
 FROM {p}mb WHERE i<45""",
        f"{p}mix": f"""SELECT {keys}, p, (lo+hi)/2e0 AS root FROM {p}mb WHERE i=45
 UNION ALL SELECT {keys}, p, v FROM {p}ms WHERE jump""",
    }


BASE = chain()
HYB = {**BASE, **mixture("h", "erows", "ecomps")}
MOD = {**BASE, **mixture("o", "(SELECT * FROM erows WHERE false)", "emodel")}


def _mix_select(p: str) -> str:
    return ", ".join(f"round(max(root) FILTER (p={q}e0),6) AS d{int(q * 100)}"
                     for q in (0.1, 0.5, 0.9)) + f" FROM {p}mix GROUP BY batch_id, step"


# -- Spark side ----------------------------------------------------------------------------------------


def window_rows(spark, sf, s=S, keys=("rid",)):
    """Accepted readings of every window with enough objects, shifted forward in age.

    A reading stands in five windows, so only what is asked for goes along.
    """
    steps = win_steps(spark, sf)
    n = V.rolling_sum("n_acc", ["batch_id"], s.window_steps)
    t = (F.col("step") - 40) * 60.0
    keep = steps.select(*BS, n.alias("_n"), V.relative_growth(
        "mean_um", t, ["batch_id"], s.growth_steps).alias("growth")).filter(
        F.col("_n") >= s.min_objects)
    rows = J.window_members(X.win(spark, sf).filter("accepted").select(
        *BS, *keys, "t_s", "size_um", "thickness_um"), ["batch_id"], s.window_steps)
    now = F.lit(s.step_s) * (F.col("window_step") + 1)
    h = F.col("thickness_um") * (F.lit(1.0) + F.col("growth") * (now - F.col("t_s")))
    rows = rows.drop("step").withColumnRenamed("window_step", "step")
    return (N.with_group_values(rows, keep, BS).withColumn("window_step", F.col("step"))
            .select(*BS, *keys, F.log("size_um").alias("x"), h.alias("h")))


def exact_reference(spark, sf):
    return E.reference_from_population(X.bed(spark, sf).filter("true_class=0"), BS, "size_um",
                                       S.size_edges)


def window_model(spark, sf, s=S, keys=("rid",), ref=None):
    ref = exact_reference(spark, sf) if ref is None else ref
    return E.WindowModel(window_rows(spark, sf, s, keys), ref, BS, s)


@query("e1_reference_population", """
SELECT batch_id, step, round(log_size,6) AS log_size, round(weight,6) AS weight FROM eref""")
def _(spark, sf):
    return _rounded(exact_reference(spark, sf), "log_size", "weight")


_U1, _U2 = u_duck("g1"), u_duck("g2")
ATL = {"atl": f"""SELECT batch_id, step, rid, ln(size_um+2e0*(sqrt(-2e0*ln(1e0-{_U1}))
 *cos(6.283185307179586e0*{_U2}))) AS log_size, 1e0/count(*) OVER (PARTITION BY batch_id, step)
 AS weight FROM (SELECT *, count(*) OVER (PARTITION BY batch_id, step) AS n FROM bed
 WHERE true_class=0) WHERE {u_duck('al')}<100e0/n"""}


def atline(spark, sf):
    return E.reference_from_sample(X.bed(spark, sf).filter("true_class=0"), BS, "size_um", 100,
                                   2.0, ["rid"])


@query("e2_reference_sample", """
SELECT batch_id, step, count(*) AS n_effective, round(sum(weight),6) AS total,
 round(avg(log_size),6) AS mean_log_size, round(max(log_size),6) AS max_log_size
FROM atl GROUP BY 1,2""", ATL)
def _(spark, sf):
    return atline(spark, sf).groupBy(*BS).agg(
        F.max("n_effective").alias("n_effective"), r6(F.sum("weight")).alias("total"),
        r6(F.avg("log_size")).alias("mean_log_size"), r6(F.max("log_size")).alias("max_log_size"))


_OWN = chain(ref="(SELECT batch_id, step, x AS log_size, 1e0 AS weight FROM er)", p="own",
             sigma=0.0)
_OWN["cores"] = f"""SELECT batch_id, ln(300e0)+(bin+0.5e0)*((ln(1010e0)-ln(300e0))/200) AS log_core,
 n/sum(n) OVER (PARTITION BY batch_id) AS weight FROM (SELECT batch_id,
 floor((ln(core_um)-ln(300e0))/((ln(1010e0)-ln(300e0))/200)) AS bin, count(*) AS n FROM bed
 WHERE true_class=0 GROUP BY 1,2)"""
_COA = """ln(exp(log_core)+2e0*exp(alpha+beta*ln(exp(log_core)+2e0*mean_um)))"""


@query("e3_reference_certificate", f"""
SELECT batch_id, step, count(*) AS n, round(sum(weight*s),6) AS mean_log_size,
 round(max(s),6) AS max_log_size FROM (SELECT f.batch_id, f.step, weight, {_COA} AS s
 FROM ownefit f JOIN (SELECT batch_id, step, avg(h) AS mean_um FROM er GROUP BY 1,2)
 USING (batch_id, step) JOIN cores USING (batch_id)) GROUP BY 1,2""", _OWN)
def _(spark, sf):
    return certificate(spark, sf, N.settle(window_rows(spark, sf))).groupBy(*BS).agg(
        F.count("*").alias("n"), r6(F.sum(F.col("weight") * F.col("log_size")))
        .alias("mean_log_size"), r6(F.max("log_size")).alias("max_log_size"))


def certificate(spark, sf, rows):
    """Reference of every window from the certified cores and the window's own trend."""
    own = rows.select(*BS, F.col("x").alias("log_size"), F.lit(1.0).alias("weight"))
    _, table = E.size_classes(rows, own, BS, S.size_classes)
    mean = rows.groupBy(*BS).agg(F.avg("h").alias("mean_um"))
    fit = E.fit_trend(E.class_arrays(table, BS), 0.0).join(mean, BS).select(
        *BS, "alpha", "beta", "mean_um")
    cores = E.reference_from_population(X.bed(spark, sf).filter("true_class=0"), ["batch_id"],
                                        "core_um", (300.0, 1010.0, 200))
    cores = cores.withColumnRenamed("log_size", "log_core")
    return E.reference_from_cores(cores, fit, BS, ["batch_id"])


@query("e4_size_classes", """
SELECT batch_id, step, class, n, round(s1,5) AS s1, round(f_true,6) AS f_true,
 round(x_ref,6) AS x_ref, round(x_obs,6) AS x_obs FROM ecls""", BASE)
def _(spark, sf):
    _, table = E.size_classes(window_rows(spark, sf), exact_reference(spark, sf), BS,
                              S.size_classes)
    return _rounded(table.select(*BS, "class", "n", r6("s1", 5).alias("s1"), "f_true", "x_ref",
                                 "x_obs"), "f_true", "x_ref", "x_obs")


@query("e5_trend_fit", """
SELECT batch_id, step, round(alpha,6) AS alpha, round(beta,6) AS beta, round(cv2u,6)
 AS cv2_unclipped, round(cv2,6) AS cv2 FROM efit""", BASE)
def _(spark, sf):
    _, table = E.size_classes(window_rows(spark, sf), exact_reference(spark, sf), BS,
                              S.size_classes)
    fit = E.fit_trend(E.class_arrays(table, BS), S.sigma_um)
    return _rounded(fit.select(*BS, "alpha", "beta", "cv2_unclipped", "cv2"),
                    "alpha", "beta", "cv2_unclipped", "cv2")


@query("e6_ipw_weights", """
SELECT batch_id, step, class, n, round(w_ipw+1e-11,9) AS w_ipw FROM ewt WHERE n>0""", BASE)
def _(spark, sf):
    _, table = E.size_classes(N.settle(window_rows(spark, sf, keys=())),
                              N.settle(exact_reference(spark, sf)), BS, S.size_classes)
    out = E.class_weights(table, BS, S.trim_percentile).filter("n > 0")
    return out.select(*BS, "class", "n", r6(F.col("w_ipw") + 1e-11, 9).alias("w_ipw"))


IPW = {**BASE, "ipwm": """SELECT batch_id, step, mean, sqrt(greatest(sum(w_ipw*(s2-2e0*mean*s1
 +n*mean*mean))/sum(w_ipw*n),0e0)) AS sd, sum(w_ipw*n)*sum(w_ipw*n)/sum(w_ipw*w_ipw*n) AS ess,
 coalesce(sum(f_true) FILTER (n=0),0e0) AS uncovered FROM (SELECT *, sum(w_ipw*s1) OVER g
 /sum(w_ipw*n) OVER g AS mean FROM ewt WINDOW g AS (PARTITION BY batch_id, step))
 GROUP BY 1,2,3""",
       "ipwq": f"""SELECT batch_id, step, {interp('', '', 0.1)} AS d10, {interp('', '', 0.5)} AS d50,
 {interp('', '', 0.9)} AS d90 FROM ({weighted_points('erows', 'batch_id, step', 'h', 'w_ipw',
                                                     'rid')}) GROUP BY 1,2""",
       "rawq": f"""SELECT batch_id, step, {interp('', '', 0.1)} AS d10, {interp('', '', 0.5)} AS d50,
 {interp('', '', 0.9)} AS d90 FROM ({weighted_points('(SELECT *, 1e0 AS one FROM erows)',
                                                     'batch_id, step', 'h', 'one', 'rid')})
 GROUP BY 1,2""",
       "rawm": """SELECT batch_id, step, avg(h) AS mean, stddev_pop(h)/avg(h) AS cv FROM erows
 GROUP BY 1,2"""}


@query("e7_ipw_estimate", """
SELECT batch_id, step, round(mean,6) AS mean, CASE WHEN mean>0 THEN round(sd/mean,6) END AS cv,
 round(ess,5) AS ess, round(uncovered,6) AS uncovered, round(d10,6) AS d10, round(d50,6) AS d50,
 round(d90,6) AS d90 FROM ipwm JOIN ipwq USING (batch_id, step)""", IPW)
def _(spark, sf):
    out = window_model(spark, sf).ipw(tie())
    return _rounded(out, "mean", "cv", "uncovered", "d10", "d50", "d90").withColumn(
        "ess", r6("ess", 5))


@query("e8_raw_estimate", """
SELECT batch_id, step, round(mean,6) AS mean, round(cv,6) AS cv, round(d10,6) AS d10,
 round(d50,6) AS d50, round(d90,6) AS d90 FROM rawm JOIN rawq USING (batch_id, step)""", IPW)
def _(spark, sf):
    rows = window_rows(spark, sf)
    return _rounded(E.raw_estimate(rows, BS, tie()), "mean", "cv", "d10", "d50", "d90")


@query("e9_shrink_to_trend", """
SELECT batch_id, step, count(*) AS n, round(avg(v),6) AS mean_shrunk, round(stddev_pop(v),6)
 AS sd_shrunk, round(stddev_pop(h),6) AS sd_raw FROM erows GROUP BY 1,2""", BASE)
def _(spark, sf):
    return window_model(spark, sf, keys=()).rows.groupBy(*BS).agg(
        F.count("*").alias("n"), r6(F.avg("v")).alias("mean_shrunk"),
        r6(F.stddev_pop("v")).alias("sd_shrunk"), r6(F.stddev_pop("h")).alias("sd_raw"))


@query("e10_empirical_share", """
SELECT batch_id, step, class, round(CASE WHEN n>0 THEN n/(n+20e0) ELSE 0e0 END,6) AS share
FROM ecls""", BASE)
def _(spark, sf):
    _, table = E.size_classes(window_rows(spark, sf), exact_reference(spark, sf), BS,
                              S.size_classes)
    n = F.col("n")
    return table.select(*BS, "class", r6(F.when(n > 0, n / (n + S.prior_count)).otherwise(0.0))
                        .alias("share"))


@query("e11_mixture_hybrid", f"SELECT batch_id, step, {_mix_select('h')}", HYB, recursive=True)
def _(spark, sf):
    m = window_model(spark, sf, keys=())
    return _rounded(E.mixture_quantiles(m.rows, m.hybrid, BS, E.QS), "d10", "d50", "d90")


@query("e11_mixture_model", f"SELECT batch_id, step, {_mix_select('o')}", MOD, recursive=True)
def _(spark, sf):
    out = window_model(spark, sf, keys=()).model_estimate()
    return _rounded(out.select(*BS, "d10", "d50", "d90"), "d10", "d50", "d90")


def _mass(lo: str, hi: str) -> str:
    return f"{smooth(hi)}-{smooth(lo)}"


CORR = {"hcorr": f"""SELECT batch_id, step, bin, coalesce(n,0e0)+{_mass('bin*0.5e0','(bin+1)*0.5e0')}
 AS mass FROM (SELECT batch_id, step, comps, unnest(range(60)) AS bin FROM ecomps) LEFT JOIN
 (SELECT batch_id, step, least(floor(v/0.5e0),59)::BIGINT AS bin, sum(w) AS n FROM erows
  WHERE v BETWEEN 0e0 AND 30e0 GROUP BY 1,2,3) USING (batch_id, step, bin)""",
        "hshare": """SELECT batch_id, step, bin, CASE WHEN sum(mass) OVER g<>0 THEN
 mass/sum(mass) OVER g END AS share FROM hcorr WINDOW g AS (PARTITION BY batch_id, step)"""}


@query("e14_corrected_histogram", """
SELECT batch_id, step, bin, round(share,6) AS share FROM hshare""", {**BASE, **CORR})
def _(spark, sf):
    return _rounded(E.corrected_histogram(window_model(spark, sf, keys=()), 0.0, 0.5, 60), "share")


@query("e16_class_display", """
SELECT batch_id, step, class, round(exp(lo+(class+0.5e0)*width),5) AS size_um,
 round(f_obs,6) AS f_obs, round(f_true,6) AS f_true,
 CASE WHEN f_obs>0 THEN round(f_true/f_obs+1e-11,9) END AS weight FROM (
 SELECT s.batch_id, s.step, s.class, s.lo, s.width, coalesce(n,0e0)/nw AS f_obs,
  coalesce(f_true,0e0) AS f_true FROM (SELECT batch_id, step, lo, width,
   unnest(range(30)) AS class FROM espan) s JOIN (SELECT batch_id, step, sum(n) AS nw FROM ecls
   GROUP BY 1,2) USING (batch_id, step) LEFT JOIN ecls c ON c.batch_id=s.batch_id
   AND c.step=s.step AND c.class=s.class)""", BASE)
def _(spark, sf):
    _, table = E.size_classes(window_rows(spark, sf), exact_reference(spark, sf), BS,
                              S.size_classes)
    out = E.class_display(table, BS, S.size_classes)
    return _rounded(out, "f_obs", "f_true").withColumn("size_um", r6("size_um", 5)).withColumn(
        "weight", r6(F.col("weight") + 1e-11, 9))


_ZS = "[" + ",".join(f"{z}e0" for z in E.NINE_POINTS) + "]"
CMD = {**BASE, "cfit": """SELECT batch_id, step, alpha, beta, sqrt(greatest(0e0, res/nn
 -power(0.65e0/exp(alpha+beta*mx),2e0))) AS cv FROM (SELECT c.batch_id, c.step, alpha, beta, mx,
  sum(n) AS nn, sum((s2-2e0*t*s1+n*t*t)/(t*t)) AS res FROM (SELECT e.*, alpha, beta, mx,
   exp(alpha+beta*(lo+(class+0.5e0)*width)) AS t FROM ecls e JOIN (
   SELECT batch_id, step, mx, my-beta*mx AS alpha, beta FROM (SELECT batch_id, step, mx, my,
    sum(n*(c-mx)*(y-my))/greatest(sum(n*(c-mx)*(c-mx)),1e-12) AS beta FROM (
     SELECT *, sum(n*c) OVER g/sum(n) OVER g AS mx, sum(n*y) OVER g/sum(n) OVER g AS my FROM (
      SELECT batch_id, step, n, lo+(class+0.5e0)*width AS c, ln(s1/n) AS y FROM ecls
      WHERE n>0 AND s1>0) WINDOW g AS (PARTITION BY batch_id, step)) GROUP BY 1,2,3,4))
   USING (batch_id, step) WHERE n>0) c GROUP BY 1,2,3,4,5)""",
       "citems": f"""SELECT batch_id, step, s1/n+sqrt(greatest(0e0,1e0-0.65e0*0.65e0/greatest(
 s2/n-(s1/n)*(s1/n),1e-12)))*(h-s1/n) AS v, f_true/n AS w FROM erow
 JOIN ecls USING (batch_id, step, class) WHERE n>=20
 UNION ALL SELECT batch_id, step, exp(alpha+beta*(lo+(class+0.5e0)*width))*(1e0+cv*z), f_true/9
 FROM (SELECT *, unnest({_ZS}) AS z FROM ecls WHERE n<20 AND f_true>0)
 JOIN cfit USING (batch_id, step)""",
       "ccum": """SELECT batch_id, step, v, sum(w) OVER (PARTITION BY batch_id, step ORDER BY v)
 AS cum FROM citems"""}


@query("e17_class_mean_d10", """
SELECT batch_id, step, round(coalesce(min(v) FILTER (cum>=0.1e0-1e-12), max(v)),6) AS d10
FROM ccum GROUP BY 1,2""", CMD)
def _(spark, sf):
    rows, table = E.size_classes(window_rows(spark, sf), exact_reference(spark, sf), BS,
                                 S.size_classes)
    table = N.settle(table)
    return _rounded(E.class_mean_d10(rows, table, BS, S.sigma_um, 20), "d10")


#: fixed values: published release times (minutes) at three coat thicknesses (um)
RELEASE_POINTS = ((9.8, 30.0), (13.2, 50.0), (16.1, 70.0))


@query("e18_release_projection", """
SELECT batch_id, step, round(sum(share*(slope*(bin*0.5e0+0.25e0)+icpt)),5) AS mean_t63_min,
 round(coalesce(sum(share) FILTER (NOT (bin*0.5e0+0.25e0 BETWEEN 9.8e0 AND 16.1e0)),0e0),6)
  AS share_outside
FROM hshare, (SELECT regr_slope(y,x) AS slope, regr_intercept(y,x) AS icpt FROM (
 SELECT unnest([9.8e0,13.2e0,16.1e0]) AS x, unnest([30e0,50e0,70e0]) AS y)) GROUP BY 1,2""",
       {**BASE, **CORR})
def _(spark, sf):
    points = spark.range(1).select(F.explode(F.array(*[
        F.struct(F.lit(a).alias("x"), F.lit(b).alias("y")) for a, b in RELEASE_POINTS]))
        .alias("p"))
    line = points.agg(F.regr_slope("p.y", "p.x").alias("slope"),
                      F.regr_intercept("p.y", "p.x").alias("icpt"))
    hist = E.corrected_histogram(window_model(spark, sf, keys=()), 0.0, 0.5, 60)
    centre = F.col("bin") * 0.5 + 0.25
    outside = ~centre.between(RELEASE_POINTS[0][0], RELEASE_POINTS[-1][0])
    return A.rejoin(hist, line, []).groupBy(*BS).agg(
        r6(F.sum(F.col("share") * (F.col("slope") * centre + F.col("icpt"))), 5)
        .alias("mean_t63_min"),
        r6(F.sum(F.when(outside, F.col("share")).otherwise(0.0))).alias("share_outside"))


# -- flagship slice: one row per batch ------------------------------------------------------------------
_SL = {"slw": "SELECT batch_id, 0 AS step, rid, ln(size_um) AS x, thickness_um AS h FROM win "
              "WHERE accepted",
       "slr": f"""SELECT batch_id, 0 AS step, ln(500e0)+(bin+0.5e0)*{_W} AS log_size,
 n/sum(n) OVER (PARTITION BY batch_id) AS weight FROM (SELECT batch_id,
 floor((ln(size_um)-ln(500e0))/{_W}) AS bin, count(*) AS n FROM bed WHERE true_class=0
 GROUP BY 1,2)"""}
_SL.update(chain(ref="slr", rows="slw", p="sl"))
_SL["slq"] = f"""SELECT batch_id, {interp('', '', 0.1)} AS d10 FROM ({weighted_points(
    'slerows', 'batch_id', 'h', 'w_ipw', 'rid')}) GROUP BY 1"""
_SL["slraw"] = f"""SELECT batch_id, {interp('', '', 0.1)} AS d10 FROM ({weighted_points(
    '(SELECT *, 1e0 AS one FROM slerows)', 'batch_id', 'h', 'one', 'rid')}) GROUP BY 1"""
_SL["sltrue"] = """SELECT batch_id, max(h_um) FILTER (r=least(n-1,floor(0.1e0*n))) AS d10 FROM (
 SELECT *, row_number() OVER (PARTITION BY batch_id ORDER BY h_um)-1 AS r,
 count(*) OVER (PARTITION BY batch_id) AS n FROM bed WHERE true_class=0) GROUP BY 1"""


@query("slice_corrected_d10", """
SELECT t.batch_id, round(t.d10,6) AS true_d10, round(r.d10,6) AS raw_d10,
 round(q.d10,6) AS corrected_d10, round(ess,4) AS ess, round(uncovered,6) AS uncovered
FROM sltrue t JOIN slraw r USING (batch_id) JOIN slq q USING (batch_id) JOIN (
 SELECT batch_id, sum(w_ipw*n)*sum(w_ipw*n)/sum(w_ipw*w_ipw*n) AS ess,
 coalesce(sum(f_true) FILTER (n=0),0e0) AS uncovered FROM slewt GROUP BY 1) USING (batch_id)""",
       _SL)
def _(spark, sf):
    with X.made_once(sf):
        return _slice(spark, sf)


def _slice(spark, sf):
    by = ["batch_id"]
    bed = X.bed(spark, sf).filter("true_class=0")
    rows = X.win(spark, sf).filter("accepted").select(
        *by, "rid", F.log("size_um").alias("x"), F.col("thickness_um").alias("h"))
    m = E.WindowModel(rows, E.reference_from_population(bed, by, "size_um", S.size_edges), by, S)
    ipw = m.ipw(tie()).select(*by, r6("d10").alias("corrected_d10"), r6("ess", 4).alias("ess"),
                            r6("uncovered").alias("uncovered"))
    raw = m.raw(tie()).select(*by, r6("d10").alias("raw_d10"))
    true = N.exact_quantiles(bed, by, "h_um", {"true_d10": 0.1}, kind="nearest")
    return true.withColumn("true_d10", r6("true_d10")).join(raw, by).join(ipw, by)


# -- timeline ---------------------------------------------------------------------------------------------
TIMELINE_METHODS = ("raw", "ipw", "model", "hybrid")


def base_columns(spark, sf, s=S):
    """Counts, rates and growth of every step; no estimate yet."""
    by = ["batch_id"]
    n = V.rolling_sum("n_acc", by, s.window_steps)
    single = V.rolling_sum("n_single", by, s.window_steps)
    twin = V.rolling_sum("n_twin", by, s.window_steps)
    fines = V.rolling_sum("n_fines", by, s.window_steps)
    steps = F.count("*").over(V.trailing(by, s.window_steps))
    t = (F.col("step") - 40) * s.step_s
    return win_steps(spark, sf).select(
        *BS, (F.lit(s.step_s) * (F.col("step") + 1)).alias("t_s"), n.alias("n_window"),
        F.when(single > 0, F.lit(1.0) - n / single).alias("undecided_rate"),
        ratio(F.lit(100.0) * twin, single + twin).alias("gate_twin_pct"),
        (fines / (steps * (s.step_s / 60.0))).alias("fines_per_min"),
        (F.lit(3600.0) * V.relative_growth("mean_um", t, by, s.growth_steps))
        .alias("growth_rel_per_h"))


def estimate_timeline(spark, sf, s=S, bootstrap="none", models=TIMELINE_METHODS,
                      replicates_from=None):
    """Every estimator at every step; NULL where the window holds too few objects.

    With ``replicates_from`` windows whose corrected d10 reaches it also carry their replicates.
    """
    # the population is read for the window and for the reference: not worth a copy
    with X.made_once(sf, "bed"):
        return _timeline(spark, sf, s, bootstrap, models, replicates_from)


def _timeline(spark, sf, s, bootstrap, models, replicates_from):
    # the key of a reading orders equal ones of unequal weight; a bootstrap names with it what it
    # draws, and gets it for its windows alone
    ref = N.settle(exact_reference(spark, sf))
    m = window_model(spark, sf, s, ("rid",) if "ipw" in models else (), ref)

    def drawn_from(wanted):
        return window_rows(spark, sf, s).join(N.small_side(wanted), BS, "left_semi")

    out = base_columns(spark, sf, s).join(m.summary().drop("n"), BS, "left")
    parts = {"raw": lambda: m.raw(tie()), "ipw": lambda: m.ipw(tie()), "model": m.model_estimate,
             "hybrid": m.hybrid_estimate}
    for name in models:
        est = parts[name]()
        if name == "hybrid" and bootstrap != "none":
            est = N.settle(est)
            wanted = est if bootstrap == "all" else est.filter(F.col("d10") >= s.spec_d10_um)
            out = out.join(interval_of(m, wanted.select(*BS), s, rows=drawn_from), BS, "left")
        if name == "hybrid" and replicates_from is not None:
            est = N.settle(est)
            wanted = est.filter(F.col("d10") >= replicates_from).select(*BS)
            reps = replicates_of(m, wanted, s, rows=drawn_from).groupBy(*BS).agg(
                F.sort_array(F.collect_list("d10")).alias("d10_reps"))  # as many as replicates
            out = out.join(reps, BS, "left")
        out = out.join(E.prefixed(est, BS, name), BS, "left")
    middle = N.weighted_quantiles(ref, BS, "log_size", "weight", F.lit(0), {"_m": 0.5})
    out = out.join(middle.join(m.fit.select(*BS), BS).select(
        *BS, F.exp("_m").alias("ref_median_um")), BS, "left")
    members = J.window_members(X.win(spark, sf).filter("accepted").select(*BS, "size_um"),
                               ["batch_id"], s.window_steps)
    sizes = N.exact_quantiles(members.select("batch_id", F.col("window_step").alias("step"),
                                             "size_um"), BS, "size_um", {"size_median_um": 0.5})
    out = out.join(sizes, BS, "left")
    return E.complete_schema(out, ["d10_lo", "d10_hi", "p_spec"])


def interval_of(model, wanted, s=S, sample=None, rows=None):
    """Bootstrap interval of the windows in ``wanted`` only."""
    return E.bootstrap_interval(replicates_of(model, wanted, s, sample, rows), model.by,
                                s.interval, s.spec_d10_um)


def replicates_of(model, wanted, s=S, sample=None, rows=None):
    """d10 of every replicate of the windows in ``wanted``: the filter precedes the explode.

    ``rows`` makes the rows of such windows with their keys, for a model that holds none.
    """
    sub = object.__new__(E.WindowModel)
    sub.by, sub.s = model.by, s
    sub.table = model.table.join(wanted, model.by, "left_semi")
    sub.fit = model.fit.join(wanted, model.by, "left_semi")
    if rows is None or "rid" in model.rows.columns:
        sub.rows = model.rows.join(wanted, model.by, "left_semi")
    else:
        sub.rows = N.settle(model.weigh(rows(wanted)).select(*model.by, "rid", "class", "h", "v"))
    if sample is not None:
        sample = (sample[0].join(wanted, model.by, "left_semi"), sample[1])
    return E.bootstrap_d10(sub, ["rid"], s.bootstrap_reps, sample)


TL = {**IPW, **mixture("h", "erows", "ecomps"),
      **mixture("o", "(SELECT * FROM erows WHERE false)", "emodel")}
TL["tlbase"] = """SELECT batch_id, step, 60e0*(step+1) AS t_s, n::BIGINT AS n_window,
 CASE WHEN s>0 THEN 1e0-n/s END AS undecided_rate,
 CASE WHEN s+t>0 THEN 100e0*t/(s+t) END AS gate_twin_pct, f/(c*1e0) AS fines_per_min,
 3600e0*growth AS growth_rel_per_h
 FROM (SELECT batch_id, step, sum(n_acc) OVER w AS n, sum(n_single) OVER w AS s,
  sum(n_twin) OVER w AS t, sum(n_fines) OVER w AS f, count(*) OVER w AS c FROM wstep WINDOW w AS (PARTITION BY batch_id ORDER BY step
  ROWS 4 PRECEDING)) JOIN wgrowth USING (batch_id, step)"""
for _p in ("h", "o"):
    TL[f"{_p}piv"] = (f"SELECT batch_id, step, max(root) FILTER (p=0.1e0) AS d10, max(root) FILTER "
                      f"(p=0.5e0) AS d50, max(root) FILTER (p=0.9e0) AS d90 FROM {_p}mix "
                      "GROUP BY 1,2")
_CM = ("list_sum(list_transform(comps, lambda c: c.w*c.mu))",
       "list_sum(list_transform(comps, lambda c: c.w*(c.mu*c.mu+c.sd*c.sd)))")
TL["omom"] = (f"SELECT batch_id, step, m1 AS mean, sqrt(greatest(m2-m1*m1,0e0))/m1 AS cv FROM ("
              f"SELECT batch_id, step, {_CM[0]} AS m1, {_CM[1]} AS m2 FROM emodel)")
TL["hmom"] = (f"SELECT batch_id, step, m1 AS mean, sqrt(greatest(m2-m1*m1,0e0))/m1 AS cv FROM ("
              f"SELECT batch_id, step, a1+{_CM[0]} AS m1, a2+{_CM[1]} AS m2 FROM ecomps JOIN "
              "(SELECT batch_id, step, sum(w*v) AS a1, sum(w*v*v) AS a2 FROM erows GROUP BY 1,2) "
              "USING (batch_id, step))")
TL["refmed"] = f"""SELECT batch_id, step, exp({interp('', '', 0.5)}) AS ref_median_um FROM (
 {weighted_points('eref', 'batch_id, step', 'log_size', 'weight', 'log_size')}) GROUP BY 1,2"""
TL["tl"] = """SELECT b.*, r.mean AS raw_mean, q.d10 AS raw_d10, q.d50 AS raw_d50, q.d90 AS raw_d90,
 r.cv AS raw_cv, i.mean AS ipw_mean, iq.d10 AS ipw_d10, iq.d50 AS ipw_d50, iq.d90 AS ipw_d90,
 i.sd/i.mean AS ipw_cv, i.ess AS ipw_ess, i.uncovered AS ipw_uncovered, om.mean AS model_mean,
 o.d10 AS model_d10, o.d50 AS model_d50, o.d90 AS model_d90, om.cv AS model_cv,
 hm.mean AS hybrid_mean, h.d10 AS hybrid_d10, h.d50 AS hybrid_d50, h.d90 AS hybrid_d90,
 hm.cv AS hybrid_cv, f.beta AS fit_beta, sqrt(f.cv2) AS cv_within,
 f.cv2u AS cv2_within_unclipped, rm.ref_median_um, sm.size_median_um FROM tlbase b
 LEFT JOIN (SELECT g.batch_id, g.step, quantile_cont(size_um, 0.5) AS size_median_um FROM wgrid g
  JOIN win w ON w.batch_id=g.batch_id AND w.accepted AND w.step>g.step-5 AND w.step<=g.step
  GROUP BY 1,2) sm USING (batch_id, step)
 LEFT JOIN rawm r USING (batch_id, step) LEFT JOIN rawq q USING (batch_id, step)
 LEFT JOIN ipwm i USING (batch_id, step) LEFT JOIN ipwq iq USING (batch_id, step)
 LEFT JOIN omom om USING (batch_id, step) LEFT JOIN opiv o USING (batch_id, step)
 LEFT JOIN hmom hm USING (batch_id, step) LEFT JOIN hpiv h USING (batch_id, step)
 LEFT JOIN efit f USING (batch_id, step) LEFT JOIN refmed rm ON f.batch_id=rm.batch_id
 AND f.step=rm.step"""
TL_COLS = ["t_s", "undecided_rate", "gate_twin_pct", "fines_per_min", "size_median_um",
           "growth_rel_per_h", *[
    f"{m}_{k}" for m in TIMELINE_METHODS for k in FIELDS], "ipw_uncovered", "fit_beta",
    "cv_within", "cv2_within_unclipped", "ref_median_um"]


@query("e15_estimate_timeline", "SELECT batch_id, step, n_window, round(ipw_ess,4) AS ipw_ess, "
       + ", ".join(f"round({c},5) AS {c}" for c in TL_COLS)
       + ", NULL::DOUBLE AS d10_lo, NULL::DOUBLE AS d10_hi, NULL::DOUBLE AS p_spec FROM tl",
       TL, recursive=True)
def _(spark, sf):
    out = estimate_timeline(spark, sf)
    return out.select(*BS, "n_window", r6("ipw_ess", 4).alias("ipw_ess"),
                      *[r6(c, 5).alias(c) for c in TL_COLS], "d10_lo", "d10_hi", "p_spec")


@query("a34_scorecard", """
SELECT batch_id, round(median(abs(e)) FILTER (step>=20),6) AS mae, round(avg(e) FILTER (step>=20),6)
 AS bias, round(any_value(e) FILTER (step=ideal),6) AS err_at_spec FROM (
 SELECT t.batch_id, t.step, hybrid_d10-d10_um AS e, min(t.step) FILTER (d10_um>=12e0) OVER (
  PARTITION BY t.batch_id) AS ideal FROM truthline t LEFT JOIN tl ON tl.batch_id=t.batch_id
  AND tl.step=t.step) GROUP BY 1""", {**TL, **TRUTH_SQL}, recursive=True)
def _(spark, sf):
    est = estimate_timeline(spark, sf, models=("hybrid",))
    return scorecard(est, truth_timeline(spark, sf), "hybrid_d10", 20, S.spec_d10_um)


def scorecard(est, truth, column, from_step, spec):
    """Median absolute error, bias and error at the ideal step of one run per batch."""
    both = N.settle(truth.join(est.select(*BS, column), BS, "left")
                    .withColumn("e", F.col(column) - F.col("d10_um")))
    ideal = V.first_crossing(both, ["batch_id"], F.col("d10_um") >= spec, "ideal")
    late = both.filter(F.col("step") >= from_step).withColumn("abs_e", F.abs("e"))
    mae = N.exact_quantiles(late, ["batch_id"], "abs_e", {"mae": 0.5})
    bias = late.groupBy("batch_id").agg(F.avg("e").alias("bias"))
    at = both.join(ideal, "batch_id").groupBy("batch_id").agg(
        F.max(F.when(F.col("step") == F.col("ideal"), F.col("e"))).alias("err_at_spec"))
    return _rounded(bias.join(mae, "batch_id", "left").join(at, "batch_id"),
                    "mae", "bias", "err_at_spec")




