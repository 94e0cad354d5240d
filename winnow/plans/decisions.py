"""Queries: bootstrap, stopping rules, diagnosis, sweeps."""

from __future__ import annotations

import math

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from winnow.functions.exprs import r6
from winnow.operators import decide as D
from winnow.operators import estimate as E
from winnow.operators import joins as J
from winnow.operators import primitives as N
from winnow.plans import estimation as Q
from winnow.plans import fixtures as X
from winnow.plans.measures import BS, TRUTH_SQL, _rounded, truth_timeline
from winnow.plans.registry import query
from winnow.plans.series import ev_steps
from winnow.settings import DEFAULTS as S
from winnow.sources import files as R

# -- bootstrap ---------------------------------------------------------------------------------------


def _poisson_sql(u: str) -> str:
    cum, arms = 0.0, []
    for k in range(E.poisson_terms()):
        cum += math.exp(-1.0) / math.factorial(k)
        arms.append(f"({u}>={cum!r}e0)::INT")
    return "(" + "+".join(arms) + ")::DOUBLE"


def _word(w: str) -> str:
    return f"('0x'||substr(d,1+8*{w},8))::UBIGINT/4294967296.0e0"


BOOT = {
    **Q.TL,
    "needed": "SELECT batch_id, step FROM hpiv WHERE d10>=12e0",
    "brow": f"""SELECT batch_id, step, class, h, v, q*4+w AS rep, {_poisson_sql(_word('w'))} AS c
 FROM (SELECT *, md5(concat_ws(':',rid,q)) AS d FROM (SELECT batch_id, step, rid, class, h, v,
  unnest(range(50)) AS q FROM erows JOIN needed USING (batch_id, step))),
 (SELECT unnest(range(4)) AS w)""",
    "bdraw": "SELECT * FROM brow WHERE c>0",
    "bfull": """SELECT k.batch_id, k.step, k.rep, e.class, lo, width, f_true, x_ref, x_obs,
 coalesce(s.n,0e0) AS n, coalesce(s.s1,0e0) AS s1, coalesce(s.s2,0e0) AS s2
 FROM (SELECT DISTINCT batch_id, step, rep FROM bdraw) k JOIN ecls e USING (batch_id, step)
 LEFT JOIN (SELECT batch_id, step, rep, class, sum(c) AS n, sum(c*h) AS s1, sum(c*h*h) AS s2
  FROM bdraw GROUP BY 1,2,3,4) s ON s.batch_id=k.batch_id AND s.step=k.step AND s.rep=k.rep
  AND s.class=e.class""",
    "bfit": """SELECT batch_id, step, rep, width, alpha, beta,
 greatest((sum(s2-2e0*t*s1+n*t*t)-sum(n)*0.65e0*0.65e0)/sum(n*t*t)-beta*beta*width*width/12e0,0e0)
  AS cv2 FROM (SELECT f.*, alpha, beta, exp(alpha+beta*x_obs) AS t FROM bfull f JOIN (
  SELECT batch_id, step, rep, beta, my-beta*mx AS alpha FROM (SELECT batch_id, step, rep, mx, my,
   CASE WHEN sum(n*(x_obs-mx)*(x_obs-mx))>0 THEN sum(n*(x_obs-mx)*(ln(s1/n)-my))
    /sum(n*(x_obs-mx)*(x_obs-mx)) ELSE 0e0 END AS beta FROM (SELECT *,
    sum(n*x_obs) OVER g/sum(n) OVER g AS mx, sum(n*ln(s1/n)) OVER g/sum(n) OVER g AS my
    FROM bfull WHERE n>0 AND s1>0 WINDOW g AS (PARTITION BY batch_id, step, rep))
   GROUP BY 1,2,3,4,5)) USING (batch_id, step, rep) WHERE n>0) GROUP BY 1,2,3,4,5,6""",
    "bcomps": """SELECT batch_id, step, rep, list({'mu':mu,'sd':mu*sqrt(cv2+beta*beta*width*width
 /12e0),'w':wm}) AS comps FROM (SELECT c.batch_id, c.step, c.rep, cv2, beta, f.width,
 exp(alpha+beta*x_ref) AS mu, f_true*(1e0-CASE WHEN n>0 THEN n/(n+20e0) ELSE 0e0 END) AS wm
 FROM bfull c JOIN bfit f USING (batch_id, step, rep)) GROUP BY 1,2,3""",
    "bpts": """SELECT d.batch_id, d.step, d.rep, v, c*CASE WHEN n>0 THEN f_true*(n/(n+20e0))/n
 ELSE 0e0 END AS w FROM bdraw d JOIN bfull f USING (batch_id, step, rep, class)""",
}
BOOT.update(Q.mixture("b", "bpts", "bcomps", "[0.1e0]", "batch_id, step, rep"))
BOOT["bint"] = """SELECT batch_id, step, quantile_cont(root,0.05) AS d10_lo,
 quantile_cont(root,0.95) AS d10_hi, avg((root>=12e0)::INT) AS p_spec FROM bmix GROUP BY 1,2"""


# every window with an estimate; the timeline bootstraps only where a rule reads the interval
BOOT_ALL = {**BOOT, "needed": "SELECT DISTINCT batch_id, step FROM ecls"}


@query("e12_bootstrap_interval", """
SELECT batch_id, step, round(d10_lo,5) AS d10_lo, round(d10_hi,5) AS d10_hi,
 round(p_spec,6) AS p_spec FROM bint""", BOOT_ALL, recursive=True)
def _(spark, sf):
    m = Q.window_model(spark, sf)
    out = E.bootstrap_interval(E.bootstrap_d10(m, ["rid"], S.bootstrap_reps), BS, S.interval,
                               S.spec_d10_um)
    return out.select(*BS, r6("d10_lo", 5).alias("d10_lo"), r6("d10_hi", 5).alias("d10_hi"),
                      r6("p_spec").alias("p_spec"))


# the same with an at-line sample as reference, whose rows are resampled too
BOOT_REF = {
    **BOOT_ALL, **Q.ATL, **Q.chain(ref="atl"),
    "bshare": f"""SELECT *, c/sum(c) OVER (PARTITION BY batch_id, step, rep) AS f FROM (
 SELECT batch_id, step, q*4+w AS rep, class, sum({_poisson_sql(_word('w'))}) AS c FROM (
  SELECT *, md5(concat_ws(':','ref',rid,q)) AS d FROM (SELECT batch_id, step, rid,
   least(greatest(floor((log_size-lo)/width),0),29)::BIGINT AS class, unnest(range(50)) AS q
   FROM atl JOIN espan USING (batch_id, step))), (SELECT unnest(range(4)) AS w) GROUP BY ALL)""",
    "bfull": BOOT["bfull"].replace("f_true", "coalesce(r.f,0e0) AS f_true")
    + """ LEFT JOIN bshare r ON r.batch_id=k.batch_id AND r.step=k.step AND r.rep=k.rep
  AND r.class=e.class"""}


@query("e12_bootstrap_at_line", """
SELECT batch_id, step, round(d10_lo,5) AS d10_lo, round(d10_hi,5) AS d10_hi,
 round(p_spec,6) AS p_spec FROM bint""", BOOT_REF, recursive=True)
def _(spark, sf):
    sample = N.settle(Q.atline(spark, sf))
    with X.made_once(sf, "bed"):
        m = E.WindowModel(Q.window_rows(spark, sf), sample, BS, S)
    out = E.bootstrap_interval(E.bootstrap_d10(m, ["rid"], S.bootstrap_reps, (sample, ["rid"])), BS,
                               S.interval, S.spec_d10_um)
    return out.select(*BS, r6("d10_lo", 5).alias("d10_lo"), r6("d10_hi", 5).alias("d10_hi"),
                      r6("p_spec").alias("p_spec"))


#: Objects a certificate stands for.
CERTIFIED = 150


@query("e12_bootstrap_certificate")
def _(spark, sf):
    with X.made_once(sf, "bed"):
        rows = N.settle(Q.window_rows(spark, sf))
    m = E.WindowModel(rows, N.settle(Q.certificate(spark, sf, rows)), BS, S)
    out = E.bootstrap_interval(E.bootstrap_d10(m, ["rid"], S.bootstrap_reps, n_effective=CERTIFIED),
                               BS, S.interval, S.spec_d10_um)
    return _rounded(out, "d10_lo", "d10_hi", "p_spec")


PLAIN = {
    **Q.IPW,
    "pdraw": f"""SELECT * FROM (SELECT batch_id, step, class, h, q*4+w AS rep,
  {_poisson_sql(_word('w'))} AS c FROM (SELECT *, md5(concat_ws(':',rid,q)) AS d FROM (
   SELECT batch_id, step, rid, class, h, unnest(range({S.bootstrap_reps // 4})) AS q FROM erow)),
  (SELECT unnest(range(4)) AS w)) WHERE c>0""",
    "praw": """SELECT batch_id, step, rep, quantile_cont(h,0.1) AS d10 FROM (
 SELECT batch_id, step, rep, h, unnest(range(c::BIGINT)) AS i FROM pdraw) GROUP BY 1,2,3""",
    "pipw": """SELECT batch_id, step, rep, min(h) FILTER (cum>=0.1e0*tot-1e-12) AS d10 FROM (
 SELECT *, sum(w) OVER (PARTITION BY batch_id, step, rep ORDER BY h) AS cum,
  sum(w) OVER (PARTITION BY batch_id, step, rep) AS tot FROM (SELECT d.*,
  c*(f_true/sum(c) OVER (PARTITION BY batch_id, step, rep, class)) AS w FROM pdraw d
  JOIN ecls USING (batch_id, step, class))) GROUP BY 1,2,3"""}
_PLAIN_SQL = """SELECT batch_id, step, round(quantile_cont(d10,0.05)+1e-9,6) AS d10_lo,
 round(quantile_cont(d10,0.95)+1e-9,6) AS d10_hi, round(avg((d10>=12e0)::INT),6) AS p_spec FROM {}
GROUP BY 1,2"""


def _plain_interval(d10):
    out = E.bootstrap_interval(d10, BS, S.interval, S.spec_d10_um)
    return out.select(*BS, r6(F.col("d10_lo") + 1e-9).alias("d10_lo"),
                      r6(F.col("d10_hi") + 1e-9).alias("d10_hi"), r6("p_spec").alias("p_spec"))


@query("e12_bootstrap_raw", _PLAIN_SQL.format("praw"), PLAIN)
def _(spark, sf):
    with X.made_once(sf, "bed"):
        rows = N.settle(Q.window_rows(spark, sf))
    return _plain_interval(E.bootstrap_raw_d10(rows, BS, ["rid"], S.bootstrap_reps))


@query("e12_bootstrap_ipw", _PLAIN_SQL.format("pipw"), PLAIN)
def _(spark, sf):
    with X.made_once(sf, "bed"):
        window = N.settle(Q.window_rows(spark, sf))
    rows, table = E.size_classes(window, N.settle(Q.exact_reference(spark, sf)), BS,
                                 S.size_classes)
    return _plain_interval(E.bootstrap_ipw_d10(rows, table, BS, ["rid"],
                                               S.bootstrap_reps))


@query("e13_bootstrap_pruning", """
SELECT batch_id, count(*) AS windows, count(*) FILTER (d10>=12e0) AS needed,
 min(step) FILTER (d10>=12e0) AS first_needed FROM hpiv GROUP BY 1""", Q.TL, recursive=True)
def _(spark, sf):
    m = Q.window_model(spark, sf, keys=())
    d10 = E.mixture_quantiles(m.rows, m.hybrid, BS, {"d10": 0.1})
    hit = F.col("d10") >= S.spec_d10_um
    return d10.groupBy("batch_id").agg(
        F.count("*").alias("windows"), F.count_if(hit).alias("needed"),
        F.min(F.when(hit, F.col("step"))).alias("first_needed"))


# -- stopping rules -------------------------------------------------------------------------------------


def sprayed(spark, sf):
    """Running object count per batch as the sprayed amount, with its target."""
    per = X.bed(spark, sf).groupBy(*BS).agg(F.count("*").alias("n"))
    upto = W.partitionBy("batch_id").orderBy("step")
    return per.select(*BS, F.sum("n").over(upto).cast("double").alias("sprayed_g"),
                      (F.lit(0.8) * F.sum("n").over(W.partitionBy("batch_id")))
                      .alias("target_g"))


DEC = {
    **BOOT, **TRUTH_SQL,
    "sprayed": """SELECT batch_id, step, sum(n) OVER (PARTITION BY batch_id ORDER BY step)::DOUBLE
 AS sprayed_g, 0.8e0*sum(n) OVER (PARTITION BY batch_id) AS target_g FROM (
 SELECT batch_id, step, count(*) AS n FROM bed GROUP BY 1,2)""".replace(
        "ORDER BY step)::DOUBLE", "ORDER BY step)"),
    "tlp": "SELECT tl.*, d10_lo, d10_hi, p_spec FROM tl LEFT JOIN bint USING (batch_id, step)",
    "stopw": """SELECT s.batch_id, min(s.step) FILTER (sprayed_g>=target_g) AS c0,
 min(s.step) FILTER (n_window>=100 AND raw_mean>=16e0) AS c1,
 min(s.step) FILTER (n_window>=100 AND raw_d10>=12e0) AS c2,
 min(s.step) FILTER (n_window>=100 AND p_spec>0.95e0 AND hybrid_cv<0.3e0
  AND undecided_rate<0.2e0) AS c3
 FROM sprayed s LEFT JOIN tlp t ON t.batch_id=s.batch_id AND t.step=s.step GROUP BY 1""",
    "stopl": """SELECT batch_id, 'C0' AS rule, c0 AS stop FROM stopw UNION ALL
 SELECT batch_id, 'C1', c1 FROM stopw UNION ALL SELECT batch_id, 'C2', c2 FROM stopw UNION ALL
 SELECT batch_id, 'C3', c3 FROM stopw""",
    "tstate": "SELECT t.*, sprayed_g FROM truthline t JOIN sprayed USING (batch_id, step)",
    "tends": """SELECT batch_id, max(step) AS last, min(step) FILTER (d10_um>=12e0) AS ideal
 FROM tstate GROUP BY 1""",
    "outc": """SELECT s.batch_id, s.rule, stop IS NOT NULL AS stopped, t.step, ideal,
 100e0*t.frac_below_spec AS true_below_spec_pct, t.d10_um AS true_d10_um,
 t.mean_um AS true_mean_um, CASE WHEN stop IS NOT NULL THEN CASE WHEN rule IN ('C1','C2')
  THEN raw_d10 WHEN rule='C3' THEN hybrid_d10 END END AS believed_d10_um,
 100e0*(t.sprayed_g/i.sprayed_g-1e0) AS excess_coating_pct, t.agglomerate_pct
 FROM stopl s JOIN tends e USING (batch_id) JOIN tstate t ON t.batch_id=s.batch_id
 AND t.step=coalesce(stop,last) LEFT JOIN tstate i ON i.batch_id=s.batch_id AND i.step=ideal
 LEFT JOIN tlp p ON p.batch_id=s.batch_id AND p.step=t.step"""}


def decided(spark, sf):
    """Timeline with intervals where needed, sprayed amounts, and the four stops."""
    est = N.settle(Q.estimate_timeline(spark, sf, bootstrap="needed", models=("raw", "hybrid")))
    spray = sprayed(spark, sf)
    return est, spray, D.stop_steps(est, spray, S)


@query("d1_stopping_rules", "SELECT batch_id, rule, stop FROM stopl", DEC, recursive=True)
def _(spark, sf):
    return decided(spark, sf)[2]


@query("d2_rule_outcome", """SELECT batch_id, rule, stopped, step, ideal,
 round(true_below_spec_pct,6) AS true_below_spec_pct, round(true_d10_um,6) AS true_d10_um,
 round(true_mean_um,6) AS true_mean_um, round(believed_d10_um,5) AS believed_d10_um,
 round(excess_coating_pct,6) AS excess_coating_pct, round(agglomerate_pct,6) AS agglomerate_pct
 FROM outc""", DEC, recursive=True)
def _(spark, sf):
    est, spray, stops = decided(spark, sf)
    out = D.outcomes(stops, est, truth_timeline(spark, sf), spray, S.spec_d10_um)
    return _rounded(out, "true_below_spec_pct", "true_d10_um", "true_mean_um",
                    "excess_coating_pct", "agglomerate_pct").withColumn(
        "believed_d10_um", r6("believed_d10_um", 5))


@query("d3_rule_comparison", """SELECT batch_id, CASE WHEN NOT ok THEN 'not comparable'
 WHEN abs(gap)<0.4e0 THEN 'agree' WHEN gap<0 THEN 'raw early' ELSE 'raw late' END AS verdict,
 CASE WHEN ok THEN round(b2/b3,6) END AS below_ratio FROM (SELECT a.batch_id,
 a.stopped AND b.stopped AND b.true_below_spec_pct>0 AS ok, a.true_d10_um-b.true_d10_um AS gap,
 a.true_below_spec_pct AS b2, b.true_below_spec_pct AS b3 FROM outc a JOIN outc b
 USING (batch_id) WHERE a.rule='C2' AND b.rule='C3')""", DEC, recursive=True)
def _(spark, sf):
    est, spray, stops = decided(spark, sf)
    out = D.outcomes(stops, est, truth_timeline(spark, sf), spray, S.spec_d10_um)
    return _rounded(D.compare_rules(out), "below_ratio")


# -- diagnosis ------------------------------------------------------------------------------------------
#: fixed values: healthy behaviour of the recipe, and the limits of the rules
RECIPE = {"growth": 0.3, "core_um": 700.0, "spread2": 0.05, "spread_ratio": 1.2}
LIMITS = {"growth_low": 0.85, "agglomerate_high": 3.0, "fines_high": 1.05, "spread_high": 1.6,
          "undecided_high": 0.06, "core_shift": 30.0}

DIAG = {
    **Q.TL,
    "dinput": """SELECT t.batch_id, t.step, raw_mean AS coat_um, gate_twin_pct AS twin_pct,
 coalesce(n_fines/360e0,0e0) AS fines, cv2_within_unclipped AS cv2, undecided_rate, ref_median_um
 FROM tl t LEFT JOIN estep e ON e.instrument=t.batch_id AND e.step=t.step""",
    "dsig0": """SELECT batch_id, step, step+1>20 AS ready,
 CASE WHEN count(coat_um) OVER w>=3 THEN regr_slope(coat_um, (step-40)::DOUBLE) OVER w END
  /(0.3e0/power(1e0+2e0/700e0*coalesce(coat_um,0e0),2e0)) AS growth_ratio,
 avg(twin_pct) OVER w AS agglomerate_pct, avg(fines) OVER w AS f,
 avg(fines) FILTER (step+1<=10) OVER (PARTITION BY batch_id) AS base,
 CASE WHEN step+1>=30 THEN sqrt(greatest(avg(cv2*(step+1)) OVER w,0e0)/0.05e0)/1.2e0 END
  AS spread_ratio, undecided_rate, avg(ref_median_um-2e0*coat_um) OVER w-700e0 AS core_shift_um
 FROM dinput WINDOW w AS (PARTITION BY batch_id ORDER BY step ROWS 9 PRECEDING)""",
    "dsig": """SELECT *, CASE WHEN base<>0 THEN f/base END AS fines_ratio FROM dsig0""",
    "dflag0": """SELECT *, coalesce(growth_ratio<0.85e0,false) AS low,
 coalesce(agglomerate_pct>3e0,false) AS wet, coalesce(fines_ratio>1.05e0,false) AS fine FROM dsig""",
    "dflag": """SELECT batch_id, step, ready AND wet AS over_wetting,
 ready AND fine AND low AS spray_drying, ready AND low AND NOT fine AND NOT wet AS nozzle_block,
 ready AND coalesce(spread_ratio>1.6e0,false) AND NOT wet AS maldistribution,
 ready AND coalesce(undecided_rate>0.06e0,false) AS window_fouling,
 ready AND coalesce(core_shift_um>30e0,false) AS substrate_shift FROM dflag0"""}


def signals(spark, sf, est=None):
    """Diagnosis signals of a timeline with raw estimates; without one it is made."""
    if est is None:
        est = Q.estimate_timeline(spark, sf, models=("raw",))
    fines = ev_steps(spark, sf).select(F.col("instrument").alias("batch_id"), "step",
                                       (F.col("n_fines") / 360.0).alias("fines"))
    per = N.settle(est.join(fines, BS, "left").select(
        *BS, F.col("raw_mean").alias("coat_um"), F.col("gate_twin_pct").alias("twin_pct"),
        F.coalesce("fines", F.lit(0.0)).alias("fines"),
        F.col("cv2_within_unclipped").alias("cv2"), "undecided_rate", "ref_median_um"))
    return D.diagnosis_signals(per, ["batch_id"], 10, 10, 30, RECIPE)


_SIG = ("growth_ratio", "agglomerate_pct", "fines_ratio", "spread_ratio", "undecided_rate",
        "core_shift_um")


@query("d4_diagnosis_signals", "SELECT batch_id, step, ready, "
       + ", ".join(f"round({c},5) AS {c}" for c in _SIG) + " FROM dsig", DIAG, recursive=True)
def _(spark, sf):
    return signals(spark, sf).select(*BS, "ready", *[r6(c, 5).alias(c) for c in _SIG])


_FAULTS = list(D.FAULTS)


@query("d5_fault_rules", f"SELECT batch_id, step, {', '.join(_FAULTS)} FROM dflag", DIAG,
       recursive=True)
def _(spark, sf):
    return D.fault_flags(signals(spark, sf), LIMITS).select(*BS, *_FAULTS)


@query("j5_signals_and_verdicts", f"""SELECT batch_id, step, round(growth_ratio,5) AS growth_ratio,
 {', '.join(_FAULTS)} FROM dsig JOIN dflag USING (batch_id, step)""", DIAG, recursive=True)
def _(spark, sf):
    sig = N.settle(signals(spark, sf))
    verdict = D.fault_flags(sig, LIMITS).select(*BS, *_FAULTS)
    return sig.select(*BS, r6("growth_ratio", 5).alias("growth_ratio")).join(verdict, BS)


@query("d6_fault_history", "SELECT batch_id, fault, first_step, at_end FROM ("
       + " UNION ALL ".join(
           f"SELECT batch_id, '{f}' AS fault, min(step) FILTER "
           f"({f}) AS first_step, arg_max({f}, step) AS at_end FROM dflag GROUP BY 1"
           for f in D.FAULTS) + ")", DIAG, recursive=True)
def _(spark, sf):
    return D.fault_history(D.fault_flags(signals(spark, sf), LIMITS))


@query("d7_parameter_sweep", """
SELECT batch_id, spec, smooth, stop, ideal, round(coalesce(t1.d10_um, t2.d10_um),6)
  AS true_d10_um, round(coalesce(t1.frac_below_spec, t2.frac_below_spec),6) AS below
FROM (SELECT c.batch_id, spec, smooth, min(c.step) FILTER (lvl>=spec) AS stop,
  min(c.step) FILTER (d10_um>=spec) AS ideal, max(c.step) AS last FROM (
  SELECT r.batch_id, r.step, g.spec, g.smooth, CASE g.smooth WHEN 1 THEN raw_d10
   WHEN 2 THEN m2 ELSE m4 END AS lvl FROM (SELECT batch_id, step, raw_d10,
    CASE WHEN count(raw_d10) OVER a=2 THEN avg(raw_d10) OVER a END AS m2,
    CASE WHEN count(raw_d10) OVER b=4 THEN avg(raw_d10) OVER b END AS m4 FROM tl
    WINDOW a AS (PARTITION BY batch_id ORDER BY step ROWS 1 PRECEDING),
     b AS (PARTITION BY batch_id ORDER BY step ROWS 3 PRECEDING)) r,
   (SELECT spec, smooth FROM (SELECT unnest([8e0,10e0,12e0,14e0]) AS spec),
    (SELECT unnest([1,2,4]) AS smooth)) g) c
  JOIN truthline t ON t.batch_id=c.batch_id AND t.step=c.step GROUP BY 1,2,3)
 LEFT JOIN (SELECT batch_id, step AS stop, d10_um, frac_below_spec FROM truthline) t1
  USING (batch_id, stop)
 LEFT JOIN (SELECT batch_id, step AS last, d10_um, frac_below_spec FROM truthline) t2
  USING (batch_id, last)""", {**Q.TL, **TRUTH_SQL}, recursive=True)
def _(spark, sf):
    est = N.settle(Q.estimate_timeline(spark, sf, models=("raw",)).select(*BS, "raw_d10"))
    cases = J.case_grid(spark, {"spec": (8.0, 10.0, 12.0, 14.0), "smooth": (1, 2, 4)})
    return _rounded(D.sweep_rules(est, truth_timeline(spark, sf), cases, "raw_d10"),
                    "true_d10_um", "below")


SWEEP = {"min_objects": (100.0, 200.0), "target_mean_um": (14.0, 16.0, 18.0),
         "spec_d10_um": (10.0, 12.0), "p_spec_min": (0.5, 0.95)}
_CASES = ", ".join(SWEEP)
_GCASES = ", ".join(f"g.{c}" for c in SWEEP)
SWP = {
    **DEC,
    "needed": f"SELECT batch_id, step FROM hpiv WHERE d10>={min(SWEEP['spec_d10_um'])!r}e0",
    "swspec": """SELECT m.batch_id, m.step, spec_d10_um, avg((root>=spec_d10_um)::INT) AS pr
 FROM bmix m JOIN hpiv h ON h.batch_id=m.batch_id AND h.step=m.step JOIN (
 SELECT DISTINCT spec_d10_um FROM swgrid) ON d10>=spec_d10_um GROUP BY 1,2,3""",
    "swgrid": "SELECT * FROM " + ", ".join(
        f"(SELECT unnest({[float(v) for v in vs]}::DOUBLE[]) AS {c})" for c, vs in SWEEP.items()),
    "swstop": f"""SELECT s.batch_id, {_GCASES}, min(s.step) FILTER (sprayed_g>=target_g) AS c0,
 min(s.step) FILTER (n_window>=min_objects AND raw_mean>=target_mean_um) AS c1,
 min(s.step) FILTER (n_window>=min_objects AND raw_d10>=g.spec_d10_um) AS c2,
 min(s.step) FILTER (n_window>=min_objects AND pr>p_spec_min AND hybrid_cv<0.3e0
  AND undecided_rate<0.2e0) AS c3 FROM sprayed s CROSS JOIN swgrid g
 LEFT JOIN tl t ON t.batch_id=s.batch_id AND t.step=s.step LEFT JOIN swspec w
 ON w.batch_id=s.batch_id AND w.step=s.step AND w.spec_d10_um=g.spec_d10_um GROUP BY ALL""",
    "swlong": " UNION ALL ".join(
        f"SELECT batch_id, {_CASES}, '{r}' AS rule, {r.lower()} AS stop FROM swstop"
        for r in D.RULES)}


@query("d7_rule_sweep", f"""
SELECT {_CASES}, rule, count(*) AS batches, count(stop) AS stops,
 round(avg(100e0*t.frac_below_spec),6) AS true_below_spec_pct,
 round(avg(t.d10_um),6) AS true_d10_um,
 round(avg(100e0*(t.sprayed_g/i.sprayed_g-1e0)),6) AS excess_coating_pct
FROM swlong s JOIN tends e USING (batch_id) JOIN tstate t ON t.batch_id=s.batch_id
 AND t.step=coalesce(stop,last) LEFT JOIN tstate i ON i.batch_id=s.batch_id AND i.step=ideal
GROUP BY ALL""", SWP, recursive=True)
def _(spark, sf):
    est, spray = _sweep_input(spark, sf)
    stops = D.sweep_stops(est, spray, J.case_grid(spark, SWEEP), S)
    out = D.outcomes(stops, est, truth_timeline(spark, sf), spray, S.spec_d10_um,
                     keep=list(SWEEP))
    return _rounded(D.scorecard(out, list(SWEEP)), "true_below_spec_pct", "true_d10_um",
                    "excess_coating_pct")


def _sweep_input(spark, sf):
    """Timeline with the replicates of every window that the lowest specification lets in."""
    est = Q.estimate_timeline(spark, sf, models=("raw", "hybrid"),
                              replicates_from=min(SWEEP["spec_d10_um"]))
    return N.settle(est), N.settle(sprayed(spark, sf))


@query("d7_sweep_resume", f"""
SELECT {_CASES}, rule, count(stop) AS stops, sum(stop) AS total,
 CASE WHEN spec_d10_um={min(SWEEP['spec_d10_um'])!r}e0 THEN 1 ELSE 2 END AS run
FROM swlong GROUP BY ALL""", SWP, recursive=True)
def _(spark, sf):
    est, spray = _sweep_input(spark, sf)
    grid = J.case_grid(spark, SWEEP)
    folder, made = R.scratch(spark, "sweep"), "case_key string, " + ", ".join(
        f"{c} double" for c in SWEEP) + ", rule string, stops bigint, total bigint, run int"

    def run(number, cases):
        """One run: reads what is stored, computes the rest, stores it."""
        cases = cases.withColumn("case_key", R.content_key(list(SWEEP), 1))
        stored = R.load_result_set(spark, folder, made, "stops", "sweep", 1)
        done, new = D.sweep_resumed(cases, stored, "case_key", lambda todo: D.sweep_stops(
            est, spray, todo.select(*SWEEP), S).groupBy(*SWEEP, "rule").agg(
            F.count("stop").alias("stops"), F.sum("stop").alias("total")).join(
            todo, list(SWEEP)).select("case_key", *SWEEP, "rule", "stops", "total",
                                      F.lit(number).alias("run")))
        R.save_result_set({"stops": done}, folder, "sweep", 1)
        return done

    run(1, grid.filter(F.col("spec_d10_um") == min(SWEEP["spec_d10_um"])))
    return run(2, grid).drop("case_key")


_SG, _DG = (0.88, 0.9, 0.92, 0.94, 0.96), (0.08, 0.12, 0.16, 0.19)


@query("d8_threshold_grid", f"""
SELECT a_min, b_max, round(recall,6) AS recall, round(false_rate,6) AS false_rate FROM (
 SELECT a_min, b_max, avg((solidity<a_min OR defect>b_max)::INT) FILTER (truth=1) AS recall,
  avg((solidity<a_min OR defect>b_max)::INT) FILTER (truth=0) AS false_rate
 FROM pred, (SELECT unnest({[float(v) for v in _SG]}::DOUBLE[]) AS a_min),
  (SELECT unnest({[float(v) for v in _DG]}::DOUBLE[]) AS b_max) GROUP BY 1,2)
WHERE false_rate<=0.6e0 ORDER BY recall DESC, a_min, b_max LIMIT 1""")
def _(spark, sf):
    out = D.tune_pair_rule(X.pred(spark, sf), F.col("truth"), "solidity", "defect", _SG, _DG,
                           0.6)
    return _rounded(out, "recall", "false_rate")
