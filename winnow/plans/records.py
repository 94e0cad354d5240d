"""Queries: instrument monitoring, logs, sources, scan geometry and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from winnow.functions.exprs import r6, ratio
from winnow.operators import decide as D
from winnow.operators import geometry as G
from winnow.operators import logs as L
from winnow.operators import monitor as M
from winnow.operators import primitives as N
from winnow.operators import windows as V
from winnow.plans import decisions as Q
from winnow.plans import fixtures as X
from winnow.plans.fixtures import u_duck, u_spark
from winnow.plans.measures import BS, _F7, _PAIRS, _rounded
from winnow.plans.registry import query
from winnow.plans.series import ev_steps
from winnow.plans.sqlparts import canonical_sql
from winnow.settings import DEFAULTS as S
from winnow.sources import files as R
from winnow.streaming import operators as T

# -- monitoring -------------------------------------------------------------------------------------


def _limit_sql(p: int) -> dict[str, str]:
    """Control limit from the beta quantile: Simpson's rule in u = sqrt(z), then bisection."""
    a, b = f"{p / 2!r}e0", f"((nb-{p})/2e0)"
    u = "(k*sqrt((lo+hi)/2e0)/2000e0)"
    area = (f"list_sum(list_transform(range(0,2001), lambda k: CASE WHEN k IN (0,2000) THEN 1e0"
            f" WHEN k%2=1 THEN 4e0 ELSE 2e0 END*2e0*pow({u},{p - 1})*pow(1e0-{u}*{u},{b}-1e0)))"
            f"*sqrt((lo+hi)/2e0)/6000e0*exp(lgamma({a}+{b})-lgamma({a})-lgamma({b}))")
    return {
        "fbis": f"""SELECT 0 AS i, 0e0 AS lo, 1e0 AS hi, nb FROM fcov UNION ALL
 SELECT i+1, CASE WHEN cdf<{S.t2_confidence} THEN (lo+hi)/2e0 ELSE lo END,
 CASE WHEN cdf<{S.t2_confidence} THEN hi ELSE (lo+hi)/2e0 END, nb
 FROM (SELECT *, {area} AS cdf FROM fbis WHERE i<60)""",
        "flim": "SELECT (nb+1e0)*(nb-1e0)/nb*hi/(1e0-hi) AS lim FROM fbis WHERE i=60"}


def _t2_sql() -> dict[str, str]:
    """T-squared by forward substitution on a Cholesky factor written out column by column."""
    p = len(_F7)
    cov = "SELECT count(*) AS nb, " + ", ".join(f"avg({c}) AS m{i}" for i, c in enumerate(_F7)) + ", " + ", ".join(
        f"covar_samp({a},{b}) AS c{_F7.index(b)}{_F7.index(a)}" for a, b in _PAIRS
    ) + " FROM feat WHERE baseline"
    tr = "+".join(f"c{i}{i}" for i in range(p))
    cols = [f"({tr})*1e-9/{p} AS ridge"]
    for j in range(p):
        for i in range(j, p):
            s = "".join(f"-l{i}{k}*l{j}{k}" for k in range(j))
            cols.append(f"sqrt(c{j}{j}+ridge{s}) AS l{j}{j}" if i == j
                        else f"(c{i}{j}{s})/l{j}{j} AS l{i}{j}")
    y = []
    for i, c in enumerate(_F7):
        s = "".join(f"-l{i}{k}*y{k}" for k in range(i))
        y.append(f"({c}-m{i}{s})/l{i}{i} AS y{i}")
    t2 = "+".join(f"y{i}*y{i}" for i in range(p)) + " AS t2"
    return {**_limit_sql(p), "fcov": cov, "fchol": f"SELECT *, {', '.join(cols)} FROM fcov",
            "ft2": f"SELECT vec_id, label, baseline, f4, m3, {', '.join(y)}, {t2} FROM feat, fchol"}


T2 = _t2_sql()


@query("m1_hotelling_baseline", "SELECT nb AS n, round(lim,4) AS t2_limit, "
       + ", ".join(f"round(m{i},6) AS mean_{c}" for i, c in enumerate(_F7))
       + " FROM fcov, flim", T2, recursive=True)
def _(spark, sf):
    b = M.fit_baseline(X.feat(spark, sf).filter("baseline"), _F7, S)
    return spark.range(1).select(
        F.lit(b.n).cast("bigint").alias("n"), F.lit(round(b.t2_limit, 4)).alias("t2_limit"),
        *[F.lit(round(v, 6)).alias(f"mean_{c}") for c, v in zip(b.features, b.mean)])


@query("m2_hotelling_t2", "SELECT vec_id, round(t2,5) AS t2 FROM ft2", T2)
def _(spark, sf):
    df = X.feat(spark, sf)
    b = M.fit_baseline(df.filter("baseline"), _F7, S)
    return df.select("vec_id", r6(M.hotelling_t2(b), 5).alias("t2"))


M3 = {**T2,
      "mseq": f"""SELECT label, vec_id, f4, (t2>(SELECT lim FROM flim))::INT AS x,
 ({u_duck('und', 'vec_id')}<0.08e0)::INT AS u, m3 AS base,
 row_number() OVER (PARTITION BY label ORDER BY vec_id) AS r FROM ft2""",
      "mew": """SELECT label, vec_id, r, base, 0.02e0*x+0.98e0*0.01e0 AS e, 0.02e0*u AS n,
  0.02e0*f4+0.98e0*base AS f FROM mseq WHERE r=1
  UNION ALL SELECT s.label, s.vec_id, s.r, s.base, 0.02e0*s.x+0.98e0*w.e, 0.02e0*s.u+0.98e0*w.n,
  0.02e0*s.f4+0.98e0*w.f FROM mew w JOIN mseq s ON s.label=w.label AND s.r=w.r+1"""}


@query("m3_drift_state", """
SELECT vec_id, round(e,6) AS exceed_rate, round(n,6) AS undecided_rate,
 round(base-f,6) AS reflector_drop, ['OK','Warning','Alarm'][1+greatest(
  CASE WHEN e>=0.2e0 THEN 2 WHEN e>=0.05e0 THEN 1 ELSE 0 END,
  CASE WHEN n>=0.2e0 THEN 2 WHEN n>=0.1e0 THEN 1 ELSE 0 END,
  CASE WHEN base-f>=3e0 THEN 2 WHEN base-f>=1.5e0 THEN 1 ELSE 0 END)] AS state FROM mew""", M3,
       recursive=True)
def _(spark, sf):
    df = X.feat(spark, sf)
    b = M.fit_baseline(df.filter("baseline"), _F7, S)
    seq = df.select("label", "vec_id", "f4",
                    (M.hotelling_t2(b) > b.t2_limit).cast("double").alias("x"),
                    F.expr(f"cast({u_spark('und', 'vec_id')}<0.08e0 as double)").alias("u"))
    out = M.drift_state(seq, ["label"], "vec_id", ["vec_id"], "x", "u", "f4", b.mean[3], S)
    return _rounded(out.select("vec_id", "exceed_rate", "undecided_rate", "reflector_drop",
                               "state"), "exceed_rate", "undecided_rate", "reflector_drop")


def _rates(spark, sf):
    und = V.rolling_sum("n_undecided", ["instrument"], 5)
    single = V.rolling_sum("n_single", ["instrument"], 5)
    return ev_steps(spark, sf).select("instrument", "step",
                                      ratio(und.cast("double"), single).alias("rate"))


RATES = {"erate": """SELECT instrument, step, sum(n_undecided) OVER w
 /nullif(sum(n_single) OVER w,0) AS rate FROM estep
 WINDOW w AS (PARTITION BY instrument ORDER BY step ROWS 4 PRECEDING)""",
         "estate": """SELECT instrument, step, ['OK','Warning','Alarm'][1+CASE
 WHEN coalesce(rate,0e0)>=0.35e0 THEN 2 WHEN coalesce(rate,0e0)>=0.3e0 THEN 1 ELSE 0 END] AS state
 FROM erate"""}


def _rate_states(spark, sf):
    from winnow.functions.exprs import state_name

    return _rates(spark, sf).select("instrument", "step", state_name(
        V.rate_state(F.col("rate"), (0.3, 0.35))).alias("state"))


@query("m4_rate_state", "SELECT instrument, step, state FROM estate", RATES)
def _(spark, sf):
    return _rate_states(spark, sf)


@query("m5_alarm_before_error", """
SELECT instrument, first_warning, first_alarm, first_bad, CASE WHEN first_bad IS NULL THEN
 'no bad reading' WHEN first_alarm<first_bad THEN 'alarm first' ELSE 'error first' END AS verdict
FROM (SELECT instrument, min(step) FILTER (state='Warning') AS first_warning,
 min(step) FILTER (state='Alarm') AS first_alarm FROM estate GROUP BY 1) LEFT JOIN
 (SELECT instrument, min(step) AS first_bad FROM ev WHERE accepted AND value>200e0 GROUP BY 1)
 USING (instrument)""", RATES)
def _(spark, sf):
    bad = (X.ev(spark, sf).filter("accepted and value > 200e0").groupBy("instrument", "step")
           .agg(F.lit(True).alias("bad")))
    states = _rate_states(spark, sf).join(bad, ["instrument", "step"], "left")
    return M.alarm_before_error(states, ["instrument"], "state",
                                F.coalesce("bad", F.lit(False)))


# -- logs -----------------------------------------------------------------------------------------------
_BODY = ("role", "text")
_SHA = f"sha256({canonical_sql({'role': 'role', 'text': 'text'})})"


def _link(seq: str, prev: str, body: str, log: str = "log_id") -> str:
    return "sha256(" + canonical_sql({"log": log, "seq": seq, "prev": prev, "body": body}) + ")"


LOGS = {"lbody": f"SELECT log_id, seq, role, text, {_SHA} AS body FROM logs",
        "lchain": f"""SELECT log_id, seq, repeat('0',64) AS prev_hash,
  {_link('seq', "repeat('0',64)", 'body')} AS hash FROM lbody WHERE seq=1
  UNION ALL SELECT b.log_id, b.seq, c.hash, {_link('b.seq', 'c.hash', 'b.body', 'b.log_id')}
  FROM lchain c JOIN lbody b ON b.log_id=c.log_id AND b.seq=c.seq+1""",
        "ltamper": """SELECT l.log_id, l.seq, l.role, CASE WHEN l.log_id%7=0 AND l.seq=2 THEN
  l.text||'x' ELSE l.text END AS text, CASE WHEN l.log_id%5=0 AND l.seq=3 THEN repeat('1',64)
  ELSE prev_hash END AS prev_hash, hash FROM logs l JOIN lchain USING (log_id, seq)
  WHERE NOT (l.log_id%11=3 AND l.seq=2)""",
        "lcheck": f"""SELECT log_id, pos, hash, CASE WHEN seq<>pos THEN 'number'
  WHEN prev_hash<>before THEN 'link' WHEN hash<>{_link('seq', 'prev_hash', _SHA)} THEN 'content'
  END AS bad
  FROM (SELECT *, row_number() OVER w AS pos, coalesce(lag(hash) OVER w,repeat('0',64)) AS before
   FROM ltamper WINDOW w AS (PARTITION BY log_id ORDER BY seq))"""}


def chained(spark, sf):
    return N.settle(L.append_chain(X.log(spark, sf), "log_id", "seq", L.row_digest(_BODY)))


@query("l1_chain_verification", """
SELECT log_id, count(*) AS entries, min(pos) FILTER (bad IS NOT NULL) AS first_bad_seq,
 arg_min(bad,pos) FILTER (bad IS NOT NULL) AS problem, arg_max(hash,pos) AS latest,
 count(bad)=0 AS ok FROM lcheck GROUP BY 1""", LOGS, recursive=True)
def _(spark, sf):
    bad = chained(spark, sf).filter("not (log_id % 11 = 3 and seq = 2)").withColumn(
        "text", F.expr("case when log_id % 7 = 0 and seq = 2 then concat(text,'x') else text end")
    ).withColumn("prev_hash", F.expr(
        "case when log_id % 5 = 0 and seq = 3 then repeat('1',64) else prev_hash end"))
    return L.verify_chain(bad.withColumn("line", F.col("seq")), "log_id", "line",
                          L.row_digest(_BODY))


@query("l2_chain_append", "SELECT log_id, seq, prev_hash, hash FROM lchain", LOGS,
       recursive=True)
def _(spark, sf):
    return chained(spark, sf).select("log_id", "seq", "prev_hash", "hash")


# attempts to sign every entry of the logs: some with a wrong meaning, reason, user or proof
_MEANINGS, _REASONS = ("user", "assistant"), ("r0", "r1", "r2")
_ATTEMPT = ["log_id", "seq", "text", "concat('u',(log_id*3+seq)%5) as user_name",
            "case when (log_id+seq)%5=0 then 'close' else role end as meaning",
            "concat('r',seq%4) as reason_code", "(log_id*5+seq)%13=0 as forged"]
_DECIDED = {c: c for c in ("text", *L.DECISION)}
SIGNED = {"attempts": f"SELECT {', '.join(_ATTEMPT)} FROM logs",
          "sbody": f"""SELECT *, sha256({canonical_sql(_DECIDED)}) AS body FROM (SELECT *,
  CASE WHEN problem IS NULL THEN meaning ELSE '{L.REFUSED}' END AS action FROM (SELECT *,
  CASE WHEN user_name='u4' THEN 'unknown' WHEN user_name IN ('u0','u2') THEN 'operator'
   ELSE 'lead' END AS role, CASE WHEN meaning NOT IN {_MEANINGS} THEN 'meaning'
   WHEN reason_code NOT IN {_REASONS} THEN 'reason' WHEN user_name='u4' THEN 'user'
   WHEN forged THEN 'credential' END AS problem FROM attempts))""",
          "schain": f"""SELECT log_id, seq, repeat('0',64) AS prev_hash,
  {_link('seq', "repeat('0',64)", 'body')} AS hash FROM sbody WHERE seq=1
  UNION ALL SELECT b.log_id, b.seq, c.hash, {_link('b.seq', 'c.hash', 'b.body', 'b.log_id')}
  FROM schain c JOIN sbody b ON b.log_id=c.log_id AND b.seq=c.seq+1"""}


def signed(spark, sf):
    """The hash chain over accepted and refused attempts, and its check."""
    accounts = spark.range(4).selectExpr(
        "concat('u',id) as user_name", "if(id%2=0,'operator','lead') as account_role",
        "sha2(concat('key of u',id),256) as credential")
    attempts = X.log(spark, sf).selectExpr(*_ATTEMPT).withColumn("proof", F.expr(
        "if(forged, 'x', sha2(concat('key of ',user_name),256))")).drop("forged")
    chain = N.settle(L.signed_log(attempts, accounts, _MEANINGS, _REASONS, "log_id", "seq",
                                  ["text"]))
    return chain, L.verify_chain(chain.withColumn("line", F.col("seq")), "log_id", "line",
                                 L.row_digest(list(_DECIDED)))


@query("l2_refused_attempts", f"""
SELECT log_id, seq, user_name, role, problem, prev_hash, hash, true AS chain_ok
FROM sbody JOIN schain USING (log_id, seq) WHERE action='{L.REFUSED}'""", {**LOGS, **SIGNED},
       recursive=True)
def _(spark, sf):
    chain, checks = signed(spark, sf)
    return chain.filter(F.col("action") == L.REFUSED).join(
        checks.select("log_id", F.col("ok").alias("chain_ok")), "log_id").select(
        "log_id", "seq", "user_name", "role", "problem", "prev_hash", "hash", "chain_ok")


_PRED_ROW = {c: c for c in ("rid", "truth", "predicted", "status")}


@query("l3_row_digest",
       f"SELECT rid, sha256({canonical_sql(_PRED_ROW)}) AS digest FROM pred")
def _(spark, sf):
    return X.pred(spark, sf).select("rid", L.row_digest(list(_PRED_ROW)).alias("digest"))


@query("l4_record_id", f"""
SELECT rid, substr(sha256({canonical_sql({**_PRED_ROW, 'model': "'model-1'"})}),1,16)
 AS record_id FROM pred""")
def _(spark, sf):
    return X.pred(spark, sf).withColumn("model", F.lit("model-1")).select(
        "rid", F.substring(L.row_digest([*_PRED_ROW, "model"]), 1, 16).alias("record_id"))


RECORD = {
    **Q.DIAG, **Q.DEC, **LOGS, **SIGNED,
    "rline": """SELECT batch_id, string_agg(step||':'||coalesce(round(hybrid_d10*1e3)::BIGINT::VARCHAR,'-')
 ||':'||coalesce(round(p_spec*1e3)::BIGINT::VARCHAR,'-'),',' ORDER BY step) AS timeline,
 max(step) AS last FROM tlp GROUP BY 1""",
    "rfault": "SELECT batch_id, string_agg(fault||':'||first_step,',' ORDER BY fault) AS faults FROM ("
              + " UNION ALL ".join(f"SELECT batch_id, '{f}' AS fault, min(step) AS first_step "
                                   f"FROM dflag WHERE {f} GROUP BY 1" for f in Q._FAULTS)
              + ") GROUP BY 1",
    "rlog": f"""SELECT log_id, count(*) AS entries, arg_max(hash,seq) AS latest,
 string_agg(concat_ws(':',seq,user_name,role,action,reason_code,substr(hash,1,8)),',' ORDER BY seq)
 FILTER (action<>'{L.REFUSED}') AS actions FROM sbody JOIN schain USING (log_id, seq) GROUP BY 1"""}


@query("l5_batch_record", """
SELECT a.batch_id, CASE WHEN c3 IS NOT NULL THEN 'stop' ELSE 'go on' END AS status,
 c3 AS stop_step, 'hybrid' AS estimator, t.step AS at_step, round(hybrid_mean,5) AS mean_um,
 round(hybrid_d10,5) AS d10_um, round(hybrid_d50,5) AS d50_um, round(hybrid_d90,5) AS d90_um,
 round(d10_lo,5) AS d10_lo, round(d10_hi,5) AS d10_hi, round(p_spec,6) AS p_spec,
 12e0 AS spec_d10_um, round(undecided_rate,6) AS undecided_rate, timeline,
 concat_ws(',','C0:'||coalesce(c0::VARCHAR,'-'),'C1:'||coalesce(c1::VARCHAR,'-'),
  'C2:'||coalesce(c2::VARCHAR,'-'),'C3:'||coalesce(c3::VARCHAR,'-')) AS stops,
 coalesce(faults,'') AS faults, coalesce(actions,'') AS signed_actions,
 coalesce(entries,0) AS entries, CASE WHEN entries>0 THEN true END AS chain_ok,
 latest AS latest_hash FROM stopw a JOIN rline USING (batch_id)
JOIN tlp t ON t.batch_id=a.batch_id AND t.step=coalesce(c3,last)
LEFT JOIN rfault f ON f.batch_id=a.batch_id LEFT JOIN rlog l ON l.log_id=a.batch_id""", RECORD,
       recursive=True)
def _(spark, sf):
    est, _spray, stops = Q.decided(spark, sf)
    # the timeline of the rules has what the diagnosis reads
    faults = D.fault_history(D.fault_flags(Q.signals(spark, sf, est), Q.LIMITS))
    chain, checks = signed(spark, sf)
    actions = chain.filter(F.col("action") != L.REFUSED).withColumnRenamed("log_id", "batch_id")
    docs = N.settle(L.batch_record(stops, est, faults, checks.select(
        F.col("log_id").alias("batch_id"), "entries", "ok", "latest"), actions,
        spec=S.spec_d10_um))
    path = R.scratch(spark, "records")
    L.export_records(docs, path)
    docs = spark.read.schema(docs.schema).json(path)  # the documents as written

    def text(column, *fields):
        return F.array_join(F.transform(column, lambda e: F.concat_ws(":", *[
            F.coalesce(f(e).cast("string"), F.lit("-")) for f in fields])), ",").alias(column)

    def of(name):
        return lambda e: e[name]

    def thousandths(name):
        return lambda e: F.round(e[name] * 1000).cast("bigint")

    dist, log = F.col("distribution"), F.col("log")
    return docs.select(
        "batch_id", "recommendation.*", dist["estimator"].alias("estimator"),
        dist["at_step"].alias("at_step"), *[
            r6(dist[c], 5).alias(c) for c in ("mean_um", "d10_um", "d50_um", "d90_um", "d10_lo",
                                              "d10_hi")],
        r6(dist["p_spec"]).alias("p_spec"), dist["spec_d10_um"].alias("spec_d10_um"),
        r6("undecided_rate").alias("undecided_rate"),
        text("timeline", of("step"), thousandths("d10_um"), thousandths("p_spec")),
        text("stops", of("rule"), of("stop")), text("faults", of("fault"), of("first_step")),
        text("signed_actions", of("seq"), of("user_name"), of("role"), of("action"),
             of("reason_code"), lambda e: F.substring(e["hash"], 1, 8)),
        log["entries"].alias("entries"), log["chain_ok"].alias("chain_ok"),
        log["latest_hash"].alias("latest_hash"))


@query("l6_log_views", """
SELECT log_id, count(*) FILTER (role='assistant') AS signed,
 bool_or(role='user' AND seq=1) AS has_recommendation FROM logs GROUP BY 1""")
def _(spark, sf):
    return X.log(spark, sf).groupBy("log_id").agg(
        F.count_if(F.col("role") == "assistant").alias("signed"),
        F.bool_or((F.col("role") == "user") & (F.col("seq") == 1)).alias("has_recommendation"))


_U52 = "('0x'||substr(sha256('42:'||source),1,13))::UBIGINT/4503599627370496e0"


@query("l7_grouped_split", f"""
SELECT doc_id, source, CASE WHEN {_U52}<0.15e0 THEN 'test' WHEN {_U52}<0.3e0 THEN 'val'
 ELSE 'train' END AS split FROM documents""")
def _(spark, sf):
    return X.table(spark, sf, "documents").select(
        "doc_id", "source", L.hash_split(F.col("source"), 42, 0.15, 0.15).alias("split"))


@query("s3_split_disjointness", f"""
SELECT count(*) FILTER (n>1) AS straddling, (SELECT count(*) FROM (SELECT source FROM documents
 EXCEPT SELECT source FROM documents WHERE source IS NOT NULL)) AS missing
FROM (SELECT source, count(DISTINCT CASE WHEN {_U52}<0.15e0 THEN 'test' WHEN {_U52}<0.3e0
 THEN 'val' ELSE 'train' END) AS n FROM documents GROUP BY 1)""")
def _(spark, sf):
    docs = X.table(spark, sf, "documents").select("source")
    split = docs.withColumn("split", L.hash_split(F.col("source"), 42, 0.15, 0.15))
    return L.split_problems(split, "source", "split", docs)


_ORDERS = ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate",
           "o_orderpriority")


@query("l8_table_fingerprint", f"""
SELECT count(*) AS n, (sum(h%1000000007)%1000000007)::BIGINT AS sum_mod, bit_xor(h) AS xor FROM (
 SELECT ('0x'||substr(md5({canonical_sql({**{c: c for c in _ORDERS},
        'o_totalprice': 'round(o_totalprice*100)::BIGINT',
        'o_orderdate': 'epoch_us(o_orderdate)'})}),1,13))::BIGINT AS h FROM orders)""")
def _(spark, sf):
    # numbers and times as whole numbers: their text is then the same everywhere
    orders = X.table(spark, sf, "orders").withColumns({
        "o_totalprice": F.round(F.col("o_totalprice") * 100).cast("bigint"),
        "o_orderdate": F.unix_micros(F.col("o_orderdate").cast("timestamp"))})
    return L.fingerprint(orders, _ORDERS)


_KEY9 = canonical_sql({"scenario": "scenario", "seed": "seed", "~version": "3"})


@query("l9_missing_results", f"""
SELECT gamma, count(*) AS n FROM grid WHERE sha256({_KEY9}) NOT IN
 (SELECT sha256({_KEY9}) FROM grid WHERE stopped) GROUP BY 1""")
def _(spark, sf):
    cases = X.grid(spark, sf).withColumn("case_key", R.content_key(["scenario", "seed"], 3))
    folder = R.scratch(spark, "stored")
    done = cases.filter("stopped").select("case_key", "bias")
    R.save_result_set({"cells": done}, folder, "all", 3)
    stored = R.load_result_set(spark, folder, done.schema, "cells", "all", 3)
    return R.missing_keys(cases, stored, "case_key").groupBy("gamma").agg(
        F.count("*").alias("n"))


# -- sources and sinks -------------------------------------------------------------------------------------
@query("src1_read_records", """
SELECT step, count(*) AS n, round(avg(value),6) AS mean_value FROM (
 SELECT ceil(value/7e0)::BIGINT AS step, value FROM events) GROUP BY 1""")
def _(spark, sf):
    df = R.read_records(spark, f"{sf}/events.parquet", "event_id bigint, value double", "value",
                        7.0)
    return df.groupBy("step").agg(F.count("*").alias("n"),
                                  r6(F.avg("value")).alias("mean_value"))


@query("src1_nan_records", """
SELECT ceil(t_s/21600e0)::BIGINT AS step, count(*) AS n, count(reading) AS n_reading,
 round(avg(reading),6) AS mean_reading FROM (SELECT (us-1704067200000000)/1e6 AS t_s,
 CASE WHEN event_id%5<>0 THEN value END AS reading FROM ev) GROUP BY 1""")
def _(spark, sf):
    path = R.scratch(spark, "nan-records")
    X.ev(spark, sf).selectExpr(
        "event_id", "(us-1704067200000000)/1e6 as t_s",
        "case when event_id%5=0 then double('NaN') else value end as reading").write.parquet(path)
    df = R.read_records(spark, path, "event_id bigint, t_s double, reading double", "t_s", 21600.0)
    return df.groupBy("step").agg(
        F.count("*").alias("n"), F.count("reading").alias("n_reading"),
        r6(F.avg("reading")).alias("mean_reading"))


# five tables of one run, as the reference's result sets have them
_FIVE = {"truth": ["seed", "below_pct as value"], "est": ["seed", "bias as value"],
         "controllers": ["scenario", "cast(stopped as int) as value"],
         "signals": ["seed", "m as value"], "samples": ["scenario", "k as value"]}


@query("src2_keyed_set", " UNION ALL ".join(
    f"SELECT '{n}' AS name, count(*) AS n, round(sum(value)::DOUBLE,4) AS total, 0 AS n_other_key, "
    f"0 AS n_other_version FROM (SELECT {', '.join(cols).replace('int', 'INT')} FROM grid)"
    for n, cols in _FIVE.items()))
def _(spark, sf):
    grid = X.grid(spark, sf)
    tables = {n: grid.selectExpr(*cols) for n, cols in _FIVE.items()}
    folder = R.scratch(spark, "keyed-set")
    schemas = {n: t.schema for n, t in tables.items()}
    missing = R.load_result_tables(spark, folder, schemas, "key-a", 3)  # nothing is stored yet
    R.save_result_set({n: t.limit(0) for n, t in tables.items()}, folder, "key-a", 3)
    R.save_result_set(tables, folder, "key-a", 3)  # a later attempt replaces an earlier one
    # a run that died after two of its tables has no commit record
    R.write_attempt({n: tables[n] for n in ("truth", "est")}, folder, "key-a", 3, "died")
    R.write_attempt({n: tables[n] for n in ("truth", "est")}, folder, "key-b", 3, "died")
    found = R.load_result_tables(spark, folder, schemas, "key-a", 3)
    other = R.load_result_tables(spark, folder, schemas, "key-b", 3)
    older = R.load_result_tables(spark, folder, schemas, "key-a", 2)
    rows = None
    for name, df in found.items():
        unseen = other[name].unionByName(missing[name]).agg(F.count("*").cast("int").alias("n_other_key"))
        row = df.agg(F.lit(name).alias("name"), F.count("*").alias("n"),
                     r6(F.sum("value").cast("double"), 4).alias("total"))
        row = row.withColumn("_k", F.lit(1)).join(unseen.withColumn("_k", F.lit(1)), "_k").join(
            older[name].agg(F.count("*").cast("int").alias("n_other_version")).withColumn(
                "_k", F.lit(1)), "_k").drop("_k")
        rows = row if rows is None else rows.unionByName(row)
    return rows


@query("src2_result_set", """
SELECT gamma, m, k, count(*) AS n, round(avg(bias),6) AS bias FROM grid GROUP BY 1,2,3""")
def _(spark, sf):
    cells = X.grid(spark, sf).groupBy("gamma", "m", "k").agg(
        F.count("*").alias("n"), r6(F.avg("bias")).alias("bias"))
    folder = R.scratch(spark, "results")
    R.save_result_set({"cells": cells}, folder, "key-a", 3)
    R.save_result_set({"cells": cells.withColumn("bias", F.lit(0.0))}, folder, "key-a", 2)
    return R.load_result_set(spark, folder, cells.schema, "cells", "key-a", 3)


@query("src3_read_log", """
SELECT log_id, seq, role, text, false AS malformed FROM logs""")
def _(spark, sf):
    path = R.scratch(spark, "log")
    R.write_log(X.log(spark, sf), path)
    df = R.read_log(spark, path, "log_id bigint, seq bigint, role string, text string")
    return df.withColumn("malformed", F.col("_malformed").isNotNull()).drop("_malformed")


@query("src4_append_log", "SELECT role, 2*count(*) AS n FROM logs GROUP BY 1")
def _(spark, sf):
    path = R.scratch(spark, "log")
    R.write_log(X.log(spark, sf), path)
    R.write_log(X.log(spark, sf), path)
    return R.read_log(spark, path, "log_id bigint, seq bigint, role string, text string").groupBy(
        "role").agg(F.count("*").alias("n"))


@query("src5_csv_report", """
SELECT gamma, m, k, count(*) AS n, round(avg(bias),6) AS bias FROM grid GROUP BY 1,2,3""")
def _(spark, sf):
    cells = X.grid(spark, sf).groupBy("gamma", "m", "k").agg(
        F.count("*").alias("n"), r6(F.avg("bias")).alias("bias"))
    path = R.scratch(spark, "report")
    R.write_report(cells, path)
    return R.read_report(spark, path, "gamma double, m double, k double, n bigint, bias double")


@query("src6_newest_version", """
SELECT gamma, m, 2 AS version, count(*) AS n FROM grid GROUP BY 1,2""")
def _(spark, sf):
    cells = X.grid(spark, sf).groupBy("gamma", "m").agg(F.count("*").alias("n"))
    folder = R.scratch(spark, "versions")
    for version in range(3):  # three files of one report, the last one is the newest
        cells.select("gamma", "m", F.lit(version).alias("version"), "n").coalesce(1).write.mode(
            "append").parquet(folder)
    return R.newest(spark, folder, "parquet", "*.parquet")


@query("src7_json_export", """
SELECT scenario, seed, round(bias,4) AS bias, CASE WHEN stopped THEN NULL ELSE round(below_pct,4)
 END AS below_pct FROM (SELECT scenario, seed, bias+1e-9 AS bias, below_pct+1e-9 AS below_pct,
 stopped FROM grid)""")
def _(spark, sf):
    rows = X.grid(spark, sf).select(
        "scenario", "seed", (F.col("bias") + 1e-9).alias("bias"),
        F.expr("case when stopped then double('NaN') else below_pct+1e-9 end").alias("below_pct"))
    path = R.scratch(spark, "export")
    R.export_timeline(rows, path, "scenario")
    return spark.read.schema("seed bigint, bias double, below_pct double, scenario string").json(
        path).select("scenario", "seed", "bias", "below_pct")


@query("src8_file_integrity")
def _(spark, sf):
    found = N.settle(R.file_hashes(spark, sf, "*.parquet"))  # both sides come from it
    wrong = found.filter("path <> 'region.parquet'").withColumn("sha256", F.when(
        F.col("path") == "nation.parquet", F.lit("0")).otherwise(F.col("sha256")))
    return R.integrity(found, wrong)


# a file list of a whole tree: one file per document, in folders of language and source
_LISTED = {"flist": """SELECT concat_ws('/',coalesce(lang,''),coalesce(source,''),doc_id||'.txt') AS path,
 sha256(coalesce(text,'')) AS sha256 FROM documents""",
           "fman": """SELECT path, CASE WHEN h%5=0 THEN 'changed' ELSE sha256 END AS sha256 FROM (
 SELECT *, ('0x'||substr(md5(path),1,6))::BIGINT AS h FROM flist) WHERE h%7<>0
 UNION ALL SELECT 'gone/'||path, sha256 FROM flist WHERE ('0x'||substr(md5(path),1,6))::BIGINT%11=0"""}


def file_list(spark, sf):
    return X.table(spark, sf, "documents").select(
        F.concat_ws("/", F.coalesce("lang", F.lit("")), F.coalesce("source", F.lit("")),
                    F.concat("doc_id", F.lit(".txt"))).alias("path"),
        F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha256"))


@query("src8_manifest", """
SELECT path, CASE WHEN f.sha256 IS NULL THEN 'missing' WHEN m.sha256 IS NULL THEN 'unlisted'
 WHEN f.sha256<>m.sha256 THEN 'mismatch' ELSE 'ok' END AS status
FROM flist f FULL JOIN fman m USING (path)""", _LISTED)
def _(spark, sf):
    found = N.settle(file_list(spark, sf))
    h = F.conv(F.substring(F.md5("path"), 1, 6), 16, 10).cast("bigint")
    listed = found.filter(h % 7 != 0).withColumn("sha256", F.when(
        h % 5 == 0, F.lit("changed")).otherwise(F.col("sha256")))
    gone = found.filter(h % 11 == 0).withColumn("path", F.concat(F.lit("gone/"), "path"))
    path = R.scratch(spark, "manifest")
    listed.unionByName(gone).write.json(path)  # the stored manifest
    return R.integrity(found, spark.read.schema("path string, sha256 string").json(path))


_PER_DIGEST = 8


def _tree_sql(rounds: int = 6) -> dict[str, str]:
    """Levels of the tree from below; inside a level, rounds of digests over buckets of lines."""
    out = {"tl3": """SELECT lang||'/'||source AS folder, 'file '||doc_id||'.txt '||h AS line FROM (
 SELECT coalesce(lang,'') AS lang, coalesce(source,'') AS source, doc_id,
  sha256(coalesce(text,'')) AS h FROM documents)"""}
    for level in (3, 2, 1):
        rows = f"tl{level}"
        out[f"tr{level}_0"] = f"""SELECT folder, digest, left_, bucket FROM (
 SELECT folder, p AS left_, bucket, sha256(string_agg(line, chr(10) ORDER BY line)) AS digest FROM (
  SELECT *, floor(('0x'||substr(md5(line),1,12))::BIGINT*p/281474976710656e0)::BIGINT AS bucket FROM (
   SELECT *, ((count(*) OVER (PARTITION BY folder)+{_PER_DIGEST - 1})//{_PER_DIGEST})::BIGINT AS p
   FROM {rows})) GROUP BY 1,2,3)"""
        for r in range(1, rounds):
            before = f"tr{level}_{r - 1}"
            out[f"tr{level}_{r}"] = f"""SELECT folder, digest, left_, bucket FROM {before} WHERE left_=1
 UNION ALL SELECT folder, sha256(string_agg(lpad(bucket::VARCHAR,12,'0')||' '||digest, chr(10)
  ORDER BY lpad(bucket::VARCHAR,12,'0')||' '||digest)) AS digest,
  (left_+{_PER_DIGEST - 1})//{_PER_DIGEST} AS left_, bucket//{_PER_DIGEST} AS bucket
 FROM {before} WHERE left_>1 GROUP BY 1,3,4"""
        last = f"tr{level}_{rounds - 1}"
        if level > 1:
            above = "regexp_extract(folder,'^(.*)/[^/]*$',1)"
            out[f"tl{level - 1}"] = (f"SELECT {above} AS folder, 'folder '||"
                                     f"regexp_extract(folder,'[^/]*$')||' '||digest AS line FROM {last}")
    return out


@query("src9_tree_hash_of_list", """
SELECT digest AS tree, (SELECT count(*) FROM documents) AS files FROM tr1_5""", _tree_sql())
def _(spark, sf):
    return R.tree_hash(file_list(spark, sf), _PER_DIGEST)


@query("src9_tree_hash")
def _(spark, sf):
    return R.tree_hash(R.file_hashes(spark, sf, "*.parquet"))


# -- scan geometry -----------------------------------------------------------------------------------------
# the root of the fit's one equation by bisection of [0, smaller eigenvalue]
CIRC = {"gmom": """SELECT scan_id, px, pz, count(*) AS n, avg(p*p) AS spp, avg(r*r) AS srr,
 avg(p*r) AS spr, avg(q*p) AS gp, avg(q*r) AS gr, avg(q*q) AS qq FROM (SELECT *, p*p+r*r AS q FROM (
 SELECT scan_id, px, pz, x_um-px AS p, outer_um-pz AS r FROM (SELECT *,
  avg(x_um) OVER (PARTITION BY scan_id) AS px, avg(outer_um) OVER (PARTITION BY scan_id) AS pz
  FROM asc2 WHERE valid))) GROUP BY 1,2,3""",
        "gax": """SELECT *, (spp*srr-spr*spr)/big AS small FROM (SELECT *, spp+srr AS tr,
 (spp+srr)/2e0+sqrt(power((spp-srr)/2e0,2)+spr*spr) AS big FROM gmom)""",
        "gbis": """SELECT scan_id, 0 AS i, 0e0 AS lo, small AS hi FROM gax WHERE small>1e-12*big
 UNION ALL SELECT scan_id, i+1, CASE WHEN up THEN (lo+hi)/2e0 ELSE lo END,
 CASE WHEN up THEN hi ELSE (lo+hi)/2e0 END FROM (SELECT b.*,
  qq-power(tr+lo+hi,2)-(gp*gp*(srr-(lo+hi)/2e0)-2e0*gp*gr*spr+gr*gr*(spp-(lo+hi)/2e0))
   /((big-(lo+hi)/2e0)*(small-(lo+hi)/2e0))>0e0 AS up
  FROM gbis b JOIN gax USING (scan_id) WHERE i<70)""",
        "gc": """SELECT scan_id, n, px+ax AS xc, pz+az AS zc, sqrt(ax*ax+az*az+tr+2e0*e) AS radius
 FROM (SELECT a.*, lo AS e, (gp*(srr-lo)-gr*spr)/((big-lo)*(small-lo))/2e0 AS ax,
  (gr*(spp-lo)-gp*spr)/((big-lo)*(small-lo))/2e0 AS az
  FROM gax a JOIN gbis USING (scan_id) WHERE i=70)""",
        "gt": """SELECT *, radius-sqrt(power(radius*cos_r-opt/1.48e0,2)+power(radius*sin_r,2))
 AS thickness_um FROM (SELECT *, sqrt(1e0-sin_r*sin_r) AS cos_r FROM (
 SELECT *, sin(theta)/1.48e0 AS sin_r, count(*) OVER (PARTITION BY scan_id) AS nc FROM (
 SELECT a.scan_id, a.rid, found_inner-found_outer AS opt, radius,
  asin(greatest(-1e0,least(1e0,(x_um-xc)/radius))) AS theta FROM asc2 a
  JOIN (SELECT scan_id, xc, radius FROM gc) USING (scan_id) WHERE valid)
 WHERE abs(theta)<=radians(20e0)) WHERE nc>=5)"""}

def _circles(spark, sf):
    df = X.asc(spark, sf).filter("valid")
    return df, G.fit_circle(df, ["scan_id"], "x_um", "outer_um")


@query("g1_circle_fit", """
SELECT c.scan_id, n, round(xc,3) AS xc, round(radius,3) AS radius,
 round(sqrt(avg(power(sqrt(power(x_um-xc,2)+power(outer_um-zc,2))-radius,2))),4) AS residual_rms
FROM gc c JOIN (SELECT scan_id, x_um, outer_um FROM asc2 WHERE valid) a USING (scan_id)
WHERE n>=5 GROUP BY c.scan_id, n, xc, zc, radius""", CIRC, recursive=True)
def _(spark, sf):
    out = _circles(spark, sf)[1].filter("n >= 5")
    return out.select("scan_id", "n", r6("xc", 3).alias("xc"), r6("radius", 3).alias("radius"),
                      r6("residual_rms", 4).alias("residual_rms"))


def _columns(spark, sf):
    df, circles = _circles(spark, sf)
    rows = df.drop("radius_um").withColumn("opt", F.col("found_inner") - F.col("found_outer"))
    return G.column_thickness(rows, circles.select("scan_id", "xc", "radius"), ["scan_id"],
                              "x_um", "opt", 1.48, 20.0, 5)


@query("g2_refraction_correction", """
SELECT scan_id, count(*) AS n, round(avg(thickness_um),4) AS mean_um, round(min(thickness_um),4)
 AS min_um FROM gt GROUP BY 1""", CIRC, recursive=True)
def _(spark, sf):
    return _columns(spark, sf).groupBy("scan_id").agg(
        F.count("*").alias("n"), r6(F.avg("thickness_um"), 4).alias("mean_um"),
        r6(F.min("thickness_um"), 4).alias("min_um"))


@query("g3_scan_summary", """
SELECT scan_id, n_columns, round(m,4) AS thickness_um,
 round(sqrt(power(sd/sqrt(n_columns),2)+power(m*0.002e0/1.48e0,2)),4) AS uncertainty_um,
 CASE WHEN m>0 THEN round(sd/m,4) END AS intra_cv, round(o,4) AS optical_um FROM (
 SELECT scan_id, count(*) AS n_columns, avg(thickness_um) AS m, stddev_samp(thickness_um) AS sd,
  avg(opt) FILTER (abs(theta)<=apex+radians(2e0)) AS o FROM (SELECT *, min(abs(theta)) OVER (
  PARTITION BY scan_id) AS apex FROM gt) GROUP BY 1)""", CIRC, recursive=True)
def _(spark, sf):
    out = G.scan_summary(_columns(spark, sf), ["scan_id"], "opt", 1.48, 0.002)
    return out.select("scan_id", "n_columns", *[r6(c, 4).alias(c) for c in (
        "thickness_um", "uncertainty_um", "intra_cv", "optical_um")])


@query("g4_reflectance_index", """
SELECT scan_id, round((1e0+r)/(1e0-r),6) AS index FROM (SELECT scan_id,
 sqrt(0.04e0)*power(10e0,(db-40e0+0.5e0*roll)/20e0) AS r FROM (SELECT scan_id,
 10e0*log10(avg(power(10e0,snr_db/10e0))) AS db, avg(outer_um)/500e0 AS roll FROM asc2
 WHERE abs(x_um)<=50e0 GROUP BY 1))""")
def _(spark, sf):
    from winnow.operators.aggregates import power_mean_db

    apex = X.asc(spark, sf).filter("abs(x_um) <= 50e0").groupBy("scan_id").agg(
        power_mean_db(F.col("snr_db")).alias("db"), (F.avg("outer_um") / 500.0).alias("roll"))
    return apex.select("scan_id", r6(G.reflectance_index(
        F.col("db"), 40.0, F.lit(0.5) * F.col("roll"), 0.04)).alias("index"))


@query("g5_masks_from_surfaces", """
SELECT scan_id, cls AS class, count(*) AS n FROM (SELECT scan_id,
 (d>=outer_um/10e0)::INT+(d>=inner_um/10e0)::INT AS cls FROM asc2, (SELECT unnest(range(40)) AS d))
GROUP BY 1,2""")
def _(spark, sf):
    return G.masks(X.asc(spark, sf), F.col("outer_um") / 10.0, F.col("inner_um") / 10.0,
                   40).groupBy("scan_id", "class").agg(F.count("*").alias("n"))


@query("g6_lateral_resample", """
SELECT scan_id, col, n, round(power,5) AS power, count(*) OVER (PARTITION BY scan_id)=5 AS complete,
 (col-2e0)*100e0 AS x_out FROM (SELECT scan_id, floor((x_um+250e0)/100e0)::BIGINT AS col,
 avg(power(10e0,snr_db/10e0)*outer_um) AS power, count(*) AS n FROM asc2 GROUP BY 1,2)
WHERE col BETWEEN 0 AND 4""")
def _(spark, sf):
    df = X.asc(spark, sf).withColumn(
        "p", F.pow(F.lit(10.0), F.col("snr_db") / 10.0) * F.col("outer_um"))
    out = G.lateral_resample(df, ["scan_id"], "x_um", "p", 500.0, 5)
    return out.withColumn("power", r6("power", 5))


# -- streams: the events table replayed as time-ordered files ------------------------------------------------
def _stream(spark, sf, parts=3, closing=None):
    ev = X.ev(spark, sf).select("event_id", "instrument", "us", "gate_class", "accepted", "value")
    return T.replay(ev, "us", parts, closing).withColumn("ts", F.timestamp_micros("us"))


@query("str1_tumbling_counts", """
SELECT instrument, us//21600000000*21600000000 AS start_us, count(*) AS n,
 count(*) FILTER (accepted) AS n_acc, count(*) FILTER (gate_class=2) AS n_fines FROM ev
GROUP BY 1,2""")
def _(spark, sf):
    out = T.run_available(T.tumbling_counts(_stream(spark, sf), "6 hours", "1 day"), "update")
    return T.latest(out, ["instrument", "start_us"])


_SLIDE = {"sld": """SELECT instrument, (us//21600000000-o)*21600000000 AS start_us,
 floor(value/20e0)::BIGINT%3 AS class, floor(value/0.5e0)::BIGINT AS cell, value
 FROM ev, (SELECT unnest([0,1]) AS o) WHERE accepted"""}


def _moments(spark, sf):
    ev = _stream(spark, sf).withColumn("class", F.floor(F.col("value") / 20.0) % 3)
    return T.sliding_moments(ev, "12 hours", "6 hours", "1 day", 0.5)


@query("str2_sliding_moments", """
SELECT instrument, start_us, class, cell, count(*) AS n, round(sum(value),6) AS s1,
 round(sum(value*value),5) AS s2 FROM sld GROUP BY 1,2,3,4""", _SLIDE)
def _(spark, sf):
    out = T.latest(T.run_available(_moments(spark, sf), "update"),
                   ["instrument", "start_us", "class", "cell"])
    return out.withColumn("s1", r6("s1")).withColumn("s2", r6("s2", 5))


@query("str3_corrected_windows", """
SELECT instrument, start_us, round(m+1e-9,6) AS mean, round((min(cell) FILTER (
 cum>=0.1e0*tot-1e-9)+0.5e0)*0.5e0,6) AS d10 FROM (SELECT instrument, start_us, cell, m,
 sum(w) OVER (PARTITION BY instrument, start_us ORDER BY cell) AS cum,
 sum(w) OVER (PARTITION BY instrument, start_us) AS tot FROM (SELECT instrument, start_us, cell,
  f/(nc/nw) AS w, sum(f/(nc/nw)*value) OVER g/sum(f/(nc/nw)) OVER g AS m FROM (SELECT *,
  count(*) OVER (PARTITION BY instrument, start_us, class) AS nc,
  count(*) OVER (PARTITION BY instrument, start_us) AS nw,
  CASE class WHEN 0 THEN 0.5e0 WHEN 1 THEN 0.3e0 ELSE 0.2e0 END AS f FROM sld)
  WINDOW g AS (PARTITION BY instrument, start_us))) GROUP BY 1,2,m""", _SLIDE)
def _(spark, sf):
    ref = spark.range(3).select(F.col("id").alias("class"), F.element_at(
        F.array(*map(F.lit, (0.5, 0.3, 0.2))), (F.col("id") + 1).cast("int")).alias("f_true"))
    # ten days behind the last reading comes a time mark, by which all windows close
    ev = _stream(spark, sf, closing=864_000_000_000).withColumn(
        "class", F.floor(F.col("value") / 20.0) % 3)
    out = T.closed_windows(ev, ref, "12 hours", "6 hours", "1 day", 0.5).drop("epoch")
    # means of two-decimal readings end on exact halves: nudge both sides off the tie
    return _rounded(out.withColumn("mean", F.col("mean") + 1e-9), "mean", "d10")


@query("str4_drift_state", """
SELECT instrument, round(u,6) AS undecided_rate, round(v,6) AS level, r AS n,
 ['OK','Warning','Alarm'][1+CASE WHEN u>=0.35e0 THEN 2 WHEN u>=0.3e0 THEN 1 ELSE 0 END] AS state
FROM dew JOIN (SELECT instrument, count(*) AS r FROM ev GROUP BY 1) USING (instrument, r)""",
       {"dseq": """SELECT instrument, value, (gate_class=0 AND NOT accepted)::INT AS x,
 row_number() OVER (PARTITION BY instrument ORDER BY us, event_id) AS r FROM ev""",
        "dew": """SELECT instrument, r, 0.02e0*x AS u, 0.02e0*value AS v FROM dseq WHERE r=1
 UNION ALL SELECT s.instrument, s.r, 0.02e0*s.x+0.98e0*d.u, 0.02e0*s.value+0.98e0*d.v
 FROM dew d JOIN dseq s ON s.instrument=d.instrument AND s.r=d.r+1"""}, recursive=True)
def _(spark, sf):
    out = T.drift_stream(_stream(spark, sf), S.ewma_lambda, (0.3, 0.35))
    return _rounded(T.latest(out, ["instrument"]), "undecided_rate", "level")


@query("str5_latched_stop", """
SELECT batch_id, min(step) FILTER (mean_um>=12e0) AS stop FROM wstep GROUP BY 1
HAVING min(step) FILTER (mean_um>=12e0) IS NOT NULL""")
def _(spark, sf):
    from winnow.plans.series import win_steps

    levels = win_steps(spark, sf).select(*BS, F.col("mean_um").alias("level")).filter(
        "level is not null")
    return T.latched_stops(T.replay(levels, "step", 4), 12.0).select("batch_id", "stop")


@query("str6_cumulative_counts", """
SELECT instrument, count(*) FILTER (accepted) AS n_acc, count(*) FILTER (gate_class=1) AS n_twin,
 count(*) FILTER (gate_class=2) AS n_fines FROM ev GROUP BY 1""")
def _(spark, sf):
    return T.latest(T.run_available(T.cumulative_counts(_stream(spark, sf)), "update"),
                    ["instrument"])


@query("str7_chain_stream", "SELECT log_id, seq, prev_hash, hash FROM lchain", LOGS,
       recursive=True)
def _(spark, sf):
    entries = X.log(spark, sf).select("log_id", "seq", L.row_digest(_BODY).alias("body"))
    out = T.chain_stream(T.replay(entries, "seq", 3), "body")
    return out.select("log_id", "seq", "prev_hash", "hash")


# a seventh of the readings arrives behind all others; what lies in a closed window is dropped
_LATE = {"lparts": """SELECT instrument, us, (us-lo)*3//(hi-lo+1) AS third, event_id%7=0 AS held
 FROM ev, (SELECT min(us) AS lo, max(us) AS hi FROM ev)""",
         "lmark": """SELECT max(us)//1000*1000-86400000000 AS mark FROM lparts
 WHERE third<=1 AND NOT held"""}


@query("str8_late_rows", """
SELECT instrument, count(*) FILTER (NOT lost) AS kept, count(*) FILTER (lost) AS dropped FROM (
 SELECT instrument, held AND (us//21600000000+1)*21600000000<=mark AS lost FROM lparts, lmark)
GROUP BY 1""", _LATE)
def _(spark, sf):
    ev = X.ev(spark, sf).select("event_id", "instrument", "us", "gate_class", "accepted")
    ends = ev.agg(F.min("us").alias("lo"), F.max("us").alias("hi")).first()
    third = F.expr(f"cast((us - {ends.lo}) * 3 div {ends.hi - ends.lo + 1} as int)")
    parts = ev.withColumn("_part", F.when(F.col("event_id") % 7 == 0, 3).otherwise(third))
    stream = T.replay_parts(parts, "_part", 4).withColumn("ts", F.timestamp_micros("us"))
    return T.late_rows(stream, "6 hours", "1 day")
