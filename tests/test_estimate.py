import math
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from winnow.operators import estimate as E
from winnow.settings import DEFAULTS

BY = ["batch_id"]


def biased_window(k, seed=23, m=3.0):
    """A population whose reading grows with size, and a window that prefers large objects."""
    gen = np.random.default_rng(seed)
    size = gen.gamma(24.0, 640.0 / 24.0, 30_000) + 60.0
    h = 14.0 * (size / size.mean()) ** k * gen.uniform(0.97, 1.03, size.size)
    keep = gen.random(size.size) < 0.07 * (size / size.mean()) ** m
    seen = np.maximum(h[keep] + gen.normal(0.0, 1.0, keep.sum()), 0)
    return size, h, size[keep], seen


def model(spark, k):
    size, h, ws, wh = biased_window(k)
    rows = spark.createDataFrame(
        [(0, str(i), float(math.log(s)), float(v)) for i, (s, v) in enumerate(zip(ws, wh))],
        "batch_id long, rid string, x double, h double")
    ref = spark.createDataFrame([(0, float(math.log(s)), 1.0) for s in size[::10]],
                                "batch_id long, log_size double, weight double")
    return np.quantile(h, 0.1), np.quantile(wh, 0.1), E.WindowModel(
        rows, ref, BY, replace(DEFAULTS, sigma_um=1.0))


def phi(z):
    return 0.5 * (1 + np.vectorize(math.erf)(z / math.sqrt(2)))


def test_reweighting_recovers_the_population(spark):
    true, raw, m = model(spark, 1.0)
    est = m.hybrid_estimate().first()
    trend = m.model_estimate().first()
    ipw = m.ipw(F.col("rid")).first()
    assert raw > true + 0.5
    assert abs(est.d10 - true) < 0.2 and abs(trend.d10 - true) < 0.2
    assert abs(ipw.d10 - true) < abs(raw - true)
    assert 0 < ipw.ess <= 2500 and 0 <= ipw.uncovered < 0.1

    # brute force: bisect the same mixture over all readings at once
    comps = m.hybrid.first().comps
    rows = m.rows.select("v", "w").toPandas()
    mu, sd, w = (np.array([c[i] for c in comps]) for i in ("mu", "sd", "w"))
    lo, hi = 0.0, 60.0
    for _ in range(60):
        mid = (lo + hi) / 2
        cdf = rows.w[rows.v <= mid].sum() + (w * phi((mid - mu) / np.maximum(sd, 1e-12))).sum()
        lo, hi = (lo, mid) if cdf >= 0.1 else (mid, hi)
    assert est.d10 == pytest.approx(hi, abs=2e-5)

    hist = E.corrected_histogram(m, 0.0, 0.5, 80).collect()
    assert sum(r.share for r in hist) == pytest.approx(1.0)
    small = E.bootstrap_interval(E.bootstrap_d10(m, ["rid"], 30), BY, 0.9, 12.0).first()
    assert small.d10_lo < est.d10 < small.d10_hi and 0 <= small.p_spec <= 1


def test_no_correction_is_claimed_without_a_trend(spark):
    true, _, m = model(spark, 0.0)
    est = m.hybrid_estimate().first()
    assert abs(m.fit.first().beta) < 0.1
    assert abs(est.d10 - true) < 0.25


def test_partitioning_does_not_change_the_answer(spark):
    _, _, ws, wh = biased_window(1.0)
    rows = spark.createDataFrame(
        [(0, str(i), float(math.log(s)), float(v)) for i, (s, v) in enumerate(zip(ws, wh))],
        "batch_id long, rid string, x double, h double")
    got = [E.raw_estimate(rows.repartition(n), BY, F.col("rid"), size).first()
           for n, size in ((2, None), (8, 300))]
    assert tuple(got[0]) == pytest.approx(tuple(got[1]), abs=1e-9)


def test_too_few_objects_give_nulls(spark, sf):
    from winnow.plans import estimation as Q

    steps = Q.estimate_timeline(spark, sf, models=("raw",)).collect()
    assert steps and all(r.raw_d10 is None for r in steps if r.n_window < 100)
    assert all(r.p_spec is None for r in steps)


def test_poisson_counts_have_mean_and_variance_one(spark):
    rows = spark.range(400).select(F.col("id").cast("string").alias("rid"))
    out = E.resampled_rows(rows, 50, ["rid"]).groupBy("rid", "rep").agg(F.sum("c").alias("c"))
    got = out.agg(F.sum("c").alias("s"), F.sum(F.col("c") * F.col("c")).alias("q")).first()
    n = 400 * 50
    assert got.s / n == pytest.approx(1.0, abs=0.03)
    assert got.q / n - (got.s / n) ** 2 == pytest.approx(1.0, abs=0.05)


def test_plain_bootstraps_against_brute_force(spark):
    _, _, m = model(spark, 1.0)
    counts = (E.resampled_rows(m.rows.select("batch_id", "rid", "class", "h"), 6, ["rid"])
              .join(m.table.select("class", "f_true"), "class").toPandas())
    raw = {r.rep: r.d10 for r in E.bootstrap_raw_d10(m.rows, BY, ["rid"], 6).collect()}
    ipw = {r.rep: r.d10 for r in E.bootstrap_ipw_d10(
        m.rows, m.table, BY, ["rid"], 6, rows_per_bucket=500).collect()}
    assert sorted(raw) == sorted(ipw) == list(range(6))
    for rep, part in counts.groupby("rep"):
        part = part.sort_values("h")
        drawn = np.repeat(part.h.to_numpy(), part.c.to_numpy().astype(int))
        assert raw[rep] == pytest.approx(np.quantile(drawn, 0.1), abs=1e-9)
        w = part.c * part.f_true / part.groupby("class").c.transform("sum")
        cum = w.cumsum().to_numpy()
        assert ipw[rep] == part.h.to_numpy()[np.argmax(cum >= 0.1 * cum[-1] - 1e-12)]


def test_binomial_draws_invert_the_exact_distribution():
    import math

    gen = np.random.default_rng(5)
    for n, p in ((0, 0.3), (1, 0.5), (7, 0.2), (40, 0.93), (150, 0.5), (3000, 0.4), (5, 0.0), (5, 1.0)):
        u = np.sort(gen.random(300))
        got = E.binomial_draws(np.full(300, n), np.full(300, p), u)
        if p in (0.0, 1.0):
            assert (got == int(n * p)).all()
            continue
        small = min(p, 1 - p)
        cdf, total = [], 0.0
        for k in range(n + 1):
            total += math.exp(math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)
                              + k * math.log(small) + (n - k) * math.log1p(-small))
            cdf.append(total)
        for x, g in zip(u, got):
            v = 1 - x if p > 0.5 else x
            k = next((k for k, c in enumerate(cdf) if c > v), n)
            assert abs((n - k if p > 0.5 else k) - g) <= (0 if n < 1000 else 1)


def test_multinomial_shares_of_a_certificate(spark):
    shares = [0.4, 0.0, 0.35, 0.2, 0.05]
    table = spark.createDataFrame([(b, k, f) for b in (1, 2) for k, f in enumerate(shares)],
                                  "batch_id long, class long, f_true double")
    rows = E.multinomial_shares(table, ["batch_id"], 150, 400).collect()
    again = E.multinomial_shares(table.repartition(3), ["batch_id"], 150, 400).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again))
    by = {}
    for r in rows:
        assert abs(r._f * 150 - round(r._f * 150)) < 1e-9
        by.setdefault((r.batch_id, r.rep), {})[r["class"]] = r._f
    assert len(by) == 800 and all(abs(sum(v.values()) - 1) < 1e-9 for v in by.values())
    for k, f in enumerate(shares):
        values = np.array([v[k] for v in by.values()])
        assert abs(values.mean() - f) < 5 * math.sqrt(max(f * (1 - f), 1e-12) / 150 / 800) + 1e-12
        assert abs(values.var() - f * (1 - f) / 150) < 0.2 * f * (1 - f) / 150 + 1e-12
    # the shares of two classes pull against each other
    a, b = (np.array([v[k] for v in by.values()]) for k in (0, 2))
    assert abs(np.cov(a, b)[0, 1] + 0.4 * 0.35 / 150) < 0.3 * 0.4 * 0.35 / 150


def test_undecided_curve_is_flat_at_its_fit(spark):
    from winnow.operators import aggregates as A

    gen = np.random.default_rng(4)
    x = gen.random((800, 2))
    y = gen.random(800) < 1 / (1 + np.exp(-(-1 + 2 * x[:, 0] - x[:, 1])))
    df = spark.createDataFrame([(float(a), float(b), bool(t)) for (a, b), t in zip(x, y)],
                               "a double, b double, y boolean")
    row = A.undecided_curve(df, {"a": F.col("a"), "b": F.col("b")}, F.col("y")).first()
    w = np.array([row.intercept, row.a, row.b])
    z = np.column_stack([np.ones(800), x])
    grad = z.T @ (1 / (1 + np.exp(-z @ w)) - y) + np.array([0, w[1], w[2]]) / 100
    assert np.abs(grad).max() < 1e-2
    one = A.undecided_curve(df.filter("y"), {"a": F.col("a")}, F.col("y")).first()
    assert one.a == 0.0 and one.intercept > 9
