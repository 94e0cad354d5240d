import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from winnow.functions.exprs import edge_bin, no_nan, normal_cdf, uniform
from winnow.operators import primitives as N


@pytest.fixture(scope="module")
def skewed(spark):
    """A hot group with a hot value, beside small groups."""
    gen = np.random.default_rng(1)
    rows = [("hot", float(v), float(w), i) for i, (v, w) in enumerate(
        zip(np.where(gen.random(900) < 0.4, 5.0, gen.normal(5, 2, 900).round(2)),
            gen.random(900) + 0.1))]
    rows += [(f"g{i % 7}", float(i % 11), 1.0, 1000 + i) for i in range(100)]
    return rows, spark.createDataFrame(rows, "g string, v double, w double, id long")


def test_running_sums_match_a_sorted_loop_with_and_without_buckets(skewed):
    rows, df = skewed
    want = {}
    for g in {r[0] for r in rows}:
        total = 0.0
        mine = sorted(r for r in rows if r[0] == g)
        for v in sorted({r[1] for r in mine}):
            own = sum(r[2] for r in mine if r[1] == v)
            want[g, v] = (total, own)
            total += own
    for size in (None, 40):
        out = N.running_sums(df, ["g"], "v", {"w": F.col("w")}, rows_per_bucket=size).collect()
        assert len(out) == len(want)
        for r in out:
            assert (r.w_before, r.w) == pytest.approx(want[r.g, r.v], abs=1e-9)


def test_row_positions_split_one_hot_value(skewed):
    rows, df = skewed
    out = N.row_positions(df, ["g"], "v", ["id"], rows_per_bucket=40).collect()
    assert len(out) == len(rows)
    for g in {r[0] for r in rows}:
        mine = sorted((r.pos, r.v) for r in out if r.g == g)
        assert [p for p, _ in mine] == list(range(len(mine)))
        assert [v for _, v in mine] == sorted(v for _, v in mine)
    again = N.row_positions(df.repartition(3), ["g"], "v", ["id"]).collect()
    assert {(r.id, r.pos) for r in out} == {(r.id, r.pos) for r in again}


def test_exact_quantiles_linear_and_nearest(skewed):
    rows, df = skewed
    hot = np.array([r[1] for r in rows if r[0] == "hot"])
    for size in (None, 40):
        lin = N.exact_quantiles(df, ["g"], "v", {"a": 0.1, "b": 0.5}, rows_per_bucket=size)
        got = {r.g: (r.a, r.b) for r in lin.collect()}
        assert got["hot"] == pytest.approx(tuple(np.quantile(hot, [0.1, 0.5])))
    near = N.exact_quantiles(df, ["g"], "v", {"a": 0.1, "b": 1.0}, kind="nearest").collect()
    row = next(r for r in near if r.g == "hot")
    ranked = np.sort(hot)
    assert (row.a, row.b) == (ranked[int(0.1 * hot.size)], ranked[-1])
    everything = N.exact_quantiles(df, [], "v", {"m": 0.5}, rows_per_bucket=40).first()
    assert everything.m == pytest.approx(np.median([r[1] for r in rows]))


def interp_quantile(v, w, q):
    order = np.argsort(v, kind="stable")
    v, w = np.asarray(v, float)[order], np.asarray(w, float)[order]
    return np.interp(q, (np.cumsum(w) - 0.5 * w) / w.sum(), v)


def test_weighted_quantile_literals_and_order(spark):
    data = [(1.0, 1.0), (2.0, 1.0), (3.0, 1.0), (4.0, 9.0)]
    for order in ((0, 1, 2, 3), (2, 0, 3, 1)):
        df = spark.createDataFrame([data[i] for i in order], "v double, w double")
        got = N.weighted_quantiles(df, [], "v", "w", "w", {"a": 0.1, "b": 0.5, "c": 0.99}).first()
        assert tuple(got) == pytest.approx(tuple(
            interp_quantile([1, 2, 3, 4], [1, 1, 1, 9], [0.1, 0.5, 0.99])))


def test_weighted_quantile_with_ties(skewed):
    rows, df = skewed
    hot = sorted((r[1], r[3], r[2]) for r in rows if r[0] == "hot")
    for size in (None, 40):
        got = N.weighted_quantiles(df, ["g"], "v", "w", "id", {"a": 0.1, "b": 0.45, "c": 0.9},
                                   size)
        row = next(r for r in got.collect() if r.g == "hot")
        want = interp_quantile([h[0] for h in hot], [h[2] for h in hot], [0.1, 0.45, 0.9])
        assert (row.a, row.b, row.c) == pytest.approx(tuple(want), abs=1e-9)


@pytest.mark.parametrize("lam", [0.02, 0.3, 0.95, 1.0])
def test_ewma_equals_the_loop(spark, lam):
    gen = np.random.default_rng(2)
    values = gen.normal(size=1500)
    df = spark.createDataFrame([(i % 2, i, float(v)) for i, v in enumerate(values)],
                               "g long, t long, v double")
    out = N.ewma(df, ["g"], "t", ["t"], {"level": ("v", 0.5)}, lam, rows_per_bucket=200).collect()
    got = {r.t: r.level for r in out}
    for g in (0, 1):
        level = 0.5
        for t in range(g, 1500, 2):
            level = lam * values[t] + (1 - lam) * level
            assert got[t] == pytest.approx(level, abs=1e-11)


@pytest.mark.parametrize("chunk", [4096, 5])
def test_affine_scan_equals_the_loop(spark, monkeypatch, chunk):
    monkeypatch.setattr(N, "SCAN_ROWS", chunk)  # 5: several levels of chunks
    gen = np.random.default_rng(6)
    rows = [(g, t, float(a), None if gen.random() < 0.1 else float(b))
            for g, size in ((0, 400), (1, 3)) for t, (a, b) in enumerate(zip(
                gen.choice([0.0, -0.5, 0.9, 1.0, 1.01], size), gen.normal(size=size)))]
    df = spark.createDataFrame(rows, "g long, t long, a double, b double").repartition(5)
    out = N.affine_scan(df, ["g"], "t", ["t"], {"x": (F.col("a"), F.col("b"), 2.0),
                                                "y": (F.lit(1.0), F.lit(1.0), 0.0)}).collect()
    got = {(r.g, r.t): (r.x, r.y) for r in out}
    assert len(got) == len(rows)
    level = {}
    for g, t, a, b in rows:
        x, y = level.get(g, (2.0, 0.0))
        level[g] = x, y = (x if b is None else a * x + b), y + 1
        assert got[g, t] == (pytest.approx(x, rel=1e-9, abs=1e-9), y)


def test_affine_scan_of_nothing(spark):
    empty = spark.createDataFrame([], "g long, t long, a double")
    assert N.affine_scan(empty, ["g"], "t", ["t"], {"x": (F.col("a"), F.col("a"), 0.0)}).count() == 0


def test_step_grid_fills_missing_steps(spark):
    df = spark.createDataFrame([("a", 2, 5), ("a", 4, 1)], "g string, step long, n long")
    out = {r.step: r.n for r in N.on_step_grid(df, ["g"], ["n"]).collect()}
    assert out == {2: 5, 3: 0, 4: 1}


def test_scalar_helpers(spark):
    row = spark.range(1).select(
        normal_cdf(F.lit(0.0)).alias("mid"), normal_cdf(F.lit(-1.96)).alias("low"),
        no_nan(F.lit(float("nan"))).alias("nan"), edge_bin(F.lit(9.0), [0, 3, 6, 9]).alias("top"),
        edge_bin(F.lit(-1.0), [0, 3, 6, 9]).alias("bottom"),
        uniform(F.lit("a"), F.lit(1)).alias("u")).first()
    assert row.mid == pytest.approx(0.5, abs=1e-7)
    assert row.low == pytest.approx(0.5 * (1 + math.erf(-1.96 / math.sqrt(2))), abs=1e-7)
    assert row["nan"] is None and (row.top, row.bottom) == (2, 0)
    assert 0 <= row.u < 1


def test_buckets_of_buckets(spark, monkeypatch):
    # more parts than literal boundaries: every coarse bucket is cut again
    monkeypatch.setattr(N, "COARSE_BUCKETS", 4)
    rows = [(i % 3, float((i * 37) % 500)) for i in range(2000)]
    df = spark.createDataFrame(rows, "g long, v double").repartition(5)
    buckets = N.range_buckets(df, "v", 100)
    assert buckets.inner is not None and buckets.rows == 2000
    sizes = [r["count"] for r in buckets.assign(df, "v").groupBy("_bucket").count().collect()]
    assert len(sizes) > 12 and max(sizes) <= 300 and sum(sizes) == 2000
    got = N.exact_quantiles(df, ["g"], "v", {"m": 0.5}, rows_per_bucket=100).collect()
    import statistics

    for r in got:
        assert r.m == statistics.median(v for g, v in rows if g == r.g)
