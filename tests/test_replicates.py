"""Bootstraps whose draws never become rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from winnow.operators import estimate as E
from winnow.operators import primitives as N
from winnow.operators import replicates as P
from winnow.settings import DEFAULTS as S

BY = ["batch_id", "step"]


def window(spark, n=700):
    """Two windows, one with half of its readings at one value, and their reference."""
    gen = np.random.default_rng(3)
    rows = [(b, 0, f"{b}-{i}", float(x), 0.0 if b and i % 2 else float(np.exp(x) / 30 + y))
            for b in (0, 1) for i, (x, y) in enumerate(zip(gen.normal(6.5, 0.1, n),
                                                           gen.normal(0, 1, n)))]
    ref = [(b, 0, 6.2 + 0.02 * k, 1 / 30) for b in (0, 1) for k in range(30)]
    return (N.settle(spark.createDataFrame(rows, "batch_id long, step long, rid string, x double, h double")),
            spark.createDataFrame(ref, "batch_id long, step long, log_size double, weight double"))


def test_counts_are_those_of_resampled_rows(spark):
    rows = spark.createDataFrame([("a",), ("b:1",), ("",), (None,)], "rid string")
    want = {(r.rid, r.rep): r.c for r in E.resampled_rows(rows, 10, ["rid"]).collect()}
    got = P.poisson_matrix(["a:", "b:1:", ":", ""], 10)
    assert got.shape == (4, 10)
    assert all(want.get((k, i), 0) == got[j, i] for j, k in enumerate(("a", "b:1", "", None))
               for i in range(10))


def test_a_hot_value_is_a_part_of_its_own(spark):
    rows, _ = window(spark)
    got = P.cut_parts(rows, BY, ["rid"], "h", 50).groupBy("batch_id", "_part", "_sub").agg(
        F.count("*").alias("n"), F.count_distinct("h").alias("values")).collect()
    assert max(r.n for r in got) < 150  # half of a window is one value
    assert any(r["values"] == 1 and r.n > 5 for r in got)


@pytest.mark.parametrize("size", [None, 60])
def test_bootstraps_without_rows_per_draw(spark, monkeypatch, size):
    rows, ref = window(spark)
    m = E.WindowModel(rows, ref, BY, S)
    drawn = (E.resampled_rows(m.rows.select(*BY, "rid", "class", "h", "v"), 6, ["rid"])
             .join(m.table.select(*BY, "class", "f_true"), [*BY, "class"]).toPandas())

    def no_rows(*_):
        raise AssertionError("a row per draw")

    monkeypatch.setattr(E, "resampled_rows", no_rows)
    raw = {(r.batch_id, r.rep): r.d10 for r in E.bootstrap_raw_d10(
        m.rows, BY, ["rid"], 6, rows_per_bucket=size).collect()}
    ipw = {(r.batch_id, r.rep): r.d10 for r in E.bootstrap_ipw_d10(
        m.rows, m.table, BY, ["rid"], 6, rows_per_bucket=size).collect()}
    hyb = {(r.batch_id, r.rep): r.d10 for r in E.bootstrap_d10(
        m, ["rid"], 6, rows_per_bucket=size).collect()}
    assert len(raw) == len(ipw) == len(hyb) == 12
    for key, part in drawn.groupby(["batch_id", "rep"]):
        part = part.sort_values("h")
        assert raw[key] == pytest.approx(np.quantile(np.repeat(part.h, part.c.astype(int)), 0.1), abs=1e-9)
        w = part.c * part.f_true / part.groupby("class").c.transform("sum")
        cum = w.cumsum().to_numpy()
        assert ipw[key] == part.h.to_numpy()[np.argmax(cum >= 0.1 * cum[-1] - 1e-12)]
    # the mixture of every replicate reaches p at its root
    again = {(r.batch_id, r.rep): r.d10 for r in E.bootstrap_d10(m, ["rid"], 6).collect()}
    assert hyb == pytest.approx(again, abs=1e-9)


def test_keys_join_the_rows_of_a_model_later(spark):
    rows, ref = window(spark, 200)
    columns = [*BY, "rid", "class", "h", "v", "w"]
    want = E.WindowModel(rows, ref, BY, S).rows.select(*columns).collect()
    m = E.WindowModel(rows.drop("rid"), ref, BY, S)
    assert "rid" not in m.rows.columns
    assert sorted(m.weigh(rows).select(*columns).collect()) == sorted(want)


def test_signals_read_a_timeline_that_is_there(spark, sf, monkeypatch):
    from winnow.plans import decisions as Q

    def again(*_, **__):
        raise AssertionError("a second timeline")

    monkeypatch.setattr(Q.Q, "estimate_timeline", again)
    est = spark.createDataFrame(
        [(1, k, 9.0 + k, 1.0, 0.1, 0.2, 700.0) for k in range(40)],
        "batch_id long, step long, raw_mean double, gate_twin_pct double, "
        "cv2_within_unclipped double, undecided_rate double, ref_median_um double")
    assert Q.signals(spark, sf, est).filter("ready").count() > 0


def test_digests_of_keys_of_any_length():
    import hashlib

    keys = ["", "a:", "é" * 20 + ":", *("x" * n for n in range(45, 70)), "y" * 200]
    words = np.array([[int(hashlib.md5(f"{k}{q}".encode()).hexdigest()[8 * w:8 * w + 8], 16)
                       for q in range(12) for w in range(4)] for k in keys]) / 2.0 ** 32
    want, cum, term = np.zeros(words.shape, int), 0.0, np.exp(-1.0)
    for k in range(P.poisson_terms()):
        cum += term
        term /= k + 1
        want += words >= cum
    assert (P.poisson_matrix(keys, 47) == want[:, :47]).all()


def test_draws_of_some_replicates_alone():
    import pyarrow as pa

    keys = [f"{10 ** (i % 7)}:{i}:" for i in range(300)]
    got = P._tools()[0](pa.chunked_array([keys[:100], keys[100:]]), [3, 11])
    want = P.poisson_matrix(keys, 48).T
    assert (got == want[[12, 13, 14, 15, 44, 45, 46, 47]]).all()
    assert P._tools()[0](pa.array([], pa.string()), [0]).shape == (4, 0)


def test_parts_are_those_of_a_search(spark):
    gen = np.random.default_rng(5)
    values = [*gen.normal(0, 1, 600).tolist(), float("inf"), float("-inf"), None]
    rows = spark.createDataFrame([(i % 2, str(i), v) for i, v in enumerate(values)],
                                 "b long, rid string, h double")
    got = P.cut_parts(rows, ["b"], ["rid"], "h", 40).toPandas()
    assert (got[got.h.isna()]._part == -1).all()
    for _, part in got[got.h.notna()].groupby("b"):
        part = part.sort_values("h")
        assert part._part.is_monotonic_increasing and part._part.nunique() == 8
        assert part._part.value_counts().max() < 60


def test_an_interval_makes_its_replicates_once(spark):
    made = spark.sparkContext.accumulator(0)

    def count(x):
        made.add(1)
        return x

    d10 = spark.range(40).select(F.lit(1).alias("b"), F.udf(count, "double")(
        F.col("id").cast("double")).alias("d10"))
    row = E.bootstrap_interval(d10, ["b"], 0.9, 20.0).first()
    assert row.p_spec == 0.5 and made.value == 40


@pytest.mark.parametrize("kind", ["certificate", "at_line", "ipw", "raw"])
def test_a_bootstrap_makes_its_window_once(spark, sf, monkeypatch, kind):
    from __spark_entry__ import queries
    from winnow.plans import fixtures as X

    class Begun(Exception):
        pass

    def begun(*_):
        raise Begun

    made, win = [], X._win
    monkeypatch.setattr(X, "_win", lambda *a: made.append(a) or win(*a))
    monkeypatch.setattr(E, "cut_parts", begun)
    with pytest.raises(Begun):
        queries()[f"e12_bootstrap_{kind}"](spark, sf)
    assert len(made) == 1
