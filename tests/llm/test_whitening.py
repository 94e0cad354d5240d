import numpy as np
import pytest

from winnow.llm import whitening as H


def close_spectrum(d, u, want):
    """u diag(d) u' is ``want`` and u is orthonormal."""
    size = max(1.0, np.abs(want).max())
    assert np.abs(u.T @ u - np.eye(len(d))).max() < 1e-12
    assert np.abs((u * d) @ u.T - want).max() < 1e-12 * size * len(d)
    assert (np.diff(d) >= -1e-12 * size).all()


@pytest.mark.parametrize("seed", range(30))
def test_rank_one_against_the_full_matrix(seed):
    r = np.random.default_rng(seed)
    p = int(r.integers(1, 24))
    q = np.linalg.qr(r.normal(size=(p, p)))[0]
    d = np.sort(r.choice([0.0, 1.0, 1.0, 3.0, 1e-9, 1e6], p) * r.choice([1.0, r.random()], p))
    z = r.normal(size=p) * r.choice([0.0, 1e-14, 1.0, 1e3], p)
    rho = float(r.choice([1e-6, 1.0, 1e4]))
    got = H.rank_one(d, q, z, rho)
    close_spectrum(*got, (q * d) @ q.T + rho * np.outer(q @ z, q @ z))


def test_secular_roots_lie_between_the_poles():
    r = np.random.default_rng(1)
    for _ in range(50):
        d = np.sort(r.random(12) * 10 ** r.uniform(-3, 3, 12))
        z2 = r.random(12) * 10 ** r.uniform(-8, 0, 12)
        rho = 10 ** r.uniform(-3, 3)
        distance, roots = H.secular_roots(d, z2, rho)
        want = np.linalg.eigvalsh(np.diag(d) + rho * np.sqrt(np.outer(z2, z2)))
        assert np.allclose(roots, want, rtol=1e-12, atol=1e-14 * want[-1])
        assert (np.diag(distance) <= 0).all()


def test_updates_and_merges_give_the_scatter():
    r = np.random.default_rng(2)
    x = np.floor(r.normal(size=(300, 9)) @ r.normal(size=(9, 9)) * 40)
    x[50:150] = x[50]  # one vector many times
    whole, parts = H.Spectrum(9), []
    for lo in (0, 5, 100, 210):
        part = H.Spectrum(9)
        for row in x[lo:{0: 5, 5: 100, 100: 210, 210: 300}[lo]]:
            part.add(row, 1)
        parts.append(part)
    for part in parts:
        whole.merge(H.Spectrum.of(*part.row()))
    away = x - x.mean(axis=0)
    assert whole.n == 300 and (whole.sums == x.sum(axis=0)).all()
    close_spectrum(whole.d, whole.u, away.T @ away)
    weighted = H.Spectrum(9)
    for row, times in zip(*np.unique(x, axis=0, return_counts=True)):
        weighted.add(row, int(times))
    close_spectrum(weighted.d, weighted.u, away.T @ away)


def brute(rows, components=H.COMPONENTS):
    """By length: ids, deviations, |whitened|, explained, from numpy's own decomposition."""
    out = {}
    for dim in {len(v) for _, v in rows}:
        ids = [i for i, v in rows if len(v) == dim]
        x = np.array([[int(np.floor(64 * np.float64(c))) + 1_000_000 for c in v]
                      for _, v in rows if len(v) == dim], np.int64)
        n, sums = len(x), x.sum(axis=0)
        dev = [sum((n * int(a) - int(s)) ** 2 for a, s in zip(row, sums)) for row in x]
        away = x - sums / n
        e, u = np.linalg.eigh(away.T @ away / n)
        e, u = e[::-1], u[:, ::-1]
        k = [c for c in range(min(components, dim)) if e[c] > 1e-10 * e.sum()]
        out[dim] = (ids, dev, np.abs(away @ u[:, k] / np.sqrt(e[k])), e[k] / e.sum(), n)
    return out


def compare(df, rows):
    want = brute(rows)
    got = H.whiten(df).collect()
    for ids, dev, white, explained, n in want.values():
        mine = [r for r in got if r.n == n and r.vec_id in set(ids)]
        assert len(mine) == white.size
        at = {(i, c + 1): (dev[k], white[k, c], explained[c])
              for k, i in enumerate(ids) for c in range(white.shape[1])}
        signs = {}
        for r in mine:
            d, w, x = at[r.vec_id, r.component]
            assert r.deviation == d and abs(r.explained - x) <= 1e-9 * x
            assert abs(abs(r.whitened) - w) < 1e-6
            assert r.identity_error < 1e-9
            signs.setdefault(r.component, []).append(r.whitened)
        for values in signs.values():
            assert abs(np.mean(values)) < 1e-9  # one sign for all rows keeps the mean at zero
    assert len(got) == sum(w[2].size for w in want.values())


def test_table_against_numpy(spark, sf):
    df = spark.read.parquet(f"{sf}/embeddings.parquet").repartition(23)
    compare(df, [(r.vec_id, r.embedding) for r in df.collect()])


def test_messy_vectors(spark):
    r = np.random.default_rng(5)
    rows = [(i, [float(v) for v in r.normal(size=4)]) for i in range(40)]
    rows += [(100 + i, [float(v) for v in r.normal(size=2)]) for i in range(20)]
    rows += [(200 + i, rows[0][1]) for i in range(30)]
    bad = [(900, None), (901, []), (902, [1.0, None, 2.0, 3.0]), (903, [1.0, float("nan"), 0., 0.]),
           (904, [float("inf"), 0.0])]
    df = spark.createDataFrame([(i, v, "a", 3) for i, v in rows + bad],
                               "vec_id bigint, embedding array<float>, white string, dim int")
    rows = [(i, [float(np.float32(c)) for c in v]) for i, v in rows]
    compare(df, rows)
    compare(df.repartition(5), rows)


def test_no_variance_no_rows_and_empty_table(spark):
    schema = "vec_id bigint, embedding array<float>"
    assert H.whiten(spark.createDataFrame([], schema)).collect() == []
    assert H.whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], schema)).collect() == []
    line = H.whiten(spark.createDataFrame([(None, [1.0, 2.0]), (2, [3.0, 2.0])], schema)).collect()
    assert [(r.vec_id, r.component, abs(round(r.whitened, 12))) for r in line] in (
        [(None, 1, 1.0), (2, 1, 1.0)], [(2, 1, 1.0), (None, 1, 1.0)])


def test_very_large_entries(spark):
    df = spark.createDataFrame([(1, [1e30, 0.0]), (2, [-1e30, 1.0]), (3, [0.0, 2.0])],
                               "vec_id bigint, embedding array<float>")
    got = H.whiten(df).collect()
    assert {r.deviation for r in got} <= {None, *(r.deviation for r in got)}
    assert len(got) >= 3
