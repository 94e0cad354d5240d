"""Result sets with commit records, tree digests, signed logs, as-of ties, sweeps."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from winnow.operators import decide as D
from winnow.operators import joins as J
from winnow.operators import logs as L
from winnow.operators import primitives as N
from winnow.settings import DEFAULTS as S
from winnow.sources import files as R


def test_half_written_sets_are_not_seen(spark, tmp_path):
    folder = str(tmp_path / "sets")
    a, b = spark.range(3).toDF("x"), spark.range(5).toDF("y")
    schemas = {"a": a.schema, "b": b.schema}

    def counts(key="k", version=1):
        found = R.load_result_tables(spark, folder, schemas, key, version)
        return {n: df.count() for n, df in found.items()}

    assert counts() == {"a": 0, "b": 0}  # nothing was ever stored
    R.write_attempt({"a": a}, folder, "k", 1, "died")
    assert counts() == {"a": 0, "b": 0}
    R.save_result_set({"a": a, "b": b}, folder, "k", 1)
    R.write_attempt({"a": a}, folder, "k", 1, "died again")
    assert counts() == {"a": 3, "b": 5} and counts("other") == counts(version=2) == {"a": 0, "b": 0}
    R.save_result_set({"a": a.limit(1)}, folder, "k", 1)  # the newest commit has one table
    assert counts() == {"a": 1, "b": 0}
    with pytest.raises(ValueError):
        R.save_result_set({R.COMMITS: a}, folder, "k", 1)


def brute_tree(files, per):
    def sha(lines):
        return hashlib.sha256("\n".join(sorted(lines)).encode()).hexdigest()

    def fold(lines):
        parts = -(-len(lines) // per)
        buckets = {}
        for line in lines:
            key = int(hashlib.md5(line.encode()).hexdigest()[:12], 16)
            buckets.setdefault(int(key * parts / float(1 << 48)), []).append(line)
        digests = {b: sha(ls) for b, ls in buckets.items()}
        while parts > 1:
            parts, up = -(-parts // per), {}
            for b, d in digests.items():
                up.setdefault(b // per, []).append(f"{b:012d} {d}")
            digests = {b: sha(ls) for b, ls in up.items()}
        return digests[0]

    def folder(prefix):
        lines, below = [], set()
        for path, digest in files.items():
            if path.startswith(prefix):
                rest = path[len(prefix):]
                if "/" in rest:
                    below.add(rest.split("/")[0])
                else:
                    lines.append(f"file {rest} {digest}")
        return fold(lines + [f"folder {b} {folder(prefix + b + '/')}" for b in below])

    return folder("")


@pytest.mark.parametrize("per", [3, 1000])
def test_tree_hash_against_a_recursive_one(spark, per):
    rnd = random.Random(2)
    files = {"/".join(rnd.choice("abc") for _ in range(rnd.randrange(4))) + f"/f{i}": f"{i:064d}"
             for i in range(120)}
    files = {p.lstrip("/"): d for p, d in files.items()}

    def tree(given):
        df = spark.createDataFrame(list(given.items()), "path string, sha256 string").repartition(5)
        return tuple(R.tree_hash(df, per).first())

    assert tree(files) == (brute_tree(files, per), 120)
    changed = {**files, sorted(files)[7]: "0" * 63 + "x"}
    assert tree(changed)[0] != tree(files)[0]
    assert R.tree_hash(spark.createDataFrame([], "path string, sha256 string")).count() == 0


def test_file_hashes_and_tree_of_a_folder(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    for name, data in (("one", b"1"), ("sub/two", b"22")):
        (tmp_path / name).write_bytes(data)
    found = R.file_hashes(spark, str(tmp_path))
    assert {r.path: r.sha256 for r in found.collect()} == {
        n: hashlib.sha256(d).hexdigest() for n, d in (("one", b"1"), ("sub/two", b"22"))}
    assert R.tree_hash(found).first().files == 2


@pytest.fixture(scope="module")
def large_folder(tmp_path_factory):
    """A small file and one of over 2 GB, all of it a hole but its end."""
    folder = tmp_path_factory.mktemp("large")
    (folder / "small").write_bytes(b"1")
    with open(folder / "large", "wb") as f:
        f.seek(2 ** 31 + 5)
        f.write(b"end")
    want = {}
    for name in ("small", "large"):
        with open(folder / name, "rb") as f:
            want[name] = hashlib.file_digest(f, "sha256").hexdigest()
    return str(folder), want


def test_a_file_larger_than_a_value_can_be(spark, large_folder):
    folder, want = large_folder
    found = R.file_hashes(spark, folder)
    assert {r.path: r.sha256 for r in found.collect()} == want
    assert {r.path: r.status for r in R.integrity(found, found).collect()} == dict.fromkeys(want, "ok")


def test_tree_of_a_folder_with_a_large_file(spark, large_folder):
    folder, want = large_folder
    assert tuple(R.tree_hash(R.file_hashes(spark, folder)).first()) == (brute_tree(want, 1000), 2)


def test_refused_attempts_are_part_of_the_chain(spark):
    attempts = spark.createDataFrame(
        [(1, 1, "a", "ann", "p-ann", "stop", "ok"), (1, 2, "b", "ann", "wrong", "stop", "ok"),
         (1, 3, "c", "bob", "p-bob", "stop", "why"), (1, 4, "d", None, "p", "stop", "ok"),
         (1, 5, "e", "ann", None, "stop", "ok"), (2, 1, "f", "bob", "p-bob", "play", "why"),
         (2, 2, "g", "bob", "p-bob", "go", "ok")],
        "log long, seq long, text string, user_name string, proof string, meaning string, "
        "reason_code string")
    accounts = spark.createDataFrame([("ann", "lead", "p-ann"), ("bob", "operator", "p-bob")],
                                     "user_name string, account_role string, credential string")
    chain = N.settle(L.signed_log(attempts, accounts, ("stop", "go"), ("ok",), "log", "seq", ["text"]))
    got = {(r.log, r.text): (r.action, r.problem, r.role) for r in chain.collect()}
    assert got == {
        (1, "a"): ("stop", None, "lead"), (1, "b"): (L.REFUSED, "credential", "lead"),
        (1, "c"): (L.REFUSED, "reason", "operator"), (1, "d"): (L.REFUSED, "user", "unknown"),
        (1, "e"): (L.REFUSED, "credential", "lead"), (2, "f"): (L.REFUSED, "meaning", "operator"),
        (2, "g"): ("go", None, "operator")}
    assert "proof" not in chain.columns and "credential" not in chain.columns
    body = L.row_digest(["text", *L.DECISION])

    def problems(df):
        return {r.log: r.problem for r in L.verify_chain(
            df.withColumn("line", F.col("seq")), "log", "line", body).collect()}

    assert problems(chain) == {1: None, 2: None}
    assert problems(chain.filter("text <> 'b'"))[1] == "number"  # a refused one was taken out
    assert problems(chain.withColumn("problem", F.when(
        F.col("text") != "c", F.col("problem"))))[1] == "content"


@pytest.mark.parametrize("size", [None, 3])
def test_asof_with_a_crowded_instant(spark, monkeypatch, size):
    monkeypatch.setattr(N, "HOT_ROWS", 5)
    rnd = random.Random(1)
    series = [("a", float(t), float(v)) for t, v in ((0, 1), (5, 3), (5, 7), (10, 2), (20, 8))]
    times = [5.0] * 200 + [7.5] * 100 + [rnd.uniform(-3, 25) for _ in range(100)] + [None]
    rec = spark.createDataFrame([("a", t, i) for i, t in enumerate(times)] + [("b", 1.0, 999)],
                                "g string, t double, i long").repartition(3)
    ser = spark.createDataFrame(series, "g string, t double, v double")
    got = {r.i: r.out for r in J.asof_interpolate(rec, ser, ["g"], "t", "v", "out", size).collect()}
    assert len(got) == len(times) + 1 and got[999] is None and got[400] is None
    for i, t in enumerate(times[:-1]):
        before = max(((a, v) for _, a, v in series if a <= t), default=None)
        after = min(((a, v) for _, a, v in series if a >= t), default=None)
        if before is None or after is None:
            want = (before or after)[1]
        elif before[0] == after[0]:
            want = before[1]
        else:
            want = before[1] + (after[1] - before[1]) * (t - before[0]) / (after[0] - before[0])
        assert got[i] == pytest.approx(want)


def sweep_tables(spark):
    rnd = random.Random(3)
    est = [(b, s, rnd.randrange(50, 300), rnd.uniform(10, 20), rnd.uniform(8, 14), 8 + s / 3,
            rnd.uniform(0, 0.4), rnd.uniform(0, 0.3), sorted(rnd.gauss(8 + s / 3, 1) for _ in range(20)))
           for b in range(3) for s in range(25)]
    spray = [(b, s, float(s), 18.0) for b in range(3) for s in range(25)]
    return est, spray, spark.createDataFrame(
        est, "batch_id long, step long, n_window long, raw_mean double, raw_d10 double, "
             "hybrid_d10 double, hybrid_cv double, undecided_rate double, d10_reps array<double>"
        ).withColumn("p_spec", F.lit(None).cast("double")), spark.createDataFrame(
        spray, "batch_id long, step long, sprayed_g double, target_g double")


@pytest.mark.parametrize("cases", [10_000, 3])
def test_sweep_reads_the_probability_of_each_specification(spark, monkeypatch, cases):
    monkeypatch.setattr(D, "SWEEP_CASES", cases)
    est, spray, e, sp = sweep_tables(spark)
    grid = J.case_grid(spark, {"spec_d10_um": (9.0, 11.0, 13.0), "p_spec_min": (0.3, 0.9),
                               "min_objects": (60.0, 120.0), "cv_target": (0.1, 0.3)})
    got = {(r.batch_id, r.spec_d10_um, r.p_spec_min, r.min_objects, r.cv_target, r.rule): r.stop
           for r in D.sweep_stops(e, sp, grid, S).collect()}
    assert len(got) == 3 * 24 * 4
    for (b, spec, p_min, n_min, cv, rule), stop in got.items():
        def hit(row):
            _, s, n, mean, raw, hyb, cv_, und, reps = row
            if rule == "C0":
                return s >= 18
            if rule == "C1":
                return n >= n_min and mean >= S.target_mean_um
            if rule == "C2":
                return n >= n_min and raw >= spec
            p = sum(x >= spec for x in reps) / len(reps) if hyb >= spec else 0
            return n >= n_min and p > p_min and cv_ < cv and und < S.undecided_limit
        assert stop == min((r[1] for r in est if r[0] == b and hit(r)), default=None)


def test_resumed_sweep_computes_what_is_missing(spark):
    seen = []

    def compute(todo):
        seen.append(sorted(r.k for r in todo.collect()))
        return todo.withColumn("v", F.col("k") * 2)

    cases = spark.range(6).toDF("k")
    stored = spark.createDataFrame([(1, 2), (4, 8)], "k long, v long")
    out, new = D.sweep_resumed(cases, stored, "k", compute)
    assert seen == [[0, 2, 3, 5]] and new.count() == 4
    assert sorted(map(tuple, out.collect())) == [(k, 2 * k) for k in range(6)]
    assert D.sweep_resumed(cases, out, "k", compute)[1].count() == 0 and len(seen) == 1


def test_circle_of_noisy_arcs(spark):
    import numpy as np

    from winnow.operators import geometry as G

    gen = np.random.default_rng(3)
    rows, want = [], {}
    for i in range(30):
        c, r = gen.normal(0, 300, 2), gen.uniform(50, 500)
        a = gen.uniform(0.3, 6) + np.linspace(0, gen.uniform(0.6, 3), 25)
        p = np.stack([c[0] + r * np.cos(a), c[1] + r * np.sin(a)], 1) + gen.normal(0, 0.01, (25, 2))
        rows += [(i, float(x), float(z)) for x, z in p]
        # Pratt's fit as a plain eigenproblem
        m = p.mean(axis=0)
        u = p - m
        z = np.column_stack([(u ** 2).sum(1), u, np.ones(25)])
        b = np.array([[0, 0, 0, -2], [0, 1, 0, 0], [0, 0, 1, 0], [-2, 0, 0, 0]], float)
        e, v = np.linalg.eig(np.linalg.solve(b, z.T @ z / 25))
        k = min((k for k in range(4) if e[k].real > -1e-9), key=lambda k: e[k].real)
        q = v[:, k].real
        want[i] = (*(m - q[1:3] / q[0] / 2), float(np.sqrt(q[1:3] @ q[1:3] - 4 * q[0] * q[3])
                                                   / abs(q[0]) / 2))
    rows += [(99, float(t), 2.0 * t) for t in range(9)]  # a line has no circle
    df = spark.createDataFrame(rows, "i long, x double, z double")
    got = {r.i: (r.xc, r.zc, r.radius) for r in G.fit_circle(df, ["i"], "x", "z").collect()}
    assert set(got) == set(want)
    for i, w in want.items():
        assert got[i] == pytest.approx(w, rel=1e-5, abs=1e-3)
