import math

import pytest
from pyspark.sql import functions as F

from winnow.llm import neighbours as N


def brute(rows, k, every):
    good = [(i, [float(x) for x in v]) for i, v in rows
            if i is not None and v and all(x is not None and math.isfinite(x) for x in v)
            and any(v)]
    out = []
    for q in sorted({i for i, _ in good if i % every == 0}):
        found = []
        for own, a in good:
            for i, b in good if own == q else ():
                if i != q and len(a) == len(b):
                    dot = na = nb = 0.0
                    for x, y in zip(a, b):
                        dot, na, nb = dot + x * y, na + x * x, nb + y * y
                    found.append((-(dot / (math.sqrt(na) * math.sqrt(nb))), i))
        out += [(q, n, i, -s) for n, (s, i) in enumerate(sorted(found)[:k], 1)]
    return out


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").withColumns(
        {"ids": F.lit("x"), "score": F.lit(1), "query_id": F.lit(2)}).repartition(3)


@pytest.mark.parametrize("small", [False, True])
def test_against_brute_force(spark, monkeypatch, small):
    if small:  # many blocks, tiles and tasks
        for name, value in (("QUERY_ROWS", 3), ("BLOCK_ROWS", 7), ("BLOCKS_PER_TASK", 2)):
            monkeypatch.setattr(N, name, value)
    import random

    rnd = random.Random(4)
    rows = [(i, [rnd.randrange(-3, 4) / 2 for _ in range(6)]) for i in range(120)]
    rows += [(200 + i, [1.0, 2.0, 0.0, 0.0, 0.0, 1.0]) for i in range(30)]  # one hot vector
    rows += [(None, [1.0] * 6), (300, None), (301, []), (302, [0.0] * 6), (303, [1.0, None]),
             (304, [float("nan")] + [1.0] * 5), (305, [float("inf")] + [1.0] * 5),
             (400, [1.0, 2.0]), (401, [2.0, 4.0]), (402, [1.0, 0.0]), (40, rows[40][1])]
    got = sorted(tuple(r) for r in N.nearest(
        frame(spark, rows), F.col("vec_id") % 10 == 0, 5).collect())
    assert got == brute(rows, 5, 10)


def test_few_rows_and_empty_table(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.0, 1.0])]
    got = N.nearest(frame(spark, rows), F.col("vec_id") == 0).collect()
    assert [tuple(r) for r in got] == [(0, 1, 1, 0.0)]
    assert N.nearest(frame(spark, rows).limit(0), F.col("vec_id") == 0).count() == 0


@pytest.mark.parametrize("times", [2, 5, 7])
def test_repeated_rows_lose_no_neighbour(spark, times):
    import random

    rnd = random.Random(9)
    rows = [(i, [rnd.gauss(0, 1) for _ in range(8)]) for i in range(60)]
    rows = [(i, [float(x) for x in F_(v)]) for i, v in rows]
    nearest = {i for _, n, i, _ in brute(rows, 5, 10) if n == 1}
    rows += [r for r in rows if r[0] in nearest for _ in range(times - 1)]
    rows += [(i, [2 * x for x in v]) for i, v in rows[:60] if i in nearest]  # equal cosine
    rows += [(100, rows[10][1])] * times + [(101 + i, rows[10][1]) for i in range(4)]
    got = sorted(tuple(r) for r in N.nearest(
        frame(spark, rows).coalesce(1), F.col("vec_id") % 10 == 0, 5).collect())
    want = brute(rows, 5, 10)
    assert [r[:3] for r in got] == [r[:3] for r in want]


def test_query_equals_its_sql_on_repeated_rows(spark, tmp_path):
    import random

    import duckdb

    rnd = random.Random(2)
    rows = [(i, [rnd.randrange(-4, 5) / 4 for _ in range(3)]) for i in range(0, 100, 3)]
    rows += [(99, rows[0][1])] * 4 + [(50, rows[0][1])] * 3 + [(0, rows[5][1])] * 2
    rows += [(150 + i % 2 * 7, rows[0][1]) for i in range(40)]  # one vector many times, two ids
    frame(spark, rows).select("vec_id", "embedding").write.parquet(str(tmp_path / "embeddings.parquet"))
    con = duckdb.connect()
    con.execute(f"create view embeddings as from read_parquet('{tmp_path}/embeddings.parquet/*.parquet')")
    want = sorted(con.execute(N.OP7_SQL).fetchall())
    got = sorted(tuple(r) for r in N.op7_nearest_vectors(spark, str(tmp_path)).collect())
    assert [r[:3] for r in got] == [r[:3] for r in want]
    assert all(abs(a[3] - b[3]) < 1e-12 for a, b in zip(got, want))


def F_(v):
    import numpy as np

    return np.array(v, np.float32)
