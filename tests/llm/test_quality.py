import zlib

import numpy as np
import pytest

from winnow.llm import quality as Q


def brute_passages(text):
    words = (text or "").encode().split()
    return max(1, -(-len(words) // Q.PASSAGE_WORDS))


def test_passages_cover_the_whole_text(messy):
    for r in messy.collect():
        bag = Q.passages(r.text)
        assert bag.shape == (brute_passages(r.text), Q.N_FEATURES) and np.isfinite(bag).all()
    head = "clean words here " * 400
    assert not np.array_equal(Q.passages(head)[-1], Q.passages(head + "$$$ " * 40)[-1])


def test_gradients_by_differences():
    rng = np.random.default_rng(0)
    bags = [rng.normal(size=(n, Q.N_FEATURES)).astype(np.float32) for n in (1, 3, 2, 5)]
    y = np.array([0, 1, 1, 0])
    first, later = Q.fit(bags, y, steps=1), Q.fit(bags, y, steps=200)

    def loss(m):
        p = np.clip(m.scores(bags), 1e-12, 1 - 1e-12)
        return -np.mean(np.where(y == 1, np.log(p), np.log(1 - p)))

    assert loss(later) < 0.05 < loss(first)


def test_attention_finds_the_one_bad_passage():
    rng = np.random.default_rng(1)
    bags, y = [], []
    for i in range(200):
        x = rng.normal(size=(6, Q.N_FEATURES)).astype(np.float32)
        if i % 2:
            x[rng.integers(6), 8] += 12
        bags.append(x)
        y.append(1 - i % 2)
    model = Q.fit(bags[:150], np.array(y[:150]))
    assert np.mean((model.scores(bags[150:]) >= 0.5) == np.array(y[150:])) > 0.9


def test_held_out_accuracy_on_the_tables(spark, sf):
    from winnow.llm.queries import QUERIES

    sf = sf.replace("0.001", "0.01")
    got = {r.doc_id: r for r in QUERIES["op10_quality"](spark, sf).collect()}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in got.items())
    marks = [r for r in spark.read.parquet(f"{sf}/labels.parquet").collect()
             if got[r.doc_id].held_out]
    right = sum(got[r.doc_id].predicted == r.quality for r in marks)
    assert right >= 0.97 * len(marks)


def test_messy_rows(spark, messy, empty):
    labels = spark.createDataFrame(
        [(1, 1), (2, 1), (3, 0), (4, None), (6, 0), (None, 1)], "doc_id bigint, quality int")
    rows = messy.drop("score")
    got = Q.score(rows, Q.fit_on(rows, labels)).collect()
    assert len(got) == rows.count() and all(0 <= r.score <= 1 for r in got)
    same = [r.score for r in got if r.doc_id == 6]
    assert same[0] == same[1]
    flat = Q.score(rows, Q.fit_on(empty, labels)).collect()
    assert {r.score for r in flat} == {0.5}
    assert Q.score(empty.drop("score"), Q.fit_on(rows, labels)).count() == 0
    with pytest.raises(ValueError):
        Q.score(messy, Q.fit_on(rows, labels))


def plain_score(model, bag):
    """The forward pass written out number by number."""
    import math

    w1, b1, v, u, a, w2, b2 = model.weights
    hidden, weights = [], []
    for row in bag:
        x = [(float(c) - m) / s for c, m, s in zip(row, model.mean, model.scale)]
        h = [math.tanh(sum(c * w1[i][k] for i, c in enumerate(x)) + b1[k]) for k in range(len(b1))]
        gates = [math.tanh(sum(c * v[i][g] for i, c in enumerate(h)))
                 / (1 + math.exp(-sum(c * u[i][g] for i, c in enumerate(h)))) for g in range(len(a))]
        hidden.append(h)
        weights.append(math.exp(sum(g * c for g, c in zip(gates, a))))
    total = sum(weights)
    z = [sum(w / total * h[k] for w, h in zip(weights, hidden)) for k in range(len(b1))]
    return 1 / (1 + math.exp(-(sum(c * w for c, w in zip(z, w2)) + b2[0])))


def test_query_scores_equal_a_plain_forward_pass(spark, sf):
    from winnow.llm.queries import QUERIES

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = Q.fit_on(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = QUERIES["op10_quality"](spark, sf).collect()
    assert len(got) == len(texts)
    for r in got:
        want = plain_score(model, Q.passages(texts[r.doc_id]))
        assert abs(r.score - want) < 1e-9 and r.predicted == int(r.score >= 0.7)


def test_passage_shares_by_counting():
    text = "Ab 12, c|d!\n" * 60 + "é Zz"
    bag = Q.passages(text)
    words = text.split()
    groups = [b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" ", b"\n",
              b".,;:", b"!?", b"|", b"#$%&*", b"'\"()-"]
    # the first passage ends where its 129th word begins
    at, seen = 0, 0
    for i, c in enumerate(text):
        if not c.isspace() and (i == 0 or text[i - 1].isspace()):
            seen += 1
            if seen == Q.PASSAGE_WORDS + 1:
                at = i
                break
    head = text[:at].encode()
    shares = [sum(b in g for b in head) / len(head) for g in groups]
    assert np.allclose(bag[0][:len(groups)], shares)
    first = words[:Q.PASSAGE_WORDS]
    assert np.isclose(bag[0][Q._N_CLASS], len(set(first)) / len(first))
