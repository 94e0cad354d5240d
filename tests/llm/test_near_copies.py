import random

import numpy as np
import pytest

from winnow.llm import near_copies as C
from winnow.llm import simhash


def cut(t):
    w = (t or "").lower().split()
    return {" ".join(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def overlap(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def jaccard(a, b):
    return overlap(cut(a), cut(b))


def brute(rows):
    """Smallest id of every component of pairs at 0.8 or more."""
    part = list(range(len(rows)))
    sets = [cut(t) for _, t in rows]
    for i in range(len(rows)):
        for j in range(i):
            if part[i] != part[j] and overlap(sets[i], sets[j]) >= 0.8:
                part = [part[j] if p == part[i] else p for p in part]
    least = {}
    for n, (i, _) in enumerate(rows):
        least[part[n]] = min(i, least.get(part[n], i))
    return sorted(least.values())


def edited(words, at, tag):
    return " ".join(f"{tag}{i}" if i in at else w for i, w in enumerate(words))


@pytest.mark.parametrize("chunk", [512, 3])
def test_components_against_brute_force(spark, monkeypatch, chunk):
    monkeypatch.setattr(C, "CHUNK_ROWS", chunk)  # 3: groups are cut into many tiles
    rnd = random.Random(5)
    rows = []
    for g in range(12):
        words = [f"g{g}w{rnd.randrange(400)}" for _ in range(150)]
        for v in range(9):  # versions of one text, from close to far
            rows.append((len(rows), edited(words, set(rnd.sample(range(150), v // 2)), f"x{v}y")))
    rows += [(500, "A b"), (501, "a  B"), (502, "a b c"), (503, ""), (504, " \n")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    got = sorted(r.doc_id for r in C.kept_rows(docs).collect())
    assert got == brute(rows) and len(got) < len(rows) / 2


def test_near_copies_beyond_the_reach_of_the_fingerprints(spark):
    words = [f"w{i}" for i in range(300)]
    near, far = edited(words, {40, 120, 200, 280}, "x"), edited(words, set(range(0, 300, 14)), "x")
    assert jaccard(" ".join(words), near) >= 0.8 > jaccard(" ".join(words), far)
    bits = simhash.fingerprint(" ".join(words)) ^ simhash.fingerprint(near)
    assert bits.bit_count() > 2
    docs = spark.createDataFrame([(1, " ".join(words)), (2, near), (3, far)],
                                 "doc_id bigint, text string")
    assert sorted(r.doc_id for r in C.kept_rows(docs).collect()) == [1, 3]


def test_documents_of_the_test_tables(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert sorted(r.doc_id for r in C.kept_rows(docs).collect()) == brute(rows)


def test_repeated_and_missing_ids(spark):
    words = [f"w{i}" for i in range(300)]
    base, near = " ".join(words), edited(words, {40, 120}, "x")
    rows = [(1, base), (5, near), (1, "quite another text " * 9), (None, near.replace("w", "v")),
            (None, base.replace("w", "v")), (None, None), (7, "")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = sorted((r.doc_id or -1, r.text or "") for r in C.kept_rows(docs).collect())
    assert [i for i, _ in got] == [-1, 1, 1, 7]


def test_exact_threshold_counts_as_similar():
    a = np.arange(9, dtype=np.uint64)
    assert list(C.links([a[:8], a[:8], a])) and list(C.links([a[:4], np.arange(5, dtype=np.uint64)]))
    assert not list(C.links([a[:3], a[:4]]))


def test_chains_in_one_bucket_and_a_bucket_of_unlike_sets(spark, monkeypatch):
    # every set in one bucket: links must be found whatever the smallest member is like
    monkeypatch.setattr(C, "CHUNK_ROWS", 4)
    monkeypatch.setattr(C, "bands", lambda found: [1, 2] if len(found) else [])
    rnd = random.Random(11)
    rows = []
    for g in range(6):
        words = [f"g{g}w{i}" for i in range(100)]
        for v in range(7):  # each version is alike to its neighbours only
            words = words[:14 * v] + [f"g{g}v{v}n{i}" for i in range(5)] + words[14 * v + 5:]
            rows.append((len(rows), " ".join(words)))
    rows += [(900 + i, " ".join(f"u{i}x{rnd.randrange(500)}" for _ in range(30))) for i in range(9)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    got = sorted(r.doc_id for r in C.kept_rows(docs).collect())
    assert got == brute(rows) and 9 < len(got) < len(rows)


def test_joined_members_are_not_compared_again():
    a = [np.arange(i, 100 + i, dtype=np.uint64) for i in range(4)]
    assert len(list(C.links(a))) == 3 and len(list(C.links(a, None, [1, 1, 2, 2]))) == 1
    assert not list(C.links(a, None, [1, 1, 1, 1]))
    assert not list(C.links(a, [0, 0, 0, 0], [1, 2, 3, 4]))


def test_empty_table_and_clashing_names(spark):
    schema = "doc_id bigint, text string, fp string, key int, hub string, n int"
    assert C.kept_rows(spark.createDataFrame([], schema)).count() == 0
    words = " ".join(f"w{i}" for i in range(50))
    rows = [(2, words, "f", 1, "h", 3), (1, words + " ", "f", 1, "h", 3), (3, "else", None, None, None, 1)]
    got = C.kept_rows(spark.createDataFrame(rows, schema))
    assert got.columns == ["doc_id", "text", "fp", "key", "hub", "n"]
    assert sorted(r.doc_id for r in got.collect()) == [1, 3]
