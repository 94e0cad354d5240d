import random
import re

import xxhash

from winnow.llm import simhash as S


def brute_fingerprint(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64)
               if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(values, radius=2):
    root = {v: v for v in values}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(values):
        for b in values[i + 1:]:
            if (a ^ b).bit_count() <= radius and find(a) != find(b):
                root[max(find(a), find(b))] = min(find(a), find(b))
    return {v: find(v) for v in values}


def dense(seed, bases=12, each=40, flips=6):
    rnd = random.Random(seed)
    out = set()
    for _ in range(bases):
        base = rnd.getrandbits(64)
        for _ in range(each):
            v = base
            for _ in range(rnd.randrange(flips)):
                v ^= 1 << rnd.randrange(64)
            out.add(v)
    return sorted(out)


def signed(v):
    return v - (1 << 64) if v >> 63 else v


def test_fingerprints_of_messy_rows(messy, empty):
    for r in S.fingerprints(messy, ("doc_id",)).join(
            messy.select("doc_id", "text"), "doc_id").collect():
        assert r.fp == signed(brute_fingerprint(r.text))
    assert S.fingerprints(empty).count() == 0


def test_stars_against_brute_force():
    for radius in (0, 1, 2, 3):
        for seed in range(6):
            values = dense(seed, bases=4)
            want = brute_components(values, radius)
            got = dict(S.stars(values, radius))
            assert {v: got.get(v, v) for v in values} == want
    assert list(S.stars([5])) == [] and list(S.stars([5, 7])) == [(7, 5)]


def test_components_through_both_cuts(spark, monkeypatch):
    monkeypatch.setattr(S, "BUCKET_ROWS", 8)
    values = dense(9)
    want = brute_components(values)
    least = {}
    for i, v in enumerate(values):
        least.setdefault(want[v], i)
    rows = spark.createDataFrame([(i, signed(v)) for i, v in enumerate(values)],
                                 "doc_id bigint, fp bigint").repartition(3)
    got = {r.fp: r.component_id for r in S.near_dedup(rows).collect()}
    assert got == {signed(v): least[want[v]] for v in values}


def test_a_long_chain_is_one_component(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(300)], "a bigint, b bigint")
    got = S.components(edges.repartition(4)).collect()
    assert len(got) == 300 and {r.root for r in got} == {0}


def test_kept_rows_hold_one_row_of_each_component(messy, empty):
    kept = S.kept_rows(messy)
    assert kept.columns == messy.columns
    fps = [brute_fingerprint(r.text) for r in kept.collect()]
    want = brute_components(sorted({brute_fingerprint(r.text) for r in messy.collect()}))
    assert len(fps) == len(set(want.values()))
    assert S.kept_rows(empty).count() == 0


def test_kept_rows_go_by_component_and_not_by_id(spark, monkeypatch):
    from winnow.llm import simhash

    # one id in two components; a component whose ids are all null
    docs = spark.createDataFrame([(1, 0), (5, 1), (1, 0xFFFF), (None, 0xFF0000), (None, 0xFF0001)],
                                 "doc_id bigint, n bigint")
    monkeypatch.setattr(simhash, "fingerprints", lambda df, keep: df.select(*keep, "n").withColumnRenamed("n", "fp"))
    got = sorted((r.doc_id or 0, r.n) for r in simhash.kept_rows(docs).collect())
    assert len(got) == 3 and got[0][1] in (0xFF0000, 0xFF0001) and got[1:] == [(1, 0), (1, 0xFFFF)]
