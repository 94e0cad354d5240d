import heapq
import random
import zlib
from collections import Counter, defaultdict

import pytest

from winnow.llm import common, sharding


def plain_lpt(sizes, shards):
    heap = [(0, i) for i in range(shards)]
    out = []
    for size in sorted(sizes, reverse=True):
        load, i = heapq.heappop(heap)
        out.append((size, i))
        heapq.heappush(heap, (load + size, i))
    return Counter(out)


@pytest.mark.parametrize("seed", range(12))
def test_runs_equal_one_group_at_a_time(seed):
    r = random.Random(seed)
    shards = r.choice([1, 2, 7, 40])
    counts = {r.randint(1, 60): r.choice([1, 3, 50, 900]) for _ in range(r.randint(1, 12))}
    want = plain_lpt([s for s, n in counts.items() for _ in range(n)], shards)
    got = Counter()
    for size, dealt in sharding.lpt(sorted(counts.items(), reverse=True), shards):
        for i, n in enumerate(dealt):
            got[size, i] += n
    assert +got == want


def brute(rows, shards):
    """Bytes of every shard by the plain rule over groups of equal texts."""
    groups = Counter()
    for _, text in rows:
        groups[text or ""] += len((text or "").encode()) + sharding.ROW_BYTES
    loads = Counter()
    for (size, i), n in plain_lpt(groups.values(), shards).items():
        loads[i] += size * n
    return sorted(loads.values())


def checked(rows, got, shards):
    assert Counter((r.doc_id, r.text_crc32, r.size) for r in got) == Counter(
        (i, zlib.crc32((t or "").encode()), len((t or "").encode()) + 16) for i, t in rows)
    loads, slots, homes = Counter(), defaultdict(list), defaultdict(set)
    for r in got:
        loads[r.shard] += r.size
        slots[r.shard].append(r.slot)
        homes[r.digest].add(r.shard)
    assert sorted(loads.values()) == brute(rows, shards)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(len(h) == 1 for h in homes.values())


def made(seed, n=600):
    r = random.Random(seed)
    rows = [(i if r.random() < 0.8 else r.choice([None, 7]), r.choice(
        ["hot text"] * 4 + [None, "", "x" * r.randint(1, 9), f"text {r.randint(0, 80)}", "é" * 30]))
        for i in range(n)]
    return rows + [(5, "again and again")] * 90


@pytest.mark.parametrize("per_part", [20_000, 16])
def test_against_brute_force_in_any_partitioning(spark, monkeypatch, per_part):
    monkeypatch.setattr(sharding, "ROWS_PER_PART", per_part)
    monkeypatch.setattr(common, "HOT_ROWS", 20)
    rows = made(per_part)
    seen = set()
    for parts in (1, 3, 7):
        docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(parts)
        got = sharding.assign(docs, 6).collect()
        checked(rows, got, 6)
        seen.add(tuple(sorted((r.shard, r.slot, r.doc_id or -1, r.digest) for r in got)))
    assert len(seen) == 1


def test_messy_rows_and_clashing_names(spark, messy):
    got = sharding.assign(messy, 3).collect()
    checked([(r.doc_id, r.text) for r in messy.collect()], got, 3)
    rows = sharding.sharded_rows(messy, 3).collect()
    assert Counter((r.doc_id, r.text, r.digest) for r in rows) == Counter(
        (r.doc_id, r.text, r.digest) for r in messy.collect())
    by_text = defaultdict(set)
    for r in rows:
        by_text[r.text or ""].add(r._shard)
    assert all(len(s) == 1 for s in by_text.values())


def test_written_shards(spark, messy, tmp_path):
    sharding.write_shards(messy.select("doc_id", "text", "lang"), str(tmp_path / "out"), 3)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == messy.count()
    assert {r._shard for r in back.select("_shard").distinct().collect()} <= {0, 1, 2}


def test_empty_and_fewer_groups_than_shards(spark, empty):
    assert sharding.assign(empty).collect() == []
    one = spark.createDataFrame([(1, "a"), (2, "a")], "doc_id bigint, text string")
    assert sorted((r.shard, r.slot) for r in sharding.assign(one).collect()) == [(0, 0), (0, 1)]
