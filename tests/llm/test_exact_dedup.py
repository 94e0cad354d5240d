import re

import numpy as np
from pyspark.sql import functions as F

from winnow.llm import exact_dedup as X
from winnow.llm.common import tagged_rows


def test_filter_has_no_false_negative_and_few_false_positives():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 3, 10, 1000, 50_000):
        keys = np.unique(rng.integers(0, 2 ** 63, n, dtype=np.uint64))
        f = X.build_filter(keys)
        assert X.may_contain(f, keys).all()
        other = rng.integers(2 ** 63, 2 ** 64 - 1, 20_000, dtype=np.uint64)
        assert X.may_contain(f, other).mean() < 0.01
        if n == 50_000:
            assert len(f[3]) < 1.4 * n


def brute(rows):
    groups = {}
    for i, r in enumerate(rows):
        groups.setdefault(re.sub("[\x20\x09-\x0d]", "", r.text or ""), []).append((i, r))
    out = []
    for key, members in groups.items():
        best = max(members, key=lambda m: (len(m[1].text or ""), m[1].doc_id is not None,
                                           -(m[1].doc_id or 0)))
        out += [(r.doc_id, best[1].doc_id, len(members)) for _, r in members]
    return sorted(out, key=str)


def test_messy_rows_against_brute_force(messy):
    got = X.dedup(tagged_rows(messy)).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size) for r in got), key=str) \
        == brute(messy.collect())


def test_different_texts_under_one_digest_are_split(messy):
    weak = lambda c: F.lpad((F.crc32(F.encode(c, "UTF-8")) % 2).cast("string"), 64, "0")
    got = X.dedup(tagged_rows(messy), digest=weak).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size) for r in got), key=str) \
        == brute(messy.collect())


def test_kept_rows_hold_one_row_of_each_class(messy, empty):
    kept = X.kept_rows(messy)
    assert kept.columns == messy.columns
    texts = [re.sub("[\x20\x09-\x0d]", "", r.text or "") for r in kept.collect()]
    want = {re.sub("[\x20\x09-\x0d]", "", r.text or "") for r in messy.collect()}
    assert len(texts) == len(want) and set(texts) == want
    assert X.kept_rows(empty).count() == 0


def test_snapshot_only_and_batch_only(messy):
    tagged = tagged_rows(messy)
    for flag in (True, False):
        got = X.dedup(tagged, incoming=F.lit(flag)).collect()
        assert sorted(((r.doc_id, r.keep_id, r.group_size) for r in got), key=str) \
            == brute(messy.collect())
