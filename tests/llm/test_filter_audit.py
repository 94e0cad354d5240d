import random
import re
from collections import Counter, defaultdict
from itertools import permutations

from winnow.llm import filter_audit as A


def brute_masks(docs, labels):
    """Counter of (part, mask) and the same among good and toxic documents."""
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    least = {}
    for i, text, _ in docs:
        if i is not None:
            least[text or ""] = min(i, least.get(text or "", i))
    out = defaultdict(lambda: [0, 0, 0])
    for i, text, lang in docs:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = [len(words) < 200, 100 * len(set(words)) < 50 * len(words),
                 100 * sum("A" <= c <= "Z" for c in text) > 3 * len(text),
                 any(c in "#$%&*|" for c in text), i is not None and least[text] < i]
        w = out[lang or "", sum(f << k for k, f in enumerate(fails))]
        w[0] += 1
        w[1] += i in good
        w[2] += i in toxic
    return {k: tuple(v) for k, v in out.items()}


def brute_audit(masks):
    """One part, document sets by plain counting."""
    rows = []
    for order in permutations(range(5)):
        gone = 0
        for step, f in enumerate(order, 1):
            bit = 1 << f
            hit = [(m, w) for m, w in masks.items() if m & bit]
            removed = [w for m, w in hit if not m & gone]
            rows.append(["".join("ABCDE"[k] for k in order), step,
                         sum(w[0] for m, w in masks.items() if not m & (gone | bit)),
                         sum(w[0] for w in removed), sum(w[0] for m, w in hit if m & gone),
                         sum(w[0] for m, w in hit if m == bit), sum(w[1] for w in removed),
                         sum(w[2] for w in removed), f])
            gone |= bit
    total = Counter()
    for r in rows:
        total[r[8]] += r[3]
    return sorted((*r[:8], total[r[8]]) for r in rows)


def test_exchanges_visit_every_order_once():
    for n in range(1, 6):
        order, seen = list(range(n)), {tuple(range(n))}
        for at in A.plain_changes(n):
            order[at], order[at + 1] = order[at + 1], order[at]
            assert tuple(order) not in seen
            seen.add(tuple(order))
        assert len(seen) == len(list(permutations(range(n))))


def test_diagram_keeps_counts_and_shares_nodes():
    r = random.Random(4)
    masks = {m: (r.randint(0, 3), r.randint(0, 2), 0) for m in range(32)}
    d = A.Diagram(masks, 5)
    for at in [*A.plain_changes(5)]:
        d.exchange(at)
        assert d.weight[d.root] == tuple(sum(w[k] for w in masks.values()) for k in range(3))
    same = A.Diagram({m: (2, 1, 0) for m in range(32)}, 5)
    assert [len(e) for e in same.edges] == [1, 1, 1, 1, 1]  # equal halves are one node
    for at in A.plain_changes(5):
        same.exchange(at)
    assert [len(e) for e in same.edges] == [1, 1, 1, 1, 1]


def test_audit_of_random_masks():
    for seed in range(20):
        r = random.Random(seed)
        masks = {m: (n := r.randint(0, 9), r.randint(0, n), r.randint(0, n))
                 for m in r.sample(range(32), r.randint(0, 32))}
        assert sorted(A.audit_masks(masks)) == brute_audit(masks)


def compare(spark, docs, labels):
    got = A.failure_masks(docs, labels).collect()
    plain = brute_masks([(r.doc_id, r.text, r.lang) for r in docs.collect()],
                        [tuple(r) for r in labels.select("doc_id", "quality", "toxic").collect()])
    assert {(r.part, r.mask): (r.n, r.good, r.toxic) for r in got} == plain
    by_part = defaultdict(dict)
    for (part, mask), w in plain.items():
        by_part[part][mask] = w
    out = defaultdict(list)
    for r in A.audit(A.failure_masks(docs, labels)).collect():
        out[r.part].append(tuple(r)[1:])
    assert {p: sorted(v) for p, v in out.items()} == {
        p: brute_audit(m) for p, m in by_part.items()}


LABELS = "doc_id bigint, quality int, toxic int"


def test_messy_rows(spark, messy):
    labels = spark.createDataFrame([(1, 1, None), (1, 0, 1), (6, None, 1), (None, 1, 1), (9, 1, 0)],
                                   LABELS)
    compare(spark, messy, labels)


def test_copies_ties_and_null_ids(spark):
    r = random.Random(1)
    texts = ["Same text " * 120, "ONE TWO # " * 150, None, "", "a b c",
             " ".join(f"w{i}" for i in range(300)), " ".join(f"W{i}" for i in range(220))]
    rows = [(r.choice([None, *range(30)]), r.choice(texts), r.choice(["en", None, "", "de"]))
            for _ in range(400)]
    labels = spark.createDataFrame([(i, r.choice([0, 1, None]), r.choice([0, 1, None]))
                                    for i in range(0, 40, 2) for _ in range(2)], LABELS)
    for parts in (1, 5):
        compare(spark, spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
                .repartition(parts), labels)


def test_empty_tables(spark, messy, empty):
    none = spark.createDataFrame([], LABELS)
    assert A.audit(A.failure_masks(empty, none)).collect() == []
    assert A.audit(A.failure_masks(messy, none)).filter("good_lost + toxic_lost > 0").count() == 0
