import random
import re
from collections import Counter
from itertools import product

import numpy as np

from winnow.llm import secret_scan as X


def brute(text):
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?"""
                        r"""([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    return sorted(
        [(m.start(), 0, m.end()) for m in assign.finditer(text) if len(m[2]) >= 6]
        + [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
        + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24])


PARTS = ["token", "Password", "secret", "api_key", "APIKEY", "passwd", " = ", ": ", '"', "'", "=",
         ":", "abc", "deadbeef0123", "0" * 12, "AKIA", "ABCDEF1234567890", "x1", " ", "\n", ".",
         "é", "-", "_", "/", "+", "fedcba9876543210fedcba98", "abcdefabcdefabcdefabcdef", "😀"]


def test_base_spans_against_brute_force():
    rnd = random.Random(2)
    for _ in range(20_000):
        t = "".join(rnd.choice(PARTS) for _ in range(rnd.randrange(14)))
        assert X.base_spans(t, X.candidate_tokens(t)) == brute(t)


def test_a_long_run_is_read_once():
    run = "token " + "ab" * 100_000
    assert X.candidate_tokens(run) == [(0, 5), (6, len(run))]
    assert X.candidate_tokens("xtoken_apikey-y z") == [(0, 15), (16, 17)]


def field_of(texts):
    return X.fit_field(Counter(c for t in texts for c in X.marked_chains(t)))


TRAIN = ([f'x token = "{i:040x}" y' for i in range(50, 90)] + [f"call {i} 4558 or {i}"
         for i in range(40)] + [f"secret: a{i}B7zz9Kq12345678" for i in range(10, 50)]
         + ["plain words only"] * 5)


def test_field_finds_more_than_the_patterns_and_keeps_them():
    field = field_of(TRAIN)
    spans = X.spans_of("my credential = 'aB3dE5gH7jK9mN1pQ3sT5vW7' and 12 apples", field)
    assert [s[1] for s in spans] == [3]
    for t in TRAIN:
        assert [s for s in X.spans_of(t, field) if s[1] < 3] == brute(t)
    assert X.spans_of("pages 10 to 2500", field) == []


def test_pieces_for_fitting_join_to_the_chain():
    feats = tuple((str(i),) for i in range(200))
    states = (0, 1, 2) * 20 + (1,) + (2,) * 90 + (0,) * 49
    pieces = X.fit_pieces(feats, states)
    assert sum((f for f, _ in pieces), ()) == feats and sum((s for _, s in pieces), ()) == states
    assert len(pieces) > 1 and all(s[0] != 2 for _, s in pieces)
    assert X.fit_pieces((), ()) == [((), ())] and len(X.fit_pieces(feats[:9], states[:9])) == 1


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(3)
    field = X.ChainField({"a": 0, "b": 1, "c": 2}, rng.normal(size=(3, 3)),
                         rng.normal(size=(3, 3)))
    field.moves[0, 2] = -1e9
    for feats in (("a",), ("a", "b"), ("c", "b", "a", "a"), ("b", "c", "c", "a", "b")):
        chain = tuple((f,) for f in feats)

        def value(path):
            v = field.first[path[0]] + sum(field.weights[field.index[f], s]
                                           for f, s in zip(feats, path))
            return v + sum(field.moves[a, b] for a, b in zip(path, path[1:]))

        best = max(product(range(3), repeat=len(feats)), key=value)
        assert field.viterbi(chain) == best


def test_gradient_reaches_the_marked_states():
    samples = Counter(c for t in TRAIN for c in X.marked_chains(t))
    field = X.fit_field(samples)
    assert all(field.viterbi(f) == s for f, s in samples)


def test_without_positive_marks_nothing_is_added():
    field = field_of(["call 4558 now", "12 and 13"])
    assert X.spans_of("credential = 'aB3dE5gH7jK9mN1pQ3sT5vW7'", field) == []
    assert X.fit_field(Counter()).viterbi((("a",),)) == (0,)


def prose(n, seed):
    r = random.Random(seed)
    words = "the a of in and river table light people house green walk year 2019 12 small".split()
    return [" ".join(r.choice(words) for _ in range(r.randint(20, 60))) + "." for _ in range(n)]


def trained(kinds, patterns=True):
    return X.fit_field(Counter(p for t in prose(250, 1) for c in X.training_chains(t, kinds, patterns)
                               for p in X.fit_pieces(*c)))


def test_made_secrets_stand_where_they_are_said_to():
    for i, t in enumerate(["", "one", *prose(30, 5)]):
        made, marks = X.with_made_secrets(t, i)
        assert len(marks) == 2 and all(re.fullmatch("[A-Za-z0-9]+", made[a:b]) for a, b in marks)
        left = [w for w in made.split() if w in t.split()]
        assert len(left) >= len(t.split())


def test_values_no_pattern_knows():
    field = trained(X.VALUE_KINDS)
    for text, value in (('client_key = "Zx9Qw8Er7Ty6Ui5Op4As3Df2"', "Zx9Qw8Er7Ty6Ui5Op4As3Df2"),
                        ("passphrase: correcthorse", "correcthorse"),
                        ("authorization: bearer abcdefghijklmnop", "abcdefghijklmnop")):
        assert [text[a:b] for a, k, b in X.spans_of(text, field) if k == 3] == [value]
    for text in ("the password is required", "bearer of good news", "in 2019 there were 250 people"):
        assert X.spans_of(text, field) == []


def test_a_kind_kept_from_training_is_found():
    for kind in X.VALUE_KINDS:
        field = trained(tuple(k for k in X.VALUE_KINDS if k != kind), patterns=False)
        hit = total = wrong = 0
        for i, t in enumerate(prose(80, 9)):
            made, marks = X.with_made_secrets(t, 500 + i, (kind,))
            found = [span for tokens, feats in X.chains(made, X.candidate_tokens(made))
                     for span, state in zip(tokens, field.viterbi(feats)) if state]
            hit += sum(any(a < y and x < b for x, y in found) for a, b in marks)
            wrong += sum(not any(a < y and x < b for a, b in marks) for x, y in found)
            total += len(marks)
        assert hit >= 0.7 * total and wrong <= 0.1 * total, (kind, hit, wrong, total)


def test_fit_is_the_same_in_any_partitioning(spark):
    rows = [(None if i % 3 else i, t) for i, t in enumerate(prose(60, 3))]
    fields = []
    for parts in (1, 4):
        docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(parts)
        fields.append(X.fit_on(docs, rows=50, pieces=60))
    assert fields[0].index == fields[1].index
    assert np.allclose(fields[0].weights, fields[1].weights)


def test_messy_rows(messy, empty):
    rows = messy.drop("spans")
    field = X.fit_on(rows)
    got = X.scan(rows, field).collect()
    assert len(got) == rows.count()
    for r in got:
        spans = [(s.start, X.KINDS.index(s.kind), s.end) for s in r.spans]
        assert [s for s in spans if s[1] < 3] == brute(r.text or "")
    assert X.scan(empty.drop("spans"), X.fit_on(empty)).count() == 0
