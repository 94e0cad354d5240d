import re

from pyspark.sql import Row

from winnow.llm import license_scan as X


def words(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def places(w, phrase):
    p = phrase.split()
    return [i for i in range(len(w)) if w[i:i + len(p)] == p]


def brute(text):
    w = words(text)
    starts, labels, base = [], set(), set()
    score = 0.0
    for t in X.TEMPLATES:
        hits = [places(w, p) for p in t.phrases]
        if all(hits):
            n = sum(len(p.split()) for p in t.phrases)
            labels.add(t.label)
            score = max(score, n / (n + 1))
        if t.base:
            starts += [s for h in hits for s in h]
            if all(hits):
                base.add(t.label)
    return (len(w), len(starts), min(starts, default=None), max(starts, default=None),
            sorted(base), sorted(labels), score)


TEXTS = [
    None, "", "MIT", "under the MIT License under the mit license", "CC BY NC cc-by-nc 4.0",
    "Licensed under the Apache License, Version 2.0. Licensed under CC BY-NC 4.0.",
    "apache apache license version version 2 license version 2 2", "the mit license under",
    "Permission is hereby granted, free of charge; THE SOFTWARE IS PROVIDED AS IS, WITHOUT "
    "WARRANTY OF ANY KIND", "Permission is hereby granted, free of charge only",
    "cc by sa und CC0, é cc éby nc", "Kit under the mit license", "by " * 500 + "cc by nc " * 50,
    "GNU General Public License, version 3", "gnu general public license version 2 under the mit",
]


def test_scan_against_brute_force(spark, messy):
    docs = spark.createDataFrame(
        [(i, t, "x", 1.0) for i, t in enumerate(TEXTS)],
        "doc_id bigint, text string, labels string, n_words double").repartition(3)
    for frame in (docs, messy):
        rows = X.scan(frame, keep=("doc_id", "text")).collect()
        assert len(rows) == frame.count()
        for r in rows:
            assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels,
                    r.score) == brute(r.text)


def test_rarest_words_come_from_all_documents(spark):
    docs = spark.createDataFrame([Row(doc_id=i, text="mit mit license") for i in range(9)])
    idf = X.word_idf(docs)
    assert idf["mit"] == idf["license"] == 0.0 < idf["under"] == idf["cc"]


def test_empty_table(empty):
    assert X.scan(empty).count() == 0
