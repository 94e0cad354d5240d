"""License scan with a positional rare-token index.

Templates are lists of mandatory key phrases.  The document frequency of every template word is
counted over all documents; each phrase is found by its two rarest words (highest IDF).  In a
file the occurrences of these words are looked up, each posting (phrase, offset) turns a word's
position into a start, and the starts of both words are intersected.  What is left is verified
word by word against the phrase; a template needs all its phrases.  Every phrase has a rarest
word and every occurrence is looked up, so nothing is missed.

Only DataFrame functions run; no row leaves its partition but for the word counts, and the
driver reads one number per template word.

Defined results: a null or empty text has no words, no labels and score zero; repeated rows give
repeated results; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
import string
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from winnow.llm.common import table
from winnow.llm.registry import query


@dataclass(frozen=True)
class Template:
    """A label and the phrases a file must hold for it."""

    label: str
    phrases: tuple[str, ...]
    base: bool = False


# fixed values: words of published licence notices
TEMPLATES = (
    Template("mit", ("under the mit license",), base=True),
    Template("apache-2", ("apache license version 2",), base=True),
    Template("cc-by-nc", ("cc by nc",), base=True),
    Template("mit", ("permission is hereby granted free of charge",
                     "the software is provided as is without warranty of any kind")),
    Template("bsd", ("redistribution and use in source and binary forms",)),
    Template("gpl", ("gnu general public license",)),
    Template("gpl-2", ("gnu general public license version 2",)),
    Template("gpl-3", ("gnu general public license version 3",)),
    Template("lgpl", ("gnu lesser general public license",)),
    Template("agpl", ("gnu affero general public license",)),
    Template("mpl-2", ("mozilla public license version 2",)),
    Template("mpl-2", ("mozilla public license v 2",)),
    Template("isc", ("permission to use copy modify and or distribute this software",)),
    Template("cc-by-sa", ("cc by sa",)),
    Template("cc-by", ("creative commons attribution",)),
    Template("cc0", ("cc0",)),
    Template("unlicense", ("free and unencumbered software released into the public domain",)),
    Template("epl", ("eclipse public license",)),
    Template("bsl-1", ("boost software license version 1",)),
    Template("zlib", ("this software is provided as is without any express or implied warranty",)),
)

_DELIMITERS = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"


def words_of(text: Column) -> Column:
    """Words after lower-casing A-Z only."""
    low = F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    return F.array_remove(F.split(low, _DELIMITERS), "")


def _phrases(templates: tuple[Template, ...]) -> list[tuple[str, ...]]:
    return list(dict.fromkeys(tuple(p.split()) for t in templates for p in t.phrases))


def _strings(words) -> Column:
    return F.array(*[F.lit(w) for w in words])


def word_idf(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES) -> dict[str, float]:
    """IDF of every template word over all documents."""
    vocabulary = sorted({w for p in _phrases(templates) for w in p})
    n = docs.count()
    rows = (docs.select(F.explode(F.array_intersect(words_of(F.col("text")),
                                                    _strings(vocabulary))).alias("word"))
            .groupBy("word").agg(F.count("*").alias("df")).collect())
    df = {r["word"]: r["df"] for r in rows}
    return {w: math.log((n + 1) / (df.get(w, 0) + 1)) for w in vocabulary}


def scan(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES,
         keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns, n_words, ``hits`` (phrase number and start) and the labels.

    Columns: n_words, hits, labels (array), base_labels (array), n_base, first_word, last_word,
    score.  The score of a file is t / (t + 1) for the t mandatory words of its largest template.
    """
    idf = word_idf(docs, templates)
    phrases = _phrases(templates)
    # two rarest words of each phrase with their offsets: the postings of the index
    anchors = [sorted(range(len(p)), key=lambda i: (-idf[p[i]], i))[:2] for p in phrases]
    rare = sorted({p[i] for p, at in zip(phrases, anchors) for i in at})

    words = F.col("_words")
    placed = docs.select(*keep, words_of(F.col("text")).alias("_words"))
    seen = F.filter(
        F.transform(words, lambda w, i: F.when(F.array_contains(_strings(rare), w),
                                               F.struct(w.alias("w"), i.alias("i")))),
        lambda x: x.isNotNull())
    rarest = sorted({p[at[0]] for p, at in zip(phrases, anchors)})
    placed = placed.select(
        "*", F.when(F.arrays_overlap(words, _strings(rarest)), seen).alias("_seen"))

    def starts(word: str, offset: int) -> Column:
        return F.transform(F.filter("_seen", lambda o: o["w"] == word),
                           lambda o: o["i"] - F.lit(offset))

    def verified(n: int, phrase: tuple[str, ...], at: list[int]) -> Column:
        where = starts(phrase[at[0]], at[0])
        for i in at[1:]:
            where = F.array_intersect(where, starts(phrase[i], i))
        exact = F.filter(where, lambda s: (s >= 0) & (
            F.slice(words, s + 1, F.lit(len(phrase))) == _strings(phrase)))
        return F.transform(exact, lambda s: F.struct(
            F.lit(n).alias("phrase"), s.cast("bigint").alias("start")))

    found = [verified(n, p, at) for n, (p, at) in enumerate(zip(phrases, anchors))]
    empty = F.array().cast("array<struct<phrase:int,start:bigint>>")
    placed = placed.select(
        *keep, F.size(words).cast("bigint").alias("n_words"),
        F.when(F.col("_seen").isNull(), empty).otherwise(F.concat(*found)).alias("hits"))
    placed = placed.select(
        "*", F.array_distinct(F.transform("hits", lambda h: h["phrase"])).alias("_met"))

    number = {p: n for n, p in enumerate(phrases)}

    def met(t: Template) -> Column:
        out = F.lit(True)
        for p in t.phrases:
            out = out & F.array_contains("_met", number[tuple(p.split())])
        return out

    def labels(of: list[Template]) -> Column:
        marks = F.array(*[F.when(met(t), F.lit(t.label)) for t in of])
        return F.array_sort(F.array_distinct(F.filter(marks, lambda x: x.isNotNull())))

    base = [t for t in templates if t.base]
    base_numbers = F.array(*[F.lit(number[tuple(p.split())]) for t in base for p in t.phrases])
    base_starts = F.transform(
        F.filter("hits", lambda h: F.array_contains(base_numbers, h["phrase"])),
        lambda h: h["start"])
    sizes = {t: sum(len(p.split()) for p in t.phrases) for t in templates}
    score = F.greatest(*[F.when(met(t), F.lit(n / (n + 1))).otherwise(F.lit(0.0))
                         for t, n in sizes.items()])
    return placed.select(
        *keep, "n_words", "hits", labels(list(templates)).alias("labels"),
        labels(base).alias("base_labels"), base_starts.alias("_starts"), score.alias("score")
    ).select(
        *keep, "n_words", "hits", "labels", "base_labels",
        F.size("_starts").cast("bigint").alias("n_base"),
        F.array_min("_starts").alias("first_word"), F.array_max("_starts").alias("last_word"),
        "score")


def _sql() -> str:
    """The same by plain comparison at every position, for DuckDB."""
    phrases = _phrases(TEMPLATES)
    number = {p: n for n, p in enumerate(phrases)}
    cols = ",\n".join(
        "list_filter(range(len(w)), lambda i: "
        + " AND ".join(f"w[i+{k + 1}] = '{x}'" for k, x in enumerate(p)) + f") AS p{n}"
        for n, p in enumerate(phrases))

    def met(t: Template) -> str:
        return " AND ".join(f"len(p{number[tuple(p.split())]}) > 0" for p in t.phrases)

    def labels(of) -> str:
        marks = ", ".join(f"CASE WHEN {met(t)} THEN '{t.label}' END" for t in of)
        return (f"array_to_string(list_sort(list_distinct(list_filter([{marks}], "
                "lambda x: x IS NOT NULL))), ',')")

    base = [t for t in TEMPLATES if t.base]
    starts = " || ".join(f"p{number[tuple(p.split())]}" for t in base for p in t.phrases)
    scores = ", ".join(
        f"CASE WHEN {met(t)} THEN {n / (n + 1)!r}::DOUBLE ELSE 0.0::DOUBLE END"
        for t in TEMPLATES for n in [sum(len(p.split()) for p in t.phrases)])
    pattern = "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
    return f"""
WITH t AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''),
    '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '{pattern}') AS w FROM documents),
p AS (SELECT doc_id, w, {cols} FROM t),
s AS (SELECT *, {starts} AS b FROM p)
SELECT doc_id, len(w)::BIGINT AS n_words, len(b)::BIGINT AS n_base,
       list_min(b)::BIGINT AS first_word, list_max(b)::BIGINT AS last_word,
       {labels(base)} AS base_labels, {labels(TEMPLATES)} AS labels,
       greatest({scores}) AS score
FROM s
"""


@query("op1_license_scan", _sql())
def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "doc_id", "n_words", "n_base", "first_word", "last_word",
        F.array_join("base_labels", ",").alias("base_labels"),
        F.array_join("labels", ",").alias("labels"), "score")
