"""Quality classifier: attention-based multiple-instance learning.

A document is a bag of passages of 128 words.  Each passage is encoded (shares of byte classes,
word shapes, repetition; one tanh layer), a gated attention gives each passage a weight, and the
weighted passage representation is scored.  Only the document labels are used, the attention
learns which passages matter.

Features come from the text alone; labels, language, source and id never enter a score.  The
model is small and is fitted on a bounded sample of labelled rows (``FIT_ROWS``); scoring is one
pass over whole texts without a shuffle.

Defined results: null and empty texts are a bag of one empty passage and get a score; a text of
any length is scored whole; labels that are null are no labels; without labels of both values
every score is 0.5; a null id is not held out; clashing output names are refused.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from winnow.llm.common import bounded_sample, map_slices, table
from winnow.llm.registry import query

#: Most labelled rows the model is fitted on.
FIT_ROWS = 6000
PASSAGE_WORDS = 128
ACCEPT = 0.7

_GROUPS = (b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" ",
           b"\n", b".,;:", b"!?", b"|", b"#$%&*", b"'\"()-")
_CLASS = np.full(256, len(_GROUPS), np.int64)
for _i, _g in enumerate(_GROUPS):
    _CLASS[list(_g)] = _i
_CLASS[128:] = len(_GROUPS) + 1
_N_CLASS = len(_GROUPS) + 2
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
N_FEATURES = _N_CLASS + 7


def passages(text: str | None, words_each: int = PASSAGE_WORDS) -> np.ndarray:
    """One row of features per passage of a whole text."""
    raw = (text or "").encode()
    words = raw.split()
    if not words:
        return np.zeros((1, N_FEATURES), np.float32)
    data = np.frombuffer(raw, np.uint8)
    solid = ~_SPACE[data]
    begins = np.flatnonzero(solid & np.concatenate(([True], ~solid[:-1])))
    cuts = begins[::words_each].copy()
    cuts[0] = 0
    n = len(cuts)
    part = np.repeat(np.arange(n), np.diff(np.append(cuts, len(data))))
    hist = np.bincount(part * _N_CLASS + _CLASS[data], minlength=n * _N_CLASS)
    hist = hist.reshape(n, _N_CLASS).astype(np.float64)
    size = hist.sum(axis=1, keepdims=True)
    extra = np.zeros((n, 7))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    all_kinds = len(set(words)) / len(words) ** 0.75
    same_lines = 1.0 - len(set(lines)) / len(lines)
    for i in range(n):
        w = words[i * words_each:(i + 1) * words_each]
        kinds = len(set(w))
        twice = sum(a == b for a, b in zip(w, w[1:]))
        letters = size[i, 0] - hist[i, 3] - hist[i, 4]
        extra[i] = (kinds / len(w), kinds / len(w) ** 0.75, twice / len(w), np.log1p(len(w)),
                    letters / len(w), all_kinds, same_lines)
    return np.concatenate([hist / size, extra], axis=1).astype(np.float32)


@dataclass
class AttentionModel:
    """Passage layer, gated attention and output layer, fitted by Adam on whole bags."""

    mean: np.ndarray
    scale: np.ndarray
    weights: list[np.ndarray]

    def logits(self, x: np.ndarray, starts: np.ndarray) -> np.ndarray:
        return _forward(self.weights, (x - self.mean) / self.scale, starts)[0]

    def scores(self, bags: list[np.ndarray]) -> np.ndarray:
        starts = np.cumsum([0, *[len(b) for b in bags[:-1]]])
        logit = self.logits(np.concatenate(bags).astype(np.float64), starts)
        return 1.0 / (1.0 + np.exp(-np.clip(logit, -500, 500)))


def _forward(weights, x, starts):
    w1, b1, v, u, a, w2, b2 = weights
    h = np.tanh(x @ w1 + b1)
    tv, su = np.tanh(h @ v), 1.0 / (1.0 + np.exp(-(h @ u)))
    e = (tv * su) @ a
    bag = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(x))))
    e = np.exp(e - np.maximum.reduceat(e, starts)[bag])
    att = e / np.add.reduceat(e, starts)[bag]
    z = np.add.reduceat(att[:, None] * h, starts)
    return z @ w2 + b2[0], (h, tv, su, bag, att, z)


def fit(bags: list[np.ndarray], labels: np.ndarray, hidden: int = 16, gate: int = 8,
        steps: int = 300, rate: float = 0.02, decay: float = 1e-4,
        seed: int = 7) -> AttentionModel:
    """Binary cross entropy; scores are shares of label 1 as the sample has it."""
    if not len(bags):
        bags, labels = [np.zeros((1, N_FEATURES), np.float32)], np.zeros(1)
    x = np.concatenate(bags).astype(np.float64)
    starts = np.cumsum([0, *[len(b) for b in bags[:-1]]])
    y = np.asarray(labels, float)
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-3
    x = (x - mean) / scale
    rng = np.random.default_rng(seed)
    f = x.shape[1]
    w = [rng.normal(0, f ** -0.5, (f, hidden)), np.zeros(hidden),
         rng.normal(0, hidden ** -0.5, (hidden, gate)),
         rng.normal(0, hidden ** -0.5, (hidden, gate)), rng.normal(0, 0.1, gate),
         np.zeros(hidden), np.zeros(1)]
    if 0 < y.sum() < len(y):
        m = [np.zeros_like(p) for p in w]
        s = [np.zeros_like(p) for p in w]
        for t in range(1, steps + 1):
            logit, (h, tv, su, bag, att, z) = _forward(w, x, starts)
            d = (1.0 / (1.0 + np.exp(-logit)) - y) / len(y)
            dz = d[:, None] * w[5]
            datt = (dz[bag] * h).sum(axis=1)
            de = att * (datt - np.add.reduceat(att * datt, starts)[bag])
            dg = de[:, None] * w[4]
            dv, du = dg * su * (1 - tv ** 2), dg * tv * su * (1 - su)
            dh = att[:, None] * dz[bag] + dv @ w[2].T + du @ w[3].T
            dp = dh * (1 - h ** 2)
            grads = [x.T @ dp, dp.sum(axis=0), h.T @ dv, h.T @ du,
                     ((tv * su) * de[:, None]).sum(axis=0), z.T @ d, np.array([d.sum()])]
            for p, g, mi, si in zip(w, grads, m, s):
                g = g + decay * p
                mi += 0.1 * (g - mi)
                si += 0.001 * (g * g - si)
                p -= rate * (mi / (1 - 0.9 ** t)) / (np.sqrt(si / (1 - 0.999 ** t)) + 1e-8)
    return AttentionModel(mean, scale, w)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def fit_on(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> AttentionModel:
    """Model from at most ``rows`` labelled documents that are not held out."""
    marked = (labels.select("doc_id", F.col("quality").cast("int").alias("quality"))
              .filter(F.col("quality").isin(0, 1) & ~held_out(F.col("doc_id"))))
    picked = bounded_sample(marked, F.col("doc_id"), rows)
    sample = docs.select("doc_id", "text").join(picked, "doc_id").limit(rows)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        bags = [passages(t).ravel() for t in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(2), pa.array(bags, type=pa.list_(pa.float32()))],
            names=["doc_id", "quality", "bag"])

    got = map_slices(sample.select("doc_id", "text", "quality"), work,
                     "doc_id bigint, quality int, bag array<float>").toArrow()
    order = np.argsort(got.column("doc_id").to_numpy(), kind="stable")
    bags = [np.asarray(x, np.float32).reshape(-1, N_FEATURES)
            for x in got.column("bag").to_pylist()]
    return fit([bags[i] for i in order], got.column("quality").to_numpy()[order])


def score(docs: DataFrame, model: AttentionModel, text: str = "text",
          out: str = "score") -> DataFrame:
    """All columns of ``docs`` and the score of its whole texts."""
    if out in docs.columns:
        raise ValueError(f"column {out} is there already")
    where, names = docs.columns.index(text), [*docs.columns, out]
    schema = T.StructType([*docs.schema.fields, T.StructField(out, T.DoubleType())])

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        # one bag at a time: a score never depends on the rows it travels with
        scores = [float(model.scores([passages(t)])[0]) for t in batch.column(where).to_pylist()]
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())],
                                          names=names)

    return map_slices(docs, work, schema)


def accepted_rows(docs: DataFrame, labels: DataFrame, accept: float = ACCEPT) -> DataFrame:
    """The rows whose score reaches ``accept``, with their own columns."""
    model = fit_on(docs, labels)
    return score(docs, model, out="_score").filter(F.col("_score") >= accept).drop("_score")


@query("op10_quality")
def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit_on(docs, table(spark, sf_dir, "labels"))
    return score(docs, model).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
        (F.col("score") >= ACCEPT).cast("int").alias("predicted"))
