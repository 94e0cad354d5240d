"""Embedding whitening by an incremental eigendecomposition.

Every task keeps the spectrum (count, exact sums, eigenvalues, eigenvectors) of the scatter of the
vectors it has read around their own mean.  A new vector is one centred rank-one update: entries
that no longer matter are deflated, the secular equation gives the new eigenvalues between the
old ones, and the eigenvectors follow from recomputed weights.  Equal vectors of a batch are one
update with their count.  The spectra of the tasks are combined in rounds of a bounded fan-in: one
spectrum takes the eigenpairs of the other and the difference of the means as rank-one updates.
The basis that results is then refined once over all rows (Rayleigh-Ritz): the matrix of the
centred rows in that basis is a distributed sum of dim x dim numbers, and its eigenvectors give the
components to double precision, whatever the updates have lost.

The driver holds dim x dim numbers per vector length, never rows.

Defined results: vectors that are null, empty, or hold null or non-finite entries take no part; an
entry beyond 2^34 counts as 2^34; vectors of each length are a fit list of their own; a null
``vec_id`` is kept; repeated rows count each; components of no variance (under 1e-10 of the trace)
do not exist, so equal vectors give no rows; a deviation beyond 64 bits is null; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from winnow.llm.common import settle, table
from winnow.llm.registry import query

SCALE, OFFSET = 64, 1_000_000
COMPONENTS = 32
#: Spectra one task combines in a round.
FAN_IN = 8
#: Share of the trace below which a component has no variance.
LEAST_SHARE = 1e-10
#: Rows turned into doubles at once.
CHUNK_ROWS = 4096
_LARGEST = float(1 << 40)
_EPS = np.finfo(float).eps

RESULT = ("vec_id bigint, component int, n bigint, deviation bigint, whitened double, "
          "explained double, identity_error double")


# ---- symmetric rank-one update ------------------------------------------------------------

def secular_roots(d: np.ndarray, z2: np.ndarray, rho: float) -> tuple[np.ndarray, np.ndarray]:
    """Roots of 1 + rho * sum(z2 / (d - x)) for rising d, as distances from their nearer pole.

    Returns (distance of root j from every pole, the roots).  Between two poles the sums over the
    poles on either side are replaced by one pole each, with equal value and slope; steps that
    leave the bracket are halved instead.
    """
    k = len(d)
    top = d[-1] + rho * z2.sum()
    right = np.append(d[1:], top)
    half = (right - d) / 2
    at_mid = 1 + rho * (z2[:, None] / ((d[:, None] - d[None, :]) - half[None, :])).sum(axis=0)
    near_left = at_mid >= 0
    near_left[-1] = True
    index = np.arange(k)
    origin = np.where(near_left, index, np.minimum(index + 1, k - 1))
    pole = d[:, None] - d[origin][None, :]
    low = np.where(near_left, 0.0, -half)
    high = np.where(near_left, half, 0.0)
    if at_mid[-1] < 0:
        low[-1] = half[-1]
    high[-1] = 2 * half[-1] if at_mid[-1] < 0 else half[-1]
    left = (index[:, None] <= index[None, :]).astype(float)
    own, nxt = pole[index, index], pole[np.minimum(index + 1, k - 1), index]
    rz = rho * z2
    x = (low + high) / 2
    for _ in range(60):
        inverse = 1.0 / (pole - x)
        terms = rz[:, None] * inverse
        slopes = terms * inverse
        below, slope_below = (terms * left).sum(axis=0), (slopes * left).sum(axis=0)
        above = terms.sum(axis=0) - below
        slope_above = slopes.sum(axis=0) - slope_below
        value = 1 + below + above
        open_ = np.abs(value) > 8 * _EPS * (1 + np.abs(below) + np.abs(above))
        open_ &= (high - low) > 4 * _EPS * np.abs(x)
        if not open_.any():
            break
        high, low = np.where(value > 0, x, high), np.where(value > 0, low, x)
        a, b = own - x, nxt - x
        c = value - a * slope_below - b * slope_above
        p = (a + b) * value - a * b * (slope_below + slope_above)
        q = a * b * value
        root = np.sqrt(np.maximum(p * p - 4 * q * c, 0))
        with np.errstate(divide="ignore", invalid="ignore"):
            step = np.where(p > 0, 2 * q / (p + root), (p - root) / (2 * c))
            # the last root has no pole to its right
            step[-1] = a[-1] + a[-1] ** 2 * slope_below[-1] / (value[-1] - a[-1] * slope_below[-1])
        moved = x + step
        inside = np.isfinite(moved) & (moved > low) & (moved < high)
        x = np.where(open_, np.where(inside, moved, (low + high) / 2), x)
    return pole - x, d[origin] + x


def rank_one(d: np.ndarray, u: np.ndarray, z: np.ndarray, rho: float
             ) -> tuple[np.ndarray, np.ndarray]:
    """Spectrum of u diag(d) u' + rho (u z)(u z)' for rising d and rho > 0."""
    length = float(np.sqrt(z @ z))
    if length == 0.0 or rho <= 0.0:
        return d, u
    rho, z = rho * length * length, z / length
    tol = 8 * _EPS * max(abs(d[-1]), rho)
    live = np.flatnonzero(rho * np.abs(z) > tol)
    if not len(live):
        return d, u
    d, u = d.copy(), u.copy()
    zl, dl = z[live], d[live]
    if len(live) > 1 and (np.abs(np.diff(dl) * zl[1:] * zl[:-1])
                          <= tol * (zl[1:] ** 2 + zl[:-1] ** 2)).any():
        live = _rotate_equal(d, u, z, live, tol)
    poles, weights = d[live], z[live]
    if len(live) == 1:
        d[live] += rho * weights ** 2
    else:
        distance, roots = secular_roots(poles, weights ** 2, rho)
        # weights for which the roots are exact, so that the vectors stay orthogonal
        gaps = poles[None, :] - poles[:, None]
        np.fill_diagonal(gaps, 1.0)
        exact = np.sqrt(np.abs(np.prod(distance / gaps, axis=1)))
        vectors = np.copysign(exact, weights)[:, None] / distance
        vectors /= np.sqrt((vectors ** 2).sum(axis=0))
        u[:, live] = u[:, live] @ vectors
        d[live] = roots
    if (np.diff(d) < 0).any():
        order = np.argsort(d, kind="stable")
        d, u = d[order], u[:, order]
    return d, u


def _rotate_equal(d: np.ndarray, u: np.ndarray, z: np.ndarray, live: np.ndarray, tol: float
                  ) -> np.ndarray:
    """Deflation of (nearly) equal eigenvalues: a rotation moves their weight to one of them."""
    out, at = [], live[0]
    for nxt in live[1:]:
        r = float(np.hypot(z[at], z[nxt]))
        c, s = z[nxt] / r, z[at] / r
        if abs((d[nxt] - d[at]) * c * s) <= tol:
            z[at], z[nxt] = 0.0, r
            first, second = u[:, at].copy(), u[:, nxt].copy()
            u[:, at], u[:, nxt] = c * first - s * second, s * first + c * second
            d[at], d[nxt] = (c * c * d[at] + s * s * d[nxt], s * s * d[at] + c * c * d[nxt])
        else:
            out.append(at)
        at = nxt
    return np.array([*out, at])


class Spectrum:
    """Count, exact sums and eigenpairs of the scatter of whole-number vectors."""

    def __init__(self, dim: int):
        self.n = 0
        self.sums = np.zeros(dim, np.int64)
        self.d, self.u = np.zeros(dim), np.eye(dim)

    def mean(self) -> np.ndarray:
        return self.sums / self.n

    def add(self, x: np.ndarray, times: int) -> None:
        """A vector that stands ``times`` times."""
        if self.n:
            away = self.u.T @ (x - self.mean())
            self.d, self.u = rank_one(self.d, self.u, away, self.n * times / (self.n + times))
        self.n += times
        self.sums += x.astype(np.int64) * times

    def merge(self, other: "Spectrum") -> None:
        """The other's eigenpairs, then the difference of the means, one update each."""
        if self.n and other.n:
            away = other.mean() - self.mean()
            updates = [(other.u[:, k], float(v)) for k, v in enumerate(other.d) if v > 0]
            for vector, weight in [*updates, (away, self.n * other.n / (self.n + other.n))]:
                self.d, self.u = rank_one(self.d, self.u, self.u.T @ vector, weight)
        elif other.n:
            self.d, self.u = other.d, other.u
        self.n += other.n
        self.sums = self.sums + other.sums

    def row(self) -> tuple:
        return len(self.d), self.n, self.sums.tobytes(), self.d.tobytes(), self.u.tobytes()

    @classmethod
    def of(cls, dim: int, n: int, sums: bytes, d: bytes, u: bytes) -> "Spectrum":
        out = cls(dim)
        out.n, out.sums = n, np.frombuffer(sums, np.int64)
        out.d, out.u = np.frombuffer(d), np.frombuffer(u).reshape(dim, dim)
        return out


STATE = "dim int, n bigint, sums binary, d binary, u binary"
_STATE = [c.split()[0] for c in STATE.split(", ")]


# ---- passes over the rows -----------------------------------------------------------------

def whole_vectors(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, floor(64 c) as doubles) of the valid vectors of a batch, by length."""
    lists = batch.column(batch.schema.get_field_index("embedding"))
    starts = lists.offsets.to_numpy()
    length = np.diff(starts)
    length[lists.is_null().to_numpy(zero_copy_only=False)] = 0
    values = lists.values.to_numpy(zero_copy_only=False)  # null entries become NaN
    for dim in np.unique(length[length > 0]).tolist():
        rows = np.flatnonzero(length == dim)
        for at in range(0, len(rows), CHUNK_ROWS):
            part = rows[at:at + CHUNK_ROWS]
            x = values[starts[part][:, None] + np.arange(dim)].astype(np.float64)
            good = np.isfinite(x).all(axis=1)
            with np.errstate(over="ignore"):
                yield part[good], np.clip(np.floor(SCALE * x[good]), -_LARGEST, _LARGEST)


def spectra(vectors: DataFrame) -> DataFrame:
    """One row per task and vector length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, Spectrum] = {}
        for batch in batches:
            for _, x in whole_vectors(batch):
                state = found.setdefault(x.shape[1], Spectrum(x.shape[1]))
                for row, times in zip(*np.unique(x, axis=0, return_counts=True)):
                    state.add(row, int(times))
        rows = [s.row() for s in found.values() if s.n]
        if rows:
            yield pa.RecordBatch.from_pandas(pd.DataFrame(rows, columns=_STATE).astype(
                {"dim": "int32"}), preserve_index=False)

    return vectors.select("embedding").mapInArrow(run, STATE)


def combined(states: DataFrame) -> dict[int, Spectrum]:
    """The spectrum of all rows for each vector length; ``FAN_IN`` spectra a task and round."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = [tuple(r) for r in pdf[_STATE].itertuples(index=False)]
        whole = Spectrum(int(rows[0][0]))
        for row in sorted(rows, key=lambda r: (r[1], r[2])):  # an order of their own
            whole.merge(Spectrum.of(*row))
        return pd.DataFrame([whole.row()], columns=_STATE)

    while True:
        states = settle(states)
        most = states.groupBy("dim").count().agg(F.max("count")).first()[0] or 0
        if most <= 1:
            return {r.dim: Spectrum.of(*(r[c] for c in _STATE)) for r in states.collect()}
        bucket = F.pmod(F.xxhash64("n", "sums"), F.lit(-(-most // FAN_IN))).alias("_bucket")
        states = states.groupBy("dim", bucket).applyInPandas(run, STATE)


def _gram(rows: DataFrame, matrices) -> dict[int, np.ndarray]:
    """Sum of x'x over all rows by length; ``matrices`` gives (dim, block of rows) of a batch.

    Each task sends the upper triangle of its sum; the sums over tasks are Spark's.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, np.ndarray] = {}
        for batch in batches:
            for dim, x in matrices(batch):
                found[dim] = found.get(dim, 0.0) + x.T @ x
        for dim, g in found.items():
            i, j = np.triu_indices(len(g))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(i), dim, np.int32)), pa.array(i.astype(np.int32)),
                 pa.array(j.astype(np.int32)), pa.array(g[i, j])], names=["dim", "i", "j", "g"])

    sums = (rows.mapInArrow(run, "dim int, i int, j int, g double")
            .groupBy("dim", "i", "j").agg(F.sum("g").alias("g")).toPandas())
    out = {}
    for dim, part in sums.groupby("dim"):
        size = int(part["i"].max()) + 1
        g = np.zeros((size, size))
        g[part["i"], part["j"]] = part["g"]
        g[part["j"], part["i"]] = part["g"]
        out[int(dim)] = g
    return out


def fit(vectors: DataFrame) -> dict[int, tuple]:
    """dim -> (n, exact sums of floor(64 c), eigenvalues by falling size, components, trace)."""
    whole = combined(spectra(vectors))
    bases = {dim: (s.mean(), np.linalg.qr(s.u)[0]) for dim, s in whole.items()}

    def matrices(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
        for _, x in whole_vectors(batch):
            mean, basis = bases[x.shape[1]]
            yield x.shape[1], (x - mean) @ basis

    out = {}
    for dim, g in _gram(vectors.select("embedding"), matrices).items():
        s = whole[dim]
        e, w = np.linalg.eigh(g / s.n)
        out[dim] = (s.n, s.sums, e[::-1], bases[dim][1] @ w[:, ::-1], float(np.trace(g)) / s.n)
    return out


def _deviations(x: np.ndarray, n: int, sums: np.ndarray) -> list[int | None]:
    """Sum of (n x - S)^2 in whole numbers; the offset of x cancels."""
    bound = n * float(np.abs(x).max(initial=0.0)) + float(np.abs(sums).max())
    if len(sums) * bound * bound < 2.0 ** 62:
        away = n * x.astype(np.int64) - sums
        return (away * away).sum(axis=1).tolist()
    exact = [sum((n * int(v) - int(s)) ** 2 for v, s in zip(row, sums)) for row in x]
    return [v if v < 1 << 63 else None for v in exact]


def whiten(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """``RESULT`` for every valid row of ``vectors`` (vec_id, embedding) and component."""
    spark = vectors.sparkSession
    models, explained = {}, []
    for dim, (n, sums, e, u, trace) in fit(vectors).items():
        k = int((e[:components] > LEAST_SHARE * trace).sum()) if trace > 0 else 0
        models[dim] = (n, sums, sums / n, u[:, :k] / np.sqrt(e[:k]))
        explained += [(dim, c + 1, n, float(e[c] / trace)) for c in range(k)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, x in whole_vectors(batch):
                n, sums, mean, scaled = models[x.shape[1]]
                white = (x - mean) @ scaled
                size = scaled.shape[1]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(rows)),
                     pa.array(np.full(len(rows), x.shape[1], np.int32)),
                     pa.array(_deviations(x, n, sums), pa.int64()),
                     pa.ListArray.from_arrays(
                         pa.array(np.arange(len(rows) + 1, dtype=np.int32) * size),
                         pa.array(white.ravel()))],
                    names=["vec_id", "dim", "deviation", "white"])

    white = settle(vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), "embedding")
                   .mapInArrow(run, "vec_id bigint, dim int, deviation bigint, white array<double>"))

    def with_one(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
        """The rows with a one behind them, so that the sums carry the means along."""
        dims = batch.column(0).to_numpy()
        lists = batch.column(1)
        starts, values = lists.offsets.to_numpy(), lists.values.to_numpy()
        for dim in np.unique(dims).tolist():
            size = models[dim][3].shape[1]
            if size:
                x = values[starts[:-1][dims == dim][:, None] + np.arange(size)]
                yield dim, np.column_stack([x, np.ones(len(x))])

    errors = {}
    for dim, g in _gram(white.select("dim", "white"), with_one).items():
        n = models[dim][0]
        mean = g[-1, :-1] / n
        covariance = g[:-1, :-1] / n - np.outer(mean, mean)
        errors[dim] = float(np.abs(covariance - np.eye(len(mean))).max())
    about = spark.createDataFrame(
        [(*row, errors[row[0]]) for row in explained],
        "dim int, component int, n bigint, explained double, identity_error double")
    return (white.select("vec_id", "dim", "deviation", F.posexplode("white").alias("_c", "whitened"))
            .withColumn("component", F.col("_c") + 1)
            .join(F.broadcast(about), ["dim", "component"])  # 32 rows a length
            .select(*[c.split()[0] for c in RESULT.split(", ")]))


@query("op13_embedding_whitening")
def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
