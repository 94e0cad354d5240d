"""Exact nearest neighbours by a block matrix join with int8 tiles.

Vectors are scaled to unit length and rounded to int8 with one scale each; the length of what
rounding took away is kept.  Queries and candidates become blocks; a tile is one pair of blocks.
The product of the int8 matrices gives all cosines of a tile with an error bound (Cauchy-Schwarz
on the rounded parts), a pair survives when its upper bound reaches the fifth lower bound seen,
and only survivors are computed in double precision from the original vectors.  Each task keeps
a heap per query over its tiles; the heaps of all tasks are merged per query.

Every row is a candidate of its own, and a query's own rows are those of its id.  Of equal vectors in
one block only the first rows by id can ever be in an answer (k of an id, and ids until k rows are
left without any one of them), so a hot vector does not multiply the survivors.  Work is queries
times rows, which the stated query set implies; a task holds one tile.

Defined results: vectors that are null, zero, or hold null or non-finite values, and rows without
id, take no part; vectors meet only those of their own length; repeated rows count each, on both
sides, as in the SQL twin: a candidate that stands twice is two neighbours, and the rows of a repeated
query id share one list in which each has its candidates; fewer candidates than k give all of
them; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from winnow.llm.common import settle, table
from winnow.llm.registry import query

#: Rows of a block on either side, and candidate blocks one task goes through per query block.
QUERY_ROWS = 512
BLOCK_ROWS = 2048
BLOCKS_PER_TASK = 8
#: Room for the rounding of the double arithmetic of bounds.
SLACK = 1e-9

_BLOCK = "dim int, n int, uid bigint, ids binary, vectors binary"


def _blocks(df: DataFrame, rows: int, twins: int | None = None) -> DataFrame:
    """Rows (vec_id, embedding) packed into blocks of one vector length."""

    def pack(dim: int, ids: list[int], vectors: list[np.ndarray]) -> pa.RecordBatch:
        if twins is not None:
            keep = _first_twins(ids, vectors, twins)
            ids, vectors = [ids[i] for i in keep], [vectors[i] for i in keep]
        raw = np.array(ids, np.int64).tobytes()
        uid = int.from_bytes(hashlib.sha1(raw).digest()[:7], "big")
        return pa.RecordBatch.from_arrays(
            [pa.array([dim], pa.int32()), pa.array([len(ids)], pa.int32()),
             pa.array([uid], pa.int64()), pa.array([raw], pa.binary()),
             pa.array([np.stack(vectors).tobytes()], pa.binary())],
            names=["dim", "n", "uid", "ids", "vectors"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[list, list]] = {}
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for i, x in zip(ids, batch.column(1)):
                if i is None or not x.is_valid or not len(x.values) or x.values.null_count:
                    continue
                v = x.values.to_numpy(zero_copy_only=False).astype(np.float64)
                norm = _dot(v[None, :], v[None, :])[0]
                if not np.isfinite(norm) or norm <= 0.0:
                    continue
                got = held.setdefault(len(v), ([], []))
                got[0].append(i)
                got[1].append(v)
                if len(got[0]) == rows:
                    yield pack(len(v), *held.pop(len(v)))
        for dim, got in held.items():
            yield pack(dim, *got)

    return df.select("vec_id", "embedding").mapInArrow(run, _BLOCK)


def _first_twins(ids: list[int], vectors: list[np.ndarray], k: int) -> list[int]:
    """Rows that can be among the k best of any query: by equal vector, in the order of ids, at
    most k rows of an id, until k rows remain whichever id is the query's own."""
    same: dict[bytes, dict[int, list[int]]] = {}
    for i, v in enumerate(vectors):
        same.setdefault(v.tobytes(), {}).setdefault(ids[i], []).append(i)
    keep = []
    for group in same.values():
        total = most = 0
        for i in sorted(group):
            rows = group[i][:k]
            keep += rows
            total, most = total + len(rows), max(most, len(rows))
            if total - most >= k:
                break
    return sorted(keep)


def _dot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row-wise inner products summed in order, so equal rows give equal sums anywhere."""
    out = np.zeros(len(a))
    for d in range(a.shape[1]):
        out += a[:, d] * b[:, d]
    return out


class _Rounded:
    """A block of unit vectors as int8, with the lengths its error bounds need."""

    def __init__(self, ids: bytes, vectors: bytes, dim: int):
        self.ids = np.frombuffer(ids, np.int64)
        self.x = np.frombuffer(vectors, np.float64).reshape(-1, dim)
        self.norm = np.sqrt(_dot(self.x, self.x))
        unit = self.x / self.norm[:, None]
        self.scale = np.abs(unit).max(axis=1) / 127.0
        self.q = np.rint(unit / self.scale[:, None]).astype(np.int8)
        near = self.q * self.scale[:, None]
        self.near = np.sqrt((near ** 2).sum(axis=1))
        self.lost = np.sqrt(((unit - near) ** 2).sum(axis=1))


def _tile(q: _Rounded, c: _Rounded, k: int, floor: np.ndarray) -> Iterator[tuple[int, int, float]]:
    """Survivors (query row, candidate row, exact cosine); ``floor`` holds proven k-th scores."""
    kind = np.float32 if q.q.shape[1] <= 1000 else np.float64  # sums of products stay exact
    product = q.q.astype(kind) @ c.q.astype(kind).T
    about = product.astype(np.float64) * q.scale[:, None] * c.scale[None, :]
    error = (q.near[:, None] * c.lost[None, :] + q.lost[:, None] * (c.near + c.lost)[None, :]
             + SLACK)
    own = q.ids[:, None] == c.ids[None, :]
    about[own] = -np.inf
    low = about - error
    if low.shape[1] >= k:
        low = np.partition(low, low.shape[1] - k, axis=1)[:, low.shape[1] - k]
        floor = np.maximum(floor, low)
    rows, cols = np.nonzero((about + error >= floor[:, None]) & ~own)
    for at in range(0, len(rows), 65536):
        r, s = rows[at:at + 65536], cols[at:at + 65536]
        exact = _dot(q.x[r], c.x[s]) / (q.norm[r] * c.norm[s])
        yield from zip(r.tolist(), s.tolist(), exact.tolist())


def nearest(vectors: DataFrame, is_query: Column, k: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k largest cosines of every query row."""
    asked = vectors.filter(F.coalesce(is_query, F.lit(False)))
    n_query = max(1, -(-asked.count() // QUERY_ROWS))
    q = settle(_blocks(asked.select("vec_id", "embedding").repartition(n_query), QUERY_ROWS))
    c = settle(_blocks(vectors, BLOCK_ROWS, twins=k))
    groups = max(1, -(-c.count() // BLOCKS_PER_TASK))
    left = q.select(F.col("dim").alias("qd"), F.col("uid").alias("qb"),
                    F.col("ids").alias("qi"), F.col("vectors").alias("qv"),
                    F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("part"))
    names = q.groupBy("dim").agg(F.collect_set("uid").alias("all_q"))
    right = c.join(names, "dim").select(
        "dim", "ids", "vectors", F.pmod("uid", F.lit(groups)).cast("int").alias("part"),
        F.explode("all_q").alias("qb"))
    tiles = (left.join(right, ["qb", "part"]).filter("qd = dim")
             .select("qb", "part", "dim", "qi", "qv", "ids", "vectors")
             .sortWithinPartitions("qb", "part"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, block, heaps = None, None, []

        def out() -> pa.RecordBatch:
            of_id: dict[int, list] = {}
            for i, h in zip(block.ids.tolist(), heaps):
                of_id.setdefault(i, []).extend(h)
            rows = [(i, -n, s) for i, h in of_id.items() for s, n in heapq.nlargest(k, h)]
            return pa.RecordBatch.from_arrays(
                [pa.array([r[j] for r in rows], t) for j, t in
                 enumerate((pa.int64(), pa.int64(), pa.float64()))],
                names=["query_id", "vec_id", "score"])

        for batch in batches:
            for n in range(batch.num_rows):
                qb, part, dim, qi, qv, ids, vecs = (col[n].as_py() for col in batch.columns)
                if (qb, part) != at:
                    if block is not None:
                        yield out()
                    at, block = (qb, part), _Rounded(qi, qv, dim)
                    heaps = [[] for _ in block.ids]
                cand = _Rounded(ids, vecs, dim)
                floor = np.array([h[0][0] if len(h) == k else -np.inf for h in heaps])
                for r, s, x in _tile(block, cand, k, floor):
                    entry = (x, -int(cand.ids[s]))
                    h = heaps[r]
                    if len(h) < k:
                        heapq.heappush(h, entry)
                    elif entry > h[0]:
                        heapq.heapreplace(h, entry)
        if block is not None:
            yield out()

    partial = tiles.mapInArrow(run, "query_id bigint, vec_id bigint, score double")

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def best(i: int, found: list) -> list:
            top = heapq.nsmallest(k, found)
            return [(i, n, v, -s) for n, (s, v) in enumerate(top, 1)]

        at, found, rows = None, [], []
        for batch in batches:
            for i, v, s in zip(*(col.to_pylist() for col in batch.columns)):
                if i != at:
                    if found:
                        rows += best(at, found)
                    at, found = i, []
                found.append((-s, v))
                if len(found) > 4096:  # an id that stands very often
                    found = heapq.nsmallest(k, found)
            if len(rows) > 4096:
                yield _ranked(rows)
                rows = []
        if found:
            rows += best(at, found)
        if rows:
            yield _ranked(rows)

    return (partial.repartition("query_id").sortWithinPartitions("query_id")
            .mapInArrow(merge, "query_id bigint, rank int, vec_id bigint, score double"))


def _ranked(rows: list) -> pa.RecordBatch:
    types = (pa.int64(), pa.int32(), pa.int64(), pa.float64())
    return pa.RecordBatch.from_arrays(
        [pa.array([r[j] for r in rows], t) for j, t in enumerate(types)],
        names=["query_id", "rank", "vec_id", "score"])


OP7_SQL = """
WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
u AS (SELECT vec_id, e, sqrt(list_inner_product(e, e)) AS n FROM v
      WHERE list_inner_product(e, e) > 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id,
             list_inner_product(q.e, c.e) / (q.n * c.n) AS score
      FROM u q JOIN u c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e)
      WHERE q.vec_id % 50 = 0)
SELECT query_id, rank::INTEGER AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank
      FROM s) WHERE rank <= 5
"""


@query("op7_nearest_vectors", OP7_SQL)
def op7_nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)
