"""Distributed building blocks: range buckets, prefix sums, row positions, quantiles.

A window over a whole group puts that group into one task.  Everything here first collapses
equal values, then cuts the value range into buckets by a few literal boundaries, works inside
(group, bucket), and adds the totals of the buckets before.  One group, or one value, may
therefore hold any share of the rows.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from winnow.functions.exprs import uniform

#: Rows a single window task may hold.  Input of fewer rows, as counted, is one bucket.
ROWS_PER_BUCKET = 200_000
#: Parts a value that repeats is cut into by a hash; a rare one has as many as it has rows at most.
TIE_PARTS = 1 << 16
#: Literal boundaries the driver makes at most; beyond them every bucket is cut again.
COARSE_BUCKETS = 4096


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder the session names, which all executors can reach."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not sc.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
            folder = tempfile.mkdtemp(prefix="winnow-checkpoint-")
        sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


def settle(df: DataFrame) -> DataFrame:
    """Cut the lineage with a table written next to the session's checkpoints.

    An eager checkpoint would compute the plan twice and keep the size estimates of the plan;
    a written table is computed once, survives lost executors, and tells the optimizer its
    real size, so that small ones are broadcast later.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/settled-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def rows_up_to(df: DataFrame, most: int) -> int:
    """Number of rows, counted no further than one above ``most``."""
    return df.limit(most + 1).count()


#: A side of a join is broadcast only up to this many rows, as counted.
BROADCAST_ROWS = 100_000


def small_side(df: DataFrame) -> DataFrame:
    """Broadcast hint behind a count of the rows; beyond it Spark joins by shuffle."""
    return F.broadcast(df) if rows_up_to(df, BROADCAST_ROWS) <= BROADCAST_ROWS else df


def with_group_values(df: DataFrame, per_group: DataFrame, by: Sequence[str]) -> DataFrame:
    """Values of each group onto its rows, which are not shuffled by a possibly hot group key.

    The values are written first, so their count is real and they are computed once.
    """
    return df.join(small_side(settle(per_group)), list(by))


@dataclass(frozen=True)
class RangeBuckets:
    """Boundaries of a value range; recomputation puts a row in the same bucket.

    ``splits`` are literal; ``inner`` holds the finer boundaries of each coarse bucket as a
    written table, where one level is not enough.  ``rows`` is the measured number of rows.
    """

    splits: tuple[float, ...]
    rows: int = 0
    inner: DataFrame | None = None

    def assign(self, df: DataFrame, value: str, out: str = "_bucket") -> DataFrame:
        if not self.splits:
            return df.withColumn(out, F.lit(0))
        cut = Bucketizer(splits=[float("-inf"), *self.splits, float("inf")],
                         inputCol="_cut", outputCol=out, handleInvalid="keep")
        df = cut.transform(df.withColumn("_cut", F.col(value).cast("double"))).withColumn(
            out, F.col(out).cast("bigint"))
        if self.inner is not None:
            cuts = self.inner.withColumnRenamed("_coarse", out)
            finer = F.size(F.filter("_cuts", lambda c: c <= F.col("_cut")))
            df = df.join(cuts, out, "left").withColumn(
                out, F.col(out) * F.lit(1 << 20) + F.coalesce(finer, F.lit(0))).drop("_cuts")
        return df.drop("_cut")


def _cut_points(df: DataFrame, value: Column, parts: int):
    """Approximate quantiles that cut rows into ``parts``; an aggregate."""
    shares = ",".join(f"{i / parts!r}D" for i in range(1, parts))
    return df.select(value.cast("double").alias("_v"), "*"), F.expr(
        f"percentile_approx(_v, array({shares}), {10 * parts})")


def range_buckets(df: DataFrame, value: str, rows_per_bucket: int | None = None) -> RangeBuckets:
    """Boundaries that cut the rows, as counted, into parts of about ``ROWS_PER_BUCKET``.

    The driver receives at most ``COARSE_BUCKETS`` numbers.  Where more parts are wanted, each
    coarse bucket gets boundaries of its own in a second pass, and they stay a table.
    """
    per_bucket = rows_per_bucket or ROWS_PER_BUCKET
    n = df.select(F.count(value)).first()[0]
    wanted = -(-n // per_bucket)
    if wanted <= 1:
        return RangeBuckets((), n)
    coarse = min(wanted, COARSE_BUCKETS)
    rows, cuts = _cut_points(df, F.col(value), coarse)
    found = RangeBuckets(tuple(sorted(set(rows.agg(cuts.alias("q")).first()["q"]))), n)
    if wanted <= coarse:
        return found
    finer = min(-(-wanted // coarse), COARSE_BUCKETS)
    rows, cuts = _cut_points(found.assign(df, value, "_coarse"), F.col(value), finer)
    inner = settle(rows.groupBy("_coarse").agg(F.array_distinct(cuts).alias("_cuts")))
    return RangeBuckets(found.splits, n, inner)


def _group_cols(df: DataFrame, by: Sequence[str], name: str = "_all"
                ) -> tuple[DataFrame, list[str]]:
    """A global order is the order inside one constant group."""
    return (df, list(by)) if by else (df.withColumn(name, F.lit(0)), [name])


def running_sums(
    df: DataFrame,
    by: Sequence[str],
    value: str,
    sums: Mapping[str, Column],
    extra: Mapping[str, Column] | None = None,
    rows_per_bucket: int | None = None,
) -> DataFrame:
    """One row per distinct (by, value) with prefix sums over the order of ``value``.

    For every name in ``sums``: ``name`` (own sum), ``name_before`` (sum over strictly smaller
    values of the group) and ``name_total``.  ``extra`` holds further aggregates per value.
    """
    df, keys = _group_cols(df.filter(F.col(value).isNotNull()), by)
    # the source is read once; rows and boundaries are those of the collapsed table
    one = settle(df.groupBy(*keys, value).agg(
        *[F.sum(c).alias(n) for n, c in sums.items()],
        *[c.alias(n) for n, c in (extra or {}).items()]))
    buckets = range_buckets(one, value, rows_per_bucket)
    if not buckets.splits:
        order = W.partitionBy(*keys).orderBy(value).rowsBetween(W.unboundedPreceding, 0)
        whole = W.partitionBy(*keys)
        out = one.select(
            "*",
            *[(F.sum(n).over(order) - F.col(n)).alias(f"{n}_before") for n in sums],
            *[F.sum(n).over(whole).alias(f"{n}_total") for n in sums])
        return out.drop("_all")
    one = buckets.assign(one, value)
    totals = one.groupBy(*keys, "_bucket").agg(*[F.sum(n).alias(f"_{n}") for n in sums])
    upto = W.partitionBy(*keys).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy(*keys)
    totals = totals.select(
        *keys, "_bucket",
        *[F.coalesce(F.sum(f"_{n}").over(upto), F.lit(0)).alias(f"_{n}_off") for n in sums],
        *[F.sum(f"_{n}").over(whole).alias(f"{n}_total") for n in sums])
    inside = (W.partitionBy(*keys, "_bucket").orderBy(value)
              .rowsBetween(W.unboundedPreceding, 0))
    out = one.select("*", *[(F.sum(n).over(inside) - F.col(n)).alias(f"_{n}_in") for n in sums])
    out = out.join(totals, [*keys, "_bucket"])
    for n in sums:
        out = out.withColumn(f"{n}_before", F.col(f"_{n}_off") + F.col(f"_{n}_in"))
    return out.drop("_all", "_bucket", *[f"_{n}_off" for n in sums], *[f"_{n}_in" for n in sums])


def row_positions(
    df: DataFrame,
    by: Sequence[str],
    value: str,
    ties: Sequence[str],
    out: str = "pos",
    rows_per_bucket: int | None = None,
) -> DataFrame:
    """Zero-based position of every row in its group, ordered by (value, hash of ties, ties).

    Rows sharing one value have no natural order; a hash of their key gives them a fixed one
    that can be cut into parts, so one value may be as frequent as it likes.  Adds ``out`` and
    ``out_n`` (rows of the group).
    """
    df, keys = _group_cols(df, by, "_whole")
    df = (df.withColumn("_u", uniform(*ties))
          .withColumn("_part", F.floor(F.col("_u") * TIE_PARTS).cast("bigint")))
    parts = settle(df.groupBy(*keys, value, "_part").agg(F.count("*").alias("_n")))
    below = running_sums(parts, keys, value, {"_rows": F.col("_n")},
                         rows_per_bucket=rows_per_bucket)
    upto = W.partitionBy(*keys, value).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    offsets = (
        parts.withColumn("_part_off", F.coalesce(F.sum("_n").over(upto), F.lit(0)))
        .join(below, [*keys, value])
        .select(*keys, value, "_part",
                (F.col("_rows_before") + F.col("_part_off")).alias("_off"),
                F.col("_rows_total").alias(f"{out}_n")))
    inside = W.partitionBy(*keys, value, "_part").orderBy("_u", *ties)
    return (df.withColumn("_rn", F.row_number().over(inside) - 1)
            .join(offsets, [*keys, value, "_part"])
            .withColumn(out, (F.col("_off") + F.col("_rn")).cast("bigint"))
            .drop("_u", "_part", "_rn", "_off", "_whole"))


def exact_quantiles(
    df: DataFrame,
    by: Sequence[str],
    value: str,
    qs: Mapping[str, float],
    kind: str = "linear",
    rows_per_bucket: int | None = None,
    count: Column | None = None,
) -> DataFrame:
    """Exact unweighted quantiles per group, one column per name in ``qs``.

    ``count`` says how often a row occurs, for input that is already collapsed.

    ``linear`` interpolates between ranks (q * (n - 1)); ``nearest`` takes the element at
    zero-based rank min(n - 1, int(q * n)).  NULLs do not count.
    """
    one = F.lit(1).cast("bigint") if count is None else count.cast("bigint")
    ranked = running_sums(df, by, value, {"n": one}, rows_per_bucket=rows_per_bucket)
    n = F.col("n_total").cast("double")

    def at(rank: Column) -> Column:
        hit = (F.col("n_before") <= rank) & (rank < F.col("n_before") + F.col("n"))
        return F.max(F.when(hit, F.col(value)))

    aggs, final = [F.max("n_total").alias("_n")], []
    for name, q in qs.items():
        if kind == "nearest":
            rank = F.least(n - 1, F.floor(F.lit(float(q)) * n).cast("double"))
            aggs.append(at(rank).alias(name))
            final.append(F.col(name))
        elif kind == "linear":
            pos = F.lit(float(q)) * (n - 1)
            aggs += [at(F.floor(pos).cast("double")).alias(f"_{name}_lo"),
                     at(F.ceil(pos).cast("double")).alias(f"_{name}_hi")]
            pos1 = F.lit(float(q)) * (F.col("_n").cast("double") - 1)
            lo, hi = F.col(f"_{name}_lo"), F.col(f"_{name}_hi")
            final.append((lo + (hi - lo) * (pos1 - F.floor(pos1))).alias(name))
        else:
            raise ValueError(f"unknown kind {kind!r}")
    ranked, keys = _group_cols(ranked, by)
    return ranked.groupBy(*keys).agg(*aggs).select(*by, *final)


def weighted_quantiles(
    df: DataFrame,
    by: Sequence[str],
    value: str,
    weight: str,
    tie: str | Column,
    qs: Mapping[str, float],
    rows_per_bucket: int | None = None,
) -> DataFrame:
    """Quantiles of a weighted sample: each row sits at the midpoint of its own weight.

    Rows of equal value lie on one flat stretch of the curve.  Only its first and last point
    matter for interpolation, so a value keeps the weights of its first and last row (in the
    order of ``tie``) and the stretch between them is never expanded.
    """
    tie = F.col(tie) if isinstance(tie, str) else tie
    w = F.col(weight)
    ranked = running_sums(
        df.filter(w.isNotNull()), by, value, {"w": w},
        {"w_first": F.min_by(w, tie), "w_last": F.max_by(w, tie)}, rows_per_bucket)
    left = (F.col("w_before") + F.col("w_first") / 2) / F.col("w_total")
    right = (F.col("w_before") + F.col("w") - F.col("w_last") / 2) / F.col("w_total")
    points = ranked.select(*by, value, left.alias("_left"), right.alias("_right"))
    points, keys = _group_cols(points, by)
    aggs, final = [F.min(value).alias("_min"), F.max(value).alias("_max")], []
    for name, q in qs.items():
        # last point at or below q, first point above q: both are plain extremes
        below = F.max(F.when(F.col("_left") <= q, F.struct(
            F.when(F.col("_right") <= q, F.col("_right")).otherwise(F.col("_left")).alias("c"),
            F.col(value).alias("v"))))
        above = F.min(F.when(F.col("_right") > q, F.struct(
            F.when(F.col("_left") > q, F.col("_left")).otherwise(F.col("_right")).alias("c"),
            F.col(value).alias("v"))))
        aggs += [below.alias(f"_{name}_b"), above.alias(f"_{name}_a")]
        b, a = F.col(f"_{name}_b"), F.col(f"_{name}_a")
        span = a["c"] - b["c"]
        final.append(
            F.when(b.isNull(), F.col("_min")).when(a.isNull(), F.col("_max"))
            .otherwise(b["v"] + (a["v"] - b["v"]) * (q - b["c"]) / span).alias(name))
    return points.groupBy(*keys).agg(*aggs).select(*by, *final)


def step_grid(df: DataFrame, by: Sequence[str], step: str = "step") -> DataFrame:
    """Every step between the first and the last of each group."""
    return (df.groupBy(*by).agg(F.min(step).alias("_a"), F.max(step).alias("_b"))
            .select(*by, F.explode(F.sequence("_a", "_b")).alias(step)))


def on_step_grid(df: DataFrame, by: Sequence[str], zeros: Sequence[str] = (),
                 step: str = "step") -> DataFrame:
    """Per-step aggregates on the full grid, so that row frames mean step frames."""
    out = step_grid(df, by, step).join(df, [*by, step], "left")
    return out.fillna(0, subset=list(zeros)) if zeros else out


def microbins(df: DataFrame, by: Sequence[str], value: str, tol: float,
              sums: Mapping[str, Column]) -> DataFrame:
    """Collapse rows whose values agree within ``tol`` before any sort."""
    return (df.withColumn("_cell", F.floor(F.col(value) / F.lit(tol)))
            .groupBy(*by, "_cell")
            .agg(*[F.sum(c).alias(n) for n, c in sums.items()])
            .withColumn(value, (F.col("_cell") + F.lit(0.5)) * F.lit(tol)).drop("_cell"))


#: Rows whose maps one task composes; a level above, that many chunks.
SCAN_ROWS = 4096


def _composed(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Running composition of the maps x -> a x + b, in doubling strides."""
    stride = 1
    while stride < len(a):
        # the right hand sides are whole before anything is replaced
        b = np.concatenate([b[:stride], a[stride:] * b[:-stride] + b[stride:]])
        a = np.concatenate([a[:stride], a[stride:] * a[:-stride]])
        stride *= 2
    return a, b


def affine_scan(
    df: DataFrame,
    by: Sequence[str],
    order: str | None,
    ties: Sequence[str],
    maps: Mapping[str, tuple[Column, Column, float]],
    rows_per_bucket: int | None = None,
    pos: str | None = None,
) -> DataFrame:
    """Levels x = a x + b along each group's order, with an own factor in every row.

    ``maps`` names an output column and gives (a, b, start).  Maps compose associatively, so rows
    are cut into chunks by position, each chunk is composed by itself, and the chunks' maps are
    scanned the same way one level above; a group with all rows is spread over all tasks.  A row
    whose a or b is missing leaves the level as it is; a factor of zero starts anew.
    ``pos`` names a column with the zero-based position, where the caller has it.
    """
    by, own = list(by), pos is None
    if pos is None:
        pos = "_pos"
        df = row_positions(df, by, order, ties, pos, rows_per_bucket).drop(f"{pos}_n")
    cols = df.columns
    rows = df.withColumn("_chunk", F.floor(F.col(pos) / SCAN_ROWS))
    for name, (a, b, _) in maps.items():
        known = a.isNotNull() & b.isNotNull()
        rows = (rows.withColumn(f"_a_{name}", F.when(known, a.cast("double")).otherwise(1.0))
                .withColumn(f"_b_{name}", F.when(known, b.cast("double")).otherwise(0.0)))
    names = list(maps)

    def compose(chunk: pa.Table) -> pa.Table:
        chunk = chunk.sort_by(pos)
        for name in names:
            parts = _composed(chunk[f"_a_{name}"].to_numpy(), chunk[f"_b_{name}"].to_numpy())
            for side, values in zip("ab", parts):
                at = chunk.schema.get_field_index(f"_{side}_{name}")
                chunk = chunk.set_column(at, chunk.schema.field(at), pa.array(values))
        return chunk

    done = settle(rows.groupBy(*by, "_chunk").applyInArrow(compose, rows.schema))
    carry = {n: F.lit(float(start)) for n, (_, _, start) in maps.items()}
    if done.filter("_chunk > 0").isEmpty():
        out = done
    else:
        whole = F.max_by(F.struct(*[f"_{s}_{n}" for n in names for s in "ab"]), pos)
        ends = done.groupBy(*by, "_chunk").agg(whole.alias("_w")).select(
            *by, F.col("_chunk").alias("_k"), "_w.*")
        levels = affine_scan(ends, by, None, (), {
            f"_c_{n}": (F.col(f"_a_{n}"), F.col(f"_b_{n}"), start)
            for n, (_, _, start) in maps.items()}, pos="_k")
        levels = levels.select(*by, (F.col("_k") + 1).alias("_chunk"), *[f"_c_{n}" for n in names])
        out = done.join(levels, [*by, "_chunk"], "left")
        carry = {n: F.coalesce(f"_c_{n}", c) for n, c in carry.items()}
    return out.select(*[c for c in cols if not (own and c == pos)], *[
        (F.col(f"_a_{n}") * carry[n] + F.col(f"_b_{n}")).alias(n) for n in names])


def affine_totals(df: DataFrame, by: Sequence[str], order: str, ties: Sequence[str],
                  maps: Mapping[str, tuple[Column, Column]], rows_per_bucket: int | None = None
                  ) -> DataFrame:
    """The map of all rows of a group: ``name_a`` and ``name_b`` of x -> a x + b, and ``rows``."""
    placed = row_positions(df, by, order, ties, "_at", rows_per_bucket).drop("_at_n")
    parts = {f"{n}_{side}": (a, b, start) for n, (a, own) in maps.items()
             for side, b, start in (("a", F.lit(0.0), 1.0), ("b", own, 0.0))}
    out = affine_scan(placed, by, None, (), parts, pos="_at")
    return out.groupBy(*by).agg(F.count("*").alias("rows"), *[
        F.max_by(n, "_at").alias(n) for n in parts])


def ewma(
    df: DataFrame,
    by: Sequence[str],
    order: str,
    ties: Sequence[str],
    values: Mapping[str, tuple[str, float]],
    lam: float,
    rows_per_bucket: int | None = None,
) -> DataFrame:
    """Exponentially weighted averages along each group's order: an affine scan of one factor.

    ``values`` maps an output name to (input column, start level); a missing input counts as 0.
    """
    return affine_scan(df, by, order, ties, {
        n: (F.lit(1.0 - lam), F.lit(lam) * F.coalesce(F.col(c).cast("double"), F.lit(0.0)), start)
        for n, (c, start) in values.items()}, rows_per_bucket)


#: Rows of a key from which it may count as hot, and hot keys at most.
HOT_ROWS = 10_000
HOT_KEYS = 20_000


def join_hot(rows: DataFrame, per_key: DataFrame, keys: Sequence[str], members: str) -> DataFrame:
    """``rows`` with the columns of their key; ``members`` counts the rows of each key.

    Fewer than ``HOT_KEYS`` keys can hold more than that share of all rows; these reach their rows
    by broadcast, so no task gets all rows of one of them.  Both sides are read twice and should be
    written tables.
    """
    keys = list(keys)
    total = per_key.agg(F.coalesce(F.sum(members), F.lit(0)).alias("n")).first()["n"]
    is_hot = F.col(members) > max(HOT_ROWS, total // HOT_KEYS)
    hot = F.broadcast(per_key.filter(is_hot).drop(members))
    rest = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti")
    return rows.join(hot, keys).unionByName(
        rest.join(per_key.filter(~is_hot).drop(members), keys))


def with_previous(df: DataFrame, by: Sequence[str], pos: str, value: str, out: str) -> DataFrame:
    """``out``: ``value`` of the row before, by zero-based position; no window over a group."""
    before = df.select(*by, (F.col(pos) + 1).alias(pos), F.col(value).alias(out))
    return df.join(before, [*by, pos], "left")
