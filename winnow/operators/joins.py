"""Joins: window membership, as-of with interpolation, nearest neighbour, case grids, resume."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from winnow.operators.primitives import (
    exact_quantiles, join_hot, range_buckets, settle, small_side, with_group_values)


def window_members(df: DataFrame, by: Sequence[str], steps: int,
                   step: str = "step") -> DataFrame:
    """Every row once per trailing window that holds it: window i owns steps (i - steps, i].

    Steps are whole numbers, so the range join is an explode and an equal key.
    """
    df = settle(df)  # its rows are made once, for the ends of the groups and for the windows
    last = df.groupBy(*by).agg(F.max(step).alias("_last"))
    reach = F.sequence(F.col(step), F.least(F.col(step) + (steps - 1), F.col("_last")))
    return (with_group_values(df, last, by)
            .select("*", F.explode(reach).alias("window_step")).drop("_last"))


def asof_interpolate(records: DataFrame, series: DataFrame, by: Sequence[str], t: str,
                     value: str, out: str, rows_per_bucket: int | None = None) -> DataFrame:
    """Value of a series at each record's time: linear between points, flat beyond the ends.

    Records of one time have one answer, so both streams are first reduced to distinct times, each
    with its first and last point; these are cut into buckets of time, neighbours are found inside a
    bucket, and the last point before and the first point after it come from one row per bucket.
    The answers reach the records by (by, time), hot times by broadcast, so one instant may hold any
    share of the rows.  Of several points at one time the largest value counts at it and after it,
    the smallest before it; a record without time or group has no value.
    """
    by = list(by)
    point = F.when(F.col(value).isNotNull(), F.struct(F.col(t).alias("t"), F.col(value).alias("v")))
    records = settle(records)
    known = F.col(t).isNotNull()
    for c in by:
        known = known & F.col(c).isNotNull()
    kind = series.select(point.alias("p")).schema["p"].dataType
    times = settle(records.filter(known).select(*by, t, F.lit(None).cast(kind).alias("_p"),
                                                F.lit(1).alias("_r"))
                   .unionByName(series.select(*by, t, point.alias("_p"), F.lit(0).alias("_r"))
                                .filter(F.col("_p").isNotNull()))
                   .groupBy(*by, t).agg(F.min("_p").alias("_lo"), F.max("_p").alias("_hi"),
                                        F.sum("_r").alias("_members")))
    buckets = range_buckets(times, t, rows_per_bucket)
    times = buckets.assign(times, t)
    key = [*by, "_bucket"]
    near = W.partitionBy(*key).orderBy(t)
    times = times.select(
        "*", F.last("_hi", True).over(near.rowsBetween(W.unboundedPreceding, 0)).alias("_b"),
        F.first("_lo", True).over(near.rowsBetween(0, W.unboundedFollowing)).alias("_a"))
    if buckets.splits:
        ends = times.groupBy(*key).agg(F.min("_lo").alias("_first"), F.max("_hi").alias("_last"))
        across = W.partitionBy(*by).orderBy("_bucket")
        ends = ends.select(
            *key,
            F.last("_last", True).over(across.rowsBetween(W.unboundedPreceding, -1)).alias("_pb"),
            F.first("_first", True).over(across.rowsBetween(1, W.unboundedFollowing)).alias("_pa"))
        times = times.join(ends, key).withColumn("_b", F.coalesce("_b", "_pb")).withColumn(
            "_a", F.coalesce("_a", "_pa"))
    b, a = F.col("_b"), F.col("_a")
    flat = (b["t"] == a["t"]) | a.isNull()
    level = (F.when(b.isNull(), a["v"]).when(flat, b["v"])
             .otherwise(b["v"] + (a["v"] - b["v"]) * (F.col(t) - b["t"]) / (a["t"] - b["t"])))
    levels = settle(times.filter("_members > 0").select(*by, t, "_members", level.alias(out)))
    found = join_hot(records.filter(known), levels, [*by, t], "_members")
    return found.unionByName(records.filter(~known).withColumn(
        out, F.lit(None).cast(levels.schema[out].dataType))).select(*records.columns, out)


def weighted_nearest(queries: DataFrame, library: DataFrame, coords: Sequence[tuple[str, str]],
                     weights: Sequence[float], lib_id: str, out: str = "nearest") -> DataFrame:
    """Exact nearest library entry under a weighted sum of absolute differences.

    ``coords`` pairs (query column, library column); the lowest id wins ties.  A missing query
    coordinate takes the library's median; library entries with a missing one take no part.

    Points on both sides are collapsed to distinct coordinates and put into a grid over all
    weighted coordinates.  A point outside the library's box is moved to its edge, which lowers
    every cost by the same amount; on a coordinate with few library values a point looks around
    the closest of them.  A first look into the neighbouring cells gives an upper bound of the
    cost, a second one visits just the cells that can still hold something as cheap.  Points
    without any neighbour go on with three times the edge.
    """
    qcols, lcols = [q for q, _ in coords], [c for _, c in coords]
    known = library.filter(" AND ".join(f"`{c}` IS NOT NULL" for c in lcols))
    lib = settle(known.groupBy(*lcols).agg(F.min(lib_id).alias("_id")))
    box = lib.agg(F.count("*").alias("n"), *[f(c).alias(f"{name}_{c}") for c in lcols
                                             for name, f in (("lo", F.min), ("hi", F.max))]).first()
    if box["n"] == 0:
        return queries.withColumn(out, F.lit(None).cast(library.schema[lib_id].dataType))
    gaps = queries.agg(*[F.count_if(F.col(q).isNull()).alias(q) for q in qcols]).first()
    filled = {}
    for q, c in coords:
        if gaps[q]:
            middle = exact_quantiles(known, [], c, {"m": 0.5}).first()["m"]
            filled[q] = F.coalesce(F.col(q), F.lit(middle))
    spans = [float(w) * (box[f"hi_{c}"] - box[f"lo_{c}"]) for w, c in zip(weights, lcols)]

    def scaled(x: str, c: str, w: float) -> Column:
        inside = F.least(F.greatest(F.col(x), F.lit(box[f"lo_{c}"])), F.lit(box[f"hi_{c}"]))
        return (inside - F.lit(box[f"lo_{c}"])).cast("double") * F.lit(float(w))

    moved = sum((F.lit(float(w)) * F.abs(F.col(q) - F.least(F.greatest(
        F.col(q), F.lit(box[f"lo_{c}"])), F.lit(box[f"hi_{c}"])))
        for w, (q, c) in zip(weights, coords)), F.lit(0.0))
    points = queries.select(*[filled.get(q, F.col(q)).alias(q) for q in qcols]).distinct()
    todo = settle(points.select("*", moved.alias("_moved"), *[
        scaled(q, c, w).alias(f"_p{i}") for i, (w, (q, c)) in enumerate(zip(weights, coords))]))
    grid = lib.select("*", *[scaled(c, c, w).alias(f"_z{i}")
                             for i, (w, c) in enumerate(zip(weights, lcols))])
    wide = [x for x in spans if x > 0]
    edge = 0.5 * math.prod(x / box["n"] ** (1 / len(wide)) for x in wide) ** (
        1 / len(wide)) if wide else 1.0
    cells = [f"_c{i}" for i in range(len(coords))]
    cost = sum((F.lit(float(w)) * F.abs(F.col(q) - F.col(c))
                for w, (q, c) in zip(weights, coords)), F.lit(0.0))
    few = [_few_values(grid, f"_z{i}") for i in range(len(coords))]
    keys = todo.columns
    done = None
    while True:
        near = grid.withColumns({name: F.floor(F.col(f"_z{i}") / F.lit(edge))
                                 for i, name in enumerate(cells)})
        around = todo
        for i, name in enumerate(cells):
            p = F.col(f"_p{i}")
            if few[i]:
                values = F.array(*[F.lit(v) for v in few[i]])
                p = F.array_min(F.transform(values, _gap_to(p)))["v"]
            at = F.floor(p / F.lit(edge))
            around = around.withColumn(name, F.explode(F.array(at - 1, at, at + 1))
                                       if spans[i] > 0 else at)
        # a bound of the cost; primitive minima, as one of a struct would sort every pair
        bound = settle(around.join(near, cells, "left").groupBy(*keys).agg(
            F.min(cost).alias("_most")))
        ball = bound.filter("_most IS NOT NULL").withColumn(
            "_room", (F.col("_most") - F.col("_moved")) * (1 + 1e-9) + 1e-9)
        for i, name in enumerate(cells):
            p, room = F.col(f"_p{i}"), F.col("_room")
            first, final = F.floor((p - room) / F.lit(edge)), F.floor((p + room) / F.lit(edge))
            if few[i]:
                taken = sorted({math.floor(v / edge) for v in few[i]})
                reach = F.filter(F.array(*[F.lit(c).cast("bigint") for c in taken]),
                                 _between(first, final))
            else:
                reach = F.sequence(first, final)
            ball = ball.withColumn(name, F.explode(reach))
            low = F.col(name) * F.lit(edge)
            away = F.greatest(F.lit(0.0), low - F.col(f"_p{i}"),
                              F.col(f"_p{i}") - low - F.lit(edge))
            ball = ball.withColumn("_room", F.col("_room") - away).filter("_room >= 0")
        pairs = ball.drop("_room").join(near, cells)
        cheap = settle(pairs.groupBy(*keys).agg(F.min(cost).alias("_best")))
        found = settle(pairs.filter(cost <= F.col("_most")).join(
            cheap.select(*qcols, "_best"), qcols).filter(cost == F.col("_best"))
            .groupBy(*qcols).agg(F.min("_id").alias(out)))
        done = found if done is None else done.unionByName(found)
        todo = settle(bound.filter("_most IS NULL").drop("_most"))
        if todo.isEmpty():
            break
        edge *= 3.0
    if not filled:
        return queries.join(done, qcols, "left")
    named = [f"_q{i}" for i in range(len(qcols))]
    done = done.withColumnsRenamed(dict(zip(qcols, named)))
    same = [filled.get(q, F.col(q)) == F.col(n) for q, n in zip(qcols, named)]
    return queries.join(done, same, "left").drop(*named)


def _few_values(grid: DataFrame, column: str, most: int = 64) -> list[float]:
    """The distinct values of a coordinate when they are at most ``most``, else none."""
    values = [r[0] for r in grid.select(column).distinct().limit(most + 1).collect()]
    return sorted(values) if len(values) <= most else []


def _gap_to(p: Column):
    return lambda v: F.struct(F.abs(v - p).alias("gap"), v.alias("v"))


def _between(first: Column, final: Column):
    return lambda c: (c >= first) & (c <= final)


def unfinished(cases: DataFrame, finished: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Cases whose key has no stored result yet."""
    return cases.join(finished, list(keys), "left_anti")


def wanted_results(finished: DataFrame, cases: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Stored results that belong to the cases asked for."""
    return finished.join(cases, list(keys), "left_semi")


def case_grid(spark, axes: Mapping[str, Sequence[float] | tuple]) -> DataFrame:
    """Every combination of a few literal axes, built by explodes of literal arrays."""
    out = spark.range(1).select()
    for name, values in axes.items():
        out = out.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))
    return out


def log_axis(lo: float, hi: float, n: int) -> list[float]:
    a, b = math.log(lo), math.log(hi)
    return [math.exp(a + (b - a) * i / (n - 1)) for i in range(n)]


def align_runs(a: DataFrame, b: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Steps where both runs have a value, with the difference a - b."""
    left = a.select(*keys, F.col(value).alias("a"))
    right = b.select(*keys, F.col(value).alias("b"))
    return (left.join(right, list(keys))
            .filter(F.col("a").isNotNull() & F.col("b").isNotNull())
            .withColumn("gap", F.col("a") - F.col("b")))


def stop_gap(a: Column, b: Column) -> Column:
    """Steps between two stops; 999 when only one of the runs stopped, 0 when neither did."""
    return (F.when(a.isNull() & b.isNull(), F.lit(0)).when(a.isNull() | b.isNull(), F.lit(999))
            .otherwise(F.abs(a - b)).cast("bigint"))


def domain_check(df: DataFrame, checks: Sequence[tuple[str, DataFrame, str, Column]]
                 ) -> DataFrame:
    """First failing look-up of each row, in the given order; rows stay, with the problem."""
    problem = F.lit(None).cast("string")
    for i, (column, domain, key, message) in enumerate(checks):
        known = small_side(domain.select(F.col(key).alias(column)).distinct()
                           .withColumn(f"_known{i}", F.lit(True)))
        df = df.join(known, column, "left")
        problem = F.coalesce(problem, F.when(F.col(f"_known{i}").isNull(), message))
    return df.withColumn("problem", problem).drop(*[f"_known{i}" for i in range(len(checks))])
