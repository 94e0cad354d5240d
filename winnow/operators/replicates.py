"""Poisson replicates of windows without a row per draw.

A window is cut into parts by the order of a value.  Inside a part the counts of all replicates are
one matrix, rows by replicates, which leaves the task as sums per class.  The place where running
weights reach a goal is found among the ends of the parts, and then in the one part that holds it:
only parts that hold the place of some replicate are drawn again, from the same digests.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Sequence
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from winnow.functions.exprs import col
from winnow.functions.mixture import row_cdf, smooth_cdf
from winnow.operators.primitives import settle, small_side, with_group_values

#: Rows of one part, as counted; its counts are a matrix of so many rows.
PART_ROWS = 16_384
#: Digests made together: a step of them stays in the cache of a core.
DRAW_CELLS = 32_768


def poisson_terms(bits: int = 32) -> int:
    """Steps of the Poisson(1) distribution function that a uniform of so many bits can reach."""
    cum, k = 0.0, 0
    while cum <= 1.0 - 0.5 ** bits:
        cum += math.exp(-1.0) / math.factorial(k)
        k += 1
    return k


@cache
def _tools():
    """Helpers of the tasks, built inside a function so that they travel by value."""
    steps, cum = [], 0.0
    for k in range(poisson_terms()):
        cum += math.exp(-1.0) / math.factorial(k)
        steps.append(math.ceil(cum * 4294967296.0))
    steps = [s for s in steps if s <= 0xFFFFFFFF]

    def fixed(x: int) -> np.ndarray:
        return np.array(x & 0xFFFFFFFF, np.uint32)  # of no dimension: the cheapest operand

    turns = [s for row in ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21))
             for s in row * 4]
    left, right = [fixed(s) for s in turns], [fixed(32 - s) for s in turns]
    sines = [fixed(int(abs(math.sin(i + 1)) * 4294967296.0)) for i in range(64)]
    places = [place for row in zip(*[(i, (5 * i + 1) % 16, (3 * i + 5) % 16, 7 * i % 16)
                                     for i in range(16)]) for place in row]
    start = [fixed(x) for x in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)]
    steps = [fixed(x) for x in steps]
    often, seldom = steps[:6], steps[6:]

    def turn(i: int, a, b, c, d, f, t, addends) -> None:
        """Step i of MD5; its new word is left in f."""
        if i < 16:  # d ^ (b & (c ^ d))
            np.bitwise_xor(c, d, out=f), np.bitwise_and(f, b, out=f), np.bitwise_xor(f, d, out=f)
        elif i < 32:  # c ^ (d & (b ^ c))
            np.bitwise_xor(b, c, out=f), np.bitwise_and(f, d, out=f), np.bitwise_xor(f, c, out=f)
        elif i < 48:
            np.bitwise_xor(b, c, out=f), np.bitwise_xor(f, d, out=f)
        else:  # c ^ (b | ~d)
            np.invert(d, out=f), np.bitwise_or(f, b, out=f), np.bitwise_xor(f, c, out=f)
        np.add(f, a, out=f)
        for x in addends:
            np.add(f, x, out=f)
        np.right_shift(f, right[i], out=t), np.left_shift(f, left[i], out=f)
        np.bitwise_or(f, t, out=f), np.add(f, b, out=f)

    def draw(text: np.ndarray, quads: Sequence[int], out: np.ndarray) -> None:
        """Counts of keys of one length, a row of bytes each, into ``out`` (quad, word, key).

        The words before the end of the key are those of every quad, and so are the first steps.
        Few keys are taken with several quads at once.
        """
        n, size = text.shape
        whole, at_once = size // 4, min(-(-DRAW_CELLS // n), len(quads))
        block = np.zeros((n, 4 * whole + 4), np.uint8)
        block[:, :size] = text
        words = np.ascontiguousarray(block.view("<u4").T)
        ready = {i: words[g] + sines[i] for i, g in enumerate(places) if g < whole}
        state = tuple(np.full(n, x) for x in start)
        for i in range(whole):
            f = np.empty(n, np.uint32)
            turn(i, *state, f, np.empty_like(f), (ready[i],))
            state = state[3], f, state[1], state[2]
        shape = at_once, n
        store = [np.empty(shape, np.uint32) for _ in range(8)]
        flags, sums = np.empty(shape, bool), np.empty(shape, np.uint8)
        for first in range(0, len(quads), at_once):
            some = quads[first:first + at_once]
            t, last, *free = (x[:len(some)] for x in store)
            flag, counted = flags[:len(some)], sums[:len(some)]
            rest = np.zeros((len(some), 64), np.uint8)
            for row, quad in zip(rest, some):
                end = str(quad).encode()
                row[size:size + len(end) + 1] = list(end + b"\x80")
                row[56:58] = list((8 * (size + len(end))).to_bytes(2, "little"))
            rest = rest.view("<u4")
            np.bitwise_or(words[whole], rest[:, whole, None], out=last)
            used = rest.any(axis=0)
            a, b, c, d = state
            for i in range(whole, 64):
                g = places[i]
                if g < whole:
                    added = (ready[i],)
                elif g == whole:
                    added = last, sines[i]
                else:
                    added = (rest[:, g, None] + sines[i] if used[g] else sines[i],)
                f = free.pop()
                turn(i, a, b, c, d, f, t, added)
                if i >= whole + 4:  # the first four are the common state
                    free.append(a)
                a, b, c, d = d, f, b, c
            for w, (x, begun) in enumerate(zip((a, b, c, d), start)):
                np.add(x, begun, out=x)
                x.byteswap(inplace=True)
                counted[:] = 0
                for step in often:
                    np.greater_equal(x, step, out=flag)
                    np.add(counted, flag.view(np.uint8), out=counted)
                high = np.nonzero(flag)
                for step in seldom:
                    counted[high] += x[high] >= step
                out[first:first + len(some), w] = counted

    def long_draw(key: bytes, quads: Sequence[int]) -> np.ndarray:
        words = np.frombuffer(b"".join(hashlib.md5(key + str(q).encode()).digest() for q in quads),
                              ">u4")
        return sum((words >= s).astype(np.uint8) for s in steps).reshape(len(quads), 4)

    def counts(keys: pa.Array | pa.ChunkedArray, quads: Sequence[int]) -> np.ndarray:
        """Poisson(1) counts, one row for each of the four replicates of a quad and one column
        per key."""
        keys = keys.cast(pa.large_binary())
        keys = keys.combine_chunks() if isinstance(keys, pa.ChunkedArray) else keys
        n, quads = len(keys), [int(q) for q in quads]
        out = np.zeros((len(quads), 4, n), np.uint8)
        if not n or not quads:
            return out.reshape(4 * len(quads), n)
        _, offsets, data = keys.buffers()
        at = np.frombuffer(offsets, np.int64)[keys.offset:keys.offset + n + 1]
        data = np.frombuffer(data or b"", np.uint8)
        size, digits = np.diff(at), len(str(max(quads)))
        order = np.argsort(size, kind="stable")
        for rows in np.split(order, np.flatnonzero(np.diff(size[order])) + 1):
            length = int(size[rows[0]])
            if length + digits > 55:  # does not fit into one block with a number and its length
                for i in rows:
                    out[:, :, i] = long_draw(data[at[i]:at[i + 1]].tobytes(), quads)
                continue
            for some in np.split(rows, range(DRAW_CELLS, len(rows), DRAW_CELLS)):
                part = np.empty((len(quads), 4, len(some)), np.uint8)
                draw(data[at[some][:, None] + np.arange(length)], quads, part)
                out[:, :, some] = part
        return out.reshape(4 * len(quads), n)

    def lists(values: np.ndarray) -> pa.Array:
        """One list per row of a matrix."""
        n, width = values.shape
        return pa.ListArray.from_arrays(np.arange(n + 1, dtype=np.int32) * np.int32(width),
                                        pa.array(np.ascontiguousarray(values).reshape(-1)))

    def repeat(column: pa.ChunkedArray, n: int) -> pa.Array:
        return column.slice(0, 1).combine_chunks().take(pa.array(np.zeros(n, np.int64)))

    return counts, lists, repeat


def poisson_matrix(keys: Sequence[str], reps: int) -> np.ndarray:
    """Poisson(1) counts, one row per key and one column per replicate.

    A digest of "key" and a number holds the uniforms of four replicates, as in `resampled_rows`.
    """
    drawn = _tools()[0](pa.array(list(keys), pa.string()), range((reps + 3) // 4))
    return np.ascontiguousarray(drawn[:reps].T)


def cut_parts(rows: DataFrame, by: Sequence[str], keys: Sequence[str | Column], value: str,
              rows_per_part: int | None = None) -> DataFrame:
    """Rows with ``_part``, rising with ``value`` inside a window, ``_sub`` and ``_key``.

    A window has as many parts as its counted rows ask for.  A value that fills several parts is a
    part of its own, cut further by ``_sub``; rows without a value are part -1.
    """
    by, per = list(by), rows_per_part or PART_ROWS
    rows = rows.withColumn("_key", F.concat_ws(":", *[col(k).cast("string") for k in keys],
                                               F.lit("")))
    known = F.col(value).isNotNull()
    most = rows.groupBy(*by).agg(F.count(value).alias("_n")).agg(F.max("_n")).first()[0] or 0
    parts = -(-most // per)
    if parts <= 1:
        return rows.withColumn("_part", F.when(known, F.lit(0)).otherwise(-1).cast("bigint")
                               ).withColumn("_sub", F.lit(0).cast("bigint"))
    shares = ",".join(f"{i / parts!r}D" for i in range(1, parts))
    wanted = f"cast(ceil(_n/{per}) as int)"
    cuts = rows.groupBy(*by).agg(
        F.count(value).alias("_n"),
        F.expr(f"percentile_approx(`{value}`, array({shares}), {10 * parts})").alias("_all"))
    cuts = cuts.selectExpr(
        *by, f"if({wanted} > 1, transform(sequence(1, greatest({wanted}-1, 1)), "
             f"i -> _all[cast(floor(i*{parts}/{wanted}) as int)-1]), cast(array() as array<double>)) "
             "as _picked")
    cuts = cuts.selectExpr(*by, "_picked", "array_distinct(_picked) as _cuts").selectExpr(
        "*", "filter(_cuts, c -> size(filter(_picked, d -> d = c)) > 1) as _hot")
    hot = F.expr(f"array_contains(_hot, `{value}`)")
    # cuts at or below the value, found by halving: a window of many rows has many cuts
    steps = [1 << k for k in reversed(range(parts.bit_length()))]
    cuts = cuts.withColumn("_known", F.size("_cuts")).withColumn("_cuts", F.expr(
        f"concat(_cuts, array_repeat(double('Infinity'), {2 * steps[0] - 1} - _known))"))
    pieces = F.expr(f"size(filter(_picked, d -> d = `{value}`)) + 1")
    rows = with_group_values(rows, cuts, by).withColumn("_below", F.lit(0))
    for step in steps:
        rows = rows.withColumn("_below", F.expr(
            f"_below + if(_cuts[_below + {step - 1}] <= `{value}`, {step}, 0)"))
    below = F.least("_below", "_known")
    return rows.withColumn(
        "_part", F.when(known, 2 * below + F.when(hot, 0).otherwise(1)).otherwise(-1)
        .cast("bigint")).withColumn(
        "_sub", F.when(known & hot, F.pmod(F.xxhash64("_key"), pieces)).otherwise(0)
        .cast("bigint")).drop("_picked", "_cuts", "_hot", "_known", "_below")


def _spread(rows: DataFrame, key: Sequence[str]) -> DataFrame:
    """By key, in the session's number of partitions: their bytes say nothing of the work in them."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *key)


def part_sums(parted: DataFrame, by: Sequence[str], value: str, reps: int,
              moment: str | None = None) -> DataFrame:
    """Per window, part and class: ends of ``value`` and, as one number per replicate, the draws
    ``n`` and with ``moment`` their sums ``s1`` and ``s2`` of it and of its square.  A written table.
    """
    key = [*by, "_part", "_sub"]
    names = ["n", "s1", "s2"] if moment else ["n"]
    kept = [parted.schema[c] for c in key]
    schema = StructType([*kept, StructField("class", LongType()), StructField("_lo", DoubleType()),
                         StructField("_hi", DoubleType()),
                         *[StructField(n, ArrayType(DoubleType())) for n in names]])

    draw, lists, repeat = _tools()
    columns = schema.names

    def add(part: pa.Table) -> pa.Table:
        part = part.take(pa.array(np.argsort(part["class"].to_numpy(), kind="stable")))
        counts = draw(part["_key"], range((reps + 3) // 4))[:reps]
        classes, starts = np.unique(part["class"].to_numpy(), return_index=True)
        v = part[value].to_numpy()
        h = np.nan_to_num(part[moment].to_numpy(), posinf=np.inf, neginf=-np.inf) if moment else None
        sums = np.empty((len(names), len(classes), reps))
        ends = np.empty((2, len(classes)))
        for i, at in enumerate(map(slice, starts, [*starts[1:], len(v)])):
            sums[0, i] = counts[:, at].sum(axis=1)
            if moment:
                drawn = counts[:, at].astype(np.float64)
                sums[1, i], sums[2, i] = drawn @ h[at], drawn @ (h[at] * h[at])
            ends[:, i] = v[at].min(), v[at].max()
        return pa.table([*[repeat(part[c], len(classes)) for c in key], pa.array(classes),
                         *map(pa.array, ends), *map(lists, sums)], names=columns)

    cols = dict.fromkeys([*key, "_key", "class", value, *([moment] if moment else [])])
    rows = parted.select(*cols).withColumn("class", F.col("class").cast("bigint"))
    return settle(_spread(rows, key).groupBy(*key).applyInArrow(add, schema))


def replicate_sums(parts: DataFrame, by: Sequence[str], names: Sequence[str] = ("n",)) -> DataFrame:
    """The same per (by, rep, class) over all parts; classes without a draw are left out."""
    each = parts.select(*by, "class", F.posexplode(F.arrays_zip(*names)).alias("rep", "_s"))
    return (each.filter("_s.n > 0").groupBy(*by, F.col("rep").cast("bigint").alias("rep"), "class")
            .agg(*[F.sum(f"_s.{n}").alias(n) for n in names]))


def _part_masses(parts: DataFrame, weights: DataFrame, by: Sequence[str], reps: int) -> DataFrame:
    """(by, rep, _part, _lo, _hi, _d draws, _m their weight): sums of a part over its classes."""
    key = [*by, "_part"]
    per_class = weights.groupBy(*by, "class").agg(
        F.collect_list(F.struct(F.col("rep").cast("bigint").alias("rep"), "_w")).alias("_ws"))
    both = parts.filter("_part >= 0").select(*key, "class", "_lo", "_hi", "n").join(
        per_class, [*by, "class"])
    schema = StructType([*[parts.schema[c] for c in key], StructField("_lo", DoubleType()),
                         StructField("_hi", DoubleType()),
                         *[StructField(n, ArrayType(DoubleType())) for n in ("_d", "_m")]])

    _, lists, repeat = _tools()
    columns = schema.names

    def add(part: pa.Table) -> pa.Table:
        part = part.combine_chunks()
        drawn = part["n"].combine_chunks().flatten().to_numpy().reshape(-1, reps)
        ws = part["_ws"].combine_chunks()
        row = np.repeat(np.arange(len(ws)), np.diff(ws.offsets.to_numpy()))
        rep, w = (x.to_numpy(zero_copy_only=False) for x in ws.flatten().flatten())
        dense = np.zeros(drawn.shape)
        dense[row, rep] = w
        sums = [drawn.sum(axis=0)[None], (drawn * dense).sum(axis=0)[None]]
        return pa.table([*[repeat(part[c], 1) for c in key],
                         pa.array([part["_lo"].to_numpy().min()]),
                         pa.array([part["_hi"].to_numpy().max()]), *map(lists, sums)],
                        names=columns)

    one = both.groupBy(*key).applyInArrow(add, schema)
    return one.select(*key, "_lo", "_hi", F.posexplode(F.arrays_zip("_d", "_m")).alias("rep", "_s")
                      ).select(*by, F.col("rep").cast("bigint").alias("rep"), "_part", "_lo", "_hi",
                               "_s.*")


def crossings(parted: DataFrame, parts: DataFrame, weights: DataFrame, goals: DataFrame,
              by: Sequence[str], value: str, reps: int, smooth: DataFrame | None = None) -> DataFrame:
    """The first drawn value of every replicate at which its running weight reaches a goal.

    ``weights``: by, rep, class, _w; ``goals``: by, rep, q, p, where ``q`` names a goal.  With
    ``smooth`` (by, rep, comps) the class normals are added to the running weight.  Returns by, rep,
    q, ``v`` (NULL if it is never reached), ``w_before``, ``below`` (the last value before, if any),
    ``v_max`` and ``w_all``.
    """
    by = list(by)
    rep = [*by, "rep"]
    upto = W.partitionBy(*rep).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    ends = settle(_part_masses(parts, weights, by, reps)).withColumn(
        "_base", F.coalesce(F.sum("_m").over(upto), F.lit(0.0)))
    reached, level = F.lit(True), F.col("_base") + F.col("_m")
    if smooth is None:
        reached = F.col("_d") > 0  # what is not drawn is no reading of the replicate
    else:
        ends = ends.join(smooth.select(*rep, "comps"), rep).withColumn(
            "_s", smooth_cdf(F.col("comps"), F.col("_hi"))).drop("comps")
        level = level + F.col("_s")
    reached = reached & (level >= F.col("p"))
    picks = settle(ends.withColumn("_level", level).join(goals.select(*rep, "q", "p"), rep).groupBy(
        *rep, "q", "p").agg(
        F.min(F.when(reached, F.struct("_part", "_base", "_lo", "_hi"))).alias("_at"),
        F.max(F.when(F.col("_level") < F.col("p"), F.col("_hi"))).alias("below"),
        F.max("_hi").alias("v_max"), F.sum("_m").alias("w_all")))
    out = [*rep, "q", "v", "w_before", "below"]
    # a part of one value needs no look inside
    flat = picks.filter("_at._lo = _at._hi").select(
        *rep, "q", F.col("_at._lo").alias("v"), F.col("_at._base").alias("w_before"), "below")
    inside = picks.filter("_at._lo < _at._hi").select(
        *rep, "q", "p", "below", F.col("_at._part").alias("_part"), F.col("_at._base").alias("_base"))
    classes = weights.groupBy(*rep).agg(F.collect_list(F.struct(
        F.col("class").cast("bigint").alias("class"), "_w")).alias("_ws"))
    asked = inside.join(classes, rep)
    if smooth is not None:
        asked = asked.join(smooth.select(*rep, *[F.col(f"comps.{c}").alias(f"_{c}") for c in (
            "mu", "sd", "w")]), rep)
    key = [*by, "_part"]
    rows = parted.select(*key, "_key", F.col("class").cast("bigint").alias("class"), value).join(
        small_side(settle(inside.select(*key).distinct())), key, "left_semi")
    schema = StructType([inside.schema[c] if c in ("rep", "q", *by) else StructField(c, DoubleType())
                         for c in out])
    cdf, normals, draw = row_cdf(), smooth is not None, _tools()[0]
    want = to_arrow_schema(schema)

    def table_of(columns: list) -> pa.Table:
        return pa.table([c.cast(f.type) if isinstance(c, pa.Array) else pa.array(c, f.type)
                         for c, f in zip(columns, want)], schema=want)

    def look(part: pa.Table, asks: pa.Table) -> pa.Table:
        if not len(part) or not len(asks):
            return table_of([[] for _ in out])
        part = part.take(pa.array(np.argsort(part[value].to_numpy(), kind="stable")))
        v, cls = part[value].to_numpy(), part["class"].to_numpy()
        asks = asks.combine_chunks()
        n_rep, base, goal = (asks[c].to_numpy() for c in ("rep", "_base", "p"))
        quads = np.unique(n_rep // 4)
        counts = draw(part["_key"], quads)
        place = 4 * np.searchsorted(quads, n_rep // 4) + n_rep % 4
        w_lists = asks["_ws"].to_pylist()
        comps = [[np.array(x) for x in asks[c].to_pylist()] for c in (
            "_mu", "_sd", "_w")] if normals else None
        found, before, below = (np.empty(len(n_rep)) for _ in range(3))
        table = np.zeros(int(cls.max()) + 1)
        for i, ws in enumerate(w_lists):
            table[:] = 0.0
            for w in ws:
                if w["class"] < len(table):
                    table[w["class"]] = w["_w"] or 0.0
            drawn = counts[place[i]]
            cum = base[i] + np.cumsum(table[cls] * drawn)
            if normals:
                mu, sd, w = (c[i] for c in comps)
                first, last = 0, len(v) - 1
                while first < last:
                    mid = (first + last) // 2
                    if cum[mid] + cdf(v[mid], mu, sd, w) >= goal[i]:
                        last = mid
                    else:
                        first = mid + 1
            else:
                taken = np.flatnonzero(drawn)
                first = taken[min(np.searchsorted(cum[taken], goal[i]), len(taken) - 1)]
            start = np.searchsorted(v, v[first])  # equal values count together
            found[i] = v[first]
            before[i] = cum[start - 1] if start else base[i]
            below[i] = v[start - 1] if start else np.nan
        last = asks["below"].to_pylist()
        below = [b if b == b else x for b, x in zip(below.tolist(), last)]
        return table_of([*[asks[c].combine_chunks() for c in [*rep, "q"]], found, before, below])

    sought = _spread(rows, key).groupBy(*key).cogroup(_spread(asked, key).groupBy(*key)).applyInArrow(
        look, schema)
    hits = flat.select(*out).unionByName(sought.select(*out))
    return picks.select(*rep, "q", "p", "v_max", "w_all", F.col("below").alias("_end")).join(
        hits, [*rep, "q"], "left").withColumn("below", F.coalesce("below", "_end")).drop("_end")
