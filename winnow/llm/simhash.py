"""SimHash near-dedup with bit-sliced comparison.

A fingerprint bit is one when it is set in over half of the XXH64 values of a text's word
shingles.  Documents of one fingerprint collapse first.  Fingerprints that differ in few bits
agree in two of four 16-bit blocks, so each one goes to six buckets of 32 equal bits; a bucket of
many is cut again by two of four bytes of its other half, after which only 16 bits are free and
a group holds at most 65,536 fingerprints, however large the table is.  Both steps keep every
pair within two bits (pigeonhole).

Inside a group the bit planes are stored vertically: plane b is one integer whose bit j is bit b
of member j.  Comparing one member with all others takes one exclusive-or per plane and a
carry-save counter of ones, twos and over; a block is abandoned once every member exceeds the
radius.  A search over what is not reached yet gives each group as stars, never as pairs, and
alternating large-star and small-star rounds join the stars of all groups.

Defined results: a null or empty text has fingerprint zero and is linked like any other; a null
id is never the smallest unless its whole component has none; repeated rows have the same
fingerprint; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from winnow.llm.common import join_by_group, map_slices, settle, table, tagged_rows
from winnow.llm.registry import query

#: A bucket of more fingerprints than this is cut a second time.
BUCKET_ROWS = 4096

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def fingerprint(text: str | None, width: int = 3) -> int:
    """Unsigned 64-bit fingerprint of one text."""
    words = (text or "").encode().translate(_LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    cuts = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    digest = xxhash.xxh64_intdigest
    if len(words) <= width:
        hashes = [digest(joined, 42)]
    else:
        starts = [0, *(cuts[: len(words) - width] + 1).tolist()]
        ends = [*cuts[width - 1:].tolist(), len(joined)]
        hashes = [digest(joined[a:b], 42) for a, b in zip(starts, ends)]
    n = len(hashes)
    counts = np.zeros(64, np.int64)
    for at in range(0, n, 8192):
        part = np.array(hashes[at:at + 8192], dtype=">u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int32)
    return int.from_bytes(np.packbits(2 * counts > n).tobytes(), "big")


def fingerprints(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",),
                 width: int = 3) -> DataFrame:
    """The kept columns and ``fp``, the fingerprint as a signed long."""
    fields = docs.select(*keep).schema
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in fields) + ", fp bigint"

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column(len(keep)).to_pylist()
        fps = np.array([fingerprint(t, width) for t in texts], dtype=np.uint64).view(np.int64)
        return pa.RecordBatch.from_arrays([*batch.columns[:len(keep)], pa.array(fps)],
                                          names=[*keep, "fp"])

    return map_slices(docs.select(*keep, "text"), work, schema)


# ---- bit-sliced groups --------------------------------------------------------------------

def stars(values: list[int], radius: int = 2) -> Iterator[tuple[int, int]]:
    """(member, smallest) for every connected set of distinct unsigned values.

    Counters are ones, twos and over, so the radius is at most three.
    """
    n = len(values)
    full = (1 << n) - 1
    planes = []
    for b in range(64):
        plane = int("".join("1" if v >> b & 1 else "0" for v in reversed(values)), 2)
        if plane and plane != full:  # a plane all members share adds to no distance
            planes.append((b, plane))
    left = full
    while left:
        root = (left & -left).bit_length() - 1
        left &= ~(1 << root)
        reached, queue = [root], [root]
        while queue and left:
            v = values[queue.pop()]
            ones = twos = over = 0
            for i, (b, plane) in enumerate(planes):
                differ = plane ^ full if v >> b & 1 else plane
                carry = ones & differ
                ones ^= differ
                over |= twos & carry
                twos ^= carry
                if i & 7 == 7 and not left & ~(over | (twos & ones if radius < 3 else 0)):
                    near = 0  # all exceed the radius: the block is abandoned
                    break
            else:
                far = over | (twos if radius < 2 else twos & ones if radius < 3 else 0)
                if radius < 1:
                    far |= ones
                near = left & ~far
            left &= ~near
            while near:
                low = near & -near
                j = low.bit_length() - 1
                near ^= low
                reached.append(j)
                queue.append(j)
        if len(reached) > 1:
            members = [values[j] for j in reached]
            least = min(members)
            for m in members:
                if m != least:
                    yield m, least


def _bits(fp: Column, low: int, n: int) -> Column:
    return F.shiftrightunsigned(fp, low).bitwiseAND(F.lit((1 << n) - 1))


def _first_keys(fp: Column) -> Column:
    """Six keys: the number of the block pair, its 32 bits, and room for the second cut."""
    out = []
    for t, (i, j) in enumerate(combinations(range(4), 2)):
        out.append(F.lit(t << 51) + _bits(fp, 16 * i, 16) * F.lit(1 << 35)
                   + _bits(fp, 16 * j, 16) * F.lit(1 << 19) + F.lit(7 << 16))
    return F.array(*out)


def _second_keys(fp: Column, key: Column) -> Column:
    """Six finer keys of one first key, from the bytes its blocks leave free."""
    pairs = list(combinations(range(4), 2))
    by_table = []
    for i, j in pairs:
        rest = [b for b in range(4) if b not in (i, j)]
        bytes_ = [16 * b + 8 * h for b in rest for h in (0, 1)]
        by_table.append(F.array(*[
            key + F.lit((u - 7) << 16) + _bits(fp, bytes_[x], 8) * F.lit(256)
            + _bits(fp, bytes_[y], 8) for u, (x, y) in enumerate(pairs)]))
    t = F.shiftright(key, 51)
    out = by_table[0]
    for k, keys in enumerate(by_table[1:], 1):
        out = F.when(t == k, keys).otherwise(out)
    return out


def linked_stars(fps: DataFrame, radius: int = 2) -> DataFrame:
    """(a, b): every fingerprint a within a group's connected set, with its smallest b."""
    if radius > 2:
        raise ValueError("four blocks prove links of at most two bits")
    keyed = settle(fps.select("fp", F.explode(_first_keys(F.col("fp"))).alias("key")))
    sizes = keyed.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    shared = keyed.join(sizes, "key")
    few = shared.filter(F.col("n") <= BUCKET_ROWS).select("fp", "key")
    many = shared.filter(F.col("n") > BUCKET_ROWS).select(
        "fp", F.explode(_second_keys(F.col("fp"), F.col("key"))).alias("key"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def edges(values: list[int]) -> pa.RecordBatch | None:
            if len(values) < 2:
                return None
            out = np.array(list(stars(values, radius)), dtype=np.uint64).view(np.int64)
            if not len(out):
                return None
            return pa.RecordBatch.from_arrays([pa.array(out[:, 0]), pa.array(out[:, 1])],
                                              names=["a", "b"])

        at, group = None, []
        for batch in batches:
            keys = batch.column(1).to_numpy(zero_copy_only=False)
            values = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            if not len(keys):
                continue
            cuts = [0, *(np.flatnonzero(np.diff(keys)) + 1).tolist(), len(keys)]
            for lo, hi in zip(cuts, cuts[1:]):
                if keys[lo] != at:
                    if (out := edges(group)) is not None:
                        yield out
                    at, group = keys[lo], []
                group.extend(values[lo:hi].tolist())
        if (out := edges(group)) is not None:
            yield out

    return (few.unionByName(many).repartition("key").sortWithinPartitions("key")
            .mapInArrow(run, "a bigint, b bigint"))


def components(edges: DataFrame, split_hubs: bool = True) -> DataFrame:
    """(node, root): the smallest node of every connected set that has an edge.

    Large-star and small-star rounds; every round is a written table.  A node with a large share of
    all edges has its least neighbour broadcast to them; without ``split_hubs`` a node meets its
    edges in one task, with fewer and smaller jobs.
    """
    e = settle(edges.select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("m"))
               .filter("v <> m").distinct())

    def mark(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("v", "m").cast("decimal(38,0)"))).first())

    def with_least(rows: DataFrame, total: int) -> DataFrame:
        """Edges with the least neighbour of their ``v``; a hub's edges are not sent to one task."""
        least = rows.groupBy("v").agg(F.min("m").alias("least"), F.count("*").alias("n"))
        if not split_hubs:
            return rows.join(least.drop("n"), "v")
        least = settle(least)
        return join_by_group(rows, least, "v", "n", total)

    before = mark(e)
    while before[0]:
        both = e.unionByName(e.select(F.col("m").alias("v"), F.col("v").alias("m")))
        large = (with_least(both, 2 * before[0]).filter(F.col("m") > F.col("v"))
                 .select(F.col("m").alias("v"), F.least("v", "least").alias("m"))
                 .filter("v <> m").distinct())
        if split_hubs:
            large = settle(large)
        small = (with_least(large, before[0]).select(
            F.explode(F.array(F.struct("v", F.col("least").alias("m")),
                              F.struct(F.col("m").alias("v"), F.col("least").alias("m"))))
            .alias("x")).select("x.v", "x.m").filter("v <> m").distinct())
        e = settle(small)
        after = mark(e)
        if after == before:
            break
        before = after
    return e.select(F.col("v").alias("node"), F.col("m").alias("root"))


def near_dedup(rows: DataFrame, radius: int = 2) -> DataFrame:
    """(fp, root, component_id) of every fingerprint in ``rows`` (doc_id, fp); ids may repeat, so
    only ``root``, the smallest fingerprint, tells components apart."""
    classes = settle(rows.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = components(linked_stars(classes.select("fp"), radius), split_hubs=False)
    placed = classes.join(roots, classes["fp"] == roots["node"], "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root"))
    smallest = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    return placed.join(smallest, "root").select("fp", "root", "component_id")


def kept_rows(docs: DataFrame, radius: int = 2) -> DataFrame:
    """One row of every near-dup component: the smallest id; all columns stay."""
    tagged = tagged_rows(docs)
    rows = settle(fingerprints(tagged, ("doc_id", "_row")))
    placed = rows.join(near_dedup(rows, radius), "fp")
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "_row")
    keep = placed.groupBy("root").agg(F.min(order).getField("_row").alias("_row"))
    return tagged.join(keep.select("_row"), "_row", "left_semi").select(*docs.columns)


@query("op2_simhash_near_dedup")
def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = settle(fingerprints(table(spark, sf_dir, "documents")))
    return rows.join(near_dedup(rows), "fp").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
