"""Sharding by longest processing time: copies stay together, shards get near equal bytes.

A group is all rows of one text.  Groups go by falling size to the least loaded shard, ties to the
smaller number, through a heap.  Groups of one size are interchangeable for that rule, so the
schedule needs no list of groups: it walks the distinct group sizes with their counts, and a run of
equal groups is dealt up to a common level at once and by the heap from there.  T bytes have at
most sqrt(2T) distinct group sizes, and that histogram is all the driver sees.  The schedule says
how many groups of a size each shard takes; ranks inside a size, by digest, give every group its
shard.

Slots number the rows of a shard in a shuffled order (a hash of text and id).  Ranks and slots come
from hash parts with counted offsets, so neither a frequent size nor a large shard is one window,
and repeated rows are counted before they are numbered.

Defined results: a null text is an empty one; a null ``doc_id`` is an id like others; repeated rows
count each and get slots of their own; of equal groups the smaller digest goes to the smaller shard;
fewer groups than shards leave shards empty; an empty table gives no rows; a group larger than a
shard's share stays whole, so its shard is larger then; other columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from winnow.llm.common import join_by_group, settle, table, tagged_rows
from winnow.llm.registry import query
from winnow.operators.primitives import small_side

SHARDS = 40
#: Bytes a row counts beside its text.
ROW_BYTES = 16
#: Rows one window task numbers, and repeated rows one task writes out.
ROWS_PER_PART = 20_000
_KEYS = 1 << 60


def lpt(runs: Sequence[tuple[int, int]], shards: int) -> Iterator[tuple[int, list[int]]]:
    """(size, groups per shard) for runs (size, count) by falling size."""
    heap = [(0, i) for i in range(shards)]
    for size, count in runs:
        dealt = [0] * shards
        if count > 4 * shards:
            heap, count = _to_level(heap, size, count, dealt)
        for _ in range(count):
            load, i = heap[0]
            dealt[i] += 1
            heapq.heapreplace(heap, (load + size, i))
        yield size, dealt


def _to_level(heap: list, size: int, count: int, dealt: list[int]) -> tuple[list, int]:
    """Deals the groups that would go to loads below one level; the heap, and what is left over.

    A shard of load l takes groups at loads l, l + size, ...; those below a level come before all
    others, whatever their order.  The level is the highest that does not use up the run.
    """
    def taken(load: int, level: int) -> int:
        return max(0, -(-(level - load) // size))

    low, high = heap[0][0], heap[0][0] + size * (count + 1)
    while low < high:
        level = (low + high + 1) // 2
        if sum(taken(load, level) for load, _ in heap) <= count:
            low = level
        else:
            high = level - 1
    out = []
    for load, i in heap:
        dealt[i] = taken(load, low)
        count -= dealt[i]
        out.append((load + size * dealt[i], i))
    heapq.heapify(out)
    return out, count


def _part(key: Column, parts: Column) -> Column:
    """The part of a 60-bit key; parts keep the order of keys."""
    return F.least(F.floor(key / (F.lit(float(_KEYS)) / parts)), parts - 1).cast("int")


def _key(hex_: Column) -> Column:
    return F.conv(F.substring(hex_, 1, 15), 16, 10).cast("bigint")


def _parts(n: Column) -> Column:
    return F.greatest(F.lit(1), F.ceil(n / F.lit(ROWS_PER_PART))).cast("bigint")


def _offsets(rows: DataFrame, of: str, weight: Column) -> DataFrame:
    """(of, _part, _ahead): weights of the parts before."""
    ahead = W.partitionBy(of).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    sums = rows.groupBy(of, "_part").agg(F.sum(weight).alias("_sum"))
    return settle(sums.select(of, "_part", F.coalesce(F.sum("_sum").over(ahead), F.lit(0))
                              .alias("_ahead")))


def text_digest(text: Column) -> Column:
    return F.sha2(F.encode(F.coalesce(text, F.lit("")), "UTF-8"), 256)


def row_size(text: Column) -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + F.lit(ROW_BYTES)).cast("bigint")


def owners(groups: DataFrame, shards: int = SHARDS) -> DataFrame:
    """``groups`` (digest, bytes, ...) with ``shard``; digests are distinct."""
    sizes = groups.groupBy("bytes").agg(F.count("*").alias("n")).toArrow().sort_by(
        [("bytes", "descending")])
    plan = []
    for size, dealt in lpt(list(zip(*(c.to_pylist() for c in sizes.columns))), shards):
        taken = [(i, n) for i, n in enumerate(dealt) if n]
        upto = [n for _, n in taken]
        for k in range(1, len(upto)):
            upto[k] += upto[k - 1]
        plan.append((size, upto[-1], upto, [i for i, _ in taken]))
    tickets = small_side(groups.sparkSession.createDataFrame(
        plan, "bytes bigint, _n bigint, _upto array<bigint>, _shards array<int>"))
    placed = groups.join(tickets, "bytes").withColumn(
        "_part", _part(_key(F.col("digest")), _parts(F.col("_n"))))
    # a size of one part starts at zero; only frequent sizes have offsets
    frequent = placed.filter(F.col("_n") > ROWS_PER_PART)
    placed = placed.join(small_side(_offsets(frequent, "bytes", F.lit(1))), ["bytes", "_part"],
                         "left")
    rank = (F.coalesce("_ahead", F.lit(0)) - 1
            + F.row_number().over(W.partitionBy("bytes", "_part").orderBy("digest")))
    return placed.withColumn("_rank", rank).withColumn(
        "shard", F.element_at("_shards", F.size(F.filter(
            "_upto", lambda x: x <= F.col("_rank"))) + 1)).select(*groups.columns, "shard")


def assign(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """(doc_id, size, text_crc32, digest, shard, slot) of every row of ``docs`` (doc_id, text)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = settle(docs.select(
        "doc_id", row_size(F.col("text")).alias("size"), F.crc32(text.cast("binary"))
        .alias("text_crc32"), text_digest(F.col("text")).alias("digest"))
        .groupBy("doc_id", "size", "text_crc32", "digest").agg(F.count("*").alias("n")))
    groups = settle(rows.groupBy("digest").agg(
        F.sum(F.col("n") * F.col("size")).alias("bytes"), F.count("*").alias("members")))
    where = settle(owners(groups, shards))
    key = _key(F.md5(F.concat_ws(":", "digest", F.col("doc_id").cast("string"))))
    placed = settle(join_by_group(rows, where.select("digest", "shard", "members"), "digest",
                                  "members").withColumn("_key", key))
    sums = F.broadcast(placed.groupBy("shard").agg(F.sum("n").alias("_rows")))  # one row a shard
    placed = placed.join(sums, "shard").withColumn(
        "_part", _part(F.col("_key"), _parts(F.col("_rows"))))
    placed = placed.join(small_side(_offsets(placed, "shard", F.col("n"))), ["shard", "_part"])
    order = W.partitionBy("shard", "_part").orderBy("_key", "digest", "doc_id")
    start = (F.col("_ahead") + F.sum("n").over(order.rowsBetween(W.unboundedPreceding, 0))
             - F.col("n"))
    out = settle(placed.select("doc_id", "size", "text_crc32", "digest", "shard", "n",
                               start.alias("_start")))
    few = out.filter(F.col("n") <= ROWS_PER_PART)
    # many equal rows: cut into stretches, which are dealt out before they become rows
    cut = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1,
                               F.lit(ROWS_PER_PART).cast("bigint")))
    many = (out.filter(F.col("n") > ROWS_PER_PART).withColumn("_at", cut).select(
        "doc_id", "size", "text_crc32", "digest", "shard",
        F.least(F.col("n") - F.col("_at"), F.lit(ROWS_PER_PART)).alias("n"),
        (F.col("_start") + F.col("_at")).alias("_start")).repartition("shard", "_start"))
    slot = F.explode(F.sequence(F.col("_start"), F.col("_start") + F.col("n") - 1))
    return few.unionByName(many).select("doc_id", "size", "text_crc32", "digest", "shard",
                                        slot.alias("slot"))


def sharded_rows(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """The rows of ``docs`` with all their columns, and ``_shard``."""
    tagged = tagged_rows(docs)
    names = settle(tagged.select("_row", text_digest(F.col("text")).alias("digest"),
                                 row_size(F.col("text")).alias("size")))
    groups = settle(names.groupBy("digest").agg(
        F.sum("size").alias("bytes"), F.count("*").alias("members")))
    placed = join_by_group(names.select("_row", "digest"), owners(groups, shards), "digest",
                           "members")
    return tagged.join(placed.select("_row", F.col("shard").alias("_shard")), "_row").select(
        *docs.columns, "_shard")


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, files: int = 8) -> None:
    """Parquet folders ``_shard=0`` and so on, of about ``files`` files each."""
    deal = F.pmod(F.xxhash64(*[c for c in docs.columns]), F.lit(files))
    (sharded_rows(docs, shards).repartition("_shard", deal)
     .write.partitionBy("_shard").parquet(path))


#: CRC-32 by its rule: the reflected polynomial, one byte of the text a step.
_CRC = []
for _byte in range(256):
    for _ in range(8):
        _byte = (_byte >> 1) ^ (0xEDB88320 if _byte & 1 else 0)
    _CRC.append(_byte)

OP11_SQL = f"""
WITH RECURSIVE t AS (SELECT doc_id, coalesce(text, '') AS x FROM documents),
d AS (SELECT doc_id, x, strlen(x) + {ROW_BYTES} AS size, sha256(x) AS h FROM t),
g AS (SELECT h, sum(size)::BIGINT AS bytes FROM d GROUP BY h),
o AS (SELECT h, bytes, row_number() OVER (ORDER BY bytes DESC, h) AS i,
             row_number() OVER (PARTITION BY bytes ORDER BY h) AS r FROM g),
s AS (SELECT 0::BIGINT AS i, 0::BIGINT AS bytes, 0::BIGINT AS p,
             list_transform(range({SHARDS}), lambda x: 0::BIGINT) AS loads
      UNION ALL
      SELECT i, bytes, p, list_transform(loads, lambda v, k: CASE WHEN k = p THEN v + bytes ELSE v END)
      FROM (SELECT o.i, o.bytes, list_position(s.loads, list_min(s.loads)) AS p, s.loads
            FROM s JOIN o ON o.i = s.i + 1)),
c AS (SELECT bytes, p - 1 AS shard, row_number() OVER (PARTITION BY bytes ORDER BY p) AS r
      FROM s WHERE i > 0),
w AS (SELECT h, shard FROM o JOIN c USING (bytes, r)),
crc AS (SELECT h, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(
            regexp_extract_all(hex(encode(x)), '..'), lambda y: ('0x' || y)::BIGINT)),
            lambda a, b: xor(a >> 8, {_CRC}[(xor(a, b) & 255) + 1]::BIGINT)), 4294967295::BIGINT) AS crc
        FROM (SELECT h, min(x) AS x FROM d GROUP BY h))
SELECT doc_id, size, crc AS text_crc32, 'bytes' AS law, shard::INTEGER AS shard,
       row_number() OVER (PARTITION BY shard ORDER BY ('0x' || substr(
           md5(h || coalesce(':' || doc_id, '')), 1, 15))::BIGINT, h, doc_id) - 1 AS slot,
       NULL::INTEGER AS grown_shard
FROM d JOIN w USING (h) JOIN crc USING (h)
"""


@query("op11_shard_by_size", OP11_SQL)
def op11_shard_by_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return assign(docs).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
                               "slot", F.lit(None).cast("int").alias("grown_shard"))
