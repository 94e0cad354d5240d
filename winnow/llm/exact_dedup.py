"""Exact dedup of an incoming batch against an immutable snapshot.

Texts are equal when they are identical after deleting ASCII white space.  The digests of a
snapshot never change, so each of their buckets gets one static binary-fuse filter, built once
and written.  Digests of the incoming batch are screened by these filters: a negative is
certainly new, a positive joins the exact bucket.  Duplicates inside the batch are grouped by
themselves, with a map-side combine.  Every class of two or more rows is then checked by bytes;
rows of one digest with different texts are split by the text itself.

Defined results: a null text counts as empty; empty texts are one class; a null ``doc_id`` sorts
behind every other id; of repeated rows one stays (`kept_rows`); an empty snapshot or batch gives
the classes of the other; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from winnow.llm.common import settle, table, tagged_rows
from winnow.llm.registry import query

#: Distinct digests one filter holds; the number of buckets follows from the count.
KEYS_PER_FILTER = 100_000

_M64 = (1 << 64) - 1


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), "[\\x20\\x09-\\x0D]+", "")


def sha256(text: Column) -> Column:
    return F.sha2(F.encode(text, "UTF-8"), 256)


# ---- binary-fuse filter -------------------------------------------------------------------

def _mix(keys: np.ndarray, seed: int) -> np.ndarray:
    """The 64-bit finaliser of splitmix over whole arrays."""
    with np.errstate(over="ignore"):
        x = keys + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x9E3779B97F4A7C15) & _M64)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def _slots(h: np.ndarray, segments: int, seg: int) -> tuple[np.ndarray, ...]:
    """Three slots of a key in three neighbouring segments, as the fuse layout wants."""
    first = (((h >> np.uint64(32)) * np.uint64(segments)) >> np.uint64(32)).astype(np.int64)
    mask = np.uint64(seg - 1)
    inside = [((h >> np.uint64(s)) & mask).astype(np.int64) for s in (0, 11, 21)]
    return tuple((first + i) * seg + inside[i] for i in range(3))


def _print8(h: np.ndarray) -> np.ndarray:
    return ((h ^ (h >> np.uint64(32))) & np.uint64(0xFF)).astype(np.uint8)


def build_filter(keys: np.ndarray) -> tuple[int, int, int, bytes]:
    """(seed, segments, segment length, fingerprints) of distinct uint64 keys.

    The slots of a key are peeled in rounds: every slot that only one key still uses gives that
    key its place.  Places are filled in reverse order of the rounds.  Keys that hit no empty
    core are tried again with the next seed.
    """
    n = len(keys)
    seg = 1 << max(2, min(11, int(np.log(max(n, 2)) / np.log(3.33) + 2.25)))
    factor = max(1.125, 0.875 + 0.25 * np.log(1e6) / np.log(max(n, 2)))
    segments = max(1, -(-int(n * factor) // seg) - 2)
    for seed in range(200):
        if seed and seed % 20 == 0:
            segments += max(1, segments // 10)
        h = _mix(keys, seed)
        at = np.stack(_slots(h, segments, seg)) if n else np.zeros((3, 0), np.int64)
        size = (segments + 2) * seg
        count = np.zeros(size, np.int64)
        which = np.zeros(size, np.int64)
        index = np.arange(n, dtype=np.int64)
        for row in at:
            np.add.at(count, row, 1)
            np.bitwise_xor.at(which, row, index)
        rounds, left = [], n
        alone = np.flatnonzero(count == 1)
        while len(alone):
            key, first = np.unique(which[alone], return_index=True)
            place = alone[first]
            rounds.append((key, place))
            left -= len(key)
            touched = []
            for row in at:
                slots = row[key]
                np.subtract.at(count, slots, 1)
                np.bitwise_xor.at(which, slots, key)
                touched.append(slots)
            near = np.unique(np.concatenate(touched))
            alone = near[count[near] == 1]
        if left:
            continue
        table_ = np.zeros(size, np.uint8)
        prints = _print8(h)
        for key, place in reversed(rounds):
            a, b, c = at[:, key]
            # the own place still holds zero, so the three slots give what is missing
            table_[place] = prints[key] ^ table_[a] ^ table_[b] ^ table_[c]
        return seed, segments, seg, table_.tobytes()
    raise RuntimeError("no seed peels the filter: the keys are not distinct")


def may_contain(filt: tuple[int, int, int, bytes], keys: np.ndarray) -> np.ndarray:
    seed, segments, seg, raw = filt
    table_ = np.frombuffer(raw, np.uint8)
    h = _mix(keys, seed)
    a, b, c = _slots(h, segments, seg)
    return _print8(h) == (table_[a] ^ table_[b] ^ table_[c])


def _key64(hexes: pd.Series) -> np.ndarray:
    return np.array([int(x[:16], 16) for x in hexes], dtype=np.uint64)


FILTER = "_bucket int, seed int, segments int, seg int, prints binary"


def snapshot_filters(digests: DataFrame, buckets: int) -> DataFrame:
    """One static filter per bucket of a snapshot's distinct digests, written once."""

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        seed, segments, seg, prints = build_filter(np.unique(_key64(pdf["digest"])))
        return pd.DataFrame([(int(pdf["_bucket"].iloc[0]), seed, segments, seg, prints)],
                            columns=["_bucket", "seed", "segments", "seg", "prints"])

    return settle(digests.select("digest", _bucket("digest", buckets))
                  .groupBy("_bucket").applyInPandas(build, FILTER))


def _bucket(digest: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(digest), F.lit(buckets)).cast("int").alias("_bucket")


def screen(digests: DataFrame, filters: DataFrame, buckets: int) -> DataFrame:
    """(digest, maybe): false is certain, true goes to the exact bucket."""

    def look(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(right):
            return pd.DataFrame({"digest": left["digest"], "maybe": False})
        r = right.iloc[0]
        filt = (int(r["seed"]), int(r["segments"]), int(r["seg"]), r["prints"])
        return pd.DataFrame({"digest": left["digest"],
                             "maybe": may_contain(filt, _key64(left["digest"]))})

    return (digests.select("digest", _bucket("digest", buckets)).groupBy("_bucket")
            .cogroup(filters.groupBy("_bucket")).applyInPandas(look, "digest string, maybe boolean"))


# ---- classes ------------------------------------------------------------------------------

def _classes(rows: DataFrame) -> DataFrame:
    """Rows of a class, and the order of the row that stays; combined before the shuffle."""
    order = F.struct((-F.col("n_cp")).alias("size"), F.col("doc_id").isNull().alias("none"),
                     "doc_id", "_row")
    return rows.groupBy("digest").agg(F.count("*").alias("n"), F.min(order).alias("best"))


def duplicate_classes(snapshot: DataFrame, incoming: DataFrame) -> DataFrame:
    """(digest, n, best) over snapshot and batch, both with digest, doc_id, n_cp, _row.

    Filters of the snapshot decide which digests of the batch need the exact join.
    """
    old, new = settle(_classes(snapshot)), settle(_classes(incoming))
    buckets = max(1, -(-max(old.count(), new.count()) // KEYS_PER_FILTER))
    filters = snapshot_filters(old.select("digest"), buckets)
    marked = new.join(screen(new, filters, buckets), "digest")
    fresh = marked.filter(~F.col("maybe")).select("digest", "n", "best")
    maybe = marked.filter("maybe").select("digest", F.col("n").alias("n2"),
                                          F.col("best").alias("best2"))
    # a positive finds its exact bucket, or was a false alarm and stays a class of its own
    both = old.join(maybe, "digest", "full_outer").select(
        "digest", (F.coalesce("n", F.lit(0)) + F.coalesce("n2", F.lit(0))).alias("n"),
        F.least("best", "best2").alias("best"))
    return settle(both.unionByName(fresh))


def _byte_check(texts: DataFrame, rows: DataFrame, classes: DataFrame) -> DataFrame:
    """Digests under which different texts met; smallest and largest text differ there.

    Rows of larger classes are picked without their texts, which then join by row number: a
    class of any size is spread evenly and combined before it is shuffled by its digest.
    """
    many = rows.join(classes.filter("n > 1").select("digest"), "digest").select("_row", "digest")
    return (texts.join(many, "_row").groupBy("digest")
            .agg(F.min("norm").alias("lo"), F.max("norm").alias("hi"))
            .filter("lo <> hi").select("digest"))


def dedup(docs: DataFrame, incoming: Column | None = None,
          digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """``docs`` with ``_row``, text_sha256, keep_id, keep_row, group_size; one row per row.

    ``docs`` needs doc_id, text and _row (see `tagged_rows`).  ``incoming`` marks the rows of
    the new batch, by default a quarter by hash; the others are the snapshot.
    """
    if incoming is None:
        incoming = F.pmod(F.xxhash64("doc_id"), F.lit(4)) == 0
    norm = normalised(F.col("text"))
    texts = docs.select("doc_id", "_row", norm.alias("norm"))
    rows = settle(docs.select(
        "doc_id", "_row", F.length(F.coalesce("text", F.lit(""))).cast("bigint").alias("n_cp"),
        digest(norm).alias("digest"), incoming.alias("incoming"),
        *([] if digest is sha256 else [sha256(norm).alias("text_sha256")])))
    if digest is sha256:
        rows = rows.withColumn("text_sha256", F.col("digest"))
    classes = duplicate_classes(rows.filter(~F.col("incoming")), rows.filter("incoming"))
    split = settle(_byte_check(texts.select("_row", "norm"), rows, classes))
    out = rows
    if not split.isEmpty():  # different texts under one digest: their text is their class
        mixed = (texts.select("_row", "norm", digest(F.col("norm")).alias("digest"))
                 .join(split, "digest", "left_semi")
                 .select("_row", F.concat_ws(":", "digest", "norm").alias("_own")))
        out = (rows.join(mixed, "_row", "left")
               .withColumn("digest", F.coalesce("_own", "digest")).drop("_own"))
        again = _classes(out.filter(F.col("digest").contains(":")))
        classes = classes.join(split, "digest", "left_anti").unionByName(again)
    kept = classes.select("digest", F.col("n").alias("group_size"),
                          F.col("best.doc_id").alias("keep_id"),
                          F.col("best._row").alias("keep_row"))
    return out.join(kept, "digest").select("doc_id", "_row", "text_sha256", "keep_id",
                                           "keep_row", "group_size")


def kept_rows(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns and no others."""
    tagged = tagged_rows(docs)
    keep = dedup(tagged).filter("_row = keep_row").select("_row")
    return tagged.join(keep, "_row", "left_semi").select(*docs.columns)


OP9_SQL = r"""
WITH t AS (SELECT doc_id, length(coalesce(text, '')) AS n_cp,
                  sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) AS h
           FROM documents),
k AS (SELECT h, count(*) AS n, first(doc_id ORDER BY n_cp DESC, doc_id) AS keep_id
      FROM t GROUP BY h)
SELECT t.doc_id, k.keep_id, k.n AS group_size, t.doc_id = k.keep_id AS kept, t.h AS text_sha256
FROM t JOIN k ON t.h = k.h
"""


@query("op9_exact_dedup", OP9_SQL)
def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three quarters of the documents are the snapshot, one quarter the incoming batch."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup(tagged_rows(docs)).select(
        "doc_id", "keep_id", "group_size", (F.col("_row") == F.col("keep_row")).alias("kept"),
        "text_sha256")
