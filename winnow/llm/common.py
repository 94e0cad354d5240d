"""Small helpers the operators of this package share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from winnow.operators.primitives import settle

#: Rows an Arrow batch is cut into before Python objects are made of it.
SLICE_ROWS = 256

#: Rows of a group from which it may count as hot, and hot groups at most.
HOT_ROWS = 500
HOT_GROUPS = 20_000

__all__ = ["SLICE_ROWS", "bounded_sample", "join_by_group", "map_slices", "settle", "table",
           "tagged_rows"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def map_slices(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None],
               schema: str, setup: Callable[[], Callable] | None = None) -> DataFrame:
    """``mapInArrow`` over small slices, so that memory follows a slice and not a batch.

    ``setup`` runs once per task and returns the function then used in place of ``fn``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = setup() if setup else fn
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                out = work(batch.slice(at, SLICE_ROWS))
                if out is not None and out.num_rows:
                    yield out

    return df.mapInArrow(run, schema)


def bounded_sample(df: DataFrame, key: Column, bound: int) -> DataFrame:
    """About ``bound`` rows picked by a hash of their key, never more than ``bound``.

    Only for fitting a model: the bound is a parameter of the caller.  Where the hash lets in more,
    the rows of the smallest hashes stay, so the sample is the same in any partitioning.
    """
    n = df.count()
    share = min(1.0, bound / max(1, n))
    u = F.pmod(F.xxhash64(F.lit("sample"), key), F.lit(1 << 30)) / F.lit(float(1 << 30))
    tie = F.xxhash64(*[F.col(c) for c in df.columns])
    return (df.withColumn("_u", u).filter(F.col("_u") < F.lit(share))
            .orderBy("_u", tie).limit(bound).drop("_u"))


def tagged_rows(df: DataFrame) -> DataFrame:
    """The rows with a name ``_row`` of their own, which keeps repeated rows and null ids apart.

    Rows of files are named by file and position, which no lost executor changes.  Other rows
    are written once with a number; it is made while writing and only read afterwards.
    """
    try:
        return df.select("*", F.concat_ws("#", "_metadata.file_path",
                                          F.lpad(F.col("_metadata.row_index").cast("string"),
                                                 12, "0")).alias("_row"))
    except AnalysisException:  # not a plain scan of files
        return settle(df.select("*", F.monotonically_increasing_id().alias("_row")))


def join_by_group(rows: DataFrame, groups: DataFrame, key: str | list[str], members: str,
                  total: int | None = None) -> DataFrame:
    """``rows`` with the columns of their group, whose ``members`` are its rows in ``rows``.

    A group of more than 1/``HOT_GROUPS`` of all rows is hot; there are fewer than ``HOT_GROUPS``
    of these, so they reach their rows by broadcast and no task gets all rows of one of them.
    Both sides are read twice, so they should be written tables.  ``total`` is the number of
    ``rows``, where the caller knows it.
    """
    if total is None:
        total = groups.agg(F.coalesce(F.sum(members), F.lit(0)).alias("n")).first()["n"]
    is_hot = F.col(members) > max(HOT_ROWS, total // HOT_GROUPS)
    hot = F.broadcast(groups.filter(is_hot).drop(members))
    keys = [key] if isinstance(key, str) else key
    rest = rows.join(F.broadcast(hot.select(*keys)), key, "left_anti")
    return rows.join(hot, key).unionByName(
        rest.join(groups.filter(~is_hot).drop(members), key))
