"""Streaming operators over an event stream (ts, instrument, gate_class, accepted, value).

Late rows: behind the watermark they are dropped, and Spark counts them in the query progress
(`Progress.dropped`).  Stateful steps that Spark has no aggregate for run as a fold over
micro-batches (`fold_batches`): a batch is first reduced by distributed operators, and only what is
left of a key meets its state, so a key may hold any share of a batch.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from winnow.functions.exprs import level, state_name
from winnow.operators.logs import append_chain
from winnow.operators.primitives import affine_totals, running_sums, settle, small_side
from winnow.sources.files import scratch


def tumbling_counts(events: DataFrame, step: str, late: str) -> DataFrame:
    """Counts per instrument and step."""
    return (events.withWatermark("ts", late).groupBy("instrument", F.window("ts", step).alias("w"))
            .agg(F.count("*").alias("n"), F.count_if("accepted").alias("n_acc"),
                 F.count_if(F.col("gate_class") == 2).alias("n_fines"))
            .select("instrument", F.unix_micros("w.start").alias("start_us"), "n", "n_acc",
                    "n_fines"))


def sliding_moments(events: DataFrame, width: str, slide: str, late: str, cell: float,
                    ) -> DataFrame:
    """Additive moments per sliding window, size class and reading cell: sums, not rows.

    The time of every row moves the watermark, that of a refused or closing row too; the condition
    names ``ts`` because Spark would move a plain filter in front of the watermark.
    """
    counted = F.when(F.col("ts").isNotNull(), F.col("accepted"))
    return (events.withWatermark("ts", late).filter(counted)
            .groupBy("instrument", F.window("ts", width, slide).alias("w"), "class",
                     F.floor(F.col("value") / cell).alias("cell"))
            .agg(F.count("*").alias("n"), F.sum("value").alias("s1"),
                 F.sum(F.col("value") * F.col("value")).alias("s2"))
            .select("instrument", F.unix_micros("w.start").alias("start_us"), "class", "cell",
                    "n", "s1", "s2"))


def corrected_windows(moments: DataFrame, reference: DataFrame, cell: float,
                      p: float = 0.1) -> DataFrame:
    """Re-weighted mean and lower quantile of each window from its moments.

    ``reference`` (class, f_true) is static.  The quantile is the first reading cell at which
    the running weight reaches p, so it is exact to one cell.
    """
    by = ["instrument", "start_us"]
    per = moments.groupBy(*by, "class").agg(F.sum("n").alias("nc"))
    total = per.groupBy(*by).agg(F.sum("nc").alias("nw"))
    weight = (per.join(total, by).join(small_side(reference), "class")
              .withColumn("w", F.col("f_true") / (F.col("nc") / F.col("nw"))))
    rows = moments.join(weight.select(*by, "class", "w"), [*by, "class"])
    mean = rows.groupBy(*by).agg(
        (F.sum(F.col("w") * F.col("s1")) / F.sum(F.col("w") * F.col("n"))).alias("mean"))
    ranked = running_sums(rows, by, "cell", {"wt": F.col("w") * F.col("n")})
    hit = F.col("wt_before") + F.col("wt") >= p * F.col("wt_total") - 1e-9
    low = ranked.groupBy(*by).agg(F.min(F.when(hit, F.col("cell"))).alias("cell"))
    return mean.join(low, by).select(*by, "mean", ((F.col("cell") + 0.5) * cell).alias("d10"))


def cumulative_counts(events: DataFrame) -> DataFrame:
    """Totals so far per instrument, for update mode."""
    return events.groupBy("instrument").agg(
        F.count_if("accepted").alias("n_acc"),
        F.count_if(F.col("gate_class") == 1).alias("n_twin"),
        F.count_if(F.col("gate_class") == 2).alias("n_fines"))


def closed_windows(events: DataFrame, reference: DataFrame, width: str, slide: str, late: str,
                   cell: float, p: float = 0.1) -> DataFrame:
    """Corrected mean and lower quantile of every window, as the watermark closes it.

    The state is the histogram of cells per window and class, which Spark merges and drops; a
    closed window leaves in one micro-batch with all its cells, meets the static reference there,
    and never comes again.
    """
    return run_available(sliding_moments(events, width, slide, late, cell), "append",
                         lambda closed: corrected_windows(closed, reference, cell, p))


def fold_batches(rows: DataFrame, state_schema: str,
                 fold: Callable[[DataFrame, DataFrame], tuple[DataFrame, DataFrame]]) -> DataFrame:
    """Runs a stream whose state is a table: fold(state, batch) -> (state after, output).

    Epoch n reads what epoch n - 1 left and writes its own state and output, each in a folder of
    its number, so a repeated epoch gives the same again.  Returns the outputs with ``epoch``.
    """
    spark = rows.sparkSession
    folder = scratch(spark, "stream-fold")

    def sink(batch: DataFrame, epoch: int) -> None:
        before = (spark.read.schema(state_schema).parquet(f"{folder}/state/epoch={epoch - 1:06d}")
                  if epoch else spark.createDataFrame([], state_schema))
        after, out = fold(before, settle(batch))
        after.write.mode("overwrite").parquet(f"{folder}/state/epoch={epoch:06d}")
        out.write.mode("overwrite").parquet(f"{folder}/out/epoch={epoch:06d}")

    query = (rows.writeStream.foreachBatch(sink)
             .option("checkpointLocation", scratch(spark, "stream-state"))
             .trigger(availableNow=True).start())
    query.awaitTermination()
    return spark.read.option("basePath", f"{folder}/out").parquet(f"{folder}/out/epoch=*")


def drift_stream(events: DataFrame, lam: float, limits: tuple[float, float]) -> DataFrame:
    """Running average of the undecided flag and of the reading per instrument and micro-batch.

    The rows of a micro-batch are ordered by time and id and composed to one affine map per
    instrument, in chunks; the state is three numbers.  Across micro-batches the source order
    decides.
    """
    rows = events.select(
        "instrument", "event_id", F.unix_micros("ts").alias("us"), "value",
        ((F.col("gate_class") == 0) & ~F.col("accepted")).cast("double").alias("undecided"))

    def moved(c: str) -> tuple[Column, Column]:
        return F.lit(1.0 - lam), F.lit(lam) * F.coalesce(c, F.lit(0.0))

    def fold(before: DataFrame, batch: DataFrame) -> tuple[DataFrame, DataFrame]:
        maps = settle(affine_totals(batch, ["instrument"], "us", ["event_id"], {
            "u": moved("undecided"), "v": moved("value")}))
        after = settle(before.join(maps, "instrument", "full").select(
            "instrument", *[
                (F.coalesce(f"{n}_a", F.lit(1.0)) * F.coalesce(old, F.lit(0.0))
                 + F.coalesce(f"{n}_b", F.lit(0.0))).alias(old)
                for n, old in (("u", "undecided_rate"), ("v", "level"))],
            (F.coalesce("n", F.lit(0)) + F.coalesce("rows", F.lit(0))).alias("n")))
        return after, after.join(maps.select("instrument"), "instrument", "left_semi")

    out = fold_batches(rows, "instrument bigint, undecided_rate double, level double, n bigint", fold)
    return out.withColumn("state", state_name(level(F.col("undecided_rate"), *limits)))


def latched_stops(levels: DataFrame, limit: float) -> DataFrame:
    """First step whose level reaches the limit, emitted once per batch and never again."""
    def fold(before: DataFrame, batch: DataFrame) -> tuple[DataFrame, DataFrame]:
        new = settle(batch.filter(F.col("level") >= limit).groupBy("batch_id").agg(
            F.min("step").alias("stop")).join(before, "batch_id", "left_anti"))
        return before.unionByName(new), new

    return fold_batches(levels, "batch_id bigint, stop bigint", fold)


def chain_stream(entries: DataFrame, body: str) -> DataFrame:
    """Links appended entries of each log; the state is the last sequence number and hash."""
    def fold(before: DataFrame, batch: DataFrame) -> tuple[DataFrame, DataFrame]:
        linked = settle(append_chain(batch, "log_id", "seq", F.col(body), before).select(
            "log_id", "seq", "prev_hash", "hash"))
        heads = before.unionByName(linked.select("log_id", "seq", "hash")).groupBy("log_id").agg(
            F.max("seq").alias("seq"), F.max_by("hash", "seq").alias("hash"))
        return heads, linked

    return fold_batches(entries, "log_id bigint, seq bigint, hash string", fold)


#: Rows of one file of a replayed table.
ROWS_PER_FILE = 200_000


def replay_parts(df: DataFrame, part: str, parts: int) -> DataFrame:
    """Stores a table as ``parts`` groups of files, by the number in ``part``, and reads them back as
    a stream with one group per micro-batch.  Every group has the same number of files, as many as
    the largest asks for, so no task writes a whole group.
    """
    spark = df.sparkSession
    folder = scratch(spark, "replay")
    df = settle(df)
    most = df.groupBy(part).count().agg(F.max("count")).first()[0] or 0
    files = max(1, -(-most // ROWS_PER_FILE))
    for i in range(parts):
        rows = df.filter(F.col(part) == i).drop(part)
        rows.repartition(files).write.mode("append").parquet(f"{folder}/part={i:03d}")
    return (spark.readStream.schema(df.drop(part).schema).option("maxFilesPerTrigger", files)
            .parquet(f"{folder}/part=*"))


def replay(df: DataFrame, order: str, parts: int, closing: int | None = None) -> DataFrame:
    """A table as a stream in the order of a column.

    With ``closing`` a last row follows that lies so far behind the others and is null elsewhere:
    the time mark by which a source says that nothing earlier will come.
    """
    cuts = df.approxQuantile(order, [i / parts for i in range(1, parts)], 0.001)
    place = sum(((F.col(order) > c).cast("int") for c in cuts), F.lit(0))
    placed = df.withColumn("_part", place)
    if closing is not None:
        last = df.agg((F.max(order) + closing).alias(order))
        placed = placed.unionByName(last.withColumn("_part", F.lit(parts)),
                                    allowMissingColumns=True)
        parts += 1
    return replay_parts(placed, "_part", parts)


@dataclass(frozen=True)
class Progress:
    """What Spark reports of a finished run: rows read, and rows behind the watermark.

    Spark counts dropped rows where they meet the state, so rows of one micro-batch that share a
    key are one row there.
    """

    read: int
    dropped: int


def run_counted(out: DataFrame, mode: str, transform: Callable[[DataFrame], DataFrame]
                | None = None) -> tuple[DataFrame, Progress]:
    """Runs a stream over all that is available; every micro-batch lands under its own epoch.

    Rewriting an epoch replaces it, so a retried batch is not counted twice.
    """
    spark: SparkSession = out.sparkSession
    folder = scratch(spark, "stream")

    def sink(batch: DataFrame, epoch: int) -> None:
        rows = transform(settle(batch)) if transform else batch
        rows.write.mode("overwrite").parquet(f"{folder}/epoch={epoch:06d}")

    query = (out.writeStream.outputMode(mode).foreachBatch(sink)
             .option("checkpointLocation", scratch(spark, "stream-state"))
             .trigger(availableNow=True).start())
    query.awaitTermination()
    reports = query.recentProgress
    progress = Progress(sum(p.numInputRows for p in reports),
                        sum(o.numRowsDroppedByWatermark for p in reports for o in p.stateOperators))
    return spark.read.option("basePath", folder).parquet(f"{folder}/epoch=*"), progress


def run_available(out: DataFrame, mode: str, transform: Callable[[DataFrame], DataFrame]
                  | None = None) -> DataFrame:
    return run_counted(out, mode, transform)[0]


def late_rows(events: DataFrame, step: str, late: str) -> DataFrame:
    """(instrument, kept, dropped): readings that tumbling windows counted, and readings that came
    behind the watermark.

    What is kept is what Spark's own windows hold; all that arrived is counted in a second pass
    without a watermark, as the progress counts dropped rows of all keys together.
    """
    kept = latest(run_available(tumbling_counts(events, step, late), "update"),
                  ["instrument", "start_us"]).groupBy("instrument").agg(F.sum("n").alias("kept"))
    came = latest(run_available(events.groupBy("instrument").agg(F.count("*").alias("came")),
                                "update"), ["instrument"])
    return came.join(kept, "instrument", "left").select(
        "instrument", F.coalesce("kept", F.lit(0)).alias("kept"),
        (F.col("came") - F.coalesce("kept", F.lit(0))).alias("dropped"))


def latest(df: DataFrame, keys: list[str]) -> DataFrame:
    """Last update of every key."""
    cols = [c for c in df.columns if c not in (*keys, "epoch")]
    return (df.groupBy(*keys).agg(F.max_by(F.struct(*cols), "epoch").alias("_r"))
            .select(*keys, "_r.*"))
