"""Streams against plain loops: order inside and across micro-batches, closing, late rows."""

import random

import pytest
from pyspark.sql import functions as F

from winnow.operators import logs as L
from winnow.streaming import operators as T

HOUR = 3_600_000_000


@pytest.fixture(scope="module")
def events(spark):
    rnd = random.Random(8)
    rows = [(i, rnd.choice([0, 0, 0, 1]), HOUR * rnd.randrange(0, 400) // 2, rnd.randrange(3),
             rnd.random() < 0.7, round(rnd.random() * 60, 2)) for i in range(900)]
    return rows, spark.createDataFrame(
        rows, "event_id long, instrument long, us long, gate_class long, accepted boolean, "
              "value double").repartition(4)


def stream(df, parts, closing=None):
    return T.replay(df, "us", parts, closing).withColumn("ts", F.timestamp_micros("us"))


@pytest.mark.parametrize("per_file", [200_000, 60])
def test_replay_splits_a_part_over_files(spark, events, monkeypatch, per_file):
    monkeypatch.setattr(T, "ROWS_PER_FILE", per_file)
    rows, df = events
    out, progress = T.run_counted(T.cumulative_counts(stream(df, 3)), "update")
    assert progress.read == len(rows) and progress.dropped == 0
    assert out.select("epoch").distinct().count() == 3
    got = {r.instrument: (r.n_acc, r.n_twin, r.n_fines) for r in T.latest(out, ["instrument"]).collect()}
    assert got == {k: (sum(r[4] for r in rows if r[1] == k),
                       sum(r[3] == 1 for r in rows if r[1] == k),
                       sum(r[3] == 2 for r in rows if r[1] == k)) for k in (0, 1)}


def test_drift_keeps_the_order_of_time(events):
    rows, df = events
    out = T.drift_stream(stream(df, 4), 0.1, (0.3, 0.5))
    got = {r.instrument: r for r in T.latest(out, ["instrument"]).collect()}
    # equal times have the order of the hash of their id inside one micro-batch
    from hashlib import md5

    for k in (0, 1):
        own = sorted((r[2], int(md5(str(r[0]).encode()).hexdigest()[:8], 16), r) for r in rows
                     if r[1] == k)
        u = v = 0.0
        for *_, r in own:
            u = 0.1 * (r[3] == 0 and not r[4]) + 0.9 * u
            v = 0.1 * r[5] + 0.9 * v
        assert got[k].n == len(own)
        assert (got[k].undecided_rate, got[k].level) == pytest.approx((u, v))


def test_windows_leave_once_when_they_close(spark, events):
    rows, df = events
    ref = spark.createDataFrame([(0, 0.5), (1, 0.3), (2, 0.2)], "class long, f_true double")

    def run(closing):
        ev = stream(df, 5, closing).withColumn("class", F.floor(F.col("value") / 20.0) % 3)
        return T.closed_windows(ev, ref, "12 hours", "6 hours", "1 day", 0.5).collect()

    everything = run(240 * HOUR)
    keys = [(r.instrument, r.start_us) for r in everything]
    assert len(keys) == len(set(keys))
    assert len({r.epoch for r in everything}) > 2  # windows leave while the stream runs
    assert set(keys) == {(r[1], (r[2] // (6 * HOUR) - o) * 6 * HOUR) for r in rows if r[4]
                         for o in (0, 1)}
    batch = T.sliding_moments(df.withColumn("ts", F.timestamp_micros("us")).withColumn(
        "class", F.floor(F.col("value") / 20.0) % 3), "12 hours", "6 hours", "1 day", 0.5)
    want = {(r.instrument, r.start_us): (r.mean, r.d10)
            for r in T.corrected_windows(batch, ref, 0.5).collect()}
    assert {(r.instrument, r.start_us): (r.mean, r.d10) for r in everything} == {
        k: pytest.approx(v) for k, v in want.items()}
    open_ = run(None)  # without the time mark the last windows stay open
    last = max(r[2] for r in rows)
    assert {(r.instrument, r.start_us) for r in open_} == {
        k for k in want if k[1] + 12 * HOUR <= last - 24 * HOUR}


def test_late_rows_are_counted(events):
    rows, df = events
    third = F.expr("cast(us * 3 div 720000000000 as int)")
    parts = df.withColumn("_part", F.when(F.col("event_id") % 7 == 0, 3).otherwise(third))

    def replayed():
        return T.replay_parts(parts, "_part", 4).withColumn("ts", F.timestamp_micros("us"))

    got = {r.instrument: (r.kept, r.dropped) for r in
           T.late_rows(replayed(), "6 hours", "1 day").collect()}
    held = [r for r in rows if r[0] % 7 == 0]
    mark = max(r[2] for r in rows if r[0] % 7 and r[2] * 3 // 720_000_000_000 <= 1) - 24 * HOUR
    lost = [r for r in held if (r[2] // (6 * HOUR) + 1) * 6 * HOUR <= mark]
    assert 0 < len(lost) < len(held)
    for k in (0, 1):
        n = sum(r[1] == k for r in lost)
        assert got[k] == (sum(r[1] == k for r in rows) - n, n)
    _, progress = T.run_counted(T.tumbling_counts(replayed(), "6 hours", "1 day"), "update")
    # Spark counts what meets the state: one row per window and task
    assert len({(r[1], r[2] // (6 * HOUR)) for r in lost}) <= progress.dropped <= len(lost)


def test_stops_latch_and_chains_go_on(spark):
    levels = spark.createDataFrame([(b, s, float((s * 7 + b) % 11)) for b in range(3)
                                    for s in range(30)] + [(9, 0, 1.0)],
                                   "batch_id long, step long, level double")
    got = {r.batch_id: r.stop for r in T.latched_stops(T.replay(levels, "step", 4), 9.0).collect()}
    assert got == {b: min(s for s in range(30) if (s * 7 + b) % 11 >= 9) for b in range(3)}
    entries = spark.createDataFrame([(g, i, f"{g} {i}") for g in (1, 2) for i in range(1, 20)],
                                    "log_id long, seq long, text string")
    body = L.row_digest(["text"])
    out = T.chain_stream(T.replay(entries.withColumn("body", body).drop("text"), "seq", 3), "body")
    whole = L.append_chain(entries, "log_id", "seq", body)
    cols = ("log_id", "seq", "prev_hash", "hash")
    assert sorted(map(tuple, out.select(*cols).collect())) == sorted(
        map(tuple, whole.select(*cols).collect()))
