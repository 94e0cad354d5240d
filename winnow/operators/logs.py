"""Tamper-evident logs: digests, chain append and verification, splits, fingerprints."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from winnow.functions.exprs import canonical
from winnow.operators.primitives import row_positions, settle, small_side

GENESIS = "0" * 64


def row_digest(cols: Sequence[str]) -> Column:
    """SHA-256 of a row's columns in their canonical text."""
    return F.sha2(canonical({c: F.col(c) for c in cols}), 256)


def json_digest(cols: Sequence[str]) -> Column:
    """SHA-256 of the row as compact JSON with sorted keys and nulls kept."""
    body = F.to_json(F.struct(*sorted(cols)), {"ignoreNullFields": "false"})
    return F.sha2(body, 256)


def python_json_digest(cols: Sequence[str]) -> Column:
    """The same digest as Python's ``json.dumps(sort_keys, compact)`` writes, for logs that
    were written by Python: it escapes non-ASCII text and prints floats its own way."""
    names = sorted(cols)

    def digest(rows: pd.DataFrame) -> pd.Series:
        import hashlib
        import json

        out = []
        for row in rows.itertuples(index=False):
            body = {k: (None if v is None or v != v else v) for k, v in zip(names, row)}
            blob = json.dumps(body, sort_keys=True, separators=(",", ":"), default=str)
            out.append(hashlib.sha256(blob.encode()).hexdigest())
        return pd.Series(out, dtype=object)

    return F.pandas_udf(digest, StringType())(F.struct(*names))


def link(log: Column, seq: Column, prev: Column, body: Column) -> Column:
    """Hash of an entry: its log, number and content digest bound to the hash before it."""
    return F.sha2(canonical({"log": log, "seq": seq, "prev": prev, "body": body}), 256)


def link_text(log, seq: int, prev: str, body: str) -> bytes:
    """What `link` hashes, for the one place where links must be walked in order."""
    named = {"log": log, "seq": seq, "prev": prev, "body": body}
    return "".join(f"{n}:-;" if v is None else f"{n}:{len(str(v))}:{v};"
                   for n, v in sorted(named.items())).encode()


def append_chain(entries: DataFrame, log: str, order: str, body: Column,
                 heads: DataFrame | None = None) -> DataFrame:
    """Number and link new entries behind each log's present head.

    A hash chain is sequential within a log and parallel across logs.  Content digests and
    positions are computed in parallel first; only (log, position, digest) are walked in order,
    in batches, and the hashes are joined back.  Adds seq, prev_hash and hash.
    """
    rows = settle(row_positions(entries.withColumn("_body", body), [log], order, ["_body"],
                                "_pos").drop("_pos_n"))
    slim = rows.select(log, "_pos", "_body")
    if heads is None:
        slim = slim.withColumn("_seq0", F.lit(0).cast("bigint")).withColumn(
            "_head", F.lit(GENESIS))
    else:
        slim = (slim.join(heads.select(log, F.col("seq").cast("bigint").alias("_seq0"),
                                       F.col("hash").alias("_head")), log, "left")
                .withColumn("_seq0", F.coalesce("_seq0", F.lit(0).cast("bigint")))
                .withColumn("_head", F.coalesce("_head", F.lit(GENESIS))))
    slim = slim.repartition(log).sortWithinPartitions(log, "_pos")
    kind = slim.schema[log].dataType.simpleString()

    def walk(batches):
        import hashlib

        current, seq, prev = None, 0, ""
        for pdf in batches:
            seqs, prevs, hashes = [], [], []
            for key, b, s0, head in zip(pdf[log], pdf["_body"], pdf["_seq0"], pdf["_head"]):
                if current is None or key != current:
                    current, seq, prev = key, int(s0), head
                seq += 1
                digest = hashlib.sha256(link_text(key, seq, prev, b)).hexdigest()
                seqs.append(seq)
                prevs.append(prev)
                hashes.append(digest)
                prev = digest
            yield pdf[[log, "_pos"]].assign(seq=seqs, prev_hash=prevs, hash=hashes)

    linked = slim.mapInPandas(
        walk, f"`{log}` {kind}, _pos bigint, seq bigint, prev_hash string, hash string")
    return rows.drop("seq", "prev_hash", "hash").join(linked, [log, "_pos"]).drop("_pos", "_body")


#: fixed values: what a refused signature is logged as
REFUSED = "signature_refused"


def signed_entries(attempts: DataFrame, accounts: DataFrame, meanings: Sequence[str],
                   reasons: Sequence[str]) -> DataFrame:
    """Every attempt to sign as the log entry it becomes: accepted under its meaning, or refused.

    ``attempts`` has user_name, proof, meaning, reason_code and its own columns; ``accounts`` has
    user_name, account_role and credential, the digest a proof must equal.  Adds ``role``,
    ``action`` and ``problem``: the first check that failed, of meaning, reason, user, credential.
    The proof itself is dropped.  Both kinds stay in one table, so that they are numbered and
    linked together and a refused attempt cannot be taken out unseen.
    """
    known = accounts.select("user_name", "account_role", "credential")
    both = attempts.join(small_side(known), "user_name", "left")
    problem = (F.when(~yes_in("meaning", meanings), "meaning")
               .when(~yes_in("reason_code", reasons), "reason")
               .when(F.col("account_role").isNull(), "user")
               .when(~F.col("proof").eqNullSafe(F.col("credential")), "credential"))
    return both.withColumn("problem", problem).withColumn(
        "action", F.when(F.col("problem").isNull(), F.col("meaning")).otherwise(REFUSED)).withColumn(
        "role", F.coalesce("account_role", F.lit("unknown"))).drop(
        "account_role", "credential", "proof")


def yes_in(column: str, values: Sequence[str]) -> Column:
    """Membership, where a missing value is in no list."""
    return F.coalesce(F.col(column).isin(*values), F.lit(False))


def signed_log(attempts: DataFrame, accounts: DataFrame, meanings: Sequence[str],
               reasons: Sequence[str], log: str, order: str, content: Sequence[str],
               heads: DataFrame | None = None) -> DataFrame:
    """Accepted and refused attempts as one hash chain per log; the digest of an entry covers its
    ``content`` columns and what was decided about it."""
    entries = signed_entries(attempts, accounts, meanings, reasons)
    return append_chain(entries, log, order, row_digest([*content, *DECISION]), heads)


#: Columns of an entry that its digest binds beside its content.
DECISION = ("user_name", "role", "action", "reason_code", "problem")


def verify_chain(entries: DataFrame, log: str, line: str, body: Column,
                 expected: DataFrame | None = None,
                 rows_per_bucket: int | None = None) -> DataFrame:
    """First bad entry of every log and what is wrong with it: its number, link or content,
    or the head of the log.

    An entry needs only the stored hash of the line before it, so the check is a join on
    position - 1 and does not walk the log.  ``expected`` (log, latest) holds hashes noted
    elsewhere; with them a shortened log is found too.
    """
    cols = entries.withColumn("_body", body).select(log, line, "seq", "prev_hash", "hash",
                                                    "_body")
    at = row_positions(cols, [log], line, ["hash"], "_pos", rows_per_bucket)
    before = at.select(log, (F.col("_pos") + 1).alias("_pos"), F.col("hash").alias("_before"))
    rows = at.join(before, [log, "_pos"], "left").withColumn(
        "_before", F.coalesce("_before", F.lit(GENESIS)))
    own = link(F.col(log), F.col("seq"), F.col("prev_hash"), F.col("_body"))
    problem = (F.when(~F.col("seq").eqNullSafe(F.col("_pos") + 1), "number")
               .when(~F.col("prev_hash").eqNullSafe(F.col("_before")), "link")
               .when(~F.col("hash").eqNullSafe(own), "content"))
    rows = rows.withColumn("_problem", problem)
    bad = F.when(F.col("_problem").isNotNull(), F.col("_pos"))
    out = rows.groupBy(log).agg(
        F.count("*").alias("entries"), (F.min(bad) + 1).alias("first_bad_seq"),
        F.min_by("_problem", bad).alias("problem"), F.max_by("hash", "_pos").alias("latest"))
    if expected is not None:
        out = out.join(expected.select(log, F.col("latest").alias("_want")), log, "full")
        gone = F.col("problem").isNull() & F.col("_want").isNotNull() & ~F.col(
            "latest").eqNullSafe(F.col("_want"))
        out = out.withColumn("entries", F.coalesce("entries", F.lit(0))).withColumn(
            "first_bad_seq", F.when(gone, F.col("entries")).otherwise(F.col("first_bad_seq"))
        ).withColumn("problem", F.when(gone, F.lit("head"))
                     .otherwise(F.col("problem"))).drop("_want")
    return out.withColumn("ok", F.col("problem").isNull())


def hash_split(group: Column, seed: int, test: float, val: float) -> Column:
    """train / val / test by a hash of the group, so a group never straddles."""
    digits = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), group), 256), 1, 13)
    u = F.conv(digits, 16, 10).cast("bigint") / F.lit(float(2 ** 52))
    return F.when(u < test, "test").when(u < test + val, "val").otherwise("train")


def split_problems(df: DataFrame, group: str, split: str, wanted: DataFrame) -> DataFrame:
    """Groups in more than one split, and groups in none; one row with both counts."""
    per = df.groupBy(group).agg(F.countDistinct(split).alias("_n"))
    straddle = per.agg(F.count_if(F.col("_n") > 1).alias("straddling"))
    lost = wanted.select(group).distinct().join(per, group, "left_anti").agg(
        F.count("*").alias("missing"))
    return straddle.withColumn("_k", F.lit(1)).join(lost.withColumn("_k", F.lit(1)), "_k").drop(
        "_k")


FINGERPRINT_PRIME = 1_000_000_007


def fingerprint(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Order-insensitive fingerprint of a table: rows, sum of hashes modulo a prime, xor."""
    text = canonical({c: F.col(c) for c in cols})
    h = F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("bigint")
    return df.select(h.alias("h")).agg(
        F.count("*").alias("n"),
        (F.sum(F.col("h") % FINGERPRINT_PRIME) % FINGERPRINT_PRIME).alias("sum_mod"),
        F.bit_xor("h").alias("xor"))


def batch_record(stops: DataFrame, est: DataFrame, faults: DataFrame, checks: DataFrame,
                 signed: DataFrame, method: str = "hybrid", spec: float | None = None,
                 by: str = "batch_id") -> DataFrame:
    """One nested document per batch, traceable to its log.

    ``timeline`` has one entry a step, ``stops`` one a rule, ``distribution`` is the estimate at the
    stop (at the last step without one), ``signed_actions`` are the signed entries of the log.
    Lists are as long as the steps, rules, faults and signatures of one batch.
    """
    ends = est.groupBy(by).agg(F.max("step").alias("_last"))
    cor = stops.filter(F.col("rule") == "C3").select(by, "stop")
    at = (cor.join(ends, by).withColumn("step", F.coalesce("stop", "_last"))
          .join(est, [by, "step"], "left"))
    line = est.groupBy(by).agg(F.sort_array(F.collect_list(F.struct(
        "step", F.col("t_s").alias("t_s"), F.col(f"{method}_d10").alias("d10_um"), "p_spec")))
        .alias("timeline"))
    rule_list = stops.groupBy(by).agg(F.sort_array(F.collect_list(F.struct("rule", "stop")))
                                      .alias("stops"))
    seen = faults.filter("first_step is not null").groupBy(by).agg(
        F.sort_array(F.collect_list(F.struct("fault", "first_step"))).alias("faults"))
    actions = signed.groupBy(by).agg(F.sort_array(F.collect_list(F.struct(
        "seq", "user_name", "role", "action", "reason_code", "hash"))).alias("signed_actions"))
    out = at.join(line, by, "left").join(rule_list, by).join(seen, by, "left").join(
        checks, by, "left").join(actions, by, "left")
    none = F.array().cast
    return out.select(
        by, F.struct(F.when(F.col("stop").isNotNull(), "stop").otherwise("go on").alias("status"),
                     F.col("stop").alias("stop_step")).alias("recommendation"),
        "timeline", "stops", F.struct(
            F.lit(method).alias("estimator"), F.col("step").alias("at_step"),
            *[F.col(f"{method}_{k}").alias(f"{k}_um") for k in ("mean", "d10", "d50", "d90")],
            "d10_lo", "d10_hi", "p_spec", F.lit(spec).cast("double").alias("spec_d10_um"))
        .alias("distribution"), "undecided_rate",
        F.coalesce("faults", none(seen.schema["faults"].dataType)).alias("faults"),
        F.coalesce("signed_actions", none(actions.schema["signed_actions"].dataType))
        .alias("signed_actions"),
        F.struct(F.coalesce("entries", F.lit(0)).alias("entries"), F.col("ok").alias("chain_ok"),
                 F.col("latest").alias("latest_hash")).alias("log"))


def export_records(records: DataFrame, path: str) -> None:
    """The documents as JSON lines, absent values written as null."""
    body = F.to_json(F.struct(*records.columns), {"ignoreNullFields": "false"})
    records.select(body.alias("value")).write.mode("error").text(path)
