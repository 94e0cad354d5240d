import duckdb
import pytest

import __spark_entry__ as entry
from check import TABLES, rows_of


def test_every_twin_has_a_query():
    names = set(entry.queries())
    assert set(entry.oracle_sql()) <= names and len(names) > 120


def test_entry_returns_one_row_per_batch(spark):
    rows = entry.entry(spark).collect()
    assert sorted(r.batch_id for r in rows) == [0, 1, 2, 3]


def test_correction_is_closer_than_the_raw_sample(spark):
    # at this size the sampling error of one batch is below the size bias
    rows = entry.queries()["slice_corrected_d10"](spark, "/root/testdata/sf0.01").collect()
    raw = sum(abs(r.raw_d10 - r.true_d10) for r in rows)
    assert sum(abs(r.corrected_d10 - r.true_d10) for r in rows) < raw


@pytest.mark.parametrize("name", [
    "prj2_event_label", "bin5_merge_bins", "a2_weighted_quantile_global", "a13_worst_cell",
    "a29_ks_distance", "j6_unfinished_cases", "w8_ewma", "w10_smoothed_crossing", "t6_even_frames",
    "d8_threshold_grid", "l2_chain_append", "src7_json_export", "g1_circle_fit",
    "str1_tumbling_counts", "str7_chain_stream", "p4_affine_scan", "j2_asof_interpolate",
    "j8_case_grid", "src2_keyed_set", "src9_tree_hash_of_list", "l2_refused_attempts",
    "str8_late_rows", "a32_undecided_curve", "e5_trend_fit", "m3_drift_state"])
def test_query_equals_its_sql_twin(spark, sf, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf}/{t}.parquet')")
    df = entry.queries()[name](spark, sf)
    res = con.execute(entry.oracle_sql()[name])
    want = rows_of([d[0] for d in res.description], res.fetchall())
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == want
