import duckdb
import pytest

import __spark_entry__ as entry
import corpus_pipeline as P
from check import TABLES, rows_of
from winnow.llm import exact_dedup, queries, quality, sentencepiece_bpe


def test_every_operator_has_one_query():
    names = [n for n in entry.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14))
    assert "pipeline" in entry.queries() and len(P.STAGES) == 5


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_its_sql_twin(spark, sf, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf}/{t}.parquet')")
    df = entry.queries()[name](spark, sf)
    res = con.execute(entry.oracle_sql()[name])
    want = rows_of([d[0] for d in res.description], res.fetchall())
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == want


def test_stages_against_plain_versions(spark, sf):
    from tests.llm import test_near_copies
    from tests.llm.test_exact_dedup import brute

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    steps = {}
    for name, stage in P.STAGES:
        got = stage(spark, docs, sf)
        if name != "encode":
            assert got.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        given, docs = docs, exact_dedup.settle(got)
        steps[name] = (given.collect(), docs.collect())
    before, after = steps["quality_classifier"]
    model = quality.fit_on(spark.read.parquet(f"{sf}/documents.parquet"),
                           spark.read.parquet(f"{sf}/labels.parquet"))
    assert [r.doc_id for r in after] == [
        r.doc_id for r in before if model.scores([quality.passages(r.text)])[0] >= quality.ACCEPT]
    before, after = steps["exact_dedup"]
    assert sorted(r.doc_id for r in after) == sorted({k for _, k, _ in brute(before)})
    before, after = steps["near_dedup"]
    assert sorted(r.doc_id for r in after) == test_near_copies.brute(
        [(r.doc_id, r.text) for r in before])
    before, after = steps["mix_sources"]
    kept = {r.doc_id for r in after}
    assert kept < {r.doc_id for r in before} and len(kept) == len(after)
    before, after = steps["encode"]
    m = sentencepiece_bpe.model(sentencepiece_bpe.model_path())
    want = {r.doc_id: m.encoded(r.text)[1].decode() for r in before}
    assert {r.doc_id: ",".join(map(str, r.ids)) for r in after} == want


def test_pipeline_on_messy_rows(spark, sf, messy, empty):
    for frame in (messy, empty):
        docs = frame.drop("n_tokens", "score", "spans").withColumnRenamed("digest", "n_chars")
        for name, stage in P.STAGES:
            docs = exact_dedup.settle(stage(spark, docs, sf))
        assert docs.count() <= 12
