"""run() against brute force, stage by stage and as a whole."""

import corpus_pipeline as C
import pytest
from feedloom.llm import language_id
from feedloom.llm.common import saved

from test_byte_bpe import ENC
from test_decontamination import brute as brute_contained
from test_line_dedup import brute as brute_lines
from test_simhash import brute_components, brute_fp

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def outputs(spark):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    out.append(docs)
    for name, stage in C.STAGES:
        docs = saved(stage(spark, docs, SF), name)
        out.append(docs)
    return out


def texts(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_columns_and_names(outputs):
    assert [n for n, _ in C.STAGES] == ["language_id", "line_dedup", "simhash_near_dedup", "benchmark_decontamination", "byte_bpe"]
    for df in outputs[1:-1]:
        assert df.columns == outputs[0].columns and df.dtypes == outputs[0].dtypes


def test_language_stage(spark, outputs):
    docs = outputs[0]
    kept = {r.doc_id for r in language_id.predict(docs).where("not rejected").collect()}
    assert texts(outputs[1]) == {d: t for d, t in texts(docs).items() if d in kept}
    assert len(kept) >= 0.97 * docs.count()


def test_line_stage(outputs):
    before, after = texts(outputs[1]), texts(outputs[2])
    want = {d: kept for d, n, gone, kept in brute_lines(sorted(before.items()), 20) if not gone or kept.strip(" \t\n\x0b\x0c\r")}
    assert after == want
    assert all(r.n_chars == len(r.text) for r in outputs[2].collect() if before[r.doc_id] != r.text)


def test_near_duplicate_stage(outputs):
    rows = [(d, brute_fp(t)) for d, t in texts(outputs[2]).items()]
    assert sorted(texts(outputs[3])) == sorted({c for _, _, c in brute_components(rows)})


def test_decontamination_stage(spark, outputs):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    before = texts(outputs[3])
    bad = {r[0] for r in brute_contained(list(before.items()), items)}
    assert bad and sorted(texts(outputs[4])) == sorted(set(before) - bad)


def test_token_stage_and_run(spark, outputs):
    want = {d: ENC.encode_ordinary(t) for d, t in texts(outputs[4]).items()}
    rows = C.run(spark, SF).collect()
    assert {r.doc_id: list(r.ids) for r in rows} == want == {r.doc_id: list(r.ids) for r in outputs[5].collect()}
    assert all(r.round_trip and r.n_tokens == len(r.ids) for r in rows)


def test_odd_rows_and_empty_tables(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame([(9001, None, None, None, None), (9002, "", "en", "s", 0), (None, docs.first().text, "en", "s", 5),
                                 (9003, "123 456", "xx", "s", 7)], docs.schema)
    docs.union(odd).union(docs.limit(3)).write.parquet(str(tmp_path / "a" / "documents.parquet"))
    spark.read.parquet(f"{SF}/benchmark.parquet").write.parquet(str(tmp_path / "a" / "benchmark.parquet"))
    got = {r.doc_id for r in C.run(spark, str(tmp_path / "a")).select("doc_id").collect()}
    assert not got & {9001, 9002, 9003} and len(got) > 100 and None in got
    docs.where("false").write.parquet(str(tmp_path / "b" / "documents.parquet"))
    spark.read.parquet(f"{SF}/benchmark.parquet").where("false").write.parquet(str(tmp_path / "b" / "benchmark.parquet"))
    assert C.run(spark, str(tmp_path / "b")).count() == 0
