"""Work and memory of queries whose figures grew too fast with their tables."""

from feedloom.operators import enrich
from feedloom.plans import queries
from feedloom.schema import PAGES_SCHEMA


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _tables(spark, folder, texts):
    spark.createDataFrame([(i, t, "en", "s") for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string") \
        .write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, f"https://{'spam-farm' if i == 25 else 'a'}.example.org/{i}", "<title>t</title>") for i in range(60)],
                          "page_id long, url string, html string").write.parquet(f"{folder}/pages.parquet")


def test_texts_with_references_are_decoded_once(spark, tmp_path):
    _tables(spark, tmp_path, ["one e two", None])
    got = queries.q_html_entities(spark, str(tmp_path))
    assert _plan(got).count("split(") == 1
    assert {r.doc_id: r.summary for r in got.collect()} == {0: "oné é two", 1: ""}


def test_many_references_of_rare_names(spark):
    from pyspark.sql import functions as F

    from feedloom.functions.text import html_unescape
    df = spark.range(1).select(html_unescape(F.expr("repeat('&zwnj; &zscr;&notit;&zzz; ', 1000)")).alias("t"))
    assert df.select(F.sha2("t", 256)).first()[0] == spark.range(1).select(
        F.sha2(F.expr("repeat('‌ \U0001d4cf¬it;&zzz; ', 1000)"), 256)).first()[0]


def test_page_metadata_leaves_texts_and_large_batches_out(spark):
    pages = spark.createDataFrame([("https://e/1", 200, "<meta name=description content=d><body>text</body>"), ("https://e/2", 200, None)], PAGES_SCHEMA)
    got = enrich.page_meta(pages)
    assert "containers" not in str(_plan(got)) and "page_metas" in _plan(got)
    assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch").rstrip("b")) <= 16 << 20
    assert {r.url: r.meta_description for r in got.collect()} == {"https://e/1": "d", "https://e/2": ""}


def test_merged_lint_parses_the_feeds_once(spark, tmp_path):
    _tables(spark, tmp_path, ["text"] * 60)
    got = queries.q_lint_merged(spark, str(tmp_path))
    assert "from_xml" not in _plan(got)
    assert {r.run: r.errors for r in got.collect()} == {0: 1, 1: 1}
