from pyspark.sql import functions as F

from feedloom.llm.line_dedup import _lines


def test_lines_are_joined_without_cutting_each_by_a_pattern(spark):
    text = "a b c\n a\tb  c \n\n \t \nx9 y\r\né\x0bz 1 2 3\none"
    docs = spark.createDataFrame([(1, text), (2, None), (None, "a b c")], "doc_id long, text string")
    got = _lines(docs, 3, 3, True)
    assert "split(line" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert sorted((r.text, r.leaf, r.short) for r in got.collect()) == [
        ("a b c", "3 a b c", False), ("a b c", "3 a b c", False), ("one", "1 one", True), ("x9 y", "2 x9 y", True),
        ("é z 1 2 3", "5 é z <*>", False)]
    assert [r.leaf for r in _lines(docs, 0, 4, False).where(F.col("text") != "").collect()] == ["5"]
