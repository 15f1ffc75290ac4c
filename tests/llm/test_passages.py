"""Passages that recur in fewer documents than line dedup's templates need."""

import corpus_pipeline as C
from feedloom.llm import line_dedup as D

SCHEMA = "doc_id long, text string, lang string, n_chars long"
PASSAGE = " ".join(f"word{'abcdefghijklmnopqrstuvwxyz'[i % 26]}{'xyz'[i % 3]}" for i in range(60))


def words(seed, n=60):
    return " ".join("".join("bcdfghklmnprst"[(seed * 31 + i * 7 + j * 5) % 14] + "aeiou"[(seed * 3 + i * 11 + j) % 5] for j in range(3))
                    for i in range(n))


def stage(spark, f, rows):
    df = spark.createDataFrame([(d, t, "en", -1) for d, t in rows], SCHEMA)
    out = f(df)
    assert out.columns == df.columns and out.dtypes == df.dtypes
    return sorted(((r.doc_id, r.text, r.n_chars) for r in out.collect()), key=lambda r: (r[0] is None, r))


def test_copied_lines_go_from_the_second_document_on(spark):
    rows = [(1, f"own a\n{PASSAGE}\nshort line"), (2, f"{PASSAGE.replace(' ', '  ')}\nown b\nshort line"), (3, PASSAGE), (4, f"own c\n{PASSAGE}\n{PASSAGE}"),
            (5, " ".join(PASSAGE.split()[:7])), (6, " ".join(PASSAGE.split()[:7])), (7, None), (8, ""), (None, PASSAGE), (1, f"own a\n{PASSAGE}\nshort line")]
    assert stage(spark, D.without_copied_lines, rows) == [
        (1, rows[0][1], -1), (1, rows[0][1], -1), (2, "own b\nshort line", 16), (4, "own c", 5), (5, rows[4][1], -1), (6, rows[5][1], -1),
        (7, None, -1), (8, "", -1), (None, PASSAGE, -1)]
    assert stage(spark, D.without_copied_lines, []) == []


def test_templates_of_passage_length_need_five_documents(spark):
    form = "Posted by user {} on this page of the very fine site"
    names = ["ann", "bob", "cat", "dan", "eve"]
    rows = [(i, form.format(n) + f"\nown {n}") for i, n in enumerate(names)]
    assert stage(spark, D.without_repeated_passages, rows[:4]) == [(d, t, -1) for d, t in rows[:4]]
    assert [t for _, t, _ in stage(spark, D.without_repeated_passages, rows)] == [rows[0][1]] + [f"own {n}" for n in names[1:]]


def test_pipeline_stage_drops_a_passage_of_two_documents(spark, tmp_path):
    rows = [(i, f"{words(i, 120)}\n{PASSAGE}") for i in (1, 2)]
    out = stage(spark, lambda df: C.near_duplicate_stage(spark, df, str(tmp_path)), rows)
    assert [t for _, t, _ in out] == [rows[0][1], words(2, 120)]
