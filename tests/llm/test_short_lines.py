"""Lines of one and two tokens in line dedup."""

from feedloom.llm import line_dedup as D


def test_short_lines_are_counted_like_others(spark):
    rows = [(i, f"Les.\nAnd  ornd.\npage {i}\n7\n \nown {'abcdef'[i]}") for i in range(6)]
    rows += [(9, "And ornd.\nrare\nLes. "), (10, "rare"), (None, "Les.")]
    got = {r.doc_id: (r.n_lines, r.n_dropped, r.kept) for r in D.dedup(
        spark.createDataFrame(rows, "doc_id long, text string"), min_docs=5).collect()}
    assert got[0] == (6, 0, rows[0][1])
    for i in range(1, 6):
        assert got[i] == (6, 3, f"page {i}\n \nown {'abcdef'[i]}")
    assert got[9] == (3, 2, "rare") and got[10] == (1, 0, "rare") and got[None] == (1, 0, "Les.")


def test_a_literal_field_mark_and_digits_are_no_fields(spark):
    rows = [(i, f"<*>\nsee <*>\nsee {i}\nown {'abcdef'[i]}") for i in range(6)]
    got = {r.doc_id: r.kept for r in D.dedup(spark.createDataFrame(rows, "doc_id long, text string"), min_docs=5).collect()}
    assert got[0] == rows[0][1] and got[3] == "see 3\nown d"


def test_copied_passages_go_from_the_second_document_on(spark):
    passage = "eight words that stand in only two documents"
    rows = [(5, f"{passage}\nmy own"), (2, passage.replace(" ", "  ") + "\nseven words are too few for this"),
            (7, "seven words are too few for this"), (9, f"{passage}\n{passage}"), (None, passage)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_lines, r.n_dropped, r.kept) for r in D.dedup(frame, passage=8).collect()}
    assert got == {5: (2, 1, "my own"), 2: (2, 0, rows[1][1]), 7: (1, 0, rows[2][1]), 9: (2, 2, ""), None: (1, 0, passage)}
    assert all(r.n_dropped == 0 for r in D.dedup(frame).collect())
