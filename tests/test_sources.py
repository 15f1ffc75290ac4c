import pytest

from feedloom.operators import lint
from feedloom.sources import feeds, jsonl

RSS = ('<?xml version="1.0"?><rss version="2.0"><channel><title>{t}</title>'
       '<item><title>{i}</title><link>https://pier.test/{i}</link><guid>g-{i}</guid>'
       '<pubDate>Mon, 02 Jan 2006 15:04:05 -0700</pubDate><category>c1</category></item></channel></rss>')
ATOM = ('<?xml version="1.0" encoding="utf-8"?><feed xmlns="http://www.w3.org/2005/Atom"><title>{t}</title>'
        '<entry><title>{i}</title><link href="https://pier.test/{i}"/><id>urn:{i}</id>'
        '<updated>2024-01-02T03:04:05Z</updated></entry></feed>')


def _chunks(spark, text, **kw):
    df = spark.createDataFrame([(text,)], "value string")
    return feeds.chunk_text(df, "value", **kw)


def test_split(spark):
    text = RSS.format(t="a", i="1") + "\n" + ATOM.format(t="b", i="2") + "<rss><channel>"
    got = [r.chunk for r in _chunks(spark, text).orderBy("chunk_idx").collect()]
    assert len(got) == 3 and got[0].endswith("</rss>") and got[1].endswith("</feed>")
    assert got[2] == "<rss><channel>"


def test_parse_rss_atom_rss(spark):
    text = RSS.format(t="A", i="1") + ATOM.format(t="B", i="2") + RSS.format(t="C", i="3")
    items = feeds.feed_items(feeds.parse_feeds(_chunks(spark, text))).orderBy("pos").collect()
    assert [(r.title, r.source, r.url) for r in items] == [
        ("1", "A", "https://pier.test/1"), ("2", "B", "https://pier.test/2"), ("3", "C", "https://pier.test/3")]
    assert items[0].id == "g-1" and items[0].categories == ["c1"]
    assert items[0].published_at.isoformat() == "2006-01-02T22:04:05"
    assert items[1].updated_at is not None and items[1].published_at is None


def test_parse_skips_bad_chunk(spark):
    text = "plain words </rss>" + RSS.format(t="A", i="1")
    docs = feeds.parse_feeds(_chunks(spark, text))
    assert feeds.feed_items(docs).count() == 1
    assert [r.valid for r in docs.orderBy("chunk_idx").collect()] == [False, True]


def test_lint(spark):
    text = RSS.format(t="A", i="1") + "plain words </rss>\n  \n"
    docs = feeds.parse_feeds(_chunks(spark, text))
    r = lint.lint(docs).first()
    assert (r.total, r.valid, r.invalid, r.ok) == (2, 1, 1, False)
    report = [x.line for x in lint.lint_report(docs).orderBy("source", "n").collect()]
    assert report[0] == "feeds: total=2 valid=1 invalid=1"
    assert report[1].startswith("- feed 2: ")
    merged = lint.merge_lint(lint.lint(docs), lint.lint(docs)).first()
    assert (merged.total, merged.invalid) == (4, 2)


def test_strict_printable(spark):
    text = "<rss><channel><title>a\tb</title></channel></rss>"
    strict = _chunks(spark, text, strict_printable=True).first().chunk
    assert "\t" not in strict and "ab" in strict
    assert "\t" in _chunks(spark, text).first().chunk


def test_read_feed_files(spark, tmp_path):
    (tmp_path / "a.xml").write_text(RSS.format(t="A", i="1") + RSS.format(t="A2", i="2"))
    (tmp_path / "b.xml").write_text(ATOM.format(t="B", i="3"))
    items = feeds.read_feeds(spark, str(tmp_path)).orderBy("pos").collect()
    assert [r.title for r in items] == ["1", "2", "3"]


def test_jsonl_read(spark, tmp_path):
    p = tmp_path / "items.jsonl"
    p.write_text('{"schema_version":"feedloom.feed_item.v1","url":"https://pier.test/log?utm_source=mail","title":"Log"}\n'
                 "\n"
                 '{"url":"https://pier.test/crew","title":"Crew","published_at":"2025-11-02T07:30:00Z"}\n')
    rows = jsonl.read_items_jsonl(spark, str(p)).orderBy("pos").collect()
    assert [(r.title, r.normalized_url, r.id) for r in rows] == [
        ("Log", "https://pier.test/log", "https://pier.test/log"), ("Crew", "https://pier.test/crew", "https://pier.test/crew")]
    assert rows[1].published_at is not None


def test_jsonl_unknown_version_fails(spark, tmp_path):
    p = tmp_path / "bad.jsonl"
    p.write_text('{"schema_version":"another.item.v7","url":"https://pier.test/1"}\n')
    with pytest.raises(Exception, match="unsupported schema_version"):
        jsonl.read_items_jsonl(spark, str(p)).collect()


def test_jsonl_broken_line_fails(spark, tmp_path):
    p = tmp_path / "broken.jsonl"
    p.write_text('{"url":"https://pier.test/1"}\n["no item"\n')
    with pytest.raises(Exception, match="invalid record"):
        jsonl.read_items_jsonl(spark, str(p)).collect()


def test_comments_from_bodies(spark):
    from feedloom.sources.snapshots import comments_from_bodies
    raw = spark.createDataFrame([("u1", '{"bookmarks":[{"user":"a","comment":"c","timestamp":"2026/05/20 12:00","tags":["t"]}]}'),
                                 ("u2", ""), ("u3", None)], "url string, body string")
    rows = comments_from_bodies(raw).collect()
    assert [(r.url, r.user, r.tags) for r in rows] == [("u1", "a", ["t"])]


def test_lint_feed_bodies(spark):
    bodies = spark.createDataFrame([("https://f/a", RSS.format(t="A", i="1")), ("https://f/b", "plain words </rss>"),
                                    ("https://f/c", None), ("https://f/d", "<html><body>x</body></html>")],
                                   "feed_url string, body string")
    res = lint.lint_feed_bodies(bodies)
    lines = [r.line for r in lint.lint_feed_report(res).orderBy("k1", "k2").collect()]
    assert lines == ["feeds: total=4 valid=1 invalid=3", "- https://f/b: XML syntax error",
                     "- https://f/c: fetch failed: empty feed", "- https://f/d: Failed to detect feed type"]


def test_jsonl_errors_line_numbers(spark, tmp_path):
    lines = ['{"url":"a"}'] * 3 + [""] + ["{broken"] + ['{"url":"b"}'] * 2000 + ['{"schema_version":"x.v9","url":"c"}']
    p = tmp_path / "big.jsonl"
    p.write_text("\n".join(lines) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")   # force several blocks
    try:
        got = sorted((r.line, r.error) for r in jsonl.jsonl_errors(spark, str(p)).collect())
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == [(5, "jsonl line 5: invalid JSON record"),
                   (2006, 'jsonl line 2006: unsupported schema_version "x.v9"')]
