import datetime as dt
import json

from helpers import NOW

from feedloom.schema import ITEM_JSONL_VERSION
from feedloom.sinks import digest, document, feeds, jsonl, messages
from feedloom.sources import feeds as src_feeds
from feedloom.sources import jsonl as src_jsonl


def _items(make_items):
    return make_items(dict(url="https://example.com/entry-one", title="entry <one> & co", description="desc",
                           id="item-id", published_at=NOW - dt.timedelta(hours=1), bookmark_count="12"),
                      dict(url="https://example.com/two", title="two", description=""))


def test_rss_document_parses_back(spark, make_items, make_comments, tmp_path):
    items = _items(make_items)
    c = make_comments(dict(url="https://example.com/entry-one", user="alice", comment="useful", timestamp="2026/05/20 12:00"),
                      dict(url="https://example.com/entry-one", user="bob", timestamp="2026/05/20 12:01"))
    doc = feeds.rss_lines(items, c, NOW)
    text = document.collect_document(doc)
    for want in ("Hatena Bookmark:", "12", "alice", "useful", "Comments:"):
        assert want in text
    assert "bob" not in text  # comments with empty text are not listed
    (tmp_path / "out.xml").write_text(text)
    back = src_feeds.read_feeds(spark, str(tmp_path)).orderBy("pos").collect()
    assert [(r.title, r.url) for r in back] == [("entry <one> & co", "https://example.com/entry-one"),
                                                ("two", "https://example.com/two")]
    assert back[0].id == "item-id" and back[1].published_at == NOW


def test_atom_document_parses_back(spark, make_items, tmp_path):
    text = document.collect_document(feeds.atom_lines(_items(make_items), None, NOW))
    assert "<feed" in text
    (tmp_path / "out.xml").write_text(text)
    back = src_feeds.read_feeds(spark, str(tmp_path)).orderBy("pos").collect()
    assert [r.url for r in back] == ["https://example.com/entry-one", "https://example.com/two"]


def test_written_document_concatenates(spark, make_items, tmp_path):
    out = str(tmp_path / "rss")
    document.write_document(feeds.rss_lines(_items(make_items), None, NOW), out)
    assert src_feeds.read_feeds(spark, out).count() == 2


def test_jsonl_roundtrip_and_omits_empty(spark, make_items, tmp_path):
    items = _items(make_items)
    lines = [r.line for r in jsonl.jsonl_records(items).orderBy("pos").collect()]
    rec = json.loads(lines[1])
    assert rec["schema_version"] == ITEM_JSONL_VERSION
    assert rec["id"] == "https://example.com/two" and "description" not in rec and "categories" not in rec
    out = str(tmp_path / "j")
    jsonl.write_jsonl(items, out)
    back = src_jsonl.read_items_jsonl(spark, out).orderBy("pos").collect()
    assert [(r.title, r.bookmark_count) for r in back] == [("entry <one> & co", "12"), ("two", "")]


def test_json_array(spark, make_items):
    text = document.collect_document(jsonl.json_array_lines(_items(make_items)))
    arr = json.loads(text)
    assert [a["title"] for a in arr] == ["entry <one> & co", "two"] and "schema_version" not in arr[0]


def test_digest_window(spark, make_items):
    items = make_items(dict(title="old", url="https://example.com/old", description="old desc",
                            published_at=NOW - dt.timedelta(hours=48)),
                       dict(title="new [x]", url="https://example.com/new", description="new &amp;  desc",
                            published_at=NOW - dt.timedelta(hours=1)))
    text = document.collect_document(digest.digest_lines(items, NOW, "test digest", "24h"))
    assert text.startswith("# test digest\n\nWindow: 2026-05-22T12:00:00Z - 2026-05-23T12:00:00Z\n\nItems: 1\n")
    assert "- [new \\[x\\]](https://example.com/new) - 2026-05-23T11:00:00Z" in text
    assert "  new & desc" in text and "https://example.com/old" not in text


def test_messages_and_dry_run(spark, make_items):
    items = _items(make_items).withColumn("comment_count", __import__("pyspark.sql.functions", fromlist=["lit"]).lit(3))
    m = messages.notification_messages(items).orderBy("pos").collect()
    assert m[0].text == "<https://example.com/entry-one|entry <one> & co>"
    assert m[0].attachment == "desc\n\nHatena Bookmark: *12*\nHatena Comments: 3\n"
    text = document.collect_document(messages.dry_run_lines(items, "C1"))
    assert text.splitlines() == ["slack dry-run: channel=C1 posts=2",
                                 '1. message title="entry <one> & co" url="https://example.com/entry-one"',
                                 "   hatena_bookmark_count=12 comments=3",
                                 '2. message title="two" url="https://example.com/two"']


def test_delta_dry_run_lines(spark, make_items, make_comments):
    from feedloom.operators import delta
    from feedloom.schema import STATE_SCHEMA
    items = make_items(dict(url="https://e.com/a", title='say "hi"'), dict(url="https://e.com/b", title="b"))
    state = spark.createDataFrame([("https://e.com/a", "2026-05-20T12:00:00Z", "T")], STATE_SCHEMA)
    c = make_comments(dict(url="https://e.com/a", timestamp="2026/05/20 12:00"),
                      dict(url="https://e.com/a", timestamp="2026/05/20 12:01"))
    plan = delta.comment_delta(items, c, state).plan
    text = document.collect_document(messages.delta_dry_run_lines(plan))
    assert text.splitlines() == [
        'hatena dry-run: title="say \\"hi\\"" url="https://e.com/a" parent_post=false new_comments=1',
        'hatena dry-run: title="b" url="https://e.com/b" parent_post=true new_comments=0',
        "hatena dry-run summary: channel=(unset) parent_posts=1 comment_posts=1"]
