import json
import uuid

from pyspark.sql import functions as F

from feedloom import session
from feedloom.operators import enrich
from feedloom.operators.explain import explain_items
from feedloom.plans import stages as S
from feedloom.schema import EXPLAIN_JSONL_VERSION, ITEM_SCHEMA
from feedloom.sinks import jsonl, tables
from feedloom.sources.feeds import feed_bodies_items


def _dir(spark, name):
    return f"{session.checkpoint_dir(spark).rstrip('/')}/test-{name}-{uuid.uuid4().hex}"


def test_state_store_versions(spark):
    path = _dir(spark, "state")
    store = tables.StateStore(spark, path)
    assert store.load().count() == 0
    s1 = spark.createDataFrame([("k", "2026-05-20T12:00:00Z", "T")], "entry_key string, last_comment_timestamp string, thread_id string")
    assert store.save(s1) == 1
    loaded = store.load()
    assert store.save(loaded.withColumn("thread_id", F.lit("T2"))) == 2   # reading v1 while writing v2
    assert [r.thread_id for r in store.load().collect()] == ["T2"]
    assert tables.versions(spark, path) == [1, 2]


def test_outbox_append_is_idempotent(spark):
    path = _dir(spark, "outbox")
    ob = spark.createDataFrame([("m1", "a"), ("m2", "b")], "message_id string, text string")
    tables.append_outbox(ob, path)
    tables.append_outbox(ob.union(spark.createDataFrame([("m3", "c")], ob.schema)), path)
    assert sorted(r.message_id for r in spark.read.parquet(path).collect()) == ["m1", "m2", "m3"]


def test_archive_write_and_read(spark, make_items):
    path = _dir(spark, "archive")
    assert tables.read_archive(spark, path, ITEM_SCHEMA).count() == 0
    items = make_items(dict(url="https://a/1"), dict(url="https://a/2")).withColumn(
        "feed_link", F.lit("https://feeds.example.com/rss"))
    assert tables.write_archive(items, path) == 1
    back = spark.read.parquet(f"{path}/v=1")
    assert [r.feed_key for r in back.select("feed_key").distinct().collect()] == ["feeds.example.com/rss"]


def test_explain_jsonl_records(make_items):
    df = make_items(dict(url="https://example.com/go", title="go"), dict(url="https://example.com/x", title="x"))
    ex = explain_items(df, [S.KeywordStage(["go"])])
    recs = [json.loads(r.line) for r in jsonl.explain_records(ex).orderBy("pos").collect()]
    assert recs[0]["schema_version"] == EXPLAIN_JSONL_VERSION and recs[0]["output"] == "rss"
    assert recs[0]["kept"] is True and recs[0]["item"]["metadata"] == {"keyword_score": "1"}
    assert recs[1]["kept"] is False and recs[1]["stages"][0]["reasons"] == ["keyword_filter: dropped by no include match"]
    assert "metadata" not in recs[1]["item"]


def test_feed_bodies(spark):
    rss = '<rss><channel><title>F</title><item><title>t</title><link>https://a/1</link></item></channel></rss>'
    bodies = spark.createDataFrame([("https://f/2", rss), ("https://f/1", None)], "feed_url string, body string")
    rows = feed_bodies_items(bodies).collect()
    assert [(r.title, r.source) for r in rows] == [("t", "F")]


def test_summarizer_plugin(make_items):
    df = make_items(dict(title="a"), dict(title="boom"))

    def summarizer(d):
        return F.when(F.col("title") == "boom", F.struct(F.lit(None).cast("string").alias("summary"),
                                                       F.lit(None).cast("string").alias("reason"),
                                                       F.lit("model failed").alias("error"))) \
            .otherwise(F.struct(F.upper("title").alias("summary"), F.lit("custom").alias("reason"),
                                F.lit(None).cast("string").alias("error")))
    out = enrich.summarize_with(df, summarizer).orderBy("pos").collect()
    assert (out[0].summary, out[0].reading_reason, out[0].summary_error) == ("A", "custom", None)
    assert (out[1].summary, out[1].summary_error) == ("", "model failed")


def test_feed_bodies_strict(spark):
    import pytest
    bodies = spark.createDataFrame([("https://f/1", None)], "feed_url string, body string")
    with pytest.raises(Exception, match="feed fetch failed"):
        feed_bodies_items(bodies, strict=True).collect()


def test_a_broken_version_does_not_stop_later_saves(spark, tmp_path):
    from feedloom.sinks import tables
    path = str(tmp_path / "state")
    df = spark.createDataFrame([("k", "t", "T1")], "entry_key string, last_comment_timestamp string, thread_id string")
    assert tables.write_next(df, path) == 1
    (tmp_path / "state" / "v=2").mkdir()
    (tmp_path / "state" / "v=2" / "part-0").write_text("left behind")
    assert tables.write_next(df, path) == 3
    assert tables.versions(spark, path) == [1, 3]
    assert tables.read_latest(spark, path, df.schema).count() == 1


def test_outbox_keeps_one_of_equal_messages(spark, tmp_path):
    from feedloom.sinks import tables
    path = str(tmp_path / "outbox")
    rows = spark.createDataFrame([("m1", "a"), ("m1", "a"), ("m2", "b")], "message_id string, text string")
    tables.append_outbox(rows, path)
    tables.append_outbox(rows, path)
    assert sorted(r.message_id for r in spark.read.parquet(path).collect()) == ["m1", "m2"]


def test_archive_of_one_feed_is_newest_first(spark, make_items, tmp_path):
    import datetime as dt

    from pyspark.sql import functions as F

    from feedloom.sinks import tables
    df = make_items(*[dict(url=f"https://pier.test/{i}", published_at=None if i == 3 else dt.datetime(2025, 1, 1 + i * 5 % 9))
                      for i in range(8)]).withColumn("feed_link", F.lit("https://pier.test/feed"))
    path = str(tmp_path / "archive")
    tables.write_archive(df.unionByName(df.withColumn("feed_link", F.lit("https://other.test/feed"))), path)
    got = tables.read_archive(spark, path, df.withColumn("feed_key", F.lit("")).schema, "pier.test/feed").collect()
    times = [r.published_at for r in got]
    assert len(got) == 8 and times[-1] is None and times[:-1] == sorted(times[:-1], reverse=True)


def test_unions_of_unions_do_not_collide(make_items):
    from feedloom.operators.dedup import merge_items
    from feedloom.operators.items import union_ordered
    one = lambda t, u="https://pier.test/a": make_items(dict(title=t, url=u))
    three = union_ordered(union_ordered(one("first"), one("second")), one("third"))
    assert [r.title for r in three.orderBy("pos").collect()] == ["first", "second", "third"]
    assert three.select("pos").distinct().count() == 3
    assert [r.title for r in merge_items(three).collect()] == ["first"]


def test_many_files_are_read_in_order_of_name(spark, tmp_path):
    from feedloom.operators.dedup import merge_items
    from feedloom.sources.jsonl import read_items_jsonl
    (tmp_path / "a.jsonl").write_text('{"url":"https://pier.test/a","title":"small"}\n')
    (tmp_path / "b.jsonl").write_text("".join(
        f'{{"url":"https://pier.test/{"a" if i == 900 else i}","title":"large {i}"}}\n' for i in range(2000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8192")
    try:
        items = read_items_jsonl(spark, str(tmp_path))
        titles = [r.title for r in items.orderBy("pos").collect()]
        won = {r.url: r.title for r in merge_items(items).collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert titles == ["small"] + [f"large {i}" for i in range(2000)]
    assert won["https://pier.test/a"] == "small"
