import uuid



from feedloom import session
from feedloom.operators import delta
from feedloom.schema import STATE_SCHEMA
from feedloom.streaming import jobs

URL = "https://example.com/s"


def _dir(spark, name):
    return f"{session.checkpoint_dir(spark).rstrip('/')}/test-{name}-{uuid.uuid4().hex}"


def test_comment_delta_stream_two_batches(spark, make_items, make_comments):
    items = make_items(dict(url=URL))
    state = spark.createDataFrame([(URL, "2026-05-20T12:00:00Z", "T")], STATE_SCHEMA)
    entries = delta._entries(items, state)
    lookup = items.select("url", delta.entry_key("url").alias("entry_key")).distinct().join(
        entries.select("entry_key", "last_time", "thread_id"), "entry_key")
    src, out, ck = _dir(spark, "src"), _dir(spark, "out"), _dir(spark, "ck")
    first = make_comments(dict(url=URL, user="a", comment="1", timestamp="2026/05/20 11:59"),
                          dict(url=URL, user="b", comment="2", timestamp="2026/05/20 12:02"))
    second = make_comments(dict(url=URL, user="c", comment="3", timestamp="2026/05/20 12:01", ord=5),
                           dict(url=URL, user="d", comment="4", timestamp="2026/05/20 12:04", ord=6))
    first.write.parquet(f"{src}/b=0")
    q = jobs.comment_delta_stream(jobs.read_comments_stream(spark, f"{src}/*"), lookup)
    jobs.run_available_now(q, ck, fmt="parquet", path=out)
    second.write.parquet(f"{src}/b=1")
    q = jobs.comment_delta_stream(jobs.read_comments_stream(spark, f"{src}/*"), lookup)
    jobs.run_available_now(q, ck, fmt="parquet", path=out)
    got = sorted(r.user for r in spark.read.parquet(out).collect())
    # 12:01 arrived after 12:02 was sent: never sent (late-data rule)
    assert got == ["b", "d"]
    assert all(r.thread_id == "T" for r in spark.read.parquet(out).collect())



def test_delta_batches_replay_is_idempotent(spark, make_items, make_comments):
    from feedloom.sinks.tables import StateStore
    items = make_items(dict(url=URL, title="t"))
    state_path, outbox_path = _dir(spark, "state"), _dir(spark, "outbox")
    run = jobs.comment_delta_batches(items, state_path, outbox_path)
    b0 = make_comments(dict(url=URL, user="a", comment="1", timestamp="2026/05/20 12:00"))
    b1 = make_comments(dict(url=URL, user="b", comment="2", timestamp="2026/05/20 12:05"))
    run(b0, 0)
    run(b1, 1)
    run(b1, 1)          # retried batch
    out = spark.read.parquet(outbox_path)
    assert sorted((r.kind, r.user) for r in out.collect()) == [("comment", "a"), ("comment", "b"), ("parent", None)]
    assert StateStore(spark, state_path).load().first().last_comment_timestamp == "2026-05-20T12:05:00Z"


def test_positions_of_streamed_files_stay_in_their_field(spark):
    from pyspark.sql import functions as F

    from feedloom.operators.items import SOURCE_STEP, stream_order_value
    late = 4_102_444_800_000  # the year 2100
    rows = [(1_700_000_000_000 * (1 << 21), 0), (1_700_000_000_000 * (1 << 21), 128 << 20), (1_700_000_000_000 * (1 << 21) + 1, 0),
            (1_700_000_000_001 * (1 << 21), 0), (late * (1 << 21) + (1 << 21) - 1, 1 << 39)]
    got = [int(r.p) for r in spark.createDataFrame(rows, "rank long, place long").select(
        stream_order_value(F.col("rank"), F.col("place")).alias("p")).collect()]
    assert got == sorted(set(got)) and got[-1] < SOURCE_STEP
    assert got[1] - got[0] == 128 << 20  # room for every line of the block before
