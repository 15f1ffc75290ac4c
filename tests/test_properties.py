"""Randomized properties (the reference's fuzz targets, as Spark checks)."""

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from feedloom.functions.urls import with_key
from feedloom.operators import dedup
from feedloom.sources import feeds

PIECES = st.sampled_from(["<rss>", "</rss>", "<feed>", "</feed>", "x", "\n", " ", "<", ">", "é", "</rs", "s>"])
URLS = st.builds(lambda h, p, q: f"https://{h}.example.com/{p}{q}",
                 st.sampled_from(["a", "m.a", "B", "www.c"]), st.sampled_from(["", "x", "x/", "x/amp"]),
                 st.sampled_from(["", "?utm_source=1", "?b=2&a=1", "#f"]))


@settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(PIECES, max_size=40))
def test_split_keeps_text_and_never_fails(spark, parts):
    text = "".join(parts)
    df = spark.createDataFrame([(text,)], "value string")
    chunks = [r.chunk for r in feeds.chunk_text(df).orderBy("chunk_idx").collect()]
    assert "".join(chunks) == text
    assert all(c.endswith(("</rss>", "</feed>")) for c in chunks[:-1])
    feeds.parse_feeds(feeds.chunk_text(df)).count()


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(URLS, min_size=1, max_size=12), st.lists(URLS, max_size=12))
def test_diff_never_returns_a_shared_key(make_items, left, right):
    lf = make_items(*[dict(url=u) for u in left])
    rt = make_items(*[dict(url=u) for u in right])
    out = dedup.diff_items(lf, rt)
    rkeys = {r._key for r in with_key(rt, "_key").collect()}
    got = [r._key for r in with_key(out, "_key").collect()]
    assert not (set(got) & rkeys)
    merged = dedup.merge_items(lf)
    keys = [r._key for r in with_key(merged, "_key").collect()]
    assert len(keys) == len(set(keys))
