import os
import sys

import pytest

HERE = os.path.dirname(os.path.abspath(__file__))
sys.path[:0] = [HERE, os.path.dirname(HERE)]

from feedloom.schema import COMMENTS_SCHEMA, ITEM_SCHEMA  # noqa: E402
from feedloom.session import build_session  # noqa: E402

@pytest.fixture(scope="session")
def spark():
    s = build_session("local[*]", shuffle_partitions=8, spark__driver__memory="8g")
    yield s
    s.stop()


def item(pos, url="", **kw):
    row = dict(pos=pos, id="", url=url, normalized_url="", title="", description="", content="",
               published_at=None, updated_at=None, published_raw="", updated_raw="", author="",
               source="", categories=[], summary="", reading_reason="", bookmark_count="")
    row.update(kw)
    return row


@pytest.fixture
def make_items(spark):
    def mk(*rows):
        return spark.createDataFrame([item(i, **r) if "pos" not in r else item(**r)
                                      for i, r in enumerate(rows)], ITEM_SCHEMA)
    return mk


@pytest.fixture
def make_comments(spark):
    def mk(*rows):
        full = [dict(url=r["url"], ord=r.get("ord", i), user=r.get("user", ""), comment=r.get("comment", ""),
                     timestamp=r.get("timestamp", ""), tags=r.get("tags", [])) for i, r in enumerate(rows)]
        return spark.createDataFrame(full, COMMENTS_SCHEMA)
    return mk
