"""End-to-end runs through the public API (the reference's in-process runs)."""

import json

from feedloom.operators.explain import explain_items
from feedloom.plans import stages as S
from feedloom.sinks import document, feeds, jsonl
from feedloom.sources import feeds as src_feeds
from feedloom.sources import jsonl as src_jsonl

RSS = ('<rss version="2.0"><channel><title>T</title><item><title>{t}</title><link>{u}</link>'
       '<description>d</description></item></channel></rss>')


def test_jsonl_in_domain_filter_atom_out(spark, make_items, tmp_path):
    out = str(tmp_path / "in")
    jsonl.write_jsonl(make_items(dict(title="tide log", url="https://pier.test/log?utm_source=mail"),
                                 dict(title="elsewhere", url="https://far.test/x")), out)
    items = src_jsonl.read_items_jsonl(spark, out)
    kept = S.run_stages(items, S.filter_rank_stages(include_domain=["pier.test"]))
    text = document.collect_document(feeds.atom_lines(kept))
    assert "<title>tide log</title>" in text and "elsewhere" not in text


def test_rss_in_explain_jsonl_out(spark, tmp_path):
    (tmp_path / "in.xml").write_text(RSS.format(t="tide", u="https://pier.test/tide")
                                     + RSS.format(t="paid", u="https://pier.test/ads"))
    items = src_feeds.read_feeds(spark, str(tmp_path))
    ex = explain_items(items, S.filter_rank_stages(include=["tide"], exclude=["paid"]))
    recs = [json.loads(r.line) for r in jsonl.explain_records(ex).orderBy("pos").collect()]
    assert [r["kept"] for r in recs] == [True, False]
    assert "keyword_filter: dropped by exclude=paid" in recs[1]["reasons"]


def test_merge_feeds_from_two_inputs(spark, make_items, tmp_path):
    """stdin items first, then URL feeds (ordered union), then merge."""
    from feedloom.operators.dedup import merge_items
    from feedloom.operators.items import union_ordered
    (tmp_path / "f.xml").write_text(RSS.format(t="of the feed", u="https://pier.test/a"))
    first = make_items(dict(title="of the pipe", url="https://pier.test/a?utm_source=mail"))
    merged = merge_items(union_ordered(first, src_feeds.read_feeds(spark, str(tmp_path)))).collect()
    assert [r.title for r in merged] == ["of the pipe"]
