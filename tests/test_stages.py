import pytest

from feedloom.plans import stages as S


def test_build_stages_aliases():
    st = S.build_stages({"stages": [
        {"type": "normalize"}, {"type": "hatena-bookmark"}, {"type": "keyword", "include": ["go"]},
        {"type": "since", "since": "24h"}, {"name": "hotness"}, {"type": "min-hotness", "min": 2},
        {"type": "fav-user", "users": ["a"]}, {"type": "rank", "by": "hotness"}, {"type": "tags"},
        {"type": "readability"}, {"type": "local-llm-summary"}, {"type": "ogp"}, {"type": "source"},
        {"type": "command", "name": "my", "command": "cat", "timeout": "2s"}]})
    assert [s.name for s in st] == ["normalize", "hatena_bookmark", "keyword_filter", "time_window_filter",
                                    "hotness_score", "min_hotness", "fav_user", "rank", "tag", "content",
                                    "summary", "ogp", "source_label", "my"]


def test_build_stages_errors():
    with pytest.raises(ValueError, match="unsupported pipeline stage"):
        S.build_stages({"stages": [{"type": "nope"}]})
    with pytest.raises(ValueError, match="requires since"):
        S.build_stages({"stages": [{"type": "time_window"}]})
    with pytest.raises(ValueError, match="invalid timeout"):
        S.build_stages({"stages": [{"type": "plugin", "command": "x", "timeout": "soon"}]})
    with pytest.raises(ValueError, match="cannot read the stage list"):
        S.build_stages("{not json")


def test_filter_rank_order():
    st = S.filter_rank_stages(include=["a"], include_domain=["x"], since="1h", rank_by="published",
                              min_hotness=1.0, fav_users=["u"])
    assert [s.name for s in st] == ["keyword_filter", "domain_filter", "time_window_filter", "hotness_score",
                                    "min_hotness", "fav_user", "rank"]
    assert [s.name for s in S.filter_rank_stages(rank_by="hotness")] == ["hotness_score", "rank"]
    assert S.filter_rank_stages() == []


def test_enrich_stages():
    assert [s.name for s in S.enrich_stages(["source-label", "tags", "local_summary"])] == ["source_label", "tag", "summary"]
    with pytest.raises(ValueError, match="unsupported enrich"):
        S.enrich_stages(["magic"])


def test_function_stage_and_run(make_items):
    df = make_items(dict(url="https://a/1"), dict(url="https://a/1"))
    out = S.run_stages(df, [S.NormalizeStage(), S.MergeStage(), S.FunctionStage("noop", lambda d: d)])
    assert out.count() == 1


def test_stages_use_item_comment_arrays(spark, tmp_path):
    from feedloom.sources.jsonl import read_items_jsonl
    p = tmp_path / "i.jsonl"
    p.write_text('{"url":"https://a/1","title":"x","categories":["go"],"hatena_bookmark_comments":'
                 '[{"user":"Alice","comment":"c","timestamp":"2026/05/20 12:00","tags":["rss","go"]}]}\n'
                 '{"url":"https://a/2","title":"y"}\n')
    items = read_items_jsonl(spark, str(p))
    out = S.run_stages(items, [S.TagStage(), S.FavUserStage(["alice"])], S.Context())
    rows = out.collect()
    assert [(r.url, r.categories, r.fav_users) for r in rows] == [("https://a/1", ["go", "rss"], "Alice")]


def test_tagged_run_can_be_cancelled(spark, make_items):
    import threading
    import time

    import pytest
    from pyspark.sql import functions as F

    slow = spark.range(0, 64, 1, 8).withColumn("x", F.udf(lambda v: (time.sleep(0.5), v)[1], "long")("id"))
    errors = []

    def run():
        try:
            with S.tagged_run(spark, "chain-1"):
                slow.write.format("noop").mode("overwrite").save()
        except Exception as e:  # noqa: BLE001
            errors.append(e)
    t = threading.Thread(target=run)
    t.start()
    time.sleep(2.0)
    S.cancel_run(spark, "chain-1")
    t.join(60)
    assert errors, "the tagged job should have been interrupted"
    with pytest.raises(Exception):
        raise errors[0]
    assert "chain-1" not in spark.sparkContext.getJobTags()


def test_chain_stages_order():
    st = S.chain_stages({"stages": [{"type": "normalize"}, {"type": "merge"}]}, ["summary"],
                        include=["go"], rank_by="hotness")
    assert [s.name for s in st] == ["normalize", "merge", "summary", "keyword_filter", "hotness_score", "rank"]


def test_time_window_runs_before_expensive_filters(spark, make_items, tmp_path):
    import datetime as dt

    from helpers import NOW
    from feedloom.operators.explain import explain_items
    df = make_items(dict(title="tide new", url="https://pier.test/1", published_at=NOW - dt.timedelta(hours=1)),
                    dict(title="tide old", url="https://pier.test/2", published_at=NOW - dt.timedelta(hours=48)))
    path = str(tmp_path / "items")
    df.write.parquet(path)
    stored = spark.read.parquet(path)
    chain = S.filter_rank_stages(include=["tide"], include_domain=["pier.test"], since="24h", now=NOW)
    out = S.run_stages(stored, chain, S.Context(now=NOW))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(published_at" in plan
    assert [r.title for r in out.collect()] == ["tide new"]
    first = explain_items(stored, chain, S.Context(now=NOW)).orderBy("pos").first()
    assert [s.stage for s in first.stages] == ["keyword_filter", "domain_filter", "time_window_filter"]


def test_whole_configs(spark, make_items, tmp_path):
    from feedloom.sinks.jsonl import write_jsonl
    with pytest.raises(ValueError, match="no reader"):
        S.read_config({"input": {"format": "csv"}})
    with pytest.raises(ValueError, match="digest_window"):
        S.read_config({"output": {"type": "digest", "digest_window": "soon"}})
    path = str(tmp_path / "in")
    write_jsonl(make_items(dict(title="tide", url="https://pier.test/1"), dict(title="paid", url="https://pier.test/2")), path)
    config = {"input": {"format": " JSONL ", "urls": [path]}, "stages": [{"type": "keyword", "exclude": ["paid"]}]}
    for kind, want in (("rss", "<title>tide</title>"), ("atom", "<title>tide</title>"), ("json", '"title":"tide"'),
                       ("jsonl", '"title":"tide"'), ("explain", "exclude=paid")):
        lines = [r.line for r in S.run_config(spark, {**config, "output": {"type": kind}}).collect()]
        assert any(want in x for x in lines), kind
    plan = S.run_config(spark, {**config, "output": {"type": "slack", "slack_dry_run": True, "slack_channel": "#c"}})
    assert any("#c" in r.line for r in plan.collect())
    with pytest.raises(ValueError, match="no writer"):
        S.run_config(spark, {**config, "output": {"type": "fax"}})
