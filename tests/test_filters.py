import datetime as dt

from helpers import NOW

from feedloom.operators import enrich, filters, rank


def test_keyword_filter(make_items):
    df = make_items(dict(title="Lake tables and columnar files"), dict(title="Columnar news", description="paid lake tour"),
                    dict(title="Tables only"), dict(title="Nothing here"))
    out = filters.keyword_filter(df, ["columnar", "lake", "tables"], ["paid"], 2).collect()
    assert [(r.title, r.keyword_score) for r in out] == [("Lake tables and columnar files", 3)]


def test_keyword_min_score_without_include_drops_all(make_items):
    df = make_items(dict(title="a"), dict(title="b"))
    assert filters.keyword_filter(df, [], [], 1).count() == 0


def test_keyword_blank_include_drops_all(make_items):
    df = make_items(dict(title="a"))
    assert filters.keyword_filter(df, ["  "], [], 0).count() == 0


def test_keyword_duplicate_pattern_counts_twice(make_items):
    df = make_items(dict(title="tide"))
    assert filters.keyword_filter(df, ["tide", "TIDE "], [], 0).first().keyword_score == 2


def test_domain_filter(make_items):
    df = make_items(dict(url="https://blog.harbor.test/7"), dict(url="https://harbor.test.invalid/7"), dict(url="https://harbor.test/8"))
    out = filters.domain_filter(df, ["harbor.test"], []).orderBy("pos").collect()
    assert [(r.url, r.domain) for r in out] == [("https://blog.harbor.test/7", "blog.harbor.test"),
                                                ("https://harbor.test/8", "harbor.test")]


def test_domain_filter_empty_domain(make_items):
    df = make_items(dict(url=""), dict(url="https://www.a.com/x"))
    assert filters.domain_filter(df, [], ["a.com"]).count() == 1          # empty domain kept, a.com excluded
    assert filters.domain_filter(df, ["a.com"], []).count() == 1          # empty domain dropped


def test_time_window(make_items):
    df = make_items(dict(title="new", published_at=NOW - dt.timedelta(hours=1)),
                    dict(title="old", published_at=NOW - dt.timedelta(hours=48)),
                    dict(title="none"),
                    dict(title="future", published_at=NOW + dt.timedelta(hours=3)))
    out = [r.title for r in filters.time_window(df, "24h", NOW).orderBy("pos").collect()]
    assert out == ["new", "future"]
    assert filters.time_window(df, 0, NOW).count() == 4


def test_hotness_fav_user_rank(spark, make_items, make_comments):
    df = make_items(dict(title="low", url="https://e/low", bookmark_count="1",
                         published_at=NOW - dt.timedelta(hours=24)),
                    dict(title="high", url="https://e/high", bookmark_count="14",
                         published_at=NOW - dt.timedelta(hours=3)))
    comments = make_comments(dict(url="https://e/low", user="ines"), dict(url="https://e/high", user="oto"),
                             dict(url="https://e/high", user="Oto"))
    enriched = enrich.bookmark_enrich(df, spark.createDataFrame([], "url string, count string"), comments)
    enriched = enriched.drop("bookmark_count").join(df.select("pos", "bookmark_count"), "pos")
    hot = rank.hotness_score(enriched, NOW)
    fav = filters.fav_user(hot, comments, [" OTO "])
    out = rank.rank(fav, "hotness").collect()
    assert [(r.title, r.fav_users) for r in out] == [("high", "oto")]
    scores = {r.title: r.hotness_score for r in hot.collect()}
    assert scores["low"] == round(1.5 + 2.0 + 10 * 24 / 48, 3)
    assert scores["high"] == round(21 + 4.0 + 10 * 24 / 27, 3)


def test_hotness_missing_time_uses_24h(make_items):
    df = make_items(dict(title="x"))
    assert rank.hotness_score(df, NOW).first().hotness_score == 5.0


def test_min_hotness(make_items):
    df = make_items(dict(title="a"), dict(title="b", bookmark_count="4"))
    h = rank.hotness_score(df, NOW)
    assert [r.title for r in filters.min_hotness(h, 6.0).collect()] == ["b"]
    assert filters.min_hotness(h, 0).count() == 2


def test_rank_published_stable_missing_last(make_items):
    t = NOW - dt.timedelta(hours=5)
    df = make_items(dict(title="none"), dict(title="a", published_at=t), dict(title="b", published_at=t),
                    dict(title="newest", published_at=NOW))
    assert [r.title for r in rank.rank(df, "published").collect()] == ["newest", "a", "b", "none"]
    assert [r.title for r in rank.rank(df, "TIME ").collect()] == ["newest", "a", "b", "none"]
    assert rank.rank(df, "none").count() == 4


def test_rank_unsupported(make_items):
    import pytest
    with pytest.raises(ValueError, match="unsupported rank"):
        rank.rank(make_items(dict(title="x")), "random")


def test_with_rank_matches_sort(spark, make_items):
    df = make_items(*[dict(title=str(i), bookmark_count=str(i % 7)) for i in range(40)])
    h = rank.hotness_score(df, NOW)
    ranked = rank.with_rank(h.repartition(5), rank.rank_order(h, "hotness"))
    got = [r.pos for r in ranked.orderBy("rank").collect()]
    want = [r.pos for r in rank.rank(h, "hotness").collect()]
    assert got == want
    assert sorted(r.rank for r in ranked.collect()) == list(range(1, 41))


def test_time_window_reaches_parquet_scan(spark, make_items, tmp_path):
    df = make_items(dict(title="new", published_at=NOW - dt.timedelta(hours=1)),
                    dict(title="old", published_at=NOW - dt.timedelta(hours=48)),
                    dict(title="raw", published_raw="2026-05-23T11:00:00Z"))
    path = str(tmp_path / "items")
    df.write.parquet(path)
    out = filters.time_window(spark.read.parquet(path), "24h", NOW)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [Or(IsNull(published_at),GreaterThanOrEqual(published_at" in plan
    assert sorted(r.title for r in out.collect()) == ["new", "raw"]


def test_time_window_prunes_date_partitions(spark, make_items, tmp_path):
    from feedloom.sinks.tables import write_items_table
    df = make_items(dict(title="new", published_at=NOW - dt.timedelta(hours=1)),
                    dict(title="old", published_at=NOW - dt.timedelta(days=9)),
                    dict(title="none"))
    path = str(tmp_path / "items")
    write_items_table(df, path)
    out = filters.time_window(spark.read.parquet(path), "24h", NOW)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "published_date" in plan.split("PartitionFilters: [")[1][:200]
    assert [r.title for r in out.collect()] == ["new"]


def test_fav_user_with_watch_table(spark, make_items, make_comments):
    from feedloom.operators.explain import explain_items
    from feedloom.plans import stages as S
    df = make_items(dict(url="https://e/1"), dict(url="https://e/2"))
    comments = make_comments(dict(url="https://e/1", user="Bob"), dict(url="https://e/2", user="carol"),
                             dict(url="https://e/1", user="bob"))
    watch = spark.createDataFrame([(" BOB ",), ("",)], "name string")
    out = filters.fav_user(df, comments, watch).collect()
    assert [(r.url, r.fav_users) for r in out] == [("https://e/1", "Bob")]
    ex = explain_items(df, [S.FavUserStage(watch)], S.Context(comments=comments)).orderBy("pos").collect()
    assert [r.reasons for r in ex] == [["fav_user: matched=Bob"], ["fav_user: dropped by no matching user"]]


def test_domain_filter_with_tables_matches_lists(spark, make_items):
    urls = ["https://blog.harbor.test/7", "https://harbor.test.invalid/7", "https://www.pier.test/x",
            "https://ads.pier.test/y", "", "https://m.notharbor.test/z"]
    df = make_items(*[dict(url=u) for u in urls])
    inc, exc = ["harbor.test", "WWW.pier.test"], ["ads.pier.test"]
    table = lambda xs: spark.createDataFrame([(x,) for x in xs], "d string")
    for i, e in [(inc, exc), ([], exc), (inc, [])]:
        want = sorted((r.pos, r.domain) for r in filters.domain_filter(df, i, e).collect())
        got = sorted((r.pos, r.domain) for r in filters.domain_filter(df, table(i), table(e)).collect())
        assert got == want


def test_keyword_long_lists_equal_python(spark, make_items):
    import random
    rnd = random.Random(5)
    words = [f"w{i}" for i in range(150)]
    rows = [dict(title=" ".join(rnd.sample(words, 5)), description=rnd.choice(["", "spam w7"])) for _ in range(40)]
    include, exclude = words[:100] + ["w3"], [f"x{i}" for i in range(70)] + ["spam"]   # w3 counts twice
    want = []
    for i, r in enumerate(rows):
        text = f"{r['title']} {r['description']}"
        score = sum(p in text for p in include)
        if score and not any(p in text for p in exclude):
            want.append((i, score))
    got = sorted((r.pos, r.keyword_score) for r in filters.keyword_filter(make_items(*rows), include, exclude).collect())
    assert got == want and got
