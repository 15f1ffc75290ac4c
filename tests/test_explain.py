import datetime as dt

from helpers import NOW

from feedloom.operators.explain import explain_items
from feedloom.plans import stages as S


def test_explain_keyword_domain_time(make_items):
    df = make_items(dict(url="https://pier.test/tide", title="tide", published_at=NOW - dt.timedelta(hours=1)),
                    dict(url="https://pier.test/ads", title="tide paid", published_at=NOW - dt.timedelta(hours=1)))
    st = S.filter_rank_stages(include=["tide"], exclude=["paid"], include_domain=["pier.test"], since="24h", now=NOW)
    rows = explain_items(df, st, S.Context(now=NOW)).orderBy("pos").collect()
    assert [r.kept for r in rows] == [True, False]
    assert "keyword_filter: dropped by exclude=paid" in rows[1].reasons
    assert rows[0].reasons == ["keyword_filter: score=1", "domain_filter: domain=pier.test",
                               "time_window_filter: within 24h0m0s"]
    assert rows[0].item.domain == "pier.test" and rows[1].item.keyword_score is None


def test_explain_chain_with_plugin(make_items):
    df = make_items(dict(url="https://pier.test/tide", title="tide"), dict(url="https://pier.test/ads", title="paid"),
                    dict(url="https://pier.test/tide?utm_source=mail", title="tide again"))
    st = [S.NormalizeStage(), S.MergeStage(), S.KeywordStage(["tide"], ["paid"]),
          S.ExternalCommandStage("plugin", "cat", ["-u"], timeout="5s"), S.SourceLabelStage("src")]
    rows = explain_items(df, st, S.Context(now=NOW)).orderBy("pos").collect()
    assert [r.kept for r in rows] == [True, False, False]
    assert "merge: dropped duplicate key=https://pier.test/tide" in rows[2].reasons
    assert "plugin: dry-run command=cat args=-u timeout=5s" in rows[0].reasons
    assert rows[0].item.source == "src" and rows[1].item.source == ""


def test_explain_no_stages_and_unsupported_rank(make_items):
    df = make_items(dict(url="https://a"))
    assert explain_items(df, []).first().reasons == ["no filter/rank criteria"]
    r = explain_items(df, [S.RankStage("random")]).first()
    assert (r.kept, r.reasons) == (False, ["rank: unsupported rank random"])


def test_explain_empty_keys_are_indexed(make_items):
    df = make_items(dict(url="", title="a"), dict(url="", title="b"))
    rows = explain_items(df, [S.MergeStage()]).orderBy("pos").collect()
    assert [r.reasons for r in rows] == [["merge: kept key=__index_0"], ["merge: kept key=__index_1"]]


def test_explain_kept_set_equals_execution(make_items):
    df = make_items(*[dict(url=f"https://s{i % 3}.pier.test/{i % 7}", title=("tide " if i % 2 else "") + str(i),
                           published_at=NOW - dt.timedelta(hours=i)) for i in range(30)])
    st = [S.NormalizeStage(), S.MergeStage()] + S.filter_rank_stages(
        include=["tide"], exclude_domain=["s1.pier.test"], since="20h", rank_by="hotness", min_hotness=5.5, now=NOW)
    ctx = S.Context(now=NOW)
    kept = {r.pos for r in explain_items(df, st, ctx).filter("kept").select("pos").collect()}
    executed = {r.pos for r in S.run_stages(df, st, ctx).select("pos").collect()}
    assert kept == executed
