from feedloom.operators import dedup


def test_merge_keeps_first(make_items):
    df = make_items(dict(url="https://pier.test/log?utm_source=mail"), dict(url="https://pier.test/log"))
    out = dedup.merge_items(df).collect()
    assert [r.url for r in out] == ["https://pier.test/log?utm_source=mail"]


def test_merge_counts(make_items):
    df = make_items(dict(url="https://a"), dict(url="https://b"), dict(url="https://b"))
    assert dedup.merge_items(df).count() == 2


def test_merge_empty(spark, make_items):
    assert dedup.merge_items(make_items(dict(url="x")).limit(0)).count() == 0


def test_merge_empty_keys_collapse_unless_kept(make_items):
    df = make_items(dict(url="", title="a"), dict(url="", title="b"))
    assert dedup.merge_items(df).count() == 1
    assert dedup.merge_items(df, keep_empty_keys=True).count() == 2


def test_merge_keys_unique_and_idempotent(make_items):
    import random
    rnd = random.Random(7)
    urls = [f"https://{rnd.choice(['m.', 'M.', ''])}ex{rnd.randint(0, 5)}.com/p{rnd.randint(0, 3)}"
            f"{rnd.choice(['', '/', '?utm_source=z', '#f'])}" for _ in range(60)]
    df = make_items(*[dict(url=u) for u in urls])
    once = dedup.merge_items(df)
    keys = [r.k for r in once.selectExpr("normalized_url as k").collect()]
    from feedloom.operators.items import key_col
    ks = [r[0] for r in once.select(key_col(once)).collect()]
    assert len(ks) == len(set(ks))
    assert dedup.merge_items(once).count() == once.count()
    del keys


def test_diff(make_items):
    left = make_items(dict(url="http://h.test/left"), dict(url="http://h.test/both"))
    right = make_items(dict(url="http://h.test/both"))
    assert [r.url for r in dedup.diff_items(left, right).collect()] == ["http://h.test/left"]


def test_diff_tracking_variant(make_items):
    left = make_items(dict(url="https://pier.test/log?utm_campaign=may"))
    right = make_items(dict(url="https://pier.test/log"))
    assert dedup.diff_items(left, right).count() == 0


def test_diff_self_is_empty_and_keeps_empty_keys(make_items):
    df = make_items(dict(url="https://a/1"), dict(url=""), dict(url="https://a/1"))
    out = dedup.diff_items(df, df).collect()
    assert [r.url for r in out] == [""]


def test_archive_upsert(make_items):
    new = make_items(dict(url="https://e.com/new"))
    archived = make_items(dict(url="https://e.com/old"), dict(url="https://e.com/new?utm_source=x"),
                          dict(url="https://e.com/old"))
    out = dedup.archive_upsert(new, archived).orderBy("pos").collect()
    assert [r.url for r in out] == ["https://e.com/new", "https://e.com/old"]


def test_merge_hot_key_is_combined_before_shuffle(spark, make_items):
    """One key holds a third of the rows: the plan reduces it map-side and
    the first occurrence still wins."""
    rows = [dict(url="https://hot.example.com/x?utm_source=" + str(i)) for i in range(100)]
    rows += [dict(url=f"https://e.com/{i}") for i in range(200)]
    df = make_items(*rows).repartition(8)
    out = dedup.merge_items(df)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "partial_min_by" in plan
    assert plan.index("partial_min_by") > plan.index("Exchange hashpartitioning")  # partial below the exchange
    got = {r.url for r in out.collect()}
    assert len(got) == 201 and "https://hot.example.com/x?utm_source=0" in got
