import __spark_entry__ as E


def test_entry_runs(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) > 0
    assert df.columns[:3] == ["pos", "url", "normalized_url"]
    scores = [r.hotness_score for r in rows]
    assert scores == sorted(scores, reverse=True)


def test_catalog_and_oracle_keys():
    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q)
    assert len(q) >= 30


def test_catalog_without_the_optional_parts(monkeypatch):
    """The other queries do not need the training-data operators."""
    monkeypatch.setattr(E, "_llm", None)
    monkeypatch.setattr(E, "_pipeline", None)
    q, o = E.queries(), E.oracle_sql()
    assert len(q) >= 30 and set(o) <= set(q)
    assert not any(name.startswith("op") or name == "pipeline" for name in q)
