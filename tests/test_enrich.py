from feedloom.operators import enrich
from feedloom.schema import PAGES_SCHEMA


def test_source_label(make_items):
    df = make_items(dict(source="  "), dict(source=" feed "), dict(author="ann"))
    out = [(r.source, r.source_label) for r in enrich.source_label(df, "default").orderBy("pos").collect()]
    assert out == [("default", "default"), ("feed", "feed"), ("default", "default")]
    out = [(r.source, r.source_label) for r in enrich.source_label(df, "").orderBy("pos").collect()]
    assert out == [("", None), ("feed", "feed"), ("ann", "ann")]


def test_tag_merge(make_items, make_comments):
    df = make_items(dict(url="https://e/1", categories=["go"]))
    c = make_comments(dict(url="https://e/1", tags=["rss", " go "]), dict(url="https://e/1", tags=["", "rss", "Go"]))
    assert enrich.tag_enrich(df, c).first().categories == ["go", "rss", "Go"]


def test_ogp_fills_only_empty(spark, make_items):
    html = ('<html><head><title> Page T </title><meta property="og:title" content="OG T">'
            '<meta property="og:description" content="OG D"><meta property="og:image" content="i.png">'
            '<meta name="description" content="plain"><meta property="og:site_name" content="Site">'
            '<meta property="og:title" content="OG T2"></head><body></body></html>')
    pages = spark.createDataFrame([("https://e/1", 200, html), ("https://e/3", 404, "")], PAGES_SCHEMA)
    df = make_items(dict(url="https://e/1"), dict(url="https://e/1", title="keep", description="keep d"),
                    dict(url="https://e/2"), dict(url="https://e/3"), dict(url=""))
    out = enrich.ogp_enrich(df, pages).orderBy("pos").collect()
    assert (out[0].title, out[0].description, out[0].og_image, out[0].og_site_name) == ("OG T2", "OG D", "i.png", "Site")
    assert (out[0].page_title, out[0].meta_description) == ("Page T", "plain")
    assert (out[1].title, out[1].description) == ("keep", "keep d")
    assert out[2].ogp_error == "page not captured"
    assert out[3].ogp_error == "http status 404"
    assert out[4].ogp_error is None and out[4].title == ""


def test_readable_text(spark, make_items):
    html = ("<html><head><title>x</title><script>var a='<p>';</script></head><body>"
            "<nav>Menu Home</nav><header>Top</header><article><h1>Hello</h1><p>world  &amp;\n more</p>"
            "<script>track()</script></article><footer>foot</footer></body></html>")
    pages = spark.createDataFrame([("https://e/1", 200, html), ("https://e/2", 200, "<body><p>only body</p></body>")],
                                  PAGES_SCHEMA)
    df = make_items(dict(url="https://e/1", content="old"), dict(url="https://e/2"))
    out = enrich.content_enrich(df, pages).orderBy("pos").collect()
    assert out[0].content == "Helloworld & more"
    assert out[0].content_text == "Helloworld & more"
    assert out[1].content == "only body"


def test_summary(make_items):
    df = make_items(dict(description="a" * 200, bookmark_count="42"), dict(title="  t  ", source="src"),
                    dict(title="x", bookmark_count="0"))
    out = enrich.summarize(df).orderBy("pos").collect()
    assert len(out[0].summary) == 160 and out[0].summary.endswith("...")
    assert out[0].reading_reason == "Hatena Bookmark: 42"
    assert (out[1].summary, out[1].reading_reason) == ("t", "source: src")
    assert out[2].reading_reason == "source feed item"


def test_bookmark_enrich(spark, make_items, make_comments):
    df = make_items(dict(url="https://e/1"), dict(url="https://e/2"), dict(url=""), dict(url="https://e/3"))
    counts = spark.createDataFrame([("https://e/1", " 12 "), ("https://e/2", "  "), ("", "9")], "url string, count string")
    c = make_comments(dict(url="https://e/1"), dict(url="https://e/1"), dict(url="https://e/3"))
    out = enrich.bookmark_enrich(df, counts, c).orderBy("pos").collect()
    assert [(r.bookmark_count, r.comment_count) for r in out] == [("12", 2), ("0", 0), ("", 0), ("", 1)]


def test_clean_truncate_matches_full_clean(spark):
    import random

    from pyspark.sql import functions as F

    from feedloom.functions.text import clean_text, clean_truncate, truncate_runes
    rnd = random.Random(3)
    texts = []
    for _ in range(60):
        parts = []
        for _ in range(rnd.randint(0, 400)):
            parts.append(rnd.choice(["a", "bé", "x y", " ", "\n\n", "\t", "　", " " * rnd.randint(1, 3000)]))
        texts.append("".join(parts))
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    rows = df.select(clean_truncate(F.col("t"), 160).alias("a"),
                     truncate_runes(clean_text(F.col("t")), 160).alias("b")).collect()
    assert all(r.a == r.b for r in rows)


def test_latest_capture_wins(spark, make_items):
    import datetime as dt
    pages = spark.createDataFrame(
        [("https://e/1", 200, "<title>old</title>", dt.datetime(2026, 1, 1)),
         ("https://e/1", 200, "<title>new</title>", dt.datetime(2026, 2, 1))],
        "url string, status int, html string, fetched_at timestamp")
    out = enrich.ogp_enrich(make_items(dict(url="https://e/1")), pages).collect()
    assert [(r.title, r.page_title) for r in out] == [("new", "new")]


def test_all_references_are_decoded(spark, make_items):
    html = ("<head><title>A&eacute; &mdash; it&#8217;s &#x1F30A;</title></head><body><article><p>caf&eacute; &#8212; &lt;b&gt; "
            "&amp; &copy 2 &notit; &nosuch; &#0;</p></article></body>")
    pages = spark.createDataFrame([("https://e/1", 200, html)], PAGES_SCHEMA)
    out = enrich.content_enrich(make_items(dict(url="https://e/1")), pages).first()
    assert out.content == "café — <b> & © 2 ¬it; &nosuch; \ufffd"
    assert enrich.ogp_enrich(make_items(dict(url="https://e/1")), pages).first().page_title == "Aé — it’s 🌊"


def test_nested_containers_and_quoted_attributes(spark, make_items):
    pages = spark.createDataFrame([
        ("https://e/1", 200, "<body>x<article>one <article>two</article> three</article><article>four</article></body>"),
        ("https://e/2", 200, "<main><nav>menu <nav>more</nav> still</nav><p title=\"a > b\">kept</p><!-- <p>no</p> --></main>"),
        ("https://e/3", 200, "<meta content=\"say name='x' here\" name=\"description\"><META Property=og:image content=i.png>"
                             "<script>'<meta name=description content=no>'</script>plain"),
        ("https://e/4", 200, "<article> <script>a</script></article><body><p>rest"),
    ], PAGES_SCHEMA)
    items = make_items(*[dict(url=f"https://e/{i}") for i in range(1, 5)])
    assert [r.content for r in enrich.content_enrich(items, pages).orderBy("pos").collect()] == [
        "one two three", "kept", "plain", "rest"]
    r = enrich.ogp_enrich(items, pages).orderBy("pos").collect()[2]
    assert (r.meta_description, r.og_image) == ("say name='x' here", "i.png")


def test_pages_are_read_whole(spark, make_items):
    long = "<body><p>" + "é" * (2 << 20) + "</p><article>behind it</article><meta name=description content=last></body>"
    pages = spark.createDataFrame([("https://e/1", 200, long)], PAGES_SCHEMA)
    assert enrich.content_enrich(make_items(dict(url="https://e/1")), pages).first().content == "behind it"
    assert enrich.ogp_enrich(make_items(dict(url="https://e/1")), pages).first().meta_description == "last"


def test_malformed_pages_take_linear_time():
    import time

    from feedloom.functions.html import _page_parts
    start = time.monotonic()
    for unit in ('<a href="x', "<!", "<a<a", '<a "', "<p a='\"", "</a b='", "<script", "<!--"):
        _page_parts(unit * 200_000)
    assert time.monotonic() - start < 60  # each try reaching to the end would take hours


def test_markup_tokens_as_by_a_search_for_each():
    import random
    import re

    from feedloom.functions.html import _tokens
    markup = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([A-Za-z][^\s/<>]*+)((?:[^>"']|"[^"]*"|'[^']*')*)>""", re.S)
    rng = random.Random(5)
    for _ in range(3000):
        page = "".join(rng.choice(["<", "<a", "</a", ">", '"', "'", " ", "x", "<!", "--", "<!--", "<b ", "/"]) for _ in range(rng.randint(0, 18)))
        assert [(s, e, c, n) for s, e, c, n, _ in _tokens(page)] \
            == [(m.start(), m.end(), bool(m[1]), m[2] or "") for m in markup.finditer(page)], page


def test_title_of_pages_without_an_end_tag(spark):
    from feedloom.functions.html import page_title
    pages = ["<title>a</title>", "<title x='1'> b </TITLE >", "<title>open", "<title", "<title>" * 50_000, "no title", None,
             "<title a <title>c</title>"]
    got = spark.createDataFrame([(i, p) for i, p in enumerate(pages)], "i int, p string").select("i", page_title("p").alias("t"))
    assert [r.t for r in got.orderBy("i").collect()] == ["a", "b", "", "", "", "", "", "c"]
