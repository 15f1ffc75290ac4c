import random
import re

from feedloom.llm import decontamination as D

WORD = re.compile("[a-z0-9\x80-\U0010ffff]+")


def shingles(text, k):
    ws = WORD.findall((text or "").lower())
    return {tuple(ws[i:i + k]) for i in range(len(ws) - k + 1)}


def brute(docs, items, t=0.8):
    out = []
    for item_id, text in set(items):
        n = len(WORD.findall((text or "").lower()))
        own = shingles(text, min(5, n)) if n else set()
        for d, doc in docs:
            got = len(own & shingles(doc, min(5, n))) if n else 0
            if own and got >= t * len(own):
                out.append((d, item_id, got, len(own), got / len(own)))
    return sorted(out)


def frames(spark, docs, items):
    return (spark.createDataFrame([(d, t, "z", [1]) for d, t in docs], "doc_id long, text string, item_id string, hits array<int>"),
            spark.createDataFrame([(i, t, 3) for i, t in items], "item_id long, text string, doc_id int"))


def cases():
    rnd = random.Random(5)
    vocab = [f"w{i}" for i in range(60)] + ["été", "Über", "don't"]
    text = lambda n: " ".join(rnd.choice(vocab) for _ in range(n))
    items = [(i, text(rnd.choice([1, 2, 3, 4, 5, 6, 9, 20, 60, 200]))) for i in range(40)]
    docs = []
    for d in range(120):
        own = rnd.choice(items)[1].split()
        for _ in range(rnd.randint(0, 4)):
            own[rnd.randrange(len(own))] = "changed"
        docs.append((d, text(rnd.randint(0, 300)) + rnd.choice(["\n", ", ", " "]) + " ".join(own).upper() + ". " + text(30)))
    return docs, items


def test_search_equals_brute_force(spark):
    docs, items = cases()
    df, bench = frames(spark, docs, items)
    got = sorted(map(tuple, D.search(df, bench).collect()))
    assert got == brute(docs, items) and len(got) > 30


def test_blocks_of_items_give_the_same(spark, monkeypatch):
    docs, items = cases()
    df, bench = frames(spark, docs, items)
    monkeypatch.setattr(D, "BLOCK_BYTES", 1000)
    assert len(D._item_blocks(bench)) > 2
    assert sorted(map(tuple, D.search(df, bench).collect())) == brute(docs, items)
    kept = D.remove_contaminated(df, bench)
    assert kept.columns == df.columns
    bad = {r[0] for r in brute(docs, items)}
    assert sorted(r.doc_id for r in kept.collect()) == sorted(d for d, _ in docs if d not in bad)


def test_edges(spark):
    passage = " ".join(f"p{i}" for i in range(40))
    docs = [(1, None), (2, ""), (3, "-- !! \n"), (4, passage), (4, passage), (5, "x " * 50000 + passage), (6, passage[:100]), (7, "one")]
    items = [(1, passage), (1, passage), (2, None), (3, ""), (4, "..."), (5, "one"), (6, passage)]
    df, bench = frames(spark, docs, items)
    assert sorted(map(tuple, D.search(df, bench).collect())) == brute(docs, [i for i in items])
    assert D.search(df, bench.where("false")).count() == 0 and D.remove_contaminated(df, bench.where("false")).count() == len(docs)
    assert D.search(df.where("false"), bench).count() == 0
    nul = spark.createDataFrame([(None, passage), (None, "clean text here")], "doc_id long, text string")
    assert [r.text for r in D.remove_contaminated(nul, bench).collect()] == ["clean text here"]
