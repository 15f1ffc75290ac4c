import random
import re
from collections import Counter, defaultdict

import pytest

from feedloom.llm import line_dedup as D

TOKEN = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, min_docs, depth=3, similarity=0.8, min_tokens=3):
    mask = lambda t: "<*>" if re.search("[0-9]", t) else t
    own = {(d, line) for d, t in rows if d is not None and t for line in t.split("\n") if len(TOKEN.findall(line)) >= min_tokens}
    leaf = lambda line: (len(TOKEN.findall(line)), *[mask(t) for t in TOKEN.findall(line)[:depth]])
    docs = defaultdict(set)
    for d, line in own:
        docs[leaf(line)].add(d)
    own = {(d, line) for d, line in own if len(docs[leaf(line)]) >= min_docs}
    counts = Counter((leaf(line), i, mask(t)) for d, line in own for i, t in enumerate(TOKEN.findall(line)))
    template, users = {}, defaultdict(set)
    for d, line in own:
        ts = [mask(t) for t in TOKEN.findall(line)]
        kept = [t == "<*>" or counts[leaf(line), i, t] >= min_docs for i, t in enumerate(ts)]
        fixed = [k and t != "<*>" for k, t in zip(kept, ts)]
        if sum(kept) >= similarity * len(ts) - 1e-9 and 2 * sum(fixed) >= len(ts):
            template[line] = (leaf(line), tuple(t if k else "<*>" for k, t in zip(kept, ts)))
            users[template[line]].add(d)
    gone = lambda d, line: line in template and len(users[template[line]]) >= min_docs and (
        d in users[template[line]] and d != min(users[template[line]]))
    out = []
    for d, t in rows:
        lines = t.split("\n") if t else []
        kept = [line for line in lines if not gone(d, line)]
        out.append((-1 if d is None else d, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out)


def run(spark, rows, **p):
    df = spark.createDataFrame([(d, t, 1, ["x"]) for d, t in rows], "doc_id long, text string, leaf int, lines array<string>")
    return sorted((-1 if r[0] is None else r[0], *r[1:]) for r in D.dedup(df, **p).collect())


@pytest.mark.parametrize("seed", [1, 2])
def test_random_lines_equal_brute_force(spark, seed):
    rnd = random.Random(seed)
    names = [f"{a}{b}" for a in "abcdefgh" for b in "xyz"]
    forms = [lambda: f"Posted by user {rnd.choice(names)} on page {rnd.randint(1, 99)} of this very fine site",
             lambda: "All rights reserved.", lambda: f"Call {rnd.randint(100, 999)} now or never",
             lambda: " ".join(rnd.choice(names) for _ in range(rnd.randint(0, 9))),
             lambda: f"the {rnd.choice('ab')} {rnd.choice('cd')} {rnd.choice(names)}", lambda: ""]
    rows = [(d, "\n".join(rnd.choice(forms)() for _ in range(rnd.randint(0, 8)))) for d in rnd.sample(range(500), 90)]
    got = run(spark, rows, min_docs=8)
    assert got == brute(rows, 8) and sum(r[2] for r in got) > 50


def test_edges(spark):
    line = "This line is everywhere , always ."
    rows = [(i, f"{line}\nown text number {'abcdefghij'[i]} here") for i in range(10)] + [
        (3, line), (None, line), (20, None), (21, ""), (22, "\n\n"), (23, " ".join(["long"] * 30000)), (24, line), (25, line + " x")]
    assert run(spark, rows, min_docs=5) == brute(rows, 5)
    assert run(spark, [], min_docs=5) == []


def test_stage_keeps_columns_and_untouched_rows(spark):
    line = "This line is everywhere , always ."
    rows = [(i, f"{line}\nown {i}", "en", 7) for i in range(6)] + [(9, line, "de", 7), (10, "  ", "fr", 7), (11, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, n_chars long")
    out = D.without_recurring_lines(df, min_docs=5)
    assert out.columns == df.columns and out.dtypes == df.dtypes
    got = {r.doc_id: r for r in out.collect()}
    assert sorted(got) == [0, 1, 2, 3, 4, 5, 10, 11]
    assert got[0].text == rows[0][1] and got[0].n_chars == 7
    assert got[4].text == "own 4" and got[4].n_chars == 5 and got[11].text is None
