import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from feedloom.llm import prefix_trie


def rebuild(rows):
    """``(conv_id, turn, role, text)`` -> turns of each rebuilt conversation."""
    own = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            own[c].append(((t is not None, t or 0), (r or "", x or "")))
    own = {c: [x for _, x in sorted(v, key=lambda y: y[0])] for c, v in own.items()}
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - int(np.fmod(c, 100))
        out[c] = own.get(base, [])[:h] + turns[h:]
    return out


def brute(convs):
    members = defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    children = defaultdict(list)
    for k in members:
        if k:
            children[k[:-1]].append(k)
    out = []
    for k, ms in members.items():
        leaves, kept, todo = 0, 0, [k]
        while todo:
            x = todo.pop()
            todo += children[x]
            leaves += not children[x]
            kept += (len(members[x]) - 1) * (len(x[-1][1]) if x else 0)
        ends = ",".join(map(str, sorted(c for c in ms if len(convs[c]) == len(k))))
        out.append((min(ms), len(k), min(members[k[:-1]]) if k else None, len(ms), len(children[k]), leaves, kept,
                    hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def rows_of(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=str)


def conversations(seed):
    rnd = random.Random(seed)
    rows = []
    for c in [*range(0, 60), *range(100, 130), *range(205, 212), 3000, -1, -50, -150, 10**12 + 7, -2**63, 2**63 - 1]:
        for t in range(rnd.choice([1, 1, 2, 3, 5, 9, 17])):
            text = rnd.choice(["a", "bb", "é日𝄞", "", None]) if t % 4 else rnd.choice(["x", "x", "yy"])
            rows.append((c, t, rnd.choice(["user", "user", None]), text))
    rows += [(c, t, "user", "same" if t < 3 else "late") for c in range(400, 460) for t in range(4)]  # copies
    rows += [(700, t, "user", f"turn {t % 7}") for t in range(150)] + [(701, t, "user", f"turn {t % 7}") for t in range(151)]
    rows += [(800, None, "user", "first"), (800, 0, "user", "second"), (None, 0, "user", "nobody"), (901, 0, "user", "z" * 50000)]
    rnd.shuffle(rows)
    return rows


@pytest.mark.parametrize("segment, block_rows", [(64, 1 << 13), (2, 3), (1, 1), (5, 16)])
def test_trie_equals_brute_force(spark, segment, block_rows):
    rows = conversations(segment)
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "conv_id long, turn int, role string, text string, depth int, n long") \
        .repartition(7)
    got = rows_of(prefix_trie.prefix_trie(df, segment=segment, block_rows=block_rows))
    assert got == brute(rebuild(rows))


def test_turnless_conversations_end_at_the_root(spark):
    ids = [c for c in range(1, 100) if zlib.crc32(str(c).encode()) % 6 > 2][:4]  # base 0 is absent
    rows = [(c, t, "user", "x") for c in ids for t in range(2)]
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")
    assert rows_of(prefix_trie.prefix_trie(df)) == brute(rebuild(rows))
    assert len(rows_of(prefix_trie.prefix_trie(df))) == 1


def test_repeated_rows_are_turns_and_empty_table_has_no_node(spark):
    rows = [(0, 0, "user", "x")] * 3 + [(0, 1, "user", "y")]
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")
    assert rows_of(prefix_trie.prefix_trie(df)) == brute(rebuild(rows))
    assert prefix_trie.prefix_trie(df.where("false")).count() == 0


def test_ranges_that_cut_a_conversation(spark):
    rows = [(5, t, "user", str(t)) for t in range(2000)] + [(6, 0, "user", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")
    got = {r["place"] for r in prefix_trie.numbered(df).where("conv_id = 5").collect()}
    assert got == set(range(1, 2001))


def test_extents_by_sparse_table():
    rnd = np.random.default_rng(1)
    for _ in range(100):
        v = rnd.integers(0, 4, rnd.integers(1, 60))
        t = prefix_trie.SparseTable(v)
        at, least = rnd.integers(0, len(v), 50), rnd.integers(0, 5, 50)
        for i, need, lo, hi in zip(at, least, t.left(at, least), t.right(at, least)):
            a = b = i
            while a > 0 and v[a] >= need:
                a -= 1
            while b + 1 < len(v) and v[b + 1] >= need:
                b += 1
            assert (lo, hi) == (a, b)
        lo = np.minimum(at, at[::-1])
        hi = np.maximum(at, at[::-1])
        assert t.minimum(lo, hi).tolist() == [v[x:y + 1].min() for x, y in zip(lo, hi)]
