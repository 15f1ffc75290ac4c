import gzip
import hashlib
import os
import random

import pytest

from feedloom.llm import queries, warc


def brute(rows):
    first = {}
    for i, h in rows:
        b = (h or "").encode()
        if len(b) >= 100 and i is not None:
            first[b] = min(i, first.get(b, i))
    count = {}
    for _, h in rows:
        count[(h or "").encode()] = count.get((h or "").encode(), 0) + 1
    out = []
    for i, h in rows:
        b = (h or "").encode()
        f = first.get(b) if count[b] > 1 else None
        again = f is not None and (i is None or i > f)
        out.append((str(i), len(b), hashlib.sha256(b).hexdigest(), "revisit" if again else "response", str(f if again else None)))
    return sorted(out)


def run(spark, rows):
    df = spark.createDataFrame([(i, f"http://x.test/{i} \r\né", h, 1) for i, h in rows], "page_id long, url string, html string, first int")
    return sorted((str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, str(r.refers_to)) for r in warc.round_trip(df).collect())


@pytest.fixture
def small_ranges(spark):
    keys = {"spark.sql.files.maxPartitionBytes": "997", "spark.sql.files.openCostInBytes": "1"}
    old = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def pages():
    rnd = random.Random(8)
    long = "<p>same é</p>" * 40
    rows = [(i, rnd.choice([long, "x" * 99, "x" * 100, "", None, "日本" * rnd.randint(1, 400),
                            "".join(chr(rnd.randint(33, 1200)) for _ in range(rnd.randint(0, 3000)))])) for i in range(-3, 120)]
    return rows + [(5, long), (5, long), (None, long), (None, "y")]


def test_round_trip_equals_brute_force(spark):
    assert run(spark, pages()) == brute(pages())
    assert run(spark, []) == []


def test_any_cut_into_ranges_gives_the_same(spark, small_ranges):
    assert run(spark, pages()) == brute(pages())


def test_archives_are_plain_gzip(spark, tmp_path):
    df = spark.createDataFrame([(i, None, f"page {i} " * 30) for i in range(40)], "page_id long, url string, html string")
    warc.write_archives(df, str(tmp_path / "w"))
    raw = b"".join(gzip.decompress((tmp_path / "w" / f).read_bytes()) for f in os.listdir(tmp_path / "w") if f.startswith("part"))
    assert raw.count(b"WARC/1.1\r\n") == 40 and b"page 7 page 7" in raw


def member(i, payload, stored=False):
    head = f"WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:x:{i}>\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    return gzip.compress(head + payload + b"\r\n\r\n", compresslevel=0 if stored else 6)


@pytest.mark.parametrize("cut", ["700", "2000", "100000"])
def test_foreign_archives_false_magic_and_damage(spark, tmp_path, cut):
    rnd = random.Random(1)
    noise = lambda n: rnd.randbytes(n)
    inner = [b"".join(noise(rnd.randint(0, 400)) + warc.MAGIC + noise(rnd.randint(0, 400)) for _ in range(rnd.randint(0, 6)))
             for _ in range(60)]
    os.makedirs(tmp_path / "w")
    whole = [member(i, p, stored=True) for i, p in enumerate(inner)]
    (tmp_path / "w" / "a.warc").write_bytes(b"".join(whole[:30]) + b"\n\n garbage " + b"".join(whole[30:50]))
    damaged = bytearray(whole[50])
    damaged[-8] ^= 0xFF  # the checksum
    (tmp_path / "w" / "b.warc").write_bytes(bytes(damaged) + b"".join(whole[51:59]) + whole[59][:len(whole[59]) // 2])
    (tmp_path / "w" / "empty.warc").write_bytes(b"")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", cut)
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    got = warc.read_archives(spark, str(tmp_path / "w")).collect()
    spark.conf.set("spark.sql.files.maxPartitionBytes", old[0])
    spark.conf.set("spark.sql.files.openCostInBytes", old[1])
    ok = {r.record_id: bytes(r.payload) for r in got if r.complete}
    assert ok == {f"urn:x:{i}": inner[i] for i in range(59) if i != 50}
    assert sum(not r.complete for r in got) == 2


def test_query_on_the_small_tables(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.page_id, r.html) for r in spark.read.parquet(f"{sf}/pages.parquet").collect()]
    got = sorted((str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, str(r.refers_to))
                 for r in queries.op6_warc(spark, sf).collect())
    assert got == brute(rows)
