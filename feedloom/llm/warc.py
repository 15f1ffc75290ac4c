"""WARC archives of gzip members: a writer, and a splittable reader.

Writer: one gzip member per record.  Spark's text writer stores the bytes as
they are; its separator between records is an empty gzip member, so an archive
is a plain sequence of members that any gzip tool reads.

Reader: archives are cut into byte ranges at any place.  The task of a range
looks for the gzip magic, through Spark's text reader with the magic as record
separator, and owns what starts inside its range; the reader reads on beyond the
range's end for the last one.  The magic also occurs by chance inside compressed
data, so every candidate is validated by decoding its header; a piece that is no
header goes on the member before it.  If that member began in another range, the
pieces meet by file and place; that is the only shuffle, of rare rows.

Archives must not be named ``*.gz``: Spark would decode such files itself, whole."""

from __future__ import annotations

import gzip
import hashlib
import re
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from feedloom.llm.common import on_workers, saved
from feedloom.session import checkpoint_dir

MAGIC = b"\x1f\x8b\x08"
EMPTY_MEMBER = gzip.compress(b"", mtime=0)
# Fixed values of the format.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ID = "urn:page:"
DATE = "2026-01-01T00:00:00Z"

RECORD = ("warc_type string, record_id string, target_uri string, refers_to string, headers map<string,string>, "
          "payload binary, payload_bytes long, payload_digest string, complete boolean")


# --- writing ------------------------------------------------------------------------------

def _record(page_id: int | None, url: str | None, payload: bytes, first: int | None) -> bytes:
    revisit = first is not None and (page_id is None or page_id > first)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}",
            f"WARC-Record-ID: <{ID}{'' if page_id is None else page_id}>", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    if revisit:
        head += [f"WARC-Refers-To: <{ID}{first}>", f"WARC-Profile: {PROFILE}"]
    head += [f"WARC-Payload-Digest: sha256:{hashlib.sha256(payload).hexdigest()}",
             "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return gzip.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n", mtime=0)


def write_archives(pages: DataFrame, path: str, least_bytes: int = 100) -> None:
    """Write a record per row of ``pages(page_id, url, html)`` to archives under
    ``path``.

    Of rows with equal payloads of at least ``least_bytes`` the smallest page_id
    is the response and the others revisit it; rows that share the smallest id
    are all responses, rows without an id revisit.  Null html is an empty
    payload.  Other columns are ignored."""
    on_workers(pages.sparkSession)
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                         F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html")) \
        .withColumn("digest", F.sha2("html", 256))
    first = saved(pages.where(F.octet_length("html") >= least_bytes).groupBy("digest")
                  .agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", "first"),
                  "first-pages")

    def run(batches):
        for batch in batches:
            rows = zip(*(c.to_pylist() for c in batch.columns))
            yield pa.RecordBatch.from_arrays(
                [pa.array([_record(i, u, h.encode(), f) for i, u, h, f in rows], pa.binary())], ["value"])

    pages.join(first, "digest", "left").select("page_id", "url", "html", "first").mapInArrow(run, "value binary") \
        .select(F.col("value").cast("string").alias("value")) \
        .write.option("encoding", "ISO-8859-1").option("lineSep", EMPTY_MEMBER.decode("latin-1")).text(path)


# --- reading ------------------------------------------------------------------------------

def _decode(data: bytes) -> tuple[bytes | None, bool, bool]:
    """What a candidate member decodes to (None: it is no record), if it is whole,
    and if it is damaged.  A short candidate may decode to nothing yet."""
    d = zlib.decompressobj(31)
    try:
        out = d.decompress(data)
        broken = False
    except zlib.error:
        broken = True
        try:
            out = zlib.decompressobj(31).decompress(data, 512)
        except zlib.error:
            return None, False, True
    if out[:5] != b"WARC/"[:len(out)] or (broken and not out):
        return None, False, True
    return out, d.eof and not broken, broken


class Members:
    """Puts the pieces between magics together to members; ``found`` gets the
    records as (bytes, whole)."""

    def __init__(self):
        self.held, self.found = None, []

    def feed(self, piece: bytes) -> None:
        data = piece if self.held is None else self.held + piece
        out, whole, broken = _decode(data)
        if self.held is not None and broken:
            self.end()  # what was held is damaged, or was no member; this piece may begin one
            return self.feed(piece)
        self.held = None
        if out and (whole or broken):
            self.found.append((out, whole))
        elif not broken and not whole:
            self.held = data

    def end(self) -> None:
        """Nothing more follows what is held."""
        if self.held is not None and (out := _decode(self.held)[0]):
            self.found.append((out, False))
        self.held = None


def _fields(lines: bytes) -> dict[str, str]:
    out = {}
    for line in lines.decode("utf-8", "replace").split("\r\n")[1:]:
        name, colon, value = line.partition(":")
        if colon:
            out[name.strip().lower()] = value.strip()
    return out


def _row(record: bytes, complete: bool) -> tuple:
    head, _, rest = record.partition(b"\r\n\r\n")
    fields = _fields(head)
    length = fields.get("content-length", "")
    block = rest[:int(length)] if length.isdigit() else rest
    payload, size = block, None
    if fields.get("content-type", "").startswith("application/http"):
        http, _, payload = block.partition(b"\r\n\r\n")
        told = _fields(http).get("content-length", "")
        size = int(told) if told.isdigit() else None
    bare = lambda name: fields[name].strip("<>") if name in fields else None
    if fields.get("warc-type") == "revisit":
        payload, digest = None, fields.get("warc-payload-digest", "").rpartition(":")[2] or None
    else:
        size, digest = len(payload), hashlib.sha256(payload).hexdigest()
    return (fields.get("warc-type"), bare("warc-record-id"), fields.get("warc-target-uri"), bare("warc-refers-to"),
            fields, payload, size, digest, complete)


_ARROW = pa.schema([
    ("warc_type", pa.string()), ("record_id", pa.string()), ("target_uri", pa.string()), ("refers_to", pa.string()),
    ("headers", pa.map_(pa.string(), pa.string())), ("payload", pa.binary()), ("payload_bytes", pa.int64()),
    ("payload_digest", pa.string()), ("complete", pa.bool_())])
_PIECE = "piece binary, opens boolean, seq int"
_FLUSH = 16 << 20


def _batch(found: list[tuple]) -> pa.RecordBatch:
    """Records and pieces as one batch; each row is one or the other."""
    columns = [pa.array([None if r is None or r[i] is None else list(r[i].items()) if isinstance(r[i], dict) else r[i]
                         for _, r, _ in found], f.type) for i, f in enumerate(_ARROW)]
    places = [pa.array([x[0][0] for x in found], pa.string()), pa.array([x[0][1] for x in found], pa.int64())]
    pieces = [pa.array([None if p is None else p[i] for _, _, p in found], t)
              for i, t in enumerate((pa.binary(), pa.bool_(), pa.int32()))]
    return pa.RecordBatch.from_arrays(places + columns + pieces, ["file", "block", *_ARROW.names, "piece", "opens", "seq"])


def _ranges(batches):
    """Records of each byte range; and pieces of members that cross ranges: those
    before the first sound header, and the open member at the end."""
    place, members, owns, heads, found, size = None, Members(), False, [], [], 0

    def records():
        out = [(place, _row(r, whole), None) for r, whole in members.found]
        members.found = []
        return out

    def end():
        if place is None:
            return
        if not owns:
            members.held = None
        found.extend((place, None, (p, False, i)) for i, p in enumerate(heads))
        if members.held is not None:
            found.append((place, None, (members.held, True, len(heads))))
        members.held = None

    for batch in batches:
        for file, block, value in zip(*(batch.column(i).to_pylist() for i in range(3))):
            if (file, block) != place:
                end()
                place, owns, heads = (file, block), block == 0, []
                if owns:
                    continue  # bytes before the file's first magic
            piece = MAGIC + value
            if not owns:
                heads.append(piece)
                members.feed(piece)
                done = members.found or members.held is not None and len(_decode(members.held)[0]) >= 5
                if not done and members.held is None and _decode(piece)[1]:
                    done = True  # an empty member
                if done:  # the range's first sound header: what came before it goes on an earlier member
                    owns = True
                    own = members.held if members.held is not None else None
                    taken = 1 if own is None else next(n for n in range(1, len(heads) + 1) if b"".join(heads[-n:]) == own)
                    heads = heads[:len(heads) - taken]
            else:
                members.feed(piece)
            size += sum(len(r) for r, _ in members.found)
            found.extend(records())
            if size >= _FLUSH or len(found) >= 4096:
                yield _batch(found)
                found, size = [], 0
    end()
    if found:
        yield _batch(found)


def _joined(batches):
    for batch in batches:
        found = []
        for pieces in batch.column(0).to_pylist():
            members = Members()
            for p in pieces:
                members.feed(p["piece"])
            members.end()
            found += [(("", 0), _row(r, whole), None) for r, whole in members.found]
        if found:
            yield _batch(found).select(_ARROW.names)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """One row per record of the archives under ``path``.

    ``payload_bytes`` and ``payload_digest`` (SHA-256) belong to the full payload:
    counted from it, or as a revisit record tells them.  ``payload`` is null for
    revisits.  A member cut off by the end of its file gives a row whose
    ``complete`` is false.  Bytes that belong to no member are passed over."""
    on_workers(spark)
    pieces_at = spark.read.option("encoding", "ISO-8859-1").option("lineSep", MAGIC.decode("latin-1")).text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.col("value").cast("binary").alias("value"))
    found = saved(pieces_at.mapInArrow(_ranges, f"file string, block long, {RECORD}, {_PIECE}"), "records")
    order = W.partitionBy("file").orderBy("block", "seq")
    crossing = found.where("piece is not null").select(
        "file", "block", "seq", "piece", F.sum(F.col("opens").cast("int")).over(order).alias("member")) \
        .groupBy("file", "member").agg(
            F.sort_array(F.collect_list(F.struct("block", "seq", "piece"))).alias("pieces")) \
        .select("pieces").mapInArrow(_joined, RECORD)
    return found.where("piece is null").select(*_ARROW.names).union(crossing)


def round_trip(pages: DataFrame, least_bytes: int = 100) -> DataFrame:
    """Write ``pages`` to archives in the shared folder and read them back:
    ``(page_id, payload_bytes, payload_digest, record_type, refers_to)``."""
    spark = pages.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/llm-warc-{uuid.uuid4().hex}"
    write_archives(pages, path, least_bytes)
    number = lambda c: F.regexp_extract(c, ID + r"(-?\d+)$", 1).try_cast("long")
    return read_archives(spark, path).select(
        number("record_id").alias("page_id"), "payload_bytes", "payload_digest", F.col("warc_type").alias("record_type"),
        number("refers_to").alias("refers_to"))
