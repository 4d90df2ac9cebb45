"""WARC archives: an index first, then coalesced reads of byte ranges.

:func:`write` puts one record per row into archives in a shared folder, each record a gzip member of
its own, and returns the index: archive, offset, length, URL and payload digest per record. Of records
with equal payloads of at least ``LEAST`` bytes, that with the smallest id is a response and the others
are revisits, which hold the original's HTTP headers but no payload. :func:`read` takes any selection
of index rows, sorts them by archive and offset, joins ranges that lie near each other and reads each
joined range once.

Each task writes archives under names of its own and reports only what it wrote, so a task that is
tried again leaves at worst an archive that no index names. Archives are reached through
``pyarrow.fs``, so the shared folder may be local or remote.

Defined results: null payloads are empty; a null id is kept as null and is always a response; rows
that repeat an id and a payload are responses alike where that id is the smallest; rows that repeat an
id with other payloads are told apart by these; a null URL is
written as ``urn:none``; an empty table gives an empty index.
"""

from __future__ import annotations

import gzip
import hashlib
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palaver.llm import common

#: Payloads smaller than this are always stored; an archive is closed beyond so many bytes.
LEAST, ARCHIVE_BYTES = 100, 1 << 30
#: Ranges are joined across gaps up to the first size, and up to the second size in all.
GAP, RANGE_BYTES = 1 << 16, 1 << 23
#: A task reads about so many bytes of archives.
TASK_BYTES = 1 << 24
RECORD_ID, DATE = "urn:palaver:page:", "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
INDEX = "page_id long, url string, archive string, offset long, length long, digest string, record_type string"


def classify(pages: DataFrame, id_col: str, payload_col: str, least: int = LEAST) -> DataFrame:
    """The rows that are revisits: ``page_id`` and payload digest, and the id of the response that they refer to."""
    keys = pages.select(pages[id_col].alias("page_id"), common.utf8(payload_col).alias("p")).filter(F.octet_length("p") >= least).select("page_id", F.sha2("p", 256).alias("digest"))
    keys = common.materialize(keys, "digests")
    groups = keys.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    groups = common.materialize(groups, "groups")  # as a table, so that the join can split a payload that a third of all rows have
    return common.holding(keys.join(groups, "digest").filter("page_id <> refers_to").select("page_id", "digest", "refers_to").distinct(), keys, groups)


def _clean(url: str) -> str:
    return "".join(f"%{ord(c):02X}" if ord(c) < 33 or ord(c) == 127 else c for c in url)


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> tuple[bytes, str]:
    """An uncompressed record, and the bare digest of its payload."""
    digest = hashlib.sha256(payload).hexdigest()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if refers_to is None else http
    lines = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <{RECORD_ID}{'' if page_id is None else page_id}>", f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {_clean(url) if url else 'urn:none'}", f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    if refers_to is not None:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{RECORD_ID}{refers_to}>"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n", digest


def parse(data: bytes) -> dict:
    """Headers, HTTP headers and payload of one uncompressed record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    if not first.startswith("WARC/1."):
        raise ValueError(f"not a WARC record: {first[:20]!r}")
    headers = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
    block = rest[: int(headers["content-length"])]
    if rest[len(block) :] != b"\r\n\r\n":
        raise ValueError("a record cut off")
    http, _, payload = block.partition(b"\r\n\r\n")
    http_headers = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in http.decode().split("\r\n")[1:])}
    return {"headers": headers, "http": http_headers, "payload": payload}


def _place(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri}" if uri.startswith("/") else uri)


def write(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least: int = LEAST, folder: str | None = None) -> DataFrame:
    """Writes the archives and returns their index. Without a ``folder`` they go below the shared one and
    with the application."""
    spark = pages.sparkSession
    told = classify(pages, id_col, payload_col, least)
    revisits = common.materialize(told, "revisits")
    common.drop(told)
    folder = folder or common.scratch(spark, "warc")
    rows = pages.select(pages[id_col].cast("long").alias("page_id"), pages[url_col].alias("url"), common.utf8(payload_col).alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256)).join(revisits, ["page_id", "digest"], "left")

    def run(batches):
        place, base = _place(folder)
        place.create_dir(base, recursive=True)
        out, name, at = None, "", 0
        try:
            for batch in batches:
                index = []
                for page_id, url, payload, refers_to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if out is None or at > ARCHIVE_BYTES:
                        if out is not None:
                            out.close()
                        name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                        out = place.open_output_stream(f"{base}/{name}", compression=None)
                    data, digest = record(page_id, url, payload, refers_to)
                    packed = gzip.compress(data, 1, mtime=0)
                    out.write(packed)
                    index.append((page_id, url, f"{folder}/{name}", at, len(packed), digest, "response" if refers_to is None else "revisit"))
                    at += len(packed)
                columns = list(zip(*index, strict=True)) or [()] * 7
                kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["page_id", "url", "archive", "offset", "length", "digest", "record_type"])
        finally:
            if out is not None:
                out.close()

    index = common.materialize(rows.select("page_id", "url", "payload", "refers_to").transform(common.in_batches).mapInArrow(run, INDEX), "index")
    common.drop(revisits)
    return index


def coalesce(spans: list[tuple[int, int]], gap: int = GAP, most: int = RANGE_BYTES) -> list[tuple[int, int, int, int]]:
    """Joined ranges of sorted (offset, length): first span, span after the last, first byte, byte after the last."""
    out: list[tuple[int, int, int, int]] = []
    for i, (offset, length) in enumerate(spans):
        if out and offset - out[-1][3] <= gap and offset + length - out[-1][2] <= most:
            a, _, begin, end = out[-1]
            out[-1] = a, i + 1, begin, max(end, offset + length)
        else:
            out.append((i, i + 1, offset, offset + length))
    return out


READ = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"


def read(index: DataFrame, with_payload: bool = True) -> DataFrame:
    """The records that the index rows name. Revisits tell size and digest of the original's payload."""
    spans = index.select("archive", "offset", "length")
    tasks = -(-(spans.agg(F.sum("length")).first()[0] or 1) // TASK_BYTES)
    picked = spans.repartitionByRange(tasks, "archive", "offset").sortWithinPartitions("archive", "offset")

    def told(data: bytes) -> tuple:
        r = parse(data)
        h, payload = r["headers"], r["payload"]
        own, refers = h["warc-record-id"][len(RECORD_ID) + 1 : -1], h.get("warc-refers-to")
        claimed = h["warc-payload-digest"].removeprefix("sha256:")
        kind, size = h["warc-type"], int(r["http"]["content-length"])
        if kind == "response" and (hashlib.sha256(payload).hexdigest() != claimed or len(payload) != size):
            raise ValueError(f"record {own} does not match its digest")
        return int(own) if own else None, h["warc-target-uri"], kind, int(refers[len(RECORD_ID) + 1 : -1]) if refers else None, size, claimed, payload if with_payload and kind == "response" else None

    kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary())
    names = [x.split(" ")[0] for x in READ.split(", ")]

    def run(batches):
        opened: dict[str, object] = {}
        for batch in batches:
            rows = list(zip(*(c.to_pylist() for c in batch.columns), strict=True))
            first = 0
            while first < len(rows):
                archive, last = rows[first][0], first
                while last < len(rows) and rows[last][0] == archive:
                    last += 1
                if archive not in opened:
                    for f in opened.values():
                        f.close()
                    place, path = _place(archive)
                    opened = {archive: place.open_input_file(path)}
                mine = [(o, n) for _, o, n in rows[first:last]]
                for a, b, begin, end in coalesce(mine):
                    opened[archive].seek(begin)
                    data = opened[archive].read(end - begin)
                    found = [told(zlib.decompress(data[o - begin : o - begin + n], 31)) for o, n in mine[a:b]]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found, strict=True), kinds, strict=True)], names)
                first = last
        for f in opened.values():
            f.close()

    return picked.transform(common.in_batches).mapInArrow(run, READ)


def op3_warc(spark, sf_dir: str) -> DataFrame:
    index = write(common.table(spark, sf_dir, "pages"))
    return read(index, with_payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP3_SQL = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
g AS (SELECT payload_digest, min(page_id) AS first_id FROM p WHERE payload_bytes >= 100 GROUP BY payload_digest)
SELECT p.page_id, CAST(p.payload_bytes AS BIGINT) AS payload_bytes, p.payload_digest,
  CASE WHEN g.first_id IS NULL OR p.page_id = g.first_id OR p.payload_bytes < 100 THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN p.payload_bytes >= 100 AND p.page_id <> g.first_id THEN g.first_id END AS refers_to
FROM p LEFT JOIN g USING (payload_digest)
"""
